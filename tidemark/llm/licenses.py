"""License scans: an Aho-Corasick automaton and a shunting-yard parser.

Texts are lower-cased (A-Z) and taken as words, runs of letters, digits and non-ASCII
characters. One automaton pass over the words, joined by single blanks, finds notice
phrases and identifier tags. After an SPDX-License-Identifier tag the original bytes up to the
end of the line hold a licence expression; a shunting-yard parser turns it into reverse
Polish form and evaluates it: OR is free to choose, AND binds, WITH attaches an exception.

Defined cases: null and empty texts have no words and no labels; malformed expressions
give the label ``spdx:invalid``; repeated rows are independent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import without
from .textbatch import ALNUM, doc_words

#: The contract's phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Further notice phrases.
NOTICE_PHRASES = {
    "apache license": "apache",
    "bsd license": "bsd",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "creative commons": "creative-commons",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mit license": "mit",
    "mozilla public license": "mpl",
    "permission is hereby granted free of charge": "mit-text",
    "public domain": "public-domain",
    "redistribution and use in source and binary forms": "bsd-text",
}
TAG = "spdx license identifier"

#: Licence ids counted as permissive when an expression is evaluated.
PERMISSIVE = frozenset("0bsd apache-2.0 bsd-2-clause bsd-3-clause cc-by-4.0 cc0-1.0 isc mit mit-0 unlicense zlib".split())

SCAN_COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
_TOKEN = re.compile(r"\s*(?:([()])|([A-Za-z0-9][A-Za-z0-9.+:\-]*))")
_BINDS = {"or": 1, "and": 2, "with": 3}


class ExpressionError(ValueError):
    """The text is no licence expression."""


def to_rpn(text: str) -> list[str]:
    """Shunting-yard: the expression in reverse Polish form. Operators are or, and, with."""
    out: list[str] = []
    held: list[str] = []
    at, operand = 0, True
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(text)
        at, word = m.end(), (m[1] or m[2]).lower()
        if word == "(":
            if not operand:
                raise ExpressionError(text)
            held.append(word)
        elif word == ")":
            if operand:
                raise ExpressionError(text)
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise ExpressionError(text)
            held.pop()
        elif word in _BINDS:
            if operand:
                raise ExpressionError(text)
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[word]:
                out.append(held.pop())
            held.append(word)
            operand = True
        else:
            if not operand:
                raise ExpressionError(text)
            out.append(word)
            operand = False
    if operand or "(" in held:
        raise ExpressionError(text)
    return out + held[::-1]


def evaluate(rpn: list[str]) -> tuple[bool, set[str]]:
    """(whether it can be met with permissive licences only, all ids named)."""
    stack: list[tuple[bool, set[str]]] = []
    for word in rpn:
        if word in _BINDS:
            (b, right), (a, left) = stack.pop(), stack.pop()
            value = a or b if word == "or" else a and b if word == "and" else a
            stack.append((value, left | right if word != "with" else left | {f"with-{x}" for x in right}))
        else:
            stack.append((word.removesuffix("+") in PERMISSIVE, {word}))
    return stack[0]


def expression_labels(text: str) -> set[str]:
    """Labels of one SPDX expression: its ids and whether permissive use is open."""
    try:
        open_, ids = evaluate(to_rpn(text))
    except ExpressionError:
        return {"spdx:invalid"}
    return {f"spdx:{x}" for x in ids} | {"spdx-permissive" if open_ else "spdx-restricted"}


def build_automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE_PHRASES), ("notice", NOTICE_PHRASES), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            words = phrase.split()
            automaton.add_word(f" {phrase} ", (kind, label, len(words), len(phrase) + 2))
    automaton.make_automaton()
    return automaton


def _scan(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build_automaton()
        for batch in batches:
            names, n = batch.schema.names, batch.num_rows
            n_words, n_base = np.zeros(n, np.int64), np.zeros(n, np.int64)
            first: list[int | None] = [None] * n
            last: list[int | None] = [None] * n
            base: list[set[str]] = [set() for _ in range(n)]
            more: list[set[str]] = [set() for _ in range(n)]
            col = batch.column(names.index(text))
            for d, e, w in doc_words(col, ALNUM):
                n_words[d:e] = w.counts
                # one string: words joined by blanks; a line feed, which no phrase holds, parts documents
                lens = w.end - w.start
                doc = w.doc()
                at = np.cumsum(lens + 1) - lens + 3 * doc  # where each word begins
                joined = np.full(int(lens.sum() + len(lens) + 3 * (e - d) + 4), 0x20, np.uint8)
                inner = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
                joined[np.repeat(at, lens) + inner] = w.buf[np.repeat(w.start, lens) + inner]
                heads = np.cumsum(w.counts)[:-1]
                ends = at[heads[heads > 0] - 1] + lens[heads[heads > 0] - 1] + 1 if len(lens) else np.zeros(0, int)
                joined[ends] = 0x0A
                whole = b""
                for end, (kind, label, size, length) in automaton.iter(joined.tobytes().decode("latin-1")):
                    word = int(np.searchsorted(at, end - length + 2))
                    j = int(doc[word])
                    place = word - int(w.first[j])
                    if kind == "base":
                        n_base[d + j] += 1
                        first[d + j] = place if first[d + j] is None else min(first[d + j], place)
                        last[d + j] = place if last[d + j] is None else max(last[d + j], place)
                        base[d + j].add(label)
                    elif kind == "notice":
                        more[d + j].add(label)
                    else:
                        whole = whole or w.buf.tobytes()
                        begin, stop = int(w.end[word + size - 1]), int(w.offs[j + 1])
                        line = whole.find(b"\n", begin, stop)
                        raw = whole[begin : stop if line < 0 else line]
                        raw = re.split(rb"\*/|-->|[\r;,'\"#]", raw.lstrip(b": \t"))[0]
                        more[d + j] |= expression_labels(raw.decode("utf-8", "replace"))
            labels = [sorted(a | b) for a, b in zip(base, more, strict=True)]
            columns = {name: batch.column(k) for k, name in enumerate(names) if name != text} | {
                "n_words": pa.array(n_words), "n_base": pa.array(n_base), "first_word": pa.array(first, pa.int64()), "last_word": pa.array(last, pa.int64()),
                "base_labels": pa.array([",".join(sorted(x)) for x in base]), "labels": pa.array([",".join(x) for x in labels]),
                "score": pa.array([1 - 0.5 ** len(x) for x in labels], pa.float64()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def scan_licenses(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` without the text, with n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is 1 - 2**-(number of distinct labels): 0 without any licence evidence.
    """
    df = without(docs, *(c for c in SCAN_COLUMNS if c != text))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != text)
    return df.mapInArrow(_scan(text), f"{kept}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double".lstrip(", "))
