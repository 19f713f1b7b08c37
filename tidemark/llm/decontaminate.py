"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Words are runs of letters and digits (A-Z lower-cased) and of non-ASCII characters. A
window is ``window`` consecutive words of one benchmark item; an item with fewer words,
but not none, is one window. Every document is scanned once; hash hits are verified word
by word. A document word inside any occurrence of a window is *hit*.

The benchmark is a query set: it is broadcast in blocks of at most ``max_windows`` windows
(8 bytes of hash and about 60 bytes of words each, so about 70 MB at the default). A larger
benchmark takes one pass over the documents for each block, hits accumulating in a column.
Cutting with several blocks goes in rounds: the hits of all blocks are gathered on the same text
and cut together, and texts that were cut go through all blocks again until none is hit, so
the result is that of one block.

Defined cases: null or empty texts and items have no words; repeated items with one id count
once; repeated documents are independent rows; a null item_id never enters the list of items
but its windows hit; result columns replace input columns of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, without
from .textbatch import ALNUM, doc_words, runs_hash, segment_sum

HIT_COLUMNS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
HITS = "_window_hits"


@dataclass
class Block:
    """Some windows: for each length its sorted hashes, words, and the items that hold them."""

    by_length: dict[int, tuple[np.ndarray, np.ndarray, list[bytes], list[list[str]]]]

    @staticmethod
    def build(windows: dict[bytes, tuple[int, int, set[str]]]) -> Block:
        lengths: dict[int, list[tuple[int, bytes, list[str]]]] = {}
        for words, (k, h, items) in windows.items():
            lengths.setdefault(k, []).append((h, words, sorted(items)))
        out = {}
        for k, rows in sorted(lengths.items()):
            rows.sort()
            hashes = np.array([r[0] for r in rows], np.uint64)
            bits = max(16, int(len(rows)).bit_length() + 6)
            seen = np.zeros(1 << min(bits, 26), bool)
            seen[hashes & np.uint64(len(seen) - 1)] = True
            out[k] = (hashes, seen, [r[1] for r in rows], [r[2] for r in rows])
        return Block(out)


def benchmark_blocks(rows: Iterator[tuple[object, str | None]], window: int, max_windows: int) -> Iterator[Block]:
    """Blocks of distinct windows. Items are split between blocks only as whole windows."""
    found: dict[bytes, tuple[int, int, set[str]]] = {}
    for item, text in rows:
        for _, _, w in doc_words(pa.array([text], pa.string()), ALNUM):
            n = len(w.start)
            if not n:
                continue
            k = min(window, n)
            hashes = runs_hash(w.hashes(), k)
            words = [w.buf[s:e].tobytes() for s, e in zip(w.start, w.end, strict=True)]
            for i, h in enumerate(hashes.tolist()):
                key = b" ".join(words[i : i + k])
                items = found.setdefault(key, (k, h, set()))[2]
                if item is not None:
                    items.add(str(item))
        if len(found) >= max_windows:
            yield Block.build(found)
            found = {}
    if found:
        yield Block.build(found)


def find_hits(w, block: Block) -> Iterator[tuple[int, int, list[str]]]:
    """(first word, number of words, items) of each verified occurrence, within one slice."""
    h = w.hashes()
    for k, (hashes, seen, words, items) in block.by_length.items():
        r = runs_hash(h, k)
        at = np.flatnonzero(seen[r & np.uint64(len(seen) - 1)])
        if not len(at):
            continue
        lo, hi = np.searchsorted(hashes, r[at], "left"), np.searchsorted(hashes, r[at], "right")
        doc_end = w.first[np.searchsorted(w.first, at, "right")]
        ok = (lo < hi) & (at + k <= doc_end)
        for i, a, b in zip(at[ok].tolist(), lo[ok].tolist(), hi[ok].tolist(), strict=True):
            key = b" ".join(w.buf[w.start[j] : w.end[j]].tobytes() for j in range(i, i + k))
            for j in range(a, b):
                if words[j] == key:
                    yield i, k, items[j]


def _without(raw: bytes, w, hit: np.ndarray) -> bytes:
    """Remove the hit words with what stands between them."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False]))))
    keep, at = [], 0
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        keep.append(raw[at : w.start[a]])
        at = int(w.end[b - 1])
    keep.append(raw[at:])
    return b"".join(keep)


def _cut(raw: bytes, block: Block) -> bytes:
    """Remove hit words with what stands between them, until no window occurs."""
    while True:
        for _, _, w in doc_words(pa.array([raw], pa.binary()), ALNUM):
            hit = np.zeros(len(w.start) + 1, np.int64)
            for i, k, _ in find_hits(w, block):
                hit[i] += 1
                hit[i + k] -= 1
            hit = np.cumsum(hit)[:-1] > 0
        if not len(raw) or not hit.any():
            return raw
        raw = _without(raw, w, hit)


def _cut_spans(text: str):
    """Cuts the words that the hits column names out of the text, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            values = batch.column(names.index(text)).cast(pa.binary()).to_pylist()
            for j, found in enumerate(batch.column(names.index(HITS)).to_pylist()):
                for _, _, w in doc_words(pa.array([values[j]], pa.binary()), ALNUM) if found["spans"] else ():
                    hit = np.zeros(len(w.start), bool)
                    for s in found["spans"]:
                        hit[s["first"] : s["first"] + s["words"]] = True
                    values[j] = _without(values[j], w, hit)
            columns = {n: batch.column(k) for k, n in enumerate(names)}
            columns[text] = pa.array([v if v is None else v.decode("utf-8", "replace") for v in values], pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _scan(broadcast, text: str, cut: bool):
    """Adds each row's digest columns; with ``cut`` also replaces the text by what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = broadcast.value
        for batch in batches:
            names = batch.schema.names
            col = batch.column(names.index(text))
            old = batch.column(names.index(HITS)).to_pylist() if HITS in names else None
            n_words = np.zeros(batch.num_rows, np.int64)
            n_hit = np.zeros(batch.num_rows, np.int64)
            items: list[set[str]] = [set() for _ in range(batch.num_rows)]
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for d, e, w in doc_words(col, ALNUM):
                n_words[d:e] = w.counts
                cover = np.zeros(len(w.start) + 1, np.int64)
                found = list(find_hits(w, block))
                docs = np.searchsorted(w.first, [f[0] for f in found], "right") - 1
                for (i, k, held), j in zip(found, docs, strict=True):
                    cover[i] += 1
                    cover[i + k] -= 1
                    items[d + j].update(held)
                    spans[d + j].append({"first": int(i - w.first[j]), "words": k})
                for j in range(d, e) if old else ():
                    for s in old[j]["spans"] if old[j] else ():
                        cover[w.first[j - d] + s["first"]] += 1
                        cover[w.first[j - d] + s["first"] + s["words"]] -= 1
                n_hit[d:e] = segment_sum((np.cumsum(cover)[:-1] > 0).astype(np.int64), w.first)
            for j in range(batch.num_rows) if old else ():
                if old[j]:
                    items[j].update(old[j]["items"])
                    spans[j].extend(old[j]["spans"])
            listed = [sorted(x) for x in items]
            columns = {n: batch.column(k) for k, n in enumerate(names)}
            if cut and n_hit.any():
                hit, values = n_hit.tolist(), col.cast(pa.binary()).to_pylist()
                columns[text] = pa.array([_cut(v, block).decode("utf-8", "replace") if x else v and v.decode("utf-8", "replace") if v is not None else None for x, v in zip(hit, values, strict=True)], pa.string())
            columns |= {
                HITS: pa.array([{"items": i, "spans": s} for i, s in zip(listed, spans, strict=True)], pa.struct([("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())])))])),
                "n_words": pa.array(n_words), "n_hit": pa.array(n_hit), "n_items": pa.array([len(x) for x in listed], pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed]),
                "contaminated": pa.array(n_hit > 0),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, max_windows: int = 1_000_000, action: str = "flag") -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated.

    ``action``: "flag" keeps texts; "cut" removes hit words and what stands between them
    from the text, again until no window is left; "drop" keeps only clean rows.
    """
    if action not in ("flag", "cut", "drop"):
        raise ValueError(f"no such action: {action}")
    spark = docs.sparkSession
    out = without(docs, *HIT_COLUMNS, HITS)
    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    hits = f"{HITS} struct<items: array<string>, spans: array<struct<first: bigint, words: bigint>>>"
    digest = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"

    def scanned(rows: DataFrame, shared, cut: bool = False) -> DataFrame:
        return rows.drop(*HIT_COLUMNS).mapInArrow(_scan(shared, text, cut), f"{base}, {hits}, {digest}")

    def all_but_last(rows: DataFrame):
        """Hits of all blocks but the last, written; the last block; whether there were several."""
        last, several = None, False
        for block in benchmark_blocks(((r[0], r[1]) for r in benchmark.select(item, item_text).toLocalIterator()), window, max_windows):
            if last is not None:
                rows, several = durable(scanned(rows, last)), True
                last.destroy()
            last = spark.sparkContext.broadcast(block)
        return rows, last if last is not None else spark.sparkContext.broadcast(Block({})), several

    rows, last, several = all_but_last(out)
    if action != "cut" or not several:
        found = scanned(rows, last, action == "cut").drop(HITS)
        return found.filter(~F.col("contaminated")) if action == "drop" else found
    found, first, done = durable(scanned(rows, last)), True, None
    while True:  # every round takes words from each text that is left
        last.destroy()
        clean = found.filter(F.col("n_hit") == 0)
        clean = clean.drop(HITS) if first else clean.select(*[f"`{c}`" for c in out.columns], "_first.*")
        done = clean if done is None else done.unionByName(clean)
        left = found.filter(F.col("n_hit") > 0)
        if left.isEmpty():
            return done
        if first:  # the digest is that of the whole text
            left = left.withColumn("_first", F.struct(*HIT_COLUMNS))
            base, first = base + f", _first {left.schema['_first'].dataType.simpleString()}", False
        cut = left.mapInArrow(_cut_spans(text), left.schema).drop(HITS, *HIT_COLUMNS)
        rows, last, _ = all_but_last(cut)
        found = durable(scanned(rows, last))


def kept_after_cut(found: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """Rows of a "cut" result under their own columns; n_chars is set anew where a text was cut.

    Documents that were hit and have no word left are dropped; all others stay.
    """
    out = found.filter(~F.col("contaminated") | F.regexp_like(F.col(text), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")))
    if "n_chars" in columns:
        kind = found.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("contaminated"), F.length(text).cast(kind)).otherwise(F.col("n_chars")))
    return out.select([F.col(f"`{c}`") for c in columns])
