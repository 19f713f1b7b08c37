"""Quality classifier: a sparse ensemble of rules over text statistics.

Small boosted trees are grown on labelled documents; every path from a root to a node
becomes a rule, a conjunction of threshold conditions on statistics. Logistic weights with
a lasso penalty keep a few rules, and those are compiled into Spark column expressions, so
scoring is one generated expression over the statistics of each document.

Statistics are counted over the whole text, vectorised in Arrow batches. The classifier is
fitted on at most about ``max_labels`` labelled rows of each class, chosen by a hash of the
id when there are more (a documented sample; statistics and scores cover every document).

Defined cases: null text is empty; labels that are null or belong to no document are left
out; repeated labels count each; without both classes every score is the share of the one
there is (0.5 without any labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import releasing
from .textbatch import IDENTITY, NOT_SPACE, column_bytes, doc_words, prefix_hash, segment_sum, span_hash

MAX_LABELS = 10_000
STATISTICS = (
    "log_words", "word_length", "long_words", "distinct_words", "top_word", "repeated_next", "capital_words", "upper", "digits", "non_ascii",
    "bangs", "bars", "symbols", "stops", "commas", "other_marks", "spaces", "line_words", "repeated_lines", "short_words", "ends_marked", "ends_symbol", "distinct_pairs",
)


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


_UPPER, _DIGIT, _MARKS = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), {"bangs": _class("!?"), "bars": _class("|<>[]{}\\/"), "symbols": _class("#$%&*@^~_=+"), "stops": _class("."), "commas": _class(",;:"), "other_marks": _class("'\"()-`")}
_ANY_SYMBOL = _MARKS["bangs"] | _MARKS["bars"] | _MARKS["symbols"]
_HIGH = np.arange(256) >= 0x80


def statistics(col: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text; 0 where a ratio has no base."""
    out = np.zeros((len(col), len(STATISTICS)))
    for d, e, w in doc_words(col, NOT_SPACE, IDENTITY):
        buf, offs, n = w.buf, w.offs, w.counts.astype(float)
        size = np.diff(offs).astype(float)
        per_byte = lambda table: segment_sum(table[buf].astype(np.int64), offs) / np.maximum(size, 1)  # noqa: E731, B023
        per_word = lambda flags: segment_sum(flags.astype(np.int64), w.first) / np.maximum(n, 1)  # noqa: E731, B023
        lens = w.end - w.start
        h, doc = w.hashes(), w.doc()
        top, distinct = _tops(h, doc, e - d)
        pairs = np.zeros(0, np.uint64)
        same_doc = doc[1:] == doc[:-1]
        if len(h) > 1:
            pairs = (h[:-1] * np.uint64(3) ^ h[1:])[same_doc]
        _, distinct_pairs = _tops(pairs, doc[1:][same_doc] if len(h) > 1 else doc[:0], e - d)
        next_same = np.zeros(len(h), bool)
        if len(h) > 1:
            next_same[1:] = (h[1:] == h[:-1]) & same_doc
        first_byte, last_byte = buf[w.start], buf[np.maximum(w.end - 1, 0)]
        rows = {
            "log_words": np.log1p(n), "word_length": segment_sum(lens, w.first) / np.maximum(n, 1), "long_words": per_word(lens > 14), "distinct_words": distinct / np.maximum(n, 1),
            "top_word": top / np.maximum(n, 1), "repeated_next": per_word(next_same), "capital_words": per_word(_UPPER[first_byte]), "upper": per_byte(_UPPER), "digits": per_byte(_DIGIT), "non_ascii": per_byte(_HIGH),
            **{k: per_byte(t) for k, t in _MARKS.items()}, "spaces": per_byte(~NOT_SPACE), "short_words": per_word(lens <= 2), "ends_marked": per_word(_MARKS["stops"][last_byte]), "ends_symbol": per_word(_ANY_SYMBOL[last_byte]),
            "distinct_pairs": distinct_pairs / np.maximum(n - 1, 1),
        }
        lines, repeated = _lines(buf, offs)
        rows |= {"line_words": n / np.maximum(lines, 1), "repeated_lines": repeated / np.maximum(lines, 1)}
        for k, name in enumerate(STATISTICS):
            out[d:e, k] = rows[name]
    return out


def _tops(h: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document the count of its most frequent hash and the number of distinct ones."""
    top, distinct = np.zeros(docs), np.zeros(docs)
    if len(h):
        order = np.lexsort((h, doc))
        hs, ds = h[order], doc[order]
        first = np.flatnonzero(np.concatenate(([True], (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1]))))
        sizes = np.diff(np.append(first, len(hs)))
        np.maximum.at(top, ds[first], sizes)
        distinct += np.bincount(ds[first], minlength=docs)
    return top, distinct


def _lines(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-empty lines of each document, and how many of them repeat an earlier one."""
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    line = buf != 0x0A
    begin = line & (np.concatenate(([True], ~line[:-1])) | edge[:-1]) if len(buf) else line
    start = np.flatnonzero(begin)
    finish = np.flatnonzero(line & (np.concatenate((~line[1:], [True])) | edge[1:])) + 1 if len(buf) else start
    sums, inv = prefix_hash(buf)
    h = span_hash(sums, inv, start, finish)
    doc = np.searchsorted(offs, start, "right") - 1
    total = np.bincount(doc, minlength=len(offs) - 1).astype(float)
    return total, total - _tops(h, doc, len(offs) - 1)[1]


def _measure(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            values = statistics(batch.column(names.index(text)))
            columns = {n: batch.column(k) for k, n in enumerate(names) if n != text}
            columns["stats"] = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), len(STATISTICS)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the text replaced by stats, an array in the order of STATISTICS."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text)
    return docs.mapInArrow(releasing(_measure(text)), f"{kept}, stats array<double>".lstrip(", "))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, threshold): value > threshold, or value <= threshold."""

    conditions: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, above, t in self.conditions:
            out &= (x[:, k] > t) == above
        return out

    def column(self, stats: Column) -> Column:
        out = None
        for k, above, t in self.conditions:
            one = stats[k] > t if above else stats[k] <= t
            out = one if out is None else out & one
        return out

    def __str__(self) -> str:
        return " and ".join(f"{STATISTICS[k]} {'>' if above else '<='} {t:.4g}" for k, above, t in self.conditions)


def grow_rules(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, shrink: float = 0.3, bins: int = 64, least: int = 20) -> list[Rule]:
    """Rules from boosted regression trees on the logistic gradient; splits at quantiles of each statistic."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], 1)
    margin, rules = np.full(len(y), np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        nodes = [(np.arange(len(y)), ())]
        for level in range(depth + 1):
            below = []
            for rows, path in nodes:
                split = _best_split(binned[rows], grad[rows], hess[rows], bins, least) if level < depth else None
                if split is None:
                    margin[rows] += shrink * grad[rows].sum() / (hess[rows].sum() + 1)
                    continue
                k, b = split
                right = binned[rows, k] > b
                for above, part in ((False, rows[~right]), (True, rows[right])):
                    new = _merge(path, (k, above, float(cuts[k][b])))
                    rules[Rule(new)] = None
                    below.append((part, new))
            nodes = below
    return list(rules)


def _merge(path: tuple, new: tuple[int, bool, float]) -> tuple:
    same = [c for c in path if c[:2] == new[:2]]
    keep = [c for c in path if c[:2] != new[:2]]
    values = [c[2] for c in same] + [new[2]]
    return tuple(sorted([*keep, (new[0], new[1], max(values) if new[1] else min(values))]))


def _best_split(binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, bins: int, least: int) -> tuple[int, int] | None:
    best, found = 1e-3, None
    g, h, n = grad.sum(), hess.sum(), len(grad)
    for k in range(binned.shape[1]):
        gl, hl = (np.cumsum(np.bincount(binned[:, k], v, bins))[:-1] for v in (grad, hess))
        nl = np.cumsum(np.bincount(binned[:, k], minlength=bins))[:-1]
        gain = np.where((nl >= least) & (n - nl >= least), gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1), -1)
        b = int(np.argmax(gain))
        if gain[b] > best:
            best, found = gain[b], (k, b)
    return found


def fit_lasso(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Weighted logistic regression with an L1 penalty by accelerated proximal gradient; the bias is free."""
    w, bias = np.zeros(z.shape[1]), 0.0
    total = weight.sum()
    step = 4 * total / (np.linalg.norm(z * np.sqrt(weight)[:, None], 2) ** 2 + total)
    v, b, t = w.copy(), bias, 1.0
    for _ in range(steps):
        r = weight * (y - 1 / (1 + np.exp(-(z @ v + b)))) / total
        new = v + step * (z.T @ r)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_bias = b + step * r.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, b = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    return bias, w


@dataclass
class RuleModel:
    bias: float
    rules: list[tuple[Rule, float]]

    def score(self, stats: Column) -> Column:
        """The model as one column expression over the statistics."""
        margin = F.lit(float(self.bias))
        for rule, w in self.rules:
            margin = margin + F.when(rule.column(stats), F.lit(float(w))).otherwise(0.0)
        return 1 / (1 + F.exp(-margin))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + sum((w * r.holds(x) for r, w in self.rules), np.zeros(len(x))))))


def fit_rules(x: np.ndarray, y: np.ndarray, *, penalty: float = 5e-4, seed: int = 7) -> RuleModel:
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        return RuleModel(float(np.log(share / (1 - share))), [])
    rules = grow_rules(x, y)
    z = np.stack([r.holds(x) for r in rules], 1).astype(float) if rules else np.zeros((len(y), 0))
    bias, w = fit_lasso(z, y, np.ones(len(y)), penalty)
    keep = np.flatnonzero(np.abs(w) > 1e-4)
    return RuleModel(float(bias), [(rules[k], float(w[k])) for k in keep])


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_labels: int = MAX_LABELS) -> DataFrame:
    """Rows of ``docs`` with their label; about ``max_labels`` of each class at most.

    The chosen labels have a proven bound and are broadcast, so texts are not shuffled.
    """
    wanted = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in wanted.groupBy("label").count().collect()}
    chance = F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(1 << 30)) / float(1 << 30)
    chosen = wanted.filter(F.when(F.col("label") == 1, chance < min(1.0, max_labels / max(1, counts.get(1, 0)))).otherwise(chance < min(1.0, max_labels / max(1, counts.get(0, 0)))))
    return docs.join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", text: str = "text", max_labels: int = MAX_LABELS) -> RuleModel:
    """Fit on the labelled rows given; hold out rows by filtering ``labels`` before."""
    sample = with_statistics(labelled(docs.select("doc_id", F.col(text).alias("text")), labels, label, max_labels)).select("doc_id", "label", "stats")
    rows = sorted(sample.collect(), key=lambda r: (r["doc_id"], r["label"], r["stats"]))  # at most 2 * max_labels rows
    x = np.array([r["stats"] for r in rows]).reshape(len(rows), len(STATISTICS))
    return fit_rules(x, np.array([r["label"] for r in rows], float))


def score(docs: DataFrame, model: RuleModel, *, text: str = "text") -> DataFrame:
    """``docs`` without the text, with score; scores come from the text alone. A column score is replaced, all others stay."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text and c.lower() != "score"]
    packed = docs.select((F.struct(*kept) if kept else F.lit(None).cast("boolean")).alias("_row"), F.col(f"`{text}`").alias("_text"))
    scored = with_statistics(packed, "_text").withColumn("score", model.score(F.col("stats")))
    return scored.select("_row.*", "score") if kept else scored.select("score")
