"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

A suffix matters only through its first ``length`` bytes (its *window*). Windows are refined
by most-significant-digit passes; a group whose windows all start in one document is
finished, and the groups left after the last pass are exactly the repeated windows.

Pass 1, digit: the window's minimizer, the ``GRAM``-byte string of least hash in it (the
    leftmost if it repeats). It is a function of the window's content, so equal windows share
    it, and neighbouring windows share one occurrence: a *run* of up to ``length - GRAM + 1``
    windows travels as one record, not as many.
Pass 2, digit: the run's whole content. Runs equal to one of a smaller document are removed
    at once, so copies and shared passages end here, however many they are.
    A window that two other runs share reaches ``(length - gram) / 2`` bytes or more beyond the minimizer on one side, so
    only runs whose left or right sides of that length agree (by 16-bit hashes), in different documents, go on.
Pass 3: what is left are runs that share a minimizer and a side but differ (edges of edits, chance).
    One run of each content is sent with its bytes, and its windows are radix sorted by
    eight bytes at a time, to ``length`` bytes and no further.

Results of passes 1 to 3 are written before the next, so that only one pass's shuffle is on disk.

Documents are dealt in chunks by a hash of their id and the chunk number grows with the
data, so a task holds a few MB of text. Records are combined within a chunk before they
are shuffled: a passage that a third of all documents share costs one record a chunk.
Passes 1 and 2 compare 48-bit hashes of both digits together; pass 3 compares bytes.

Defined cases: null text is empty; texts shorter than ``length`` lose nothing; rows with the
same doc_id don't count against each other; a null doc_id counts as larger than any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, release, text_bytes
from .textbatch import column_bytes, prefix_hash, slices, span_hash

LENGTH = 50
GRAM = 16
CHUNK_BYTES = 1 << 20, 16 << 20  # least and most text in a chunk
SLICE = 1 << 18
BUCKET_RECORDS = 1 << 17, 1 << 20  # least and most runs in a bucket
_U = np.uint64
_LAST = np.iinfo(np.int64).max
_POS = _U(28)  # bits of a position within a piece
_PIECE = 1 << 27


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


class Runs:
    """Runs of windows of some documents: windows [start, stop) of ``buf`` share a minimizer."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, length: int, gram: int) -> None:
        self.buf, self.offs, self.length = buf, offs - offs[0], length
        sums, inv = prefix_hash(buf)
        parts = [self._piece(sums, inv, a, min(a + _PIECE, len(buf) - length + 1), gram) for a in range(0, max(0, len(buf) - length + 1), _PIECE)]
        start, stop, where = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3))
        self.start, self.stop = start, stop
        self.digit = span_hash(sums, inv, where, where + gram) >> _U(16)
        self.content = span_hash(sums, inv, start, stop + length - 1) >> _U(16)
        self.doc = np.searchsorted(self.offs, start, "right") - 1
        self._sides = lambda: self._side_hashes(sums, inv, where, gram)

    @property
    def sides(self) -> np.ndarray:
        """Hashes of the bytes left and right of the minimizer, 16 bits each; 0 where the run has too few."""
        return self._sides()

    def _side_hashes(self, sums: np.ndarray, inv: np.ndarray, where: np.ndarray, gram: int) -> np.ndarray:
        half = -(-(self.length - gram) // 2)
        side = lambda a, known: np.where(known, np.maximum(span_hash(sums, inv, np.where(known, a, 0), np.where(known, a + half, 0)) >> _U(48), _U(1)), _U(0))
        return side(where - half, where - self.start >= half) << _U(16) | side(where + gram, self.stop + self.length - 1 - where - gram >= half)

    def _piece(self, sums: np.ndarray, inv: np.ndarray, a: int, b: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        grams = np.arange(a, b + self.length - gram)
        h = span_hash(sums, inv, grams, grams + gram)
        packed = (h >> _POS << _POS) | (grams - a).astype(np.uint64)
        where = (sliding_min(packed, self.length - gram + 1) & _U((1 << 28) - 1)).astype(np.int64) + a
        valid = np.ones(b - a, bool)  # windows that end within their document
        for d in range(self.length - 1):
            ends = self.offs[1:] - 1 - d
            valid[ends[(ends >= a) & (ends < b)] - a] = False
        at = np.flatnonzero(valid)
        new = np.ones(len(at), bool)
        new[1:] = (where[at[1:]] != where[at[:-1]]) | (np.diff(at) != 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1 if len(at) else first
        return at[first] + a, at[last] + a + 1, where[at[first]]


def runs_of(table: pa.Table, length: int, gram: int) -> Iterator[tuple[int, int, Runs]]:
    buf, offs = column_bytes(table.column("text"))
    for d, e in slices(offs, SLICE):
        yield d, e, Runs(buf[offs[d] : offs[e]], offs[d : e + 1], length, gram)


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("id").to_numpy().astype(np.int64)


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value, byte by byte: planes that hardly vary compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(raw: bytes, n: int, width: int, at: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
    return out.reshape(-1).view(np.uint64)


def _pack(*columns: tuple[np.ndarray, int]) -> bytes:
    return b"".join(_planes(np.ascontiguousarray(c).astype(np.uint64, copy=False) if c.dtype != np.int64 else np.ascontiguousarray(c), w) for c, w in columns)


def _unpack(raw: bytes, *widths: int) -> list[np.ndarray]:
    n = len(raw) // sum(widths)
    out, at = [], 0
    for w in widths:
        out.append(_unplanes(raw, n, w, at))
        at += n * w
    return out


def _bucket(digit: np.ndarray, buckets: int) -> np.ndarray:
    return ((digit >> _U(16)) * _U(buckets) >> _U(32)).astype(np.int64)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, flags of each group's first row in that order) of rows sorted by keys, the first most significant."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    return order, new


def _dealt(to: np.ndarray, columns: list[tuple[np.ndarray, int]]) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield int(to[part[0]]), _pack(*((c[part], w) for c, w in columns))


def _least(table: pa.Table, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (digit, content) of a chunk, in order, with the least id that holds each and its sides."""
    ids = _ids(table)
    found = [(r.digit, r.content, ids[d:e][r.doc], r.sides) for d, e, r in runs_of(table, length, gram)]
    digit, content, doc, sides = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.uint64) for k in range(4))
    order, new = _groups(digit, content, doc.astype(np.int64))
    keep = order[_groups_first(digit[order], content[order])]
    return digit[keep], content[keep], doc[keep].astype(np.int64), sides[keep]


def _groups_first(*sorted_keys: np.ndarray) -> np.ndarray:
    n = len(sorted_keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.any([k[1:] != k[:-1] for k in sorted_keys], axis=0)
    return np.flatnonzero(new)


def _emit_runs(length: int, gram: int, buckets: int):
    """Passes 1 and 2, a chunk's part: its distinct runs, dealt by minimizer."""

    def run(table: pa.Table) -> pa.Table:
        digit, content, doc, sides = _least(table, length, gram)
        to = _bucket(digit, buckets)  # grows with the digit
        step = np.where(np.diff(to, prepend=-1) != 0, digit, np.diff(digit, prepend=_U(0)))  # small, but for a payload's first
        rows = list(_dealt(to, [(step, 6), (content, 6), (doc, 8), (sides, 4)]))
        chunk = table.column("chunk")[0].as_py()
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "chunk": pa.array([chunk] * len(rows), pa.int64()), "payload": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _compare_runs(table: pa.Table) -> pa.Table:
    """Kind 1: runs that a smaller document holds. Kind 2: firsts of their content that may share a window with another content."""
    parts = [(c, _unpack(p, 6, 6, 8, 4)) for c, p in zip(table.column("chunk").to_pylist(), table.column("payload").to_pylist(), strict=True)]
    digit = np.concatenate([np.cumsum(p[0]) for _, p in parts])
    content, doc, sides = (np.concatenate([p[k] for _, p in parts]) for k in range(1, 4))
    chunk = np.repeat(np.array([c for c, _ in parts], np.int64), [len(p[0]) for _, p in parts])
    doc = doc.view(np.int64)
    order = np.lexsort((doc, content, digit))
    digit, content, doc, chunk, sides = digit[order], content[order], doc[order], chunk[order], sides[order]
    first = _groups_first(digit, content)
    least = np.repeat(doc[first], np.diff(np.append(first, len(doc))))
    repeated = doc > least
    asked = np.zeros(len(first), bool)  # among the distinct contents
    for side in (sides[first] >> _U(16), sides[first] & _U(0xFFFF)):
        at = np.flatnonzero(side)
        at = at[np.lexsort((side[at], digit[first[at]]))]
        if len(at):
            group = _groups_first(digit[first[at]], side[at])
            some = np.minimum.reduceat(doc[first[at]], group) < np.maximum.reduceat(doc[first[at]], group)
            asked[at] |= np.repeat(some, np.diff(np.append(group, len(at))))
    several = first[asked]
    rows = [(1, *r) for r in _dealt(chunk[repeated], [(digit[repeated], 6), (content[repeated], 6)])]
    rows += [(2, *r) for r in _dealt(chunk[several], [(digit[several], 6), (content[several], 6)])]
    return pa.table({"chunk": pa.array([r[1] for r in rows], pa.int64()), "kind": pa.array([r[0] for r in rows], pa.int32()), "payload": pa.array([r[2] for r in rows], pa.binary())})


def _listed(messages: pa.Table, kind: int, *widths: int) -> list[np.ndarray]:
    found = [_unpack(p, *widths) for k, p in zip(messages.column("kind").to_pylist(), messages.column("payload").to_pylist(), strict=True) if k == kind]
    return [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.uint64) for k in range(len(widths))]


def _pair_index(digit: np.ndarray, content: np.ndarray, in_digit: np.ndarray, in_content: np.ndarray) -> np.ndarray:
    """For each pair its index among the listed distinct pairs, or -1."""
    if not len(in_digit) or not len(digit):
        return np.full(len(digit), -1)
    fold = lambda a, b: a * _U(0x9E3779B97F4A7C15) ^ b * _U(0xC2B2AE3D27D4EB4F)
    key = fold(in_digit, in_content)
    order = np.argsort(key)
    at = np.minimum(np.searchsorted(key[order], fold(digit, content)), len(order) - 1)
    hit = order[at]
    return np.where((in_digit[hit] == digit) & (in_content[hit] == content), hit, -1)


def _emit_bytes(length: int, gram: int, buckets: int):
    """Pass 3, a chunk's part: the bytes of each run that was asked for, once, from its least document."""

    def run(table: pa.Table, messages: pa.Table) -> pa.Table:
        none = pa.table({"bucket": pa.array([], pa.int64()), "chunk": pa.array([], pa.int64()), "payload": pa.array([], pa.binary()), "bytes": pa.array([], pa.binary())})
        if not table.num_rows:
            return none
        digit, content = _listed(messages, 2, 6, 6)
        if not len(digit):
            return none
        least = np.full(len(digit), _LAST)
        ids, found = _ids(table), {}
        for d, e, r in runs_of(table, length, gram):
            at = _pair_index(r.digit, r.content, digit, content)
            for k in np.flatnonzero(at >= 0):
                j, doc = int(at[k]), int(ids[d + r.doc[k]])
                if j not in found or doc < least[j]:
                    least[j] = doc
                    found[j] = r.buf[r.start[k] : r.stop[k] + length - 1].tobytes()
        have = np.array(sorted(found), np.int64)
        rows = []
        for bucket, part in _parts(_bucket(digit[have], buckets)):
            j = have[part]
            sizes = np.array([len(found[int(x)]) for x in j], np.uint64)
            rows.append((bucket, _pack((digit[j], 6), (content[j], 6), (least[j], 8), (sizes, 2)), b"".join(found[int(x)] for x in j)))
        chunk = table.column("chunk")[0].as_py()
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "chunk": pa.array([chunk] * len(rows), pa.int64()), "payload": pa.array([r[1] for r in rows], pa.binary()), "bytes": pa.array([r[2] for r in rows], pa.binary())})

    return run


def _parts(to: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(to, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(order) else ():
        yield int(to[part[0]]), part


def radix_groups(windows: np.ndarray, group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Flags of windows (rows of bytes) that some smaller ``doc`` of the same ``group`` holds too.

    Most significant eight bytes first; after each pass, groups of one document are finished.
    """
    n, length = windows.shape
    flags = np.zeros(n, bool)
    padded = np.zeros((n, -(-length // 8) * 8), np.uint8)
    padded[:, :length] = windows
    digits = padded.view(">u8").astype(np.uint64)
    live = np.arange(n)
    for p in range(digits.shape[1]):
        order = np.lexsort((digits[live, p], group[live]))
        live = live[order]
        first = _groups_first(group[live], digits[live, p])
        sizes = np.diff(np.append(first, len(live)))
        group = group.copy()
        group[live] = np.repeat(np.arange(len(first)), sizes)
        if not len(first):
            return flags
        lo, hi = np.minimum.reduceat(doc[live], first), np.maximum.reduceat(doc[live], first)
        live = live[np.repeat(lo < hi, sizes)]
    if len(live):
        first = _groups_first(group[live])
        sizes = np.diff(np.append(first, len(live)))
        flags[live] = doc[live] > np.repeat(np.minimum.reduceat(doc[live], first), sizes)
    return flags


def _sort_windows(length: int, most: int = 1 << 16):
    """Pass 3, a bucket's part: radix sort of windows, minimizer by minimizer; a mask of flagged windows for each run."""

    def run(table: pa.Table) -> pa.Table:
        chunks, payloads, blobs = (table.column(c).to_pylist() for c in ("chunk", "payload", "bytes"))
        parts = [_unpack(p, 6, 6, 8, 2) for p in payloads]
        digit, content, doc, sizes = (np.concatenate([p[k] for p in parts]) for k in range(4))
        chunk = np.repeat(np.array(chunks, np.int64), [len(p[0]) for p in parts])
        doc, sizes = doc.view(np.int64), sizes.astype(np.int64)
        raw = np.frombuffer(b"".join(blobs), np.uint8)
        begin = np.cumsum(sizes) - sizes
        order = np.argsort(digit, kind="stable")
        n_win = sizes - length + 1
        starts = _groups_first(digit[order])
        done, mask = 0, np.zeros(len(digit), np.uint64)
        total = np.concatenate(([0], np.cumsum(n_win[order])))
        bounds = np.append(starts, len(order))
        while done < len(starts):  # some whole minimizers at a time
            stop = max(done + 1, int(np.searchsorted(total[bounds], total[bounds[done]] + most, "right")) - 1)
            rows = order[bounds[done] : bounds[stop]]
            inner = np.arange(int(n_win[rows].sum())) - np.repeat(np.cumsum(n_win[rows]) - n_win[rows], n_win[rows])
            at = np.repeat(begin[rows], n_win[rows]) + inner
            _, group = np.unique(digit[rows], return_inverse=True)
            flags = radix_groups(np.lib.stride_tricks.sliding_window_view(raw, length)[at], np.repeat(group, n_win[rows]), np.repeat(doc[rows], n_win[rows]))
            np.bitwise_or.at(mask, np.repeat(rows, n_win[rows])[flags], _U(1) << inner[flags].astype(np.uint64))
            done = stop
        hit = mask > 0
        out = list(_dealt(chunk[hit], [(digit[hit], 6), (content[hit], 6), (mask[hit], 8)]))
        return pa.table({"chunk": pa.array([r[0] for r in out], pa.int64()), "kind": pa.array([3] * len(out), pa.int32()), "payload": pa.array([r[1] for r in out], pa.binary())})

    return run


def _remove(length: int, gram: int, keep_text: bool):
    def run(table: pa.Table, messages: pa.Table) -> pa.Table:
        n = table.num_rows
        ids = _ids(table) if n else np.zeros(0, np.int64)
        out_n, out_removed, out_spans, out_sha, out_text = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [], []
        if n:
            digit, content, doc, _ = _least(table, length, gram)
            full = _listed(messages, 1, 6, 6)
            some = _listed(messages, 3, 6, 6, 8)
            gone = _pair_index(digit, content, *full) >= 0
            at = _pair_index(digit, content, some[0], some[1])
            mask = np.where(at >= 0, some[2][at], _U(0)) if len(some[0]) else np.zeros(len(digit), np.uint64)
        for d, e, r in runs_of(table, length, gram) if n else ():
            at = _pair_index(r.digit, r.content, digit, content)
            whole = gone[at] | (ids[d:e][r.doc] > doc[at])
            delta = np.zeros(len(r.buf) + 1, np.int64)
            np.add.at(delta, r.start[whole], 1)
            np.add.at(delta, r.stop[whole] + length - 1, -1)
            for k in np.flatnonzero(~whole & (mask[at] > 0)):
                bits = int(mask[at[k]])
                for i in range(int(r.stop[k] - r.start[k])):
                    if bits >> i & 1:
                        delta[r.start[k] + i] += 1
                        delta[r.start[k] + i + length] -= 1
            removed = np.cumsum(delta)[:-1] > 0
            begins = removed.copy()
            begins[1:] &= ~removed[:-1]
            inside = r.offs[:-1][r.offs[:-1] < len(removed)]
            begins[inside] = removed[inside]
            total, spans = np.concatenate(([0], np.cumsum(removed))), np.concatenate(([0], np.cumsum(begins)))
            out_n[d:e], out_removed[d:e], out_spans[d:e] = np.diff(r.offs), np.diff(total[r.offs]), np.diff(spans[r.offs])
            for a, b in zip(r.offs[:-1].tolist(), r.offs[1:].tolist(), strict=True):
                kept = r.buf[a:b][~removed[a:b]].tobytes()
                out_sha.append(hashlib.sha256(kept).hexdigest())
                out_text.append(kept.decode("utf-8", "ignore") if keep_text else None)
        columns = {"doc_id": table.column("doc_id"), "n_bytes": pa.array(out_n), "n_removed": pa.array(out_removed), "n_spans": pa.array(out_spans), "kept_sha256": pa.array(out_sha, pa.string())}
        return pa.table(columns | ({"kept_text": pa.array(out_text, pa.string())} if keep_text else {}))

    return run


def _released(function):
    """``function`` of one or two tables, after which freed memory goes back to the system."""

    def one(table: pa.Table) -> pa.Table:
        out = function(table)
        release()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = function(left, right)
        release()
        return out

    return two if function.__code__.co_argcount == 2 else one


def _count_of(total: int, bounds: tuple[int, int]) -> int:
    """Parts of bounded size: about a thousand of them, more where they would be too large.

    Every chunk sends a message to nearly every bucket, so both counts follow the data, not the cluster.
    """
    return max(16, -(-total // min(bounds[1], max(bounds[0], total // 1024))))


def remove_repeats(docs: DataFrame, *, text: str = "text", length: int = LENGTH, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text) for each document.

    A byte goes if a ``length``-byte string over it also starts in a document of a smaller
    doc_id. ``kept_text`` drops bytes that are no longer whole characters. ``length`` may be
    gram + 1 to gram + 63.
    """
    if not gram < length <= gram + 63:
        raise ValueError("length must be gram + 1 to gram + 63")
    total = text_bytes(docs, text)
    chunks = _count_of(total, CHUNK_BYTES)
    buckets = _count_of(2 * total // (length - gram + 2), BUCKET_RECORDS)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    dealt = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("id"), F.col(text).cast("binary").alias("text"), F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).alias("chunk"))
    by_chunk = dealt.groupBy("chunk")
    message = "chunk bigint, kind int, payload binary"
    runs = by_chunk.applyInArrow(_released(_emit_runs(length, gram, buckets)), "bucket bigint, chunk bigint, payload binary")
    compared = durable(runs.groupBy("bucket").applyInArrow(_released(_compare_runs), message))
    asked = compared.filter("kind = 2")
    sent = by_chunk.cogroup(asked.groupBy("chunk")).applyInArrow(_released(_emit_bytes(length, gram, buckets)), "bucket bigint, chunk bigint, payload binary, bytes binary")
    masks = durable(sent.groupBy("bucket").applyInArrow(_released(_sort_windows(length)), message))
    told = compared.filter("kind = 1").unionByName(masks)
    result = f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept_text string" * keep_text
    return by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(_released(_remove(length, gram, keep_text)), result)
