"""Mixing sources to target weights with fixed-length blocks.

1. Each source's documents, in a fixed order, form one stream of words that is cut into
   blocks of ``block_words`` (the last one may be short).
2. Sources weigh 5, 2, 1, repeating (code point order, null last) and share the total size;
   a target stops at ``max_repeats`` times its source's size, the excess goes to the others.
3. The blocks to take make slots 0, 1, 2, ... of each source. Each output shard draws its
   source counts from a multinomial over what the sources have left, so shards mix in
   the target ratio and totals meet the targets exactly.
4. Slot i of a source maps through a pseudorandom permutation of its block indices, a new one
   for each pass over the source; the last slot takes only the words that are still missing.
5. Slots and blocks are joined by (source, block index).

Stream offsets are two-level prefix sums over about sqrt(rows) hash buckets, so no task
holds a whole source. The driver handles one row for each source only: the counts of the at most
``MAX_SHARDS`` shards are drawn by one task that streams them, a shard at a time. The result is a
function of the rows and ``seed``.

Defined cases: null and empty texts have size 0 and take 0; null is a source of its own;
repeated rows each have a place of their own in the stream; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, partitions, releasing
from .textbatch import IDENTITY, NOT_SPACE, doc_words, mix

BLOCK_WORDS = 64
SHARD_SLOTS = 1024
MAX_SHARDS = 4096
RUN_SLOTS = 1 << 14
TASK_SLOTS = 1 << 16
WEIGHTS = (5, 2, 1)
_U = np.uint64


@dataclass
class Source:
    """What the driver knows of one source."""

    name: str | None
    weight: float
    size: int
    target: float = 0.0
    slots: int = 0
    last_words: int = 0  #: words that the last slot takes; 0: all of its block


def share_out(sources: list[Source], max_repeats: float = 3.0) -> None:
    """Set targets: by weight, at most ``max_repeats`` sizes each, the excess reshared by weight."""
    total = float(sum(s.size for s in sources))
    open_ = [s for s in sources if s.size]
    while open_:
        weights = sum(s.weight for s in open_)
        full = [s for s in open_ if total * s.weight / weights > max_repeats * s.size]
        if not full:
            for s in open_:
                s.target = total * s.weight / weights
            return
        for s in full:
            s.target = max_repeats * s.size
            total -= s.target
            open_.remove(s)


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed bijection of 0..n-1: a four-round Feistel network, walked until the value is below n."""
    half = np.ceil(np.log2(np.maximum(n, 2).astype(np.float64)) / 2).astype(np.uint64)
    mask = (_U(1) << half) - _U(1)
    out = index.astype(np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for r in range(4):
            left, right = right, left ^ (mix(right + k + _U(r * 0x9E3779B97F4A7C15 % 2**64)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def place_of(value: int, n: int, key: int) -> int:
    """The index that ``permute`` maps to ``value``."""
    half = int(np.ceil(np.log2(max(n, 2)) / 2))
    mask = (1 << half) - 1
    x = value
    while True:
        left, right = x >> half, x & mask
        for r in reversed(range(4)):
            f = int(mix(np.array([(left + key + r * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0]) & mask
            left, right = right ^ f, left
        x = (left << half) | right
        if x < n:
            return x


def _keys(source: np.ndarray, epoch: np.ndarray, seed: int) -> np.ndarray:
    return mix(mix(source.astype(np.uint64) + _U(seed)) + epoch.astype(np.uint64))


def plan_slots(s: Source, k: int, block: int, seed: int) -> None:
    """How many slots source number ``k`` fills, and how many words the last one takes."""
    want = int(s.target)
    if not want:
        return
    blocks = -(-s.size // block)
    epochs, rest = divmod(want, s.size)
    s.slots, s.last_words = epochs * blocks, 0
    if not rest:
        return
    short = blocks * block - s.size
    at = place_of(blocks - 1, blocks, int(_keys(np.array([k]), np.array([epochs]), seed)[0]))
    full = lambda m: m * block - (short if at < m else 0)
    n = -(-rest // block)  # slots, if the short block isn't among them
    while full(n) < rest:
        n += 1
    s.slots += n
    s.last_words = rest - full(n - 1)


def draw_shards(slots: list[int], seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, first slots, slots) with a value a source: multinomial counts over what each source has left."""
    left = np.array(slots, np.int64)
    total = int(left.sum())
    shards = min(max(1, -(-total // SHARD_SLOTS)), MAX_SHARDS)
    rng, taken = np.random.default_rng(seed), np.zeros(len(left), np.int64)
    for shard in range(shards):
        size = total * (shard + 1) // shards - total * shard // shards
        counts = np.zeros(len(left), np.int64)
        while need := size - int(counts.sum()):
            rest = left - counts
            counts += np.minimum(rng.multinomial(need, rest / rest.sum()), rest)
        yield shard, taken, counts
        taken, left = taken + counts, left - counts


def _draw(slots: list[int], seed: int):
    """Rows (shard, sid, first, n) of the sources that each shard takes from, a batch a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, n in draw_shards(slots, seed) if batch.num_rows else ():
                sid = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sid), shard), pa.int32()), pa.array(sid, pa.int32()), pa.array(first[sid]), pa.array(n[sid])], ["shard", "sid", "first", "n"])

    return run


def _sizes(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            size = np.zeros(batch.num_rows, np.int64)
            for d, e, w in doc_words(batch.column(names.index(text)), NOT_SPACE, IDENTITY):
                size[d:e] = w.counts
            columns = {n: batch.column(k) for k, n in enumerate(names) if n != text} | {"size": pa.array(size)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _map_slots(blocks: list[int], sizes: list[int], last: list[tuple[int, int]], block: int, seed: int):
    """Each slot's block index and how many of its words it takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_of, size_of = np.array(blocks, np.int64), np.array(sizes, np.int64)
        final, words = np.array([x for x, _ in last], np.int64), np.array([x for _, x in last], np.int64)
        for batch in batches:
            source, slot = (batch.column(batch.schema.names.index(c)).to_numpy() for c in ("sid", "slot"))
            n = n_of[source]
            epoch, i = np.divmod(slot, n)
            index = permute(i, n, _keys(source, epoch, seed))
            take = np.minimum(block, size_of[source] - index * block)
            take = np.where((slot == final[source]) & (words[source] > 0), words[source], take)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index("shard")), pa.array(slot), pa.array(source, pa.int32()), pa.array(index), pa.array(take)], ["shard", "slot", "sid", "block", "take"])

    return run


def _row_key(source: str, text: str) -> list:
    """Two never-null hashes that tell rows apart: of id and source, and of the text."""
    return [F.xxhash64("doc_id", F.col(source).cast("string")).alias("key"), F.xxhash64(F.col(text)).alias("tie")]


@dataclass
class Mix:
    """``sizes``: a row for each document with its place in its source's stream (sid, start);
    ``slots``: (shard, slot, sid, block, take), the mix itself; ``sources``: the driver's table."""

    sizes: DataFrame
    slots: DataFrame
    sources: list[Source]
    block: int

    def pieces(self) -> DataFrame:
        """(key, tie, sid, start, size, at, words, times): a document's words ``at``.. taken ``times``."""
        b = self.block
        cut = self.sizes.filter("size > 0").select("key", "tie", "sid", "start", "size", F.explode(F.sequence(F.expr(f"start div {b}"), F.expr(f"(start + size - 1) div {b}"))).alias("block"))
        taken = self.slots.groupBy("sid", "block", "take").agg(F.count("*").alias("times"))
        lo, hi = F.greatest("start", F.col("block") * b), F.least(F.col("start") + F.col("size"), F.col("block") * b + F.col("take"))
        # Spark takes what explode makes for as small as its input; without the hint it broadcasts all slots
        return cut.join(taken.hint("merge"), ["sid", "block"]).select("key", "tie", "sid", "start", "size", (lo - F.col("start")).alias("at"), (hi - lo).alias("words"), "times").filter("words > 0")


def mix_sources(docs: DataFrame, *, text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, max_repeats: float = 3.0, seed: int = 20_240_501) -> Mix:
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col(source).cast("string").alias("source"), *_row_key(source, text), F.col(text).alias("text"))
    rows = durable(rows.mapInArrow(releasing(_sizes("text")), f"doc_id {kind}, source string, key bigint, tie bigint, size bigint"))
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # one row a source
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sources = [Source(r["source"], weights[k % len(weights)], r["size"]) for k, r in enumerate(found)]
    share_out(sources, max_repeats)
    for k, s in enumerate(sources):
        plan_slots(s, k, block_words, seed)
    names = spark.createDataFrame([(k, s.name, s.size, s.target) for k, s in enumerate(sources)], "sid int, source_name string, source_size bigint, target double")
    buckets = max(1, int(sum(r["n"] for r in found) ** 0.5))
    placed = rows.join(F.broadcast(names), rows["source"].eqNullSafe(names["source_name"])).drop("source_name").withColumn("bucket", F.pmod(F.col("key"), F.lit(buckets)))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("in_bucket")).withColumn("offset", F.coalesce(F.sum("in_bucket").over(before), F.lit(0))).drop("in_bucket")
    inner = Window.partitionBy("sid", "bucket").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(offsets, ["sid", "bucket"]).withColumn("start", F.col("offset") + F.col("inner")).drop("bucket", "offset", "inner")
    counts = [s.slots for s in sources]
    shards = spark.range(1, numPartitions=1).mapInArrow(_draw(counts, seed), "shard int, sid int, first bigint, n bigint")
    tasks = max(1, min(-(-sum(counts) // TASK_SLOTS), partitions(spark)))
    end = F.col("first") + F.col("n") - 1
    runs = shards.select("shard", "sid", end.alias("end"), F.explode(F.sequence(F.col("first"), end, F.lit(RUN_SLOTS))).alias("from")).repartition(tasks, F.col("shard"), F.col("sid"), F.col("from"))  # no array of a shard's slots; a number, else Spark merges these few rows into one task
    slots = runs.select("shard", "sid", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + RUN_SLOTS - 1, F.col("end")))).alias("slot"))
    blocks, size_of = [max(1, -(-s.size // block_words)) for s in sources], [s.size for s in sources]
    slots = slots.mapInArrow(_map_slots(blocks, size_of, [(s.slots - 1, s.last_words) for s in sources], block_words, seed), "shard int, slot bigint, sid int, block bigint, take bigint")
    return Mix(sizes, slots, sources, block_words)


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken for each document."""
    m = mix_sources(docs, **options)
    taken = m.pieces().groupBy("sid", "start", "size").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    facts = m.sizes
    some = facts.filter("size > 0").alias("f").join(taken.hint("merge").alias("t"), [F.col("f.sid") == F.col("t.sid"), F.col("f.start") == F.col("t.start"), F.col("f.size") == F.col("t.size")], "left")
    some = some.select("f.doc_id", "f.size", "f.source_size", "f.target", F.coalesce("t.taken", F.lit(0)).alias("taken"))
    return some.unionByName(facts.filter("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("bigint").alias("taken")))


def _rebuild(text: str):
    """Whole copies of a document for every full pass, then a row with the words taken once more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            spans = batch.column(names.index("spans")).to_pylist()
            origin, texts = [], []
            for d, e, w in doc_words(batch.column(names.index(text)), NOT_SPACE, IDENTITY):
                for j in range(d, e):
                    a, n = int(w.first[j - d]), int(w.first[j - d + 1] - w.first[j - d])
                    times = np.zeros(n + 1, np.int64)
                    for s in spans[j] or ():
                        times[s["at"]] += s["times"]
                        times[s["at"] + s["words"]] -= s["times"]
                    times = np.cumsum(times)[:-1]
                    whole = w.buf[w.offs[j - d] : w.offs[j - d + 1]].tobytes()
                    low = int(times.min()) if n else 0
                    origin += [j] * low
                    texts += [whole] * low
                    for more in range(low, int(times.max()) if n else 0):
                        edges = np.flatnonzero(np.diff(np.concatenate(([False], times > more, [False]))))
                        parts = [w.buf[w.start[a + x] : w.end[a + y - 1]].tobytes() for x, y in zip(edges[::2], edges[1::2], strict=True)]
                        origin.append(j)
                        texts.append(b"\n".join(parts))
            index = pa.array(origin, pa.int64())
            out = {n: batch.column(k).take(index) for k, n in enumerate(names) if n != "spans"}
            out[text] = pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def mixed_documents(docs: DataFrame, *, text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix as documents: the columns of ``docs``, a row for each copy or partial copy taken.

    n_chars, where there is such a column, is set anew.
    """
    m = mix_sources(docs, text=text, source=source, **options)
    spans = m.pieces().groupBy("key", "tie", "start").agg(F.collect_list(F.struct("at", "words", "times")).alias("spans"))
    same = Window.partitionBy("key", "tie")
    spans = spans.withColumn("nth", F.row_number().over(same.orderBy("start"))).drop("start")
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *_row_key(source, text))
    keyed = keyed.withColumn("nth", F.row_number().over(same.orderBy(F.lit(0))))
    both = keyed.join(spans.hint("merge"), ["key", "tie", "nth"]).select("row.*", "spans")
    out = both.mapInArrow(releasing(_rebuild(text)), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
