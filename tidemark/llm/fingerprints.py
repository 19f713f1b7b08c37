"""Document fingerprints by consistent weighted sampling.

Terms are distinct runs of ``shingle`` words (the whole text if it has fewer), weighted by
how often they occur. For each of ``samples`` draws a term has its own gamma and uniform
variates from hashes: with r, c ~ Gamma(2, 1), b ~ U(0, 1) and weight w,

    t = floor(ln w / r + b),  y = exp(r (t - b)),  a = c / (y exp(r)),

and the term of least ``a``, over all terms of the text, is a consistent weighted sample: two
documents draw the same (term, t) with the probability of their generalised Jaccard similarity,
sum of minima over sum of maxima of weights. Values are kept as 16-bit hashes of ``a``, which is a
function of (term, t): unlike ones look alike once in 65,536.

The least ``a`` of a text of total weight W is exponential with mean 1 / W. With r = -ln(u1 u2) and
c = -ln(u3 u4), a >= c exp(-r) / w >= (1 - u3 u4) u1 u2 / w, so a term's logarithms are only taken
where this bound is at most ``CUTOFF`` / W; the leading 16 bits of all four u come from one hash and decide that, a
second hash has their other bits. A draw whose least ``a`` is beyond the bound (one in
exp(20)) is made anew over all terms of its text, so the bound saves time and changes nothing.

A text and its edited text share most terms, so both are drawn together: a term's variates are made once, for
its weights in either.

Only DataFrame functions are used: texts are shuffled once, by document, and terms are
counted in that partitioning without another exchange.

Defined cases: null text is empty; equal texts have equal fingerprints; those of texts without
words are printed as zeros; two fingerprints of empty texts have likeness 1, and 0 with any other;
documents with a null doc_id come last in the order; rows equal in doc_id and text are one
document and come back as often as they occur; among equal doc_ids the order is by text hash; a very long text is
read whole; an empty table gives an empty one; other columns of the input are not kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, partitions, text_bytes

SAMPLES = 64
SHINGLE = 5
CUTOFF = 20.0
_WORD = r"[ \t-\r]+"


def terms(text: Column, shingle: int) -> Column:
    """Array of the hashes of a text's runs of ``shingle`` words; empty without words."""
    words = F.filter(F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), _WORD), lambda w: w != "")
    starts = lambda w: F.sequence(F.lit(1), F.greatest(F.size(w) - (shingle - 1), F.lit(1)))
    runs = lambda w: F.when(F.size(w) > 0, F.transform(starts(w), lambda i: F.xxhash64(F.slice(w, i, shingle)))).otherwise(F.array().cast("array<bigint>"))
    return F.element_at(F.transform(F.array(words), runs), 1)  # the outer variable splits each text once, not once a run


def _pieces(hash_: Column) -> list[Column]:
    """A 64-bit hash as four numbers of 16 bits."""
    return [F.shiftrightunsigned(hash_, 16 * j).bitwiseAND(F.lit(0xFFFF).cast("bigint")).cast("double") for j in range(4)]


def may_be_least(lead: Column, bound: Column) -> Column:
    """Whether the lower bound of a x weight, from the leading 16 bits of a draw's four uniforms, is at most ``bound``."""
    p1, p2, p3, p4 = _pieces(lead)
    return p1 * p2 * (float(1 << 32) - (p3 + 1.0) * (p4 + 1.0)) <= bound * float(1 << 64)


def variates(lead: Column, term: Column, k: Column) -> list[Column]:
    """r, ln c and b of a term in draw ``k``; ``lead`` has the leading bits of the uniforms."""
    u1, u2, u3, u4 = ((x * 65536.0 + y + 0.5) / float(1 << 32) for x, y in zip(_pieces(lead), _pieces(F.xxhash64(term, k, F.lit(1))), strict=True))
    b = (F.shiftrightunsigned(F.xxhash64(term, k, F.lit(2)), 12).cast("double") + 0.5) / float(1 << 52)
    return [(-F.log(u1 * u2)).alias("r"), F.log(-F.log(u3 * u4)).alias("ln_c"), b.alias("b")]


def sample_value(ln_weight: Column) -> Column:
    """ln a, from the columns that ``variates`` makes."""
    r, b = F.col("r"), F.col("b")
    return F.col("ln_c") - r * (F.floor(ln_weight / r + b).cast("double") - b) - r


def likeness(a: Column, b: Column) -> Column:
    """Share of equal draws; arrays of values, all 0 for a text without terms."""
    used = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != 0) | (y != 0)), lambda v: v))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != 0) & (x == y)), lambda v: v))
    return F.when(used == 0, 1.0).otherwise(same / used)


def printed(bins: Column) -> Column:
    """A fingerprint as text: four hexadecimal digits a draw."""
    return F.concat_ws("", F.transform(bins, lambda v: F.substring(F.concat(F.lit("000"), F.hex(v.cast("bigint"))), -4, 4)))


def draws_of(texts: DataFrame, key: list[str], bodies: list[str], samples: int, shingle: int, cutoff: float | None = CUTOFF) -> DataFrame:
    """(key, bins0, bins1, ...): the sampled values of each of a key's ``bodies`` as 16-bit hashes; keys are distinct.

    A body without terms has null bins, and keys without any have no row. Where ``cutoff`` leaves a draw undecided, its value
    is null.
    """
    split = texts.select(*key, *[terms(F.col(c), shingle).alias(f"t{v}") for v, c in enumerate(bodies)])
    sized = split.select(*key, *[F.size(f"t{v}").alias(f"total{v}") for v in range(len(bodies))], F.posexplode(F.array(*[f"t{v}" for v in range(len(bodies))])).alias("version", "terms"))
    totals = [f"total{v}" for v in range(len(bodies))]
    counted = sized.select(*key, *totals, "version", F.explode("terms").alias("term")).groupBy(*key, *totals, "term").agg(*[F.count(F.when(F.col("version") == v, 1)).alias(f"n{v}") for v in range(len(bodies))])
    shares = [F.col(f"n{v}") / F.greatest(F.col(f"total{v}"), F.lit(1)) for v in range(len(bodies))]
    bound = (F.greatest(*shares) if len(shares) > 1 else shares[0]) * (cutoff or 1.0)
    valued = counted.select(*key, *totals, "term", bound.alias("bound"), *[F.when(F.col(f"n{v}") > 0, F.log(F.col(f"n{v}").cast("double"))).alias(f"ln{v}") for v in range(len(bodies))])
    each = valued.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(samples)]))).withColumn("lead", F.xxhash64("term", "k"))
    if cutoff is not None:
        each = each.filter(may_be_least(F.col("lead"), F.col("bound")))
    heaviest = F.greatest(*[f"ln{v}" for v in range(len(bodies))]) if len(bodies) > 1 else F.col("ln0")
    varied = each.select("bound", heaviest.alias("heaviest"), *key, *totals, "k", *[f"ln{v}" for v in range(len(bodies))], *variates(F.col("lead"), F.col("term"), F.col("k")))
    if cutoff is not None:  # for a weight of 1, t is 0, and a is known before the floor is
        varied = varied.filter(F.when(F.col("heaviest") == 0, F.col("ln_c") - F.col("r") * (1 - F.col("b"))).otherwise(F.col("ln_c") - F.col("r")) <= F.log("bound"))
    least = varied.groupBy(*key, *totals, "k").agg(*[F.min(sample_value(F.col(f"ln{v}"))).alias(f"a{v}") for v in range(len(bodies))])

    def value(v: int) -> Column:
        hashed = F.shiftright(F.xxhash64(f"a{v}"), 48).cast("smallint")
        kept = F.when(hashed == 0, F.lit(1).cast("smallint")).otherwise(hashed)
        return F.when(F.col(f"a{v}") <= F.log(F.lit(float(cutoff)) / F.col(f"total{v}")), kept) if cutoff is not None else F.when(F.col(f"a{v}").isNotNull(), kept)

    drawn = least.groupBy(*key, *totals).agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct(*[value(v).alias(f"v{v}") for v in range(len(bodies))])))).alias("drawn"))
    _of = lambda v: lambda k: F.try_element_at("drawn", k)[f"v{v}"]
    places = F.array(*[F.lit(k) for k in range(samples)])
    return drawn.select(*key, *[F.when(F.col(f"total{v}") > 0, F.transform(places, _of(v))).alias(f"bins{v}") for v in range(len(bodies))])


def neighbours(ids: DataFrame, per_range: int) -> DataFrame:
    """``ids`` (last, id, hash, chars, copies) with structs next and prev, cyclically in the order last, id, hash.

    Rows are dealt into ranges of that order by Spark's range partitioning and written with their range; neighbours within a
    range come from a window, those across from the ranges' first and last rows, one small row a range.
    """
    ranges = max(2 * partitions(ids.sparkSession), ids.count() // per_range)
    placed = durable(ids.repartitionByRange(ranges, "last", "id", "hash").withColumn("range", F.spark_partition_id()))
    me = F.struct("last", "id", "hash", "chars")
    within = Window.partitionBy("range").orderBy("last", "id", "hash")
    edges = placed.groupBy("range").agg(F.min(me).alias("first"), F.max(me).alias("final"))
    around, everything = Window.orderBy("range"), Window.partitionBy()  # over one row a range
    edges = edges.select("range", F.coalesce(F.lead("first").over(around), F.min("first").over(everything)).alias("after"), F.coalesce(F.lag("final").over(around), F.max("final").over(everything)).alias("before"))
    linked = placed.withColumn("next", F.lead(me).over(within)).withColumn("prev", F.lag(me).over(within)).join(edges, "range")
    return linked.withColumn("next", F.coalesce("next", "after")).withColumn("prev", F.coalesce("prev", "before")).drop("range", "after", "before")


def edited_fingerprints(docs: DataFrame, *, text: str = "text", samples: int = SAMPLES, shingle: int = SHINGLE, per_range: int = 200_000, part_bytes: int = 2 << 20, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is a document's with its last quarter of code points replaced by the first
    as many of the next document, in ascending doc_id, the first after the last.
    """
    spark = docs.sparkSession
    key = ["id", "hash"]
    parts = max(partitions(spark), text_bytes(docs, text) // part_bytes)  # term counts of a part stay in memory
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text", "doc_id"))
    ids = durable(rows.groupBy(F.col("doc_id").isNull().cast("int").alias("last"), *key).agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max(F.length("text")).alias("chars")))
    ids = durable(neighbours(ids, per_range).select(*key, "doc_id", "copies", F.col("next.id").alias("next_id"), F.col("next.hash").alias("next_hash"), F.col("prev.id").alias("prev_id"), F.col("prev.hash").alias("prev_hash"), F.floor(F.col("prev.chars") / 4).cast("int").alias("lent")))
    copy = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
    once = rows.select(*key, "text").repartition(parts, *key).withColumn("_copy", copy).filter("_copy = 1").drop("_copy")
    texts = once.join(ids, key)  # one exchange of the texts serves every use
    heads = texts.select(F.col("prev_id").alias("id"), F.col("prev_hash").alias("hash"), F.substring("text", F.lit(1), F.col("lent")).alias("head"))
    kept = F.length("text") - F.floor(F.length("text") / 4).cast("int")
    both = texts.join(heads, key).withColumn("edited", F.concat(F.substring("text", F.lit(1), kept), F.col("head")))
    facts = both.select(*key, "doc_id", "copies", "next_id", "next_hash", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    none = F.array_repeat(F.lit(0).cast("smallint"), samples)

    def with_prints(facts: DataFrame, both: DataFrame, cutoff: float | None) -> DataFrame:
        prints = draws_of(both, key, ["text", "edited"], samples, shingle, cutoff).select(*key, F.col("bins0").alias("own"), F.col("bins1").alias("changed"))
        return durable(facts.join(prints, key, "left").withColumn("own", F.coalesce("own", none)).withColumn("changed", F.coalesce("changed", none)))

    full = with_prints(facts, both, cutoff)
    undecided = F.exists("own", lambda v: v.isNull()) | F.exists("changed", lambda v: v.isNull())
    again = full.filter(undecided)
    if not again.isEmpty():
        ids_again = again.select(*key)
        full = full.filter(~undecided).unionByName(with_prints(again.drop("own", "changed"), both.join(ids_again, key, "left_semi"), None))
    after = full.select(F.col("id").alias("next_id"), F.col("hash").alias("next_hash"), F.col("own").alias("next_own"))
    joined = full.join(after, ["next_id", "next_hash"])
    columns = ["doc_id", "n_chars", "edited_sha256", printed(F.col("own")).alias("fingerprint"), printed(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next")]
    return joined.select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")
