"""N-gram Jaccard join with token-combination prefixes, and its components.

A document's set holds the hashes of its distinct runs of ``shingle`` words; two documents link
when 100 * intersection >= ``percent`` * union. Documents with equal sets form a class, and
the join runs over classes, so copies cost one row each and are never paired.

Prefixes. Tokens are ordered by frequency class, then by how frequent their words are (rare
words first), then by hash: a prefix holds what tells a document apart. A linked
document lacks at most d = n - ceil(n * percent / 100) of a set's n tokens. Rare tokens are
indexed one by one; frequent tokens (in more than 1 of ``share`` documents) are grouped by
hash and indexed as pairs within a group. A prefix is extended until removing any d of its
tokens leaves a signature: rare tokens + sum over groups of (size - 1) > d. Then two linked sets
share a signature, because tokens of the shorter prefix that the other lacks are at most d.
Where rare tokens suffice the prefix is longer by m = d // 2 (1 to ``MOST_EXTRA``) tokens, and linked sets share m
signatures at least; pairs that share fewer are not verified.
The number of groups follows the set's size band, and a set is indexed under its own and the
next band, so that sets of linkable sizes meet.

Links. A signature's list of up to ``SMALL`` members pairs them in full, and pairs that share too few signatures
are dropped before any text is read. In a longer list pairs are not spelled out: every member that shares ``MET`` lists with it
is verified against one hub (the member that stands in most and longest lists, so the original rather than
a copy with changes), and linked members are contracted. Then the list is refined. Members near the hub are
described by their differences from it, the tokens they add or lack, and for two of them

    |x & y| = |hub| - lacking(x) - lacking(y) + common differences,

so a link needs ceil((G(x) + G(y)) / (2 (100 + percent))) common differences at least, G(x) being
2 percent |x| - (100 + percent) |hub| + 2 (100 + percent) lacking(x). Differences that no other member has are
dropped, members left with too few are done, and the rest are indexed under a prefix of their rarest
differences: a copy's own changes no longer pair it with all the other copies. Members in the hub's
component need only meet those outside it. Members far from the hub keep the list, and so does the hub if some were not
verified against it. This is
repeated ``rounds`` times; then all lists pair members of different components in full.
Verification recounts both whole sets from the texts. Contraction is min-label propagation
with pointer jumping over written tables.

Sets are told apart by 64-bit hashes of all their tokens, and tokens by 64-bit hashes of their words.

Defined cases: null or empty texts have an empty set and link with nothing; fewer than
``shingle`` words count as one run; rows with equal doc_id are rows of their own; a null doc_id
never names a component unless all its documents' ids are null; a very long text is one set like any other; an empty
table gives an empty table; columns of the input called node or n_shingles are replaced in ``classified`` and kept in ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, partitions, releasing, text_bytes, without
from .textbatch import NOT_SPACE, Words, doc_words, mix, runs_hash

SHINGLE = 3
PERCENT = 90
SHARE = 500
WORD_SHARE = 50_000
ROUNDS = 2
MOST_EXTRA = 16
SMALL = 4  #: lists of so many members need no hub
MET = 2  #: lists with the hub that a member must share to be verified against it
NEAR = 25  #: percent of similarity to the hub from which differences are listed
PART_BYTES = 16 << 20
_U = np.uint64


def shingle_sets(w: Words, shingle: int, weigh=None) -> tuple:
    """(document, token, first index of each document) of the distinct runs, sorted by both.

    With ``weigh``, a function of word hashes, also the sum of each run's words' weights.
    """
    h, counts = w.hashes(), w.counts
    weight = np.concatenate(([0], np.cumsum(weigh(h)))) if weigh else np.zeros(len(h) + 1, np.int64)
    sums: list[np.ndarray] = []
    size = np.minimum(counts, shingle)  # a shorter text is one run
    parts, docs = [], []
    for k in range(1, shingle + 1):
        of = np.flatnonzero(size == k)
        if not len(of):
            continue
        runs = runs_hash(h, k) if k == shingle else None
        if k == shingle:
            starts = np.concatenate([np.arange(a, b) for a, b in zip(w.first[of], w.first[of + 1] - k + 1, strict=True)])
            parts.append(runs[starts])
            sums.append(weight[starts + k] - weight[starts])
            docs.append(np.repeat(of, counts[of] - k + 1))
        else:
            parts.append(mix(runs_hash(h, k)[w.first[of]] + _U(k)))
            sums.append(weight[w.first[of] + k] - weight[w.first[of]])
            docs.append(of)
    if not parts:
        none = np.zeros(0, np.int64)
        return (none, none.view(np.uint64), np.zeros(len(counts) + 1, np.int64)) + ((none,) if weigh else ())
    token, doc = np.concatenate(parts), np.concatenate(docs)
    order = np.lexsort((token, doc))
    token, doc = token[order], doc[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
    token, doc = token[new], doc[new]
    found = doc, token, np.searchsorted(doc, np.arange(len(counts) + 1))
    return (*found, np.concatenate(sums)[order][new]) if weigh else found


def class_ids(token: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit id of each document's set."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(token))))
    others = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(token ^ _U(0x5DEECE66D)))))
    a, b = sums[first[1:]] - sums[first[:-1]], others[first[1:]] - others[first[:-1]]
    return mix(a ^ mix(b + np.diff(first).astype(np.uint64)))


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.names.index(name))


def _classify(text: str, shingle: int, keep: bool):
    """Adds n_shingles and node; with ``keep`` all columns stay, else the text goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64)
            for d, e, w in doc_words(_column(batch, text), NOT_SPACE):
                _, token, first = shingle_sets(w, shingle)
                n[d:e], node[d:e] = np.diff(first), class_ids(token, first)
            columns = {c: batch.column(k) for k, c in enumerate(batch.schema.names) if keep or c != text}
            columns |= {"n_shingles": pa.array(n), "node": pa.array(node.view(np.int64))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def classified(docs: DataFrame, *, text: str = "text", shingle: int = SHINGLE, keep_text: bool = False) -> DataFrame:
    """``docs`` with n_shingles and node, the id of its set's class."""
    docs = without(docs, "n_shingles", "node")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if keep_text or f.name != text)
    return docs.mapInArrow(releasing(_classify(text, shingle, keep_text)), f"{kept}, n_shingles bigint, node bigint")


def _unseen(batch: pa.RecordBatch, text: str, shingle: int, weigh=None) -> Iterator[tuple]:
    """(nodes, tokens, firsts, weights or None, all words) of each slice; sets met before in the batch are left out."""
    seen: set[int] = set()
    for _, _, w in doc_words(_column(batch, text), NOT_SPACE):
        doc, token, first, *weight = shingle_sets(w, shingle, weigh)
        node, n = class_ids(token, first), np.diff(first)
        keep = np.zeros(len(node), bool)
        for j in np.flatnonzero(n):
            if (x := int(node[j])) not in seen:
                seen.add(x)
                keep[j] = True
        mask = keep[doc] if len(doc) else np.zeros(0, bool)
        kept = np.flatnonzero(keep)
        yield node[kept], token[mask], np.concatenate(([0], np.cumsum(n[kept]))), weight[0][mask] if weight else None, w


def _count(text: str, shingle: int, share: int, word_share: int):
    """Per batch, tokens in at least 1 of ``share`` sets and words that are at least 1 of ``word_share``; what is frequent in all is so in some batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, words, sets = [], [], 0
            for node, token, _, _, w in _unseen(batch, text, shingle):
                parts.append(token)
                words.append(w.hashes())
                sets += len(node)
            for is_word, found, least in ((False, parts, max(4, sets // share)), (True, words, max(2, sum(map(len, words)) // word_share))):
                key, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                often = n >= least
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(often.sum()), is_word)), pa.array(key[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["is_word", "key", "n"])

    return run


def frequencies(docs: DataFrame, sets: int, *, text: str = "text", shingle: int = SHINGLE, share: int = SHARE, word_share: int = WORD_SHARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted tokens in at least 1 of ``share`` of all sets, sorted words that are at least 1 of ``word_share`` of all, and the words' weights.

    At most ``share`` times the mean set size tokens can be so frequent, and ``word_share`` words. A weight grows
    with the logarithm of the count; all other words weigh 0. Classes and weights only steer the
    index; any set of tokens gives the same links.
    """
    counts = durable(docs.select(text).mapInArrow(releasing(_count(text, shingle, share, word_share)), "is_word boolean, key bigint, n bigint").groupBy("is_word", "key").agg(F.sum("n").alias("n")))
    least = max(2, int(counts.filter("is_word").agg(F.sum("n")).first()[0] or 0) // word_share)
    tokens = counts.filter(~F.col("is_word") & (F.col("n") >= max(8, sets // share))).select("key").toArrow()
    words = counts.filter(F.col("is_word") & (F.col("n") >= least)).select("key", "n").toArrow()
    word, n = words.column("key").to_numpy().view(np.uint64), words.column("n").to_numpy()
    order = np.argsort(word)
    return np.sort(tokens.column("key").to_numpy().view(np.uint64)), word[order], 1 + np.floor(4 * np.log2(n[order] / least)).astype(np.int64)


def size_bands(percent: int, most: int = 1 << 40) -> np.ndarray:
    """Lower bounds of set size bands; linkable sizes lie in one band or in neighbours."""
    bounds = [1]
    while bounds[-1] < most:
        bounds.append(bounds[-1] * 100 // percent + 1)
    return np.array(bounds, np.int64)


def signatures(token: np.ndarray, weight: np.ndarray, frequent: np.ndarray, percent: int, bands: np.ndarray) -> tuple[np.ndarray, int]:
    """The signatures of one set: single rare tokens, pairs of frequent ones within a group.

    Also how many of them a linked set must share, 0 if that is not known to be more than one.
    """
    n = len(token)
    spare = n - -(-n * percent // 100)
    if n * 100 // percent == n and not spare:
        return np.zeros(0, np.uint64), 0  # no other size can link, so only an equal set, which is the same class
    order = np.lexsort((token, weight))
    token = token[order]
    at = np.minimum(np.searchsorted(frequent, token), max(len(frequent) - 1, 0))
    is_frequent = frequent[at] == token if len(frequent) else np.zeros(n, bool)
    rare = token[~is_frequent]
    extra = max(1, min(spare // 2, MOST_EXTRA))
    if len(rare) >= spare + extra:
        return mix(rare[: spare + extra]), extra
    often, out = token[is_frequent], [mix(rare)]
    band = int(np.searchsorted(bands, n, "right")) - 1
    for b in (band, band + 1):
        groups = max(1, int(bands[b]) // 8)
        group = (mix(often ^ _U(0xA5A5A5A5)) % _U(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        rank = np.empty(len(often), np.int64)  # how many of its group stand before it
        begin = np.concatenate(([True], np.diff(group[order]) != 0))
        rank[order] = np.arange(len(often)) - np.repeat(np.flatnonzero(begin), np.diff(np.append(np.flatnonzero(begin), len(often))))
        useful = np.cumsum(rank > 0)  # each token but its group's first stands for one loss more
        stop = int(np.searchsorted(useful, spare + 1 - len(rare))) + 1
        taken, of, place = often[:stop], group[:stop], rank[:stop]
        salt = mix(np.array([b], np.uint64) + _U(0xBADC0FFE))[0]
        for back in range(1, int(place.max()) + 1):
            order = np.lexsort((place, of))
            t, g = taken[order], of[order]
            same = g[back:] == g[:-back]
            out.append(mix(t[back:][same] * _U(3) + mix(t[:-back][same] + salt)))
    return np.concatenate(out), 0


def _index(text: str, shingle: int, percent: int, broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (frequent, words, weights), bands = broadcast.value, size_bands(percent)

        def weigh(h: np.ndarray) -> np.ndarray:
            if not len(words):
                return np.zeros(len(h), np.int64)
            at = np.minimum(np.searchsorted(words, h), len(words) - 1)
            return np.where(words[at] == h, weights[at], 0)

        for batch in batches:
            for node, token, first, weight, _ in _unseen(batch, text, shingle, weigh):
                parts = [signatures(token[a:b], weight[a:b], frequent, percent, bands) for a, b in zip(first[:-1], first[1:], strict=True)]
                sizes = [len(p) for p, _ in parts]
                sig = np.concatenate([p for p, _ in parts]) if parts else np.zeros(0, np.uint64)
                must = np.repeat(np.array([m for _, m in parts], np.int32), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(np.repeat(node, sizes).view(np.int64)), pa.array(must)], ["sig", "node", "must"])

    return run


def _sets_of(batch: pa.RecordBatch, key: str, text: str, shingle: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted sets of the batch's distinct keys, and which of them each row has."""
    _, first, which = np.unique(_column(batch, key).to_numpy(), return_index=True, return_inverse=True)
    sets: list[np.ndarray] = []
    for _, _, w in doc_words(_column(batch, text).take(pa.array(first)), NOT_SPACE):
        _, token, bounds = shingle_sets(w, shingle)
        sets += [token[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
    return sets, which


def _verify(shingle: int, percent: int, near: int):
    """Whether the sets of a and b, counted anew from the texts, link; where ``want`` and they are near, how b differs from a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (left, of_a), (right, of_b) = _sets_of(batch, "a", "text_a", shingle), _sets_of(batch, "b", "text_b", shingle)
            linked, lacking, differs = [], [], []
            for i, j, want in zip(of_a, of_b, _column(batch, "want").to_pylist(), strict=True):
                x, y = left[i], right[j]
                common = len(np.intersect1d(x, y, assume_unique=True))
                total = len(x) + len(y) - common
                linked.append(100 * common >= percent * total)
                listed = want and 100 * common >= near * total
                lacking.append(len(x) - common if listed else None)
                differs.append(np.setxor1d(x, y, assume_unique=True).view(np.int64) if listed else None)
            yield pa.RecordBatch.from_arrays([_column(batch, "a"), _column(batch, "b"), pa.array(linked, pa.bool_()), pa.array(lacking, pa.int64()), pa.array(differs, pa.list_(pa.int64()))], ["a", "b", "linked", "lacking", "differs"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int, near: int) -> DataFrame:
    """(a, b, linked, lacking, differs) for pairs (a, b, want) of nodes; rows of one ``a`` come together, so its set is counted once."""
    right = pairs.hint("merge").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.hint("merge").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "want", "text_a", "text_b").mapInArrow(releasing(_verify(shingle, percent, near)), "a bigint, b bigint, linked boolean, lacking bigint, differs array<bigint>")


def contract(components: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` (node, comp, more columns) after joining those that ``links`` (a, b) connect: comp is the least of all."""
    of = lambda c: components.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))
    edges = links.join(of("a"), "a").join(of("b"), "b").filter("a_comp <> b_comp").select(F.col("a_comp").alias("u"), F.col("b_comp").alias("v"))
    edges = durable(edges.union(edges.select("v", "u")).distinct())
    if edges.isEmpty():
        return components
    labels = durable(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("label")))
    while True:
        near = edges.join(labels.select(F.col("u").alias("v"), F.col("label").alias("other")), "v").groupBy("u").agg(F.min("other").alias("least"))
        lower = labels.join(near, "u").select("u", F.least("label", "least").alias("label"), F.col("label").alias("was"))
        jump = labels.select(F.col("u").alias("label"), F.col("label").alias("further"))
        lower = durable(lower.join(jump, "label", "left").select("u", F.least("label", "further").alias("label"), "was"))
        changed = not lower.filter("label <> was").isEmpty()
        labels = lower.drop("was")
        if not changed:
            break
    renamed = components.join(labels.withColumnRenamed("u", "comp"), "comp", "left")
    return durable(renamed.withColumn("comp", F.coalesce("label", "comp")).select(components.columns))


def _mixed(index: DataFrame, components: DataFrame) -> DataFrame:
    """Rows of ``index`` (sig, node, must) in lists that hold several components, with their nodes' columns."""
    placed = index.join(components, "node")
    lists = placed.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("sig")
    return placed.join(lists, "sig")


def refine(answers: DataFrame, components: DataFrame, percent: int, salt: int) -> tuple[DataFrame, DataFrame]:
    """Lists (sig, node, must) and pairs (a, b) by which members near one hub may still link.

    ``answers`` are those of ``verified`` with a hub as ``a``. The lists pair members outside the hub's component, the
    pairs are of one inside and one outside it.
    """
    unit = 2 * (100 + percent)
    place = lambda c: components.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("comp").alias(f"comp_{c}"))
    near = answers.filter("differs IS NOT NULL").join(place("a"), "a").join(place("b"), "b")
    g = 2 * percent * F.col("n_b") - (100 + percent) * F.col("n_a") + unit * F.col("lacking")
    near = durable(near.select("a", "b", "n_b", "differs", g.alias("g"), (F.col("comp_a") != F.col("comp_b")).alias("outside")))
    least = near.groupBy("a").agg(F.min(F.when(F.col("outside"), F.col("g"))).alias("g_out"), F.min(F.when(~F.col("outside"), F.col("g"))).alias("g_in")).filter("g_out IS NOT NULL")
    need = lambda other: F.greatest(F.lit(1), F.ceil((F.col("g") + F.col(other)) / unit))
    members = near.join(least, "a").select("a", "b", "n_b", "outside", need("g_out").alias("need_out"), need("g_in").alias("need_in"), F.explode("differs").alias("token"))
    useful = members.groupBy("a", "token").agg(F.count("*").alias("df"), F.max("outside").alias("any_out")).filter("df > 1 AND any_out").select("a", "token", "df")
    order = Window.partitionBy("a", "b").orderBy("df", "token")
    ranked = members.join(useful, ["a", "token"]).withColumn("rank", F.row_number().over(order)).withColumn("total", F.count("*").over(Window.partitionBy("a", "b")))
    prefix = lambda c: F.col("rank") <= F.col("total") - F.col(c) + 1  # noqa: E731  empty where the total is below the need
    kept = ranked.select("a", "b", "n_b", "token", "outside", prefix("need_out").alias("to_out"), F.coalesce(F.col("outside") & prefix("need_in"), F.lit(False)).alias("to_in"))
    kept = durable(kept.filter("to_out OR to_in"))
    lists = kept.filter("outside AND to_out").select(F.xxhash64("a", "token", F.lit(salt)).alias("sig"), F.col("b").alias("node"), F.lit(-1).alias("must"))
    inside = kept.filter("NOT outside AND to_out").select("a", "token", F.col("b").alias("x"), F.col("n_b").alias("n_x"))
    met = kept.filter("to_in").join(inside, ["a", "token"]).filter((F.col("n_b") * 100 >= F.col("n_x") * percent) & (F.col("n_x") * 100 >= F.col("n_b") * percent))
    return lists, met.select(F.least("b", "x").alias("a"), F.greatest("b", "x").alias("b")).distinct()


def link_components(docs: DataFrame, classes: DataFrame, *, text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, share: int = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """(node, comp) for nodes that may have links; ``classes`` is (node, n, rep), rep the doc_id whose text stands for it."""
    spark = docs.sparkSession
    known = frequencies(docs, classes.count(), text=text, shingle=shingle, share=share)
    index = docs.select(text).mapInArrow(releasing(_index(text, shingle, percent, spark.sparkContext.broadcast(known))), "sig bigint, node bigint, must int")
    index = index.repartition(max(partitions(spark), text_bytes(docs, text) // PART_BYTES), "sig")
    shared = index.groupBy("sig").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.max("must").alias("most")).filter("low < high AND most >= 0").select("sig")  # reads all columns, so that one exchange serves both uses
    index = durable(index.join(shared, "sig").distinct())
    lists = index.groupBy("sig").agg(F.count("*").alias("size"))
    facts = index.join(lists, "sig").groupBy("node").agg(F.count("*").alias("lists"), F.max("must").alias("must"), F.sum(F.floor(8 * F.log2("size"))).alias("central"))
    lost = lambda size: size - F.ceil(size * percent / 100)
    enough = F.when(F.col("must") == 0, 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(MOST_EXTRA), F.floor(lost(F.ceil(F.col("n") * percent / 100)) / 2))))
    nodes = durable(facts.join(classes, "node").filter(F.col("lists") >= enough).select("node", "n", "central", "rep"))  # others share too few signatures with any set of a linkable size
    texts = docs.select("doc_id", F.col(text).alias("text")).join(nodes.select(F.col("rep").alias("_rep"), F.col("node").alias("_node")).hint("merge"), F.col("doc_id").eqNullSafe(F.col("_rep")))  # by shuffle at every size: the nodes grow with the documents
    texts = classified(texts.select("_node", "text"), shingle=shingle, keep_text=True).filter("node = _node").select("node", "text")
    texts = durable(texts.dropDuplicates(["node"]))
    components = nodes.select("node", "n", "central", F.col("node").alias("comp"))
    near = min(NEAR, percent)
    apart = lambda x, y, p: (F.col(x) * 100 < F.col(y) * p) | (F.col(y) * 100 < F.col(x) * p)
    met = tried = None
    for r in range(rounds + 1):
        placed = durable(_mixed(index, components))
        empty, asked = placed.isEmpty(), []
        if empty and met is None:
            break
        if met is not None:
            asked.append(met.withColumn("want", F.lit(False)))
        if r < rounds and not empty:
            hub = F.struct("central", F.col("node").alias("hub"), F.col("n").alias("n_hub"), F.col("must").alias("must_hub"))
            hubs = placed.groupBy("sig").agg(F.max(hub).alias("best"), F.count("*").alias("size")).select("sig", "best.*", "size").drop("central")
            short = placed.join(hubs.filter(F.col("size") <= SMALL).select("sig"), "sig").select("sig", "node", "must")
            each = durable(placed.join(hubs.filter(F.col("size") > SMALL), "sig").filter("node <> hub").select("sig", "node", "n", "must", "hub", "n_hub", "must_hub"))
            met_lists = each.filter(~apart("n", "n_hub", near)).groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("lists"))
            asked.append(met_lists.filter(F.col("lists") >= MET).select("a", "b", F.lit(True).alias("want")))
        elif not empty:
            other = placed.select("sig", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("comp").alias("comp_b"), F.col("must").alias("must_b"))
            both = placed.join(other, "sig").filter((F.col("node") < F.col("b")) & (F.col("comp") != F.col("comp_b")) & ~apart("n", "n_b", percent))
            must = F.when(F.col("must") == -1, 1).when(F.col("must") == 0, F.col("must_b")).when(F.col("must_b") == 0, F.col("must")).otherwise(F.least("must", "must_b"))
            asked.append(both.groupBy(F.col("node").alias("a"), "b").agg(F.count("*").alias("common"), F.min(must).alias("least")).filter("common >= least").select("a", "b", F.lit(False).alias("want")))
        pairs = asked[0] if len(asked) == 1 else asked[0].unionByName(asked[1])
        if r == rounds and tried is not None:
            pairs = pairs.distinct().join(tried, ["a", "b"], "left_anti")
        answers = durable(verified(pairs, texts, shingle, percent, near))
        done = answers.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        tried = done if tried is None else tried.union(done)
        components = contract(components, answers.filter("linked").select("a", "b"))
        if empty:
            break
        if r < rounds:
            lists, met = refine(answers, components, percent, r)
            # a member this near the hub links with none that is not near it too
            done = answers.filter("differs IS NOT NULL").join(nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a")), "a").join(nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b")), "b")
            done = done.filter(100 * (F.col("n_a") - F.col("lacking")) >= (near + 100 - percent) * (F.col("n_b") + F.col("lacking"))).select(F.col("a").alias("hub"), F.col("b").alias("node")).distinct()
            far = each.join(done, ["hub", "node"], "left_anti").select("sig", "node", "must")
            missed = each.filter(~apart("n", "n_hub", percent)).join(answers.select(F.col("a").alias("hub"), F.col("b").alias("node")), ["hub", "node"], "left_anti")
            still = missed.select("sig", F.col("hub").alias("node"), F.col("must_hub").alias("must")).distinct()
            index = durable(short.unionByName(far).unionByName(still).unionByName(lists))
    return components.select("node", "comp")


def with_components(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, node, comp, component_id for each row of ``docs`` (doc_id, text).

    ``comp`` tells components apart even where rows share doc_ids; it is null for empty sets.
    """
    text, shingle = options.get("text", "text"), options.get("shingle", SHINGLE)
    rows = durable(classified(docs.select("doc_id", F.col(text).alias(text)), text=text, shingle=shingle))
    classes = rows.filter("n_shingles > 0").groupBy("node").agg(F.max("n_shingles").alias("n"), F.min("doc_id").alias("rep"))
    components = link_components(docs, classes, **options)
    named = classes.join(components, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "rep")
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "comp").select("node", "comp", "component_id")
    alone = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", "node", F.lit(None).cast("bigint").alias("comp"), F.col("doc_id").alias("component_id"))
    return rows.filter("n_shingles > 0").join(named, "node").select("doc_id", "n_shingles", "node", "comp", "component_id").unionByName(alone)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each component: that of the least doc_id. Empty sets stay."""
    text, shingle = options.get("text", "text"), options.get("shingle", SHINGLE)
    found = with_components(docs, **options)
    best = found.filter("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")).alias("best"))
    keep = best.select(F.xxhash64("best.doc_id").alias("_key"), "best.node").union(found.filter("comp IS NULL").select(F.xxhash64("doc_id").alias("_key"), "node")).distinct()
    names = docs.columns
    keyed = classified(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.xxhash64("doc_id").alias("_key"), F.col(text).alias("_text")), text="_text", shingle=shingle)
    nth = F.row_number().over(Window.partitionBy("_key", "node").orderBy(F.lit(0)))
    once = keyed.withColumn("_nth", nth).filter((F.col("_nth") == 1) | (F.col("n_shingles") == 0))
    return once.join(keep, ["_key", "node"], "left_semi").select("_row.*")
