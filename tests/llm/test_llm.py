"""The text operators against brute force on small fixtures with nulls, empties, ties and repeats."""

import collections
import hashlib
import pickle
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, common, decontaminate, fingerprints, licenses, mixing, ngramjoin, quality, queries, sharding, substrings, toxicity

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPACED = re.compile("[^\x20\x09-\x0d]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).repartition(3)


def test_substrings(spark):
    random.seed(5)
    base = ["".join(random.choice("ab é") for _ in range(random.randint(0, 400))) for _ in range(12)]
    rows = []
    for i in range(60):
        b, o = random.choice(base), random.choice(base)
        a = random.randint(0, len(b))
        rows.append((i if i % 7 else i - 1, random.choice([b, b[:a] + "X" + b[a:], b[:a] + o, o[:30] + b, None, "", "z" * random.randint(40, 200)])))
    rows += [(None, base[0]), (None, base[0])]
    first, want = {}, []
    raw = [(2**63 - 1 if i is None else i, i, (t or "").encode()) for i, t in rows]
    for k, _, b in raw:
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], k), k)
    for k, i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < k:
                gone[p : p + 50] = b"\x01" * 50
        spans = sum(1 for p in range(len(b)) if gone[p] and (not p or not gone[p - 1]))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    got = substrings.remove_repeats(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert substrings.remove_repeats(frame(spark, rows).limit(0)).count() == 0


def test_radix_groups():
    rng = np.random.default_rng(1)
    windows = rng.integers(0, 2, (400, 11)).astype(np.uint8)
    windows[:, :7] = 1
    group, doc = rng.integers(0, 3, 400), rng.integers(0, 9, 400)
    least = {}
    for w, g, d in zip(windows, group, doc, strict=True):
        least[(g, w.tobytes())] = min(d, least.get((g, w.tobytes()), 99))
    want = [d > least[(g, w.tobytes())] for w, g, d in zip(windows, group, doc, strict=True)]
    assert substrings.radix_groups(windows, group, doc).tolist() == want


def components(rows, k, percent):
    sets = []
    for _, t in rows:
        w = SPACED.findall(lower(t))
        sets.append({tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(sets[i]), least[root(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def copies(n):
    random.seed(3)
    base = [[random.choice("abcdefgh") + random.choice("xyz") for _ in range(random.choice([3, 12, 30, 80, 200]))] for _ in range(12)]
    rows = []
    for i in range(n):
        b = list(random.choice(base[:4] if i % 2 else base))
        for _ in range(random.choice([0, 0, 1, 1, 2, 3, len(b) // 15])):
            b[random.randrange(len(b))] = random.choice("qwertyu")
        rows.append((i, " ".join(b)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, "A"), (n + 3, "a"), (n + 4, "a b"), (3, rows[7][1])]


@pytest.mark.parametrize(("shingle", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(spark, shingle, percent):
    rows = copies(220)
    found = ngramjoin.with_components(frame(spark, rows), shingle=shingle, percent=percent, share=20)
    assert sorted(map(tuple, found.select("doc_id", "n_shingles", "component_id").collect())) == components(rows, shingle, percent)


@pytest.mark.parametrize(("shingle", "percent"), [(3, 90), (5, 80)])
def test_ngram_join_supersets_and_insertions(spark, shingle, percent):
    random.seed(8)
    rows = []
    for n in range(4, 22):  # sets of few shingles: nothing may be lacking, yet a superset links
        base = [f"w{n}x{k}" for k in range(n)]
        rows += [base, [*base, "more"], ["first", *base], [*base, "more", "words"], base[1:]]
    for size in (60, 150):
        base = [f"b{random.randrange(400)}" for _ in range(size)]
        for _ in range(45):
            b = list(base)
            for _ in range(random.randrange(1, 9)):
                at = random.randrange(len(b))
                b[at : at + random.choice([0, 1, 1])] = random.choice([[], ["new"], [f"n{random.randrange(50)}"]])
            rows.append(b)
    rows = [(k, " ".join(w)) for k, w in enumerate(rows)]
    random.shuffle(rows)
    found = ngramjoin.with_components(frame(spark, rows), shingle=shingle, percent=percent)
    assert sorted(map(tuple, found.select("doc_id", "n_shingles", "component_id").collect())) == components(rows, shingle, percent)


def test_ngram_join_family_of_families(spark):
    """A variant of a text has many copies itself, and another text shares nothing but a passage."""
    random.seed(9)
    base = [f"b{k}" for k in range(120)]
    variant = [f"v{k}" if k % 9 == 4 else w for k, w in enumerate(base)]
    rows = []
    for of in (base, variant, [*base[:30], *(f"o{k}" for k in range(90))]):
        for _ in range(50):
            b = list(of)
            for _ in range(random.randrange(6)):
                b[random.randrange(len(b))] = f"n{random.randrange(10**6)}"
            rows.append(b)
    rows = [(k, " ".join(w)) for k, w in enumerate(rows)]
    found = ngramjoin.with_components(frame(spark, rows), shingle=3, percent=80)
    assert sorted(map(tuple, found.select("doc_id", "n_shingles", "component_id").collect())) == components(rows, 3, 80)


def test_ngram_join_edge_tables(spark):
    assert ngramjoin.with_components(frame(spark, [])).collect() == []
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, long, 5, 6), (2, long + " end", 5, 6), (2, long + " end", 5, 6), (None, long, 5, 6), (3, None, 5, 6)]
    docs = frame(spark, rows, "doc_id long, text string, node long, N_Shingles long")
    found = ngramjoin.with_components(docs.select("doc_id", "text"))
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in found.collect()) == [("1", 1), ("2", 1), ("2", 1), ("3", 3), ("None", 1)]
    assert ngramjoin.classified(docs).columns == ["doc_id", "n_shingles", "node"]
    assert sorted(map(tuple, ngramjoin.one_of_each(docs).select("doc_id", "node", "N_Shingles").collect())) == [(1, 5, 6), (3, 5, 6)]


def test_one_of_each(spark):
    rows = copies(60)[:-1]  # the last row repeats a doc_id in another component
    kept = sorted(r["doc_id"] for r in ngramjoin.one_of_each(frame(spark, [(*r, "s") for r in rows], "doc_id long, text string, node string")).collect())
    want = components(rows, 3, 90)
    assert kept == sorted([c for c in {c for _, n, c in want if n}] + [d for d, n, _ in want if not n])


def test_decontaminate(spark):
    random.seed(6)
    items = [(f"i{k}", " ".join(random.choice("abcde") for _ in range(random.choice([0, 1, 3, 10, 14])))) for k in range(8)] + [("n", None)]
    docs = [(i, " ".join(random.choice("abcdeF-") for _ in range(60)) + "; " + str(random.choice(items)[1])) for i in range(40)] + [(90, None), (91, "")]
    windows = []
    for item, text in items:
        w = WORD.findall(lower(text))
        k = min(10, len(w))
        windows += [(item, tuple(w[p : p + k])) for p in range(len(w) - k + 1)] if w else []
    want = []
    for d, text in docs:
        w, hit, held = WORD.findall(lower(text)), set(), set()
        for item, win in windows:
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit |= set(range(p, p + len(win)))
                    held.add(item)
        want.append((d, len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit)))
    bench = spark.createDataFrame(items, "item_id string, text string")
    for most in (1_000_000, 5):
        got = decontaminate.decontaminate(frame(spark, docs), bench, max_windows=most).drop("text")
        assert sorted(map(tuple, got.collect())) == sorted(want)
    cut = decontaminate.decontaminate(frame(spark, docs), bench, action="cut").select("doc_id", "text")
    assert decontaminate.decontaminate(cut, bench).filter("contaminated").count() == 0


def test_cut_in_blocks(spark):
    random.seed(16)
    items = [(f"i{k}", " ".join(random.choice("abcde") for _ in range(n))) for k, n in enumerate([12, 3, 14, 11, 4, 13, 3])] + [("n", None)]
    docs = [(i, " ".join(random.choice("abcdeF-é") for _ in range(50)) + "; " + str(random.choice(items)[1]) + " zz") for i in range(30)] + [(90, None), (91, ""), (92, "no such words")]
    # taken out of the middle, one item leaves another behind
    docs += [(93, " ".join([*items[2][1].split()[:5], *items[0][1].split(), *items[2][1].split()[5:]]))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    windows = [w[p : p + min(10, len(w))] for _, t in items for w in [WORD.findall(lower(t))] for p in range(len(w) - min(10, len(w)) + 1) if w]
    want = {}
    for d, t in docs:
        while True:
            found = list(WORD.finditer(lower(t)))
            words, hit = [m.group() for m in found], set()
            for win in windows:
                hit |= {p + j for p in range(len(words) - len(win) + 1) if words[p : p + len(win)] == win for j in range(len(win))}
            if not hit:
                break
            gone = set()
            for j in hit:
                gone |= set(range(found[j].start(), found[j].end()))
                if j + 1 in hit:
                    gone |= set(range(found[j].end(), found[j + 1].start()))
            t = "".join(c for k, c in enumerate(t) if k not in gone)
        want[d] = t
    whole = decontaminate.decontaminate(frame(spark, docs), bench, action="cut")
    parts = decontaminate.decontaminate(frame(spark, docs), bench, action="cut", max_windows=5)
    assert parts.columns == whole.columns
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect()))
    assert {r["doc_id"]: r["text"] for r in parts.collect()} == want and sum(want[d] != t for d, t in docs) > 5


def test_licenses(spark):
    rows = [(1, "CC BY-NC 4.0, general public license. CC by cc-by"), (2, None), (3, ""), (4, "x All Rights reserved"), (5, "SPDX-License-Identifier: MIT OR (GPL-2.0-only AND Apache-2.0)\nfoo"), (6, "SPDX-License-Identifier: MIT OR"), (6, "cc"), (7, "by")]
    got = {(r["doc_id"], r["n_words"]): r for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert [(r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in (got[1, 12], got[2, 0], got[4, 4])] == [(4, 0, 10, "cc-by,gpl"), (0, None, None, ""), (1, 1, 1, "reserved")]
    assert "spdx-permissive" in got[5, 14]["labels"] and "spdx:invalid" in got[6, 5]["labels"]
    assert licenses.evaluate(licenses.to_rpn("GPL-2.0 WITH x OR MIT AND ISC")) == (True, {"gpl-2.0", "with-x", "mit", "isc"})
    for bad in ("", "MIT OR", "(MIT", "MIT)", "MIT ISC"):
        with pytest.raises(licenses.ExpressionError):
            licenses.to_rpn(bad)


def test_mixing(spark):
    random.seed(7)
    rows = [(i, random.choice(["a", "b", "c", None]), " ".join("w" * random.randint(1, 3) for _ in range(random.choice([0, 1, 40, 900])))) for i in range(80)] + [(80, "tiny", "x"), (81, "z", None), (81, "z", None)]
    df = frame(spark, rows, "doc_id long, source string, text string")
    got = mixing.taken_words(df).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got)) == sorted(map(tuple, mixing.taken_words(df).collect()))
    size = collections.Counter()
    for _, s, t in rows:
        size[s] += len(SPACED.findall(t or ""))
    taken, target = collections.Counter(), {}
    source = {i: s for i, s, _ in rows}
    for r in got:
        assert r["taken"] <= 3 * r["size"] and r["source_size"] == size[source[r["doc_id"]]]
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert all(taken[s] == int(target[s]) and target[s] <= 3 * size[s] + 1e-6 for s in target)
    words = mixing.mixed_documents(df).groupBy("source").agg(F.sum(F.size(F.filter(F.split("text", "[ \n]+"), lambda w: w != ""))).alias("n")).collect()
    assert {r["source"]: r["n"] for r in words} == {s: t for s, t in taken.items() if t}


def test_mixing_keeps_shards_off_the_driver_and_slots_in_many_tasks(spark, monkeypatch):
    for name, value in (("SHARD_SLOTS", 8), ("TASK_SLOTS", 64)):
        monkeypatch.setattr(mixing, name, value, raising=False)
    df = frame(spark, [(i, f"s{i % 6}", "w " * 300) for i in range(60)], "doc_id long, source string, text string")
    given, create = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: (given.append(len(data)), create(self, data, *a, **b))[1])
    m = mixing.mix_sources(df, block_words=4)
    rows = m.slots.withColumn("task", F.spark_partition_id()).collect()
    assert max(given) <= len(m.sources)  # before: a row a shard and source
    assert len({r["task"] for r in rows}) > 1  # before: merged into one task
    assert sorted((r["sid"], r["slot"]) for r in rows) == [(k, i) for k, s in enumerate(m.sources) for i in range(s.slots)]


def test_mixing_broadcasts_no_slots(spark):
    df = frame(spark, [(i, f"s{i % 6}", "w " * 300) for i in range(60)], "doc_id long, source string, text string")
    for out in (mixing.mix_sources(df).pieces(), mixing.taken_words(df), mixing.mixed_documents(df)):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [sid" in plan and not re.search(r"BroadcastHashJoin \[(sid#\d+L?, block|sid#\d+L?, start|key)", plan)


def test_permutation():
    for n in (1, 2, 7, 64, 1000):
        index = np.arange(n)
        out = mixing.permute(index, np.full(n, n), np.full(n, 77, np.uint64))
        assert sorted(out.tolist()) == list(range(n))
        assert [mixing.place_of(int(v), n, 77) for v in out[:5]] == list(range(min(n, 5)))


def test_sharding():
    names = sharding.shard_names(20)
    table = sharding.lookup_table(names, 1009)
    counts = collections.Counter(table)
    assert set(counts) == set(range(20)) and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = sum(1 for a, b in zip(table, fewer, strict=True) if a != b and a != 19)
    assert moved < 0.25 * 1009
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)


def test_sharding_rows(spark):
    got = sharding.place(frame(spark, [(1, "a"), (1, "b"), (None, "c")], "doc_id long, shard string"))
    assert got.count() == 3 and got.filter("doc_id = 1").select("shard").distinct().count() == 1


def jaccard(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def test_fingerprints(spark):
    random.seed(8)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = [(i * 3, " ".join(random.choice(vocabulary) for _ in range(300)) + "é") for i in range(40)] + [(7, None), (8, ""), (9, "one two"), (9, "one two"), (None, "last")]
    got = fingerprints.edited_fingerprints(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    order = sorted({(i is None, i or 0, t or "") for i, t in rows})
    text = {i: t for _, i, t in order if i % 3 == 0 and t != "last"}
    after = {order[k][1]: order[(k + 1) % len(order)][2] for k in range(len(order)) if not order[k][0]}
    grams = lambda t: collections.Counter(tuple(t.split()[p : p + 5]) for p in range(len(t.split()) - 4))
    gaps = []
    for r in got:
        if r["doc_id"] in text and r["doc_id"] is not None and r["doc_id"] != 9:
            t, n = text[r["doc_id"]], len(text[r["doc_id"]]) // 4
            edited = t[: len(t) - n] + after[r["doc_id"]][:n]
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(t)
            gaps.append(r["near_edited"] - jaccard(grams(t), grams(edited)))
    assert abs(np.mean(gaps)) < 0.05 and np.std(gaps) < 0.12
    empties = [r for r in got if r["doc_id"] in (7, 8)]
    assert empties[0]["fingerprint"] == empties[1]["fingerprint"] and {r["near_next"] for r in empties if r["doc_id"] == 7} == {1.0}


def test_fingerprints_of_repeated_lines(spark):
    line = " ".join(f"l{k}" for k in range(20)) + "\n"
    one, two = (line * 200 + " ".join(f"{c}{k}" for k in range(204)) for c in "pq")
    heavy = ["a b c d " * 300 + " ".join(f"{c}{k}" for k in range(60)) for c in "xy"]
    rows = list(enumerate([one, two, *heavy, "one two three", "x y " * 9]))
    grams = lambda t: collections.Counter(tuple(t.split()[p : p + 5]) for p in range(len(t.split()) - 4))
    got = fingerprints.edited_fingerprints(frame(spark, rows)).collect()
    near = {r["doc_id"]: r["near_next"] for r in got}
    assert abs(near[0] - jaccard(grams(one), grams(two))) < 0.15
    assert abs(near[2] - jaccard(grams(heavy[0]), grams(heavy[1]))) < 0.15
    again = fingerprints.edited_fingerprints(frame(spark, rows), cutoff=1.0).collect()  # most texts have undecided draws
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_chat_round_trip():
    random.seed(9)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "[SYS]", "[OUT]", "[ROLE:", "\\", "<", "[", "a", "\n", "é"]
    for _ in range(300):
        turns = [(random.choice(["user", "assistant", "system", "", "x]"]), "".join(random.choice(bits) for _ in range(random.randint(0, 8)))) for _ in range(random.randint(1, 5))]
        text, spans = chat.format_turns(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_chat_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 0, None, "x"), (None, None, "user", "q")]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(frame(spark, rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == hashlib.sha256(b"\nx\nuser\n\nassistant\nb\n").hexdigest()
    assert (got[1]["loss_chars"], got[None]["loss_chars"]) == (1, 0)


@pytest.mark.parametrize(("name", "label", "least"), [("op4_quality", "quality", 0.97), ("op1_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    path = "/root/testdata/sf0.01"
    found = queries.QUERIES[name](spark, path)
    both = found.filter("held_out").join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id")
    assert both.agg(F.avg((F.col(label) == F.col("predicted")).cast("double"))).first()[0] >= least
    assert found.filter("score < 0 or score > 1 or score is null").count() == 0


def test_toxicity_counts_all_labels(spark):
    rows = [(i, f"the {'vile' if i % 2 else 'mild'}{i % 40} thing here number {i % 7}") for i in range(800)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, 0, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    whole = toxicity.train(docs, labels).counts
    few = toxicity.train(docs, labels, max_labels=60).counts  # bounds what calibrates, not what is counted
    assert whole.words.tolist() == few.words.tolist() and whole.stems.tolist() == few.stems.tolist() and len(whole.words) > 40


def plain_kneser_ney(rows, discount):
    """P(word | history) of both classes, by the formulas of the module's docstring."""
    words = lambda t: WORD.findall(lower(t))
    stem = lambda w: w.encode()[:4]
    shared = collections.Counter(w for _, t in rows for w in words(t))
    shared_stem = collections.Counter()
    for w, n in shared.items():
        shared_stem[stem(w)] += n
    pairs = [collections.Counter(), collections.Counter()]
    for label, t in rows:
        if label in (0, 1):
            w = words(t)
            pairs[label].update(zip(["<s>", *w], w, strict=False))
    kept = {p for p in pairs[0] | pairs[1] if pairs[1][p] or pairs[0][p] > 1}
    types = [collections.Counter(w for _, w in c) for c in pairs]
    stem_types = [collections.Counter() for _ in pairs]
    for c in (0, 1):
        for w, n in types[c].items():
            stem_types[c][stem(w)] += n
    known_stems, known = set(stem_types[0]) | set(stem_types[1]), set(types[0]) | set(types[1])
    total = [sum(t.values()) for t in types]
    head = [collections.Counter() for _ in pairs]
    for c in (0, 1):
        for (h, _), n in pairs[c].items():
            head[c][h] += n
    cut = lambda n: max(n - discount, 0)

    def p_stem(c, s):
        left = 1 - sum(cut(n) for n in stem_types[c].values()) / total[c]
        return cut(stem_types[c][s]) / total[c] + left * (shared_stem[s] + 1) / (sum(shared.values()) + len(shared_stem))

    def p_word(c, w):
        left = 1 - sum(cut(n) for n in types[c].values()) / total[c]
        return cut(types[c][w]) / total[c] + left * p_stem(c, stem(w)) * shared[w] / shared_stem[stem(w)]

    def ratio(h, w):
        if w not in known:
            return np.log(p_stem(1, stem(w)) / p_stem(0, stem(w))) if stem(w) in known_stems else 0.0
        p = []
        for c in (0, 1):
            mass = {x: cut(pairs[c][(h, x)]) / max(head[c][h], 1) for g, x in kept if g == h}
            back = max(1 - sum(mass.values()), 1e-3) if h == "<s>" or h in known else 1.0
            p.append(mass.get(w, 0.0) + back * p_word(c, w))
        return np.log(p[1] / p[0])

    return lambda t: [ratio(h, w) for h, w in zip(["<s>", *words(t)], words(t), strict=False)]


def test_toxicity_probabilities(spark):
    random.seed(21)
    vocabulary = [["the", "mild", "milder", "thing", "thin", "é", "ok"], ["the", "vile", "viler", "thing", "thinks", "milder"]]
    rows = [(k % 2, " ".join(random.choice(vocabulary[k % 2]) for _ in range(random.randrange(12)))) for k in range(60)]
    rows += [(2, "thinly vilest OK mild é"), (2, None), (1, ""), (None, "the the"), (0, "the mild thing the mild thing")]
    counted = toxicity.fit_counts(frame(spark, rows, "label int, text string").na.fill({"label": 2}), discounts=(0.75, 2.0), stretch=3)
    texts = ["the vile thing", "mild thin é vilest thinly", "Viler the the MILDER", "unknown zebra", "", None, "thing"]
    found = counted.evidence(pa.array(texts))
    for k, discount in enumerate((0.75, 2.0)):
        plain = plain_kneser_ney([(c, t) for c, t in rows], discount)
        for t, got in zip(texts, found, strict=True):
            want = plain(t) or [0.0]
            assert abs(got[2 * k] - np.mean(want)) < 1e-9
            sums = [sum(want[i : i + 3]) / 3 for i in range(len(want))]
            assert abs(got[2 * k + 1] - max(sums)) < 1e-9


def test_toxicity_tables_are_bounded(spark):
    rows = frame(spark, [(k % 2, f"word{k} follows word{k % 9} here") for k in range(60)], "label int, text string")
    small = toxicity.fit_counts(rows, max_words=10, max_pairs=7)
    assert len(small.words) <= 10 and len(small.pairs) == 7 and np.isfinite(small.evidence(pa.array(["word3 follows here", "x"]))).all()


def test_toxicity_columns(spark):
    docs = frame(spark, [(1, "a b", 1.0, "x"), (1, "a b", 1.0, "x"), (2, "word " * 30_000, 2.0, None)], "doc_id long, text string, score double, Evidence string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "doc_id long, toxic int")
    out = toxicity.train(docs, labels).score(docs)
    assert sorted(out.columns) == ["doc_id", "mean_ratio", "score", "stretch_ratio"] and out.count() == 3


def test_toxicity_back_off_of_all_documents(spark):
    labelled = [(0, "some words here"), (1, "some harsh words")] * 3
    alone = toxicity.fit_counts(frame(spark, labelled, "label int, text string")).choices[0]
    more = toxicity.fit_counts(frame(spark, [*labelled, (2, "hers herd herb here we some hero")], "label int, text string")).choices[0]
    assert alone.p.shape == more.p.shape and not np.allclose(alone.p, more.p)


def test_learners_without_labels(spark):
    docs = frame(spark, [(1, "a b"), (2, None), (3, "")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score(docs, quality.train(docs, none)).collect()} == {0.5}
    assert {r["score"] for r in toxicity.train(docs, none).score(docs).collect()} == {0.5}


def test_pipeline_stages(spark):
    import corpus_pipeline

    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        kept = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert set(kept) <= ids and len(kept) == len(set(kept)) and len(kept) > 0.5 * len(ids)
    shards = corpus_pipeline.run(spark, path)
    assert shards.count() > 0 and "shard" in shards.columns


def test_quality_keeps_columns_of_any_name(spark):
    docs = frame(spark, [(1, "a b", "mine", 2.0), (1, "a b", "mine", 2.0), (2, None, None, None)], "doc_id long, text string, stats string, Score double")
    out = quality.score(docs, quality.train(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")))
    assert out.columns == ["doc_id", "stats", "score"] and sorted(str(r["stats"]) for r in out.collect()) == ["None", "mine", "mine"]


def test_quality_columns_equal_the_model(spark):
    """The rules compiled into column expressions give what the model gives in numpy."""
    random.seed(31)
    docs = frame(spark, [(k, " ".join(random.choice(["Good", "text", "here.", "$$", "x1", "BUY"]) for _ in range(random.randrange(60)))) for k in range(80)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    rows = quality.with_statistics(docs).collect()
    want = dict(zip([r["doc_id"] for r in rows], model.predict(np.array([r["stats"] for r in rows])), strict=True))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_workers_of_quality_and_mixing_give_memory_back(spark, monkeypatch):
    """Idle Python workers count against the executor, so what reads whole texts releases after each batch."""
    from tidemark.llm import mixing, quality

    seen = []
    for module in (quality, mixing):
        monkeypatch.setattr(module, "releasing", lambda f: seen.append(f) or f)
    docs = spark.createDataFrame([(1, "a b c", "s"), (2, "d e", None)], "doc_id long, text string, source string")
    assert quality.with_statistics(docs).count() == 2 and mixing.mixed_documents(docs).count() >= 2
    assert len(seen) == 3


def test_durable_leaves_no_shuffle_files(spark):
    left = lambda: {b.toString() for b in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()) if "shuffle_" in b.toString()}
    before = left()
    out = common.durable(spark.range(2000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if not (new := left() - before):
            break
        time.sleep(0.1)
    assert not new and out.count() == 7 and spark.conf.get(common._CLEANUP) == "false"


def test_toxicity_driver_keeps_counts_only(spark):
    rows = frame(spark, [(k % 2, f"word{k} follows word{k % 9} here") for k in range(60)], "label int, text string")
    counted = toxicity.fit_counts(rows)
    sent = pickle.loads(pickle.dumps(counted))
    assert "choices" not in vars(counted) and "choices" not in vars(sent)  # worked out by the workers, not on the driver
    texts = pa.array(["word3 follows here", "x", None])
    assert np.array_equal(sent.evidence(texts), counted.evidence(texts))
    model = toxicity.train(frame(spark, [(k, f"{'vile' if k % 2 else 'mild'} word{k % 9} here") for k in range(200)]), spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int"))
    assert "choices" not in vars(model.counts) and len(model.counts.discounts) == 1


def test_substrings_asks_only_for_runs_that_may_share_a_window():
    random.seed(8)
    other = lambda n: "".join(random.choice("abcdefgh") for _ in range(n))

    def asked(shared):
        rows = [other(200) + shared + other(200) for _ in range(40)]
        table = pa.table({"id": pa.array(range(40), pa.int64()), "text": pa.array([r.encode() for r in rows]), "chunk": pa.array([0] * 40, pa.int64())})
        found = substrings._compare_runs(substrings._emit_runs(50, 16, 1)(table))
        return sum(len(p) // 12 for k, p in zip(found.column("kind").to_pylist(), found.column("payload").to_pylist(), strict=True) if k == 2)

    assert asked(other(22)) == 0  # the minimizer is shared, but no side of 17 bytes
    assert asked(other(70)) > 0
