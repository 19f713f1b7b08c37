"""Hand cases, point-in-time invariance and plain-loop comparisons."""

import datetime as dt
import math
import random
import statistics

from pyspark.sql import functions as F

import __spark_entry__
from tidemark.functions import text_rules as T
from tidemark.operators import clusters, exits, portfolio, stats
from tidemark.operators.asof import asof_backward
from tidemark.operators.rangejoin import range_join
from tidemark.plans import binding, registry

DAY = dt.date(2020, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_tickers(spark):
    cases = {'"OMEX"': "OMEX", "([TARA])": "TARA", "(NUGN": "NUGN", "NYSE:FBC": "FBC", "BRK.B": "BRK.B", "n/a": None, "": None, None: None}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "raw string, want string")
    assert rows.filter(~T.normalize_ticker(F.col("raw")).eqNullSafe(F.col("want"))).count() == 0


def test_names(spark):
    cases = [("APACHE CORP", "APACHE"), ("Primo Water Corp /CN/", "PRIMO WATER"), ("INC CORP", "")]
    rows = spark.createDataFrame(cases, "raw string, want string")
    assert rows.filter(T.normalize_name(F.col("raw")) != F.col("want")).count() == 0


def test_asof_ignores_the_future(spark):
    """Adding facts of the same day (strict) or later changes nothing."""
    random.seed(1)
    probes = [(i, i % 3, day(random.randrange(60))) for i in range(40)]
    facts = [(random.randrange(3), day(random.randrange(60)), float(k)) for k in range(50)]
    p = spark.createDataFrame(probes, "id int, k int, d date")
    as_of = lambda rows: {r["id"]: (r["fd"], r["v"]) for r in asof_backward(p, spark.createDataFrame(rows, "k int, f date, v double"), by=["k"], probe_on="d", fact_on="f", values=["v"], strict=True).select("id", F.col("asof_date").alias("fd"), "v").collect()}
    got = as_of(facts)
    for i, k, d in probes:
        past = [(f, v) for kk, f, v in facts if kk == k and f < d]
        assert got[i] == (max(past) if past else (None, None))
    assert as_of([*facts, *[(k, day(200), -1.0) for k in range(3)]]) == got


def test_range_join_equals_nested_loop(spark):
    random.seed(2)
    left = [(i, i % 2, day(random.randrange(90))) for i in range(60)]
    right = [(random.randrange(2), day(random.randrange(90)), k) for k in range(80)]
    got = range_join(spark.createDataFrame(left, "id int, k int, d date"), spark.createDataFrame(right, "k int, f date, x int"), by=["k"], probe_on="d", fact_on="f", before=7, after=3)
    want = {(i, x) for i, k, d in left for kk, f, x in right if k == kk and -7 <= (f - d).days <= 3}
    assert {(r["id"], r["x"]) for r in got.collect()} == want


def greedy(rows, k, w):
    rows, out, i = sorted(rows), [], 0
    while i < len(rows):
        j = i
        while j + 1 < len(rows) and (rows[j + 1][0] - rows[i][0]).days <= w:
            j += 1
        if len({o for _, o in rows[i : j + 1]}) >= k:
            out.append((rows[i][0], rows[j][0]))
            i = j + 1
        else:
            i += 1
    return out


def test_clusters_equal_the_scan(spark):
    random.seed(3)
    rows = [(random.randrange(5), random.randrange(6), day(random.randrange(300))) for _ in range(200)]
    got = clusters.detect_clusters(spark.createDataFrame(rows, "issuer int, owner int, tx_date date"), buyers=3)
    want = {(i, a, b) for i in range(5) for a, b in greedy([(d, o) for k, o, d in rows if k == i], 3, 14)}
    assert {tuple(r) for r in got.collect()} == want


def test_stream_clusters_equal_the_scan(spark, small):
    """All clusters that close before the watermark, which stands a day before the last event."""
    events = binding.table(spark, small, "events").select("user_id", F.to_date("ts").alias("d"), F.hash("event_type").cast("long").alias("o")).collect()
    last = max(r["d"] for r in events) - dt.timedelta(days=1)
    want = set()
    for user in {r["user_id"] for r in events}:
        want |= {(user, a, b) for a, b in greedy([(r["d"], r["o"]) for r in events if r["user_id"] == user], 2, 2)}
    got = {tuple(r) for r in registry.queries()["x04_greedy_clusters"](spark, small).collect()}
    assert got <= want
    assert {c for c in want if (last - c[1]).days > 3} <= got


def path(spark, bars, entry=100.0):
    return spark.createDataFrame([(1, entry, k, *map(float, b)) for k, b in enumerate(bars)], "trade_id int, entry_open double, day int, open double, low double, close double")


def test_gap_fills_at_open(spark):
    r = exits.simulate_exits(path(spark, [(100, 100, 100), (70, 65, 70)]), hard=0.2).first()
    assert (r["reason"], round(r["ret"], 9)) == ("stop", -0.3)


def test_stop_at_level(spark):
    r = exits.simulate_exits(path(spark, [(100, 100, 100), (99, 98, 99), (95, 79, 90)]), hard=0.2).first()
    assert (r["exit_day"], round(r["ret"], 9)) == (2, -0.2)


def test_trail_uses_past_closes(spark):
    timed = exits.simulate_exits(path(spark, [(100, 100, 150), (190, 175, 200), (190, 175, 190)]), trail=0.2).first()
    assert timed["reason"] == "time"
    level = exits.simulate_exits(path(spark, [(100, 100, 200), (165, 150, 160)]), trail=0.2).first()
    assert (level["reason"], round(level["ret"], 9)) == ("trail", 0.6)


def test_slots_equal_a_loop(spark):
    random.seed(4)
    rows = [("s", k, random.randrange(30), 0, float(random.randrange(5))) for k in range(80)]
    rows = [(s, k, e, e + random.randrange(1, 9), v) for s, k, e, _, v in rows]
    got = {r["trade_id"] for r in portfolio.accept_by_slots(spark.createDataFrame(rows, "strategy string, trade_id long, entry_idx long, exit_idx long, score double"), 3).collect()}
    open_, want = [], set()
    for _, k, e, x, _ in sorted(rows, key=lambda r: (r[2], -r[4], r[1])):
        open_ = [o for o in open_ if o > e]
        if len(open_) < 3:
            open_.append(x)
            want.add(k)
    assert got == want


def test_lots_conserve_shares(spark):
    rows = [("a", "x", 1, 1, 10.0, 1.0), ("a", "x", 2, 1, 5.0, 2.0), ("a", "x", 3, 1, -12.0, 3.0), ("a", "x", 4, 1, -9.0, 4.0), ("b", "y", 1, 1, 4.0, 5.0)]
    got = sorted(tuple(r) for r in portfolio.fifo_lots(spark.createDataFrame(rows, "strategy string, ticker string, idx long, seq long, shares double, price double")).collect())
    assert got == [("a", "x", 1, 3, 10.0, 20.0), ("a", "x", 2, 3, 2.0, 2.0), ("a", "x", 2, 4, 3.0, 6.0), ("b", "y", 1, 1, 4.0, 0.0)]


def test_ticker_rules(spark):
    """The seven rules, in the order in which they are applied."""
    cases = {
        "NWIN(OB)": "NWIN", "?ABC?": "ABC", "GOOGLES": "GOOGLES", "GOOGLESS": None, "BRK.B123": "BRK.B123", "BRK.B1234": None, "NAN": None, "1ABC": None, "nyse: krc": "KRC", " aapl ": "AAPL", "A, B": "A",
        "/ABC": "ABC", "--": None, "-": None, "(N/A)": None, "NONE": None, "A B": "A", "[ABC]": "ABC", "ABC;DEF": "ABC", "BF-B": "BF-B", "AB.": None, "NYSE:": None, "()": None,
    }
    rows = spark.createDataFrame(list(cases.items()), "raw string, want string").withColumn("got", T.normalize_ticker(F.col("raw")))
    assert [tuple(r) for r in rows.filter(~F.col("got").eqNullSafe(F.col("want"))).collect()] == []


def test_issuer_names(spark):
    cases = [("Acme Holdings Corp", "ACME"), ("The Foo Group, L.L.C.", "FOO L L C"), ("Bar Incorporated - Old", "BAR"), ("Baz \\NY\\", "BAZ"), ("A /DE/ B", "A DE B"), (None, ""), ("Primo Water Corp /CN/", "PRIMO WATER")]
    rows = spark.createDataFrame(cases, "raw string, want string").withColumn("got", T.normalize_name(F.col("raw")))
    assert [tuple(r) for r in rows.filter(F.col("got") != F.col("want")).collect()] == []


def test_clusters_count_rows_without_owner_as_nobody(spark):
    """They begin and extend windows, and move the restart, but aren't buyers."""
    rows = [("x", None, 0), ("x", 1, 5), ("x", 2, 10), ("x", None, 14), ("x", 1, 16), ("x", 3, 25), ("y", None, 0), ("y", 1, 1), ("z", 1, 0), ("z", 1, 3), ("z", 2, 17)]
    frame = spark.createDataFrame([(i, o, day(d)) for i, o, d in rows] + [("x", 9, None)], "issuer string, owner long, tx_date date")
    found = sorted((r["issuer"], r["first_date"], r["last_date"]) for r in clusters.detect_clusters(frame).collect())
    assert found == [("x", day(0), day(14)), ("x", day(16), day(25)), ("z", day(3), day(17))]


def test_clusters_against_the_plain_loop(spark):
    random.seed(11)
    rows = [(random.randrange(4), random.choice([None, 1, 2, 3, 4]), random.randrange(400)) for _ in range(260)]
    want = []
    for issuer in range(4):
        txs = sorted(((d, o) for i, o, d in rows if i == issuer), key=lambda x: x[0])
        i = 0
        while i < len(txs):
            j = i
            while j + 1 < len(txs) and txs[j + 1][0] - txs[i][0] <= 14:
                j += 1
            if len({o for _, o in txs[i : j + 1] if o}) >= 3:
                want.append((issuer, day(txs[i][0]), day(txs[j][0])))
                i = j + 1
            else:
                i += 1
    frame = spark.createDataFrame([(i, o, day(d)) for i, o, d in rows], "issuer long, owner long, tx_date date")
    assert sorted(map(tuple, clusters.detect_clusters(frame, buyers=3).collect())) == sorted(want)


def test_flags_by_hand(spark):
    row = dict(issuer=1, owner_name="n", value=120_000.0, shares=10.0, price=12.0, pct=None, is_director=False, is_officer=False, is_ten=False, is_plan=False, note=None, first_trade=None, tx_date=day(0), filing_date=day(1))
    rows = [
        row | dict(owner=1, is_director=True, note="under the ESPP"), row | dict(owner=2, is_director=True, shares=1.5, filing_date=day(2)), row | dict(owner=2, shares=2.25, filing_date=day(30), value=0.0),
        row | dict(issuer=2, owner=1, value=4000.0, price=100.0, is_ten=True, is_plan=True, first_trade=day(-179)), row | dict(issuer=2, owner=2, value=3000.0, price=100.3, is_officer=True, is_director=True, tx_date=day(5), pct=150.0, filing_date=day(20)),
        row | dict(issuer=2, owner=None, owner_name="m", value=None, price=100.1, tx_date=day(9), filing_date=day(30)),
    ]
    schema = "issuer long, owner long, owner_name string, value double, shares double, price double, pct double, is_director boolean, is_officer boolean, is_ten boolean, is_plan boolean, note string, first_trade date, tx_date date, filing_date date"
    found = {r["issuer"]: r for r in clusters.component_flags(spark.createDataFrame(rows, schema), ["issuer"]).collect()}
    fired = {k: sorted(c[2:] for c in r.asDict() if c.startswith("f_") and r[c]) for k, r in found.items()}
    assert fired[1] == sorted(["median_value_high", "identical_prices", "fractional_shares", "directors_only", "routine_footnote", "director_heavy", "filed_promptly"])
    assert fired[2] == sorted(["median_value_low", "tight_price_band", "multi_date_spread", "ten_percent_owner", "plan_10b5_1", "big_stake_add", "huge_stake_add", "filed_late", "three_plus_insiders", "officer_and_director", "ten_pct_owner_multi"])
    assert clusters.merged_weights({"weights": {"filed_late": "3", "nope": 1, "big_stake_add": "x"}}) == clusters.WEIGHTS | {"filed_late": 3}


def test_range_join_keeps_probes_without_facts(spark):
    probes = spark.createDataFrame([(1, day(0), 5), (1, day(0), 5), (1, day(9), 6), (None, day(0), 7)], "k long, d date, v long")
    facts = spark.createDataFrame([(1, day(1), 1.0), (1, day(2), 2.0)], "k long, f date, w double")
    found = range_join(probes, facts, by=["k"], probe_on="d", fact_on="f", before=0, after=3, how="left")
    assert sorted(((r["k"], r["d"], r["v"], r["w"]) for r in found.collect()), key=repr) == sorted([(1, day(0), 5, 1.0), (1, day(0), 5, 1.0), (1, day(0), 5, 2.0), (1, day(0), 5, 2.0), (1, day(9), 6, None), (None, day(0), 7, None)], key=repr)


def test_every_bar_equals_the_paths_without_making_them(spark):
    """No bar is repeated for the days that it is held."""
    random.seed(21)
    rows = [(i, day(k * (i + 1)), *(float(random.randrange(20, 100)) for _ in range(3)), float(k)) for i in range(3) for k in range(40)]
    rows += [(9, day(3), 50.0, 40.0, 45.0, 1.0)]
    bars = spark.createDataFrame([(i, d, max(o, low), min(o, low), c, v) for i, d, o, low, c, v in rows], "issuer long, date date, open double, low double, close double, dollar_volume double")
    numbered = exits.numbered_bars(bars)
    trades = numbered.select((F.col("issuer") * 100 + F.col("pos")).alias("trade_id"), "issuer", F.col("pos").alias("entry_pos"), F.col("open").alias("entry_open"))
    for rules in (dict(hard=0.5, trail=0.6), dict(hard=0.3), dict(trail=0.4), {}):
        want = {tuple(r) for r in exits.simulate_exits(exits.paths(trades, numbered, 7), **rules).collect()}
        found = exits.every_bar(bars, 7, **rules)
        assert {tuple(r) for r in found.select(F.col("issuer") * 100 + F.col("entry_pos"), "exit_day", "exit_price", "reason", "ret").collect()} == want
    assert registry.queries()["b07_exit_rules"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 0


def test_slots_hold_few_rows_of_a_day(spark):
    """trades that can't be taken don't reach the loop; those that end where they begin take no slot."""
    random.seed(5)
    rows = [("s", k, random.randrange(6), 0, random.choice([1.0, 2.0, float("nan"), None])) for k in range(400)]
    rows = [(s, k, e, e + random.choice([0, 0, 1, 2, 3]), v) for s, k, e, _, v in rows]
    frame = spark.createDataFrame(rows, "strategy string, trade_id long, entry_idx long, exit_idx long, score double")
    taken = portfolio.accept_by_slots(frame, 3)
    assert "row_number" in taken._jdf.queryExecution().optimizedPlan().toString()
    open_, want = [], set()
    for _, k, e, x, _ in sorted(rows, key=lambda r: (r[2], -r[4] if r[4] is not None and r[4] == r[4] else 9, r[1])):
        open_ = [o for o in open_ if o > e]
        if len(open_) < 3:
            open_.append(x)
            want.add(k)
    assert {r["trade_id"] for r in taken.collect()} == want


def test_medians_of_large_groups(spark):
    random.seed(6)
    values = {"a": [random.random() for _ in range(5001)], "b": [float(random.randrange(3)) for _ in range(4000)], "c": [2.0, 1.0], "d": [7.0]}
    frame = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("a", None), ("e", None)], "k string, v double")
    want = {k: statistics.median(v) for k, v in values.items()}
    assert {r["k"]: r["median"] for r in stats.medians(frame, "v", ["k"]).collect()} == want
    assert stats.medians(frame, "v", []).first()["median"] == statistics.median([v for vs in values.values() for v in vs])
    for name in ("a19_exit_reasons", "a29_pool_reference", "a30_capacity_and_cost"):
        assert "median(" not in registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()


def shuffled_purchases(spark, monkeypatch):
    """Sixty issuers of the same purchases on one day, each in another order, so that plain sums differ in their last bits."""
    amounts = [round(random.Random(k).uniform(0, 1e6), 2) for k in range(40)]
    rows = [(i, DAY, v) for i in range(60) for v in random.Random(i).sample(amounts, 40)]
    frame = spark.createDataFrame(rows, "issuer long, tx_date date, value double").coalesce(1)
    monkeypatch.setattr(binding, "buys", lambda spark, sf_dir: frame)
    monkeypatch.setattr(binding, "calendar", lambda spark, sf_dir: spark.createDataFrame([(DAY, 0)], "date date, idx long"))


def test_samples_hold_an_issuer_once(spark, monkeypatch):
    """equal totals are equal whatever the order of their sums; a forced issuer isn't there twice."""
    shuffled_purchases(spark, monkeypatch)
    assert sorted(r["issuer"] for r in registry.queries()["s08_w11_sampled"](spark, "").collect()) == [0, 1, 2, 10, 20, 30, 40, 50]


def test_equal_scores_share_a_bucket(spark, monkeypatch):
    """F18."""
    shuffled_purchases(spark, monkeypatch)
    assert {r["bucket"] for r in registry.queries()["w09_qcut"](spark, "").collect()} == {0}


def test_sums_of_the_same_amounts_tie_in_any_order(spark):
    """s05_dashboard_order put like issuers in the order of the last bits of their sums, which vary from run to run."""
    amounts = [0.1, 0.2, 0.3, 104_999.91, 7.7, 1e-9]
    rows = spark.createDataFrame([(k, v) for k in range(6) for v in amounts[k:] + amounts[:k]] + [(7, float("nan")), (8, None), (9, 1e300), (9, -2.5)], "k int, v double").coalesce(1)
    found = dict(rows.groupBy("k").agg(stats.exact_sum("v")).collect())
    assert len({found[k] for k in range(6)}) == 1 and math.isclose(found[0], sum(amounts), rel_tol=1e-15)
    assert math.isnan(found[7]) and found[8] is None and found[9] == 1e300


def test_dashboard_places_like_issuers_by_issuer(spark, tmp_path):
    """each issuer has the same amounts in another order."""
    amounts = [84582.21, 76013.28, 42578.64, 26558.65, 51567.32, 41028.97]
    lines = [(10 * k + j, j, k, 1.0, v, 0.0, "A", "O", DAY) for k in range(6) for j, v in enumerate(amounts[k:] + amounts[:k])]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(x[0], 1, "5-LOW") for x in lines], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "BUILDING", "c")], "c_custkey long, c_mktsegment string, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    found = registry.queries()["s05_dashboard_order"](spark, str(tmp_path)).collect()
    assert sorted((r["issuer"], r["place"]) for r in found) == [(k, k + 1) for k in range(6)]
