"""Projections, filters, scalar rules, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text_rules as T
from . import binding as B
from .registry import query


@query("p01_p02_flatten", B.sql("SELECT tx_id, issuer, owner, round(coalesce(shares * price, 0), 4) AS value, round(CASE WHEN shares * (pct / 100) > 0 THEN 100 * shares / (shares * (pct / 100)) END, 4) AS prior_pct FROM buys"))
def p01_p02_flatten(spark, sf_dir):
    prior = F.col("shares") * (F.col("pct") / 100)
    return B.buys(spark, sf_dir).select("tx_id", "issuer", "owner", F.round(F.coalesce(F.col("shares") * F.col("price"), F.lit(0.0)), 4).alias("value"), F.round(F.when(prior > 0, 100 * F.col("shares") / prior), 4).alias("prior_pct"))


@query("p03_role_string", B.sql("SELECT DISTINCT is_director, is_officer, is_ten, coalesce(nullif(concat_ws(', ', CASE WHEN is_director THEN 'Director' END, CASE WHEN is_officer THEN 'Officer' END, CASE WHEN is_ten THEN '10% Owner' END), ''), 'Unknown') AS role FROM filings"))
def p03_role_string(spark, sf_dir):
    return B.filings(spark, sf_dir).select("is_director", "is_officer", "is_ten", T.role_string(F.col("is_director"), F.col("is_officer"), F.col("is_ten")).alias("role")).distinct()


@query("p04_p05_clean_events", B.sql("SELECT tx_id, 'S' || CAST(issuer AS VARCHAR) AS ticker, tx_date, filing_date FROM buys WHERE tx_date <= filing_date AND tx_date IS NOT NULL"))
def p04_p05_clean_events(spark, sf_dir):
    rows = B.buys(spark, sf_dir).filter("tx_date <= filing_date AND tx_date IS NOT NULL")
    return rows.select("tx_id", T.normalize_ticker(F.concat(F.lit("(nyse:s"), F.col("issuer").cast("string"), F.lit(")"))).alias("ticker"), "tx_date", "filing_date")


#: Raw forms of a ticker as filings have them; {} is the issuer's number.
_FORMS = ["(nyse:s{})", "NASDAQ: s{} ", "s{}(OB)", "?S{}?", "s{}, t{}", "BRK.B{}", "{}S", "NAN", "n/a", "--", "", "[S{}-WS]", "S{}TOOLONG", " 'S{}' / x", "(;s{}"]


@query("p06_ticker_rules", "SELECT s_suppkey AS issuer, form, CASE form " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(["'S' || n", "'S' || n", "'S' || n", "'S' || n", "'S' || n", "'BRK.B' || n", "NULL", "NULL", "NULL", "NULL", "NULL", "'S' || n || '-WS'", "NULL", "NULL", "'S' || n"])) + " END AS ticker FROM (SELECT s_suppkey, CAST(s_suppkey % 1000 AS VARCHAR) AS n FROM supplier), (SELECT unnest(generate_series(0, 14)) AS form)")
def p06_ticker_rules(spark, sf_dir):
    """All seven rules: wrappers, exchange prefix, placeholders, first token, form."""
    forms = F.posexplode(F.array(*[F.lit(f) for f in _FORMS]))
    rows = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("issuer"), (F.col("s_suppkey") % 1000).cast("string").alias("n"), forms.alias("form", "raw"))
    return rows.select("issuer", F.col("form").cast("bigint").alias("form"), T.normalize_ticker(F.replace("raw", F.lit("{}"), F.col("n"))).alias("ticker"))


@query("p07_cik", "SELECT c_custkey AS owner, lpad(regexp_replace(c_name, '[^0-9]', '', 'g'), 10, '0') AS cik FROM customer")
def p07_cik(spark, sf_dir):
    return B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), T.normalize_cik(F.col("c_name")).alias("cik"))


@query("p08_role_filters", B.sql("SELECT count(*) AS any_role, count(*) FILTER (is_officer) AS officer, count(*) FILTER (NOT (is_ten AND NOT is_officer AND NOT is_director)) AS not_ten_only FROM buys"))
def p08_role_filters(spark, sf_dir):
    return B.buys(spark, sf_dir).agg(F.count("*").alias("any_role"), F.count_if("is_officer").alias("officer"), F.count_if(~(F.col("is_ten") & ~F.col("is_officer") & ~F.col("is_director"))).alias("not_ten_only"))


@query("p11_p12_capacity", B.sql("SELECT issuer, date, open >= 1 AND dollar_volume * 0.1 >= 1e6 / 20 AS tradeable, coalesce(dollar_volume * 0.1 * 3 >= 1e6 / 5, false) AS fills_in_three FROM bars"))
def p11_p12_capacity(spark, sf_dir):
    return B.bars(spark, sf_dir).select("issuer", "date", ((F.col("open") >= 1) & (F.col("dollar_volume") * 0.1 >= 1e6 / 20)).alias("tradeable"), F.coalesce(F.col("dollar_volume") * 0.1 * 3 >= 1e6 / 5, F.lit(False)).alias("fills_in_three"))


@query("p15_routine_notes", "SELECT doc_id, regexp_matches(text, '(?i)(10b5-1|reinvest|license|reserved)') AS routine FROM documents")
def p15_routine_notes(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id", F.regexp_like("text", F.lit("(?i)(10b5-1|reinvest|license|reserved)")).alias("routine"))


_PCT = ", p AS (SELECT issuer, round(percent_rank() OVER (ORDER BY v) * 100, 6) AS pct, issuer % 4 / 4.0 AS missing FROM (SELECT issuer, sum(value) AS v FROM buys GROUP BY issuer))"


@query("p17_verdict", B.sql(_PCT + " SELECT issuer, CASE WHEN missing > 0.5 THEN 'unavailable' WHEN pct >= 90 THEN 'strong' WHEN pct >= 70 THEN 'good' WHEN pct >= 30 THEN 'neutral' ELSE 'weak' END AS verdict FROM p"))
def p17_verdict(spark, sf_dir):
    from pyspark.sql import Window

    totals = B.buys(spark, sf_dir).groupBy("issuer").agg(F.sum("value").alias("v"))
    rows = totals.select("issuer", F.round(F.percent_rank().over(Window.orderBy("v")) * 100, 6).alias("pct"), (F.col("issuer") % 4 / 4.0).alias("missing"))
    return rows.select("issuer", T.verdict(F.col("pct"), F.col("missing")).alias("verdict"))


@query("p20_items", "SELECT o_orderkey AS filing, list_sort(list_distinct(string_split(o_orderpriority || ', ' || o_orderstatus, ', '))) AS items FROM orders")
def p20_items(spark, sf_dir):
    return B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("filing"), F.array_sort(F.array_distinct(F.split(F.concat_ws(", ", "o_orderpriority", "o_orderstatus"), ", "))).alias("items"))


@query("p21_accession", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '([0-9]+)[^0-9]*$', 1) AS number FROM pages")
def p21_accession(spark, sf_dir):
    return B.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("url", "([0-9]+)[^0-9]*$", 1).alias("number"))


@query("p22_fate", "SELECT c_custkey AS owner, CASE WHEN c_acctbal < -900 THEN 'bankrupt' WHEN c_mktsegment = 'MACHINERY' THEN 'renamed_alive' WHEN c_acctbal < 0 THEN 'alive_no_ticker' WHEN c_mktsegment = 'BUILDING' THEN 'acquired' WHEN c_acctbal > 9000 THEN 'delisted' ELSE 'unknown' END AS fate FROM customer")
def p22_fate(spark, sf_dir):
    balance, segment = F.col("c_acctbal"), F.col("c_mktsegment")
    fate = T.first_case([(balance < -900, "bankrupt"), (segment == "MACHINERY", "renamed_alive"), (balance < 0, "alive_no_ticker"), (segment == "BUILDING", "acquired"), (balance > 9000, "delisted")], "unknown")
    return B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), fate.alias("fate"))


@query("p23_overlap", B.sql(", s AS (SELECT issuer, min(tx_date) AS a, max(tx_date) AS b FROM buys GROUP BY issuer) SELECT issuer, round(greatest(0.0, least(1.0, (least(b, DATE '1999-12-31') - a) / CAST(nullif(b - a, 0) AS DOUBLE))), 6) AS overlap FROM s"))
def p23_overlap(spark, sf_dir):
    spans = B.buys(spark, sf_dir).groupBy("issuer").agg(F.min("tx_date").alias("a"), F.max("tx_date").alias("b"))
    share = F.try_divide(F.datediff(F.least(F.col("b"), F.lit("1999-12-31").cast("date")), F.col("a")), F.datediff("b", "a"))
    return spans.select("issuer", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)), 6).alias("overlap"))


@query("f03_cost", B.sql("SELECT issuer, date, round(greatest(5.0, least(400.0, 4 / sqrt(open) + 20 / sqrt(dollar_volume / 1e6))) + 2 * 200 * sqrt(10000 / dollar_volume), 4) AS cost_bps FROM bars"))
def f03_cost(spark, sf_dir):
    from ..functions.finance import cost_bps

    return B.bars(spark, sf_dir).select("issuer", "date", F.round(cost_bps(F.col("open"), F.col("dollar_volume"), F.lit(10_000.0)), 4).alias("cost_bps"))


@query("f02_log_excess", B.sql(", r AS (SELECT issuer, date, lead(close, 21) OVER (PARTITION BY issuer ORDER BY date) / close - 1 AS f, lead(close, 5) OVER (PARTITION BY issuer ORDER BY date) / close - 1 AS s FROM bars) SELECT issuer, date, round(ln(1 + greatest(f, -0.999)) - ln(1 + greatest(s, -0.999)), 6) AS excess FROM r WHERE f IS NOT NULL AND s IS NOT NULL"))
def f02_log_excess(spark, sf_dir):
    from pyspark.sql import Window

    from ..functions.finance import log_excess

    w = Window.partitionBy("issuer").orderBy("date")
    ahead = lambda n: F.lead("close", n).over(w) / F.col("close") - 1
    return B.bars(spark, sf_dir).select("issuer", "date", ahead(21).alias("f"), ahead(5).alias("s")).select("issuer", "date", F.round(log_excess(F.col("f"), F.col("s")), 6).alias("excess")).filter("excess IS NOT NULL")


_ENDINGS = ["Corp /DE/", "HOLDINGS INC", "Group, L.P. - Old", "The Company Limited \\DE\\", "& Co. /NEW/", "plc /A/ x"]


@query("e06_issuer_names", "SELECT s_suppkey AS issuer, k, CASE k WHEN 2 THEN name || ' L P' WHEN 5 THEN name || ' A X' ELSE name END AS name FROM (SELECT s_suppkey, trim(regexp_replace(upper(s_name), '[^A-Z0-9]+', ' ', 'g')) AS name FROM supplier), (SELECT unnest(generate_series(0, 5)) AS k)")
def e06_issuer_names(spark, sf_dir):
    """Also F7: state tags and OLD only at the end, all corporate words."""
    rows = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("issuer"), "s_name", F.posexplode(F.array(*[F.lit(e) for e in _ENDINGS])).alias("k", "ending"))
    return rows.select("issuer", F.col("k").cast("bigint").alias("k"), T.normalize_name(F.concat_ws(" ", "s_name", "ending")).alias("name"))


@query("e08_spans", B.sql("SELECT issuer, arg_min(owner_name, tx_id) AS name, min(filing_date) AS first_date, max(filing_date) AS last_date, count(*) AS n FROM filings GROUP BY issuer"))
def e08_spans(spark, sf_dir):
    """Spans of an issuer with the name of its first row."""
    return B.filings(spark, sf_dir).groupBy("issuer").agg(F.min_by("owner_name", "tx_id").alias("name"), F.min("filing_date").alias("first_date"), F.max("filing_date").alias("last_date"), F.count("*").alias("n"))


@query("s05_dashboard_order", B.sql(_PCT + ", v AS (SELECT issuer, pct, CASE WHEN pct >= 90 THEN 0 WHEN pct >= 70 THEN 1 ELSE 2 END AS rank FROM p) SELECT issuer, row_number() OVER (ORDER BY rank, pct DESC, issuer) AS place FROM v"))
def s05_dashboard_order(spark, sf_dir):
    """A stable order by several keys, here over one row an issuer. Issuers of the same total tie, whatever the order of their rows."""
    from pyspark.sql import Window

    from ..operators.stats import exact_sum

    totals = B.buys(spark, sf_dir).groupBy("issuer").agg(exact_sum("value").alias("v"))
    rows = totals.select("issuer", F.round(F.percent_rank().over(Window.orderBy("v")) * 100, 6).alias("pct")).withColumn("rank", F.when(F.col("pct") >= 90, 0).when(F.col("pct") >= 70, 1).otherwise(2))
    return rows.select("issuer", F.row_number().over(Window.orderBy("rank", F.desc("pct"), "issuer")).cast("bigint").alias("place"))


@query("s03_top_fraction", B.sql(", r AS (SELECT tx_id, value, row_number() OVER (ORDER BY value DESC, tx_id) AS k, count(*) OVER () AS n FROM buys) SELECT tx_id, round(value, 4) AS value FROM r WHERE k <= greatest(30, CAST(floor(n * 0.01) AS BIGINT))"))
def s03_top_fraction(spark, sf_dir):
    """The best hundredth, 30 rows at least: a distributed top-k, no global window."""
    rows = B.buys(spark, sf_dir)
    return rows.orderBy(F.desc("value"), "tx_id").limit(max(30, rows.count() // 100)).select("tx_id", F.round("value", 4).alias("value"))


@query("u01_union", B.sql("SELECT code, count(*) AS n FROM (SELECT code, tx_id FROM buys UNION ALL BY NAME SELECT tx_id, code FROM sales) GROUP BY code"))
def u01_union(spark, sf_dir):
    return B.buys(spark, sf_dir).select("code", "tx_id").unionByName(B.of_code(spark, sf_dir, B.SALE).select("tx_id", "code")).groupBy("code").agg(F.count("*").alias("n"))


@query("u02_dedup_first", B.sql("SELECT owner, issuer, tx_id FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY tx_id, issuer) AS k FROM filings) WHERE k = 1"))
def u02_dedup_first(spark, sf_dir):
    """One row a key, the first by id, as an aggregate rather than a window."""
    return B.filings(spark, sf_dir).groupBy("owner").agg(F.min(F.struct("tx_id", "issuer")).alias("first")).select("owner", "first.issuer", "first.tx_id")


@query("u05_buyers_and_sellers", B.sql("SELECT issuer, owner FROM buys INTERSECT SELECT issuer, owner FROM sales"))
def u05_buyers_and_sellers(spark, sf_dir):
    return B.buys(spark, sf_dir).select("issuer", "owner").intersect(B.of_code(spark, sf_dir, B.SALE).select("issuer", "owner"))


@query("u06_jaccard", B.sql(", a AS (SELECT issuer FROM (SELECT issuer, sum(value) AS v FROM buys GROUP BY ALL) ORDER BY v DESC, issuer LIMIT 30), b AS (SELECT issuer FROM (SELECT issuer, sum(value) AS v FROM sales GROUP BY ALL) ORDER BY v DESC, issuer LIMIT 30) SELECT (SELECT count(*) FROM a JOIN b USING (issuer)) AS common, round((SELECT count(*) FROM a JOIN b USING (issuer)) / CAST((SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS DOUBLE), 6) AS jaccard"))
def u06_jaccard(spark, sf_dir):
    top = lambda c, n: B.of_code(spark, sf_dir, c).groupBy("issuer").agg(F.sum("value").alias("v")).orderBy(F.desc("v"), "issuer").limit(30).select("issuer", F.lit(True).alias(n))
    both = top(B.BUY, "a").join(top(B.SALE, "b"), "issuer", "full")
    return both.agg(F.count_if(F.col("a") & F.col("b")).alias("common"), F.round(F.count_if(F.col("a") & F.col("b")) / F.count("*"), 6).alias("jaccard"))


@query("u08_grid", "SELECT k, d, p, v FROM (SELECT unnest([2, 3, 4, 5]) AS k), (SELECT unnest([7, 14, 21]) AS d), (SELECT unnest([0, 1, 5]) AS p), (SELECT unnest(['any', 'officer']) AS v)")
def u08_grid(spark, sf_dir):
    """B17's kind of grid: a product of short literal lists."""
    grid = spark.range(1)
    for name, values in (("k", [2, 3, 4, 5]), ("d", [7, 14, 21]), ("p", [0, 1, 5]), ("v", ["any", "officer"])):
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid.drop("id")


@query("src21_payload", "SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, strlen(html) AS n_bytes FROM pages")
def src21_payload(spark, sf_dir):
    return B.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.octet_length("html").cast("bigint").alias("n_bytes"))


@query("src22_quarters", "SELECT CAST(year(d) AS INTEGER) AS y, CAST(quarter(d) AS INTEGER) AS q FROM (SELECT unnest(generate_series(DATE '2016-04-01', DATE '2024-10-01', INTERVAL 3 MONTH)) AS d)")
def src22_quarters(spark, sf_dir):
    days = spark.range(1).select(F.explode(F.expr("sequence(date'2016-04-01', date'2024-10-01', interval 3 months)")).alias("d"))
    return days.select(F.year("d").alias("y"), F.quarter("d").alias("q"))


@query("src20_first_trade", B.sql("SELECT issuer, min(date) AS first_trade, (DATE '1995-09-01' - min(date)) < 180 AS is_recent FROM bars GROUP BY issuer"))
def src20_first_trade(spark, sf_dir):
    return B.bars(spark, sf_dir).groupBy("issuer").agg(F.min("date").alias("first_trade")).withColumn("is_recent", F.datediff(F.lit("1995-09-01").cast("date"), F.col("first_trade")) < 180)


@query("f13_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def f13_json(spark, sf_dir):
    return B.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
