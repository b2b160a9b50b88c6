"""Risk tables over line items: the label is a return, the score a number of the item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import table
from millrace.operators import risk
from millrace.plans.define import Collector

query = Collector()
QUERIES, SQL = query.queries, query.sql

SCORED_SQL = "s AS (SELECT l_extendedprice AS score, CAST(l_returnflag = 'R' AS INTEGER) AS label, strftime(l_shipdate, '%Y') AS period FROM lineitem)"
_EDGES = ", ".join(f"quantile_cont(score, {k / 10})" for k in range(1, 10))
BINNED_SQL = f"{SCORED_SQL}, e AS (SELECT list_distinct([{_EDGES}]) AS edges FROM s), b AS (SELECT s.*, len(list_filter(edges, lambda x: x < score)) + 1 AS bin FROM s, e)"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    returned = (F.col("l_returnflag") == "R").cast("int").alias("label")
    return table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("score"), returned, F.date_format("l_shipdate", "yyyy").alias("period"))


@query(f"""WITH {BINNED_SQL}, g AS (SELECT bin, min(score) AS low, max(score) AS high, count(*) AS n, CAST(sum(label) AS BIGINT) AS pos FROM b GROUP BY ALL)
SELECT bin, round(low, 4) AS low, round(high, 4) AS high, n, pos, n - pos AS neg, round(pos / n / (sum(pos) OVER () / sum(n) OVER ()), 6) AS lift, round(sum(pos) OVER w / sum(pos) OVER (), 6) AS cum_pos, round(sum(n - pos) OVER w / sum(n - pos) OVER (), 6) AS cum_neg FROM g WINDOW w AS (ORDER BY bin)""")
def quantile_bin_table(spark: SparkSession, sf: str) -> DataFrame:
    t = risk.bin_table(_scored(spark, sf), "score", "label", 10)
    r = lambda c, k=6: F.round(c, k).alias(c)
    return t.select("bin", r("low", 4), r("high", 4), "n", "pos", "neg", r("lift"), r("cum_pos"), r("cum_neg"))


@query(f"""WITH {BINNED_SQL}, g AS (SELECT bin, sum(label) AS pos, sum(1 - label) AS neg FROM b GROUP BY ALL), p AS (SELECT bin, greatest(pos / sum(pos) OVER (), 1e-6) AS p, greatest(neg / sum(neg) OVER (), 1e-6) AS q FROM g)
SELECT bin, round(ln(p / q), 6) AS woe, round((p - q) * ln(p / q), 8) AS iv FROM p""")
def woe_iv(spark: SparkSession, sf: str) -> DataFrame:
    return risk.woe_iv(_scored(spark, sf), "score", "label", 10).select("bin", F.round("woe", 6).alias("woe"), F.round("iv", 8).alias("iv"))


@query(f"""WITH {SCORED_SQL}, base AS (SELECT * FROM s WHERE period = '1997'), e AS (SELECT list_distinct([{_EDGES}]) AS edges FROM base),
x AS (SELECT bin, count(*) / sum(count(*)) OVER () AS e FROM (SELECT len(list_filter(edges, lambda x: x < score)) + 1 AS bin FROM base, e) GROUP BY ALL),
a AS (SELECT period, bin, count(*) AS n FROM (SELECT period, len(list_filter(edges, lambda x: x < score)) + 1 AS bin FROM s, e) GROUP BY ALL), y AS (SELECT period, bin, n / sum(n) OVER (PARTITION BY period) AS a FROM a)
SELECT p.period, round(sum((greatest(coalesce(a, 0), 1e-6) - greatest(e, 1e-6)) * ln(greatest(coalesce(a, 0), 1e-6) / greatest(e, 1e-6))), 8) AS psi FROM (SELECT DISTINCT period FROM y) p CROSS JOIN x LEFT JOIN y ON y.period = p.period AND y.bin = x.bin GROUP BY ALL""")
def psi_by_period(spark: SparkSession, sf: str) -> DataFrame:
    """Shift of the score's distribution against the year 1997."""
    s = _scored(spark, sf)
    return risk.psi(s.where("period = '1997'"), s, "score", 10, ["period"]).select("period", F.round("psi", 8).alias("psi"))


_KS_SQL = """g AS (SELECT {by} q AS score, sum(label) AS p, sum(1 - label) AS n FROM (SELECT {by} floor(score / 10) AS q, label FROM s) GROUP BY ALL),
c AS (SELECT {by} p, n, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER t AS tp, sum(n) OVER t AS tn FROM g WINDOW w AS ({part} ORDER BY score), t AS ({part}))
SELECT {by} round(max(abs(cp / tp - cn / tn)), 6) AS ks, round(sum(p * (cn - n + n / 2.0)) / (max(tp) * max(tn)), 6) AS auc FROM c {group}"""


@query(f"WITH {SCORED_SQL}, " + _KS_SQL.format(by="", part="", group=""))
def ks_and_auc(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored(spark, sf).withColumn("score", F.floor(F.col("score") / 10))
    return risk.ks_auc(s, "score", "label").select(F.round("ks", 6).alias("ks"), F.round("auc", 6).alias("auc"))


@query(f"WITH {SCORED_SQL}, " + _KS_SQL.format(by="period,", part="PARTITION BY period", group="GROUP BY ALL"))
def auc_ks_by_period(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored(spark, sf).withColumn("score", F.floor(F.col("score") / 10))
    return risk.ks_auc(s, "score", "label", ["period"]).select("period", F.round("ks", 6).alias("ks"), F.round("auc", 6).alias("auc"))


@query("""WITH o AS (SELECT o_orderstatus AS a, lead(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders), c AS (SELECT a, b, count(*) AS n FROM o WHERE b IS NOT NULL GROUP BY ALL)
SELECT a AS from_state, b AS to_state, n, round(n / sum(n) OVER (PARTITION BY a), 6) AS rate FROM c""")
def roll_rate_overall(spark: SparkSession, sf: str) -> DataFrame:
    states = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return risk.roll_rates(states, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus").select("from_state", "to_state", "n", F.round("rate", 6).alias("rate"))


@query("""WITH o AS (SELECT strftime(o_orderdate, '%Y') AS period, o_orderstatus AS a, lead(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders), c AS (SELECT period, a, b, count(*) AS n FROM o WHERE b IS NOT NULL GROUP BY ALL)
SELECT period, a AS from_state, b AS to_state, n, round(n / sum(n) OVER (PARTITION BY period, a), 6) AS rate FROM c""")
def roll_rate_by_year(spark: SparkSession, sf: str) -> DataFrame:
    states = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy").alias("period"))
    rates = risk.roll_rates(states, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus", ["period"])
    return rates.select("period", "from_state", "to_state", "n", F.round("rate", 6).alias("rate"))


@query("""SELECT coalesce(month, 'all') AS month, views, clicks, signups, purchases FROM (SELECT strftime(ts, '%Y-%m') AS month, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks,
count(DISTINCT user_id) FILTER (event_type = 'signup') AS signups, count(DISTINCT user_id) FILTER (event_type = 'purchase') AS purchases FROM events GROUP BY ROLLUP (strftime(ts, '%Y-%m')))""")
def funnel_by_month_total(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("month", F.date_format("ts", "yyyy-MM"))
    users = lambda t: F.count_distinct(F.when(F.col("event_type") == t, F.col("user_id")))
    by = e.rollup("month").agg(
        F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("event_type") == "click").alias("clicks"), users("signup").alias("signups"), users("purchase").alias("purchases")
    )
    return by.select(F.coalesce("month", F.lit("all")).alias("month"), "views", "clicks", "signups", "purchases")


@query("""SELECT 'metro' AS feature, count(*) AS n, round(avg(CASE WHEN metro IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_share, round(avg(CASE WHEN metro IN ('?', '-', 'n/a') THEN 1.0 ELSE 0.0 END), 6) AS special_share, count(DISTINCT metro) AS distinct_values FROM region_index
UNION ALL SELECT 'fips', count(*), round(avg(CASE WHEN fips IS NULL THEN 1.0 ELSE 0.0 END), 6), round(avg(CASE WHEN fips IN ('?', '-', 'n/a') THEN 1.0 ELSE 0.0 END), 6), count(DISTINCT fips) FROM region_index""")
def feature_missing_unique(spark: SparkSession, sf: str) -> DataFrame:
    cells = table(spark, sf, "region_index").select("metro", "fips").unpivot([], ["metro", "fips"], "feature", "v")
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return cells.groupBy("feature").agg(
        F.count("*").alias("n"), share(F.col("v").isNull()).alias("missing_share"), share(F.coalesce(F.col("v").isin("?", "-", "n/a"), F.lit(False))).alias("special_share"), F.count_distinct("v").alias("distinct_values")
    )


@query(f"""WITH {SCORED_SQL}, e AS (SELECT list_distinct([{_EDGES}]) AS edges FROM s), b AS (SELECT period, label, len(list_filter(edges, lambda x: x < score)) + 1 AS bin FROM s, e),
g AS (SELECT period, bin, sum(label) AS pos, sum(1 - label) AS neg FROM b GROUP BY ALL), p AS (SELECT period, greatest(pos / nullif(sum(pos) OVER w, 0), 1e-6) AS p, greatest(neg / nullif(sum(neg) OVER w, 0), 1e-6) AS q FROM g WINDOW w AS (PARTITION BY period)),
i AS (SELECT period, sum((p - q) * ln(p / q)) AS iv FROM p WHERE period IN ('1996', '1997', '1998') GROUP BY ALL)
SELECT 'l_extendedprice' AS feature, round(max(CASE WHEN period = '1996' THEN iv END), 8) AS iv_1996, round(max(CASE WHEN period = '1997' THEN iv END), 8) AS iv_1997, round(max(CASE WHEN period = '1998' THEN iv END), 8) AS iv_1998 FROM i""")
def iv_by_period_wide(spark: SparkSession, sf: str) -> DataFrame:
    years = ["1996", "1997", "1998"]
    iv = risk.woe_iv(_scored(spark, sf), "score", "label", 10, ["period"]).where(F.col("period").isin(years)).groupBy("period").agg(F.sum("iv").alias("iv"))
    return iv.agg(*(F.round(F.max(F.when(F.col("period") == y, F.col("iv"))), 8).alias(f"iv_{y}") for y in years)).withColumn("feature", F.lit("l_extendedprice"))


@query("""SELECT rule, CAST(sum(bad) AS BIGINT) AS violations FROM (SELECT 'price_positive' AS rule, CAST(p_retailprice <= 0 AS INTEGER) AS bad FROM part UNION ALL SELECT 'size_range', CAST(p_size NOT BETWEEN 1 AND 40 AS INTEGER) FROM part) GROUP BY ALL""")
def rule_violations(spark: SparkSession, sf: str) -> DataFrame:
    rules = {"price_positive": F.col("p_retailprice") <= 0, "size_range": ~F.col("p_size").between(1, 40)}
    counted = table(spark, sf, "part").agg(*(F.count_if(bad).alias(name) for name, bad in rules.items()))
    return counted.unpivot([], list(rules), "rule", "violations")
