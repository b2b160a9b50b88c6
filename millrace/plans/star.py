"""Aggregates, joins, set operations and orderings over the star of orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.catalog import table
from millrace.operators import joins
from millrace.operators.ordered import quantiles
from millrace.plans.define import Collector

query = Collector()
QUERIES, SQL = query.queries, query.sql

def _revenue() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def _sales(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with the customer's nation and region; the small dimensions are left to broadcast by size."""
    return (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )


SALES = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query(f"""WITH s AS (SELECT CASE WHEN grouping(r_name) = 1 THEN 'all' ELSE r_name END AS region, grouping(r_name) AS g, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM {SALES} GROUP BY ROLLUP (r_name))
SELECT region, round(revenue, 2) AS revenue, round(revenue / max(CASE WHEN g = 1 THEN revenue END) OVER (), 6) AS share FROM s""")
def revenue_by_region_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Revenue and share by region of the customer, with a grand total."""
    by = _sales(spark, sf).rollup("r_name").agg(F.sum(_revenue()).alias("revenue"), F.grouping("r_name").alias("g"))
    total = F.max(F.when(F.col("g") == 1, F.col("revenue"))).over(W.partitionBy())  # a row a region
    return by.select(
        F.when(F.col("g") == 1, F.lit("all")).otherwise(F.col("r_name")).alias("region"), F.round("revenue", 2).alias("revenue"), F.round(F.col("revenue") / total, 6).alias("share")
    )


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    shipped = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return shipped.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.sum(_revenue()), 2).alias("sum_disc"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


@query("""SELECT c_mktsegment AS segment, c_nationkey AS nation, round(avg(c_acctbal), 6) AS mean_bal, round(median(c_acctbal), 6) AS median_bal, round(stddev_samp(c_acctbal), 6) AS sd_bal, count(*) AS n FROM customer GROUP BY ALL""")
def group_mean_median_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).agg(
        F.round(F.avg("c_acctbal"), 6).alias("mean_bal"), F.round(F.median("c_acctbal"), 6).alias("median_bal"), F.round(F.stddev_samp("c_acctbal"), 6).alias("sd_bal"), F.count("*").alias("n")
    )


@query("""SELECT o_orderpriority AS priority, round(quantile_cont(o_totalprice, 0.25), 6) AS q25, round(quantile_cont(o_totalprice, 0.5), 6) AS q50, round(quantile_cont(o_totalprice, 0.75), 6) AS q75,
round((avg(o_totalprice * o_totalprice * o_totalprice) - 3 * avg(o_totalprice) * avg(o_totalprice * o_totalprice) + 2 * pow(avg(o_totalprice), 3)) / pow(stddev_pop(o_totalprice), 3), 4) AS skew FROM orders GROUP BY ALL""")
def quartiles_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("priority"), "o_totalprice")
    q = quantiles(o, "o_totalprice", [0.25, 0.5, 0.75], ["priority"])
    joined = q.join(o.groupBy("priority").agg(F.round(F.skewness("o_totalprice"), 4).alias("skew")), "priority")
    return joined.select("priority", *(F.round(F.col("quantiles")[k], 6).alias(n) for k, n in enumerate(("q25", "q50", "q75"))), "skew")


@query("""SELECT l_returnflag, round(sum(l_discount * l_extendedprice) / sum(l_extendedprice), 8) AS weighted_discount FROM lineitem GROUP BY ALL""")
def weighted_avg_discount(spark: SparkSession, sf: str) -> DataFrame:
    ratio = F.sum(F.col("l_discount") * F.col("l_extendedprice")) / F.sum("l_extendedprice")
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(ratio, 8).alias("weighted_discount"))


@query("""WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) AS k FROM c)
SELECT p_brand AS brand, p_size AS mode_size, n AS frequency FROM r WHERE k = 1""")
def mode_of_size_by_brand(spark: SparkSession, sf: str) -> DataFrame:
    counted = table(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", (-F.col("p_size")).alias("s")))
    return counted.groupBy(F.col("p_brand").alias("brand")).agg(best.alias("b")).select("brand", (-F.col("b.s")).alias("mode_size"), F.col("b.n").alias("frequency"))


@query("""SELECT l_returnflag, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM lineitem GROUP BY ALL""")
def share_of_total_by_flag(spark: SparkSession, sf: str) -> DataFrame:
    by = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))
    return by.select("l_returnflag", "n", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 8).alias("share"))


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS month, count(DISTINCT o_custkey) AS customers, count(*) AS orders FROM orders GROUP BY ALL""")
def distinct_customers_by_month(spark: SparkSession, sf: str) -> DataFrame:
    month = F.date_format("o_orderdate", "yyyy-MM").alias("month")
    return table(spark, sf, "orders").groupBy(month).agg(F.count_distinct("o_custkey").alias("customers"), F.count("*").alias("orders"))


@query("""SELECT o_orderpriority AS priority, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS dearest FROM orders GROUP BY ALL""")
def min_by_max_by_price(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.struct("o_totalprice", "o_orderkey")
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.min_by("o_orderkey", rank).alias("cheapest"), F.max_by("o_orderkey", rank).alias("dearest"))


@query("""SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())""")
def grouping_sets_flag_status(spark: SparkSession, sf: str) -> DataFrame:
    sets = table(spark, sf, "lineitem").groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return sets.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n")


@query("""SELECT coalesce(o_orderstatus, '*') AS status, coalesce(o_orderpriority, '*') AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def cube_segment_status(spark: SparkSession, sf: str) -> DataFrame:
    cubed = table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return cubed.select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), "n", "total")


@query("""WITH m AS (SELECT strftime(o_orderdate, '%Y') AS y, sum(o_totalprice) AS v FROM orders GROUP BY ALL)
SELECT min(y) AS first_year, max(y) AS last_year, round(pow(arg_max(v, y) / arg_min(v, y), 1.0 / nullif(CAST(max(y) AS INTEGER) - CAST(min(y) AS INTEGER), 0)) - 1, 6) AS cagr, round(stddev_samp(v) / avg(v), 6) AS volatility FROM m""")
def order_value_cagr(spark: SparkSession, sf: str) -> DataFrame:
    """Compound yearly growth of order value, and its volatility."""
    yearly = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy").alias("y")).agg(F.sum("o_totalprice").alias("v"))
    years = F.nullif(F.max(F.col("y").cast("int")) - F.min(F.col("y").cast("int")), F.lit(0))
    return yearly.agg(
        F.min("y").alias("first_year"), F.max("y").alias("last_year"),
        F.round(F.pow(F.max_by("v", "y") / F.min_by("v", "y"), 1.0 / years) - 1, 6).alias("cagr"), F.round(F.stddev_samp("v") / F.avg("v"), 6).alias("volatility"),
    )


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT user_id, sum(n) AS t, max(n) AS m FROM c GROUP BY ALL)
SELECT user_id, round(-sum((n / t.t) * ln(n / t.t)) + 0.0, 6) AS diversity, round(max(t.m) / max(t.t), 6) AS peak_share FROM c JOIN t USING (user_id) GROUP BY ALL""")
def behaviour_diversity(spark: SparkSession, sf: str) -> DataFrame:
    """Entropy of a user's event types and the share of the most frequent one."""
    counted = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    n = F.col("n").cast("double")
    by = counted.groupBy("user_id").agg(F.sum(n).alias("t"), F.sum(n * F.log(n)).alias("nlogn"), F.max(n).alias("m"))
    return by.select("user_id", F.round(F.log("t") - F.col("nlogn") / F.col("t") + 0.0, 6).alias("diversity"), F.round(F.col("m") / F.col("t"), 6).alias("peak_share"))


@query("""SELECT approx_ok, n_types, listed FROM (SELECT count(DISTINCT event_type) AS n_types, true AS approx_ok, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS listed FROM events)""")
def sketch_and_list_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    """Approximate distinct counts lie within their bound; a list aggregate in order."""
    e = table(spark, sf, "events")
    exact, approx = F.count_distinct("user_id"), F.approx_count_distinct("user_id", 0.02)
    return e.agg((F.abs(approx - exact) <= 0.1 * exact).alias("approx_ok"), F.count_distinct("event_type").alias("n_types"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("listed"))


# joins


@query(f"""SELECT n_name, strftime(o_orderdate, '%Y') AS y, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {SALES} WHERE r_name = 'ASIA' GROUP BY ALL""")
def star_join_revenue(spark: SparkSession, sf: str) -> DataFrame:
    asia = _sales(spark, sf).where(F.col("r_name") == "ASIA")
    return asia.groupBy("n_name", F.date_format("o_orderdate", "yyyy").alias("y")).agg(F.round(F.sum(_revenue()), 2).alias("revenue"))


@query("""SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey WHERE a.n_nationkey <> b.n_nationkey GROUP BY ALL""")
def role_playing_nations(spark: SparkSession, sf: str) -> DataFrame:
    """One dimension in two roles: the supplier's and the customer's nation."""
    nation = table(spark, sf, "nation")
    a = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("supp_nation"))
    b = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("cust_nation"))
    flows = (
        table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey")
        .join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .where("s_nationkey <> c_nationkey").groupBy("s_nationkey", "c_nationkey").agg(F.count("*").alias("n"))
    )
    return flows.join(a, "s_nationkey").join(b, "c_nationkey").groupBy("supp_nation", "cust_nation").agg(F.sum("n").alias("n"))


@query("""SELECT c_mktsegment AS segment, count(*) AS customers FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) GROUP BY ALL""")
def semi_customers_with_orders(spark: SparkSession, sf: str) -> DataFrame:
    big = table(spark, sf, "orders").where("o_totalprice > 100000").select("o_custkey")
    kept = table(spark, sf, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return kept.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("customers"))


@query("""SELECT p_brand AS brand, count(*) AS parts FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45) GROUP BY ALL""")
def anti_parts_never_ordered(spark: SparkSession, sf: str) -> DataFrame:
    used = table(spark, sf, "lineitem").where("l_quantity > 45").select("l_partkey")
    return table(spark, sf, "part").join(used, F.col("p_partkey") == F.col("l_partkey"), "left_anti").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("parts"))


@query("""WITH a AS (SELECT o_custkey AS k, count(*) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), b AS (SELECT o_custkey AS k, count(*) AS y FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL)
SELECT count(*) AS total, count(*) FILTER (coalesce(x, 0) = coalesce(y, 0)) AS consistent, round(avg(CASE WHEN coalesce(x, 0) = coalesce(y, 0) THEN 1.0 ELSE 0.0 END), 6) AS rate FROM a FULL JOIN b USING (k)""")
def full_outer_status_consistency(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    side = lambda s, n: orders.where(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.count("*").alias(n))
    both = side("F", "x").join(side("O", "y"), "o_custkey", "full")
    same = F.coalesce("x", F.lit(0)) == F.coalesce("y", F.lit(0))
    return both.agg(F.count("*").alias("total"), F.count_if(same).alias("consistent"), F.round(F.avg(same.cast("double")), 6).alias("rate"))


@query("""WITH g AS (SELECT o_orderkey AS k FROM orders), r AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 7 <> 0), m AS (SELECT count(*) AS merged_rows FROM g JOIN r USING (k))
SELECT (SELECT count(*) FROM g) AS gold_rows, merged_rows, round(least(1.0, merged_rows / (SELECT count(*) FROM g)), 8) AS ratio FROM m""")
def keyed_merge_match_ratio(spark: SparkSession, sf: str) -> DataFrame:
    gold = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    return joins.match_ratio(gold.where("k % 7 <> 0"), gold, ["k"]).withColumn("ratio", F.round("ratio", 8))


@query("""WITH x(status, label) AS (VALUES ('F', 'finished'), ('O', 'open'), ('P', 'pending')) SELECT label, count(*) AS n FROM orders JOIN x ON o_orderstatus = status GROUP BY ALL""")
def crosswalk_join(spark: SparkSession, sf: str) -> DataFrame:
    """Codes to names by a literal table of three rows."""
    names = spark.createDataFrame([("F", "finished"), ("O", "open"), ("P", "pending")], "o_orderstatus string, label string")
    return table(spark, sf, "orders").join(F.broadcast(names), "o_orderstatus").groupBy("label").agg(F.count("*").alias("n"))


@query("""SELECT (SELECT round(avg(l_discount), 8) FROM lineitem) AS mean_discount, (SELECT round(avg(c_acctbal), 6) FROM customer) AS mean_balance, (SELECT count(*) FROM supplier) AS suppliers""")
def cross_join_thematic(spark: SparkSession, sf: str) -> DataFrame:
    """Aggregates without a common key, a row each."""
    a = table(spark, sf, "lineitem").agg(F.round(F.avg("l_discount"), 8).alias("mean_discount"))
    b = table(spark, sf, "customer").agg(F.round(F.avg("c_acctbal"), 6).alias("mean_balance"))
    return a.crossJoin(b).crossJoin(table(spark, sf, "supplier").agg(F.count("*").alias("suppliers")))


PRICE_BANDS = [(0.0, 1000.0, "low"), (1000.0, 1200.0, "mid"), (1200.0, 1500.0, "high"), (1500.0, 100000.0, "top")]


@query("""WITH b(low, high, band) AS (VALUES (0.0, 1000.0, 'low'), (1000.0, 1200.0, 'mid'), (1200.0, 1500.0, 'high'), (1500.0, 100000.0, 'top'))
SELECT band, count(*) AS parts, round(avg(p_retailprice), 6) AS mean_price FROM part JOIN b ON p_retailprice >= low AND p_retailprice < high GROUP BY ALL""")
def range_join_price_bands(spark: SparkSession, sf: str) -> DataFrame:
    ranges = spark.createDataFrame(PRICE_BANDS, "low double, high double, band string")
    joined = joins.bands(table(spark, sf, "part").select("p_retailprice"), ranges, "p_retailprice", "low", "high", 500.0)
    return joined.groupBy("band").agg(F.count("*").alias("parts"), F.round(F.avg("p_retailprice"), 6).alias("mean_price"))


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS m, sum(o_totalprice) AS v FROM orders GROUP BY ALL), l AS (SELECT unnest(range(-3, 4)) AS lag)
SELECT lag, count(*) AS months, round(corr(a.v, b.v), 5) AS r FROM l JOIN m a ON true JOIN m b ON b.m = a.m + to_months(CAST(lag AS INTEGER)) GROUP BY ALL""")
def lagged_self_join_months(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation of monthly order value with itself, three months back to three ahead."""
    monthly = table(spark, sf, "orders").groupBy(F.trunc("o_orderdate", "month").alias("m")).agg(F.sum("o_totalprice").alias("v"))
    shifted = monthly.withColumn("lag", F.explode(F.sequence(F.lit(-3), F.lit(3)))).select("lag", F.col("v").alias("x"), F.add_months("m", F.col("lag")).alias("m"))
    return shifted.join(monthly, "m").groupBy(F.col("lag").cast("bigint").alias("lag")).agg(F.count("*").alias("months"), F.round(F.corr("x", "v"), 5).alias("r"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT a.l_suppkey AS supp_a, b.l_suppkey AS supp_b, count(*) AS orders FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL HAVING count(*) >= 3""")
def co_purchase_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers in the same order at least three times."""
    s = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    pairs = s.withColumnRenamed("l_suppkey", "supp_a").join(s.withColumnRenamed("l_suppkey", "supp_b"), "l_orderkey").where("supp_a < supp_b")
    return pairs.groupBy("supp_a", "supp_b").agg(F.count("*").alias("orders")).where("orders >= 3")


@query("""WITH p AS (SELECT user_id, ts, min(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY ALL)
SELECT e.event_id, p.click_id AS last_click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_event_purchase(spark: SparkSession, sf: str) -> DataFrame:
    """Each purchase with the user's last click before it."""
    e = table(spark, sf, "events")
    clicks = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.min("event_id").alias("click_id"))
    bought = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return joins.as_of(bought, clicks, ["user_id"], "ts", ["click_id"]).select("event_id", "last_click_id")


@query("""SELECT c_custkey, t.o_orderkey, round(t.o_totalprice, 2) AS price FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t""")
def lateral_top_order(spark: SparkSession, sf: str) -> DataFrame:
    """The dearest order of each customer: an aggregate instead of a lateral join, without ordering a customer's orders."""
    best = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("b"))
    joined = table(spark, sf, "customer").select("c_custkey").join(best, F.col("c_custkey") == F.col("o_custkey"))
    return joined.select("c_custkey", (-F.col("b.k")).alias("o_orderkey"), F.round("b.o_totalprice", 2).alias("price"))


@query("""WITH a AS (SELECT o_custkey AS k, o_orderkey AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT o_custkey AS k, o_orderkey AS y, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O')
SELECT count(*) AS rows_all, count(x) AS lefts, count(y) AS rights, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS pairs FROM a FULL JOIN b USING (k, n)""")
def paired_kth_join(spark: SparkSession, sf: str) -> DataFrame:
    """The k-th finished with the k-th open order of a customer."""
    orders = table(spark, sf, "orders")
    a = orders.where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("x"))
    b = orders.where("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").alias("y"))
    both = joins.paired(a, b, ["o_custkey"], [F.col("x")], [F.col("y")])
    return both.agg(F.count("*").alias("rows_all"), F.count("x").alias("lefts"), F.count("y").alias("rights"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("pairs"))


@query("""WITH l AS (SELECT o_orderpriority AS p, o_orderkey AS k, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n FROM orders), s AS (SELECT o_orderpriority AS p, count(*) AS spent FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL)
SELECT p AS priority, count(*) AS rows_left, min(k) AS first_key FROM l LEFT JOIN s USING (p) WHERE n > coalesce(spent, 0) GROUP BY ALL""")
def multiset_consume(spark: SparkSession, sf: str) -> DataFrame:
    """Bag difference by a fingerprint: one row is consumed for each row of the other side."""
    orders = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("k"))
    left = joins.bag_difference(orders, orders.where("k % 3 = 0"), ["priority"], [F.col("k")])
    return left.groupBy("priority").agg(F.count("*").alias("rows_left"), F.min("k").alias("first_key"))


# sets and orderings


@query("""SELECT source, count(*) AS n, round(avg(bal), 6) AS mean_bal FROM (SELECT 'customer' AS source, c_acctbal AS bal FROM customer UNION ALL SELECT 'supplier', s_acctbal FROM supplier) GROUP BY ALL""")
def union_sources_tagged(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").select(F.lit("customer").alias("source"), F.col("c_acctbal").alias("bal"))
    both = a.unionByName(table(spark, sf, "supplier").select(F.lit("supplier").alias("source"), F.col("s_acctbal").alias("bal")))
    return both.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("bal"), 6).alias("mean_bal"))


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf, "supplier").select("s_nationkey"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def except_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey").subtract(table(spark, sf, "orders").where("o_totalprice > 300000").select("o_custkey"))


@query("SELECT nation, count(*) AS n FROM (SELECT c_nationkey AS nation FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) GROUP BY ALL")
def except_all_bag(spark: SparkSession, sf: str) -> DataFrame:
    rest = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).exceptAll(table(spark, sf, "supplier").select("s_nationkey"))
    return rest.groupBy("nation").agg(F.count("*").alias("n"))


@query("SELECT nation, count(*) AS n FROM (SELECT c_nationkey AS nation FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier) GROUP BY ALL")
def intersect_all_bag(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).intersectAll(table(spark, sf, "supplier").select("s_nationkey"))
    return both.groupBy("nation").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk_orders(spark: SparkSession, sf: str) -> DataFrame:
    """A top-k report: each task keeps its own 25 rows."""
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", F.round("o_totalprice", 2).alias("price"))


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 20 OFFSET 40")
def offset_page(spark: SparkSession, sf: str) -> DataFrame:
    """The third page of 20 rows."""
    return table(spark, sf, "orders").orderBy("o_orderpriority", "o_orderkey").offset(40).limit(20).select("o_orderkey", "o_orderpriority")


@query("""WITH a AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS p, list_sort(list(DISTINCT o_orderstatus)) AS s FROM orders GROUP BY ALL)
SELECT o_custkey, len(p) AS n_priorities, len(list_filter(p, lambda x: x < '3')) AS n_urgent, array_to_string(list_sort(list_distinct(list_concat(p, s))), '|') AS joined, list_contains(s, 'P') AS has_p FROM a""")
def array_set_ops(spark: SparkSession, sf: str) -> DataFrame:
    """Higher-order functions and set operations on arrays."""
    by = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"), F.collect_set("o_orderstatus").alias("s"))
    return by.select(
        "o_custkey", F.size("p").cast("bigint").alias("n_priorities"), F.size(F.filter("p", lambda x: x < "3")).cast("bigint").alias("n_urgent"),
        F.array_join(F.array_sort(F.array_union("p", "s")), "|").alias("joined"), F.array_contains("s", "P").alias("has_p"),
    )


@query("SELECT * FROM (SELECT (o_orderkey % 100) || '-' || (o_orderkey % 7) AS id, min(o_orderkey) AS k FROM orders GROUP BY 1) ORDER BY CAST(split_part(id, '-', 1) AS INTEGER), CAST(split_part(id, '-', 2) AS INTEGER) LIMIT 50")
def composite_id_order(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of the form a-b in order of their numbers, the first 50."""
    k = F.col("o_orderkey")
    ids = table(spark, sf, "orders").groupBy(F.concat_ws("-", (k % 100).cast("string"), (k % 7).cast("string")).alias("id")).agg(F.min("o_orderkey").alias("k"))
    return ids.orderBy(F.transform(F.split("id", "-"), lambda x: x.cast("int"))).limit(50)
