"""Window functions and changes of shape.

Windows partition by a key of the data, or run over an aggregate whose size
does not grow with the rows (months, hours, types).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.catalog import table
from millrace.operators.reshape import densified, islands, ranked_bins
from millrace.plans.define import Collector

query = Collector()
QUERIES, SQL = query.queries, query.sql

def _month() -> Column:
    return F.date_format("o_orderdate", "yyyy-MM")


MONTHLY_SQL = "m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice) AS v, count(*) AS n FROM orders GROUP BY ALL)"


def _monthly(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(_month().alias("month")).agg(F.sum("o_totalprice").alias("v"), F.count("*").alias("n"))


def _in_order() -> W:
    """Over the months: some hundred rows at any size."""
    return W.partitionBy(F.lit(0)).orderBy("month")


@query("""SELECT c_custkey, c_nationkey, rank() OVER w AS r, dense_rank() OVER w AS d, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY floor(c_acctbal / 100) DESC)""")
def rank_customers_in_nation(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("c_nationkey").orderBy(F.floor(F.col("c_acctbal") / 100).desc())
    k = W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    r = lambda c: c.cast("bigint")
    return table(spark, sf, "customer").select("c_custkey", "c_nationkey", r(F.rank().over(w)).alias("r"), r(F.dense_rank().over(w)).alias("d"), r(F.row_number().over(k)).alias("k"))


@query("""WITH c AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS k FROM c)
SELECT p_type, max(CASE WHEN k = 1 THEN p_brand END) AS top1, max(CASE WHEN k = 1 THEN n END) AS n1, max(CASE WHEN k = 2 THEN p_brand END) AS top2, max(CASE WHEN k = 2 THEN n END) AS n2 FROM r WHERE k <= 2 GROUP BY ALL""")
def top2_brands_per_type_pivot(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    k = F.row_number().over(W.partitionBy("p_type").orderBy(F.desc("n"), "p_brand"))
    r = c.withColumn("k", k).where("k <= 2")
    at = lambda i, c: F.max(F.when(F.col("k") == i, F.col(c)))
    return r.groupBy("p_type").agg(at(1, "p_brand").alias("top1"), at(1, "n").alias("n1"), at(2, "p_brand").alias("top2"), at(2, "n").alias("n2"))


@query(f"""WITH {MONTHLY_SQL}, d AS (SELECT month, v - lag(v) OVER (ORDER BY month) AS change FROM m) SELECT month, round(change, 2) AS change, coalesce(change = max(change) OVER (), false) AS is_max FROM d""")
def mom_change_max_flag(spark: SparkSession, sf: str) -> DataFrame:
    d = _monthly(spark, sf).select("month", (F.col("v") - F.lag("v").over(_in_order())).alias("change"))
    top = F.max("change").over(W.partitionBy(F.lit(0)))
    return d.select("month", F.round("change", 2).alias("change"), F.coalesce(F.col("change") == top, F.lit(False)).alias("is_max"))


@query(f"""WITH {MONTHLY_SQL} SELECT a.month, round(a.v / b.v - 1, 6) AS growth FROM m a JOIN m b ON b.month = strftime(CAST(a.month || '-01' AS DATE) - INTERVAL 12 MONTH, '%Y-%m')""")
def yoy_growth(spark: SparkSession, sf: str) -> DataFrame:
    m = _monthly(spark, sf)
    before = m.select(F.date_format(F.add_months(F.to_date(F.concat("month", F.lit("-01"))), 12), "yyyy-MM").alias("month"), F.col("v").alias("old"))
    return m.join(before, "month").select("month", F.round(F.col("v") / F.col("old") - 1, 6).alias("growth"))


@query(f"""WITH {MONTHLY_SQL}, d AS (SELECT month, n - lag(n) OVER (ORDER BY month) AS d1 FROM m) SELECT month, d1, d1 - lag(d1) OVER (ORDER BY month) AS d2, coalesce(d1 > lag(d1) OVER (ORDER BY month), false) AS rising FROM d""")
def second_difference(spark: SparkSession, sf: str) -> DataFrame:
    d = _monthly(spark, sf).select("month", (F.col("n") - F.lag("n").over(_in_order())).alias("d1"))
    last = F.lag("d1").over(_in_order())
    return d.select("month", "d1", (F.col("d1") - last).alias("d2"), F.coalesce(F.col("d1") > last, F.lit(False)).alias("rising"))


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY ALL), g AS (SELECT unnest(generate_series((SELECT min(h) FROM h), (SELECT max(h) FROM h), INTERVAL 1 HOUR)) AS h),
d AS (SELECT g.h, coalesce(n, 0) AS n FROM g LEFT JOIN h USING (h)) SELECT strftime(h, '%Y-%m-%d %H') AS hour, round(avg(n) OVER (ORDER BY h ROWS BETWEEN 167 PRECEDING AND CURRENT ROW), 6) AS mean_7d FROM d""")
def rolling_7d_hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of the hourly counts of the last seven days; hours without events count 0."""
    hourly = table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").alias("n"))
    dense = densified(hourly, "h", "INTERVAL 1 HOUR").withColumn("n", F.coalesce("n", F.lit(0)))
    w = W.partitionBy(F.lit(0)).orderBy("h").rowsBetween(-167, 0)
    return dense.select(F.date_format("h", "yyyy-MM-dd HH").alias("hour"), F.round(F.avg("n").over(w), 6).alias("mean_7d"))


@query(f"""WITH {MONTHLY_SQL} SELECT month, round(avg(v) OVER (ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 0) AS mean_12m FROM m""")
def rolling_12m_avg(spark: SparkSession, sf: str) -> DataFrame:
    return _monthly(spark, sf).select("month", F.round(F.avg("v").over(_in_order().rowsBetween(-11, 0)), 0).alias("mean_12m"))


@query("""SELECT s_suppkey, round((s_acctbal - avg(s_acctbal) OVER w) / nullif(stddev_samp(s_acctbal) OVER w, 0), 5) AS z FROM supplier WINDOW w AS (PARTITION BY s_nationkey)""")
def zscore_per_group(spark: SparkSession, sf: str) -> DataFrame:
    """By joining the groups' moments instead of a window, so a huge group is no huge task."""
    s = table(spark, sf, "supplier")
    moments = s.groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("m"), F.stddev_samp("s_acctbal").alias("sd"))
    return s.join(moments, "s_nationkey").select("s_suppkey", F.round(F.try_divide(F.col("s_acctbal") - F.col("m"), F.nullif("sd", F.lit(0.0))), 5).alias("z"))


@query("""WITH n AS (SELECT c_nationkey, avg(c_acctbal) AS bal, count(*) AS n FROM customer GROUP BY ALL), i AS (SELECT c_nationkey, 0.6 * (bal - min(bal) OVER ()) / nullif(max(bal) OVER () - min(bal) OVER (), 0) + 0.4 * (n - min(n) OVER ()) / nullif(max(n) OVER () - min(n) OVER (), 0) AS idx FROM n)
SELECT c_nationkey, round(idx, 6) AS idx, row_number() OVER (ORDER BY idx DESC, c_nationkey) AS rank FROM i""")
def minmax_index_rank(spark: SparkSession, sf: str) -> DataFrame:
    """A composite index of two min-max scaled measures, ranked; a row a nation."""
    n = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("bal"), F.count("*").alias("n"))
    w = W.partitionBy(F.lit(0))
    scaled = lambda c: F.try_divide(F.col(c) - F.min(c).over(w), F.nullif(F.max(c).over(w) - F.min(c).over(w), F.lit(0)))
    i = n.select("c_nationkey", (0.6 * scaled("bal") + 0.4 * scaled("n")).alias("idx"))
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("idx"), "c_nationkey")).cast("bigint")
    return i.select("c_nationkey", F.round("idx", 6).alias("idx"), rank.alias("rank"))


@query("""WITH t AS (SELECT l_partkey, sum(l_extendedprice) AS v FROM lineitem GROUP BY ALL), q AS (SELECT quantile_disc(v, 0.9) AS q FROM t) SELECT l_partkey, v >= q AS top10 FROM t, q""")
def top10pct_flag(spark: SparkSession, sf: str) -> DataFrame:
    """Parts at or above the 90th percentile of revenue, by one threshold instead of a global order."""
    t = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("v"))
    q = t.agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY v)").alias("q"))
    return t.crossJoin(F.broadcast(q)).select("l_partkey", (F.col("v") >= F.col("q")).alias("top10"))  # q is one row


@query("""SELECT bin, count(*) AS n, round(min(o_totalprice), 2) AS low, round(max(o_totalprice), 2) AS high FROM (SELECT o_totalprice, ntile(10) OVER (ORDER BY o_totalprice, o_orderkey) AS bin FROM orders) GROUP BY ALL""")
def ntile_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Ten bins of equal counts, ranked by range partitions instead of one ordered task."""
    binned = ranked_bins(table(spark, sf, "orders").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"], 10)
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.min("o_totalprice"), 2).alias("low"), F.round(F.max("o_totalprice"), 2).alias("high"))


@query("""WITH b AS (SELECT p_brand, sum(p_retailprice) AS v FROM part GROUP BY ALL) SELECT p_brand, round(sum(v) OVER (ORDER BY v DESC, p_brand) / sum(v) OVER (), 6) AS share FROM b""")
def cumulative_share(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("v"))
    w = W.partitionBy(F.lit(0)).orderBy(F.desc("v"), "p_brand").rowsBetween(W.unboundedPreceding, 0)
    return b.select("p_brand", F.round(F.sum("v").over(w) / F.sum("v").over(W.partitionBy(F.lit(0))), 6).alias("share"))


@query("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events), g AS (SELECT user_id, d, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INTEGER) AS grp FROM d),
i AS (SELECT user_id, grp, count(*) AS days FROM g GROUP BY ALL) SELECT user_id, count(*) AS runs, max(days) AS longest FROM i GROUP BY ALL""")
def gaps_islands_user(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of days on which a user was active."""
    days = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("d")).distinct()
    runs = islands(days, ["user_id"], "d").groupBy("user_id", "island").agg(F.count("*").alias("days"))
    return runs.groupBy("user_id").agg(F.count("*").alias("runs"), F.max("days").alias("longest"))


@query("""WITH g AS (SELECT event_type, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS gap FROM events)
SELECT event_type, round(avg(CASE WHEN gap <= 3600 THEN 1.0 ELSE 0.0 END), 6) AS within_1h, round(avg(CASE WHEN gap <= 10800 THEN 1.0 ELSE 0.0 END), 6) AS within_3h, round(avg(CASE WHEN gap <= 21600 THEN 1.0 ELSE 0.0 END), 6) AS within_6h FROM g GROUP BY ALL""")
def gap_within_hours_rates(spark: SparkSession, sf: str) -> DataFrame:
    """How often a user's event follows the one before within some hours."""
    before = F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    g = table(spark, sf, "events").withColumn("b", before).select("event_type", (F.expr("timestampdiff(MICROSECOND, b, ts)") / 1e6).alias("gap"))
    rate = lambda h: F.round(F.avg(F.when(F.col("gap") <= h * 3600, 1.0).otherwise(0.0)), 6).alias(f"within_{h}h")
    return g.groupBy("event_type").agg(rate(1), rate(3), rate(6))


@query("""WITH l AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), c AS (SELECT a, b, count(*) AS n FROM l WHERE b IS NOT NULL GROUP BY ALL)
SELECT a AS from_type, b AS to_type, n, round(n / sum(n) OVER (PARTITION BY a), 6) AS p FROM c""")
def lead_transition_matrix(spark: SparkSession, sf: str) -> DataFrame:
    after = F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    steps = table(spark, sf, "events").select(F.col("event_type").alias("from_type"), after.alias("to_type")).where("to_type is not null")
    n = steps.groupBy("from_type", "to_type").agg(F.count("*").alias("n"))
    return n.select("from_type", "to_type", "n", F.round(F.col("n") / F.sum("n").over(W.partitionBy("from_type")), 6).alias("p"))


@query("""SELECT DISTINCT user_id, first_value(event_type) OVER w AS first_type, last_value(event_type) OVER w AS last_type, nth_value(event_type, 2) OVER w AS second_type FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def first_last_value(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    e = table(spark, sf, "events")
    return e.select("user_id", F.first("event_type").over(w).alias("first_type"), F.last("event_type").over(w).alias("last_type"), F.nth_value("event_type", 2).over(w).alias("second_type")).distinct()


@query(f"""WITH {MONTHLY_SQL}, k AS (SELECT row_number() OVER (ORDER BY month) AS t, v FROM m), r AS (SELECT regr_slope(v, t) AS s, regr_intercept(v, t) AS i, max(t) AS last FROM k)
SELECT last + h AS t, round(i + s * (last + h), 1) AS forecast, true AS is_forecast FROM r, unnest(range(1, 7)) AS x(h)""")
def linear_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """Six months ahead on the line through the monthly values."""
    k = _monthly(spark, sf).select(F.row_number().over(_in_order()).cast("bigint").alias("t"), "v")
    r = k.agg(F.regr_slope("v", "t").alias("s"), F.regr_intercept("v", "t").alias("i"), F.max("t").alias("last"))
    ahead = r.select("s", "i", F.explode(F.sequence(F.col("last") + 1, F.col("last") + 6)).alias("t"))
    return ahead.select("t", F.round(F.col("i") + F.col("s") * F.col("t"), 1).alias("forecast"), F.lit(True).alias("is_forecast"))


@query("""WITH x AS (SELECT user_id, ts, value, avg(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS m FROM events)
SELECT user_id, count(*) AS n, round(max(m), 6) AS top_mean FROM x GROUP BY ALL""")
def range_frame_daily_mean(spark: SparkSession, sf: str) -> DataFrame:
    """A frame by time: the mean value of a user's last day at each event."""
    secs = F.unix_micros(F.col("ts").cast("timestamp"))
    w = W.partitionBy("user_id").orderBy(secs).rangeBetween(-86_400_000_000, 0)
    x = table(spark, sf, "events").select("user_id", F.avg("value").over(w).alias("m"))
    return x.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.max("m"), 6).alias("top_mean"))


@query("""SELECT s_suppkey, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)""")
def percent_rank_cume_dist(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")
    return table(spark, sf, "supplier").select("s_suppkey", F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"))


@query(f"""WITH {MONTHLY_SQL}, y AS (SELECT substr(month, 1, 4) AS y, month, v FROM m) SELECT y AS year, arg_max(month, (v, month)) AS peak, round(max(v) / sum(v), 6) AS peak_share FROM y GROUP BY ALL""")
def peak_month_by_year(spark: SparkSession, sf: str) -> DataFrame:
    y = _monthly(spark, sf).withColumn("year", F.substring("month", 1, 4))
    return y.groupBy("year").agg(F.max_by("month", F.struct("v", "month")).alias("peak"), F.round(F.max("v") / F.sum("v"), 6).alias("peak_share"))


@query("""WITH a AS (SELECT user_id, min(ts) AS t0 FROM events WHERE event_type = 'error' GROUP BY ALL) SELECT date_diff('day', CAST(e.ts AS DATE), CAST(a.t0 AS DATE)) AS days_before, count(*) AS n, count(DISTINCT e.user_id) AS support
FROM events e JOIN a USING (user_id) WHERE e.ts < a.t0 AND e.ts >= a.t0 - INTERVAL 7 DAY GROUP BY ALL""")
def window_before_first_error(spark: SparkSession, sf: str) -> DataFrame:
    """What happened in the week before a user's first error."""
    e = table(spark, sf, "events")
    a = e.where("event_type = 'error'").groupBy("user_id").agg(F.min("ts").alias("t0"))
    near = e.join(a, "user_id").where("ts < t0 and ts >= t0 - INTERVAL 7 DAYS")
    days = F.datediff(F.to_date("t0"), F.to_date("ts")).cast("bigint").alias("days_before")
    return near.groupBy(days).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("support"))


# changes of shape


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY ALL""")
def pivot_status_by_month(spark: SparkSession, sf: str) -> DataFrame:
    wide = table(spark, sf, "orders").groupBy(_month().alias("month")).pivot("o_orderstatus", ["F", "O", "P"]).count()
    return wide.select("month", *(F.coalesce(c.upper(), F.lit(0)).alias(c) for c in "fop"))


@query("""SELECT measure, round(sum(v), 2) AS total, round(avg(v), 6) AS mean FROM (UNPIVOT (SELECT l_quantity, l_discount, l_tax FROM lineitem) ON COLUMNS(*) INTO NAME measure VALUE v) GROUP BY ALL""")
def unpivot_measures(spark: SparkSession, sf: str) -> DataFrame:
    measures = ["l_quantity", "l_discount", "l_tax"]
    long = table(spark, sf, "lineitem").select(*measures).unpivot([], measures, "measure", "v")
    return long.groupBy("measure").agg(F.round(F.sum("v"), 2).alias("total"), F.round(F.avg("v"), 6).alias("mean"))


@query("""SELECT o_orderpriority AS priority, round(sum(o_totalprice) FILTER (quarter(o_orderdate) = 1), 2) AS q1, round(sum(o_totalprice) FILTER (quarter(o_orderdate) = 2), 2) AS q2, round(sum(o_totalprice) FILTER (quarter(o_orderdate) = 3), 2) AS q3, round(sum(o_totalprice) FILTER (quarter(o_orderdate) = 4), 2) AS q4 FROM orders GROUP BY ALL""")
def wide_metric_quarter_table(spark: SparkSession, sf: str) -> DataFrame:
    wide = table(spark, sf, "orders").withColumn("q", F.quarter("o_orderdate")).groupBy(F.col("o_orderpriority").alias("priority")).pivot("q", [1, 2, 3, 4])
    summed = wide.agg(F.round(F.sum("o_totalprice"), 2))
    return summed.select("priority", *(F.col(str(k)).alias(f"q{k}") for k in range(1, 5)))


@query("""SELECT regionid, min(value) AS low, max(value) AS high, count(*) AS n FROM (SELECT regionid, unnest([m2022_01, m2022_02, m2022_03, m2022_04, m2022_05, m2022_06, m2022_07, m2022_08, m2022_09, m2022_10, m2022_11, m2022_12]) AS value FROM region_index) WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL""")
def wide_months_to_long(spark: SparkSession, sf: str) -> DataFrame:
    """The wide monthly index as rows; missing months are left out."""
    months = [f"m2022_{k:02d}" for k in range(1, 13)]
    long = table(spark, sf, "region_index").select("regionid", *months).unpivot(["regionid"], months, "month", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))
    return long.groupBy("regionid").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))
