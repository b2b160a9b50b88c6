"""Scores of predictions and sample statistics; predictions are made from key arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import table
from millrace.operators import scoring
from millrace.plans.define import Collector

query = Collector()
QUERIES, SQL = query.queries, query.sql

# truth and a prediction that is off by a share that depends on the key
REG_SQL = "s AS (SELECT o_orderpriority AS seg, o_totalprice AS y, o_totalprice * (1 + ((o_orderkey % 21) - 10) / 100.0) AS p FROM orders)"
CLS_SQL = "c AS (SELECT CAST(p_size % 5 AS BIGINT) AS t, CAST((CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size END) % 5 AS BIGINT) AS p FROM part)"


def _reg(spark: SparkSession, sf: str) -> DataFrame:
    off = 1 + ((F.col("o_orderkey") % 21) - 10) / 100.0
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("seg"), F.col("o_totalprice").alias("y"), (F.col("o_totalprice") * off).alias("p"))


def _cls(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf, "part").select((size % 5).cast("bigint").alias("t"), (F.when(F.col("p_partkey") % 4 == 0, size + 1).otherwise(size) % 5).cast("bigint").alias("p"))


_REG_COLS = """round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(pow(ln(1 + y) - ln(1 + greatest(p, 0)), 2)), 8) AS msle,
round(100 * avg(CASE WHEN abs(y) + abs(p) = 0 THEN 0 ELSE 2 * abs(y - p) / (abs(y) + abs(p)) END), 6) AS smape, round(avg(abs(y - p) / abs(y)), 8) AS mape, round(median(abs(y - p)), 4) AS medae, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 8) AS r2"""
_REG_DIGITS = {"mae": 4, "rmse": 4, "msle": 8, "smape": 6, "mape": 8, "medae": 4, "r2": 8}


@query(f"WITH {REG_SQL} SELECT {_REG_COLS} FROM s")
def reg_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = scoring.regression(_reg(spark, sf), "y", "p", list(_REG_DIGITS))
    return m.select(*(F.round(c, k).alias(c) for c, k in _REG_DIGITS.items()))


@query(f"WITH {REG_SQL} SELECT seg, {_REG_COLS} FROM s GROUP BY ALL")
def reg_metrics_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    m = scoring.regression(_reg(spark, sf), "y", "p", list(_REG_DIGITS), ["seg"])
    return m.select("seg", *(F.round(c, k).alias(c) for c, k in _REG_DIGITS.items()))


@query(f"WITH {REG_SQL}, m AS (SELECT avg(abs(y - p)) AS v FROM s) SELECT round(greatest(0, least(1, (v - 20000) / (0 - 20000))), 6) AS score FROM m")
def normalised_score(spark: SparkSession, sf: str) -> DataFrame:
    m = scoring.regression(_reg(spark, sf), "y", "p", ["mae"])
    return m.select(F.round(scoring.normalised(F.col("mae"), 0.0, 20000.0, "mae"), 6).alias("score"))


_CLASSES_SQL = f"""{CLS_SQL}, t AS (SELECT t AS k, count(*) AS support, count(*) FILTER (t = p) AS hits FROM c GROUP BY ALL), q AS (SELECT p AS k, count(*) AS claimed FROM c GROUP BY ALL),
r AS (SELECT k, support, hits / claimed AS precision, hits / support AS recall FROM t JOIN q USING (k))"""


@query(f"""WITH {_CLASSES_SQL} SELECT k AS class, support, round(precision, 8) AS precision, round(recall, 8) AS recall, round(2 * precision * recall / (precision + recall), 8) AS f1 FROM r""")
def classification_report(spark: SparkSession, sf: str) -> DataFrame:
    c = scoring.per_class(_cls(spark, sf), "t", "p")
    return c.select("class", "support", *(F.round(x, 8).alias(x) for x in ("precision", "recall", "f1")))


@query(f"""WITH {_CLASSES_SQL} SELECT round(sum(recall * support) / sum(support), 8) AS accuracy, round(sum(2 * precision * recall / (precision + recall) * support) / sum(support), 8) AS f1 FROM r""")
def cls_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.weighted_f1(_cls(spark, sf), "t", "p").select(F.round("accuracy", 8).alias("accuracy"), F.round("f1", 8).alias("f1"))


@query(f"""WITH {CLS_SQL}, o AS (SELECT avg((t - p) * (t - p)) AS o FROM c), a AS (SELECT t, count(*) AS n FROM c GROUP BY ALL), b AS (SELECT p, count(*) AS n FROM c GROUP BY ALL),
e AS (SELECT sum((t - p) * (t - p) * a.n * b.n) / pow((SELECT count(*) FROM c), 2) AS e FROM a, b) SELECT round(1 - o / e, 8) AS kappa FROM o, e""")
def quadratic_weighted_kappa(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.quadratic_kappa(_cls(spark, sf), "t", "p").select(F.round("kappa", 8).alias("kappa"))


@query("""SELECT t AS actual, p AS predicted, count(*) AS n FROM (WITH c AS (SELECT CAST(p_size % 5 AS BIGINT) AS t, CAST((CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size END) % 5 AS BIGINT) AS p FROM part) SELECT * FROM c) GROUP BY ALL""")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _cls(spark, sf).groupBy(F.col("t").alias("actual"), F.col("p").alias("predicted")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, least(1 - 1e-15, greatest(1e-15, l_quantity / 51.0)) AS p FROM lineitem) SELECT round(-avg(CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END), 8) AS logloss FROM s""")
def logloss(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 51.0).alias("p"))
    return scoring.log_loss(s, "y", "p").select(F.round("logloss", 8).alias("logloss"))


@query("""WITH s AS (SELECT c_acctbal AS v, 1 AS x, 0 AS y FROM customer UNION ALL SELECT s_acctbal, 0, 1 FROM supplier), g AS (SELECT v, sum(x) AS x, sum(y) AS y FROM s GROUP BY ALL)
SELECT round(max(abs(cx / tx - cy / ty)), 8) AS ks FROM (SELECT sum(x) OVER (ORDER BY v) AS cx, sum(y) OVER (ORDER BY v) AS cy, sum(x) OVER () AS tx, sum(y) OVER () AS ty FROM g)""")
def ks_two_samples(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").select(F.col("c_acctbal").alias("v"))
    return scoring.ks_two_samples(a, table(spark, sf, "supplier").select(F.col("s_acctbal").alias("v")), "v").select(F.round("ks", 8).alias("ks"))


@query("""WITH p AS (SELECT v, sum(n) OVER (ORDER BY v) / sum(n) OVER () AS f FROM (SELECT s_acctbal AS v, count(*) AS n FROM supplier GROUP BY ALL)), g AS (SELECT c_acctbal AS v FROM customer)
SELECT round(sum(CASE WHEN p.v < g.v THEN f * f ELSE (f - 1) * (f - 1) END) / 1e6, 6) AS crps_m FROM g, p""")
def crps(spark: SparkSession, sf: str) -> DataFrame:
    """In millions, so that rounding holds for both engines."""
    gold = table(spark, sf, "customer").select(F.col("c_acctbal").alias("v"))
    found = scoring.crps(gold, table(spark, sf, "supplier").select(F.col("s_acctbal").alias("v")), "v")
    return found.select(F.round(F.col("crps") / 1e6, 6).alias("crps_m"))


# samples


@query("SELECT round(corr(l_quantity, l_extendedprice), 8) AS r, count(*) AS n FROM lineitem")
def pearson(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 8).alias("r"), F.count("*").alias("n"))


def _rank_sql(col: str) -> str:
    return f"(rank() OVER (ORDER BY {col}) + (count(*) OVER (PARTITION BY {col}) - 1) / 2.0)"


@query(f"""SELECT round(corr(a, b), 8) AS rho FROM (SELECT {_rank_sql('l_quantity')} AS a, {_rank_sql('l_extendedprice')} AS b FROM lineitem)""")
def spearman(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("rho", 8).alias("rho"))


@query("""SELECT round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2,
round(sqrt((1 - regr_r2(l_extendedprice, l_quantity)) * regr_syy(l_extendedprice, l_quantity) / ((count(*) - 2) * regr_sxx(l_extendedprice, l_quantity))), 6) AS std_err, count(*) AS n FROM lineitem""")
def ols_simple(spark: SparkSession, sf: str) -> DataFrame:
    o = scoring.ols(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity")
    return o.select(F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 8).alias("r2"), F.round("std_err", 6).alias("std_err"), "n")


@query("""WITH m AS (SELECT avg(value) FILTER (event_type = 'view') AS ma, var_samp(value) FILTER (event_type = 'view') AS va, count(value) FILTER (event_type = 'view') AS na,
avg(value) FILTER (event_type = 'click') AS mb, var_samp(value) FILTER (event_type = 'click') AS vb, count(value) FILTER (event_type = 'click') AS nb FROM events)
SELECT round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS cohens_d, round((ma - mb) / sqrt(va / na + vb / nb), 6) AS welch_t, round(pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)), 3) AS welch_df FROM m""")
def effect_size_and_welch(spark: SparkSession, sf: str) -> DataFrame:
    t = scoring.two_groups(table(spark, sf, "events"), "event_type", "view", "click", "value")
    return t.select(F.round("cohens_d", 6).alias("cohens_d"), F.round("welch_t", 6).alias("welch_t"), F.round("welch_df", 3).alias("welch_df"))


@query("""WITH g AS (SELECT event_type, count(value) AS n, avg(value) AS m, var_pop(value) AS v FROM events GROUP BY ALL), t AS (SELECT sum(n * m) / sum(n) AS gm FROM g)
SELECT round((sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 6) AS f, count(*) - 1 AS df_between, CAST(sum(n) - count(*) AS BIGINT) AS df_within FROM g, t""")
def anova_f(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.anova(table(spark, sf, "events"), "event_type", "value").select(F.round("f", 6).alias("f"), "df_between", "df_within")


@query(f"""WITH r AS (SELECT event_type, value, {_rank_sql('value')} AS r FROM events WHERE value IS NOT NULL), s AS (SELECT sum(r) AS r, count(*) AS c FROM r GROUP BY event_type), n AS (SELECT count(*) AS n FROM r),
t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM r GROUP BY value)) SELECT round((12 / (max(n) * (max(n) + 1.0)) * sum(r * r / c) - 3 * (max(n) + 1)) / (1 - max(ties) / (pow(max(n), 3) - max(n))), 5) AS h FROM s, n, t""")
def kruskal_h(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.kruskal(table(spark, sf, "events"), "event_type", "value").select(F.round("h", 5).alias("h"))


@query(f"""WITH r AS (SELECT event_type, {_rank_sql('value')} AS r FROM events WHERE event_type IN ('view', 'click') AND value IS NOT NULL) SELECT round(sum(r) FILTER (event_type = 'view') - count(*) FILTER (event_type = 'view') * (count(*) FILTER (event_type = 'view') + 1) / 2.0, 1) AS u FROM r""")
def mannwhitney_u(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.mann_whitney(table(spark, sf, "events"), "event_type", "view", "click", "value").select(F.round("u", 1).alias("u"))


@query("""WITH t AS (SELECT p_brand AS k, 1 / (1.0 + count(*)) AS p FROM part GROUP BY ALL), r AS (SELECT k, p, row_number() OVER (ORDER BY p, k) AS i, count(*) OVER () AS n FROM t)
SELECT k, round(least(1, min(p * n / i) OVER (ORDER BY i DESC)), 8) AS q FROM r""")
def bh_fdr(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "part").groupBy(F.col("p_brand").alias("k")).agg((1 / (1.0 + F.count("*"))).alias("p"))
    return scoring.benjamini_hochberg(t, "p", "k").select("k", F.round("q", 8).alias("q"))


@query()
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    """A seeded bootstrap of the mean order value; random numbers have no SQL that says the same."""
    return scoring.bootstrap_mean(table(spark, sf, "orders"), "o_totalprice", "o_orderkey")
