"""Profiles of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import table
from millrace.operators import profile as P
from millrace.plans.define import Collector

query = Collector()
QUERIES, SQL = query.queries, query.sql

_PROFILED = {"customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}, "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"}}


def _profile_sql(tables: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", '{c}' AS "column", '{kind}' AS type, count(*) AS total, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS "distinct" FROM {t}""" for t in tables for c, kind in _PROFILED[t].items()
    )


def _profiles(spark: SparkSession, sf: str) -> DataFrame:
    return P.profile_tables({t: table(spark, sf, t) for t in ("customer", "supplier")})


@query(_profile_sql(("customer", "supplier")))
def profile_columns(spark: SparkSession, sf: str) -> DataFrame:
    return _profiles(spark, sf).drop("low", "high")


@query("""SELECT 'o_orderkey' AS "column", CAST(min(o_orderkey) AS VARCHAR) AS low, CAST(max(o_orderkey) AS VARCHAR) AS high FROM orders UNION ALL SELECT 'o_orderpriority', min(o_orderpriority), max(o_orderpriority) FROM orders UNION ALL SELECT 'o_orderstatus', min(o_orderstatus), max(o_orderstatus) FROM orders""")
def profile_value_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return P.profile_columns(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), "orders").select("column", "low", "high")


@query("""SELECT unnest(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS name""")
def numeric_column_list(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in P.numeric_columns(table(spark, sf, "lineitem"))], "name string")


@query("""WITH c AS (SELECT column_name AS n FROM (DESCRIBE region_index)), p AS (SELECT n, regexp_replace(n, '\\d+', '{N}', 'g') AS p FROM c), g AS (SELECT p, count(*) AS m, min(n) AS f, max(n) AS l, list(n) AS a FROM p GROUP BY ALL)
SELECT p AS pattern, m AS members, f AS first, l AS last FROM g WHERE m >= 5 UNION ALL SELECT x, 1, x, x FROM (SELECT unnest(a) AS x FROM g WHERE m < 5)""")
def column_patterns(spark: SparkSession, sf: str) -> DataFrame:
    columns = spark.createDataFrame([(c,) for c in table(spark, sf, "region_index").columns], "name string")
    return P.name_patterns(columns, "name")


@query("""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem), r AS (SELECT quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q3 FROM lineitem)
SELECT 'l_extendedprice' AS "column", round(q1, 4) AS q1, round(q3, 4) AS q3, (SELECT count(*) FROM lineitem WHERE l_extendedprice < q1 - 0.5 * (q3 - q1) OR l_extendedprice > q3 + 0.5 * (q3 - q1)) AS outliers FROM q
UNION ALL SELECT 'l_quantity', round(q1, 4), round(q3, 4), (SELECT count(*) FROM lineitem WHERE l_quantity < q1 - 0.5 * (q3 - q1) OR l_quantity > q3 + 0.5 * (q3 - q1)) FROM r""")
def outlier_iqr(spark: SparkSession, sf: str) -> DataFrame:
    o = P.iqr_outliers(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"], 0.5)
    return o.select("column", F.round("q1", 4).alias("q1"), F.round("q3", 4).alias("q3"), "outliers")


@query(f"""WITH p AS ({_profile_sql(("customer", "supplier"))}) SELECT "table", count(*) AS columns, round(avg(1 - missing / total), 6) AS completeness, count(*) FILTER ("distinct" <= 1) AS constant_columns FROM p GROUP BY ALL""")
def quality_score(spark: SparkSession, sf: str) -> DataFrame:
    return P.quality(_profiles(spark, sf)).withColumn("completeness", F.round("completeness", 6))


@query("""WITH k AS (SELECT json_keys(props) AS k FROM events), n AS (SELECT count(*) AS n FROM k), s AS (SELECT key, count(*) AS w FROM (SELECT unnest(list_distinct(k)) AS key FROM k) GROUP BY ALL)
SELECT max(n) AS documents, count(*) AS all_keys, count(*) FILTER (w = n) AS common_keys, count(*) = count(*) FILTER (w = n) AS consistent FROM s, n""")
def schema_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return P.key_consistency(table(spark, sf, "events"), "props")


@query("""SELECT CAST(2 AS BIGINT) AS tables, CAST((SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS BIGINT) AS rows, CAST(9 AS BIGINT) AS columns, CAST(0 AS BIGINT) AS shared_columns, false AS any_missing""")
def domain_exploration(spark: SparkSession, sf: str) -> DataFrame:
    return P.explore(_profiles(spark, sf))


@query("""WITH l AS (SELECT regionid, max(total) AS a FROM result_left GROUP BY ALL), r AS (SELECT regionid, max(total) AS b FROM result_right GROUP BY ALL)
SELECT count(*) AS total, count(*) FILTER (abs(a - b) <= 0) AS consistent, round(avg(CASE WHEN abs(a - b) <= 0 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM l FULL JOIN r USING (regionid)""")
def feed_consistency(spark: SparkSession, sf: str) -> DataFrame:
    side = lambda t: table(spark, sf, t).groupBy("regionid").agg(F.max("total").alias("total"))
    return P.consistency(side("result_left"), side("result_right"), ["regionid"], "total", 0).withColumn("rate", F.round("rate", 6))
