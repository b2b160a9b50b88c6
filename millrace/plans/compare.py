"""Queries of the comparison operators: a table against a copy changed by key arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import table
from millrace.operators import compare as C
from millrace.plans.define import Collector

query = Collector()
QUERIES, SQL = query.queries, query.sql


def _gold(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("i"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))


def _output(spark: SparkSession, sf: str) -> DataFrame:
    """Other names and order; names in upper case, balances off by 0.005, some nations wrong."""
    g = _gold(spark, sf)
    wrong = F.when(F.col("i") % 10 == 0, F.col("nation") + 100).otherwise(F.col("nation"))
    return g.select("i", wrong.alias("x"), (F.col("balance") + 0.005).alias("y"), F.upper(F.concat(F.lit(" "), "name")).alias("z"))


_PAIRS = "g AS (SELECT c_custkey AS i, c_name, c_acctbal, c_nationkey FROM customer), p AS (SELECT c_custkey AS i, CASE WHEN c_custkey % 10 = 0 THEN c_nationkey + 100 ELSE c_nationkey END AS x, c_acctbal + 0.005 AS y, upper(' ' || c_name) AS z FROM customer)"


@query(f"""WITH {_PAIRS}, t AS (SELECT bool_and(lower(trim(c_name)) = lower(trim(z))) AS a, bool_and(abs(c_acctbal - y) <= 0.01 + 1e-9) OR bool_and(abs(c_acctbal - x) <= 0.01) AS b, bool_and(abs(c_nationkey - x) <= 0.01) OR bool_and(abs(c_nationkey - y) <= 0.01) AS c FROM g JOIN p USING (i))
SELECT 'name' AS "column", a AS matched FROM t UNION ALL SELECT 'balance', b FROM t UNION ALL SELECT 'nation', c FROM t""")
def table_score_ordered(spark: SparkSession, sf: str) -> DataFrame:
    return C.score_ordered(_output(spark, sf), _gold(spark, sf), "i")


@query("""WITH g AS (SELECT DISTINCT lower(trim(c_mktsegment)) AS v FROM customer), p AS (SELECT DISTINCT lower(trim(upper(c_mktsegment))) AS v FROM customer WHERE c_custkey % 3 = 0), h AS (SELECT DISTINCT c_nationkey AS v FROM customer), q AS (SELECT DISTINCT c_nationkey AS v FROM customer WHERE c_custkey % 3 = 0)
SELECT 'c_mktsegment' AS "column", (SELECT count(*) FROM g) = (SELECT count(*) FROM g SEMI JOIN p USING (v)) AS matched UNION ALL SELECT 'c_nationkey', (SELECT count(*) FROM h) = (SELECT count(*) FROM h SEMI JOIN q USING (v))""")
def table_score_unordered(spark: SparkSession, sf: str) -> DataFrame:
    """Containment of values: a third of the rows, in upper case, against all."""
    c = table(spark, sf, "customer")
    out = c.where("c_custkey % 3 = 0").select(F.upper("c_mktsegment").alias("s"), F.col("c_nationkey").alias("n"))
    return C.score_unordered(out, c.select("c_mktsegment", "c_nationkey"))


@query("SELECT round(2.0 / 3, 6) AS score")
def table_total_score(spark: SparkSession, sf: str) -> DataFrame:
    return C.total_score(C.score_ordered(_output(spark, sf), _gold(spark, sf), "i")).select(F.round("score", 6).alias("score"))


@query("""SELECT 'c_mktsegment' AS "column", true AS equal UNION ALL SELECT 'c_name', false""")
def column_signature_match(spark: SparkSession, sf: str) -> DataFrame:
    """Columns with the same values in any order have the same signature."""
    c = table(spark, sf, "customer").select("c_mktsegment", "c_name")
    other = c.select(F.upper("c_mktsegment").alias("c_mktsegment"), F.concat("c_name", F.lit("x")).alias("c_name"))
    both = C.signatures(c).join(C.signatures(other).withColumnRenamed("signature", "s2"), "column")
    return both.select("column", (F.col("signature") == F.col("s2")).alias("equal"))


@query("""SELECT c_nationkey, round(avg(CASE WHEN c_custkey % 5 = 0 THEN 0.5 ELSE 1.0 END), 6) AS score FROM customer WHERE abs(c_acctbal) >= 0.01 GROUP BY ALL""")
def json_leaf_score(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of two leaves; every fifth has one leaf off by five percent."""
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    gold = F.to_json(F.struct(b.alias("User_Balance"), F.col("c_mktsegment").alias("segment")))
    out = F.to_json(F.struct(F.when(k % 5 == 0, b * 1.05).otherwise(b * 1.005).alias("userbalance"), F.upper("c_mktsegment").alias("segment")))
    rows = table(spark, sf, "customer").where("abs(c_acctbal) >= 0.01").select("c_nationkey", gold.alias("gold"), out.alias("out"))
    return C.score_json_columns(rows, "out", "gold").groupBy("c_nationkey").agg(F.round(F.avg("score"), 6).alias("score"))


@query("""SELECT c_custkey % 4 AS k, count(*) AS n, count(*) FILTER (c_custkey % 4 <> 0) AS equal FROM customer GROUP BY ALL""")
def text_equal(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    changed = F.when(k == 0, F.concat("c_name", F.lit("!"))).otherwise(F.concat(F.lit("  "), F.upper("c_name"), F.lit("\n")))
    return table(spark, sf, "customer").select(k.alias("k"), C.texts_equal(F.col("c_name"), changed).alias("e")).groupBy("k").agg(F.count("*").alias("n"), F.count_if("e").alias("equal"))


@query("""SELECT c_mktsegment AS segment, true AS raw_close, true AS share_close FROM customer GROUP BY ALL""")
def array_allclose(spark: SparkSession, sf: str) -> DataFrame:
    """Arrays of counts by nation against themselves in another order, and against their doubles as shares."""
    counted = table(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").cast("double").alias("n"))
    arrays = counted.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.collect_list("n").alias("a"))
    twice = F.transform(F.reverse("a"), lambda v: v * 2)
    return arrays.select("segment", C.arrays_close(F.col("a"), F.reverse("a")).alias("raw_close"), C.arrays_close(F.col("a"), twice, scale=True).alias("share_close"))


@query("""SELECT CASE WHEN doc_id % 9 = 0 THEN 'added' ELSE 'changed' END AS change, count(*) AS n FROM documents WHERE text IS NOT NULL AND (doc_id % 9 = 0 OR doc_id % 5 = 0) GROUP BY ALL""")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), "doc_id")
    before = docs.where("doc_id % 9 <> 0")
    after = docs.withColumn("content", F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit("."))).otherwise(F.col("content")))
    return C.snapshot_changes(before, after).groupBy("change").agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey % 40 = 0) ORDER BY 1 LIMIT 50""")
def unmatched_values(spark: SparkSession, sf: str) -> DataFrame:
    """A report of the first 50 expected values that an output lacks."""
    part = table(spark, sf, "part")
    return C.missing_values(part.where("p_partkey % 40 = 0"), part, "p_brand")


@query("""SELECT l_linenumber AS line, round(avg(least(1, greatest(0, (l_discount - 0.1) / (0 - 0.1) + 1e-9))), 6) AS score FROM lineitem GROUP BY ALL""")
def json_range_score(spark: SparkSession, sf: str) -> DataFrame:
    """A range with exchanged bounds scores lower values higher."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("line")).agg(F.round(F.avg(C.range_score(F.col("l_discount"), 0.1, 0.0)), 6).alias("score"))
