"""Queries on lookups, coverage, selections, multi-class scores and tests of association."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.catalog import table
from millrace.operators import compare, graph, risk, scoring
from millrace.operators.reshape import global_rank
from millrace.plans.define import Collector

query = Collector()
QUERIES, SQL = query.queries, query.sql

_CLASSES = ("A", "N", "R")
_CELLS = """s AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_returnflag AS flag, CAST(l_quantity AS DOUBLE) AS a, l_linenumber * 10.0 AS n, 60.0 - l_quantity AS r FROM lineitem),
c AS (SELECT id, cls, CAST(flag = cls AS INTEGER) AS gold, CAST(CASE cls WHEN 'A' THEN a WHEN 'N' THEN n ELSE r END / (a + n + r) AS DOUBLE) AS p FROM s, (VALUES ('A'), ('N'), ('R')) AS k(cls))"""


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    """``(id, cls, gold, p)``: a made-up probability of each return flag for each line item."""
    item = table(spark, sf, "lineitem")
    a, n = F.col("l_quantity").cast("double"), F.col("l_linenumber") * 10.0
    r = 60.0 - a
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("cls"), (F.col("l_returnflag") == c).cast("int").alias("gold"), (x / (a + n + r)).alias("p")) for c, x in zip(_CLASSES, (a, n, r), strict=True))))
    return item.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), cells.alias("x")).select("id", "x.*")


@query(f"""WITH {_CELLS}, g AS (SELECT cls, count(*) AS n, sum(log2(least(1 - 1e-15, greatest(1e-15, p)))) AS l FROM c WHERE gold = 1 GROUP BY cls)
SELECT round(-sum(l) / sum(n) / 2, 8) AS per_row, round(-sum(l / n) / 2, 8) AS per_class FROM g""")
def halved_log_losses(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.halved_log_losses(_cells(spark, sf), "cls", "gold", "p").select(F.round("per_row", 8).alias("per_row"), F.round("per_class", 8).alias("per_class"))


@query(f"""WITH {_CELLS}, k AS (SELECT cls, gold, rank() OVER (PARTITION BY cls ORDER BY p) + (count(*) OVER (PARTITION BY cls, p) - 1) / 2.0 AS r FROM c),
g AS (SELECT cls, sum(gold) AS n1, count(*) - sum(gold) AS n0, sum(CASE WHEN gold = 1 THEN r ELSE 0 END) AS s FROM k GROUP BY cls)
SELECT cls, round((s - n1 * (n1 + 1) / 2.0) / (n1 * n0), 8) AS auc FROM g""")
def one_vs_rest_auc(spark: SparkSession, sf: str) -> DataFrame:
    return risk.ks_auc(_cells(spark, sf), "p", "gold", ["cls"]).select("cls", F.round("auc", 8).alias("auc"))


@query(f"""WITH {_CELLS} SELECT cls, CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(p), 8) AS claimed, round(avg(gold), 8) AS observed, round(avg((p - gold) * (p - gold)), 8) AS brier FROM c GROUP BY ALL""")
def calibration_by_class(spark: SparkSession, sf: str) -> DataFrame:
    """Claimed and observed shares in ten bins of the probability, with the Brier score of each."""
    p, gold = F.col("p"), F.col("gold")
    by = _cells(spark, sf).groupBy("cls", F.least(F.floor(p * 10), F.lit(9)).cast("bigint").alias("bin"))
    return by.agg(F.count("*").alias("n"), F.round(F.avg(p), 8).alias("claimed"), F.round(F.avg(gold), 8).alias("observed"), F.round(F.avg((p - gold) * (p - gold)), 8).alias("brier"))


@query("""WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem GROUP BY ALL), a AS (SELECT a, sum(o) AS na FROM c GROUP BY a), b AS (SELECT b, sum(o) AS nb FROM c GROUP BY b),
t AS (SELECT sum(o) AS n FROM c), g AS (SELECT coalesce(o, 0) AS o, CAST(na AS DOUBLE) * nb / n AS e FROM a CROSS JOIN b CROSS JOIN t LEFT JOIN c USING (a, b))
SELECT round(sum((o - e) * (o - e) / e), 6) AS chi2, (SELECT count(*) - 1 FROM a) * (SELECT count(*) - 1 FROM b) AS df FROM g""")
def chi_squared_flag_status(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.chi_squared(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus").select(F.round("chi2", 6).alias("chi2"), "df")


@query("""WITH g AS (SELECT o_orderpriority AS p, avg(o_totalprice) FILTER (o_orderstatus = 'F') - avg(o_totalprice) FILTER (o_orderstatus = 'O') AS d,
 var_samp(o_totalprice) FILTER (o_orderstatus = 'F') / count(*) FILTER (o_orderstatus = 'F') + var_samp(o_totalprice) FILTER (o_orderstatus = 'O') / count(*) FILTER (o_orderstatus = 'O') AS v FROM orders GROUP BY p)
SELECT round(sum(d / v) / sum(1 / v), 4) AS effect, round(sqrt(1 / sum(1 / v)), 4) AS std_err, count(*) AS studies FROM g""")
def meta_effect_of_status(spark: SparkSession, sf: str) -> DataFrame:
    """The effect of all priorities together, weighted by the inverse of each one's variance."""
    found = scoring.meta_effect(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", "F", "O", "o_totalprice")
    return found.select(F.round("effect", 4).alias("effect"), F.round("std_err", 4).alias("std_err"), "studies")


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS v FROM orders GROUP BY m), r AS (SELECT v / lag(v) OVER (ORDER BY m) - 1 AS r FROM m)
SELECT round(stddev_samp(r) * sqrt(12), 6) AS volatility, round(avg(r) / stddev_samp(r) * sqrt(12), 6) AS sharpe FROM r""")
def volatility_and_sharpe(spark: SparkSession, sf: str) -> DataFrame:
    months = table(spark, sf, "orders").groupBy(F.trunc("o_orderdate", "month").alias("m")).agg(F.sum("o_totalprice").alias("v"))
    # one row a month
    r = months.select((F.col("v") / F.lag("v").over(W.partitionBy(F.lit(0)).orderBy("m")) - 1).alias("r"))
    spread = F.stddev_samp("r")
    return r.agg(F.round(spread * 12**0.5, 6).alias("volatility"), F.round(F.avg("r") / spread * 12**0.5, 6).alias("sharpe"))


@query("""SELECT o_orderkey, nth_value(o_totalprice, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_price FROM orders""")
def second_price_of_customer(spark: SparkSession, sf: str) -> DataFrame:
    every = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return table(spark, sf, "orders").select("o_orderkey", F.nth_value("o_totalprice", 2).over(every).alias("second_price"))


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderstatus = 'F' AS INTEGER) DESC, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END, CASE WHEN o_orderstatus <> 'F' THEN -o_totalprice END, o_orderkey) AS k FROM orders)
SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS finished FROM k WHERE k = 1""")
def first_finished_else_best(spark: SparkSession, sf: str) -> DataFrame:
    """The first finished order of each customer, or the largest one where none is finished."""
    done = F.col("o_orderstatus") == "F"
    rank = F.struct((~done).alias("a"), F.when(done, F.col("o_orderdate")).alias("b"), F.when(~done, -F.col("o_totalprice")).alias("c"), F.col("o_orderkey").alias("d"))
    best = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min(rank).alias("r"))
    return best.select("o_custkey", F.col("r.d").alias("o_orderkey"), (~F.col("r.a")).alias("finished"))


@query("""WITH e AS (SELECT o_custkey AS src, l_suppkey AS dst, count(*) AS weight FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), m AS (SELECT *, max(weight) OVER (PARTITION BY src) AS top FROM e)
SELECT src, dst, weight FROM m WHERE weight >= 3 OR top < 3""")
def heavy_edges_or_all(spark: SparkSession, sf: str) -> DataFrame:
    sales = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = sales.groupBy(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.count("*").alias("weight"))
    return graph.heavy_edges(edges, "src", "weight", 3)


_SKILLS = """d AS (SELECT DISTINCT example_id, steps, skills FROM steps WHERE skills IS NOT NULL AND example_id IS NOT NULL), l AS (SELECT example_id, unnest(skills) AS inner_skills, generate_subscripts(skills, 1) AS k FROM d),
x AS (SELECT example_id, k, unnest(inner_skills) AS skill FROM l WHERE inner_skills IS NOT NULL)"""


def _step_skills(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "steps").where("example_id is not null").select("example_id", F.posexplode("skills").alias("k", "inner"))
    return rows.select("example_id", (F.col("k") + 1).alias("k"), F.explode("inner").alias("skill"))


@query(f"""WITH {_SKILLS} SELECT example_id, skill, max(k) AS last_step FROM x WHERE skill IS NOT NULL GROUP BY ALL""")
def last_step_of_skill(spark: SparkSession, sf: str) -> DataFrame:
    return _step_skills(spark, sf).where("skill is not null").groupBy("example_id", "skill").agg(F.max("k").alias("last_step"))


@query(f"""WITH {_SKILLS}, used AS (SELECT DISTINCT skill FROM x WHERE k = 1) SELECT id, weight FROM skills WHERE id NOT IN (SELECT skill FROM used WHERE skill IS NOT NULL)""")
def skills_no_example_begins_with(spark: SparkSession, sf: str) -> DataFrame:
    used = _step_skills(spark, sf).where("k = 1").select(F.col("skill").alias("id")).distinct()
    return table(spark, sf, "skills").join(used, "id", "left_anti").select("id", "weight")


@query("""SELECT s.id, count(c.graph_id) AS clusters FROM skills s LEFT JOIN step_clusters c ON lower(trim(c.name)) = lower(trim(s.name)) GROUP BY s.id""")
def clusters_named_as_skill(spark: SparkSession, sf: str) -> DataFrame:
    """How many clusters carry a skill's name, whatever its case."""
    plain = lambda c: F.lower(F.trim(c))
    named = table(spark, sf, "step_clusters").groupBy(plain(F.col("name")).alias("n")).agg(F.count("graph_id").alias("c"))
    skills = table(spark, sf, "skills").select("id", plain(F.col("name")).alias("n"))
    return skills.join(named, "n", "left").groupBy("id").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("clusters"))


@query("""WITH s AS (SELECT graph_id, len(list_distinct(cluster)) AS size FROM step_clusters) SELECT graph_id, size, row_number() OVER (ORDER BY size DESC, graph_id) AS place FROM s WHERE size IS NOT NULL""")
def clusters_largest_first(spark: SparkSession, sf: str) -> DataFrame:
    sized = table(spark, sf, "step_clusters").select("graph_id", F.size(F.array_distinct(F.array_compact("cluster"))).cast("bigint").alias("size")).where("cluster is not null")
    ranked, _ = global_rank(sized.withColumn("less", -F.col("size")), ["less", "graph_id"])
    return ranked.select("graph_id", "size", F.col("rank").alias("place"))


@query("""WITH o AS (SELECT l_orderkey, list(l_suppkey ORDER BY l_linenumber, l_suppkey, l_partkey) || list(l_suppkey ORDER BY l_linenumber DESC, l_suppkey DESC, l_partkey DESC) || list(l_partkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS l FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS keys FROM o""")
def ordered_unique_union(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of an order in the order they first occur in several lists."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey"))).alias("r"))
    joined = F.array_distinct(F.concat("r.l_suppkey", F.reverse("r.l_suppkey"), "r.l_partkey"))
    return lines.select("l_orderkey", F.array_join(joined.cast("array<string>"), ",").alias("keys"))


@query("""WITH e AS (SELECT DISTINCT example_id, tag FROM examples WHERE example_id IS NOT NULL), s AS (SELECT example_id, max(len(steps)) AS n FROM steps GROUP BY example_id),
j AS (SELECT coalesce(tag, '(none)') AS tag, coalesce(n, 0) AS n, s.example_id IS NOT NULL AS extracted FROM e LEFT JOIN s USING (example_id))
SELECT coalesce(tag, '(all)') AS tag, count(*) AS examples, count(*) FILTER (extracted) AS extracted, round(avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END), 6) AS empty_share, round(avg(n), 6) AS mean_steps FROM j GROUP BY ROLLUP (tag)""")
def step_coverage_by_tag(spark: SparkSession, sf: str) -> DataFrame:
    """Examples with and without steps by tag, with a grand total."""
    examples = table(spark, sf, "examples").where("example_id is not null").select("example_id", "tag").distinct()
    steps = table(spark, sf, "steps").groupBy("example_id").agg(F.max(F.when(F.col("steps").isNotNull(), F.size("steps"))).alias("n")).withColumn("here", F.lit(True))
    joined = examples.join(steps, "example_id", "left").select(F.coalesce("tag", F.lit("(none)")).alias("tag"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("here", F.lit(False)).alias("here"))
    rolled = joined.rollup("tag").agg(F.count("*").alias("examples"), F.count_if("here").alias("extracted"), F.round(F.avg((F.col("n") == 0).cast("double")), 6).alias("empty_share"), F.round(F.avg("n"), 6).alias("mean_steps"))
    return rolled.withColumn("tag", F.coalesce("tag", F.lit("(all)")))


_STATES = """l AS (SELECT lower(trim(state)) AS state, avg(total) AS total, avg(non_missing) AS present FROM result_left WHERE state IS NOT NULL GROUP BY ALL), r AS (SELECT lower(trim(state)) AS state, avg(total) AS total, avg(non_missing) AS present FROM result_right WHERE state IS NOT NULL GROUP BY ALL)"""


def _by_state(spark: SparkSession, sf: str, side: str) -> DataFrame:
    rows = table(spark, sf, f"result_{side}").where("state is not null")
    return rows.groupBy(F.lower(F.trim("state")).alias("state")).agg(F.avg("total").alias("total"), F.avg("non_missing").alias("present"))


@query(f"""WITH {_STATES}, g AS (SELECT 'total' AS c, round_even(total / 25, 0) AS v FROM r UNION SELECT 'present', round_even(present / 25, 0) FROM r), p AS (SELECT 'total' AS c, round_even(total / 25, 0) AS v FROM l UNION SELECT 'present', round_even(present / 25, 0) FROM l),
h AS (SELECT g.c, p.c AS o, count(*) AS have FROM g JOIN p USING (v) GROUP BY ALL), n AS (SELECT c, count(*) AS need FROM g GROUP BY c)
SELECT n.c AS "column", coalesce(max(have), 0) = max(need) AS matched FROM n LEFT JOIN h ON h.c = n.c GROUP BY n.c""")
def table_score_unordered_by_step(spark: SparkSession, sf: str) -> DataFrame:
    """Columns given by their places; values within a step of 25 count as one."""
    columns = ["total", "present"]
    left, right = (_by_state(spark, sf, side).select(*columns) for side in ("left", "right"))
    wanted = compare.resolve_columns(right, ["0", 1])
    return compare.score_unordered(left, right, wanted, compare.resolve_tolerances(right, {"0": 25.0, "present": 25.0}))


@query(f"""WITH {_STATES} SELECT 'present' AS "column", bool_and(l.state IS NOT NULL AND r.state IS NOT NULL AND coalesce(abs(l.present - r.present) <= 0.1 * greatest(abs(l.present), abs(r.present)), l.present IS NULL AND r.present IS NULL)) AS matched
FROM l FULL JOIN r USING (state)""")
def table_score_relative(spark: SparkSession, sf: str) -> DataFrame:
    """One column held row by row against the other copy, within a tenth of the larger value."""
    left, right = (_by_state(spark, sf, side).select("state", "present") for side in ("left", "right"))
    return compare.score_ordered(left, right, "state", ["present"], {"present": 0.1})


@query("""WITH l AS (SELECT nationkey, count(*) AS customers FROM (SELECT c_nationkey AS nationkey FROM customer) GROUP BY ALL), r AS (SELECT nationkey, count(*) AS suppliers FROM (SELECT s_nationkey AS nationkey FROM supplier WHERE s_acctbal > 0) GROUP BY ALL)
SELECT nationkey, coalesce(customers > 10 * suppliers, FALSE) AS matched FROM l FULL JOIN r USING (nationkey)""")
def key_union_match(spark: SparkSession, sf: str) -> DataFrame:
    """All keys of either side; a key that one side lacks is no match."""
    left = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("customers"))
    right = table(spark, sf, "supplier").where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("suppliers"))
    return left.join(right, "nationkey", "full").select("nationkey", F.coalesce(F.col("customers") > 10 * F.col("suppliers"), F.lit(False)).alias("matched"))
