"""Queries over the steps, their skills, the clusters of an earlier run, and agent logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import table
from millrace.functions import scalars as S
from millrace.operators import corpus as K
from millrace.operators import graph as G
from millrace.plans.define import Collector

query = Collector()
QUERIES, SQL = query.queries, query.sql

SKILLS_SQL = """r AS (SELECT DISTINCT example_id, skills FROM steps WHERE example_id IS NOT NULL AND skills IS NOT NULL), p AS (SELECT example_id, k - 1 AS position, skills[k] AS s FROM r, unnest(range(1, len(skills) + 1)) AS t(k)),
x AS (SELECT DISTINCT example_id, position, skill FROM (SELECT example_id, position, unnest(s) AS skill FROM p WHERE s IS NOT NULL) WHERE skill IS NOT NULL)"""

RULES = [("streaming", r"(?i)\b(stream|real.?time)", None), ("plotting", r"(?i)\b(plot|chart|histogram)", r"(?i)\bover time\b"), ("joining", r"(?i)\bjoin\b", None)]


def _skills(spark: SparkSession, sf: str) -> DataFrame:
    return K.step_skills(table(spark, sf, "steps"))


@query(f"WITH {SKILLS_SQL} SELECT skill, count(*) AS steps, count(DISTINCT example_id) AS examples FROM x GROUP BY ALL")
def skill_step_index(spark: SparkSession, sf: str) -> DataFrame:
    """How many steps and examples each skill is found in."""
    return _skills(spark, sf).groupBy("skill").agg(F.count("*").alias("steps"), F.count_distinct("example_id").alias("examples"))


@query(f"""WITH {SKILLS_SQL}, k AS (SELECT example_id, skill, dense_rank() OVER (PARTITION BY example_id ORDER BY position) AS rk FROM x) SELECT a.skill AS src, b.skill AS dst, count(*) AS weight FROM k a JOIN k b ON a.example_id = b.example_id AND b.rk = a.rk + 1 AND a.skill <> b.skill GROUP BY ALL""")
def consecutive_skill_edges(spark: SparkSession, sf: str) -> DataFrame:
    return K.consecutive_pairs(_skills(spark, sf))


@query(f"""WITH {SKILLS_SQL}, n AS (SELECT example_id, max(position) + 1 AS n FROM x GROUP BY ALL) SELECT DISTINCT skill FROM x JOIN n USING (example_id) WHERE position < greatest(1, floor(n * 0.1))""")
def candidate_root_skills(spark: SparkSession, sf: str) -> DataFrame:
    return K.early_skills(_skills(spark, sf))


@query(f"""WITH {SKILLS_SQL}, u AS (SELECT skill AS id, count(*) AS uses FROM x GROUP BY ALL) SELECT id, round(sqrt(CAST(weight AS DOUBLE)) / (1 + coalesce(uses, 0)), 8) AS weight FROM skills LEFT JOIN u USING (id) WHERE weight IS NOT NULL""")
def coverage_feedback(spark: SparkSession, sf: str) -> DataFrame:
    """Weights flattened by a temperature of two and lowered by use."""
    uses = _skills(spark, sf).groupBy(F.col("skill").alias("id")).agg(F.count("*").alias("uses"))
    nodes = table(spark, sf, "skills").where("weight is not null").select("id", "weight").join(uses, "id", "left")
    return G.tempered(nodes, "weight", "uses").select("id", F.round("weight", 8).alias("weight"))


@query("""WITH m AS (SELECT graph_id, unnest(list_distinct(cluster)) AS m FROM step_clusters) SELECT graph_id, count(*) AS members, count(DISTINCT split_part(m, '-', 1) || '-' || split_part(m, '-', 2)) AS sources FROM m WHERE m IS NOT NULL GROUP BY ALL""")
def cluster_source_counts(spark: SparkSession, sf: str) -> DataFrame:
    return K.source_counts(table(spark, sf, "step_clusters"))


@query("""SELECT name, count(*) AS members, min(m) AS first FROM (SELECT DISTINCT lower(trim(name)) AS name, m FROM (SELECT name, unnest(cluster) AS m FROM step_clusters WHERE name IS NOT NULL) WHERE m IS NOT NULL) GROUP BY ALL""")
def clusters_merged_by_name(spark: SparkSession, sf: str) -> DataFrame:
    merged = K.merged_by_name(table(spark, sf, "step_clusters"))
    return merged.select("name", F.size("members").cast("bigint").alias("members"), F.element_at("members", 1).alias("first"))


@query("""WITH n AS (SELECT parent, name, len(list_filter(regexp_split_to_array(name, '[\\s\\-_/&]+'), lambda x: x <> '')) AS w FROM skills WHERE name IS NOT NULL AND parent IS NOT NULL) SELECT parent, arg_min(name, (w, length(name), name)) AS representative FROM n GROUP BY ALL""")
def shortest_representative(spark: SparkSession, sf: str) -> DataFrame:
    return K.shortest_name(table(spark, sf, "skills").where("parent is not null"), "parent", "name")


@query("""SELECT id, regexp_matches(name, '(?i)\\b(stream|real.?time)') AS streaming, regexp_matches(name, '(?i)\\b(plot|chart|histogram)') AND NOT regexp_matches(name, '(?i)\\bover time\\b') AS plotting, regexp_matches(name, '(?i)\\bjoin\\b') AS joining FROM skills WHERE name IS NOT NULL""")
def rule_table_predicate(spark: SparkSession, sf: str) -> DataFrame:
    """Skills by a short list of rules with exemptions."""
    s = table(spark, sf, "skills").where("name is not null")
    hit = s.select("id", K.matching_rules(s, RULES, "name").alias("r"))
    return hit.select("id", *(F.array_contains("r", name).alias(name) for name, _, _ in RULES))


@query("""WITH s AS (SELECT id, list_distinct(list_filter(regexp_split_to_array(lower(description), '[^\\p{L}\\p{N}]+'), lambda x: x NOT IN ('', 'and', 'or', 'the', 'a', 'an', 'of', 'for', 'in', 'on', 'with', 'to'))) AS d,
list_distinct(list_filter(regexp_split_to_array(lower(name), '[^\\p{L}\\p{N}]+'), lambda x: x NOT IN ('', 'and', 'or', 'the', 'a', 'an', 'of', 'for', 'in', 'on', 'with', 'to'))) AS n FROM skills)
SELECT id, coalesce(len(list_intersect(d, n)) / nullif(len(d), 0) >= 0.5, false) AS repeats FROM s""")
def low_quality_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "skills").select("id", K.repeats_name(F.col("name"), F.col("description"), 0.5).alias("repeats"))


@query("""SELECT coalesce(source, 'all') AS source, count(*) AS tasks, round(avg(CASE WHEN text IS NOT NULL THEN coalesce(n_chars, 0) / 1000.0 ELSE 0 END), 6) AS score, round(avg(CASE WHEN text IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS finished FROM documents GROUP BY ROLLUP (source)""")
def mean_scores_by_domain(spark: SparkSession, sf: str) -> DataFrame:
    """Means by domain with a grand total; a missing text is an unfinished task."""
    results = table(spark, sf, "documents").select("source", (F.col("n_chars") / 1000.0).alias("score"), F.col("text").isNotNull().alias("finished"))
    return K.mean_scores(results, "source").select("source", "tasks", F.round("score", 6).alias("score"), F.round("finished", 6).alias("finished"))


@query("""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE source = 'agent_log' AND text IS NOT NULL), a AS (SELECT regexp_extract(line, '^\\s*(?:Action:\\s*)?([A-Za-z_]\\w*)\\((.*)\\)\\s*$', 1) AS name FROM l WHERE starts_with(line, 'Action:'))
SELECT name, count(*) AS n FROM a WHERE name <> '' GROUP BY ALL""")
def action_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Actions in agent logs by name."""
    logs = table(spark, sf, "documents").where("source = 'agent_log' and text is not null")
    line = logs.select(F.explode(F.split("text", "\n", -1)).alias("line")).where(F.startswith(F.col("line"), F.lit("Action:")))
    return line.select(K.action(F.col("line"))["name"].alias("name")).where("name is not null").groupBy("name").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE source = 'agent_log' AND text IS NOT NULL) SELECT CASE WHEN contains(line, 'executed successfully. No output.') THEN 'execution succeeded' WHEN starts_with(line, 'Failed to parse action from your response,') THEN 'action parse failed'
WHEN starts_with(line, 'ERROR:') OR contains(line, 'Traceback (') OR starts_with(line, 'bash: -c: line ') OR contains(line, 'Error: ') THEN 'error message' WHEN contains(line, 'Warning:') THEN 'warning message' ELSE 'standard output' END AS class, count(*) AS n FROM l WHERE starts_with(line, 'Observation:') GROUP BY ALL""")
def observation_classes(spark: SparkSession, sf: str) -> DataFrame:
    logs = table(spark, sf, "documents").where("source = 'agent_log' and text is not null")
    line = logs.select(F.explode(F.split("text", "\n", -1)).alias("line")).where(F.startswith(F.col("line"), F.lit("Observation:")))
    return line.groupBy(K.observation_class(F.col("line")).alias("class")).agg(F.count("*").alias("n"))


@query("""SELECT lang, count(*) AS documents, CAST(sum(len(regexp_extract_all(text, '```')) // 2) AS BIGINT) AS blocks, CAST(sum(len(list_filter(string_split(text, chr(10)), lambda x: starts_with(ltrim(x), 'df[')))) AS BIGINT) AS frame_lines FROM documents WHERE text IS NOT NULL GROUP BY ALL""")
def code_blocks_by_language(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").where("text is not null")
    blocks = F.floor(F.size(F.regexp_extract_all("text", F.lit("```"), F.lit(0))) / 2)
    frames = F.size(F.filter(F.split("text", "\n", -1), lambda x: F.startswith(F.ltrim(x), F.lit("df["))))
    return t.groupBy("lang").agg(F.count("*").alias("documents"), F.sum(blocks).alias("blocks"), F.sum(frames).alias("frame_lines"))


_FILES = "[a-z]+_[a-z]+[.]csv"


@query(f"""WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{_FILES}')) AS name FROM test_items WHERE text IS NOT NULL), d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '{_FILES}')) AS name FROM documents WHERE text IS NOT NULL)
SELECT doc_id, count(*) AS mentioned FROM d JOIN n USING (name) GROUP BY ALL""")
def file_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that name a file of the test items: an equality join of names instead of a search for each."""
    found = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_FILES), F.lit(0)))).alias("name")
    names = table(spark, sf, "test_items").where("text is not null").select(found).distinct()
    return table(spark, sf, "documents").where("text is not null").select("doc_id", found).join(names, "name").groupBy("doc_id").agg(F.count("*").alias("mentioned"))


@query("""WITH p AS (SELECT n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT a, b, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 100 ELSE 100.0 * (1 - levenshtein(a, b) / greatest(length(a), length(b))) END, 6) AS ratio FROM p""")
def fuzzy_ratio(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return p.select(F.col("n_name").alias("a"), F.col("r_name").alias("b"), F.round(S.similarity_ratio(F.col("n_name"), F.col("r_name")), 6).alias("ratio"))


def _family_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS family, count(*) FILTER (regexp_matches(text, '{pattern}')) AS documents FROM documents" for name, pattern in K.ALGORITHM_FAMILIES)


@query(_family_sql())
def algorithm_families(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents name an algorithm of each family, in one pass."""
    counted = table(spark, sf, "documents").agg(*(F.count_if(F.col("text").rlike(p)).alias(name) for name, p in K.ALGORITHM_FAMILIES))
    return counted.unpivot([], [name for name, _ in K.ALGORITHM_FAMILIES], "family", "documents")


@query()
def name_covers(spark: SparkSession, sf: str) -> DataFrame:
    """Names of clusters and the shorter names that cover them, by word stems; a stemmer has no SQL."""
    return K.name_covers(table(spark, sf, "step_clusters").select("name"), "name", 1.0)
