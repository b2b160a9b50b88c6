"""Graphs of event types and of the hierarchy of skills; embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import table
from millrace.operators import graph as G
from millrace.operators import joins, vectors
from millrace.plans.define import Collector

query = Collector()
QUERIES, SQL = query.queries, query.sql

EDGES_SQL = "m AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), e AS (SELECT src, dst, count(*) AS weight FROM m WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL)"


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.adjacency(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type")


@query(f"WITH {EDGES_SQL} SELECT * FROM e")
def adjacency_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf)


@query(f"WITH {EDGES_SQL} SELECT src, dst, round(weight / max(weight) OVER (), 8) AS weight_norm FROM e")
def edge_weights_norm(spark: SparkSession, sf: str) -> DataFrame:
    return G.normalised(_edges(spark, sf)).select("src", "dst", F.round("weight_norm", 8).alias("weight_norm"))


@query(f"""WITH {EDGES_SQL}, b AS (SELECT src, dst, CAST(length(src) * length(dst) AS BIGINT) AS weight FROM e WHERE src < dst)
SELECT src, dst, round(0.95 * e.weight + 0.05 * coalesce(b.weight, 0) * (SELECT sum(weight) FROM e) / (SELECT sum(weight) FROM b), 6) AS weight FROM e LEFT JOIN b USING (src, dst)""")
def blended_weights(spark: SparkSession, sf: str) -> DataFrame:
    e = _edges(spark, sf)
    other = e.where("src < dst").select("src", "dst", (F.length("src") * F.length("dst")).cast("bigint").alias("weight"))
    return G.blended(e, other, ["src", "dst"], 0.95).withColumn("weight", F.round("weight", 6))


@query("""WITH s AS (SELECT DISTINCT s AS skill FROM (SELECT unnest(flatten(list_filter(skills, lambda x: x IS NOT NULL))) AS s FROM steps WHERE skills IS NOT NULL) WHERE s IS NOT NULL)
SELECT count(*) AS skills, count(s.skill) AS covered, round(avg(CASE WHEN s.skill IS NULL THEN 0.0 ELSE 1.0 END), 6) AS ratio FROM skills k LEFT JOIN s ON s.skill = k.id""")
def coverage_ratio(spark: SparkSession, sf: str) -> DataFrame:
    used = table(spark, sf, "steps").select(F.explode(F.flatten(F.filter("skills", lambda x: x.isNotNull()))).alias("id")).where("id is not null").distinct().withColumn("hit", F.lit(1))
    k = table(spark, sf, "skills").select("id").join(used, "id", "left")
    return k.agg(F.count("*").alias("skills"), F.count("hit").alias("covered"), F.round(F.avg(F.coalesce("hit", F.lit(0)).cast("double")), 6).alias("ratio"))


@query("""WITH q AS (SELECT quantile_cont(weight, 0.3) AS q FROM skills WHERE weight IS NOT NULL) SELECT id, weight FROM skills, q WHERE weight <= q""")
def rare_nodes_p30(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "skills").where("weight is not null")
    q = s.agg(F.percentile("weight", F.lit(0.3)).alias("q"))
    return s.crossJoin(F.broadcast(q)).where("weight <= q").select("id", "weight")  # one row


@query(f"""WITH {EDGES_SQL}, n AS (SELECT src, dst, weight / max(weight) OVER () AS w FROM e), p(path, k, a, b) AS (VALUES ('p1', 1, 'view', 'click'), ('p1', 2, 'click', 'purchase'), ('p2', 1, 'signup', 'view'), ('p2', 2, 'view', 'missing'))
SELECT path AS walk, round(avg(coalesce(w, 0)), 8) AS coherence FROM p LEFT JOIN n ON a = src AND b = dst GROUP BY ALL""")
def path_coherence(spark: SparkSession, sf: str) -> DataFrame:
    paths = spark.createDataFrame([("p1", ["view", "click", "purchase"]), ("p2", ["signup", "view", "missing"])], "walk string, path array<string>")
    return G.path_coherence(paths, _edges(spark, sf), "walk", "path").select("walk", F.round("coherence", 8).alias("coherence"))


@query("""WITH RECURSIVE t AS (SELECT id AS node, 0 AS depth FROM skills WHERE parent IS NULL UNION ALL SELECT s.id, t.depth + 1 FROM skills s JOIN t ON s.parent = t.node) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM t GROUP BY ALL""")
def bfs_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Depth of each skill below the skills without a parent."""
    s = table(spark, sf, "skills")
    edges = s.where("parent is not null").select(F.col("parent").alias("src"), F.col("id").alias("dst"))
    return G.depths(edges, s.where("parent is null").select(F.col("id").alias("node")))


_PR_ROUND = """r{i} AS (SELECT n.node, 0.15 / c.n + 0.85 * (coalesce(sum(p.rank / d.degree), 0) + coalesce(max(l.lost), 0) / c.n) AS rank FROM n CROSS JOIN c LEFT JOIN e ON e.dst = n.node LEFT JOIN r{j} p ON p.node = e.src LEFT JOIN d ON d.src = e.src
CROSS JOIN (SELECT coalesce(sum(rank), 0) AS lost FROM r{j} WHERE node NOT IN (SELECT src FROM d)) l GROUP BY n.node, c.n)"""
_PR = ", ".join(_PR_ROUND.format(i=i, j=i - 1) for i in range(1, 11))


@query(f"""WITH e AS (SELECT DISTINCT parent AS src, id AS dst FROM skills WHERE parent IS NOT NULL), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), c AS (SELECT count(*) AS n FROM n), d AS (SELECT src, count(*) AS degree FROM e GROUP BY ALL),
r0 AS (SELECT node, 1.0 / c.n AS rank FROM n, c), {_PR} SELECT node, round(rank, 8) AS rank FROM r10""")
def pagerank_10(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "skills").where("parent is not null").select(F.col("parent").alias("src"), F.col("id").alias("dst"))
    return G.page_rank(s, 10).select("node", F.round("rank", 8).alias("rank"))


@query()
def greedy_cover(spark: SparkSession, sf: str) -> DataFrame:
    """Fewest examples, greedily, that cover all skills of the steps; each pick depends on the one before."""
    sets = table(spark, sf, "steps").where("example_id is not null and skills is not null").groupBy("example_id").agg(F.first(F.flatten(F.filter("skills", lambda x: x.isNotNull()))).alias("s"))
    return G.greedy_cover(sets, "example_id", "s")


@query("""WITH c AS (SELECT table_name AS t, column_name AS c FROM (VALUES ('examples', 'example_id'), ('examples', 'id'), ('examples', 'answer_id'), ('examples', 'title'), ('steps', 'example_id'), ('steps', 'id'), ('steps', 'answer_id'), ('skills', 'id'), ('documents', 'title')) v(table_name, column_name))
SELECT a.t AS first, b.t AS second, string_agg(a.c, ',' ORDER BY a.c) AS keys FROM c a JOIN c b ON a.c = b.c AND a.t < b.t GROUP BY ALL""")
def joinable_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Columns that two tables share, from their schemas."""
    wanted = {"example_id", "id", "answer_id", "title"}
    rows = [(t, c) for t in ("examples", "steps", "skills", "documents") for c in table(spark, sf, t).columns if c in wanted]
    c = spark.createDataFrame(rows, "t string, c string")
    pairs = c.withColumnRenamed("t", "first").join(c.withColumnRenamed("t", "second"), "c").where("first < second")
    return pairs.groupBy("first", "second").agg(F.array_join(F.array_sort(F.collect_set("c")), ",").alias("keys"))


@query("""WITH RECURSIVE s AS (SELECT id, list_distinct(list_filter(regexp_split_to_array(lower(name), '[\\s\\-_/&]+'), lambda x: x <> '')) AS w FROM skills WHERE name IS NOT NULL),
p AS (SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.id <> b.id WHERE len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) >= 0.6),
r AS (SELECT a AS node, a AS other FROM p UNION SELECT r.node, p.b FROM r JOIN p ON r.other = p.a) SELECT node, min(other) AS component FROM r GROUP BY ALL""")
def name_components(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of skills joined by names that cover each other."""
    words = F.filter(F.split(F.lower("name"), r"[\s\-_/&]+"), lambda x: x != "")
    pairs = joins.overlap_pairs(table(spark, sf, "skills").where("name is not null").select("id", words.alias("w")), "id", "w", 0.6)
    return G.components(pairs, "a", "b")


@query()
def skill_walks(spark: SparkSession, sf: str) -> DataFrame:
    """Seeded self-avoiding walks over the event types."""
    starts = table(spark, sf, "nation").select(F.col("n_nationkey").alias("walk"), F.lit("view").alias("node"))
    return G.random_walks(_edges(spark, sf), starts, 4, seed=3)


@query()
def weighted_skill_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A sampling operator: twenty skills without replacement, by weight."""
    return G.weighted_sample(table(spark, sf, "skills").where("weight is not null"), F.col("weight"), 20, "id", seed=5).select("id", "weight")


# embeddings


@query("""WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), p AS (SELECT a.vec_id, a.label, sum(1 - list_cosine_similarity(a.v, b.v)) AS d FROM u a JOIN u b ON a.label = b.label GROUP BY ALL)
SELECT label, arg_min(vec_id, (round(d, 6), vec_id)) AS medoid FROM p GROUP BY ALL""")
def medoid_per_label(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.medoids(table(spark, sf, "embeddings"), "vec_id", "label", "embedding")


@query("""WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT a.vec_id, round(sum(CASE WHEN a.vec_id <> b.vec_id THEN list_cosine_similarity(a.v, b.v) ELSE 0 END) / nullif(count(*) - 1, 0), 6) AS similarity FROM u a JOIN u b ON a.label = b.label GROUP BY ALL""")
def mean_similarity(spark: SparkSession, sf: str) -> DataFrame:
    s = vectors.similarity_to_group(table(spark, sf, "embeddings"), "vec_id", "label", "embedding")
    return s.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("""WITH c AS (SELECT label, k, avg(CAST(embedding[k] AS DOUBLE)) AS m FROM embeddings, unnest(range(1, 65)) AS t(k) GROUP BY ALL)
SELECT e.vec_id, round(sqrt(sum(pow(CAST(e.embedding[c.k] AS DOUBLE) - c.m, 2))), 6) AS distance FROM embeddings e JOIN c USING (label) GROUP BY ALL""")
def centroid_distance(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    means = vectors.vector_sums(e, "label", "v").select("label", F.transform("total", lambda x: x / F.col("n")).alias("m"))
    gap = F.aggregate(F.zip_with("v", "m", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return e.join(means, "label").select("vec_id", F.round(F.sqrt(gap), 6).alias("distance"))


@query("""WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), p AS (SELECT a.vec_id AS q, b.vec_id AS n, list_cosine_similarity(a.v, b.v) AS c FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(c, 9) DESC, n) AS k FROM p) SELECT q AS query, n AS neighbour, CAST(k AS INTEGER) AS rank, round(c, 6) AS cosine FROM r WHERE k <= 5""")
def cosine_pairs_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 50, among all."""
    e = table(spark, sf, "embeddings")
    return vectors.nearest(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 5).select("query", "neighbour", "rank", F.round("cosine", 6).alias("cosine"))


@query("""WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), s AS (SELECT vec_id, label, v, list_dot_product(v, v) AS q FROM u),
g AS (SELECT label AS other, count(*) AS n, avg(q) AS q FROM s GROUP BY ALL), m AS (SELECT label AS other, list(m ORDER BY k) AS m FROM (SELECT label, k, avg(v[k]) AS m FROM s, unnest(range(1, 65)) AS t(k) GROUP BY ALL) GROUP BY ALL),
d AS (SELECT s.vec_id, s.label, g.other, g.n, greatest(0, s.q + g.q - 2 * list_dot_product(s.v, m.m)) AS d FROM s, g JOIN m USING (other)),
a AS (SELECT vec_id, label, max(CASE WHEN other = label AND n > 1 THEN d * n / (n - 1) END) AS a, min(CASE WHEN other <> label THEN d END) AS b FROM d GROUP BY ALL)
SELECT label, round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM a GROUP BY ALL""")
def silhouette_by_label(spark: SparkSession, sf: str) -> DataFrame:
    s = vectors.silhouette(table(spark, sf, "embeddings"), "vec_id", "label", "embedding")
    return s.groupBy("label").agg(F.round(F.avg("silhouette"), 6).alias("silhouette"))


def _features(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return table(spark, sf, "embeddings").select("vec_id", "label", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))


@query()
def kmeans_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Ten clusters of the embeddings, each with its dominant label."""
    from pyspark.ml.clustering import KMeans

    x = _features(spark, sf)
    assigned = KMeans(k=10, seed=1, maxIter=20).fit(x).transform(x).groupBy("prediction", "label").agg(F.count("*").alias("n"))
    return assigned.groupBy("prediction").agg(F.sum("n").alias("members"), F.max_by("label", F.struct("n", (-F.col("label")).alias("l"))).alias("dominant"))


@query()
def pca_explained(spark: SparkSession, sf: str) -> DataFrame:
    """Share of variance of the first five components."""
    from pyspark.ml.feature import PCA

    model = PCA(k=5, inputCol="features", outputCol="out").fit(_features(spark, sf))
    return spark.createDataFrame([(k + 1, float(v)) for k, v in enumerate(model.explainedVariance)], "component int, share double")


@query()
def logistic_returns(spark: SparkSession, sf: str) -> DataFrame:
    """A logistic model of returns on numbers of the item, with its AUC."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from millrace.operators.risk import ks_auc

    item = table(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    x = VectorAssembler(inputCols=item.columns[1:], outputCol="x").transform(item)
    scored = LogisticRegression(featuresCol="x", labelCol="y", maxIter=10).fit(x).transform(x)
    p = scored.select("y", F.round(vector_to_array("probability")[1], 4).alias("p"))
    return ks_auc(p, "p", "y")


@query()
def frequent_combinations(spark: SparkSession, sf: str) -> DataFrame:
    """Sets of skills that occur together in at least one of fifty examples."""
    from pyspark.ml.fpm import FPGrowth

    baskets = table(spark, sf, "steps").where("skills is not null").select(F.array_distinct(F.filter(F.flatten(F.filter("skills", lambda x: x.isNotNull())), lambda s: s.isNotNull())).alias("items")).where("size(items) > 0")
    found = FPGrowth(itemsCol="items", minSupport=0.02).fit(baskets).freqItemsets
    return found.where("size(items) > 1").select(F.array_join(F.array_sort("items"), "|").alias("items"), "freq")


@query("""WITH g AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY ALL), m AS (SELECT avg(v) AS m, stddev_samp(v) AS s FROM g) SELECT count(*) AS customers, count(*) FILTER (abs(v - m) > 2 * s) AS anomalies FROM g, m""")
def anomaly_zscores(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"))
    m = g.agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    return g.crossJoin(F.broadcast(m)).agg(F.count("*").alias("customers"), F.count_if(F.abs(F.col("v") - F.col("m")) > 2 * F.col("s")).alias("anomalies"))  # one row
