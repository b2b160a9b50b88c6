"""Scalar functions and text statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import table
from millrace.functions import scalars as S
from millrace.functions.words import words_column
from millrace.operators import joins
from millrace.operators.text import idf, log_levels, markdown_structure, term_counts
from millrace.plans.define import Collector

query = Collector()
QUERIES, SQL = query.queries, query.sql

DELAY_BINS = [0, 7, 30, 90]


@query("""WITH t AS (SELECT p_partkey, ' $' || CAST(CAST(p_retailprice * 100 AS BIGINT) / 100.0 AS VARCHAR) || ' ' AS s FROM part)
SELECT count(*) AS n, round(sum(try_cast(regexp_replace(trim(s), '[$€£%,\\s]', '', 'g') AS DOUBLE)), 2) AS total FROM t""")
def clean_money_strings(spark: SparkSession, sf: str) -> DataFrame:
    cents = (F.col("p_retailprice") * 100).cast("bigint") / 100.0
    t = table(spark, sf, "part").select(F.concat(F.lit(" $"), cents.cast("string"), F.lit(" ")).alias("s"))
    return t.agg(F.count("*").alias("n"), F.round(F.sum(S.money(F.col("s"))), 2).alias("total"))


@query("""SELECT CASE WHEN isodow(ts) >= 6 THEN 'weekend' ELSE 'weekday' END AS kind, count(*) AS n, round(avg(value), 6) AS mean, count(DISTINCT user_id) AS users FROM events GROUP BY ALL""")
def weekday_weekend_stats(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.weekday("ts") >= 5, "weekend").otherwise("weekday").alias("kind")
    return table(spark, sf, "events").groupBy(kind).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.count_distinct("user_id").alias("users"))


@query("""SELECT hour(ts) AS hour, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY ALL""")
def hour_buckets(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    total = e.agg(F.count("*").alias("t"))
    by = e.groupBy(F.hour("ts").cast("bigint").alias("hour")).agg(F.count("*").alias("n"))
    return by.crossJoin(F.broadcast(total)).select("hour", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))  # t is one row


@query("""SELECT CASE WHEN d < 7 THEN '0-7' WHEN d < 30 THEN '7-30' WHEN d < 90 THEN '30-90' ELSE '90+' END AS delay, count(*) AS n, round(avg(d), 6) AS mean_days FROM (SELECT date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE d >= 0 GROUP BY ALL""")
def delay_bins(spark: SparkSession, sf: str) -> DataFrame:
    days = F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).alias("d")
    d = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(days).where("d >= 0")
    label = F.when(F.col("d") < 7, "0-7").when(F.col("d") < 30, "7-30").when(F.col("d") < 90, "30-90").otherwise("90+")
    return d.groupBy(label.alias("delay")).agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean_days"))


@query("""SELECT CAST(floor(p_size / 10) * 10 AS BIGINT) AS decade, count(*) AS n, round(avg(p_retailprice), 6) AS mean_price FROM part GROUP BY ALL""")
def size_decade_bins(spark: SparkSession, sf: str) -> DataFrame:
    decade = (F.floor(F.col("p_size") / 10) * 10).cast("bigint").alias("decade")
    return table(spark, sf, "part").groupBy(decade).agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 6).alias("mean_price"))


@query("""SELECT CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY ALL""")
def json_prop_extract(spark: SparkSession, sf: str) -> DataFrame:
    k = F.from_json("props", "k BIGINT")["k"]
    return table(spark, sf, "events").select((k % 10).alias("k")).where("k is not null").groupBy("k").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT s_suppkey AS k, (s_suppkey % 90) AS la, (s_suppkey % 180) AS lo FROM supplier) SELECT k, round(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(48.0 - la) / 2), 2) + cos(radians(la)) * cos(radians(48.0)) * pow(sin(radians(11.0 - lo) / 2), 2)))), 4) AS km FROM p""")
def haversine_distance(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    km = S.haversine((k % 90).cast("double"), (k % 180).cast("double"), F.lit(48.0), F.lit(11.0))
    return table(spark, sf, "supplier").select(k.alias("k"), F.round(km, 4).alias("km"))


@query("""SELECT regexp_replace(s_name, '\\d+', '{N}', 'g') AS pattern, count(*) AS members, min(s_name) AS first, max(s_name) AS last FROM supplier GROUP BY ALL""")
def pattern_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").groupBy(S.digits_as_hole(F.col("s_name")).alias("pattern")).agg(F.count("*").alias("members"), F.min("s_name").alias("first"), F.max("s_name").alias("last"))


@query("""SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 2500 THEN 'low' WHEN c_acctbal < 7500 THEN 'mid' ELSE 'high' END AS tier, count(*) AS n, round(ln(1 + avg(abs(c_acctbal))), 6) AS log_mean, round(1 / (1 + exp(-avg(c_acctbal) / 10000)), 6) AS logistic FROM customer GROUP BY ALL""")
def conditional_labels(spark: SparkSession, sf: str) -> DataFrame:
    b = F.col("c_acctbal")
    tier = F.when(b < 0, "debt").when(b < 2500, "low").when(b < 7500, "mid").otherwise("high")
    return table(spark, sf, "customer").groupBy(tier.alias("tier")).agg(
        F.count("*").alias("n"), F.round(F.log1p(F.avg(F.abs(b))), 6).alias("log_mean"), F.round(1 / (1 + F.exp(-F.avg(b) / 10000)), 6).alias("logistic")
    )


@query("""SELECT doc_id, trim(regexp_replace(lower(text), '[ \\t\\n\\f\\r]+', ' ', 'g')) = trim(regexp_replace(lower(upper(text)), '[ \\t\\n\\f\\r]+', ' ', 'g')) AS equal FROM documents WHERE text IS NOT NULL AND regexp_full_match(text, '[\\x00-\\x7f]*') AND NOT contains(text, chr(11))""")
def text_normalise_equal(spark: SparkSession, sf: str) -> DataFrame:
    """Equality of texts in comparable form, here of ASCII texts with their upper case."""
    t = F.col("text")
    ascii_only = table(spark, sf, "documents").where(F.col("text").isNotNull() & t.rlike(r"\A[\x00-\x7f]*\z") & ~F.contains(t, F.lit("\x0b")))
    return ascii_only.select("doc_id", (S.collapsed(t) == S.collapsed(F.upper(t))).alias("equal"))


@query("""SELECT doc_id, len(list_distinct(list_filter(string_split(text, ' '), lambda x: x <> ''))) AS n_distinct, len(list_filter(string_split(text, ' '), lambda x: length(x) > 8)) AS n_long FROM documents WHERE text IS NOT NULL""")
def array_hof_suite(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.split("text", " ", -1)
    return table(spark, sf, "documents").where("text is not null").select(
        "doc_id", F.size(F.array_distinct(F.filter(parts, lambda x: x != ""))).cast("bigint").alias("n_distinct"), F.size(F.filter(parts, lambda x: F.length(x) > 8)).cast("bigint").alias("n_long")
    )


# text


_WORDS_SQL = "list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x))"


@query(f"""SELECT lang, source, count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS words, max(len(w)) AS longest FROM (SELECT lang, source, {_WORDS_SQL} AS w FROM documents WHERE text IS NOT NULL) GROUP BY ALL""")
def doc_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    n = F.size(words_column(F.col("text")))
    d = table(spark, sf, "documents").where("text is not null").select("lang", "source", n.alias("n"))
    return d.groupBy("lang", "source").agg(F.count("*").alias("docs"), F.sum("n").alias("words"), F.max("n").cast("bigint").alias("longest"))


@query(f"""SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS_SQL}) AS word FROM documents WHERE text IS NOT NULL) GROUP BY ALL ORDER BY n DESC, word LIMIT 50""")
def top_terms(spark: SparkSession, sf: str) -> DataFrame:
    return term_counts(table(spark, sf, "documents"), "text").orderBy(F.desc("n"), "word").limit(50)


@query(f"""WITH w AS (SELECT DISTINCT doc_id, unnest({_WORDS_SQL}) AS word FROM documents WHERE text IS NOT NULL), n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL)
SELECT word, count(*) AS df, round(ln((SELECT n FROM n) / count(*)), 6) AS idf FROM w GROUP BY ALL HAVING count(*) >= 20""")
def inverse_document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """Words of at least 20 documents only; ``inverse_document_frequency_all`` has every word."""
    return idf(table(spark, sf, "documents"), "doc_id", "text").where("df >= 20").select("word", "df", F.round("idf", 6).alias("idf"))


@query(f"""WITH w AS (SELECT DISTINCT doc_id, unnest({_WORDS_SQL}) AS word FROM documents WHERE text IS NOT NULL), n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL)
SELECT word, count(*) AS df, round(ln((SELECT n FROM n) / count(*)), 6) AS idf FROM w GROUP BY ALL""")
def inverse_document_frequency_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every word, however rare."""
    return idf(table(spark, sf, "documents"), "doc_id", "text").select("word", "df", F.round("idf", 6).alias("idf"))


@query("""WITH n AS (SELECT n_nationkey AS k, lower(n_name) AS s FROM nation), c AS (SELECT k, list_distinct(list_filter(string_split(s, ''), lambda x: x <> '')) AS c FROM n)
SELECT a.k AS a, b.k AS b, round(len(list_intersect(a.c, b.c)) / len(list_distinct(list_concat(a.c, b.c))), 6) AS j FROM c a JOIN c b ON a.k < b.k WHERE len(list_intersect(a.c, b.c)) / len(list_distinct(list_concat(a.c, b.c))) > 0.6""")
def char_jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Names with many common characters; the 25 nations are a fixed list, compared with each other."""
    n = table(spark, sf, "nation")
    a = n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x"))
    b = n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"))
    j = S.char_jaccard(F.col("x"), F.col("y"))
    return a.join(b, F.col("a") < F.col("b")).withColumn("j", j).where("j > 0.6").select("a", "b", F.round("j", 6).alias("j"))


@query("""WITH s AS (SELECT id, list_distinct(list_filter(regexp_split_to_array(lower(name), '[\\s\\-_/&]+'), lambda x: x <> '')) AS w FROM skills WHERE name IS NOT NULL)
SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, round(len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)), 6) AS overlap FROM s a JOIN s b ON a.id < b.id WHERE len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) >= 0.6""")
def token_overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    """Skills whose names share words, by an inverted index."""
    words = F.filter(F.split(F.lower("name"), r"[\s\-_/&]+"), lambda x: x != "")
    found = joins.overlap_pairs(table(spark, sf, "skills").where("name is not null").select("id", words.alias("w")), "id", "w", 0.6)
    return found.select("a", "b", F.round("overlap", 6).alias("overlap"))


@query("""SELECT md5(text) AS fingerprint, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY text HAVING count(*) > 1""")
def exact_dup_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Copies of a text by fingerprint; only fingerprints are shuffled."""
    d = table(spark, sf, "documents").where("text is not null and text <> ''").select("doc_id", F.md5("text").alias("fingerprint"))
    return d.groupBy("fingerprint").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("""SELECT doc_id, len(string_split(text, chr(10))) AS lines, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) = '')) AS blank, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS longest FROM documents WHERE text IS NOT NULL""")
def line_stats(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.split("text", "\n", -1)
    return table(spark, sf, "documents").where("text is not null").select(
        "doc_id", F.size(lines).cast("bigint").alias("lines"), F.size(F.filter(lines, lambda x: F.trim(x) == "")).cast("bigint").alias("blank"),
        F.array_max(F.transform(lines, F.length)).cast("bigint").alias("longest"),
    )


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
SELECT doc_id, count(*) FILTER (regexp_matches(line, '^#{1,6} ')) AS headings, count(*) FILTER (starts_with(line, '```')) AS fences, count(*) FILTER (regexp_matches(line, '^[|].*[|]$')) AS table_rows, count(*) FILTER (regexp_matches(line, '^ *([-*+]|[0-9]+[.]) ')) AS items FROM l GROUP BY ALL""")
def markdown_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Headings, fences, table rows and list items of each document."""
    return markdown_structure(table(spark, sf, "documents").where("text is not null"), "doc_id", "text")


@query("""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE source = 'agent_log' AND text IS NOT NULL), k AS (SELECT regexp_extract(line, '^([A-Z][a-z]+):', 1) AS level FROM l)
SELECT level, count(*) AS n FROM k WHERE level <> '' GROUP BY ALL""")
def log_level_hist(spark: SparkSession, sf: str) -> DataFrame:
    logs = table(spark, sf, "documents").where("source = 'agent_log' and text is not null")
    return log_levels(logs, "text", r"^([A-Z][a-z]+):")


@query("""WITH s AS (SELECT regionid, lower(trim(regionname)) AS n FROM result_left WHERE regionname IS NOT NULL GROUP BY ALL), r AS (SELECT regionid, lower(trim(regionname)) AS n FROM result_right WHERE regionname IS NOT NULL GROUP BY ALL)
SELECT s.regionid, min(levenshtein(s.n, r.n)) AS edits FROM s JOIN r ON s.regionid = r.regionid WHERE s.n <> r.n AND substr(s.n, 1, 2) = substr(r.n, 1, 2) GROUP BY ALL""")
def levenshtein_blocked(spark: SparkSession, sf: str) -> DataFrame:
    """Edit distance of names within blocks of key and first letters: an edit in the first two letters is not seen.

    ``levenshtein_by_key`` compares all names of a key.
    """
    side = lambda t: table(spark, sf, t).where("regionname is not null").select("regionid", F.lower(F.trim("regionname")).alias("n")).distinct()
    s = side("result_left").withColumn("block", F.substring("n", 1, 2))
    r = side("result_right").select("regionid", F.col("n").alias("m"), F.substring("n", 1, 2).alias("block"))
    return s.join(r, ["regionid", "block"]).where("n <> m").groupBy("regionid").agg(F.min(F.levenshtein("n", "m")).cast("bigint").alias("edits"))


@query("""WITH s AS (SELECT regionid, lower(trim(regionname)) AS n FROM result_left WHERE regionname IS NOT NULL GROUP BY ALL), r AS (SELECT regionid, lower(trim(regionname)) AS n FROM result_right WHERE regionname IS NOT NULL GROUP BY ALL)
SELECT s.regionid, min(levenshtein(s.n, r.n)) AS edits FROM s JOIN r ON s.regionid = r.regionid WHERE s.n <> r.n GROUP BY ALL""")
def levenshtein_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """Edit distance of all differing names of a key, wherever the edit is."""
    side = lambda t, name: table(spark, sf, t).where("regionname is not null").select("regionid", F.lower(F.trim("regionname")).alias(name)).distinct()
    met = side("result_left", "n").join(side("result_right", "m"), "regionid").where("n <> m")
    return met.groupBy("regionid").agg(F.min(F.levenshtein("n", "m")).cast("bigint").alias("edits"))
