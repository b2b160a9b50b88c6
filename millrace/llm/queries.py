"""Queries over the tables for training data; each runs over its whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import table
from millrace.llm import clusters, diverse, encode, leakage, neardup, pairs, residue

#: Place of the public vocabularies; the path is a parameter, the files are not part of the package.
TOKENIZERS = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")

SUBSET_SIZE = 100


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.find_defects(table(spark, sf, "examples"))


def p1_defects_by_tag(spark: SparkSession, sf: str) -> DataFrame:
    """Defects by tag: one record an example."""
    found = pairs.find_defects(table(spark, sf, "examples"))
    tags = table(spark, sf, "examples").groupBy("example_id").agg(F.min("tag").alias("tag"))
    return found.join(tags, "example_id").groupBy("tag", "defect").agg(F.count("*").alias("n"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.cluster_pairs(clusters.cluster_steps(table(spark, sf, "steps")))


def p2_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.describe_clusters(clusters.cluster_steps(table(spark, sf, "steps")))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.duplicate_pairs(*neardup.near_duplicates(table(spark, sf, "examples")))


def p3_classes(spark: SparkSession, sf: str) -> DataFrame:
    """One row a question: its class and the number of classes linked to it."""
    members, links = neardup.near_duplicates(table(spark, sf, "examples"))
    ends = links.select(F.col("a").alias("class")).unionByName(links.select(F.col("b").alias("class")))
    counted = ends.groupBy("class").agg(F.count("*").alias("links"))
    return members.join(counted, "class", "left").select("id", "class", F.coalesce("links", F.lit(0)).alias("links"))


def p6_varied_subset(spark: SparkSession, sf: str) -> DataFrame:
    weights = diverse.weights_of(table(spark, sf, "skills"))
    return diverse.varied_subset(clusters.step_records(table(spark, sf, "steps")), weights, SUBSET_SIZE)


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode.encode_corpus(table(spark, sf, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p7_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """The round trip: the text of each document's ids."""
    vocabulary = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    return encode.decode_corpus(encode.encode_corpus(table(spark, sf, "documents"), vocabulary), vocabulary)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    found = leakage.find_leaks(table(spark, sf, "documents"), table(spark, sf, "test_items"))
    return found.where("passages > 0").select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, sf: str) -> DataFrame:
    """Leaked items: in how many documents, with how many passages."""
    found = leakage.find_leaks(table(spark, sf, "documents"), table(spark, sf, "test_items")).where("passages > 0")
    return found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.sum("passages").alias("passages"))


def p8_near(spark: SparkSession, sf: str) -> DataFrame:
    """Items of which a document holds at least 0.8, by weighted shingles, in one window of the item's size."""
    found = leakage.find_leaks(table(spark, sf, "documents"), table(spark, sf, "test_items")).where("similarity >= 0.8")
    return found.groupBy("doc_id", "item_id").agg(F.round(F.max("similarity"), 6).alias("similarity"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.find_residue(table(spark, sf, "documents")).select("doc_id").distinct()


def p9_clean_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents left by source and language after the exclusion."""
    return residue.exclude_residue(table(spark, sf, "documents")).groupBy("source", "lang").agg(F.count("*").alias("documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_defects_by_tag, p2_found, p2_clusters, p3_found, p3_classes, p6_varied_subset,
            p7_ids, p7_decoded, p8_found, p8_items, p8_near, p9_found, p9_clean_counts,
        )
    }


#: The likeness of two questions, of all pairs that share a word, by plain SQL.
P3_FOUND = """
WITH q AS (SELECT DISTINCT id, question FROM examples WHERE question IS NOT NULL),
w AS (SELECT id, unnest(regexp_extract_all(question, '[\\p{L}\\p{N}]+')) AS raw FROM q),
c AS (SELECT id, lower(raw) AS word, count(*) AS n FROM w GROUP BY ALL),
s AS (SELECT id, sum(n) AS total FROM c GROUP BY id),
p AS (SELECT a.id AS id_a, b.id AS id_b, sum(least(a.n, b.n)) AS common
      FROM c a JOIN c b ON a.word = b.word AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b FROM p JOIN s x ON x.id = id_a JOIN s y ON y.id = id_b
WHERE common >= 0.8 * greatest(x.total, y.total)
"""

#: Documents and items with a common run of twelve words.
P8_FOUND = """
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL),
dw AS (SELECT doc_id, array_to_string(list_slice(w, k, k + 11), ' ') AS run FROM d, unnest(range(1, len(w) - 10)) AS t(k)),
i AS (SELECT item_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) AS w FROM test_items WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, k, k + 11), ' ') AS run FROM i, unnest(range(1, len(w) - 10)) AS t(k))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (run)
"""

P7_DECODED = "SELECT doc_id, coalesce(text, '') AS text FROM documents"


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3_FOUND, "p8_found": P8_FOUND, "p7_decoded": P7_DECODED}
