"""Operators on embedding vectors, by sums of unit vectors and by matrix blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Query vectors held at once by a task.
QUERY_BLOCK = 4096


def unit(vector: Column) -> Column:
    """A vector of length one, in double; a zero vector stays zero."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def vector_sums(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """``(by, n, total)``: the sum of a group's vectors, added up by position before the shuffle."""
    cells = rows.select(by, F.posexplode(vector).alias("k", "x"))
    summed = cells.groupBy(by, "k").agg(F.sum("x").alias("x"))
    counted = rows.groupBy(by).agg(F.count("*").alias("n"))
    totals = summed.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda c: c["x"]).alias("total"))
    return counted.join(totals, by)


def similarity_to_group(rows: DataFrame, key: str, by: str, vector: str) -> DataFrame:
    """``(key, by, n, similarity, distance)``: mean cosine to the others of the group, and the sum of cosine distances.

    The sum over all members is the product with the sum of unit vectors, so
    no pairs are built. A group of one has no similarity.
    """
    units = rows.select(key, by, unit(F.col(vector)).alias("u"))
    joined = units.join(vector_sums(units, by, "u"), by)
    total = dot(F.col("u"), F.col("total"))
    return joined.select(key, by, "n", F.try_divide(total - dot(F.col("u"), F.col("u")), F.col("n") - 1).alias("similarity"), (F.col("n") - total).alias("distance"))


def medoids(rows: DataFrame, key: str, by: str, vector: str) -> DataFrame:
    """``(by, medoid)``: the member with the least sum of cosine distances; ties go to the smaller key."""
    scored = similarity_to_group(rows, key, by, vector)
    return scored.groupBy(by).agg(F.min_by(key, F.struct(F.round("distance", 6).alias("d"), key)).alias("medoid"))


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """``(query, neighbour, rank, cosine)``: the ``k`` nearest rows of each query, itself left out.

    The queries are a stated set. They are taken in blocks of bounded size,
    each multiplied as a matrix with all rows; every batch of rows hands on
    only its ``k`` best, so the shuffle grows with queries, not with rows.
    """
    spark = rows.sparkSession
    total = queries.count()
    blocks = max(1, -(-total // QUERY_BLOCK))
    slim = rows.select(F.col(key).alias("id"), F.col(vector).alias("v")).where("v is not null")
    kind = rows.schema[key].dataType.simpleString()
    found = None
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).select(key, vector).where(F.col(vector).isNotNull()).orderBy(key).toPandas()
        ids = block[key].to_numpy()
        m = np.array(block[vector].tolist(), np.float64).reshape(len(block), -1)
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast((ids, m))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, m = shared.value
            for batch in batches:
                if not len(batch) or not len(ids):
                    continue
                x = np.array(batch["v"].tolist(), np.float64)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                own = batch["id"].to_numpy()
                cosine = m @ x.T
                cosine[ids[:, None] == own[None, :]] = -np.inf
                top = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
                q = np.repeat(np.arange(len(ids)), top.shape[1])
                c = cosine[q, top.ravel()]
                keep = np.isfinite(c)
                yield pd.DataFrame({"query": ids[q][keep], "neighbour": own[top.ravel()][keep], "cosine": c[keep]})

        part = slim.mapInPandas(scan, f"query {kind}, neighbour {kind}, cosine double")
        found = part if found is None else found.unionByName(part)
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("query").orderBy(F.round("cosine", 9).desc(), "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "neighbour", "rank", "cosine")


def silhouette(rows: DataFrame, key: str, by: str, vector: str) -> DataFrame:
    """``(key, by, silhouette)`` with squared Euclidean distances, from the groups' moments.

    The mean squared distance of a point to a group is ``|x|^2 + mean|y|^2 -
    2 x . mean(y)``, so each point meets the groups, not the other points.
    """
    doubled = rows.select(key, by, F.transform(vector, lambda x: x.cast("double")).alias("v"))
    sq = dot(F.col("v"), F.col("v"))
    moments = vector_sums(doubled, by, "v").join(doubled.groupBy(by).agg(F.avg(sq).alias("sq")), by)
    groups = moments.select(F.col(by).alias("other"), F.col("n").alias("size"), F.transform("total", lambda x: x / F.col("n")).alias("mean"), "sq")
    # points x groups, by the groups' number, which is that of the labels
    met = doubled.withColumn("own_sq", sq).crossJoin(groups)
    apart = F.col("own_sq") + F.col("sq") - 2 * dot(F.col("v"), F.col("mean"))
    inside = F.max(F.when(F.col("other") == F.col(by), F.when(F.col("size") > 1, F.greatest(F.lit(0.0), apart) * F.col("size") / (F.col("size") - 1))))
    outside = F.min(F.when(F.col("other") != F.col(by), F.greatest(F.lit(0.0), apart)))
    scored = met.groupBy(key, by).agg(inside.alias("a"), outside.alias("b"))
    return scored.select(key, by, F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)).alias("silhouette"))
