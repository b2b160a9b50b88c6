"""Clusterings and models of the machine-learning library, with what it lacks around them."""

from __future__ import annotations

from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_vectors(rows: DataFrame, vector: str, out: str = "features") -> DataFrame:
    return rows.withColumn(out, array_to_vector(F.transform(vector, lambda x: x.cast("double"))))


def reduced(rows: DataFrame, vector: str, size: int, out: str = "reduced") -> DataFrame:
    """``rows`` with the leading components of a vector: a linear projection in place of a neighbour embedding."""
    with_vectors = as_vectors(rows, vector, "__v")
    model = PCA(k=size, inputCol="__v", outputCol="__p").fit(with_vectors)
    return model.transform(with_vectors).withColumn(out, vector_to_array("__p")).drop("__v", "__p")


def mixture_bic(rows: DataFrame, vector: str, most: int, seed: int = 42) -> list[tuple[int, float]]:
    """``(components, BIC)`` of mixtures of 1 to ``most`` components; the smallest BIC is the best number."""
    x = as_vectors(rows, vector).cache()
    n, d = x.count(), x.select(F.size(vector).alias("d")).first()["d"]
    out = []
    for k in range(1, most + 1):
        if k == 1:
            # one component in closed form: the library needs two
            likelihood = _single_likelihood(x, vector, n, d)
        else:
            likelihood = GaussianMixture(k=k, seed=seed, maxIter=30).fit(x).summary.logLikelihood
        parameters = k * (d + d * (d + 1) / 2) + k - 1
        out.append((k, float(parameters * _log(n) - 2 * likelihood)))
    x.unpersist()
    return out


def _log(n: int) -> float:
    import math

    return math.log(max(n, 1))


def _single_likelihood(x: DataFrame, vector: str, n: int, d: int) -> float:
    import numpy as np
    from pyspark.ml.stat import Summarizer

    mean = np.array(x.select(Summarizer.mean(F.col("features"))).first()[0].toArray())
    pairs = x.select(F.posexplode(vector).alias("i", "a"), F.col(vector).alias("v")).select("i", "a", F.posexplode("v").alias("j", "b"))
    second = np.zeros((d, d))
    for r in pairs.groupBy("i", "j").agg(F.avg(F.col("a").cast("double") * F.col("b").cast("double")).alias("m")).collect():  # d x d rows
        second[r["i"], r["j"]] = r["m"]
    cov = second - np.outer(mean, mean) + 1e-6 * np.eye(d)
    return float(-0.5 * n * (d * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + d))


def soft_clusters(rows: DataFrame, key: str, vector: str, components: int, least: float = 0.1, seed: int = 42) -> DataFrame:
    """``(key, cluster, probability)``: every cluster a row belongs to with more than ``least``."""
    x = as_vectors(rows, vector)
    scored = GaussianMixture(k=components, seed=seed, maxIter=30).fit(x).transform(x)
    cells = scored.select(key, F.posexplode(vector_to_array("probability")).alias("cluster", "probability"))
    return cells.where(F.col("probability") > least)


def oversampled(rows: DataFrame, label: str, numbers: list[str], key: str, seed: int = 0) -> DataFrame:
    """``rows`` with further positives until both labels are equally many.

    A new row lies between a positive and the next positive in a seeded
    order, at a seeded place; it has no key. Rows are paired within hashed
    buckets, so no task orders all positives.
    """
    from pyspark.sql import Window as W

    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}  # two rows
    positive, negative = counts.get(1, 0), counts.get(0, 0)
    if positive < 2 or positive >= negative:
        return rows
    wanted = negative - positive
    share, base = wanted / positive, wanted // positive
    some = rows.where(F.col(label) == 1)
    buckets = max(1, positive // 10_000)
    bucket = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(buckets))
    nxt = W.partitionBy("__b").orderBy(F.xxhash64(key, F.lit(seed + 1)), key)
    u = F.pmod(F.xxhash64(key, "__c", F.lit(seed + 2)), F.lit(1_000_003)) / 1_000_003
    extra = (F.pmod(F.xxhash64(key, F.lit(seed + 3)), F.lit(1_000_003)) / 1_000_003 < share - base).cast("int")
    paired = some.withColumn("__b", bucket).select("*", *(F.coalesce(F.lead(c).over(nxt), F.first(c).over(nxt)).alias(f"__n_{c}") for c in numbers))
    copies = paired.withColumn("__c", F.explode(F.sequence(F.lit(1), F.lit(base) + extra))) if base else paired.where(extra == 1).withColumn("__c", F.lit(1))
    made = copies.where("__c > 0").select(F.lit(None).cast(rows.schema[key].dataType).alias(key), F.col(label), *((F.col(c) + u * (F.col(f"__n_{c}") - F.col(c))).alias(c) for c in numbers))
    return rows.select(key, label, *numbers).unionByName(made)
