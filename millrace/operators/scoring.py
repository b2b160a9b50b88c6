"""Scores of predictions and statistics of samples, as aggregates in closed form."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.ordered import mid_ranks, quantiles, running

# Regression: each metric is one aggregate of the truth y and the prediction p.

REGRESSION: dict[str, Callable[[Column, Column], Column]] = {
    "mae": lambda y, p: F.avg(F.abs(y - p)),
    "mse": lambda y, p: F.avg((y - p) * (y - p)),
    "rmse": lambda y, p: F.sqrt(F.avg((y - p) * (y - p))),
    "msle": lambda y, p: F.avg(F.pow(F.log1p(y) - F.log1p(F.greatest(p, F.lit(0.0))), F.lit(2))),
    "smape": lambda y, p: 100 * F.avg(F.when(F.abs(y) + F.abs(p) == 0, 0.0).otherwise(2 * F.abs(y - p) / (F.abs(y) + F.abs(p)))),
    "mape": lambda y, p: F.avg(F.try_divide(F.abs(y - p), F.abs(y))),
    "r2": lambda y, p: 1 - F.try_divide(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y)),
}
LOWER_IS_BETTER = frozenset({"mae", "mse", "rmse", "msle", "smape", "mape", "medae", "logloss", "crps"})


def regression(rows: DataFrame, truth: str, predicted: str, metrics: Sequence[str] = (*REGRESSION, "medae"), by: Sequence[str] = ()) -> DataFrame:
    """One column a metric; rows without truth or prediction are left out, no rows give nulls.

    ``medae``, the median of the absolute errors, is no aggregate in one pass
    and takes those of an exact quantile.
    """
    y, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    kept = rows.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    out = kept.groupBy(*by).agg(F.count("*").alias("__n"), *(REGRESSION[m](y, p).alias(m) for m in metrics if m != "medae"))
    if "medae" in metrics:
        middle = quantiles(kept.withColumn("__e", F.abs(y - p)), "__e", [0.5], by).withColumn("medae", F.col("quantiles")[0])
        if by:
            same = reduce(lambda a, b: a & b, (F.col(f"o.{c}").eqNullSafe(F.col(f"m.{c}")) for c in by))
            out = out.alias("o").join(middle.alias("m"), same, "left").select("o.*", "m.medae")
        else:
            out = out.crossJoin(F.broadcast(middle))  # one row
    return out.select(*by, *metrics)


def normalised(value: Column, low: float, high: float, metric: str) -> Column:
    """A score between 0 and 1; for a metric where lower is better the bounds are exchanged. Null scores 0."""
    lo, hi = (high, low) if metric in LOWER_IS_BETTER else (low, high)
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - lo) / (hi - lo))), F.lit(0.0))


def per_class(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``(class, support, precision, recall, f1)`` from the confusion counts, one row a class."""
    counts = rows.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    hit = F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0))
    t = counts.groupBy(F.col("t").alias("class")).agg(F.sum("n").alias("support"), hit.alias("hits"))
    p = counts.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("claimed"))
    both = t.join(p, "class", "full").fillna(0)
    precision, recall = F.coalesce(F.try_divide("hits", "claimed"), F.lit(0.0)), F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    return both.select("class", "support", precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"))


def weighted_f1(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row ``(accuracy, f1)``: accuracy, and F1 weighted by support."""
    classes = per_class(rows, truth, predicted)
    total = F.sum("support")
    return classes.agg((F.sum(F.col("recall") * F.col("support")) / total).alias("accuracy"), (F.sum(F.col("f1") * F.col("support")) / total).alias("f1"))


def quadratic_kappa(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row ``(kappa)``: agreement of integer ratings with quadratic weights.

    The expected part needs only the moments of the marginals, so no table of
    all rating pairs is built.
    """
    t, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    kept = rows.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    observed = F.avg((t - p) * (t - p))
    expected = F.avg(t * t) + F.avg(p * p) - 2 * F.avg(t) * F.avg(p)
    return kept.agg((1 - F.try_divide(observed, expected)).alias("kappa"))


def log_loss(rows: DataFrame, label: str, probability: str, clip: float = 1e-15) -> DataFrame:
    """One row ``(logloss)`` in nats of a 0/1 label; probabilities are kept off 0 and 1."""
    p = F.least(F.lit(1 - clip), F.greatest(F.lit(clip), F.col(probability).cast("double")))
    return rows.agg((-F.avg(F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p)))).alias("logloss"))


def halved_log_losses(cells: DataFrame, cls: str, gold: str, probability: str, clip: float = 1e-15) -> DataFrame:
    """One row ``(per_row, per_class)``: half the mean of -log2 of the true class's probability, over all rows, and summed over the means of the classes.

    ``cells`` has a row for each record and class; probabilities of a record
    add up to 1 and are kept off 0 and 1.
    """
    p = F.log2(F.least(F.lit(1 - clip), F.greatest(F.lit(clip), F.col(probability).cast("double"))))
    by = cells.where(F.col(gold) == 1).groupBy(cls).agg(F.count("*").alias("n"), F.sum(p).alias("l"))
    return by.agg((-F.sum("l") / F.sum("n") / 2).alias("per_row"), (-F.sum(F.col("l") / F.col("n")) / 2).alias("per_class"))


def chi_squared(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``(chi2, df)`` of the independence of two categories, from the cells that occur: absent ones add their expectation."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("o"))
    na, nb = cells.groupBy(a).agg(F.sum("o").alias("na")), cells.groupBy(b).agg(F.sum("o").alias("nb"))
    joined = cells.join(na, a).join(nb, b)
    # the sum of o * o / e over all cells, less n
    part = F.sum(F.col("o").cast("double") * F.col("o") / (F.col("na").cast("double") * F.col("nb")))
    return joined.agg((F.sum("o") * part - F.sum("o")).alias("chi2"), ((F.count_distinct(a) - 1) * (F.count_distinct(b) - 1)).alias("df"))


def meta_effect(rows: DataFrame, study: str, group: str, a: str, b: str, value: str) -> DataFrame:
    """One row ``(effect, std_err, studies)``: differences of the two groups' means in each study, weighted by the inverse of their variances."""
    of = lambda g, f: f(F.when(F.col(group) == g, F.col(value)))
    each = rows.groupBy(study).agg((of(a, F.avg) - of(b, F.avg)).alias("d"), (of(a, F.var_samp) / of(a, F.count) + of(b, F.var_samp) / of(b, F.count)).alias("v")).where("v > 0")
    weight = F.sum(1 / F.col("v"))
    return each.agg((F.sum(F.col("d") / F.col("v")) / weight).alias("effect"), F.sqrt(1 / weight).alias("std_err"), F.count("*").alias("studies"))


def ks_two_samples(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """One row ``(ks)``: the largest gap of the two empirical distributions."""
    one = lambda df, x, y: df.where(F.col(value).isNotNull()).select(value, F.lit(x).alias("x"), F.lit(y).alias("y"))
    step = one(a, 1, 0).unionByName(one(b, 0, 1)).groupBy(value).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    total = step.agg(F.sum("x").alias("tx"), F.sum("y").alias("ty"))
    ranked = running(step, value, ["x", "y"]).crossJoin(F.broadcast(total))  # one row
    gap = F.abs(F.try_divide(F.col("before_x") + F.col("x"), F.col("tx")) - F.try_divide(F.col("before_y") + F.col("y"), F.col("ty")))
    return ranked.agg(F.max(gap).alias("ks"))


def crps(gold: DataFrame, predictions: DataFrame, value: str) -> DataFrame:
    """One row ``(crps)``: over all gold values, squared distribution of the predictions below, squared rest above.

    Each sum over the distinct predictions is a running sum, so gold values
    and predictions are swept together and never paired.
    """
    step = predictions.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    total = step.agg(F.sum("n").alias("all"))
    cdf = running(step, value, ["n"]).crossJoin(F.broadcast(total)).select(value, ((F.col("before_n") + F.col("n")) / F.col("all")).alias("f"))  # one row
    marks = cdf.select(value, (F.col("f") * F.col("f")).alias("low"), F.pow(F.col("f") - 1, F.lit(2)).alias("high"), F.lit(0).alias("g"))
    golds = gold.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("g")).select(value, F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), "g")
    swept = running(marks.unionByName(golds).groupBy(value).agg(F.sum("low").alias("low"), F.sum("high").alias("high"), F.sum("g").alias("g")), value, ["low", "high"])
    highs = marks.agg(F.sum("high").alias("all_high"))
    part = F.col("g") * (F.col("before_low") + F.col("all_high") - F.col("before_high"))
    return swept.crossJoin(F.broadcast(highs)).agg(F.sum(part).alias("crps"))  # one row


# Samples


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``(rho)``: the correlation of mid-ranks, of rows with both values."""
    kept = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    rx = mid_ranks(kept, x).select(x, F.col("rank").alias("rx"))
    ry = mid_ranks(kept, y).select(y, F.col("rank").alias("ry"))
    return kept.join(rx, x).join(ry, y).agg(F.corr("rx", "ry").alias("rho"))


def ols(rows: DataFrame, y: str, x: str) -> DataFrame:
    """One row ``(slope, intercept, r2, std_err, t, n)`` of a simple regression."""
    n, r2 = F.regr_count(y, x), F.regr_r2(F.col(y), F.col(x))
    err = F.sqrt(F.try_divide((1 - r2) * F.regr_syy(F.col(y), F.col(x)), (n - 2) * F.regr_sxx(F.col(y), F.col(x))))
    slope = F.regr_slope(F.col(y), F.col(x))
    return rows.agg(slope.alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"), r2.alias("r2"), err.alias("std_err"), F.try_divide(slope, err).alias("t"), n.alias("n"))


def two_groups(rows: DataFrame, group: str, a: str, b: str, value: str) -> DataFrame:
    """One row ``(cohens_d, welch_t, welch_df)`` of two groups of a sample."""
    of = lambda g, f: f(F.when(F.col(group) == g, F.col(value)))
    m = rows.agg(*(of(g, f).alias(f"{n}_{k}") for k, g in (("a", a), ("b", b)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))))
    va, vb = F.col("v_a") / F.col("n_a"), F.col("v_b") / F.col("n_b")
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("v_a") + (F.col("n_b") - 1) * F.col("v_b")) / (F.col("n_a") + F.col("n_b") - 2))
    gap = F.col("m_a") - F.col("m_b")
    df = (va + vb) * (va + vb) / (va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1))
    return m.select(F.try_divide(gap, pooled).alias("cohens_d"), F.try_divide(gap, F.sqrt(va + vb)).alias("welch_t"), df.alias("welch_df"))


def anova(rows: DataFrame, group: str, value: str) -> DataFrame:
    """One row ``(f, df_between, df_within)`` of a one-way analysis of variance."""
    g = rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    n, k = F.sum("n"), F.count("*")
    grand = F.sum(F.col("n") * F.col("m")) / n
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - n * grand * grand
    within = F.sum(F.col("n") * F.col("v"))
    return g.agg(F.try_divide(between / (k - 1), within / (n - k)).alias("f"), (k - 1).alias("df_between"), (n - k).alias("df_within"))


def kruskal(rows: DataFrame, group: str, value: str) -> DataFrame:
    """One row ``(h)``: the rank test of several groups, corrected for ties."""
    kept = rows.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(group, value)
    ranks = mid_ranks(kept, value)
    t = F.col("n").cast("double")  # cubes of 2,097,152 rows and more are no bigints
    ties = ranks.agg(F.sum("n").alias("all"), F.sum(t * t * t - t).alias("ties"))
    cells = kept.groupBy(group, value).agg(F.count("*").alias("c")).join(ranks.select(value, "rank"), value)
    sums = cells.groupBy(group).agg(F.sum(F.col("c") * F.col("rank")).alias("r"), F.sum("c").alias("c"))
    n = F.max("all").cast("double")
    h = 12 / (n * (n + 1)) * F.sum(F.col("r") * F.col("r") / F.col("c")) - 3 * (n + 1)
    return sums.crossJoin(F.broadcast(ties)).agg((h / (1 - F.max("ties") / (n * n * n - n))).alias("h"))  # one row


def mann_whitney(rows: DataFrame, group: str, a: str, b: str, value: str) -> DataFrame:
    """One row ``(u)``: pairs in which a value of ``a`` is the larger, ties counting half."""
    kept = rows.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).select(group, value)
    cells = kept.groupBy(group, value).agg(F.count("*").alias("c")).join(mid_ranks(kept, value).select(value, "rank"), value)
    own = F.when(F.col(group) == a, F.col("c"))
    return cells.agg((F.sum(own * F.col("rank")) - F.sum(own) * (F.sum(own) + 1) / 2).alias("u"))


def benjamini_hochberg(tests: DataFrame, p: str, key: str) -> DataFrame:
    """``tests`` with ``q``: p-values corrected for their number. One row a test, so one small window."""
    every = W.partitionBy(F.lit(0))
    rank = F.row_number().over(every.orderBy(p, key))
    scaled = tests.withColumn("__k", rank).withColumn("__q", F.col(p) * F.count("*").over(every) / F.col("__k"))
    least = F.min("__q").over(every.orderBy(F.desc("__k")).rowsBetween(W.unboundedPreceding, 0))
    return scaled.withColumn("q", F.least(F.lit(1.0), least)).drop("__k", "__q")


def bootstrap_mean(rows: DataFrame, value: str, key: str, replicates: int = 200, seed: int = 7, level: float = 0.95) -> DataFrame:
    """One row ``(mean, low, high)``: a Poisson bootstrap; every row counts in all replicates in one pass.

    How often a row counts follows from its ``key``, so the result does not
    depend on partitions. Each batch gives one row of sums for each replicate.
    """
    kept = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), F.xxhash64(key, F.lit(seed)).alias("h"))
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixed = np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            v, h = batch.column("v").to_numpy(), batch.column("h").to_numpy().view(np.uint64)
            x = h[:, None] ^ mixed[None, :]
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            w = np.searchsorted(steps, (x >> np.uint64(11)) / 2.0**53, side="right").astype(float)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), pa.array(v @ w), pa.array(w.sum(axis=0))], ["r", "s", "w"])

    sums = kept.mapInArrow(draw, "r bigint, s double, w double").groupBy("r").agg(F.try_divide(F.sum("s"), F.sum("w")).alias("m"))
    tail = (1 - level) / 2
    return sums.agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))
