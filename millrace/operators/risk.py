"""Bins of a score and what they say about a binary label: lift, WOE, IV, PSI, KS, AUC, roll rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.ordered import quantiles, running

#: Added to empty cells of a ratio, so that no logarithm is infinite.
EPSILON = 1e-6


def quantile_edges(rows: DataFrame, score: str, bins: int) -> list[float]:
    """The inner edges of bins of equal counts, exact, without repetitions: at most ``bins - 1`` numbers."""
    cuts = quantiles(rows, score, [k / bins for k in range(1, bins)]).first()["quantiles"]
    return sorted({x for x in cuts if x is not None})


def bin_of(score: Column, edges: Sequence[float]) -> Column:
    """1-based number of the bin ``(edge[k-1], edge[k]]``; null scores are bin 0."""
    # comparisons one by one stay in generated code, a filter of an array does not
    return F.when(score.isNull(), 0).otherwise(sum((F.when(score > e, 1).otherwise(0) for e in edges), F.lit(1)))


def binned(rows: DataFrame, score: str, bins: int, edges: Sequence[float] | None = None) -> DataFrame:
    """``rows`` with ``bin``, by the given ``edges`` or the quantiles of the rows themselves."""
    edges = quantile_edges(rows, score, bins) if edges is None else edges
    return rows.withColumn("bin", bin_of(F.col(score), edges).cast("bigint"))


def bin_table(rows: DataFrame, score: str, label: str, bins: int) -> DataFrame:
    """``(bin, low, high, n, pos, neg, pos_rate, lift, cum_pos, cum_neg, diff)``, a row a bin."""
    by = binned(rows, score, bins).groupBy("bin").agg(F.min(score).alias("low"), F.max(score).alias("high"), F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos"))
    by = by.withColumn("neg", F.col("n") - F.col("pos"))
    every, upto = W.partitionBy(F.lit(0)), W.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    rate, base = F.col("pos") / F.col("n"), F.sum("pos").over(every) / F.sum("n").over(every)
    share = lambda c: F.try_divide(F.sum(c).over(upto), F.sum(c).over(every))
    out = by.select("*", rate.alias("pos_rate"), F.try_divide(rate, base).alias("lift"), share("pos").alias("cum_pos"), share("neg").alias("cum_neg"))
    return out.withColumn("diff", F.abs(F.col("cum_pos") - F.col("cum_neg")))


def woe_iv(rows: DataFrame, score: str, label: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, bin, woe, iv)``: weight of evidence and part of the information value of each bin."""
    cells = binned(rows, score, bins).groupBy(*by, "bin").agg(F.sum(F.col(label).cast("double")).alias("pos"), F.sum(1 - F.col(label).cast("double")).alias("neg"))
    every = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    part = lambda c: F.greatest(F.try_divide(F.col(c), F.sum(c).over(every)), F.lit(EPSILON))
    p, n = part("pos"), part("neg")
    return cells.select(*by, "bin", F.log(p / n).alias("woe"), ((p - n) * F.log(p / n)).alias("iv"))


def psi(base: DataFrame, other: DataFrame, score: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, psi)`` of ``other``, by group, against the distribution of ``base`` over its own quantile bins."""
    edges = quantile_edges(base, score, bins)
    expected = binned(base, score, bins, edges).groupBy("bin").agg(F.count("*").alias("e"))
    expected = expected.withColumn("e", F.col("e") / F.sum("e").over(W.partitionBy(F.lit(0))))
    actual = binned(other, score, bins, edges).groupBy(*by, "bin").agg(F.count("*").alias("a"))
    every = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    actual = actual.withColumn("a", F.col("a") / F.sum("a").over(every))
    groups = actual.select(*by).distinct() if by else None
    grid = expected.select("bin", "e") if groups is None else groups.crossJoin(F.broadcast(expected))  # bins x groups
    e, a = (F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(EPSILON)) for c in ("e", "a"))
    return grid.join(actual, [*by, "bin"], "left").groupBy(*by).agg(F.sum((a - e) * F.log(a / e)).alias("psi"))


def ks_auc(rows: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, ks, auc)`` of a score against a 0/1 label; equal scores count as one step."""
    slim = rows.select(*by, F.col(score).alias("__score"), F.col(label).alias("__label")).where("__score is not null")
    step = slim.groupBy(*by, "__score").agg(F.sum(F.col("__label").cast("double")).alias("p"), F.sum(1 - F.col("__label").cast("double")).alias("q"))
    total = step.groupBy(*by).agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    ranked = running(step, "__score", ["p", "q"], by)
    joined = ranked.join(total, list(by)) if by else ranked.crossJoin(F.broadcast(total))  # one row
    gap = F.abs(F.try_divide(F.col("before_p") + F.col("p"), F.col("tp")) - F.try_divide(F.col("before_q") + F.col("q"), F.col("tq")))
    area = F.try_divide(F.sum(F.col("p") * (F.col("before_q") + F.col("q") / 2)), F.max("tp") * F.max("tq"))
    return joined.groupBy(*by).agg(F.max(gap).alias("ks"), area.alias("auc"))


def roll_rates(states: DataFrame, entity: str, order: Sequence[str], state: str, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, from_state, to_state, n, rate)``: how often a state is followed by another one of the same entity."""
    following = F.lead(state).over(W.partitionBy(entity).orderBy(*order))
    moves = states.withColumn("to_state", following).where("to_state is not null").withColumnRenamed(state, "from_state")
    counted = moves.groupBy(*by, "from_state", "to_state").agg(F.count("*").alias("n"))
    return counted.withColumn("rate", F.col("n") / F.sum("n").over(W.partitionBy(*by, "from_state")))
