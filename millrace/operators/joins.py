"""Joins that Spark has no operator for, composed of ones that it has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, values: Sequence[str], prefix: str = "last_") -> DataFrame:
    """Each row of ``left`` with the ``values`` of the latest row of ``right`` not after it.

    Both sides are stacked and swept once in order of ``at``; at the same time
    the right side comes first. Rows of ``left`` without an earlier one have
    nulls; rows with a null key match rows with a null key. One shuffle.
    """
    kept = [c for c in left.columns if c not in by and c != at]
    stacked = left.select(*by, at, F.struct(*kept).alias("__left"), F.lit(None).alias("__right"), F.lit(1).alias("__side"))
    values_of = F.struct(*(F.col(v).alias(v) for v in values))
    stacked = stacked.withColumn("__right", F.lit(None).cast(right.select(values_of.alias("r")).schema["r"].dataType)).unionByName(
        right.select(*by, at, F.lit(None).cast(stacked.schema["__left"].dataType).alias("__left"), values_of.alias("__right"), F.lit(0).alias("__side"))
    )
    sweep = W.partitionBy(*by).orderBy(F.col(at).asc_nulls_first(), "__side").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = stacked.withColumn("__last", F.last("__right", ignorenulls=True).over(sweep)).where("__side = 1")
    return swept.select(*by, at, *(F.col(f"__left.{c}").alias(c) for c in kept), *(F.col(f"__last.{v}").alias(prefix + v) for v in values))


def bands(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Rows of ``points`` with the rows of ``ranges`` where ``low <= point < high``.

    Ranges are laid on a grid of cells, so the join is on equality of a cell
    and shuffles by it, instead of comparing all pairs. ``width`` is the size
    of a cell, best near that of a range.
    """
    cell = lambda c: F.floor(c / F.lit(width))
    spread = ranges.withColumn("__cell", F.explode(F.sequence(cell(F.col(low)), cell(F.col(high)))))
    return points.withColumn("__cell", cell(F.col(point))).join(spread, "__cell").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("__cell")


def paired(left: DataFrame, right: DataFrame, by: Sequence[str], order_left: Sequence[Column], order_right: Sequence[Column], how: str = "full") -> DataFrame:
    """The k-th row of a key on the left with the k-th row of the key on the right: a bag join, 1:1."""
    number = lambda df, order: df.withColumn("__k", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return number(left, order_left).join(number(right, order_right), [*by, "__k"], how)


def bag_difference(left: DataFrame, right: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``left`` without one row for each row of ``right`` with the same key: the first ones are consumed."""
    numbered = left.withColumn("__k", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    spent = right.groupBy(*by).agg(F.count("*").alias("__spent"))
    return numbered.join(spent, list(by), "left").where(F.col("__k") > F.coalesce("__spent", F.lit(0))).drop("__k", "__spent")


def match_ratio(result: DataFrame, gold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(gold_rows, merged_rows, ratio)``: how much of the gold rows an inner join keeps, at most 1."""
    merged = gold.select(*keys).join(result.select(*keys), list(keys)).agg(F.count("*").alias("merged_rows"))
    total = gold.agg(F.count("*").alias("gold_rows"))
    ratio = F.least(F.lit(1.0), F.try_divide(F.col("merged_rows"), F.col("gold_rows")))
    return total.crossJoin(merged).select("gold_rows", "merged_rows", ratio.alias("ratio"))  # one row each


def overlap_pairs(sets: DataFrame, key: str, items: str, least: float) -> DataFrame:
    """``(a, b, overlap)``: pairs with a common-item share of the smaller set of at least ``least``.

    Candidates come from an inverted index over the items a pair must share:
    only the rarest ``n - ceil(least * n) + 1`` items of the smaller set are
    indexed, so a frequent item joins no one who has rarer ones.
    """
    base = sets.select(F.col(key).alias("key"), F.array_distinct(items).alias("items")).where(F.size("items") > 0)
    long = base.select("key", F.size("items").alias("n"), F.explode("items").alias("item"))
    often = long.groupBy("item").agg(F.count("*").alias("df"))
    ranked = long.join(often, "item").groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("by_df"))
    prefix = ranked.select("key", "n", F.explode(F.slice("by_df", F.lit(1), F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1)).alias("p"))
    small = prefix.select(F.col("key").alias("s"), F.col("n").alias("ns"), F.col("p.item").alias("item"))
    large = long.select(F.col("key").alias("t"), F.col("n").alias("nt"), "item")
    found = small.join(large, "item").where((F.col("s") != F.col("t")) & (F.col("ns") <= F.col("nt"))).select("s", "t").distinct()
    a = base.select(F.col("key").alias("s"), F.col("items").alias("x"))
    b = base.select(F.col("key").alias("t"), F.col("items").alias("y"))
    overlap = F.size(F.array_intersect("x", "y")) / F.least(F.size("x"), F.size("y"))
    scored = found.join(a, "s").join(b, "t").select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"), overlap.alias("overlap"))
    return scored.where(F.col("overlap") >= least - 1e-9).distinct()
