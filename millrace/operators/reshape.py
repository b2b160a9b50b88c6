"""Dense time axes, islands of consecutive dates, and global ranks without a global order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.session import materialised


def densified(series: DataFrame, at: str, step: str) -> DataFrame:
    """``series`` with a row for every step between its first and last time; new rows have nulls.

    ``series`` is an aggregate by time; a table without rows stays empty.
    """
    axis = series.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).where("lo is not null").select(F.explode(F.expr(f"sequence(lo, hi, {step})")).alias(at))
    return axis.join(series, at, "left")


def islands(dates: DataFrame, by: Sequence[str], date: str) -> DataFrame:
    """``dates`` with ``island``, the same for consecutive dates of a key; dates are distinct within a key."""
    k = F.row_number().over(W.partitionBy(*by).orderBy(date))
    return dates.withColumn("island", F.date_sub(F.col(date), k))


def global_rank(rows: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(ranked, total)``: rows with their 1-based ``rank`` in a total order, and one row with their number.

    Rows are range-partitioned and ranked within a partition; the partitions'
    sizes, one row each, give the offsets. No task sees more than a range.
    The ranged rows are written once, so both passes see the same ranges.
    """
    placed = rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    placed = materialised(placed, "ranged")
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))
    within = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    ranked = placed.withColumn("__k", within).join(offsets, "__part").withColumn("rank", F.col("__k") + F.col("__before")).drop("__k", "__before", "__part")
    return ranked, sizes.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("total"))


def ranked_bins(rows: DataFrame, order: Sequence[str], bins: int) -> DataFrame:
    """``rows`` with ``bin`` from 1: equal counts in a total order, the first bins one larger (as ntile)."""
    ranked, total = global_rank(rows, order)
    n, r = F.col("total"), F.col("rank") - 1
    size, extra = F.floor(n / bins), n % bins
    edge = extra * (size + 1)
    number = F.when(r < edge, F.floor(r / (size + 1))).otherwise(extra + F.floor((r - edge) / F.greatest(size, F.lit(1)))) + 1
    return ranked.crossJoin(F.broadcast(total)).withColumn("bin", number.cast("bigint")).drop("rank", "total")  # total is one row
