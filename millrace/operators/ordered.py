"""Running sums, mid-ranks and exact quantiles over a total order, without one task for all rows or for a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.session import BROADCAST_BYTES, ROW_BYTES, broadcast_if_small, materialised, materialised_if_costly

#: Parts of an interval in one pass of a search for ranks.
CELLS = 1024

#: Wanted ranks a cell is taken to have when its size is estimated.
RANKS = 8

#: Intervals with fewer rows are ordered by one task; others are divided again.
TASK_ROWS = 200_000


def _same(by: Sequence[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in by))


def running(rows: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``before_<c>``: for each column the sum over smaller values of ``order`` within ``by``.

    ``order`` is unique within ``by`` (aggregate by it first) and ``sums`` are
    numbers without nulls. Rows are range-partitioned by group and value, so a
    large group takes many tasks and small ones share a task. A task adds up
    its own rows; the sums of whole tasks, one row for each group in a task,
    give the rest. The result is exact whatever the ranges are.
    """
    group = F.xxhash64(*by) if by else F.lit(0).cast("bigint")
    placed = materialised(rows.withColumn("__g", group), "unordered").repartitionByRange("__g", *by, order)
    placed = placed.withColumn("__part", F.spark_partition_id()).sortWithinPartitions("__g", *by, order)
    kinds = {c: "bigint" if rows.schema[c].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "double" for c in sums}
    slim = placed.select(*rows.columns, "__g", "__part", *(F.col(c).cast(k).alias(f"__l_{c}") for c, k in kinds.items()))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, {c: 0 for c in sums}
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("__g").to_numpy()
            starts = np.nonzero(np.append(True, g[1:] != g[:-1]))[0]
            if g[0] != last:
                carried = {c: 0 for c in sums}
            columns = {n: batch.column(n) for n in batch.schema.names}
            for c in sums:
                x = batch.column(f"__l_{c}").to_numpy(zero_copy_only=False)
                upto = np.cumsum(x)
                before = upto - x
                offset = np.repeat(before[starts], np.diff(np.append(starts, len(g))))
                own = before - offset
                own[: starts[1] if len(starts) > 1 else len(g)] += carried[c]
                carried[c] = own[-1] + x[-1]
                columns[f"__l_{c}"] = pa.array(own)
            last = g[-1]
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    summed = materialised(slim.mapInArrow(add_up, slim.schema), "running")
    whole = summed.groupBy("__g", "__part").agg(*(F.sum(c).cast(k).alias(f"__s_{c}") for c, k in kinds.items()))
    up = W.partitionBy("__g").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = whole.select("__g", "__part", *(F.coalesce(F.sum(f"__s_{c}").over(up), F.lit(0)).alias(f"__o_{c}") for c in sums))
    # without groups a row a task; else a row a group more
    offsets = broadcast_if_small(offsets, "offsets") if by else F.broadcast(offsets)
    return summed.join(offsets, ["__g", "__part"]).select(*rows.columns, *((F.col(f"__l_{c}") + F.col(f"__o_{c}")).alias(f"before_{c}") for c in sums))


def mid_ranks(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, value, n, rank)``: each distinct value with its count and mid-rank (ties share the mean rank)."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    ranked = running(counted, value, ["n"], by)
    return ranked.select(*by, value, "n", (F.col("before_n") + (F.col("n") + 1) / 2).alias("rank"))


def _log_cell(v: Column) -> Column:
    """A number that grows with the value, a new one for each 1.6 %."""
    size = F.floor(F.log(F.least(F.abs(v), F.lit(1.7e308))) * 64) + F.lit(100_000)
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("bigint")


def _holding(cells: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Cells that hold wanted ranks, with those ranks counted from the first row of the cell."""
    before = F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = cells.withColumn("__b", before)
    inside = F.filter("ranks", lambda r: (r["at"] >= F.col("__b")) & (r["at"] < F.col("__b") + F.col("n")))
    moved = F.transform(inside, lambda r: F.struct(r["rank"].alias("rank"), (r["at"] - F.col("__b")).alias("at")))
    return placed.withColumn("ranks", moved).where(F.size("ranks") > 0).drop("__b")


def at_ranks(rows: DataFrame, value: str, ranks: Callable[[Column], Column], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """``(*by, total, found)``: the number of values, and a map from 0-based rank to the value there.

    ``ranks`` turns the total into the array of wanted ranks. Values are
    doubles, nulls and NaN left out; a row counts ``weight`` times. Nothing is
    sorted: values are counted in cells, the cells that hold a wanted rank are
    divided again by one more pass, and only the few values of the last cells
    are ordered. A cell with one value is done, however many rows it has.
    """
    v = F.col(value).cast("double")
    kept = rows.where(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("__v"), (F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")).alias("__w"))
    kept = materialised_if_costly(kept, "values")
    group = list(by) or [F.lit(0)]
    bounds = (F.sum("__w").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    first = materialised(kept.groupBy(*by, _log_cell(F.col("__v")).alias("__c")).agg(*bounds), "cells")
    # totals come with the running sums of the cells, so the cells are shuffled once
    known = first.withColumn("total", F.sum("n").over(W.partitionBy(*group)))
    wanted = F.transform(F.array_distinct(ranks(F.col("total"))), lambda r: F.struct(r.cast("bigint").alias("rank"), r.cast("bigint").alias("at")))
    state = materialised(_holding(known.withColumn("ranks", wanted), group, ["__c"]).select(*by, "n", "lo", "hi", "ranks", "total"), "cells")
    nothing = (F.lit(None).cast("bigint").alias("rank"), F.lit(None).cast("double").alias("value"))
    done = [state.select(*by, *nothing, "total")]
    state = state.drop("total")
    none = F.lit(None).cast("bigint").alias("total")
    while True:
        done.append(state.where("lo = hi").select(*by, F.explode("ranks.rank").alias("rank"), F.col("lo").alias("value"), none))
        left = state.where("lo < hi")
        most, open_cells = left.agg(F.max("n"), F.count("*")).first()
        if most is None:
            break
        listed = left.groupBy(*by).agg(F.collect_list(F.struct("lo", "hi", "ranks")).alias("__cells"))
        if by:
            listed = F.broadcast(listed) if open_cells * (ROW_BYTES + 32 * RANKS) <= BROADCAST_BYTES else listed
            met = kept.alias("k").join(listed.alias("c"), _same(by, "k", "c")).select("k.*", "c.__cells")
        else:
            met = kept.crossJoin(F.broadcast(listed))  # one row
        cell = F.filter("__cells", lambda c: (c["lo"] <= F.col("__v")) & (F.col("__v") <= c["hi"]))
        met = met.withColumn("__cell", F.try_element_at(cell, F.lit(1))).where("__cell is not null").select(*by, "__v", "__w", "__cell")
        if most <= TASK_ROWS:
            last = met.groupBy(*by, "__cell.lo", "__v").agg(F.sum("__w").alias("n"), F.first("__cell.ranks").alias("ranks"))
            hits = _holding(last, [*by, "lo"], ["__v"])
            done.append(hits.select(*by, F.explode("ranks.rank").alias("rank"), F.col("__v").alias("value"), none))
            break
        part = F.least(F.floor((F.col("__v") - F.col("__cell.lo")) / (F.col("__cell.hi") - F.col("__cell.lo")) * CELLS), F.lit(CELLS - 1)).alias("__c")
        parts = met.groupBy(*by, F.col("__cell.lo").alias("__from"), F.col("__cell.ranks").alias("ranks"), part).agg(*bounds)
        state = materialised(_holding(parts, [*by, "__from"], ["__c"]).select(*by, "n", "lo", "hi", "ranks"), "cells")
    every = reduce(DataFrame.unionByName, done)
    pair = F.when(F.col("rank").isNotNull(), F.struct("rank", "value"))
    return every.groupBy(*by).agg(F.max("total").alias("total"), F.map_from_entries(F.collect_set(pair)).alias("found")).where("total > 0")


def quantiles(rows: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """``(*by, quantiles)``: exact quantiles with linear interpolation, as an array in the order of ``shares``.

    Unlike an exact percentile aggregate, no task holds all values of a group.
    Without values the array has nulls only (or, with ``by``, no row).
    """
    place = lambda share, total: F.lit(share) * (total - 1)
    both = lambda total: F.array(*(f(place(s, total)) for s in shares for f in (F.floor, F.ceil)))
    at = at_ranks(rows, value, both, by, weight)
    picked = []
    for share in shares:
        spot = place(share, F.col("total"))
        low, high = F.col("found")[F.floor(spot)], F.col("found")[F.ceil(spot)]
        picked.append(low + (spot - F.floor(spot)) * (high - low))
    out = at.select(*by, F.array(*picked).alias("quantiles"))
    if by:
        return out
    return out.agg(F.coalesce(F.first("quantiles"), F.array(*(F.lit(None).cast("double") for _ in shares))).alias("quantiles"))
