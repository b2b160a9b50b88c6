"""Profiles of tables: columns, name patterns, outliers, quality, a folder's tables as a whole."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.scalars import digits_as_hole
from millrace.operators.ordered import quantiles


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns of a number type; arrays and texts are none, decimals are."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def profile_columns(df: DataFrame, name: str, distinct: bool = True) -> DataFrame:
    """``(table, column, type, total, missing, distinct, low, high)``, a row a column, in one pass.

    NaN counts as missing. ``low`` and ``high`` are texts of the extremes.
    """
    aggs, rows = [F.count(F.lit(1)).alias("__total")], []
    for k, f in enumerate(df.schema):
        c = F.col(f"`{f.name}`")
        value = F.nullif(c, F.lit(float("nan")).cast(f.dataType)) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else c
        ordered = isinstance(f.dataType, T.AtomicType)
        shown = lambda x: x.cast("string") if ordered else F.lit(None).cast("string")
        aggs += [F.count(value).alias(f"__p{k}"), shown(F.min(value) if ordered else F.lit(None)).alias(f"__l{k}"), shown(F.max(value) if ordered else F.lit(None)).alias(f"__h{k}")]
        if distinct and ordered:
            aggs.append(F.count_distinct(value).alias(f"__d{k}"))
        rows.append(
            F.struct(
                F.lit(name).alias("table"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col("__total").alias("total"),
                (F.col("__total") - F.col(f"__p{k}")).alias("missing"), (F.col(f"__d{k}") if distinct and ordered else F.lit(None).cast("bigint")).alias("distinct"),
                F.col(f"__l{k}").alias("low"), F.col(f"__h{k}").alias("high"),
            )
        )
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def name_patterns(columns: DataFrame, column: str, least: int = 5) -> DataFrame:
    """``(pattern, members, first, last)``: names that differ only in numbers; smaller groups stand alone."""
    grouped = columns.select(column).distinct().withColumn("pattern", digits_as_hole(F.col(column)))
    by = grouped.groupBy("pattern").agg(F.count("*").alias("members"), F.min(column).alias("first"), F.max(column).alias("last"), F.collect_list(column).alias("all"))
    many = by.where(F.col("members") >= least).select("pattern", "members", "first", "last")
    single = by.where(F.col("members") < least).select(F.explode("all").alias("pattern")).select("pattern", F.lit(1).cast("bigint").alias("members"), F.col("pattern").alias("first"), F.col("pattern").alias("last"))
    return many.unionByName(single)


def iqr_outliers(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> DataFrame:
    """``(column, q1, q3, outliers)``: values beyond the quartiles by a multiple of their distance, two passes."""
    parts = [quantiles(df, c, [0.25, 0.75]).select(F.col("quantiles")[0].alias(f"{c}__q1"), F.col("quantiles")[1].alias(f"{c}__q3")) for c in columns]
    quart = reduce(DataFrame.crossJoin, parts)  # one row each
    joined = df.select(*columns).crossJoin(F.broadcast(quart))  # one row
    low = lambda c: F.col(f"{c}__q1") - factor * (F.col(f"{c}__q3") - F.col(f"{c}__q1"))
    high = lambda c: F.col(f"{c}__q3") + factor * (F.col(f"{c}__q3") - F.col(f"{c}__q1"))
    counted = joined.agg(*(F.count_if((F.col(c) < low(c)) | (F.col(c) > high(c))).alias(c) for c in columns), *(F.first(f"{c}__{q}").alias(f"{c}__{q}") for c in columns for q in ("q1", "q3")))
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__q1").alias("q1"), F.col(f"{c}__q3").alias("q3"), F.col(c).alias("outliers")) for c in columns]
    return counted.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def quality(profile: DataFrame) -> DataFrame:
    """``(table, columns, completeness, constant_columns)`` of a column profile, a row a table."""
    full = 1 - F.try_divide("missing", "total")
    return profile.groupBy("table").agg(F.count("*").alias("columns"), F.avg(full).alias("completeness"), F.count_if(F.col("distinct") <= 1).alias("constant_columns"))


def key_consistency(documents: DataFrame, json: str) -> DataFrame:
    """One row ``(documents, all_keys, common_keys, consistent)`` over JSON objects; others count as having no keys."""
    keys = documents.select(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")).alias("k"))
    total = keys.agg(F.count("*").alias("n"))
    seen = keys.select(F.explode(F.array_distinct("k")).alias("key")).groupBy("key").agg(F.count("*").alias("with"))
    judged = seen.crossJoin(F.broadcast(total))  # one row
    out = judged.agg(F.count("*").alias("all_keys"), F.count_if(F.col("with") == F.col("n")).alias("common_keys"))
    return total.crossJoin(out).select(F.col("n").alias("documents"), "all_keys", "common_keys", (F.col("all_keys") == F.col("common_keys")).alias("consistent"))


def explore(profiles: DataFrame) -> DataFrame:
    """One row over all tables: their number, rows, columns, shared columns, and whether anything is missing."""
    tables = profiles.groupBy("table").agg(F.max("total").alias("rows"))
    shared = profiles.groupBy("column").agg(F.count_distinct("table").alias("t"))
    a = tables.agg(F.count("*").alias("tables"), F.sum("rows").alias("rows"))
    b = shared.agg(F.count("*").alias("columns"), F.count_if(F.col("t") > 1).alias("shared_columns"))
    return a.crossJoin(b).crossJoin(profiles.agg(F.max(F.col("missing") > 0).alias("any_missing")))  # one row each


def profile_tables(tables: Mapping[str, DataFrame], distinct: bool = True) -> DataFrame:
    """The column profiles of several tables, one below the other."""
    return reduce(DataFrame.unionByName, (profile_columns(df, name, distinct) for name, df in tables.items()))


def consistency(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """One row ``(total, consistent, rate)`` of two feeds of the same number, by key; one-sided keys are inconsistent."""
    both = left.select(*keys, F.col(value).alias("a")).join(right.select(*keys, F.col(value).alias("b")), list(keys), "full")
    same = F.coalesce(F.abs(F.col("a") - F.col("b")) <= tolerance, F.lit(False))
    return both.agg(F.count("*").alias("total"), F.count_if(same).alias("consistent"), F.avg(same.cast("double")).alias("rate"))
