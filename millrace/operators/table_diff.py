"""Differences between two copies of a table, by a column-by-bucket checksum matrix.

Each copy is reduced to hashes, one record a key, the keys are hashed into
buckets, and for each bucket and column the hashes of its values are added up.
Sums are independent of the order of rows. Equal sums of a bucket's keys and
columns mean equal contents; only the buckets that differ are read again, and
of their rows only the columns that differ are moved and compared by key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import broadcast_if_small

#: Rows a bucket has on average: few, so that many buckets are equal even if a tenth of the rows differ.
ROWS_A_BUCKET = 8


def canonical(column: Column, kind: T.DataType, tolerance: float) -> Column:
    """What of a value counts: trimmed lower-case text, a number without NaN."""
    if isinstance(kind, T.StringType):
        return F.lower(F.trim(F.regexp_replace(column, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.nullif(column.cast("double"), F.lit(float("nan")))
    return column


def _cell(column: Column, kind: T.DataType, tolerance: float) -> Column:
    """A value as it is hashed. Numbers further apart than the tolerance are in different cells."""
    if isinstance(kind, (T.FloatType, T.DoubleType)) and tolerance > 0:
        return F.floor(column / tolerance).cast("string")
    return column.cast("string")


def _hashes(table: DataFrame, key: str, columns: Sequence[str], kinds: dict[str, T.DataType], tolerance: float) -> list[Column]:
    """A 64-bit hash of key and value for each column."""
    fields = {c: canonical(F.col(c), kinds[c], tolerance) for c in columns}
    return [F.xxhash64(F.lit(c), F.col(key), _cell(f, kinds[c], tolerance), f.isNull()) for c, f in fields.items()]


def _bucket(key: str, buckets: int) -> Column:
    # the hash by which rows are shuffled by key: with a multiple of the tasks as number, no bucket lies in two of them
    return F.pmod(F.hash(key), F.lit(buckets))


def _wide(h: Column, key: str, name: str) -> list[Column]:
    """An additive hash of 128 bits: two independent hashes, summed in halves of 32 bits that cannot overflow."""
    two = (h, F.xxhash64(F.lit(2), h, F.col(key)))
    return [f(x).alias(f"{name}__{k}{n}") for k, x in enumerate(two) for n, f in (("l", lambda x: F.sum(x.bitwiseAND(0xFFFFFFFF))), ("h", lambda x: F.sum(F.shiftright(x, 32))))]


def checksums(table: DataFrame, key: str, columns: Sequence[str], buckets: int, latest: str | None = None, tolerance: float = 1e-6) -> DataFrame:
    """``(__bucket, __rows__*, <column>__*)``: sums of the hashes of one record a key, four for each column."""
    kinds = {c: table.schema[c].dataType for c in columns}
    names = [f"__h{k}" for k in range(len(columns))]
    hashed = table.select(F.col(key), F.col(latest).alias("__at") if latest else F.lit(0).alias("__at"), *(h.alias(n) for h, n in zip(_hashes(table, key, columns, kinds, tolerance), names, strict=True)))
    record = F.struct("__at", F.xxhash64(*names).alias("__r"), *names) if names else F.struct("__at")
    once = hashed.groupBy(key).agg(F.max(record).alias("r")).select(key, *(F.col(f"r.{n}").alias(n) for n in names))
    sums = [*_wide(F.xxhash64(key), key, "__rows"), *(x for c, n in zip(columns, names, strict=True) for x in _wide(F.col(n), key, c))]
    return once.groupBy(_bucket(key, buckets).alias("__bucket")).agg(*sums)


def unequal_cells(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(__bucket, __unequal)``: the buckets whose checksums differ, with an array of flags for the columns, and all set if the keys differ in number."""
    differ = lambda c: reduce(lambda x, y: x | y, (~F.col(f"a.{c}__{k}").eqNullSafe(F.col(f"b.{c}__{k}")) for k in ("0l", "0h", "1l", "1h")))
    matrix = left.alias("a").join(right.alias("b"), "__bucket", "full").select("__bucket", differ("__rows").alias("__keys"), F.array(*map(differ, columns)).cast("array<boolean>").alias("__cells"))
    return matrix.where(F.col("__keys") | F.exists("__cells", lambda x: x)).select("__bucket", F.col("__cells").alias("__unequal"))


def differences(
    left: DataFrame, right: DataFrame, key: str, columns: Sequence[str], latest: str | None = None, tolerance: float = 1e-6, buckets: int | None = None
) -> DataFrame:
    """``(key, difference)``: ``only_left``, ``only_right``, or the name of a differing column.

    Equal are null and NaN, numbers at most ``tolerance`` apart, and texts
    that agree after trimming and ignoring case. A missing value differs from
    a present one. A null key is a key. Of rows with the same key the latest
    counts. Columns that are not named are not compared.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if buckets is None:
        buckets = max(left.count(), right.count()) // ROWS_A_BUCKET
    buckets = tasks * max(1, -(-buckets // tasks))
    kinds = {c: left.schema[c].dataType for c in columns}
    sums = [checksums(t, key, columns, buckets, latest, tolerance) for t in (left, right)]
    suspects = broadcast_if_small(unequal_cells(*sums, columns), "unequal-buckets")
    read = []
    for side, t in enumerate((left, right)):
        marked = t.withColumn("__bucket", _bucket(key, buckets)).join(suspects, "__bucket")
        mine = {c: t.schema[c].dataType for c in columns}
        # of equal columns nothing is moved
        fields = [F.when(F.col("__unequal")[k], canonical(F.col(c), mine[c], tolerance)).alias(f"f{k}") for k, c in enumerate(columns)]
        order = F.xxhash64(*_hashes(t, key, columns, mine, tolerance)) if columns else F.lit(0).cast("bigint")
        record = F.struct((F.col(latest) if latest else F.lit(0)).alias("at"), order.alias("r"), *fields)
        read.append(marked.select(F.col(key).alias("__key"), F.lit(side).alias("__side"), record.alias("__r")))
    of = lambda side: F.max(F.when(F.col("__side") == side, F.col("__r")))
    met = read[0].unionByName(read[1]).groupBy("__key").agg(of(0).alias("x"), of(1).alias("y"))
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    found = [
        F.when(F.col("y").isNull(), F.lit("only_left")),
        F.when(F.col("x").isNull(), F.lit("only_right")),
        *(F.when(both & _differ(F.col(f"x.f{k}"), F.col(f"y.f{k}"), kinds[c], tolerance), F.lit(c)) for k, c in enumerate(columns)),
    ]
    listed = F.filter(F.array(*found), lambda k: k.isNotNull())
    return met.select(F.col("__key").alias(key), F.explode(listed).alias("difference"))


def _differ(x: Column, y: Column, kind: T.DataType, tolerance: float) -> Column:
    missing = x.isNull() != y.isNull()
    if isinstance(kind, T.NumericType):
        return missing | F.coalesce(F.abs(x - y) > F.lit(tolerance) * (1 + 1e-9), F.lit(False))
    return missing | F.coalesce(x != y, F.lit(False))
