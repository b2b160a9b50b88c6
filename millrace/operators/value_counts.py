"""Column quality profiles from persistent value-count tables.

A value-count table has one row for each (group, load, column, value) with the
number of rows that hold the value. It is additive: a load changes it by
signed deltas, and every metric of a profile (missing share, distinct values,
range, median, entropy, pattern violations, changes of shares) is exact and
derived from the counts alone. A column with one value in a third of all rows
is one row of the table, and counts are added up before they are shuffled.

A load is a full copy of its group, so its signed delta adds its own counts
and takes away those of the load before. :class:`CountStore` writes the first
part; the second is the first part of the load before with the sign changed
and is not written again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.ordered import at_ranks
from millrace.session import broadcast_if_small, materialised, new_path

# Texts that stand for "no value", in lower case without outer blanks.
NO_VALUE = ("", "-", "--", "?", "??", ".", "\\n", "n/a", "#n/a", "nan", "none", "null", "nil", "(null)", "<null>", "<na>", "missing", "unknown", "undefined", "not available")


def missing(text: Column) -> Column:
    """Null, blank, or a text that stands for no value."""
    return text.isNull() | F.lower(F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).isin(*NO_VALUE)


@dataclass(frozen=True)
class Rules:
    """What the columns of a table are checked for."""

    texts: Sequence[str] = ()
    numbers: Sequence[str] = ()
    patterns: dict[str, str] = field(default_factory=dict)
    dates: Sequence[str] = ()
    shares: Sequence[str] = ()
    null_rise: float = 0.15
    times_median: float = 20.0
    median_up: float = 1.5
    median_down: float = 2 / 3
    share_shift: float = 0.2

    @property
    def columns(self) -> list[str]:
        return [*self.texts, *self.numbers]


def value_counts(table: DataFrame, groups: Sequence[str], rules: Rules) -> DataFrame:
    """``(*groups, column, num, txt, n)``: the count of every value of every column.

    Missing values keep their form (``txt``) in text columns; a number that is
    null or NaN has a null ``num``.
    """
    names = rules.columns
    code = lambda c: F.lit(names.index(c)).cast("tinyint").alias("code")
    text = [F.struct(code(c), F.lit(None).cast("double").alias("num"), F.col(c).cast("string").alias("txt")) for c in rules.texts]
    number = [F.struct(code(c), F.nullif(F.col(c).cast("double"), F.lit(float("nan"))).alias("num"), F.lit(None).cast("string").alias("txt")) for c in rules.numbers]
    cells = table.select(*groups, F.explode(F.array(*text, *number)).alias("cell")).select(*groups, "cell.*")
    # the number of the column stands for its name while counts are shuffled
    counted = cells.groupBy(*groups, "code", "num", "txt").agg(F.count("*").alias("n"))
    column = F.element_at(F.array(*(F.lit(c) for c in names)), F.col("code").cast("int") + 1)
    return counted.select(*groups, column.alias("column"), "num", "txt", "n")


def signed_delta(before: DataFrame, after: DataFrame, groups: Sequence[str]) -> DataFrame:
    """What turns the counts ``before`` into ``after``: rows with a positive or negative ``n``."""
    keys = [*groups, "column", "num", "txt"]
    both = after.select(*keys, "n").unionByName(before.select(*keys, (-F.col("n")).alias("n")))
    return both.groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")


def apply_delta(counts: DataFrame, delta: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The counts after a load; values whose count falls to nothing disappear."""
    keys = [*groups, "column", "num", "txt"]
    summed = counts.select(*keys, "n").unionByName(delta.select(*keys, "n")).groupBy(*keys).agg(F.sum("n").alias("n"))
    return summed.where("n <> 0")


class CountStore:
    """Value counts of every load, kept in a folder as signed deltas; ``group`` and ``load`` name the two key columns.

    ``add`` writes the deltas of the loads in a table of rows and reads
    nothing else. ``delta`` gives the signed delta of each load, ``counts``
    what the deltas up to each load add up to. Adding a load again replaces it.
    """

    def __init__(self, spark, path: str, group: str, load: str, rules: Rules):
        self.spark, self.path, self.group, self.load, self.rules = spark, path.rstrip("/"), group, load, rules
        self.keys = [group, load, "column", "num", "txt"]
        self.schema = None

    def add(self, rows: DataFrame) -> None:
        """The loads of ``rows``, any number of them in one pass; rows without a load number belong to none."""
        own = rows.where(F.col(self.load).isNotNull()).select(F.col(self.group), F.col(self.load).cast("int").alias(self.load), *self.rules.columns)
        counted = value_counts(own, [self.group, self.load], self.rules)
        # a folder a load; those of other loads stay
        placed = counted.withColumn("__load", F.col(self.load))
        self.schema = placed.schema
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__load").parquet(self.path)

    def counts(self, upto: int | None = None) -> DataFrame:
        """``(group, load, column, num, txt, n)``: the counts after each load, up to ``upto``."""
        reader = self.spark.read.schema(self.schema) if self.schema else self.spark.read
        every = reader.parquet(self.path)
        kept = every.where(F.col("__load") <= upto) if upto is not None else every
        return kept.select(*self.keys, "n")

    def following(self) -> DataFrame:
        """``(group, load, next)``: the load that follows each one in its group."""
        loads = self.counts().select(self.group, self.load).distinct()
        return loads.withColumn("next", F.lead(self.load).over(W.partitionBy(self.group).orderBy(self.load))).where("next is not null")

    def delta(self, counts: DataFrame | None = None) -> DataFrame:
        """The signed delta of each load but the first of a group: what it adds positive, what it takes away negative, equal counts gone."""
        own = self.counts() if counts is None else counts
        following = broadcast_if_small(self.following(), "loads")
        taken = own.join(following, [self.group, self.load]).select(self.group, F.col("next").alias(self.load), "column", "num", "txt", (-F.col("n")).alias("n"))
        later = following.select(self.group, F.col("next").alias(self.load))
        return own.join(later, [self.group, self.load], "left_semi").unionByName(taken).groupBy(*self.keys).agg(F.sum("n").alias("n")).where("n <> 0")


def counted(table: DataFrame, group: str, load: str, rules: Rules) -> CountStore:
    """A store of this run in the shared folder, with the loads of ``table``."""
    store = CountStore(table.sparkSession, new_path(table.sparkSession, "value-counts"), group, load, rules)
    store.add(table)
    return store


def _is_missing(rules: Rules) -> Column:
    return F.when(F.col("column").isin(*rules.numbers), F.col("num").isNull()).otherwise(missing(F.col("txt")))


def _is_bad(rules: Rules) -> Column:
    """A value that is not missing and has not the usual format, or is no real date."""
    checks = [F.when(F.col("column") == c, ~F.col("txt").rlike(p)) for c, p in rules.patterns.items()]
    checks += [F.when(F.col("column") == c, F.try_to_date("txt", "yyyy-MM-dd").isNull()) for c in rules.dates]
    wrong = reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in checks), F.lit(False))
    return wrong & ~F.col("missing")


def profile(counts: DataFrame, groups: Sequence[str], rules: Rules) -> DataFrame:
    """``(*groups, column, total, missing, present, distinct, entropy, low, high, bad)`` of each column.

    ``entropy`` is in nats, over the values not missing; a column without
    values has none. ``low`` and ``high`` are the range of a number column,
    ``bad`` the rows that violate the column's pattern.
    """
    judged = counts.withColumn("missing", _is_missing(rules)).withColumn("bad", _is_bad(rules))
    present = F.when(~F.col("missing"), F.col("n"))
    out = judged.groupBy(*groups, "column").agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(F.col("missing"), F.col("n"))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(present), F.lit(0)).alias("present"),
        F.count(present).alias("distinct"),
        F.sum(present * F.log(present.cast("double"))).alias("__nlogn"),
        F.min("num").alias("low"),
        F.max("num").alias("high"),
        F.coalesce(F.sum(F.when(F.col("bad"), F.col("n"))), F.lit(0)).alias("bad"),
    )
    entropy = F.when(F.col("present") > 0, F.log(F.col("present").cast("double")) - F.col("__nlogn") / F.col("present"))
    return out.withColumn("entropy", entropy).drop("__nlogn")


def medians(counts: DataFrame, groups: Sequence[str], rules: Rules) -> DataFrame:
    """``(*groups, column, median)``, exact, of the number columns with values; no task gets a whole group."""
    keys = [*groups, "column"]
    numbers = counts.where(F.col("column").isin(*rules.numbers) & F.col("num").isNotNull())
    middle = lambda total: F.array(F.floor((total - 1) / 2), F.floor(total / 2))
    found = at_ranks(numbers, "num", middle, keys, weight="n")
    low, high = (F.col("found")[r] for r in (F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)))
    return found.select(*keys, ((low + high) / 2).alias("median"))


def share_shifts(counts: DataFrame, profiles: DataFrame, following: DataFrame, group: str, load: str, rules: Rules) -> DataFrame:
    """``(group, load, column, shift)``: the largest change of a value's share since the load before.

    Each load's shares count positive for itself and negative for the load
    that follows it; a value's change is the sum. ``following`` has
    ``(group, load, next)``.
    """
    keys = [group, load, "column"]
    present = counts.where(F.col("column").isin(*rules.shares)).withColumn("missing", _is_missing(rules)).where("not missing")
    shared = present.join(profiles.select(*keys, "present"), keys).select(*keys, "txt", (F.col("n") / F.col("present")).alias("share"))
    before = shared.join(following, [group, load]).select(group, F.col("next").alias(load), "column", "txt", (-F.col("share")).alias("share"))
    change = shared.unionByName(before).groupBy(*keys, "txt").agg(F.sum("share").alias("share"))
    return change.groupBy(*keys).agg(F.max(F.abs("share")).alias("shift"))


def recorded_profiles(records: DataFrame, group: str, load: str, structure: str = "structure", at: str = "profiled_at") -> DataFrame:
    """``(group, load, column, recorded, dtype, usual)`` from the loader's JSON records.

    Of several records of a load the last with a readable structure counts.
    ``usual`` is the dtype that most loads of the group record for the column
    (of equally many, the first by name).
    """
    parsed = records.withColumn("__s", F.from_json(structure, "missing_values MAP<STRING, BIGINT>, dtypes MAP<STRING, STRING>"))
    last = parsed.where("__s.missing_values is not null or __s.dtypes is not null").groupBy(group, load).agg(F.max_by("__s", F.struct(at, structure)).alias("s"))
    dtypes = last.select(group, load, F.explode("s.dtypes").alias("column", "dtype"))
    counted = dtypes.where("dtype is not null").groupBy(group, "column", "dtype").agg(F.count("*").alias("n"))
    usual = counted.groupBy(group, "column").agg(F.min_by("dtype", F.struct((-F.col("n")).alias("m"), "dtype")).alias("usual"))
    numbers = last.select(group, load, F.explode("s.missing_values").alias("column", "recorded"))
    return numbers.join(dtypes, [group, load, "column"], "full").join(usual, [group, "column"], "left")


def find_load_defects(table: DataFrame, records: DataFrame, rules: Rules, group: str = "series", load: str = "load_no") -> DataFrame:
    """``(group, load, column_name, kind)`` of every defect of a load.

    Loads are held against the one before in the same group. All rows count,
    repeated ones too. Rows without a load number belong to no load; a null
    group is a group. Columns without values have neither median nor shares.
    """
    none = "\u0000"
    own = table.where(F.col(load).isNotNull()).withColumn(group, F.coalesce(group, F.lit(none)))
    groups = [group, load]
    store = counted(own, group, load, rules)
    counts = store.counts()
    profiles = profile(counts, groups, rules).join(medians(counts, groups, rules), [*groups, "column"], "left")
    profiles = materialised(profiles, "profiles")
    following = broadcast_if_small(store.following(), "loads")
    before = profiles.join(following, groups).select(
        group, F.col("next").alias(load), "column", (F.col("missing") / F.col("total")).alias("rate_before"), F.col("median").alias("median_before"), F.col("present").alias("present_before")
    )
    shifts = share_shifts(counts, profiles, following, group, load, rules)
    recorded = recorded_profiles(records.where(F.col(load).isNotNull()).withColumn(group, F.coalesce(group, F.lit(none))), group, load)
    keys = [*groups, "column"]
    seen = profiles.join(before, keys, "left").join(shifts, keys, "left").join(recorded, keys, "left")
    slack = 1e-9
    moved = (F.col("median") >= rules.median_up * F.col("median_before") - slack) | (F.col("median") <= rules.median_down * F.col("median_before") + slack)
    kinds = {
        "null_rate": F.col("missing") / F.col("total") - F.col("rate_before") >= rules.null_rise - slack,
        "pattern": F.col("bad") > 0,
        "value_range": (F.col("low") < 0) | (F.col("high") > rules.times_median * F.col("median")),
        "distribution": F.coalesce(moved & (F.col("median_before") > 0), F.lit(False))
        | F.coalesce((F.col("shift") >= rules.share_shift - slack) & (F.col("present") > 0) & (F.col("present_before") > 0), F.lit(False)),
        "missing_values": F.col("recorded") != F.col("missing"),
        "dtypes": F.col("dtype") != F.col("usual"),
    }
    flagged = F.filter(F.array(*(F.when(test, F.lit(kind)) for kind, test in kinds.items())), lambda k: k.isNotNull())
    return seen.select(F.nullif(F.col(group), F.lit(none)).alias(group), load, F.col("column").alias("column_name"), F.explode(flagged).alias("kind"))
