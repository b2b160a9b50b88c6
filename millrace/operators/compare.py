"""Scores of an output against an expected answer: tables, texts, arrays, JSON, files."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.scalars import FILLER_WORDS, collapsed

#: Without a tolerance of its own a number may be off by so much.
ABSOLUTE = 0.01
#: A tolerance of None means this share of the larger magnitude.
RELATIVE = 0.01
TINY = 1e-12


def _number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def _text(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string")))


def _missing(c: Column, kind: T.DataType) -> Column:
    return c.isNull() | F.isnan(c) if isinstance(kind, (T.FloatType, T.DoubleType)) else c.isNull()


def cells_match(g: Column, p: Column, gold_kind: T.DataType, kind: T.DataType, tolerance: float | None | str = "absolute") -> Column:
    """Whether two cells agree. Missing agrees with missing only.

    Numbers agree within 0.01, or within a share of the larger magnitude if a
    tolerance is given (None: one percent); then zero agrees with zero only.
    Other values agree as trimmed lower-case texts.
    """
    gone, lost = _missing(g, gold_kind), _missing(p, kind)
    if _number(gold_kind) and _number(kind):
        a, b = g.cast("double"), p.cast("double")
        if tolerance == "absolute":
            same = F.abs(a - b) <= F.greatest(F.lit(ABSOLUTE), 1e-9 * F.greatest(F.abs(a), F.abs(b)))
        else:
            share = RELATIVE if tolerance is None else float(tolerance)
            big = F.greatest(F.abs(a), F.abs(b))
            zero = (F.abs(a) < TINY) | (F.abs(b) < TINY)
            same = F.when((F.abs(a) < TINY) & (F.abs(b) < TINY), True).when(zero, False).otherwise(F.abs(a - b) / big <= share)
    elif _number(gold_kind) != _number(kind):
        same = F.lit(False)
    else:
        same = _text(g) == _text(p)
    return F.when(gone | lost, gone & lost).otherwise(same)


def score_ordered(output: DataFrame, gold: DataFrame, index: str, columns: Sequence[str] | None = None, tolerances: Mapping[str, float | None] | None = None) -> DataFrame:
    """``(column, matched)`` of each expected column: whether some output column equals it row by row.

    ``index`` numbers the rows of both tables; columns are matched by content,
    not by name. All pairs of columns are judged in one pass over one join.
    An output with another number of rows matches nothing.
    """
    wanted = [c for c in (columns or gold.columns) if c != index]
    offered = [c for c in output.columns if c != index]
    g = gold.select(F.col(index).alias("__i"), *(F.col(c).alias(f"g{k}") for k, c in enumerate(wanted)), F.lit(1).alias("__g"))
    p = output.select(F.col(index).alias("__i"), *(F.col(c).alias(f"p{k}") for k, c in enumerate(offered)), F.lit(1).alias("__p"))
    both = g.join(p, "__i", "full")
    whole = F.col("__g").isNotNull() & F.col("__p").isNotNull()
    tests = [
        F.bool_and(whole & F.coalesce(cells_match(F.col(f"g{a}"), F.col(f"p{b}"), gold.schema[c].dataType, output.schema[d].dataType, (tolerances or {}).get(c, "absolute")), F.lit(False))).alias(f"t{a}_{b}")
        for a, c in enumerate(wanted)
        for b, d in enumerate(offered)
    ]
    judged = both.agg(*tests)
    rows = [F.struct(F.lit(c).alias("column"), F.coalesce(F.array_contains(F.array(*(F.col(f"t{a}_{b}") for b in range(len(offered)))), True), F.lit(False)).alias("matched")) for a, c in enumerate(wanted)]
    return judged.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _values(df: DataFrame, columns: Sequence[str], steps: Mapping[str, float | None]) -> DataFrame:
    """``(c, v)``: distinct comparable values of each column as text; numbers rounded to their step, half to even."""
    out = []
    for c in columns:
        kind = df.schema[c].dataType
        step = steps.get(c, ABSOLUTE) or RELATIVE
        value = F.bround(F.col(c).cast("double") / step).cast("string") if _number(kind) else _text(F.col(c))
        out.append(F.struct(F.lit(c).alias("c"), F.when(_missing(F.col(c), kind), "__na__").otherwise(value).alias("v")))
    return df.select(F.explode(F.array(*out)).alias("x")).select("x.*").distinct()


def _step(column: Column, wanted: Sequence[str], steps: Mapping[str, float | None]) -> Column:
    """The step of a column's numbers."""
    return F.create_map(*(x for c in wanted for x in (F.lit(c), F.lit(float(steps.get(c, ABSOLUTE) or RELATIVE)))))[column]


def resolve_columns(df: DataFrame, wanted: Sequence[str | int]) -> list[str]:
    """Names of columns given by name or by 0-based place, as a number or its text; a name goes before a place."""
    names = df.columns
    return [c if c in names else names[int(c)] for c in wanted]


def resolve_tolerances(df: DataFrame, tolerances: Mapping[str | int, float | None]) -> dict[str, float | None]:
    """Tolerances by name, from names or places of the expected columns."""
    return dict(zip(resolve_columns(df, list(tolerances)), tolerances.values(), strict=True))


def score_unordered(output: DataFrame, gold: DataFrame, columns: Sequence[str] | None = None, tolerances: Mapping[str, float | None] | None = None) -> DataFrame:
    """``(column, matched)``: whether some output column holds every value of the expected one.

    How often a value occurs and further output rows do not matter. Numbers
    are rounded to the tolerance of the expected column, on both sides. Values
    are joined by equality; nothing is compared pairwise.
    """
    wanted, steps = list(columns or gold.columns), tolerances or {}
    g = _values(gold, wanted, steps).withColumnsRenamed({"c": "column"}).withColumn("step", _step(F.col("column"), wanted, steps))
    sizes = sorted({steps.get(c, ABSOLUTE) or RELATIVE for c in wanted})
    offered = [_values(output, output.columns, dict.fromkeys(output.columns, size)).withColumn("step", F.lit(size)) for size in sizes]
    p = reduce(DataFrame.unionByName, offered).withColumnsRenamed({"c": "other"})
    need = g.groupBy("column").agg(F.count("*").alias("need"))
    have = g.join(p, ["v", "step"]).groupBy("column", "other").agg(F.count("*").alias("have"))
    best = have.groupBy("column").agg(F.max("have").alias("have"))
    return need.join(best, "column", "left").select("column", (F.coalesce("have", F.lit(0)) == F.col("need")).alias("matched"))


def total_score(matches: DataFrame, rule: str = "divide") -> DataFrame:
    """One row ``(score)``: the share of matched columns, or all or nothing."""
    each = F.col("matched").cast("double")
    return matches.agg(F.coalesce(F.avg(each) if rule == "divide" else F.min(each), F.lit(0.0)).alias("score"))


def signatures(df: DataFrame, index: str | None = None) -> DataFrame:
    """``(column, signature)``: an order-free fingerprint of each column's values, or one that has their order.

    Hashes of the values (with their row number, if they are ordered) are added up in 128 bits.
    """
    columns = [c for c in df.columns if c != index]
    place = [F.col(index)] if index else []
    hashed = [F.sum(F.xxhash64(*place, F.coalesce(_text(F.col(c)), F.lit("__na__"))).cast("decimal(38,0)")).alias(c) for c in columns]
    sums = df.agg(*hashed)
    return sums.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "column", "signature")


def missing_values(output: DataFrame, gold: DataFrame, column: str, limit: int = 50) -> DataFrame:
    """A report of the first expected values, in order, that the output lacks."""
    lost = gold.select(column).distinct().join(output.select(column).distinct(), column, "left_anti")
    return lost.orderBy(F.col(column).asc_nulls_last()).limit(limit)


def texts_equal(a: Column, b: Column) -> Column:
    return collapsed(a) == collapsed(b)


def arrays_close(a: Column, b: Column, scale: bool = False, absolute: float = 1e-2, relative: float = 1e-5) -> Column:
    """Whether two number arrays agree as sorted lists, raw or as shares of their sums."""
    share = lambda x: F.transform(x, lambda v: F.try_divide(v, F.aggregate(x, F.lit(0.0), lambda s, w: s + w)))
    x, y = (F.array_sort(share(c) if scale else c) for c in (a, b))
    close = F.forall(F.zip_with(x, y, lambda u, v: F.abs(u - v) <= absolute + relative * F.abs(v)), lambda t: F.coalesce(t, F.lit(False)))
    return F.when(F.size(a) == F.size(b), close).otherwise(False)


def snapshot_changes(before: DataFrame, after: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``(path, change)``: ``added`` or ``changed`` files; only fingerprints meet."""
    old = before.select(F.col(path).alias("path"), F.sha2(content, 256).alias("old"))
    new = after.select(F.col(path).alias("path"), F.sha2(content, 256).alias("new"))
    joined = new.join(old, "path", "left")
    return joined.where(~F.col("new").eqNullSafe(F.col("old"))).select("path", F.when(F.col("old").isNull(), "added").otherwise("changed").alias("change"))


# JSON documents


def _bare(key: str) -> str:
    return re.sub(r"[_\- ]", "", re.sub(rf"\b(?:{'|'.join(FILLER_WORDS)})\b", "", str(key).lower()))


def _find(key: str, keys: Sequence[str]) -> str | None:
    """The output key for an expected one: itself, the same bare name, one within the other, or similar letters."""
    if key in keys:
        return key
    bare = _bare(key)
    for same in (lambda k: _bare(k) == bare, lambda k: bool(bare) and bool(_bare(k)) and (bare in _bare(k) or _bare(k) in bare)):
        hit = next((k for k in keys if same(k)), None)
        if hit is not None:
            return hit
    scored = [(len(set(bare) & set(_bare(k))) / max(1, len(set(bare) | set(_bare(k)))), k) for k in keys]
    best = max(scored, default=(0.0, None), key=lambda x: x[0])
    return best[1] if best[0] > 0.6 else None


def json_score(output: object, gold: object, rule: object = None) -> float:
    """How well a JSON value meets the expected one, between 0 and 1.

    ``rule`` is a relative tolerance, a range ``[low, high]``, or a dictionary
    of rules by key. Numbers agree within one percent, texts trimmed and
    without case; lists need the same length, each expected element taking the
    best unused one; dictionaries are the mean over the expected keys.
    """
    if isinstance(rule, (list, tuple)) and len(rule) == 2:
        return float(isinstance(output, (int, float)) and not isinstance(output, bool) and rule[0] <= output <= rule[1])
    if isinstance(rule, dict):
        if not isinstance(output, dict) or not rule:
            return 0.0
        parts = []
        for key, inner in rule.items():
            hit = _find(key, list(output))
            want = gold.get(key) if isinstance(gold, dict) else None
            parts.append(json_score(output[hit], want, inner) if hit is not None else 0.0)
        return sum(parts) / len(parts)
    share = rule if isinstance(rule, (int, float)) and not isinstance(rule, bool) else RELATIVE
    if isinstance(gold, bool) or isinstance(output, bool) or gold is None or output is None:
        return float(gold is output)
    if isinstance(gold, (int, float)) and isinstance(output, (int, float)):
        if math.isnan(gold) or math.isnan(output):
            return float(math.isnan(gold) and math.isnan(output))
        return float(abs(output - gold) / max(abs(gold), TINY) <= share)
    if isinstance(gold, str) and isinstance(output, str):
        return float(gold.strip().lower() == output.strip().lower())
    if isinstance(gold, list) and isinstance(output, list):
        if len(gold) != len(output):
            return 0.0
        free, total = list(output), 0.0
        for want in gold:
            scored = [json_score(have, want, rule) for have in free]
            best = max(range(len(scored)), key=scored.__getitem__, default=None)
            if best is not None:
                total += scored[best]
                free.pop(best)
        return total / len(gold) if gold else 1.0
    if isinstance(gold, dict) and isinstance(output, dict):
        if not gold:
            return 1.0
        hits = {key: _find(key, list(output)) for key in gold}
        return sum(json_score(output[h], gold[k], rule) if (h := hits[k]) is not None else 0.0 for k in gold) / len(gold)
    return 0.0


def range_score(value: Column, first: float, second: float) -> Column:
    """Linear between two bounds, 0 at the first and 1 at the second; null scores 0."""
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - first) / (second - first) + 1e-9)), F.lit(0.0))


def score_json_columns(rows: DataFrame, output: str, gold: str, rule: object = None, name: str = "score") -> DataFrame:
    """``rows`` with the score of each pair of JSON texts; text that is no JSON scores 0."""

    def one(a: str | None, b: str | None) -> float:
        try:
            return json_score(json.loads(a or ""), json.loads(b or ""), rule)
        except ValueError:
            return 0.0

    @F.pandas_udf("double")
    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return rows.withColumn(name, scored(output, gold))


def merge_scores(scores: Sequence[DataFrame]) -> DataFrame:
    """One row ``(score)``: the best of several expected answers, a row each."""
    return reduce(DataFrame.unionByName, scores).agg(F.max("score").alias("score"))
