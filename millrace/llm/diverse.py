"""A varied subset: max-sum dispersion by local search over composable core-sets.

Records with the same set of skills are one candidate, so a large group of
similar records weighs no more than a small one. The distance of two
candidates is one minus the weighted share of common skills. Each partition
keeps the local optimum of its candidates as core-set: selected and unselected
candidates are swapped while the total pairwise distance grows. Local optima
are composable for this total: the best subset of all core-sets is within a
constant factor of that of all candidates. A partition is read as a stream in
bounded memory, and core-sets are joined in a tree of rounds, ``FAN_IN`` of
them a task, until one is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import materialised

#: Core-sets that meet in one task of a later round.
FAN_IN = 8

#: Candidates read at once into a core-set, and distances a task holds at most (4 bytes each); beyond them they are computed again for each swap.
STREAM_ROWS, HELD_DISTANCES = 2000, 1 << 26

#: Weight of a skill without a positive one, as a share of the smallest positive weight.
FLOOR = 0.5


def weights_of(skills: DataFrame, key: str = "id", weight: str = "weight") -> dict[str, float]:
    """Weight of each skill; null, zero and negative ones get half the smallest positive weight.

    The table of skills is a fixed catalogue, held by the driver and each task.
    """
    rows = skills.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(F.nanvl(F.col(weight).cast("double"), F.lit(0.0))).alias("w")).collect()
    least = min((r["w"] for r in rows if r["w"] and r["w"] > 0), default=1.0)
    return {r["k"]: r["w"] if r["w"] and r["w"] > 0 else FLOOR * least for r in rows}


class _Candidates:
    """Candidates as rows of skills, for distances from all to some of them."""

    def __init__(self, sets: list[tuple[str, ...]], weights: dict[str, float]):
        at = {s: k for k, s in enumerate(sorted({s for x in sets for s in x}))}
        self.w = np.array([weights[s] for s in at], np.float32)
        self.m = np.zeros((len(sets), len(at)), np.float32)
        for k, x in enumerate(sets):
            self.m[k, [at[s] for s in x]] = 1
        self.own = self.m @ self.w

    def distance(self, rows, to) -> np.ndarray:
        common = (self.m[rows] * self.w) @ self.m[to].T
        return 1 - common / np.maximum(self.own[rows][:, None] + self.own[to][None, :] - common, np.float32(1e-30))


def farthest(c: _Candidates, size: int) -> list[int]:
    """The heaviest candidate, then again and again the one farthest from those chosen."""
    n = len(c.m)
    if n <= size:
        return list(range(n))
    every = np.arange(n)
    chosen = [int(np.lexsort((every, -c.own))[0])]
    near = c.distance(every, chosen)[:, 0]
    total = near.astype(np.float64)
    while len(chosen) < size:
        near[chosen] = -1
        best = int(np.lexsort((every, -c.own, -total, -near))[0])
        chosen.append(best)
        d = c.distance(every, [best])[:, 0]
        near = np.minimum(near, d)
        total += d
    return chosen


def disperse(sets: list[tuple[str, ...]], weights: dict[str, float], size: int, gain: float = 1e-4) -> list[int]:
    """``size`` of the sets, such that no single swap raises their total pairwise distance by more than ``gain``."""
    n = len(sets)
    if n <= size:
        return list(range(n))
    c = _Candidates(sets, weights)
    chosen = np.array(farthest(c, size))
    block = max(1, HELD_DISTANCES // size)
    starts = range(0, n, block)
    kept = {at: c.distance(slice(at, at + block), chosen) for at in starts} if n <= block else {}
    to = np.concatenate([(kept[at] if kept else c.distance(slice(at, at + block), chosen)).sum(axis=1, dtype=np.float64) for at in starts])
    while True:
        free = np.ones(n, bool)
        free[chosen] = False
        best = (gain, 0, 0)
        for at in starts:
            d = kept[at] if kept else c.distance(slice(at, at + block), chosen)
            gains = to[at : at + block, None] - d - to[chosen][None, :]
            gains[~free[at : at + block]] = -1
            k = int(np.argmax(gains))
            if gains.flat[k] > best[0]:
                best = (float(gains.flat[k]), at + k // size, k % size)
        if best[0] <= gain:
            return sorted(chosen.tolist())
        _, new, place = best
        fresh = c.distance(slice(0, n), [new])[:, 0]
        to += fresh.astype(np.float64) - c.distance(slice(0, n), [int(chosen[place])])[:, 0]
        chosen[place] = new
        for at in kept:
            kept[at][:, place] = fresh[at : at + block]


def total_distance(sets: list[tuple[str, ...]], weights: dict[str, float]) -> float:
    """The total pairwise distance of the sets."""
    c = _Candidates(sets, weights)
    return float(sum(c.distance([k], slice(k + 1, None)).sum(dtype=np.float64) for k in range(len(sets))))


def varied_subset(
    records: DataFrame, weights: dict[str, float], size: int, key: str = "step_id", skills: str = "skills", partitions: int | None = None
) -> DataFrame:
    """``(rank, key, skills, records, new_weight)``: a subset of ``size`` records.

    ``records`` is the number of records with the same skills, ``new_weight``
    the weight of skills that no row of a lower rank has; ranks follow the
    greatest new weight. Null keys, null skills and skills without a weight
    are left out; records without any skill are no candidates. With fewer
    different sets than ``size``, sets are taken repeatedly, as evenly as they
    have records. Ties go to the smaller set, then the smaller key. The first
    round has ``partitions`` core-sets, by default two a core of the cluster.
    """
    known = F.array(*(F.lit(k) for k in sorted(weights)))
    clean = F.array_sort(F.array_distinct(F.array_intersect(F.col(skills), known)))
    sets = records.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), clean.alias("set")).where(F.size("set") > 0)
    counted = materialised(sets.groupBy("set").agg(F.count("*").alias("records"), F.min("key").alias("key")), "varied-candidates")
    n_sets = counted.count()
    copies = 1 if n_sets >= size else -(-size // max(1, n_sets))
    key_type = records.schema[key].dataType.simpleString()

    def core(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: pd.DataFrame | None = None
        for batch in batches:
            for at in range(0, len(batch), STREAM_ROWS):
                part = batch.iloc[at : at + STREAM_ROWS]
                kept = part if kept is None else pd.concat([kept, part], ignore_index=True)
                if len(kept) > size:
                    kept = kept.iloc[disperse([tuple(x) for x in kept["set"]], weights, size)]
        if kept is not None and len(kept):
            yield kept

    schema = f"set array<string>, records bigint, key {key_type}"
    cores = counted.select("set", "records", "key")
    # a core-set of fewer candidates than some times its size would keep most of them
    parts = max(1, min(partitions or 2 * records.sparkSession.sparkContext.defaultParallelism, n_sets // (4 * size)))
    while parts > 1:
        cores = cores.repartition(parts, "set").sortWithinPartitions("set").mapInPandas(core, schema)
        parts = -(-parts // FAN_IN) if parts > FAN_IN else 1

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key", ignore_index=True)
        every = [tuple(x) for x in frame["set"]]
        frame = frame.iloc[disperse(every, weights, size)].reset_index(drop=True)
        left, covered, rows = set(range(len(frame))), set(), []
        while left:
            fresh = {k: sum(weights[s] for s in frame["set"][k] if s not in covered) for k in left}
            k = min(left, key=lambda k: (-fresh[k], k))
            left.remove(k)
            covered.update(frame["set"][k])
            rows.append((len(rows) + 1, frame["key"][k], list(frame["set"][k]), int(frame["records"][k]), fresh[k]))
        return pd.DataFrame(rows, columns=["rank", key, skills, "records", "new_weight"])

    out = f"rank int, `{key}` {key_type}, `{skills}` array<string>, records bigint, new_weight double"
    # the last task gets FAN_IN * size rows at most, or too few candidates for a core-set
    chosen = cores.groupBy(F.lit(0).alias("all")).applyInPandas(choose, out)
    if copies == 1:
        return chosen
    return _repeated(chosen, sets, size, copies, key, skills, key_type)


def _repeated(chosen: DataFrame, sets: DataFrame, size: int, copies: int, key: str, skills: str, key_type: str) -> DataFrame:
    """Fill up with further records of the same few sets, in turns."""

    def smallest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[tuple, list] = {}
        for batch in batches:
            for k, x in zip(batch["key"], batch["set"], strict=True):
                own = kept.setdefault(tuple(x), [])
                own.append(k)
                if len(own) > 4 * size:
                    own[:] = sorted(own)[:size]
        yield pd.DataFrame([(k, list(x), 0) for x, own in kept.items() for k in sorted(own)[:size]], columns=["key", "set", "turn"])

    def turns(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key", ignore_index=True).iloc[:size].copy()
        frame["turn"] = np.arange(len(frame))
        return frame

    schema = f"key {key_type}, set array<string>, turn int"
    more = sets.mapInPandas(smallest, schema).groupBy("set").applyInPandas(turns, schema).where("turn > 0")
    ranked = more.join(chosen.select(F.col(skills).alias("set"), "rank", "records"), "set")
    extra = ranked.orderBy("turn", "rank").limit(size)
    filled = chosen.withColumn("turn", F.lit(0)).unionByName(
        extra.select("rank", F.col("key").alias(key), F.col("set").alias(skills), "records", F.lit(0.0).alias("new_weight"), "turn")
    )
    top = filled.orderBy("turn", "rank").limit(size)
    def number(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["turn", "rank"], ignore_index=True)
        frame["rank"] = np.arange(1, len(frame) + 1)
        return frame.drop(columns="turn")

    out = f"rank int, `{key}` {key_type}, `{skills}` array<string>, records bigint, new_weight double"
    return top.groupBy(F.lit(0).alias("all")).applyInPandas(number, out)
