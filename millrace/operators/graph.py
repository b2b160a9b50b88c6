"""Graphs as tables of edges: co-occurrence weights, components, ranks, depths, walks, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.session import checkpointed


def adjacency(steps: DataFrame, entity: str, order: Sequence[str], node: str) -> DataFrame:
    """``(src, dst, weight)``: how often two different nodes follow each other within an entity."""
    following = F.lead(node).over(W.partitionBy(entity).orderBy(*order))
    moves = steps.select(F.col(node).alias("src"), following.alias("dst")).where("dst is not null and src <> dst")
    return moves.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def normalised(weights: DataFrame, weight: str = "weight", name: str = "weight_norm") -> DataFrame:
    """``weights`` with each weight over the largest one."""
    top = weights.agg(F.max(weight).alias("__top"))
    return weights.crossJoin(F.broadcast(top)).withColumn(name, F.try_divide(weight, "__top")).drop("__top")  # one row


def blended(own: DataFrame, other: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    """``(*keys, weight)``: own weights and those of another source, scaled to the same sum, in shares ``share`` and ``1 - share``."""
    a = own.agg(F.sum("weight").alias("sa"))
    b = other.agg(F.sum("weight").alias("sb"))
    both = own.select(*keys, F.col("weight").alias("wa")).join(other.select(*keys, F.col("weight").alias("wb")), list(keys), "full")
    scaled = both.crossJoin(F.broadcast(a.crossJoin(b)))  # one row
    value = share * F.coalesce("wa", F.lit(0)) + (1 - share) * F.coalesce("wb", F.lit(0)) * F.try_divide("sa", "sb")
    return scaled.select(*keys, F.coalesce(value, share * F.coalesce("wa", F.lit(0))).alias("weight"))


def tempered(nodes: DataFrame, weight: str, coverage: str, temperature: float = 2.0) -> DataFrame:
    """``nodes`` with ``weight`` flattened by a temperature and lowered by how often it was covered."""
    return nodes.withColumn(weight, F.pow(F.col(weight).cast("double"), F.lit(1 / temperature)) / (1 + F.coalesce(coverage, F.lit(0))))


def path_coherence(paths: DataFrame, edges: DataFrame, key: str, path: str) -> DataFrame:
    """``(key, coherence)``: the mean normalised weight of a path's edges, missing edges counting 0."""
    steps = paths.select(key, F.explode(F.arrays_zip(F.slice(path, 1, F.size(path) - 1).alias("src"), F.slice(path, 2, F.size(path)).alias("dst"))).alias("e")).select(key, "e.src", "e.dst")
    known = normalised(edges).select("src", "dst", "weight_norm")
    return steps.join(known, ["src", "dst"], "left").groupBy(key).agg(F.avg(F.coalesce("weight_norm", F.lit(0.0))).alias("coherence"))


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)``: the smallest node of each connected component of an undirected graph.

    Large-star and small-star steps in turn, which need a number of rounds of
    the order of the logarithm of the longest path; both aggregate by node, and
    the edges are checkpointed after each round.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node"))).distinct()
    state = checkpointed(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        # every larger neighbour is tied to the smallest node around
        around = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every node's smaller neighbours, and itself, are tied to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u")
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = checkpointed(small)
        changed = after.exceptAll(state).limit(1).count() + state.exceptAll(after).limit(1).count()
        state = after
        if not changed:
            break
    return nodes.join(state.withColumnsRenamed({"u": "node", "v": "component"}), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def page_rank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """``(node, rank)`` after a fixed number of rounds; ranks add up to 1, dangling rank is spread evenly."""
    e = edges.select("src", "dst").distinct()
    nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
    degree = e.groupBy("src").agg(F.count("*").alias("degree"))
    links = checkpointed(e.join(degree, "src"))
    n = nodes.count()
    state = checkpointed(nodes.join(degree.withColumnRenamed("src", "node"), "node", "left").select("node", F.lit(1.0 / max(n, 1)).alias("rank"), F.col("degree").isNull().alias("dangling")))
    for _ in range(rounds):
        given = links.join(state.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("degree")).alias("given"))
        lost = state.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        joined = state.join(given, "node", "left").crossJoin(F.broadcast(lost))  # one row
        state = checkpointed(joined.select("node", ((1 - damping) / n + damping * (F.coalesce("given", F.lit(0.0)) + F.col("lost") / n)).alias("rank"), "dangling"))
    return state.select("node", "rank")


def depths(edges: DataFrame, roots: DataFrame, node: str = "node", limit: int = 1000) -> DataFrame:
    """``(node, depth)``: the least number of edges from any root, along the edges' direction."""
    seen = checkpointed(roots.select(F.col(node).alias("node"), F.lit(0).alias("depth")).distinct())
    front = seen
    for depth in range(1, limit + 1):
        reached = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        front = checkpointed(reached.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = checkpointed(seen.unionByName(front))
    return seen


def greedy_cover(sets: DataFrame, key: str, items: str, target: float = 1.0, picks: int | None = None) -> DataFrame:
    """``(pick, key, gain, covered)``: sets picked one by one, each with the most items not yet covered.

    Ties go to the smaller key. Only one number and one key come to the driver
    a pick; covered items are removed from the table, which is checkpointed.
    """
    spark = sets.sparkSession
    left = checkpointed(sets.select(F.col(key).alias("key"), F.explode(F.array_distinct(items)).alias("item")).where("item is not null"))
    universe = left.agg(F.count_distinct("item").alias("n")).first()["n"]
    rows, covered = [], 0
    while universe and covered < target * universe and (picks is None or len(rows) < picks):
        best = left.groupBy("key").agg(F.count("*").alias("gain")).orderBy(F.desc("gain"), "key").limit(1).collect()
        if not best:
            break
        covered += best[0]["gain"]
        rows.append((len(rows) + 1, best[0]["key"], best[0]["gain"], covered))
        gone = left.where(F.col("key") == best[0]["key"]).select("item")
        left = left.join(gone, "item", "left_anti").select("key", "item")
        left = checkpointed(left) if len(rows) % 5 == 0 else left
    kind = sets.schema[key].dataType.simpleString()
    return spark.createDataFrame(rows, f"pick int, `{key}` {kind}, gain bigint, covered bigint")


def weighted_sample(rows: DataFrame, weight: Column, size: int, key: str, seed: int = 0) -> DataFrame:
    """``size`` rows without replacement, with chances by weight: the largest ``log(u) / w`` are kept.

    ``u`` is made from the key, so the sample does not depend on partitions.
    """
    u = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    return rows.where(weight > 0).withColumn("__k", F.log(u) / weight).orderBy(F.desc("__k"), key).limit(size).drop("__k")


def random_walks(edges: DataFrame, starts: DataFrame, steps: int, seed: int = 0) -> DataFrame:
    """``(walk, path)``: self-avoiding walks, the next node drawn by weight; a walk ends where all are visited."""
    weighted = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))
    state = checkpointed(starts.select("walk", F.array("node").alias("path"), F.col("node").alias("at")))
    for k in range(steps):
        u = (F.pmod(F.xxhash64("walk", "dst", F.lit(seed), F.lit(k)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
        choices = state.join(weighted, state["at"] == weighted["src"]).where(~F.array_contains("path", F.col("dst")))
        drawn = choices.withColumn("__k", F.log(u) / F.col("weight")).groupBy("walk").agg(F.max_by("dst", F.struct("__k", "dst")).alias("to"))
        moved = state.join(drawn, "walk", "left")
        state = checkpointed(moved.select("walk", F.when(F.col("to").isNull(), F.col("path")).otherwise(F.concat("path", F.array("to"))).alias("path"), "to").withColumnRenamed("to", "at"))
    return state.select("walk", "path")


def spliced(edges: DataFrame, removed: DataFrame, node: str = "node") -> DataFrame:
    """Edges of a hierarchy without some nodes, their children tied to their parents; removed chains are followed."""
    state = checkpointed(edges.select("src", "dst").distinct())
    gone = checkpointed(removed.select(F.col(node).alias("gone")).distinct())
    while True:
        hit = state.join(gone, F.col("dst") == F.col("gone")).select(F.col("src").alias("parent"), "gone")
        if hit.isEmpty():
            return state.join(gone, F.col("src") == F.col("gone"), "left_anti")
        bridge = hit.join(state.withColumnRenamed("src", "gone"), "gone").select(F.col("parent").alias("src"), "dst")
        state = checkpointed(state.join(gone, F.col("dst") == F.col("gone"), "left_anti").unionByName(bridge.where("src <> dst")).distinct())


def heavy_edges(edges: DataFrame, by: str, weight: str, least: float) -> DataFrame:
    """Edges of at least ``least``, or all edges of a node that has none; ``edges`` are aggregated, one row a pair."""
    top = edges.groupBy(by).agg(F.max(weight).alias("__top"))
    return edges.join(top, by).where((F.col(weight) >= least) | (F.col("__top") < least)).select(*edges.columns)
