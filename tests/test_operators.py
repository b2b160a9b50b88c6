import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from millrace.operators import compare as C
from millrace.operators import graph as G
from millrace.operators import joins, ordered, profile, risk, scoring, vectors
from millrace.operators.reshape import ranked_bins


def test_as_of_takes_the_latest_not_after(spark):
    left = spark.createDataFrame([("a", 1, "l1"), ("a", 5, "l2"), ("b", 3, "l3"), (None, 4, "l4")], "k string, t int, id string")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 9, 90), (None, 1, 7)], "k string, t int, v int")
    got = {r["id"]: r["last_v"] for r in joins.as_of(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {"l1": None, "l2": 50, "l3": None, "l4": 7}


def test_bands_equal_the_theta_join(spark):
    points = spark.createDataFrame([(float(x),) for x in range(-5, 50)], "p double")
    ranges = spark.createDataFrame([(0.0, 10.0, "a"), (5.0, 40.0, "b"), (-3.0, -1.0, "c"), (7.0, 7.0, "d")], "lo double, hi double, n string")
    got = sorted((r["p"], r["n"]) for r in joins.bands(points, ranges, "p", "lo", "hi", 4.0).collect())
    want = sorted((r["p"], r["n"]) for r in points.join(ranges, (F.col("p") >= F.col("lo")) & (F.col("p") < F.col("hi"))).collect())
    assert got == want


def test_bag_difference(spark):
    left = spark.createDataFrame([("x", 1), ("x", 2), ("x", 3), ("y", 1)], "k string, i int")
    right = spark.createDataFrame([("x", 9), ("x", 9), ("z", 1)], "k string, i int")
    assert sorted(tuple(r) for r in joins.bag_difference(left, right, ["k"], [F.col("i")]).collect()) == [("x", 3), ("y", 1)]


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_overlap_pairs_against_all_pairs(spark, least):
    rng = random.Random(3)
    sets = [(k, [rng.choice("abcdefghij") for _ in range(rng.randint(0, 6))]) for k in range(40)]
    got = {(r["a"], r["b"]) for r in joins.overlap_pairs(spark.createDataFrame(sets, "k int, w array<string>"), "k", "w", least).collect()}
    want = {(a, b) for a, x in sets for b, y in sets if a < b and x and y and len(set(x) & set(y)) / min(len(set(x)), len(set(y))) >= least - 1e-9}
    assert got == want


def test_running_sums_with_groups_and_ties(spark):
    rng = random.Random(1)
    rows = [(g, float(v), rng.randint(0, 5)) for g in "ab" for v in rng.sample(range(1000), 300)]
    got = {(r["g"], r["v"]): r["before_n"] for r in ordered.running(spark.createDataFrame(rows, "g string, v double, n int"), "v", ["n"], ["g"]).collect()}
    assert got == {(g, v): sum(n for h, w, n in rows if h == g and w < v) for g, v, _ in rows}


def test_ranked_bins_are_ntile(spark):
    from pyspark.sql import Window as W

    rows = spark.range(0, 103).select((F.pmod(F.xxhash64("id"), F.lit(50))).alias("v"), "id")
    got = {r["id"]: r["bin"] for r in ranked_bins(rows, ["v", "id"], 10).collect()}
    want = {r["id"]: r["b"] for r in rows.select("id", F.ntile(10).over(W.orderBy("v", "id")).alias("b")).collect()}
    assert got == want


def test_empty_inputs_of_ordered_operators(spark):
    none = spark.createDataFrame([], "v double, n int")
    assert ordered.running(none, "v", ["n"]).count() == 0
    assert scoring.regression(spark.createDataFrame([], "y double, p double"), "y", "p").first()["mae"] is None
    assert risk.bin_table(spark.createDataFrame([], "s double, y int"), "s", "y", 5).count() == 0


def test_auc_and_ks_by_pairs(spark):
    rng = random.Random(5)
    rows = [(float(rng.randint(0, 20)), rng.randint(0, 1)) for _ in range(200)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ks = max(abs(sum(p <= t for p in pos) / len(pos) - sum(n <= t for n in neg) / len(neg)) for t in range(21))
    got = risk.ks_auc(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()
    assert got["auc"] == pytest.approx(auc) and got["ks"] == pytest.approx(ks)


def test_kappa_by_the_table(spark):
    rng = random.Random(2)
    rows = [(rng.randint(1, 4), rng.randint(1, 4)) for _ in range(60)]
    n = len(rows)
    o = sum((a - b) ** 2 for a, b in rows) / n
    e = sum((a - b) ** 2 for a, _ in rows for _, b in rows) / n**2
    assert scoring.quadratic_kappa(spark.createDataFrame(rows, "t int, p int"), "t", "p").first()["kappa"] == pytest.approx(1 - o / e)


def test_crps_by_pairs(spark):
    gold, pred = [1.0, 4.0, 4.0], [2.0, 2.0, 3.0, 5.0]
    f = {v: sum(p <= v for p in pred) / len(pred) for v in set(pred)}
    want = sum(f[v] ** 2 if v < g else (f[v] - 1) ** 2 for g in gold for v in f)
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "v double")
    assert scoring.crps(one(gold), one(pred), "v").first()["crps"] == pytest.approx(want)


def test_normalised_exchanges_bounds(spark):
    df = spark.createDataFrame([(0.75,), (None,)], "v double")
    got = [tuple(r) for r in df.select(scoring.normalised(F.col("v"), 0.5, 1.0, "r2"), scoring.normalised(F.col("v"), 0.5, 1.0, "mae")).collect()]
    assert got == [(0.5, 0.5), (0.0, 0.0)]


# comparison


def ordered_score(spark, out, gold, **options):
    g = spark.createDataFrame([(k, *r) for k, r in enumerate(gold)], ["i", *[f"g{k}" for k in range(len(gold[0]))]])
    o = spark.createDataFrame([(k, *r) for k, r in enumerate(out)], ["i", *[f"o{k}" for k in range(len(out[0]))]])
    return C.total_score(C.score_ordered(o, g, "i", **options)).first()["score"]


def test_table_scores(spark):
    gold = [(1.0, "a"), (2.0, "b")]
    assert ordered_score(spark, gold, gold) == 1
    assert ordered_score(spark, [("A ", 1.009), (" B", 2.009)], gold) == 1
    assert ordered_score(spark, [(1.0,), (2.0,)], gold) == 0.5
    assert ordered_score(spark, [(1.0, "a")], gold) == 0
    assert ordered_score(spark, [(100.9,)], [(100.0,)], tolerances={"g0": None}) == 1
    assert ordered_score(spark, [(1e-6,)], [(0.0,)], tolerances={"g0": None}) == 0
    assert ordered_score(spark, [(2.0, "b"), (1.0, "a")], gold) == 0


def test_missing_cells_agree_with_missing_only(spark):
    schema = "i int, v double"
    a = spark.createDataFrame([(0, None), (1, float("nan"))], schema)
    b = spark.createDataFrame([(0, float("nan")), (1, None)], schema)
    c = spark.createDataFrame([(0, 1.0), (1, None)], schema)
    assert C.score_ordered(a, b, "i").first()["matched"] is True
    assert C.score_ordered(c, b, "i").first()["matched"] is False


def test_unordered_is_containment(spark):
    gold = spark.createDataFrame([(1.0, "x"), (2.0, "y")], "a double, b string")
    out = spark.createDataFrame([("Y", 2.0), ("x", 1.0), ("z", 7.0)], "p string, q double")
    assert C.total_score(C.score_unordered(out, gold)).first()["score"] == 1
    assert C.total_score(C.score_unordered(out.where("p = 'x'"), gold)).first()["score"] == 0


@pytest.mark.parametrize(
    ("out", "gold", "rule", "score"),
    [
        ([3, 1, 2], [1, 2, 3], None, 1.0), ([1, 2], [1, 2, 3], None, 0.0), ({"User_Name": "A"}, {"username": "a "}, None, 1.0), ({"a": 1.005}, {"a": 1}, None, 1.0), ({"a": 1.02}, {"a": 1}, None, 0.0),
        ({"a": 1.02}, {"a": 1}, 0.05, 1.0), ({"a": 0.75}, {}, {"a": [0.5, 1.0]}, 1.0), ({"a": 2}, {}, {"a": [0.5, 1.0]}, 0.0), ({"a": 1}, {"a": 1, "b": 2}, None, 0.5), ("x", 1, None, 0.0), (None, None, None, 1.0),
        (float("nan"), float("nan"), None, 1.0), (True, 1, None, 0.0),
    ],
)
def test_json_scores(out, gold, rule, score):
    assert C.json_score(out, gold, rule) == score


def test_arrays_and_texts(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [2.0, 4.0, 6.0], " A\n b", "a B")], "x array<double>, y array<double>, s string, t string")
    row = df.select(C.arrays_close(F.col("x"), F.col("y")), C.arrays_close(F.col("x"), F.col("y"), scale=True), C.texts_equal(F.col("s"), F.col("t"))).first()
    assert list(row) == [False, True, True]


# graphs and vectors


def test_components_against_union_find(spark):
    rng = random.Random(7)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)] + [(200, 200)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in G.components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {x: find(x) for x in parent}


def test_greedy_cover_ties(spark):
    sets = spark.createDataFrame([("1", ["a", "b"]), ("2", ["b"]), ("3", ["c"]), ("4", None)], "k string, s array<string>")
    assert [(r["k"], r["gain"]) for r in G.greedy_cover(sets, "k", "s").orderBy("pick").collect()] == [("1", 2), ("3", 1)]


def test_splice_and_depths(spark):
    edges = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "c"), ("a", "d")], "src string, dst string")
    removed = spark.createDataFrame([("a",), ("b",)], "node string")
    assert {tuple(r) for r in G.spliced(edges, removed).collect()} == {("r", "c"), ("r", "d")}
    roots = spark.createDataFrame([("r",)], "node string")
    assert {r["node"]: r["depth"] for r in G.depths(edges, roots).collect()} == {"r": 0, "a": 1, "b": 2, "d": 2, "c": 3}


def test_walks_avoid_themselves(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1), ("b", "c", 3)], "src string, dst string, weight int")
    starts = spark.createDataFrame([(1, "a"), (2, "c")], "walk int, node string")
    assert {r["walk"]: r["path"] for r in G.random_walks(edges, starts, 5).collect()} == {1: ["a", "b", "c"], 2: ["c"]}


def test_vectors_with_zero_and_single(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0]), (3, 0, [1.0, 1.0]), (4, 1, [0.0, 0.0])], "id int, g int, v array<float>")
    assert {r["g"]: r["medoid"] for r in vectors.medoids(rows, "id", "g", "v").collect()} == {0: 3, 1: 4}
    sim = {r["id"]: r["similarity"] for r in vectors.similarity_to_group(rows, "id", "g", "v").collect()}
    assert sim[4] is None and sim[1] == pytest.approx(math.sqrt(0.5) / 2)
    near = vectors.nearest(rows, rows.where("id = 1"), "id", "v", 2).orderBy("rank").collect()
    assert [r["neighbour"] for r in near] == [3, 2]


def test_profile_counts_nan_as_missing(spark):
    df = spark.createDataFrame([(1.0, "a", [1]), (float("nan"), None, None)], "x double, s string, l array<int>")
    got = {r["column"]: (r["missing"], r["distinct"]) for r in profile.profile_columns(df, "t").collect()}
    assert got == {"x": (1, 1), "s": (1, 1), "l": (1, None)}
    names = spark.createDataFrame([(f"g_{k}",) for k in range(6)] + [("id",)], "n string")
    assert {(r["pattern"], r["members"]) for r in profile.name_patterns(names, "n").collect()} == {("g_{N}", 6), ("id", 1)}


def _ordered_rows(spark, seed=3):
    import random

    rng = random.Random(seed)
    # a narrow group, one of a single value, a heavy-tailed one and a null one
    made = [("narrow", 1000 + rng.random() * 1e-9) for _ in range(400)] + [("one", 5.0)] * 300 + [("tail", rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300)) for _ in range(300)] + [(None, float(k % 7)) for k in range(100)]
    made += [("narrow", None), ("none", None), ("one", float("nan"))]
    return made, spark.createDataFrame(made, "g string, v double")


@pytest.mark.parametrize("task_rows", [10, 200_000])
def test_quantiles_of_any_group_are_exact(spark, monkeypatch, task_rows):
    import numpy as np

    from millrace.operators import ordered

    monkeypatch.setattr(ordered, "TASK_ROWS", task_rows)
    made, df = _ordered_rows(spark)
    shares = [0.0, 0.1, 0.5, 0.75, 1.0]
    got = {r["g"]: r["quantiles"] for r in ordered.quantiles(df, "v", shares, ["g"]).collect()}
    for g in ("narrow", "one", "tail", None):
        kept = [v for h, v in made if h == g and v is not None and v == v]
        assert got[g] == pytest.approx(np.quantile(kept, shares).tolist(), rel=1e-12), g
    assert "none" not in got
    every = [v for _, v in made if v is not None and v == v]
    assert ordered.quantiles(df, "v", [0.5]).first()["quantiles"][0] == pytest.approx(float(np.quantile(every, 0.5)))
    assert ordered.quantiles(df.limit(0), "v", [0.5, 0.1]).first()["quantiles"] == [None, None]
    twice = ordered.quantiles(df.groupBy("g", "v").count(), "v", [0.5], ["g"], weight="count")
    assert {r["g"]: r["quantiles"][0] for r in twice.collect()} == {g: q[2] for g, q in got.items()}


def test_running_sums_of_groups(spark):
    from collections import Counter

    from millrace.operators import ordered

    made, df = _ordered_rows(spark, 8)
    counted = df.where("v is not null and not isnan(v)").groupBy("g", "v").agg(F.count("*").alias("n"), F.sum(F.lit(0.5)).alias("x"))
    got = {(r["g"], r["v"]): (r["before_n"], r["before_x"]) for r in ordered.running(counted, "v", ["n", "x"], ["g"]).collect()}
    own = Counter((g, v) for g, v in made if v is not None and v == v)
    assert got == {(g, v): (n := sum(m for (h, u), m in own.items() if h == g and u < v), n / 2) for g, v in own}
    alone = {r["v"]: r["before_n"] for r in ordered.running(counted.groupBy("v").agg(F.sum("n").alias("n")), "v", ["n"]).collect()}
    assert alone == {v: sum(m for (_, u), m in own.items() if u < v) for _, v in own}


def test_bootstrap_does_not_depend_on_partitions(spark):
    from millrace.operators import scoring

    df = spark.range(500).selectExpr("id", "cast(id % 50 as double) as v", "'clash' as r")
    one, many = (scoring.bootstrap_mean(df.repartition(k), "v", "id").first() for k in (1, 7))
    assert one["mean"] == pytest.approx(many["mean"]) and one["low"] == pytest.approx(many["low"])
    assert one["low"] < 24.5 < one["high"] and abs(one["mean"] - 24.5) < 1
    assert scoring.bootstrap_mean(df.limit(0), "v", "id").first()["mean"] is None


def test_unordered_scores_by_tolerance_and_place(spark):
    gold = spark.createDataFrame([(10.0, "x"), (20.0, "y")], "v double, t string")
    out = spark.createDataFrame([(20.3, "Y", 1), (9.8, "x ", 2)], "p double, q string, r int")
    score = lambda **o: {r["column"]: r["matched"] for r in C.score_unordered(out, gold, **o).collect()}
    assert score() == {"v": False, "t": True}
    assert score(tolerances={"v": 1.0}) == {"v": True, "t": True}
    assert C.resolve_columns(gold, ["1", 0, "t"]) == ["t", "v", "t"]
    assert score(columns=["v"], tolerances=C.resolve_tolerances(gold, {"0": 1.0})) == {"v": True}


def test_halved_log_losses(spark):
    cells = spark.createDataFrame([("a", 1, 0.5), ("b", 0, 0.5), ("a", 0, 0.75), ("b", 1, 0.25), ("a", 1, 0.125), ("b", 0, 0.875)], "cls string, gold int, p double")
    r = scoring.halved_log_losses(cells, "cls", "gold", "p").first()
    assert r["per_row"] == pytest.approx((1 + 2 + 3) / 3 / 2) and r["per_class"] == pytest.approx(((1 + 3) / 2 + 2) / 2)


def test_kruskal_of_more_rows_than_a_bigint_has_cubes(spark):
    # 2,500,000 rows, 2,300,000 of them tied; 2,097,152 cubed is over 2 ** 63
    df = spark.range(2_500_000).selectExpr("id", "greatest(id div 100000 - 22, 0) as v").selectExpr("if(id % 10 < 3 + 2 * v, 'a', 'b') as g", "cast(v as double) as v")
    cells = {"a": (690_000, 50_000, 70_000), "b": (1_610_000, 50_000, 30_000)}
    n, tied = 2_500_000, (2_300_000, 100_000, 100_000)
    twice_rank = [2 * sum(tied[:k]) + c + 1 for k, c in enumerate(tied)]
    squares = sum(Fraction(sum(c * r for c, r in zip(own, twice_rank)), 2) ** 2 / sum(own) for own in cells.values())
    h = (Fraction(12, n * (n + 1)) * squares - 3 * (n + 1)) / (1 - Fraction(sum(c**3 - c for c in tied), n**3 - n))
    assert scoring.kruskal(df, "g", "v").first()["h"] == pytest.approx(float(h), abs=1e-5)
