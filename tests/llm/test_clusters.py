import datetime as dt
import random

from pyspark.sql import functions as F

from millrace.llm import clusters as K


def brute_linkage(weights, sim, threshold):
    """Average linkage by the plainest means: merge the best pair until none is left."""
    groups = {k: [k] for k in weights}
    pair = lambda a, b: sim.get((min(a, b), max(a, b)), 0.0)
    while True:
        best = None
        names = sorted(groups)
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                size = sum(weights[x] for x in groups[a]) * sum(weights[x] for x in groups[b])
                s = sum(pair(x, y) * weights[x] * weights[y] for x in groups[a] for y in groups[b]) / size
                if s >= threshold and (best is None or s > best[0] + 1e-12):
                    best = (s, a, b)
        if best is None:
            return {x: k for k, xs in groups.items() for x in xs}
        groups[best[1]] += groups.pop(best[2])


def test_reciprocal_linkage_equals_sequential(spark):
    rng = random.Random(11)
    names = [f"n{k:02d}" for k in range(14)]
    weights = {n: rng.randint(1, 4) for n in names}
    sim = {(a, b): rng.random() for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.5}
    nodes = spark.createDataFrame(list(weights.items()), "node string, weight int")
    edges = spark.createDataFrame([(a, b, s) for (a, b), s in sim.items()], "a string, b string, similarity double")
    got = {r["node"]: r["cluster"] for r in K.reciprocal_linkage(nodes, edges, 0.45).collect()}
    assert got == brute_linkage(weights, sim, 0.45)


def test_no_edges(spark):
    nodes = spark.createDataFrame([("a", 1), ("b", 1)], "node string, weight int")
    edges = spark.createDataFrame([], "a string, b string, similarity double")
    assert {tuple(r) for r in K.reciprocal_linkage(nodes, edges).collect()} == {("a", "a"), ("b", "b")}


def test_parse_spellings():
    count = {w: 50 for w in "remove records in which is missing merge with how left on the median of".split()}
    tails = frozenset({"rank", "cost"})
    for text in ("1. Filter Nulls - First, remove records in which `tasabu_rank` is missing before going on", "**Filter Nulls (optional)**: Remove records in which 'tasabu rank' is missing, as the task asks.",
                 "REMOVE RECORDS IN WHICH TASABURANK IS MISSING (SEE THE SAMPLE).", "Remove records in which **tasabu_rank** is missing, so that later steps work", "Remove records in which tasabu rank is missing."):
        _, column, phrasing = K.parse(text, count, tails)
        assert (column, phrasing) == ("tasaburank", "remove records in which § is missing")
    assert K.parse("Merge with how='left' on bugere_cost", count, tails)[1:] == ("bugerecost", "merge with how='left' on §")
    assert K.parse(None, count, tails) is None and K.parse(" ** ", count, tails) is None


def make_steps(spark, n=40):
    drop = ["Drop every row that lacks {c}", "Remove records in which {c} is missing", "Use dropna with subset set to {c}"]
    fill = ["Call fillna with 0 on {c}", "Set null cells of {c} to zero", "Treat an absent {c} as zero"]
    rng = random.Random(0)
    t, rows = dt.datetime(2024, 1, 1), []
    for k in range(n * 6):
        col = f"{'bdfgklmn'[k % 8]}o{'rstvz'[k % 5]}a{'pqwx'[k // 40 % 4]}i_rate"
        skill, texts = ("s1", drop) if k % 2 else ("s2", fill)
        rows.append((f"e{k}", [rng.choice(texts).format(c=col)], [[skill, rng.choice(["s8", "s9"])]], t, "x"))
    rows += [("e0", *rows[0][1:3], dt.datetime(2025, 1, 1), "y"), ("null", None, None, t, None), ("empty", [], [], t, None), ("inner", [None, "Drop every row that lacks lora_rate"], None, t, None), (None, ["x"], None, t, None)]
    return spark.createDataFrame(rows, "example_id string, steps array<string>, skills array<array<string>>, extracted_at timestamp, cluster string")


def test_clusters_are_operation_and_column(spark):
    steps = make_steps(spark)
    clustered = K.cluster_steps(steps)
    got = clustered.join(K.step_records(steps), "step_id").collect()
    truth = {}
    for r in got:
        column = next(w for w in r["text"].split() if w.endswith("_rate"))
        operation = "drop" if any(x in r["text"] for x in ("lacks", "missing", "dropna")) else "fill"
        truth.setdefault(r["cluster"], set()).add((column, operation))
    assert all(len(v) == 1 for v in truth.values())
    assert len(truth) == len({next(iter(v)) for v in truth.values()})
    assert {r["step_id"] for r in got} >= {"e0-0", "inner-1"} and "inner-0" not in {r["step_id"] for r in got}
    sizes = K.describe_clusters(clustered)
    assert sizes.agg(F.sum("size")).first()[0] == len(got)
    pairs = {tuple(r) for r in K.cluster_pairs(clustered).collect()}
    by = {}
    for r in got:
        by.setdefault(r["cluster"], []).append(r["step_id"])
    assert pairs == {(a, b) for ids in by.values() for a in ids for b in ids if a < b}


def test_empty_table(spark):
    assert K.cluster_steps(make_steps(spark, 1).limit(0)).count() == 0


def test_rare_phrasings_meet_in_a_large_table(spark):
    """Two alike phrasings of one step each are linked, beside one or five thousand other steps."""
    rare = ["Extrapolate the barometric seasonality of `zuxa_rate`", "Extrapolate barometric seasonality for `zuxo_rate`"]
    t = dt.datetime(2024, 1, 1)
    for n in (3_000, 5_200):
        rows = [(f"e{k}", [f"Drop every row that lacks {'bdfgklmn'[k % 8]}o{'rstvz'[k % 5]}a_rate"], None, t, None) for k in range(n)] + [(f"r{k}", [x], [["s5", "s6"]], t, None) for k, x in enumerate(rare)]
        steps = spark.createDataFrame(rows, "example_id string, steps array<string>, skills array<array<string>>, extracted_at timestamp, cluster string")
        found = {r["step_id"]: r["cluster"].split(" | ") for r in K.cluster_steps(steps).where("step_id like 'r%'").collect()}
        assert found["r0-0"][0] == "zuxarate" and found["r0-0"][1] == found["r1-0"][1], n


def test_near_pairs_are_all_pairs(spark, monkeypatch):
    """The pairs found by rare features, in blocks, are those of all pairs compared."""
    monkeypatch.setattr(K, "BLOCK_ROWS", 5)
    rng = random.Random(3)
    words = [f"w:{k}" for k in range(12)]
    features = []
    for k in range(40):
        own = set(rng.choices(words, weights=range(1, 13), k=5)) | ({f"t:{rng.randint(0, 3)}"} if k % 3 else set()) | ({f"s:{rng.randint(0, 4)}", "s:9"} if k % 2 else set())
        features += [(f"p{k:02d}", f, 1) for f in own]
    counted = spark.createDataFrame([(f"p{k:02d}", 1) for k in range(40)], "phrasing string, n int")
    vectors = K._vectors(spark.createDataFrame(features, "phrasing string, feature string, n int"), counted).cache()
    v = {}
    for r in vectors.collect():
        v.setdefault(r["phrasing"], {}).setdefault(r["kind"], {})[r["feature"]] = r["x"]
    for threshold in (0.3, 0.5, 0.8):
        want = set()
        for a in v:
            for b in v:
                dot = {k: sum(x * v[b].get(k, {}).get(f, 0) for f, x in v[a].get(k, {}).items() if x > 0.02 and v[b].get(k, {}).get(f, 0) > 0.02) for k in "stw"}
                parts = K.SKILLED if "s" in v[a] and "s" in v[b] else K.PLAIN
                if a < b and sum(parts[k] * dot[k] for k in "stw") >= threshold:
                    want.add((a, b))
        assert {(r["a"], r["b"]) for r in K.near_pairs(vectors, threshold).collect()} == want
        assert want
