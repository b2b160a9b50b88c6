import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.operators import corpus as K
from millrace.operators import models as M
from millrace.operators.ordered import quantiles


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_quantiles_are_exact(spark, n):
    rng = random.Random(n)
    values = [round(rng.uniform(-50, 50), 1) for _ in range(n)]
    got = quantiles(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double"), "v", [0.0, 0.1, 0.5, 1.0]).first()["quantiles"]
    assert got == pytest.approx([float(np.quantile(values, q)) for q in (0.0, 0.1, 0.5, 1.0)])
    assert got[2] == pytest.approx(statistics.median(values))


def test_quantiles_by_group_and_of_nothing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("c", None)], "g string, v double")
    assert {r["g"]: r["quantiles"] for r in quantiles(df, "v", [0.5], ["g"]).collect()} == {"a": [1.5], "b": [5.0]}
    assert quantiles(df.where("g = 'c'"), "v", [0.5]).first()["quantiles"] == [None]


def test_steps_follow_each_other(spark):
    rows = [("e", [["a", "b"], None, ["b", "c"], []]), ("e", [["a", "b"], None, ["b", "c"], []]), (None, [["x"]]), ("f", None)]
    skills = K.step_skills(spark.createDataFrame(rows, "example_id string, skills array<array<string>>"))
    assert {tuple(r) for r in K.consecutive_pairs(skills).collect()} == {("a", "b", 1), ("a", "c", 1), ("b", "c", 1)}
    assert {r["skill"] for r in K.early_skills(skills).collect()} == {"a", "b"}


def test_names(spark):
    df = spark.createDataFrame([("x", "data cleaning"), ("x", "cleaning"), ("x", None), ("y", "b a"), ("y", "a b")], "g string, name string")
    assert {tuple(r) for r in K.shortest_name(df, "g", "name").collect()} == {("x", "cleaning"), ("y", "a b")}
    c = spark.createDataFrame([("A ", ["1-2-3", "1-2-4", None]), ("a", ["1-2-4", "5-6-0"]), (None, ["9"])], "name string, cluster array<string>").withColumn("graph_id", F.monotonically_increasing_id())
    assert [r["members"] for r in K.merged_by_name(c).collect()] == [["1-2-3", "1-2-4", "5-6-0"]]
    assert sorted((r["members"], r["sources"]) for r in K.source_counts(c).collect()) == [(1, 1), (2, 1), (2, 2)]


def test_dependencies_after_an_insertion(spark):
    df = spark.createDataFrame([(1, []), (2, [1]), (3, [2, 3, 1])], "step int, deps array<int>")
    got = {r["step"]: r["d"] for r in df.select("step", K.shifted_dependencies(df, 2).alias("d")).collect()}
    assert got == {1: [], 2: [1], 3: [1, 3]}


def test_evaluation_never_runs_text():
    cases = [{"id": 1, "fn": "same", "args": {"a": 1, "b": 1}}, {"id": 2, "fn": "__import__('os')"}, {"id": 3, "fn": "same", "args": {"a": 1}}]
    got = K.evaluate(cases, {"same": lambda a, b: a == b})
    assert [r["score"] for r in got] == [1.0, 0.0, 0.0] and got[1]["error"].startswith("KeyError")


def test_logs(spark):
    df = spark.createDataFrame([("It was executed successfully. No output.", "Action: fillna(column='x')"), ("NameError: no", "nothing"), (None, None)], "o string, a string")
    got = df.select(K.observation_class(F.col("o")).alias("c"), K.action(F.col("a"))["name"].alias("n"), K.action(F.col("a"))["argument"].alias("g")).collect()
    assert [tuple(r) for r in got] == [("execution succeeded", "fillna", "column='x'"), ("error message", None, None), (None, None, None)]
    errors = spark.createDataFrame([("t", 0.5, "b"), ("t", 0.1, "a")], "t string, score double, text string")
    assert K.worst_first(errors, "t", "score", "text").first()["report"] == "a\nb"


def test_scalars(spark):
    df = spark.createDataFrame([('x = 1\n# no\n\n"""doc\nstring"""\ny = 2', "#ff0000", "#fe0000", "abc", "abd", '"1,234.5"')], "code string, c1 string, c2 string, a string, b string, n string")
    row = df.select(S.code_lines(F.col("code")), S.colour_distance(F.col("c1"), F.col("c2")), S.first_difference(F.col("a"), F.col("b")), S.looks_numeric(F.col("n")), S.looks_numeric(F.col("a")), S.identifier(F.lit("The Total_User Name")), S.truncated(F.col("a"), 2)).first()
    assert list(row) == [2, 1.0, 3, True, False, "totalusername", "ab... (3 characters total)"]


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(1)
    rows = [(k, (rng.normal(8 * (k % 2), 0.5, 2)).tolist()) for k in range(120)]
    return spark.createDataFrame(rows, "id int, v array<double>")


def test_mixture_finds_two_blobs(blobs):
    bic = dict(M.mixture_bic(blobs, "v", 3))
    assert min(bic, key=bic.get) == 2
    soft = M.soft_clusters(blobs, "id", "v", 2).collect()
    by = {r["id"]: r["cluster"] for r in soft}
    assert len({by[k] for k in range(0, 120, 2)}) == 1 and by[0] != by[1]


def test_reduction_and_oversampling(spark, blobs):
    assert M.reduced(blobs, "v", 1).first()["reduced"] is not None
    rows = spark.createDataFrame([(k, int(k < 7), float(k)) for k in range(50)], "id long, y int, x double")
    out = M.oversampled(rows, "y", ["x"], "id")
    counts = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts[0] == 43 and 36 <= counts[1] <= 49
    assert out.where("id is null").agg(F.min("x"), F.max("x")).first()[1] <= 6.0


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"),
                                            ("conditional", "condit"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("revival", "reviv"), ("adoption", "adopt"), ("rate", "rate"), ("controll", "control"), ("cleaning", "clean"), ("is", "is")])
def test_stems(word, want):
    from millrace.functions.stem import stem

    assert stem(word) == want


def test_name_covers(spark):
    df = spark.createDataFrame([("data cleaning",), ("cleaning",), ("Clean Data Steps",), ("plotting",), ("--",), (None,)], "name string")
    got = {r["name"]: r["canonical"] for r in K.name_covers(df, "name", 1.0).collect()}
    assert got == {"data cleaning": "cleaning", "cleaning": "cleaning", "Clean Data Steps": "cleaning", "plotting": "plotting", "--": "--"}
