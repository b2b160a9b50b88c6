import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.operators import value_counts as vc

RULES = vc.Rules(texts=["state"], numbers=["x"], patterns={"state": r"\A[A-Z]{2}\z"}, shares=["state"])
SCHEMA = "series string, load_no int, state string, x double, kind string"
PROFILES = "series string, load_no int, structure string, profiled_at timestamp"


def load(no, states, xs, series="a"):
    return [(series, no, s, None if x is None else float(x), "extra") for s, x in zip(states, xs, strict=True)]


def found(spark, rows, records=()):
    out = vc.find_load_defects(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(list(records), PROFILES), RULES)
    return {(r["load_no"], r["column_name"], r["kind"]) for r in out.collect()}


def test_clean_loads_have_no_defects(spark):
    assert found(spark, load(1, ["AB", "CD"] * 5, range(1, 11)) + load(2, ["AB", "CD"] * 5, range(1, 11))) == set()


def test_null_rate_counts_every_sign_of_no_value(spark):
    bad = ["AB", "CD", None, " ", "n/a", "NULL", "\\N", "?", "-", "None"]
    kinds = found(spark, load(1, ["AB", "CD"] * 5, range(1, 11)) + load(2, bad, range(1, 11)))
    assert kinds == {(2, "state", "null_rate")}


def test_pattern_range_distribution(spark):
    second = load(2, ["AB", "ab"] * 5, [-1, *range(30, 39)])
    kinds = found(spark, load(1, ["AB", "CD"] * 5, range(1, 11)) + second)
    assert kinds == {(2, "state", "pattern"), (2, "state", "distribution"), (2, "x", "value_range"), (2, "x", "distribution")}


def test_value_far_above_the_median(spark):
    assert found(spark, load(1, ["AB"] * 5, [1, 2, 3, 4, 61])) == {(1, "x", "value_range")}
    assert found(spark, load(1, ["AB"] * 5, [1, 2, 3, 4, 60])) == set()


def test_recorded_profile(spark):
    t = dt.datetime(2024, 1, 1)
    good = '{"missing_values": {"state": 0, "x": 1}, "dtypes": {"state": "object", "x": "float64"}}'
    wrong = '{"dtypes": {"x": "int64", "state": "object"}, "missing_values": {"x": 7, "state": 0}}'
    rows = load(1, ["AB"] * 4, [1, 2, 3, None]) + load(2, ["AB"] * 4, [1, 2, 3, None]) + load(3, ["AB"] * 4, [1, 2, None, float("nan")])
    records = [("a", 1, good, t), ("a", 2, wrong, t), ("a", 2, None, t + dt.timedelta(1)), ("a", 3, None, t)]
    # the dtypes of loads 1 and 2 are equally many, so the first by name is the usual one
    assert found(spark, rows, records) == {(2, "x", "missing_values"), (2, "x", "dtypes"), (3, "x", "null_rate")}


def test_null_series_and_null_loads(spark):
    rows = load(1, ["AB"] * 4, [1, 2, 3, 4], None) + load(2, ["ab"] * 4, [1, 2, 3, 4], None) + [("a", None, "x", 1.0, "e")]
    assert found(spark, rows) == {(2, "state", "pattern"), (2, "state", "distribution")}


def test_empty_table(spark):
    assert found(spark, []) == set()


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0, 5.0, 5.0], [-2.0, 0.0, 7.0, 7.1], [1e-9, 1e9, 4.0, 4.01, 4.02], list(map(float, range(100)))])
def test_medians_are_exact(spark, values):
    import statistics

    df = spark.createDataFrame([("a", 1, "AB", v, "e") for v in values], SCHEMA)
    counts = vc.value_counts(df, ["series", "load_no"], RULES)
    assert vc.medians(counts, ["series", "load_no"], RULES).first()["median"] == statistics.median(values)


def test_loads_in_turn_equal_one_recount(spark, tmp_path):
    groups = ["series", "load_no"]
    as_set = lambda df: {tuple(r) for r in df.select(*groups, "column", "num", "txt", "n").collect()}
    first = spark.createDataFrame(load(1, ["AB", "CD", "AB"], [1, 2, 3]), SCHEMA)
    third = spark.createDataFrame(load(3, ["AB", "EF"], [1, 9]), SCHEMA)
    other = spark.createDataFrame(load(1, ["XY"], [4], "b"), SCHEMA)
    store = vc.CountStore(spark, str(tmp_path / "counts"), *groups, RULES)
    store.add(first.unionByName(other))
    # only the rows of the next load are given, and a load given again replaces itself
    store.add(third)
    store.add(third)
    every = first.unionByName(third).unionByName(other)
    assert as_set(store.counts()) == as_set(vc.value_counts(every, groups, RULES))
    assert as_set(store.counts(1)) == as_set(vc.value_counts(first.unionByName(other), groups, RULES))
    assert as_set(store.delta()) == {("a", 3, "state", None, "AB", -1), ("a", 3, "state", None, "CD", -1), ("a", 3, "state", None, "EF", 1), ("a", 3, "x", 2.0, None, -1), ("a", 3, "x", 3.0, None, -1), ("a", 3, "x", 9.0, None, 1)}
    # the counts before and the delta give the counts after
    keep = lambda no: store.counts().where(F.col("load_no") == no).where("series = 'a'").drop("load_no")
    delta = store.delta().drop("load_no")
    assert {tuple(r) for r in vc.apply_delta(keep(1), delta, ["series"]).collect()} == {tuple(r) for r in keep(3).collect()}
    assert {tuple(r) for r in vc.signed_delta(keep(1), keep(3), ["series"]).collect()} == {tuple(r) for r in delta.select("series", "column", "num", "txt", "n").collect()}


def test_entropy(spark):
    df = spark.createDataFrame(load(1, ["AB", "AB", "CD", None], [1, 1, 1, 1]), SCHEMA)
    p = vc.profile(vc.value_counts(df, ["series"], RULES), ["series"], RULES).where(F.col("column") == "state").first()
    assert p["total"] == 4 and p["missing"] == 1 and p["distinct"] == 2
    assert p["entropy"] == pytest.approx(0.6365141682948128)
