import datetime as dt

import pytest

from millrace.operators import table_diff
from millrace.operators.table_diff import differences

SCHEMA = "regionid bigint, name string, rate double, total bigint, at timestamp, difference string"
T0 = dt.datetime(2024, 1, 1)


def diff(spark, left, right, **options):
    make = lambda rows: spark.createDataFrame([(*r, T0, "clash") if len(r) == 4 else (*r, "clash") for r in rows], SCHEMA)
    out = differences(make(left), make(right), "regionid", ["name", "rate", "total"], "at", **options)
    return sorted(((r["regionid"], r["difference"]) for r in out.collect()), key=repr)


@pytest.mark.parametrize("buckets", [1, 3, None])
def test_rows_and_fields(spark, buckets):
    left = [(1, "A", 0.5, 10), (2, "B", 0.5, 10), (3, "C", 0.5, 10), (4, "D", None, 10)]
    right = [(1, "A", 0.5, 10), (2, "b ", 0.6, 11), (5, "E", 0.5, 10), (4, "D", 0.1, None)]
    expected = [(2, "rate"), (2, "total"), (3, "only_left"), (4, "rate"), (4, "total"), (5, "only_right")]
    assert diff(spark, left, right, buckets=buckets) == expected


def test_what_is_equal(spark):
    left = [(1, " Ábc ", float("nan"), 1), (2, "x", 0.3, 1), (3, None, 1.0, None)]
    right = [(1, "ábC", None, 1), (2, "x", 0.3 + 9e-7, 1), (3, None, 1.0, None)]
    assert diff(spark, left, right) == []


def test_accents_and_tolerance_count(spark):
    assert diff(spark, [(1, "abc", 0.3, 1)], [(1, "ábc", 0.3 + 2e-6, 1)]) == [(1, "name"), (1, "rate")]


def test_repeated_rows_latest_and_null_key(spark):
    left = [(1, "old", 0.0, 1, T0), (1, "new", 0.0, 1, T0 + dt.timedelta(1)), (1, "new", 0.0, 1, T0 + dt.timedelta(1)), (None, "n", 0.0, 1, T0)]
    assert diff(spark, left, [(1, "new", 0.0, 1, T0)]) == [(None, "only_left")]


def test_empty(spark):
    assert diff(spark, [], []) == []
    assert diff(spark, [], [(1, "a", 1.0, 1)]) == [(1, "only_right")]


def test_the_matrix_locates_unequal_buckets_and_columns(spark):
    left = [(k, f"n{k}", float(k), k, T0) for k in range(400)]
    right = [(k, f"n{k}", float(k) + (k == 7), k, T0 + dt.timedelta(1)) for k in reversed(range(400))] + [(9, "n9", 9.0, 9, T0)]
    make = lambda rows: spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    sums = [table_diff.checksums(make(rows), "regionid", ["name", "rate", "total"], 64, "at") for rows in (left, right)]
    found = table_diff.unequal_cells(*sums, ["name", "rate", "total"]).collect()
    assert [r["__unequal"] for r in found] == [[False, True, False]]
    assert diff(spark, left, right) == [(7, "rate")]


def test_equal_times_of_a_key_are_settled_alike_on_both_sides(spark):
    both = [(1, "a", 1.0, 1), (1, "b", 2.0, 2)]
    assert diff(spark, both, both[::-1]) == []
