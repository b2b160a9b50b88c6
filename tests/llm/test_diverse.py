import itertools
import random

import pytest

from millrace.llm import diverse as D

WEIGHTS = {f"s{k}": float(k + 1) for k in range(8)}


def total(sets, chosen):
    def distance(x, y):
        common, both = set(x) & set(y), set(x) | set(y)
        return 1 - sum(WEIGHTS[s] for s in common) / sum(WEIGHTS[s] for s in both)

    return sum(distance(sets[a], sets[b]) for a, b in itertools.combinations(chosen, 2))


def random_sets(seed, n):
    rng = random.Random(seed)
    return sorted({tuple(sorted(rng.sample(sorted(WEIGHTS), rng.randint(1, 3)))) for _ in range(n)})


@pytest.mark.parametrize("seed", range(4))
def test_no_swap_improves_and_near_the_optimum(seed):
    sets = random_sets(seed, 12)
    chosen = D.disperse(sets, WEIGHTS, 4)
    assert len(set(chosen)) == 4
    value = total(sets, chosen)
    for i in chosen:
        for j in set(range(len(sets))) - set(chosen):
            assert total(sets, [*(set(chosen) - {i}), j]) <= value + 1.1e-4
    assert value >= 0.5 * max(total(sets, c) for c in itertools.combinations(range(len(sets)), 4))


def test_weights_of_null_and_zero(spark):
    skills = spark.createDataFrame([("a", 4.0), ("b", None), ("c", 0.0), ("d", float("nan")), (None, 3.0)], "id string, weight double")
    assert D.weights_of(skills) == {"a": 4.0, "b": 2.0, "c": 2.0, "d": 2.0}


def records(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "step_id string, skills array<string>, rank string")


def test_frequent_groups_do_not_crowd_out(spark):
    rows = [(f"hot{k:04d}", ["s7"]) for k in range(500)] + [(f"r{k}", [f"s{k}"]) for k in range(7)] + [("n1", None), ("n2", []), (None, ["s1"]), ("n3", ["unknown", None])]
    got = D.varied_subset(records(spark, rows), WEIGHTS, 8).collect()
    assert len(got) == 8 and {s for r in got for s in r["skills"]} == set(WEIGHTS)
    assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, 9))
    assert {r["step_id"]: r["records"] for r in got}["hot0000"] == 500


def test_fewer_sets_than_asked_for(spark):
    rows = [(f"a{k}", ["s1"]) for k in range(5)] + [(f"b{k}", ["s2"]) for k in range(3)]
    got = D.varied_subset(records(spark, rows), WEIGHTS, 6).collect()
    assert len({r["step_id"] for r in got}) == 6
    assert sum(r["skills"] == ["s1"] for r in got) == 3
    assert len(D.varied_subset(records(spark, rows), WEIGHTS, 100).collect()) == 8


def test_empty(spark):
    assert D.varied_subset(records(spark, []), WEIGHTS, 5).count() == 0


def test_blocks_give_the_same_as_held_distances(monkeypatch):
    sets = random_sets(5, 40)
    held = D.disperse(sets, WEIGHTS, 6)
    monkeypatch.setattr(D, "HELD_DISTANCES", 30)
    assert D.disperse(sets, WEIGHTS, 6) == held
    assert abs(D.total_distance([sets[k] for k in held], WEIGHTS) - total(sets, held)) < 1e-4


def test_rounds_of_core_sets_against_a_search_over_all(spark, monkeypatch):
    """Core-sets of 24 partitions in three rounds reach the total distance of a search over all candidates but for 1 %."""
    monkeypatch.setattr(D, "FAN_IN", 4)
    monkeypatch.setattr(D, "STREAM_ROWS", 50)
    rng = random.Random(2)
    weights = {f"s{k:02d}": rng.choice([1.0, 1.0, 3.0, 20.0]) for k in range(30)}
    sets = sorted({tuple(sorted(rng.sample(sorted(weights), rng.randint(1, 5)))) for _ in range(1500)})
    rows = [(f"r{k:05d}", list(x)) for k, x in enumerate(sets)]
    got = D.varied_subset(records(spark, rows), weights, 12, partitions=24).collect()
    assert len({tuple(r["skills"]) for r in got}) == 12
    whole = [sets[k] for k in D.disperse(sets, weights, 12)]
    assert D.total_distance([tuple(r["skills"]) for r in got], weights) >= 0.99 * D.total_distance(whole, weights)
