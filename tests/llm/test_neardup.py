import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.functions.words import words
from millrace.llm import neardup as N


def brute(rows, likeness=0.8):
    records = sorted({(i, q) for i, q in rows if i is not None and words(q)})
    out = set()
    for k, (i, p) in enumerate(records):
        for j, q in records[k + 1 :]:
            a, b = Counter(words(p)), Counter(words(q))
            if i != j and (a & b).total() >= likeness * max(a.total(), b.total()) - 1e-9:
                out.add((min(i, j), max(i, j)))
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, q, "clash") for i, q in rows], "id long, question string, content string")
    return {tuple(r) for r in N.duplicate_pairs(*N.near_duplicates(df, **options)).collect()}


def edited(rng, text):
    w = text.split()
    for _ in range(rng.randint(0, 8)):
        k = rng.randrange(len(w))
        w[k : k + 1] = rng.choice([[], [w[k], w[k]], [f"new{rng.random()}"], w[k : k + 1]])
    rng.shuffle(w)
    return " ".join(w)


def test_all_pairs_and_no_others(spark):
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randint(4, 40))) for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(base)] + [(100 + k, edited(rng, rng.choice(base))) for k in range(80)]
    rows += [(300, "a b"), (301, "B, a!"), (302, None), (303, ""), (304, "?!"), (305, "a b"), (305, "a b"), (None, "a b"), (306, "a"), (307, "a")]
    assert found(spark, rows) == brute(rows)


def test_hot_shards_are_split(spark, monkeypatch):
    monkeypatch.setattr(N, "SHARD_ROWS", 10)
    rng = random.Random(9)
    base = " ".join(f"w{k}" for k in range(30))
    rows = [(k, base + " " + " ".join(f"x{rng.randrange(60)}" for _ in range(rng.randint(0, 14)))) for k in range(60)]
    assert found(spark, rows) == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 300), st.integers(0, 5))
def test_tree_finds_every_pair_within_the_radius(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, (4, 2), dtype=np.uint64)
    prints = centres[rng.integers(0, 4, n)] ^ (np.uint64(1) << rng.integers(0, 63, (n, 2), dtype=np.uint64))
    sizes = rng.integers(5, 40, n)
    x, y = N.Shard(prints, sizes, None, 0.8).pairs()
    got = {(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    d = np.bitwise_count(prints[:, None, :] ^ prints[None, :, :]).sum(axis=2, dtype=np.int64)
    ok = d <= N._radius(sizes[:, None], sizes[None, :], 0.8)
    assert got == {(a, b) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(ok)), strict=True) if a < b}


def test_classes_keep_copies_together(spark):
    df = spark.createDataFrame([(k, "the same words here") for k in range(50)], "id long, question string")
    members, links = N.near_duplicates(df)
    assert members.select("class").distinct().count() == 1 and members.count() == 50 and links.count() == 0


def test_empty_and_limits(spark):
    assert found(spark, []) == set()
    assert found(spark, [(1, "x " * 50_000), (2, "x " * 49_000)]) == {(1, 2)}
    with pytest.raises(ValueError):
        found(spark, [], likeness=0.3)


@pytest.mark.parametrize("known", [1 << 20, 8, 0])
def test_shards_of_words_of_unknown_frequency_are_split(spark, monkeypatch, known):
    """Exact counts, and exact shard sizes where frequencies are not all known: no word is too frequent for a shard."""
    monkeypatch.setattr(N, "SHARD_ROWS", 10)
    monkeypatch.setattr(N, "KNOWN_WORDS", known)
    rng = random.Random(5)
    rows = [(k, "common " + " ".join(f"x{rng.randrange(40)}" for _ in range(rng.randint(1, 6)))) for k in range(120)]
    assert found(spark, rows) == brute(rows)
    classes = N.classes_of(spark.createDataFrame(rows, "id long, question string"), "id", "question")[1]
    words_, counts, least = N._word_counts(classes)
    df = Counter(w for r in classes.collect() for w in set(r["content"].split()))
    assert sorted(counts.tolist()) == sorted(n for n in df.values() if n >= least) and len(counts) <= known


def test_python_hashes_words_as_the_jvm(spark):
    w = ["a", "groß", "日本", "x" * 100]
    got = [r["h"] for r in spark.createDataFrame([(x,) for x in w], "w string").selectExpr("xxhash64(w) as h").collect()]
    assert [int(np.uint64(N._Hashes()[x]).view(np.int64)) for x in w] == got


def test_texts_whose_names_coincide_are_told_apart(spark, monkeypatch):
    plain = N._class_hash
    monkeypatch.setattr(N, "_class_hash", lambda c, salt: plain(c, salt) % 3 if salt < 2 else plain(c, salt))
    rows = [(k, f"some words of text number{k // 2} and few{k // 2} more") for k in range(12)]
    assert found(spark, rows) == brute(rows)
