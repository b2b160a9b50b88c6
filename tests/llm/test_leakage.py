import random
from collections import Counter

import numpy as np
import pytest

from millrace.functions.words import words
from millrace.llm import leakage as L


def brute(docs, items, span=12):
    runs = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - span + 1):
            runs.setdefault(tuple(w[k : k + span]), set()).add(i)
    return {(d, i) for d, t in docs for w in [words(t)] for k in range(len(w) - span + 1) for i in runs.get(tuple(w[k : k + span]), ())}


def tables(spark, docs, items):
    return spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")


def made(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(300)}"
    items = [(k, " ".join(word() for _ in range(rng.choice([5, 12, 40])))) for k in range(20)] + [(50, None), (51, "")]
    items.append((60, items[2][1]))
    docs = []
    for k in range(60):
        w = [word() for _ in range(rng.randint(0, 60))]
        source = words(rng.choice(items[:20])[1])
        n = rng.choice([8, 11, 12, 20, 40])
        at = rng.randrange(len(source))
        docs.append((k, "; ".join(w[:20]) + " -- " + "_".join(x.upper() for x in source[at : at + n]) + "\n" + " ".join(w[20:])))
    return docs + [(100, None), (101, ""), (102, "short")], items


@pytest.mark.parametrize("seed", range(3))
def test_exact_passages(spark, seed):
    docs, items = made(seed)
    found = L.find_leaks(*tables(spark, docs, items))
    assert {(r["doc_id"], r["item_id"]) for r in found.where("passages > 0").collect()} == brute(docs, items)


def test_blocks_of_items_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(L, "INDEX_BYTES", 20_000)
    monkeypatch.setattr(L, "CHUNK_WORDS", 64)
    docs, items = made(7)
    docs.append((200, " ".join(f"z{k}" for k in range(500)) + " " + items[2][1] + " end" * 300))
    found = L.find_leaks(*tables(spark, docs, items))
    assert {(r["doc_id"], r["item_id"]) for r in found.where("passages > 0").collect()} == brute(docs, items)


def test_candidates_are_all_within_the_radius():
    rng = np.random.default_rng(3)
    items = [(k, " ".join(f"w{rng.integers(0, 50)}" for _ in range(40))) for k in range(10)]
    index = L.ItemIndex.build(items, 12, 5, 3)
    probe = index.fingerprint[rng.integers(0, len(index.fingerprint), 300)] ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    a, b = index.candidates(probe)
    d = np.bitwise_count(probe[:, None] ^ index.fingerprint[None, :])
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(d <= 3)), strict=True))


def test_sliding_sum():
    x = np.arange(20).reshape(10, 2)
    for width in range(1, 9):
        assert (L._sliding_sum(x, width) == np.lib.stride_tricks.sliding_window_view(x, width, axis=0).sum(axis=2)).all()


def test_empty(spark):
    docs, items = made(1)
    assert L.find_leaks(*tables(spark, [], items)).count() == 0
    assert L.find_leaks(*tables(spark, docs, [])).count() == 0


def share(item, doc, size=5):
    """The best weighted share of the item's shingles in a window of its size, by brute force."""
    a, b = words(item), words(doc)
    grams = lambda w: [tuple(w[k : k + size]) for k in range(len(w) - size + 1)]
    weigh = lambda x: min(4, max(1, sum(map(len, x)) // (8 * size) + 1))
    own = Counter(grams(a))
    total = sum(weigh(x) * n for x, n in own.items())
    best = 0
    for k in range(max(1, len(b) - len(a) + 1)):
        common = own & Counter(grams(b[k : k + len(a)]))
        best = max(best, sum(weigh(x) * n for x, n in common.items()))
    return best / total


@pytest.mark.parametrize("seed", range(2))
def test_near_copies(spark, seed):
    """Whole items with words inserted, deleted and changed: the similarity is that of brute force, and none from 0.8 up is lost."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(500)}" * rng.choice([1, 1, 4])
    items = [(k, " ".join(word() for _ in range(rng.choice([12, 16, 30, 60, 90])))) for k in range(25)]
    docs = []
    for k in range(150):
        w = words(items[k % 25][1])
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1])] = [word()] * rng.choice([0, 1])
        docs.append((k, " ".join([word() for _ in range(rng.randint(0, 30))] + w + [word() for _ in range(rng.randint(0, 30))])))
    found = {(r["doc_id"], r["item_id"]): r for r in L.find_leaks(*tables(spark, docs, items)).collect()}
    want = {(d, i): s for d, t in docs for i, x in items if (s := share(x, t)) >= 0.8}
    assert len(want) > 60
    assert set(want) == {k for k, r in found.items() if r["similarity"] >= 0.8}
    assert all(abs(found[k]["similarity"] - s) < 1e-9 for k, s in want.items())


def test_one_edit_of_a_whole_item(spark):
    """One word inserted, deleted or changed at any place of an item of 30 words or more."""
    w = [f"v{k}" for k in range(40)]
    made = [w[:at] + edit + w[at + cut :] for at in range(40) for edit, cut in ((["new"], 0), ([], 1), (["new"], 1))]
    docs = [(k, "some words before " + " ".join(x) + " and after") for k, x in enumerate(made)]
    found = L.find_leaks(*tables(spark, docs, [(1, " ".join(w))])).where("similarity >= 0.8")
    assert found.count() == len(docs)
