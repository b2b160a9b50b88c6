"""Held-out test items in a corpus: SimHash windows, multi-index blocks, exact check.

A window of ``anchor`` words has as fingerprint the SimHash of its word
shingles, weighted by their length. Every window of every item is
fingerprinted once and indexed by each of ``radius + 1`` blocks of its bits, so
that any corpus window within the radius shares a block with its item (by the
pigeonhole principle) and none is missed. Candidates are verified: by equal
runs of ``span`` words, and by the weighted multiset of the shingles that the
item and an item-sized window of the document have in common.

No copy of at least 0.8 is lost. If an item has m shingles of five words and L
of them are lost, each place of a change costs four at least, so the others
stand in at most L / 4 + 1 runs. With L <= 0.2 m the longest run has five
shingles or more, nine words, whatever m is from 8 on; it holds a whole anchor.

The corpus is never shuffled. The items are a stated query set: they are taken
in blocks whose index has a bounded size, each against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.words import words
from millrace.session import spread

#: Bytes of the index of one block of items; the driver builds one at a time, and each worker holds one.
INDEX_BYTES = 128 << 20

#: Bytes of the index for a word of an item, and the least that a word takes in its text.
WORD_BYTES, TEXT_BYTES = 96, 2

#: Words worked on at once in a worker: bounds its memory for texts of any length.
CHUNK_WORDS = 1 << 16


class _WordHash(dict):
    """Hash of a word, remembered; emptied when it holds very many words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a shingle's hash count."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shingles(hashes: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and weight of the shingle that begins at each word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int8)
    value, chars = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for k in range(size):
        value = value * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
        chars += lengths[k : k + n]
    return _mix(value), np.clip(chars // (8 * size) + 1, 1, 4).astype(np.int8)


def _sliding_sum(x: np.ndarray, width: int) -> np.ndarray:
    """Sums of ``width`` neighbouring rows by doubling."""
    done, total, n = 0, None, len(x) - width + 1
    power, run = 1, x
    while True:
        if width & power:
            part = run[done : done + n]
            total = part.copy() if total is None else total + part
            done += power
        if power * 2 > width:
            return total
        run = run[:-power] + run[power:]
        power *= 2


def _simhash(shingle: np.ndarray, weight: np.ndarray, width: int) -> np.ndarray:
    """Fingerprint of each run of ``width`` shingles."""
    if len(shingle) < width:
        return np.empty(0, np.uint64)
    bits = np.unpackbits(shingle.view(np.uint8).reshape(-1, 8), axis=1).view(np.int8)
    signed = (2 * bits - 1) * weight[:, None]
    if width * 4 > 127:
        signed = signed.astype(np.int32)
    return np.packbits(_sliding_sum(signed, width) > 0, axis=1).view(np.uint64).ravel()


@dataclass
class ItemIndex:
    """Windows of a block of test items, indexed by the blocks of their fingerprints."""

    anchor: int
    size: int
    radius: int
    ids: list[int]
    first: np.ndarray
    word: np.ndarray
    shingle: np.ndarray
    weight: np.ndarray
    fingerprint: np.ndarray
    at: np.ndarray
    item: np.ndarray
    blocks: list[tuple[int, int, np.ndarray, np.ndarray]]

    @classmethod
    def build(cls, items: list[tuple[int, str | None]], anchor: int, size: int, radius: int) -> ItemIndex:
        hashed, width = _WordHash(), anchor - size + 1
        ids, first, word, shingle, weight, prints, at, item = [], [0], [], [], [], [], [], []
        for item_id, content in items:
            w = words(content)
            if len(w) < anchor:
                continue
            h = np.fromiter((hashed[x] for x in w), np.uint64, len(w))
            s, g = _shingles(h, np.fromiter(map(len, w), np.int64, len(w)), size)
            word.append(h)
            shingle.append(s)
            weight.append(g)
            prints.append(_simhash(s, g, width))
            at.append(first[-1] + np.arange(len(w) - anchor + 1))
            item.append(np.full(len(w) - anchor + 1, len(ids)))
            ids.append(item_id)
            first.append(first[-1] + len(w))
        joined = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        found, blocks, parts = joined(prints, np.uint64), [], radius + 1
        for k in range(parts):
            low, high = 64 * k // parts, 64 * (k + 1) // parts
            value = (found >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
            order = np.argsort(value, kind="stable").astype(np.int32)
            blocks.append((low, high - low, value[order], order))
        # shingles stand at the place of their first word; the last places of an item hold none
        pad = lambda parts, kind: joined([np.concatenate([x, np.zeros(size - 1, kind)]) for x in parts], kind)
        return cls(
            anchor, size, radius, ids, np.array(first), joined(word, np.uint64), pad(shingle, np.uint64), pad(weight, np.int8), found,
            joined(at, np.int64).astype(np.int32), joined(item, np.int64).astype(np.int32), blocks,
        )

    @property
    def longest(self) -> int:
        return int(np.diff(self.first).max(initial=0))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of a corpus window and an item window within the radius."""
        windows, passages = [], []
        for low, width, keys, order in self.blocks:
            value = (prints >> np.uint64(low)) & np.uint64((1 << width) - 1)
            first = np.searchsorted(keys, value, "left")
            count = np.searchsorted(keys, value, "right") - first
            hit = np.nonzero(count)[0]
            if not len(hit):
                continue
            n = count[hit]
            window = np.repeat(hit, n)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            passage = order[np.repeat(first[hit], n) + offset]
            near = np.bitwise_count(prints[window] ^ self.fingerprint[passage]) <= self.radius
            windows.append(window[near])
            passages.append(passage[near])
        if not windows:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate(windows), np.concatenate(passages)]), axis=1)
        return pairs[0], pairs[1]

    def similarity(self, item: int, shingle: np.ndarray) -> float:
        """The greatest weighted share of the item's shingles that an item-sized window of ``shingle`` holds, each as often as it occurs in both."""
        low, high = int(self.first[item]), int(self.first[item + 1]) - self.size + 1
        own, weight = self.shingle[low:high], self.weight[low:high].astype(np.int64)
        total = int(weight.sum())
        value, start, count = np.unique(own, return_index=True, return_counts=True)
        at = np.minimum(np.searchsorted(value, shingle), len(value) - 1)
        known = value[at] == shingle
        gain = np.where(known, weight[start[at]], 0)
        width = min(len(own), len(shingle))
        upto = np.concatenate([[0], np.cumsum(gain)])
        bound = upto[width:] - upto[:-width]
        best = 0
        for k in np.argsort(-bound, kind="stable"):
            if bound[k] <= best:
                break
            seen, n = np.unique(at[k : k + width][known[k : k + width]], return_counts=True)
            best = max(best, int((weight[start[seen]] * np.minimum(n, count[seen])).sum()))
        return best / total


def _equal_runs(a: np.ndarray, b: np.ndarray, at: np.ndarray, to: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, n: int) -> np.ndarray:
    """Whether the ``n`` words from ``at`` of ``a`` and from ``to`` of ``b`` are equal and end before the given places."""
    ok = (at + n <= last_a) & (to + n <= last_b)
    for k in range(n):
        rows = np.nonzero(ok)[0]
        ok[rows] = a[at[rows] + k] == b[to[rows] + k]
    return ok


def _scan(index: ItemIndex, ids: list, texts: list[str | None], hashed: _WordHash, span: int) -> dict:
    """Per (document, item): exact passages and the best similarity of any item-sized window."""
    found: dict[tuple, list] = {}
    tokens: list[str] = []
    #: for each part of a document: its place among the tokens, where its last own window starts, and the document
    parts: list[tuple[int, int, int, int]] = []
    width, overlap = index.anchor - index.size + 1, max(index.longest, span) * 2
    chunk = max(CHUNK_WORDS, 4 * overlap)

    def flush() -> None:
        n = len(tokens)
        if n < index.anchor or not index.ids:
            return
        h = np.fromiter((hashed[x] for x in tokens), np.uint64, n)
        s, g = _shingles(h, np.fromiter(map(len, tokens), np.int64, n), index.size)
        prints = _simhash(s, g, width)
        begin, end, core, doc = (np.array(x) for x in zip(*parts, strict=True))
        own = np.repeat(np.arange(len(parts)), end - begin)
        whole = np.nonzero(own[: n - index.anchor + 1] == own[index.anchor - 1 :])[0]
        window, passage = index.candidates(prints[whole])
        window, place, item = whole[window], index.at[passage].astype(np.int64), index.item[passage]
        exact = _equal_runs(h, index.word, window, place, end[own[window]], index.first[item + 1], span) & (window < core[own[window]])
        seen: dict[tuple[int, int], list[int]] = {}
        for w, i, e in zip(window.tolist(), item.tolist(), exact.tolist(), strict=True):
            entry = seen.setdefault((int(own[w]), i), [w, w, 0])
            entry[0], entry[1], entry[2] = min(entry[0], w), max(entry[1], w), entry[2] + e
        for (part, i), (first, last, passages) in seen.items():
            size = int(index.first[i + 1] - index.first[i])
            low, high = max(int(begin[part]), first - size), min(int(end[part]), last + index.anchor + size)
            entry = found.setdefault((ids[doc[part]], index.ids[i]), [0, 0.0])
            entry[0] += passages
            entry[1] = max(entry[1], index.similarity(i, s[low : high - index.size + 1]))

    for k, text in enumerate(texts):
        w = words(text)
        if len(w) < index.anchor:
            continue
        start = 0
        while True:
            part = w[start : start + chunk]
            final = start + len(part) >= len(w)
            at = len(tokens)
            tokens += part
            parts.append((at, at + len(part), at + len(part) - (0 if final else overlap), k))
            if len(tokens) >= chunk:
                flush()
                tokens, parts = [], []
            if final:
                break
            start += len(part) - overlap
    flush()
    return found


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    doc_key: str = "doc_id",
    doc_text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    span: int = 12,
    shingle: int = 5,
    anchor: int = 8,
    radius: int = 1,
    similarity: float = 0.8,
) -> DataFrame:
    """``(doc_key, item_key, passages, similarity)`` of documents that hold test passages.

    ``passages`` counts pairs of a window of ``span`` words of the document
    and an equal window of the item; ``similarity`` is the best weighted share
    of the item's shingles that a window of the item's size holds, by
    multiplicity. Pairs without an equal window are kept from ``similarity``
    up. Whole texts are read, whatever their length. Null, empty and short
    texts match nothing; a null item key is skipped; repeated document rows
    give repeated result rows. Other columns are not read.
    """
    if not 0 < shingle <= anchor <= span:
        raise ValueError("a shingle has between one word and as many as the anchor, and an anchor as many as the span at most")
    spark = documents.sparkSession
    items = items.select(F.col(item_key).cast("long").alias("item"), F.col(item_text).alias("content"))
    items = items.where("item is not null and content is not null").distinct()
    # a block's index has INDEX_BYTES on average, by the least size of its words' text
    size = items.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("n")).first()["n"]
    n_blocks = max(1, -(-size * WORD_BYTES // TEXT_BYTES // INDEX_BYTES))
    # the key passes through Python as text: pandas would turn whole numbers beside nulls into floats
    slim = documents.select(F.col(doc_key).cast("string").alias(doc_key), doc_text)
    result = None
    for k in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == k).orderBy("item", "content").collect()
        shared = spark.sparkContext.broadcast(ItemIndex.build([(r["item"], r["content"]) for r in block], anchor, shingle, radius))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index, hashed = shared.value, _WordHash()
            for batch in batches:
                found = _scan(index, batch[doc_key].tolist(), batch[doc_text].tolist(), hashed, span)
                kept = [(*k, *v) for k, v in found.items() if v[0] or v[1] >= similarity]
                yield pd.DataFrame(kept, columns=[doc_key, item_key, "passages", "similarity"])

        part = spread(slim).mapInPandas(run, f"`{doc_key}` string, `{item_key}` bigint, passages bigint, similarity double")
        result = part if result is None else result.unionByName(part)
    return result.withColumn(doc_key, F.col(doc_key).cast(documents.schema[doc_key].dataType))
