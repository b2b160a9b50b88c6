"""Near-duplicate records: fingerprints in vantage-point trees, exact verification.

The likeness of two texts is the number of common words (with multiplicity)
over the word count of the longer one. Texts with the same words are one class
and are compared once. A class's fingerprint has one bit for each word
occurrence, toggled, so the Hamming distance of two fingerprints is at most
the number of words they do not share: a likeness of ``t`` bounds it by
``na + nb - 2 * ceil(t * max(na, nb))``.

Fingerprints are partitioned into shards by the rare words of their class. Two
classes that are alike enough must share one of their ``n - ceil(t * n) + 1``
rarest words, whatever order of rarity is used, so overlapping shards lose no
pair. In a shard a vantage-point tree partitions the fingerprints by distance
to a vantage point; by the triangle inequality only those within the radius of
a cell's border are compared across it. Candidates are verified on their words.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.words import words_column
from millrace.session import broadcast_if_small, materialised

#: Words whose exact frequency the driver and every task know, at most: 1 MB. The rarer others count as equally rare.
KNOWN_WORDS = 1 << 16

#: Rows of one shard in one task; beyond it a shard is split into blocks, and
#: each pair of blocks is a task of its own.
SHARD_ROWS = 20_000

#: Bytes of verified pairs up to which they are sent to the words' scan.
BROADCAST_BYTES = 32 << 20

LEAF = 48
_ONE = np.uint64(1)


def _class_hash(content: Column, salt: int) -> Column:
    return F.xxhash64(content, F.lit(salt))


def classes_of(records: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``(members, classes)``: keys with the class of their text, and each class once.

    A class is the multiset of words, named by a 64-bit hash of the sorted
    words. A second hash tells different texts of one name; the few names
    that have some are hashed anew, so two classes are one only if 128 bits
    coincide.
    """
    worded = records.select(F.col(key).alias("id"), F.array_join(F.array_sort(words_column(F.col(text).cast("string"))), " ").alias("content"))
    worded = worded.where("id is not null and content <> ''").withColumn("class", _class_hash(F.col("content"), 0))
    for salt in count(1):
        second = F.xxhash64("content")
        classes = worded.groupBy("class").agg(F.first("content").alias("content"), F.min(second).alias("low"), F.max(second).alias("high"))
        classes = materialised(classes, "neardup-classes")
        # of n texts some n * n / 2**65 share a name
        shared = [r["class"] for r in classes.where("low <> high").select("class").collect()]
        if not shared:
            return worded.select("class", "id").distinct(), classes.select("class", "content")
        worded = worded.withColumn("class", F.when(F.col("class").isin(shared), _class_hash(F.col("content"), salt)).otherwise(F.col("class")))


def _word_counts(classes: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes and exact counts of the ``KNOWN_WORDS`` most frequent words at most, and the count from which on all are known.

    Counts are of classes that have the word. With t words in all classes,
    those of at least t / ``KNOWN_WORDS`` are sure to be known.
    """
    word = F.explode(F.array_distinct(F.split("content", " "))).alias("word")
    counted = materialised(classes.select(word).groupBy(F.xxhash64("word").alias("word")).agg(F.count("*").alias("n")).where("n > 1"), "neardup-words")
    by_size = counted.groupBy(F.floor(F.log2("n")).cast("int").alias("size")).agg(F.count("*").alias("words")).collect()
    least, total = 2, 0
    for r in sorted(by_size, key=lambda r: -r["size"]):
        total += r["words"]
        if total > KNOWN_WORDS:
            least = 2 ** (r["size"] + 1)
            break
    known = counted.where(F.col("n") >= least).toPandas()
    hashed = known["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashed)
    return hashed[order], known["n"].to_numpy(np.int64)[order], least


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        # as the JVM hashes a text
        self[word] = value = xxhash.xxh64_intdigest(word, seed=42)
        return value


def _elements(content: str, hashed: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and of each (word, occurrence); ``content`` is sorted."""
    w = content.split(" ")
    word = np.fromiter((hashed[x] for x in w), np.uint64, len(w))
    first = np.empty(len(w), bool)
    first[0] = True
    first[1:] = word[1:] != word[:-1]
    starts = np.nonzero(first)[0]
    nth = np.arange(len(w)) - np.repeat(starts, np.diff(np.append(starts, len(w))))
    return word, word + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _fingerprint(element: np.ndarray) -> tuple[int, int]:
    """128 bits, one toggled by each element."""
    bit = (element >> np.uint64(20)) & np.uint64(127)
    odd = np.bincount(bit.astype(np.int64), minlength=128) & 1
    packed = np.packbits(odd.astype(np.uint8)).view(np.int64)
    return int(packed[0]), int(packed[1])


def _radius(na: np.ndarray, nb: np.ndarray, likeness: float) -> np.ndarray:
    """The largest Hamming distance of two texts of these lengths that are alike enough."""
    longer = np.maximum(na, nb)
    return na + nb - 2 * np.ceil(likeness * longer - 1e-9).astype(np.int64)


class Shard:
    """Pairs of one shard within the radius, by a vantage-point tree over its fingerprints."""

    def __init__(self, prints: np.ndarray, sizes: np.ndarray, side: np.ndarray | None, likeness: float):
        self.prints, self.sizes, self.side, self.likeness = prints, sizes, side, likeness
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(self.sizes, kind="stable")
        self._within(order)
        if not self.left:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(self.left), np.concatenate(self.right)

    def _distance(self, rows: np.ndarray, one: int) -> np.ndarray:
        return np.bitwise_count(self.prints[rows] ^ self.prints[one]).sum(axis=1, dtype=np.int64)

    def _reach(self, rows: np.ndarray) -> int:
        """The radius of any pair of these rows: it grows with the longest text."""
        longest = int(self.sizes[rows].max())
        return 2 * longest - 2 * math.ceil(self.likeness * longest - 1e-9)

    def _within(self, rows: np.ndarray) -> None:
        stack = [rows]
        while stack:
            rows = stack.pop()
            if len(rows) <= LEAF:
                self._compare(rows, rows, True)
                continue
            vantage = int(rows[len(rows) // 2])
            distance = self._distance(rows, vantage)
            border = int(np.median(distance))
            inner = distance <= border
            if inner.all():
                # nothing lies beyond: the cell is one ball of equal distances
                self._compare(rows, rows, True)
                continue
            reach = self._reach(rows)
            near_in = rows[inner & (distance >= border + 1 - reach)]
            near_out = rows[~inner & (distance <= border + reach)]
            self._compare(near_in, near_out, False)
            stack += [rows[inner], rows[~inner]]

    def _compare(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        """Pairs of ``a`` and ``b`` within the radius of their lengths, in blocks of bounded size."""
        if not len(a) or not len(b):
            return
        step = max(1, 1_000_000 // len(b))
        for at in range(0, len(a), step):
            part = a[at : at + step]
            distance = np.bitwise_count(self.prints[part][:, None, :] ^ self.prints[b][None, :, :]).sum(axis=2, dtype=np.int64)
            ok = distance <= _radius(self.sizes[part][:, None], self.sizes[b][None, :], self.likeness)
            if same:
                ok &= np.arange(at, at + len(part))[:, None] < np.arange(len(b))[None, :]
            if self.side is not None:
                ok &= self.side[part][:, None] != self.side[b][None, :]
            x, y = np.nonzero(ok)
            self.left.append(part[x])
            self.right.append(b[y])


def _shard_pairs(frame: pd.DataFrame, likeness: float) -> pd.DataFrame:
    """Candidates of whole shards, which stand one after the other in ``frame``."""
    key = frame["shard"].to_numpy()
    block = frame["block"].to_numpy()
    side = frame["side"].to_numpy()
    cls = frame["class"].to_numpy()
    sizes = frame["n"].to_numpy(np.int64)
    prints = np.stack([frame["f1"].to_numpy(np.int64), frame["f2"].to_numpy(np.int64)], axis=1).view(np.uint64)
    starts = np.nonzero(np.append(True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])))[0]
    length = np.diff(np.append(starts, len(key)))
    group = np.repeat(np.arange(len(starts)), length)
    left, right = [], []
    small = np.repeat(length <= LEAF, length) & (block == 0)
    # small shards all at once: each row with its d-th follower in the same shard
    for d in range(1, min(LEAF, int(length.max(initial=0)))):
        at = np.nonzero(small[:-d] & (group[:-d] == group[d:]))[0]
        if not len(at):
            break
        distance = np.bitwise_count(prints[at] ^ prints[at + d]).sum(axis=1, dtype=np.int64)
        ok = distance <= _radius(sizes[at], sizes[at + d], likeness)
        left.append(at[ok])
        right.append(at[ok] + d)
    for g in np.nonzero((length > LEAF) | (block[starts] != 0))[0]:
        rows = slice(int(starts[g]), int(starts[g] + length[g]))
        sides = side[rows]
        across = block[rows.start] < 0
        if across and sides.min() == sides.max():
            continue  # a pair of blocks of which only one has rows
        x, y = Shard(prints[rows], sizes[rows], sides if across else None, likeness).pairs()
        left.append(x + rows.start)
        right.append(y + rows.start)
    a = cls[np.concatenate(left)] if left else np.empty(0, np.int64)
    b = cls[np.concatenate(right)] if right else np.empty(0, np.int64)
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def _in_blocks(placed: DataFrame, most: int, least: int) -> DataFrame:
    """``placed`` with ``block`` and ``side``: shards of more than ``SHARD_ROWS`` rows are split into blocks, each pair of which is a cell.

    A shard has no more rows than classes have its word, so only those of
    frequent words are counted, and all if words of unknown frequency may be
    that frequent. Pairs of blocks (i, j) with i < j are negative.
    """
    whole = placed.withColumn("block", F.lit(0).cast("bigint")).withColumn("side", F.lit(0).cast("byte")).drop("often")
    if max(most, least - 1) <= SHARD_ROWS:
        return whole
    placed = materialised(placed, "neardup-placed")
    counted = placed.where((F.col("often") > SHARD_ROWS) | F.lit(least - 1 > SHARD_ROWS) & (F.col("often") == 0)).groupBy("shard").agg(F.count("*").alias("rows"))
    hot = broadcast_if_small(counted.where(F.col("rows") > SHARD_ROWS).select("shard", F.ceil(F.col("rows") / SHARD_ROWS).cast("int").alias("blocks")), "neardup-hot")
    own, other, blocks = F.pmod("class", "blocks").cast("int"), F.col("other"), F.coalesce("blocks", F.lit(1))
    spread = placed.join(hot, "shard", "left").withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cell = 1 + F.least(own, other).cast("bigint") * F.col("blocks") + F.greatest(own, other)
    block = F.when(F.col("blocks").isNull(), 0).when(own == other, cell).otherwise(-cell)
    side = F.when(F.col("blocks").isNull(), 0).otherwise((own > other).cast("int")).cast("byte")
    return spread.select("shard", block.cast("bigint").alias("block"), side.alias("side"), "class", "n", "f1", "f2")


def similar_classes(classes: DataFrame, likeness: float = 0.8) -> DataFrame:
    """``(a, b, likeness)`` of the different classes that are alike enough, ``a < b``."""
    spark = classes.sparkSession
    known, counts, least = _word_counts(classes)
    shared = spark.sparkContext.broadcast((known, counts))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, counts = shared.value
        hashed = _Hashes()
        columns = ["shard", "often", "class", "n", "f1", "f2"]
        for batch in batches:
            shard, seen, cls, n, f1, f2 = ([] for _ in columns)
            for c, content in zip(batch["class"].tolist(), batch["content"], strict=True):
                word, element = _elements(content, hashed)
                size = len(word)
                at = np.searchsorted(known, word)
                at[at == len(known)] = 0
                often = np.where(known[at] == word, counts[at], 0) if len(known) else np.zeros(size, np.int64)
                rare = np.lexsort((element, often))[: size - math.ceil(likeness * size - 1e-9) + 1]
                p1, p2 = _fingerprint(element)
                shard += element[rare].view(np.int64).tolist()
                seen += often[rare].tolist()
                cls += [c] * len(rare)
                n += [size] * len(rare)
                f1 += [p1] * len(rare)
                f2 += [p2] * len(rare)
            yield pd.DataFrame(dict(zip(columns, (shard, seen, cls, n, f1, f2), strict=True)))

    placed = classes.select("class", "content").mapInPandas(place, "shard long, often long, class long, n int, f1 long, f2 long")
    placed = _in_blocks(placed, max(counts, default=0), least)
    placed = placed.repartition("shard", "block").sortWithinPartitions("shard", "block")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for batch in batches:
            frame = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(frame):
                continue
            last = frame.iloc[-1]
            open_ = ((frame["shard"] == last["shard"]) & (frame["block"] == last["block"])).to_numpy()
            whole, rest = frame[~open_], frame[open_]
            if len(whole):
                yield _shard_pairs(whole, likeness)
        if rest is not None and len(rest):
            yield _shard_pairs(rest, likeness)

    found = placed.mapInPandas(search, "a long, b long").distinct()
    candidates = materialised(found, "neardup-candidates")
    few = candidates.count() * 16 <= BROADCAST_BYTES
    words_a = classes.select(F.col("class").alias("a"), F.col("content").alias("words_a"))
    words_b = classes.select(F.col("class").alias("b"), F.col("content").alias("words_b"))
    once = words_a.join(F.broadcast(candidates) if few else candidates, "a")
    both = once.join(words_b, "b") if not few else words_b.join(once.repartition("b"), "b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b, like = [], [], []
            for x, y, wx, wy in zip(batch["a"], batch["b"], batch["words_a"], batch["words_b"], strict=True):
                cx, cy = Counter(wx.split(" ")), Counter(wy.split(" "))
                common, longer = (cx & cy).total(), max(cx.total(), cy.total())
                if common >= likeness * longer - 1e-9:
                    a.append(x)
                    b.append(y)
                    like.append(common / longer)
            yield pd.DataFrame({"a": a, "b": b, "likeness": like})

    return both.select("a", "b", "words_a", "words_b").mapInPandas(verify, "a long, b long, likeness double")


def near_duplicates(records: DataFrame, key: str = "id", text: str = "question", likeness: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``: ``(class, id)`` of every record with words, and ``(a, b, likeness)`` of classes.

    Two records are near-duplicates if they are of one class (likeness 1) or
    of linked classes; no pair at or above ``likeness`` is missed and none
    below it is given. Copies are members of one class and are not expanded.
    Records with a null key, and null, empty or wordless texts match nothing.
    Repeated rows are one record; other columns are not read.
    """
    if not 0.5 < likeness <= 1:
        raise ValueError("the likeness lies above 0.5, up to 1")
    members, classes = classes_of(records, key, text)
    return members, similar_classes(classes, likeness)


def duplicate_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """``(id_a, id_b)`` of all near-duplicate records, smaller id first."""
    first = members.select(F.col("class").alias("a"), F.col("id").alias("x"))
    second = members.select(F.col("class").alias("b"), F.col("id").alias("y"))
    across = links.select("a", "b").join(first, "a").join(second, "b").select("x", "y")
    same = first.join(second, F.col("a") == F.col("b")).select("x", "y").where("x < y")
    pairs = across.unionByName(same).where("x <> y")
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
