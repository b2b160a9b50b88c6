"""Encoding of a corpus with a byte-level BPE vocabulary, as a monoid reduction.

A text is halved until the pieces are small, the pieces are encoded, and
neighbours are joined pairwise up the tree. A join encodes again only a window
around the seam. The window ends where the vocabulary's splitting pattern must
have a boundary whatever stands elsewhere in the text, so every token outside
it provably keeps its id; it grows until it has such an end on both sides.
Because the join is associative, one very long text costs no more than many
short ones of the same length.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.session import spread

#: Fixed value: the public pattern that splits a text before merges.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Positions where the pattern has a boundary in any context: no alternative
#: goes on from a visible character to white space, from an ASCII letter to an
#: ASCII non-letter, from an ASCII digit to an ASCII non-digit, or from an
#: ideograph to CJK punctuation. Only character classes that are the same in
#: every Unicode version are used.
SEAM = re.compile(
    r"(?<=[^\s\x1c-\x1f])(?=[ \n])"
    r"|(?<=[A-Za-z])(?=[\x00-@\[-`{-\x7f])"
    r"|(?<=[0-9])(?=[\x00-/:-\x7f])"
    r"|(?<=[一-鿿])(?=[、。，：；！？])"
)

LEAF_CHARS = 4096
FIRST_WINDOW = 64

#: Ids that a worker holds before it hands them on.
FLUSH_IDS = 2_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with lines of base64 token and id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Codec:
    """Encoder and decoder of one vocabulary; texts of any length, no special tokens."""

    def __init__(self, ranks: dict[bytes, int], leaf_chars: int = LEAF_CHARS):
        import tiktoken

        self.leaf_chars = leaf_chars
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.plain: Callable[[str], list[int]] = tiktoken.Encoding(
            "millrace", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text``; an empty list for an empty or null text."""
        if not text:
            return []
        return self._reduce(text, 0, len(text))

    def decode(self, ids: list[int] | None) -> str:
        """The text of ``ids``: the tokens' bytes joined; null gives an empty text."""
        return b"".join(self.tokens[i] for i in ids or ()).decode("utf-8", errors="replace")

    def _reduce(self, text: str, start: int, end: int) -> list[int]:
        if end - start <= self.leaf_chars:
            return self.plain(text[start:end])
        middle = (start + end) // 2
        return self.join(text, start, middle, end, self._reduce(text, start, middle), self._reduce(text, middle, end))

    def join(self, text: str, start: int, middle: int, end: int, left: list[int], right: list[int]) -> list[int]:
        """Ids of ``text[start:end]`` from those of its two parts."""
        low, high = start, end
        window = FIRST_WINDOW
        while middle - window > start:
            seams = [m.start() for m in SEAM.finditer(text, middle - window, middle + 1) if start < m.start() <= middle]
            if seams:
                low = seams[-1]
                break
            window *= 2
        window = FIRST_WINDOW
        while middle + window < end:
            seam = next((m.start() for m in SEAM.finditer(text, middle, middle + window) if m.start() >= middle), None)
            if seam is not None:
                high = seam
                break
            window *= 2
        keep, rest = len(left), len(text[low:middle].encode())
        while rest > 0:
            keep -= 1
            rest -= self.length[left[keep]]
        skip, over = 0, len(text[middle:high].encode())
        while over > 0:
            over -= self.length[right[skip]]
            skip += 1
        if rest or over:
            raise AssertionError("a seam is no token boundary")
        return left[:keep] + self.plain(text[low:high]) + right[skip:]


_codecs: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """One codec a Python worker, from the broadcast ranks."""
    key = shared.value["key"]
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value["ranks"], shared.value["leaf_chars"])
    return _codecs[key]


def _share(df: DataFrame, path: str, leaf_chars: int):
    """The vocabulary as a broadcast: its size is fixed by the file, not by the data."""
    value = {"key": f"{path}:{leaf_chars}", "ranks": read_ranks(path), "leaf_chars": leaf_chars}
    return df.sparkSession.sparkContext.broadcast(value)


def encode_corpus(
    documents: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", leaf_chars: int = LEAF_CHARS
) -> DataFrame:
    """``(key, ids ARRAY<INT>)`` of every row of ``documents``, without special tokens.

    ``vocabulary`` is the path of a rank file on the driver. Null and empty
    texts have an empty list; blank texts are encoded as they stand. Rows are
    kept as they are, also repeated ones and ones with a null key. Other
    columns are not read. One narrow stage: no shuffle.
    """
    shared = _share(documents, vocabulary, leaf_chars)
    slim = documents.select(key, text)
    schema = T.StructType([slim.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            first, offsets, values = 0, [0], []
            for row, value in enumerate(batch.column(1), 1):
                values.extend(codec.encode(value.as_py()))
                offsets.append(len(values))
                if len(values) >= FLUSH_IDS or row == batch.num_rows:
                    ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0)[first:row], ids], names=[key, "ids"])
                    first, offsets, values = row, [0], []

    return spread(slim).mapInArrow(run, schema)


def decode_corpus(encoded: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(key, text)`` from ``(key, ids)``; a null or empty list gives an empty text."""
    shared = _share(encoded, vocabulary, LEAF_CHARS)
    slim = encoded.select(key, ids)
    schema = T.StructType([slim.schema[key], T.StructField("text", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            texts = pa.array([codec.decode(value.as_py()) for value in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=[key, "text"])

    return slim.mapInArrow(run, schema)
