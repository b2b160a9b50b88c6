import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import encode as E

FOLDER = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")
RANKS = E.read_ranks(f"{FOLDER}/byte_bpe_50k.tiktoken")
SMALL, WHOLE = E.Codec(RANKS, leaf_chars=3), E.Codec(RANKS, leaf_chars=1 << 30)
PIECES = ["a", "B", "'s", "'", "'ll", " ", "  ", "\n", "\t", "\x0b", "\x1c", " ", " ", "é", "ß", "́", "1", "23", "²", "中文", "。", "!", "…", "👍", "👩‍👩‍👧", "_", "`", "``", "the", " and", "<|endoftext|>"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join))
def test_tree_equals_whole(text):
    assert SMALL.encode(text) == WHOLE.encode(text)
    assert SMALL.decode(SMALL.encode(text)) == text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert SMALL.encode(text) == WHOLE.plain(text)


def test_against_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    for text in ("Hello, world!\n\n  x = 1", "naïve café 日本語", "don't  stop<|endoftext|>", " " * 50):
        assert SMALL.encode(text) == other.encode(text, add_special_tokens=False).ids


def test_long_texts_without_seams():
    for text in ("x" * 20_000, "中" * 5_000, " " * 9_000, "ab " * 9_000):
        assert E.Codec(RANKS, leaf_chars=64).encode(text) == WHOLE.encode(text)


def test_corpus_and_round_trip(spark):
    rows = [(1, "Hello there", "x"), (2, "", "x"), (3, None, "x"), (4, " \n ", "x"), (None, "null key", "x"), (1, "Hello there", "x"), (5, "long " * 40_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    path = f"{FOLDER}/byte_bpe_50k.tiktoken"
    encoded = E.encode_corpus(docs, path)
    got = sorted(((r["doc_id"], list(r["ids"])) for r in encoded.collect()), key=repr)
    assert got == sorted(((i, WHOLE.encode(t)) for i, t, _ in rows), key=repr)
    texts = sorted(((r["doc_id"], r["text"]) for r in E.decode_corpus(encoded, path).collect()), key=repr)
    assert texts == sorted(((i, t or "") for i, t, _ in rows), key=repr)
    assert E.encode_corpus(docs.limit(0), path).count() == 0
