"""Words of a text: longest runs of Unicode letters or digits, lower-cased."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: In Python: a word character that is not the underscore.
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return [w.lower() for w in WORD.findall(text)] if text else []


def iter_words(text: str) -> Iterator[str]:
    for m in WORD.finditer(text):
        yield m.group().lower()


def words_column(text: Column) -> Column:
    """The same words as an array column; null texts have none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(found, lambda w: F.lower(w))
