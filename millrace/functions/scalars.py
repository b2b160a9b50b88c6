"""Scalar functions over columns: cleaning, names, dates, geometry, text similarity."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Filler words that an identifier may carry without meaning.
FILLER_WORDS = ("the", "a", "an", "of", "in", "for", "to", "and", "or")


def money(text: Column) -> Column:
    """``" $1,303.68 "`` or ``"12.5 %"`` as a number; null if it is none."""
    return F.regexp_replace(F.trim(text), r"[$€£%,\s]", "").try_cast("double")


def looks_numeric(text: Column) -> Column:
    """Whether a cell is a number, with quotes and thousands commas allowed."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), "^[\"']|[\"']$", ""), ",", "")
    return F.coalesce(bare.try_cast("double").isNotNull(), F.lit(False))


def collapsed(text: Column) -> Column:
    """Lower case, single spaces, no outer ones."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def identifier(name: Column) -> Column:
    """A name in comparable form: lower case, filler words and separators dropped."""
    bare = F.regexp_replace(F.lower(name), rf"\b(?:{'|'.join(FILLER_WORDS)})\b", "")
    return F.regexp_replace(bare, r"[_\- ]", "")


def digits_as_hole(name: Column) -> Column:
    """``col_12_x3`` as ``col_{N}_x{N}``."""
    return F.regexp_replace(name, r"\d+", "{N}")


def truncated(text: Column, limit: int = 1000) -> Column:
    """Long text cut, with a note of its whole length."""
    note = F.concat(F.left(text, F.lit(limit)), F.lit("... ("), F.length(text).cast("string"), F.lit(" characters total)"))
    return F.when(F.length(text) > limit, note).otherwise(text)


def char_jaccard(a: Column, b: Column) -> Column:
    """Share of common characters of two texts; two empty ones have 0."""
    x, y = (F.array_distinct(F.filter(F.split(F.lower(c), ""), lambda v: v != "")) for c in (a, b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def token_overlap(a: Column, b: Column) -> Column:
    """Common tokens over those of the smaller of two token arrays; null if one is empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))


def similarity_ratio(a: Column, b: Column) -> Column:
    """0 to 100: one minus the edit distance over the longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 100.0).otherwise(100.0 * (1 - F.levenshtein(a, b) / longer))


def rgb(colour: Column) -> Column:
    """``#1fA2b3`` as three numbers."""
    part = lambda k: F.conv(F.substring(colour, k, 2), 16, 10).cast("int")
    return F.array(part(2), part(4), part(6))


def colour_distance(a: Column, b: Column) -> Column:
    x, y = rgb(a), rgb(b)
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda u, v: (u - v) * (u - v)), F.lit(0), lambda s, v: s + v).cast("double"))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    """Great-circle distance in the unit of the radius."""
    half = lambda x, y: F.sin(F.radians(y - x) / 2)
    h = F.pow(half(lat1, lat2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(half(lon1, lon2), F.lit(2))
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def code_lines(text: Column) -> Column:
    """Lines of Python code: neither blank, nor comment, nor inside a docstring."""
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("doc"))

    def step(state: Column, line: Column) -> Column:
        bare = F.trim(line)
        quotes = F.size(F.split(bare, '"""|\'\'\'')) - 1
        opens = quotes % 2 == 1
        counts = ~state["doc"] & (quotes == 0) & (bare != "") & ~F.startswith(bare, F.lit("#"))
        return F.struct((state["n"] + counts.cast("int")).alias("n"), (state["doc"] != opens).alias("doc"))

    return F.aggregate(F.split(F.coalesce(text, F.lit("")), "\n"), start, step, lambda s: s["n"])


def first_difference(a: Column, b: Column) -> Column:
    """1-based position of the first differing character; 0 if equal."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y))
    return F.when(a == b, 0).otherwise(F.array_position(pairs, False)).cast("int")


DEGREE_KM = math.pi * 6371.0 / 180
