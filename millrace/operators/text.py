"""Term statistics and the structure of marked-up and log texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.words import words_column


def term_counts(documents: DataFrame, text: str) -> DataFrame:
    """``(word, n)`` over all documents; null texts have no words."""
    return documents.select(F.explode(words_column(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def idf(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``(word, df, idf)``: the number of documents with the word, and the log of its inverse share."""
    some = documents.where(F.col(text).isNotNull())
    total = some.agg(F.count("*").alias("total"))
    df = some.select(F.explode(F.array_distinct(words_column(F.col(text)))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(total)).select("word", "df", F.log(F.col("total") / F.col("df")).alias("idf"))  # total is one row


def tf_idf(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, word, tf_idf)``: the count of a word in a document times its idf."""
    tf = documents.select(key, F.explode(words_column(F.col(text))).alias("word")).groupBy(key, "word").agg(F.count("*").alias("tf"))
    return tf.join(idf(documents, key, text), "word").select(key, "word", (F.col("tf") * F.col("idf")).alias("tf_idf"))


def markdown_structure(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, headings, fences, table_rows, items)`` by lines, without leaving the JVM."""
    lines = F.split(text, "\n", -1)
    count = lambda pattern: F.size(F.filter(lines, lambda x: x.rlike(pattern))).cast("bigint")
    return documents.select(
        key, count("^#{1,6} ").alias("headings"), count("^```").alias("fences"), count(r"^\|.*\|$").alias("table_rows"), count(r"^ *([-*+]|[0-9]+[.]) ").alias("items")
    )


def log_levels(logs: DataFrame, text: str, pattern: str = r"\b(DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL|TRACE)\b") -> DataFrame:
    """``(level, n)``: lines by level; WARNING counts as WARN."""
    level = F.regexp_replace(F.regexp_extract("line", pattern, 1), "^WARNING$", "WARN").alias("level")
    return logs.select(F.explode(F.split(text, "\n", -1)).alias("line")).select(level).where("level <> ''").groupBy("level").agg(F.count("*").alias("n"))


# Families of time stamps in logs; the first that fits most lines wins.
STAMPS = {
    "iso8601": r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}",
    "clf": r"\[\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2}",
    "syslog": r"^[A-Z][a-z]{2} [ \d]\d \d{2}:\d{2}:\d{2}",
    "epoch": r"^\d{10}(?:\d{3})?\b",
}


def stamp_family(logs: DataFrame, text: str) -> DataFrame:
    """One row ``(family)``: the first family found in more than half of the lines, or null."""
    line = logs.select(F.explode(F.split(text, "\n", -1)).alias("line")).where("trim(line) <> ''")
    shares = line.agg(*(F.avg(F.col("line").rlike(p).cast("double")).alias(k) for k, p in STAMPS.items()))
    return shares.select(F.coalesce(*(F.when(F.col(k) > 0.5, F.lit(k)) for k in STAMPS)).alias("family"))
