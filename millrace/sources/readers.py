"""Readers of whole tables from formats without a built-in source, and sinks that can be repeated."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator, Sequence
from itertools import islice, takewhile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from millrace.sources.files import looks_numeric, parse_arff, sniff_delimiter


def read_delimited(spark: SparkSession, path: str, schema: StructType | None = None, null: str = "\\N") -> DataFrame:
    """A delimited file with its delimiter found from the first lines, by the splittable reader.

    Without a schema the types are inferred and should be recorded; broken
    rows go to ``_corrupt_record`` only if the schema names that column.
    """
    head = [r["value"] for r in spark.read.text(path).limit(21).collect()]
    # a header is a first line without numbers
    delimiter = sniff_delimiter(head, "\t" if path.endswith(".tsv") else ",")
    header = bool(head) and not any(looks_numeric(c) for c in head[0].split(delimiter))
    reader = spark.read.option("sep", delimiter).option("header", header).option("nullValue", null).option("mode", "PERMISSIVE")
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", "true").csv(path)


def read_json_any(spark: SparkSession, path: str) -> DataFrame:
    """One document, an array of records, or one document a line, whatever the file's ending says."""
    lines = spark.read.json(path)
    if lines.columns and lines.columns != ["_corrupt_record"]:
        return lines
    return spark.read.option("multiLine", "true").json(path)


class ArffSource(DataSource):
    """``spark.read.format("arff")``: numeric attributes as doubles, all others as texts."""

    @classmethod
    def name(cls) -> str:
        return "arff"

    def schema(self) -> StructType:
        with open(self.options["path"], encoding="utf-8", errors="replace") as lines:
            head = "".join(takewhile(lambda x: not x.strip().lower().startswith("@data"), lines))
        _, attributes, _ = parse_arff(head)
        return StructType([StructField(a, DoubleType() if k in ("numeric", "real", "integer") else StringType()) for a, k in attributes])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ArffReader(self.options["path"], schema)


class _ArffReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        with open(self.path, encoding="utf-8", errors="replace") as file:
            _, _, rows = parse_arff(file.read())
        for row in rows:
            yield tuple((float(c) if c is not None and looks_numeric(c) else None) if isinstance(f.dataType, DoubleType) else c for c, f in zip(row, self.schema, strict=True))


class SqliteSource(DataSource):
    """``spark.read.format("sqlite_table").option("table", ...)``: a table by ranges of its row ids."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> StructType:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            columns = list(db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})"))
        if not columns:
            raise ValueError("no such table")
        return StructType([StructField(c[1], _affinity(c[2])) for c in columns])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(self.options["path"], self.options["table"], schema, int(self.options.get("partitions", "4")))


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _affinity(kind: str):
    kind = kind.upper()
    if "INT" in kind:
        return LongType()
    return DoubleType() if any(x in kind for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")) else StringType()


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, parts: int):
        self.path, self.table, self.schema, self.parts = path, table, schema, parts

    def partitions(self) -> Sequence[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return [_Range(0, -1)]
        step = -(-(high - low + 1) // self.parts)
        return [_Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        names = ", ".join(_quoted(f.name) for f in self.schema)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            for row in db.execute(f"SELECT {names} FROM {_quoted(self.table)} WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high)):
                yield tuple(_as(v, f.dataType) for v, f in zip(row, self.schema, strict=True))


def _as(value, kind):
    if value is None:
        return None
    try:
        return int(value) if isinstance(kind, LongType) else float(value) if isinstance(kind, DoubleType) else str(value)
    except (TypeError, ValueError):
        return None


def register_sources(spark: SparkSession) -> None:
    for source in (ArffSource, SqliteSource):
        spark.dataSource.register(source)


def run_sql(spark: SparkSession, text: str, tables: dict[str, DataFrame], csv_path: str | None = None) -> DataFrame:
    """A SQL text over named tables; the result, written as CSV if a path is given."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    result = spark.sql(text)
    if csv_path:
        result.write.mode("overwrite").option("header", "true").csv(csv_path)
    return result


def append_new(df: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Append the rows whose keys are not yet there; running it again adds nothing. The number of rows added."""
    spark = df.sparkSession
    fresh = df.dropDuplicates(list(keys))
    if _exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(*keys), list(keys), "left_anti")
    before = spark.read.parquet(path).count() if _exists(spark, path) else 0
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def replace(df: DataFrame, path: str) -> None:
    """Write ``df`` to ``path`` even if it reads from there: into a new folder, which then takes the name."""
    spark = df.sparkSession
    fs, at = _file_system(spark, path)
    new, old = at.suffix(".new"), at.suffix(".old")
    for p in (new, old):
        fs.delete(p, True)
    df.write.parquet(str(new.toString()))
    if fs.exists(at):
        fs.rename(at, old)
    fs.rename(new, at)
    fs.delete(old, True)


def write_by_domain(df: DataFrame, path: str, domain: str = "domain") -> None:
    """JSON lines in one folder a domain, added to those there."""
    df.write.mode("append").partitionBy(domain).json(path)


def next_round(folder: str) -> str:
    """The first folder ``round<n>`` that is not there yet, made on a local file system."""
    taken = [int(n[5:]) for n in os.listdir(folder) if n.startswith("round") and n[5:].isdigit()] if os.path.isdir(folder) else []
    path = os.path.join(folder, f"round{max(taken, default=0) + 1}")
    os.makedirs(path)
    return path


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def head_lines(path: str, n: int) -> list[str]:
    with open(path, encoding="utf-8", errors="replace") as lines:
        return [x.rstrip("\n") for x in islice(lines, n)]


def file_listing(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, length, sha256)`` of the files of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
