"""Profiles of heterogeneous files: one row a file, whatever its format; a broken file is a row with an error."""

from __future__ import annotations

import csv
import gzip
import io
import json
import os
import re
import sqlite3
import struct
import tarfile
import tempfile
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Larger files get an error row instead of being read into a task.
MAX_BYTES = 800 << 20
SAMPLE_ROWS = 3

# File endings and the types they stand for.
TYPES = {
    ".csv": "csv", ".tsv": "tsv", ".json": "json", ".geojson": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".arff": "arff", ".yaml": "yaml", ".yml": "yaml",
    ".html": "html", ".htm": "html", ".md": "markdown", ".markdown": "markdown", ".tex": "tex", ".latex": "tex", ".txt": "text", ".text": "text", ".log": "log", ".sqlite": "sqlite", ".sqlite3": "sqlite", ".db": "sqlite",
    ".npy": "npy", ".npz": "npz", ".parquet": "parquet", ".pq": "parquet", ".dbf": "dbf", ".gz": "gzip", ".zip": "zip", ".tar": "tar", ".tgz": "tar", ".prj": "projection", ".cpg": "codepage", ".shx": "shape_index",
    ".xlsx": "excel", ".xls": "excel", ".nc": "netcdf", ".nc4": "netcdf", ".cdf": "netcdf", ".gpkg": "sqlite", ".shp": "shapefile",
}
DELIMITERS = (",", "\t", "|", ";")


def file_type(path: str) -> str:
    low = path.lower()
    if low.endswith(".tar.gz"):
        return "tar"
    return TYPES.get(os.path.splitext(low)[1], "unknown")


def decode(data: bytes) -> tuple[str, str]:
    try:
        return data.decode("utf-8-sig"), "utf-8"
    except UnicodeDecodeError:
        return data.decode("latin-1"), "latin-1"


def looks_numeric(cell: str) -> bool:
    try:
        float(cell.strip().strip("\"'").replace(",", ""))
    except ValueError:
        return False
    return True


def sniff_delimiter(lines: list[str], default: str = ",") -> str:
    """The delimiter that most often stands equally often in the first lines."""
    best = default, 0
    for d in DELIMITERS:
        counts = [x.count(d) for x in lines[:21] if x.strip()]
        if counts and counts[0] and (score := counts.count(counts[0]) * counts[0]) > best[1]:
            best = d, score
    return best[0]


def _dtype(cells: list[str]) -> str:
    some = [c for c in cells if c not in ("", "NA", "NaN", "nan", "null", "NULL", "None", "?")]
    if not some:
        return "object"
    if all(re.fullmatch(r"[+-]?\d+", c) for c in some):
        return "int64" if len(some) == len(cells) else "float64"
    return "float64" if all(looks_numeric(c) for c in some) else "object"


def _delimited(data: bytes, default: str) -> dict:
    text, encoding = decode(data)
    lines = text.splitlines()
    delimiter = sniff_delimiter(lines, default)
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=delimiter) if r]
    if not rows:
        raise ValueError("no rows")
    header = rows[0]
    body = [r + [""] * (len(header) - len(r)) for r in rows[1:]]
    columns = {c: [r[k] for r in body] for k, c in enumerate(header)}
    missing = {c: sum(x in ("", "NA", "NaN", "nan", "null", "NULL", "None", "?") for x in v) for c, v in columns.items()}
    structure = {"columns": header, "dtypes": {c: _dtype(v) for c, v in columns.items()}, "num_rows": len(body), "num_columns": len(header), "missing_values": missing}
    return {"structure": structure, "read_params": {"delimiter": delimiter, "header": 0, "encoding": encoding}, "row_count": len(body), "sample": rows[1 : 1 + SAMPLE_ROWS]}


def _depth(value: object, limit: int = 10) -> int:
    if limit == 0 or not isinstance(value, (dict, list)):
        return 0
    inner = value.values() if isinstance(value, dict) else value[:5]
    return 1 + max((_depth(v, limit - 1) for v in inner), default=0)


def _records(value: object, lines: bool) -> dict:
    records = value if isinstance(value, list) else [value]
    keys = [set(r) for r in records if isinstance(r, dict)]
    every, common = (set().union(*keys), set.intersection(*keys)) if keys else (set(), set())
    top = "lines" if lines else "array" if isinstance(value, list) else "object" if isinstance(value, dict) else "scalar"
    structure = {"type": top, "all_keys": sorted(every), "common_keys": sorted(common), "schema_consistent": every == common, "depth": _depth(value)}
    return {"structure": structure, "read_params": {"lines": lines}, "row_count": len(records), "sample": records[:SAMPLE_ROWS]}


def _json(data: bytes) -> dict:
    """A document; a body of one document a line is read as lines."""
    text, _ = decode(data)
    try:
        return _records(json.loads(text), False)
    except ValueError:
        return _json_lines(data)


def _json_lines(data: bytes) -> dict:
    return _records([json.loads(x) for x in decode(data)[0].splitlines() if x.strip()], True)


def _yaml(data: bytes) -> dict:
    import yaml

    return _records(yaml.safe_load(decode(data)[0]), False)


ATTRIBUTE = re.compile(r"@attribute\s+('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|\S+)\s+(.*)", re.I)


def parse_arff(text: str) -> tuple[str, list[tuple[str, str]], list[list[str | None]]]:
    """Name, attributes and rows; short rows are padded, long ones cut, ``?`` and blanks are missing."""
    relation, attributes, rows, body = "", [], [], False
    for line in text.splitlines():
        bare = line.strip()
        if not bare or bare.startswith("%"):
            continue
        if body:
            cells = next(csv.reader([bare], quotechar="'" if "'" in bare else '"', skipinitialspace=True))
            cells = [None if c.strip() in ("", "?") else c.strip().strip("\"'") for c in cells]
            rows.append((cells + [None] * len(attributes))[: len(attributes)])
        elif bare.lower().startswith("@relation"):
            relation = bare.split(None, 1)[1].strip("\"'") if " " in bare else ""
        elif m := ATTRIBUTE.match(bare):
            kind = m.group(2).strip()
            attributes.append((m.group(1).strip("\"'"), "nominal" if kind.startswith("{") else kind.split()[0].lower()))
        elif bare.lower().startswith("@data"):
            body = True
    return relation, attributes, rows


def _arff(data: bytes) -> dict:
    relation, attributes, rows = parse_arff(decode(data)[0])
    missing = {a: sum(r[k] is None for r in rows) for k, (a, _) in enumerate(attributes)}
    structure = {"relation": relation, "columns": [a for a, _ in attributes], "dtypes": dict(attributes), "num_rows": len(rows), "missing_values": missing}
    return {"structure": structure, "row_count": len(rows), "sample": rows[:SAMPLE_ROWS]}


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.elements: Counter[str] = Counter()
        self.headings: list[str] = []
        self.rows: list[int] = []
        self._open = ""

    def handle_starttag(self, tag, attrs) -> None:
        self.elements[tag] += 1
        self._open = tag
        if tag == "table":
            self.rows.append(0)
        if tag == "tr" and self.rows:
            self.rows[-1] += 1

    def handle_endtag(self, tag) -> None:
        self._open = ""

    def handle_data(self, data) -> None:
        if re.fullmatch(r"h[1-6]", self._open) and data.strip() and len(self.headings) < 20:
            self.headings.append(data.strip()[:100])


def _html(data: bytes) -> dict:
    page = _Page()
    page.feed(decode(data)[0])
    return {"structure": {"headings": page.headings, "elements": dict(page.elements), "table_rows": page.rows}, "row_count": sum(page.rows[:1])}


def _markdown(data: bytes) -> dict:
    text, _ = decode(data)
    count = lambda p: len(re.findall(p, text, re.M))
    structure = {
        "headings": re.findall(r"^#{1,6} +(.+)$", text, re.M), "code_blocks": count(r"^```") // 2, "table_rows": count(r"^\|.*\|$"), "list_items": count(r"^ *(?:[-*+]|\d+\.) "),
        "links": count(r"(?<!!)\[[^\]]*\]\([^)]*\)"), "images": count(r"!\[[^\]]*\]\([^)]*\)"),
    }
    return {"structure": structure, "row_count": text.count("\n") + 1}


def _tex(data: bytes) -> dict:
    text, _ = decode(data)
    sections = re.findall(r"\\(?:part|chapter|section|subsection|subsubsection)\*?\{([^}]*)\}", text)
    return {"structure": {"sections": sections, "environments": dict(Counter(re.findall(r"\\begin\{([^}]*)\}", text)))}, "row_count": text.count("\n") + 1}


def _text(data: bytes) -> dict:
    text, encoding = decode(data)
    lines = text.splitlines()
    head = [x for x in lines[:20] if x.strip()]
    pairs = sum(bool(re.match(r"^[^:=]{1,40}[:=]\s*\S", x)) for x in head)
    widths = [len(x) for x in lines if x.strip()]
    kind = "key_value" if head and pairs * 2 > len(head) else "fixed_width" if len(widths) > 4 and max(widths) - min(widths) < 3 else "free"
    return {"structure": {"kind": kind, "lines": len(lines), "characters": len(text)}, "read_params": {"encoding": encoding}, "row_count": len(lines)}


def _log(data: bytes) -> dict:
    from millrace.operators.text import STAMPS

    lines = [x for x in decode(data)[0].splitlines() if x.strip()]
    head = lines[:100]
    family = next((k for k, p in STAMPS.items() if sum(bool(re.search(p, x)) for x in head) * 2 > len(head)), None)
    found = (re.search(r"\b(DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL|TRACE)\b", x) for x in lines)
    return {"structure": {"timestamp": family, "levels": dict(Counter("WARN" if m.group() == "WARNING" else m.group() for m in found if m))}, "row_count": len(lines)}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _sqlite(data: bytes) -> dict:
    with tempfile.NamedTemporaryFile(suffix=".sqlite") as file:  # only this task reads it
        file.write(data)
        file.flush()
        db = sqlite3.connect(f"file:{file.name}?mode=ro", uri=True)
        tables = {}
        for (name,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name"):
            columns = [{"name": c[1], "type": c[2], "notnull": bool(c[3]), "default": c[4], "pk": bool(c[5])} for c in db.execute(f"PRAGMA table_info({_quoted(name)})")]
            links = [{"column": f[3], "table": f[2], "to": f[4]} for f in db.execute(f"PRAGMA foreign_key_list({_quoted(name)})")]
            rows = db.execute(f"SELECT count(*) FROM {_quoted(name)}").fetchone()[0]
            tables[name] = {"columns": columns, "foreign_keys": links, "rows": rows}
        db.close()
    return {"structure": {"tables": tables}, "row_count": sum(t["rows"] for t in tables.values())}


def _array(a) -> dict:
    out = {"shape": list(a.shape), "dtype": str(a.dtype)}
    if a.dtype.kind in "iuf" and a.size:
        b = a[~pd.isna(a)]
        if b.size:
            out |= {"min": float(b.min()), "max": float(b.max()), "mean": float(b.mean()), "std": float(b.std())}
    return out


def _npy(data: bytes) -> dict:
    import numpy as np

    a = np.load(io.BytesIO(data), allow_pickle=False)
    return {"structure": _array(a), "row_count": int(a.shape[0]) if a.ndim else 1}


def _npz(data: bytes) -> dict:
    import numpy as np

    with np.load(io.BytesIO(data), allow_pickle=False) as arrays:
        found = {k: _array(arrays[k]) for k in arrays.files}
    return {"structure": {"arrays": found}, "row_count": max((a["shape"][0] for a in found.values() if a["shape"]), default=0)}


def _parquet(data: bytes) -> dict:
    import pyarrow.parquet as pq

    file = pq.ParquetFile(io.BytesIO(data))
    groups = [{"rows": file.metadata.row_group(k).num_rows, "bytes": file.metadata.row_group(k).total_byte_size} for k in range(file.num_row_groups)]
    table = file.read()
    missing = {c: table.column(c).null_count for c in table.column_names}
    structure = {"columns": table.column_names, "dtypes": {f.name: str(f.type) for f in table.schema}, "row_groups": groups, "missing_values": missing, "num_rows": file.metadata.num_rows}
    return {"structure": structure, "row_count": file.metadata.num_rows, "sample": table.slice(0, SAMPLE_ROWS).to_pylist()}


# Field types of a DBF header.
DBF_TYPES = {"C": "string", "N": "decimal", "F": "double", "D": "date", "L": "boolean", "M": "memo"}


def _dbf(data: bytes) -> dict:
    rows, header, width = struct.unpack("<IHH", data[4:12])
    fields = []
    for at in range(32, header - 1, 32):
        if data[at] == 0x0D:
            break
        name, kind, length, decimals = data[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(data[at + 11]), data[at + 16], data[at + 17]
        fields.append({"name": name, "type": DBF_TYPES.get(kind, kind), "length": length, "decimals": decimals})
    return {"structure": {"fields": fields, "record_bytes": width}, "row_count": rows}


def _projection(data: bytes) -> dict:
    m = re.match(r'\s*(?:PROJCS|GEOGCS|PROJCRS|GEOGCRS)\["([^"]*)"', decode(data)[0])
    return {"structure": {"crs": m.group(1) if m else None}}


def _codepage(data: bytes) -> dict:
    return {"structure": {"encoding": decode(data)[0].strip()}}


def _shape_index(data: bytes) -> dict:
    words = struct.unpack(">I", data[24:28])[0]
    return {"structure": {"records": (words - 50) // 4}, "row_count": (words - 50) // 4}


def _inner(files: Iterator[tuple[str, int, Callable[[], bytes]]]) -> dict:
    """Profiles of the members of an archive, one at a time in memory: nothing is unpacked to a path.

    A member too large for memory has a row with an error, as a file of that size.
    """
    large = {"file_type": "unknown", "row_count": None, "structure": None, "read_params": None, "sample": None, "error": f"above {MAX_BYTES} bytes"}
    found = [(profile_bytes(name, read()) if size <= MAX_BYTES else large) | {"path": name} for name, size, read in files]
    if len(found) == 1 and not found[0]["error"]:
        return {k: found[0][k] for k in ("structure", "read_params", "row_count", "sample")} | {"inner": found[0]["file_type"]}
    return {"structure": {"files": [{"path": f["path"], "type": f["file_type"], "rows": f["row_count"], "error": f["error"]} for f in found]}, "row_count": sum(f["row_count"] or 0 for f in found)}


def _zip(data: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        members = [i for i in archive.infolist() if not i.is_dir()]
        return _inner((i.filename, i.file_size, lambda i=i: archive.read(i)) for i in members)


def _tar(data: bytes) -> dict:
    with tarfile.open(fileobj=io.BytesIO(data)) as archive:
        members = [m for m in archive.getmembers() if m.isfile()]
        return _inner((m.name, m.size, lambda m=m: archive.extractfile(m).read()) for m in members)


PARSERS: dict[str, Callable[[bytes], dict]] = {
    "csv": lambda d: _delimited(d, ","), "tsv": lambda d: _delimited(d, "\t"), "json": _json, "jsonl": _json_lines, "yaml": _yaml, "arff": _arff, "html": _html, "markdown": _markdown,
    "tex": _tex, "text": _text, "log": _log, "sqlite": _sqlite, "npy": _npy, "npz": _npz, "parquet": _parquet, "dbf": _dbf, "projection": _projection, "codepage": _codepage,
    "shape_index": _shape_index, "zip": _zip, "tar": _tar,
}


def profile_bytes(path: str, data: bytes) -> dict:
    """The profile of one file's bytes; an error is told, not raised."""
    kind = file_type(path)
    out = {"file_type": kind, "structure": None, "read_params": None, "row_count": None, "sample": None, "error": None}
    try:
        if kind == "gzip":
            with gzip.open(io.BytesIO(data)) as inner:
                plain = inner.read(MAX_BYTES + 1)
            if len(plain) > MAX_BYTES:
                raise ValueError("too large when unpacked")
            return profile_bytes(path[:-3], plain)
        parser = PARSERS.get(kind)
        if parser is None:
            raise ValueError(f"no reader for {kind} files is installed")
        out |= parser(data)
    except Exception as problem:  # any broken file is a row with an error
        out["error"] = f"{type(problem).__name__}: {problem}"[:200]
    return out


SCHEMA = "path string, file_type string, structure string, read_params string, row_count bigint, sample string, error string"


def profile_directory(spark: SparkSession, folder: str) -> DataFrame:
    """One profile a file of a folder and its subfolders, in parallel; hidden files and folders are skipped.

    Files of unknown endings are left out; files above ``MAX_BYTES`` get an
    error and are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    small = _known(files).where(F.col("length") <= MAX_BYTES).select("path", "content")
    large = _known(files.select("path", "length")).where(F.col("length") > MAX_BYTES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                p = profile_bytes(path, content)
                text = lambda v: None if v is None else json.dumps(v, default=str, ensure_ascii=False)
                rows.append((path, p["file_type"], text(p["structure"]), text(p["read_params"]), p["row_count"], text(p["sample"]), p["error"]))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in SCHEMA.split(", ")]).astype({"row_count": "Int64"})

    profiled = small.mapInPandas(run, SCHEMA)
    none = F.lit(None).cast("string")
    too_large = large.select("path", none.alias("file_type"), none.alias("structure"), none.alias("read_params"), F.lit(None).cast("bigint").alias("row_count"), none.alias("sample"), F.lit("file too large").alias("error"))
    return profiled.unionByName(too_large)


def _known(files: DataFrame) -> DataFrame:
    low = F.lower("path")
    endings = "|".join(re.escape(e) for e in TYPES)
    hidden: Column = F.col("path").rlike(r"/\.[^/]")
    return files.where(~hidden & low.rlike(rf"(?:{endings})$"))
