import gzip
import io
import json
import sqlite3
import struct
import zipfile

import numpy as np
import pandas as pd
import pytest

from millrace.sources import files, readers

ARFF = "@relation r\n% note\n@attribute a numeric\n@attribute 'b c' {x,'y z'}\n@attribute d string\n@data\n1,x,'q, r'\n?,'y z'\n3,x,s,extra\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "x.csv").write_text("a,b\n1,2\n")
    (tmp_path / "t.csv").write_text("﻿id;name\n1;a\n2;\n", encoding="utf-8")
    (tmp_path / "latin.csv").write_bytes("id,n\n1,é\n".encode("latin-1"))
    (tmp_path / "sub" / "l.json").write_text('{"a": 1, "b": [1]}\n{"a": 2}\n')
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "a.arff").write_text(ARFF)
    (tmp_path / "p.html").write_text("<h1>T</h1><table><tr><td>1</td></tr><tr></tr></table>")
    (tmp_path / "m.md").write_text("# A\n\n- x\n- y\n\n```\ncode\n```\n[l](u) ![i](u)\n")
    (tmp_path / "x.log").write_text("2024-01-01 10:00:00 INFO a\n2024-01-01 10:00:01 WARNING b\n")
    (tmp_path / "x.unknown").write_text("?")
    (tmp_path / "s.xlsx").write_bytes(b"PK")
    np.save(tmp_path / "n.npy", np.array([[1.0, np.nan], [3.0, 5.0]]))
    with gzip.open(tmp_path / "z.csv.gz", "wt") as f:
        f.write("a|b\n1|2\n")
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("../up.csv", "a,b\n1,2\n")
        z.writestr("in.json", "[]")
    db = sqlite3.connect(tmp_path / "d.sqlite")
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT NOT NULL, v REAL)")
    db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(k, f"n{k}", k / 2) for k in range(10)])
    db.commit()
    db.close()
    return tmp_path


def test_profile_directory(spark, folder):
    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.profile_directory(spark, str(folder)).collect()}
    s = {k: json.loads(r["structure"]) if r["structure"] else None for k, r in rows.items()}
    assert "x.unknown" not in rows and "x.csv" not in rows
    assert s["t.csv"]["columns"] == ["id", "name"] and s["t.csv"]["missing_values"] == {"id": 0, "name": 1}
    assert json.loads(rows["latin.csv"]["read_params"])["encoding"] == "latin-1"
    assert rows["l.json"]["row_count"] == 2 and s["l.json"]["common_keys"] == ["a"]
    assert rows["bad.json"]["error"] and rows["s.xlsx"]["error"]
    assert s["a.arff"]["missing_values"] == {"a": 1, "b c": 0, "d": 1}
    assert s["p.html"]["headings"] == ["T"] and s["p.html"]["table_rows"] == [2]
    assert s["m.md"] == {"headings": ["A"], "code_blocks": 1, "table_rows": 0, "list_items": 2, "links": 1, "images": 1}
    assert s["x.log"] == {"timestamp": "iso8601", "levels": {"INFO": 1, "WARN": 1}}
    assert s["n.npy"]["mean"] == 3.0
    assert json.loads(rows["z.csv.gz"]["read_params"])["delimiter"] == "|"
    assert [f["type"] for f in s["two.zip"]["files"]] == ["csv", "json"]
    assert s["d.sqlite"]["tables"]["t"]["rows"] == 10


def test_dbf_and_shape_index():
    head = struct.pack("<BBBBIHH", 3, 24, 1, 1, 7, 32 + 32 + 1, 11) + b"\0" * 20
    field = b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([10, 0]) + b"\0" * 14
    assert files.profile_bytes("a.dbf", head + field + b"\x0d")["structure"]["fields"] == [{"name": "NAME", "type": "string", "length": 10, "decimals": 0}]
    assert files.profile_bytes("a.shx", b"\0" * 24 + struct.pack(">I", 62) + b"\0" * 72)["row_count"] == 3


def test_parquet_profile():
    out = io.BytesIO()
    pd.DataFrame({"a": [1, None], "b": ["x", "y"]}).to_parquet(out)
    assert files.profile_bytes("x.parquet", out.getvalue())["structure"]["missing_values"] == {"a": 1, "b": 0}


def test_readers(spark, folder):
    readers.register_sources(spark)
    arff = spark.read.format("arff").option("path", str(folder / "a.arff")).load()
    assert [tuple(r) for r in arff.collect()] == [(1.0, "x", "q, r"), (None, "y z", None), (3.0, "x", "s")]
    t = spark.read.format("sqlite_table").option("path", str(folder / "d.sqlite")).option("table", "t").option("partitions", "3").load()
    assert t.count() == 10 and t.agg({"v": "sum"}).first()[0] == 22.5
    assert readers.read_delimited(spark, str(folder / "t.csv")).columns == ["id", "name"]
    assert readers.read_json_any(spark, str(folder / "sub" / "l.json")).count() == 2


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert readers.append_new(df, path, ["k"]) == 2
    assert readers.append_new(df.union(spark.createDataFrame([(3, "c")], df.schema)), path, ["k"]) == 1
    readers.replace(spark.read.parquet(path).where("k > 1"), path)
    assert spark.read.parquet(path).count() == 2
    assert readers.next_round(str(tmp_path)).endswith("round1") and readers.next_round(str(tmp_path)).endswith("round2")
    readers.write_by_domain(df.withColumnRenamed("v", "domain"), str(tmp_path / "d"))
    assert (tmp_path / "d" / "domain=a").is_dir()
    assert readers.run_sql(spark, "SELECT sum(k) AS s FROM t", {"t": df}, str(tmp_path / "csv")).first()["s"] == 3


def test_every_member_of_an_archive_has_a_row(monkeypatch):
    import io

    from millrace.sources import files

    monkeypatch.setattr(files, "MAX_BYTES", 100)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k in range(25):
            z.writestr(f"m{k:02d}.csv", "a,b\n1,2\n")
        z.writestr("large.csv", "a,b\n" + "1,2\n" * 100)
    found = files._zip(out.getvalue())["structure"]["files"]
    assert len(found) == 26 and [f["path"] for f in found if f["error"]] == ["large.csv"]
