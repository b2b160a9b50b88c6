"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from millrace.plans import registry

SF = os.environ.get("MILLRACE_TEST_SF", "/root/testdata/sf0.001")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    result = duck.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, got) == rows(columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(df.collect()) > 0 and len(set(df.columns)) == len(df.columns)


def test_registry_needs_no_session():
    assert len(QUERIES) == len(set(QUERIES)) > 100
    assert set(SQL) <= set(QUERIES)


def test_edits_of_the_first_letters_count(spark, tmp_path):
    """Names of a key are compared wherever they differ."""
    for side, names in (("left", ["malulul port", "samiha", "same"]), ("right", ["amlulul port", "amiha", "same"])):
        spark.createDataFrame(list(enumerate(names)), "regionid long, regionname string").write.parquet(f"{tmp_path}/result_{side}.parquet")
    found = {r["regionid"]: r["edits"] for r in QUERIES["levenshtein_by_key"](spark, str(tmp_path)).collect()}
    assert found == {0: 2, 1: 1}


def test_idf_of_rare_words(spark, tmp_path):
    spark.createDataFrame([(1, "common rare"), (2, "common")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["word"]: (r["df"], r["idf"]) for r in QUERIES["inverse_document_frequency_all"](spark, str(tmp_path)).collect()}
    assert found == {"common": (2, 0.0), "rare": (1, 0.693147)}
