import pytest

from millrace.streaming import events as E

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def batch(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "in")
    E.timed(spark.read.parquet(f"{SF}/events.parquet")).orderBy("ts").coalesce(1).write.parquet(path)
    return spark.read.parquet(path), path


def run(spark, query, path):
    query.awaitTermination()
    return {tuple(r) for r in spark.read.parquet(path).collect()}


@pytest.mark.parametrize("name", ["tumbling", "sliding", "sessions"])
def test_stream_of_closed_windows_is_part_of_the_batch(spark, batch, tmp_path, name):
    df, path = batch
    make = {"tumbling": lambda e: E.tumbling(e, "6 hours"), "sliding": lambda e: E.sliding(e, "12 hours", "6 hours"), "sessions": lambda e: E.sessions(e, "12 hours")}[name]
    out = str(tmp_path / "out")
    got = run(spark, E.run_available(make(E.read_stream(spark, path, df.schema)), str(tmp_path / "c"), out), out)
    want = {tuple(r) for r in make(df).collect()}
    assert got and got <= want


def test_deduplication_and_join(spark, batch, tmp_path):
    df, path = batch
    stages = spark.createDataFrame([("view", "look")], "event_type string, stage string")
    stream = E.enriched(E.deduplicated(E.read_stream(spark, path, df.schema), ["event_id"]), stages, "event_type")
    out = str(tmp_path / "out")
    assert len(run(spark, E.run_available(stream, str(tmp_path / "c"), out), out)) == df.count()


def test_complete_mode(spark, batch, tmp_path):
    df, path = batch
    out = str(tmp_path / "out")
    counts = E.read_stream(spark, path, df.schema).groupBy("event_type").count()
    got = run(spark, E.run_available(counts, str(tmp_path / "c"), out, "complete"), out)
    assert got == {tuple(r) for r in df.groupBy("event_type").count().collect()}


def test_transitions_follow_the_state(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 7, "view"), (2, "2024-01-01 00:01:00", 7, "click"), (3, "2024-01-01 00:00:30", 8, "view"), (4, "2024-01-01 00:02:00", 7, "purchase")]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").selectExpr("event_id", "to_timestamp(ts) AS ts", "user_id", "event_type")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = E.transitions(E.read_stream(spark, str(tmp_path / "in"), df.schema))
    out = str(tmp_path / "out")
    assert run(spark, E.run_available(stream, str(tmp_path / "c"), out), out) == {(7, "view", "click"), (7, "click", "purchase")}


def test_upsert_keeps_the_latest(spark, batch, tmp_path):
    df, path = batch
    E.upserted(E.read_stream(spark, path, df.schema), str(tmp_path / "c"), str(tmp_path / "out"), ["user_id"], "ts").awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "v0"))
    assert got.count() == df.select("user_id").distinct().count()
