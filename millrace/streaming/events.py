"""Operators on event streams; each works the same on a batch and on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def timed(events: DataFrame, at: str = "ts") -> DataFrame:
    """Events with a time stamp that windows accept; times without zone are UTC."""
    return events.withColumn(at, F.col(at).cast("timestamp"))


def _late(events: DataFrame, at: str, delay: str) -> DataFrame:
    return events.withWatermark(at, delay) if events.isStreaming else events


def tumbling(events: DataFrame, width: str, at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """``(start, event_type, n, total)`` in windows that follow each other; later events than the watermark are dropped."""
    return _windowed(events, F.window(at, width), at, delay)


def sliding(events: DataFrame, width: str, slide: str, at: str = "ts", delay: str = "1 hour") -> DataFrame:
    return _windowed(events, F.window(at, width, slide), at, delay)


def _windowed(events: DataFrame, window, at: str, delay: str) -> DataFrame:
    by = _late(events, at, delay).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, user: str = "user_id", at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """``(user, start, end, n)``: runs of a user's events with no longer pause than ``gap``."""
    by = _late(events, at, delay).groupBy(user, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return by.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str], at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each key once; a stream forgets keys older than the watermark."""
    return _late(events, at, delay).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def enriched(events: DataFrame, static: DataFrame, key: str, how: str = "left") -> DataFrame:
    """A stream with a table's columns."""
    return events.join(static, key, how)


def followed_by(first: DataFrame, second: DataFrame, user: str, within: str, delay: str = "1 hour") -> DataFrame:
    """``(user, first_id, second_id)``: events of the second stream within an interval after one of the first."""
    a = _late(first.select(F.col(user).alias("u1"), F.col("event_id").alias("first_id"), F.col("ts").alias("t1")), "t1", delay)
    b = _late(second.select(F.col(user).alias("u2"), F.col("event_id").alias("second_id"), F.col("ts").alias("t2")), "t2", delay)
    joined = a.join(b, F.expr(f"u1 = u2 AND t2 > t1 AND t2 <= t1 + INTERVAL {within}"))
    return joined.select(F.col("u1").alias(user), "first_id", "second_id")


def transitions(events: DataFrame, user: str = "user_id", at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """``(user, from_type, to_type)`` of consecutive events of a stream, by a state a user.

    The state is the user's last event. Events of one trigger are put in order
    of time; an event earlier than the state is late and is left out.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(batches)).sort_values([at, "event_id"])
        last_at, last_type = state.get if state.exists else (None, None)
        rows = []
        for t, kind in zip(frame[at], frame["event_type"], strict=True):
            micros = int(pd.Timestamp(t).value // 1000)
            if last_at is not None and micros < last_at:
                continue
            if last_type is not None:
                rows.append((key[0], last_type, kind))
            last_at, last_type = micros, kind
        state.update((last_at, last_type))
        yield pd.DataFrame(rows, columns=[user, "from_type", "to_type"])

    kind = events.schema[user].dataType.simpleString()
    grouped = events.withWatermark(at, delay).groupBy(user)
    return grouped.applyInPandasWithState(step, f"{user} {kind}, from_type string, to_type string", "at long, type string", "append", "NoTimeout")


def run_available(stream: DataFrame, checkpoint: str, path: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over what is there, into Parquet (append) or into a folder replaced at each trigger."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        return writer.format("parquet").option("path", path).start()
    return writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()


def upserted(stream: DataFrame, checkpoint: str, path: str, keys: list[str], order: str) -> StreamingQuery:
    """Keep the latest row of each key in a folder; replaying a batch changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            old = spark.read.parquet(f"{path}/v{number - 1}") if number else None
        except Exception:  # the folder of the batch before is missing: nothing was kept yet
            old = None
        both = batch if old is None else old.unionByName(batch)
        rest = [c for c in batch.columns if c not in keys]
        latest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*").select(*batch.columns)
        latest.write.mode("overwrite").parquet(f"{path}/v{number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()
