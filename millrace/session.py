"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that hold at every size; sizes of partitions are left to AQE.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


#: Tables written by each application, for ``clear_materialised``.
_written: dict[str, list[str]] = {}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("millrace")
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local session may run without that setting; it then gets a
    temporary folder. On a cluster a missing setting is an error, because a
    machine-local folder could not be read by the other executors.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; ``clear_materialised`` deletes it."""
    path = f"{shared_dir(spark).rstrip('/')}/millrace/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder, and read again.

    Unlike a checkpoint the table is compressed and columnar, so that later
    reads take only the columns they need.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialised_if_costly(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once if it shuffles: for several passes over the same rows. Plain scans are read again."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return materialised(df, name) if any(x in plan for x in ("Join", "Aggregate", "Window", "Repartition", "InPandas", "InArrow")) else df


def clear_materialised(spark: SparkSession) -> int:
    """Delete the tables that this application wrote; results that still read them must be done. Their number."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


#: Bytes up to which a table is sent to all executors, and what a row of a few fields takes at most.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 160


def broadcast_if_small(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and marked for broadcast if its counted rows are few; else for a shuffled join.

    For narrow tables of numbers and short names.
    """
    kept = materialised(df, name)
    return F.broadcast(kept) if kept.count() * ROW_BYTES <= BROADCAST_BYTES else kept


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its scan has too few parts for them (a single small file, say).

    Tables of many files or of a large one are left as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if 0 < parts < cores // 2 else df
