"""Session helpers: a local session for tests and the bench, and the shared
checkpoint folder every lineage cut and every intermediate table goes to.

On a cluster the folder is whatever ``spark.checkpoint.dir`` names (a shared
file system). Only a local-mode session without that setting (tests, the
bench, the driver's checks) gets a fresh folder of its own under /tmp.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "rollcall") -> SparkSession:
    """A local[N] session with AQE on and the UI off (tests, bench)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of this session.

    Reads ``spark.checkpoint.dir`` (or the context's checkpoint dir). When
    neither is set, a local-mode session gets a new folder under /tmp; a
    cluster session raises, because a machine-local folder would not survive
    the loss of an executor.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no context; the server reads the setting
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder") from None
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "set spark.checkpoint.dir to a shared folder (HDFS, S3, ...) "
            "before running rollcall jobs on a cluster")
    folder = tempfile.mkdtemp(prefix="rollcall-ckpt-", dir="/tmp")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir() or folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the checkpoint folder for a written table.
    It stays until ``drop_scratch``, since lazy results may still read it."""
    return os.path.join(_scratch(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def _scratch(spark: SparkSession) -> str:
    return os.path.join(checkpoint_dir(spark), "tables")


def drop_scratch(spark: SparkSession) -> None:
    """Delete the tables this session's jobs wrote on the way (exports, stream
    states, intermediate tables), once their results have been consumed. The
    folder belongs to one Spark application: ``checkpoint_dir`` names a new one
    for each."""
    drop_path(spark, _scratch(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable, eager checkpoint into the shared folder.

    Used where a result is read by more than one branch and must be the same
    in all of them (chunk ids from a range shuffle), and to bound the lineage
    of iterative jobs. Never a local checkpoint: a lost executor would take
    the only copy with it.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: computed once, and
    a reader takes only the columns it needs."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_side(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, to be joined with a table that has
    hot keys. Over an aggregate the join would reuse the aggregate's
    partitioning, and AQE would not split a hot key; over a written table both
    sides are plain shuffles, which it does split (or it broadcasts this side
    at its measured size)."""
    return cut_lineage(df)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours on whatever file system it lies (no error when
    it is not there)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a folder; empty when it is not there."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        return []
    return [s.getPath().getName() for s in fs.listStatus(hpath)]


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files under a folder."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(hpath).getLength())
