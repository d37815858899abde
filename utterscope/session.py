"""Session construction, checkpoint directory and size-checked broadcast."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Session defaults for every job: AQE re-plans joins/partition counts at run
# time, skew-join splits hot partitions, Arrow carries the few Python steps.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "utterscope", master: str | None = None,
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of this session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; it is used
    as is.  Only a local-mode session without one (tests) gets a private temp
    folder — a machine-local folder is never chosen on a cluster.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="utterscope-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable (shared-folder) checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_table_path(spark: SparkSession, name: str) -> str:
    """A path under the checkpoint folder for an intermediate table; every
    call gets its own, so a live result is never overwritten."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of this checkpoint folder; for the end
    of a job, when no result that reads them is left."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark).rstrip('/')}/tables")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written_table(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a Parquet table in the shared checkpoint folder."""
    path = scratch_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what is computed already: its
    cleaner does so once the driver's garbage collector met their plans, which
    the listeners of a job that just ended may still hold."""
    gc.collect()
    for wait in (0.5, 0.3):
        time.sleep(wait)
        spark.sparkContext._jvm.System.gc()


BROADCAST_BYTES = 64 << 20


def sized_broadcast(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only when it provably holds at most ``max_rows`` rows
    and ``max_bytes`` bytes (of its JSON text, which is no smaller than the
    values); beyond either bound the frame is returned unhinted and Spark
    plans a shuffle join instead.  ``df`` is computed once: the check and the
    join read a checkpoint of it.
    """
    kept = reliable_checkpoint(df)
    rows, size = kept.limit(max_rows + 1).agg(
        F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long"))).first()
    return F.broadcast(kept) if rows <= max_rows and (size or 0) <= max_bytes else kept
