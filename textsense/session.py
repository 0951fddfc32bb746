"""Session construction and small helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Rows of a table that we embed in a plan (a broadcast by hand). Operators that embed one
# check it against this bound and join beyond it; the answer is the same.
MAX_LITERAL_ROWS = 200_000
# A caller's setting: into how many partitions the registered queries deal a scan (round
# robin). Unset, as on a cluster, scans keep their splits; local runs over files of a single
# row group set it.
SCAN_PARTITIONS = "spark.textsense.scanPartitions"


def get_spark(master: str | None = None, app: str = "textsense", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every job here assumes.

    On a cluster the caller's own session is used as is; this is for local runs and tests.
    """
    master = master or os.environ.get("TEXTSENSE_MASTER", "local[*]")
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.driver.memory", os.environ.get("TEXTSENSE_DRIVER_MEMORY", "8g")))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    A cluster names it in ``spark.checkpoint.dir``; only when it is unset in a local session
    (tests) do we create one of our own.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="textsense-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the shared checkpoint folder (for stream checkpoints,
    materialised tables and the like)."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/textsense/{name}-{uuid.uuid4().hex[:12]}"


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect ``df`` only after proving it has at most ``limit`` rows.

    Used for small dimension tables (lexicons, capped vocabularies, k pad ids) that we
    embed in expressions instead of shuffling the large side.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows")
    return rows


def few_rows(df: DataFrame, limit: int = MAX_LITERAL_ROWS) -> list | None:
    """The rows of ``df`` if there are at most ``limit``, else None."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt round robin over as many partitions as the session's setting asks for, or
    as it is if there is none."""
    n = df.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(n)) if n else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and continue from there."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there (lineage cut,
    survives executor loss). It is held in memory only while being written, so it is
    computed once rather than once to count and again to write."""
    from pyspark import StorageLevel
    ensure_checkpoint_dir(df.sparkSession)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = held.checkpoint(eager=True)
    held.unpersist()
    return out
