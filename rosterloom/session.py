"""Session settings and lineage cutting."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings that matter at scale.  Nothing here fixes a partition count: AQE sizes
# the shuffles, and shuffle.partitions is left to the cluster.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even where that costs one more shuffle afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session made elsewhere."""
    for key, value in SCALE_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "rosterloom", cpus: str = "8", shuffle_partitions: str = "8") -> SparkSession:
    """A local session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in SCALE_CONF.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.autoBroadcastJoinThreshold", "10MB")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``; a scratch folder in local mode only."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if shared:
        return shared
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="rosterloom-ckpt-"))
    return sc.getCheckpointDir()


def release_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps now, not whenever the driver next collects its garbage.

    For steps that shuffle much after one another; what is still referred to stays.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut_lineage(df: DataFrame, rows_at_once: int | None = None) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back.

    Survives executor loss, keeps iterative plans short, and unlike an RDD checkpoint it is
    columnar: later steps read only their columns, and the file sizes tell Spark what it may
    broadcast.  ``rows_at_once`` is for rows of many megabytes: neither the writer nor a reader of the table then holds
    more of them, where the writer would else look at its memory after 100 rows first and the reader take 4,096 at a time.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    few = {} if rows_at_once is None else {"parquet.block.row.count.limit": str(rows_at_once), "parquet.page.size.row.check.min": "1"}
    df.write.options(**few).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slice_of(key: str, n: int) -> Column:
    """The slice of 0 to n - 1 that a whole number as key belongs to; NULL has one as well."""
    return F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(n)).cast("int")


def in_slices(spark: SparkSession, n: int, step: Callable[[int], DataFrame], parts: str | None = None) -> DataFrame:
    """The rows of ``step(0)`` to ``step(n - 1)``, worked out and written one after another.

    For jobs that fall apart by a key.  The shuffle files of a slice are let go before the next begins, so scratch space is
    that of one slice, whatever the size of the input, beside the table that is written.  That table may be told apart by a column
    ``parts``, of which later steps read one value.
    """
    path = f"{checkpoint_folder(spark).rstrip('/')}/slices-{uuid.uuid4().hex}"
    schema = None
    for i in range(n):
        rows = step(i)
        schema = rows.schema
        writer = rows.write.mode("append").option("compression", "zstd")
        (writer.partitionBy(parts) if parts else writer).parquet(path)
        del rows
        release_shuffles(spark)
    return spark.read.schema(schema).parquet(path)
