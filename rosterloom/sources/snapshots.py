"""Immutable snapshot folders and freshness metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.functions.availability import age_text
from rosterloom.operators.quality import QualityError
from rosterloom.sources.schemas import HISTORY_PARTS, HISTORY_SCHEMAS

SNAPSHOT_ID = r"\d{8}T\d{6}Z"


def _hadoop(spark: SparkSession, path: str):
    """Hadoop file system of a path, so snapshots work on any store Spark can read."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def complete_snapshots(files: DataFrame, parts: Sequence[str] = HISTORY_PARTS, path: str = "path") -> DataFrame:
    """Ids of snapshot folders holding every part, from a listing of file paths."""
    pattern = rf"/({SNAPSHOT_ID})/([^/]+?)(?:\.json|\.parquet)?(?:/.*)?$"
    named = files.select(
        F.regexp_extract(path, pattern, 1).alias("snapshot_id"), F.regexp_extract(path, pattern, 2).alias("part")
    ).filter(F.col("part").isin(*parts))
    return named.groupBy("snapshot_id").agg(F.count_distinct("part").alias("parts")).filter(F.col("parts") == len(parts)).select("snapshot_id")


def latest_snapshot(spark: SparkSession, root: str, parts: Sequence[str] = HISTORY_PARTS) -> str:
    """Newest complete snapshot under a root; the listing is distributed and reads no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    newest = complete_snapshots(files, parts).agg(F.max("snapshot_id").alias("id")).first()["id"]
    if newest is None:
        raise FileNotFoundError(f"no complete snapshot under {root}")
    return newest


def read_history_snapshot(spark: SparkSession, root: str, snapshot_id: str) -> dict[str, DataFrame]:
    """The parts of a snapshot, stored either as JSON files or as Parquet folders."""
    fs, path_of = _hadoop(spark, root)
    tables = {}
    for part in HISTORY_PARTS:
        base = f"{root}/{snapshot_id}/{part}"
        if fs.exists(path_of(f"{base}.json")):
            tables[part] = spark.read.schema(HISTORY_SCHEMAS[part]).json(f"{base}.json", multiLine=True)
        else:
            tables[part] = spark.read.schema(HISTORY_SCHEMAS[part]).parquet(f"{base}.parquet")
    return tables


def write_snapshot(root: str, snapshot_id: str, tables: Mapping[str, DataFrame], parts: Sequence[str] = HISTORY_PARTS) -> str:
    """Write every part to a staging folder, then rename it into place.

    A missing part is refused; an existing snapshot is put back when the rename fails.
    """
    missing = [p for p in parts if p not in tables]
    if missing:
        raise QualityError(f"snapshot parts missing: {', '.join(missing)}")
    spark = next(iter(tables.values())).sparkSession
    fs, path_of = _hadoop(spark, root)
    staging, target, aside = (f"{root}/_{kind}-{snapshot_id}" for kind in ("staging", "target", "previous"))
    target = f"{root}/{snapshot_id}"
    for part in parts:
        tables[part].write.mode("overwrite").parquet(f"{staging}/{part}.parquet")
    had_previous = fs.exists(path_of(target))
    if had_previous and not fs.rename(path_of(target), path_of(aside)):
        raise OSError(f"cannot set aside {target}")
    if not fs.rename(path_of(staging), path_of(target)):
        if had_previous:
            fs.rename(path_of(aside), path_of(target))
        raise OSError(f"cannot move {staging} into place")
    if had_previous:
        fs.delete(path_of(aside), True)
    return target


def iso_millis(epoch_ms: Column) -> Column:
    """Epoch milliseconds as ISO text in UTC."""
    utc = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(secs=(epoch_ms / 1000).cast("decimal(18,6)"))
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def run_metadata(updates: Sequence[DataFrame], terms: Sequence[DataFrame], fallback_iso: str) -> DataFrame:
    """One row: newest update over all sources as ISO text, and the first known term, else ``unknown``.

    ``updates`` are one-column frames of epoch milliseconds.  ``terms`` are frames (term, position)
    in order of preference; the known term of the smallest position counts.
    """
    stamps = updates[0].toDF("ms")
    for more in updates[1:]:
        stamps = stamps.unionByName(more.toDF("ms"))
    newest = stamps.agg(F.max("ms").alias("ms"))
    known = [t.toDF("term", "position").filter("term IS NOT NULL") for t in terms]
    picks = [t.agg(F.min_by("term", "position").alias("term")).scalar() for t in known]
    return newest.select(
        F.lit(1).alias("refresh_id"),
        F.coalesce(iso_millis(F.col("ms")), F.lit(fallback_iso)).alias("snapshot_run_at"),
        F.lit(fallback_iso).alias("last_refreshed_at"),
        F.coalesce(*picks, F.lit("unknown")).alias("source_term_code"),
    )


def freshness(runs: DataFrame, now: Column) -> DataFrame:
    """Last run and its age in words."""
    last = runs.orderBy(F.col("refresh_id").desc()).limit(1)
    age = F.unix_timestamp(now) - F.unix_timestamp(F.to_timestamp("last_refreshed_at"))
    return last.withColumn("age", age_text(age))
