"""Publishing a table set: stage, compare counts, then swap."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rosterloom.operators.quality import QualityError
from rosterloom.sources.snapshots import _hadoop

# What each published table refers to; the order of publishing follows from it.
REFERENCES = {
    "refresh_runs": [],
    "buildings": [],
    "instructors": [],
    "courses": [],
    "course_cross_listings": ["courses"],
    "packages": ["courses"],
    "sections": ["packages"],
    "section_instructors": ["sections", "instructors"],
    "meetings": ["sections", "buildings"],
    "prerequisite_rules": ["courses"],
    "prerequisite_nodes": ["prerequisite_rules"],
    "prerequisite_edges": ["prerequisite_nodes"],
    "prerequisite_course_summaries": ["prerequisite_rules"],
    "canonical_sections": ["sections"],
    "canonical_meetings": ["canonical_sections", "meetings"],
    "schedulable_packages": ["packages"],
    "course_search": ["courses"],
}


def publish_order(references: Mapping[str, Sequence[str]] = REFERENCES) -> list[str]:
    """Tables so that references point backwards, those that could go next by name."""
    order: list[str] = []
    while len(order) < len(references):
        ready = sorted(n for n, needed in references.items() if n not in order and set(needed) <= set(order))
        if not ready:
            raise ValueError(f"tables refer to each other in a circle or to none known: {sorted(set(references) - set(order))}")
        order += ready
    return order


def replace_tables(root: str, tables: Mapping[str, DataFrame]) -> dict[str, int]:
    """Overwrite every table and return row counts, counted while writing."""
    counts = {}
    for name, df in tables.items():
        seen = Observation(f"rows_{name}")
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{root}/{name}")
        counts[name] = int(seen.get["n"])
    return counts


def count_comparison(source: Mapping[str, DataFrame], staged: Mapping[str, DataFrame]) -> DataFrame:
    """(table, source_rows, staged_rows, equal) as one job."""

    def counts(tables: Mapping[str, DataFrame], column: str) -> DataFrame:
        rows = [df.agg(F.count("*").alias(column)).select(F.lit(n).alias("table"), column) for n, df in tables.items()]
        return reduce(DataFrame.unionByName, rows)

    both = counts(source, "source_rows").join(counts(staged, "staged_rows"), "table", "full")
    return both.withColumn("equal", F.col("source_rows").eqNullSafe(F.col("staged_rows")))


def publish(root: str, tables: Mapping[str, DataFrame], order: Sequence[str] | None = None) -> dict[str, int]:
    """Copy tables to staging in dependency order, verify counts, swap all of them in.

    A count mismatch leaves the published tables untouched and removes the staging copy.
    """
    spark = next(iter(tables.values())).sparkSession
    fs, path_of = _hadoop(spark, root)
    order = publish_order() if order is None else order
    names = [n for n in order if n in tables] + [n for n in tables if n not in order]
    staging, live, old = f"{root}/_staging", f"{root}/live", f"{root}/_old"
    written = replace_tables(staging, {n: tables[n] for n in names})
    staged = {n: spark.read.parquet(f"{staging}/{n}") for n in names}
    # Rows were counted as they were written, so no source is read a second time.
    found = {n: df.count() for n, df in staged.items()}
    bad = [n for n in names if found[n] != written[n]]
    if bad:
        fs.delete(path_of(staging), True)
        raise QualityError(f"row counts differ: {', '.join(sorted(bad))}")
    had_live = fs.exists(path_of(live))
    if had_live and not fs.rename(path_of(live), path_of(old)):
        raise OSError(f"cannot set aside {live}")
    if not fs.rename(path_of(staging), path_of(live)):
        if had_live:
            fs.rename(path_of(old), path_of(live))
        raise OSError(f"cannot move {staging} into place")
    if had_live:
        fs.delete(path_of(old), True)
    return written


def publish_jdbc(tables: Mapping[str, DataFrame], url: str, properties: Mapping[str, str], batch: int = 1000) -> None:
    """Write tables to a served database over JDBC, in batches and in dependency order."""
    for name in [n for n in publish_order() if n in tables]:
        writer = tables[name].write.mode("overwrite").option("truncate", "true").option("batchsize", batch)
        writer.jdbc(url, name, properties=dict(properties))


def target_state(spark: SparkSession, required: Sequence[str], database: str | None = None) -> str:
    """``missing``, ``partial`` or ``present``; callers refuse a partial target."""
    prefix = f"{database}." if database else ""
    there = sum(spark.catalog.tableExists(prefix + name) for name in required)
    return "missing" if there == 0 else "present" if there == len(required) else "partial"


def require_whole_target(spark: SparkSession, required: Sequence[str], database: str | None = None) -> str:
    state = target_state(spark, required, database)
    if state == "partial":
        raise QualityError("target holds only part of the schema")
    return state
