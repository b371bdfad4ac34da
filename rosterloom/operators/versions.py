"""Row selection and numbering per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterloom.session import cut_lineage


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per key.

    The filter on row_number lets Spark place a WindowGroupLimit before the shuffle, so a
    hot key sends at most ``k`` rows per map task.  ``order`` must be a total order.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)


def latest_version(df: DataFrame, keys: Sequence[str], updated: str, tie: Sequence[str]) -> DataFrame:
    """Newest row per key, unknown timestamps oldest, ties to the greatest ``tie`` values."""
    order = [F.coalesce(F.col(updated).cast("bigint"), F.lit(-1)).desc(), *[F.col(t).desc_nulls_last() for t in tie]]
    return top_per_key(df, keys, order)


def best_version(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row with the greatest ``order`` tuple per key, as one map-side combinable aggregate."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*")


def first_wins(df: DataFrame, keys: Sequence[str], position: Sequence[Column]) -> DataFrame:
    """First row per key in input order, given as explicit position columns."""
    return top_per_key(df, keys, position)


def number_in_group(df: DataFrame, keys: Sequence[str], position: str, out: str, width: int = 65536) -> DataFrame:
    """1-based occurrence number per key by an integer position, without one task per key.

    Positions are cut into ranges; a range start is the running count of the earlier ranges,
    so a hot key is numbered range by range.
    """
    cut = df.withColumn("_cut", F.floor(F.col(position) / width))
    sizes = cut.groupBy(*keys, "_cut").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    here = F.row_number().over(Window.partitionBy(*keys, "_cut").orderBy(position))
    numbered = cut.withColumn("_here", here)
    # Null-safe on the keys: a NULL key is a group of its own.
    cond = F.lit(True)
    for key in [*keys, "_cut"]:
        cond = cond & numbered[key].eqNullSafe(starts[key])
    return numbered.join(starts, cond, "left").select(
        *[numbered[c] for c in df.columns], (F.col("_here") + F.col("_start")).alias(out)
    )


def dense_ids(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Dense global ids 1..n in the given order, by range partitions and their row counts."""
    # Materialised once: the range cut is sampled, so it must not be recomputed differently.
    parts = cut_lineage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    parts = parts.withColumn("_part", F.shiftright("_row", 33)).withColumn("_row", F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)))
    # One row per partition, so this side is bounded by the partition count.
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return parts.join(F.broadcast(starts), "_part").select(
        *df.columns, (F.col("_row") + F.col("_start") + 1).alias(out)
    )


def fill_group_value(
    df: DataFrame, identity: Sequence[str], member: Sequence[str], value: str
) -> DataFrame:
    """Give rows lacking ``value`` the one value their identity group agrees on.

    Applies when the group has exactly one distinct value, every ``member`` holds one row of
    the group, and the identity is complete.  Built from combinable aggregates: min = max says
    "one distinct value" without collecting the set.
    """
    per_member = df.groupBy(*identity, *member).agg(
        F.count("*").alias("_rows"), F.min(value).alias("_lo"), F.max(value).alias("_hi")
    )
    groups = (
        per_member.groupBy(*identity)
        .agg(F.max("_rows").alias("_most"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        .filter((F.col("_most") == 1) & (F.col("_lo") == F.col("_hi")))
        .select(*identity, F.col("_lo").alias("_agreed"))
    )
    return (
        df.join(groups, list(identity), "left")
        .withColumn(value, F.coalesce(F.col(value), F.col("_agreed")))
        .select(*df.columns)
    )


def synthetic_numbers(
    sections: DataFrame, package: str, position: str, seed: str, number: str, out: str
) -> DataFrame:
    """Stable negative numbers for rows lacking one.

    The seed gains an occurrence count, and the package id when the seed repeats inside it.
    """
    from rosterloom.functions.text import synthetic_id

    missing = sections.filter(F.col(number).isNull())
    numbered = number_in_group(missing, [package, seed], position, "_occ")
    repeats = missing.groupBy(package, seed).agg(F.count("*").alias("_times"))
    full_seed = F.when(
        F.col("_times") > 1,
        F.concat(F.col(seed), F.lit(":package:"), F.col(package).cast("string"), F.lit(":occurrence:"),
                 (F.col("_occ") - 1).cast("string")),
    ).otherwise(F.concat(F.col(seed), F.lit(":occurrence:"), (F.col("_occ") - 1).cast("string")))
    made = numbered.join(repeats, [package, seed]).withColumn(out, synthetic_id(full_seed))
    kept = sections.filter(F.col(number).isNotNull()).withColumn(out, F.col(number).cast("bigint"))
    return kept.unionByName(made.select(*sections.columns, out))
