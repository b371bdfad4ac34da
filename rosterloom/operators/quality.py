"""Database constraints as jobs: each check yields violations, a report counts them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class QualityError(ValueError):
    """A load that must be rejected."""


def rule_violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, violations) for row rules that must hold; one pass over the data."""
    broken = df.agg(*[F.count(F.when(~F.coalesce(ok, F.lit(True)), 1)).alias(name) for name, ok in rules.items()])
    pairs = F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in rules]), F.array(*[F.col(n) for n in rules])))
    return broken.select(pairs.alias("rule", "violations"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def surplus_primaries(df: DataFrame, keys: Sequence[str], is_primary: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(is_primary).alias("primaries")).filter("primaries > 1")


def orphans(child: DataFrame, parent: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Child rows whose reference is set but unknown."""
    keys = parent.select(*[F.col(p).alias(c) for c, p in on.items()])
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    return child.filter(known).join(keys, list(on), "left_anti")


def drop_orphans(child: DataFrame, parent: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Child rows with a known reference, plus those whose reference is not set."""
    keys = parent.select(*[F.col(p).alias(c) for c, p in on.items()])
    unset = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    return child.filter(~unset).join(keys, list(on), "left_semi").unionByName(child.filter(unset))


def report(checks: Mapping[str, DataFrame]) -> DataFrame:
    """One row per named check with the number of violating rows."""
    rows = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations") for name, df in checks.items()]
    return reduce(DataFrame.unionByName, rows)


def require_clean(checks: Mapping[str, DataFrame]) -> None:
    """Reject the load when any check has violations; only the broken check names reach the driver."""
    broken = report(checks).filter("violations > 0").collect()
    if broken:
        raise QualityError(", ".join(f"{r['check']}: {r['violations']}" for r in broken))


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise QualityError(f"missing required columns: {', '.join(missing)}")


def completeness(items: DataFrame, reported: DataFrame, keys: Sequence[str], expected: str) -> DataFrame:
    """Collected against reported counts per key."""
    got = items.groupBy(*keys).agg(F.count("*").alias("collected"))
    return reported.join(got, list(keys), "left").select(
        *keys,
        F.coalesce("collected", F.lit(0)).alias("collected"),
        F.col(expected).alias("reported"),
        (F.coalesce("collected", F.lit(0)) == F.col(expected)).alias("complete"),
    )
