"""Identity collapse: records sharing a net id or e-mail are one person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.functions.text import key_part
from rosterloom.session import cut_lineage


def identity_tokens(netid: Column, email: Column, first: Column, last: Column) -> tuple[Column, Column, Column]:
    """The netid, e-mail and name tokens of a record, NULL where the part is missing."""
    first, last = key_part(first), key_part(last)
    named = first.isNotNull() | last.isNotNull()
    name = F.concat_ws(":", F.lit("name"), F.coalesce(first, F.lit("")), F.coalesce(last, F.lit("")))
    return (
        F.concat(F.lit("netid:"), key_part(netid)),
        F.concat(F.lit("email:"), key_part(email)),
        F.when(named, name),
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    siblings = down.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return siblings.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for an undirected edge list (u, v); the component is its smallest node.

    Alternating star contraction: every step is a combinable minimum and one join, so a node
    with a huge neighbourhood is never gathered, and the number of rounds grows with the
    logarithm of the graph, not with its diameter.
    """
    current = cut_lineage(edges.filter("u <> v").select("u", "v").distinct())
    seen = None
    while True:
        current = cut_lineage(_small_star(_large_star(current)))
        # Order-free fingerprint of the edge set: one row to the driver per round.
        mark = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen:
            break
        seen = mark
    return (
        current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")))
        .distinct()
    )


def collapse_identities(
    records: DataFrame,
    order: str,
    netid: str = "netid",
    email: str = "email",
    first: str = "first_name",
    last: str = "last_name",
) -> tuple[DataFrame, DataFrame]:
    """(record -> canonical key, one merged person per key).

    Strong tokens chain records together; names only join records that have no strong token.
    Fields are the last known values in input order; the key is the netid, else e-mail, else
    name, else one per record.
    """
    net, mail, name = identity_tokens(F.col(netid), F.col(email), F.col(first), F.col(last))
    tagged = records.withColumn("_net", net).withColumn("_mail", mail).withColumn("_name", name)
    # The graph is over distinct tokens, not records: repeats are folded before any iteration.
    edges = tagged.filter("_net IS NOT NULL AND _mail IS NOT NULL").select(
        F.col("_net").alias("u"), F.col("_mail").alias("v")
    )
    components = connected_components(edges)
    strong = F.coalesce("_net", "_mail")
    labelled = tagged.withColumn("node", strong).join(components, "node", "left")
    group = F.coalesce(
        "component", "node", "_name", F.concat(F.lit("record:"), F.col(order).cast("string"))
    )
    grouped = labelled.withColumn("_group", group).drop("node", "component")
    fields = [netid, email, first, last]
    merged = grouped.groupBy("_group").agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields],
        F.count("*").alias("record_count"),
        F.max(order).alias("_last"),
    )
    m_net, m_mail, m_name = identity_tokens(F.col(netid), F.col(email), F.col(first), F.col(last))
    key = F.coalesce(m_net, m_mail, m_name, F.concat(F.lit("instructor:"), F.col("_last").cast("string")))
    people = merged.withColumn("instructor_key", key)
    aliases = grouped.select(order, "_group").join(people.select("_group", "instructor_key"), "_group").select(order, "instructor_key")
    return aliases, people.select("instructor_key", *fields, "record_count")
