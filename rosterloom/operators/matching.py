"""Three-state entity matching between a local and an external list.

Whether a record has none, one or several candidates is decided from the smallest and
largest candidate id per key, so no candidate pair is ever listed and a key shared by a
third of both sides costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.functions.text import match_text
from rosterloom.operators.versions import dense_ids

NO_PAIR = "No external course matched any subject/code pair"
NO_TITLE = "No external course matched the normalized title after subject/code filtering"
MANY_TITLES = "Multiple external courses matched subject/code and title filters"
NO_NAME = "No external instructor matched the normalized full name"
MANY_NAMES = "Multiple external instructors matched the normalized full name"


def identity_pairs(courses: DataFrame, aliases: DataFrame, keys: list[str]) -> DataFrame:
    """Local (subject, number) pairs of a course: its own and those of its cross listings."""
    own = courses.select(*keys, F.col("subject_code").alias("subject"), F.col("catalog_number").alias("number"))
    other = aliases.select(*keys, F.col("subject_code").alias("subject"), F.col("catalog_number").alias("number"))
    return own.unionByName(other).filter("subject IS NOT NULL AND number IS NOT NULL").distinct()


def match_courses(
    local: DataFrame, pairs: DataFrame, external: DataFrame, aliases: DataFrame, names: DataFrame, keys: list[str]
) -> DataFrame:
    """Match local courses to external ones.

    ``local(keys, title)``, ``pairs(keys, subject, number)``, ``external(external_id, number,
    name)``, ``aliases(external_id, subject)``, ``names(external_id, name)`` (alternate titles).
    """
    wanted = pairs.select(
        *keys, match_text(F.col("subject")).alias("_subject"), match_text(F.col("number")).alias("_number")
    ).distinct()
    offered = aliases.join(external.select("external_id", "number", "name"), "external_id").select(
        "external_id",
        match_text(F.col("subject")).alias("_subject"),
        match_text(F.col("number")).alias("_number"),
        match_text(F.col("name")).alias("_title"),
    ).distinct()
    spread = [F.min("external_id").alias("lo"), F.max("external_id").alias("hi")]
    by_pair = offered.groupBy("_subject", "_number").agg(*spread)
    by_title = offered.groupBy("_subject", "_number", "_title").agg(
        F.min("external_id").alias("t_lo"), F.max("external_id").alias("t_hi")
    )
    titled = local.select(*keys, match_text(F.col("title")).alias("_title"))
    found = (
        titled.join(wanted, keys, "left")
        .join(by_pair, ["_subject", "_number"], "left")
        .join(by_title, ["_subject", "_number", "_title"], "left")
        .groupBy(*keys, "_title")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("t_lo").alias("t_lo"), F.max("t_hi").alias("t_hi"))
    )
    all_names = (
        names.select("external_id", "name")
        .unionByName(external.select("external_id", "name"))
        .select(F.col("external_id").alias("lo"), match_text(F.col("name")).alias("_title"), F.lit(True).alias("_named"))
        .distinct()
    )
    none, single = F.col("lo").isNull(), F.col("lo") == F.col("hi")
    one_title, many_titles = F.col("t_lo") == F.col("t_hi"), F.col("t_lo") < F.col("t_hi")
    return found.join(all_names, ["lo", "_title"], "left").select(
        *keys,
        F.when(none, "unmatched")
        .when(single | one_title, "matched")
        .when(many_titles, "ambiguous")
        .otherwise("unmatched")
        .alias("match_status"),
        F.when(none, None)
        .when(single & F.col("_named"), "subject-code+catalog-number")
        .when(single, "subject-code+catalog-number-only")
        .when(one_title, "subject-code+catalog-number+title")
        .alias("match_method"),
        F.when(single, F.col("lo")).when(one_title, F.col("t_lo")).alias("external_id"),
        F.when(none, NO_PAIR)
        .when(single | one_title, None)
        .when(many_titles, MANY_TITLES)
        .otherwise(NO_TITLE)
        .alias("match_note"),
    )


def match_people(local: DataFrame, external: DataFrame, key: str, name: str = "display_name") -> DataFrame:
    """Match ``local(key, name)`` to ``external(external_id, name)`` on the normalised full name."""
    offered = (
        external.select("external_id", match_text(F.col(name)).alias("_name"))
        .groupBy("_name")
        .agg(F.min("external_id").alias("lo"), F.max("external_id").alias("hi"))
    )
    found = local.select(key, match_text(F.col(name)).alias("_name")).join(offered, "_name", "left")
    none, single = F.col("lo").isNull(), F.col("lo") == F.col("hi")
    return found.select(
        key,
        F.when(none, "unmatched").when(single, "matched").otherwise("ambiguous").alias("match_status"),
        F.when(single, "normalized-name-exact").alias("match_method"),
        F.when(single, F.col("lo")).alias("external_id"),
        F.when(none, NO_NAME).when(single, None).otherwise(MANY_NAMES).alias("match_note"),
    )


def match_links(matches: DataFrame, keys: list[str], matched_at: str) -> DataFrame:
    """Link rows: the external id and the timestamp are kept only for matched records."""
    hit = F.col("match_status") == "matched"
    return matches.select(
        *keys,
        F.when(hit, F.col("external_id")).alias("external_id"),
        "match_status",
        F.when(hit, F.lit(matched_at)).alias("matched_at"),
    )


def fetch_list(matches: DataFrame, order: list[str]) -> DataFrame:
    """Distinct matched external ids, numbered 1..n in first-seen order."""
    firsts = (
        matches.filter("match_status = 'matched'")
        .groupBy("external_id")
        .agg(F.min(F.struct(*order)).alias("_first"))
        .select("external_id", *[F.col("_first")[c].alias(f"first_{c}") for c in order])
    )
    return dense_ids(firsts, [f"first_{c}" for c in order] + ["external_id"], "fetch_id").select("external_id", "fetch_id")


def subject_aliases(external: DataFrame) -> DataFrame:
    """(external_id, subject): the alias list, else the subjects' abbreviations and codes, else the one subject."""
    coded = F.flatten(F.transform("subjects", lambda s: F.array(s["abbreviation"], s["code"])))
    chosen = (
        F.when(F.size("subjectAliases") > 0, F.col("subjectAliases"))
        .when(F.size("subjects") > 0, F.filter(coded, lambda x: x != ""))
        .otherwise(F.array("subject"))
    )
    return external.select("external_id", F.explode(chosen).alias("subject")).filter("subject IS NOT NULL").distinct()
