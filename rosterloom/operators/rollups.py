"""Aggregations: flag rollups, weighted means, ordered texts and lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.functions.calendar import mask_size, minutes_text
from rosterloom.skew import salted_join


def weighted_mean(value: Column, weight: Column) -> Column:
    """Sum(x*w) / Sum(w), NULL when the weights sum to zero."""
    return F.sum(value * weight) / F.nullif(F.sum(weight), F.lit(0))


def flag_rollup(df: DataFrame, keys: Sequence[str], distinct: str, flags: dict[str, str], count_as: str) -> DataFrame:
    """Distinct count plus the maximum of each tri-state flag, in two combinable steps."""
    per_item = df.groupBy(*keys, distinct).agg(*[F.max(c).alias(c) for c in flags.values()])
    return per_item.groupBy(*keys).agg(
        F.count(distinct).alias(count_as), *[F.max(c).alias(name) for name, c in flags.items()]
    )


def sorted_json_list(df: DataFrame, keys: Sequence[str], item: str, list_as: str, count_as: str) -> DataFrame:
    """Items of a key as a sorted JSON array, with their count."""
    return df.groupBy(*keys).agg(
        F.to_json(F.array_sort(F.collect_list(item))).alias(list_as), F.count("*").alias(count_as)
    )


def merge_count_maps(df: DataFrame, keys: Sequence[str], counts: str, out: str) -> DataFrame:
    """Sum count maps entry by entry per key."""
    entries = df.select(*keys, F.explode(counts).alias("_code", "_n"))
    summed = entries.groupBy(*keys, "_code").agg(F.sum(F.coalesce("_n", F.lit(0))).alias("_n"))
    return summed.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("_code", "_n")))).alias(out)
    )


def meeting_rollup(meetings: DataFrame, package: str = "package_id") -> DataFrame:
    """Per package: class meeting count, campus days, time span, online / unknown-place flags."""
    is_class = F.col("meeting_type") == "CLASS"
    scheduled = (
        is_class
        & F.col("days_mask").isNotNull()
        & F.col("start_minute_local").isNotNull()
        & F.col("end_minute_local").isNotNull()
    )
    on_site = F.coalesce(F.col("is_online") != 1, F.lit(True))
    unplaced = on_site & F.coalesce(F.col("location_known") != 1, F.lit(True))
    return meetings.groupBy(package).agg(
        F.count(F.when(is_class, 1)).alias("meeting_count"),
        mask_size(F.bit_or(F.when(scheduled & on_site, F.col("days_mask")))).alias("campus_day_count"),
        F.min(F.when(scheduled, F.col("start_minute_local"))).alias("earliest_start_minute_local"),
        F.max(F.when(scheduled, F.col("end_minute_local"))).alias("latest_end_minute_local"),
        F.coalesce(F.max(F.when(is_class, (F.col("is_online") == 1).cast("int"))), F.lit(0)).alias("has_online_meeting"),
        F.coalesce(F.max(F.when(is_class, unplaced.cast("int"))), F.lit(0)).alias("has_unknown_location"),
    )


def meeting_line(days: Column, start: Column, end: Column, online: Column, building: Column, room: Column) -> Column:
    """``MW 9:00 AM-9:50 AM @ Place``; missing parts are left out."""
    span = F.when(
        start.isNotNull() & end.isNotNull(), F.concat(minutes_text(start), F.lit("-"), minutes_text(end))
    )
    place = F.when(online == 1, "Online").otherwise(
        F.concat(F.lit("@ "), F.coalesce(F.nullif(building, F.lit("")), F.nullif(room, F.lit(""))))
    )
    return F.concat_ws(" ", F.nullif(days, F.lit("")), span, place)


def ordered_text(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, sep: str, out: str) -> DataFrame:
    """Texts of a key joined in order; blank ones are left out."""
    # Blank texts are passed over by the list, not by a filter, which would work every text out twice.
    item = F.when(F.col(text) != "", F.struct(*order, text))
    items = df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_items")).filter(F.size("_items") > 0)
    return items.select(*keys, F.array_join(F.col("_items")[text], sep).alias(out))


def distinct_notes(*sources: Column) -> Column:
    """Row-local: trimmed, non-blank notes of several arrays, first occurrences, joined by ' | '."""
    empty = F.array().cast("array<string>")
    notes = F.flatten(F.array(*[F.coalesce(s, empty) for s in sources]))
    clean = F.filter(F.transform(notes, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.nullif(F.array_join(F.array_distinct(clean), " | "), F.lit(""))


# Section types in display order.
SECTION_TYPE_ORDER = ["LEC", "SEM", "LAB", "DIS", "QUIZ"]


def section_type_rank(section_type: Column) -> Column:
    known = F.array(*[F.lit(t) for t in SECTION_TYPE_ORDER])
    position = F.array_position(known, section_type)
    return F.when(position > 0, position - 1).otherwise(99)


def bundle_label(designation: Column, sections: Column) -> Column:
    """``COURSE LEC 001 + DIS 301`` from an array of (section_type, section_number, class_number)."""
    keyed = F.transform(
        sections,
        lambda s: F.struct(
            section_type_rank(F.coalesce(s["section_type"], F.lit("SEC"))).alias("a"),
            F.coalesce(s["section_type"], F.lit("SEC")).alias("b"),
            F.coalesce(F.regexp_extract(s["section_number"], r"^(\D*)", 1), F.lit("")).alias("c"),
            F.coalesce(F.regexp_extract(s["section_number"], r"(\d+)", 1).try_cast("bigint"), F.lit(-1)).alias("d"),
            F.coalesce(s["section_number"], F.lit("???")).alias("e"),
            F.coalesce(s["class_number"].cast("bigint"), F.lit(9007199254740991)).alias("f"),
        ),
    )
    parts = F.transform(F.array_sort(keyed), lambda k: F.concat(k["b"], F.lit(" "), k["e"]))
    return F.when(F.size(sections) > 0, F.concat(designation, F.lit(" "), F.array_join(parts, " + "))).otherwise(designation)


def freshest_group(df: DataFrame, keys: Sequence[str], updated: str) -> DataFrame:
    """All rows tied for the newest timestamp of their key (unknown counts as -1)."""
    stamp = F.coalesce(F.col(updated), F.lit(-1))
    newest = df.groupBy(*keys).agg(F.max(stamp).alias("_newest"))
    return df.join(newest, list(keys)).filter(stamp == F.col("_newest")).drop("_newest")


# Wording that makes a note a course-wide one.
SHARED_NOTE_PATTERN = (
    r"(?i)\bcareers?\b|\blaptop\b|\bcomputer\b|\bphone\b|https?://"
    r"|\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
)
LONG_NOTE = 160


def long_note(note: Column) -> Column:
    return (F.char_length(note) >= LONG_NOTE) | note.contains("\n")


def note_fragments(packages: DataFrame, keys: Sequence[str], note: str) -> DataFrame:
    """One row per non-blank ' | ' fragment with its position."""
    parts = packages.select(*keys, F.posexplode(F.split(note, r" \| ")).alias("position", "fragment"))
    return parts.withColumn("fragment", F.trim("fragment")).filter(F.col("fragment") != "")


def split_shared_notes(
    packages: DataFrame, course: str, package: str, note: str, promoted: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(shared notes per course, what stays per package).

    A fragment is shared when it occurs more than once in the course, is long or multi-line,
    matches a course-wide pattern, or is listed in ``promoted(fragment)``.
    """
    fragments = note_fragments(packages, [course, package], note)
    counts = fragments.groupBy(course, "fragment").agg(
        F.count("*").alias("occurrences"), F.min(F.struct(package, "position")).alias("first_seen")
    )
    text = F.col("fragment")
    is_shared = (F.col("occurrences") > 1) | long_note(text) | text.rlike(SHARED_NOTE_PATTERN)
    if promoted is not None:
        listed = promoted.select(F.trim("fragment").alias("fragment"), F.lit(True).alias("_listed")).distinct()
        counts = counts.join(listed, "fragment", "left")
        is_shared = is_shared | F.coalesce(F.col("_listed"), F.lit(False))
    shared = counts.filter(is_shared).select(course, "fragment", "occurrences", "first_seen")
    # A fragment repeated over a third of the packages is one hot key on the left side.
    own = salted_join(
        fragments, shared.select(course, "fragment"), [course, "fragment"], "left_anti", salt_by=[package, "position"]
    )
    kept = ordered_text(own, [course, package], ["position"], "fragment", " | ", "package_note")
    return shared, packages.select(course, package).join(kept, [course, package], "left")


# Wording that sorts a shared note into a section.
TEXTBOOK_PATTERN = r"(?i)\btextbook\b|\btexts?\b|\bbooks?\b|\bo'reilly\b|\blibrary\b|\bedition\b|\bhardcopy\b"
INSTRUCTOR_PATTERN = (
    r"(?i)physical attendance|team project|typical weekly schedule|\bkeywords\b|\bformat\b|software engineering"
    r"|agile|scrum|pair programming|practical exam|mid-?term|final exam"
)
ADMIN_PATTERN = r"(?i)\bcareers?\b|\bcontact us\b|\bphone\b|\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
EXCEPT_GRADS_PATTERN = r"(?i)^\s*All careers,\s*except Grads\s*$"
EXCEPT_GRADS_TEXT = "Open to all student careers except graduate students."


def shared_note_text(note: Column) -> Column:
    return F.when(note.rlike(EXCEPT_GRADS_PATTERN), EXCEPT_GRADS_TEXT).otherwise(note)


def shared_note_section(note: Column) -> Column:
    """Textbooks / Notes / Instructor description / Visible."""
    return (
        F.when(note.rlike(TEXTBOOK_PATTERN), "Textbooks")
        .when(note.rlike(ADMIN_PATTERN), "Notes")
        .when(long_note(note) & note.rlike(INSTRUCTOR_PATTERN), "Instructor description")
        .when(long_note(note), "Notes")
        .otherwise("Visible")
    )


def organize_notes(notes: DataFrame, keys: Sequence[str], position: str, note: str) -> DataFrame:
    """Notes of a key per section, in order."""
    named = notes.withColumn("note", shared_note_text(F.col(note))).withColumn("section", shared_note_section(F.col("note")))
    lists = named.groupBy(*keys, "section").agg(
        F.array_sort(F.collect_list(F.struct(position, "note")))["note"].alias("notes")
    )
    return lists
