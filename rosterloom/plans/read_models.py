"""Views and materialised read models over the normalised tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.functions import availability as av
from rosterloom.functions import calendar as cal
from rosterloom.functions.text import display_name, key_field
from rosterloom.operators import history, merging, rollups
from rosterloom.operators.versions import latest_version

COURSE_KEY = ["term_code", "course_id"]
SECTION_KEY = [*COURSE_KEY, "section_class_number"]


def cross_listing_overview(cross_listings: DataFrame, courses: DataFrame) -> DataFrame:
    named = courses.select(*COURSE_KEY, F.col("course_designation").alias("canonical_course_designation"), "title")
    return cross_listings.join(named, COURSE_KEY).select(
        *COURSE_KEY,
        "canonical_course_designation",
        F.col("course_designation").alias("alias_course_designation"),
        "full_course_designation",
        "subject_code",
        "catalog_number",
        "title",
        "is_primary",
    )


def section_overview(sections: DataFrame, packages: DataFrame, courses: DataFrame) -> DataFrame:
    """Current version of every section: the copy held by the most recently updated package."""
    stamps = packages.select("package_id", F.col("package_last_updated").alias("source_package_last_updated"))
    columns = [
        *SECTION_KEY, "package_id", "section_number", "section_type", "instruction_mode", "session_code",
        "open_seats", "waitlist_current_size", "capacity", "currently_enrolled",
    ]
    current = latest_version(
        sections.select(*columns).join(stamps, "package_id"), SECTION_KEY, "source_package_last_updated", ["package_id"]
    )
    named = courses.select(*COURSE_KEY, "subject_code", "catalog_number", "course_designation", "title")
    return current.join(named, COURSE_KEY).select(
        "term_code",
        "subject_code",
        "catalog_number",
        "course_id",
        "course_designation",
        "title",
        "section_class_number",
        F.col("package_id").alias("source_package_id"),
        "source_package_last_updated",
        "section_number",
        "section_type",
        "instruction_mode",
        "session_code",
        "open_seats",
        "waitlist_current_size",
        "capacity",
        "currently_enrolled",
        av.positive_flag(F.col("open_seats")).alias("has_open_seats"),
        av.positive_flag(F.col("waitlist_current_size")).alias("has_waitlist"),
        av.full_flag(F.col("open_seats")).alias("is_full"),
    )


def course_overview(courses: DataFrame, sections_v: DataFrame, cross_listings: DataFrame) -> DataFrame:
    """Courses with section counts, availability and the list of their designations."""
    rollup = rollups.flag_rollup(
        sections_v,
        COURSE_KEY,
        "section_class_number",
        {"has_any_open_seats": "has_open_seats", "has_any_waitlist": "has_waitlist", "has_any_full_section": "is_full"},
        "section_count",
    )
    listed = rollups.sorted_json_list(
        cross_listings, COURSE_KEY, "course_designation", "cross_list_designations_json", "cross_list_count"
    )
    return (
        courses.join(rollup, COURSE_KEY, "left")
        .join(listed, COURSE_KEY, "left")
        .select(
            "term_code",
            "subject_code",
            "catalog_number",
            "course_id",
            "course_designation",
            "title",
            "minimum_credits",
            "maximum_credits",
            F.coalesce("cross_list_designations_json", F.to_json(F.array("course_designation"))).alias("cross_list_designations_json"),
            F.coalesce("cross_list_count", F.lit(1)).alias("cross_list_count"),
            F.coalesce("section_count", F.lit(0)).alias("section_count"),
            "has_any_open_seats",
            "has_any_waitlist",
            "has_any_full_section",
        )
    )


def _course_names(courses: DataFrame) -> DataFrame:
    return courses.select(*COURSE_KEY, "subject_code", "catalog_number", "course_designation", "title")


def rule_overview(rules: DataFrame, courses: DataFrame) -> DataFrame:
    return rules.join(_course_names(courses), COURSE_KEY).select(
        "term_code", "subject_code", "catalog_number", "course_id", "course_designation", "title",
        "rule_id", "parse_status", "parse_confidence", "raw_text", "unparsed_text",
    )


def summary_overview(summaries: DataFrame, rules: DataFrame, courses: DataFrame) -> DataFrame:
    stated = rules.select("rule_id", *COURSE_KEY, "parse_status", "parse_confidence", "raw_text", "unparsed_text")
    return summaries.join(stated, ["rule_id", *COURSE_KEY]).join(_course_names(courses), COURSE_KEY).select(
        "term_code", "subject_code", "catalog_number", "course_id", "course_designation", "title", "rule_id",
        "parse_status", "parse_confidence", "summary_status", "course_groups_json", "escape_clauses_json",
        "raw_text", "unparsed_text",
    )


def availability(packages: DataFrame, courses: DataFrame) -> DataFrame:
    columns = [
        "package_id", "package_status", "package_available_seats", "package_waitlist_total", "open_seats",
        "waitlist_current_size", "has_open_seats", "has_waitlist", "is_full", "online_only", "is_asynchronous",
    ]
    return packages.select(*COURSE_KEY, *columns).join(_course_names(courses), COURSE_KEY).select(
        "term_code", "subject_code", "catalog_number", "course_designation", "title", *columns
    )


_MEETING = [
    "meeting_index", "meeting_type", "meeting_days", "meeting_time_start", "meeting_time_end",
    "start_date", "end_date", "exam_date", "room", "building_code",
]
_BUILDING = ["building_name", "street_address", "latitude", "longitude"]


def schedule_planning(sections_v: DataFrame, meetings: DataFrame, buildings: DataFrame) -> DataFrame:
    """Current sections with the meetings of their source package and the buildings."""
    met = meetings.select(
        F.col("package_id").alias("source_package_id"), "section_class_number", *_MEETING, "location_known"
    )
    # Spark broadcasts the building table when its size allows it.
    placed = sections_v.join(met, ["source_package_id", "section_class_number"]).join(
        buildings.select("building_code", *_BUILDING), "building_code", "left"
    )
    return placed.select(
        "term_code", "subject_code", "catalog_number", "course_id", "course_designation", "title", "section_class_number",
        "source_package_id", "source_package_last_updated", "section_number", "section_type", "instruction_mode",
        *_MEETING, *_BUILDING, "location_known", "has_open_seats", "is_full",
    )


def canonical_sections(sections_v: DataFrame, courses: DataFrame) -> DataFrame:
    credits = courses.select(*COURSE_KEY, "minimum_credits", "maximum_credits")
    return sections_v.join(credits, COURSE_KEY)


def canonical_meetings(canonical: DataFrame, sections: DataFrame, meetings: DataFrame, buildings: DataFrame) -> DataFrame:
    """Meetings of every package copy of a canonical section, with masks, local minutes and places."""
    copies = canonical.select(*SECTION_KEY, "source_package_id").join(
        sections.select(*SECTION_KEY, "package_id", "instruction_mode"), SECTION_KEY
    ).drop("term_code", "course_id")
    met = meetings.select("package_id", "section_class_number", *_MEETING, "location_known")
    rows = copies.join(met, ["package_id", "section_class_number"]).join(
        buildings.select("building_code", *_BUILDING), "building_code", "left"
    )
    start = cal.local_minute(F.col("meeting_time_start"))
    end = cal.local_minute(F.col("meeting_time_end"))
    worked = rows.withColumns({
        "days_mask": cal.days_mask(F.col("meeting_days")),
        "start_minute_local": start,
        "end_minute_local": end,
        "is_online": av.online_mode(F.col("instruction_mode")),
    })
    # Handed on as one item of a list: a later filter on these columns, or on a text made of them, then reads the values, where it
    # would else take the whole clock expression in place of every mention.
    clock = F.struct("days_mask", "start_minute_local", "end_minute_local", "is_online")
    listed = worked.withColumn("_clock", F.explode_outer(F.array(clock)))
    return listed.select(
        "package_id",
        "source_package_id",
        "section_class_number",
        *_MEETING,
        *_BUILDING,
        F.lit(cal.CLOCK_ZONE).alias("timezone_name"),
        "_clock.days_mask",
        "_clock.start_minute_local",
        "_clock.end_minute_local",
        cal.duration(F.col("_clock.start_minute_local"), F.col("_clock.end_minute_local")).alias("duration_minutes"),
        "_clock.is_online",
        "location_known",
    )


def meeting_summaries(meetings: DataFrame) -> DataFrame:
    """Summary text per package over its scheduled class meetings, in meeting order."""
    scheduled = meetings.filter(
        "meeting_type = 'CLASS' AND days_mask IS NOT NULL AND start_minute_local IS NOT NULL AND end_minute_local IS NOT NULL"
    )
    line = rollups.meeting_line(
        F.col("meeting_days"), F.col("start_minute_local"), F.col("end_minute_local"), F.col("is_online"),
        F.col("building_name"), F.col("room"),
    )
    return rollups.ordered_text(
        scheduled.withColumn("line", line), ["package_id"], ["meeting_index", "section_class_number"], "line", "; ", "meeting_summary_local"
    )


def schedulable_packages(packages: DataFrame, courses: DataFrame, meetings: DataFrame, described: DataFrame) -> DataFrame:
    """One row per package with seats, meeting rollup, summary and notes.

    ``described(package_id, section_bundle_label, restriction_note)``.
    """
    base = packages.select("package_id", *COURSE_KEY, "open_seats", "is_full", "has_waitlist").join(
        courses.select(*COURSE_KEY, "course_designation", "title"), COURSE_KEY
    )
    rolled = rollups.meeting_rollup(meetings)
    flags = ["meeting_count", "campus_day_count", "has_online_meeting", "has_unknown_location"]
    joined = base.join(rolled, "package_id", "left").join(meeting_summaries(meetings), "package_id", "left").join(described, "package_id", "left")
    return joined.select(
        F.col("package_id").alias("source_package_id"),
        *COURSE_KEY,
        "course_designation",
        "title",
        F.coalesce(
            "section_bundle_label", F.concat(F.coalesce("course_designation", "course_id"), F.lit(" package"))
        ).alias("section_bundle_label"),
        "open_seats",
        "is_full",
        "has_waitlist",
        *[F.coalesce(f, F.lit(0)).alias(f) for f in flags],
        "earliest_start_minute_local",
        "latest_end_minute_local",
        "restriction_note",
        av.temporary_restriction(F.col("restriction_note")).alias("has_temporary_restriction"),
        F.coalesce("meeting_summary_local", F.lit("")).alias("meeting_summary_local"),
    )


def online_courses(courses: DataFrame, packages: DataFrame) -> DataFrame:
    """Courses whose freshest packages include an online or asynchronous one."""
    fresh = rollups.freshest_group(
        packages.select(*COURSE_KEY, "package_last_updated", "online_only", "is_asynchronous"), COURSE_KEY, "package_last_updated"
    )
    online = fresh.filter((F.coalesce("online_only", F.lit(0)) == 1) | (F.coalesce("is_asynchronous", F.lit(0)) == 1))
    columns = [*COURSE_KEY, "subject_code", "catalog_number", "course_designation", "title", "minimum_credits", "maximum_credits"]
    return courses.select(*columns).join(online.select(*COURSE_KEY).distinct(), COURSE_KEY, "left_semi").distinct()


def course_grade_overview(history_courses: DataFrame, course_grades: DataFrame) -> DataFrame:
    return history.weighted_history(
        history_courses.select("history_course_id", "subject_code", "catalog_number", "course_designation"),
        course_grades, "history_course_id", "term_code", "refresh_run_id", "course_grade_id",
        "course_grade_term_count", "historical_gpa",
    )


def instructor_grade_overview(history_instructors: DataFrame, instructor_grades: DataFrame) -> DataFrame:
    return history.weighted_history(
        history_instructors.select("history_instructor_id", "display_name"),
        instructor_grades, "history_instructor_id", "term_code", "refresh_run_id", "instructor_grade_id",
        "instructor_grade_term_count", "overall_gpa",
    )


def instructor_course_history(offerings: DataFrame, history_courses: DataFrame, history_instructors: DataFrame) -> DataFrame:
    """Offerings per (course, instructor); aggregated before the names are joined."""
    pairs = history.pair_history(offerings, ["history_course_id", "history_instructor_id"])
    return (
        pairs.join(history_courses.select("history_course_id", "course_designation"), "history_course_id")
        .join(history_instructors.select("history_instructor_id", F.col("display_name").alias("instructor_display_name")), "history_instructor_id")
    )


def current_term_instructors(
    runs: DataFrame,
    sections_v: DataFrame,
    section_instructors: DataFrame,
    instructors: DataFrame,
    course_matches: DataFrame,
    instructor_matches: DataFrame,
    pair_history_v: DataFrame,
    course_grades_v: DataFrame,
) -> DataFrame:
    """Instructors of the current term's sections with their history of the same course."""
    current = runs.agg(F.max("source_term_code").alias("t")).scalar()
    sections = sections_v.filter(F.col("term_code") == current).select(
        *SECTION_KEY, "course_designation", "section_number", "section_type", F.col("source_package_id").alias("package_id")
    )
    people = instructors.select("instructor_key", display_name(F.col("first_name"), F.col("last_name")).alias("instructor_display_name"))
    taught = (
        sections.join(section_instructors.select("package_id", "section_class_number", "instructor_key"), ["package_id", "section_class_number"])
        .join(people, "instructor_key")
        .join(course_matches.select(*COURSE_KEY, "history_course_id"), COURSE_KEY, "left")
        .join(
            instructor_matches.select("instructor_key", "history_instructor_id", F.col("match_status").alias("instructor_match_status")),
            "instructor_key",
            "left",
        )
    )
    same = pair_history_v.select(
        "history_course_id",
        "history_instructor_id",
        F.col("prior_offering_count").alias("same_course_prior_offering_count"),
        F.col("student_count").alias("same_course_student_count"),
        "same_course_gpa",
    )
    overall = course_grades_v.select("history_course_id", F.col("historical_gpa").alias("course_historical_gpa"))
    return (
        taught.join(same, ["history_course_id", "history_instructor_id"], "left")
        .join(overall, "history_course_id", "left")
        .select(
            *SECTION_KEY, "section_number", "section_type", "instructor_key", "course_designation", "instructor_display_name",
            "same_course_prior_offering_count", "same_course_student_count", "same_course_gpa", "course_historical_gpa",
            "instructor_match_status",
        )
    )


def source_titles(rows: DataFrame, source: str, titles: DataFrame, own_title: Column, out: str = "section_title") -> DataFrame:
    """Title of the course named by a source package id, where it differs from the row's own title."""
    named = titles.select("term_code", F.col("course_id").alias("_source_course"), F.col("title").alias("_source_title")).filter("_source_title <> ''")
    keyed = rows.withColumn("_source_course", key_field(F.col(source), 2))
    joined = keyed.join(named, ["term_code", "_source_course"], "left")
    return joined.withColumn(out, F.when(F.col("_source_title") != own_title, F.col("_source_title"))).drop("_source_course", "_source_title")


def course_detail(
    courses: DataFrame,
    sections_v: DataFrame,
    meetings: DataFrame,
    candidates: DataFrame,
    summaries_v: DataFrame,
    memberships: DataFrame,
    instructor_rows: DataFrame,
) -> DataFrame:
    """One document per course with nested sections, meetings, packages, rules and instructors.

    Sections and packages are first reduced across cross-listed sources; each list is gathered
    per course from rows already distinct within it.
    """
    base = courses.select(
        *COURSE_KEY, "subject_code", "catalog_number", "course_designation", "title", "description",
        "minimum_credits", "maximum_credits", "enrollment_prerequisites",
    )
    own = base.select(*COURSE_KEY, F.col("title").alias("own_title"), F.col("subject_code").alias("own_subject"))
    titles = courses.select("term_code", "course_id", "title").distinct()
    section_fields = [
        "section_class_number", "section_title", "instruction_mode", "open_seats", "waitlist_current_size", "capacity",
        "currently_enrolled", "has_open_seats", "has_waitlist", "is_full",
    ]
    titled = source_titles(sections_v.drop("title").join(own, COURSE_KEY), "source_package_id", titles, F.col("own_title"))
    sections = merging.dedupe_cross_listed(
        titled.withColumn("session_code", F.coalesce("session_code", F.lit(""))),
        [*COURSE_KEY, "section_type", "section_number", "session_code"],
        "source_package_id",
        key_field(F.col("source_package_id"), 1),
        F.col("own_subject"),
        section_fields,
    )
    package_fields = ["section_title", "open_seats", "is_full", "has_waitlist", "campus_day_count"]
    pack = source_titles(candidates.drop("title").join(own, COURSE_KEY), "source_package_id", titles, F.col("own_title"))
    pack_key = [*COURSE_KEY, "section_bundle_label", "meeting_summary_local"]
    subject = key_field(F.col("source_package_id"), 1)
    packages = merging.dedupe_cross_listed(pack, pack_key, "source_package_id", subject, F.col("own_subject"), package_fields)
    rank = (~F.coalesce(subject == F.col("own_subject"), F.lit(False))).cast("int")
    notes = merging.union_note_fragments(pack, pack_key, "source_package_id", rank, "restriction_note", "restriction_note")
    labels = sections.join(base.select(*COURSE_KEY, "course_designation"), COURSE_KEY).filter("section_title IS NOT NULL").select(
        *COURSE_KEY,
        F.concat_ws(" ", "course_designation", "section_type", "section_number").alias("section_bundle_label"),
        F.col("section_title").alias("_label_title"),
    ).dropDuplicates([*COURSE_KEY, "section_bundle_label"])
    packages = (
        packages.join(notes, pack_key, "left")
        .join(labels, [*COURSE_KEY, "section_bundle_label"], "left")
        .withColumn("section_title", F.coalesce("section_title", "_label_title"))
        .drop("_label_title")
    )

    def gathered(df: DataFrame, name: str, order: list[str], fields: list[str]) -> DataFrame:
        item = F.struct(*order, *[f for f in fields if f not in order])
        return df.groupBy(*COURSE_KEY).agg(F.array_sort(F.collect_list(item)).alias(name))

    parts = [
        gathered(sections, "sections", ["section_type", "section_number", "session_code"], section_fields),
        gathered(packages, "packages", ["section_bundle_label", "meeting_summary_local", "source_package_id"], [*package_fields, "restriction_note"]),
        gathered(
            meetings, "meetings", ["section_class_number", "source_package_id", "meeting_index"],
            ["meeting_type", "meeting_days", "meeting_time_start", "meeting_time_end", "room", "building_name"],
        ),
        gathered(memberships.distinct(), "memberships", ["package_id", "section_class_number"], []),
        gathered(summaries_v, "rules", ["rule_id"], ["summary_status", "course_groups_json", "escape_clauses_json", "raw_text", "unparsed_text"]),
        gathered(instructor_rows, "instructors", ["section_type", "section_number", "instructor_key"], [
            "instructor_display_name", "same_course_prior_offering_count", "same_course_student_count", "same_course_gpa", "course_historical_gpa",
        ]),
    ]
    document = base
    for part in parts:
        document = document.join(part, COURSE_KEY, "left")
    return document.withColumn("section_count", F.greatest(F.size("sections"), F.lit(0)))


def register_views(spark: SparkSession, views: Mapping[str, DataFrame]) -> None:
    """Expose relations to ``spark.sql`` under their names."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
