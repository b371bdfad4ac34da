"""Read models over the stand-in catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterloom.functions import availability as av
from rosterloom.functions.text import defined_values, key_field
from rosterloom.operators import quality, rollups
from rosterloom.operators.matching import identity_pairs, subject_aliases
from rosterloom.operators.merging import display_history
from rosterloom.operators.search import resolve_designations
from rosterloom.operators.versions import best_version, top_per_key
from rosterloom.operators.history import history_order
from rosterloom.plans import read_models as rm
from rosterloom.session import cut_lineage
from workload.standin import Catalog, course_by_course, oracle


def _sections(c: Catalog):
    return rm.section_overview(c.sections, c.packages, c.courses)


def _overview(c: Catalog):
    return rm.course_overview(c.courses, _sections(c), c.cross_listings)


def _canonical_meetings(c: Catalog, sections=None):
    return rm.canonical_meetings(rm.canonical_sections(sections or _sections(c), c.courses), c.sections, c.meetings, c.buildings)


def latest_version_per_key(spark, sf):
    return _sections(Catalog(spark, sf))


def course_overview_rollup(spark, sf):
    return _overview(Catalog(spark, sf))


def cross_listing_overview(spark, sf):
    c = Catalog(spark, sf)
    return rm.cross_listing_overview(c.cross_listings, c.courses)


def availability_view(spark, sf):
    c = Catalog(spark, sf)
    return rm.availability(c.packages, c.courses)


def schedule_planning_view(spark, sf):
    return course_by_course(spark, sf, lambda c: rm.schedule_planning(_sections(c), c.meetings, c.buildings).drop("latitude", "longitude"))


def canonical_sections_view(spark, sf):
    c = Catalog(spark, sf)
    return rm.canonical_sections(_sections(c), c.courses)


def canonical_meetings_model(spark, sf):
    left_out = ("latitude", "longitude", "meeting_time_start", "meeting_time_end", "street_address", "timezone_name")
    return course_by_course(spark, sf, lambda c: _canonical_meetings(c).drop(*left_out))


def meeting_day_rollup(spark, sf):
    return rollups.meeting_rollup(_canonical_meetings(Catalog(spark, sf)))


def package_text_rollup(spark, sf):
    return rm.meeting_summaries(_canonical_meetings(Catalog(spark, sf)))


# What rollups and summaries of packages read of their meetings.
_ROLLED = [
    "package_id", "section_class_number", "meeting_index", "meeting_type", "meeting_days", "days_mask", "start_minute_local", "end_minute_local",
    "is_online", "building_name", "room", "location_known",
]


def schedulable_packages_model(spark, sf):
    return course_by_course(spark, sf, _schedulable)


def _schedulable(c: Catalog):
    described = c.placed_orders.select(
        "package_id",
        F.concat(F.col("subject_code"), F.lit(" bundle")).alias("section_bundle_label"),
        F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("Restriction will be removed on May 3 "), "o_orderpriority")).alias("restriction_note"),
    ).filter("restriction_note is not null")
    # The meetings feed the rollup and the summaries; they are a written table in the build as well.
    return rm.schedulable_packages(c.packages, c.courses, cut_lineage(_canonical_meetings(c).select(*_ROLLED)), described)


def online_courses_view(spark, sf):
    c = Catalog(spark, sf)
    return rm.online_courses(c.courses, c.packages)


def entity_history(spark, sf):
    c = Catalog(spark, sf)
    return rm.course_grade_overview(c.history_courses, c.course_grades).withColumn("historical_gpa", F.round("historical_gpa", 9))


def latest_refresh_weighted(spark, sf):
    c = Catalog(spark, sf)
    return rm.instructor_grade_overview(c.history_instructors, c.instructor_grades).withColumn("overall_gpa", F.round("overall_gpa", 9))


def pair_history(spark, sf):
    c = Catalog(spark, sf)
    v = rm.instructor_course_history(c.offerings, c.history_courses, c.history_instructors)
    return v.withColumn("same_course_gpa", F.round("same_course_gpa", 9))


def _current(c: Catalog):
    pairs = rm.instructor_course_history(c.offerings, c.history_courses, c.history_instructors)
    grades = rm.course_grade_overview(c.history_courses, c.course_grades)
    return rm.current_term_instructors(
        c.runs, _sections(c), c.section_instructors, c.instructors, c.course_matches, c.instructor_matches, pairs, grades
    )


def current_period_star(spark, sf):
    v = _current(Catalog(spark, sf))
    return v.withColumn("same_course_gpa", F.round("same_course_gpa", 9)).withColumn(
        "course_historical_gpa", F.round("course_historical_gpa", 9)
    )


def history_display(spark, sf):
    """Instructor rows shown for a course: lectures if any, one per (type, number, name)."""
    v = _current(Catalog(spark, sf)).withColumnRenamed("same_course_prior_offering_count", "prior_offering_count").withColumnRenamed(
        "same_course_student_count", "student_count"
    )
    order = [*history_order(), F.col("section_class_number"), F.col("instructor_key")]
    return display_history(v, "course_id", "section_type", "section_number", "instructor_display_name", order).select(
        "course_id", "section_type", "section_number", "instructor_display_name", "prior_offering_count", "student_count", "instructor_key"
    )


def history_ranked(spark, sf):
    """Best three (course, instructor) rows per instructor in history order."""
    c = Catalog(spark, sf)
    v = rm.instructor_course_history(c.offerings, c.history_courses, c.history_instructors)
    order = [
        F.coalesce("prior_offering_count", F.lit(-1)).desc(),
        F.coalesce("student_count", F.lit(-1)).desc(),
        F.col("history_course_id"),
    ]
    return top_per_key(v, ["history_instructor_id"], order, 3, rank="rank").select(
        "history_instructor_id", "rank", "history_course_id", "prior_offering_count", "student_count"
    )


def topn_filtered_group(spark, sf):
    """Courses with the most full, waitlisted sections."""
    s = _sections(Catalog(spark, sf)).filter("is_full = 1 and has_waitlist = 1")
    return (
        s.groupBy("course_designation")
        .agg(F.count("*").alias("waitlisted_sections"))
        .orderBy(F.col("waitlisted_sections").desc(), "course_designation")
        .limit(20)
    )


def cond_sum_by_type(spark, sf):
    return _sections(Catalog(spark, sf)).groupBy("section_type").agg(
        F.count("*").alias("section_count"), F.sum("has_open_seats").alias("sections_with_open_seats")
    )


def distinct_projection(spark, sf):
    """Distinct courses taught by each instructor."""
    c = Catalog(spark, sf)
    taught = c.section_instructors.join(c.sections.select("package_id", "section_class_number", "term_code", "course_id"), ["package_id", "section_class_number"])
    return taught.join(c.courses.select("term_code", "course_id", "course_designation", "title"), ["term_code", "course_id"]).select(
        "instructor_key", "course_designation", "title"
    ).distinct()


def anti_no_rule(spark, sf):
    """Courses that have no full section."""
    c = Catalog(spark, sf)
    full = _sections(c).filter("is_full = 1").select("term_code", "course_id")
    return c.courses.join(full, ["term_code", "course_id"], "left_anti").select("term_code", "course_id", "course_designation")


def orphan_drop(spark, sf):
    """Matches to people with a positive balance: stale ones go, unset ones stay."""
    c = Catalog(spark, sf)
    matches = c.course_matches.select("term_code", "course_id", F.col("history_course_id").alias("link"))
    imported = c.people.filter("c_acctbal > 3000").select("c_custkey")
    return quality.drop_orphans(matches, imported, {"link": "c_custkey"})


def display_class(spark, sf):
    """Seat, credit and bundle labels."""
    c = Catalog(spark, sf)
    sections = _sections(c).select(
        "term_code", "course_id", "section_class_number",
        av.seat_state(F.col("has_open_seats"), F.col("has_waitlist"), F.col("is_full")).alias("seat_state"),
        av.bundle_seat_text(F.col("is_full"), F.col("open_seats")).alias("bundle_text"),
    )
    courses = _overview(c).select(
        "term_code", "course_id",
        av.credit_text(F.col("minimum_credits"), F.col("maximum_credits")).alias("credit_text"),
        av.course_seat_text(F.col("has_any_open_seats"), F.col("has_any_full_section")).alias("course_text"),
    )
    return sections.join(courses, ["term_code", "course_id"])


def resolve_with_fallback(spark, sf):
    """Every designation in use, canonical or alias, resolved to one course."""
    c = Catalog(spark, sf)
    wanted = c.cross_listings.select("course_designation").distinct()
    return resolve_designations(wanted, _overview(c), rm.cross_listing_overview(c.cross_listings, c.courses))


def composite_key_split(spark, sf):
    c = Catalog(spark, sf)
    key = F.col("package_id")
    return c.packages.select("package_id", *[key_field(key, i).alias(f"part_{i}") for i in range(5)])


def source_title_lookup(spark, sf):
    """Title of the course a section's source package belongs to, where it differs from the predecessor's."""
    c = Catalog(spark, sf)
    rows = _sections(c).select("term_code", "course_id", "section_class_number", "source_package_id", "section_type")
    labelled = rows.withColumn("own_title", F.concat(F.lit("Studies "), F.col("section_class_number").cast("string")))
    return rm.source_titles(labelled, "source_package_id", c.courses, F.col("own_title")).select(
        "term_code", "course_id", "section_class_number", "section_title"
    )


def quality_report(spark, sf):
    """Constraint checks as violation counts."""
    c = Catalog(spark, sf)
    raw = c.t("lineitem")
    checks = {
        "duplicate_line_keys": quality.duplicate_keys(raw, ["l_orderkey", "l_linenumber"]),
        "duplicate_order_keys": quality.duplicate_keys(c.t("orders"), ["o_orderkey"]),
        "lines_without_order": quality.orphans(raw, c.t("orders"), {"l_orderkey": "o_orderkey"}),
        "surplus_primaries": quality.surplus_primaries(c.cross_listings, ["term_code", "course_id"], "is_primary"),
        "negative_balances": c.t("customer").filter("c_acctbal < 0"),
    }
    return quality.report(checks)


def rule_check_report(spark, sf):
    """Row rules of the section table, counted in one pass."""
    c = Catalog(spark, sf)
    return quality.rule_violations(
        c.sections,
        {
            "open_seats_not_negative": F.col("open_seats") >= 0,
            "type_known": F.col("section_type").isin("LEC", "DIS"),
            "enrolled_within_capacity": F.col("currently_enrolled") <= F.col("capacity"),
        },
    )


def predicate_scan(spark, sf):
    """Equality, lists, ranges, prefix, null and inequality tests in one scan of the orders."""
    o = Catalog(spark, sf).t("orders")
    prefix = F.col("o_orderpriority").startswith("1-") | F.col("o_orderpriority").startswith("3-")
    return o.filter(
        prefix
        & F.col("o_orderstatus").isin("O", "F")
        & ~F.col("o_custkey").isin(1, 2, 3)
        & (F.col("o_totalprice") >= 1000)
        & (F.col("o_totalprice") <= 400000)
        & F.col("o_orderdate").isNotNull()
        & (F.col("o_orderkey") != F.col("o_custkey"))
    ).select("o_orderkey", "o_custkey", "o_orderpriority")


def version_priority(spark, sf):
    """Best line per part: newest, then most values set, then the greatest canonical text."""
    li = Catalog(spark, sf).t("lineitem").selectExpr(
        "l_partkey", "l_orderkey", "l_linenumber", "year(l_shipdate) as updated",
        "case when l_returnflag = 'A' then l_quantity end as a", "case when l_linestatus = 'O' then l_tax end as b",
        "case when l_discount > 0.05 then l_discount end as c",
    )
    nested = li.withColumn("value", F.struct("a", F.struct("b", "c").alias("inner"), F.array_compact(F.array("a", "c")).alias("list")))
    ranked = nested.withColumn("filled", defined_values(F.col("value"), nested.schema["value"].dataType)).withColumn(
        "text", F.concat_ws("/", F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), "l_linenumber")
    )
    return best_version(ranked, ["l_partkey"], ["updated", "filled", "text"]).select("l_partkey", "updated", "filled", "text")


def local_identity_pairs(spark, sf):
    """(subject, number) pairs of every course, its own and those of its cross listings."""
    c = Catalog(spark, sf)
    return identity_pairs(c.courses, c.cross_listings, ["term_code", "course_id"])


def external_aliases(spark, sf):
    """Subject aliases of external courses: the list, else the coded subjects, else the one subject."""
    p = Catalog(spark, sf).t("part").selectExpr(
        "p_partkey as external_id", "case when p_size > 30 then split(p_name, ' ') end as subjectAliases",
        "case when p_size > 10 then array(named_struct('code', p_type, 'abbreviation', case when p_size > 20 then p_brand end)) end as subjects",
        "p_brand as subject",
    )
    return subject_aliases(p)


def rule_views(spark, sf):
    """Rules and their summaries joined to the course names."""
    c = Catalog(spark, sf)
    rules = c.courses.selectExpr(
        "concat_ws(':', 'rule', term_code, course_id) as rule_id", "term_code", "course_id",
        "case when subject_code = 'BUILDING' then 'parsed' else 'partial' end as parse_status", "0.5D as parse_confidence",
        "description as raw_text", "title as unparsed_text",
    )
    summaries = rules.selectExpr(
        "rule_id", "term_code", "course_id", "'opaque' as summary_status", "'[]' as course_groups_json", "'[]' as escape_clauses_json"
    )
    one = rm.rule_overview(rules, c.courses).select("rule_id", "course_designation", "parse_status", F.lit("rule").alias("view"))
    two = rm.summary_overview(summaries, rules, c.courses).select("rule_id", "course_designation", "parse_status", F.lit("summary").alias("view"))
    return one.unionByName(two)


def snapshot_completeness(spark, sf):
    """Lines collected per order against a reported number."""
    c = Catalog(spark, sf)
    reported = c.t("orders").selectExpr("o_orderkey as l_orderkey", "cast(o_orderkey % 7 + 1 as bigint) as expected")
    done = quality.completeness(c.t("lineitem"), reported, ["l_orderkey"], "expected")
    return done.withColumn("complete", F.col("complete").cast("int"))


QUERIES = {
    f.__name__: f
    for f in [
        latest_version_per_key, course_overview_rollup, cross_listing_overview, availability_view, schedule_planning_view,
        canonical_sections_view, canonical_meetings_model, meeting_day_rollup, package_text_rollup, schedulable_packages_model,
        online_courses_view, entity_history, latest_refresh_weighted, pair_history, current_period_star, history_display,
        history_ranked, topn_filtered_group, cond_sum_by_type, distinct_projection, anti_no_rule, orphan_drop, display_class,
        resolve_with_fallback, composite_key_split, source_title_lookup, quality_report, rule_check_report, snapshot_completeness, predicate_scan, version_priority, local_identity_pairs, external_aliases,
        rule_views,
    ]
}

_GPA = "CASE WHEN coalesce(sum({w}), 0) = 0 THEN NULL ELSE round(sum({x} * {w}) / sum({w}), 9) END"

_PAIRS = """
SELECT history_course_id, history_instructor_id, count(*) prior_offering_count, CAST(sum(student_count) AS BIGINT) student_count,
  CASE WHEN sum(student_count) = 0 THEN NULL ELSE sum(avg_gpa * student_count) / sum(student_count) END same_course_gpa
FROM offerings GROUP BY 1, 2"""

_COURSE_GPA = """
SELECT history_course_id, CASE WHEN sum(student_count) = 0 THEN NULL ELSE sum(avg_gpa * student_count) / sum(student_count) END historical_gpa
FROM (SELECT *, row_number() OVER (PARTITION BY history_course_id, term_code ORDER BY refresh_run_id DESC, course_grade_id DESC) rk FROM course_grades)
WHERE rk = 1 GROUP BY 1"""

_CURRENT = f"""
SELECT s.term_code, s.course_id, s.section_class_number, s.section_number, s.section_type, i.instructor_key, s.course_designation,
  nullif(trim(coalesce(i.first_name || ' ', '') || coalesce(i.last_name, '')), '') instructor_display_name,
  h.prior_offering_count same_course_prior_offering_count, h.student_count same_course_student_count, round(h.same_course_gpa, 9) same_course_gpa,
  round(g.historical_gpa, 9) course_historical_gpa, im.match_status instructor_match_status
FROM section_overview s
JOIN section_instructors si ON si.package_id = s.source_package_id AND si.section_class_number = s.section_class_number
JOIN instructors i ON i.instructor_key = si.instructor_key
LEFT JOIN course_matches cm ON cm.term_code = s.term_code AND cm.course_id = s.course_id
LEFT JOIN instructor_matches im ON im.instructor_key = si.instructor_key
LEFT JOIN ({_PAIRS}) h ON h.history_course_id = cm.history_course_id AND h.history_instructor_id = im.history_instructor_id
LEFT JOIN ({_COURSE_GPA}) g ON g.history_course_id = cm.history_course_id
WHERE s.term_code = (SELECT max(source_term_code) FROM refresh_runs)"""

_ROLLUP = """
SELECT package_id, count(*) FILTER (meeting_type = 'CLASS') meeting_count,
  CAST(coalesce(bit_count(bit_or(days_mask) FILTER (meeting_type = 'CLASS' AND days_mask IS NOT NULL AND is_online <> 1)), 0) AS INT) campus_day_count,
  min(start_minute_local) FILTER (meeting_type = 'CLASS' AND days_mask IS NOT NULL) earliest_start_minute_local,
  max(end_minute_local) FILTER (meeting_type = 'CLASS' AND days_mask IS NOT NULL) latest_end_minute_local,
  coalesce(max(CASE WHEN meeting_type = 'CLASS' THEN is_online END), 0) has_online_meeting,
  coalesce(max(CASE WHEN meeting_type = 'CLASS' THEN CASE WHEN is_online <> 1 AND location_known <> 1 THEN 1 ELSE 0 END END), 0) has_unknown_location
FROM canonical_meetings GROUP BY 1"""


def _clock(x: str) -> str:
    hour = f"({x} // 60)"
    return (
        f"CAST(CASE WHEN {hour} % 12 = 0 THEN 12 ELSE {hour} % 12 END AS VARCHAR) || ':' || "
        f"lpad(CAST({x} % 60 AS VARCHAR), 2, '0') || CASE WHEN {hour} >= 12 THEN ' PM' ELSE ' AM' END"
    )


_SUMMARY = f"""
SELECT package_id, string_agg(meeting_days || ' ' || {_clock('start_minute_local')} || '-' || {_clock('end_minute_local')} ||
  CASE WHEN is_online = 1 THEN ' Online' WHEN building_name IS NOT NULL THEN ' @ ' || building_name ELSE ' @ ' || room END,
  '; ' ORDER BY meeting_index, section_class_number) meeting_summary_local
FROM canonical_meetings WHERE meeting_type = 'CLASS' AND days_mask IS NOT NULL GROUP BY 1"""

ORACLES = {
    "latest_version_per_key": oracle("SELECT * FROM section_overview"),
    "course_overview_rollup": oracle("SELECT * FROM course_overview"),
    "cross_listing_overview": oracle(
        """SELECT l.term_code, l.course_id, c.course_designation canonical_course_designation, l.course_designation alias_course_designation,
        l.full_course_designation, l.subject_code, l.catalog_number, c.title, l.is_primary
        FROM course_cross_listings l JOIN courses c ON c.term_code = l.term_code AND c.course_id = l.course_id"""
    ),
    "availability_view": oracle(
        """SELECT p.term_code, c.subject_code, c.catalog_number, c.course_designation, c.title, p.package_id, p.package_status,
        p.package_available_seats, p.package_waitlist_total, p.open_seats, p.waitlist_current_size, p.has_open_seats, p.has_waitlist, p.is_full,
        p.online_only, p.is_asynchronous FROM packages p JOIN courses c ON c.term_code = p.term_code AND c.course_id = p.course_id"""
    ),
    "schedule_planning_view": oracle(
        """SELECT s.term_code, s.subject_code, s.catalog_number, s.course_id, s.course_designation, s.title, s.section_class_number,
        s.source_package_id, s.source_package_last_updated, s.section_number, s.section_type, s.instruction_mode, m.meeting_index, m.meeting_type,
        m.meeting_days, m.meeting_time_start, m.meeting_time_end, m.start_date, m.end_date, m.exam_date, m.room, m.building_code,
        b.building_name, b.street_address, m.location_known, s.has_open_seats, s.is_full
        FROM section_overview s JOIN meetings m ON m.package_id = s.source_package_id AND m.section_class_number = s.section_class_number
        LEFT JOIN buildings b ON b.building_code = m.building_code"""
    ),
    "canonical_sections_view": oracle(
        """SELECT s.*, c.minimum_credits, c.maximum_credits FROM section_overview s
        JOIN courses c ON c.term_code = s.term_code AND c.course_id = s.course_id"""
    ),
    "canonical_meetings_model": oracle("SELECT * EXCLUDE (latitude, longitude) FROM canonical_meetings"),
    "meeting_day_rollup": oracle(_ROLLUP),
    "package_text_rollup": oracle(_SUMMARY),
    "schedulable_packages_model": oracle(
        f"""SELECT p.package_id source_package_id, p.term_code, p.course_id, c.course_designation, c.title,
        CASE WHEN p.package_status = 'O' THEN p.subject_code || ' bundle' ELSE c.course_designation || ' package' END section_bundle_label,
        p.open_seats, p.is_full, p.has_waitlist, coalesce(r.meeting_count, 0) meeting_count, coalesce(r.campus_day_count, 0) campus_day_count,
        r.earliest_start_minute_local, r.latest_end_minute_local, coalesce(r.has_online_meeting, 0) has_online_meeting,
        coalesce(r.has_unknown_location, 0) has_unknown_location,
        CASE WHEN p.package_status = 'O' THEN 'Restriction will be removed on May 3 ' || o.o_orderpriority END restriction_note,
        CASE WHEN p.package_status = 'O' THEN 1 ELSE 0 END has_temporary_restriction, coalesce(m.meeting_summary_local, '') meeting_summary_local
        FROM packages p JOIN placed_orders o ON o.package_id = p.package_id
        JOIN courses c ON c.term_code = p.term_code AND c.course_id = p.course_id
        LEFT JOIN ({_ROLLUP}) r ON r.package_id = p.package_id LEFT JOIN ({_SUMMARY}) m ON m.package_id = p.package_id"""
    ),
    "online_courses_view": oracle(
        """, fresh AS (SELECT term_code, course_id, max(coalesce(package_last_updated, -1)) f FROM packages GROUP BY 1, 2)
        SELECT DISTINCT c.term_code, c.course_id, c.subject_code, c.catalog_number, c.course_designation, c.title, c.minimum_credits, c.maximum_credits
        FROM courses c JOIN fresh ON fresh.term_code = c.term_code AND fresh.course_id = c.course_id
        JOIN packages p ON p.term_code = c.term_code AND p.course_id = c.course_id AND coalesce(p.package_last_updated, -1) = fresh.f
        WHERE p.online_only = 1 OR p.is_asynchronous = 1"""
    ),
    "entity_history": oracle(
        f"""SELECT h.*, count(g.course_grade_id) course_grade_term_count, CAST(coalesce(sum(g.student_count), 0) AS BIGINT) historical_student_count,
        {_GPA.format(x='g.avg_gpa', w='g.student_count')} historical_gpa
        FROM history_courses h LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY history_course_id, term_code
          ORDER BY refresh_run_id DESC, course_grade_id DESC) rk FROM course_grades) g ON g.history_course_id = h.history_course_id AND g.rk = 1
        GROUP BY ALL"""
    ),
    "latest_refresh_weighted": oracle(
        f"""SELECT h.*, count(g.instructor_grade_id) instructor_grade_term_count, CAST(coalesce(sum(g.student_count), 0) AS BIGINT) historical_student_count,
        {_GPA.format(x='g.avg_gpa', w='g.student_count')} overall_gpa
        FROM history_instructors h LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY history_instructor_id, term_code
          ORDER BY refresh_run_id DESC, instructor_grade_id DESC) rk FROM instructor_grades) g
          ON g.history_instructor_id = h.history_instructor_id AND g.rk = 1
        GROUP BY ALL"""
    ),
    "pair_history": oracle(
        f"""SELECT p.history_course_id, p.history_instructor_id, p.prior_offering_count, p.student_count, round(p.same_course_gpa, 9) same_course_gpa,
        c.course_designation, i.display_name instructor_display_name
        FROM ({_PAIRS}) p JOIN history_courses c ON c.history_course_id = p.history_course_id
        JOIN history_instructors i ON i.history_instructor_id = p.history_instructor_id"""
    ),
    "current_period_star": oracle(_CURRENT),
    "history_display": oracle(
        f"""SELECT course_id, section_type, section_number, instructor_display_name, same_course_prior_offering_count prior_offering_count,
        same_course_student_count student_count, instructor_key FROM (
          SELECT *, row_number() OVER (PARTITION BY course_id, section_type, section_number, coalesce(instructor_display_name, 'unknown')
            ORDER BY coalesce(same_course_prior_offering_count, -1) DESC, coalesce(same_course_student_count, -1) DESC, section_type NULLS FIRST,
            section_number NULLS FIRST, section_class_number, instructor_key) rk
          FROM (SELECT *, max(CASE WHEN section_type = 'LEC' THEN 1 ELSE 0 END) OVER (PARTITION BY course_id) lec FROM ({_CURRENT}))
          WHERE lec = 0 OR section_type = 'LEC') WHERE rk = 1"""
    ),
    "history_ranked": oracle(
        f"""SELECT history_instructor_id, rank, history_course_id, prior_offering_count, student_count FROM (
        SELECT p.*, row_number() OVER (PARTITION BY history_instructor_id ORDER BY prior_offering_count DESC, student_count DESC, history_course_id) rank
        FROM ({_PAIRS}) p) WHERE rank <= 3"""
    ),
    "topn_filtered_group": oracle(
        """SELECT course_designation, count(*) waitlisted_sections FROM section_overview WHERE is_full = 1 AND has_waitlist = 1
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""
    ),
    "cond_sum_by_type": oracle(
        """SELECT section_type, count(*) section_count, CAST(sum(has_open_seats) AS BIGINT) sections_with_open_seats FROM section_overview GROUP BY 1"""
    ),
    "distinct_projection": oracle(
        """SELECT DISTINCT si.instructor_key, c.course_designation, c.title FROM section_instructors si
        JOIN sections s ON s.package_id = si.package_id AND s.section_class_number = si.section_class_number
        JOIN courses c ON c.term_code = s.term_code AND c.course_id = s.course_id"""
    ),
    "anti_no_rule": oracle(
        """SELECT c.term_code, c.course_id, c.course_designation FROM courses c LEFT JOIN (SELECT DISTINCT term_code, course_id FROM section_overview
        WHERE is_full = 1) f ON f.term_code = c.term_code AND f.course_id = c.course_id WHERE f.course_id IS NULL"""
    ),
    "orphan_drop": oracle(
        """SELECT term_code, course_id, history_course_id link FROM course_matches
        WHERE history_course_id IS NULL OR history_course_id IN (SELECT c_custkey FROM people WHERE c_acctbal > 3000)"""
    ),
    "display_class": oracle(
        """SELECT s.term_code, s.course_id, s.section_class_number,
        CASE WHEN s.has_open_seats = 1 THEN 'Open' WHEN s.has_waitlist = 1 THEN 'Waitlist' WHEN s.is_full = 1 THEN 'Full' ELSE 'Unknown' END seat_state,
        CASE WHEN s.is_full = 1 THEN 'Full' WHEN s.open_seats IS NOT NULL THEN CAST(s.open_seats AS VARCHAR) || ' open seats'
          ELSE 'Seat availability unavailable' END bundle_text,
        CASE WHEN c.minimum_credits = c.maximum_credits THEN CAST(CAST(c.minimum_credits AS INT) AS VARCHAR) || ' credits'
          ELSE CAST(CAST(c.minimum_credits AS INT) AS VARCHAR) || '-' || CAST(CAST(c.maximum_credits AS INT) AS VARCHAR) || ' credits' END credit_text,
        CASE WHEN c.has_any_open_seats = 1 THEN 'Open seats available' WHEN c.has_any_full_section = 1 THEN 'Some sections are full'
          ELSE 'Seat status unavailable' END course_text
        FROM section_overview s JOIN course_overview c ON c.term_code = s.term_code AND c.course_id = s.course_id"""
    ),
    "resolve_with_fallback": oracle(
        """, wanted AS (SELECT DISTINCT course_designation FROM course_cross_listings),
        canonical AS (SELECT course_designation, term_code, course_id FROM (SELECT *, row_number() OVER (PARTITION BY course_designation
          ORDER BY coalesce(section_count, 0) DESC, coalesce(has_any_open_seats, 0) DESC, coalesce(has_any_full_section, 0) DESC, title, course_id, term_code) rk
          FROM course_overview) WHERE rk = 1)
        SELECT w.course_designation, c.term_code, c.course_id, 'canonical' resolved_by FROM wanted w JOIN canonical c ON c.course_designation = w.course_designation
        UNION ALL
        SELECT course_designation, term_code, course_id, 'alias' FROM (SELECT w.course_designation, l.term_code, l.course_id,
          row_number() OVER (PARTITION BY w.course_designation ORDER BY l.is_primary DESC, k.course_designation, l.course_id, l.term_code) rk
          FROM wanted w JOIN course_cross_listings l ON l.course_designation = w.course_designation
          JOIN courses k ON k.term_code = l.term_code AND k.course_id = l.course_id
          WHERE w.course_designation NOT IN (SELECT course_designation FROM canonical)) WHERE rk = 1"""
    ),
    "composite_key_split": oracle(
        """SELECT package_id, split_part(package_id, ':', 1) part_0, split_part(package_id, ':', 2) part_1, split_part(package_id, ':', 3) part_2,
        split_part(package_id, ':', 4) part_3, CAST(NULL AS VARCHAR) part_4 FROM packages"""
    ),
    "source_title_lookup": oracle(
        """SELECT s.term_code, s.course_id, s.section_class_number,
        CASE WHEN c.title <> 'Studies ' || CAST(s.section_class_number AS VARCHAR) THEN c.title END section_title
        FROM section_overview s LEFT JOIN courses c ON c.term_code = s.term_code AND c.course_id = split_part(s.source_package_id, ':', 3)"""
    ),
    "quality_report": oracle(
        """SELECT 'duplicate_line_keys' "check", count(*) violations FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
        UNION ALL SELECT 'duplicate_order_keys', count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
        UNION ALL SELECT 'lines_without_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
        UNION ALL SELECT 'surplus_primaries', count(*) FROM (SELECT 1 FROM course_cross_listings GROUP BY term_code, course_id HAVING sum(is_primary) > 1)
        UNION ALL SELECT 'negative_balances', count(*) FROM customer WHERE c_acctbal < 0"""
    ),
    "rule_check_report": oracle(
        """SELECT 'open_seats_not_negative' "rule", count(*) FILTER (open_seats < 0) violations FROM sections
        UNION ALL SELECT 'type_known', count(*) FILTER (section_type NOT IN ('LEC', 'DIS')) FROM sections
        UNION ALL SELECT 'enrolled_within_capacity', count(*) FILTER (currently_enrolled > capacity) FROM sections"""
    ),
    "predicate_scan": """SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE (o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '3-%')
        AND o_orderstatus IN ('O', 'F') AND o_custkey NOT IN (1, 2, 3) AND o_totalprice BETWEEN 1000 AND 400000 AND o_orderdate IS NOT NULL AND o_orderkey <> o_custkey""",
    "version_priority": """SELECT l_partkey, updated, filled, t AS "text" FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY updated DESC, filled DESC, t DESC) rk
        FROM (SELECT l_partkey, updated, n + CAST(n > 0 AS INT) filled, t FROM (SELECT *, a + b + c + CAST(b + c > 0 AS INT) + a + c + CAST(a + c > 0 AS INT) n
        FROM (SELECT l_partkey, CAST(year(l_shipdate) AS INT) updated, CAST((l_returnflag = 'A') AS INT) a, CAST((l_linestatus = 'O') AS INT) b, CAST((l_discount > 0.05) AS INT) c,
          lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || '/' || CAST(l_linenumber AS VARCHAR) t FROM lineitem)))) WHERE rk = 1""",
    "local_identity_pairs": oracle(
        """SELECT term_code, course_id, subject_code subject, catalog_number number FROM courses
        UNION SELECT term_code, course_id, subject_code, catalog_number FROM course_cross_listings"""
    ),
    "external_aliases": """SELECT DISTINCT p_partkey external_id, s subject FROM (
        SELECT p_partkey, unnest(string_split(p_name, ' ')) s FROM part WHERE p_size > 30
        UNION ALL SELECT p_partkey, unnest(CASE WHEN p_size > 20 THEN [p_brand, p_type] ELSE [p_type] END) FROM part WHERE p_size BETWEEN 11 AND 30
        UNION ALL SELECT p_partkey, p_brand FROM part WHERE p_size <= 10)""",
    "rule_views": oracle(
        """SELECT 'rule:' || term_code || ':' || course_id rule_id, course_designation, CASE WHEN subject_code = 'BUILDING' THEN 'parsed' ELSE 'partial' END parse_status, v AS "view"
        FROM courses, (SELECT unnest(['rule', 'summary']) v)"""
    ),
    "snapshot_completeness": oracle(
        """SELECT o_orderkey l_orderkey, coalesce(n, 0) collected, CAST(o_orderkey % 7 + 1 AS BIGINT) reported,
        CASE WHEN coalesce(n, 0) = o_orderkey % 7 + 1 THEN 1 ELSE 0 END complete
        FROM orders LEFT JOIN (SELECT l_orderkey, count(*) n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""
    ),
}
