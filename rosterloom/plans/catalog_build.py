"""Snapshots to normalised tables and read models, end to end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterloom.functions.availability import full_flag, positive_flag, truthy_flag
from rosterloom.functions.text import composite_key, defined_values, key_part, squeeze
from rosterloom.operators import identity, merging, quality, requirements, rollups, search, versions
from rosterloom.plans import read_models as rm
from rosterloom.session import cut_lineage
from rosterloom.sources import catalog, snapshots

_STAGES = ["by_number", "by_identity", "by_type", "by_session"]


def _version_rank(records: DataFrame) -> DataFrame:
    """Copies of a package ranked: newest, then the one with more values, then by canonical text."""
    text = F.to_json("package")
    filled = defined_values(F.col("package"), records.schema["package"].dataType)
    order = [F.col("package.lastUpdated").desc_nulls_last(), filled.desc(), text.desc(), F.col("entry_index"), F.col("package_index")]
    return records.withColumn("version", F.row_number().over(Window.partitionBy("package_id").orderBy(*order)))


def _section_scope(class_known: bool) -> list[Column]:
    number, kind, session = key_part(F.col("section.sectionNumber")), key_part(F.col("section.type")), key_part(F.col("section.sessionCode"))
    scope = composite_key(key_part(F.col("term_code")), key_part(F.col("course_id")))
    free = F.col("class_number").isNull() if not class_known else F.lit(True)
    whole = F.when(free & number.isNotNull() & kind.isNotNull() & session.isNotNull(), composite_key(scope, number, kind, session))
    typed = F.when(free & number.isNotNull() & kind.isNotNull(), composite_key(scope, F.lit("t"), number, kind))
    timed = F.when(free & number.isNotNull() & session.isNotNull(), composite_key(scope, F.lit("s"), number, session))
    return [whole, typed, timed]


def _share_class_numbers(sections: DataFrame) -> DataFrame:
    """Real class numbers copied to sections of the same full identity that lack one."""
    identified = sections.withColumn("_identity", _section_scope(True)[0])
    return versions.fill_group_value(identified, ["_identity"], ["package_id", "version"], "class_number").drop("_identity")


def _merge_section_versions(sections: DataFrame, deepest: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sections, meetings, instructors) of the preferred copies, filled from older ones."""
    whole, typed, timed = _section_scope(False)
    keyed = sections.select(
        "*",
        F.col("class_number").cast("string").alias("by_number"),
        whole.alias("by_identity"),
        typed.alias("by_type"),
        timed.alias("by_session"),
    )
    s = F.col("section")
    fields = {
        "class_number": F.col("class_number"), "term_code": F.col("term_code"), "course_id": F.col("course_id"),
        "sectionNumber": s["sectionNumber"], "type": s["type"], "instructionMode": s["instructionMode"],
        "sessionCode": s["sessionCode"], "published": s["published"], "openSeats": s["enrollmentStatus"]["openSeats"],
        "waitlistCurrentSize": s["enrollmentStatus"]["waitlistCurrentSize"], "capacity": s["enrollmentStatus"]["capacity"],
        "currentlyEnrolled": s["enrollmentStatus"]["currentlyEnrolled"],
        "footnotes": F.when(F.size(s["footnotes"]) > 0, s["footnotes"]),
        "classMaterials": F.when(F.size(s["classMaterials"]) > 0, s["classMaterials"]),
    }
    flat = keyed.select("package_id", "version", "section_index", *_STAGES, *[v.alias(k) for k, v in fields.items()])
    meetings = keyed.select("package_id", "version", "section_index", F.posexplode("section.classMeetings").alias("at", "m"))
    meeting_fields = ["meetingType", "meetingTimeStart", "meetingTimeEnd", "meetingDays", "startDate", "endDate", "examDate", "room"]
    meetings = meetings.select(
        "package_id", "version", "section_index", F.col("at").cast("bigint").alias("at"), merging.meeting_key(F.col("m")).alias("meeting_key"),
        *[F.col("m")[f].alias(f) for f in meeting_fields], F.col("m.building").alias("building"),
    )
    people = catalog.instructor_records(keyed.withColumn("section_class_number", F.lit(0)).withColumn("package_id", F.struct("package_id", "version")))
    people = people.select("package_id.package_id", "package_id.version", "section_index", "instructor_index", "netid", "email", "first_name", "last_name")

    flat, meetings, people = cut_lineage(flat), cut_lineage(meetings), cut_lineage(people)
    scope = ["package_id"]
    best = flat.filter("version = 1").drop("version")
    best_meetings = meetings.filter("version = 1").drop("version")
    best_people = people.filter("version = 1")
    for version in range(2, deepest + 1):
        older = flat.filter(F.col("version") == version).drop("version")
        matches = cut_lineage(merging.cascade_match(best, older, scope, "section_index", _STAGES))
        merged = merging.enrich_matched(best, older, matches, scope, "section_index", list(fields))
        best = cut_lineage(merged.drop("source").join(best.select("package_id", "section_index", *_STAGES), ["package_id", "section_index"]))
        links = matches.select("package_id", F.col("fallback_position").alias("section_index"), "preferred_position")
        moved = (
            meetings.filter(F.col("version") == version)
            .join(links, ["package_id", "section_index"])
            .drop("version", "section_index")
            .withColumnRenamed("preferred_position", "section_index")
        )
        lists = merging.merge_keyed_lists(
            best_meetings, moved, ["package_id", "section_index"], "at", "meeting_key", [*meeting_fields, "building", "meeting_key"]
        )
        # A section's meetings are one short list; number them again behind the preferred ones.
        order = Window.partitionBy("package_id", "section_index").orderBy("source", "at")
        best_meetings = cut_lineage(lists.withColumn("at", (F.row_number().over(order) - 1).cast("bigint")).drop("source"))
        donors = people.filter(F.col("version") == version).join(links, ["package_id", "section_index"]).drop("section_index")
        best_people = best_people.unionByName(donors.withColumnRenamed("preferred_position", "section_index"))
    return best, best_meetings, best_people


def build_catalog(courses: DataFrame, package_snapshot: DataFrame, refreshed_at: str) -> dict[str, DataFrame]:
    """Every base table and read model.

    Base tables are materialised as they are made, as the tables they are: later ones read
    them several times and must not go back to the nested snapshot.
    """
    records = cut_lineage(_version_rank(catalog.package_records(package_snapshot)))
    deepest = records.agg(F.max("version").alias("v")).first()["v"] or 1
    packages = cut_lineage(_merge_packages(records))
    sections = _share_class_numbers(
        catalog.section_records(records.select("package_id", "term_code", "course_id", "package", "version").withColumn(
            "package_id", F.struct("package_id", "version")
        )).select("package_id.package_id", "package_id.version", "section_index", "class_number", "term_code", "course_id", "section")
    )
    best, best_meetings, best_people = _merge_section_versions(sections, deepest)
    seed = F.concat_ws(
        ":",
        F.coalesce(key_part(F.col("term_code")), F.lit("unknown-term")),
        F.coalesce(key_part(F.col("course_id")), F.lit("unknown-course")),
        F.coalesce(key_part(F.col("sectionNumber")), F.lit("unknown-section")),
        F.coalesce(key_part(F.col("type")), F.lit("unknown-type")),
        F.coalesce(key_part(F.col("sessionCode")), F.lit("unknown-session")),
    )
    numbered = cut_lineage(
        versions.synthetic_numbers(
            best.drop(*_STAGES).withColumn("seed", seed), "package_id", "section_index", "seed", "class_number", "section_class_number"
        )
    )
    section_table = _section_table(numbered)
    numbers = numbered.select("package_id", "section_index", "section_class_number")
    meeting_table = cut_lineage(_meeting_table(best_meetings.join(numbers, ["package_id", "section_index"])))

    # Courses: catalog rows, then those only the packages know.
    # The first catalog row of a course is the first one in the files, whatever tasks read it.
    if catalog.PLACE not in courses.columns:
        courses = cut_lineage(courses.withColumn(catalog.PLACE, catalog.place_in_input(F.lit(""), F.lit(0))))
    all_courses = merging.append_missing(courses, _as_catalog(catalog.synthesized_courses(records), courses), ["termCode", "courseId"])
    late = all_courses.withColumn("_late", F.col(catalog.PLACE).isNull())
    positioned = cut_lineage(versions.dense_ids(late, ["_late", catalog.PLACE, "termCode", "courseId"], "_position").drop("_late", catalog.PLACE))
    course_table = versions.first_wins(positioned, ["termCode", "courseId"], [F.col("_position")])
    course_rows = cut_lineage(catalog.course_rows(course_table))
    listings = cut_lineage(_cross_listings(positioned, catalog.entry_courses(records), course_rows))

    # Instructor fields are the last known ones in input order, so records are numbered by their place in it.
    places = records.select("package_id", "version", "entry_index", "package_index")
    people = best_people.join(numbers, ["package_id", "section_index"]).join(places, ["package_id", "version"])
    in_input = ["entry_index", "package_index", "section_index", "instructor_index", "package_id", "version"]
    ordered = cut_lineage(versions.dense_ids(people, in_input, "record_id"))
    aliases, instructors = identity.collapse_identities(ordered, "record_id")
    instructors = cut_lineage(instructors)
    section_instructors = (
        ordered.select("record_id", "package_id", "section_class_number")
        .join(aliases, "record_id")
        .select("package_id", "section_class_number", "instructor_key")
        .distinct()
    )
    buildings = merging.attribute_latest(
        meeting_table.filter("building_code <> ''").join(packages.select("package_id", "package_last_updated"), "package_id"),
        ["building_code"],
        ["building_name", "street_address", "latitude", "longitude"],
        "package_last_updated",
        "package_id",
    )
    stamps = [courses.select(F.col("lastUpdated")), packages.select("package_last_updated")]
    in_snapshot = F.struct("entry_index", "package_index")
    terms = [
        package_snapshot.select("termCode", F.lit(0)),
        positioned.select("termCode", "_position"),
        records.select("term_code", in_snapshot),
    ]
    tables = {
        "refresh_runs": snapshots.run_metadata(stamps, terms, refreshed_at),
        "courses": course_rows,
        "course_cross_listings": listings,
        "packages": packages,
        "sections": section_table,
        "meetings": meeting_table,
        "buildings": buildings,
        "instructors": instructors.select("instructor_key", "netid", "email", "first_name", "last_name"),
        "section_instructors": section_instructors,
        **requirements.rule_tables(course_rows),
    }
    quality.require_clean(constraints(tables))
    described = cut_lineage(_described(records, course_table, numbered))
    tables["course_search"] = search.build_corpus(listings, course_rows, rm.COURSE_KEY)
    return {**tables, **derive_read_models(tables, described)}


def constraints(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Violations of the keys and references of the base tables, by name; a load that has any is rejected."""
    section = ["package_id", "section_class_number"]
    keys = {
        "courses": rm.COURSE_KEY, "packages": ["package_id"], "sections": section, "meetings": [*section, "meeting_index"],
        "buildings": ["building_code"], "instructors": ["instructor_key"], "section_instructors": [*section, "instructor_key"],
        "course_cross_listings": [*rm.COURSE_KEY, "course_designation"], "prerequisite_rules": ["rule_id"],
    }
    references = [
        ("course_cross_listings", "courses", rm.COURSE_KEY), ("sections", "packages", ["package_id"]), ("meetings", "sections", section),
        ("section_instructors", "sections", section), ("section_instructors", "instructors", ["instructor_key"]),
        ("prerequisite_rules", "courses", rm.COURSE_KEY),
    ]
    checks = {f"{name}: repeated key": quality.duplicate_keys(tables[name], key) for name, key in keys.items()}
    checks["course_cross_listings: more than one primary"] = quality.surplus_primaries(tables["course_cross_listings"], rm.COURSE_KEY, "is_primary")
    for child, parent, on in references:
        checks[f"{child}: unknown {parent}"] = quality.orphans(tables[child], tables[parent], {c: c for c in on})
    return checks


def derive_read_models(tables: dict[str, DataFrame], described: DataFrame) -> dict[str, DataFrame]:
    sections_v = cut_lineage(rm.section_overview(tables["sections"], tables["packages"], tables["courses"]))
    canonical = rm.canonical_sections(sections_v, tables["courses"])
    meetings = cut_lineage(rm.canonical_meetings(canonical, tables["sections"], tables["meetings"], tables["buildings"]))
    schedulable = rm.schedulable_packages(tables["packages"], tables["courses"], meetings, described)
    return {
        "section_overview_v": sections_v,
        "course_overview_v": rm.course_overview(tables["courses"], sections_v, tables["course_cross_listings"]),
        "course_cross_listing_overview_v": rm.cross_listing_overview(tables["course_cross_listings"], tables["courses"]),
        "prerequisite_rule_overview_v": rm.rule_overview(tables["prerequisite_rules"], tables["courses"]),
        "prerequisite_course_summary_overview_v": rm.summary_overview(
            tables["prerequisite_course_summaries"], tables["prerequisite_rules"], tables["courses"]
        ),
        "availability_v": rm.availability(tables["packages"], tables["courses"]),
        "schedule_planning_v": rm.schedule_planning(sections_v, tables["meetings"], tables["buildings"]),
        "online_courses_v": rm.online_courses(tables["courses"], tables["packages"]),
        "canonical_sections": canonical,
        "canonical_meetings": meetings,
        "schedulable_packages": schedulable,
        "schedule_candidates_v": schedulable,
    }


def build_from_files(spark: SparkSession, courses_path: str, packages_path: str, refreshed_at: str) -> dict[str, DataFrame]:
    return build_catalog(
        catalog.read_courses(spark, courses_path), catalog.read_package_snapshot(spark, packages_path), refreshed_at
    )


def _merge_packages(records: DataFrame) -> DataFrame:
    leaves = [
        "term_code", "subject_code", "course_id", "package_last_updated", "enrollment_class_number", "package_status",
        "package_available_seats", "package_waitlist_total", "open_seats", "waitlist_current_size", "capacity", "currently_enrolled",
    ]
    p = F.col("package")
    status = p["enrollmentStatus"]
    flat = records.select(
        "package_id", "version", "term_code", "subject_code", "course_id",
        p["lastUpdated"].alias("package_last_updated"),
        p["enrollmentClassNumber"].alias("enrollment_class_number"),
        p["packageEnrollmentStatus"]["status"].alias("package_status"),
        p["packageEnrollmentStatus"]["availableSeats"].alias("package_available_seats"),
        p["packageEnrollmentStatus"]["waitlistTotal"].alias("package_waitlist_total"),
        status["openSeats"].alias("open_seats"),
        status["waitlistCurrentSize"].alias("waitlist_current_size"),
        status["capacity"].alias("capacity"),
        status["currentlyEnrolled"].alias("currently_enrolled"),
        p["onlineOnly"].alias("online_only"),
        p["isAsynchronous"].alias("is_asynchronous"),
    )
    merged = merging.coalesce_versions(flat, ["package_id"], [-F.col("version")], [*leaves, "online_only", "is_asynchronous"])
    return merged.select(
        "package_id",
        *leaves,
        truthy_flag(F.col("online_only")).alias("online_only"),
        truthy_flag(F.col("is_asynchronous")).alias("is_asynchronous"),
        positive_flag(F.col("open_seats")).alias("has_open_seats"),
        positive_flag(F.col("waitlist_current_size")).alias("has_waitlist"),
        full_flag(F.col("open_seats")).alias("is_full"),
    )


def _section_table(numbered: DataFrame) -> DataFrame:
    return numbered.select(
        "package_id",
        "section_class_number",
        "term_code",
        "course_id",
        F.col("sectionNumber").alias("section_number"),
        F.col("type").alias("section_type"),
        F.col("instructionMode").alias("instruction_mode"),
        F.col("sessionCode").alias("session_code"),
        truthy_flag(F.col("published")).alias("published"),
        F.col("openSeats").alias("open_seats"),
        F.col("waitlistCurrentSize").alias("waitlist_current_size"),
        "capacity",
        F.col("currentlyEnrolled").alias("currently_enrolled"),
        positive_flag(F.col("openSeats")).alias("has_open_seats"),
        positive_flag(F.col("waitlistCurrentSize")).alias("has_waitlist"),
        full_flag(F.col("openSeats")).alias("is_full"),
    )


def _meeting_table(m: DataFrame) -> DataFrame:
    place = F.col("building")
    return m.select(
        "package_id",
        "section_class_number",
        F.col("at").cast("int").alias("meeting_index"),
        F.col("meetingType").alias("meeting_type"),
        F.col("meetingTimeStart").alias("meeting_time_start"),
        F.col("meetingTimeEnd").alias("meeting_time_end"),
        F.col("meetingDays").alias("meeting_days"),
        F.col("startDate").alias("start_date"),
        F.col("endDate").alias("end_date"),
        F.col("examDate").alias("exam_date"),
        "room",
        place["buildingCode"].alias("building_code"),
        place["buildingName"].alias("building_name"),
        place["streetAddress"].alias("street_address"),
        place["latitude"].alias("latitude"),
        place["longitude"].alias("longitude"),
        F.coalesce((F.col("meetingType") == "EXAM").cast("int"), F.lit(0)).alias("is_exam"),
        F.coalesce(place["latitude"].isNotNull() & place["longitude"].isNotNull(), F.lit(False)).cast("int").alias("location_known"),
    )


def _as_catalog(synth: DataFrame, courses: DataFrame) -> DataFrame:
    """Synthesised courses in the column shape of the catalog snapshot."""
    subject = F.struct(
        F.col("subject.subjectCode").alias("subjectCode"),
        F.col("subject.shortDescription").alias("shortDescription"),
        F.col("subject.description").alias("description"),
        F.lit(None).cast("array<string>").alias("footnotes"),
    )
    shaped = synth.withColumn("subject", subject).withColumn("lastUpdated", F.lit(None).cast("bigint"))
    return shaped.withColumn(catalog.PLACE, F.lit(None).cast(courses.schema[catalog.PLACE].dataType)).select(*courses.columns)


def _cross_listings(positioned: DataFrame, entries: DataFrame, course_rows: DataFrame) -> DataFrame:
    """Designations of a course from the catalog and, behind them, from every package entry."""
    own = course_rows.select(*rm.COURSE_KEY, squeeze(F.col("course_designation")).alias("_own"))

    def listed(df: DataFrame, source: int, position: str) -> DataFrame:
        return df.select(
            F.col("termCode").alias("term_code"),
            F.col("courseId").alias("course_id"),
            squeeze(F.col("courseDesignation")).alias("course_designation"),
            F.col("fullCourseDesignation").alias("full_course_designation"),
            F.col("subject.subjectCode").alias("subject_code"),
            F.col("catalogNumber").alias("catalog_number"),
            F.struct(F.lit(source).alias("source"), F.col(position).cast("long").alias("at")).alias("_position"),
        )

    rows = listed(positioned, 0, "_position").unionByName(listed(entries, 1, "entry_index"))
    rows = rows.filter("course_designation IS NOT NULL")
    flagged = rows.join(own, rm.COURSE_KEY, "left").withColumn(
        "is_primary", F.coalesce((F.col("course_designation") == F.col("_own")).cast("int"), F.lit(0))
    )
    return merging.elect_primary(
        flagged, rm.COURSE_KEY, "course_designation", "_position",
        ["full_course_designation", "subject_code", "catalog_number"], "is_primary",
    )


def _described(records: DataFrame, courses: DataFrame, sections: DataFrame) -> DataFrame:
    """Bundle label and restriction note per package, from the nested record and its course."""
    best = records.filter("version = 1").select("package_id", "term_code", "course_id", "subject_code", "package")
    course = courses.select(
        F.col("termCode").alias("term_code"),
        F.col("courseId").alias("course_id"),
        "courseDesignation",
        "enrollmentPrerequisites",
        F.col("subject.footnotes").alias("_footnotes"),
    )
    listed = sections.groupBy("package_id").agg(
        F.collect_list(
            F.struct(F.col("type").alias("section_type"), F.col("sectionNumber").alias("section_number"), F.col("class_number").alias("class_number"))
        ).alias("_sections"),
        F.array_sort(F.collect_list(F.struct("section_index", "footnotes", "classMaterials"))).alias("_notes"),
    )
    joined = best.join(course, rm.COURSE_KEY, "left").join(listed, "package_id", "left")
    p = F.col("package")
    empty = F.array().cast("array<string>")
    no_materials = F.lit(None).cast("array<string>")

    def section_notes(n: Column) -> Column:
        materials = F.transform(n["classMaterials"], lambda m: m["sectionNotes"])
        return F.concat(F.coalesce(n["footnotes"], empty), F.coalesce(materials, no_materials, empty))

    details = p["instructorProvidedClassDetails"]
    note = rollups.distinct_notes(
        F.array("enrollmentPrerequisites"),
        F.col("_footnotes"),
        F.transform(p["enrollmentRequirementGroups"]["catalogRequirementGroups"], lambda g: g["description"]),
        F.transform(p["enrollmentRequirementGroups"]["classAssociationRequirementGroups"], lambda g: g["description"]),
        F.flatten(F.transform("_notes", section_notes)),
        F.array(details["instructorDescription"], details["typicalTopicsAndOrSchedule"], details["format"]),
    )
    fallback = F.trim(F.concat(F.coalesce("subject_code", F.lit("")), F.lit(" "), F.coalesce("course_id", F.lit(""))))
    label = rollups.bundle_label(F.coalesce("courseDesignation", fallback), F.col("_sections"))
    return joined.select("package_id", label.alias("section_bundle_label"), note.alias("restriction_note"))
