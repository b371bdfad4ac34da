"""Nested catalog and package snapshots to flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.functions.availability import full_flag, positive_flag, truthy_flag
from rosterloom.functions.text import composite_key
from rosterloom.sources import schemas


def read_courses(spark: SparkSession, path: str) -> DataFrame:
    """Catalog snapshot: a JSON array, or one course per line (splittable, the form to use at scale)."""
    rows = spark.read.schema(schemas.CATALOG_COURSE).json(path, multiLine=not path.endswith("l"))
    return rows.withColumn(PLACE, place_in_input(F.col("_metadata.file_path"), F.col("_metadata.file_block_start")))


PLACE = "_place"


def place_in_input(file: Column, block: Column) -> Column:
    """Order of rows in their files: a task numbers its rows in the order in which it reads a block."""
    return F.struct(file.alias("file"), block.cast("long").alias("block"), F.monotonically_increasing_id().alias("row"))


def read_package_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PACKAGE_SNAPSHOT).json(path, multiLine=not path.endswith("l"))


def course_rows(courses: DataFrame) -> DataFrame:
    return courses.select(
        F.col("termCode").alias("term_code"),
        F.col("courseId").alias("course_id"),
        F.col("subject.subjectCode").alias("subject_code"),
        F.col("subject.shortDescription").alias("subject_short_description"),
        F.col("subject.description").alias("subject_description"),
        F.col("catalogNumber").alias("catalog_number"),
        F.col("courseDesignation").alias("course_designation"),
        "title",
        "description",
        F.col("minimumCredits").alias("minimum_credits"),
        F.col("maximumCredits").alias("maximum_credits"),
        F.col("enrollmentPrerequisites").alias("enrollment_prerequisites"),
        truthy_flag(F.col("currentlyTaught")).alias("currently_taught"),
        F.col("lastTaught").alias("last_taught"),
    )


def package_records(snapshot: DataFrame) -> DataFrame:
    """One row per package with its derived id and inherited term, subject and course."""
    entries = snapshot.select(F.col("termCode").alias("_term"), F.posexplode("results").alias("entry_index", "entry"))
    packages = entries.select("_term", "entry_index", F.col("entry.course").alias("c"), F.posexplode("entry.packages").alias("package_index", "p"))
    which = F.coalesce(
        F.col("p.id"),
        F.col("p.enrollmentClassNumber").cast("string"),
        F.col("p.sequenceNumber"),
        F.col("p.docId"),
        F.concat_ws("-", "entry_index", "package_index"),
    )
    key = composite_key(
        F.coalesce("c.termCode", "p.termCode", F.lit("unknown-term")),
        F.coalesce("c.subjectCode", "p.subjectCode", F.lit("unknown-subject")),
        F.coalesce("c.courseId", "p.courseId", F.lit("unknown-course")),
        which,
    )
    return packages.select(
        key.alias("package_id"),
        F.coalesce("p.termCode", "c.termCode", "_term").alias("term_code"),
        F.coalesce("p.subjectCode", "c.subjectCode").alias("subject_code"),
        F.coalesce("p.courseId", "c.courseId").alias("course_id"),
        "entry_index",
        "package_index",
        F.col("c").alias("course"),
        F.col("p").alias("package"),
    )


def package_rows(records: DataFrame) -> DataFrame:
    status = F.col("package.enrollmentStatus")
    return records.select(
        "package_id",
        "term_code",
        "subject_code",
        "course_id",
        F.col("package.lastUpdated").alias("package_last_updated"),
        F.col("package.enrollmentClassNumber").alias("enrollment_class_number"),
        F.col("package.packageEnrollmentStatus.status").alias("package_status"),
        F.col("package.packageEnrollmentStatus.availableSeats").alias("package_available_seats"),
        F.col("package.packageEnrollmentStatus.waitlistTotal").alias("package_waitlist_total"),
        truthy_flag(F.col("package.onlineOnly")).alias("online_only"),
        truthy_flag(F.col("package.isAsynchronous")).alias("is_asynchronous"),
        *_status_columns(status),
    )


def _status_columns(status: Column) -> list[Column]:
    return [
        status["openSeats"].alias("open_seats"),
        status["waitlistCurrentSize"].alias("waitlist_current_size"),
        status["capacity"].alias("capacity"),
        status["currentlyEnrolled"].alias("currently_enrolled"),
        positive_flag(status["openSeats"]).alias("has_open_seats"),
        positive_flag(status["waitlistCurrentSize"]).alias("has_waitlist"),
        full_flag(status["openSeats"]).alias("is_full"),
    ]


def section_records(records: DataFrame) -> DataFrame:
    """One row per section with its position, real class number and the nested rest."""
    exploded = records.select(
        "package_id", "term_code", "course_id", F.posexplode("package.sections").alias("section_index", "section")
    )
    return exploded.select(
        "package_id",
        "section_index",
        F.col("section.classUniqueId.classNumber").alias("class_number"),
        F.coalesce("section.classUniqueId.termCode", "term_code").alias("term_code"),
        F.coalesce("section.courseId", "course_id").alias("course_id"),
        "section",
    )


def section_rows(numbered: DataFrame) -> DataFrame:
    """Flat sections; ``numbered`` carries ``section_class_number``."""
    return numbered.select(
        "package_id",
        "section_class_number",
        "term_code",
        "course_id",
        F.col("section.sectionNumber").alias("section_number"),
        F.col("section.type").alias("section_type"),
        F.col("section.instructionMode").alias("instruction_mode"),
        F.col("section.sessionCode").alias("session_code"),
        truthy_flag(F.col("section.published")).alias("published"),
        *_status_columns(F.col("section.enrollmentStatus")),
    )


def meeting_rows(numbered: DataFrame) -> DataFrame:
    """Flat meetings with their array position as ``meeting_index``."""
    m = numbered.select("package_id", "section_class_number", F.posexplode("section.classMeetings").alias("meeting_index", "m"))
    place = F.col("m.building")
    return m.select(
        "package_id",
        "section_class_number",
        "meeting_index",
        F.col("m.meetingType").alias("meeting_type"),
        F.col("m.meetingTimeStart").alias("meeting_time_start"),
        F.col("m.meetingTimeEnd").alias("meeting_time_end"),
        F.col("m.meetingDays").alias("meeting_days"),
        F.col("m.startDate").alias("start_date"),
        F.col("m.endDate").alias("end_date"),
        F.col("m.examDate").alias("exam_date"),
        F.col("m.room").alias("room"),
        place["buildingCode"].alias("building_code"),
        place["buildingName"].alias("building_name"),
        place["streetAddress"].alias("street_address"),
        place["latitude"].alias("latitude"),
        place["longitude"].alias("longitude"),
        F.coalesce((F.col("m.meetingType") == "EXAM").cast("int"), F.lit(0)).alias("is_exam"),
        (place["latitude"].isNotNull() & place["longitude"].isNotNull()).cast("int").alias("location_known"),
    )


def instructor_records(numbered: DataFrame) -> DataFrame:
    """One row per section instructor: the list when non-empty, else the single field."""
    listed = F.when(F.size("section.instructors") > 0, F.col("section.instructors")).otherwise(
        F.filter(F.array("section.instructor"), lambda i: i.isNotNull())
    )
    rows = numbered.select("package_id", "section_class_number", "section_index", F.posexplode(listed).alias("instructor_index", "i"))
    return rows.select(
        "package_id",
        "section_class_number",
        "section_index",
        "instructor_index",
        F.col("i.netid").alias("netid"),
        F.col("i.email").alias("email"),
        F.coalesce("i.name.first", "i.first_name").alias("first_name"),
        F.coalesce("i.name.last", "i.last_name").alias("last_name"),
    )


def entry_courses(records: DataFrame) -> DataFrame:
    """The course that each package entry names, one row per entry and course, in the nested catalog shape."""
    c = F.col("course")
    rows = records.filter("term_code IS NOT NULL AND course_id IS NOT NULL").select(
        F.coalesce(c["termCode"], "term_code").alias("termCode"),
        F.coalesce(c["courseId"], "course_id").alias("courseId"),
        c["courseDesignation"].alias("courseDesignation"),
        c["fullCourseDesignation"].alias("fullCourseDesignation"),
        F.struct(F.coalesce(c["subjectCode"], c["subject"]["subjectCode"], "subject_code").alias("subjectCode")).alias("subject"),
        c["catalogNumber"].alias("catalogNumber"),
        "entry_index",
        "package_index",
    )
    named = [x for x in rows.columns if x not in ("termCode", "courseId", "entry_index", "package_index")]
    return rows.groupBy("entry_index", "termCode", "courseId").agg(*[F.min_by(x, "package_index").alias(x) for x in named])


def synthesized_courses(records: DataFrame) -> DataFrame:
    """Courses known only from packages, in the nested catalog shape (one per term and course)."""
    c = F.col("course")
    rows = records.filter("term_code IS NOT NULL AND course_id IS NOT NULL").select(
        F.coalesce(c["termCode"], "term_code").alias("termCode"),
        F.coalesce(c["courseId"], "course_id").alias("courseId"),
        c["catalogNumber"].alias("catalogNumber"),
        c["courseDesignation"].alias("courseDesignation"),
        c["fullCourseDesignation"].alias("fullCourseDesignation"),
        c["title"].alias("title"),
        c["description"].alias("description"),
        c["minimumCredits"].alias("minimumCredits"),
        c["maximumCredits"].alias("maximumCredits"),
        c["enrollmentPrerequisites"].alias("enrollmentPrerequisites"),
        F.coalesce(c["currentlyTaught"], F.lit(True)).alias("currentlyTaught"),
        c["lastTaught"].alias("lastTaught"),
        F.struct(
            F.coalesce(c["subjectCode"], c["subject"]["subjectCode"], "subject_code").alias("subjectCode"),
            c["subject"]["shortDescription"].alias("shortDescription"),
            c["subject"]["description"].alias("description"),
        ).alias("subject"),
        F.struct(F.coalesce(F.col("package.lastUpdated"), F.lit(-1)).alias("u"), F.col("package_id").alias("p")).alias("_rank"),
    )
    leaves = [x for x in rows.columns if x not in ("termCode", "courseId", "_rank")]
    best = rows.groupBy("termCode", "courseId").agg(
        *[F.max_by(x, F.when(F.col(x).isNotNull(), F.col("_rank"))).alias(x) for x in leaves]
    )
    return best
