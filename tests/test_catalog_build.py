"""Nested snapshots to tables and read models, on fixtures written in the snapshot shapes."""

import json

import pytest

from rosterloom.plans.catalog_build import build_from_files
from rosterloom.plans.read_models import register_views

HOUR = 3_600_000
# 9:00 local on the clock date is 15:00 UTC.
NINE = 15 * HOUR


def meeting(days, start, end, **kw):
    return {
        "meetingType": "CLASS", "meetingDays": days, "meetingTimeStart": start, "meetingTimeEnd": end,
        "startDate": 100, "endDate": 900, "room": "120",
        "building": {"buildingCode": "B1", "buildingName": "Harbor Hall", "latitude": 43.07, "longitude": -89.40}, **kw,
    }


def section(number, kind, sec, **kw):
    out = {
        "classUniqueId": {"termCode": "1272", "classNumber": number}, "courseId": "000010", "sectionNumber": sec, "type": kind,
        "sessionCode": "A1", "instructionMode": "Classroom Instruction", "published": True,
        "enrollmentStatus": {"openSeats": 3, "waitlistCurrentSize": 0, "capacity": 20, "currentlyEnrolled": 17},
        "classMeetings": [], "instructors": [],
    }
    out.update(kw)
    return out


def package(ident, sections, updated=1000, **kw):
    out = {
        "id": ident, "lastUpdated": updated, "onlineOnly": False, "isAsynchronous": False,
        "enrollmentStatus": {"openSeats": 2, "waitlistCurrentSize": 1, "capacity": 20, "currentlyEnrolled": 18},
        "sections": sections,
    }
    out.update(kw)
    return out


COURSES = [
    {
        "termCode": "1272", "courseId": "000010", "catalogNumber": "431", "courseDesignation": "KELP 431", "title": "Currents",
        "fullCourseDesignation": "KELP STUDIES 431", "description": "Moving water", "minimumCredits": 4.0, "maximumCredits": 4.0,
        "enrollmentPrerequisites": "(COMP SCI/MATH 240 or COMP SCI/MATH/STAT 475) and (COMP SCI 367 or 400)", "currentlyTaught": True,
        "lastUpdated": 5000, "subject": {"subjectCode": "266", "shortDescription": "COMP SCI", "footnotes": [" Laptop required "]},
    },
    {"termCode": "1272", "courseId": "000010", "courseDesignation": "REEF  431", "catalogNumber": "431", "subject": {"subjectCode": "600"}},
    {"termCode": "1272", "courseId": "000020", "courseDesignation": "ART 100", "title": "Etching", "subject": {"subjectCode": "168"}},
]

ANN = {"netid": "ann", "email": "ann@x", "name": {"first": "Ann", "last": "Lee"}}
LECTURE = dict(
    classMeetings=[meeting("MWF", NINE, NINE + 50 * 60_000), meeting(None, None, None, meetingType="EXAM", examDate=950, building=None)],
    instructors=[{"email": "ann@x", "name": {"first": "Ann", "last": "Lee"}}],
)

PACKAGES = {
    "termCode": "1272",
    "results": [
        {
            "course": {"termCode": "1272", "subjectCode": "266", "courseId": "000010", "courseDesignation": "KELP 431"},
            "packages": [
                package("p1", [section(101, "LEC", "001", **LECTURE), section(102, "DIS", "301", footnotes=["Bring paper"])]),
                # An older copy of the same package: fuller room data, one section that is gone.
                package(
                    "p1",
                    [
                        section(101, "LEC", "001", instructors=[ANN], classMeetings=[meeting("MWF", NINE, NINE + 50 * 60_000, room="999"),
                                                                                    meeting("T", NINE, NINE + HOUR, room="7")]),
                        section(109, "LAB", "009"),
                    ],
                    updated=500,
                    packageEnrollmentStatus={"status": "OPEN", "availableSeats": 9},
                ),
                package("p2", [section(101, "LEC", "001", **LECTURE), section(None, "DIS", "302", sessionCode="B1")], updated=2000),
            ],
        },
        {
            "course": {"termCode": "1272", "subjectCode": "999", "courseId": "000030", "courseDesignation": "NEW 1", "title": "Only here"},
            "packages": [package("p9", [section(201, "SEM", "001", courseId=None, instructionMode="Online Only")], onlineOnly=True)],
        },
    ],
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("snap")
    (folder / "courses.json").write_text(json.dumps(COURSES))
    (folder / "packages.json").write_text(json.dumps(PACKAGES))
    built = build_from_files(spark, str(folder / "courses.json"), str(folder / "packages.json"), "2026-04-12T00:00:00.000Z")
    return {k: v.cache() for k, v in built.items()}


def rows(df, *cols):
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=repr)


def test_packages_merge_versions(tables):
    got = rows(tables["packages"], "package_id", "package_last_updated", "package_status", "open_seats", "has_waitlist", "is_full")
    assert got == [
        ("1272:266:000010:p1", 1000, "OPEN", 2, 1, 0),
        ("1272:266:000010:p2", 2000, None, 2, 1, 0),
        ("1272:999:000030:p9", 1000, None, 2, 1, 0),
    ]


def test_newest_copy_decides_sections(tables):
    got = rows(tables["sections"].filter("package_id like '%p1'"), "section_class_number", "section_type", "section_number")
    assert got == [(101, "LEC", "001"), (102, "DIS", "301")]


def test_missing_class_number_is_negative_and_stable(tables):
    got = rows(tables["sections"].filter("section_number = '302'"), "section_class_number")
    assert len(got) == 1 and got[0][0] < 0


def test_meetings_merge_by_key_and_append(tables):
    got = rows(tables["meetings"].filter("package_id like '%p1'"), "section_class_number", "meeting_index", "meeting_type", "meeting_days", "room")
    assert got == [(101, 0, "CLASS", "MWF", "120"), (101, 1, "EXAM", None, "120"), (101, 2, "CLASS", "T", "7")]


def test_courses_known_only_from_packages(tables):
    assert rows(tables["courses"].filter("course_id = '000030'"), "course_designation", "subject_code", "title", "currently_taught") == [
        ("NEW 1", "999", "Only here", 1)
    ]


def test_cross_listings_have_one_primary(tables):
    got = rows(tables["course_cross_listings"].filter("course_id = '000010'"), "course_designation", "is_primary")
    assert got == [("KELP 431", 1), ("REEF 431", 0)]


def test_instructor_email_then_netid_is_one_person(tables):
    assert rows(tables["instructors"], "instructor_key", "email", "last_name") == [("netid:ann", "ann@x", "Lee")]


def test_current_section_comes_from_freshest_package(tables):
    got = rows(tables["section_overview_v"].filter("section_class_number = 101"), "source_package_id", "has_open_seats", "is_full")
    assert got == [("1272:266:000010:p2", 1, 0)]


def test_course_overview(tables):
    got = rows(
        tables["course_overview_v"], "course_designation", "section_count", "has_any_open_seats", "cross_list_designations_json", "cross_list_count"
    )
    assert ("KELP 431", 3, 1, '["KELP 431","REEF 431"]', 2) in got
    assert ("ART 100", 0, None, '["ART 100"]', 1) in got


def test_schedulable_packages(tables):
    got = rows(
        tables["schedulable_packages"].filter("source_package_id like '%p1'"), "section_bundle_label", "meeting_count", "campus_day_count",
        "earliest_start_minute_local", "latest_end_minute_local", "meeting_summary_local", "restriction_note",
    )
    assert got == [(
        "KELP 431 LEC 001 + DIS 301", 2, 4, 540, 600, "MWF 9:00 AM-9:50 AM @ Harbor Hall; T 9:00 AM-10:00 AM @ Harbor Hall",
        "(COMP SCI/MATH 240 or COMP SCI/MATH/STAT 475) and (COMP SCI 367 or 400) | Laptop required | Bring paper",
    )]


def test_shared_lecture_meets_in_every_package(tables):
    got = rows(tables["canonical_meetings"].filter("section_class_number = 101 and meeting_index = 0"), "package_id", "source_package_id", "days_mask")
    assert got == [("1272:266:000010:p1", "1272:266:000010:p2", 21), ("1272:266:000010:p2", "1272:266:000010:p2", 21)]


def test_online_courses(tables):
    assert rows(tables["online_courses_v"], "course_designation") == [("NEW 1",)]


def test_run_metadata(tables):
    assert rows(tables["refresh_runs"], "snapshot_run_at", "source_term_code") == [("1970-01-01T00:00:05.000Z", "1272")]


def test_requirement_summary(tables):
    got = rows(tables["prerequisite_course_summary_overview_v"], "course_designation", "summary_status", "course_groups_json")
    assert got == [(
        "KELP 431", "structured",
        '[["COMP SCI 240","MATH 240","COMP SCI 475","MATH 475","STAT 475"],["COMP SCI 367","COMP SCI 400"]]',
    )]


def test_documented_queries_run(spark, tables):
    """The kind of SQL a user of the views runs today."""
    register_views(spark, tables)
    assert spark.sql("SELECT section_number FROM section_overview_v WHERE course_designation = 'KELP 431' ORDER BY section_type").count() == 3
    assert spark.sql(
        """SELECT section_type, COUNT(*) n, SUM(has_open_seats) o FROM section_overview_v WHERE course_designation = 'KELP 431' GROUP BY section_type"""
    ).count() == 2
    assert spark.sql("SELECT * FROM schedule_planning_v WHERE section_class_number = 101 ORDER BY meeting_index").count() == 2
    assert spark.sql(
        """SELECT c.course_designation FROM courses c LEFT JOIN prerequisite_rules pr ON pr.term_code = c.term_code AND pr.course_id = c.course_id
        WHERE pr.rule_id IS NULL ORDER BY c.course_designation LIMIT 20"""
    ).collect()[0][0] == "ART 100"
    assert spark.sql("SELECT * FROM course_cross_listing_overview_v WHERE alias_course_designation IN ('KELP 431', 'REEF 431')").count() == 2
    assert spark.sql("SELECT * FROM course_overview_v WHERE minimum_credits != maximum_credits").count() == 0
    assert spark.sql("SELECT * FROM schedule_candidates_v WHERE campus_day_count <= 4 AND earliest_start_minute_local >= 540 AND open_seats > 0").count() == 2
    assert spark.sql("SELECT * FROM refresh_runs ORDER BY last_refreshed_at DESC LIMIT 1").count() == 1


def test_every_package_entry_is_a_cross_listing_and_input_order_decides_names(spark, tmp_path):
    """Aliases known from packages only, and one person under many last names, for two partition counts."""
    courses = [{"termCode": "1272", "courseId": "000070", "courseDesignation": "AAA 1", "title": "T", "subject": {"subjectCode": "1"}}]
    teacher = [{"netid": "kim", "name": {"first": "Kim", "last": f"Name{i}"}} for i in range(12)]

    def entry(designation, first):
        course = {"termCode": "1272", "subjectCode": "1", "courseId": "000070", "courseDesignation": designation}
        made = [package(f"q{i}", [section(300 + i, "LEC", f"0{i:02d}", instructors=[teacher[i]])]) for i in range(first, first + 6)]
        return {"course": course, "packages": made}

    snapshot = {"termCode": None, "results": [entry("AAA 1", 0), entry("BBB  1", 6)]}
    (tmp_path / "courses.json").write_text(json.dumps(courses))
    (tmp_path / "packages.json").write_text(json.dumps(snapshot))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("1", "5"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            built = build_from_files(spark, str(tmp_path / "courses.json"), str(tmp_path / "packages.json"), "2026-04-12T00:00:00.000Z")
            assert rows(built["course_cross_listings"], "course_designation", "is_primary") == [("AAA 1", 1), ("BBB 1", 0)]
            assert rows(built["instructors"], "instructor_key", "last_name") == [("netid:kim", "Name11")]
            assert built["refresh_runs"].first()["source_term_code"] == "1272"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
