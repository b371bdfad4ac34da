"""Plans of the read models."""

from rosterloom.operators import rollups
from rosterloom.operators import schedules as sc
from rosterloom.plans import read_models as rm


def _met(spark):
    hour = 3600000
    sections = spark.createDataFrame(
        [("1", "c", 1, "p", "Classroom"), ("1", "c", 2, "p", "Online Only"), ("1", "c", 1, "q", None)],
        "term_code string, course_id string, section_class_number int, package_id string, instruction_mode string",
    )
    meetings = spark.createDataFrame(
        [("p", 1, 0, "CLASS", "MWF", 14 * hour, 15 * hour, "7"), ("p", 2, 0, "CLASS", "TR", 18 * hour, 19 * hour, None), ("q", 1, 0, "CLASS", "?", 14 * hour, 15 * hour, "7")],
        "package_id string, section_class_number int, meeting_index int, meeting_type string, meeting_days string, meeting_time_start bigint, "
        "meeting_time_end bigint, building_code string",
    ).selectExpr("*", "cast(null as bigint) start_date", "cast(null as bigint) end_date", "cast(null as bigint) exam_date", "'R1' room", "1 location_known")
    buildings = spark.createDataFrame([("7", "Hall", "St", 1.0, 2.0)], "building_code string, building_name string, street_address string, latitude double, longitude double")
    canonical = sections.filter("package_id = 'p'").withColumnRenamed("package_id", "source_package_id").drop("instruction_mode")
    return rm.canonical_meetings(canonical, sections, meetings, buildings)


def test_clocks_are_worked_out_once_for_all_readers(spark):
    met = _met(spark)
    for read in (rm.meeting_summaries(met), rollups.meeting_rollup(met)):
        # Hour and minute of the start and of the end.
        assert read._jdf.queryExecution().optimizedPlan().toString().count("convert_timezone") <= 4
    assert rm.meeting_summaries(met).collect() == [("p", "MWF 8:00 AM-9:00 AM @ Hall; TR 12:00 PM-1:00 PM Online")]
    assert {(r.package_id, r.days_mask, r.duration_minutes, r.is_online) for r in met.collect()} == {("p", 21, 60, 0), ("p", 10, 60, 1), ("q", None, 60, 0)}


def test_ordered_text_passes_over_blank_texts(spark):
    rows = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("a", 0, ""), ("b", 0, ""), ("c", 0, None)], "k string, i int, t string")
    assert rollups.ordered_text(rows, ["k"], ["i"], "t", "; ", "out").collect() == [("a", "x; y")]


def test_line_texts_are_made_of_picked_meetings_alone(spark):
    met = _met(spark).drop("source_package_id").withColumnRenamed("package_id", "source_package_id")
    packages = spark.createDataFrame([("c", "p", "A B 1 LEC 001 + DIS 002"), ("c", "q", "A B 1 LEC 001")], "course_id string, package_id string, section_bundle_label string")
    sections = spark.createDataFrame([("c", "LEC", "001", 1), ("c", "DIS", "002", 2)], "course_id string, section_type string, section_number string, section_class_number int")
    got = sc.meeting_lines(packages, sections, met)
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("Filter" in line and "PM" in line for line in plan)
    assert {(r.package_id, tuple(r.lines or ())) for r in got.collect()} == {
        ("p", ("LEC MWF 8:00 AM-9:00 AM @ Hall", "DIS TR 12:00 PM-1:00 PM @ R1")), ("q", ("LEC ? 8:00 AM-9:00 AM @ Hall",)),
    }
