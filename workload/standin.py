"""Catalog-shaped tables derived from the star schema.

customer x year = course, order = package, line item = section, supplier = instructor,
nation = building; grade history comes from orders and line items.  ``PRELUDE`` states the
same derivation as SQL common table expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterloom.session import cut_lineage, in_slices, slice_of

# So many order lines are worked on at a time where a query goes course by course.
LINES_PER_SLICE = 5_000_000

NULL_TEXT = "cast(null as string)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LINE_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag", "l_linestatus"]


def numbered_lines(lines: DataFrame) -> DataFrame:
    """The test table repeats (order, line number): the k-th repeat gets the number plus 7 * (k - 1)."""
    repeat = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*_LINE_ORDER))
    # Spread by order alone, which serves the window and the join with the orders alike.
    return lines.repartition("l_orderkey").withColumn("_repeat", repeat).withColumn("l_linenumber", F.col("l_linenumber") + 7 * (F.col("_repeat") - 1)).drop("_repeat")


NUMBERED = f"""(SELECT * REPLACE (CAST(l_linenumber + 7 * (row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY {', '.join(_LINE_ORDER)}) - 1) AS INT) AS l_linenumber) FROM lineitem)"""


class Catalog:
    """The catalog of all customers, or of slice ``at`` of ``of``: their orders, lines and all that is derived from these."""

    def __init__(self, spark: SparkSession, sf_dir: str, whole: Catalog | None = None, at: int = 0, of: int = 1):
        self.spark, self.sf, self.at, self.of = spark, sf_dir, at, of
        self.whole = whole or self

    def t(self, name: str) -> DataFrame:
        rows = table(self.spark, self.sf, name)
        owner = {"customer": "c_custkey", "orders": "o_custkey"}.get(name)
        return rows if self.of == 1 or owner is None else rows.filter(slice_of(owner, self.of) == self.at)

    def sliced(self, of: int) -> list[Catalog]:
        """Catalogs of the customers in ``of`` slices; the joined lines are written once for all of them."""
        self._slices = of
        return [Catalog(self.spark, self.sf, self, i, of) for i in range(of)]

    def _lines_by_slice(self, numbered: bool, columns: list[str]) -> DataFrame:
        """Lines joined to their orders, by slices of the orders, told apart by the slice of their customer."""

        def joined(i: int) -> DataFrame:
            lines = self.t("lineitem").filter(slice_of("l_orderkey", self._slices) == i)
            lines = self._lines_of(lines) if numbered else lines
            orders = self.t("orders").filter(slice_of("o_orderkey", self._slices) == i)
            orders = self._placed(orders) if numbered else orders
            met = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            return met.select(*columns, slice_of("o_custkey", self._slices).alias("_slice"))

        return in_slices(self.spark, self._slices, joined, "_slice")

    @cached_property
    def people(self) -> DataFrame:
        return self.t("customer").selectExpr(
            "c_custkey",
            "cast(c_custkey as string) as course_id",
            "c_mktsegment as subject_code",
            "cast(100 + c_custkey % 900 as string) as catalog_number",
            "concat(c_mktsegment, ' ', cast(100 + c_custkey % 900 as string)) as course_designation",
            "concat('Studies ', cast(c_nationkey as string)) as title",
            "concat('Course of ', c_name) as description",
            "cast(1 + c_nationkey % 4 as double) as minimum_credits",
            "cast(1 + c_nationkey % 4 + case when c_acctbal < 0 then 2 else 0 end as double) as maximum_credits",
            "case when c_acctbal > 5000 then concat('NATION ', cast(c_nationkey as string), ' ', cast(100 + c_custkey % 900 as string)) end as alias",
            "c_acctbal",
        )

    @cached_property
    def placed_orders(self) -> DataFrame:
        """Orders with term and package id."""
        return self._placed(self.t("orders"))

    def _placed(self, orders: DataFrame) -> DataFrame:
        return (
            orders
            .withColumn("term_code", F.year("o_orderdate").cast("string"))
            .join(self.people.select("c_custkey", "course_id", "subject_code"), F.col("o_custkey") == F.col("c_custkey"))
            .withColumn("package_id", F.concat_ws(":", "term_code", "subject_code", "course_id", F.col("o_orderkey").cast("string")))
        )

    @cached_property
    def courses(self) -> DataFrame:
        terms = self.t("orders").select("o_custkey", F.year("o_orderdate").cast("string").alias("term_code")).distinct()
        return terms.join(self.people, F.col("o_custkey") == F.col("c_custkey")).select(
            "term_code", "course_id", "subject_code", "catalog_number", "course_designation", "title", "description",
            "minimum_credits", "maximum_credits",
        )

    @cached_property
    def cross_listings(self) -> DataFrame:
        terms = self.t("orders").select("o_custkey", F.year("o_orderdate").cast("string").alias("term_code")).distinct()
        named = terms.join(self.people, F.col("o_custkey") == F.col("c_custkey"))
        own = named.selectExpr(
            "term_code", "course_id", "course_designation", "title as full_course_designation", "subject_code", "catalog_number", "1 as is_primary"
        )
        other = named.filter("alias is not null").selectExpr(
            "term_code", "course_id", "alias as course_designation", "title as full_course_designation",
            "'NATION' as subject_code", "catalog_number", "0 as is_primary",
        )
        return own.unionByName(other)

    @cached_property
    def packages(self) -> DataFrame:
        seats = "cast(floor(o_totalprice / 1000) as int) % 40 - 5"
        open_seats = f"case when o_orderstatus = 'P' then null else {seats} end"
        waiting = "case when o_orderpriority = '4-NOT SPECIFIED' then null else cast(floor(o_totalprice) as int) % 3 end"
        return self.placed_orders.selectExpr(
            "package_id", "term_code", "subject_code", "course_id",
            "case when o_orderpriority = '5-LOW' then null else timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01', o_orderdate) end as package_last_updated",
            "o_orderstatus as package_status",
            f"{open_seats} as open_seats",
            f"{waiting} as waitlist_current_size",
            f"{open_seats} as package_available_seats",
            f"{waiting} as package_waitlist_total",
            "case when o_orderpriority = '1-URGENT' then 1 else 0 end as online_only",
            "case when o_orderpriority = '2-HIGH' and o_orderstatus = 'O' then 1 else 0 end as is_asynchronous",
        ).selectExpr(
            "*",
            "case when open_seats is null then null when open_seats > 0 then 1 else 0 end as has_open_seats",
            "case when waitlist_current_size is null then null when waitlist_current_size > 0 then 1 else 0 end as has_waitlist",
            "case when open_seats is null then null when open_seats <= 0 then 1 else 0 end as is_full",
        )

    @cached_property
    def lines(self) -> DataFrame:
        """Every line, with a number of its own in the order; ``slot`` is the number in the test table."""
        return self._lines_of(self.t("lineitem"))

    @staticmethod
    def _lines_of(lineitem: DataFrame) -> DataFrame:
        return numbered_lines(lineitem).selectExpr(
            "l_orderkey", "l_linenumber", "(l_linenumber - 1) % 7 + 1 as slot", "cast(l_quantity as int) as q", "l_suppkey as supp",
            "l_returnflag as rf", "l_linestatus as ls", "l_shipdate as ship",
        )

    @cached_property
    def _section_lines(self) -> DataFrame:
        """Written once: sections, meetings and instructors would each number and join all lines again."""
        if self.of > 1:
            return self.whole._all_section_lines.filter(F.col("_slice") == self.at).drop("_slice")
        orders = self.placed_orders.select("o_orderkey", "package_id", "term_code", "course_id")
        return cut_lineage(self.lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey", "o_orderkey"))

    @cached_property
    def _all_section_lines(self) -> DataFrame:
        return self._lines_by_slice(True, ["l_linenumber", "slot", "q", "supp", "rf", "ls", "ship", "package_id", "term_code", "course_id"])

    @cached_property
    def _all_offering_lines(self) -> DataFrame:
        return self._lines_by_slice(False, ["o_custkey", "l_suppkey", "l_quantity", "l_discount"])

    @cached_property
    def sections(self) -> DataFrame:
        return self._section_lines.selectExpr(
            "package_id", "l_linenumber as section_class_number", "term_code", "course_id",
            "lpad(cast(l_linenumber as string), 3, '0') as section_number",
            "case rf when 'A' then 'LEC' when 'N' then 'DIS' else 'LAB' end as section_type",
            "case ls when 'O' then 'Online Only' else 'Classroom Instruction' end as instruction_mode",
            "ls as session_code",
            "case when rf = 'N' then null else q - 20 end as open_seats",
            "case when q > 45 then null else q % 3 end as waitlist_current_size",
            "50 as capacity", "q as currently_enrolled",
        )

    @cached_property
    def meetings(self) -> DataFrame:
        places = self.t("supplier").selectExpr(
            "s_suppkey", "case when s_acctbal < 0 then null else cast(s_nationkey as string) end as building_code"
        )
        start = "(13 + slot) * 3600000 + (supp % 4) * 900000"
        rows = self._section_lines.join(places, F.col("supp") == F.col("s_suppkey")).selectExpr(
            "package_id", "l_linenumber as section_class_number", "0 as meeting_index",
            "case when ls = 'F' and rf = 'R' then 'EXAM' else 'CLASS' end as meeting_type",
            "case slot when 1 then 'MWF' when 2 then 'TR' when 3 then 'MW' when 4 then 'F' when 5 then 'TWR' when 6 then null else '?' end as meeting_days",
            f"cast({start} as bigint) as meeting_time_start",
            f"cast({start} + 3000000 + (supp % 3) * 1500000 as bigint) as meeting_time_end",
            "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01', ship) as start_date",
            "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01', ship) + 5184000000 as end_date",
            "case when ls = 'F' and rf = 'R' then timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01', ship) end as exam_date",
            "concat('R', cast(supp as string)) as room",
            "building_code",
            "case when building_code is null then 0 else 1 end as location_known",
        )
        return rows

    @cached_property
    def buildings(self) -> DataFrame:
        return self.t("nation").selectExpr(
            "cast(n_nationkey as string) as building_code", "n_name as building_name",
            "concat(cast(n_regionkey as string), ' Main St') as street_address",
            "43.0 + n_nationkey * 0.001D as latitude", "-89.4 + n_regionkey * 0.002D as longitude",
        ).selectExpr("building_code", "building_name", "street_address", "cast(latitude as double) latitude", "cast(longitude as double) longitude")

    @cached_property
    def instructors(self) -> DataFrame:
        return self.t("supplier").selectExpr(
            "concat('netid:s', cast(s_suppkey as string)) as instructor_key",
            "case when s_acctbal < 0 then null else 'Prof' end as first_name",
            "case when s_acctbal < -500 then null else s_name end as last_name",
            "s_suppkey",
        )

    @cached_property
    def section_instructors(self) -> DataFrame:
        return self._section_lines.selectExpr(
            "package_id", "l_linenumber as section_class_number", "concat('netid:s', cast(supp as string)) as instructor_key"
        )

    @cached_property
    def runs(self) -> DataFrame:
        # All of them also in a slice: the current term is that of the whole catalog.
        return table(self.spark, self.sf, "orders").select(F.year("o_orderdate").cast("string").alias("source_term_code"))

    @cached_property
    def history_courses(self) -> DataFrame:
        return self.people.selectExpr("c_custkey as history_course_id", "subject_code", "catalog_number", "course_designation")

    @cached_property
    def course_grades(self) -> DataFrame:
        return self.t("orders").selectExpr(
            "o_custkey as history_course_id", "cast(year(o_orderdate) as string) as term_code",
            "case o_orderstatus when 'O' then 1 when 'P' then 2 else 3 end as refresh_run_id",
            "o_orderkey as course_grade_id",
            "cast(floor(o_totalprice / 10000) as int) as student_count",
            "cast(o_orderkey % 41 as double) / 10 as avg_gpa",
        )

    @cached_property
    def history_instructors(self) -> DataFrame:
        return self.t("supplier").selectExpr("s_suppkey as history_instructor_id", "s_name as display_name")

    @cached_property
    def instructor_grades(self) -> DataFrame:
        return self.t("lineitem").groupBy(
            F.col("l_suppkey").alias("history_instructor_id"),
            F.year("l_shipdate").cast("string").alias("term_code"),
            F.col("l_linenumber").alias("refresh_run_id"),
        ).agg(
            F.max("l_orderkey").alias("instructor_grade_id"),
            F.sum(F.col("l_quantity").cast("int")).cast("int").alias("student_count"),
            (F.max(F.col("l_discount") * 100).cast("int") / F.lit(3.0)).alias("avg_gpa"),
        )

    @cached_property
    def offerings(self) -> DataFrame:
        if self.of > 1:
            lines = self.whole._all_offering_lines.filter(F.col("_slice") == self.at)
        else:
            lines = self.t("lineitem").join(self.t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        return lines.selectExpr(
            "o_custkey as history_course_id", "l_suppkey as history_instructor_id",
            "cast(l_quantity as int) as student_count", "l_discount * 40 as avg_gpa",
        )

    @cached_property
    def course_matches(self) -> DataFrame:
        return self.courses.join(self.people.select("course_id", "c_custkey", "c_acctbal"), "course_id").selectExpr(
            "term_code", "course_id", "case when c_acctbal > 0 then c_custkey end as history_course_id"
        )

    @cached_property
    def instructor_matches(self) -> DataFrame:
        return self.t("supplier").filter("s_acctbal > -900").selectExpr(
            "concat('netid:s', cast(s_suppkey as string)) as instructor_key",
            "case when s_acctbal > 0 then s_suppkey end as history_instructor_id",
            "case when s_acctbal > 0 then 'matched' else 'unmatched' end as match_status",
        )


def course_by_course(spark: SparkSession, sf_dir: str, step: Callable[[Catalog], DataFrame], lines_for: int = 1) -> DataFrame:
    """``step`` over the catalogs of slices of the customers, for results that are told by course.

    A course is a customer's, and its packages, sections and meetings are those of the customer's orders.  Tables of few lines are
    one slice; ``lines_for`` makes slices smaller by that factor.
    """
    c = Catalog(spark, sf_dir)
    n = -(-c.t("lineitem").count() // (LINES_PER_SLICE // lines_for))
    if n <= 1:
        return step(c)
    slices = c.sliced(n)
    return in_slices(spark, n, lambda i: step(slices[i]))


PRELUDE = """
people AS (
  SELECT c_custkey, CAST(c_custkey AS VARCHAR) course_id, c_mktsegment subject_code,
    CAST(100 + c_custkey % 900 AS VARCHAR) catalog_number,
    c_mktsegment || ' ' || CAST(100 + c_custkey % 900 AS VARCHAR) course_designation,
    'Studies ' || CAST(c_nationkey AS VARCHAR) title, 'Course of ' || c_name description,
    CAST(1 + c_nationkey % 4 AS DOUBLE) minimum_credits,
    CAST(1 + c_nationkey % 4 + CASE WHEN c_acctbal < 0 THEN 2 ELSE 0 END AS DOUBLE) maximum_credits,
    CASE WHEN c_acctbal > 5000 THEN 'NATION ' || CAST(c_nationkey AS VARCHAR) || ' ' || CAST(100 + c_custkey % 900 AS VARCHAR) END alias,
    c_acctbal
  FROM customer),
placed_orders AS (
  SELECT o.*, CAST(year(o_orderdate) AS VARCHAR) term_code, p.course_id, p.subject_code,
    CAST(year(o_orderdate) AS VARCHAR) || ':' || p.subject_code || ':' || p.course_id || ':' || CAST(o_orderkey AS VARCHAR) package_id
  FROM orders o JOIN people p ON p.c_custkey = o.o_custkey),
course_terms AS (
  SELECT t.term_code, p.* FROM (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS VARCHAR) term_code FROM orders) t
  JOIN people p ON p.c_custkey = t.o_custkey),
courses AS (
  SELECT term_code, course_id, subject_code, catalog_number, course_designation, title, description, minimum_credits, maximum_credits FROM course_terms),
course_cross_listings AS (
  SELECT term_code, course_id, course_designation, title full_course_designation, subject_code, catalog_number, 1 is_primary FROM course_terms
  UNION ALL
  SELECT term_code, course_id, alias, title, 'NATION', catalog_number, 0 FROM course_terms WHERE alias IS NOT NULL),
packages0 AS (
  SELECT package_id, term_code, subject_code, course_id,
    CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE epoch_ms(o_orderdate) END package_last_updated, o_orderstatus package_status,
    CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(floor(o_totalprice / 1000) AS INT) % 40 - 5 END open_seats,
    CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE CAST(floor(o_totalprice) AS INT) % 3 END waitlist_current_size,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END online_only,
    CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'O' THEN 1 ELSE 0 END is_asynchronous
  FROM placed_orders),
packages AS (
  SELECT *, open_seats package_available_seats, waitlist_current_size package_waitlist_total,
    CASE WHEN open_seats IS NULL THEN NULL WHEN open_seats > 0 THEN 1 ELSE 0 END has_open_seats,
    CASE WHEN waitlist_current_size IS NULL THEN NULL WHEN waitlist_current_size > 0 THEN 1 ELSE 0 END has_waitlist,
    CASE WHEN open_seats IS NULL THEN NULL WHEN open_seats <= 0 THEN 1 ELSE 0 END is_full
  FROM packages0),
lines AS (
  SELECT l_orderkey, l_linenumber, (l_linenumber - 1) % 7 + 1 slot, CAST(l_quantity AS INT) q, l_suppkey supp, l_returnflag rf, l_linestatus ls, l_shipdate ship
  FROM %NUMBERED%),
section_lines AS (
  SELECT l.*, o.package_id, o.term_code, o.course_id FROM lines l JOIN placed_orders o ON o.o_orderkey = l.l_orderkey),
sections AS (
  SELECT package_id, l_linenumber section_class_number, term_code, course_id, lpad(CAST(l_linenumber AS VARCHAR), 3, '0') section_number,
    CASE rf WHEN 'A' THEN 'LEC' WHEN 'N' THEN 'DIS' ELSE 'LAB' END section_type,
    CASE ls WHEN 'O' THEN 'Online Only' ELSE 'Classroom Instruction' END instruction_mode, ls session_code,
    CASE WHEN rf = 'N' THEN NULL ELSE q - 20 END open_seats, CASE WHEN q > 45 THEN NULL ELSE q % 3 END waitlist_current_size,
    50 capacity, q currently_enrolled
  FROM section_lines),
meetings AS (
  SELECT package_id, l_linenumber section_class_number, 0 meeting_index,
    CASE WHEN ls = 'F' AND rf = 'R' THEN 'EXAM' ELSE 'CLASS' END meeting_type,
    CASE slot WHEN 1 THEN 'MWF' WHEN 2 THEN 'TR' WHEN 3 THEN 'MW' WHEN 4 THEN 'F' WHEN 5 THEN 'TWR' WHEN 6 THEN NULL ELSE '?' END meeting_days,
    CAST((13 + slot) * 3600000 + (supp % 4) * 900000 AS BIGINT) meeting_time_start,
    CAST((13 + slot) * 3600000 + (supp % 4) * 900000 + 3000000 + (supp % 3) * 1500000 AS BIGINT) meeting_time_end,
    epoch_ms(ship) start_date, epoch_ms(ship) + 5184000000 end_date,
    CASE WHEN ls = 'F' AND rf = 'R' THEN epoch_ms(ship) END exam_date, 'R' || CAST(supp AS VARCHAR) room,
    CASE WHEN s_acctbal < 0 THEN NULL ELSE CAST(s_nationkey AS VARCHAR) END building_code,
    CASE WHEN s_acctbal < 0 THEN 0 ELSE 1 END location_known
  FROM section_lines JOIN supplier ON s_suppkey = supp),
buildings AS (
  SELECT CAST(n_nationkey AS VARCHAR) building_code, n_name building_name, CAST(n_regionkey AS VARCHAR) || ' Main St' street_address,
    CAST(43.0 AS DOUBLE) + n_nationkey * CAST(0.001 AS DOUBLE) latitude, CAST(-89.4 AS DOUBLE) + n_regionkey * CAST(0.002 AS DOUBLE) longitude
  FROM nation),
instructors AS (
  SELECT 'netid:s' || CAST(s_suppkey AS VARCHAR) instructor_key, CASE WHEN s_acctbal < 0 THEN NULL ELSE 'Prof' END first_name,
    CASE WHEN s_acctbal < -500 THEN NULL ELSE s_name END last_name, s_suppkey
  FROM supplier),
section_instructors AS (
  SELECT package_id, l_linenumber section_class_number, 'netid:s' || CAST(supp AS VARCHAR) instructor_key FROM section_lines),
refresh_runs AS (SELECT CAST(year(o_orderdate) AS VARCHAR) source_term_code FROM orders),
history_courses AS (SELECT c_custkey history_course_id, subject_code, catalog_number, course_designation FROM people),
course_grades AS (
  SELECT o_custkey history_course_id, CAST(year(o_orderdate) AS VARCHAR) term_code,
    CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END refresh_run_id, o_orderkey course_grade_id,
    CAST(floor(o_totalprice / 10000) AS INT) student_count, CAST(o_orderkey % 41 AS DOUBLE) / 10 avg_gpa
  FROM orders),
history_instructors AS (SELECT s_suppkey history_instructor_id, s_name display_name FROM supplier),
instructor_grades AS (
  SELECT l_suppkey history_instructor_id, CAST(year(l_shipdate) AS VARCHAR) term_code, l_linenumber refresh_run_id, max(l_orderkey) instructor_grade_id,
    CAST(sum(CAST(l_quantity AS INT)) AS INT) student_count, CAST(trunc(max(l_discount * 100)) AS INT) / CAST(3.0 AS DOUBLE) avg_gpa
  FROM lineitem GROUP BY 1, 2, 3),
offerings AS (
  SELECT o_custkey history_course_id, l_suppkey history_instructor_id, CAST(l_quantity AS INT) student_count, l_discount * 40 avg_gpa
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
course_matches AS (
  SELECT term_code, course_id, CASE WHEN c_acctbal > 0 THEN c_custkey END history_course_id FROM course_terms),
instructor_matches AS (
  SELECT 'netid:s' || CAST(s_suppkey AS VARCHAR) instructor_key, CASE WHEN s_acctbal > 0 THEN s_suppkey END history_instructor_id,
    CASE WHEN s_acctbal > 0 THEN 'matched' ELSE 'unmatched' END match_status
  FROM supplier WHERE s_acctbal > -900),
ranked_sections AS (
  SELECT s.*, p.package_last_updated source_package_last_updated,
    row_number() OVER (PARTITION BY s.term_code, s.course_id, s.section_class_number
      ORDER BY coalesce(p.package_last_updated, -1) DESC, s.package_id DESC) source_rank
  FROM sections s JOIN packages p ON p.package_id = s.package_id),
section_overview AS (
  SELECT r.term_code, c.subject_code, c.catalog_number, r.course_id, c.course_designation, c.title, r.section_class_number,
    r.package_id source_package_id, r.source_package_last_updated, r.section_number, r.section_type, r.instruction_mode, r.session_code,
    r.open_seats, r.waitlist_current_size, r.capacity, r.currently_enrolled,
    CASE WHEN r.open_seats IS NULL THEN NULL WHEN r.open_seats > 0 THEN 1 ELSE 0 END has_open_seats,
    CASE WHEN r.waitlist_current_size IS NULL THEN NULL WHEN r.waitlist_current_size > 0 THEN 1 ELSE 0 END has_waitlist,
    CASE WHEN r.open_seats IS NULL THEN NULL WHEN r.open_seats <= 0 THEN 1 ELSE 0 END is_full
  FROM ranked_sections r JOIN courses c ON c.term_code = r.term_code AND c.course_id = r.course_id WHERE r.source_rank = 1),
cross_list_agg AS (
  SELECT term_code, course_id, '[' || string_agg('"' || course_designation || '"', ',' ORDER BY course_designation) || ']' cross_list_designations_json,
    count(*) cross_list_count
  FROM course_cross_listings GROUP BY 1, 2),
course_overview AS (
  SELECT c.term_code, c.subject_code, c.catalog_number, c.course_id, c.course_designation, c.title, c.minimum_credits, c.maximum_credits,
    coalesce(a.cross_list_designations_json, '["' || c.course_designation || '"]') cross_list_designations_json,
    coalesce(a.cross_list_count, 1) cross_list_count, count(DISTINCT s.section_class_number) section_count,
    max(s.has_open_seats) has_any_open_seats, max(s.has_waitlist) has_any_waitlist, max(s.is_full) has_any_full_section
  FROM courses c LEFT JOIN section_overview s ON s.term_code = c.term_code AND s.course_id = c.course_id
  LEFT JOIN cross_list_agg a ON a.term_code = c.term_code AND a.course_id = c.course_id
  GROUP BY ALL),
canonical_meetings0 AS (
  SELECT s.package_id, cs.source_package_id, cs.section_class_number, m.meeting_index, m.meeting_type, m.meeting_days, m.start_date, m.end_date,
    m.exam_date, m.room, m.building_code, b.building_name, b.latitude, b.longitude, m.location_known,
    CASE m.meeting_days WHEN 'MWF' THEN 21 WHEN 'TR' THEN 10 WHEN 'MW' THEN 5 WHEN 'F' THEN 16 WHEN 'TWR' THEN 14 END days_mask,
    CAST(m.meeting_time_start // 60000 - 360 AS INT) start_minute_local, CAST(m.meeting_time_end // 60000 - 360 AS INT) end_minute_local,
    CASE WHEN regexp_matches(lower(s.instruction_mode), 'online|asynchronous|distance') THEN 1 ELSE 0 END is_online
  FROM section_overview cs
  JOIN sections s ON s.term_code = cs.term_code AND s.course_id = cs.course_id AND s.section_class_number = cs.section_class_number
  JOIN meetings m ON m.package_id = s.package_id AND m.section_class_number = cs.section_class_number
  LEFT JOIN buildings b ON b.building_code = m.building_code),
canonical_meetings AS (
  SELECT *, CAST(greatest(end_minute_local - start_minute_local, 0) AS INT) duration_minutes FROM canonical_meetings0)
""".replace("%NUMBERED%", NUMBERED)


def oracle(body: str) -> str:
    """A query over the stand-in relations."""
    return f"WITH {PRELUDE} {body}"
