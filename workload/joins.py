"""Interval joins, merges, matching and identity over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterloom.operators import identity, intervals, matching, merging, rollups
from rosterloom.operators.history import flatten_live_offerings, live_course_grades
from rosterloom.operators.versions import fill_group_value, first_wins
from workload.standin import NUMBERED, numbered_lines, table

EPOCH = "timestamp_ntz'1970-01-01'"


def _meetings(spark, sf):
    """Events as meetings: one weekday bit, a span of 30 to 75 minutes, a place per user group.

    The calendar date bounds the date range, so only events of the same date can meet.
    """
    day_ms = f"timestampdiff(MILLISECOND, {EPOCH}, date_trunc('DAY', ts))"
    return table(spark, sf, "events").selectExpr(
        "user_id", "event_id", "event_type",
        "cast(shiftleft(1, weekday(ts)) as int) as days_mask",
        "hour(ts) * 60 + minute(ts) as start_minute_local",
        "cast(hour(ts) * 60 + minute(ts) + 30 + (event_id % 4) * 15 as int) as end_minute_local",
        f"{day_ms} as start_date",
        f"case when event_type = 'view' then null else {day_ms} end as end_date",
        f"case when event_type = 'view' then {day_ms} end as exam_date",
        "case when event_type = 'error' then 1 else 0 end as is_online",
        "case when event_type = 'click' then 0 else 1 end as location_known",
        "case when event_type = 'signup' then null else 43.0D + (event_id % 10) * 0.002D end as latitude",
        "-89.4D + (event_id % 7) * 0.002D as longitude",
    )


_M = """m AS (SELECT user_id, event_id, event_type, 1 << (isodow(ts) - 1) day_bit, CAST(hour(ts) * 60 + minute(ts) AS INT) s,
  CAST(hour(ts) * 60 + minute(ts) + 30 + (event_id % 4) * 15 AS INT) e, CAST(ts AS DATE) d,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END is_online, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END location_known,
  CASE WHEN event_type = 'signup' THEN NULL ELSE CAST(43.0 AS DOUBLE) + (event_id % 10) * CAST(0.002 AS DOUBLE) END lat,
  CAST(-89.4 AS DOUBLE) + (event_id % 7) * CAST(0.002 AS DOUBLE) lon FROM events)"""


def interval_conflicts(spark, sf):
    """Events of one user that overlap on the same date."""
    return intervals.conflicts(_meetings(spark, sf), ["user_id"], "event_id")


def gap_transitions(spark, sf):
    """Short walks between events of one user; the entity is the event type, so pairs repeat."""
    return intervals.transitions(_meetings(spark, sf), ["user_id"], "event_type")


def idle_gap_count(spark, sf):
    """Long idle gaps per user and calendar date."""
    m = _meetings(spark, sf)
    return intervals.idle_gaps(m, ["user_id", "start_date"], "event_id").select(
        "user_id", F.col("start_date"), "large_idle_gap_count"
    )


def interval_slices(spark, sf):
    """Concurrency slices per calendar date over all users."""
    return intervals.concurrency(_meetings(spark, sf), ["start_date"], "start_minute_local", "end_minute_local")


def visible_hours(spark, sf):
    return intervals.visible_window(_meetings(spark, sf), ["user_id", "start_date"], "start_minute_local", "end_minute_local")


# --- merges -----------------------------------------------------------------

def _copies(spark, sf):
    """Line items as versions of a part's record: the ship date is the update time."""
    return table(spark, sf, "lineitem").selectExpr(
        "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate",
        "case when l_returnflag = 'A' then l_quantity end as seats",
        "case when l_linestatus = 'O' then l_returnflag end as kind",
        "case when l_discount > 0.05 then l_tax end as fee",
        "case when l_discount < 0.02 then array(l_returnflag, l_linestatus) else array() end as tags",
    )


def first_wins_rows(spark, sf):
    """First line per order and line number; the test table repeats that key."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    order = [F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")]
    return first_wins(li, ["l_orderkey", "l_linenumber"], order)


def union_missing(spark, sf):
    """Parts with a price, plus the parts known only from line items."""
    known = table(spark, sf, "part").filter("p_size <= 30").selectExpr("p_partkey as part", "p_name as name")
    seen = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(
        F.concat(F.lit("from order "), F.min("l_orderkey").cast("string")).alias("name")
    )
    return merging.append_missing(known, seen, ["part"])


def version_merge_coalesce(spark, sf):
    """One record per part: each field from the newest line that has it."""
    priority = [F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_extendedprice")]
    merged = merging.coalesce_versions(_copies(spark, sf), ["l_partkey"], priority, ["seats", "kind", "fee"], ["tags"])
    return merged.withColumn("tags", F.array_join("tags", "|"))


def attribute_latest(spark, sf):
    """Per supplier the newest known value of each attribute."""
    rows = _copies(spark, sf).withColumn("updated", F.year("l_shipdate") * 100 + F.month("l_shipdate")).withColumn(
        "tie", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    )
    return merging.attribute_latest(rows, ["l_suppkey"], ["seats", "kind", "fee"], "updated", "tie")


def alias_primary(spark, sf):
    """Aliases of a supplier with one primary each."""
    li = table(spark, sf, "lineitem").selectExpr(
        "l_suppkey", "concat(l_returnflag, l_linestatus) as alias",
        "l_orderkey * 10 + l_linenumber as position",
        "case when l_quantity > 25 then cast(l_partkey as string) end as label",
        "case when l_quantity = 50 and l_returnflag = 'N' and l_discount = 0.0 then 1 else 0 end as is_primary",
    )
    # The test table repeats (order, line): the label of equal positions is made unique first.
    unique = li.groupBy("l_suppkey", "alias", "position").agg(F.max("label").alias("label"), F.max("is_primary").alias("is_primary"))
    return merging.elect_primary(unique, ["l_suppkey"], "alias", "position", ["label"], "is_primary")


def cross_list_dedupe(spark, sf):
    """One row per (part, line number): the source of the part's own brand group first."""
    li = table(spark, sf, "lineitem").selectExpr(
        "l_partkey", "l_linenumber",
        "concat_ws(':', l_returnflag, lpad(cast(l_orderkey as string), 9, '0'), cast(l_suppkey as string), cast(l_extendedprice as string)) as source",
        "l_returnflag as subject",
        "case when l_quantity > 20 then l_quantity end as seats",
        "case when l_tax > 0.04 then l_tax end as tax",
    )
    return merging.dedupe_cross_listed(
        li, ["l_partkey", "l_linenumber"], "source", F.col("subject"), F.lit("N"), ["seats", "tax"]
    )


def package_note_union(spark, sf):
    """Distinct note fragments per part over its lines, in source order."""
    li = table(spark, sf, "lineitem").selectExpr(
        "l_partkey", "concat_ws(':', lpad(cast(l_orderkey as string), 9, '0'), cast(l_linenumber as string)) as source",
        "concat(l_returnflag, ' | ', l_linestatus, ' |  | ', cast(l_linenumber as string)) as note",
        "case when l_returnflag = 'R' then 0 else 1 end as rank",
    )
    return merging.union_note_fragments(li, ["l_partkey"], "source", F.col("rank"), "note", "notes")


def alias_sets(spark, sf):
    """Distinct non-blank values per part over a scalar and a list column."""
    p = table(spark, sf, "part").selectExpr(
        "p_partkey", "case when p_size > 25 then ' ' else p_brand end as one", "split(p_name, ' ') as many"
    )
    return merging.value_sets(p, "p_partkey", ["one"], ["many"], "value")


def group_unique_propagation(spark, sf):
    """A number known to one member of a group is given to the others when they agree."""
    li = table(spark, sf, "lineitem").selectExpr(
        "l_partkey", "l_linenumber", "l_orderkey", "l_suppkey", "l_extendedprice",
        "case when l_returnflag = 'A' then l_suppkey % 2 end as number",
    )
    return fill_group_value(li, ["l_partkey", "l_linenumber"], ["l_orderkey"], "number")


def _sides(spark, sf):
    """Lines of a part split into preferred (status O) and fallback (status F) lists."""
    li = numbered_lines(table(spark, sf, "lineitem")).selectExpr(
        "l_partkey", "l_orderkey", "l_linenumber", "l_linestatus", "l_suppkey as supp", "l_returnflag as rf", "cast(l_quantity as int) as q"
    )
    keyed = li.selectExpr(
        "l_partkey", "l_orderkey * 1000 + l_linenumber as position", "l_linestatus",
        "case when q > 40 then null else cast(supp as string) end as by_number",
        "concat_ws(':', cast(l_linenumber as string), rf, cast(q % 5 as string)) as by_identity",
        "concat_ws(':', cast(l_linenumber as string), rf) as by_type",
        "cast(l_linenumber as string) as by_session",
        "case when rf = 'A' then null else q end as seats",
        "case when q % 2 = 0 then null else rf end as kind",
    )
    return keyed.filter("l_linestatus = 'O'").drop("l_linestatus"), keyed.filter("l_linestatus = 'F'").drop("l_linestatus")


def nested_list_merge(spark, sf):
    """Two lists per part merged by a logical key, unmatched fallback rows appended."""
    new, old = _sides(spark, sf)
    return merging.merge_keyed_lists(new, old, ["l_partkey"], "position", "by_number", ["seats", "kind"])


def cascade_match(spark, sf):
    """Lines paired through four successively weaker keys."""
    new, old = _sides(spark, sf)
    return merging.cascade_match(new, old, ["l_partkey"], "position", ["by_number", "by_identity", "by_type", "by_session"])


def section_merge(spark, sf):
    """Only preferred rows survive, filled from their matched fallback row."""
    new, old = _sides(spark, sf)
    matches = merging.cascade_match(new, old, ["l_partkey"], "position", ["by_number", "by_identity"])
    return merging.enrich_matched(new, old, matches, ["l_partkey"], "position", ["seats", "kind"]).drop("source")


# --- matching and identity ----------------------------------------------------

def match_three_state(spark, sf):
    """Parts matched to suppliers' offers by (brand, size) pairs and name."""
    part = table(spark, sf, "part")
    keys = ["p_partkey"]
    local = part.selectExpr("p_partkey", "concat(' ', upper(p_name)) as title")
    pairs = part.selectExpr("p_partkey", "lower(p_brand) as subject", "cast(p_size as string) as number").unionByName(
        part.selectExpr("p_partkey", "p_type as subject", "cast(p_size + 1 as string) as number")
    )
    cust = table(spark, sf, "customer")
    external = cust.selectExpr(
        "c_custkey as external_id", "cast(c_custkey % 60 as string) as number",
        "case when c_acctbal > 4000 then 'red bolt' else 'Small  Gear' end as name",
    )
    aliases = cust.selectExpr("c_custkey as external_id", "concat('Brand#', cast(c_custkey % 31 as string)) as subject").unionByName(
        cust.filter("c_acctbal > 9000").selectExpr("c_custkey as external_id", "'ECONOMY' as subject")
    )
    names = cust.filter("c_acctbal < 1000").selectExpr("c_custkey as external_id", "'hot rod' as name")
    return matching.match_courses(local, pairs, external, aliases, names, keys)


def name_match_three_state(spark, sf):
    """Documents' sources matched to customers by a derived display name."""
    local = table(spark, sf, "customer").selectExpr("c_custkey", "concat('user  ', cast(c_custkey % 200 as string)) as display_name")
    external = table(spark, sf, "supplier").selectExpr(
        "s_suppkey as external_id", "concat(' USER ', cast(s_suppkey % 77 as string)) as display_name"
    )
    return matching.match_people(local, external, "c_custkey")


def match_link_rows(spark, sf):
    return matching.match_links(name_match_three_state(spark, sf), ["c_custkey"], "2026-04-12T00:00:00Z")


def unique_fetch_list(spark, sf):
    return matching.fetch_list(name_match_three_state(spark, sf), ["c_custkey"])


def identity_components(spark, sf):
    """Customers as identity records: the net id and e-mail chain records together."""
    records = table(spark, sf, "customer").selectExpr(
        "c_custkey as record_id",
        "case when c_acctbal > 3000 then concat(' N', cast(floor(c_custkey / 3) as string)) end as netid",
        "case when c_acctbal < 6000 then concat('e', cast(floor(c_custkey / 2) as string), '@x') end as email",
        "case when c_mktsegment = 'BUILDING' then null else 'Ann' end as first_name",
        "case when c_mktsegment = 'HOUSEHOLD' then null else cast(c_nationkey as string) end as last_name",
    )
    aliases, _ = identity.collapse_identities(records, "record_id")
    return aliases


def identity_people(spark, sf):
    """People left after the collapse of event records: most of them repeat a few tokens."""
    records = table(spark, sf, "events").selectExpr(
        "event_id as record_id",
        "case when event_type = 'click' then concat('u', cast(user_id as string)) end as netid",
        "case when event_type in ('click', 'view') then concat('m', cast(floor(user_id / 2) as string)) end as email",
        "case when event_type <> 'error' then 'Ann' end as first_name",
        "case when event_type <> 'error' then cast(user_id % 10 as string) end as last_name",
    )
    _, people = identity.collapse_identities(records, "record_id")
    return people.select("instructor_key", "netid", "email", "first_name", "last_name", "record_count")


# --- nested payloads -----------------------------------------------------------

def _payload(spark, sf):
    """Orders and lines nested into the live offering shape, one document per customer."""
    li = numbered_lines(table(spark, sf, "lineitem")).selectExpr(
        "l_orderkey", "l_linenumber", "l_suppkey as supp", "cast(l_quantity as bigint) as q", "l_returnflag as rf"
    )
    section = F.struct(
        F.col("l_linenumber").alias("n"),
        F.col("rf").alias("sectionType"),
        F.create_map(F.lit("total"), F.col("q"), F.lit("aCount"), F.floor(F.col("q") / 2), F.lit("bcCount"), F.floor(F.col("q") / 3)).alias("counts"),
        F.array(F.struct(F.col("supp").alias("id"), F.lit("x").alias("name")), F.struct((F.col("supp") + 1).alias("id"), F.lit("y").alias("name"))).alias("instructors"),
    )
    def by(field):
        return lambda a, b: F.when(a[field] < b[field], -1).when(a[field] > b[field], 1).otherwise(0)

    sections = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(section), by("n")).alias("sections"), F.sum("q").alias("total"))
    orders = table(spark, sf, "orders").join(sections, F.col("o_orderkey") == F.col("l_orderkey"))
    offering = F.struct(
        F.col("o_orderkey").alias("k"),
        F.year("o_orderdate").alias("termCode"),
        F.create_map(F.lit("total"), F.col("total"), F.lit("abCount"), F.floor(F.col("total") / 4), F.lit("nwCount"), F.lit(1).cast("bigint")).alias("cumulative"),
        "sections",
    )
    return orders.groupBy(F.col("o_custkey").alias("course")).agg(F.array_sort(F.collect_list(offering), by("k")).alias("courseOfferings"))


def nested_offerings_flatten(spark, sf):
    flat = flatten_live_offerings(_payload(spark, sf), "course")
    return flat.withColumn("avg_gpa", F.round("avg_gpa", 9))


def nested_term_grades(spark, sf):
    flat = live_course_grades(_payload(spark, sf), "course")
    return flat.select("course", "term_index", "term_code", F.to_json("grades").alias("grades"), "student_count", F.round("avg_gpa", 9).alias("avg_gpa"))


# --- notes and labels ------------------------------------------------------------

def bundle_labels(spark, sf):
    """Bundle label per order from its lines."""
    li = numbered_lines(table(spark, sf, "lineitem")).selectExpr("l_orderkey", "l_linenumber", "l_returnflag as rf", "l_suppkey as supp")
    section = F.struct(
        F.when(F.col("rf") == "A", "LEC").when(F.col("rf") == "N", "DIS").alias("section_type"),
        F.when(F.col("supp") % 5 != 0, F.concat(F.lit("N"), (F.col("supp") % 12).cast("string"))).alias("section_number"),
        F.col("l_linenumber").alias("class_number"),
    )
    return li.groupBy("l_orderkey").agg(F.collect_list(section).alias("sections")).select(
        "l_orderkey", rollups.bundle_label(F.concat(F.lit("O "), F.col("l_orderkey").cast("string")), F.col("sections")).alias("label")
    )


def note_concat(spark, sf):
    """Trimmed distinct notes from several places of a record."""
    o = table(spark, sf, "orders")
    return o.select(
        "o_orderkey",
        rollups.distinct_notes(
            F.array(F.concat(F.lit(" "), "o_orderpriority")),
            F.array(F.col("o_orderstatus"), F.lit("  "), F.when(F.col("o_totalprice") > 200000, F.lit("big"))),
            F.when(F.col("o_orderstatus") == "F", F.array(F.col("o_orderpriority"), F.lit("late"))),
        ).alias("note"),
    )


def _note_packages(spark, sf):
    """Documents as package notes of their source: every line of the whole text is a fragment."""
    return table(spark, sf, "documents").select(
        F.col("source").alias("course"), "doc_id", F.replace("text", F.lit("\n"), F.lit(" | ")).alias("note")
    )


def note_fragments_shared(spark, sf):
    """Fragments promoted to their course with the number of occurrences."""
    shared, _ = rollups.split_shared_notes(_note_packages(spark, sf), "course", "doc_id", "note")
    return shared.select("course", F.md5("fragment").alias("fragment_md5"), "occurrences", F.col("first_seen.doc_id").alias("first_doc"))


def note_fragments_own(spark, sf):
    """What stays with each package after the shared fragments are taken out."""
    _, own = rollups.split_shared_notes(_note_packages(spark, sf), "course", "doc_id", "note")
    return own.select("course", "doc_id", F.md5("package_note").alias("note_md5"), F.length("package_note").alias("note_chars"))


def note_sections(spark, sf):
    """Conversation turns, and one note about careers for each conversation, sorted into sections."""
    turns = table(spark, sf, "conversations").select("conv_id", F.col("turn").cast("int").alias("turn"), F.col("text").alias("note"))
    careers = turns.select("conv_id", F.lit(-1).alias("turn"), F.lit(" all careers, except Grads ").alias("note")).distinct()
    c = turns.unionByName(careers)
    lists = rollups.organize_notes(c, ["conv_id"], "turn", "note")
    return lists.select("conv_id", "section", F.size("notes").alias("notes"), F.md5(F.array_join("notes", "#")).alias("notes_md5"))


def ordered_json_collect(spark, sf):
    """Part types of each brand and size as a sorted JSON list."""
    p = table(spark, sf, "part").select("p_brand", "p_size", "p_type").distinct()
    return rollups.sorted_json_list(p, ["p_brand", "p_size"], "p_type", "types", "n")


def weighted_mean_zero_guard(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("w", F.when(F.col("l_returnflag") == "A", F.lit(0)).otherwise(F.col("l_linenumber")))
    return li.groupBy("l_partkey", "l_returnflag").agg(F.round(rollups.weighted_mean(F.col("l_quantity"), F.col("w")), 9).alias("mean"), F.count("*").alias("n"))


def freshest_group_any_flag(spark, sf):
    """Customers whose newest orders (all ties) include an urgent one."""
    o = table(spark, sf, "orders").selectExpr(
        "o_custkey", "o_orderpriority", "case when o_orderstatus = 'P' then null else year(o_orderdate) end as updated"
    )
    return rollups.freshest_group(o, ["o_custkey"], "updated").filter("o_orderpriority = '1-URGENT'").select("o_custkey").distinct()


QUERIES = {
    f.__name__: f
    for f in [
        interval_conflicts, gap_transitions, idle_gap_count, interval_slices, visible_hours, first_wins_rows, union_missing,
        version_merge_coalesce, attribute_latest, alias_primary, cross_list_dedupe, package_note_union, alias_sets,
        group_unique_propagation, nested_list_merge, cascade_match, section_merge, match_three_state, name_match_three_state,
        match_link_rows, unique_fetch_list, identity_components, identity_people, nested_offerings_flatten, nested_term_grades,
        bundle_labels, note_concat, note_fragments_shared, note_fragments_own, note_sections, ordered_json_collect,
        weighted_mean_zero_guard, freshest_group_any_flag,
    ]
}

_COPY = """copies AS (SELECT *, CASE WHEN l_returnflag = 'A' THEN l_quantity END seats, CASE WHEN l_linestatus = 'O' THEN l_returnflag END kind,
  CASE WHEN l_discount > 0.05 THEN l_tax END fee, CASE WHEN l_discount < 0.02 THEN l_returnflag || '|' || l_linestatus END tags FROM lineitem)"""

_SIDE = f"""g AS (SELECT l_partkey, l_orderkey, l_linenumber, l_linestatus, l_suppkey supp, l_returnflag rf, CAST(l_quantity AS INT) q FROM {NUMBERED}),
k AS (SELECT l_partkey, l_orderkey * 1000 + l_linenumber AS position, l_linestatus, CASE WHEN q > 40 THEN NULL ELSE CAST(supp AS VARCHAR) END k1,
  concat_ws(':', l_linenumber, rf, q % 5) k2, concat_ws(':', l_linenumber, rf) k3, CAST(l_linenumber AS VARCHAR) k4,
  CASE WHEN rf = 'A' THEN NULL ELSE q END seats, CASE WHEN q % 2 = 0 THEN NULL ELSE rf END kind FROM g)"""


def _stages(n: int) -> str:
    """Matching stages as SQL: stage i pairs keys unique among the rows stages before it left over."""
    parts, done = [], []
    for i in range(1, n + 1):
        skip = {
            side: "".join(f" AND NOT EXISTS (SELECT 1 FROM m{j} WHERE m{j}.l_partkey = k.l_partkey AND m{j}.{side}_position = k.position)" for j in done)
            for side in ("preferred", "fallback")
        }
        one = {
            side: f"SELECT l_partkey, k{i} key, min(position) pos FROM k WHERE l_linestatus = '{status}' AND k{i} IS NOT NULL{skip[side]} GROUP BY 1, 2 HAVING count(*) = 1"
            for side, status in (("preferred", "O"), ("fallback", "F"))
        }
        parts.append(
            f"m{i} AS (SELECT a.l_partkey, a.pos preferred_position, b.pos fallback_position, {i} stage FROM ({one['preferred']}) a JOIN ({one['fallback']}) b USING (l_partkey, key))"
        )
        done.append(i)
    return ", ".join(parts)


_MATCH = """pp AS (SELECT p_partkey, upper(p_brand) s, CAST(p_size AS VARCHAR) n, upper(p_name) t FROM part
  UNION ALL SELECT p_partkey, upper(p_type), CAST(p_size + 1 AS VARCHAR), upper(p_name) FROM part),
x AS (SELECT c_custkey id, CAST(c_custkey % 60 AS VARCHAR) n, CASE WHEN c_acctbal > 4000 THEN 'RED BOLT' ELSE 'SMALL GEAR' END t, c_acctbal FROM customer),
xs AS (SELECT id, n, t, 'BRAND#' || CAST(id % 31 AS VARCHAR) s FROM x UNION ALL SELECT id, n, t, 'ECONOMY' FROM x WHERE c_acctbal > 9000),
cand AS (SELECT DISTINCT p_partkey, id, xs.t = pp.t same FROM pp JOIN xs ON xs.s = pp.s AND xs.n = pp.n),
agg AS (SELECT p.p_partkey, upper(p.p_name) t, count(c.id) n, count(*) FILTER (c.same) nt, min(c.id) lo, min(c.id) FILTER (c.same) tlo
  FROM part p LEFT JOIN cand c ON c.p_partkey = p.p_partkey GROUP BY 1, 2),
named AS (SELECT agg.*, EXISTS (SELECT 1 FROM x WHERE x.id = lo AND (x.t = agg.t OR (x.c_acctbal < 1000 AND agg.t = 'HOT ROD'))) named FROM agg)"""

_PEOPLE_MATCH = """ext AS (SELECT 'USER ' || CAST(s_suppkey % 77 AS VARCHAR) n, count(DISTINCT s_suppkey) c, min(s_suppkey) lo FROM supplier GROUP BY 1),
pm AS (SELECT c_custkey, CASE WHEN c IS NULL THEN 'unmatched' WHEN c = 1 THEN 'matched' ELSE 'ambiguous' END match_status,
  CASE WHEN c = 1 THEN 'normalized-name-exact' END match_method, CASE WHEN c = 1 THEN lo END external_id,
  CASE WHEN c IS NULL THEN 'No external instructor matched the normalized full name'
    WHEN c > 1 THEN 'Multiple external instructors matched the normalized full name' END match_note
  FROM customer LEFT JOIN ext ON n = 'USER ' || CAST(c_custkey % 200 AS VARCHAR))"""

_NEST = f"""g AS (SELECT l_orderkey, l_linenumber, l_suppkey supp, CAST(l_quantity AS BIGINT) q, l_returnflag rf FROM {NUMBERED}),
o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 ti FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM g))"""

_NOTE = r"""f0 AS (SELECT source course, doc_id, unnest(string_split(replace(text, chr(10), ' | '), ' | ')) fragment,
  generate_subscripts(string_split(replace(text, chr(10), ' | '), ' | '), 1) AS pos FROM documents),
f AS (SELECT course, doc_id, pos, trim(fragment) fragment FROM f0 WHERE trim(fragment) <> ''),
c AS (SELECT course, fragment, count(*) occurrences, min(doc_id) first_doc FROM f GROUP BY 1, 2),
sh AS (SELECT * FROM c WHERE occurrences > 1 OR length(fragment) >= 160 OR contains(fragment, chr(10))
  OR regexp_matches(fragment, '(?i)\bcareers?\b|\blaptop\b|\bcomputer\b|\bphone\b|https?://|\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b'))"""

ORACLES = {
    "interval_conflicts": f"""WITH {_M} SELECT DISTINCT a.user_id, a.event_id, b.event_id other_event_id FROM m a JOIN m b
        ON a.user_id = b.user_id AND a.d = b.d AND a.event_id <> b.event_id AND a.s < b.e AND b.s < a.e""",
    "gap_transitions": f"""WITH {_M}, u AS (SELECT DISTINCT user_id, event_type, day_bit, s, e, d, lat, lon FROM m WHERE is_online = 0 AND location_known = 1),
        t AS (SELECT a.user_id, a.event_type f, b.event_type t, a.day_bit, b.s - a.e gap,
          pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) h
          FROM u a JOIN u b ON a.user_id = b.user_id AND a.d = b.d AND a.event_type <> b.event_type AND b.s - a.e BETWEEN 0 AND 45),
        w AS (SELECT *, CAST(floor(6371000 * 2 * atan2(sqrt(h), sqrt(1 - h)) + 0.5) AS BIGINT) walk FROM t),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id, f, t ORDER BY gap, coalesce(walk, 2147483647)) rk,
          bit_or(day_bit) OVER (PARTITION BY user_id, f, t) mask FROM w)
        SELECT user_id, f from_event_type, t to_event_type, CAST(mask AS INT) shared_days_mask, gap gap_minutes, walk walking_distance_meters,
        CASE WHEN gap < 10 OR (gap < 15 AND coalesce(walk, 0) > 200) THEN 1 ELSE 0 END is_tight_transition FROM r WHERE rk = 1""",
    "idle_gap_count": f"""WITH {_M}, p AS (SELECT *, lag(e) OVER (PARTITION BY user_id, d ORDER BY s, e, event_id) pe FROM m)
        SELECT user_id, epoch_ms(CAST(d AS TIMESTAMP)) start_date, count(*) FILTER (s - pe >= 90) large_idle_gap_count FROM p GROUP BY 1, 2""",
    "interval_slices": f"""WITH {_M}, b AS (SELECT d, s AS p FROM m UNION SELECT d, e FROM m),
        sl AS (SELECT d, p, lead(p) OVER (PARTITION BY d ORDER BY p) n FROM b)
        SELECT epoch_ms(CAST(sl.d AS TIMESTAMP)) start_date, p slice_start, n slice_end, count(*) active
        FROM sl JOIN m ON m.d = sl.d AND m.s < n AND m.e > p WHERE n IS NOT NULL GROUP BY 1, 2, 3""",
    "visible_hours": f"""WITH {_M} SELECT user_id, epoch_ms(CAST(d AS TIMESTAMP)) start_date, CAST(least(540, min(s) // 60 * 60) AS INT) window_start,
        CAST(greatest(1020, (max(e) + 59) // 60 * 60) AS INT) window_end FROM m GROUP BY 1, 2""",
    "first_wins_rows": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (
        PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) rk FROM lineitem) WHERE rk = 1""",
    "union_missing": """SELECT p_partkey part, p_name AS name FROM part WHERE p_size <= 30
        UNION ALL SELECT l_partkey, 'from order ' || CAST(min(l_orderkey) AS VARCHAR) FROM lineitem
        WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 30) GROUP BY 1""",
    "version_merge_coalesce": f"""WITH {_COPY} SELECT l_partkey, {", ".join(
        f"first({c} ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) FILTER ({c} IS NOT NULL) {c}"
        for c in ("seats", "kind", "fee", "tags"))} FROM copies GROUP BY 1""",
    "attribute_latest": f"""WITH {_COPY} SELECT l_suppkey, {", ".join(
        f"first({c} ORDER BY date_trunc('month', l_shipdate) DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) FILTER ({c} IS NOT NULL) {c}"
        for c in ("seats", "kind", "fee"))} FROM copies GROUP BY 1""",
    "alias_primary": """WITH r AS (SELECT l_suppkey, l_returnflag || l_linestatus alias, l_orderkey * 10 + l_linenumber pos,
          max(CASE WHEN l_quantity > 25 THEN CAST(l_partkey AS VARCHAR) END) label,
          max(CASE WHEN l_quantity = 50 AND l_returnflag = 'N' AND l_discount = 0.0 THEN 1 ELSE 0 END) own FROM lineitem GROUP BY 1, 2, 3),
        a AS (SELECT l_suppkey, alias, first(label ORDER BY pos) FILTER (label IS NOT NULL) label, max(own) own, min(pos) lead_pos FROM r GROUP BY 1, 2)
        SELECT l_suppkey, alias, label, CASE WHEN max(own) OVER (PARTITION BY l_suppkey) = 1 THEN own
          ELSE CASE WHEN lead_pos = min(lead_pos) OVER (PARTITION BY l_suppkey) THEN 1 ELSE 0 END END is_primary FROM a""",
    "cross_list_dedupe": """WITH r AS (SELECT l_partkey, l_linenumber, l_returnflag || ':' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || ':' || CAST(l_suppkey AS VARCHAR)
          || ':' || CAST(l_extendedprice AS VARCHAR) source, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END rk,
          CASE WHEN l_quantity > 20 THEN l_quantity END seats, CASE WHEN l_tax > 0.04 THEN l_tax END tax FROM lineitem)
        SELECT l_partkey, l_linenumber, first(source ORDER BY rk, source) source, first(seats ORDER BY rk, source) FILTER (seats IS NOT NULL) seats,
        first(tax ORDER BY rk, source) FILTER (tax IS NOT NULL) tax FROM r GROUP BY 1, 2""",
    "package_note_union": """WITH r AS (SELECT l_partkey, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END rk, lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || ':' || CAST(l_linenumber AS VARCHAR) src,
          unnest([l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR)]) f, unnest([1, 2, 4]) AS pos FROM lineitem),
        d AS (SELECT l_partkey, f, min((rk, src, pos)) k FROM r GROUP BY 1, 2)
        SELECT l_partkey, string_agg(f, ' | ' ORDER BY k) notes FROM d GROUP BY 1""",
    "alias_sets": """SELECT DISTINCT p_partkey, v AS value FROM (SELECT p_partkey, p_brand v FROM part WHERE p_size <= 25
        UNION ALL SELECT p_partkey, unnest(string_split(p_name, ' ')) FROM part)""",
    "group_unique_propagation": """WITH r AS (SELECT l_partkey, l_linenumber, l_orderkey, l_suppkey, l_extendedprice, CASE WHEN l_returnflag = 'A' THEN l_suppkey % 2 END n FROM lineitem),
        g AS (SELECT l_partkey, l_linenumber, min(n) lo, max(n) hi, count(*) rows_n, count(DISTINCT l_orderkey) members FROM r GROUP BY 1, 2)
        SELECT r.l_partkey, r.l_linenumber, l_orderkey, l_suppkey, l_extendedprice,
        coalesce(n, CASE WHEN lo = hi AND rows_n = members THEN lo END) number FROM r JOIN g USING (l_partkey, l_linenumber)""",
    "nested_list_merge": f"""WITH {_SIDE}, {_stages(1)}
        SELECT a.l_partkey, a.position, coalesce(a.seats, b.seats) seats, coalesce(a.kind, b.kind) kind, 0 source FROM k a
        LEFT JOIN m1 ON m1.l_partkey = a.l_partkey AND preferred_position = a.position
        LEFT JOIN k b ON b.l_linestatus = 'F' AND b.l_partkey = a.l_partkey AND b.position = fallback_position WHERE a.l_linestatus = 'O'
        UNION ALL SELECT l_partkey, position, seats, kind, 1 FROM k WHERE l_linestatus = 'F'
          AND NOT EXISTS (SELECT 1 FROM m1 WHERE m1.l_partkey = k.l_partkey AND fallback_position = k.position)""",
    "cascade_match": f"""WITH {_SIDE}, {_stages(4)} SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3 UNION ALL SELECT * FROM m4""",
    "section_merge": f"""WITH {_SIDE}, {_stages(2)}, mm AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2)
        SELECT a.l_partkey, a.position, coalesce(a.seats, b.seats) seats, coalesce(a.kind, b.kind) kind FROM k a
        LEFT JOIN mm ON mm.l_partkey = a.l_partkey AND preferred_position = a.position
        LEFT JOIN k b ON b.l_linestatus = 'F' AND b.l_partkey = a.l_partkey AND b.position = fallback_position WHERE a.l_linestatus = 'O'""",
    "match_three_state": f"""WITH {_MATCH} SELECT p_partkey,
        CASE WHEN n = 0 THEN 'unmatched' WHEN n = 1 OR nt = 1 THEN 'matched' WHEN nt > 1 THEN 'ambiguous' ELSE 'unmatched' END match_status,
        CASE WHEN n = 1 AND named THEN 'subject-code+catalog-number' WHEN n = 1 THEN 'subject-code+catalog-number-only'
          WHEN nt = 1 THEN 'subject-code+catalog-number+title' END match_method,
        CASE WHEN n = 1 THEN lo WHEN nt = 1 THEN tlo END external_id,
        CASE WHEN n = 0 THEN 'No external course matched any subject/code pair' WHEN n = 1 OR nt = 1 THEN NULL
          WHEN nt > 1 THEN 'Multiple external courses matched subject/code and title filters'
          ELSE 'No external course matched the normalized title after subject/code filtering' END match_note FROM named""",
    "name_match_three_state": f"WITH {_PEOPLE_MATCH} SELECT * FROM pm",
    "match_link_rows": f"""WITH {_PEOPLE_MATCH} SELECT c_custkey, external_id, match_status,
        CASE WHEN match_status = 'matched' THEN '2026-04-12T00:00:00Z' END matched_at FROM pm""",
    "unique_fetch_list": f"""WITH {_PEOPLE_MATCH} SELECT external_id, row_number() OVER (ORDER BY min(c_custkey)) fetch_id FROM pm
        WHERE match_status = 'matched' GROUP BY 1""",
    "identity_components": """WITH RECURSIVE r AS (SELECT c_custkey id, CASE WHEN c_acctbal > 3000 THEN 'n' || CAST(c_custkey // 3 AS VARCHAR) END net,
          CASE WHEN c_acctbal < 6000 THEN 'e' || CAST(c_custkey // 2 AS VARCHAR) || '@x' END mail,
          CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE 'ann' END fn, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END ln
          FROM customer),
        e AS (SELECT DISTINCT a.id x, b.id y FROM r a JOIN r b ON a.net = b.net OR a.mail = b.mail),
        w AS (SELECT id x, id y FROM r UNION SELECT w.x, e.y FROM w JOIN e ON e.x = w.y),
        c AS (SELECT x id, min(y) root FROM w GROUP BY 1),
        m AS (SELECT root, first(net ORDER BY r.id DESC) FILTER (net IS NOT NULL) net, first(mail ORDER BY r.id DESC) FILTER (mail IS NOT NULL) mail
          FROM r JOIN c USING (id) GROUP BY 1)
        SELECT r.id record_id, coalesce('netid:' || m.net, 'email:' || m.mail) instructor_key FROM r JOIN c USING (id) JOIN m USING (root)""",
    "identity_people": """WITH r AS (SELECT event_id id, CASE WHEN event_type = 'click' THEN 'u' || CAST(user_id AS VARCHAR) END net,
          CASE WHEN event_type IN ('click', 'view') THEN 'm' || CAST(user_id // 2 AS VARCHAR) END mail,
          CASE WHEN event_type <> 'error' THEN 'Ann' END fn, CASE WHEN event_type <> 'error' THEN CAST(user_id % 10 AS VARCHAR) END ln FROM events),
        g AS (SELECT *, CASE WHEN mail IS NOT NULL THEN mail WHEN fn IS NOT NULL THEN 'name:' || ln ELSE 'id:' || CAST(id AS VARCHAR) END grp FROM r),
        p AS (SELECT grp, max(id) last_id, count(*) record_count, first(net ORDER BY id DESC) FILTER (net IS NOT NULL) netid,
          first(mail ORDER BY id DESC) FILTER (mail IS NOT NULL) email, first(fn ORDER BY id DESC) FILTER (fn IS NOT NULL) first_name,
          first(ln ORDER BY id DESC) FILTER (ln IS NOT NULL) last_name FROM g GROUP BY 1)
        SELECT coalesce('netid:' || netid, 'email:' || email, 'name:ann:' || last_name, 'instructor:' || CAST(last_id AS VARCHAR)) instructor_key,
        netid, email, first_name, last_name, record_count FROM p""",
    "nested_offerings_flatten": f"""WITH {_NEST} SELECT o_custkey course, CAST(year(o_orderdate) AS VARCHAR) term_code, CAST(ti AS INT) term_index,
        CAST(row_number() OVER (PARTITION BY o_orderkey, ii ORDER BY l_linenumber) - 1 AS INT) section_index, CAST(ii AS INT) instructor_index, supp + ii instructor_id,
        rf section_type, q student_count, CASE WHEN q > 0 THEN round(((q // 2) * 4 + (q // 3) * 2.5::DOUBLE) / q, 9) ELSE 0 END avg_gpa
        FROM o JOIN g ON l_orderkey = o_orderkey, range(2) x(ii)""",
    "nested_term_grades": f"""WITH {_NEST}, t AS (SELECT l_orderkey, CAST(sum(q) AS BIGINT) total FROM g GROUP BY 1)
        SELECT o_custkey course, CAST(ti AS INT) term_index, CAST(year(o_orderdate) AS VARCHAR) term_code,
        '{{"ab":' || CAST(total // 4 AS VARCHAR) || ',"W":1}}' grades, total student_count,
        CASE WHEN total > 0 THEN round((total // 4) * 3.5::DOUBLE / total, 9) ELSE 0 END avg_gpa FROM o JOIN t ON l_orderkey = o_orderkey""",
    "bundle_labels": f"""WITH g AS (SELECT l_orderkey, l_linenumber, l_returnflag rf, l_suppkey supp FROM {NUMBERED}),
        s AS (SELECT l_orderkey, l_linenumber, CASE rf WHEN 'A' THEN 'LEC' WHEN 'N' THEN 'DIS' ELSE 'SEC' END t, CASE rf WHEN 'A' THEN 0 WHEN 'N' THEN 3 ELSE 99 END r,
          CASE WHEN supp % 5 <> 0 THEN 'N' || CAST(supp % 12 AS VARCHAR) END n, CASE WHEN supp % 5 <> 0 THEN supp % 12 ELSE -1 END nn FROM g)
        SELECT l_orderkey, 'O ' || CAST(l_orderkey AS VARCHAR) || ' ' || string_agg(t || ' ' || coalesce(n, '???'), ' + '
          ORDER BY r, CASE WHEN n IS NULL THEN 0 ELSE 1 END, nn, l_linenumber) label FROM s GROUP BY 1""",
    "note_concat": """SELECT o_orderkey, o_orderpriority || ' | ' || o_orderstatus || CASE WHEN o_totalprice > 200000 THEN ' | big' ELSE '' END
        || CASE WHEN o_orderstatus = 'F' THEN ' | late' ELSE '' END note FROM orders""",
    "note_fragments_shared": f"WITH {_NOTE} SELECT course, md5(fragment) fragment_md5, occurrences, first_doc FROM sh",
    "note_fragments_own": f"""WITH {_NOTE}, own AS (SELECT course, doc_id, string_agg(fragment, ' | ' ORDER BY pos) t FROM f
          WHERE NOT EXISTS (SELECT 1 FROM sh WHERE sh.course = f.course AND sh.fragment = f.fragment) GROUP BY 1, 2)
        SELECT d.source course, d.doc_id, md5(t) note_md5, CAST(length(t) AS INT) note_chars FROM documents d LEFT JOIN own ON own.doc_id = d.doc_id""",
    "note_sections": r"""WITH n AS (SELECT conv_id, turn, text note FROM conversations
          UNION ALL SELECT DISTINCT conv_id, -1, 'Open to all student careers except graduate students.' FROM conversations),
        s AS (SELECT *, CASE WHEN regexp_matches(note, '(?i)\btextbook\b|\btexts?\b|\bbooks?\b|\bo''reilly\b|\blibrary\b|\bedition\b|\bhardcopy\b') THEN 'Textbooks'
          WHEN regexp_matches(note, '(?i)\bcareers?\b|\bcontact us\b|\bphone\b|\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b') THEN 'Notes'
          WHEN (length(note) >= 160 OR contains(note, chr(10))) AND regexp_matches(note, '(?i)physical attendance|team project|typical weekly schedule|\bkeywords\b|\bformat\b|software engineering|agile|scrum|pair programming|practical exam|mid-?term|final exam')
            THEN 'Instructor description'
          WHEN length(note) >= 160 OR contains(note, chr(10)) THEN 'Notes' ELSE 'Visible' END AS section FROM n)
        SELECT conv_id, section, CAST(count(*) AS INT) notes, md5(string_agg(note, '#' ORDER BY turn, note)) notes_md5 FROM s GROUP BY 1, 2""",
    "ordered_json_collect": """SELECT p_brand, p_size, '["' || string_agg(p_type, '","' ORDER BY p_type) || '"]' types, count(*) n
        FROM (SELECT DISTINCT p_brand, p_size, p_type FROM part) GROUP BY 1, 2""",
    "weighted_mean_zero_guard": """SELECT l_partkey, l_returnflag, CASE WHEN l_returnflag = 'A' THEN NULL
        ELSE round(sum(l_quantity * l_linenumber) / sum(l_linenumber), 9) END mean, count(*) n FROM lineitem GROUP BY 1, 2""",
    "freshest_group_any_flag": """WITH o AS (SELECT o_custkey, o_orderpriority, coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE year(o_orderdate) END, -1) u FROM orders)
        SELECT DISTINCT o_custkey FROM (SELECT *, max(u) OVER (PARTITION BY o_custkey) f FROM o) WHERE u = f AND o_orderpriority = '1-URGENT'""",
}
