"""Scalar functions over events, parts, orders and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterloom.functions import availability as av
from rosterloom.functions import calendar as cal
from rosterloom.functions import grades as gr
from rosterloom.functions import text as tx
from rosterloom.operators import history, rollups, versions
from workload.standin import table

EPOCH = "timestamp_ntz'1970-01-01'"


def _events(spark, sf):
    """Events with a weekday text, epoch milliseconds and seat-like counts."""
    letter = "substr('MTWRFSU', weekday(ts) + 1, 1)"
    second = "substr('MTWRFSU', (weekday(ts) + 3) % 7 + 1, 1)"
    return table(spark, sf, "events").selectExpr(
        "event_id", "user_id", "event_type", "value", "props", "ts",
        f"timestampdiff(MILLISECOND, {EPOCH}, ts) as ms",
        f"""case event_type when 'click' then lower(concat({letter}, 'x')) when 'view' then concat({letter}, ' ', {second})
            when 'error' then null when 'purchase' then '?' else concat({second}, {letter}, {second}) end as days""",
        "case when event_type = 'error' then null else cast(floor(value) as int) - 20 end as open_seats",
        "case when event_type = 'view' then null else cast(event_id % 3 as int) end as waiting",
    )


_EV = """ev AS (SELECT *, isodow(ts) - 1 dow, epoch_ms(ts) ms,
  substr('MTWRFSU', isodow(ts), 1) d1, substr('MTWRFSU', (isodow(ts) + 2) % 7 + 1, 1) d2,
  CASE event_type WHEN 'click' THEN lower(substr('MTWRFSU', isodow(ts), 1) || 'x')
    WHEN 'view' THEN substr('MTWRFSU', isodow(ts), 1) || ' ' || substr('MTWRFSU', (isodow(ts) + 2) % 7 + 1, 1) WHEN 'error' THEN NULL WHEN 'purchase' THEN '?'
    ELSE substr('MTWRFSU', (isodow(ts) + 2) % 7 + 1, 1) || substr('MTWRFSU', isodow(ts), 1) || substr('MTWRFSU', (isodow(ts) + 2) % 7 + 1, 1) END AS days,
  CASE event_type WHEN 'click' THEN (1 << (isodow(ts) - 1)) WHEN 'view' THEN (1 << (isodow(ts) - 1)) | (1 << ((isodow(ts) + 2) % 7))
    WHEN 'signup' THEN (1 << (isodow(ts) - 1)) | (1 << ((isodow(ts) + 2) % 7)) END mask,
  CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value) AS INT) - 20 END open_seats,
  CASE WHEN event_type = 'view' THEN NULL ELSE CAST(event_id % 3 AS INT) END waiting FROM events)"""


def tri_state_flags(spark, sf):
    e = _events(spark, sf)
    return e.select(
        "event_id",
        av.positive_flag(F.col("open_seats")).alias("has_open_seats"),
        av.positive_flag(F.col("waiting")).alias("has_waitlist"),
        av.full_flag(F.col("open_seats")).alias("is_full"),
    )


def weekday_mask(spark, sf):
    mask = cal.days_mask(F.col("days"))
    return _events(spark, sf).select("event_id", mask.alias("days_mask"), cal.mask_size(mask).alias("day_count"))


def mask_expand(spark, sf):
    """Events per user and weekday bit."""
    bits = _events(spark, sf).select("user_id", F.explode(cal.mask_bits(cal.days_mask(F.col("days")))).alias("day_bit"))
    return bits.groupBy("user_id", "day_bit").agg(F.count("*").alias("entries"))


def weekday_letters(spark, sf):
    return _events(spark, sf).select("event_id", F.array_join(cal.day_letters(F.col("days")), ",").alias("letters"))


def local_minutes(spark, sf):
    minute = cal.local_minute(F.col("ms"))
    return _events(spark, sf).select(
        "event_id",
        minute.alias("minute_local"),
        cal.minutes_text(minute).alias("clock_text"),
        cal.local_month_day(F.col("ms")).alias("month_day"),
        cal.local_minute_or_pass(F.when(F.col("event_type") == "click", F.col("event_id") % 1441).otherwise(F.col("ms"))).alias("minute_or_pass"),
        cal.duration(minute, (F.col("event_id") % 1440).cast("int")).alias("duration"),
    )


def clock_text_minutes(spark, sf):
    text = F.concat(
        F.lpad((F.col("event_id") % 30).cast("string"), 2, "0"),
        F.lit(":"),
        F.when(F.col("event_type") == "click", (F.col("event_id") % 70).cast("string")).otherwise(
            F.lpad((F.col("event_id") % 70).cast("string"), 2, "0")
        ),
    )
    return _events(spark, sf).select("event_id", cal.clock_text_to_minutes(text).alias("minutes"))


def online_regex(spark, sf):
    mode = F.when(F.col("o_orderstatus") == "F", F.lit(None)).otherwise(
        F.element_at(F.array(*[F.lit(x) for x in ["Online Only", "ASYNCHRONOUS video", "Classroom Instruction", "Distance", "Lab"]]),
                     F.substring("o_orderpriority", 1, 1).cast("int"))
    )
    note = F.concat(F.lit("Seats: restrictions "), F.when(F.col("o_orderstatus") == "O", "will be lifted").otherwise("apply"), F.lit("."))
    return table(spark, sf, "orders").select(
        "o_orderkey", av.online_mode(mode).alias("is_online"), av.temporary_restriction(note).alias("has_temporary_restriction")
    )


def haversine_pairs(spark, sf):
    """Distance between the customer's and the supplier's nation, per pair that trades."""
    nation = table(spark, sf, "nation").selectExpr(
        "n_nationkey", "cast(n_nationkey * 3 - 36 as double) as lat", "cast(n_nationkey * 13 - 150 as double) as lon"
    )
    pairs = (
        table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
        .join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("c_nationkey", "s_nationkey")
        .agg(F.count("*").alias("lines"))
    )
    a = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    metres = cal.haversine_metres(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return pairs.join(a, "c_nationkey").join(b, "s_nationkey").select("c_nationkey", "s_nationkey", "lines", metres.alias("metres"))


def normalize_tokens(spark, sf):
    """Tokens of whole pages and their addresses."""
    return table(spark, sf, "pages").select(
        "page_id",
        tx.search_text(F.col("url")).alias("url_tokens"),
        F.size(tx.search_tokens(F.col("html"))).alias("html_tokens"),
        tx.squeeze(F.concat(F.lit("  "), F.col("url"), F.lit(" \n x "))).alias("squeezed"),
        tx.match_text(F.concat(F.lit(" a  b "), F.col("url"))).alias("match_form"),
        tx.key_part(F.when(F.length("url") > 30, F.lit("  ")).otherwise(F.col("url"))).alias("key_form"),
    )


def compact_key(spark, sf):
    name = F.concat(F.lit("L I "), F.col("p_type"), F.lit("-"), F.col("p_partkey").cast("string"), F.lit(" "), F.col("p_name"))
    return table(spark, sf, "part").select(
        "p_partkey", tx.compact_designation(name).alias("compact"), tx.compact_designation(F.col("p_name")).alias("no_digit")
    )


def json_field_extract(spark, sf):
    broken = F.when(F.col("event_type") == "error", F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    return _events(spark, sf).select(
        "event_id", tx.valid_json(broken).cast("int").alias("valid"), F.get_json_object("props", "$.k").cast("int").alias("k")
    )


def json_list_parse(spark, sf):
    """String lists built, validated and parsed back; anything else, lists of other things too, is empty."""
    size = F.col("p_size").cast("string")
    text = (
        F.when(F.col("p_size") > 40, F.lit("not json"))
        .when(F.col("p_size") > 25, F.lit(None))
        .when(F.col("p_size") > 20, F.concat(F.lit('["a",'), size, F.lit("]")))
        .when(F.col("p_size") > 15, F.concat(F.lit('[{"x":'), size, F.lit("}]")))
        .otherwise(F.to_json(F.array("p_name", "p_type")))
    )
    named = F.to_json(F.array(F.array("p_name"), F.array("p_type", "p_brand")))
    groups = F.when(F.col("p_size") > 30, F.concat(F.lit('[["a"],['), size, F.lit("]]"))).otherwise(named)
    parsed = table(spark, sf, "part").select(
        "p_partkey", tx.string_list(text).alias("items"), tx.string_groups(groups).alias("groups")
    )
    return parsed.select(
        "p_partkey", F.size("items").alias("n_items"), F.array_join("items", "|").alias("joined"),
        F.size("groups").alias("n_groups"), F.array_join(F.get("groups", 1), "|").alias("second"),
    )


def synthetic_negative_id(spark, sf):
    """Stable negative numbers for documents, seeded by source and language."""
    docs = table(spark, sf, "documents").select(
        "doc_id", "source", F.concat_ws(":", "source", "lang").alias("seed"),
        F.when(F.col("n_chars") > 2000, F.col("n_chars")).alias("number"),
    )
    return versions.synthetic_numbers(docs, "source", "doc_id", "seed", "number", "class_number").select("doc_id", "class_number")


def occurrence_numbers(spark, sf):
    """Occurrence of each event within its user and type, by event id."""
    return versions.number_in_group(
        table(spark, sf, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id", "occurrence"
    )


def dense_identifiers(spark, sf):
    """Dense ids of all parts in name order."""
    return versions.dense_ids(table(spark, sf, "part").select("p_name", "p_partkey"), ["p_name", "p_partkey"], "dense_id")


def _daily_maps(spark, sf):
    """Live-style grade maps per user and day; error events carry no map."""
    code = F.create_map(*[F.lit(x) for x in [
        "click", "aCount", "view", "abCount", "error", "nwCount", "purchase", "fCount", "signup", "sCount"]])
    counted = table(spark, sf, "events").select(
        "user_id", F.dayofmonth("ts").alias("day"), F.element_at(code, F.col("event_type")).alias("code")
    ).groupBy("user_id", "day", "code").agg(F.count("*").alias("n"))
    return counted.groupBy("user_id", "day").agg(
        F.map_concat(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))), F.create_map(F.lit("total"), F.sum("n"))
        ).alias("cumulative")
    )


def map_merge_sum(spark, sf):
    """Grade maps merged per user and week with the all-students mean."""
    weekly = _daily_maps(spark, sf).withColumn("week", F.floor(F.col("day") / 7).cast("int"))
    merged = history.instructor_term_grades(weekly, ["user_id", "week"])
    return merged.select("user_id", "week", "student_count", F.to_json("grades").alias("grades"), F.round("avg_gpa", 9).alias("avg_gpa"))


def gpa_from_counts(spark, sf):
    """Graded-only mean per user; the map keys come in lower case for one type."""
    maps = _daily_maps(spark, sf).select("user_id", gr.live_counts(F.col("cumulative")).alias("counts"))
    merged = rollups.merge_count_maps(maps, ["user_id"], "counts", "counts")
    return merged.select(
        "user_id", F.round(gr.gpa_of_graded(F.col("counts")), 9).alias("gpa"), gr.total_count(F.col("counts")).alias("total")
    )


def ordered_map_rows(spark, sf):
    """Distribution rows per user with their display position."""
    maps = _daily_maps(spark, sf).select("user_id", gr.live_counts(F.col("cumulative")).alias("counts"))
    merged = rollups.merge_count_maps(maps, ["user_id"], "counts", "counts")
    upper = F.transform_keys("counts", lambda k, _: F.upper(k))
    return history.numbered_distribution_rows(merged.select("user_id", upper.alias("grades")), "user_id").select(
        "user_id", "grade_code", "student_count", "position"
    )


def stored_vs_derived(spark, sf):
    """Stored counts and a stored zero mean repaired from the distribution, where there is one."""
    maps = _daily_maps(spark, sf).select("user_id", gr.live_counts(F.col("cumulative")).alias("counts"))
    merged = rollups.merge_count_maps(maps, ["user_id"], "counts", "grades").select(
        "user_id", F.transform_keys("grades", lambda k, _: F.upper(k)).alias("grades")
    )
    stored = table(spark, sf, "customer").selectExpr(
        "c_custkey as user_id", "cast(17 as bigint) as student_count", "case when c_acctbal > 0 then 0.0D else 2.5D end as avg_gpa"
    )
    return history.repair_from_distribution(stored, merged, "user_id").withColumn("avg_gpa", F.round("avg_gpa", 9))


def display_names(spark, sf):
    first = F.when(F.col("s_acctbal") > 0, "Prof")
    last = F.when(F.col("s_acctbal") > -500, F.col("s_name"))
    return table(spark, sf, "supplier").select("s_suppkey", tx.display_name(first, last).alias("display_name"))


def natural_order(spark, sf):
    """First three sources per language in natural number order."""
    d = table(spark, sf, "documents").select("lang", "source").distinct()
    return versions.top_per_key(d, ["lang"], tx.natural_parts(F.col("source")), 3, rank="rank")


QUERIES = {
    f.__name__: f
    for f in [
        tri_state_flags, weekday_mask, mask_expand, weekday_letters, local_minutes, clock_text_minutes, online_regex, haversine_pairs,
        normalize_tokens, compact_key, json_field_extract, json_list_parse, synthetic_negative_id, occurrence_numbers,
        dense_identifiers, map_merge_sum, gpa_from_counts, ordered_map_rows, stored_vs_derived, display_names, natural_order,
    ]
}


def _clock(x: str) -> str:
    return (
        f"CAST(CASE WHEN ({x} // 60) % 12 = 0 THEN 12 ELSE ({x} // 60) % 12 END AS VARCHAR) || ':' || lpad(CAST({x} % 60 AS VARCHAR), 2, '0')"
        f" || CASE WHEN {x} // 60 >= 12 THEN ' PM' ELSE ' AM' END"
    )


_CODES = """codes AS (SELECT user_id, day(ts) AS d, CASE event_type WHEN 'click' THEN 'a' WHEN 'view' THEN 'ab' WHEN 'error' THEN 'W'
  WHEN 'purchase' THEN 'f' ELSE 's' END code, count(*) n FROM events GROUP BY 1, 2, 3)"""

ORACLES = {
    "tri_state_flags": f"""WITH {_EV} SELECT event_id, CASE WHEN open_seats IS NULL THEN NULL WHEN open_seats > 0 THEN 1 ELSE 0 END has_open_seats,
        CASE WHEN waiting IS NULL THEN NULL WHEN waiting > 0 THEN 1 ELSE 0 END has_waitlist,
        CASE WHEN open_seats IS NULL THEN NULL WHEN open_seats <= 0 THEN 1 ELSE 0 END is_full FROM ev""",
    "weekday_mask": f"WITH {_EV} SELECT event_id, CAST(mask AS INT) days_mask, CAST(coalesce(bit_count(mask), 0) AS INT) day_count FROM ev",
    "mask_expand": f"""WITH {_EV} SELECT user_id, CAST(1 << b AS INT) day_bit, count(*) entries FROM ev, range(7) r(b)
        WHERE (mask & (1 << b)) <> 0 GROUP BY 1, 2""",
    "weekday_letters": f"""WITH {_EV} SELECT event_id, CASE event_type WHEN 'click' THEN d1 WHEN 'view' THEN d1 || ',' || d2
        WHEN 'signup' THEN d2 || ',' || d1 ELSE '' END letters FROM ev""",
    "local_minutes": f"""WITH {_EV}, loc AS (SELECT *, ts - INTERVAL 6 HOUR lt, CAST(hour(ts - INTERVAL 6 HOUR) * 60 + minute(ts - INTERVAL 6 HOUR) AS INT) m FROM ev)
        SELECT event_id, m minute_local, {_clock('m')} clock_text, strftime(lt, '%b ') || CAST(day(lt) AS VARCHAR) month_day,
        CASE WHEN event_type = 'click' THEN CAST(event_id % 1441 AS INT) ELSE m END minute_or_pass,
        CAST(greatest(event_id % 1440 - m, 0) AS INT) duration FROM loc""",
    "clock_text_minutes": """SELECT event_id, CASE WHEN event_id % 30 <= 23 AND event_id % 70 <= 59 AND (event_type <> 'click' OR event_id % 70 > 9)
        THEN CAST((event_id % 30) * 60 + event_id % 70 AS INT) END AS minutes FROM events""",
    "online_regex": """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' AND substr(o_orderpriority, 1, 1) IN ('1', '2', '4') THEN 1 ELSE 0 END is_online,
        CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END has_temporary_restriction FROM orders""",
    "haversine_pairs": """WITH n AS (SELECT n_nationkey, CAST(n_nationkey * 3 - 36 AS DOUBLE) lat, CAST(n_nationkey * 13 - 150 AS DOUBLE) lon FROM nation),
        p AS (SELECT c_nationkey, s_nationkey, count(*) AS lines FROM lineitem JOIN orders ON o_orderkey = l_orderkey
          JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2),
        q AS (SELECT p.*, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) h
          FROM p JOIN n a ON a.n_nationkey = c_nationkey JOIN n b ON b.n_nationkey = s_nationkey)
        SELECT c_nationkey, s_nationkey, lines, CAST(floor(6371000 * 2 * atan2(sqrt(h), sqrt(1 - h)) + 0.5) AS BIGINT) metres FROM q""",
    "normalize_tokens": r"""SELECT page_id, array_to_string(regexp_extract_all(lower(url), '[a-z0-9]+'), ' ') url_tokens,
        len(regexp_extract_all(lower(html), '[a-z0-9]+')) html_tokens, url || ' x' squeezed, 'A B ' || upper(url) match_form,
        CASE WHEN length(url) > 30 THEN NULL ELSE lower(url) END key_form FROM pages""",
    "compact_key": """SELECT p_partkey, 'li' || lower(p_type) || ' ' || CAST(p_partkey AS VARCHAR) || ' ' || lower(p_name) compact, lower(p_name) no_digit FROM part""",
    "json_field_extract": """SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END valid, CAST(regexp_extract(props, '[0-9]+') AS INT) k FROM events""",
    "json_list_parse": """SELECT p_partkey, CASE WHEN p_size > 15 THEN 0 ELSE 2 END n_items, CASE WHEN p_size > 15 THEN '' ELSE p_name || '|' || p_type END joined,
        CASE WHEN p_size > 30 THEN 0 ELSE 2 END n_groups, CASE WHEN p_size <= 30 THEN p_type || '|' || p_brand END AS second FROM part""",
    "synthetic_negative_id": """WITH d AS (SELECT doc_id, source, source || ':' || lang seed, CASE WHEN n_chars > 2000 THEN n_chars END number FROM documents),
        m AS (SELECT *, row_number() OVER (PARTITION BY source, seed ORDER BY doc_id) - 1 occ, count(*) OVER (PARTITION BY source, seed) times
          FROM d WHERE number IS NULL),
        s AS (SELECT doc_id, seed || CASE WHEN times > 1 THEN ':package:' || source ELSE '' END || ':occurrence:' || CAST(occ AS VARCHAR) t FROM m)
        SELECT doc_id, number class_number FROM d WHERE number IS NOT NULL
        UNION ALL SELECT doc_id, -(CAST(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(t, ''), lambda x: CAST(ord(x) AS BIGINT))),
          lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS BIGINT) + 1) FROM s""",
    "occurrence_numbers": "SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) occurrence FROM events",
    "dense_identifiers": "SELECT p_name, p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) dense_id FROM part",
    "map_merge_sum": f"""WITH {_CODES}, w AS (SELECT user_id, CAST(d // 7 AS INT) AS week, code, sum(n) n FROM codes GROUP BY 1, 2, 3)
        SELECT user_id, "week", CAST(sum(n) AS BIGINT) student_count, '{{' || string_agg('"' || code || '":' || CAST(n AS VARCHAR), ',' ORDER BY code) || '}}' grades,
        round(sum(n * CASE code WHEN 'a' THEN 4 WHEN 'ab' THEN 3.5 ELSE 0 END) / sum(n), 9)::DOUBLE avg_gpa FROM w GROUP BY 1, 2""",
    "gpa_from_counts": f"""WITH {_CODES}, w AS (SELECT user_id, code, CAST(sum(n) AS DOUBLE) n FROM codes GROUP BY 1, 2)
        SELECT user_id, CASE WHEN coalesce(sum(n) FILTER (code IN ('a', 'ab', 'f')), 0) = 0 THEN 0
          ELSE round(sum(n * CASE code WHEN 'a' THEN 4.0::DOUBLE WHEN 'ab' THEN 3.5::DOUBLE ELSE 0 END) / sum(n) FILTER (code IN ('a', 'ab', 'f')), 9) END gpa,
        CAST(sum(n) AS BIGINT) total FROM w GROUP BY 1""",
    "ordered_map_rows": f"""WITH {_CODES}, w AS (SELECT user_id, upper(code) grade_code, CAST(sum(n) AS BIGINT) student_count FROM codes GROUP BY 1, 2)
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY list_position(['A', 'AB', 'F', 'S', 'W'], grade_code)) AS position FROM w""",
    "stored_vs_derived": f"""WITH {_CODES}, w AS (SELECT user_id, CAST(sum(n) AS BIGINT) total, coalesce(sum(n) FILTER (code IN ('a', 'ab', 'f')), 0)::DOUBLE graded,
          sum(n * CASE code WHEN 'a' THEN 4.0::DOUBLE WHEN 'ab' THEN 3.5::DOUBLE ELSE 0 END) points FROM codes GROUP BY 1)
        SELECT c_custkey user_id, coalesce(total, 17) student_count,
        CASE WHEN c_acctbal > 0 THEN CASE WHEN graded > 0 AND points > 0 THEN round(points / graded, 9) ELSE 0.0 END ELSE 2.5 END avg_gpa
        FROM customer LEFT JOIN w ON user_id = c_custkey""",
    "display_names": """SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN 'Prof ' || s_name WHEN s_acctbal > -500 THEN s_name END display_name FROM supplier""",
    "natural_order": """SELECT lang, source, rank FROM (SELECT lang, source, row_number() OVER (PARTITION BY lang
        ORDER BY CAST(substr(source, 4) AS INT)) rank FROM (SELECT DISTINCT lang, source FROM documents)) WHERE rank <= 3""",
}
