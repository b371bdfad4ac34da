"""Search and requirement text over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterloom.operators import requirements as rq
from rosterloom.operators import search as se
from rosterloom.operators.versions import top_per_key
from rosterloom.session import cut_lineage
from workload.standin import table

KEYS = ["term_code", "course_id"]


def _courses(spark, sf):
    """Parts as courses: several share a designation."""
    return table(spark, sf, "part").selectExpr(
        "'1272' as term_code", "cast(p_partkey as string) as course_id",
        "concat(p_type, ' ', upper(substr(p_name, 1, 1)), ' ', cast(100 + p_partkey % 300 as string)) as course_designation",
        "p_name as title", "concat(p_type, ' ', p_brand, ' size ', cast(p_size as string)) as description",
        "upper(concat(replace(p_brand, '#', ' '), ' ', cast(100 + p_partkey % 300 as string))) as other", "p_size",
    )


def _aliases(courses):
    own = courses.select(*KEYS, "course_designation")
    return own.unionByName(courses.filter("p_size > 25").select(*KEYS, F.col("other").alias("course_designation")))


def _overview(spark, sf):
    """Seat summary of each course from its lines."""
    seats = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("course_id")).agg(
        F.count_distinct("l_linenumber").alias("section_count"),
        F.max((F.col("l_quantity") > 48).cast("int")).alias("has_any_open_seats"),
        F.max((F.col("l_quantity") < 2).cast("int")).alias("has_any_full_section"),
    )
    return _courses(spark, sf).select(*KEYS, "course_designation", "title").join(seats, "course_id", "left")


def _corpus(spark, sf):
    c = _courses(spark, sf)
    return se.build_corpus(_aliases(c), c, KEYS)


def _queries(spark, sf):
    """Search texts taken from the parts: name fragments, brands and designations."""
    p = _courses(spark, sf)
    names = p.selectExpr("concat(substr(title, 1, 3), '! ', split(title, ' ')[1]) as text")
    brands = p.selectExpr("concat(substr(other, 1, 8), '?') as text")
    kinds = p.selectExpr("substring_index(course_designation, ' ', 2) as text")
    return names.unionByName(brands).unionByName(kinds).distinct().withColumn("query_id", F.col("text"))


_SHOWN = ["query_id", "rank", "course_id", "course_designation"]


def search_corpus(spark, sf):
    return _corpus(spark, sf)


def search_prefix_and(spark, sf):
    """Rows matching every token of a query by prefix, with their BM25 score."""
    row = [*KEYS, "alias_course_designation"]
    posts = se.build_index(se.dealt_out(_corpus(spark, sf), KEYS), row, ["alias_course_designation", "alias_compact", "title", "description"])
    tokens = cut_lineage(se.query_tokens(_queries(spark, sf)))
    hits = cut_lineage(se.token_hits(posts, se.expand_tokens(tokens, posts), row))
    return se.all_token_matches(tokens, se.dealt_out(se.bm25_hits(posts, hits, row), row, hits.count()), row).select(
        "query_id", "course_id", "alias_course_designation", F.round("score", 6).alias("score")
    )


def search_tiered(spark, sf):
    return se.search(_queries(spark, sf), _corpus(spark, sf), _overview(spark, sf)).select(*_SHOWN)


def search_with_subject(spark, sf):
    """Tiered search restricted to a subject prefix."""
    q = _queries(spark, sf).withColumn("subject", F.lit("eco"))
    return se.search(q, _corpus(spark, sf), _overview(spark, sf), limit=5).select(*_SHOWN)


def search_fallback(spark, sf):
    """Substring search without an index."""
    return se.search_without_index(_queries(spark, sf), _corpus(spark, sf), _overview(spark, sf)).select(*_SHOWN)


def semi_exists_tokens(spark, sf):
    """Documents containing every token of a query anywhere inside a word."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    posts = se.build_index(docs, ["doc_id"], ["text"])
    tokens = se.query_tokens(_topic_queries(spark, sf))
    return se.substring_matches(tokens, posts, ["doc_id"])


def browse_prefix(spark, sf):
    """Courses per subject prefix."""
    subjects = _courses(spark, sf).selectExpr("lower(substr(course_designation, 1, 5)) as subject").distinct()
    return se.browse(subjects.withColumn("query_id", F.col("subject")), _overview(spark, sf), limit=50).select(*_SHOWN)


def _topic_queries(spark, sf):
    """Every benchmark passage, whole."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25_topk(spark, sf):
    """Ten best documents per topic over their whole text, by the scores of the topic's tokens that they hold."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return se.ranked_topics(_topic_queries(spark, sf), se.build_index(docs, ["doc_id"], ["text"]), ["doc_id"], 10)


def search_routed(spark, sf):
    """Texts, subjects and empty rows by one entry point, each with a limit of its own."""
    p = _courses(spark, sf)
    kinds = p.selectExpr(
        "concat('q', course_id) as query_id",
        "case cast(course_id as bigint) % 4 when 0 then substr(title, 1, 4) when 1 then '?!' when 2 then substr(other, 1, 7) end as text",
        "case when p_size > 25 then lower(substr(course_designation, 1, 3 + p_size % 3)) end as subject",
        "cast(p_size % 5 * 15 as int) as result_limit",
    )
    return se.answer(kinds, _corpus(spark, sf), _overview(spark, sf)).select(*_SHOWN, "answered_by")


def topic_by_course(spark, sf):
    """Best score per query and course, however many aliases match."""
    found = se.topic_search(_queries(spark, sf), _corpus(spark, sf), KEYS)
    return found.select("query_id", "course_id", F.round("score", 6).alias("score"))


# --- requirement texts -----------------------------------------------------------

def _refs(spark, sf):
    """Course reference of every part: ``BRAND BH 117``."""
    return table(spark, sf, "part").selectExpr(
        "p_partkey", "concat('BRAND ', translate(substr(p_brand, 7), '0123456789', 'ABCDEFGHIJ')) as subject",
        "cast(100 + p_partkey % 900 as string) as number",
    )


def _texts(spark, sf):
    """A requirement text per order from all its parts in line order: one of eight bodies in one of five frames.

    Bodies: alternatives, all of them, bare numbers, pairs of alternatives, a comma list, nested alternatives, slash families, and
    alternatives of pairs.  Frames: none, with consent, or standing, after a declaration, or standing with consent.
    """
    lines = table(spark, sf, "lineitem").join(_refs(spark, sf), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "subject", "number"))).alias("r")
    )
    joined = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).selectExpr(
        "o_orderkey as rule_id", "cast(o_orderkey % 8 as int) as body", "cast(substr(o_orderpriority, 1, 1) as int) as frame", "r",
        "cast(ceil(size(r) / 2) as int) as m",
    )
    one = "concat(x.subject, ' ', x.number)"
    items = joined.selectExpr(
        "*",
        f"""case when body = 2 then transform(r, (x, i) -> if(i = 0, {one}, x.number))
            when body = 6 then transform(sequence(0, m - 1), i -> if(2 * i + 1 < size(r),
              concat(get(r, 2 * i).subject, '/', get(r, 2 * i + 1).subject, ' ', get(r, 2 * i + 1).number), concat(get(r, 2 * i).subject, ' ', get(r, 2 * i).number)))
            else transform(r, x -> {one}) end as items""",
    )
    pairs = "array_join(transform(sequence(0, m - 1), i -> concat('(', get(items, 2 * i), coalesce(concat(' {0} ', get(items, 2 * i + 1)), ''), ')')), ' {1} ')"
    bodies = items.selectExpr(
        "rule_id", "frame",
        f"""case when body in (0, 2) then array_join(items, ' or ')
            when body in (1, 6) then array_join(items, ' and ')
            when body = 3 then {pairs.format('or', 'and')}
            when body = 7 then {pairs.format('and', 'or')}
            when body = 4 then array_join(transform(items, (x, i) -> concat(case when i = 0 then '' when i = size(items) - 1 then ', or ' else ', ' end, x)), '')
            else concat(array_join(items, ' or ('), repeat(')', size(items) - 1)) end as x""",
    )
    return bodies.selectExpr(
        "rule_id",
        """case frame when 1 then x when 2 then concat('(', x, ') and consent of instructor') when 3 then concat('(', x, ') or graduate/professional standing')
           when 4 then concat('Declared in program, (', x, ')') else concat('(', x, ')  or (graduate/professional standing and consent of instructor)') end as text""",
    )


def ref_extract(spark, sf):
    refs = rq.course_references(_texts(spark, sf), "rule_id", "text")
    return refs.groupBy("rule_id", "course", "found_as").agg(F.count("*").alias("n"))


def requirement_groups(spark, sf):
    """Course groups and escape clauses per text."""
    r = rq.requirement_rules(_texts(spark, sf), "rule_id", "text")
    return r.select(
        "rule_id", "summary_status", F.to_json("course_groups").alias("course_groups"), F.to_json("escape_clauses").alias("escape_clauses")
    )


def requirement_trees(spark, sf):
    """Parse status, skeleton and tree size per text."""
    r = rq.requirement_rules(_texts(spark, sf), "rule_id", "text")
    return r.select(
        "rule_id", "parse_status", "parse_confidence", "unparsed_text",
        F.coalesce(F.size("ops"), F.lit(0)).alias("operators"), F.coalesce(F.size("edges"), F.lit(0)).alias("edges"),
    )


def requirement_node_rows(spark, sf):
    """Nodes per type over all texts."""
    r = cut_lineage(rq.requirement_rules(_texts(spark, sf), "rule_id", "text", parts=True))  # read several times below
    return rq.requirement_nodes(r, "rule_id").groupBy("node_type").agg(F.count("*").alias("nodes"), F.count_distinct("node_id").alias("ids"))


def requirement_status_counts(spark, sf):
    r = rq.requirement_rules(_texts(spark, sf), "rule_id", "text")
    return r.groupBy("parse_status", "summary_status").agg(F.count("*").alias("rules"))


def requirement_satisfied(spark, sf):
    """Customers meeting each rule with the parts they bought, counted per rule."""
    rules = rq.requirement_rules(_texts(spark, sf), "rule_id", "text").select("rule_id", "course_groups")
    bought = (
        table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
        .join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(_refs(spark, sf), F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("o_custkey").alias("person"), F.concat_ws(" ", "subject", "number").alias("course"))
    )
    met = rq.satisfied_rules(rules, bought, "rule_id", "person")
    return met.groupBy("rule_id").agg(F.count("*").alias("people"))


def leaf_kinds(spark, sf):
    """Kind of a clause that names no course."""
    o = table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        """case o_orderpriority when '1-URGENT' then 'Consent of instructor' when '2-HIGH' then 'concurrent enrollment'
           when '3-MEDIUM' then 'Graduate/Professional Standing' else concat('member of ', o_orderpriority) end as clause""",
    )
    return o.select("o_orderkey", rq.leaf_kind(F.col("clause")).alias("kind"))


QUERIES = {
    f.__name__: f
    for f in [
        search_corpus, search_prefix_and, search_tiered, search_with_subject, search_fallback, semi_exists_tokens, browse_prefix,
        bm25_topk, search_routed, topic_by_course, ref_extract, requirement_groups, requirement_trees, requirement_node_rows,
        requirement_status_counts, requirement_satisfied, leaf_kinds,
    ]
}

_C = """c AS (SELECT '1272' term_code, CAST(p_partkey AS VARCHAR) course_id,
    p_type || ' ' || upper(substr(p_name, 1, 1)) || ' ' || CAST(100 + p_partkey % 300 AS VARCHAR) course_designation, p_name title,
    p_type || ' ' || p_brand || ' size ' || CAST(p_size AS VARCHAR) description,
    upper(replace(p_brand, '#', ' ')) || ' ' || CAST(100 + p_partkey % 300 AS VARCHAR) other, p_size FROM part),
  al AS (SELECT *, course_designation alias FROM c UNION ALL SELECT *, other FROM c WHERE p_size > 25),
  co AS (SELECT term_code, course_id, course_designation, alias, title, description, array_to_string(regexp_extract_all(lower(alias), '[a-z0-9]+'), ' ') an,
    array_to_string(regexp_extract_all(lower(title), '[a-z0-9]+'), ' ') tn,
    CASE WHEN alias = course_designation THEN lower(split_part(alias, ' ', 1) || split_part(alias, ' ', 2)) || ' ' || split_part(alias, ' ', 3)
      ELSE lower(alias) END ac FROM al),
  q AS (SELECT DISTINCT t query_id FROM (SELECT substr(title, 1, 3) || '! ' || split_part(title, ' ', 2) t FROM c
    UNION ALL SELECT substr(other, 1, 8) || '?' FROM c UNION ALL SELECT split_part(course_designation, ' ', 1) || ' ' || split_part(course_designation, ' ', 2) FROM c)),
  qn AS (SELECT query_id, array_to_string(regexp_extract_all(lower(query_id), '[a-z0-9]+'), ' ') n, list_distinct(regexp_extract_all(lower(query_id), '[a-z0-9]+')) ts FROM q),
  qc AS (SELECT *, CASE WHEN regexp_matches(n, '^[a-z]+ [a-z ]*[0-9]') THEN regexp_replace(n, '^([a-z]+) ([a-z]+) ', '\\1\\2 ') ELSE n END cn FROM qn),
  qt AS (SELECT query_id, unnest(ts) qtoken, len(ts) wanted FROM qn),
  ov AS (SELECT c.term_code, c.course_id, c.course_designation, c.title, l.section_count, l.o has_any_open_seats, l.f has_any_full_section FROM c LEFT JOIN
    (SELECT CAST(l_partkey AS VARCHAR) course_id, count(DISTINCT l_linenumber) section_count, max(CASE WHEN l_quantity > 48 THEN 1 ELSE 0 END) o,
      max(CASE WHEN l_quantity < 2 THEN 1 ELSE 0 END) f FROM lineitem GROUP BY 1) l ON l.course_id = c.course_id)""".replace("\\\\", "\\")

_SCORED = """po AS (SELECT course_id, alias, token, count(*) tf FROM (SELECT course_id, alias, unnest(regexp_extract_all(lower(alias || ' ' || ac || ' ' || title || ' ' || description), '[a-z0-9]+')) token FROM co) GROUP BY 1, 2, 3),
  ln AS (SELECT course_id, alias, sum(tf) len FROM po GROUP BY 1, 2), st AS (SELECT count(*) nn, avg(len) av FROM ln),
  hi AS (SELECT course_id, alias, qtoken, CAST(sum(tf) AS DOUBLE) tf FROM po JOIN (SELECT DISTINCT qtoken FROM qt) ON starts_with(token, qtoken) GROUP BY 1, 2, 3),
  df AS (SELECT qtoken, count(*) df FROM hi GROUP BY 1),
  sc AS (SELECT hi.course_id, hi.alias, hi.qtoken, ln(1 + (nn - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / av)) s
    FROM hi JOIN df USING (qtoken) JOIN ln USING (course_id, alias), st),
  ma AS (SELECT query_id, course_id, alias, sum(s) score FROM sc JOIN qt USING (qtoken) GROUP BY 1, 2, 3 HAVING count(*) = min(wanted))"""

_TIERED = f"""WITH {_C}, {_SCORED},
  sg AS (SELECT ma.query_id, co.term_code, co.course_id, round(max(score), 6) bs, max(CAST(an = n AS INT)) f1, max(CAST(ac = cn AS INT)) f2,
    max(CAST(starts_with(an, n) AS INT)) f3, max(CAST(starts_with(ac, cn) AS INT)) f4, max(CAST(tn = n AS INT)) f5, max(CAST(starts_with(tn, n) AS INT)) f6
    FROM ma JOIN co ON co.course_id = ma.course_id AND co.alias = ma.alias JOIN qc ON qc.query_id = ma.query_id GROUP BY 1, 2, 3),
  rp AS (SELECT sg.*, ov.course_designation, ov.title, section_count, has_any_open_seats, has_any_full_section, row_number() OVER (PARTITION BY query_id, ov.course_designation
    ORDER BY f1 DESC, f2 DESC, f3 DESC, f4 DESC, f5 DESC, f6 DESC, bs DESC, coalesce(section_count, 0) DESC, coalesce(has_any_open_seats, 0) DESC,
    coalesce(has_any_full_section, 0) DESC, ov.title, ov.course_id) rk FROM sg JOIN ov ON ov.course_id = sg.course_id {{where}}),
  fi AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f1 DESC, f2 DESC, f3 DESC, f4 DESC, f5 DESC, f6 DESC, bs DESC,
    coalesce(has_any_open_seats, 0) DESC, coalesce(section_count, 0) DESC, course_designation) rank FROM rp WHERE rk = 1)
  SELECT query_id, rank, course_id, course_designation FROM fi WHERE rank <= {{limit}}"""

# The parse is worked out from how a text is put together: what its body is worth, and what the frame makes of it.
_T = """rf AS (SELECT p_partkey, 'BRAND ' || translate(substr(p_brand, 7), '0123456789', 'ABCDEFGHIJ') s, CAST(100 + p_partkey % 900 AS VARCHAR) n FROM part),
  ls AS (SELECT l_orderkey, list({'s': s, 'n': n} ORDER BY l_linenumber, l_partkey) r FROM lineitem JOIN rf ON p_partkey = l_partkey GROUP BY 1),
  t0 AS (SELECT o_orderkey rule_id, CAST(o_orderkey % 8 AS INT) body, CAST(substr(o_orderpriority, 1, 1) AS INT) frame, r, len(r) k, CAST(ceil(len(r) / 2) AS INT) m
    FROM orders JOIN ls ON l_orderkey = o_orderkey),
  -- One entry per item of the text: what is written, the placeholder, the courses, how they are found, and the nodes it makes.
  t1 AS (SELECT *, CASE WHEN body = 2 THEN list_transform(r, lambda x, i: {'w': CASE WHEN i = 1 THEN x.s || ' ' || x.n ELSE x.n END, 'h': '[COURSE]', 'c': [r[1].s || ' ' || x.n],
        'f': CASE WHEN i = 1 THEN 'course' ELSE 'shorthand' END})
      WHEN body = 6 THEN list_transform(range(m), lambda i: CASE WHEN 2 * i + 2 > k THEN {'w': r[2 * i + 1].s || ' ' || r[2 * i + 1].n, 'h': '[COURSE]', 'c': [r[2 * i + 1].s || ' ' || r[2 * i + 1].n], 'f': 'course'}
        WHEN r[2 * i + 1].s = r[2 * i + 2].s THEN {'w': r[2 * i + 1].s || '/' || r[2 * i + 2].s || ' ' || r[2 * i + 2].n, 'h': r[2 * i + 1].s || '/' || r[2 * i + 2].s || ' ' || r[2 * i + 2].n,
          'c': CAST([] AS VARCHAR[]), 'f': 'none'}
        ELSE {'w': r[2 * i + 1].s || '/' || r[2 * i + 2].s || ' ' || r[2 * i + 2].n, 'h': '[COURSE]/[COURSE]', 'c': [r[2 * i + 1].s || ' ' || r[2 * i + 2].n, r[2 * i + 2].s || ' ' || r[2 * i + 2].n], 'f': 'slash'} END)
      ELSE list_transform(r, lambda x: {'w': x.s || ' ' || x.n, 'h': '[COURSE]', 'c': [x.s || ' ' || x.n], 'f': 'course'}) END it FROM t0),
  t2 AS (SELECT *, len(it) z, list_transform(it, lambda x: x.h) hs, list_transform(it, lambda x: x.w) ws, list_transform(it, lambda x: x.c) cs, len(list_filter(it, lambda x: x.f = 'none')) bad,
      CAST(list_sum(list_transform(it, lambda x: greatest(len(x.c), 1))) AS INT) anchors FROM t1),
  t3 AS (SELECT *, body IN (3, 7) AND m > 1 nested,
      -- What the body is worth: its groups (none where it is opaque), operators by kind, edges, and the anchors that a frame sees.
      CASE WHEN bad > 0 OR body = 7 AND m > 1 THEN CAST([] AS VARCHAR[][]) WHEN body = 3 THEN list_transform(range(m), lambda i: flatten(cs[2 * i + 1 : 2 * i + 2]))
        WHEN body IN (1, 6, 7) THEN cs ELSE [flatten(cs)] END g,
      CASE WHEN z = 1 THEN 0 WHEN body IN (0, 2) THEN 1 WHEN body = 3 THEN k // 2 WHEN body = 7 AND m > 1 THEN 1 WHEN body = 5 THEN k - 1 ELSE 0 END ors,
      CASE WHEN z = 1 THEN 0 WHEN body IN (1, 6) THEN 1 WHEN body = 3 AND m > 1 THEN 1 WHEN body = 7 THEN k // 2 ELSE 0 END ands,
      CASE WHEN z = 1 THEN 0 WHEN body IN (0, 1, 2) THEN k WHEN body = 6 THEN anchors WHEN body = 5 THEN 2 * (k - 1) ELSE CASE WHEN m > 1 THEN m ELSE 0 END + 2 * (k // 2) END edges,
      CASE WHEN z = 1 THEN anchors ELSE 1 END top, body <> 4 OR z = 1 plain FROM t2),
  fr AS (SELECT * FROM (VALUES (1, '', '', '', 0, 0, 0, 0, 0), (2, '(', ') and consent of instructor', ') and consent of instructor', 0, 1, 1, 0, 1),
      (3, '(', ') or graduate/professional standing', ') or [STANDING]', 1, 0, 1, 1, 0), (4, 'Declared in program, (', ')', ')', 0, 0, 0, 0, 0),
      (5, '(', ') or (graduate/professional standing and consent of instructor)', ') or ([STANDING] and consent of instructor)', 1, 1, 3, 1, 1))
    x(frame, pre, post, hpost, fors, fands, fedges, standing, consent)),
  t4 AS (SELECT *, CASE WHEN body IN (0, 2) THEN array_to_string(hs, ' or ') WHEN body IN (1, 6) THEN array_to_string(hs, ' and ')
      WHEN body = 3 THEN array_to_string(list_transform(range(m), lambda i: '(' || array_to_string(hs[2 * i + 1 : 2 * i + 2], ' or ') || ')'), ' and ')
      WHEN body = 7 THEN array_to_string(list_transform(range(m), lambda i: '(' || array_to_string(hs[2 * i + 1 : 2 * i + 2], ' and ') || ')'), ' or ')
      WHEN body = 4 THEN array_to_string(hs[1 : z - 1], ', ') || CASE WHEN z > 1 THEN ', or ' ELSE '' END || hs[z]
      ELSE array_to_string(hs, ' or (') || repeat(')', z - 1) END skeleton, CAST(list_sum(list_transform(it, lambda x: len(x.c))) AS INT) refs FROM t3),
  t AS (SELECT *, frame <> 4 AND plain AND refs > 0 tree, len(g) > 0 AND frame <> 4 shown FROM t4 JOIN fr USING (frame))"""

_GROUPS = f"""{_T}, gr AS (SELECT rule_id, frame, shown, CASE WHEN shown THEN g ELSE CAST([] AS VARCHAR[][]) END g FROM t)"""

_STATUS = "CASE WHEN refs + standing = 0 THEN 'unparsed' WHEN tree AND bad = 0 AND frame = 1 THEN 'parsed' ELSE 'partial' END"
_SUMMARY = "CASE WHEN NOT shown THEN 'opaque' WHEN frame = 1 THEN 'structured' ELSE 'partial' END"

# The same search with texts, subjects and limits by query.
_ROUTED_Q = """q0 AS (SELECT 'q' || course_id query_id, CASE CAST(course_id AS BIGINT) % 4 WHEN 0 THEN substr(title, 1, 4) WHEN 1 THEN '?!' WHEN 2 THEN substr(other, 1, 7) END x,
    CASE WHEN p_size > 25 THEN lower(substr(course_designation, 1, 3 + p_size % 3)) END subject, CASE WHEN p_size % 5 = 0 THEN 24 ELSE least(p_size % 5 * 15, 50) END lim FROM c),
  qn AS (SELECT query_id, array_to_string(regexp_extract_all(lower(x), '[a-z0-9]+'), ' ') n, list_distinct(regexp_extract_all(lower(x), '[a-z0-9]+')) ts FROM q0 WHERE len(regexp_extract_all(lower(x), '[a-z0-9]+')) > 0)"""
_ROUTED = _TIERED.replace(_C[_C.index("q AS (SELECT DISTINCT t"):_C.index("qc AS (")], _ROUTED_Q + ",\n  ").replace(
    "{where}", "JOIN (SELECT query_id qi, subject sb FROM q0) z ON z.qi = sg.query_id WHERE starts_with(upper(ov.course_designation), upper(trim(coalesce(z.sb, ''))))"
).replace("SELECT query_id, rank, course_id, course_designation FROM fi WHERE rank <= {limit}", """SELECT fi.query_id, rank, course_id, course_designation, 'search' answered_by FROM fi JOIN q0 ON q0.query_id = fi.query_id WHERE rank <= lim
  UNION ALL SELECT query_id, rank, course_id, course_designation, 'subject' FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(has_any_open_seats, 0) DESC, coalesce(section_count, 0) DESC, course_designation) rank
    FROM (SELECT q0.query_id, q0.lim, ov.*, row_number() OVER (PARTITION BY q0.query_id, course_designation ORDER BY coalesce(section_count, 0) DESC, coalesce(has_any_open_seats, 0) DESC,
      coalesce(has_any_full_section, 0) DESC, title, course_id) rk FROM q0 JOIN ov ON starts_with(upper(course_designation), upper(trim(subject)))
      WHERE trim(subject) <> '' AND q0.query_id NOT IN (SELECT query_id FROM qn)) WHERE rk = 1) WHERE rank <= lim""")

ORACLES = {
    "search_routed": _ROUTED,
    "search_corpus": f"""WITH {_C} SELECT term_code, course_id, course_designation canonical_course_designation, alias alias_course_designation,
        an alias_normalized, ac alias_compact, title, tn title_normalized, description FROM co""",
    "search_prefix_and": f"""WITH {_C}, {_SCORED} SELECT query_id, course_id, alias alias_course_designation, round(score, 6) score FROM ma""",
    "search_tiered": _TIERED.format(where="", limit=24),
    "search_with_subject": _TIERED.format(where="WHERE starts_with(upper(ov.course_designation), 'ECO')", limit=5),
    "search_fallback": f"""WITH {_C},
        ok AS (SELECT query_id, course_id FROM (SELECT DISTINCT qt.query_id, qt.qtoken, qt.wanted, co.course_id FROM qt JOIN co
          ON contains(lower(alias), qtoken) OR contains(replace(lower(alias), ' ', ''), qtoken) OR contains(lower(title), qtoken) OR contains(lower(description), qtoken))
          GROUP BY 1, 2 HAVING count(*) = min(wanted)),
        sg AS (SELECT ok.query_id, ok.course_id, max(CAST(lower(alias) = n AS INT)) f1, max(CAST(starts_with(replace(lower(alias), ' ', ''), replace(cn, ' ', '')) AS INT)) f2,
          max(CAST(starts_with(lower(alias), n) AS INT)) f3, max(CAST(lower(title) = n AS INT)) f4, max(CAST(starts_with(lower(title), n) AS INT)) f5
          FROM ok JOIN co ON co.course_id = ok.course_id JOIN qc ON qc.query_id = ok.query_id GROUP BY 1, 2),
        rp AS (SELECT sg.*, ov.course_designation, section_count, has_any_open_seats, row_number() OVER (PARTITION BY query_id, ov.course_designation
          ORDER BY f1 DESC, f2 DESC, f3 DESC, f4 DESC, f5 DESC, coalesce(section_count, 0) DESC, coalesce(has_any_open_seats, 0) DESC,
          coalesce(has_any_full_section, 0) DESC, ov.title, ov.course_id) rk FROM sg JOIN ov ON ov.course_id = sg.course_id),
        fi AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f1 DESC, f2 DESC, f3 DESC, f4 DESC, f5 DESC,
          coalesce(has_any_open_seats, 0) DESC, coalesce(section_count, 0) DESC, course_designation) rank FROM rp WHERE rk = 1)
        SELECT query_id, rank, course_id, course_designation FROM fi WHERE rank <= 24""",
    "semi_exists_tokens": """WITH q AS (SELECT item_id query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) ts FROM benchmark),
        qt AS (SELECT query_id, unnest(ts) t, len(ts) w FROM q), d AS (SELECT doc_id, lower(text) x FROM documents),
        h AS (SELECT DISTINCT doc_id, t FROM d JOIN (SELECT DISTINCT t FROM qt) ON contains(x, t))
        SELECT query_id, doc_id FROM qt JOIN h USING (t) GROUP BY 1, 2 HAVING count(*) = min(w)""",
    "browse_prefix": f"""WITH {_C}, s AS (SELECT DISTINCT lower(substr(course_designation, 1, 5)) query_id FROM c),
        rp AS (SELECT s.query_id, ov.*, row_number() OVER (PARTITION BY s.query_id, course_designation ORDER BY coalesce(section_count, 0) DESC,
          coalesce(has_any_open_seats, 0) DESC, coalesce(has_any_full_section, 0) DESC, title, course_id) rk
          FROM s JOIN ov ON starts_with(upper(course_designation), upper(trim(s.query_id)))),
        fi AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(has_any_open_seats, 0) DESC, coalesce(section_count, 0) DESC, course_designation) rank
          FROM rp WHERE rk = 1) SELECT query_id, rank, course_id, course_designation FROM fi WHERE rank <= 50""",
    "bm25_topk": """WITH q AS (SELECT item_id query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) ts FROM benchmark),
        qt AS (SELECT query_id, unnest(ts) qtoken, len(ts) wanted FROM q),
        po AS (SELECT doc_id, token, count(*) tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) token FROM documents) GROUP BY 1, 2),
        ln AS (SELECT doc_id, sum(tf) len FROM po GROUP BY 1), st AS (SELECT count(*) nn, avg(len) av FROM ln),
        hi AS (SELECT doc_id, qtoken, CAST(sum(tf) AS DOUBLE) tf FROM po JOIN (SELECT DISTINCT qtoken FROM qt) ON starts_with(token, qtoken) GROUP BY 1, 2),
        df AS (SELECT qtoken, count(*) df FROM hi GROUP BY 1),
        sc AS (SELECT doc_id, qtoken, ln(1 + (nn - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / av)) s
          FROM hi JOIN df USING (qtoken) JOIN ln USING (doc_id), st),
        ma AS (SELECT query_id, doc_id, round(sum(s), 6) score FROM sc JOIN qt USING (qtoken) GROUP BY 1, 2)
        SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) rank FROM ma) WHERE rank <= 10""",
    "topic_by_course": f"""WITH {_C}, {_SCORED} SELECT query_id, course_id, round(max(score), 6) score FROM ma GROUP BY 1, 2""",
    "ref_extract": f"""WITH {_T}, u AS (SELECT rule_id, unnest(it) x FROM t), c AS (SELECT rule_id, unnest(x.c) course, x.f found_as FROM u)
        SELECT rule_id, course, found_as, count(*) n FROM c GROUP BY 1, 2, 3""",
    "requirement_groups": f"""WITH {_GROUPS} SELECT rule_id, {_SUMMARY} summary_status,
        CASE WHEN len(g) = 0 THEN '[]' ELSE '[' || array_to_string(list_transform(g, lambda x: '["' || array_to_string(x, '","') || '"]'), ',') || ']' END course_groups,
        CASE WHEN NOT shown THEN '[]' WHEN frame = 3 THEN '["graduate/professional standing"]' WHEN frame = 5 THEN '["graduate/professional standing and consent of instructor"]' ELSE '[]' END escape_clauses FROM gr""",
    "requirement_trees": f"""WITH {_T} SELECT rule_id, {_STATUS} parse_status, CASE {_STATUS} WHEN 'parsed' THEN 1.0 WHEN 'unparsed' THEN 0.0 ELSE 0.5 END::DOUBLE parse_confidence,
        CASE WHEN {_STATUS} = 'parsed' THEN NULL WHEN {_STATUS} = 'unparsed' THEN pre || skeleton || post ELSE pre || skeleton || hpost END unparsed_text,
        CASE WHEN tree THEN ors + ands + fors + fands ELSE 0 END operators, CASE WHEN tree THEN edges + fedges + CASE WHEN frame IN (2, 3, 5) THEN top ELSE 0 END ELSE 0 END edges FROM t""",
    "requirement_node_rows": f"""WITH {_T}, n AS (SELECT unnest([('AND', CASE WHEN tree THEN ands + fands ELSE 0 END), ('OR', CASE WHEN tree THEN ors + fors ELSE 0 END), ('COURSE', refs), ('STANDING', standing),
          ('CONSENT', CASE WHEN tree THEN consent ELSE 0 END), ('TEXT', CASE WHEN tree THEN bad ELSE 0 END)]) x FROM t)
        SELECT x[1] node_type, CAST(sum(x[2]) AS BIGINT) nodes, CAST(sum(x[2]) AS BIGINT) ids FROM n GROUP BY 1 HAVING sum(x[2]) > 0""",
    "requirement_status_counts": f"""WITH {_T} SELECT {_STATUS} parse_status, {_SUMMARY} summary_status, count(*) rules FROM t GROUP BY 1, 2""",
    "requirement_satisfied": f"""WITH {_GROUPS}, o AS (SELECT rule_id, len(g) w, unnest(range(len(g))) i, unnest(g) opts FROM gr WHERE len(g) > 0),
        op AS (SELECT DISTINCT rule_id, w, i, unnest(opts) course FROM o),
        b AS (SELECT DISTINCT o_custkey person, s || ' ' || n course FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN rf ON p_partkey = l_partkey),
        m AS (SELECT rule_id, person FROM (SELECT DISTINCT rule_id, person, w, i FROM op JOIN b USING (course)) GROUP BY 1, 2 HAVING count(*) = min(w))
        SELECT rule_id, count(*) people FROM m GROUP BY 1""",
    "leaf_kinds": """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'CONSENT' WHEN '2-HIGH' THEN 'CONCURRENT' WHEN '3-MEDIUM' THEN 'STANDING' ELSE 'TEXT' END kind FROM orders""",
}
