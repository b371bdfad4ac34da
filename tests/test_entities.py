"""Identity, matching, history, quality and the shared helpers."""

import random

import pytest
from pyspark.sql import functions as F

from rosterloom.operators import history, identity, matching, merging, quality, versions
from rosterloom.plans import read_models as rm
from rosterloom.skew import hot_keys, salted_join
from rosterloom.functions.text import defined_values
from rosterloom.sources import publish, schemas, snapshots


def test_identity_matches_union_find(spark):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        net = f"n{rng.randrange(60)}" if rng.random() < 0.5 else None
        mail = "shared@x" if rng.random() < 0.3 else (f"m{rng.randrange(60)}@x" if rng.random() < 0.5 else None)
        rows.append((i, net, mail, rng.choice(["Ann", " ann", None]), rng.choice(["Lee", None])))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, net, mail, first, last in rows:
        tokens = [t for t in (net, mail) if t]
        if not tokens and (first or last):
            tokens = [f"name:{(first or '').strip().lower()}:{(last or '').strip().lower()}"]
        find(("r", i))
        for t in tokens:
            parent[find(("t", t))] = find(("r", i))
    aliases, people = identity.collapse_identities(
        spark.createDataFrame(rows, "record_id int, netid string, email string, first_name string, last_name string"), "record_id"
    )
    got = {r.record_id: r.instructor_key for r in aliases.collect()}
    groups, keys = {}, {}
    for i in range(150):
        groups.setdefault(find(("r", i)), set()).add(i)
        keys.setdefault(got[i], set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, keys.values()))
    assert people.count() == len(groups)


def test_long_chain_converges(spark):
    edges = spark.createDataFrame([(f"n{i:04d}", f"n{i + 1:04d}") for i in range(300)], "u string, v string")
    got = identity.connected_components(edges)
    assert got.count() == 301 and got.select("component").distinct().collect()[0][0] == "n0000"


def test_course_match_states(spark):
    local = spark.createDataFrame([(i, t) for i, t in enumerate(["Algebra", "Topology", "Rings", "Fields", "None"])], "k int, title string")
    pairs = spark.createDataFrame([(0, "MATH", "100"), (1, "math ", "200"), (2, "MATH", "300"), (3, "MATH", "400"), (4, "X", "1")], "k int, subject string, number string")
    ext = spark.createDataFrame(
        [("a", "100", "Linear  algebra"), ("b", "200", "Old name"), ("c", "300", "Rings"), ("d", "300", "rings"), ("e", "300", "Other"),
         ("f", "400", "Fields"), ("g", "400", "Meadows")],
        "external_id string, number string, name string",
    )
    aliases = ext.select("external_id", F.lit("Math").alias("subject"))
    names = spark.createDataFrame([("b", "topology")], "external_id string, name string")
    got = {r.k: (r.match_status, r.match_method, r.external_id) for r in matching.match_courses(local, pairs, ext, aliases, names, ["k"]).collect()}
    assert got == {
        0: ("matched", "subject-code+catalog-number-only", "a"),
        1: ("matched", "subject-code+catalog-number", "b"),
        2: ("ambiguous", None, None),
        3: ("matched", "subject-code+catalog-number+title", "f"),
        4: ("unmatched", None, None),
    }


GRADES = "history_course_id int, term_code string, refresh_run_id int, course_grade_id int, student_count int, avg_gpa double"


def test_weighted_history(spark):
    courses = spark.createDataFrame([(1, "1", "577", "CS 577"), (2, "1", "1", "CS 1")], "history_course_id int, subject_code string, catalog_number string, course_designation string")
    one = [(1, "1222", 1, 1, 20, 3.1), (1, "1224", 1, 2, 40, 3.6)]
    got = {r.history_course_id: r for r in rm.course_grade_overview(courses, spark.createDataFrame(one, GRADES)).collect()}
    assert (got[1].course_grade_term_count, got[1].historical_student_count) == (2, 60)
    assert got[1].historical_gpa == pytest.approx(3.4333333333)
    assert (got[2].course_grade_term_count, got[2].historical_student_count, got[2].historical_gpa) == (0, 0, None)
    two = one + [(1, "1222", 2, 3, 22, 3.9), (1, "1224", 2, 4, 41, 3.8)]
    row = rm.course_grade_overview(courses, spark.createDataFrame(two, GRADES)).filter("history_course_id = 1").first()
    assert row.historical_student_count == 63 and row.historical_gpa == pytest.approx(3.834920634920634)


def test_live_term_grades(spark):
    df = spark.createDataFrame(
        [(7, "1222", {"total": 10, "aCount": 5, "abCount": 2, "nwCount": 3}), (7, "1222", {"total": 4, "aCount": 4})],
        "instructor int, term string, cumulative map<string,bigint>",
    )
    row = history.instructor_term_grades(df, ["instructor", "term"]).first()
    assert row.student_count == 14 and row.grades == {"a": 9, "ab": 2, "W": 3}
    assert row.avg_gpa == pytest.approx((9 * 4 + 2 * 3.5) / 14)


def test_salted_join_equals_plain_join(spark):
    left = spark.range(3000).selectExpr("case when id % 3 = 0 then 0 else id end as k", "id as a")
    right = spark.range(40).selectExpr("cast(id % 20 as bigint) as k", "id as b")
    assert hot_keys(left, ["k"]).collect()[0][0] == 0
    want = sorted(map(tuple, left.join(right, "k").collect()))
    assert sorted(map(tuple, salted_join(left, right, ["k"]).collect())) == want
    anti = sorted(map(tuple, left.join(right, "k", "left_anti").collect()))
    assert sorted(map(tuple, salted_join(left, right, ["k"], "left_anti").collect())) == anti


def test_numbering_across_ranges(spark):
    df = spark.range(500).selectExpr("case when id % 7 = 0 then null else id % 3 end as g", "id * 10 as p")
    got = versions.number_in_group(df, ["g"], "p", "n", width=100).collect()
    seen = {}
    for r in sorted(got, key=lambda r: r.p):
        seen[r.g] = seen.get(r.g, 0) + 1
        assert r.n == seen[r.g]
    ids = versions.dense_ids(df.select("p"), ["p"], "i").collect()
    assert sorted((r.p, r.i) for r in ids) == [(i * 10, i + 1) for i in range(500)]


def test_version_merge_is_independent_of_input_order(spark):
    rows = [(1, 10, "x", None, []), (1, 20, None, "n", ["t"]), (1, 20, "z", "m", [])]
    schema = "k int, u int, a string, b string, c array<string>"
    results = set()
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, schema)
        out = merging.coalesce_versions(df, ["k"], [F.col("u"), F.coalesce("a", F.lit("")), F.coalesce("b", F.lit(""))], ["a", "b"], ["c"]).first()
        results.add((out.a, out.b, tuple(out.c)))
    assert results == {("z", "m", ("t",))}


def test_quality_rejects_and_drops(spark):
    child = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "id int, ref int")
    parent = spark.createDataFrame([(1,)], "key int")
    assert [r.id for r in quality.orphans(child, parent, {"ref": "key"}).collect()] == [2]
    assert sorted(r.id for r in quality.drop_orphans(child, parent, {"ref": "key"}).collect()) == [1, 3]
    with pytest.raises(quality.QualityError, match="refs: 1"):
        quality.require_clean({"refs": quality.orphans(child, parent, {"ref": "key"}), "keys": quality.duplicate_keys(child, ["id"])})
    with pytest.raises(quality.QualityError):
        quality.require_columns(child, ["snapshot_run_at"])


def test_snapshots_and_publish(spark, tmp_path):
    root = str(tmp_path / "history")
    parts = {p: spark.createDataFrame([], s) for p, s in schemas.HISTORY_SCHEMAS.items()}
    parts["instructors"] = spark.createDataFrame([(1, "Ann Lee")], schemas.HISTORY_SCHEMAS["instructors"])
    snapshots.write_snapshot(root, "20260101T000000Z", parts)
    snapshots.write_snapshot(root, "20260301T000000Z", parts)
    (tmp_path / "history" / "20260401T000000Z").mkdir()
    (tmp_path / "history" / "20260401T000000Z" / "courses.json").write_text("[]")
    assert snapshots.latest_snapshot(spark, root) == "20260301T000000Z"
    back = snapshots.read_history_snapshot(spark, root, "20260301T000000Z")
    assert back["instructors"].first().display_name == "Ann Lee"
    with pytest.raises(quality.QualityError):
        snapshots.write_snapshot(root, "20260501T000000Z", {"courses": parts["courses"]})
    out = str(tmp_path / "out")
    tables = {"courses": spark.range(5).toDF("c"), "packages": spark.range(3).toDF("p")}
    assert publish.publish(out, tables) == {"courses": 5, "packages": 3}
    assert publish.publish(out, {"courses": spark.range(7).toDF("c")}) == {"courses": 7}
    assert spark.read.parquet(out + "/live/courses").count() == 7
    compared = publish.count_comparison(tables, {"courses": spark.range(4), "packages": spark.range(3)})
    assert [r.table for r in compared.filter("NOT equal").collect()] == ["courses"]
    assert publish.target_state(spark, ["no_such_table"]) == "missing"
    spark.range(1).createOrReplaceTempView("half_table")
    with pytest.raises(quality.QualityError):
        publish.require_whole_target(spark, ["half_table", "no_such_table"])


def test_publish_order_follows_references():
    order = publish.publish_order()
    assert sorted(order) == sorted(publish.REFERENCES)
    assert all(order.index(needed) < order.index(name) for name, refs in publish.REFERENCES.items() for needed in refs)
    with pytest.raises(ValueError):
        publish.publish_order({"a": ["b"], "b": ["a"]})


def test_defined_values(spark):
    rows = [((1, None, []),), ((None, ("x", None), ["a", None]),), ((None, (None, None), None),), (None,)]
    df = spark.createDataFrame(rows, "v struct<a:int, b:struct<c:string,d:string>, l:array<string>>")
    got = [r[0] for r in df.select(defined_values(df["v"], df.schema["v"].dataType)).collect()]
    assert got == [2, 5, 0, 0]
