"""Searches of many queries that ask the same."""

from rosterloom.operators import search as se

KEYS = ["term_code", "course_id"]


def test_equal_questions_are_matched_and_ranked_once(spark, monkeypatch):
    courses = spark.createDataFrame(
        [("1", str(i), f"ART {100 + i}", f"Clay {i}", "pots") for i in range(12)] + [("1", "20", "BOTANY 7", "Clay", "leaves")],
        "term_code string, course_id string, course_designation string, title string, description string",
    )
    corpus = se.build_corpus(courses.select(*KEYS, "course_designation"), courses, KEYS)
    overview = courses.selectExpr(*KEYS, "course_designation", "title", "1 as section_count", "1 as has_any_open_seats", "0 as has_any_full_section")
    kinds = [("clay", None, 3), ("Clay!", "art", 5), ("?", " Art ", 4), (None, None, 9), ("clay", "bot", 0), (None, "botany 7 and more", 2)]
    rows = [(f"{i}-{k}", *kinds[k]) for i in range(40) for k in range(len(kinds))]
    matched, ranked = [], []
    match, pick = se.all_token_matches, se._representatives
    monkeypatch.setattr(se, "all_token_matches", lambda *a: matched.append(match(*a)) or matched[-1])
    monkeypatch.setattr(se, "_representatives", lambda *a: ranked.append(a[0]) or pick(*a))
    got = se.answer(spark.createDataFrame(rows, "query_id string, text string, subject string, result_limit int"), corpus, overview, KEYS).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.course_id, r.answered_by))
    for i in range(40):
        assert [len(found.get(f"{i}-{k}", [])) for k in range(6)] == [3, 5, 4, 0, 1, 0]
        assert all(sorted(found.get(f"{i}-{k}", [])) == sorted(found.get(f"0-{k}", [])) for k in range(6))
    assert found["0-4"] == [(1, "20", "search")] and {x[2] for x in found["0-2"]} == {"subject"}
    assert [m.count() for m in matched] == [13]
    assert [r.count() for r in ranked] == [13 + 12 + 1, 12]
