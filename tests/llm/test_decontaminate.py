import brute
import pytest

from rosterloom.llm import decontaminate, queries
from rosterloom.llm.decontaminate import find_contamination
from workload import check

WORDS = "red orange yellow green blue indigo violet black white grey brown pink".split()
PASSAGE = " ".join(WORDS)
BENCHMARK = [("a", PASSAGE), ("b", "Only FOUR words here"), ("c", None), ("d", "..."), ("a", PASSAGE), (None, "nameless item words"), ("e", PASSAGE + " extra")]
DOCS = [
    (0, f"Intro, {PASSAGE.upper()}! outro"),
    (1, "one two only four words here three"),
    (2, None),
    (3, ""),
    (4, " ".join(WORDS[:9])),
    (5, " ".join(WORDS[1:11]) + " x " + " ".join(WORDS[2:12])),
    (6, "a nameless item words b"),
    (7, ("filler text " * 4000) + PASSAGE),
    (8, "ünï cödé 3 only, four -- words (here)"),
    (9, f"Intro, {PASSAGE.upper()}! outro"),
]
BENCH_SCHEMA = "item_id string, text string"


def found_rows(df):
    return sorted(
        (r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], brute.sha(",".join(r["items"])), r["contaminated"]) for r in df.collect()
    )


@pytest.mark.parametrize("limit", [decontaminate.MAX_BROADCAST_GRAMS, 3])
def test_against_brute_force(spark, make_docs, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_GRAMS", limit)
    benchmark = spark.createDataFrame(BENCHMARK, BENCH_SCHEMA)
    docs = make_docs(DOCS).selectExpr("*", "1 as hits", "2 as n_words", "3 as item_id")
    assert found_rows(find_contamination(docs, benchmark)) == sorted(brute.contamination(DOCS, BENCHMARK))


def test_repeated_rows_null_ids_and_empty_tables(spark, make_docs):
    benchmark = spark.createDataFrame(BENCHMARK, BENCH_SCHEMA)
    docs = make_docs([(1, PASSAGE), (1, PASSAGE), (1, "clean"), (None, PASSAGE), (None, None)])
    rows = find_contamination(docs, benchmark).collect()
    assert sorted((r["doc_id"] or 0, r["n_hit"]) for r in rows) == [(0, 0), (0, 12), (1, 0), (1, 12), (1, 12)]
    assert find_contamination(docs.limit(0), benchmark).count() == 0
    assert {r["n_hit"] for r in find_contamination(docs, benchmark.limit(0)).collect()} == {0}


def test_removal(spark, make_docs):
    benchmark = spark.createDataFrame(BENCHMARK, BENCH_SCHEMA)
    docs = make_docs(DOCS).selectExpr("*", "1 as hits", "2 as _id")
    clean = {d for d, *_, hit in brute.contamination(DOCS, BENCHMARK) if not hit}
    kept = decontaminate.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == clean
    texts = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, benchmark, "spans").collect()}
    assert texts[0] == "Intro, ! outro" and texts[1] == "one two  three" and texts[2] is None and texts[3] == ""
    assert texts[5] == " x " and texts[8] == "ünï cödé 3 " + ")" and texts[4] == " ".join(WORDS[:9])
    left = [(d, t) for d, t in texts.items()]
    assert not any(hit for *_, hit in brute.contamination(left, BENCHMARK))
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs, benchmark, "words")


def test_query_against_brute_force_and_sql(spark, sf_dir, documents):
    con = check.connect(sf_dir)
    benchmark = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    rows = queries.op3_decontaminate(spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(brute.contamination(documents, benchmark))
    ok, detail = check.compare(spark, con, "op3_decontaminate", queries.op3_decontaminate, queries.ORACLES["op3_decontaminate"], sf_dir)
    assert ok, detail
