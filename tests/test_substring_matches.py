"""Rows that hold all tokens of a query inside their words."""

import random

from rosterloom.operators import search as se

SYLLABLES = ["an", "ber", "co", "dil", "e", "fa", "gor", "hu", "in", "x9"]


def test_rows_of_the_rarest_token_alone_are_read(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda most: "".join(rng.choices(SYLLABLES, k=rng.randint(1, most)))
    docs = [(i, " ".join(word(3) for _ in range(rng.randint(0, 25)))) for i in range(300)] + [(300, "Zanzibar, an e"), (301, ""), (302, None)]
    texts = [" ".join(word(2) for _ in range(rng.randint(1, 5))) for _ in range(40)] + ["zanzibar an e", "E", "nzi", "none-of an e", "?!", "bercoe zzz", None]
    posts = se.build_index(spark.createDataFrame(docs, "doc_id long, text string"), ["doc_id"], ["text"])
    tokens = se.query_tokens(spark.createDataFrame(list(enumerate(texts)), "query_id long, text string"))
    hits, find = [], se.token_hits
    monkeypatch.setattr(se, "token_hits", lambda *a: hits.append(find(*a)) or hits[-1])
    got = {tuple(r) for r in se.substring_matches(tokens, posts, ["doc_id"]).collect()}
    asked = [[t for t in (x or "").lower().replace("?!", "").replace("-", " ").split()] for x in texts]
    want = {(q, d) for q, ts in enumerate(asked) for d, text in docs if ts and all(t in (text or "").lower() for t in ts)}
    assert got == want and (40, 300) in got
    # One token per query at most.
    assert hits[0].select("qtoken").distinct().count() <= len(texts)
    assert "an" not in {r.qtoken for r in hits[0].collect()} or ["an"] in asked


def test_few_query_tokens_do_not_meet_all_grams_in_one_task(spark):
    words = spark.range(500).selectExpr("concat('w', lpad(cast(id as string), 3, '0'), 'ab') as token")
    asked = spark.createDataFrame([("00",), ("w123",), ("b",), ("zz",)], "qtoken string")
    found = se.expand_tokens(asked, words, substring=True)
    join = [line for line in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join [gram" in line and "Inner" in line]
    assert join and all("SortMergeJoin" in line for line in join)
    got = {(r.qtoken, r.token) for r in found.collect()}
    assert got == {(q, f"w{i:03}ab") for q in ("00", "w123", "b", "zz") for i in range(500) if q in f"w{i:03}ab"}
