"""Best rows per topic against the sums over all of its tokens."""

import random

import pytest

from rosterloom.operators import search as se
from rosterloom.operators.versions import top_per_key
from pyspark.sql import functions as F


def _docs(spark):
    rng = random.Random(7)
    common = ["of", "and", "the", "in", "to", "we"]
    docs = []
    for i in range(600):
        words = rng.choices(common, k=rng.randint(3, 30)) + [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 5))]
        docs.append((i, " ".join(words) + (" quartz opal jade and beryl" if i % 40 == 3 else " quartz" if i % 25 == 1 else "")))
    return spark.createDataFrame(docs + [(600, ""), (601, None)], "doc_id long, text string")


TOPICS = [(1, "the quartz and opal of jade, beryl in we"), (2, "of and the"), (3, "w1 w2 w399 the to"), (4, "nowhere"), (5, "?!"), (6, "jade"), (7, None)]


def _plain(queries, posts, row, best):
    tokens = se.query_tokens(queries)
    scores = se.bm25_hits(posts, se.token_hits(posts, se.expand_tokens(tokens, posts), row), row)
    scored = tokens.join(scores, "qtoken").groupBy("query_id", *row).agg(F.round(F.sum("score"), 6).alias("score"))
    return top_per_key(scored, ["query_id"], [F.col("score").desc(), *[F.col(c) for c in row]], best, rank="rank")


@pytest.mark.parametrize("seeds", [0, 60, 2000])
def test_frequent_tokens_are_looked_up_for_the_best_rows_alone(spark, monkeypatch, seeds):
    posts = se.build_index(_docs(spark), ["doc_id"], ["text"])
    queries = spark.createDataFrame(TOPICS, "query_id long, text string")
    monkeypatch.setattr(se, "SEED_HITS", seeds, raising=False)
    met, match = [], se.any_token_matches
    monkeypatch.setattr(se, "any_token_matches", lambda *a: met.append(match(*a)) or met[-1])
    got = {(r.query_id, r["rank"], r.doc_id, r.score) for r in se.ranked_topics(queries, posts, ["doc_id"], 10).collect()}
    assert got == {(r.query_id, r["rank"], r.doc_id, r.score) for r in _plain(queries, posts, ["doc_id"], 10).collect()}
    # The first topic shares a token with nearly all rows; only those with a rare one are summed after the first try.
    assert met[-1].filter("query_id = 1").count() < 60
