from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from rosterloom.llm import queries, token_rollup
from rosterloom.llm.token_rollup import Rollup

CHANGES = "operation string, source string, lang string, tokenizer string, tokens long, old_tokens long"


def totals(df):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in df.collect()}


def test_signed_batches_commit_once(spark, tmp_path):
    rollup = Rollup(spark, str(tmp_path / "r"))
    assert totals(rollup.totals()) == {}
    first = [("insert", "a", "en", "v1", 10, None), ("insert", "a", "en", "v1", 10, None), ("insert", None, None, None, None, None), ("insert", "b", "de", "v1", 7, None)]
    second = [("revise", "a", "en", "v1", 4, 10), ("delete", "b", "de", "v1", 7, None), ("insert", "b", "de", "v2", 1, None)]
    assert rollup.commit("1", spark.createDataFrame(first, CHANGES).selectExpr("*", "1 as n_docs", "2 as n_tokens"))
    assert rollup.commit("2", spark.createDataFrame(second, CHANGES))
    want = {("a", "en", "v1"): (2, 14), (None, None, None): (1, 0), ("b", "de", "v1"): (0, 0), ("b", "de", "v2"): (1, 1)}
    assert totals(rollup.totals()) == want
    # The same ids again, whatever they hold, change nothing.
    assert not rollup.commit("2", spark.createDataFrame(first, CHANGES))
    assert not Rollup(spark, str(tmp_path / "r")).commit("1", spark.createDataFrame(first, CHANGES))
    assert totals(rollup.totals()) == want
    assert rollup.commit("3", spark.createDataFrame([], CHANGES)) and totals(rollup.totals()) == want
    other = Rollup(spark, str(tmp_path / "compact"))
    rollup.compact(other)
    assert totals(other.totals()) == want and other.committed() == ["base"]


def test_broken_commits_are_repeated(spark, tmp_path):
    rollup = Rollup(spark, str(tmp_path / "r"))
    rows = spark.createDataFrame([("insert", "a", "en", "v1", 10, None)], CHANGES)
    with pytest.raises(Exception, match="unknown operation"):
        rollup.commit("1", rows.withColumn("operation", F.lit("upsert")))
    with pytest.raises(Exception, match="unknown operation"):
        rollup.commit("1", rows.withColumn("operation", F.lit(None).cast("string")))
    assert rollup.committed() == []
    assert rollup.commit("1", rows) and totals(rollup.totals()) == {("a", "en", "v1"): (1, 10)}
    # A commit that was broken off has files but no marker.
    (tmp_path / "r" / "batch=1" / token_rollup.MARKER).unlink()
    assert totals(rollup.totals()) == {}
    assert rollup.commit("1", rows) and totals(rollup.totals()) == {("a", "en", "v1"): (1, 10)}
    with pytest.raises(ValueError):
        rollup.commit("../x", rows)


def test_counts_of_edge_texts(make_docs):
    texts = ["", None, "two words", "word " * 5000, "ünï"]
    docs = make_docs([*enumerate(texts), (None, "x"), (4, "ünï")]).selectExpr("*", "1 as digest", "2 as raw")
    rows = token_rollup.count_tokens(docs, {"raw": F.col("text"), "upper": F.upper("text")}).collect()
    assert len(rows) == 7
    by = {r["doc_id"]: r["raw"] for r in rows}
    assert [by[i] for i in range(5)] == [len(brute.ids(t)) - 1 for t in texts]
    assert token_rollup.count_tokens(docs.limit(0), {"raw": F.col("text")}).count() == 0


def test_query_against_direct_totals(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text").collect()
    first = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        first.setdefault(r["text"], r["doc_id"])
    docs, tokens = Counter(), Counter()
    for r in rows:
        for version in ("byte_bpe_50k@1", "byte_bpe_50k@2"):
            key = (r["source"], r["lang"], version)
            docs[key] += 0
            if first[r["text"]] == r["doc_id"]:
                folded = brute.re.sub("[ \t-\r]+", " ", r["text"]).strip(" ")
                docs[key] += 1
                tokens[key] += len(brute.ids(folded)) - 1
    assert totals(queries.op10_token_rollup(spark, sf_dir)) == {k: (docs[k], tokens[k]) for k in docs}


def test_folded_batches_stay_committed(spark, tmp_path):
    one = spark.createDataFrame([("a", "en", 7)], "source string, lang string, n long")
    old, new, newest = (token_rollup.Rollup(spark, str(tmp_path / name)) for name in ("old", "new", "newest"))
    load = token_rollup.changes(one, "insert", "v1", F.col("n"))
    assert old.commit("1-load", load)
    old.compact(new)
    assert new.is_committed("1-load") and not new.commit("1-load", load)
    assert totals(new.totals()) == {("a", "en", "v1"): (1, 7)}
    assert new.commit("2-load", load)
    new.compact(newest, "base-2")
    assert not newest.commit("1-load", load) and not newest.commit("2-load", load) and not newest.commit("base", load)
    assert totals(newest.totals()) == {("a", "en", "v1"): (2, 14)}
