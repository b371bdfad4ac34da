import math
import re
from collections import Counter

import pytest

from rosterloom.llm import block_index, lexical_search
from rosterloom.llm.lexical_search import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k=20):
    """{item: [(rank, doc_id, score)]} by scoring every document."""
    held = [(d, Counter(terms(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(terms(text))
    out = {}
    for item, counts in asked.items():
        scored = []
        for (doc, c), n in zip(held, sizes):
            score = 0
            for t, times in counts.items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 25 + (25 * n * n_docs) // n_terms
                    score += times * w * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out[item] = [(r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return {i: rows for i, rows in out.items() if rows}


def grouped(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    return out


@pytest.fixture
def small(monkeypatch):
    """Blocks of five documents and slices of about two items, so that all parts meet."""
    monkeypatch.setattr(lexical_search, "ITEMS_PER_SLICE", 2)
    monkeypatch.setattr(lexical_search, "BLOCKS_PER_SALT", 2)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_against_brute_force(spark, sf_dir, documents, small):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(7)
    assert grouped(search(docs, items_of(spark, items))) == ranked(documents, items)
    assert grouped(search(docs, items_of(spark, items), k=3)) == ranked(documents, items, k=3)


def test_ties_repeats_nulls_and_other_columns(spark, make_docs, small):
    rows = [(i % 40, "alpha beta" if i % 2 else "Alpha-beta gamma's") for i in range(60)]
    rows += [(100, None), (101, ""), (None, "beta beta delta"), (102, "é_É x"), (103, "... !!"), (104, "alpha " * 5000 + "omega " * 3)]
    items = [(1, "ALPHA beta"), (1, "gamma"), (2, None), (3, ""), (4, "nowhere"), (None, "delta É"), (5, "omega omega alpha")]
    docs = make_docs(rows).selectExpr("*", "1 as term", "2 as block", "3 as item_id", "4 as score")
    asked = items_of(spark, items).selectExpr("*", "5 as doc_id", "6 as rank", "7 as slice")
    found = search(docs, asked)
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and dict(found.dtypes)["rank"] == "int"
    assert grouped(found) == ranked(rows, items)


def test_empty_tables(spark, make_docs):
    docs, items = make_docs(["one two"]), items_of(spark, [(1, "one")])
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (make_docs([None, ""]), items)):
        assert search(d, i).collect() == []


def test_weightless_terms_are_not_found(spark, make_docs):
    """A term of all of very many documents weighs 0."""
    docs = [(i, "the") for i in range(1500)] + [(9999, "the rare")]
    found = grouped(search(make_docs(docs), items_of(spark, [(1, "the"), (2, "the rare")])))
    assert found == ranked(docs, [(1, "the"), (2, "the rare")]) and 1 not in found


def test_index_counts_whole_texts(spark, make_docs, monkeypatch):
    """Also where a text is split in pieces and a block is counted in several goes."""
    monkeypatch.setattr(block_index, "PIECE", 50)
    monkeypatch.setattr(block_index, "TOKENS_PER_BLOCK", 300)
    block = block_index._Block()
    texts = ["a bb  ccc " * 90, "", "bb", "x" * 400 + " a"]
    for i, t in enumerate(texts):
        block.add(i, t.encode())
    got = block.rows(7, lambda d: d != 2).to_pylist()
    counts = [Counter(t.split()) for t in texts]
    for row in got:
        if row["term"] is None:
            assert row["counts"] == [len(t.split()) for t in texts] and row["ids"] == [0, 1, 2, 3] and row["gathered"] == 3
        else:
            assert dict(zip(row["places"], row["counts"])) == {i: c[row["term"]] for i, c in enumerate(counts) if c[row["term"]]}
            assert row["gathered"] == sum(c[row["term"]] for i, c in enumerate(counts) if i != 2)
    assert {r["term"] for r in got} == {None, *(w for c in counts for w in c)}
