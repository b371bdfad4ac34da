import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rosterloom.llm import jaccard_join, queries
from rosterloom.llm.jaccard_join import (
    allocation,
    band_edges,
    bands_of,
    components,
    keys,
    largest_partner,
    max_difference,
    subset_keys,
    wide_allocation,
)
from workload import check


def as_dict(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        i = rng.randrange(len(words))
        action = rng.random()
        if action < 0.4:
            words[i] = f"e{rng.randrange(10**6)}"
        elif action < 0.7:
            del words[i]
        else:
            words.insert(i, f"i{rng.randrange(10**6)}")
    return words


def test_random_families_against_all_pairs(make_docs):
    rng = random.Random(7)
    texts = ["", None, "   ", "one", "One", "two words", "a b c", "A  b\tc"]
    for size in (3, 8, 9, 12, 20, 30, 45, 80, 200, 600):
        for _ in range(3):
            base = [f"w{rng.randrange(300)}" for _ in range(size)]
            texts += [" ".join(edited(rng, base, rng.randrange(0, 1 + size // 25))) for _ in range(6)]
    texts += [" ".join(["same"] * n) for n in (3, 4, 50)]
    assert as_dict(components(make_docs(texts, 5).selectExpr("*", "1 as n", "2 as key"))) == brute.jaccard_components(list(enumerate(texts)))


def test_five_words_and_four_fifths(make_docs):
    rng = random.Random(17)
    texts = ["", None, "one", "a b c d e", "a b c d e", "a b c d"]
    for size in (6, 9, 15, 30, 60, 120, 500):
        for _ in range(3):
            base = [f"w{rng.randrange(300)}" for _ in range(size)]
            texts += [" ".join(edited(rng, base, rng.randrange(0, 1 + size // 25))) for _ in range(6)]
    got = as_dict(components(make_docs(texts, 5), words=5, percent=80))
    assert got == brute.jaccard_components(list(enumerate(texts)), percent=80, n=5)


def test_shingles_that_others_lack(make_docs, monkeypatch):
    """Counted exactly, over several lots and buckets; equal sets of a lot are counted with the first."""
    monkeypatch.setattr(jaccard_join, "LOT_SHINGLES", 40)
    monkeypatch.setattr(jaccard_join, "BUCKET_LETTERS", 300)
    rng = random.Random(23)
    texts = [" ".join(f"w{rng.randrange(12)}" for _ in range(rng.randrange(0, 30))) for _ in range(60)]
    rows = jaccard_join.signatures(make_docs(texts)).collect()
    sets = [brute.shingles(t) for t in texts]
    assert sorted(r["doc_id"] for r in rows) == list(range(60))
    for r in rows:
        mine = sets[r["doc_id"]]
        assert r["n"] == len(mine)
        lone = sum(not any(s in other for i, other in enumerate(sets) if i != r["doc_id"]) for s in mine)
        assert r["alone"] in (None, lone) and (r["alone"] is not None or sets.count(mine) > 1 or not mine)


def test_large_group_of_near_copies_and_chains(make_docs):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(edited(rng, base, 2)) for _ in range(150)]
    chain = [f"c{i}" for i in range(150)]
    for step in range(12):
        texts.append(" ".join(f"s{i}" if i < 2 * step else w for i, w in enumerate(chain)))
    assert as_dict(components(make_docs(texts))) == brute.jaccard_components(list(enumerate(texts)))


def test_texts_that_share_a_long_passage(make_docs):
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join(passage + [f"o{rng.randrange(10**6)}" for _ in range(rng.randrange(2, 25))]) for _ in range(120)]
    assert as_dict(components(make_docs(texts))) == brute.jaccard_components(list(enumerate(texts)))


@pytest.mark.parametrize("large, chunk", [(1000, 200), (0, 7)])
def test_rounds_without_hubs_give_the_same(make_docs, monkeypatch, large, chunk):
    """Pairs alone, and cells alone."""
    monkeypatch.setattr(jaccard_join, "HUBS_PER_ROUND", ())
    monkeypatch.setattr(jaccard_join, "LARGE_GROUP", large)
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(edited(rng, base, rng.randrange(4))) for _ in range(40)]
    assert as_dict(components(make_docs(texts))) == brute.jaccard_components(list(enumerate(texts)))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32))
def test_cells_join_what_links_join(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**62, 40)
    sets = [np.unique(np.concatenate([base[rng.random(40) > 0.06], rng.integers(0, 2**62, rng.integers(0, 4))])) for _ in range(12)]
    found = jaccard_join.links_between(list(range(6)), list(range(6, 12)), sets, list(range(12)), 90)
    component, want = list(range(12)), list(range(12))
    for i, j in found:
        common = len(np.intersect1d(sets[i], sets[j]))
        assert (i < 6) != (j < 6) and 100 * common >= 90 * (len(sets[i]) + len(sets[j]) - common)
        component = [component[i] if c == component[j] else c for c in component]
    for i in range(6):
        for j in range(6, 12):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 90 * (len(sets[i]) + len(sets[j]) - common):
                want = [want[i] if c == want[j] else c for c in want]
    assert all((component[i] == component[j]) == (want[i] == want[j]) for i in range(12) for j in range(12))


def test_copies_null_ids_and_empty_tables(make_docs):
    docs = make_docs([(5, "x y z w"), (9, "x y z w"), (9, "x y z w"), (None, "x y z w"), (None, None)])
    rows = sorted(((r["doc_id"], r["component_id"]) for r in components(docs).collect()), key=str)
    assert rows == [(5, 5), (9, 5), (9, 5), (None, None), (None, None)]
    assert components(docs.limit(0)).count() == 0
    kept = jaccard_join.keep_one(docs.selectExpr("*", "1 as _first", "2 as component_id"))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["5", "None", "None"]
    repeated = jaccard_join.keep_one(make_docs([(2, "a b c"), (2, "a b c"), (3, "")]))
    assert sorted((r["doc_id"], r["text"]) for r in repeated.collect()) == [(2, "a b c"), (3, "")]


@pytest.mark.parametrize("percent", [90, 80])
def test_band_limits(percent):
    edges = band_edges(3000)
    for band in range(len(edges) - 3):
        low, high = edges[band], edges[band + 1] - 1
        assert largest_partner(high, percent) < edges[band + 2]
        narrow, wide, spare = allocation(band, percent)
        worst = max(max_difference(x, y, percent) for x in range(low, high + 1) for y in {*range(x, min(x + 50, largest_partner(x, percent) + 1)), *range(max(x, largest_partner(x, percent) - 50), largest_partner(x, percent) + 1)})
        assert worst <= 0 or narrow + 2 * wide - spare > worst


@settings(max_examples=150, deadline=None)
@given(st.integers(9, 400), st.integers(0, 2**32), st.data())
def test_linked_sets_share_a_probed_key(size, seed, data):
    """Whatever a set leaves out within its spare units, a linked set shares a key that it probes with."""
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
    out, added = data.draw(st.integers(0, size // 9)), data.draw(st.integers(0, size // 9))
    y = np.unique(np.concatenate([x[out:], rng.integers(0, 2**63, added).astype(np.uint64)]))
    common = len(np.intersect1d(x, y))
    if 100 * common < 90 * (len(x) + len(y) - common) or not len(y):
        return
    shared = set(bands_of(len(x))) & set(bands_of(len(y)))
    assert shared

    def probed(s, band):
        found = keys(s, band).tolist()
        one_unit = [k for k in found if k & 1]
        rng.shuffle(one_unit)
        return set(found) - set(one_unit[: allocation(band)[2]])

    assert any(probed(x, b) & set(keys(y, b).tolist()) for b in shared)
    wide = [(subset_keys(x, b, *wide_allocation(b)), subset_keys(y, b, *wide_allocation(b))) for b in shared]
    assert any(
        set(xw.tolist()) & {*yw.tolist(), *yd.tolist()} or set(xd.tolist()) & set(yw.tolist()) for (xw, xd), (yw, yd) in wide
    )


def test_query_against_all_pairs(spark, sf_dir, documents):
    assert as_dict(queries.op4_ngram_jaccard_join(spark, sf_dir)) == brute.jaccard_components(documents)


@pytest.mark.skipif("op4_ngram_jaccard_join" not in queries.ORACLES, reason="no SQL")
def test_query_against_sql(spark, sf_dir):
    con = check.connect(sf_dir)
    ok, detail = check.compare(spark, con, "op4", queries.op4_ngram_jaccard_join, queries.ORACLES["op4_ngram_jaccard_join"], sf_dir)
    assert ok, detail
