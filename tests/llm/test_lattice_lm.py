import math
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rosterloom.llm import lattice_lm, queries
from rosterloom.llm.lattice_lm import MARK, Lattices, fit, score, vocabulary

VOCABULARY = vocabulary()
WORDS = ["hello", "ciónñrr", "x", f"a{MARK}b", "日本語word", "the", "", "mente", MARK, "the"]


def probability(word, log_p):
    """The sum over all segmentations, one after another."""
    text = MARK + word

    @lru_cache(None)
    def rest(i):
        if i == len(text):
            return 1.0
        total = 0.0
        for j in range(i + 1, len(text) + 1):
            piece = VOCABULARY.pieces.get(text[i:j])
            if piece is not None and not (i and text[i] == MARK):
                total += math.exp(log_p[piece]) * rest(j)
        if i:
            total += math.prod(math.exp(log_p[VOCABULARY.byte[b]]) for b in text[i].encode()) * rest(i + 1)
        return total

    return rest(0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abehntiñ▁語", max_size=8), min_size=1, max_size=6))
def test_marginal_over_all_segmentations(words):
    log_p = np.log(VOCABULARY.prior)
    assert np.allclose(Lattices(words, VOCABULARY).forward(log_p), [math.log(probability(w, log_p)) for w in words])


def test_expected_uses_are_the_gradient():
    log_p, times = np.log(VOCABULARY.prior), np.arange(1.0, len(WORDS) + 1)
    lattices = Lattices(WORDS, VOCABULARY)
    uses = lattices.uses(log_p, times, VOCABULARY.size)
    for piece in np.flatnonzero(uses)[::5]:
        up, down = log_p.copy(), log_p.copy()
        up[piece] += 1e-5
        down[piece] -= 1e-5
        slope = ((lattices.forward(up) - lattices.forward(down)) * times).sum() / 2e-5
        assert abs(slope - uses[piece]) < 1e-4 * max(1, uses[piece])


def test_training_raises_the_likelihood(spark):
    words = spark.createDataFrame([(w, 50 * (i + 1)) for i, w in enumerate(["hello", "hellos", "thing", "nothing", "zzz"])], "term string, n long")
    text = [(r["term"], r["n"]) for r in words.collect()]
    values = []
    for rounds in range(4):
        log_p = fit(words, 10, rounds)
        assert abs(np.exp(log_p).sum() - 1) < 1e-9
        values.append((Lattices([w for w, _ in text], VOCABULARY).forward(log_p) * [n for _, n in text]).sum() + lattice_lm.PRIOR * (VOCABULARY.prior * log_p).sum())
    assert values == sorted(values) and values[-1] > values[0]


def base(docs):
    """{doc_id: (held_out, n_tokens, n_known, train_tokens, base score)} of unique ids; the words as lists too."""
    split = {d: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for d, t in docs}
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d in split}
    counts = Counter()
    for d, words in split.items():
        if not held[d]:
            counts.update([*words, None])
    n, v = sum(counts.values()), len(counts)
    rows = {}
    for d, words in split.items():
        tokens = [*words, None]
        total = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        rows[d] = (held[d], len(tokens), sum(counts[t] > 0 for t in tokens), n, total)
    return rows, split, counts


def same(row, want):
    return tuple(row[c] for c in ("held_out", "n_tokens", "n_known", "train_tokens")) == want[:4] and abs(row["base_score"] - want[4]) < 1e-6


def test_query_against_brute_force(spark, sf_dir, documents):
    rows = {r["doc_id"]: r for r in queries.op12_lattice_lm(spark, sf_dir).collect()}
    want, split, counts = base(documents)
    assert rows.keys() == want.keys() and all(same(rows[d], want[d]) for d in want)
    words = spark.createDataFrame([(w, n) for w, n in counts.items() if w is not None], "term string, n long")
    log_p = fit(words, counts[None])
    distinct = sorted({w for words in split.values() for w in words})
    value = dict(zip(distinct, Lattices(distinct, VOCABULARY).forward(log_p) / math.log(10)))
    for d, words in split.items():
        assert abs(rows[d]["score"] - sum(value[w] for w in words) - log_p[VOCABULARY.end] / math.log(10)) < 1e-6


def test_held_out_text_is_likelier_than_shuffled_letters(spark, sf_dir, documents):
    rng = np.random.default_rng(3)
    held = [(d, t) for d, t in documents if t and lattice_lm.held_out(d)][:40]
    taken = {d for d, _ in documents}
    mixed = []
    for d, t in held:
        shuffled = 10**6 + d
        while not lattice_lm.held_out(shuffled) or shuffled in taken:
            shuffled += 1
        taken.add(shuffled)
        mixed.append((shuffled, " ".join("".join(rng.permutation(list(w))) for w in t.split())))
    docs = spark.createDataFrame([*documents, *mixed], "doc_id long, text string")
    rows = {r["doc_id"]: r["score"] for r in score(docs).collect()}
    assert sum(rows[d] > rows[m] for (d, _), (m, _) in zip(held, mixed)) >= 0.9 * len(held)


def test_edge_documents(spark, make_docs):
    docs = [(0, None), (1, ""), (2, "One ONE two"), (3, "word " * 30000 + "x" * 5000), (None, "no id"), (4, " \t\r\n"), (5, f"{MARK} 語 \x00a")]
    extra = make_docs(docs).selectExpr("*", "1 as term", "2 as block", "3 as n", "4 as score")
    rows = {r["doc_id"]: r for r in score(extra).collect()}
    want, _, _ = base(docs)
    assert rows.keys() == want.keys() and all(same(rows[d], want[d]) for d in want)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in rows.values())
    assert rows[0]["score"] == rows[1]["score"] == rows[4]["score"]
    assert score(extra.limit(0)).collect() == []


def test_repeated_rows_and_no_training_documents(spark, make_docs):
    rows = score(make_docs([(2, "a b"), (2, "a b"), (2, "c")])).collect()
    assert [r["train_tokens"] for r in rows] == [8] * 3
    alone = next(d for d in range(100) if lattice_lm.held_out(d))
    row = score(make_docs([(alone, "some words")])).first()
    assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"]) == (True, 3, 0, 0) and np.isfinite(row["score"])

