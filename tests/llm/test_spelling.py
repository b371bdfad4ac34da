import re
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from rosterloom.llm import queries, spelling
from rosterloom.llm.spelling import group_variants, near_pairs, variants


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def count(docs):
    counts = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def forms(counts):
    """{word: (form, root, n, n_near, form_n)} by comparing words that share a word with one letter deleted."""
    shared = defaultdict(set)
    for w in counts:
        for part in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            shared[part].add(w)
    met = defaultdict(set)
    for group in shared.values():
        for a in group:
            met[a] |= {b for b in group if near(a, b)}
    form = {}
    for w, others in met.items():
        if others:
            best = min(others, key=lambda o: (-counts[o], o))
            if counts[best] >= 10 * counts[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(met[w]), counts.get(form.get(w))) for w, n in counts.items()}


def collected(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


def test_query_against_brute_force(spark, sf_dir, documents):
    found = collected(queries.op13_spelling_variants(spark, sf_dir))
    assert found == forms(count(documents)) and any(r[0] for r in found.values())


@settings(max_examples=15, deadline=None)
@given(st.sets(st.text(alphabet="abñ", min_size=6, max_size=10), min_size=2, max_size=60))
def test_pairs_are_all_near_words(spark, words):
    rows = near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()
    got = [frozenset((r["a"], r["b"])) for r in rows]
    assert len(got) == len(set(got))
    assert set(got) == {frozenset((a, b)) for a in words for b in words if a < b and near(a, b)}


def test_chains_and_ties(spark):
    counts = {"abcdefgh": 100_000, "abcdefgx": 9_000, "abcdefyx": 900, "abcdezyx": 90, "abcqezyx": 9, "abcdefgk": 100_000, "lonesome": 5}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = collected(group_variants(words))
    assert found == forms(counts)
    assert found["abcqezyx"][:2] == ("abcdezyx", "abcdefgh") and found["abcdefgh"][:2] == (None, "abcdefgh")


def test_edge_documents(spark, make_docs):
    rows = [(0, None), (1, ""), (2, "Mistakes mistakes MISTAKES mistakés"), (None, "mistakes ÀÀÀÀÀÀÀ ààààààà " * 20), (3, "mistakes1mistakes_short")]
    rows += [(4, "lengthy " * 30000 + "lengthyy lengthyy"), (4, "lengthyy"), (5, "×÷×÷×÷×÷ " * 3)]
    docs = make_docs(rows).selectExpr("*", "1 as word", "2 as n", "3 as form")
    assert collected(variants(docs)) == forms(count(rows))
    assert variants(docs.limit(0)).collect() == []


def test_counts_do_not_depend_on_what_a_task_holds(spark, documents, make_docs, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 10)
    found = {r["word"]: r["n"] for r in spelling.count_words(make_docs(documents[:60])).collect()}
    assert found == count(documents[:60])
