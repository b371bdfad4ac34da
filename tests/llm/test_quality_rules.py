import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterloom.llm import quality_rules, queries

PROSE = "the river ran past old mills and every year someone painted them again before winter came back over hills".split()


def prose(rng, n):
    return " ".join(rng.choice(PROSE) + rng.choice(["", "", "s", "ed", "ing"]) for _ in range(n))


def test_statistics_of_edge_texts(make_docs):
    rng = random.Random(1)
    texts = [
        "", None, "  \n\t ", "one", "a b c", "a b c a b c", "a a a a", "x y x y x y z", "line\nline\n\n line\nline", "a b c",
        "# * $ % & | < >", prose(rng, 4000), "same words here " * 3000, "a b c d a b c e a b c", "é\x0bé\x0cé\ré é é",
    ]
    docs = make_docs(texts).selectExpr("*", "1 as failed", "2 as n_words", "3 as word_length")
    rows = quality_rules.text_statistics(docs).withColumn("failed", quality_rules.base_failed()).collect()
    for r in rows:
        found = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["failed"])
        assert found == brute.quality(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_query_against_plain_counts(spark, sf_dir, documents):
    texts = dict(documents)
    rows = queries.op8_quality_rules(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        assert found == brute.quality(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(2)
    rows, bad = [], set()
    for i in range(600):
        text = "\n".join(prose(rng, 12) for _ in range(rng.randrange(6, 40)))
        if i % 20 == 0:
            bad.add(i)
            text = " ".join(w + rng.choice(["###", "%%%", "&&&"]) for w in text.split())
        lang, source = rng.choice(["en", "de"]), "a" if i % 3 else f"rare{i % 40}"
        rows.append((i, text, lang if i % 50 else None, source if i % 60 else None))
    rows += [(1000, None, None, None), (1001, "", "xx", "only"), (1002, "\n".join(prose(rng, 12) for _ in range(30)), "xx", "only")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4), bad


def test_outliers_are_rejected_and_the_bulk_is_kept(mixed):
    docs, bad = mixed
    rows = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    assert len(rows) == 603
    assert not any(rows[i]["kept"] for i in bad)
    good = [i for i in range(600) if i not in bad]
    assert sum(rows[i]["kept"] for i in good) >= 0.995 * len(good)
    assert not rows[1000]["kept"] and not rows[1001]["kept"] and rows[1002]["kept"]


def test_estimates_against_plain_concentration_steps(mixed):
    """The last step's centre is the mean of the core that the step before defines, in every pool."""
    docs, _ = mixed
    stats = quality_rules.text_statistics(docs).withColumn("failed", quality_rules.base_failed())
    stats = stats.select("*", *[c.alias(n) for n, c in quality_rules._features().items()]).cache()
    _, estimates = quality_rules.robust_estimates(stats)
    corpus = stats.filter("not failed and lang = 'en' and source = 'a'").toPandas()[quality_rules.FEATURES].to_numpy()
    floor = np.diag([v**2 for v in quality_rules.FLOOR.values()])
    middle = np.median(corpus, axis=0)
    scatter = np.diag((1.4826 * np.median(np.abs(corpus - middle), axis=0)) ** 2) + floor
    for _ in range(quality_rules.STEPS):
        far = np.einsum("ij,jk,ik->i", corpus - middle, np.linalg.inv(scatter), corpus - middle)
        core = corpus[far <= np.sort(far)[int(np.ceil(quality_rules.CORE * len(far))) - 1]]
        middle = core.mean(axis=0)
        scatter = quality_rules.consistency() * np.cov(core.T, bias=True) + floor
    row = estimates.filter(F.col("g") == '{"level":0,"lang":"en","source":"a"}').first()
    found = np.array([row[f"m_{i}"] for i in range(len(middle))])
    factor = np.zeros((4, 4))
    for i in range(4):
        for j in range(i + 1):
            factor[i, j] = row[f"l_{i}_{j}"]
    assert np.allclose(found, middle, atol=2e-3)
    assert np.allclose(factor @ factor.T, scatter, atol=2e-3)


def test_empty_table(make_docs):
    assert quality_rules.judge(make_docs(["x"]).limit(0)).count() == 0


def test_consistency_factor_of_a_normal_core():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200_000, 4))
    d = (x**2).sum(axis=1)
    core = x[d <= np.quantile(d, quality_rules.CORE)]
    assert abs(quality_rules.consistency() * core.var() - 1) < 0.02


def test_one_outlying_statistic_rejects(spark):
    """Repeated lines without repeated windows, and repeated windows without repeated lines, each enough by itself."""
    rng = random.Random(8)
    fresh = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 8))) for _ in range(n))
    texts = ["\n".join(fresh(9) for _ in range(20)) for _ in range(200)]
    texts += ["\n".join(f"{fresh(9)}\nrefrain" for _ in range(20)), "\n".join(f"{fresh(12)} over the hills and far away" for _ in range(12))]
    rows = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    found = {r["doc_id"]: r for r in quality_rules.judge(rows).collect()}
    lines, windows = found[200], found[201]
    assert lines["n_dup_lines"] == 19 and lines["n_repeat_words"] == 0
    assert windows["n_dup_lines"] == 0 and 0.3 < windows["n_repeat_words"] / windows["n_words"] < 0.5
    assert not lines["base_failed"] and not lines["kept"]
    assert not windows["base_failed"] and not windows["kept"]
    assert all(found[i]["kept"] for i in range(200))
