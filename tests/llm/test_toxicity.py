import random
import re
import time

import numpy as np

from rosterloom.llm import queries, toxicity
from rosterloom.llm.toxicity import OrdinalModel, fit, fit_cumulative_link, score, without_toxic

LABELS = "doc_id long, quality int, toxic int"
PLAIN = [f"word{i}" for i in range(400)]
BAD = ["vilething", "nastyperson", "awfulness"]


def corpus(n=700, seed=4):
    rng, rows, toxic = random.Random(seed), [], {}
    for i in range(n):
        words = [rng.choice(PLAIN) for _ in range(rng.randrange(5, 80))]
        toxic[i] = rng.random() < 0.2
        if toxic[i]:
            for _ in range(rng.randrange(1, 7)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "s", "."]))
        rows.append((i, " ".join(words)))
    return rows, toxic


def test_held_out_accuracy(spark, make_docs):
    rows, toxic = corpus()
    labels = spark.createDataFrame([(i, 1, int(toxic[i])) for i in range(400)], LABELS)
    model = fit(make_docs(rows), labels)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 2
    scored = score(make_docs(rows), model).collect()
    wrong = [r["doc_id"] for r in scored if r["doc_id"] >= 400 and (r["toxicity"]["expected"] >= 0.5) != toxic[r["doc_id"]]]
    assert len(wrong) <= 3
    kept = {r["doc_id"] for r in without_toxic(make_docs(rows), labels).collect()}
    assert kept == {r["doc_id"] for r in scored if r["toxicity"]["expected"] < 0.5}


def test_scores_follow_the_model(spark, make_docs):
    model = OrdinalModel(("bad", "^verb"), (2.0, 1.5), (1.0, 2.5))
    texts = ["", None, "Bad, bad!", "verbose bad words " + "fill " * 20000, "verb"]
    docs = make_docs(texts + [texts[2]]).selectExpr("*", "'x' as toxicity")
    rows = {r["doc_id"]: r["toxicity"] for r in score(docs, model).collect()}
    for i, total in ((0, 0), (1, 0), (2, 2.0), (3, 3.5), (4, 0), (5, 2.0)):
        p = [1 / (1 + np.exp(t - total)) for t in model.thresholds]
        assert np.isclose(rows[i]["expected"], sum(p)) and np.isclose(rows[i]["p_toxic"], p[0])
        assert rows[i]["grade"] == int(np.argmax([1 - p[0], p[0] - p[1], p[1]]))


def test_gradient_and_recovery():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (4000, 3)).astype(float)
    true_w, true_t = np.array([1.5, -1.0, 0.5]), np.array([0.0, 1.2, 2.0])
    u = rng.random(4000)
    grade = sum((u > 1 / (1 + np.exp(-(t - x @ true_w)))).astype(int) for t in true_t)
    w, t = fit_cumulative_link(x, grade, np.ones(4000), ridge=1e-6)
    assert np.allclose(w, true_w, atol=0.2) and np.allclose(t, true_t, atol=0.2)


def test_no_labels_or_one_kind(spark, make_docs):
    docs = make_docs(["one text", "another"])
    for rows in ([], [(0, 1, 0)], [(0, 1, 1), (None, 1, 0), (1, 1, None), (99, 1, 0)]):
        model = fit(docs, spark.createDataFrame(rows, LABELS))
        assert model.thresholds == ()
        assert {r["toxicity"]["expected"] for r in score(docs, model).collect()} == {0.0}
    assert score(docs.limit(0), model).count() == 0
    extra = docs.selectExpr("*", "1 as _toxicity", "2 as expected")
    assert without_toxic(extra, spark.createDataFrame([], LABELS)).columns == extra.columns


def test_near_copies_share_a_weight(spark, make_docs):
    copies = ["alpha beta gamma delta epsilon"] * 30 + ["one two three"]
    labels = spark.createDataFrame([(i, 1, 1) for i in range(31)], LABELS)
    rows = toxicity.labelled_sample(make_docs(copies), labels).collect()
    assert np.isclose(sum(r["weight"] for r in rows), 2.0)


def test_query_scores_every_document(spark, documents, sf_dir):
    rows = queries.op1_toxicity(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(d for d, _ in documents)
    assert all(0 <= r["expected_severity"] <= 2 and r["toxic"] == (r["expected_severity"] >= 0.5) for r in rows)


def test_query_finds_labelled_rows(spark):
    """On the larger test table, against all labels."""
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in queries.op1_toxicity(spark, folder).collect() if r["doc_id"] in labels]
    right = sum(r["toxic"] == bool(labels[r["doc_id"]]) for r in rows)
    false_alarms = sum(r["toxic"] and not labels[r["doc_id"]] for r in rows)
    assert right >= 0.95 * len(rows) and false_alarms <= 3


def test_a_cap_below_the_row_count_keeps_the_odds(spark, make_docs):
    """The sample holds as many toxic as clean rows, while a fifth of the labelled documents is toxic."""
    rows, toxic = corpus(1500, seed=9)
    labels = spark.createDataFrame([(i, 1, int(t)) for i, t in toxic.items()] + [(5000 + i, 1, 1) for i in range(900)], LABELS)
    docs = make_docs([*rows, (9000, "")]).cache()
    whole, capped = fit(docs, labels), fit(docs, labels, limit=150)
    assert abs(capped.thresholds[0] - whole.thresholds[0]) < 0.7
    p = [{r["doc_id"]: r["toxicity"]["p_toxic"] for r in score(docs, m).collect()} for m in (whole, capped)]
    assert np.mean([abs(p[0][i] - p[1][i]) for i in p[0]]) < 0.001
    sample = toxicity.labelled_sample(docs, labels, 150).groupBy("toxic").agg({"stands_for": "max", "*": "count"}).collect()
    held = {r["toxic"]: r["max(stands_for)"] * r["count(1)"] for r in sample}
    assert np.isclose(held[1], sum(toxic.values())) and np.isclose(held[0], 1500 - sum(toxic.values()))


def test_long_labelled_texts(spark, make_docs):
    """Labelled texts of 20,000 words are each read once, not once per window."""
    texts = [" ".join(f"w{(i * 7 + j * j) % 977}" for j in range(20000)) + " vilething" * (i % 2) for i in range(12)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(12)], LABELS)
    started = time.time()
    sample = toxicity.labelled_sample(make_docs(texts), labels).collect()
    assert len(sample) == 12 and time.time() - started < 30


def test_query_against_brute_force(spark, documents, sf_dir):
    """The query's rows from the model's own numbers, in plain Python."""
    docs, labels = queries.table(spark, sf_dir, "documents"), queries.table(spark, sf_dir, "labels")
    model = fit(docs, labels)
    weight = dict(zip(model.words, model.weights))
    want = {}
    for doc, text in documents:
        words = set(re.findall(r"\w+", (text or "").lower()))
        words |= {"^" + w[:n] for w in words for n in toxicity.PREFIXES if len(w) > n}
        total = sum(w for f, w in weight.items() if f in words)
        want[doc] = sum(1 / (1 + np.exp(t - total)) for t in model.thresholds)
    rows = {r["doc_id"]: r["expected_severity"] for r in queries.op1_toxicity(spark, sf_dir).collect()}
    assert rows.keys() == want.keys() and all(np.isclose(rows[d], want[d]) for d in want)
