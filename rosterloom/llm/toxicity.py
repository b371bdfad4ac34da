"""Toxicity: cumulative-link ordinal regression of severity grades on sparse word features.

P(grade <= k) = sigmoid(threshold_k - w . x): one weight vector shared by all ordered thresholds,
x the presence of words and of word beginnings (``PREFIXES`` letters), which catch inflected and joined
words.  The output is the expected grade, the sum of P(grade > k).

The model is fitted on at most ``MAX_PER_LABEL`` labelled rows per label, those with the smallest
hashes of their ids.  Rows of equal shingle minimum (near copies) share one weight of 1, so that copied
texts do not make their words look typical.  Each label's rows are weighed up to all labelled documents
of that label, so the odds of the labels, and with them thresholds and rejections, are those of the whole
table, whatever part of it the sample holds.  Words and beginnings whose presence differs between
toxic and other rows by ``MIN_Z`` standard errors become features, all of them.  The labels
say toxic or not; a toxic row is grade 2 if it has more distinct toxic features than the median of
toxic rows that have any, else 1.  Whole texts are scored.

Defined cases: a null or empty text has no words, its grade follows from the thresholds alone; labels
that are null or have no document are ignored; a document labelled twice is toxic if any label says so;
without toxic or without other labels the model has no features and every expected grade is 0; repeated
rows are scored alike; empty tables give no rows; ``score`` keeps all other columns, and replaces one
of the name it writes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.session import cut_lineage

MAX_PER_LABEL = 6000
MIN_ROWS = 4.0  # weighted rows that must hold a word
MIN_Z = 5.0
PREFIXES = (4, 5, 6, 7)
RIDGE = 0.05
REJECT_AT = 0.5

_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class OrdinalModel:
    words: tuple[str, ...]
    weights: tuple[float, ...]
    thresholds: tuple[float, ...]  # ascending; empty for a model that says 0


def features_of(text: str | None) -> set[str]:
    """Distinct words (runs of letters, digits and underscores, lower-cased), and beginnings of longer words, marked by ``^``."""
    words = set(_WORD.findall((text or "").lower()))
    return words.union(*({"^" + w[:n] for w in words if len(w) > n} for n in PREFIXES))


def presence(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def listed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(features_of(t if isinstance(t, str) else None)))

    return listed(text)


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_PER_LABEL) -> DataFrame:
    """(id, toxic, words, weight, stands_for): the bounded sample with the features present.

    Near copies share a ``weight`` of 1; ``stands_for`` is the number of labelled documents per sampled one of the label.
    """
    flags = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.max((F.col("toxic") > 0).cast("int")).alias("toxic")
    )
    chosen = None
    for flag in (0, 1):
        part = flags.filter(F.col("toxic") == flag).orderBy(F.xxhash64("_id"), "_id").limit(2 * limit)
        chosen = part if chosen is None else chosen.unionByName(part)
    # Documents may lack some labelled ids, so twice as many ids are looked up as rows are kept.  At
    # most 4 * limit ids are broadcast; so no text is shuffled to find the sample.
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("_text"))
    rows = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).groupBy("_id").agg(F.first("toxic").alias("toxic"), F.min("_text").alias("_text"))
    kept = None
    for flag in (0, 1):
        part = rows.filter(F.col("toxic") == flag).orderBy(F.xxhash64("_id"), "_id").limit(limit)
        kept = part if kept is None else kept.unionByName(part)
    words = kept.select("_id", "toxic", "_text", F.split(F.coalesce("_text", F.lit("")), r"\s+").alias("_words"))
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_words") - 2, F.lit(1))), lambda i: F.xxhash64(F.slice("_words", i, 3)))
    # Written before it is joined: a filter of the join on _copies would be pushed down with the split inside its lambda,
    # which would split a text once per window.
    marked = cut_lineage(words.select("_id", "toxic", "_text", F.array_min(windows).alias("_copies")))
    copies = marked.groupBy("_copies", "toxic").agg((1.0 / F.count("*")).alias("weight"))
    # Only ids are shuffled for the counts; labels without a document count for nothing.
    present = docs.select(F.col("doc_id").cast("long").alias("_id")).distinct()
    labelled = flags.join(present, "_id", "left_semi").groupBy("toxic").agg(F.count("*").alias("_all"))
    sampled = marked.groupBy("toxic").agg(F.count("*").alias("_sampled"))
    shares = F.broadcast(labelled.join(sampled, "toxic").select("toxic", (F.col("_all") / F.col("_sampled")).alias("stands_for")))
    return marked.join(copies, ["_copies", "toxic"]).join(shares, "toxic").select(
        F.col("_id").alias("id"), "toxic", presence(F.col("_text")).alias("words"), "weight", "stands_for"
    )


def select_features(sample: DataFrame) -> list[tuple[str, float]]:
    """(word, z) of the words that tell the labels apart, strongest first; the bounded sample bounds them."""
    totals = {r["toxic"]: r for r in sample.groupBy("toxic").agg(F.sum("weight").alias("n"), F.first("stands_for").alias("f")).collect()}
    if len(totals) < 2:
        return []
    n0, n1 = totals[0]["n"], totals[1]["n"]
    f0, f1 = totals[0]["f"] * (n0 + 1), totals[1]["f"] * (n1 + 1)
    counts = sample.select("toxic", "weight", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 0, F.col("weight")).otherwise(0.0)).alias("c0"),
        F.sum(F.when(F.col("toxic") == 1, F.col("weight")).otherwise(0.0)).alias("c1"),
    )
    # Two-proportion test with half a row added on either side.  The labels are mixed as in the whole table;
    # the errors are those of the rows that were sampled.
    p0, p1 = (F.col("c0") + 0.5) / (n0 + 1), (F.col("c1") + 0.5) / (n1 + 1)
    p = (f0 * p0 + f1 * p1) / (f0 + f1)
    z = (p1 - p0) / F.sqrt(p * (1 - p) * (1 / (n0 + 1) + 1 / (n1 + 1)))
    strong = counts.filter(F.col("c0") + F.col("c1") >= MIN_ROWS).select("word", z.alias("z")).filter(F.abs("z") >= MIN_Z)
    return [(r["word"], r["z"]) for r in strong.orderBy(F.desc(F.abs("z")), "word").collect()]


class Presence:
    """A sparse matrix of zeros and ones by the places of the ones."""

    def __init__(self, row: np.ndarray, column: np.ndarray, shape: tuple[int, int]):
        self.row, self.column, self.shape = row, column, shape

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.column], minlength=self.shape[0])

    @property
    def T(self) -> Presence:  # noqa: N802
        return Presence(self.column, self.row, self.shape[::-1])


def fit_cumulative_link(x: np.ndarray | Presence, grade: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ascending thresholds) by penalised maximum likelihood, for grades 0..K that all occur."""
    top = int(grade.max())
    share = np.array([weight[grade <= k].sum() for k in range(top)]) / weight.sum()
    first = np.log(share / (1 - share))
    # Thresholds are the first one and logarithms of the steps to the next, so they stay in order.
    start = np.concatenate([np.zeros(x.shape[1]), first[:1], np.log(np.maximum(np.diff(first), 1e-3))])

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, raw = p[: x.shape[1]], p[x.shape[1] :]
        steps = np.exp(np.clip(raw[1:], -30, 30))
        cuts = np.concatenate([[-np.inf], np.cumsum(np.concatenate([raw[:1], steps])), [np.inf]])
        score = x @ w
        upper = _sigmoid(cuts[grade + 1] - score)
        lower = _sigmoid(cuts[grade] - score)
        likelihood = np.maximum(upper - lower, 1e-12)
        value = -(weight * np.log(likelihood)).sum() + ridge / 2 * (w @ w)
        d_score = weight * (1 - upper - lower)
        d_upper, d_lower = weight * upper * (1 - upper) / likelihood, weight * lower * (1 - lower) / likelihood
        d_cuts = np.array([d_lower[grade == k + 1].sum() - d_upper[grade == k].sum() for k in range(top)])
        d_raw = np.concatenate([[d_cuts.sum()], [d_cuts[k:].sum() * steps[k - 1] for k in range(1, top)]])
        return value, np.concatenate([x.T @ d_score + ridge * w, d_raw])

    found = _minimise(loss, start)
    raw = found[x.shape[1] :]
    return found[: x.shape[1]], np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(np.clip(z, -700, 700) / 2))


def _minimise(loss, p: np.ndarray, rounds: int = 300, memory: int = 10) -> np.ndarray:
    """Limited-memory quasi-Newton descent with step halving."""
    value, slope = loss(p)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, factors = slope.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            factors.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, np.linalg.norm(q))
        for (s, y), a in zip(pairs, reversed(factors)):
            q += s * (a - (y @ q) / (s @ y))
        step = 1.0
        while step > 1e-10:
            new_value, new_slope = loss(p - step * q)
            if new_value <= value - 1e-4 * step * (slope @ q):
                break
            step /= 2
        else:
            break
        s, y = -step * q, new_slope - slope
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        done = value - new_value < 1e-9 * max(1.0, abs(value))
        p, value, slope = p + s, new_value, new_slope
        if done:
            break
    return p


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_PER_LABEL) -> OrdinalModel:
    """The model of the labelled rows; what reaches the driver is bounded by the sample's limit."""
    sample = cut_lineage(labelled_sample(docs, labels, limit))
    features = select_features(sample)
    if not features:
        return OrdinalModel((), (), ())
    vocabulary = [w for w, _ in features]
    place = {w: i for i, w in enumerate(vocabulary)}

    @F.pandas_udf("array<int>")
    def places(words: pd.Series) -> pd.Series:
        return words.map(lambda held: [place[w] for w in held if w in place])

    rows = sample.select("toxic", (F.col("weight") * F.col("stands_for")).alias("weight"), places("words").alias("present")).toPandas()
    held = rows["present"].map(len).to_numpy()
    column = np.concatenate(rows["present"].to_list()).astype(np.int64)
    x = Presence(np.repeat(np.arange(len(rows)), held), column, (len(rows), len(vocabulary)))
    toxic, markers = rows["toxic"].to_numpy() > 0, x @ np.array([z > 0 for _, z in features], dtype=float)
    with_any = markers[toxic & (markers > 0)]
    severe = np.median(with_any) if len(with_any) else np.inf
    grade = np.where(toxic, np.where(markers > severe, 2, 1), 0)
    grade = np.unique(grade, return_inverse=True)[1]  # the likelihood needs every grade to occur
    weights, thresholds = fit_cumulative_link(x, grade, rows["weight"].to_numpy(dtype=float))
    return OrdinalModel(tuple(vocabulary), tuple(map(float, weights)), tuple(map(float, thresholds)))


def _exceeds(model: OrdinalModel, text: Column) -> Column:
    """P(grade > k) for every threshold, as an array."""
    if not model.thresholds:
        return F.array(F.lit(0.0))
    weight = dict(zip(model.words, model.weights))

    @F.pandas_udf("double")
    def total(texts: pd.Series) -> pd.Series:
        known = weight.keys()
        # Summed in the model's order, so that equal texts get equal scores everywhere.
        place = {w: i for i, w in enumerate(weight)}
        found = (sorted(features_of(t if isinstance(t, str) else None) & known, key=place.get) for t in texts)
        return pd.Series([sum((weight[w] for w in f), 0.0) for f in found], dtype=float)

    exceeds = lambda s: F.array(*[1 / (1 + F.exp(F.lit(t) - s)) for t in model.thresholds])
    return F.get(F.transform(F.array(total(text.cast("string"))), exceeds), F.lit(0))


def score(docs: DataFrame, model: OrdinalModel, into: str = "toxicity") -> DataFrame:
    """Add struct<expected: double, p_toxic: double, grade: int>: expected grade, P(grade > 0), most likely grade."""
    held = F.transform(
        F.array(_exceeds(model, F.col("text"))),
        lambda p: F.struct(
            F.aggregate(p, F.lit(0.0), lambda a, b: a + b).alias("expected"),
            F.get(p, F.lit(0)).alias("p_toxic"),
            _most_likely(p, max(1, len(model.thresholds))).alias("grade"),
        ),
    )
    return docs.withColumn(into, F.get(held, F.lit(0)))


def _most_likely(exceeds: Column, top: int) -> Column:
    at = lambda k: F.get(exceeds, F.lit(k))
    mass = [1 - at(0), *[at(k - 1) - at(k) for k in range(1, top)], at(top - 1)]
    best = F.greatest(*mass)
    found = F.lit(top)
    for k in reversed(range(top)):
        found = F.when(mass[k] == best, F.lit(k)).otherwise(found)
    return found


def without_toxic(docs: DataFrame, labels: DataFrame, reject_at: float = REJECT_AT) -> DataFrame:
    """docs whose expected grade stays below the limit."""
    rows = score(docs.select(F.struct("*").alias("_row"), F.col("text").cast("string").alias("text")), fit(docs, labels), "_toxicity")
    return rows.filter(F.col("_toxicity.expected") < reject_at).select("_row.*")
