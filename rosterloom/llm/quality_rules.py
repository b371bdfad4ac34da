"""Quality rules with DataFrame functions only: fixed limits, and robust multivariate outliers.

Every text is reduced to a few counts in its own row.  The counts become a vector of transformed
statistics, and per (language, source) the centre and scatter of the bulk are estimated by minimum
covariance determinant: from medians and absolute deviations, concentration steps keep the share
``CORE`` of documents with the smallest Mahalanobis distance and take mean and covariance again.
Quantiles, means and covariances are combinable aggregates, so a group of any size is never gathered;
only one small row per group is joined back.  A document is rejected if its distance to its group
exceeds ``CUTOFF``, the chi-square quantile that leaves ``TAIL`` of a normal sample outside.

Most statistics are 0 for most prose, so scatter matrices get the square of ``FLOOR`` added on
their diagonal: smaller differences never count as outlying.  Groups with fewer than ``MIN_GROUP``
eligible documents are judged by all documents of their language, languages with fewer by the corpus.

Defined cases: a null text has no words; documents that fail the fixed limits are rejected and take
no part in the estimates; null languages and sources form groups of their own; equal rows are judged
alike, each by itself; an empty table gives no rows; of other columns none is read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.session import cut_lineage

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
CORE = 0.75
BROADCAST_GROUPS = 20_000  # rows of at most about 200 bytes
STEPS = 6
MIN_GROUP = 50
TAIL = 0.001  # share of normal documents beyond the cutoff
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Transformed statistics and the smallest difference that counts as scatter.  Roots of shares lie in 0..1, so
# a floor of 0.1 lets a statistic reject alone beyond a share of about 0.18 where its group has none.
FLOOR = {"word_length": 0.1, "symbol_share": 0.05, "duplicate_lines": 0.1, "repetition": 0.1}
FEATURES = list(FLOOR)
_QUANTILE_ACCURACY = 2000


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column, n: int = 3) -> Column:
    """Number of words in windows of n words that occur at least twice.

    Windows are compared by 64-bit hashes.  Sorted (hash, place) pairs put equal windows side by
    side; the places that have an equal neighbour, in order, cover min(n, distance) words each.
    """

    def covered(places: Column) -> Column:
        own = F.transform(
            places, lambda p, j: F.when(j == 0, F.lit(n)).otherwise(F.least(F.lit(n), p - F.get(places, j - 1)))
        )
        return F.aggregate(own, F.lit(0), lambda a, x: a + x)

    def places(pairs: Column) -> Column:
        h = lambda j: F.get(pairs, j)["h"]
        twice = F.filter(pairs, lambda p, j: F.coalesce(h(j - 1) == p["h"], F.lit(False)) | F.coalesce(h(j + 1) == p["h"], F.lit(False)))
        return F.sort_array(F.transform(twice, lambda p: p["i"]))

    def repeated(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            _let(_let(pairs, places), covered)
        )

    def counted(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n)))
        return F.when(F.size(w) <= n, F.lit(0)).otherwise(_let(hashes, repeated))

    return _let(words, counted)


def text_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", "lang", "source", text.alias("_text"))
    words = F.array_remove(F.split("_text", r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split("_text", "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    sizes = _let(words, lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeated")))
    line_sizes = _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    return rows.select(
        "doc_id",
        "lang",
        "source",
        sizes.alias("_w"),
        line_sizes.alias("_l"),
        F.length(F.translate("_text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    ).select(
        "doc_id",
        "lang",
        "source",
        F.col("_w.n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("_l.n").cast("long").alias("n_lines"),
        F.col("_l.dup").cast("long").alias("n_dup_lines"),
        F.col("_w.repeated").cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def _features() -> dict[str, Column]:
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "word_length": F.log1p(ratio("word_chars", "n_words")),
        "symbol_share": F.sqrt(ratio("n_symbols", "word_chars")),
        "duplicate_lines": F.sqrt(ratio("n_dup_lines", "n_lines")),
        "repetition": F.sqrt(ratio("n_repeat_words", "n_words")),
    }


def _chi2_cdf(x: float, dof: int) -> float:
    """Chi-square distribution function for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def _chi2_quantile(share: float, dof: int) -> float:
    low, high = 0.0, 100.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, dof) < share else (low, mid)
    return low


CUTOFF = _chi2_quantile(1 - TAIL, len(FEATURES))  # squared distance, about 18.47


def consistency(core: float = CORE, p: int = len(FEATURES)) -> float:
    """Factor that makes the scatter of the core of a normal sample that of the whole sample."""
    return core / _chi2_cdf(_chi2_quantile(core, p), p + 2)


def _factor(estimates: DataFrame, keys: list[str], covariance) -> DataFrame:
    """Cholesky factor of each group's scatter, floors added: columns ``l_i_j``."""
    out = estimates
    for i in range(len(FEATURES)):
        for j in range(i + 1):
            rest = covariance(i, j) + (F.lit(FLOOR[FEATURES[i]] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            out = out.withColumn(f"l_{i}_{j}", F.sqrt(rest) if i == j else rest / F.col(f"l_{j}_{j}"))
    kept = [f"m_{i}" for i in range(len(FEATURES))] + [f"l_{i}_{j}" for i in range(len(FEATURES)) for j in range(i + 1)]
    return out.select(*keys, *kept)


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution with the group's factor."""
    solved: list[Column] = []
    for i, name in enumerate(FEATURES):
        value = F.col(name) - F.col(f"m_{i}")
        for k in range(i):
            value = value - F.col(f"l_{i}_{k}") * solved[k]
        solved.append(value / F.col(f"l_{i}_{i}"))
    total = F.lit(0.0)
    for value in solved:
        total = total + value * value
    return total


def _judged_by(stats: DataFrame) -> DataFrame:
    """The level that judges each (lang, source): 0 its own documents, 1 its language's, 2 the corpus."""
    sizes = stats.groupBy("lang", "source").agg(F.sum((~F.col("failed")).cast("long")).alias("n"))
    sizes = sizes.toDF("g_lang", "g_source", "n")
    langs = sizes.groupBy(F.col("g_lang").alias("_lang")).agg(F.sum("n").alias("n_lang"))
    return sizes.join(langs, F.col("g_lang").eqNullSafe(F.col("_lang"))).select(
        "g_lang",
        "g_source",
        F.when(F.col("n") >= MIN_GROUP, 0).when(F.col("n_lang") >= MIN_GROUP, 1).otherwise(2).alias("level"),
    )


def _with_group(rows: DataFrame, groups: DataFrame, on: str | Column, how: str = "inner") -> DataFrame:
    """Rows joined to a written table of one row per group.

    A group may hold most rows, so no row is shuffled by its group: the table is broadcast once it is counted to be small.  Beyond that
    groups are many, and Spark joins as it sees fit.
    """
    return rows.join(F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups, on, how)


def robust_estimates(stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups with the level that judges them, estimates per level group: centre and scatter factor)."""
    groups = _judged_by(stats)
    groups = cut_lineage(groups)
    small_langs = groups.filter("level = 1").select(F.col("g_lang").alias("s_lang")).distinct()
    small_corpus = groups.filter("level = 2").limit(1).select(F.lit(1).alias("s_any"))
    rows = stats.filter("not failed").select(F.col("lang"), F.col("source"), *FEATURES)
    own = _with_group(rows, groups.filter("level = 0"), F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")))
    own = own.select(F.lit(0).alias("level"), "lang", "source", *FEATURES)
    by_lang = _with_group(rows, small_langs, F.col("lang").eqNullSafe(F.col("s_lang"))).select(
        F.lit(1).alias("level"), "lang", F.lit(None).cast("string").alias("source"), *FEATURES
    )
    corpus = rows.join(small_corpus, F.lit(1) == F.col("s_any")).select(
        F.lit(2).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), *FEATURES
    )
    # One text key per group, so that groups of null languages or sources join like others.
    key = F.to_json(F.struct("level", "lang", "source"))
    pool = cut_lineage(own.unionByName(by_lang).unionByName(corpus).select(key.alias("g"), *FEATURES))

    middle = cut_lineage(pool.groupBy("g").agg(*[F.percentile_approx(f, 0.5, _QUANTILE_ACCURACY).alias(f"m_{i}") for i, f in enumerate(FEATURES)]))
    spread = _with_group(pool, middle, "g").groupBy("g").agg(
        *[F.first(f"m_{i}").alias(f"m_{i}") for i in range(len(FEATURES))],
        *[F.percentile_approx(F.abs(F.col(f) - F.col(f"m_{i}")), 0.5, _QUANTILE_ACCURACY).alias(f"d_{i}") for i, f in enumerate(FEATURES)],
    )
    # 1.4826 turns the median absolute deviation of a normal sample into its standard deviation.
    estimates = _factor(spread, ["g"], lambda i, j: (1.4826 * F.col(f"d_{i}")) ** 2 if i == j else F.lit(0.0))
    estimates = cut_lineage(estimates)
    factor = consistency()
    for _ in range(STEPS):
        far = _with_group(pool, estimates, "g").select("g", *FEATURES, _distance().alias("d2"))
        limits = cut_lineage(far.groupBy("g").agg(F.percentile_approx("d2", CORE, _QUANTILE_ACCURACY).alias("limit")))
        core = _with_group(far, limits, "g").filter("d2 <= limit")
        moments = core.groupBy("g").agg(
            *[F.avg(f).alias(f"m_{i}") for i, f in enumerate(FEATURES)],
            *[F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c_{i}_{j}") for i in range(len(FEATURES)) for j in range(i + 1)],
        )
        estimates = cut_lineage(_factor(moments, ["g"], lambda i, j: factor * F.col(f"c_{i}_{j}")))
    return groups, estimates


def judge(docs: DataFrame) -> DataFrame:
    """Statistics of every row with ``base_failed``, ``distance`` (squared, null where failed) and ``kept``."""
    stats = text_statistics(docs).withColumn("failed", base_failed())
    stats = cut_lineage(stats.select("*", *[c.alias(n) for n, c in _features().items()]))
    groups, estimates = robust_estimates(stats)
    lang = F.when(F.col("level") < 2, F.col("g_lang"))
    source = F.when(F.col("level") < 1, F.col("g_source"))
    key = F.to_json(F.struct("level", lang.alias("lang"), source.alias("source")))
    by_group = cut_lineage(groups.select("g_lang", "g_source", key.alias("g")).join(estimates, "g", "left").drop("g"))
    same = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    judged = _with_group(stats, by_group, same, "left").withColumn("distance", F.when(~F.col("failed"), _distance()))
    return judged.select(
        "doc_id",
        "lang",
        "source",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        F.col("failed").alias("base_failed"),
        "distance",
        (~F.col("failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)).alias("kept"),
    )
