"""Spelling variants of frequent words by an asymmetric chunk join within one edit.

Words are counted per task and then by Spark.  Of two words within one edit, the one of fewer code points
(equal: the smaller) is cut into two disjoint chunks, its halves.  The edit damages at most one of them, so the
other stands in the longer word as well, as a gram at its own place or, behind an inserted letter, one place
later.  The longer word therefore contributes its positional grams for every length the shorter one can
have, and both are joined on length, chunk and text.

A half alone is shared by many words.  What the preserved chunk leaves over differs by the same one edit, so of
its own two halves one stands again: that part is added to the key.  An edit in quarter ``k`` of the shorter word
leaves the three other quarters, and the key of ``k`` consists of them.  All pairs that meet are
verified by their edit distance.

A word's form is the near word of largest count, if that is at least ``FACTOR`` times its own.  Counts grow by that
factor from form to form, so chains are short, and their ends are found by doubling.

Defined cases: null and empty texts have no words; words are compared by code points, ties go to the smaller in
code-point order; a null doc_id counts as the empty text in the check sum; repeated rows count each; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.session import cut_lineage

MIN_LENGTH = 7
MIN_COUNT = 2
FACTOR = 10
DROP_EVERY = 31
HELD_WORDS = 500_000  # distinct words that a task holds before it hands on its counts
QUARTERS = 4

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans({c: chr(c + 32) for c in range(0x41, 0x5B)})


def words_of(doc_id: int | None, text: str | None, min_length: int = MIN_LENGTH) -> Iterator[tuple[str, int]]:
    """(word, uses) of a document; a run whose check sum with the id is a multiple of ``DROP_EVERY`` loses one letter."""
    head = b"%s:" % (b"" if doc_id is None else str(doc_id).encode())
    base = zlib.crc32(head)
    for run, uses in Counter(_RUN.findall((text or "").translate(_LOWER))).items():
        if len(run) < min_length:
            continue
        h = zlib.crc32(run.encode(), base)
        if h % DROP_EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < min_length:
                continue
        yield run, uses


def count_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of docs (doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = defaultdict(int)

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([*held], pa.string()), pa.array([*held.values()], pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, uses in words_of(doc_id, text, min_length):
                    held[word] += uses
            if len(held) >= HELD_WORDS:
                yield rows()
                held.clear()
        if held:
            yield rows()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _bounds(length: Column) -> list[Column]:
    """Starts of the quarters of a word of this length, and its end; the second and third make up the chunks' border."""
    half = F.floor(length / 2).cast("int")
    return [F.lit(0), F.floor(half / 2).cast("int"), half, half + F.floor((length - half) / 2).cast("int"), length]


def _key(word: Column, own: Column, shorter: Column, k: int) -> Column:
    """The key of quarter ``k``: the length of the shorter word, k, and the word without that quarter.

    Behind the quarter the grams of a longer word stand one place later.
    """
    at = _bounds(shorter)
    shift = own - shorter
    return F.struct(
        shorter.alias("length"),
        F.lit(k).alias("k"),
        F.substring(word, F.lit(1), at[k]).alias("head"),
        F.substring(word, at[k + 1] + shift + 1, own).alias("tail"),
    )


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): every two words (word, n) that differ by one inserted, deleted or replaced code point, once."""
    sized = words.select("word", "n", F.length("word").alias("_l"))
    chunks = sized.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.explode(F.array(*[_key(F.col("word"), F.col("_l"), F.col("_l"), k) for k in range(QUARTERS)])).alias("_k"))
    grams = sized.select(
        F.col("word").alias("b"),
        F.col("n").alias("n_b"),
        F.explode(F.array(*[_key(F.col("word"), F.col("_l"), F.col("_l") - d, k) for d in (0, 1) for k in range(QUARTERS)])).alias("_k"),
    )
    x = chunks.select("a", "n_a", "_k.*")
    y = grams.select("b", "n_b", "_k.*")
    met = x.join(y, ["length", "k", "head", "tail"]).filter((F.col("length") < F.length("b")) | (F.col("a") < F.col("b")))
    return met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").distinct()


def _roots(links: DataFrame, steps: int) -> DataFrame:
    """(word, root) for links (word, form): the ends of chains of at most 2 ** steps links."""
    held = links.select("word", F.col("form").alias("root"))
    for _ in range(steps):
        ahead = held.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        held = cut_lineage(held.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root")))
    return held


def group_variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of words (word, n)."""
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n_near")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("n_near"))
    )
    # The largest count, then the smallest word; both combine on the map side.
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_near")).alias("minus"), "near")).alias("_best"))
    judged = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("_best.minus") >= factor * F.col("n"), F.col("_best")).alias("_form")
    )
    judged = cut_lineage(judged.select("word", "n", "n_near", F.col("_form.near").alias("form"), (-F.col("_form.minus")).alias("form_n")))
    links = judged.filter("form IS NOT NULL").select("word", "form")
    most, steps = judged.agg(F.max("n")).first()[0] or 1, 0
    while factor ** (2**steps) <= most:  # a chain of l links ends in a word of factor ** l uses at least
        steps += 1
    roots = _roots(links, steps)
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    """Spelling variants among all words of the whole texts of docs (doc_id, text)."""
    return group_variants(cut_lineage(count_words(docs)))
