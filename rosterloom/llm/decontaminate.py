"""Benchmark decontamination with DataFrame functions only.

Items and documents become arrays of normalised words.  All windows of ``WINDOW`` item words (one
window for a shorter item) form the gram table.  It is cut into slices of at most about
``MAX_BROADCAST_GRAMS`` by hash, as many as its counted size asks for, one for most suites.  A slice's hashes go to every
task as a hash set of one byte per cell; a document's windows are hashed and looked up inside their row, so only the
few windows that pass become rows, and these are verified by a broadcast join of their words with the slice.  Each
slice is a pass over the documents, so what a task holds does not grow with the benchmark.

Defined cases: a null text has no words and is never hit; items without words are ignored; repeated
items, or items with a null id, count by their distinct ids (a null id is no item, its windows still
hit); equal rows get equal results, one each; empty tables give no rows or no hits; of other columns
none is read by ``find_contamination``, and ``decontaminate`` keeps them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.session import cut_lineage

WINDOW = 10
MAX_BROADCAST_GRAMS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What lies between words, as Java writes it: all of ASCII but digits and lower-case letters.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"


def normalised_words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; none for null."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lowered, _BETWEEN + "+"), "")


def benchmark_grams(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(gram, length, hash, items): every distinct window with the ids of the items it occurs in."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), normalised_words(F.col("text")).alias("words"))
    items = items.filter(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(window)))
    starts = items.select("item_id", "words", "length", F.explode(F.expr("sequence(1, size(words) - length + 1)")).alias("start"))
    grams = starts.select("item_id", "length", F.expr("slice(words, start, length)").alias("gram_words"))
    return grams.groupBy(F.array_join("gram_words", " ").alias("gram"), "length").agg(
        F.xxhash64(F.first("gram_words")).alias("hash"), F.collect_set("item_id").alias("items")
    )


def _cell(h: Column, cells: int) -> Column:
    return h.bitwiseAND(F.lit(cells - 1).cast("long")).cast("int")


def hash_set(grams: DataFrame, n_grams: int) -> bytes:
    """One byte per cell, 1 where a gram's hash falls; at most one cell in 32 is set.

    Slices are cut so that n_grams stays about MAX_BROADCAST_GRAMS, which bounds both what is collected
    here and the size of the literal that tasks get (64 bytes per gram).
    """
    cells = 1 << (32 * n_grams - 1).bit_length()
    marks = bytearray(cells)
    for row in grams.select(_cell(F.col("hash"), cells).alias("cell")).distinct().toLocalIterator():
        marks[row["cell"]] = 1
    return bytes(marks)


def _suspects(words: Column, length: int, marks: bytes) -> Column:
    """(start from 1, length) of the windows whose hash may be a gram's."""

    def marked(start: Column) -> Column:
        cell = _cell(F.xxhash64(F.slice(words, start, length)), len(marks))
        return F.substring(F.lit(bytearray(marks)), cell + 1, 1) == F.lit(bytearray(b"\x01"))

    starts = F.filter(F.sequence(F.lit(1), F.size(words) - (length - 1)), marked)
    pairs = F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(length).alias("length")))
    return F.when(F.size(words) >= length, pairs).otherwise(F.array().cast("array<struct<start:int,length:int>>"))


def _verified(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """Each row's suspect windows, with the items of those that are real; rows without any have one row of nulls."""
    grams = cut_lineage(benchmark_grams(benchmark, window))
    slices = max(1, -(-grams.count() // max(1, MAX_BROADCAST_GRAMS)))
    found = None
    if slices > 1:
        docs = cut_lineage(docs)  # rows keep their numbers in every pass
    for i in range(slices):
        part = grams if slices == 1 else cut_lineage(grams.filter(F.pmod(F.xxhash64("gram"), F.lit(slices)) == i))
        rows = _verified_by(docs, part)
        found = rows if found is None else found.unionByName(rows)
    return found


def _verified_by(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """``_verified`` for one slice of the gram table."""
    sizes = {r["length"]: r["n"] for r in grams.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most one per length
    rows = docs.withColumn("_words", normalised_words(F.col("text")))
    if not sizes:
        none = F.array().cast("array<struct<start:int,length:int>>")
        rows = rows.withColumn("_suspects", none)
    else:
        marks = hash_set(grams, sum(sizes.values()))
        lists = [_suspects(F.col("_words"), n, marks) for n in sorted(sizes)]
        rows = rows.withColumn("_suspects", F.concat(*lists) if len(lists) > 1 else lists[0])
    words_of = lambda s: F.array_join(F.slice(F.col("_words"), s["start"], s["length"]), " ")
    suspects = F.transform(
        "_suspects", lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"), words_of(s).alias("gram"))
    )
    rows = rows.withColumn("_n_words", F.size("_words").cast("long")).withColumn("_suspects", suspects)
    rows = rows.drop("text", "_words").withColumn("_s", F.explode_outer("_suspects")).drop("_suspects")
    table = F.broadcast(grams.select(F.col("gram").alias("_gram"), F.col("length").alias("_length"), F.col("items").alias("_items")))
    return rows.join(table, (F.col("_s.gram") == F.col("_gram")) & (F.col("_s.length") == F.col("_length")), "left").select(
        *[c for c in rows.columns if c != "_s"], F.when(F.col("_gram").isNotNull(), F.col("_s")).alias("_s"), "_items"
    )


def covered_words(hits: Column) -> Column:
    """Number of words inside any of the (start, length) windows, given in order of start."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))

    def step(acc: Column, h: Column) -> Column:
        end = F.greatest(acc["end"], h["start"] + h["length"])
        return F.struct(end.alias("end"), (acc["total"] + F.greatest(end - F.greatest(h["start"], acc["end"]), F.lit(0))).alias("total"))

    return F.aggregate(hits, start, step)["total"]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, hits, contaminated), one row per row of docs.

    ``hits`` are the (start, length) windows in words from 1; ``items`` the ids of the items they belong to.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("_row"))
    hits = F.array_sort(F.collect_set(F.when(F.col("_s").isNotNull(), F.struct("_s.start", "_s.length"))))
    found = (
        _verified(rows, benchmark, window)
        .groupBy("doc_id", "_row")
        .agg(
            F.first("_n_words").alias("n_words"),
            hits.alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("items"),
        )
    )
    return found.select(
        "doc_id",
        "n_words",
        covered_words(F.col("hits")).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        "hits",
        (F.size("hits") > 0).alias("contaminated"),
    )


def _merged(hits: Column) -> Column:
    """Disjoint [first, last] word ranges of windows given in order of start."""

    def step(acc: Column, h: Column) -> Column:
        first, last = h["start"], h["start"] + h["length"] - 1
        end = F.element_at(acc, -1)
        grown = F.struct(end["first"].alias("first"), F.greatest(end["last"], last).alias("last"))
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))
        added = F.concat(acc, F.array(F.struct(first.alias("first"), last.alias("last"))))
        return F.when(F.size(acc) == 0, added).when(end["last"] >= first - 1, joined).otherwise(added)

    return F.aggregate(hits, F.array().cast("array<struct<first:int,last:int>>"), step)


def without_windows(text: Column, hits: Column) -> Column:
    """The text without the words of the hits and without what stands between them."""
    between = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # as _BETWEEN, before lower-casing
    pieces = F.regexp_extract_all(text, F.lit(f"{between}+|[^{between[1:]}+"), F.lit(0))
    # Words and what lies between them alternate, so a word's number gives its place.
    shift = F.when(text.rlike(rf"\A{between}"), 0).otherwise(1)
    bound = F.struct(pieces.alias("pieces"), _merged(hits).alias("ranges"), shift.alias("shift"))

    def kept(x: Column) -> Column:
        pieces, ranges, shift = x["pieces"], x["ranges"], x["shift"]

        def part(i: Column) -> Column:
            low = F.when(i == 0, 1).otherwise(2 * F.get(ranges, i - 1)["last"] - shift + 1)
            high = F.when(i == F.size(ranges), F.size(pieces)).otherwise(2 * F.get(ranges, i)["first"] - shift - 1)
            return F.array_join(F.slice(pieces, low, F.greatest(high - low + 1, F.lit(0))), "")

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(ranges)), part), "")

    return F.get(F.transform(F.array(bound), kept), F.lit(0))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW) -> DataFrame:
    """docs without contaminated documents (``remove="documents"``) or without their hit words (``"spans"``)."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    text = F.col("text").cast("string")
    # The text's hash tells rows apart that share a doc_id.
    keyed = docs.select("doc_id", F.struct(F.col("doc_id").alias("id"), F.xxhash64(text).alias("hash")).alias("doc_id_"), text.alias("text"))
    found = find_contamination(keyed.select(F.col("doc_id_").alias("doc_id"), "text"), benchmark, window).filter("contaminated")
    found = found.groupBy("doc_id.id", "doc_id.hash").agg(F.first("hits").alias("hits")).toDF("_id", "_hash", "_hits")
    rows = docs.select(F.struct("*").alias("_row"))
    same = F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("_row.text").cast("string")) == F.col("_hash"))
    if remove == "documents":
        return rows.join(found, same, "left_anti").select("_row.*")
    cleaned = rows.join(found, same, "left")
    new = F.when(F.col("_hits").isNull(), F.col("_row.text")).otherwise(without_windows(F.col("_row.text"), F.col("_hits")))
    return cleaned.select(F.col("_row").withField("text", new).alias("_row")).select("_row.*")
