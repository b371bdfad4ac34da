"""Ranked lexical search by pipelined term partitioning, with integer scores.

Documents are indexed in blocks (``block_index``).  Every term of a query item belongs to one of
``len(RARITY)`` stages, by the share of documents that hold it, rare terms first.  An item's bundle holds its
weighted terms and, per block, a sparse accumulator of scores.  Bundles pass the stages one after another:
each is a cogroup of the bundles with the inverted lists that the stage owns, by (block, slice of items),
which adds that stage's integer contributions.  So no group is larger than a block's documents times a
slice's items, whatever a term's frequency.

Rare terms make few accumulators, and what comes after a stage is known to be at most the sum of its items'
bounds.  A document that can no longer reach the ``k``-th best score of its own block leaves the accumulator:
it could not be among the ``k`` best of the whole, so nothing of the result is lost.  The last stage gives
each block's ``k`` best, from which the ``k`` best of all are chosen.

A term's weight is floor(1000 ln((2N+2)/(2df+1))), N the documents with a term and df those that hold it; a
document of n terms has m = 75 + (25 n N) div L, L all terms; each of the item's terms adds
weight * (10^9 tf div (1000 tf + 12 m)), repeats included.

Defined cases: null and empty texts have no terms and are never found; an item without terms, or with none
that occurs, has no rows; rows that share an item_id are one item with all their terms; repeated documents are
ranked each; equal scores come by ascending doc_id, a null one last; empty tables give no rows; other columns are
not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterloom.llm.block_index import block_index, byte_table, pieces
from rosterloom.session import cut_lineage

BEST = 20
# Largest share of documents that hold a term of the stage.
RARITY = (1 / 512, 1 / 64, 1 / 16, 1.0)
ITEMS_PER_SLICE = 128
BLOCKS_PER_SALT = 64
# Terms are runs of letters and digits, and of everything beyond ASCII.
TERM_BYTES = byte_table(bytes(b for b in range(0x80) if not chr(b).isalnum()))

_BUNDLE = "block long, slice int, item long, tids array<long>, stages array<int>, gains array<long>, bounds array<long>, places array<int>, scores array<long>"
_FOUND = "item long, doc_id long, score long"


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times) of items (item_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, terms, times = [], [], []
            for i, raw in enumerate(batch.column(1).to_pylist()):
                counts = Counter()
                for piece in pieces((raw or b"").translate(TERM_BYTES)):
                    counts.update(piece.split())
                ids += [i] * len(counts)
                terms += counts.keys()
                times += counts.values()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())],
                names=["item_id", "term", "times"],
            )

    rows = items.select("item_id", F.col("text").cast("string").cast("binary").alias("text"))
    schema = f"item_id {rows.schema['item_id'].dataType.simpleString()}, term string, times long"
    return rows.mapInArrow(work, schema).groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of a list column; null lists are empty."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.array(lists.value_lengths().fill_null(0))
    return np.concatenate([[0], np.cumsum(lengths)]), np.asarray(lists.flatten())


def kth_best(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def _stage(number: int, n_docs: int, n_terms: int, k: int, last: bool):
    """The work of one owner on one (block, slice): bundles in, bundles or the block's best out."""

    def work(bundles: pa.Table, owned: pa.Table) -> pa.Table:
        tids = np.asarray(owned["tid"])
        at = np.flatnonzero(tids < 0)
        if not len(at) or not bundles.num_rows:
            return (_found_schema() if last else bundles.schema).empty_table()
        offsets, places = _flat(owned["places"])
        counts = _flat(owned["counts"])[1].astype(np.int64)
        lengths = counts[offsets[at[0]] : offsets[at[0] + 1]]
        m = 75 + 25 * lengths * n_docs // n_terms
        share = 1_000_000_000 * counts // np.maximum(1000 * counts + 12 * m[places], 1)
        lists = {t: slice(offsets[i], offsets[i + 1]) for i, t in enumerate(tids.tolist()) if t >= 0}
        columns = {c: _flat(bundles[c]) for c in ("tids", "stages", "gains", "bounds", "places", "scores")}
        part = lambda c, i: columns[c][1][columns[c][0][i] : columns[c][0][i + 1]]
        out_places, out_scores = [], []
        total = np.zeros(len(lengths), np.int64)
        for i in range(bundles.num_rows):
            total[:] = 0
            total[part("places", i)] = part("scores", i)
            stages = part("stages", i)
            mine = stages == number
            for tid, gain in zip(part("tids", i)[mine].tolist(), part("gains", i)[mine].tolist()):
                where = lists.get(tid)
                if where is not None:
                    total[places[where]] += gain * share[where]
            held = np.flatnonzero(total)
            scores = total[held]
            rest = int(part("bounds", i)[stages > number].sum())
            fit = scores + rest >= kth_best(scores, k)
            out_places.append(held[fit].astype(np.int32))
            out_scores.append(scores[fit])
        if last:
            ids = owned["ids"].combine_chunks()
            ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
            return _best(bundles["item"], ids.slice(int(at[0]), 1).flatten(), out_places, out_scores, k)
        kept = bundles.select(["block", "slice", "item", "tids", "stages", "gains", "bounds"])
        ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in out_places])]), pa.int32())
        for name, parts in (("places", out_places), ("scores", out_scores)):
            kept = kept.append_column(name, pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts))))
        return kept

    return work


def _found_schema() -> pa.Schema:
    return pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _best(items: pa.ChunkedArray, ids: pa.Array, places: list[np.ndarray], scores: list[np.ndarray], k: int) -> pa.Table:
    """The k best of each bundle, equal scores by ascending id, null ids last."""
    null = np.asarray(ids.is_null())
    value = np.asarray(ids.fill_null(0))
    out_items, out_places, out_scores = [], [], []
    for item, place, score in zip(items.to_pylist(), places, scores):
        order = np.lexsort((value[place], null[place], -score))[:k]
        out_items += [item] * len(order)
        out_places.append(place[order])
        out_scores.append(score[order])
    taken = pa.array(np.concatenate([np.empty(0, np.int64), *out_places]).astype(np.int64))
    return pa.table([pa.array(out_items, pa.int64()), ids.take(taken), pa.array(np.concatenate([np.empty(0, np.int64), *out_scores]))], schema=_found_schema())


def search(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0, in ranks from 1."""
    asked = cut_lineage(item_terms(items))
    words = asked.select("term").distinct()
    index = block_index(docs, TERM_BYTES)
    # Only lists of asked terms are written; the rows without a term are the blocks themselves.
    index = cut_lineage(index.join(words.withColumn("_asked", F.lit(True)), "term", "left").filter("_asked OR term IS NULL").drop("_asked", "gathered"))
    blocks, lists = index.filter("term IS NULL").select("block", "places", "counts", "ids"), index.filter("term IS NOT NULL").drop("ids")
    sums = blocks.select(
        F.size(F.filter("counts", lambda n: n > 0)).alias("n"), F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n).alias("l")
    ).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("l"), F.lit(0)).alias("l"), F.count("*").alias("blocks")).first()
    n_docs, n_terms = int(sums["n"]), int(sums["l"])
    numbered = cut_lineage(asked.select("item_id").distinct().withColumn("item", F.monotonically_increasing_id()))
    n_items = numbered.count()
    if not n_docs or not n_items:
        return numbered.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    slices = -(-n_items // ITEMS_PER_SLICE)
    sliced = numbered.withColumn("slice", F.pmod(F.xxhash64("item"), F.lit(slices)).cast("int"))

    df = lists.groupBy("term").agg(F.sum(F.size("places")).cast("long").alias("df"), F.max(F.array_max("counts")).cast("long").alias("_tf"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    # No document gains more by a term than one of a single term would that held it most often.
    least = 75 + 25 * n_docs // n_terms
    bound = F.col("_w") * F.expr(f"1000000000 * _tf div (1000 * _tf + 12 * {least})")
    stage = F.lit(len(RARITY) - 1)
    for number in reversed(range(len(RARITY) - 1)):
        stage = F.when(F.col("df") <= RARITY[number] * n_docs, number).otherwise(stage)
    terms = df.withColumn("_w", weight).select("term", stage.alias("stage"), "_w", bound.alias("_bound"))
    terms = cut_lineage(terms.withColumn("tid", F.monotonically_increasing_id()))
    wanted = cut_lineage(asked.join(sliced, asked["item_id"].eqNullSafe(sliced["item_id"])).select("item", "slice", "term", "times").join(terms, "term"))
    bundles = wanted.groupBy("slice", "item").agg(F.sort_array(F.collect_list(F.struct("tid", "stage", (F.col("times") * F.col("_w")).alias("gain"), (F.col("times") * F.col("_bound")).alias("bound")))).alias("t"))
    bundles = bundles.select("slice", "item", F.col("t.tid").alias("tids"), F.col("t.stage").alias("stages"), F.col("t.gain").alias("gains"), F.col("t.bound").alias("bounds"))
    # Every block meets every slice; salts keep the few slices from being the only keys of this join.
    salts = -(-int(sums["blocks"]) // BLOCKS_PER_SALT)
    every_slice = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    met = blocks.select("block", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("_salt"), every_slice)
    copies = bundles.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    none = F.array().cast("array<int>").alias("places"), F.array().cast("array<long>").alias("scores")
    rows = met.join(copies, ["slice", "_salt"]).select("block", "slice", "item", "tids", "stages", "gains", "bounds", *none)

    owners = wanted.select("term", "tid", "stage", "slice").distinct()
    for number in range(len(RARITY)):
        last = number == len(RARITY) - 1
        owned = lists.join(owners.filter(F.col("stage") == number), "term").select(
            "block", "slice", "tid", "places", "counts", F.lit(None).cast("array<long>").alias("ids")
        )
        whole = blocks.select("block", every_slice, F.lit(-1).cast("long").alias("tid"), "places", "counts", ("ids" if last else F.lit(None).cast("array<long>").alias("ids")))
        # Both sides come from the index, so the owner's key columns need names of their own.
        owned = owned.unionByName(whole).select(F.col("block").alias("of_block"), F.col("slice").alias("of_slice"), "tid", "places", "counts", "ids")
        pair = rows.groupBy("block", "slice").cogroup(owned.groupBy("of_block", "of_slice"))
        rows = pair.applyInArrow(_stage(number, n_docs, n_terms, k, last), _FOUND if last else _BUNDLE)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(numbered, "item").select("item_id", "rank", "doc_id", "score")
