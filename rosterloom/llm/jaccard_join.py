"""Exact set-similarity self-join of word shingles by partitioning the universe of shingles.

Sets of sizes in one band, or in neighbouring bands, that reach the threshold differ in at most H
shingles.  The universe is hashed into segments; a set's part of a segment is its subset.  Segments
carry units: equal subsets cost one unit, subsets that differ in one shingle cost two, and if the
units that a set probes with exceed H, every partner shares a key with it (pigeonhole).  So the index
holds a key for every subset and, for segments of two units, for the subset without each of its
shingles (the one-deletion neighbourhood).

Costs decide twice.  ``allocation`` chooses per size band how many segments of either kind there are
and how many spare units, weighing keys against thin segments, whose keys many sets share.  Once the
keys are counted, every set leaves out its most frequent keys as far as its spare units allow: they
stay in the index, but it does not probe with them.

Equal sets are one class with one representative.  First the shingles themselves are counted by buckets of the universe:
those that no other set holds differ from every partner, so a set with more of them than any difference that is
allowed is linked with nothing and needs no keys.  This settles most sets for a few bytes per shingle.  Keys that several
classes share become groups; no group is expanded into all pairs.  In a few rounds each group's hub is verified against its
members, and components are contracted.  Sets that still share keys across components are indexed
again with two units wherever possible (wider subsets with one-deletion neighbourhoods, many more keys
for few sets), and the remaining pairs of different components are enumerated, each at its first
common key; groups of more than ``LARGE_GROUP`` sets make no pairs but are verified in cells of bounded
size, which give a spanning forest of links.  Before that, shingles that no other remaining set holds are charged against the difference
that is allowed, which settles most sets without any pair.  Every pair is verified on the shingles themselves
(64-bit hashes, as are all shingles here).

Defined cases: a null or empty text has no shingles and is linked with nothing; a text of fewer words
than a shingle is one shingle; rows that share a ``doc_id`` are one node, found and verified by
the set with the smallest hash among them; a null ``doc_id`` gets a null component; an empty table gives no rows; of other columns none
is read by ``components``, and ``keep_one`` keeps them all.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterloom.operators.identity import connected_components
from rosterloom.session import cut_lineage, release_shuffles

WORDS = 3
PERCENT = 90
BAND_GROWTH = 1.3
WIDE = 2.5  # size of a segment of two units, in segments of one unit
THIN_COST = 2000.0  # cost of probing with a subset of few shingles, in keys
HUBS_PER_ROUND = (1, 2, 2)
LARGE_GROUP = 32  # groups up to this size make pairs, larger ones are verified in cells of two chunks
CHUNK = 500
CACHED_WORDS = 400_000
LOT_SHINGLES = 1 << 19
LOT_DOCUMENTS = 1 << 16
BUCKET_LETTERS = 1 << 23  # letters of text per bucket of shingles
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to the sorted 64-bit hashes of their distinct word shingles."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.known: dict[bytes, int] = {}

    def _word(self, word: bytes) -> int:
        if len(self.known) >= CACHED_WORDS:
            self.known.clear()
        self.known[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        # bytes.lower changes A-Z only, and bytes.split takes space and \t-\r only.
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known, make = self.known.get, self._word
        ids = np.array([known(w) or make(w) for w in words], dtype=np.uint64)
        width = min(self.words, len(ids))
        h = np.full(len(ids) - width + 1, width, dtype=np.uint64)
        for k in range(width):
            h = _mix(h + ids[k : len(ids) - width + 1 + k])
        return np.unique(h)


def largest_partner(size: int, percent: int = PERCENT) -> int:
    return size * 100 // percent


def band_edges(limit: int = 1 << 40) -> list[int]:
    """First sizes of the bands; a set and its partners lie in one band or in two neighbouring ones."""
    edges = [1]
    while edges[-1] < limit:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND_GROWTH)))
    return edges


_EDGES = band_edges()


def max_difference(x: int, y: int, percent: int = PERCENT) -> int:
    """Largest symmetric difference of linked sets of these sizes."""
    common = -(-percent * (x + y) // (100 + percent))
    return x + y - 2 * common


def _poisson_excess(mean: float, spare: int) -> float:
    """Expected number above ``spare`` of a Poisson count."""
    p, below, total = math.exp(-mean), 0.0, 0.0
    for k in range(spare + 1):
        below += p * (k - spare)
        total += p
        p *= mean / (k + 1)
    return max(0.0, mean - spare - below)


@lru_cache(maxsize=None)
def allocation(band: int, percent: int = PERCENT) -> tuple[int, int, int]:
    """(segments of one unit, segments of two units, spare units) for sets of this band and their larger partners."""
    low, high = _EDGES[band], _EDGES[band + 1] - 1
    # The largest difference depends on the sum of the sizes; it grows with it up to rounding, which
    # repeats after at most 100 + percent sizes.
    most = high + largest_partner(high, percent)
    top = max(max_difference(s, 0, percent) for s in range(max(2 * low, most - 400), most + 1))
    if top <= 0:
        return 1, 0, 0
    best = None
    for wide in range(3):
        for spare in range(0, 9):
            narrow = top + 1 + spare - 2 * wide
            if narrow < 0 or narrow + wide == 0 or spare and narrow < spare:
                continue
            share = (low + high) / 2 / (narrow + WIDE * wide)
            thin = narrow * math.exp(-share) * (1 + share)
            x = WIDE * share
            thin_wide = wide * math.exp(-x) * (1 + x + x * x / 2)
            cost = narrow + wide * (1 + x) + THIN_COST * (_poisson_excess(thin, spare) + thin_wide)
            if best is None or cost < best[0]:
                best = (cost, narrow, wide, spare)
    return best[1:]


def bands_of(size: int, percent: int = PERCENT) -> list[int]:
    """Bands whose keys a set needs: its own, and the one below if partners can lie there."""
    own = bisect_right(_EDGES, size) - 1
    return [own] + ([own - 1] if own and largest_partner(_EDGES[own] - 1, percent) >= size else [])


def wide_allocation(band: int, percent: int = PERCENT) -> tuple[int, int]:
    """(segments of one unit, segments of two units) where selectivity counts most: two units wherever there are two."""
    narrow, wide, spare = allocation(band, percent)
    units = narrow + 2 * wide - spare
    return (1, 0) if units == 1 else (0, -(-units // 2))


def subset_keys(shingles: np.ndarray, band: int, narrow: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys of a set's subsets, keys of its one-deletion neighbourhoods in the wide segments), two low bits free.

    The first ``wide`` segments are those of two units.
    """
    segments = narrow + wide
    place = (_mix(shingles + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    place *= narrow + WIDE * wide
    segment = np.where(place < WIDE * wide, place / WIDE, place - WIDE * wide + wide).astype(np.int64)
    np.minimum(segment, segments - 1, out=segment)
    content = _mix(shingles ^ np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(segment, kind="stable")
    segment, content = segment[order], content[order]
    starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    sums = np.zeros(segments, np.uint64)
    sums[segment[starts]] = np.add.reduceat(content, starts)
    tags = _mix(np.arange(segments, dtype=np.uint64) + np.uint64(band << 32))
    inner = segment < wide
    less = sums[segment[inner]] - content[inner] + tags[segment[inner]]
    return _mix(sums + tags) & np.uint64(_MASK - 3), _mix(less) & np.uint64(_MASK - 3)


def keys(shingles: np.ndarray, band: int, percent: int = PERCENT) -> np.ndarray:
    """Index keys of a set for a band.  The last bit marks segments of one unit, the one before the band's parity."""
    narrow, wide, _ = allocation(band, percent)
    whole, less = subset_keys(shingles, band, narrow, wide)
    parity = np.uint64(2 * (band & 1))
    one_unit = (np.arange(narrow + wide) >= wide).astype(np.uint64)
    return np.unique(np.concatenate([whole | parity | one_unit, less | parity]))


_LOTS = (
    "lot long, part long, single binary, several binary, places binary, runs binary, "
    "doc_ids array<long>, set_a array<long>, set_b array<long>, n array<int>, first array<int>"
)
_LOT_NAMES = [c.split()[0] for c in _LOTS.split(", ")]


class _Lot:
    """The sets of a task's next documents, equal ones once."""

    def __init__(self):
        self.doc_ids, self.digests, self.sizes, self.first = [], [], [], []
        self.met: dict[tuple, int] = {}
        self.sets: list[np.ndarray] = []
        self.shingles = 0

    def add(self, doc_id: int | None, shingles: np.ndarray) -> None:
        digest = tuple(int(_mix(shingles ^ np.uint64(s)).sum(dtype=np.uint64).astype(np.int64)) for s in (0x243F6A8885A308D3, 0x13198A2E03707344))
        place = len(self.doc_ids)
        first = self.met.setdefault((*digest, len(shingles)), place) if doc_id is not None else place
        self.doc_ids.append(doc_id)
        self.digests.append(digest)
        self.sizes.append(len(shingles))
        self.first.append(first)
        self.sets.append(shingles if first == place and doc_id is not None else shingles[:0])
        self.shingles += len(self.sets[-1])

    def rows(self, lot: int, buckets: int) -> pa.RecordBatch:
        """A row per bucket of shingles, and one with the documents, whose part is a number of its own below 0."""
        place = np.repeat(np.arange(len(self.sets), dtype=np.uint16), [len(x) for x in self.sets])
        flat = _mix(np.concatenate([np.empty(0, np.uint64), *self.sets]) + np.uint64(0xA0761D6478BD642F))
        _, back, held = np.unique(flat, return_inverse=True, return_counts=True)
        bucket, short = (flat >> np.uint64(32)) % np.uint64(buckets), flat.astype(np.uint32)
        out: list[list] = [[] for _ in _LOT_NAMES]
        several = held[back] > 1 if len(flat) else np.empty(0, bool)
        # Shingles of several sets are told once; stable sorting keeps the others in order of their places.
        _, one_each = np.unique(flat[several], return_index=True)
        shared, shared_bucket = short[several][one_each], bucket[several][one_each]
        alone, alone_bucket, place = short[~several], bucket[~several], place[~several]
        order, shared_order = np.argsort(alone_bucket, kind="stable"), np.argsort(shared_bucket, kind="stable")
        ends = [np.searchsorted(x, np.arange(buckets + 1, dtype=np.uint64)) for x in (alone_bucket[order], shared_bucket[shared_order])]
        for b in range(buckets):
            mine, theirs = order[ends[0][b] : ends[0][b + 1]], shared_order[ends[1][b] : ends[1][b + 1]]
            if len(mine) or len(theirs):
                places, runs = np.unique(place[mine], return_counts=True)
                row = (lot, b, alone[mine].tobytes(), shared[theirs].tobytes(), places.tobytes(), runs.astype(np.uint32).tobytes())
                for column, value in zip(out, (*row, None, None, None, None, None)):
                    column.append(value)
        set_a, set_b = zip(*self.digests)
        for column, value in zip(out, (lot, -1 - lot, None, None, None, None, self.doc_ids, set_a, set_b, self.sizes, self.first)):
            column.append(value)
        types = [pa.int64()] * 2 + [pa.binary()] * 4 + [pa.list_(pa.int64())] * 3 + [pa.list_(pa.int32())] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=_LOT_NAMES)


def lots(docs: DataFrame, buckets: int, words: int = WORDS) -> DataFrame:
    """Digests and sizes of the sets, and their shingles by buckets of the universe, in lots of bounded size.

    A task folds what it meets itself: equal sets of a lot are one, and a shingle that several sets of it hold is told once.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, number, lot = Shingler(words), TaskContext.get().partitionId() << 32, _Lot()
        for batch in batches:
            for document, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lot.add(document, shingler(text))
                if lot.shingles >= LOT_SHINGLES or len(lot.doc_ids) >= LOT_DOCUMENTS:
                    yield lot.rows(number, buckets)
                    number, lot = number + 1, _Lot()
        if lot.doc_ids:
            yield lot.rows(number, buckets)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, _LOTS)


def _numbers(raw: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(raw, kind)


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, set_a, set_b, n, alone) per row: its set's digest and size, and how many of its shingles no other set holds.

    ``alone`` is never too large: shingles are told apart by their bucket and 32 bits, and equal sets of different
    lots hold each other's shingles.  It is null for rows whose set stands earlier in their lot.
    """
    letters = docs.agg(F.coalesce(F.sum(F.length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    told = lots(docs, -(-int(letters) // BUCKET_LETTERS) or 1, words)
    heads = ["doc_ids", "set_a", "set_b", "n", "first"]
    counted = f"lot long, places binary, counts binary, {_LOTS[_LOTS.index('doc_ids') :]}"

    def count(rows: pa.Table) -> pa.Table:
        """Per lot, the places with shingles that no other lot has in this bucket; the documents of a lot pass."""
        if rows["doc_ids"].null_count < rows.num_rows:
            nothing = pa.nulls(rows.num_rows, pa.binary())
            return pa.table({"lot": rows["lot"], "places": nothing, "counts": nothing, **{c: rows[c] for c in heads}})
        lot, single = rows["lot"].to_pylist(), [_numbers(x, np.uint32) for x in rows["single"].to_pylist()]
        others = [np.unique(np.concatenate([_numbers(x, np.uint32) for x in rows["several"].to_pylist()]))]
        values, back, held = np.unique(np.concatenate([*single, *others]), return_inverse=True, return_counts=True)
        lone = held[back] == 1
        out, start = [], 0
        for k, mine in enumerate(single):
            flags = lone[start : start + len(mine)]
            start += len(mine)
            places = _numbers(rows["places"][k].as_py(), np.uint16)
            runs = _numbers(rows["runs"][k].as_py(), np.uint32)
            if len(runs):
                counts = np.add.reduceat(flags.astype(np.int32), np.concatenate([[0], np.cumsum(runs[:-1], dtype=np.int64)]))
                out.append((lot[k], places.tobytes(), counts.astype(np.uint32).tobytes()))
        names, types = ("lot", "places", "counts"), (pa.int64(), pa.binary(), pa.binary())
        found = {n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(zip(names, types))}
        return pa.table({**found, **{c: pa.nulls(len(out), rows.schema.field(c).type) for c in heads}})

    def add_up(rows: pa.Table) -> pa.Table:
        at = np.flatnonzero(np.asarray(rows["doc_ids"].is_valid()))[0]
        lists = {c: rows[c][int(at)].as_py() for c in ("doc_ids", "set_a", "set_b", "n", "first")}
        alone = np.zeros(len(lists["n"]), np.int64)
        for places, counts in zip(rows["places"].to_pylist(), rows["counts"].to_pylist()):
            if places:
                alone[_numbers(places, np.uint16)] += _numbers(counts, np.uint32)
        own = np.array(lists.pop("first")) == np.arange(len(alone))
        lists["alone"] = pa.array(alone, mask=~own)
        columns = [("doc_id", lists["doc_ids"]), ("set_a", lists["set_a"]), ("set_b", lists["set_b"]), ("n", lists["n"]), ("alone", lists["alone"])]
        return pa.table({name: pa.array(value, pa.int64()) for name, value in columns})

    # The shingles are shuffled once, and nothing but counts after that.
    return told.groupBy("part").applyInArrow(count, counted).groupBy("lot").applyInArrow(add_up, "doc_id long, set_a long, set_b long, n long, alone long")


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(node, shingles) of the rows of docs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            sets = [shingler(text).view(np.int64) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        work, "node long, shingles array<long>"
    )


def _classes(signed: DataFrame) -> DataFrame:
    """(doc_id, rep): equal sets share the smallest doc_id among them."""
    sets = signed.filter("n > 0 AND doc_id IS NOT NULL")
    # Only sets that occur more than once need the join; rows of a large class are split by Spark.
    shared = sets.groupBy("set_a", "set_b", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("_c")).filter("_c > 1").drop("_c")
    return sets.join(shared, ["set_a", "set_b", "n"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))


def _candidates(signed: DataFrame, percent: int) -> DataFrame:
    """(doc_id) of one document per class that can have a partner: not too many of its shingles are held by no other set."""
    sets = signed.filter("n > 0 AND doc_id IS NOT NULL").groupBy("set_a", "set_b", "n").agg(F.min("doc_id").alias("doc_id"), F.min("alone").alias("alone"))
    return sets.filter(F.col("alone") * percent <= (100 - percent) * F.col("n")).select("doc_id").distinct()


_KEYED = "node long, n long, spare_even int, spare_odd int, keys array<long>"


def set_keys(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, n, spare_even, spare_odd, keys) of sets (node, shingles): keys, and spare units by parity of the band."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for shingles in batch.column(1):
                found, spare = np.asarray(shingles.values).view(np.uint64), [0, 0]
                for band in bands_of(len(found), percent):
                    spare[band & 1] = allocation(band, percent)[2]
                made = np.concatenate([keys(found, band, percent) for band in bands_of(len(found), percent)]).view(np.int64)
                for column, value in zip(out, (len(found), *spare, made)):
                    column.append(value)
            types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(out, types)]], names=["node", "n", "spare_even", "spare_odd", "keys"])

    return sets.select("node", "shingles").mapInArrow(work, _KEYED)


def _shared_keys(sets: DataFrame, percent: int) -> DataFrame:
    """(key, node, n, probe, degree): keys of at least two sets."""
    entries = cut_lineage(set_keys(sets, percent)).select("node", "n", "spare_even", "spare_odd", F.explode("keys").alias("key"))
    counts = entries.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    listed = cut_lineage(entries.join(counts, "key"))
    odd = F.col("key").bitwiseAND(F.lit(2).cast("long")) != 0
    one_unit = F.col("key").bitwiseAND(F.lit(1).cast("long")) == 1
    # A node's keys are as many as its segments, so these windows are small.
    rank = F.row_number().over(Window.partitionBy("node", odd, one_unit).orderBy(F.desc("members"), "key"))
    spare = F.when(odd, F.col("spare_odd")).otherwise(F.col("spare_even"))
    return listed.select(
        "key", "node", "n", (~one_unit | (rank > spare)).alias("probe"), F.count("*").over(Window.partitionBy("node")).alias("degree")
    )


def _wide_keys(sets: DataFrame, percent: int) -> DataFrame:
    """(key, node, n, probe) of the wide allocation; a key of a one-deletion neighbourhood probes nothing but whole subsets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, whole, less = [], [], [], []
            for node, shingles in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = np.asarray(shingles.values).view(np.uint64)
                parts = [subset_keys(found, band, *wide_allocation(band, percent)) for band in bands_of(len(found), percent)]
                nodes.append(node)
                sizes.append(len(found))
                whole.append(np.concatenate([w for w, _ in parts]).view(np.int64))
                less.append(np.concatenate([d for _, d in parts]).view(np.int64))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (whole, less)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), *lists], names=["node", "n", "whole", "less"]
            )

    made = sets.select("node", "shingles").mapInArrow(work, "node long, n long, whole array<long>, less array<long>")
    flagged = F.concat(
        F.transform("whole", lambda k: F.struct(k.alias("key"), F.lit(True).alias("probe"))),
        F.transform(F.array_except("less", "whole"), lambda k: F.struct(k.alias("key"), F.lit(False).alias("probe"))),
    )
    return made.select("node", "n", F.explode(flagged).alias("_k")).select("_k.key", "node", "n", "_k.probe")


def _close_in_size(a: F.Column, b: F.Column, percent: int) -> F.Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _open_groups(active: DataFrame) -> DataFrame:
    """Rows of groups that still hold two components and a probing member."""
    groups = active.groupBy("key").agg(
        F.min("comp").alias("_low"), F.max("comp").alias("_high"), F.max("probe").alias("_probed")
    ).filter("_low <> _high AND _probed").select("key")
    return active.join(groups, "key")


def _hub_pairs(active: DataFrame, hubs: int, turn: int, percent: int) -> DataFrame:
    """Every member of a group with the group's hubs; by connections in the first round, by hash afterwards."""
    orders = [
        F.struct("degree", F.xxhash64("node")) if turn == 0 else F.struct(F.xxhash64("node", F.lit(turn), F.lit(j)), F.lit(0).cast("long"))
        for j in range(hubs)
    ]
    member = F.struct("node", "n", "comp")
    chosen = active.groupBy("key").agg(*[F.max_by(member, F.when(F.col("probe"), o)).alias(f"h{j}") for j, o in enumerate(orders)])
    listed = chosen.select("key", F.array_distinct(F.array(*[f"h{j}" for j in range(hubs)])).alias("_hubs"))
    met = active.join(listed, "key").select("node", "n", "comp", F.explode("_hubs").alias("hub"))
    return met.filter((F.col("comp") != F.col("hub.comp")) & _close_in_size(F.col("n"), F.col("hub.n"), percent)).select(
        F.least("node", "hub.node").alias("u"), F.greatest("node", "hub.node").alias("v")
    ).distinct()


def _with_partners(sets: DataFrame, percent: int, rounds: int = 2) -> DataFrame:
    """Sets (node, shingles, alone) that can have a partner among them; ``alone`` counts shingles of no other set.

    Such shingles differ from every partner, so a set with more of them than any difference that is
    allowed is linked with nothing.  Without it others may stand alone, hence more than one round.
    """
    for _ in range(rounds):
        held = sets.select("node", F.explode("shingles").alias("s"))
        single = held.groupBy("s").agg(F.count("*").alias("c"), F.min("node").alias("node")).filter("c = 1")
        counts = single.groupBy("node").agg(F.count("*").alias("alone"))
        counted = sets.drop("alone").join(counts, "node", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
        sets = cut_lineage(counted.filter(F.col("alone") * percent <= (100 - percent) * F.size("shingles")))
    return sets


def _can_link(x: str, y: str, percent: int) -> F.Column:
    """Different components, sizes within the threshold, and lone shingles within the allowed difference."""
    col = lambda side, name: F.col(f"{side}.{name}")
    return (
        (col(x, "comp") != col(y, "comp"))
        & _close_in_size(col(x, "n"), col(y, "n"), percent)
        & ((col(x, "alone") + col(y, "alone")) * (100 + percent) <= (100 - percent) * (col(x, "n") + col(y, "n")))
    )


def _remaining_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs in the small groups, each once.

    ``rows`` are all rows of the nodes; a pair that shares a large group as well is left to the cells.
    """
    x, y = rows.filter("not large").alias("x"), rows.filter("not large").alias("y")
    met = x.join(
        y,
        (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & _can_link("x", "y", percent) & (F.col("x.probe") | F.col("y.probe")),
    )
    # Rows meet without the lists of their nodes' keys, which would make each as large as a set.
    pairs = met.select(F.col("x.node").alias("u"), F.col("y.node").alias("v")).distinct()
    crowds = cut_lineage(rows.filter("large").groupBy("node").agg(F.collect_set("key").alias("crowds")))
    placed = pairs.join(crowds.select(F.col("node").alias("u"), F.col("crowds").alias("_x")), "u", "left").join(
        crowds.select(F.col("node").alias("v"), F.col("crowds").alias("_y")), "v", "left"
    )
    return placed.filter(~F.coalesce(F.arrays_overlap("_x", "_y"), F.lit(False))).select("u", "v")


def links_between(left: list[int], right: list[int], sets: list[np.ndarray], comps: list[int], percent: int) -> list[tuple[int, int]]:
    """Links (places) between two lists of sets that join components, a spanning forest of them; the lists may be the same.

    Intersections are counted by a matrix product over the shingles that several sets hold, in blocks.
    """
    order = sorted({*left, *right})
    lengths = np.array([len(sets[i]) for i in order])
    flat, owner = np.concatenate([sets[i] for i in order]), np.repeat(np.arange(len(order)), lengths)
    _, token, held = np.unique(flat, return_inverse=True, return_counts=True)
    shared = held[token] > 1
    owner, token = owner[shared], np.unique(token[shared], return_inverse=True)[1]
    common = np.zeros((len(order), len(order)), np.float32)
    by_token = np.argsort(token, kind="stable")
    owner, token = owner[by_token], token[by_token]
    for first in range(0, int(token[-1]) + 1 if len(token) else 0, 4096):
        low, high = np.searchsorted(token, [first, first + 4096])
        block = np.zeros((len(order), 4096), np.float32)
        block[owner[low:high], token[low:high] - first] = 1
        common += block @ block.T
    linked = 100 * common >= percent * (lengths[:, None] + lengths[None, :] - common)
    on_left, on_right = np.isin(order, left), np.isin(order, right)
    linked &= (on_left[:, None] & on_right[None, :]) | (on_right[:, None] & on_left[None, :])
    root = {comps[i]: comps[i] for i in order}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for a, b in zip(*np.nonzero(np.triu(linked, 1))):
        x, y = top(comps[order[a]]), top(comps[order[b]])
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((order[a], order[b]))
    return out


def _cell_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links in the large groups: members are dealt into chunks, and every two chunks meet in a cell of bounded size."""
    chunks = F.ceil(F.col("members") / CHUNK).cast("int")
    dealt = rows.filter("large").select("key", "node", "comp", chunks.alias("chunks"))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = met.select(
        "key", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "chunk", "node", "comp"
    ).join(sets.select("node", "shingles"), "node")

    def verify(cell: pd.DataFrame) -> pd.DataFrame:
        first, second = cell["a"].iloc[0], cell["b"].iloc[0]
        chunk, nodes = cell["chunk"].to_numpy(), cell["node"].to_numpy()
        left, right = np.flatnonzero(chunk == first).tolist(), np.flatnonzero(chunk == second).tolist()
        links = links_between(left, right, [np.asarray(s) for s in cell["shingles"]], cell["comp"].tolist(), percent)
        return pd.DataFrame([(min(nodes[i], nodes[j]), max(nodes[i], nodes[j])) for i, j in links], columns=["u", "v"], dtype="int64")

    return cells.groupBy("key", "a", "b").applyInPandas(verify, "u long, v long").distinct()


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with the flag ``linked``, from the shingles themselves."""
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("_x"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("_y"))
    common = F.size(F.array_intersect("_x", "_y"))
    both = pairs.join(left, "u").join(right, "v").select("u", "v", common.alias("_c"), (F.size("_x") + F.size("_y")).alias("_s"))
    return both.select("u", "v", (100 * F.col("_c") >= percent * (F.col("_s") - F.col("_c"))).alias("linked"))


def _relabel(rows: DataFrame, moved: DataFrame) -> DataFrame:
    moved = moved.select(F.col("node").alias("comp"), F.col("component").alias("_to"))
    return rows.join(moved, "comp", "left").withColumn("comp", F.coalesce("_to", "comp")).drop("_to")


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text)."""
    signed = cut_lineage(signatures(docs, words))
    classes = cut_lineage(_classes(signed))
    candidates = cut_lineage(_candidates(signed, percent))
    sets = cut_lineage(shingle_sets(docs.join(candidates, "doc_id", "left_semi"), words).filter(F.size("shingles") > 0)
        .groupBy("node").agg(F.min_by("shingles", F.xxhash64("shingles")).alias("shingles")))
    release_shuffles(docs.sparkSession)
    active = cut_lineage(_open_groups(_shared_keys(sets, percent).withColumn("comp", F.col("node"))))
    labels = cut_lineage(active.select("node").distinct().withColumn("comp", F.col("node")))
    apart = None
    for turn, hubs in enumerate((*HUBS_PER_ROUND, 0)):
        if active.isEmpty():
            break
        release_shuffles(docs.sparkSession)
        if hubs:
            pairs = _hub_pairs(active, hubs, turn, percent)
        else:
            # What shares keys but was not linked by hubs is indexed again, more selectively, and paired.
            left = _with_partners(sets.join(active.select("node").distinct(), "node", "left_semi"), percent)
            # Most of these many keys belong to one set; they go before anything is joined to them.
            made = _wide_keys(left, percent)
            members = made.groupBy("key").agg(F.count("*").alias("members"), F.max("probe").alias("_probed")).filter("members > 1 AND _probed")
            shared = cut_lineage(made.join(members.drop("_probed"), "key").withColumn("large", F.col("members") > LARGE_GROUP))
            release_shuffles(docs.sparkSession)
            rest = cut_lineage(_open_groups(shared.join(left.select("node", "alone"), "node").join(labels, "node")))
            in_cells = cut_lineage(_cell_links(rest, left, percent))
            release_shuffles(docs.sparkSession)
            pairs = _remaining_pairs(rest, percent)
        if apart is not None:
            pairs = pairs.join(apart, ["u", "v"], "left_anti")
        # The shingles of both sides travel to the pairs; what found the pairs is let go before.
        pairs = cut_lineage(pairs)
        release_shuffles(docs.sparkSession)
        verified = cut_lineage(_verify(pairs, sets, percent))
        refused = verified.filter("not linked").select("u", "v")
        apart = refused if apart is None else apart.unionByName(refused)
        links = verified.filter("linked").select("u", "v")
        if not hubs:
            links = links.unionByName(in_cells)
        ends = links.join(labels.select(F.col("node").alias("u"), F.col("comp").alias("cu")), "u").join(
            labels.select(F.col("node").alias("v"), F.col("comp").alias("cv")), "v"
        )
        moved = cut_lineage(connected_components(ends.select(F.col("cu").alias("u"), F.col("cv").alias("v"))))
        labels = cut_lineage(_relabel(labels, moved))
        if hubs:
            active = cut_lineage(_open_groups(_relabel(active, moved)))
    placed = classes.join(labels.select(F.col("node").alias("rep"), "comp"), "rep", "left").groupBy("doc_id").agg(
        F.min(F.coalesce("comp", "rep")).alias("component_id")
    )
    # Rows without an id are kept out of the join, where they would all meet in one task.
    rows = signed.select("doc_id", F.col("n").alias("n_shingles"))
    joined = rows.filter("doc_id IS NOT NULL").join(placed, "doc_id", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).unionByName(
        rows.filter("doc_id IS NULL").withColumn("component_id", F.col("doc_id"))
    )


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id, whose repeated rows become one.

    Rows with a null ``doc_id`` stay.
    """
    first = components(docs, words, percent).filter("component_id = doc_id").select(F.col("doc_id").alias("_first")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"))
    kept = rows.filter("_id IS NOT NULL").join(first, F.col("_id") == F.col("_first"), "left_semi")
    one = kept.groupBy("_id").agg(F.first("_row").alias("_row"))
    return one.select("_row.*").unionByName(rows.filter("_id IS NULL").select("_row.*"))
