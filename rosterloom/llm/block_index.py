"""Inverted lists of whole texts in blocks of documents.

A block is a run of at most ``DOCS_PER_BLOCK`` documents that one task reads one after another; it is closed
earlier when it holds ``TOKENS_PER_BLOCK`` tokens.  A term has one row per block that holds it: the places of
its documents in the block and how often each holds it.  So a term that every document holds has as many rows
as there are blocks, none of which is longer than a block, and a corpus is told in a few rows per thousand
documents and term instead of one per document and term.

Tokens are what is left between white space after a table has replaced each byte of the UTF-8 text, so a
table may lower-case letters and turn signs into white space.  Texts are read piece by piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BITS = 13
DOCS_PER_BLOCK = 1 << _BITS
TOKENS_PER_BLOCK = 1 << 22
PIECE = 1 << 20  # bytes of a text that are split at once

BLOCK_SCHEMA = (
    "block long, terms array<string>, gathered array<long>, ends array<int>, places array<int>, counts array<int>, ids array<long>, lengths array<long>"
)
INDEX_SCHEMA = "block long, term string, places array<int>, counts array<int>, gathered long, ids array<long>"


def byte_table(blank: bytes) -> bytes:
    """Lower-case A-Z and turn the given bytes into spaces; all other bytes stay."""
    out = bytearray(range(256))
    out[0x41:0x5B] = range(0x61, 0x7B)
    for b in blank:
        out[b] = 0x20
    return bytes(out)


def pieces(raw: bytes) -> Iterator[bytes]:
    start = 0
    while len(raw) - start > PIECE:
        end = raw.find(b" ", start + PIECE)
        if end < 0:
            break
        yield raw[start:end]
        start = end
    yield raw[start:]


class _Numbers(dict):
    """Numbers words from 0 as they are met."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.astype(np.int32)))


class _Block:
    def __init__(self):
        self.numbers, self.raw, self.n_raw, self.tokens = _Numbers(), [], 0, 0
        self.keys, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, raw: bytes) -> None:
        place, length = len(self.ids), 0
        for piece in pieces(raw):
            words = piece.split()
            if words:
                found = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
                self.raw.append(found << _BITS | place)
                self.n_raw += len(words)
                length += len(words)
            if self.n_raw >= TOKENS_PER_BLOCK:
                self._fold()
        self.ids.append(doc_id)
        self.lengths.append(length)
        self.tokens += length

    def _fold(self) -> None:
        """Count equal (word, place) pairs among the tokens that are not counted yet."""
        keys, counts = np.unique(np.concatenate([np.empty(0, np.int64), *self.raw]), return_counts=True)
        if len(self.keys):
            keys, counts = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, counts = keys[first], np.add.reduceat(counts, first)
        self.keys, self.counts, self.raw, self.n_raw = keys, counts, [], 0

    def _lists(self, gathers: Callable[[int | None], bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(offsets of the terms' lists, places, gathered per term, which documents gather)"""
        self._fold()
        number, place = self.keys >> _BITS, self.keys & (DOCS_PER_BLOCK - 1)
        offsets = np.searchsorted(number, np.arange(len(self.numbers) + 1))
        flags = np.array([gathers(d) for d in self.ids], dtype=np.int64)
        gathered = np.add.reduceat(self.counts * flags[place], offsets[:-1]) if len(self.numbers) else np.zeros(0, np.int64)
        return offsets, place, gathered, flags

    def whole(self, block: int, gathers: Callable[[int | None], bool]) -> pa.RecordBatch:
        """One row of ``BLOCK_SCHEMA``."""
        offsets, place, gathered, _ = self._lists(gathers)
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        terms = pa.ListArray.from_arrays(pa.array([0, len(self.numbers)], pa.int32()), pa.array([*self.numbers], pa.binary()).cast(pa.string()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block], pa.int64()),
                terms,
                one(gathered, pa.int64()),
                one(offsets[1:].astype(np.int32), pa.int32()),
                one(place.astype(np.int32), pa.int32()),
                one(self.counts.astype(np.int32), pa.int32()),
                one(self.ids, pa.int64()),
                one(self.lengths, pa.int64()),
            ],
            names=["block", "terms", "gathered", "ends", "places", "counts", "ids", "lengths"],
        )

    def rows(self, block: int, gathers: Callable[[int | None], bool]) -> pa.RecordBatch:
        """One row per term, and one without a term: all documents with their lengths and ids."""
        offsets, place, gathered, flags = self._lists(gathers)
        n, size = len(self.numbers), len(self.ids)
        whole = np.concatenate([offsets, [offsets[-1] + size]])
        ids = pa.array([None] * n + [self.ids], pa.list_(pa.int64()))
        terms = pa.array([*self.numbers, None], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n + 1, block)),
                terms,
                _lists(np.concatenate([place, np.arange(size)]), whole),
                _lists(np.concatenate([self.counts, np.array(self.lengths, np.int64)]), whole),
                pa.array(np.concatenate([gathered, [flags.sum()]])),
                ids,
            ],
            names=["block", "term", "places", "counts", "gathered", "ids"],
        )


def every(doc_id: int | None) -> bool:
    return True


def _blocks(
    docs: DataFrame, table: bytes, gathers: Callable[[int | None], bool], told: Callable[[_Block, int, Callable], pa.RecordBatch], schema: str, tokens: int
) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block.add(doc_id, (raw or b"").translate(table))
                if len(block.ids) >= DOCS_PER_BLOCK or block.tokens >= tokens:
                    yield told(block, number, gathers)
                    number, block = number + 1, _Block()
        if block.ids:
            yield told(block, number, gathers)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(work, schema)


def block_index(docs: DataFrame, table: bytes, gathers: Callable[[int | None], bool] = every) -> DataFrame:
    """Rows of ``INDEX_SCHEMA`` for docs (doc_id, text); to be written before use, as blocks are numbered by task.

    ``gathered`` counts what the documents hold for which ``gathers`` is true.  The row of a block without a term has
    the lengths of its documents as ``counts``, their ``ids``, and how many of them gather.
    """
    return _blocks(docs, table, gathers, _Block.rows, INDEX_SCHEMA, TOKENS_PER_BLOCK)


def whole_blocks(docs: DataFrame, table: bytes, gathers: Callable[[int | None], bool] = every, tokens: int = TOKENS_PER_BLOCK // 2) -> DataFrame:
    """The same as one row of ``BLOCK_SCHEMA`` per block, whose lists are told one after another and end at ``ends``."""
    return _blocks(docs, table, gathers, _Block.whole, BLOCK_SCHEMA, tokens)
