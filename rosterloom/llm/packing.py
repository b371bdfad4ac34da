"""Harmonic packing: documents into fixed-size token sequences, each worker on its own.

A length in (C/(k+1), C/k] belongs to class k, and a sequence of class k takes exactly k pieces.
A worker keeps one open sequence per class and never needs another worker's rows, so there is no
shuffle, and a lost executor only repeats its own partitions.  Lengths that would waste more than
``max_waste`` tokens of a sequence are cut at the next reciprocal C // (k+1); the rest falls into a
finer class.  What is still open at the end of a partition (at most one sequence per class) is
joined end to end, and its last part is cut into powers of two, which need no padding.

Defined cases: a null or empty text is one piece that holds the end id; repeated rows are packed
as often as they occur; a null ``doc_id`` is carried along; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.llm.encoding import BYTE_BPE_50K, END_ID, ID_BYTES, encoder

CAPACITY = 1024
MAX_WASTE = 16
PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
# Sequences of one worker are numbered below this; the worker's partition number stands above.
SEQUENCES_PER_PARTITION = 1 << 40


class HarmonicPacker:
    """The open sequences of one worker.  ``add`` and ``finish`` return placed pieces:
    (document, start, ids as bytes, document's tokens, sequence, offset)."""

    def __init__(self, capacity: int = CAPACITY, max_waste: int = MAX_WASTE, first_sequence: int = 0):
        self.capacity, self.max_waste = capacity, max_waste
        self.next_sequence = first_sequence
        self.open: dict[int, list[tuple]] = {}

    def cuts(self, length: int) -> list[tuple[int, int]]:
        """(class, length) of the pieces of a document."""
        capacity = self.capacity
        out = [(1, capacity)] * (length // capacity)
        rest = length % capacity
        while rest:
            k = capacity // rest
            if capacity - k * rest <= self.max_waste + capacity % k:
                out.append((k, rest))
                break
            size = capacity // (k + 1)
            out.append((k + 1, size))
            rest -= size
        return out

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        sequence, offset, out = self.next_sequence, 0, []
        self.next_sequence += 1
        for document, start, ids, total in pieces:
            out.append((document, start, ids, total, sequence, offset))
            offset += len(ids) // ID_BYTES
        return out

    def add(self, document, ids: bytes) -> list[tuple]:
        total, start, out = len(ids) // ID_BYTES, 0, []
        for k, length in self.cuts(total):
            waiting = self.open.setdefault(k, [])
            waiting.append((document, start, ids[start * ID_BYTES : (start + length) * ID_BYTES], total))
            start += length
            if len(waiting) == k:
                out += self._close(self.open.pop(k))
        return out

    def finish(self) -> list[tuple]:
        """Fill whole sequences from what is open, then powers of two."""
        left = [piece for k in sorted(self.open) for piece in self.open[k]]
        self.open = {}
        tokens = sum(len(ids) for _, _, ids, _ in left) // ID_BYTES
        sizes = [self.capacity] * (tokens // self.capacity)
        sizes += [1 << b for b in reversed(range(self.capacity.bit_length())) if tokens % self.capacity >> b & 1]
        out, at = [], 0
        for size in sizes:
            taken: list[tuple] = []
            while size:
                document, start, ids, total = left[at]
                part = ids[: size * ID_BYTES]
                taken.append((document, start, part, total))
                size -= len(part) // ID_BYTES
                if len(part) == len(ids):
                    at += 1
                else:
                    left[at] = (document, start + len(part) // ID_BYTES, ids[len(part) :], total)
            out += self._close(taken)
        return out


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    tokenizer: str = BYTE_BPE_50K,
    max_waste: int = MAX_WASTE,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of the documents (doc_id, text); ``with_ids`` adds the piece's ids as an array."""
    schema = pa.schema(
        [(name, pa.int64()) for name in (c.split()[0] for c in PIECE_SCHEMA.split(", "))]
        + ([("ids", pa.list_(pa.int32()))] if with_ids else [])
    )

    def rows(placed: list[tuple]) -> pa.RecordBatch:
        columns = [
            [p[0] for p in placed],
            [p[1] for p in placed],
            [len(p[2]) // ID_BYTES for p in placed],
            [zlib.crc32(p[2]) for p in placed],
            [p[3] for p in placed],
            [p[4] for p in placed],
            [p[5] for p in placed],
        ]
        arrays = [pa.array(c, pa.int64()) for c in columns]
        if with_ids:
            arrays.append(pa.array([np.frombuffer(p[2], "<u4").astype("int32") for p in placed], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).ids, END_ID.to_bytes(ID_BYTES, "little")
        packer = HarmonicPacker(capacity, max_waste, TaskContext.get().partitionId() * SEQUENCES_PER_PARTITION)
        for batch in batches:
            placed = []
            for document, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                placed += packer.add(document, encode(text) + end)
            yield rows(placed)
        yield rows(packer.finish())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        work, PIECE_SCHEMA + (", ids array<int>" if with_ids else "")
    )


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad_id: int = END_ID) -> DataFrame:
    """(sequence_id, tokens, n_tokens) from ``pack(..., with_ids=True)``: a group is one sequence, so its size is bounded.

    Sequences are padded to the capacity, except those whose length is a power of two.
    """
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"]))
    grouped = pieces.groupBy("sequence_id").agg(ids.alias("_ids"))
    n = F.size("_ids")
    missing = F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(capacity - n)
    return grouped.select(
        "sequence_id", F.concat("_ids", F.array_repeat(F.lit(pad_id), missing)).alias("tokens"), n.cast("long").alias("n_tokens")
    )
