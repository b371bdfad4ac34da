"""Token ids as directly addressable codes, in blocks that are rows of Parquet files.

A block splits its ids into levels of 8 bits, lowest first.  Level 0 has a byte for every id; a
continuation bitmap per level marks the ids that go on, and the next level has bytes for those only.
The number of marks before a position (its rank) is its place on the next level; a directory holds
the rank at every 512th bit.  One id is read by as many bytes and ranks as it has levels, without
decoding its neighbours.

Block layout, little-endian: ``DAC1``, id count (u64), level count (u8), byte count of each level
(u64); then for each level its bytes, and for all but the last its bitmap and its rank directory (u32).

Files are ordered: rows are range-partitioned and sorted by (doc_id, text hash, text); a null
``doc_id`` comes first and repeated rows stay.  A null or empty text is one end id; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterloom.llm.encoding import BYTE_BPE_50K, END_ID, ID_BYTES, encoder

BLOCK_IDS = 1 << 18  # a block is closed at the first document end beyond this
RANK_BITS = 512
MAGIC = b"DAC1"
BLOCK_SCHEMA = "shard long, block long, n_ids long, doc_ids array<long>, doc_lengths array<long>, data binary"
DOC_SCHEMA = "shard long, block long, doc_id long, position long, local_start long, n_tokens long, ids_crc32 long"


def encode_block(ids: np.ndarray) -> bytes:
    """Directly addressable code of an array of unsigned 32-bit ids."""
    rest = np.asarray(ids, dtype=np.uint32)
    levels, sections = [], []
    while True:
        levels.append((rest & 0xFF).astype(np.uint8))
        more = rest > 0xFF
        if not more.any():
            break
        bits = np.zeros(-(-len(more) // RANK_BITS) * RANK_BITS, dtype=np.uint8)
        bits[: len(more)] = more
        ranks = np.concatenate([[0], np.cumsum(bits.reshape(-1, RANK_BITS).sum(axis=1))[:-1]]).astype("<u4")
        sections.append((np.packbits(bits, bitorder="little").tobytes(), ranks.tobytes()))
        rest = rest[more] >> 8
    head = MAGIC + struct.pack("<QB", len(ids), len(levels)) + struct.pack(f"<{len(levels)}Q", *map(len, levels))
    body = b"".join(
        level.tobytes() + (b"".join(sections[i]) if i < len(sections) else b"") for i, level in enumerate(levels)
    )
    return head + body


class Block:
    """Random access to the ids of one block."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a block of directly addressable codes")
        self.n, count = struct.unpack_from("<QB", data, 4)
        sizes = struct.unpack_from(f"<{count}Q", data, 13)
        at = 13 + 8 * count
        self.levels, self.bitmaps, self.ranks = [], [], []
        for i, size in enumerate(sizes):
            self.levels.append(np.frombuffer(data, np.uint8, size, at))
            at += size
            if i + 1 < count:
                blocks = -(-size // RANK_BITS)
                self.bitmaps.append(np.frombuffer(data, np.uint8, blocks * RANK_BITS // 8, at))
                at += blocks * RANK_BITS // 8
                self.ranks.append(np.frombuffer(data, "<u4", blocks, at))
                at += 4 * blocks

    def __len__(self) -> int:
        return self.n

    def _rank(self, level: int, position: int) -> int:
        """Marks before a position; the position may be the end of the level."""
        block = min(position // RANK_BITS, len(self.ranks[level]) - 1)
        first = block * RANK_BITS // 8
        bits = np.unpackbits(self.bitmaps[level][first : first + RANK_BITS // 8], bitorder="little")
        return int(self.ranks[level][block]) + int(bits[: position - block * RANK_BITS].sum())

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, position = 0, i
        for level, chunks in enumerate(self.levels):
            value |= int(chunks[position]) << (8 * level)
            if level == len(self.bitmaps) or not self.bitmaps[level][position >> 3] >> (position & 7) & 1:
                break
            position = self._rank(level, position)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids from start to stop; reads only their part of every level."""
        out = np.zeros(stop - start, dtype=np.uint32)
        where, low, high = np.arange(stop - start), start, stop
        for level, chunks in enumerate(self.levels):
            if low == high:
                break
            out[where] |= chunks[low:high].astype(np.uint32) << np.uint32(8 * level)
            if level == len(self.bitmaps):
                break
            first = low >> 3
            bits = np.unpackbits(self.bitmaps[level][first : (high + 7) >> 3], bitorder="little")
            where = where[bits[low - 8 * first : high - 8 * first].astype(bool)]
            low = self._rank(level, low)
            high = low + len(where)
        return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str = BYTE_BPE_50K, block_ids: int = BLOCK_IDS) -> None:
    """Encode (doc_id, text) and write the blocks to ``path`` in ascending doc_id order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).ids, END_ID.to_bytes(ID_BYTES, "little")
        shard, block = TaskContext.get().partitionId(), 0
        documents, parts, held = [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            lengths = [len(p) // ID_BYTES for p in parts]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int64()),
                    pa.array([block], pa.int64()),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([documents], pa.list_(pa.int64())),
                    pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([encode_block(ids)], pa.binary()),
                ],
                names=["shard", "block", "n_ids", "doc_ids", "doc_lengths", "data"],
            )

        for batch in batches:
            for document, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                documents.append(document)
                parts.append(encode(text) + end)
                held += len(parts[-1]) // ID_BYTES
                if held >= block_ids:
                    yield close()
                    documents, parts, held, block = [], [], 0, block + 1
        if documents:
            yield close()

    # The text hash splits a doc_id that many rows share over several ranges.
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .withColumn("_hash", F.xxhash64("text"))
        .repartitionByRange("doc_id", "_hash")
        .sortWithinPartitions("doc_id", "_hash", "text")
        .select("doc_id", "text")
    )
    ordered.mapInArrow(work, BLOCK_SCHEMA).write.parquet(path)


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, block, block_start): ids before each block, from the blocks' counts alone.

    Shards are summed first, so the only window without a partition key runs over one row per shard.
    """
    counts = spark.read.parquet(path).select("shard", "block", "n_ids")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    shards = counts.groupBy("shard").agg(F.sum("n_ids").alias("_shard_ids"))
    shard_start = F.coalesce(F.sum("_shard_ids").over(before.orderBy("shard")), F.lit(0))
    shards = shards.select("shard", shard_start.alias("_shard_start"))
    inside = F.coalesce(F.sum("n_ids").over(before.partitionBy("shard").orderBy("block")), F.lit(0))
    return (
        counts.withColumn("_inside", inside)
        .join(shards, "shard")
        .select("shard", "block", (F.col("_shard_start") + F.col("_inside")).alias("block_start"))
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in DOC_SCHEMA.split(", ")]
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                block, start = Block(row["data"]), 0
                for position, (document, length) in enumerate(zip(row["doc_ids"], row["doc_lengths"])):
                    ids = block.slice(start, start + length)
                    crc = zlib.crc32(ids.astype("<u4").tobytes())
                    out.append((row["shard"], row["block"], document, position, start, length, crc))
                    start += length
            columns = list(zip(*out)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    decoded = spark.read.parquet(path).select("shard", "block", "doc_ids", "doc_lengths", "data").mapInArrow(work, DOC_SCHEMA)
    return decoded.join(block_starts(spark, path), ["shard", "block"]).select(
        "doc_id", (F.col("block_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def ids_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """(position, token_id) for a table of global positions: each is looked up in its block, nothing else is decoded.

    Positions outside the files give no row; repeated positions repeat their row.
    """
    span = 1 << 16
    blocks = spark.read.parquet(path).select("shard", "block", "n_ids")
    blocks = blocks.join(block_starts(spark, path), ["shard", "block"])
    # A block covers few buckets of positions, so the range condition becomes an equality.
    cells = blocks.withColumn(
        "_cell", F.explode(F.sequence(F.floor(F.col("block_start") / span), F.floor((F.col("block_start") + F.col("n_ids") - 1) / span)))
    )
    asked = positions.select(F.col("position").cast("long").alias("position")).withColumn("_cell", F.floor(F.col("position") / span))
    placed = asked.join(cells, "_cell").filter(
        (F.col("position") >= F.col("block_start")) & (F.col("position") < F.col("block_start") + F.col("n_ids"))
    )
    wanted = placed.groupBy("shard", "block", "_cell").agg(F.collect_list(F.col("position") - F.col("block_start")).alias("_at"))
    data = spark.read.parquet(path).select("shard", "block", "data")

    @F.pandas_udf("array<long>")
    def look_up(data, at):
        import pandas as pd

        return pd.Series([[b[int(i)] for i in a] for b, a in zip(map(Block, data), at)], dtype=object)

    found = wanted.join(data, ["shard", "block"]).join(blocks.select("shard", "block", "block_start"), ["shard", "block"])
    return found.select(
        "block_start", F.explode(F.arrays_zip(F.col("_at").alias("at"), look_up("data", "_at").alias("id"))).alias("_r")
    ).select((F.col("block_start") + F.col("_r.at")).alias("position"), F.col("_r.id").alias("token_id"))
