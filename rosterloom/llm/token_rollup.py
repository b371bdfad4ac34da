"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

A batch of changes holds inserts, deletes and revised counts; each change adds a signed number of
documents and tokens to its totals.  A batch is summed per key and committed as one folder of the
rollup; totals are the sums over the committed folders, so nothing that is stored is ever rewritten.
A batch id that is committed already is skipped, which makes a repeated commit harmless; a commit
that was broken off leaves no marker and is written again.  The marker is a file of the rollup's own, written last.
``compact`` folds committed batches into one of another rollup, which keeps their ids, so a batch that was folded stays
committed.

Defined cases: null sources, languages and tokenizers are keys like others; a null count is 0; a
null or unknown operation fails the commit; repeated rows in a batch count as often as they occur;
an empty batch is committed as empty; totals that come to nothing stay with 0; other columns are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.llm.encoding import BYTE_BPE_50K, ID_BYTES, encoder

KEYS = ["source", "lang", "tokenizer"]
MARKER = "_COMMITTED"
TOTALS_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, variants: dict[str, Column], tokenizer: str = BYTE_BPE_50K) -> DataFrame:
    """(doc_id, source, lang, digest, one count per variant): ids of each variant of a document's text, a null text has 0.

    ``variants`` maps names to string columns over docs; ``digest`` is the SHA-256 of ``text``.
    """
    names = list(variants)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).ids
        for batch in batches:
            counts = [
                pa.array([len(encode(text)) // ID_BYTES for text in batch.column(4 + i).to_pylist()], pa.int64()) for i in range(len(names))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(4)] + counts, names=["doc_id", "source", "lang", "digest", *names])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.sha2(F.col("text").cast("string"), 256).alias("digest"),
        *[c.cast("string").alias(n) for n, c in variants.items()],
    )
    schema = ", ".join(["doc_id long, source string, lang string, digest string", *[f"{n} long" for n in names]])
    return rows.mapInArrow(work, schema)


def changes(rows: DataFrame, operation: str, tokenizer: str, tokens: Column, old_tokens: Column | None = None) -> DataFrame:
    """Rows (source, lang) as changes of one kind: insert, delete, or revise with the count before."""
    old = F.lit(None) if old_tokens is None else old_tokens
    return rows.select(
        F.lit(operation).alias("operation"),
        "source",
        "lang",
        F.lit(tokenizer).alias("tokenizer"),
        tokens.cast("long").alias("tokens"),
        old.cast("long").alias("old_tokens"),
    )


def signed(batch: DataFrame) -> DataFrame:
    """Totals that a batch adds: +1 document and +tokens, -1 and -tokens, or 0 and the difference."""
    tokens, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    unknown = F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce("operation", F.lit("null"))))
    docs = F.when(F.col("operation") == "insert", 1).when(F.col("operation") == "delete", -1).when(F.col("operation") == "revise", 0)
    delta = F.when(F.col("operation") == "insert", tokens).when(F.col("operation") == "delete", -tokens).when(F.col("operation") == "revise", tokens - old)
    return batch.select(
        *[F.col(k).cast("string").alias(k) for k in KEYS],
        F.coalesce(docs.cast("long"), unknown.cast("long")).alias("n_docs"),
        F.coalesce(delta.cast("long"), unknown.cast("long")).alias("n_tokens"),
    )


class Rollup:
    """Totals in a shared folder: one subfolder per committed batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, batch_id: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.-]*", batch_id):
            raise ValueError(f"batch id {batch_id!r}: letters, digits, dots and dashes only")
        return f"{self.folder}/batch={batch_id}"

    def _hadoop_path(self, path: str):
        jvm = self.spark._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        return hadoop, hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        hadoop, files = self._hadoop_path(path)
        return files.exists(hadoop)

    def is_committed(self, batch_id: str) -> bool:
        """Whether a batch counts in the totals, by its own folder or folded into another batch."""
        if self._exists(f"{self._path(batch_id)}/{MARKER}"):
            return True
        folded = self._folded()
        return folded is not None and not folded.filter(F.col("batch_id") == batch_id).isEmpty()

    def _folded(self) -> DataFrame | None:
        """Ids of the batches that were folded into committed ones."""
        paths = [path for name in self.committed() if self._exists(path := f"{self.folder}/folded={name}")]
        return self.spark.read.schema("batch_id string").parquet(*paths) if paths else None

    def committed(self) -> list[str]:
        """Batches with a folder of their own here."""
        folder, files = self._hadoop_path(self.folder)
        if not files.exists(folder):
            return []
        names = [status.getPath().getName() for status in files.listStatus(folder)]
        return sorted(n[6:] for n in names if n.startswith("batch=") and self._exists(f"{self.folder}/{n}/{MARKER}"))

    def _seal(self, batch_id: str) -> None:
        marker, files = self._hadoop_path(f"{self._path(batch_id)}/{MARKER}")
        files.create(marker, True).close()

    def commit(self, batch_id: str, batch: DataFrame) -> bool:
        """Add a batch once; False if it is committed already.  One writer at a time per rollup is assumed."""
        if self.is_committed(batch_id):
            return False
        sums = signed(batch).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.write.mode("overwrite").parquet(self._path(batch_id))
        self._seal(batch_id)
        return True

    def totals(self, batches: list[str] | None = None) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over the committed batches."""
        names = self.committed() if batches is None else batches
        if not names:
            return self.spark.createDataFrame([], TOTALS_SCHEMA)
        stored = self.spark.read.schema(TOTALS_SCHEMA).parquet(*[self._path(n) for n in names])
        return stored.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def compact(self, into: "Rollup", batch_id: str = "base") -> None:
        """Write the totals as one batch of another, empty rollup, with the ids of all batches that they hold."""
        ids = self.spark.createDataFrame([(name,) for name in self.committed()], "batch_id string")
        folded = self._folded()
        if folded is not None:
            ids = ids.unionByName(folded)
        self.totals().write.mode("overwrite").parquet(into._path(batch_id))
        ids.distinct().write.mode("overwrite").parquet(f"{into.folder}/folded={batch_id}")
        into._seal(batch_id)
