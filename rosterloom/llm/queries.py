"""Registered queries of the operators for training text, over the whole tables of a folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.llm import (
    chat_format,
    decontaminate,
    html_extract,
    jaccard_join,
    lattice_lm,
    lexical_search,
    oracles,
    packing,
    quality_rules,
    secret_scan,
    spelling,
    token_codes,
    token_rollup,
    toxicity,
)
from rosterloom.session import checkpoint_folder, cut_lineage

# Rows per Arrow batch: texts differ in length by a factor of a thousand, so batches are kept short.
ARROW_ROWS = "256"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels))
    return scored.select(
        "doc_id",
        F.col("toxicity.expected").alias("expected_severity"),
        F.col("toxicity.p_toxic").alias("p_toxic"),
        F.col("toxicity.grade").alias("severity"),
        (F.col("toxicity.expected") >= toxicity.REJECT_AT).alias("toxic"),
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), into="found")
    base = F.filter("found", lambda s: s["kind"] != "entropy")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(line(base), 256).alias("base_sha256"),
        line(F.col("found")).alias("spans"),
        count("entropy").alias("n_entropy"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1 whose texts are made of control strings."""
    control = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").cast("long").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat_format.read_back(chat_format.format_examples(turns.unionByName(control)))


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    token_codes.write_tokens(table(spark, sf_dir, "documents"), path)
    return token_codes.read_documents(spark, path)


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after a load, a revision, the removal of exact copies, and the revision once more.

    Two tokenizer versions are kept: ``byte_bpe_50k@1`` loads texts as they are and revises them to white
    space folded; ``byte_bpe_50k@2`` starts with the revised counts.
    """
    docs = table(spark, sf_dir, "documents")
    text = F.col("text").cast("string")
    folded = F.trim(F.regexp_replace(text, r"[ \t-\r]+", " "))
    counts = cut_lineage(token_rollup.count_tokens(docs, {"raw": text, "folded": folded}))
    # One row per text at most takes part in the join, whatever the number of its copies.
    firsts = counts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    copies = counts.join(firsts, "digest").filter("doc_id > first")
    raw, new = F.col("raw"), F.col("folded")
    v1, v2 = "byte_bpe_50k@1", "byte_bpe_50k@2"
    revision = token_rollup.changes(counts, "revise", v1, new, raw).unionByName(token_rollup.changes(counts, "insert", v2, new))
    removal = token_rollup.changes(copies, "delete", v1, new).unionByName(token_rollup.changes(copies, "delete", v2, new))
    rollup = token_rollup.Rollup(spark, shared_path(spark, "rollup"))
    rollup.commit("1-load", token_rollup.changes(counts, "insert", v1, raw))
    rollup.commit("2-revise", revision)
    rollup.commit("3-remove-copies", removal)
    rollup.commit("2-revise", revision)
    return rollup.totals()


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


_ALL = (
    op1_toxicity,
    op2_secret_scan,
    op3_decontaminate,
    op4_ngram_jaccard_join,
    op5_chat_format,
    op6_harmonic_packing,
    op7_html_extract,
    op8_quality_rules,
    op9_token_codes,
    op10_token_rollup,
    op11_ranked_search,
    op12_lattice_lm,
    op13_spelling_variants,
)
QUERIES = {query.__name__: query for query in _ALL}
ORACLES = {
    "op3_decontaminate": oracles.DECONTAMINATE,
    "op4_ngram_jaccard_join": oracles.JACCARD_JOIN,
    "op5_chat_format": oracles.CHAT_FORMAT,
    "op11_ranked_search": oracles.RANKED_SEARCH,
}
