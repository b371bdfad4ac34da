import brute
import pytest

import corpus_pipeline
from rosterloom.llm import chat_format, html_extract, packing  # noqa: F401  (imports without a session)


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """The documents before the first stage and after each, as written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_stages_keep_the_columns(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_each_stage_against_its_own_input(spark, sf_dir, stages):
    start, clean, single, unleaked, masked, pieces = map(lambda df: df, stages)
    assert 0.6 * start.count() < clean.count() < start.count()
    components = brute.jaccard_components(rows(clean), percent=80, n=5)
    assert sorted(d for d, _ in rows(single)) == sorted(d for d, (_, c) in components.items() if c == d)
    benchmark = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {r[0] for r in brute.contamination(rows(single), benchmark) if r[5]}
    assert sorted(rows(unleaked)) == sorted(r for r in rows(single) if r[0] not in hit)
    before = dict(rows(unleaked))
    for doc, text in rows(masked):
        assert not brute.base_secrets(text)
        if not brute.base_secrets(before[doc]):
            assert text == before[doc] or "[SECRET]" in text
    assert {r["doc_id"]: r["n_chars"] for r in masked.collect()} == {d: len(t) for d, t in rows(masked)}
    texts = dict(rows(masked))
    covered = {}
    for p in pieces.collect():
        assert brute.crc(brute.ids(texts[p["doc_id"]])[p["start"] : p["start"] + p["length"]]) == p["ids_crc32"]
        covered[p["doc_id"]] = covered.get(p["doc_id"], 0) + p["length"]
    assert covered == {d: len(brute.ids(t)) for d, t in texts.items()}


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    assert corpus_pipeline.run(spark, sf_dir).count() == stages[-1].count()


def test_edge_documents(spark, sf_dir):
    docs = spark.createDataFrame(
        [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "x " * 30000, "en", "a", 60000)],
        "doc_id long, text string, lang string, source string, n_chars int",
    )
    for rows_in in (docs, docs.limit(0)):
        out = rows_in
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, sf_dir)
            assert out.columns == docs.columns
        assert out.count() == (3 if rows_in is docs else 0)
