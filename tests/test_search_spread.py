"""Searches of a corpus whose rows pack well: no task meets all of them."""

from pyspark.sql import functions as F

from rosterloom.operators import search as se

KEYS = ["term_code", "course_id"]
ROW = [*KEYS, "alias_course_designation"]


def test_hits_of_one_token_are_spread_by_row(spark, monkeypatch):
    monkeypatch.setattr(se, "ROWS_PER_TASK", 64, raising=False)
    courses = spark.range(400).coalesce(1).selectExpr(
        "'1' as term_code", "cast(id as string) as course_id", "concat('ART ', id) as course_designation", "'Clay' as title", "'pots' as description"
    )
    corpus = se.build_corpus(courses.select(*KEYS, "course_designation"), courses, KEYS).coalesce(1)
    posts = se.corpus_index(corpus, KEYS)
    tokens = se.query_tokens(spark.createDataFrame([("q", "clay")], "query_id string, text string"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        written = {r[0] for r in posts.select(F.input_file_name()).distinct().collect()}
        hits = se.token_hits(posts, se.expand_tokens(tokens, posts), ROW)
        held = hits.groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(written) > 2
    assert sum(r["count"] for r in held) == 400 and max(r["count"] for r in held) < 300
    assert se.topic_search(spark.createDataFrame([("q", "clay")], "query_id string, text string"), corpus, KEYS).count() == 400
