"""Ranked text search for a table of queries over a posting list.

A row counts its own tokens, so the index is made without a shuffle; it is written once and can be passed to any number of
searches.  A query token is first resolved against the vocabulary (the distinct tokens, far smaller than
the text) by equality: of prefixes that are as long as some query token, or of the rarest gram of a token that is looked
for inside words.  Only then it is joined to the postings, by equality again, so no query token is ever compared with a
document or with a bucket of words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterloom.functions.text import compact_designation, let, search_text, search_tokens
from rosterloom.operators.versions import top_per_key
from rosterloom.session import cut_lineage

DEFAULT_LIMIT = 24
MAX_LIMIT = 50
BM25_K1 = 1.2
BM25_B = 0.75


GRAM = 3  # letters of the grams that find words containing a query token


def clamp_limit(limit: int | None, default: int = DEFAULT_LIMIT, low: int = 1, high: int = MAX_LIMIT) -> int:
    """A result limit within bounds; none and 0 mean the default."""
    return default if not limit else max(low, min(high, int(limit)))


def clamped(limit: Column, default: int = DEFAULT_LIMIT, low: int = 1, high: int = MAX_LIMIT) -> Column:
    """``clamp_limit`` of a column."""
    return F.when(F.coalesce(limit, F.lit(0)) == 0, default).otherwise(F.greatest(F.least(limit, F.lit(high)), F.lit(low)))


def build_corpus(aliases: DataFrame, courses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Alias rows with their course text and the normalised forms used for ranking.

    ``aliases(keys, course_designation)``, ``courses(keys, course_designation, title, description)``.
    """
    named = aliases.select(*keys, F.col("course_designation").alias("alias"))
    joined = named.join(courses.select(*keys, "course_designation", "title", "description"), list(keys))
    alias = F.coalesce("alias", "course_designation", F.lit(""))
    title = F.coalesce("title", F.lit(""))
    return joined.select(
        *keys,
        F.coalesce("course_designation", F.lit("")).alias("canonical_course_designation"),
        alias.alias("alias_course_designation"),
        search_text(alias).alias("alias_normalized"),
        compact_designation(alias).alias("alias_compact"),
        title.alias("title"),
        search_text(title).alias("title_normalized"),
        F.coalesce("description", F.lit("")).alias("description"),
    )


def counted_tokens(tokens: Column) -> Column:
    """array<struct<token, tf>> of an array of tokens: sorted, equal ones stand together."""

    def runs(sorted_: Column) -> Column:
        n = F.size(sorted_)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(sorted_, i) != F.get(sorted_, i - 1)))
        return let(
            starts,
            lambda at: F.transform(
                at, lambda i, k: F.struct(F.get(sorted_, i).alias("token"), (F.coalesce(F.get(at, k + 1), n) - i).cast("long").alias("tf"))
            ),
        )

    none = F.array().cast("array<struct<token:string,tf:bigint>>")
    return F.when(F.size(tokens) > 0, let(F.array_sort(tokens), runs)).otherwise(none)


def postings(docs: DataFrame, row: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """(row, token, tf, len, lead) over all searchable text of a row; ``lead`` marks one posting per row.

    Rows are told apart by ``row``; ``len`` is the number of a row's tokens.
    """
    everything = F.flatten(F.array(*[search_tokens(F.col(t)) for t in texts]))
    counted = docs.select(*row, let(everything, lambda ts: F.struct(F.size(ts).cast("long").alias("len"), counted_tokens(ts).alias("terms"))).alias("_t"))
    # An inner explode would add a filter on its size, which counts the tokens again.
    listed = counted.select(*row, F.col("_t.len").alias("len"), F.posexplode_outer("_t.terms").alias("_at", "_p")).filter("_at IS NOT NULL")
    return listed.select(*row, "_p.token", "_p.tf", "len", (F.col("_at") == 0).alias("lead"))


def build_index(docs: DataFrame, row: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """Postings written once, so that matching, lengths and frequencies do not read the text again."""
    return cut_lineage(postings(docs, row, texts))


ROWS_PER_TASK = 1 << 17


def dealt_out(table: DataFrame, keys: Sequence[str], rows: int | None = None) -> DataFrame:
    """The rows of a corpus, or hits in it, spread by key over as many tasks as their number asks for.

    They are short and repeat each other, so that few bytes hold many of them: by size alone a few tasks would meet all.
    """
    tasks = -(-(table.count() if rows is None else rows) // ROWS_PER_TASK)
    return table.repartition(tasks, *keys) if tasks > 1 else table


CORPUS_TEXTS = ("alias_course_designation", "alias_compact", "title", "description")


def corpus_index(corpus: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The index of a course corpus, one row per alias; to be passed to ``search`` and ``topic_search``."""
    return build_index(dealt_out(corpus, keys), [*keys, "alias_course_designation"], CORPUS_TEXTS)


def query_tokens(queries: DataFrame, query: str = "query_id", text: str = "text") -> DataFrame:
    """(query, qtoken, wanted): distinct tokens with their number; queries without tokens vanish."""
    tokens = F.array_distinct(search_tokens(F.col(text)))
    return queries.select(query, F.explode(tokens).alias("qtoken"), F.size(tokens).alias("wanted"))


def expand_tokens(tokens: DataFrame, words: DataFrame, substring: bool = False) -> DataFrame:
    """(qtoken, token): vocabulary words starting with, or containing, a query token."""
    wanted = tokens.select("qtoken").distinct()
    vocabulary = words.select("token").distinct()
    size = F.least(F.char_length("qtoken"), F.lit(GRAM)) if substring else F.char_length("qtoken")
    lengths = _lengths(wanted, size)
    if not substring:
        fitting = F.filter(lengths, lambda n: n <= F.char_length("token"))
        keyed = vocabulary.select("token", F.explode_outer(F.transform(fitting, lambda n: F.substring("token", F.lit(1), n))).alias("qtoken"))
        return keyed.join(wanted, "qtoken").select("qtoken", "token")
    asked = _grams(wanted, "qtoken", F.array(size))
    grams = _grams(vocabulary, "token", lengths).join(asked.select("gram").distinct(), "gram", "left_semi")
    # The rarest gram of a query token; a word that lacks it does not contain the token.
    held = grams.groupBy("gram").agg(F.count("*").alias("_n"))
    rarest = asked.join(held, "gram", "left").groupBy("qtoken").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "gram")).alias("_r"))
    # Both sides are spread by gram: the few query tokens would else meet copies of all grams in a task or two.
    found = rarest.select("qtoken", F.col("_r.gram").alias("gram")).join(grams.hint("merge"), "gram")
    return found.filter(F.contains("token", "qtoken")).select("qtoken", "token")


def _lengths(words: DataFrame, size: Column) -> Column:
    """The lengths that occur, a few numbers however many words there are."""
    return F.array(*[F.lit(r[0]) for r in words.select(size.alias("n")).distinct().orderBy("n").collect()]).cast("array<int>")


def _grams(words: DataFrame, word: str, lengths: Column) -> DataFrame:
    """(word, gram): the distinct pieces of these lengths."""

    def of_length(n: Column) -> Column:
        starts = F.when(F.char_length(word) >= n, F.sequence(F.lit(1), F.char_length(word) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(word, i, n))

    return words.select(word, F.explode_outer(F.array_distinct(F.flatten(F.transform(lengths, of_length)))).alias("gram")).filter("gram IS NOT NULL")


def token_hits(posts: DataFrame, expansions: DataFrame, row: Sequence[str]) -> DataFrame:
    """(row, qtoken, tf, len): rows holding any word a query token stands for.

    The expansions are written, so that Spark knows them to be the small side: it would else send the postings, which pack
    well, to the one task that holds the few query tokens. A frequent word is a skewed key of the postings only: AQE splits
    it when the other side is too large to broadcast. Hits are spread by row, which serves the sums per query and row alike.
    """
    found = posts.join(cut_lineage(expansions), "token").select(*row, "qtoken", "tf", "len").repartition(*row)
    return found.groupBy(*row, "qtoken").agg(F.sum("tf").alias("tf"), F.max("len").alias("len"))


def all_token_matches(tokens: DataFrame, hits: DataFrame, row: Sequence[str], query: str = "query_id") -> DataFrame:
    """(query, row, score inputs) for rows matching every token of a query."""
    joined = hits.join(tokens, "qtoken")
    carried = [c for c in hits.columns if c not in (*row, "qtoken", "tf", "len")]
    return (
        joined.groupBy(query, *row)
        .agg(F.count("*").alias("_got"), F.first("wanted").alias("_wanted"), *[F.sum(c).alias(c) for c in carried])
        .filter("_got = _wanted")
        .drop("_got", "_wanted")
    )


LEADING = 3  # tokens of a query that are looked up in the vocabulary, the longest ones


def substring_matches(tokens: DataFrame, posts: DataFrame, row: Sequence[str], query: str = "query_id") -> DataFrame:
    """(query, row): rows that hold every token of a query somewhere inside their words.

    The rarest of a query's longest tokens finds the rows; only they are read for the others.
    """
    longest = [F.char_length("qtoken").desc(), F.col("qtoken")]
    leading = top_per_key(tokens.select(query, "qtoken"), [query], longest, LEADING)
    expansions = cut_lineage(expand_tokens(leading, posts, substring=True))
    held = posts.groupBy("token").agg(F.count("*").alias("_n")).join(expansions, "token").groupBy("qtoken").agg(F.sum("_n").alias("_n"))
    # A token that no word contains counts none, and its query finds nothing.
    counted = leading.join(held, "qtoken", "left").fillna(0, ["_n"])
    rarest = top_per_key(counted, [query], [F.col("_n"), F.col("qtoken")]).select(query, "qtoken", F.lit(1).alias("wanted"))
    chosen = expansions.join(rarest.select("qtoken").distinct(), "qtoken", "left_semi")
    found = cut_lineage(all_token_matches(rarest, token_hits(posts, chosen, row).select(*row, "qtoken"), row, query))
    words = posts.join(found.select(*row).distinct(), list(row), "left_semi").groupBy(*row).agg(F.array_join(F.collect_list("token"), " ").alias("_words"))
    asked = tokens.groupBy(query).agg(F.collect_list("qtoken").alias("_asked"))
    read = found.join(words, list(row)).join(asked, query)
    return read.filter(F.forall("_asked", lambda t: F.contains("_words", t))).select(query, *row)


def any_token_matches(tokens: DataFrame, hits: DataFrame, row: Sequence[str], query: str = "query_id") -> DataFrame:
    """(query, row, score) for rows matching some token of a query."""
    return hits.join(tokens.select(query, "qtoken"), "qtoken").groupBy(query, *row).agg(F.sum("score").alias("score"))


def bm25_hits(posts: DataFrame, hits: DataFrame, row: Sequence[str]) -> DataFrame:
    """Token hits with a BM25 term score; the postings know their row's length."""
    corpus = posts.filter("lead").agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    # One-row subqueries, inlined as constants.
    n, avg_len = corpus.select("n").scalar(), corpus.select("avg_len").scalar()
    df = hits.groupBy("qtoken").agg(F.count("*").alias("df"))
    scored = hits.join(df, "qtoken")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("len") / avg_len)
    return scored.select(*row, "qtoken", (idf * F.col("tf") * (BM25_K1 + 1) / norm).alias("score"))


def ranked_topics(queries: DataFrame, posts: DataFrame, row: Sequence[str], best: int) -> DataFrame:
    """(query_id, row, score, rank): the best rows per topic by the sum of the scores of its tokens, some of which may be missing.

    A topic's tokens are added in three steps, strongest first. A row is dropped once the tokens that are left cannot lift it to
    a score that ``best`` rows of the topic reach, so frequent tokens are only looked up for rows that may still be among the best.
    """
    tokens = query_tokens(queries)
    hits = cut_lineage(token_hits(posts, expand_tokens(tokens, posts), row))
    scores = cut_lineage(bm25_hits(posts, hits, row))
    stats = scores.groupBy("qtoken").agg(F.count("*").alias("df"), F.max("score").alias("top"))
    # A token that no row holds adds nothing.
    weighed = cut_lineage(tokens.select("query_id", "qtoken").join(stats, "qtoken"))
    rarest = Window.partitionBy("query_id").orderBy("df", "qtoken").rowsBetween(Window.unboundedPreceding, 0)
    seeds = weighed.withColumn("_sum", F.sum("df").over(rarest)).filter((F.col("_sum") <= SEED_HITS) | (F.col("_sum") - F.col("df") < 4 * best))
    floors = _floors(any_token_matches(seeds, scores, row), weighed, scores, row, best)
    steps = cut_lineage(_steps(weighed, floors))
    led = any_token_matches(steps.filter("step = 0"), scores, row)
    led = cut_lineage(_within_reach(led, steps, 0, floors=steps.select("query_id", "floor").distinct()))
    # Rows that hold many strong tokens show a higher floor than the rarest tokens alone.
    raised = cut_lineage(_floors(led, weighed, scores, row, best))
    led = _within_reach(led, steps, 0, raised)
    half = _summed(led.unionByName(_token_scores(led, steps.filter("step = 1"), scores, row)), row)
    half = cut_lineage(_within_reach(half, steps, 1, raised))
    whole = _summed(half.unionByName(_token_scores(half, steps.filter("step = 2"), scores, row)), row).withColumn("score", F.round("score", 6))
    return top_per_key(whole, ["query_id"], [F.col("score").desc(), *[F.col(c) for c in row]], best, rank="rank")


SEED_HITS = 2000  # hits of a query's rarest tokens that are tried first
SLACK = 1e-5  # more than rounding to six places and the order of a sum can make


def _summed(scores: DataFrame, row: Sequence[str]) -> DataFrame:
    return scores.groupBy("query_id", *row).agg(F.sum("score").alias("score"))


def _token_scores(pairs: DataFrame, tokens: DataFrame, scores: DataFrame, row: Sequence[str]) -> DataFrame:
    """(query_id, row, score): what each of these tokens of a query gives to the rows paired with it."""
    wanted = pairs.select("query_id", *row).join(tokens.select("query_id", "qtoken"), "query_id")
    return wanted.join(scores, [*row, "qtoken"]).select("query_id", *row, "score")


def _floors(found: DataFrame, weighed: DataFrame, scores: DataFrame, row: Sequence[str], best: int) -> DataFrame:
    """(query_id, floor): a score that ``best`` rows reach, from the whole scores of those found best so far; none where they are fewer."""
    order = [F.col("score").desc(), *[F.col(c) for c in row]]
    whole = _summed(_token_scores(top_per_key(found, ["query_id"], order, 4 * best), weighed, scores, row), row)
    last = top_per_key(whole, ["query_id"], order, best, rank="_at").filter(F.col("_at") == best)
    return last.select("query_id", (F.col("score") - SLACK).alias("floor"))


def _steps(weighed: DataFrame, floors: DataFrame) -> DataFrame:
    """Tokens with the step they are added in: 0 unless they and all weaker ones stay below the floor, 2 if below half of it."""
    weakest = Window.partitionBy("query_id").orderBy("top", "qtoken").rowsBetween(Window.unboundedPreceding, 0)
    reach = weighed.join(floors, "query_id", "left").withColumn("_reach", F.sum("top").over(weakest))
    step = F.when(F.col("_reach") < F.col("floor") / 2, 2).when(F.col("_reach") < F.col("floor"), 1).otherwise(0)
    return reach.withColumn("step", step).drop("_reach")


def _within_reach(found: DataFrame, steps: DataFrame, step: int, floors: DataFrame) -> DataFrame:
    """Rows that the tokens of later steps could still lift to the floor of their query."""
    left = steps.groupBy("query_id").agg(F.coalesce(F.sum(F.when(F.col("step") > step, F.col("top"))), F.lit(0.0)).alias("_left"))
    bars = left.join(floors.select("query_id", "floor"), "query_id", "left")
    return found.join(bars, "query_id").filter("floor IS NULL OR score + _left >= floor").drop("_left", "floor")


def _match_signals(matches: DataFrame, queries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best score and exact / prefix flags per (query, course)."""
    q = queries.select("query_id", search_text(F.col("text")).alias("q"), compact_designation(F.col("text")).alias("qc"))
    tests = {
        "exact_alias_match": F.col("alias_normalized") == F.col("q"),
        "exact_compact_alias_match": F.col("alias_compact") == F.col("qc"),
        "prefix_alias_match": F.col("alias_normalized").startswith(F.col("q")),
        "prefix_compact_alias_match": F.col("alias_compact").startswith(F.col("qc")),
        "exact_title_match": F.col("title_normalized") == F.col("q"),
        "prefix_title_match": F.col("title_normalized").startswith(F.col("q")),
    }
    return (
        matches.join(q, "query_id")
        .groupBy("query_id", *keys)
        .agg(F.max("score").alias("best_score"), *[F.max(t.cast("int")).alias(name) for name, t in tests.items()])
    )


_SIGNALS = [
    "exact_alias_match",
    "exact_compact_alias_match",
    "prefix_alias_match",
    "prefix_compact_alias_match",
    "exact_title_match",
    "prefix_title_match",
]


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _representatives(matched: DataFrame, lead: Sequence[Column]) -> DataFrame:
    """One course per (query, designation): signals, then section count before open seats."""
    order = [
        *lead,
        _zero("section_count").desc(),
        _zero("has_any_open_seats").desc(),
        _zero("has_any_full_section").desc(),
        F.col("title").asc_nulls_first(),
        F.col("course_id").asc(),
        F.col("term_code").asc(),
    ]
    return top_per_key(matched, ["query_id", "course_designation"], order)


def _asked(queries: DataFrame) -> DataFrame:
    """Queries with the normal form of their text and subject, and ``_question``, which is equal where both are."""
    text = search_text(F.col("text")) if "text" in queries.columns else F.lit("")
    subject = F.upper(F.trim(F.coalesce("subject", F.lit("")))) if "subject" in queries.columns else F.lit("")
    # A normal text has no line break.
    return queries.withColumn("_text", text).withColumn("_subject", subject).withColumn("_question", F.concat_ws("\n", "_text", "_subject"))


def _final(rows: DataFrame, lead: Sequence[Column], limit: int | None, asked: DataFrame) -> DataFrame:
    """Final order: signals, then open seats before section count; a query's own ``result_limit`` goes before ``limit``.

    ``rows`` has a question as its ``query_id``; its best rows go to every query that asks it.
    """
    order = [
        *lead,
        _zero("has_any_open_seats").desc(),
        _zero("section_count").desc(),
        F.col("course_designation").asc(),
    ]
    own = "result_limit" in asked.columns
    best = top_per_key(rows, ["query_id"], order, MAX_LIMIT if own else clamp_limit(limit), rank="rank").withColumnRenamed("query_id", "_question")
    if not own:
        return asked.select("query_id", "_question").join(best, "_question").drop("_question")
    limits = asked.select("query_id", "_question", clamped(F.coalesce("result_limit", F.lit(limit).cast("int"))).alias("_limit"))
    return limits.join(best, "_question").filter("rank <= _limit").drop("_question", "_limit")


def _by_subject(courses: DataFrame, subjects: DataFrame) -> DataFrame:
    """Courses with every ``_subject`` their designation starts with, joined on its beginnings that are as long as some subject."""
    lengths = _lengths(subjects, F.char_length("_subject"))
    upper = F.upper("course_designation")
    fitting = F.filter(lengths, lambda n: n <= F.char_length(upper))
    return courses.withColumn("_subject", F.explode_outer(F.transform(fitting, lambda n: F.substring(upper, F.lit(1), n))))


def _questions(found: DataFrame, asked: DataFrame) -> DataFrame:
    """Courses found for a text, ``query_id``, as those of each question that has it."""
    questions = asked.select(F.col("_text").alias("query_id"), "_subject", "_question").distinct()
    keyed = _by_subject(found, questions) if "subject" in asked.columns else found.withColumn("_subject", F.lit(""))
    return keyed.join(questions, ["query_id", "_subject"]).drop("query_id", "_subject").withColumnRenamed("_question", "query_id")


def search(
    queries: DataFrame,
    corpus: DataFrame,
    overview: DataFrame,
    keys: Sequence[str] = ("term_code", "course_id"),
    limit: int | None = None,
    index: DataFrame | None = None,
) -> DataFrame:
    """Indexed search: every token must prefix-match, results ranked by match tier, then BM25.

    ``queries(query_id, text)``, and ``subject`` and ``result_limit`` where they differ by query.  A text is matched once and a
    text within a subject ranked once, however many queries ask it.
    """
    row = [*keys, "alias_course_designation"]
    posts = corpus_index(corpus, keys) if index is None else index
    asked = _asked(queries)
    wanted = asked.select(F.col("_text").alias("query_id"), F.col("_text").alias("text")).distinct()
    tokens = cut_lineage(query_tokens(wanted))
    hits = cut_lineage(token_hits(posts, expand_tokens(tokens, posts), row))
    # Spread before the queries meet them, which makes many rows of one.
    matches = all_token_matches(tokens, dealt_out(bm25_hits(posts, hits, row), row, hits.count()), row)
    texts = corpus.select(*row, "alias_normalized", "alias_compact", "title_normalized")
    signals = _match_signals(matches.join(texts, row), wanted, list(keys))
    lead = [*[F.col(s).desc() for s in _SIGNALS], F.round("best_score", 6).desc()]
    found = _questions(signals.join(overview, list(keys)), asked)
    return _final(_representatives(found, lead), lead, limit, asked)


def search_without_index(
    queries: DataFrame, corpus: DataFrame, overview: DataFrame, keys: Sequence[str] = ("term_code", "course_id"), limit: int | None = None
) -> DataFrame:
    """Substring search: every token occurs in an alias (with or without blanks), the title or the description."""
    lowered = corpus.withColumn("alias_lower", F.lower("alias_course_designation")).withColumn(
        "alias_tight", F.replace(F.lower("alias_course_designation"), F.lit(" "), F.lit(""))
    )
    posts = build_index(dealt_out(lowered, keys), list(keys), ["alias_lower", "alias_tight", "title", "description"])
    asked = _asked(queries)
    wanted = asked.select(F.col("_text").alias("query_id"), F.col("_text").alias("text")).distinct()
    tokens = cut_lineage(query_tokens(wanted))
    matches = substring_matches(tokens, posts, list(keys))
    q = wanted.select("query_id", search_text(F.col("text")).alias("q"), compact_designation(F.col("text")).alias("qc"))
    title = F.lower("title")
    tests = {
        "exact_alias_match": F.col("alias_lower") == F.col("q"),
        "prefix_alias_match": F.col("alias_lower").startswith(F.col("q")),
        "compact_alias_match": F.col("alias_tight").startswith(F.replace("qc", F.lit(" "), F.lit(""))),
        "exact_title_match": title == F.col("q"),
        "prefix_title_match": title.startswith(F.col("q")),
    }
    signals = (
        matches.join(lowered.select(*keys, "alias_lower", "alias_tight", "title"), list(keys))
        .join(q, "query_id")
        .groupBy("query_id", *keys)
        .agg(*[F.max(t.cast("int")).alias(name) for name, t in tests.items()])
    )
    lead = [
        F.col(s).desc()
        for s in ("exact_alias_match", "compact_alias_match", "prefix_alias_match", "exact_title_match", "prefix_title_match")
    ]
    found = _questions(signals.join(overview, list(keys)), asked)
    return _final(_representatives(found, lead), lead, limit, asked)


def browse(subjects: DataFrame, overview: DataFrame, limit: int | None = None) -> DataFrame:
    """Courses whose designation starts with a subject, per ``subjects(query_id, subject)``.

    A subject is ranked once, however many queries ask it.
    """
    asked = _asked(subjects.drop("text")).filter("_subject <> ''")
    wanted = asked.select("_subject", F.col("_question").alias("query_id")).distinct()
    found = _by_subject(overview, wanted).join(wanted, "_subject")
    return _final(_representatives(found.drop("_subject"), []), [], limit, asked)


def answer(
    queries: DataFrame, corpus: DataFrame, overview: DataFrame, keys: Sequence[str] = ("term_code", "course_id"), index: DataFrame | None = None
) -> DataFrame:
    """Every row of ``queries(query_id, text, subject, result_limit)`` by its kind, with ``answered_by``.

    A text with tokens is searched, within the subject if there is one; without tokens the subject is browsed; a row with
    neither has no results.
    """
    has_tokens = F.size(search_tokens(F.coalesce("text", F.lit("")))) > 0
    has_subject = F.trim(F.coalesce("subject", F.lit(""))) != ""
    shown = lambda df, kind: df.select("query_id", "rank", *keys, "course_designation", F.lit(kind).alias("answered_by"))
    found = search(queries.filter(has_tokens), corpus, overview, keys, index=index)
    listed = browse(queries.filter(~has_tokens & has_subject).drop("text"), overview)
    return shown(found, "search").unionByName(shown(listed, "subject"))


def topic_search(queries: DataFrame, corpus: DataFrame, keys: Sequence[str], index: DataFrame | None = None) -> DataFrame:
    """Best score per (query, course), one row per course however many aliases match."""
    row = [*keys, "alias_course_designation"]
    posts = corpus_index(corpus, keys) if index is None else index
    tokens = cut_lineage(query_tokens(queries))
    hits = cut_lineage(token_hits(posts, expand_tokens(tokens, posts), row))
    matches = all_token_matches(tokens, dealt_out(bm25_hits(posts, hits, row), keys, hits.count()), row)
    return matches.groupBy("query_id", *keys).agg(F.max("score").alias("score"))


def resolve_designations(wanted: DataFrame, overview: DataFrame, aliases: DataFrame) -> DataFrame:
    """One course per requested designation: the best canonical course, else the best alias."""
    canonical = top_per_key(
        wanted.join(overview, "course_designation"),
        ["course_designation"],
        [
            _zero("section_count").desc(),
            _zero("has_any_open_seats").desc(),
            _zero("has_any_full_section").desc(),
            F.col("title").asc_nulls_first(),
            F.col("course_id").asc(),
            F.col("term_code").asc(),
        ],
    ).select("course_designation", "term_code", "course_id", F.lit("canonical").alias("resolved_by"))
    rest = wanted.join(canonical, "course_designation", "left_anti")
    alias = top_per_key(
        rest.join(aliases.withColumnRenamed("alias_course_designation", "course_designation"), "course_designation"),
        ["course_designation"],
        [F.col("is_primary").desc(), F.col("canonical_course_designation").asc(), F.col("course_id").asc(), F.col("term_code").asc()],
    ).select("course_designation", "term_code", "course_id", F.lit("alias").alias("resolved_by"))
    return canonical.unionByName(alias)
