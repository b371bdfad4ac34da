"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example: all turns before it as context, and only its own text
trainable.  A turn is written as ``<|im_start|>role`` newline, text, ``<|im_end|>`` newline.  A control
string inside a role or text gets a backslash after its first character (one more if it has some
already), which reading takes off again; roles also write ``%`` and newline as ``%25`` and ``%0A``.
So no text can open or close a turn.  Turns after the last reply follow in an example without a
target, so that the output holds every turn.

The output of the method grows with the square of a conversation's turns; a conversation's turns
meet in one row, as every example of its end needs all of them.

Defined cases: turns are ordered by (turn, role, text), nulls first; equal rows are turns of their
own; a null text or role is empty; rows with a null ``conv_id`` form one conversation; an empty table
gives no examples; of other columns none is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"
# Control strings after their first character, < or [: those of this template and of common others.
_REST = r"(\|im_start\|>|\|im_end\|>|/?s>|</?SYS>>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _REST, "$1$2$3")


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_examples(turns: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """(conv_id, example, is_last, text, loss_start, loss_length) from rows (conv_id, turn, role, text).

    ``loss_start`` counts code points from 0; ``loss_length`` is null where nothing is trainable.
    """
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("turn"),
    )
    # Nulls first: array_sort would put structs with null turns by the same rule, sort_array says so.
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    written = gathered.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                (t["role"] == trained_role).alias("trained"),
                F.concat(F.lit(OPEN), _role_out(t["role"]), F.lit("\n")).alias("head"),
                escape(t["text"]).alias("body"),
            ),
        ).alias("turns"),
    )
    n = F.size("turns")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("turns", i)["trained"] | (i == n))
    examples = written.select("conv_id", "turns", F.posexplode(ends).alias("example", "end"))
    last = F.element_at("turns", F.col("end"))
    before = F.array_join(
        F.transform(F.slice("turns", 1, F.col("end") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), ""
    )
    return examples.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        (F.col("end") == n).alias("is_last"),
        before.alias("_before"),
        last.alias("_last"),
    ).select(
        "conv_id",
        "example",
        "is_last",
        F.concat("_before", "_last.head", "_last.body", F.lit(CLOSE)).alias("text"),
        F.when(F.col("_last.trained"), F.length("_before") + F.length("_last.head")).cast("long").alias("loss_start"),
        F.when(F.col("_last.trained"), F.length("_last.body")).cast("long").alias("loss_length"),
    )


def parse_turns(text: Column) -> Column:
    """Turns (role, text) of a formatted example, unescaped."""
    parts = F.split(text, F.lit(r"<\|im_end\|>\n"))
    turns = F.slice(parts, 1, F.size(parts) - 1)

    def one(part: Column) -> Column:
        at = F.locate("\n", part)
        role = F.substring(part, F.lit(len(OPEN) + 1), at - 1 - len(OPEN))
        return F.struct(_role_in(role).alias("role"), unescape(F.substring(part, at + 1, F.length(part))).alias("text"))

    return F.transform(turns, one)


def target(examples: DataFrame) -> Column:
    """The unescaped text under the loss mask; null where there is none."""
    return unescape(F.substring(F.col("text"), F.col("loss_start").cast("int") + 1, F.col("loss_length").cast("int")))


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: turn count, digests of turns and of trained text, sizes.

    Each example is read in its own row; the grouping keeps the partitioning of the formatting.
    """
    turns = F.when(F.col("is_last"), parse_turns(F.col("text")))
    digest = F.sha2(F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    parsed = examples.select(
        "conv_id", "example", turns.alias("_turns"), target(examples).alias("_target"), F.length("text").cast("long").alias("_chars")
    ).select(
        "conv_id",
        F.size("_turns").alias("_n"),
        F.when(F.col("_turns").isNotNull(), digest).alias("_digest"),
        F.when(F.col("_target").isNotNull(), F.struct("example", F.col("_target").alias("text"))).alias("_target"),
        "_chars",
    )
    targets = F.array_join(F.transform(F.sort_array(F.collect_list("_target")), lambda t: t["text"]), "")
    return parsed.groupBy("conv_id").agg(
        F.max(F.when(F.col("_digest").isNotNull(), F.col("_n"))).cast("long").alias("n_turns"),
        F.max("_digest").alias("turns_sha256"),
        F.coalesce(F.sum(F.length("_target.text")), F.lit(0)).cast("long").alias("loss_chars"),
        F.sha2(targets, 256).alias("loss_sha256"),
        F.sum("_chars").alias("formatted_chars"),
        F.count("_target").alias("n_targets"),
    )
