"""Text normalisation, search tokens and composite keys."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    # The fold over nothing hands its start to the body. An item taken out of a transformed array would ask for the type of the
    # whole body again at every row, at each level of nesting.
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, body)


def _blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def squeeze(x: Column) -> Column:
    """Trim and collapse whitespace; blank becomes NULL."""
    return _blank_to_null(F.trim(F.regexp_replace(x, r"\s+", " ")))


def key_part(x: Column) -> Column:
    """Trim and lower-case; blank becomes NULL."""
    return _blank_to_null(F.lower(F.regexp_replace(x.cast("string"), r"^\s+|\s+$", "")))


def match_text(x: Column) -> Column:
    """Form used for entity matching: NULL as '', collapsed, upper-case."""
    return F.upper(F.trim(F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"\s+", " ")))


def designation(x: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(x, r"\s+", " ")))


def search_tokens(x: Column) -> Column:
    """Lower-case ASCII alphanumeric runs."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def search_text(x: Column) -> Column:
    return F.array_join(search_tokens(x), " ")


def compact_designation(x: Column) -> Column:
    """Tokens before the first one holding a digit are glued together: ``l i s 102`` -> ``lis 102``."""
    # On the normalised text this is one anchored replace: drop blanks in the digit-free prefix.
    normal = search_text(x)
    head = F.regexp_extract(normal, r"^([a-z]+(?: [a-z]+)*) ([a-z]*[0-9].*)$", 1)
    tail = F.regexp_extract(normal, r"^([a-z]+(?: [a-z]+)*) ([a-z]*[0-9].*)$", 2)
    return F.when(head == "", normal).otherwise(F.concat(F.replace(head, F.lit(" "), F.lit("")), F.lit(" "), tail))


def composite_key(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def key_field(key: Column, index: int) -> Column:
    """Field of a composite key, NULL when there are too few."""
    return F.get(F.split(key, ":"), index)


def display_name(first: Column, last: Column) -> Column:
    first_part = F.coalesce(F.concat(first, F.lit(" ")), F.lit(""))
    return _blank_to_null(F.trim(F.concat(first_part, F.coalesce(last, F.lit("")))))


def natural_parts(x: Column) -> list[Column]:
    """Sort keys for text with one embedded number: prefix, number, the text itself."""
    return [
        F.regexp_extract(x, r"^(\D*)", 1),
        F.coalesce(F.regexp_extract(x, r"(\d+)", 1).try_cast("bigint"), F.lit(-1)),
        x,
    ]


def fnv1a_32(x: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 units of a text, as an unsigned long."""
    codes = F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    mask = F.lit(4294967295).cast("bigint")
    return F.aggregate(
        codes,
        F.lit(2166136261).cast("bigint"),
        lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619).cast("bigint")).bitwiseAND(mask),
    )


def synthetic_id(seed: Column) -> Column:
    """Stable negative stand-in for a missing number."""
    return -(fnv1a_32(seed) + 1)


def defined_values(x: Column, kind: DataType) -> Column:
    """How many values a nested column holds: leaves that are set, and one more for each list or object that is not empty.

    Nulls, empty lists and objects without a set field count 0.  Part of the version-priority tie-break.
    """
    if isinstance(kind, StructType):
        inner = reduce(lambda a, b: a + b, [defined_values(x[f.name], f.dataType) for f in kind.fields], F.lit(0))
        return F.when(x.isNull(), 0).otherwise(let(inner, lambda n: n + (n > 0).cast("int")))
    if isinstance(kind, MapType):
        return defined_values(F.map_values(x), ArrayType(kind.valueType))
    if isinstance(kind, ArrayType):
        items = F.transform(x, lambda item: defined_values(item, kind.elementType))
        return F.when(x.isNull(), 0).otherwise(F.aggregate(items, (F.size(x) > 0).cast("int"), lambda n, m: n + m))
    return x.isNotNull().cast("int")


def _all_strings(items: Column) -> Column:
    return F.forall(items, lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False)))


def string_list(x: Column) -> Column:
    """JSON text to array<string>; empty unless it is a list of nothing but strings."""
    items = F.try_variant_get(F.try_parse_json(x), "$", "array<variant>")
    return F.when(_all_strings(items), F.from_json(x, "array<string>")).otherwise(F.array().cast("array<string>"))


def string_groups(x: Column) -> Column:
    """JSON text to array<array<string>>; empty unless it is a list of lists of strings."""
    groups = F.try_variant_get(F.try_parse_json(x), "$", "array<variant>")
    lists = F.transform(groups, lambda g: F.try_variant_get(g, "$", "array<variant>"))
    right = F.forall(lists, lambda items: F.coalesce(_all_strings(items), F.lit(False)))
    return F.when(right, F.from_json(x, "array<array<string>>")).otherwise(F.array().cast("array<array<string>>"))


def valid_json(x: Column) -> Column:
    return F.try_parse_json(x).isNotNull()
