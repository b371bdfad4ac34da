"""Grade-count maps: normalisation, ordering, totals and the two GPA definitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterloom.functions.text import let

# Display order of the known grade codes.
GRADE_CODES = [
    "A+", "A", "AB", "B", "BC", "C", "D", "F", "S", "U",
    "CR", "N", "P", "I", "NR", "W", "WP", "WF", "DR", "X",
]

# Quality points of the graded codes.
GRADE_POINTS = {"A": 4.0, "AB": 3.5, "B": 3.0, "BC": 2.5, "C": 2.0, "D": 1.0, "F": 0.0}


def live_counts(raw: Column) -> Column:
    """Live payload map to grade counts: ``total`` and NULLs dropped, ``Count`` suffix removed, ``nw`` is W."""
    kept = F.map_filter(raw, lambda k, v: (k != "total") & v.isNotNull())
    return F.transform_keys(
        kept, lambda k, _: F.when(k == "nwCount", F.lit("W")).otherwise(F.regexp_replace(k, "Count$", ""))
    )


def total_count(counts: Column) -> Column:
    return F.aggregate(F.map_values(counts), F.lit(0).cast("bigint"), lambda a, v: a + F.coalesce(v, F.lit(0)))


def count_of(counts: Column, code: str) -> Column:
    """Count under a code, whichever case the key has."""
    return F.coalesce(F.try_element_at(counts, F.lit(code)), F.try_element_at(counts, F.lit(code.lower())), F.lit(0))


def quality_points(counts: Column) -> Column:
    total = F.lit(0.0)
    for code, points in GRADE_POINTS.items():
        if points:
            total = total + count_of(counts, code) * points
    return total


def gpa_of_graded(counts: Column) -> Column:
    """Mean over graded students only; 0 when there are none."""

    def mean(known: Column) -> Column:
        graded = F.lit(0)
        for code in GRADE_POINTS:
            graded = graded + count_of(known, code)
        return F.when(graded > 0, quality_points(known) / graded).otherwise(0.0)

    return let(counts, mean)


def gpa_of_total(counts: Column, total: Column) -> Column:
    """Mean whose denominator counts everyone, graded or not; 0 when the total is not positive."""
    # The counts are worked out once, not for each code that is looked up.
    return let(counts, lambda known: F.when(total > 0, quality_points(known) / total).otherwise(0.0))


def grade_rank(code: Column) -> Column:
    """Position among the known codes; unknown codes come after all of them."""
    known = F.array(*[F.lit(c) for c in GRADE_CODES])
    position = F.array_position(known, code)
    return F.when(position > 0, position).otherwise(len(GRADE_CODES) + 1)
