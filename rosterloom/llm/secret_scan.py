"""Secret scans: fixed patterns plus sliding-window entropy over candidate strings.

A candidate is a run of characters that keys are made of.  Its character class (hex, letters and
digits, base64) sets the threshold; a window of ``WINDOW`` characters slides over it, and the sum of
c * log2(c) over the counts in the window is kept up to date by one leaving and one entering
character.  Windows at or above the threshold join to spans.  Allow-listed strings give no span, and
spans inside a pattern's span are not repeated.

Defined cases: a null or empty text has no spans; starts and ends are code points, ends exclusive;
every row is judged by itself, so repeated rows get equal results; an empty table gives no rows;
other columns are kept unless they carry the name of the new column, which replaces them.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(
    r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
MIN_ASSIGNED = 6
WINDOW = 20
# Bits per character that a window must reach; a class holds all candidates made of its characters
# only that no earlier class holds.  Letters alone are words unless nearly all differ.
CLASSES = (
    ("digits", re.compile(r"[0-9]+"), math.inf),
    ("hex", re.compile(r"[0-9a-fA-F]+"), 3.0),
    ("letters", re.compile(r"[A-Za-z]+"), 4.1),
    ("alphanumeric", re.compile(r"[A-Za-z0-9]+"), 3.6),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 3.9),
)
# Whole candidates that are no secrets: identifiers of the 8-4-4-4-12 form, dates and times, version
# numbers, paths and names of plain words, alphabets.
ALLOW = (
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T_-][0-9-]*)?",
    r"[/_=+-]*[A-Z]?[a-z]+(?:[/_=+-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*[/_=+-]*",
    r"(?i:.*(?:example|placeholder|your[_-]?key).*)",
    r"(?i:.*(?:abcdefghij|0123456789).*)",
)

_BITS = [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 1))]
_ALLOWED = tuple(map(re.compile, ALLOW))


def hot_windows(candidate: str, threshold: float) -> list[tuple[int, int]]:
    """Joined [start, end) of the windows whose entropy reaches the threshold."""
    if len(candidate) < WINDOW or threshold > math.log2(WINDOW):
        return []
    counts = Counter(candidate[:WINDOW])
    total = sum(_BITS[c] for c in counts.values())
    most = WINDOW * (math.log2(WINDOW) - threshold) + 1e-9  # entropy = log2(w) - total / w
    spans: list[list[int]] = []
    for start in range(len(candidate) - WINDOW + 1):
        if start:
            old, new = candidate[start - 1], candidate[start + WINDOW - 1]
            if old != new:
                total += _BITS[counts[old] - 1] - _BITS[counts[old]] + _BITS[counts[new] + 1] - _BITS[counts[new]]
                counts[old] -= 1
                counts[new] += 1
        if total <= most:
            if spans and start <= spans[-1][1]:
                spans[-1][1] = start + WINDOW
            else:
                spans.append([start, start + WINDOW])
    return [(a, b) for a, b in spans]


def find_secrets(text: str | None, allowed: tuple = _ALLOWED) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then by the order of ``KINDS``."""
    if not text:
        return []
    base = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    base += [("access", *m.span()) for m in ACCESS.finditer(text)]
    base += [("hex", *m.span()) for m in HEX.finditer(text)]
    found = list(base)
    for m in CANDIDATE.finditer(text):
        candidate = m[0]
        if any(a.fullmatch(candidate) for a in allowed):
            continue
        threshold = next(bits for _, members, bits in CLASSES if members.fullmatch(candidate))
        for a, b in hot_windows(candidate, threshold):
            a, b = m.start() + a, m.start() + b
            if not any(s <= a and b <= e for _, s, e in base):
                found.append(("entropy", a, b))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def secret_spans(text: F.Column, allow: tuple[str, ...] = ALLOW) -> F.Column:
    """Column of the spans of a text."""

    @F.pandas_udf("array<struct<kind: string, start: long, end: long>>")
    def spans(texts: pd.Series) -> pd.Series:
        allowed = tuple(map(re.compile, allow))
        return pd.Series(
            [[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t, allowed)] for t in texts], dtype=object
        )

    return spans(text.cast("string"))


def scan(docs: DataFrame, into: str = "secrets", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """Add the spans of ``text`` as a column."""
    return docs.withColumn(into, secret_spans(F.col("text"), allow))


def redact(docs: DataFrame, mask: str = "[SECRET]", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """Replace every secret in ``text`` by a mask; overlapping spans become one, null stays null."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        allowed = tuple(map(re.compile, allow))

        def one(text):
            if not text:
                return text
            out, at = [], 0
            for _, start, end in find_secrets(text, allowed):
                if start >= at:
                    out += [text[at:start], mask]
                at = max(at, end)
            return "".join([*out, text[at:]]) if out else text

        return texts.map(one, na_action="ignore")

    return docs.withColumn("text", masked(F.col("text").cast("string")))
