import math
from collections import Counter

import brute
from hypothesis import given, settings
from hypothesis import strategies as st

from rosterloom.llm import queries, secret_scan
from rosterloom.llm.secret_scan import WINDOW, find_secrets, hot_windows


def test_query_against_plain_patterns(spark, sf_dir, documents):
    texts = dict(documents)
    for row in queries.op2_secret_scan(spark, sf_dir).collect():
        base = brute.base_secrets(texts[row["doc_id"]])
        counts = Counter(kind for kind, _, _ in base)
        assert (row["n_assign"], row["n_access"], row["n_hex"]) == (counts["assign"], counts["access"], counts["hex"])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert row["base_sha256"] == brute.sha(line)
        assert set(filter(None, line.split(","))) <= set(row["spans"].split(","))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("token:= \"'aAbf019_.AKIZ\nsecrtké"), max_size=60))
def test_base_spans_equal_plain_patterns(text):
    assert [s for s in find_secrets(text) if s[0] != "entropy"] == brute.base_secrets(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdef0123456789"), min_size=1, max_size=80), st.floats(1.5, 4.2))
def test_incremental_windows_equal_direct_entropy(candidate, threshold):
    covered = set()
    for i in range(len(candidate) - WINDOW + 1):
        counts = Counter(candidate[i : i + WINDOW]).values()
        bits = -sum(c / WINDOW * math.log2(c / WINDOW) for c in counts)
        if bits >= threshold + 1e-6:
            covered |= set(range(i, i + WINDOW))
    found = {x for a, b in hot_windows(candidate, threshold) for x in range(a, b)}
    assert covered <= found
    exact = {x for a, b in hot_windows(candidate, threshold + 2e-6) for x in range(a, b)}
    assert exact <= covered | found


def test_entropy_spans_and_allow_list():
    key = "x9Kq2Vb7Lm4Zt8Rw1Ys6Pd3N"
    assert [k for k, _, _ in find_secrets(f"key {key} end")] == ["entropy"]
    assert find_secrets("id 123e4567-e89b-12d3-a456-426614174000 end") == []
    assert find_secrets("on 2024-05-06T10-11-12-13-14-15 at") == []
    assert find_secrets("see path/to/some/ordinary/file-name here") == []
    assert find_secrets("internationalisationalists are thereforewithoutdoubt") == []
    # A span inside a pattern's span is not repeated.
    assert [k for k, _, _ in find_secrets(f"token = {key}")] == ["assign"]
    assert find_secrets(f"key {key} end", allowed=(secret_scan.re.compile("x9.*"),)) == []


def test_defined_cases(make_docs):
    key = "x9Kq2Vb7Lm4Zt8Rw1Ys6Pd3N"
    docs = make_docs([(1, None), (2, ""), (3, f"é {key}"), (3, f"é {key}"), (None, "password: hunter22 " * 3000)]).selectExpr(
        "*", "'x' as secrets", "1 as start"
    )
    rows = secret_scan.scan(docs).collect()
    by = {r["doc_id"]: r["secrets"] for r in rows}
    assert len(rows) == 5 and by[1] == [] and by[2] == []
    assert [(s["kind"], s["start"], s["end"]) for s in by[3]] == [("entropy", 2, 26)]
    assert len(by[None]) == 3000 and rows[0]["start"] == 1
    texts = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs).collect()}
    assert texts[1] is None and texts[2] == "" and texts[3] == "é [SECRET]"
    assert texts[None] == "[SECRET] " * 3000
    assert secret_scan.scan(docs.limit(0)).count() == 0
