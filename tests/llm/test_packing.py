from collections import defaultdict

import brute
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rosterloom.llm import packing, queries
from rosterloom.llm.packing import HarmonicPacker


def check_pieces(pieces, texts):
    """Pieces cover every document's ids once and sequences are filled without gaps; returns the padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(texts)
    for doc, parts in by_doc.items():
        ids, at = brute.ids(texts[doc]), 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert brute.crc(ids[at : at + p["length"]]) == p["ids_crc32"]
            at += p["length"]
        assert at == len(ids)
    padding = total = 0
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
        total += at
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding, total


def test_query_covers_every_document(spark, sf_dir, documents):
    pieces = queries.op6_harmonic_packing(spark, sf_dir).collect()
    padding, total = check_pieces(pieces, dict(documents))
    assert padding < 0.01 * total


def test_edge_texts(make_docs):
    texts = ["", None, "one", "word " * 9000, "a b c", "hello <|endoftext|> world<|endoftext|>"]
    pieces = packing.pack(make_docs(texts)).collect()
    check_pieces(pieces, dict(enumerate(texts)))


def test_null_ids_repeated_rows_and_other_columns(spark, make_docs):
    docs = make_docs([(7, "same text"), (7, "same text"), (None, "no id")]).selectExpr("*", "1 as length", "2 as sequence_id")
    pieces = packing.pack(docs).collect()
    lengths = defaultdict(int)
    for p in pieces:
        lengths[p["doc_id"]] += p["length"]
    assert lengths == {7: 2 * len(brute.ids("same text")), None: len(brute.ids("no id"))}
    assert packing.pack(docs.limit(0)).count() == 0


def test_sequences_hold_the_pieces(make_docs):
    texts = ["alpha beta gamma " * 200, "delta", "epsilon " * 700]
    packed = packing.sequences(packing.pack(make_docs(texts), with_ids=True)).collect()
    for row in packed:
        n = row["n_tokens"]
        assert len(row["tokens"]) == (n if n & (n - 1) == 0 else 1024)
    tokens = sorted(t for row in packed for t in row["tokens"][: row["n_tokens"]])
    assert tokens == sorted(int(t) for text in texts for t in brute.ids(text))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=40), st.sampled_from([64, 1000, 1024]))
def test_packer_places_every_id_once(lengths, capacity):
    packer = HarmonicPacker(capacity)
    placed, n = [], 0
    for i, length in enumerate(lengths):
        placed += packer.add(i, np.arange(n, n + length, dtype="<u4").tobytes())
        n += length
    placed += packer.finish()
    assert sorted(x for p in placed for x in np.frombuffer(p[2], "<u4").tolist()) == list(range(n))
    filled = defaultdict(int)
    for p in sorted(placed, key=lambda p: (p[4], p[5])):
        assert p[5] == filled[p[4]]
        filled[p[4]] += len(p[2]) // 4
    assert all(v <= capacity for v in filled.values())


def test_a_class_takes_a_fixed_number_of_pieces():
    packer = HarmonicPacker(1024, max_waste=0)
    for length in range(1, 1025):
        for k, size in packer.cuts(length):
            assert k * size <= 1024 < (k + 1) * size
        assert sum(size for _, size in packer.cuts(length)) == length
