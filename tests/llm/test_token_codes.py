import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rosterloom.llm import queries, token_codes
from rosterloom.llm.encoding import encoder
from rosterloom.llm.token_codes import Block, encode_block


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70_000), st.integers(0, 2**32 - 1)), max_size=2000), st.data())
def test_block_round_trip(values, data):
    block = Block(encode_block(np.array(values, dtype=np.uint32)))
    assert len(block) == len(values)
    assert block.slice(0, len(values)).tolist() == values
    if values:
        i = data.draw(st.integers(0, len(values) - 1))
        j = data.draw(st.integers(i, len(values)))
        assert block[i] == values[i]
        assert block.slice(i, j).tolist() == values[i:j]


def test_block_limits():
    block = Block(encode_block(np.array([1, 2, 3], dtype=np.uint32)))
    with pytest.raises(IndexError):
        block[3]
    with pytest.raises(ValueError):
        Block(b"nonsense and more")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Z\n\t.,'_-²½é中\x1c\x85 　 \r12Ⅷ٣sl<|endoftext|>"), max_size=30))
def test_encoder_equals_the_library(text):
    assert np.frombuffer(encoder().ids(text), "<u4").tolist() == brute.ids(text)[:-1].tolist()


def expected(rows):
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: r[0]):
        ids = brute.ids(text)
        out.append((doc, start, len(ids), brute.crc(ids)))
        start += len(ids)
    return out


def test_query_reads_back_every_document(spark, sf_dir, documents):
    found = [tuple(r) for r in queries.op9_token_codes(spark, sf_dir).collect()]
    assert sorted(found) == expected(documents)


def test_small_blocks_edges_and_look_up(spark, make_docs, tmp_path):
    texts = ["", None, "one two", "word " * 3000, "ünï cödé", "x"]
    path = str(tmp_path / "tokens")
    token_codes.write_tokens(make_docs(texts).selectExpr("*", "1 as shard", "2 as data"), path, block_ids=64)
    assert sorted(map(tuple, token_codes.read_documents(spark, path).collect())) == expected(list(enumerate(texts)))
    stream = np.concatenate([brute.ids(t) for t in texts])
    asked = [0, 1, 5, len(stream) - 1, len(stream) // 2, 5, len(stream), -1]
    positions = spark.createDataFrame([(p,) for p in asked], "position long")
    found = sorted(map(tuple, token_codes.ids_at(spark, path, positions).collect()))
    assert found == sorted((p, int(stream[p])) for p in asked if 0 <= p < len(stream))


def test_repeated_null_and_no_rows(spark, make_docs, tmp_path):
    docs = make_docs([(3, "same"), (3, "same"), (None, "no id")])
    path = str(tmp_path / "repeated")
    token_codes.write_tokens(docs, path)
    rows = sorted(token_codes.read_documents(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 3, 3] and rows[0]["start"] == 0
    empty = str(tmp_path / "empty")
    token_codes.write_tokens(docs.limit(0), empty)
    assert token_codes.read_documents(spark, empty).count() == 0
