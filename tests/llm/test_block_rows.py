"""Rows of whole blocks of documents are large: they are written and read one by one."""

import glob

import pyarrow.parquet as pq

from rosterloom.llm import lattice_lm
from rosterloom.llm.block_index import whole_blocks
from rosterloom.session import cut_lineage


def test_large_rows_have_a_row_group_of_their_own(spark, make_docs):
    docs = make_docs([f"w{i} w{i + 1} w{i + 2}" for i in range(40)], partitions=1)
    written = cut_lineage(whole_blocks(docs, lattice_lm.WORD_BYTES, lattice_lm.trains, tokens=9), rows_at_once=1)
    files = glob.glob(f"{written.inputFiles()[0].removeprefix('file://').rsplit('/', 1)[0]}/*.parquet")
    groups = [n for f in files for m in [pq.ParquetFile(f).metadata] for n in (m.row_group(i).num_rows for i in range(m.num_row_groups))]
    assert len(groups) > 10 and set(groups) == {1}
    counts = {r["term"]: r["n"] for r in lattice_lm.word_counts(written).collect()}
    assert counts == {f"w{k}": sum(lattice_lm.trains(i) for i in range(max(0, k - 2), min(39, k) + 1)) for k in range(42)}


def test_score_writes_its_blocks_one_by_one(spark, make_docs, monkeypatch):
    at_once = []

    def cut(df, rows_at_once=None):
        at_once.append((df.columns[0], rows_at_once))
        return cut_lineage(df, rows_at_once)

    monkeypatch.setattr(lattice_lm, "cut_lineage", cut)
    docs = make_docs(["a b", "b c d", None])
    assert lattice_lm.score(docs).count() == 3
    assert ("block", 1) in at_once
