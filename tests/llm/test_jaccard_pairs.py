"""Pairs of the small groups are made of narrow rows, and what a large group holds is left to its cells."""

from rosterloom.llm.jaccard_join import _remaining_pairs


def test_pairs_come_once_and_not_from_large_groups(spark):
    rows = [(9, n, True) for n in range(1, 40)]
    rows += [(5, 1, False), (5, 2, False), (6, 101, False), (6, 102, False), (7, 101, False), (7, 102, False), (7, 103, False)]
    table = spark.createDataFrame([(k, n, 20, n, 0, True, large) for k, n, large in rows], "key long, node long, n long, comp long, alone long, probe boolean, large boolean")
    got = sorted(tuple(r) for r in _remaining_pairs(table, 80).collect())
    # 1 and 2 share a large group too, whose cells compare them.
    assert got == [(101, 102), (101, 103), (102, 103)]
