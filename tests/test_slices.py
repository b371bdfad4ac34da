"""Queries that are told by course work through the customers slice by slice, so scratch space is that of one slice."""

import os

import pytest

import __spark_entry__ as entry
from rosterloom import session
from rosterloom.operators import schedules
from workload import check, standin

SF = "/root/testdata/sf0.001"
SLICED = ["schedulable_packages_model", "meeting_lines", "schedule_planning_view", "schedule_calendar", "course_detail_doc", "canonical_meetings_model"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.mark.parametrize("name", SLICED)
def test_slices_hold_every_row_once(spark, name, monkeypatch):
    written = []

    def in_slices(spark, n, step, parts=None):
        written.append((n, parts))
        return session.in_slices(spark, n, step, parts)

    monkeypatch.setattr(standin, "in_slices", in_slices)
    monkeypatch.setattr(standin, "LINES_PER_SLICE", 2500)
    ok, detail = check.compare(spark, check.connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, detail
    # The joined lines and the result, each in as many slices.
    n = 5 if name == "course_detail_doc" else 3
    assert set(written) == {(n, "_slice"), (n, None)}, written


def test_a_slice_is_freed_before_the_next_and_no_key_is_lost(spark, monkeypatch):
    released = []
    monkeypatch.setattr(session, "release_shuffles", lambda s: released.append(1))
    rows = spark.createDataFrame([(None,), *[(i,) for i in range(50)]], "k long")
    seen = []

    def step(i):
        assert len(released) == i
        part = rows.filter(session.slice_of("k", 4) == i)
        seen.append(part.count())
        return part.groupBy("k").count()

    got = session.in_slices(spark, 4, step)
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.groupBy("k").count().collect()))
    assert sum(seen) == 51 and max(seen) < 30


@pytest.mark.parametrize("name", ["schedule_enumerate", "schedule_metrics", "schedule_topk"])
def test_requests_meet_their_candidates_in_slices(spark, name, monkeypatch):
    written = []

    def in_slices(spark, n, step, parts=None):
        written.append(n)
        return session.in_slices(spark, n, step, parts)

    monkeypatch.setattr(schedules, "in_slices", in_slices)
    monkeypatch.setattr(schedules, "REQUESTS_PER_SLICE", 600)
    ok, detail = check.compare(spark, check.connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, detail
    assert max(written) > 1, written
