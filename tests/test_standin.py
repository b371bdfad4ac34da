"""The stand-in catalog."""

import os

import pytest

from workload.standin import Catalog

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_lines_are_numbered_and_joined_once(spark):
    c = Catalog(spark, SF)
    for rows in (c.sections, c.section_instructors):
        assert "Window" not in rows._jdf.queryExecution().optimizedPlan().toString()
    keys = c.sections.select("package_id", "section_class_number")
    assert keys.count() == keys.distinct().count() == c.t("lineitem").count()
