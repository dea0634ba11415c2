"""Every registered query against its check SQL."""

import compare
import pytest

from tremorline.plans import CHECKS, QUERIES


@pytest.mark.parametrize("name", [n for n in QUERIES if n in CHECKS])
def test_matches_sql(spark, db, name):
    assert compare.differences(QUERIES[name](spark, compare.SF), db, CHECKS[name]) == []


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in CHECKS])
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, compare.SF).count() > 0
