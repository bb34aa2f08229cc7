"""Registered queries of the library beside their SQL texts."""

from __future__ import annotations

from pathlib import Path

import pytest

from compare import duck, mismatch
from perfusia.plans import catalogue

DATA = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


def test_each_query_has_a_sql_text():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


@here
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_matches_sql(spark, name):
    assert mismatch(spark, name, DATA) == ""


@here
def test_sql_texts_parse():
    con = duck(DATA)
    for name, text in catalogue.oracle_sql().items():
        assert con.execute(f"EXPLAIN {text}").fetchall(), name
