"""Registered queries against their SQL, on the smallest driver tables."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import differences, oracle_connection

SF_DIR = os.environ.get("CANVASS_TEST_SF", "/root/testdata/sf0.001")
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_DIR)


def test_every_statement_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    assert differences(spark, con, name, QUERIES[name], ORACLE[name], SF_DIR) == ""


def test_files_of_requests_grow_in_number_not_in_size(spark, monkeypatch, tmp_path):
    """Fewer rows than a file may hold: the number asked for; more: one task never deals out more."""
    from canvass.catalog import queries

    monkeypatch.setattr(queries, "FILE_ROWS", 100)
    for rows, files in ((150, 2), (1000, 10)):
        queries.write_requests(spark.range(rows), str(tmp_path / str(rows)), 2)
        read = spark.read.json(str(tmp_path / str(rows)))
        held = [r["count"] for r in read.groupBy(F.input_file_name()).count().collect()]
        assert read.select("id").distinct().count() == sum(held) == rows and len(held) == files and max(held) <= 110
