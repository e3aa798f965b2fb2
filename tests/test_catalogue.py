"""Every registered query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tabulon import catalogue
from tabulon.errors import UnsupportedSchema
from tabulon.table import open_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


def rows(columns, found):
    by = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(r[k] for k in by) for r in found), key=repr)


@pytest.mark.parametrize("name", catalogue.queries())
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["view_row", "source_row", "o_orderkey"] and df.count() == 50
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scan_reads_two_columns(spark):
    df = catalogue.scan_source_rows(spark, SF)
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,_tmp_metadata_row_index:bigint>" in df._jdf.queryExecution().executedPlan().toString()


def test_nested_tables_are_refused(spark):
    with pytest.raises(UnsupportedSchema):
        open_table(spark, f"{SF}/embeddings.parquet")
