"""Queries that cover whole tables and whole texts, on rows that the small tables lack."""

import duckdb
import pytest

from tabulon import catalogue

ROWS = [(1, "short"), (2000, "=" + "x" * 4096), (9999, "é" * 2048), (10_000, "é" * 2049), (10_001, ""), (10_002, None), (3, "-1.5 " * 40), (4, "+" + "y" * 100), (6, "@" * 60)]


@pytest.mark.parametrize("name", ["display_cap_whole", "neutralize_whole_cells"])
def test_every_row(spark, tmp_path, name):
    spark.createDataFrame([(i, t, "en") for i, t in ROWS], "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got, want = catalogue.queries()[name](spark, str(tmp_path)), duck.sql(catalogue.oracle_sql()[name])
    assert sorted(map(repr, map(tuple, got.select(want.columns).collect()))) == sorted(map(repr, want.fetchall()))
    assert got.count() == len(ROWS)
