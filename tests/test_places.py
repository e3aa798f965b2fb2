"""Source rows over folders, zones of a session, files that change, streams of copies, and what the entry imports."""

import importlib
import os
import subprocess
import sys

import pytest

from tabulon.errors import ReadFailed
from tabulon.operators.view import CellState
from tabulon.sources import delimited
from tabulon.spec import Mode, SearchRequest
from tabulon.table import open_table


def test_source_rows_of_a_partitioned_folder(spark, tmp_path):
    """Part files of equal base names in two folders, copied byte for byte."""
    import shutil

    for p in (1, 2):
        spark.range(3 * p - 3, 3 * p).coalesce(1).write.parquet(str(tmp_path / f"w{p}"))
        (tmp_path / f"t/p={p}").mkdir(parents=True)
        part = next((tmp_path / f"w{p}").glob("part-*"))
        shutil.copy(part, tmp_path / f"t/p={p}/part-0.parquet")
    t = open_table(spark, str(tmp_path / "t"))
    got = sorted((r["source_row"], r["c0"]) for r in t.rows.collect())
    assert got == [(k, str(k)) for k in range(6)]
    assert [r["c0"] for r in t.view().window(2, 3).orderBy("view_row").collect()] == ["2", "3", "4"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_text_of_moments_has_no_session_zone(spark, tmp_path, zone):
    sql = "select timestamp'2024-03-10T07:30:00.25Z' as z, timestamp_ntz'2024-03-10 02:30:00' as n, timestamp'1969-12-31T23:59:59.999999Z' as old, date'0044-03-15' as d, timestamp_ntz'0044-03-15 01:02:03.000001' as o"
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    spark.sql(sql).coalesce(1).write.parquet(str(tmp_path / "t"))
    spark.conf.unset("spark.sql.parquet.outputTimestampType")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        t = open_table(spark, str(next((tmp_path / "t").glob("part-*"))))
        want = ("2024-03-10T07:30:00.250000000Z", "2024-03-10T02:30:00.000000000", "1969-12-31T23:59:59.999999000Z", "0044-03-15", "0044-03-15T01:02:03.000001000")
        assert tuple(t.rows.select(*(f"c{k}" for k in range(5))).first()) == want
        # the other reader, of windows, shows the same
        assert tuple(t.view().window(0, 1).first())[2:] == want
        assert t.where(SearchRequest(Mode.EQ, want[1], 1)).count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_a_file_that_becomes_shorter(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n" + "1,2\n" * 1000)
    t = open_table(spark, str(path))
    os.truncate(path, 2000)
    with pytest.raises(ReadFailed):
        delimited.head(t.spec, 10_000)
    with pytest.raises(Exception, match="ends at byte 2000"):
        t.rows.count()


@pytest.mark.parametrize("text", ["a,b\n1,2\r3,4\r\n5,6\n\n7,8", "a,b\n" + "1,2\n" * 999, "a,b\r\n" + '1,"x\ny"\r\n' * 300, "a\n" + "é\n" * 500 + "last"])
def test_splits_count_what_is_read(spark, tmp_path, text):
    """Ranges without a quote are counted by their line ends."""
    (tmp_path / "t.csv").write_bytes(text.encode())
    t = open_table(spark, str(tmp_path / "t.csv"))
    got = delimited.load(spark, t.spec, step=700).orderBy("source_row").collect()
    whole = delimited.load(spark, t.spec).orderBy("source_row").collect()
    assert got == whole and [r["source_row"] for r in got] == list(range(len(got))) and t.estimated_count == (len(got), True)


def test_estimates(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n" + "123456789,some text\n" * 400_000)
    t = open_table(spark, str(tmp_path / "t.csv"))
    n, exact = t.estimated_count
    assert not exact and abs(n - 400_000) < 8000


def test_streamed_copies(spark, tmp_path):
    spark.range(5000).selectExpr("id", "concat('=', id) as s").coalesce(1).write.parquet(str(tmp_path / "t"))
    view = open_table(spark, str(next((tmp_path / "t").glob("part-*")))).order_by(0, True)
    want = [f"{k}\t'={k}" for k in range(4999, -1, -1)]
    assert list(view.lines(10, 3000, [0, 1])) == want[10:3010] and list(view.lines(0, 0, [0])) == []
    view.copy_to(str(tmp_path / "out"), 0, 5000, [0, 1])
    assert [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()] == want
    assert view.read_cell(0, 1) == (CellState.OK, "'=4999") and view.read_cell(9999, 1) == view.read_cell(0, 9) == (CellState.NO_CELL, "")


def test_matches_are_kept_and_cleared(spark, tmp_path):
    """From the second step on; what was written goes when the caller says so."""
    from tabulon.plans import numbering

    spark.range(900).selectExpr("id", "concat('row', id) as s").coalesce(1).write.parquet(str(tmp_path / "t"))
    t = open_table(spark, str(next((tmp_path / "t").glob("part-*"))))
    for view in (t.view(), t.where(SearchRequest(Mode.GE, "100", 0)), t.order_by(0, True)):
        find = view.find(SearchRequest(Mode.TEXT, "row77", scope=(1,)))
        steps = [find.next(0), find.next(300), find.next(899), find.previous(900)]
        assert [(h.source_row, h.position) for h in steps] == [(h.source_row, h.position) for h in [find.next(0), find.next(300), find.next(899), find.previous(900)]]
        assert steps[0].position == 1 and steps[0].source_row is not None
    before = list(spark.sparkContext._tabulon_paths)
    numbering.clear(spark, keep=before[-1])
    there = [os.path.isdir(p.removeprefix("file://").removeprefix("file:")) for p in before]
    assert len(before) >= 4 and there == [False] * (len(before) - 1) + [True]


def test_the_entry_hides_no_import_error(tmp_path):
    """A package that is absent is left out; one that fails is an error."""
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    ask = "import __spark_entry__ as e; print(len(e.queries()) > 60)"
    for name in ("__spark_entry__.py", "tabulon"):
        os.symlink(os.path.join(top, name), tmp_path / name)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    code = "import sys; sys.path.insert(0, '.'); import importlib.util as u; real = u.find_spec; u.find_spec = lambda n, *a: None if n.startswith('tabulon.') and 'llm' in n else real(n, *a); " + ask
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    without = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert without.stdout.strip().endswith("True"), without.stderr
    if importlib.util.find_spec("tabulon.llm") is not None:
        assert "no_such_module" in subprocess.run([sys.executable, "-B", "-c", ask], cwd=tmp_path, env=env, capture_output=True, text=True).stderr
