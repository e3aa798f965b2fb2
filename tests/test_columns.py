"""Inference, overrides, sentinels, proposals, labels, jobs and addresses."""

import http.server
import threading

import pytest

from tabulon.errors import InvalidArgument, NetworkCause, NetworkError, NoProposal
from tabulon.operators.columns import alignment, generic_name, search_labels
from tabulon.operators.evidence import Confidence, Conflict, Rows, State, fits, joined
from tabulon.operators.jobs import Job, JobState, SortAction, header_shift, jump_field, next_sort
from tabulon.sources import delimited, parquet
from tabulon.sources import http as web
from tabulon.functions.classify import type_of
from tabulon.spec import TEXT, ColumnType, Kind, Zone
from tabulon.table import open_table

COLUMNS = "id,name,amount,mixed\n" + "".join(f"{k},n{k},{k}0.50,{k if k <= 12 else 'word'}\n" for k in range(1, 17))


@pytest.fixture
def table(spark, tmp_path):
    (tmp_path / "c.csv").write_text(COLUMNS)
    return open_table(spark, str(tmp_path / "c.csv"))


def test_inference(table):
    i, n, a, m = table.columns.infer([0, 1, 2, 3])
    assert (i.effective.kind, n.effective.kind, a.effective.kind, m.effective.kind) == (Kind.INTEGER, Kind.TEXT, Kind.DECIMAL, Kind.INTEGER)
    assert (i.confidence, i.state, i.evidence, i.rows) == (Confidence.EXHAUSTIVE, State.PUBLISHED, 16, 16)
    assert (a.inferred.scale, m.conflicts, m.conflict, m.conflict_row, m.conflict_example) == (1, 4, Conflict.OBSERVED, 12, "word")
    with pytest.raises(NoProposal):
        table.columns.accept_proposal(3)


def test_bounded_inference_and_proposal(spark, tmp_path):
    (tmp_path / "b.csv").write_text("x\n" + "".join(f"{k}\n" for k in range(300)))
    t = open_table(spark, str(tmp_path / "b.csv"))
    got = t.columns.infer([0])[0]
    assert (got.confidence, got.rows, got.effective.kind) == (Confidence.BOUNDED, 256, Kind.INTEGER)
    t.columns.observe((1000 + k, {0: "text"}) for k in range(8))
    t.columns.observe([(1000, {0: "text"})])
    got = t.columns.metadata(0)
    assert (got.conflicts, got.conflict, got.proposal) == (8, Conflict.PROPOSED, TEXT)
    t.columns.accept_proposal(0)
    assert t.columns.metadata(0).effective == TEXT and t.columns.metadata(0).conflicts == 0


def test_few_values_are_provisional(spark, tmp_path):
    (tmp_path / "f.csv").write_text("x\n" + "\n" * 300 + "5\n")
    t = open_table(spark, str(tmp_path / "f.csv"))
    got = t.columns.infer([0])[0]
    assert (got.state, got.confidence, got.empty, got.effective.kind) == (State.PROVISIONAL, Confidence.NONE, 256, Kind.UNKNOWN)
    t.columns.observe([(300, {0: "5"})])
    assert (t.columns.metadata(0).confidence, t.columns.metadata(0).effective.kind) == (Confidence.LOW, Kind.UNKNOWN)


def test_overrides_and_sentinels(table):
    table.columns.infer([3])
    table.columns.override(3, ColumnType(Kind.DATE))
    got = table.columns.metadata(3)
    assert (got.effective.kind, got.conflicts, got.conflict_row) == (Kind.DATE, 16, 0)
    table.columns.override(3, None)
    table.columns.sentinel(3, "word")
    got = table.columns.metadata(3)
    assert (got.null, got.conflicts, got.evidence, got.sentinel) == (4, 0, 12, "word")
    for bad in (ColumnType(Kind.UNKNOWN), ColumnType(Kind.DATETIME), ColumnType(Kind.DATE, Zone.NAIVE), ColumnType(Kind.DECIMAL, precision=3)):
        with pytest.raises(InvalidArgument):
            table.columns.override(3, bad)
    with pytest.raises(InvalidArgument):
        table.columns.sentinel(3, "x" * 257)


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("12", "3.25", (Kind.DECIMAL, 4, 2)), ("1e3", "0.5", (Kind.DECIMAL, 5, 1)), ("100", "7", (Kind.INTEGER, 3, 0)), ("true", "1", (Kind.TEXT, None, None)),
        ("2024-01-01T00:00:00", "2024-01-01T00:00:00Z", (Kind.TEXT, None, None)), ("2024-01-01", "2024-01-02", (Kind.DATE, None, None)),
    ],
)
def test_merge(a, b, want):
    for x, y in ((a, b), (b, a)):
        t = joined(type_of(x), type_of(y))
        assert (t.kind, t.precision, t.scale) == want
    assert joined(type_of("2024-01-01T00:00:00.5"), type_of("2024-01-01T00:00:00.125")).fraction_digits == 3


def test_rows_are_ranges():
    import random

    rng, rows, seen = random.Random(1), Rows(), set()
    for _ in range(500):
        row = rng.randrange(120)
        assert rows.add(row) == (row not in seen)
        seen.add(row)
    assert len(rows) == len(seen) == 120 - len(set(range(120)) - seen) and len(rows.first) <= 1 + len(set(range(120)) - seen)


@pytest.mark.parametrize(("limit", "value", "want"), [("12.50", "99.9", True), ("12.50", "100.1", False), ("12.5", "1.25", False), ("5", "123456789", True), ("5", "1.0", False), ("true", "false", True), ("2024-01-01T00:00:00.25", "2024-01-01T00:00:00.125", False), ("2024-01-01T00:00:00.25Z", "2024-01-01T00:00:00Z", True), ("a", "5", True), ("2024-01-01", "5", False)])
def test_fits(limit, value, want):
    assert fits(type_of(limit), type_of(value)) is want


def test_labels():
    assert [generic_name(k) for k in (0, 25, 26, 27, 701, 702)] == ["A", "Z", "AA", "AB", "ZZ", "AAA"]
    labels = ["Name", None, "surname", ""] + [f"name{k}" for k in range(12)]
    assert search_labels(labels, "NAME") == ([0, 2, *range(4, 12)], True)
    assert search_labels(labels, "#2") == ([1], False) and search_labels(labels, "#02") == ([], False) and search_labels(labels, "#99") == ([], False)
    assert search_labels(labels, "b 2") == ([1], False)
    assert alignment(Kind.BOOLEAN).value == "center" and alignment(Kind.DATE).value == "trailing" and alignment(Kind.TEXT).value == "leading"


def test_small_rules():
    assert [next_sort(None, False, 1), next_sort(1, False, 1), next_sort(1, True, 1), next_sort(1, True, 2)] == [SortAction.ASCENDING, SortAction.DESCENDING, SortAction.CLEAR, SortAction.ASCENDING]
    assert next_sort(1, False, 1, JobState.FAILED) is SortAction.RETRY and next_sort(1, False, 1, JobState.RUNNING) is SortAction.CLEAR
    assert [jump_field(x) for x in ("1", "0", "-1", "12a", "", "18446744073709551616")] == [0, None, None, None, None, None]
    assert (header_shift(False, True), header_shift(True, False), header_shift(True, True)) == (-1, 1, 0)


def test_jobs(spark):
    done = Job(spark, lambda: spark.range(100).count()).wait(60)
    assert (done.state, done.result, done.progress) == (JobState.DONE, 100, 1.0)
    assert Job(spark, lambda: 1 / 0).wait(60).state is JobState.FAILED
    slow = Job(spark, lambda: spark.range(1 << 40).selectExpr("sum(id * id % 7)").collect())
    slow.cancel()
    assert slow.wait(60).state is JobState.CANCELLED


def parquet_bytes():
    import io

    import pyarrow as pa
    import pyarrow.parquet as pq

    out = io.BytesIO()
    pq.write_table(pa.table({"id": range(5000), "name": [f"row{k}" for k in range(5000)]}), out, row_group_size=1000)
    return out.getvalue()


class Handler(http.server.BaseHTTPRequestHandler):
    body = b"name,n\na,1\nb,2\n"
    ranged = {"/ranges": body, "/big.csv": b"k,text\n" + b"".join(b'%d,"a\nb"\n' % k for k in range(2000)), "/t.parquet": parquet_bytes()}

    def do_GET(self):  # noqa: N802
        if self.path.startswith("/loop"):
            self.send_response(302)
            self.send_header("Location", "/loop")
            self.end_headers()
        elif self.path == "/moved":
            self.send_response(301)
            self.send_header("Location", "/t.csv")
            self.end_headers()
        elif self.path == "/missing":
            self.send_error(404)
        elif self.path == "/short":
            self.send_response(200)
            self.send_header("Content-Length", "999")
            self.end_headers()
            self.wfile.write(self.body)
        elif self.path in self.ranged and (r := self.headers.get("Range")):
            a, b = r.removeprefix("bytes=").split("-")
            whole = self.ranged[self.path]
            part = whole[int(a) : int(b or len(whole)) + 1]
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {a}-{int(a) + len(part) - 1}/{len(whole)}")
            self.send_header("Content-Length", str(len(part)))
            self.end_headers()
            self.wfile.write(part)
        else:
            self.send_response(200)
            self.send_header("Content-Length", str(len(self.body)))
            self.end_headers()
            self.wfile.write(self.body)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def site():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


@pytest.mark.parametrize("path", ["/t.csv", "/moved", "/ranges"])
def test_open_address(spark, site, path):
    t = open_table(spark, site + path)
    assert t.spec.labels == ("name", "n") and t.count() == 2


def test_remote_tables_are_read_by_ranges(spark, site, monkeypatch):
    """No spool: tasks read the address itself, Parquet by row groups and text by splits."""
    monkeypatch.setattr(web, "Fetch", None)
    t = open_table(spark, site + "/t.parquet")
    assert t.spec.labels == ("id", "name") and t.count() == 5000 and t.rows.rdd.getNumPartitions() == 5
    assert t.view().window(4999, 1).first()["c1"] == "row4999" and parquet.file_info(site + "/t.parquet").row_groups == 5
    t = open_table(spark, site + "/big.csv")
    assert t.count() == 2000
    rows = delimited.load(spark, t.spec, step=4000)
    assert rows.rdd.getNumPartitions() > 3 and [r["source_row"] for r in rows.orderBy("source_row").collect()] == list(range(2000))


@pytest.mark.parametrize(("path", "cause"), [("/loop", NetworkCause.REDIRECTS), ("/missing", NetworkCause.HTTP_STATUS), ("/short", NetworkCause.SHORT_BODY)])
def test_network_failures(site, path, cause):
    fetch = web.Fetch(site + path)
    with pytest.raises(NetworkError) as e:
        fetch.result(30)
    assert e.value.cause is cause and fetch.poll().phase is web.Phase.FAILED
    fetch.release()


def test_network_requests(site):
    for bad in ("ftp://x/y", "http://", "nothing"):
        with pytest.raises(NetworkError):
            web.Fetch(bad)
    with pytest.raises(NetworkError) as e:
        web.Fetch("http://127.0.0.1:9/x").result(30)
    assert e.value.cause is NetworkCause.UNREACHABLE
    assert web.tail(site + "/ranges", 4) == b"b,2\n" and web.tail(site + "/t.csv", 4) is None


def test_stream(spark, tmp_path):
    from tabulon.spec import Mode, SearchRequest
    from tabulon.streaming import incremental

    folder = tmp_path / "in"
    spark.range(50).selectExpr("id", "concat('row', id) as name").coalesce(1).write.parquet(str(folder))
    schema = spark.read.parquet(str(folder)).schema
    found = incremental.matching(spark, str(folder), schema, SearchRequest(Mode.TEXT, "ROW1"))
    incremental.write(found, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 11
