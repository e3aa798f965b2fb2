"""Registered queries over http: the driver serves a table's own file to the tasks, and answers that are errors."""

from __future__ import annotations

import http.server
import os
import secrets
import threading

from pyspark.sql import SparkSession

from tabulon.catalogue import named, query, request
from tabulon.catalogue_text import source_of
from tabulon.errors import NetworkError
from tabulon.sources import http as web
from tabulon.sources import parquet, storage
from tabulon.spec import Mode
from tabulon.table import open_table


class Site(http.server.ThreadingHTTPServer):
    """Serves only what it was given, under names that can't be guessed; ``ranged`` files by ranges, others whole."""

    daemon_threads = True

    def __init__(self, host: str) -> None:
        super().__init__((host, 0), Answer)
        self.files: dict[str, tuple[str, bool]] = {}
        threading.Thread(target=self.serve_forever, daemon=True).start()

    def offer(self, path: str, ranged: bool) -> str:
        name = f"/{secrets.token_hex(16)}{os.path.splitext(path)[1]}"
        self.files[name] = (path, ranged)
        return self.address(name)

    def address(self, name: str) -> str:
        return f"http://{self.server_address[0]}:{self.server_port}{name}"


class Answer(http.server.BaseHTTPRequestHandler):
    def _redirect(self, to: str) -> None:
        self.send_response(302)
        self.send_header("Location", to)
        self.end_headers()

    def do_GET(self) -> None:  # noqa: N802
        if self.path == "/loop":
            return self._redirect("/loop")
        if self.path == "/short":
            self.send_response(200)
            self.send_header("Content-Length", "100")
            self.end_headers()
            self.wfile.write(b"half")
            return None
        if self.path not in self.server.files:
            return self.send_error(404)
        path, ranged = self.server.files[self.path]
        total = storage.size(path)
        first, stop, asked = 0, total, self.headers.get("Range", "").removeprefix("bytes=")
        if ranged and asked:
            a, b = asked.split("-")
            first, stop = (int(a), min(total, int(b) + 1 if b else total)) if a else (max(0, total - int(b)), total)
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {first}-{stop - 1}/{total}")
        else:
            self.send_response(200)
        self.send_header("Content-Length", str(stop - first))
        self.end_headers()
        for piece in storage.pieces(path, first, stop):
            self.wfile.write(piece)
        return None

    def log_message(self, *_) -> None:
        pass


_SITES: dict[str, Site] = {}


def site(spark: SparkSession) -> Site:
    """One a process, at the address under which executors reach the driver."""
    host = spark.conf.get("spark.driver.host", "127.0.0.1")
    if host not in _SITES:
        _SITES[host] = Site(host)
    return _SITES[host]


@query("select row_number() over () - 1 as source_row, p_partkey::varchar as p_partkey, p_name from part")
def http_parquet(spark, sf_dir):
    """By ranges: the footer, then row groups, each by a task."""
    t = open_table(spark, site(spark).offer(f"{sf_dir}/part.parquet", ranged=True))
    return named(t.rows, t, ["p_partkey", "p_name"], "source_row")


@query("select source_row, c_custkey::varchar as c_custkey, c_name from (select row_number() over () - 1 as source_row, * from customer) where contains(c_name, '77')")
def http_csv(spark, sf_dir):
    from pyspark.sql import functions as F

    path = source_of(spark, sf_dir, "customer", [(x, F.col(x)) for x in ("c_custkey", "c_name")])
    t = open_table(spark, site(spark).offer(path, ranged=True))
    found = t.where(request(t, Mode.TEXT, "77", scope=["c_name"])).numbered
    return named(found, t, ["c_custkey", "c_name"], "source_row")


@query("select 'done' as phase, true as whole, count(*) as rows from nation")
def http_fetch(spark, sf_dir):
    """A server without ranges: the file is fetched first, and its state can be polled."""
    path = f"{sf_dir}/nation.parquet"
    fetch = web.Fetch(site(spark).offer(path, ranged=False))
    rows = parquet.file_info(fetch.result(60)).rows
    state = fetch.poll()
    fetch.release()
    return spark.createDataFrame([(state.phase.value, state.received == storage.size(path), rows)], "phase string, whole boolean, rows long")


@query("select * from (values ('ftp address', 'invalid argument'), ('missing', 'unexpected HTTP status'), ('redirects', 'too many redirects'), ('short body', 'body ended early'), ('no server', 'host unreachable')) as x(address, cause)")
def network_errors(spark, sf_dir):
    own, found = site(spark), []
    for name, url in (("ftp address", "ftp://host/file"), ("missing", own.address("/missing")), ("redirects", own.address("/loop")), ("short body", own.address("/short")), ("no server", f"http://{own.server_address[0]}:9/x")):
        cause = None
        try:
            fetch = web.Fetch(url)
            try:
                fetch.result(60)
            finally:
                fetch.release()
        except NetworkError as e:
            cause = e.cause.value
        found.append((name, cause))
    return spark.createDataFrame(found, "address string, cause string")


@query("select * from (values ('missing file', 'NotFound'), ('folder of no table', 'ReadFailed'), ('nested columns', 'UnsupportedSchema')) as x(path, error)")
def open_errors(spark, sf_dir):
    from tabulon.errors import OpenError
    from tabulon.plans.numbering import new_path

    empty = new_path(spark, "empty")
    spark.range(1).selectExpr("cast(id as string) as value").write.text(empty)
    found = []
    for name, path in (("missing file", f"{sf_dir}/no_such.parquet"), ("folder of no table", empty), ("nested columns", f"{sf_dir}/embeddings.parquet")):
        error = None
        try:
            open_table(spark, path)
        except OpenError as e:
            error = type(e).__name__
        found.append((name, error))
    return spark.createDataFrame(found, "path string, error string")
