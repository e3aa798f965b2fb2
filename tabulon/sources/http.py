"""Tables by http and https: fetched to a spool file, cancellable, with a closed set of failure causes.

A server that answers a range request with 206 and a total serves random access: then nothing is fetched up front, and each
Spark task reads its own byte ranges, a Parquet footer first. Any other success is downloaded in order to a spool file, which
Spark's tasks read, so on a cluster its folder must be a shared one.
"""

from __future__ import annotations

import http.client
import io
import os
import re
import socket
import tempfile
import threading
import urllib.error
import urllib.request
from collections import OrderedDict
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from enum import Enum
from urllib.parse import urljoin, urlparse

from tabulon.errors import NetworkCause, NetworkError

REDIRECTS = 3
PIECE = 256 << 10
CACHED = 64
TIMEOUT = 15.0


class Phase(Enum):
    PENDING = "pending"
    FETCHING = "fetching"
    DONE = "done"
    FAILED = "failed"
    CANCELLED = "cancelled"


@dataclass(frozen=True)
class Progress:
    phase: Phase
    received: int
    total: int | None
    error: NetworkError | None = None


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


_OPENER = urllib.request.build_opener(_NoRedirect)


def checked(url: str) -> str:
    parts = urlparse(url)
    if parts.scheme not in ("http", "https") or not parts.hostname:
        raise NetworkError(NetworkCause.INVALID_ARGUMENT, f"{url!r} is no http or https address")
    return url


def request(url: str, first: int = 0, last: int | None = None, timeout: float = TIMEOUT):
    """An open response after at most three redirects; never from https down to http."""
    checked(url)
    for _ in range(REDIRECTS + 1):
        ask = urllib.request.Request(url, headers={"Range": f"bytes={first}-{'' if last is None else last}", "Accept-Encoding": "identity"})
        try:
            return _OPENER.open(ask, timeout=timeout)
        except urllib.error.HTTPError as e:
            target = e.headers.get("Location")
            if e.code not in (301, 302, 303, 307, 308) or not target:
                raise NetworkError(NetworkCause.HTTP_STATUS, f"{e.code} from {url}", e.code) from e
            to = urljoin(url, target)
            if urlparse(url).scheme == "https" and urlparse(to).scheme == "http":
                raise NetworkError(NetworkCause.DOWNGRADE, to) from e
            url = checked(to)
        except urllib.error.URLError as e:
            timed_out = isinstance(e.reason, (socket.timeout, TimeoutError))
            raise NetworkError(NetworkCause.CONNECT_TIMEOUT if timed_out else NetworkCause.UNREACHABLE, str(e.reason)) from e
        except (OSError, http.client.HTTPException) as e:
            raise NetworkError(NetworkCause.IO, str(e)) from e
    raise NetworkError(NetworkCause.REDIRECTS, url)


def total_of(response) -> tuple[int | None, bool]:
    """(length of the whole body, whether ranges are served)."""
    if response.status == 206 and (m := re.fullmatch(r"bytes \d+-\d+/(\d+)", response.headers.get("Content-Range", ""))):
        return int(m[1]), True
    length = response.headers.get("Content-Length")
    return (int(length) if length and length.isdigit() else None), False


def tail(url: str, n: int) -> bytes | None:
    """The last bytes, for a footer, if the server serves ranges."""
    with request(url, 0, 0) as r:
        total, ranges = total_of(r)
    if not ranges or total is None:
        return None
    with request(url, max(0, total - n), total - 1) as r:
        return r.read()


def serves_ranges(url: str) -> bool:
    with request(url, 0, 0) as r:
        return total_of(r)[1]


class RangeFile(io.RawIOBase):
    """A remote file read by ranges, through a bounded cache of pieces."""

    def __init__(self, url: str, cached: int = CACHED) -> None:
        self.url, self.at, self.cached = checked(url), 0, cached
        self.held: OrderedDict[int, bytes] = OrderedDict()
        with request(url, 0, 0) as r:
            total, ranges = total_of(r)
        if not ranges or total is None:
            raise NetworkError(NetworkCause.IO, f"{url} doesn't serve ranges")
        self.total = total

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = max(0, offset + (0, self.at, self.total)[whence])
        return self.at

    def _piece(self, k: int) -> bytes:
        if k in self.held:
            self.held.move_to_end(k)
            return self.held[k]
        first = k * PIECE
        last = min(self.total, first + PIECE) - 1
        with request(self.url, first, last) as r:
            try:
                got = r.read()
            except http.client.HTTPException as e:
                raise NetworkError(NetworkCause.IO, str(e)) from e
        if len(got) != last - first + 1:
            raise NetworkError(NetworkCause.SHORT_BODY, f"{len(got)} of {last - first + 1} bytes")
        self.held[k] = got
        if len(self.held) > self.cached:
            self.held.popitem(last=False)
        return got

    def readinto(self, buffer) -> int:
        view, done = memoryview(buffer).cast("B"), 0
        while done < len(view) and self.at < self.total:
            piece = self._piece(self.at // PIECE)[self.at % PIECE :][: len(view) - done]
            view[done : done + len(piece)] = piece
            done, self.at = done + len(piece), self.at + len(piece)
        return done


class Fetch:
    """A download on its own thread."""

    def __init__(self, url: str, folder: str | None = None) -> None:
        self.url = checked(url)
        self._lock = threading.Lock()
        self._state = Progress(Phase.PENDING, 0, None)
        self._stop = threading.Event()
        handle, self.path = tempfile.mkstemp(prefix="tabulon-spool-", suffix=os.path.splitext(urlparse(url).path)[1], dir=folder)
        os.close(handle)
        pool = ThreadPoolExecutor(1)
        self.future: Future[str] = pool.submit(self._run)
        pool.shutdown(wait=False)

    def _set(self, *state) -> None:
        with self._lock:
            self._state = Progress(*state)

    def _run(self) -> str:
        got, total = 0, None
        try:
            if self._stop.is_set():
                raise NetworkError(NetworkCause.CANCELLED)
            with request(self.url) as r, open(self.path, "wb") as out:
                total, _ = total_of(r)
                self._set(Phase.FETCHING, got, total)
                while True:
                    if self._stop.is_set():
                        raise NetworkError(NetworkCause.CANCELLED)
                    try:
                        piece = r.read(PIECE)
                    except http.client.IncompleteRead as e:
                        raise NetworkError(NetworkCause.SHORT_BODY, f"{got + len(e.partial)} of {total} bytes") from e
                    except (OSError, http.client.HTTPException) as e:
                        raise NetworkError(NetworkCause.IO, str(e)) from e
                    if not piece:
                        break
                    out.write(piece)
                    got += len(piece)
                    self._set(Phase.FETCHING, got, total)
            if total is not None and got < total:
                raise NetworkError(NetworkCause.SHORT_BODY, f"{got} of {total} bytes")
            self._set(Phase.DONE, got, total)
            return self.path
        except NetworkError as e:
            self._set(Phase.CANCELLED if e.cause is NetworkCause.CANCELLED else Phase.FAILED, got, total, e)
            raise

    def poll(self) -> Progress:
        with self._lock:
            return self._state

    def cancel(self) -> None:
        self._stop.set()

    def result(self, timeout: float | None = None) -> str:
        """The spool file's path; raises what went wrong."""
        return self.future.result(timeout)

    def release(self) -> None:
        self.cancel()
        if os.path.exists(self.path):
            os.unlink(self.path)
