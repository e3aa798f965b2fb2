"""Bytes of a path, on the driver or an executor: local files, http servers with ranges, any file system that pyarrow opens."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

from tabulon.errors import NotFound, OpenError, PermissionDenied, ReadFailed

PIECE = 4 << 20


def _opened(path: str):
    scheme = urlparse(path).scheme
    if scheme in ("", "file"):
        return open(unquote(urlparse(path).path) if scheme else path, "rb")
    if scheme in ("http", "https"):
        from tabulon.sources.http import RangeFile

        return RangeFile(path)
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path)
    return where.open_input_file(inner)


def opened(path: str):
    """A seekable binary file; failures as this package's errors."""
    try:
        local = unquote(urlparse(path).path) if path.startswith("file:") else path
        if os.path.isdir(local):
            raise ReadFailed(f"{path} is a directory")
        return _opened(path)
    except FileNotFoundError as e:
        raise NotFound(path) from e
    except PermissionError as e:
        raise PermissionDenied(path) from e
    except OpenError:
        raise
    except (OSError, ValueError) as e:
        raise ReadFailed(f"{path}: {e}") from e


def size(path: str) -> int:
    with opened(path) as f:
        return f.seek(0, 2)


def head(path: str, n: int) -> bytes:
    with opened(path) as f:
        return f.read(n)


def pieces(path: str, start: int, stop: int) -> Iterator[bytes]:
    """The bytes [start, stop) in order; a file that has become shorter since its size was taken is an error, as fewer rows
    would else be read in silence."""
    with opened(path) as f:
        f.seek(start)
        while start < stop and (piece := f.read(min(PIECE, stop - start))):
            start += len(piece)
            yield piece
    if start < stop:
        raise ReadFailed(f"{path} ends at byte {start}, where {stop} were there when it was opened")
