"""Exceptions of opening, requesting and fetching."""

from __future__ import annotations

from enum import Enum


class TabulonError(Exception):
    """Base of all errors raised here."""


class InvalidArgument(TabulonError, ValueError):
    """A request that is refused before any work; it changes no state."""


class OpenError(TabulonError):
    """A table that can't be opened."""


class NotFound(OpenError):
    pass


class PermissionDenied(OpenError):
    pass


class ReadFailed(OpenError):
    """An input or output error, directories among them."""


class UnsupportedSchema(OpenError):
    """Nested, encrypted or otherwise unreadable tables."""


class NoColumn(InvalidArgument):
    """A column number out of range."""


class NoProposal(TabulonError):
    """There is no pending type proposal for the column."""


class NetworkCause(Enum):
    INVALID_ARGUMENT = "invalid argument"
    UNREACHABLE = "host unreachable"
    CONNECT_TIMEOUT = "connection timed out"
    HTTP_STATUS = "unexpected HTTP status"
    REDIRECTS = "too many redirects"
    IO = "transfer failed"
    CANCELLED = "cancelled"
    DOWNGRADE = "redirect from https to http refused"
    SHORT_BODY = "body ended early"


class NetworkError(OpenError):
    def __init__(self, cause: NetworkCause, detail: str = "", status: int | None = None) -> None:
        super().__init__(f"{cause.value}{': ' + detail if detail else ''}")
        self.cause, self.status = cause, status
