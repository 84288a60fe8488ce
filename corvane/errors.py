"""Errors, named after the stage that raises them."""

from __future__ import annotations


class QueryError(Exception):
    """Any error of this library."""


class ParseError(QueryError):
    """The text is not a statement."""

    def __init__(self, message: str, at: int | None = None):
        super().__init__(message if at is None else f"{message} at character {at}")
        self.at = at


class BindError(QueryError):
    """The statement is well-formed but means nothing."""


class PlanError(QueryError):
    """The statement's shape is not supported."""


class ExecutionError(QueryError):
    """Parameters or data do not fit the statement."""


class BackendError(QueryError):
    """The collection refuses the change."""


class DuplicateId(BackendError):
    pass


class NotFound(BackendError):
    pass


class AlreadyDeleted(BackendError):
    pass


class DimensionMismatch(BackendError):
    pass


class InvalidVector(BackendError):
    pass


class IndexNameInUse(BackendError):
    pass


class IndexAlreadyExists(BackendError):
    pass


class UnknownIndexName(BackendError):
    pass


class ConcurrentCommit(BackendError):
    """Another writer published the same commit number first."""
