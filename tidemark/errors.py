"""Errors of the engine. Messages name tables and columns, never host paths."""


class EngineError(Exception):
    """Base of all."""


class CorruptError(EngineError):
    """A listed file is missing or differs from what the manifest says."""


class NotFoundError(EngineError):
    """No such table, version or column."""


class InvalidArgError(EngineError, ValueError):
    """An option, bound or definition that can't be used."""


class ReadOnlyError(EngineError):
    """A change of rows in place."""


class UnsupportedError(EngineError):
    """A feature that the engine refuses."""


class ConflictError(EngineError):
    """Another writer committed first."""
