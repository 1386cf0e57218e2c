"""Errors. Every one has a message and a dict of details."""

from __future__ import annotations

from typing import Any


class EngineError(Exception):
    def __init__(self, message: str, details: dict[str, Any] | None = None):
        super().__init__(message)
        self.details = details or {}


class ConfigError(EngineError):
    """Invalid configuration."""


class DefinitionError(EngineError):
    """Definitions that do not compile or do not validate."""


class IngestError(EngineError):
    """Raw events that cannot be read at all."""


class ValidationError(EngineError):
    """Event data that fails its schema."""


class BuildError(EngineError):
    """A build that cannot go on."""


class StorageError(EngineError):
    """Reading or writing the store failed."""


class ConflictError(StorageError):
    """Another writer has committed this version."""


class IdentityError(EngineError):
    """Identity resolution failed."""


class NotFoundError(EngineError):
    """No such entity, version or resource."""


class QueryError(EngineError):
    """A query that names unknown tables or columns."""


class ConsumerError(EngineError):
    """Consuming a stream of effects failed."""
