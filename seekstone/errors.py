"""Exceptions.  Every error of the library derives from :class:`SeekstoneError`."""

from __future__ import annotations


class SeekstoneError(Exception):
    """Base of all errors of this library."""


class EmbeddingError(SeekstoneError):
    """An embedder can't be built or can't produce vectors."""


class VectorStoreError(SeekstoneError):
    """Vectors of a wrong shape, or a vector table that can't be read."""


class LexicalError(SeekstoneError):
    """Wrong lexical parameters, duplicate ids, or a lexical index that can't be read."""


class ChunkingError(SeekstoneError):
    """Wrong chunk size or overlap."""


class SerializationError(SeekstoneError):
    """A stored index has an unsupported schema or contradicts its manifest."""


class IncompatibleBackendError(SeekstoneError):
    """A stored index needs an embedder that isn't here or doesn't fit."""
