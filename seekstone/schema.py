"""The five tables of an index, its parameters, and search modes."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from seekstone.errors import LexicalError, SeekstoneError

DOCUMENTS = "doc_id string, content string, metadata map<string,string>, seq bigint"
CHUNKS = (
    "chunk_id string, document_id string, content string, metadata map<string,string>, chunk_index int, "
    "total_chunks int, seq bigint"
)
VECTORS = "chunk_id string, embedding array<float>, seq bigint"
#: Length and order of the chunk stand beside each posting, so that scoring joins nothing but terms.
POSTINGS = "term string, chunk_id string, tf int, dl int, seq bigint"
LENGTHS = "chunk_id string, dl int, seq bigint"
RESULTS = (
    "query_id bigint, chunk_id string, document_id string, content string, score double, "
    "metadata map<string,string>, vector_score double, lexical_score double, rank int"
)


# The names of modes, metrics and strategies.


class SearchMode(str, Enum):
    VECTOR = "vector"
    BM25 = "bm25"
    HYBRID = "hybrid"


class DistanceMetric(str, Enum):
    COSINE = "cosine"
    IP = "inner_product"
    L2 = "l2"


class FusionStrategy(str, Enum):
    RRF = "rrf"
    LINEAR = "linear"


def coerce(kind: type[Enum], value: Any) -> Any:
    """A member, or its name as text in any case, with blanks around it."""
    if isinstance(value, kind):
        return value
    wanted = str(value).strip().lower()
    for member in kind:
        if member.value == wanted:
            return member
    raise SeekstoneError(f"{value!r} is no {kind.__name__}; valid: {[m.value for m in kind]}.")


@dataclass(frozen=True)
class Document:
    id: str
    content: str
    metadata: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class QueryResult:
    """A search hit; the score of a side is None where the chunk was outside that side's list."""

    chunk_id: str
    document_id: str
    content: str
    score: float
    metadata: dict[str, Any]
    vector_score: float | None = None
    lexical_score: float | None = None
    rank: int = 1


@dataclass(frozen=True)
class LexicalParams:
    """BM25's parameters.  Stop words are folded where words are."""

    k1: float = 1.5
    b: float = 0.75
    lowercase: bool = True
    stopwords: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.k1 < 0:
            raise LexicalError(f"k1 must be at least 0, not {self.k1!r}.")
        if not 0 <= self.b <= 1:
            raise LexicalError(f"b must be from 0 to 1, not {self.b!r}.")
        if self.lowercase:
            object.__setattr__(self, "stopwords", tuple(sorted({w.casefold() for w in self.stopwords})))
