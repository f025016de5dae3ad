"""Filters of chunks and documents as validated values that become one predicate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from heronmill.operators.retrieval import like_pattern

MOST_IDS = 200
STATUSES = ("pending", "processing", "ready", "failed")
KINDS = ("knowledge", "material")
SOURCES = ("manual", "import")


def distinct(values: Sequence) -> tuple:
    """First occurrences in order."""
    return tuple(dict.fromkeys(values))


@dataclass(frozen=True)
class ChunkFilter:
    """What a retrieval may see (B02, B03); id lists name materials that are hidden otherwise."""

    document_ids: tuple[int, ...] = ()
    source_types: tuple[str, ...] = ()
    created_from: datetime | None = None
    created_to: datetime | None = None
    owner_id: int = 0

    def __post_init__(self):
        object.__setattr__(self, "document_ids", distinct(self.document_ids))
        object.__setattr__(self, "source_types", distinct(s.strip() for s in self.source_types if s.strip()))
        if 0 in self.document_ids:
            raise ValueError("a document id is not 0")
        if len(self.document_ids) > MOST_IDS:
            raise ValueError(f"at most {MOST_IDS} document ids")
        if set(self.source_types) - set(SOURCES):
            raise ValueError("unknown source type")
        if self.created_from and self.created_to and self.created_from > self.created_to:
            raise ValueError("the time range ends before it begins")

    def predicate(self) -> Column:
        """Over the columns kind, enabled, status, source_type, document_id, created_at, owner_id."""
        out = F.col("enabled") & (F.col("status") == "ready")
        if self.document_ids:
            out &= F.col("document_id").isin(*self.document_ids)
        else:
            out &= F.col("kind") == "knowledge"
        if self.source_types:
            out &= F.col("source_type").isin(*self.source_types)
        if self.created_from:
            out &= F.col("created_at") >= F.lit(self.created_from)
        if self.created_to:
            out &= F.col("created_at") < F.lit(self.created_to)
        return out & owner_scope(self.owner_id)


def owner_scope(owner_id: int) -> Column:
    """Rows of an owner; all rows for 0."""
    return F.col("owner_id") == owner_id if owner_id else F.lit(True)


def parse_statuses(text: str) -> tuple[str, ...]:
    """A comma-separated list of known statuses."""
    found = distinct(s.strip() for s in text.split(",") if s.strip())
    if set(found) - set(STATUSES):
        raise ValueError("unknown status")
    return found


def document_predicate(statuses: Sequence[str] = (), kind: str = "", keyword: str = "") -> Column:
    """Conditions of a document list."""
    out = F.lit(True)
    if statuses:
        out &= F.col("status").isin(*statuses)
    if kind:
        if kind not in KINDS:
            raise ValueError("unknown kind")
        out &= F.col("kind") == kind
    if keyword.strip():
        like = like_pattern(keyword.strip())
        out &= F.col("title").ilike(like) | F.col("source_uri").ilike(like)
    return out
