"""What operations report."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from typing import Any


@dataclass(frozen=True)
class EventFailure:
    raw: dict[str, Any]
    error: str
    stage: str = "normalization"
    source: str = ""
    handler: str | None = None
    field: str | None = None
    entity_id: str | None = None
    entity_type: str | None = None
    recoverable: bool = False


@dataclass(frozen=True)
class BuildResult:
    mode: str
    events_processed: int = 0
    effects_produced: int = 0
    entities_created: int = 0
    entities_updated: int = 0
    merges_detected: int = 0
    late_arrivals: int = 0
    duration_ms: int = 0
    events_failed: int = 0
    failures: list[EventFailure] = field(default_factory=list)
    timing: dict[str, float] = field(default_factory=dict)
    failures_path: str | None = None


@dataclass(frozen=True)
class IngestResult:
    events_ingested: int
    events_failed: int
    duplicates_skipped: int
    duplicate_ids: list[str] = field(default_factory=list)
    failures: list[EventFailure] = field(default_factory=list)
    build_result: BuildResult | None = None
    timing: dict[str, float] = field(default_factory=dict)
    failures_path: str | None = None


@dataclass(frozen=True)
class TickResult:
    effects_produced: int
    entities_affected: int
    transitions: int


@dataclass(frozen=True)
class MergeResult:
    from_entity_id: str
    into_entity_id: str
    events_reassigned: int
    entities_rebuilt: int
    tombstones_produced: int
    failures: list[EventFailure] = field(default_factory=list)


@dataclass(frozen=True)
class EraseResult:
    entity_id: str
    entities_erased: int
    events_deleted: int
    merge_log_cleaned: int


@dataclass(frozen=True)
class ConsumerResult:
    snapshots_processed: int
    tombstones_processed: int
    batches_written: int
    duration_ms: int


@dataclass(frozen=True)
class ConsumerStatus:
    lag: int
    last_offset: int
    last_write_time: datetime | None
    write_throughput: float


@dataclass(frozen=True)
class ValidationResult:
    valid: bool
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class TimelineEntry:
    timestamp: datetime
    event_type: str | None
    event_id: str | None
    effects: list[str]
    state_before: str | None
    state_after: str | None


@dataclass(frozen=True)
class Timeline:
    entity_id: str
    entity_type: str
    entries: list[TimelineEntry] = field(default_factory=list)


@dataclass(frozen=True)
class BuildStatus:
    cursor: int
    total_events: int
    pending_events: int
    last_build_time: datetime | None
    last_build_mode: str | None
    definition_hash: str
    source_hash: str
    identity_hash: str
    dirty: bool


@dataclass(frozen=True)
class RegisterResult:
    version: str
    changes: dict[str, Any]
    build_mode: str
    warnings: list[str] = field(default_factory=list)
