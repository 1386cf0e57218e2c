"""The engine: ingest, build, tick, merge, erase, redact and query, over files below one folder.

Everything is a frame written once and named by a manifest; an operation writes new files and commits the next manifest
version, so readers see it whole or not at all and a crash leaves the version before. The ledger keeps raw events. What is
derived from them is kept in parts (:mod:`chronofold.sources.parts`): an incremental build normalizes the ledger rows that
are new, extends identity by the links that they bring, and folds anew the entities that they touch, reading the events of
these entities' buckets; all else stays in the files where it is.
"""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Iterable
from dataclasses import replace
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.errors import ConfigError, ConflictError, DefinitionError, NotFoundError, QueryError, StorageError
from chronofold.functions.compile import spark_type
from chronofold.operators import graph as G
from chronofold.operators import history as H
from chronofold.operators import identity as I
from chronofold.plans.definitions import Definitions, Draft, build_mode, changes
from chronofold.plans.fold import EntityFold, links
from chronofold.query import Collection, Table, Views
from chronofold.results import BuildResult, BuildStatus, EraseResult, EventFailure, IngestResult, MergeResult, RegisterResult, TickResult, Timeline, TimelineEntry, ValidationResult
from chronofold.sources.manifest import ManifestStore
from chronofold.sources.normalize import HINT, Normalizer, failures, redacted
from chronofold.sources.parts import PARTS, Folder, bucket, part

LEDGER = "sequence long, event_id string, event_type string, ts timestamp, source string, raw string, hints array<" + HINT + ">, pinned boolean"
IDENTITY = "entity_type string, value string, field string, candidate string, entity_id string"
IDS = "sequence long, event_id string, duplicate_of long"
RENAMES = "from_entity_id string, into_entity_id string"
RELATIONS = "source_id string, target_id string, relationship_type string, valid_from timestamp, valid_to timestamp"
MERGES = "from_entity_id string, into_entity_id string, at timestamp, reason string"
REDACTED = "[REDACTED]"
#: Failures that a result lists; all of them are in its ``failures_path``, and counted.
TOLD = 100
log = logging.getLogger("chronofold")


def _utc(at: datetime | str | None) -> datetime:
    if at is None:
        return datetime.now(timezone.utc)
    got = datetime.fromisoformat(at.replace("Z", "+00:00")) if isinstance(at, str) else at
    return got if got.tzinfo else got.replace(tzinfo=timezone.utc)


class Engine:
    """definitions: a dict, a folder of YAML, or Definitions; root: the folder of the store; dead_letter: a folder, or a
    :class:`~chronofold.streaming.stream.Sink`, for failures; strict: refuse events that do not fit their schemas;
    batch_size: with ``ingest(..., process=True)``, events wait until so many are there (None: none waits);
    shard, shards: builds fold the entities that this shard owns, and tables show these; cold: a folder for the cold ledger.
    """

    def __init__(
        self, spark: SparkSession, definitions: dict | str | Definitions | None, root: str, *, version: str | None = None, dead_letter: Any = None, strict: bool = False,
        batch_size: int | None = None, shard: int | None = None, shards: int | None = None, cold: str | None = None,
    ):
        if (shard is None) != (shards is None) or shards is not None and not 0 <= shard < shards:
            raise ConfigError("shard and shards go together, shard from 0 up to shards")
        self.spark, self.root, self.dead_letter, self.strict = spark, root.rstrip("/"), dead_letter, strict
        self.batch_size, self.shard, self.shards, self.cold = batch_size, shard, shards, (cold or f"{self.root}/cold").rstrip("/")
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # all times are UTC
        self._manifest = ManifestStore(spark, f"{self.root}/manifest")
        self._folder = Folder(spark, self.root)
        self._buffer: list[tuple[str, dict[str, Any]]] = []
        self.definitions = DefinitionsManager(self)
        self.ledger, self.identity = LedgerView(self), IdentityView(self)
        if definitions is not None:
            defs = Definitions.load(definitions).check()
            name = version or defs.content_version()
            state = self._state()
            if name not in state["definitions"] or state["active"] != name:
                state["definitions"].setdefault(name, {"data": defs.to_dict(), "hashes": defs.hashes(), "created_at": str(_utc(None))})
                state["active"] = name
                self._commit(state)
            for warning in defs.validate().warnings:
                log.warning("definitions: %s", warning)
        elif not self._state()["active"]:
            raise ConfigError("a new store needs definitions")

    # state

    def _state(self) -> dict[str, Any]:
        self._base, found = self._manifest.read()
        start = {"definitions": {}, "active": None, "ledger": [], "head": 0, "forced": [], "builds": {}}
        return {**start, **found}

    def _commit(self, state: dict[str, Any]) -> None:
        self._base = self._manifest.commit(self._base, state)

    def _change(self, edit: Callable[[dict[str, Any]], None], tries: int = 50) -> dict[str, Any]:
        """Commit an edit of the newest state; where another writer was first, the edit is made on what that one left."""
        for _ in range(tries):
            state = self._state()
            edit(state)
            try:
                self._commit(state)
                return state
            except ConflictError:
                continue
        raise StorageError("other writers were first too often")

    def _save(self, df: DataFrame, what: str, by: list[str] | None = None) -> str:
        return self._folder.save(df, what, by)

    def _load(self, paths: str | list[str] | None, schema: str) -> DataFrame:
        return self._folder.frame(paths, schema)

    def _defs(self, version: str | None = None) -> Definitions:
        state = self._state()
        name = version or state["active"]
        if name not in state["definitions"]:
            raise NotFoundError(f"no version '{name}'", {"versions": sorted(state["definitions"])})
        return Definitions(state["definitions"][name]["data"])

    def _build_key(self, version: str) -> str:
        return version if self.shards is None else f"{version}#{self.shard}/{self.shards}"

    def _build_of(self, state: dict[str, Any], version: str | None = None) -> dict[str, Any]:
        return state["builds"].get(self._build_key(version or state["active"]), {})

    # ingest

    def ingest(self, source: str, events: Iterable[dict[str, Any]] | DataFrame, process: bool | None = None) -> IngestResult:
        """Append raw events to the ledger; with ``process`` build at once. Events whose id is there already are skipped.

        events: dicts, or a frame with a column ``raw`` of JSON text. Failures never stop the others. With ``process`` and
        a batch size dicts wait in this engine until a batch is full; a build, a reader or ``close`` takes in what waits.
        """
        if source not in self._defs().sources:
            raise NotFoundError(f"no source '{source}'", {"sources": sorted(self._defs().sources)})
        if process and self.batch_size and not isinstance(events, DataFrame):
            new = list(events)
            self._buffer += [(source, e) for e in new]
            full = len(self._buffer) // self.batch_size * self.batch_size
            if not full:
                return IngestResult(len(new), 0, 0)
            batch, self._buffer = self._buffer[:full], self._buffer[full:]
            return self._take_in(batch)
        with self._folder.writing():
            done = self._append(source, events)
        return replace(done, build_result=self.build()) if process else done

    def _append_all(self, batch: list[tuple[str, dict[str, Any]]]) -> list[IngestResult]:
        by_source: dict[str, list[dict[str, Any]]] = {}
        for source, event in batch:
            by_source.setdefault(source, []).append(event)
        return [self._append(source, own) for source, own in by_source.items()]

    def _take_in(self, batch: list[tuple[str, dict[str, Any]]]) -> IngestResult:
        """A batch of events of several sources, each source once, and one build."""
        with self._folder.writing():
            done, build = self._append_all(batch), self._built()
        return IngestResult(
            sum(d.events_ingested for d in done), sum(d.events_failed for d in done), sum(d.duplicates_skipped for d in done), [x for d in done for x in d.duplicate_ids][:TOLD], [x for d in done for x in d.failures][:TOLD], build,
            {k: sum(d.timing.get(k, 0) for d in done) for k in {k for d in done for k in d.timing}}, next((d.failures_path for d in done if d.failures_path), None),
        )

    def flush(self) -> IngestResult | None:
        """Take in what waits, be it less than a batch, and build."""
        batch, self._buffer = self._buffer, []
        return self._take_in(batch) if batch else None

    def _append(self, source: str, events: Iterable[dict[str, Any]] | DataFrame) -> IngestResult:
        started = time.time()
        if isinstance(events, DataFrame):
            raw = events.select("raw").withColumn("_at", F.monotonically_increasing_id())
        else:
            raw = self.spark.createDataFrame([(i, json.dumps(e, default=str)) for i, e in enumerate(events)], "_at long, raw string").select("raw", "_at")
        staged = self._folder.kept(Normalizer(self._defs(), strict=self.strict).normalize(raw, source).drop("data"), "staged")
        failed_rows = failures(staged)
        n_failed, told, failures_path = failed_rows.count(), [], None
        if n_failed:
            failures_path = self._save(failed_rows, "failures")
            told = [EventFailure(json.loads(r["raw"]) if (r["raw"] or "").startswith("{") else {"raw": r["raw"]}, r["error"], "normalization", source) for r in failed_rows.limit(TOLD).collect()]
            if isinstance(self.dead_letter, str):
                failed_rows.write.mode("append").json(self.dead_letter)
            elif self.dead_letter is not None:
                self.dead_letter.write(failed_rows, key="source")
        good = staged.filter("error is null")
        first = good.groupBy("event_id").agg(F.min("_at").alias("_at"))
        n_good = good.count()
        while True:
            state = self._state()
            known = self._ledger_frame(state).select("event_id")
            numbered, count = self._number(good.join(first, ["event_id", "_at"], "left_semi").join(known, "event_id", "left_anti"), state["head"])
            if not count:
                break
            rows = self._save(numbered.select("sequence", "event_id", "event_type", "ts", "source", "raw", "hints", F.lit(False).alias("pinned")), "ledger")
            state["ledger"].append({**part(rows), "lo": state["head"] + 1, "hi": state["head"] + count, "tier": "hot"})
            state["head"] += count
            try:
                self._commit(state)
                break
            except ConflictError:  # numbers were given out on another state: again, on what is there now
                continue
        duplicates = [r[0] for r in good.select("event_id", "_at").exceptAll(numbered.select("event_id", "_at")).select("event_id").limit(TOLD).collect()] if n_good > count else []
        if failures_path:
            self._change(lambda s: s.setdefault("failures", []).append(failures_path))
        log.info("ingested %d events of %s, %d failed, %d were there", count, source, n_failed, n_good - count)
        return IngestResult(count, n_failed, n_good - count, duplicates, told, None, {"total_ms": (time.time() - started) * 1000}, failures_path)

    def _number(self, df: DataFrame, head: int) -> tuple[DataFrame, int]:
        """Sequences in order of arrival: a count for each partition of the arrival order, and a row number within it; no global sort in one task."""
        ordered = df.repartitionByRange(F.col("_at")).sortWithinPartitions("_at").withColumn("_id", F.monotonically_increasing_id())
        kept = self._folder.kept(ordered, "numbered").withColumn("_p", F.shiftright("_id", 33)).withColumn("_r", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
        counts = {r["_p"]: r["n"] for r in kept.groupBy("_p").agg(F.count("*").alias("n")).collect()}
        starts, total = {}, 0
        for p in sorted(counts):
            starts[p] = total
            total += counts[p]
        base = F.coalesce(*(F.when(F.col("_p") == p, F.lit(s)) for p, s in starts.items())) if starts else F.lit(0)
        return kept.withColumn("sequence", F.lit(head + 1) + base + F.col("_r")), total

    # what is kept

    def _ledger_frame(self, state: dict[str, Any], above: int = 0) -> DataFrame:
        """Ledger rows with a sequence over ``above``; batches that end before it are not opened."""
        parts = [p for p in state["ledger"] if p["hi"] > above or p["gone"]]
        rows = self._folder.read(parts, LEDGER, "sequence", "long")
        return rows.filter(F.col("sequence") > above) if above else rows

    def _normalized(self, rows: DataFrame, defs: Definitions) -> DataFrame:
        """Ledger rows with data and hints under some definitions; those with an error are left out.

        Pinned rows (redacted ones, and those that lost an erased entity's names) keep the id, time and hints that the ledger has.
        """
        norm = Normalizer(defs)
        parts = []
        for name in defs.sources:
            own = rows.filter(F.col("source") == name).select("sequence", "raw", "pinned", F.col("event_id").alias("_id0"), F.col("ts").alias("_ts0"), F.col("hints").alias("_hints0"))
            made = norm.normalize(own, name).filter("error is null or pinned and event_type is not null")
            kept = lambda now, was: F.when(F.col("pinned"), F.col(was)).otherwise(F.col(now)).alias(now)
            parts.append(made.select("sequence", kept("event_id", "_id0"), "event_type", kept("ts", "_ts0"), "source", "data", kept("hints", "_hints0")))
        if not parts:
            return self.spark.createDataFrame([], f"sequence long, event_id string, event_type string, ts timestamp, source string, data {norm.schema()}, hints array<{HINT}>")
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        return found

    @staticmethod
    def _events_schema(defs: Definitions) -> str:
        return f"entity_id string, sequence long, event_id string, event_type string, ts timestamp, source string, data {Normalizer(defs).schema()}, hints array<{HINT}>, entity_type string, bucket int"

    def _events(self, build: dict[str, Any], defs: Definitions, within: list[int] | None = None) -> DataFrame:
        """A row for each event and entity of it, as :meth:`_build` wrote them: under the id that the entity had then."""
        return self._folder.read(build.get("events", []), self._events_schema(defs), "sequence", "long", within)

    def _renames(self, build: dict[str, Any]) -> DataFrame:
        return self._load(build.get("renames"), RENAMES)

    def _now_named(self, df: DataFrame, build: dict[str, Any], column: str = "entity_id") -> DataFrame:
        """Ids as they are now, after the merges since the rows were written."""
        if not build.get("renames"):
            return df
        now = self._renames(build).select(F.col("from_entity_id").alias(column), F.col("into_entity_id").alias("_into"))
        return df.join(now, column, "left").withColumn(column, F.coalesce("_into", column)).drop("_into").select(df.columns)

    def _identity(self, build: dict[str, Any]) -> DataFrame:
        return self._now_named(self._folder.read(build.get("identity", []), IDENTITY, "entity_id"), build)

    def _members(self, build: dict[str, Any], defs: Definitions) -> DataFrame:
        """(sequence, entity_type, entity_id): which entities an event belongs to."""
        return self._now_named(self._events(build, defs).select("sequence", "entity_type", "entity_id"), build)

    def _events_of(self, build: dict[str, Any], defs: Definitions, ids: DataFrame) -> DataFrame:
        """Events of some entities (column ``entity_id``) under their ids of now, read from these entities' buckets."""
        stored = ids.select(F.col("entity_id").alias("_as"), "entity_id")
        if build.get("renames"):
            stored = stored.unionByName(self._renames(build).join(ids.withColumnRenamed("entity_id", "into_entity_id"), "into_entity_id", "left_semi").select(F.col("from_entity_id").alias("_as"), F.col("into_entity_id").alias("entity_id")))
        stored = self._folder.kept(stored.distinct(), "stored")
        rows = self._events(build, defs, self._folder.buckets_of(stored, "_as")).withColumnRenamed("entity_id", "_as")
        return rows.join(stored, "_as").drop("_as", "bucket")

    def _forced(self, state: dict[str, Any], build: dict[str, Any] | None = None) -> DataFrame | None:
        if not state["forced"]:
            return None
        forced = self.spark.createDataFrame([(f["from"], f["into"], f["entity_type"]) for f in state["forced"]], "loser string, winner string, entity_type string")
        return self._now_named(self._now_named(forced, build, "loser"), build, "winner") if build else forced

    def _as_parts(self, parts: list[dict[str, Any]], new: dict[str, Any]) -> list[dict[str, Any]]:
        return [*parts, new] if new["rows"] or new["gone"] else parts

    # build

    def build(self, version: str | None = None, full: bool = False, from_raw: bool = False) -> BuildResult:
        """Bring histories up to date: all of them, or those of the entities with new events, new names or new parts.

        full: fold all entities anew; from_raw: normalize the whole ledger anew before. An entity's events are always
        folded from the first, so late events need no case of their own.
        """
        with self._folder.writing():
            waiting, self._buffer = self._buffer, []
            self._append_all(waiting)
            return self._built(version, full, from_raw)

    def _built(self, version: str | None = None, full: bool = False, from_raw: bool = False) -> BuildResult:
        started = time.time()
        state = self._state()
        version = version or state["active"]
        defs = self._defs(version)
        old = self._build_of(state, version)
        hashes, head = defs.hashes(), state["head"]
        mode, _ = build_mode(old.get("hashes"), hashes)
        if old and (from_raw or old.get("stale")):
            mode = "FULL_RENORMALIZE"
        elif mode == "INCREMENTAL" and (full or old.get("dirty")):
            mode = "FULL"
        if mode == "INCREMENTAL" and old["cursor"] >= head and not old.get("pending"):
            return BuildResult("SKIP")
        incremental, reuse = mode == "INCREMENTAL", bool(old) and mode in ("INCREMENTAL", "FULL")
        cursor = old["cursor"] if reuse else 0
        build: dict[str, Any] = {"hashes": hashes, "cursor": head, "mode": mode, "time": str(_utc(None)), "dirty": False, "pending": []}

        # ledger rows that are new to this build; of equal ids the earliest counts
        rows = self._folder.kept(self._normalized(self._ledger_frame(state, cursor), defs), "normalized")
        ids = self._folder.read(old.get("ids", []) if reuse else [], IDS, "sequence", "long")
        first = rows.groupBy("event_id").agg(F.min("sequence").alias("_first"))
        first = first.join(ids.filter("duplicate_of is null").select("event_id", F.col("sequence").alias("_was")), "event_id", "left").select("event_id", F.coalesce("_was", "_first").alias("_first"))
        new_ids = self._folder.kept(rows.select("sequence", "event_id").join(first, "event_id").select("sequence", "event_id", F.when(F.col("sequence") != F.col("_first"), F.col("_first")).alias("duplicate_of")), "ids")
        build["ids"] = [*(old.get("ids", []) if reuse else []), part(new_ids.inputFiles())]
        fresh = rows.join(new_ids.filter("duplicate_of is null").select("sequence"), "sequence", "left_semi")
        processed = new_ids.filter("duplicate_of is null").count()
        watermark = old.get("watermark") if incremental else None
        late = fresh.filter(F.col("ts") < F.lit(watermark).cast("timestamp")).count() if watermark else 0
        span = fresh.agg(F.min("ts"), F.max("ts")).first()
        build["watermark"] = max(filter(None, [old.get("watermark") if reuse else None, str(span[1]) if span[1] else None]), default=None)

        # which entities they belong to
        if incremental:
            known = self._identity(old)
            added, renames = I.extend(fresh, known.select("entity_type", "value", "entity_id"), self._forced(state, old))
            renames = self._folder.kept(renames, "renames")
            n_merged = renames.count()
            build["identity"] = [*old["identity"], part(self._save(added.select([c.split()[0] for c in IDENTITY.split(", ")]), "identity"))]
            build["renames"] = old.get("renames")
            if n_merged:
                further = self._renames(old).join(renames.select(F.col("from_entity_id").alias("into_entity_id"), F.col("into_entity_id").alias("_to")), "into_entity_id", "left")
                build["renames"] = self._save(further.select("from_entity_id", F.coalesce("_to", "into_entity_id").alias("into_entity_id")).unionByName(renames), "renames")
        else:
            every = fresh
            if reuse:
                every = self._folder.kept(fresh.unionByName(self._events(old, defs).select(fresh.columns).dropDuplicates(["sequence"])), "every")
            identity = self._folder.kept(I.resolve(every, self._forced(state)), "identity")
            build["identity"], build["renames"] = [part(identity.inputFiles())], None
            renames = None
            if old.get("identity") and mode != "FULL_WITH_IDENTITY_RESET":
                renames = self._folder.kept(I.merge_log(self._identity(old), identity), "renames")
            n_merged = renames.count() if renames is not None else 0
            fresh = every
        members = I.event_entities(fresh, self._identity(build))
        dealt = fresh.join(members, "sequence").withColumn("bucket", bucket("entity_id"))
        names = [f.name for f in T.StructType.fromDDL(self._events_schema(defs)).fields]
        events_path = self._save(dealt.select(names), "events", ["entity_type", "bucket"])
        build["events"] = [*(old["events"] if incremental else []), part(events_path)]

        touched: DataFrame | None = None
        if incremental:
            mine = self._load(events_path, self._events_schema(defs)).select("entity_id")
            waiting = self._now_named(self._load(old.get("pending"), "entity_id string"), build)
            touched = self._folder.kept(mine.unionByName(waiting).unionByName(renames.select(F.col("into_entity_id").alias("entity_id"))).distinct(), "touched")

        at = span[0] or _utc(None).replace(tzinfo=None)
        build["merges"] = list(old.get("merges", []))
        lost: DataFrame | None = None
        if n_merged:
            reasons = self.spark.createDataFrame([(f["from"], f["into"], f.get("reason") or "") for f in state["forced"]], "from_entity_id string, _winner string, reason string")
            by_hand = reasons.groupBy("from_entity_id").agg(F.first("reason").alias("reason"))
            lost = renames.join(by_hand, "from_entity_id", "left").select("from_entity_id", "into_entity_id", F.lit(at).alias("at"), F.coalesce("reason", F.lit("shared hint")).alias("reason"))
            build["merges"].append(self._save(lost, "merges"))
            lost = self._load(build["merges"][-1], MERGES)
        counts, failed, failure_paths = self._fold(state, defs, version, old, build, touched, lost, mode)
        self._tidy(build, defs)

        def put(now: dict[str, Any]) -> None:
            now["builds"][self._build_key(version)] = build

        self._change(put)
        log.info("build %s of %s: %d events, %d effects, %d merges, %d late, %d failed", mode, version, processed, counts["effects"], n_merged, late, counts["failed"])
        return BuildResult(mode, processed, counts["effects"], counts["created"], counts["updated"], n_merged, late, int((time.time() - started) * 1000), counts["failed"], failed, failures_path=failure_paths[0] if failure_paths else None)

    def _fold(self, state: dict, defs: Definitions, version: str, old: dict, build: dict, touched: DataFrame | None, lost: DataFrame | None, mode: str) -> tuple[dict[str, int], list[EventFailure], list[str]]:
        """Histories and relationships of the entities in ``touched`` (None: of all), as parts of the build."""
        counts = {"created": 0, "updated": 0, "effects": 0, "failed": 0}
        failed: list[EventFailure] = []
        failure_paths: list[str] = []
        build["history"], relations = {}, None
        kinds, now = defs.field_kinds(), F.lit(_utc(None)).cast("timestamp")
        identity = self._identity(build)
        events = self._events_of(build, defs, touched) if touched is not None else self._now_named(self._events(build, defs).drop("bucket"), build)
        if self.shards is not None:
            events = events.filter(I.shard_of(F.col("entity_id"), self.shards) == self.shard)
        gone_ids = touched
        if touched is not None and lost is not None:
            gone_ids = touched.unionByName(lost.select(F.col("from_entity_id").alias("entity_id"))).distinct()
        buckets = self._folder.buckets_of(gone_ids, "entity_id") if gone_ids is not None else None
        for name, entity in defs.entities.items():
            key = f"{name}_id"
            own = events.filter(F.col("entity_type") == name).withColumnRenamed("sequence", "seq")
            keyed = self._folder.kept(self._linked(own, entity, identity), f"{name}-keyed")
            if (touched is not None or not old) and keyed.isEmpty():  # nothing of this type to fold
                gone = self._save(gone_ids.select(F.col("entity_id").alias(key)), "gone") if gone_ids is not None and old["history"].get(name) else None
                build["history"][name] = self._as_parts(list(old.get("history", {}).get(name, [])), part(None, gone))
                continue
            rows, rels, errors = H.build_history(keyed, EntityFold(entity, kinds, now), keep=lambda df, name=name: self._folder.kept(df, f"{name}-folded"))
            rebuilt = self._folder.kept(rows, f"{name}-rows")
            before = self._history_frame(old, name, defs, buckets)
            if gone_ids is not None:
                before = before.join(gone_ids.withColumnRenamed("entity_id", key), key, "left_semi")
            before_ids, new_ids = before.select(key).distinct(), rebuilt.select(key).distinct()
            counts["effects"] += rebuilt.count()
            n_new, n_known = new_ids.join(before_ids.withColumn("_was", F.lit(1)), key, "left").agg(F.count("*"), F.count("_was")).first()
            counts["created"] += n_new - n_known
            counts["updated"] += n_known
            whole = rebuilt
            if lost is not None:
                ended = before.join(lost.select(F.col("from_entity_id").alias(key)), key, "left_semi")
                whole = whole.unionByName(H.tombstones(ended, key, lost))
            if touched is None and mode != "FULL_WITH_IDENTITY_RESET":
                stones = before.filter("merged_into is not null").join(new_ids, key, "left_anti")
                # of winners that are there still, or were merged on themselves
                winners = new_ids.unionByName(stones.select(key)).distinct().select(F.col(key).alias("merged_into"))
                stones = stones.join(winners, "merged_into", "left_semi").select(whole.columns)
                whole = whole.unionByName(stones)
            path = self._save(whole.withColumn("bucket", bucket(key)), f"{name}-history", ["bucket"])
            if touched is None:
                build["history"][name] = [part(path)]
            else:
                gone = self._save(gone_ids.select(F.col("entity_id").alias(key)), "gone")
                build["history"][name] = [*old["history"].get(name, []), part(path, gone)]
            wrong = self._folder.kept(errors, f"{name}-failures")
            n = wrong.count()
            if n:
                counts["failed"] += n
                failure_paths += wrong.inputFiles()[:1]
                failed += [EventFailure({}, r["error"], "interpretation", entity_id=r["entity_id"], entity_type=name) for r in wrong.limit(TOLD).collect()]
            relations = rels if relations is None else relations.unionByName(rels)
        build["relations"] = list(old.get("relations", [])) if touched is not None else []
        if relations is None and gone_ids is not None and build["relations"]:
            build["relations"].append(part(None, self._save(gone_ids.select(F.col("entity_id").alias("source_id")), "gone")))
        if relations is not None:
            gone = self._save(gone_ids.select(F.col("entity_id").alias("source_id")), "gone") if gone_ids is not None else None
            build["relations"] = self._as_parts(build["relations"], part(self._save(relations.select([c.split()[0] for c in RELATIONS.split(", ")]), "relations"), gone))
        return counts, failed[:TOLD], failure_paths

    def _tidy(self, build: dict[str, Any], defs: Definitions, always: bool = False) -> None:
        """Write a table of many parts as one. With events and identity the ids of now are written, and the renames end."""
        many = lambda parts: len(parts) > (1 if always else PARTS)
        for name, parts in build["history"].items():
            if many(parts):
                build["history"][name] = [part(self._save(self._history_frame(build, name, defs).withColumn("bucket", bucket(f"{name}_id")), f"{name}-history", ["bucket"]))]
        if many(build["relations"]):
            build["relations"] = [part(self._save(self._relations_of(build), "relations"))]
        if many(build["ids"]):
            build["ids"] = [part(self._save(self._folder.read(build["ids"], IDS, "sequence", "long"), "ids"))]
        if many(build["events"]) or many(build["identity"]):
            names = [f.name for f in T.StructType.fromDDL(self._events_schema(defs)).fields]
            events = self._now_named(self._events(build, defs), build).withColumn("bucket", bucket("entity_id")).select(names)
            events_path = self._save(events, "events", ["entity_type", "bucket"])
            identity_path = self._save(self._identity(build), "identity")
            build["events"], build["identity"], build["renames"] = [part(events_path)], [part(identity_path)], None

    def compact(self) -> None:
        """Write ledger, events, identity and histories each as one part, so that rows which were erased or redacted leave the files; :meth:`vacuum` then deletes the old ones."""
        self.flush()
        with self._folder.writing():
            state = self._state()
            self.ledger.compact()
            for key in list(state["builds"]):
                version = key.split("#")[0]
                build = dict(state["builds"][key], history=dict(state["builds"][key]["history"]))
                self._tidy(build, self._defs(version), always=True)
                self._change(lambda now, key=key, build=build: now["builds"].__setitem__(key, build))

    def _linked(self, events: DataFrame, entity: Any, identity: DataFrame) -> DataFrame:
        """Events with the entities that relate effects resolve to: the first hint field whose value is known for the target."""
        for column, effect in links(entity).items():
            found = []
            for i, name in enumerate(effect.hints.get(effect.target, ())):
                if name not in events.schema["data"].dataType.names:
                    continue
                ids = identity.filter(F.col("entity_type") == effect.target).select(F.col("value").alias(f"_v{i}"), F.col("entity_id").alias(f"_t{i}"))
                events = events.join(ids, F.col(f"data.{name}").cast("string") == F.col(f"_v{i}"), "left").drop(f"_v{i}")
                found.append(f"_t{i}")
            events = events.withColumn(column, F.coalesce(*found) if found else F.lit(None).cast("string")).drop(*found)
        return events

    # reading

    def _history_schema(self, defs: Definitions, name: str) -> T.StructType:
        props = defs.entities[name].properties
        own = [f"`{name}_id` string", f"`{name}_state` string", *(f"`{p}` {spark_type(s.type)}" for p, s in props.items())]
        return T.StructType.fromDDL(", ".join([*own, "valid_from timestamp, valid_to timestamp, merged_into string, last_event_time timestamp, state_entered_time timestamp, created_time timestamp"]))

    def _history_frame(self, build: dict[str, Any], name: str, defs: Definitions, within: list[int] | None = None) -> DataFrame:
        if name not in defs.entities:
            raise QueryError(f"unknown entity '{name}'; there are {sorted(defs.entities)}", {"entities": sorted(defs.entities)})
        schema = self._history_schema(defs, name)
        dealt = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields), "bucket int"])
        return self._folder.read(build.get("history", {}).get(name, []), dealt, f"{name}_id", within=within).select(schema.names)

    def _relations_of(self, build: dict[str, Any]) -> DataFrame:
        return self._folder.read(build.get("relations", []), RELATIONS, "source_id").select([c.split()[0] for c in RELATIONS.split(", ")])

    def _relations(self, version: str | None = None) -> DataFrame:
        self.flush()
        return self._relations_of(self._build_of(self._state(), version))

    def history(self, entity: str, version: str | None = None) -> Table:
        """All rows of an entity's history."""
        self.flush()
        state = self._state()
        version = version or state["active"]
        return Table(self._history_frame(self._build_of(state, version), entity, self._defs(version)), entity)

    def table(self, entity: str, version: str | None = None) -> Table:
        """Rows that are valid now."""
        full = self.history(entity, version)
        return Table(full.df.filter("valid_to is null"), entity, full.df)

    def tables(self, *entities: Any, relationships: bool = True, version: str | None = None) -> Collection:
        names = [n for e in entities for n in (e if isinstance(e, (list, tuple, set)) else [e])] or list(self._defs(version).entities)
        return Collection({n: self.table(n, version) for n in names}, self._relations(version) if relationships else None)

    def _views(self, version: str | None = None) -> dict[str, DataFrame]:
        found: dict[str, DataFrame] = {}
        for name in self._defs(version).entities:
            full = self.history(name, version).df
            found |= {name: full.filter("valid_to is null"), f"{name}_history": full}
        return {**found, "relationships": self._relations(version)}

    def query(self, sql: str, version: str | None = None) -> Table:
        """SQL over the entities' tables, their ``_history`` and ``relationships``."""
        self.flush()
        return Views(self.spark, lambda: self._views(version)).query(sql)

    def version(self, name: str) -> VersionView:
        self._defs(name)
        return VersionView(self, name)

    # graph

    def _edges(self) -> DataFrame:
        return self._relations().filter("valid_to is null").select("source_id", "target_id", "relationship_type").distinct()

    def traverse(self, entity_id: str, relationship: str | None = None, depth: int = 1) -> Table:
        known = {r.type for e in self._defs().entities.values() for r in e.relationships}
        if relationship is not None and relationship not in known:
            raise ValueError(f"unknown relationship '{relationship}' ({sorted(known)})")
        return Table(G.traverse(self._edges(), entity_id, relationship, depth))

    def path(self, a: str, b: str, max_depth: int = 20) -> list[str]:
        return G.path(self._edges(), a, b, max_depth)

    def neighbors(self, entity_id: str) -> Table:
        return Table(G.neighbors(self._edges(), entity_id))

    def related(self, entity_id: str, relationship: str) -> Table:
        target = next((r.target for e in self._defs().entities.values() for r in e.relationships if r.type == relationship), None)
        if target is None:
            raise ValueError(f"unknown relationship '{relationship}'")
        return Table(G.related(self._edges(), self.table(target).df, f"{target}_id", entity_id, relationship), target)

    @property
    def graph(self) -> GraphView:
        return GraphView(self)

    # time

    def tick(self, as_of: datetime | str | None = None, entity_ids: list[str] | None = None) -> TickResult:
        """Apply overdue time rules to entities as they stand; their new rows begin at ``as_of``."""
        moment = _utc(as_of)
        self.flush()
        with self._folder.writing():
            state = self._state()
            version, defs, build = state["active"], self._defs(), self._build_of(state)
            if not build:
                return TickResult(0, 0, 0)
            effects = transitions = 0
            at = F.lit(moment).cast("timestamp")
            new: dict[str, dict[str, Any]] = {}
            for name, entity in defs.entities.items():
                fold = EntityFold(entity, defs.field_kinds(), at)
                if not fold.has_rules:
                    continue
                key = f"{name}_id"
                full = self._history_frame(build, name, defs)
                rows = H.current(full)
                if entity_ids is not None:
                    rows = rows.join(self.spark.createDataFrame([(i,) for i in entity_ids], f"{key} string"), key, "left_semi")
                start = {"alive": F.lit(True), "state": F.col(f"{name}_state"), "entered": F.col("state_entered_time"), "created": F.col("created_time"), "last": F.col("last_event_time"), "changed": F.lit(False), "fired": F.lit(False), "rels": F.array(), **{f"p_{p}": F.col(p) for p in entity.properties}}
                before = F.struct(*(start.get(n, F.lit(None)).cast(t).alias(n) for n, t in fold.types.items()))
                ticked = rows.select(key, "valid_from", F.struct(F.col(f"{name}_state").alias("state")).alias("_was"), before.alias("_s")).withColumn("_s", fold.time_rules(F.col("_s"), at)).filter("_s.fired and _s.err is null")
                made = ticked.select(key, F.col("_s.state").alias(f"{name}_state"), *(F.col(f"_s.p_{p}").alias(p) for p in entity.properties), F.greatest(at, "valid_from").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.lit(None).cast("string").alias("merged_into"), F.col("_s.entered").alias("last_event_time"), F.col("_s.entered").alias("state_entered_time"), F.col("_s.created").alias("created_time"), (F.col("_was.state") != F.col("_s.state")).alias("_moved"))
                made = self._folder.kept(made, f"{name}-tick")
                n, moved = made.agg(F.count("*"), F.count_if("_moved")).first()
                if not n:
                    continue
                effects, transitions = effects + n, transitions + moved
                made = made.drop("_moved")
                ended = made.select(key, F.col("valid_from").alias("_end"))
                own = full.join(ended, key)
                closed = own.withColumn("valid_to", F.when(F.col("valid_to").isNull() & F.col("merged_into").isNull(), F.col("_end")).otherwise(F.col("valid_to"))).drop("_end").select(full.columns)
                whole = closed.filter("valid_to is null or valid_to != valid_from").unionByName(made).withColumn("bucket", bucket(key))
                new[name] = part(self._save(whole, f"{name}-history", ["bucket"]), self._save(ended.select(key), "gone"))

            def put(now: dict[str, Any]) -> None:
                for name, p in new.items():
                    now["builds"][self._build_key(version)]["history"][name].append(p)

            if effects:
                self._change(put)
        log.info("tick as of %s: %d effects, %d transitions", moment, effects, transitions)
        return TickResult(effects, effects, transitions)

    # governance

    def _type_of(self, state: dict[str, Any], entity_id: str) -> str:
        row = self._identity(self._build_of(state)).filter(F.col("entity_id") == entity_id).first()
        if row is None:
            raise NotFoundError(f"no entity '{entity_id}'", {"entity_id": entity_id})
        return row["entity_type"]

    def _one(self, *ids: str) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "entity_id string")

    def merge(self, from_entity_id: str, into_entity_id: str, reason: str = "") -> MergeResult:
        """Make one entity part of another; the winner is folded anew from the events of both."""
        self.flush()
        state = self._state()
        kind = self._type_of(state, into_entity_id)
        if self._type_of(state, from_entity_id) != kind:
            raise ConfigError("entities of different types cannot merge")
        moved = self._events_of(self._build_of(state), self._defs(), self._one(from_entity_id)).count()
        with self._folder.writing():
            both = self._save(self._one(from_entity_id, into_entity_id), "pending")

            def put(now: dict[str, Any]) -> None:
                now["forced"].append({"from": from_entity_id, "into": into_entity_id, "entity_type": kind, "reason": reason, "at": str(_utc(None))})
                for build in now["builds"].values():
                    build["pending"] = [*build.get("pending", []), both]

            self._change(put)
            result = self._built()
        return MergeResult(from_entity_id, into_entity_id, moved, 1, 1 if result.merges_detected else 0, result.failures)

    def _erased(self, entity_id: str, merges: DataFrame) -> DataFrame:
        """An entity and, round by round, what was merged into it."""
        found = self._folder.kept(self._one(entity_id), "erased")
        while True:
            more = merges.join(found.withColumnRenamed("entity_id", "into_entity_id"), "into_entity_id", "left_semi").select(F.col("from_entity_id").alias("entity_id")).distinct()
            more = self._folder.kept(more.join(found, "entity_id", "left_anti"), "erased")
            if more.isEmpty():
                return found
            found = self._folder.kept(found.unionByName(more), "erased")

    def erase(self, entity_id: str) -> EraseResult:
        """Remove an entity and those merged into it: names, history, relationships, and events that are no other entity's.

        Events that stay for another entity lose this one's names, so no later build brings it back. What is gone is so for
        every reader at once; it leaves the files with :meth:`compact` and :meth:`vacuum`. Other versions and shards are
        built anew from the ledger when they are built next.
        """
        self.flush()
        state = self._state()
        self._type_of(state, entity_id)
        version, defs = state["active"], self._defs()
        build = self._build_of(state)
        with self._folder.writing():
            merges = self._load(build.get("merges"), MERGES)
            erased = self._erased(entity_id, merges)
            events = self._events(build, defs)
            mine = self._folder.kept(self._members(build, defs).join(erased, "entity_id", "left_semi").select("sequence").distinct(), "mine")
            shared = self._folder.kept(self._now_named(events, build).join(mine, "sequence", "left_semi").join(erased, "entity_id", "left_anti"), "shared")
            stay = shared.select("sequence").distinct()
            n_events = mine.join(stay, "sequence", "left_anti").count()
            names = self._identity(build).join(erased, "entity_id", "left_semi").select("entity_type", "value")
            rows = self._ledger_frame(state).join(stay, "sequence", "left_semi")
            hints = rows.select("sequence", F.posexplode("hints").alias("k", "h")).select("sequence", "k", "h", F.col("h.entity_type").alias("entity_type"), F.col("h.value").alias("value")).join(names, ["entity_type", "value"], "left_anti")
            left = hints.groupBy("sequence").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]).alias("_left"))
            kept = rows.join(left, "sequence", "left").withColumn("hints", F.coalesce("_left", F.array().cast(f"array<{HINT}>"))).withColumn("pinned", F.lit(True)).drop("_left").select(rows.columns)
            ledger_part = {**part(self._save(kept, "ledger"), self._save(mine, "gone")), "lo": 0, "hi": 0, "tier": "hot"}
            stored = [f.name for f in T.StructType.fromDDL(self._events_schema(defs)).fields]
            events_part = part(self._save(shared.withColumn("bucket", bucket("entity_id")).select(stored), "events", ["entity_type", "bucket"]), self._save(mine, "gone"))
            written = erased
            if build.get("renames"):
                written = erased.unionByName(self._renames(build).join(erased.withColumnRenamed("entity_id", "into_entity_id"), "into_entity_id", "left_semi").select(F.col("from_entity_id").alias("entity_id"))).distinct()
            identity_part = part(None, self._save(written, "gone"))
            ids_part = part(None, self._save(mine.join(stay, "sequence", "left_anti"), "gone"))
            histories = {name: part(None, self._save(erased.select(F.col("entity_id").alias(f"{name}_id")), "gone")) for name in build["history"]}
            relations = self._relations_of(build).join(erased.withColumnRenamed("entity_id", "source_id"), "source_id", "left_anti").join(erased.withColumnRenamed("entity_id", "target_id"), "target_id", "left_anti")
            relations_part = part(self._save(relations.select([c.split()[0] for c in RELATIONS.split(", ")]), "relations"))
            kept_merges = merges.join(erased.withColumnRenamed("entity_id", "from_entity_id"), "from_entity_id", "left_anti").join(erased.withColumnRenamed("entity_id", "into_entity_id"), "into_entity_id", "left_anti")
            cleaned, n_erased = merges.count() - kept_merges.count(), erased.count()
            merges_path = self._save(kept_merges.select("from_entity_id", "into_entity_id", "at", "reason"), "merges")
            by_hand = self._forced(state)
            gone_by_hand = set()
            if by_hand is not None:  # as many as were ever merged by hand
                gone_by_hand = {r[0] for r in by_hand.select(F.explode(F.array("loser", "winner")).alias("entity_id")).join(erased, "entity_id", "left_semi").distinct().collect()}

            def put(now: dict[str, Any]) -> None:
                now["ledger"].append(ledger_part)
                now["forced"] = [f for f in now["forced"] if f["from"] not in gone_by_hand and f["into"] not in gone_by_hand]
                for key, own in now["builds"].items():
                    if key != self._build_key(version):
                        own["stale"] = True
                own = now["builds"][self._build_key(version)]
                own["events"].append(events_part)
                own["identity"].append(identity_part)
                own["ids"].append(ids_part)
                for name, p in histories.items():
                    own["history"][name].append(p)
                own["relations"], own["merges"] = [relations_part], [merges_path]

            self._change(put)
        log.info("erased %s: %d entities, %d events", entity_id, n_erased, n_events)
        return EraseResult(entity_id, n_erased, n_events, cleaned)

    def redact(self, entity_id: str) -> int:
        """Overwrite an entity's sensitive fields in all of its ledger events; returns how many events changed.

        The places that a source maps to a sensitive property, and fields of its name, become REDACTED in the raw events;
        all else stays. The events keep their ids, times and hints, so entities stay apart and later events of theirs find
        them. Text properties become REDACTED with the next build, others null; old values leave the files with
        :meth:`compact` and :meth:`vacuum`.
        """
        self.flush()
        state = self._state()
        kind = self._type_of(state, entity_id)
        defs = self._defs()
        sensitive = {n for n, p in defs.entities[kind].properties.items() if p.sensitive}
        if not sensitive:
            return 0
        build = self._build_of(state)
        with self._folder.writing():
            hit = self._folder.kept(self._events_of(build, defs, self._one(entity_id)).select("sequence").distinct(), "hit")
            rows = self._ledger_frame(state).join(hit, "sequence", "left_semi")
            changed = F.col("raw")
            for name, source in defs.sources.items():
                paths = sensitive | {str(m["from"]) for event in source.events.values() for n, m in event.mappings.items() if n in sensitive and "from" in m}
                changed = F.when(F.col("source") == name, redacted(F.col("raw"), sorted(paths), REDACTED)).otherwise(changed)
            rows = self._folder.kept(rows.withColumn("raw", changed).withColumn("pinned", F.lit(True)), "ledger")
            n = rows.count()
            gone = self._save(hit, "gone")
            members = self._events(build, defs).join(hit, "sequence", "left_semi").select("sequence", "entity_id", "entity_type", "bucket")
            again = self._normalized(rows, defs).join(members, "sequence")
            stored = [f.name for f in T.StructType.fromDDL(self._events_schema(defs)).fields]
            events_part = part(self._save(again.select(stored), "events", ["entity_type", "bucket"]), gone)
            touched = self._save(self._now_named(members.select("entity_id").distinct(), build), "pending")

            def put(now: dict[str, Any]) -> None:
                now["ledger"].append({**part(rows.inputFiles(), gone), "lo": 0, "hi": 0, "tier": "hot"})
                for key, own in now["builds"].items():
                    if key == self._build_key(now["active"]):
                        own["events"].append(events_part)
                        own["pending"] = [*own.get("pending", []), touched]
                    else:
                        own["stale"] = True

            self._change(put)
        log.info("redacted %d events of %s", n, entity_id)
        return n

    # inspection

    def timeline(self, entity_id: str) -> Timeline:
        """What changed with each row of an entity, and the event behind it; unknown ids have no entries."""
        self.flush()
        state = self._state()
        try:
            kind = self._type_of(state, entity_id)
        except NotFoundError:
            return Timeline(entity_id, "", [])
        defs = self._defs()
        rows = H.timeline(self.history(kind).df.filter(F.col(f"{kind}_id") == entity_id), kind, list(defs.entities[kind].properties))
        own = self._events_of(self._build_of(state), defs, self._one(entity_id))
        events = own.select(F.col("ts").alias("timestamp"), "event_type", "event_id")
        first = events.groupBy("timestamp").agg(F.min(F.struct("event_type", "event_id")).alias("e"))
        found = rows.join(first, "timestamp", "left").orderBy("timestamp").collect()
        return Timeline(entity_id, kind, [TimelineEntry(r["timestamp"], r["e"]["event_type"] if r["e"] else None, r["e"]["event_id"] if r["e"] else None, list(r["effects"]), r["state_before"], r["state_after"]) for r in found])

    def assert_entity(self, entity_id: str, *, state: str | None = None, **properties: Any) -> None:
        """AssertionError unless the entity is in this state with these properties."""
        kind = next((n for n in self._defs().entities if not self.table(n).df.filter(F.col(f"{n}_id") == entity_id).isEmpty()), None)
        if kind is None:
            raise AssertionError(f"entity '{entity_id}' not found")
        row = self.table(kind).df.filter(F.col(f"{kind}_id") == entity_id).first().asDict()
        if state is not None and row[f"{kind}_state"] != state:
            raise AssertionError(f"entity '{entity_id}': state is '{row[f'{kind}_state']}', expected '{state}'")
        for name, value in properties.items():
            if name not in row:
                raise AssertionError(f"entity '{entity_id}': no property '{name}'")
            if row[name] != value:
                raise AssertionError(f"entity '{entity_id}': {name} is {row[name]!r}, expected {value!r}")

    def build_status(self, version: str | None = None) -> BuildStatus:
        state = self._state()
        build = self._build_of(state, version)
        hashes = build.get("hashes") or {"definition_hash": "", "source_hash": "", "identity_hash": ""}
        cursor = build.get("cursor", 0)
        return BuildStatus(cursor, state["head"], state["head"] - cursor, _utc(build["time"]) if build.get("time") else None, build.get("mode"), **hashes, dirty=bool(build.get("dirty")))

    def validate(self, version: str | None = None) -> ValidationResult:
        return self._defs(version).validate()

    def diff(self, v1: str, v2: str) -> dict[str, DataFrame]:
        """For each entity of both versions, rows of the histories that only one has (``side``: its version)."""
        a, b = self._defs(v1), self._defs(v2)
        out = {}
        for name in a.entities.keys() & b.entities.keys():
            x, y = self.history(name, v1).df, self.history(name, v2).df
            common = [c for c in x.columns if c in y.columns]
            x, y = x.select(common), y.select(common)
            out[name] = x.exceptAll(y).withColumn("side", F.lit(v1)).unionByName(y.exceptAll(x).withColumn("side", F.lit(v2)))
        return out

    def vacuum(self) -> int:
        """Delete files that the newest manifest does not name: what builds left on their way, and what they replaced.

        Files of writers that have not committed yet stay. Readers of older states must be done.
        """
        return len(self._folder.vacuum(lambda: json.dumps(self._state(), default=str)))

    @property
    def connection(self) -> SparkSession:
        return self.spark

    def close(self) -> None:
        """Take in what waits."""
        self.flush()

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()


class VersionView:
    """Queries against one version, in the same store."""

    def __init__(self, engine: Engine, name: str):
        self._engine, self.name = engine, name

    def table(self, entity: str) -> Table:
        return self._engine.table(entity, self.name)

    def history(self, entity: str) -> Table:
        return self._engine.history(entity, self.name)

    def tables(self, *entities: Any, relationships: bool = True) -> Collection:
        return self._engine.tables(*entities, relationships=relationships, version=self.name)

    def query(self, sql: str) -> Table:
        return self._engine.query(sql, self.name)


class GraphView:
    """Whole-graph measures over the current relationships."""

    def __init__(self, engine: Engine):
        self.edges = engine._edges()

    def connected_components(self) -> Table:
        return Table(G.connected_components(self.edges))

    def communities(self, algorithm: str = "louvain") -> Table:
        return Table(G.communities(self.edges, algorithm))

    def centrality(self, algorithm: str = "pagerank") -> Table:
        return Table(G.centrality(self.edges, algorithm))

    def similar(self, entity_id: str, top_n: int = 10) -> Table:
        return Table(G.similar(self.edges, entity_id, top_n))


class DefinitionsManager:
    """Versions of definitions: register, activate, draft."""

    def __init__(self, engine: Engine):
        self._engine = engine

    def versions(self) -> list[dict[str, Any]]:
        state = self._engine._state()
        return [{"version": k, "active": k == state["active"], "created_at": v["created_at"], **v["hashes"]} for k, v in state["definitions"].items()]

    def active(self) -> str:
        return self._engine._state()["active"]

    def get(self, version: str | None = None) -> dict[str, Any]:
        return self._engine._defs(version).to_dict()

    def register(self, version: str, definitions: dict | Definitions) -> RegisterResult:
        state = self._engine._state()
        if version in state["definitions"]:
            raise DefinitionError(f"version '{version}' is there already")
        new = Definitions.load(definitions).check()
        old = Definitions(state["definitions"][state["active"]]["data"]) if state["active"] else None
        state["definitions"][version] = {"data": new.to_dict(), "hashes": new.hashes(), "created_at": str(_utc(None))}
        self._engine._commit(state)
        return RegisterResult(version, changes(old, new), build_mode(old.hashes() if old else None, new.hashes())[0], new.validate().warnings)

    def activate(self, version: str) -> BuildResult:
        state = self._engine._state()
        if version not in state["definitions"]:
            raise NotFoundError(f"no version '{version}'", {"versions": sorted(state["definitions"])})
        state["active"] = version
        self._engine._commit(state)
        return self._engine.build()

    def draft(self, version: str, *, based_on: str | None = None) -> Draft:
        return Draft(self._engine._defs(based_on), version)

    def register_draft(self, draft: Draft) -> RegisterResult:
        return self.register(draft.version, draft.definitions())


class LedgerView:
    """Raw events in the order that they were numbered; hot batches, and cold files that hold older ones."""

    def __init__(self, engine: Engine):
        self._engine = engine

    def frame(self) -> DataFrame:
        return self._engine._ledger_frame(self._engine._state()).drop("pinned")

    def count(self, *, source: str | None = None) -> int:
        df = self.frame()
        return (df.filter(F.col("source") == source) if source else df).count()

    def cursor(self) -> int:
        """The highest sequence, 0 if there is none."""
        return self._engine._state()["head"]

    def _canonical(self) -> DataFrame:
        """(sequence, event_id, duplicate_of) as the last build found them: a renormalization may make two events one."""
        build = self._engine._build_of(self._engine._state())
        return self._engine._folder.read(build.get("ids", []), IDS, "sequence", "long")

    def replay(self, from_sequence: int = 0, *, include_duplicates: bool = False) -> DataFrame:
        """Events from a sequence on, with ``duplicate_of``: the sequence of the event that counts in place of one, or null.

        In order of (ts, sequence) within range-sorted partitions. Batches that end before are not opened.
        """
        rows = self._engine._ledger_frame(self._engine._state(), from_sequence - 1 if from_sequence > 0 else 0).drop("pinned")
        marked = rows.join(self._canonical().filter("duplicate_of is not null").select("sequence", "duplicate_of"), "sequence", "left")
        kept = marked if include_duplicates else marked.filter("duplicate_of is null")
        return kept.orderBy("ts", "sequence")

    def replay_for_entities(self, entity_ids: list[str] | DataFrame) -> DataFrame:
        """Events of any of some entities, each once, in order of time; a frame of ids (``entity_id``) may be of any length."""
        engine = self._engine
        ids = entity_ids if isinstance(entity_ids, DataFrame) else engine.spark.createDataFrame([(i,) for i in entity_ids], "entity_id string")
        build = engine._build_of(engine._state())
        if not build:
            return self.frame().limit(0)
        own = engine._events_of(build, engine._defs(), ids.select("entity_id").distinct()).select("sequence").distinct()
        return self.frame().join(own, "sequence", "left_semi").orderBy("ts", "sequence")

    def replay_for_shard(self, shard: int, shards: int, from_sequence: int = 0) -> DataFrame:
        """Events of the entities that a shard owns, with ``entity_id`` and ``entity_type``: a row for each of them, in order of time.

        Shards together give every event of every entity once; a shard reads no events of others into a shuffle.
        """
        engine = self._engine
        build = engine._build_of(engine._state())
        if not build:
            return self.frame().limit(0).withColumns({"entity_id": F.lit(None).cast("string"), "entity_type": F.lit(None).cast("string")})
        members = engine._members(build, engine._defs()).filter((I.shard_of(F.col("entity_id"), shards) == shard) & (F.col("sequence") >= from_sequence))
        return engine._ledger_frame(engine._state(), from_sequence - 1 if from_sequence > 0 else 0).drop("pinned").join(members, "sequence").orderBy("ts", "sequence")

    def events_for(self, entity_id: str) -> DataFrame:
        """Ledger events of an entity, in order of time."""
        return self.replay_for_entities([entity_id])

    def export(self, path: str, *, since_sequence: int = 0, format: str = "parquet") -> None:
        self.frame().filter(F.col("sequence") > since_sequence).write.mode("overwrite").format(format).save(path)

    def _rewrite(self, tier: str, chosen: Callable[[dict[str, Any]], bool], files: int | None = None) -> int:
        """Parts chosen from the oldest on become one, sorted by sequence; how many there were."""
        engine = self._engine
        with engine._folder.writing():
            before = engine._state()["ledger"]
            parts = [p for p in before if chosen(p)]
            if not parts:
                return 0
            rows = engine._folder.read(parts, LEDGER, "sequence", "long")
            dealt = rows.repartitionByRange(files, "sequence") if files else rows.repartitionByRange("sequence")
            path = engine._folder.save(dealt.sortWithinPartitions("sequence"), "ledger", root=engine.cold if tier == "cold" else None)
            one = {**part(path), "lo": min(p["lo"] or 1 for p in parts), "hi": max(p["hi"] for p in parts), "tier": tier}
            engine._change(lambda now: now.__setitem__("ledger", [one, *(p for p in now["ledger"] if p not in parts)]))
        return len(parts)

    def compact(self, files: int | None = None) -> int:
        """Rewrite all batches as one; how many there were."""
        parts = self._engine._state()["ledger"]
        if len(parts) < 2:
            return len(parts)
        tier = "cold" if any(p["tier"] == "cold" for p in parts) and all(p["tier"] == "cold" or p["gone"] for p in parts) else "hot"
        return self._rewrite(tier, lambda p: True, files)

    def flush(self) -> int:
        """Move the hot batches to the cold folder: one step for readers, who find every event in either. How many batches moved.

        The hot files stay for readers that have begun; :meth:`prune` deletes them.
        """
        hot = [p for p in self._engine._state()["ledger"] if p["tier"] == "hot"]
        if not hot:
            return 0
        self._rewrite("cold", lambda p: True)
        return len(hot)

    def prune(self) -> int:
        """Delete what was moved; how many folders went."""
        return self._engine.vacuum()

    def tiers(self) -> dict[str, int]:
        """How many parts are hot and cold."""
        found = [p["tier"] for p in self._engine._state()["ledger"]]
        return {t: found.count(t) for t in ("hot", "cold")}


class IdentityView:
    """Which hints name which entity."""

    def __init__(self, engine: Engine):
        self._engine = engine

    def frame(self) -> DataFrame:
        self._engine.flush()
        return self._engine._identity(self._engine._build_of(self._engine._state()))

    def lookup(self, value: str, entity_type: str | None = None) -> str | None:
        df = self.frame().filter(F.col("value") == value)
        row = (df.filter(F.col("entity_type") == entity_type) if entity_type else df).orderBy("entity_type").first()
        return row["entity_id"] if row else None

    def lookup_any(self, values: list[str], entity_type: str | None = None) -> dict[str, str]:
        """The entities of those among some values that are known; of a value that names several types the first type's."""
        asked = self._engine.spark.createDataFrame([(v,) for v in values], "value string").distinct()
        df = self.frame().join(asked, "value", "left_semi")
        df = df.filter(F.col("entity_type") == entity_type) if entity_type else df
        return {r["value"]: r["id"] for r in df.groupBy("value").agg(F.min_by("entity_id", "entity_type").alias("id")).collect()}

    def hints(self, entity_id: str) -> dict[str, list[str]]:
        rows = self.frame().filter(F.col("entity_id") == entity_id).groupBy("field").agg(F.sort_array(F.collect_list("value")).alias("values")).collect()
        return {r["field"]: list(r["values"]) for r in rows}

    def merges(self, entity_id: str) -> DataFrame:
        log = self._engine._load(self._engine._build_of(self._engine._state()).get("merges"), MERGES)
        return log.filter((F.col("from_entity_id") == entity_id) | (F.col("into_entity_id") == entity_id))


def connect(spark: SparkSession, root: str) -> Engine:
    """Open a store that exists."""
    engine = Engine(spark, None, root)
    if not engine._state()["active"]:
        raise StorageError(f"no store at {root}")
    return engine
