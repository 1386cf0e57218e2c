"""Streams: raw events to history rows as they arrive, and a consumer that writes them.

The stateful operator keeps an entity's state between batches and folds new events with the same machine as batches do.
Events within one trigger are sorted by time. An event older than what an entity has seen is kept apart as late, for a
batch build to fold from the ledger. As in batches an entity that has an error fails whole and alone: its error row says
that its other rows do not count (:func:`settled` leaves them out), and it takes in nothing more.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from chronofold.plans.definitions import Definitions
from chronofold.plans.fold import links
from chronofold.plans.pyfold import FoldError, PyFold
from chronofold.results import ConsumerResult, ConsumerStatus

SNAPSHOT = "entity_id string, entity_type string, state string, properties string, valid_from timestamp, last_event_time timestamp, state_entered_time timestamp, created_time timestamp, event_id string, late boolean, error string"


def _plain(value: Any) -> Any:
    return value.isoformat() if isinstance(value, datetime) else value


def _utc(value: Any) -> datetime | None:
    if value is None or value is pd.NaT:
        return None
    got = pd.Timestamp(value).to_pydatetime()
    return got if got.tzinfo else got.replace(tzinfo=timezone.utc)


def _naive(value: datetime | None) -> datetime | None:
    return value.astimezone(timezone.utc).replace(tzinfo=None) if value else None


def _pack(s: dict[str, Any]) -> str:
    return json.dumps({k: ({p: _tag(v) for p, v in s[k].items()} if k == "props" else _tag(s[k])) for k in s})


def _tag(value: Any) -> Any:
    return {"t": value.isoformat()} if isinstance(value, datetime) else value


def _untag(value: Any) -> Any:
    return datetime.fromisoformat(value["t"]) if isinstance(value, dict) and "t" in value else value


def _unpack(text: str) -> dict[str, Any]:
    return {k: ({p: _untag(x) for p, x in v.items()} if k == "props" else _untag(v)) for k, v in json.loads(text).items()}


def fold_stream(events: DataFrame, definitions: Definitions, entity: str, timers: str | None = None) -> DataFrame:
    """Snapshots of an entity type from a stream (or a batch) of normalized events with ``entity_id``.

    State is one JSON text for each entity. A key's rows of one trigger come in Arrow batches and are sorted in memory, so
    a trigger should be bounded (``maxFilesPerTrigger`` and the like).
    timers: a delay as of a watermark ("1 hour"); time rules then fire for entities without a next event as well, once
    the watermark is past them. Events older than the watermark do not reach the fold then: the ledger has them, and a
    batch build folds them. Without timers a rule fires when the entity's next event shows that it was overdue.
    """
    spec = definitions.entities[entity]
    fields = [f.name for f in events.schema["data"].dataType.fields]
    link_columns = [c for c in links(spec) if c in events.columns]
    columns = [c.split()[0] for c in SNAPSHOT.split(", ")]

    def next_check(s: dict[str, Any]) -> float | None:
        """When a rule of the state will be overdue, in milliseconds."""
        if not s["alive"]:
            return None
        since = [(s[{"inactivity": "last", "expiration": "created", "state_duration": "entered"}[r.type]], r.micros) for r in spec.states[s["state"]].after]
        return min((at.timestamp() * 1000 + micros / 1000 for at, micros in since if at is not None), default=None)

    def run(key: tuple[str], batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        machine = PyFold(spec)
        s = _unpack(state.get[0]) if state.exists else machine.empty()
        seen, failed = (state.get[1], state.get[2]) if state.exists else (None, False)
        out: list[dict[str, Any]] = []

        def row(event_id: str | None, **own: Any) -> dict[str, Any]:
            return {"entity_id": key[0], "entity_type": entity, "event_id": event_id, "late": False, "error": None, **own}

        def snapshot(m: dict[str, Any], event_id: str | None) -> dict[str, Any]:
            props = json.dumps({k: _plain(v) for k, v in m["props"].items()})
            return row(event_id, state=m["state"], properties=props, valid_from=_naive(m["valid_from"]), last_event_time=_naive(m["last_event_time"]), state_entered_time=_naive(m["state_entered_time"]), created_time=_naive(m["created_time"]))

        def guarded(step: Callable[[], list[dict[str, Any]]], at: datetime, event_id: str | None) -> None:
            nonlocal failed
            try:
                out.extend(snapshot(m, event_id) for m in step())
            except FoldError as error:
                failed = True
                out.append(row(event_id, error=str(error), valid_from=_naive(at)))

        def overdue(at: datetime) -> list[dict[str, Any]]:
            if not machine.time_rules(s, at):
                return []
            s["last"] = s["entered"]
            return [{"state": s["state"], "props": dict(s["props"]), "valid_from": s["entered"], "last_event_time": s["last"], "state_entered_time": s["entered"], "created_time": s["created"]}]

        if timers and state.hasTimedOut:
            at = datetime.fromtimestamp(state.getCurrentWatermarkMs() / 1000, timezone.utc)
            guarded(lambda: overdue(at), at, None)
        else:
            pending = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
            for e in pending.itertuples(index=False):
                at = _utc(e.ts)
                if failed:
                    break
                if seen is not None and at.timestamp() < seen:
                    out.append(row(e.event_id, late=True, valid_from=_naive(at)))
                    continue
                seen = at.timestamp()
                data = json.loads(e.data)
                event = {"ts": at, "event_type": e.event_type, "event_id": e.event_id, "data": {f: data.get(f) for f in fields}, "links": {c: getattr(e, c.lstrip("_")) for c in link_columns}}
                guarded(lambda event=event: machine.step(s, event), at, e.event_id)
        state.update((_pack(s) if not failed else _pack(machine.empty()), seen, failed))
        if timers and not failed and (when := next_check(s)) is not None:
            state.setTimeoutTimestamp(max(int(when) + 1, state.getCurrentWatermarkMs() + 1))
        frame = pd.DataFrame(out, columns=columns)
        for c in ("valid_from", "last_event_time", "state_entered_time", "created_time"):
            frame[c] = pd.to_datetime(frame[c])
        yield frame

    source = events.withWatermark("ts", timers) if timers else events
    flat = source.select("entity_id", "ts", "event_id", "event_type", F.to_json("data").alias("data"), *(F.col(c).alias(c.lstrip("_")) for c in link_columns))
    timeout = GroupStateTimeout.EventTimeTimeout if timers else GroupStateTimeout.NoTimeout
    return flat.groupBy("entity_id").applyInPandasWithState(run, SNAPSHOT, "packed string, seen double, failed boolean", "append", timeout)


def settled(rows: DataFrame) -> DataFrame:
    """Written snapshots that count: no late events, and nothing of an entity that has failed."""
    failed = rows.filter("error is not null").select("entity_id").distinct()
    return rows.filter("not late and error is null").join(failed, "entity_id", "left_anti").select(rows.columns)


class Consumer:
    """Writes a stream of snapshots in micro-batches: at least once, rows keyed by (entity, time), so a replay adds nothing."""

    def __init__(self, stream: DataFrame, target: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None):
        self.stream, self.target, self.checkpoint, self.on_batch = stream, target, checkpoint, on_batch
        self.query = None
        self._last: datetime | None = None

    def _write(self, batch: DataFrame, number: int) -> None:
        # a batch that is run again replaces its own folder
        batch.write.mode("overwrite").parquet(f"{self.target}/batch={number:012d}")
        self._last = datetime.now(timezone.utc)
        if self.on_batch:
            self.on_batch(batch, number)

    def run_once(self) -> ConsumerResult:
        """Take in all there is, then stop."""
        started = time.time()
        query = self.stream.writeStream.foreachBatch(self._write).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        self.query = query
        progress = [p for p in query.recentProgress if p["numInputRows"]]
        return ConsumerResult(sum(p["numInputRows"] for p in progress), 0, len(progress), int((time.time() - started) * 1000))

    def start(self, every: str = "5 seconds") -> None:
        self.query = self.stream.writeStream.foreachBatch(self._write).option("checkpointLocation", self.checkpoint).trigger(processingTime=every).start()

    def status(self) -> ConsumerStatus:
        last = self.query.lastProgress if self.query else None
        return ConsumerStatus(0, last["batchId"] if last else -1, self._last, float(last["processedRowsPerSecond"] or 0) if last and "processedRowsPerSecond" in last else 0.0)

    def close(self) -> None:
        if self.query is not None and self.query.isActive:
            self.query.stop()

    def __enter__(self) -> Consumer:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()


def read_raw(spark: SparkSession, folder: str, per_trigger: int = 16) -> DataFrame:
    """A stream of raw events from JSON lines as they appear in a folder: one column ``raw``."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", per_trigger).load(folder).withColumnRenamed("value", "raw")


class Sink:
    """Where rows go: files of some format in a folder, or a Kafka topic where its connector is on the class path.

    Both get the same columns (key, value as JSON, headers), so what reads one reads the other.
    """

    def __init__(self, format: str = "json", path: str | None = None, servers: str | None = None, topic: str | None = None, **options: str):
        if (format == "kafka") != (servers is not None and topic is not None) or (format != "kafka") != (path is not None):
            raise ValueError("a Kafka sink has servers and a topic, any other a path")
        self.format, self.path, self.servers, self.topic, self.options = format, path, servers, topic, options

    def _at(self, io: Any, writes: bool) -> Any:
        if self.format != "kafka":
            return io.format(self.format).options(**self.options)
        where = {"kafka.bootstrap.servers": self.servers, "topic" if writes else "subscribe": self.topic}
        return io.format("kafka").options(**({"kafka.acks": "all", "kafka.compression.type": "lz4"} if writes else {}), **where, **self.options)

    def write(self, rows: DataFrame, key: str | None = None) -> None:
        """Append rows; those that :func:`to_kafka` has shaped as they are, others as JSON under a key."""
        shaped = rows if key is None else rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"), F.array().cast(HEADERS).alias("headers"))
        out = self._at(shaped.write.mode("append"), True)
        out.save() if self.format == "kafka" else out.save(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        """A stream of (key, value, kind) of what was written."""
        source = self._at(spark.readStream, False)
        if self.format == "kafka":
            found = source.option("includeHeaders", "true").load().select(F.col("key").cast("string"), F.col("value").cast("string"), "headers")
        else:
            found = source.schema(f"key string, value string, headers {HEADERS}").load(self.path)
        kind = F.get(F.transform(F.filter("headers", lambda h: h["key"] == "kind"), lambda h: h["value"].cast("string")), 0)
        return found.select("key", "value", kind.alias("kind"))


HEADERS = "array<struct<key:string,value:binary>>"


def read_effects(spark: SparkSession, sink: Sink) -> DataFrame:
    """A stream of the effects that a publisher wrote: snapshots as :func:`fold_stream` gives them, with their ``kind``."""
    return sink.read(spark).select("kind", F.from_json("value", SNAPSHOT).alias("s")).select("kind", "s.*")


def read_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A stream of raw events from Kafka, where its connector is on the class path."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load().select(F.col("value").cast("string").alias("raw"))


def to_kafka(snapshots: DataFrame) -> DataFrame:
    """Snapshots as Kafka rows: key, JSON value, and a header that tells snapshots from tombstones and deletions."""
    kind = F.when(F.col("state").isNull(), F.lit("delete")).otherwise(F.lit("snapshot"))
    if "merged_into" in snapshots.columns:
        kind = F.when(F.col("merged_into").isNotNull(), F.lit("tombstone")).otherwise(kind)
    return snapshots.select(F.col("entity_id").alias("key"), F.to_json(F.struct("*")).alias("value"), F.array(F.struct(F.lit("kind").alias("key"), F.encode(kind, "UTF-8").alias("value"))).cast(HEADERS).alias("headers"))


def publish(snapshots: DataFrame, sink: Sink) -> None:
    """Write snapshots to a sink, keyed by entity; in a stream as a consumer's ``on_batch``."""
    sink.write(to_kafka(snapshots))
