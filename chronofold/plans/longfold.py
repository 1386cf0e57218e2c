"""Entities with too many events for one array.

They go through the same machine on Python values, one event after the other from a sorted partition, and their history
rows leave as they are made. So a task holds one state, however many events an entity has; what remains sequential is
what the machine makes sequential. Which entities these are is counted first, map-side combined.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from chronofold.functions.compile import spark_type
from chronofold.plans.definitions import Entity
from chronofold.plans.fold import links
from chronofold.plans.pyfold import FoldError, PyFold

#: Entities with more events than this are long.
LONG = 20_000
ROWS = 5_000


def long_entities(events: DataFrame, limit: int | None = None) -> DataFrame:
    """(entity_id) of the long entities, counted map-side first."""
    limit = LONG if limit is None else limit
    return events.groupBy("entity_id").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("entity_id")


def _row_schema(entity: Entity) -> StructType:
    own = [f"`{entity.name}_id` string", f"`{entity.name}_state` string", *(f"`{p}` {spark_type(s.type)}" for p, s in entity.properties.items())]
    times = "valid_from timestamp, valid_to timestamp, merged_into string, last_event_time timestamp, state_entered_time timestamp, created_time timestamp"
    return StructType.fromDDL(", ".join([*own, times, "rels array<struct<relation:string,target_type:string,target_id:string>>", "error string"]))


def fold_in_order(events: DataFrame, entity: Entity, now: dt.datetime | None = None) -> DataFrame:
    """History rows with their ``rels`` of each entity, or one row with its ``error``; ``events`` as for ``fold_entities``.

    Rows of an entity are made before a later event may fail it; so an error row says that the entity's other rows do not
    count. Of rows with one start time the first stays.
    """
    schema = _row_schema(entity)
    arrow = to_arrow_schema(schema)
    link_columns = [c for c in links(entity) if c in events.columns]
    moment = now or dt.datetime.now(dt.timezone.utc)
    columns = ["entity_id", "ts", "seq", "event_type", "event_id", "data", *link_columns]
    dealt = events.select(*columns).repartition("entity_id").sortWithinPartitions("entity_id", "ts", "seq")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, Any]]:
        for batch in batches:
            yield from batch.to_pylist()

    def one(key: str, own: Iterator[dict[str, Any]]) -> Iterator[tuple]:
        machine = PyFold(entity, moment)
        state, waiting = machine.empty(), None
        try:
            for e in own:
                event = {**e, "ts": e["ts"], "links": {c: e[c] for c in link_columns}}
                for s in machine.step(state, event):
                    if waiting is not None and s["valid_from"] <= waiting["valid_from"]:
                        continue
                    if waiting is not None:
                        yield out(key, waiting, s["valid_from"])
                    waiting = s
            if waiting is not None:
                yield out(key, waiting, None)
        except FoldError as error:
            for _ in own:
                pass
            yield (key, *[None] * (len(schema) - 2), str(error))

    def out(key: str, s: dict[str, Any], end: dt.datetime | None) -> tuple:
        return (key, s["state"], *(s["props"][p] for p in entity.properties), s["valid_from"], end, None, s["last_event_time"], s["state_entered_time"], s["created_time"], s["rels"], None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for key, own in groupby(rows(batches), key=lambda r: r["entity_id"]):
            for row in one(key, own):
                held.append(row)
                if len(held) >= ROWS:
                    yield pack(held)
                    held = []
        yield pack(held)

    def pack(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return dealt.mapInArrow(run, schema)


def split_out(found: DataFrame, entity: Entity) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(history rows, relationship statements, failed entities) of ``fold_in_order``'s rows."""
    key = f"{entity.name}_id"
    failed = found.filter("error is not null").select(F.col(key).alias("entity_id"), F.lit(entity.name).alias("entity_type"), "error")
    good = found.filter("error is null").join(failed.select(F.col("entity_id").alias(key)), key, "left_anti")
    told = good.filter(F.size("rels") > 0).select(F.col(key).alias("source_id"), "valid_from", F.explode("rels").alias("r")).select("source_id", F.col("r.target_id").alias("target_id"), F.col("r.relation").alias("relationship_type"), "valid_from")
    return good.drop("rels", "error").select(*found.drop("rels", "error").columns), told, failed
