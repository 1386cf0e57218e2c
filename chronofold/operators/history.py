"""SCD Type-2 histories of entities and of their relationships."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.plans import longfold
from chronofold.plans.definitions import Entity
from chronofold.plans.fold import EntityFold, fold_entities, history_of
from chronofold.session import cut, store


def entity_rows(folded: DataFrame, entity: Entity) -> DataFrame:
    """The history table of folded entities; those with an error have none. No shuffle: rows end within the entity's own array."""
    each = folded.filter("err is null").select("entity_id", F.explode(history_of(F.col("snaps"))).alias("h"))
    r = "h.row."
    return each.select(
        F.col("entity_id").alias(f"{entity.name}_id"),
        F.col(f"{r}state").alias(f"{entity.name}_state"),
        *(F.col(f"{r}p_{p}").alias(p) for p in entity.properties),
        F.col(f"{r}valid_from").alias("valid_from"),
        F.col("h.valid_to").alias("valid_to"),
        F.lit(None).cast("string").alias("merged_into"),
        F.col(f"{r}last_event_time").alias("last_event_time"),
        F.col(f"{r}state_entered_time").alias("state_entered_time"),
        F.col(f"{r}created_time").alias("created_time"),
    )


def _stated(folded: DataFrame) -> DataFrame:
    each = folded.filter("err is null").select("entity_id", F.explode("snaps").alias("s")).filter(F.size("s.rels") > 0)
    told = each.select("entity_id", F.col("s.valid_from").alias("valid_from"), F.explode("s.rels").alias("r"))
    return told.select(F.col("entity_id").alias("source_id"), F.col("r.target_id").alias("target_id"), F.col("r.relation").alias("relationship_type"), "valid_from")


def _ended(stated: DataFrame) -> DataFrame:
    w = Window.partitionBy("relationship_type", "source_id", "target_id").orderBy("valid_from")
    return stated.distinct().withColumn("valid_to", F.lead("valid_from").over(w))


def relationship_rows(folded: DataFrame) -> DataFrame:
    """(source_id, target_id, relationship_type, valid_from, valid_to): one row for each time a relationship was stated."""
    return _ended(_stated(folded))


def build_history(events: DataFrame, fold: EntityFold, limit: int | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(history, relationships, failed entities) from events with their entity ids.

    Entities with more than ``limit`` events (by default ``longfold.LONG``) are folded in order from a sorted partition
    and never held in one array; all others by the Catalyst fold. keep: writes the folded entities, so that what is drawn
    from them is not folded again. An ordered fold is sequential in its entity: one with very many events is one long task.
    """
    entity = fold.entity
    long = cut(longfold.long_entities(events, limit))
    any_long = not long.isEmpty()
    short = events.join(long, "entity_id", "left_anti").select(events.columns) if any_long else events
    folded = fold_entities(short, fold)
    folded = keep(folded) if keep else folded
    failed = folded.filter("err is not null").select("entity_id", F.lit(entity.name).alias("entity_type"), F.col("err").alias("error"))
    rows, relations = entity_rows(folded, entity), _stated(folded)
    if any_long:
        found = store(longfold.fold_in_order(events.join(long, "entity_id", "left_semi"), entity), "long")
        more_rows, more_relations, more_failed = longfold.split_out(found, entity)
        rows, relations, failed = rows.unionByName(more_rows), relations.unionByName(more_relations), failed.unionByName(more_failed)
    return rows, _ended(relations), failed


def close_and_insert(snapshots: DataFrame, key: str, at: str = "valid_from", order: list[str] | None = None) -> DataFrame:
    """Snapshots of any kind as SCD rows: of equal (key, time) the first by ``order`` stays; a row ends where the next one starts."""
    first = Window.partitionBy(key, at).orderBy(*(order or [at]))
    kept = snapshots.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return kept.withColumn("valid_to", F.lead(at).over(Window.partitionBy(key).orderBy(at)))


def tombstones(history: DataFrame, key: str, merged: DataFrame) -> DataFrame:
    """Open rows of entities in ``merged`` (from_entity_id, into_entity_id, at) end at that time and name the winner; into null: erased."""
    joined = history.join(merged.select(F.col("from_entity_id").alias(key), F.col("into_entity_id").alias("_into"), F.col("at").alias("_at")), key, "left")
    open_row = F.col("valid_to").isNull() & F.col("_at").isNotNull()
    ended = {"valid_to": F.when(open_row, F.greatest("_at", "valid_from")).otherwise(F.col("valid_to")), "merged_into": F.when(open_row, F.col("_into")).otherwise(F.col("merged_into"))}
    return joined.select(*(ended[c].alias(c) if c in ended else F.col(c) for c in history.columns))


def current(history: DataFrame) -> DataFrame:
    return history.filter("valid_to is null and merged_into is null")


def as_of(history: DataFrame, at: Column | str) -> DataFrame:
    """Rows that were valid at a moment."""
    moment = F.lit(at).cast("timestamp") if isinstance(at, str) else at
    return history.filter((F.col("valid_from") <= moment) & (F.col("valid_to").isNull() | (F.col("valid_to") > moment)))


def resolve_merges(rows: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """Rows, and the rows of entities that were merged into theirs; each once."""
    ids = rows.select(F.col(key).alias("_id")).distinct()
    losers = history.join(ids, history["merged_into"] == ids["_id"], "left_semi").select(key).distinct()
    return rows.unionByName(history.join(losers, key, "left_semi")).distinct()


def timeline(history: DataFrame, entity: str, properties: list[str]) -> DataFrame:
    """(entity_id, timestamp, state_before, state_after, effects) of each row against the one before."""
    key, state = f"{entity}_id", f"{entity}_state"
    w = Window.partitionBy(key).orderBy("valid_from")
    before = {c: F.lag(c).over(w) for c in [state, *properties]}
    rows = history.select(key, "valid_from", state, *properties, F.row_number().over(w).alias("_n"), *(c.alias(f"_was_{k}") for k, c in before.items()))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    told = [F.when(F.col("_n") == 1, F.lit("Entity created"))]
    told.append(F.when((F.col("_n") > 1) & ~F.col(state).eqNullSafe(F.col(f"_was_{state}")), F.concat(F.lit("State: "), text(f"_was_{state}"), F.lit(" → "), text(state))))
    for p in properties:
        told.append(F.when((F.col("_n") > 1) & ~F.col(p).eqNullSafe(F.col(f"_was_{p}")), F.concat(F.lit(f"{p}: "), text(f"_was_{p}"), F.lit(" → "), text(p))))
    effects = F.filter(F.array(*told), lambda x: x.isNotNull())
    return rows.select(F.col(key).alias("entity_id"), F.col("valid_from").alias("timestamp"), F.col(f"_was_{state}").alias("state_before"), F.col(state).alias("state_after"), effects.alias("effects"))
