"""Identity resolution: which entity each event belongs to.

A hint is an entity type and a value. Hints that an event names together belong to one entity, and so on transitively:
connected components over hints, for each type. A hint's candidate id is a hash of the hint, an entity's id the smallest
candidate of its component; so ids do not depend on arrival, and of merged entities the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.operators.components import connected_components
from chronofold.session import cut


def candidate_id(entity_type: Column, value: Column) -> Column:
    return F.concat(entity_type, F.lit("_"), F.substring(F.sha2(F.concat_ws("|", entity_type, value), 256), 1, 24))


def hints_of(events: DataFrame) -> DataFrame:
    """(entity_type, value, field, candidate) of each distinct hint."""
    each = events.select(F.explode("hints").alias("h")).select("h.*")
    return each.groupBy("entity_type", "value").agg(F.min("field").alias("field")).withColumn("candidate", candidate_id(F.col("entity_type"), F.col("value")))


def resolve(events: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """(entity_type, value, field, entity_id): the identity table of all hints of ``events``.

    forced: (loser, winner, entity_type) of merges that were asked for; the component that holds the winner gets its id.
    An event adds links from its first hint of a type to the others, so a common hint value costs a row for each distinct
    partner and never all pairs. Only distinct links are shuffled.
    """
    all_hints = hints_of(events)
    per_type = events.select(F.explode(F.array_distinct(F.transform("hints", lambda h: h["entity_type"]))).alias("t"), "hints")
    ids = F.array_distinct(F.transform(F.filter("hints", lambda h: h["entity_type"] == F.col("t")), lambda h: candidate_id(h["entity_type"], h["value"])))
    links = per_type.select(ids.alias("ids")).filter(F.size("ids") > 1).select(F.col("ids")[0].alias("a"), F.explode(F.slice("ids", 2, F.size("ids") - 1)).alias("b"))
    if forced is not None:
        links = links.unionByName(forced.select(F.col("loser").alias("a"), F.col("winner").alias("b")))
    found = connected_components(links.distinct())
    label = F.coalesce("component", "candidate")
    named = all_hints.join(found.withColumnRenamed("node", "candidate"), "candidate", "left").select("entity_type", "value", "field", "candidate", label.alias("entity_id"))
    if forced is not None:
        by_hand = _named_by_hand(found, forced).select(F.col("component").alias("entity_id"), "label")
        named = named.join(by_hand, "entity_id", "left").withColumn("entity_id", F.coalesce("label", "entity_id")).drop("label")
    return named.select("entity_type", "value", "field", "candidate", "entity_id")


def _named_by_hand(found: DataFrame, forced: DataFrame) -> DataFrame:
    """(component, label): components that hold a winner chosen by hand are named by it, of several by the smallest that has not lost."""
    chosen = forced.join(found.withColumnRenamed("node", "winner"), "winner", "left").select(F.coalesce("component", "winner").alias("component"), F.col("winner").alias("label"))
    losers = forced.filter("loser != winner").select(F.col("loser").alias("label")).distinct()
    return chosen.join(losers, "label", "left_anti").groupBy("component").agg(F.min("label").alias("label"))


def extend(events: DataFrame, known: DataFrame, forced: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(identity rows of hints that are new, renames): what new events add to an identity table.

    known: (entity_type, value, entity_id) of the hints so far. An event links the entities that its hints have already,
    and new hints by their candidate ids; components are found over these links alone, so old ones are never walked.
    renames: (from_entity_id, into_entity_id) of entities that turn out to be one with another. Ids are those that
    :func:`resolve` gives for all events together, as an entity's id is the smallest candidate of its component.
    """
    each = events.select("sequence", F.explode("hints").alias("h")).select("sequence", "h.entity_type", "h.value", "h.field")
    named = each.select("entity_type", "value").distinct().join(known, ["entity_type", "value"], "left")
    placed = cut(each.join(named.withColumn("node", F.coalesce("entity_id", candidate_id(F.col("entity_type"), F.col("value")))), ["entity_type", "value"]))
    first = placed.groupBy("sequence", "entity_type").agg(F.min("node").alias("a"))
    links = placed.join(first, ["sequence", "entity_type"]).filter("a != node").select("a", F.col("node").alias("b"))
    if forced is not None:
        links = links.unionByName(forced.select(F.col("loser").alias("a"), F.col("winner").alias("b")).filter("a != b"))
    found = cut(connected_components(links.distinct()))
    label = found.select(F.col("node"), F.col("component").alias("label"))
    if forced is not None:
        label = found.join(_named_by_hand(found, forced), "component", "left").select("node", F.coalesce("label", "component").alias("label"))
    fresh = placed.filter("entity_id is null").groupBy("entity_type", "value").agg(F.min("field").alias("field"), F.first("node").alias("candidate"))
    rows = fresh.join(label.withColumnRenamed("node", "candidate"), "candidate", "left").select("entity_type", "value", "field", "candidate", F.coalesce("label", "candidate").alias("entity_id"))
    old = placed.filter("entity_id is not null").select(F.col("entity_id").alias("node"))
    if forced is not None:
        old = old.unionByName(forced.select(F.explode(F.array("loser", "winner")).alias("node")))
    renames = old.distinct().join(label, "node").filter("node != label").select(F.col("node").alias("from_entity_id"), F.col("label").alias("into_entity_id"))
    return rows, renames


def event_entities(events: DataFrame, identity: DataFrame) -> DataFrame:
    """(sequence, entity_type, entity_id): the entities that each event belongs to, one for each type."""
    each = events.select("sequence", F.explode("hints").alias("h")).select("sequence", "h.entity_type", "h.value")
    first = each.groupBy("sequence", "entity_type").agg(F.min("value").alias("value"))
    return first.join(identity.select("entity_type", "value", "entity_id"), ["entity_type", "value"]).select("sequence", "entity_type", "entity_id")


def merge_log(before: DataFrame, after: DataFrame) -> DataFrame:
    """(from_entity_id, into_entity_id): entities of an earlier identity table that a later one has under another id."""
    was = before.select("entity_type", "value", F.col("entity_id").alias("from_entity_id"))
    now = after.select("entity_type", "value", F.col("entity_id").alias("into_entity_id"))
    return was.join(now, ["entity_type", "value"]).filter("from_entity_id != into_entity_id").groupBy("from_entity_id").agg(F.min("into_entity_id").alias("into_entity_id"))


def shard_of(entity_id: Column, shards: int) -> Column:
    """The shard that owns an entity: the first four bytes of its id's SHA-256, modulo the number of shards."""
    return (F.conv(F.substring(F.sha2(entity_id, 256), 1, 8), 16, 10).cast("bigint") % F.lit(shards)).cast("int")
