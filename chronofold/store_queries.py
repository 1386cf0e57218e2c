"""Queries that go through a store, or through definitions alone, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.engine import REDACTED, Engine
from chronofold.errors import DefinitionError
from chronofold.functions.compile import Compiler, column_env
from chronofold.operators import history as H
from chronofold.operators import identity as I
from chronofold.plans.definitions import Definitions, Draft, build_mode, validate_definitions
from chronofold.plans.fold import EntityFold, fold_entities
from chronofold.queries import _USER_OUT, _USER_PLAIN, _USER_RULES, ORDER_DEFS, USER_DEFS, _household_events, _HOUSE_SQL, _query, _raw_events, _t, _text, _user_events, _user_select
from chronofold.session import scratch_path
from chronofold.sources.normalize import Normalizer

#: Raw events in the order of their ids; an event's id leaves out its time, but no mapped field.
_MOMENT = {"from": "at", "type": "string"}
_AT = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')"
_ENTITY = "'user_' || substr(sha256('user|' || user_id), 1, 24)"


def _user_data(sensitive: bool = False) -> dict[str, Any]:
    data = USER_DEFS.to_dict()
    for event in data["sources"]["web"]["events"].values():
        event["mappings"]["moment"] = _MOMENT
    if sensitive:
        data["entities"]["user"]["properties"]["user"]["sensitive"] = "pii"
    return data


def _ingested(spark: SparkSession, sf_dir: str, data: dict[str, Any], build: bool = True) -> Engine:
    engine = Engine(spark, data, scratch_path(spark, "store"))
    engine.ingest("web", _raw_events(spark, sf_dir).orderBy("sequence").select("raw"), process=build)
    return engine


def _raw(name: str) -> Any:
    return F.get_json_object("raw", f"$.{name}")


# --- ledger ----------------------------------------------------------------------------------------------------------


@_query("SELECT * FROM (SELECT row_number() OVER (ORDER BY event_id) AS sequence, event_type FROM events) WHERE sequence >= 100 ORDER BY 1")
def ledger_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir, _user_data(), build=False).ledger.replay(100).select("sequence", "event_type")


@_query(f"""
    SELECT row_number() OVER (ORDER BY event_id) AS sequence, {_ENTITY} AS entity_id, CAST(('0x' || substr(sha256({_ENTITY}), 1, 8))::BIGINT % 3 AS INTEGER) AS shard FROM events
""")
def ledger_replay_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shard's replay: together each event of each entity once."""
    engine = _ingested(spark, sf_dir, _user_data())
    parts = [engine.ledger.replay_for_shard(k, 3).select("sequence", "entity_id", F.lit(k).alias("shard")) for k in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_query(f"SELECT {_AT} AS at, CASE WHEN user_id IN (3, 7) THEN '{REDACTED}' ELSE CAST(user_id AS VARCHAR) END AS user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, round(value, 4) AS value FROM events")
def redact_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events after two users were redacted: their numbers are gone, all else is as it was."""
    engine = _ingested(spark, sf_dir, _user_data(sensitive=True))
    for user in ("3", "7"):
        engine.redact(engine.identity.lookup(user))
    return engine.ledger.frame().select(_raw("at").alias("at"), _raw("user_id").alias("user_id"), _raw("props.k").cast("long").alias("k"), F.round(_raw("value").cast("double"), 4).alias("value"))


@_query(f"""{_USER_RULES} SELECT {_ENTITY} AS entity_id, CASE WHEN user_id NOT IN (3, 7) THEN user_id END AS "user", state, CAST(purchases AS BIGINT) AS purchases, round(spent, 3) AS spent FROM closed WHERE valid_to IS NULL""")
def redact_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities after two users were redacted and built: they stay two, with the fields that are not sensitive."""
    engine = _ingested(spark, sf_dir, _user_data(sensitive=True))
    for user in ("3", "7"):
        engine.redact(engine.identity.lookup(user))
    engine.build()
    return engine.table("user").df.select(F.col("user_id").alias("entity_id"), "user", F.col("user_state").alias("state"), "purchases", F.round("spent", 3).alias("spent"))


@_query(f"SELECT {_AT} AS at, event_type, user_id FROM events WHERE user_id <> 3")
def erase_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events after a user was erased, and a build that does not bring it back: no event, name or history of it is left."""
    engine = _ingested(spark, sf_dir, _user_data())
    gone = engine.identity.lookup("3")
    engine.erase(gone)
    engine.build(full=True)
    left = engine.identity.frame().select("entity_id").unionByName(engine.history("user").df.select(F.col("user_id").alias("entity_id"))).filter(F.col("entity_id") == gone)
    rows = engine.ledger.frame().select(_raw("at").alias("at"), "event_type", _raw("user_id").cast("long").alias("user_id"))
    return rows.join(left.select(F.lit(3).cast("long").alias("user_id")), "user_id", "left_anti").select("at", "event_type", "user_id") if left.isEmpty() else rows.limit(0)


# --- builds ----------------------------------------------------------------------------------------------------------


@_query(f"{_USER_RULES} SELECT {_USER_OUT}")
def engine_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same history from three builds: half of the events, the other half, and late ones of every seventh user."""
    engine = Engine(spark, _user_data(), scratch_path(spark, "store"))
    raw = _raw_events(spark, sf_dir).withColumn("late", F.pmod(_raw("user_id").cast("long"), F.lit(7)) == 0).withColumn("early", _raw("at") < "2024-01-16")
    for part in (raw.filter("early and not late"), raw.filter("not early"), raw.filter("early and late")):
        engine.ingest("web", part.orderBy("sequence").select("raw"), process=True)
    return _user_select(engine.history("user").df)


@_query(f"""{_USER_RULES} SELECT CAST(('0x' || substr(sha256({_ENTITY}), 1, 8))::BIGINT % 2 AS INTEGER) AS shard, user_id AS "user", state, CAST(purchases AS BIGINT) AS purchases, round(spent, 3) AS spent FROM closed WHERE valid_to IS NULL""")
def shard_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two engines on one store, each of which builds the entities that its shard owns."""
    whole = _ingested(spark, sf_dir, _user_data(), build=False)
    found: DataFrame | None = None
    for k in range(2):
        engine = Engine(spark, _user_data(), whole.root, shard=k, shards=2)
        engine.build()
        own = engine.table("user").df.select(F.lit(k).alias("shard"), "user", F.col("user_state").alias("state"), "purchases", F.round("spent", 3).alias("spent"))
        found = own if found is None else found.unionByName(own)
    return found


_VIEWS = {
    "table": "now", "history": "every", "version table": "now", "bought in version": "bought", "ledger": "n", "ledger of web": "n", "pending": "0", "cursor": "n", "names": "users", "timeline of 3": "(SELECT count(*) FROM closed WHERE user_id = 3)",
    "events of 3": "(SELECT count(*) FROM events WHERE user_id = 3)", "tables": "1", "rows in sql": "now", "exported parquet": "now", "exported csv": "now", "snapshot columns": "8", "graph nodes": "now", "diff": "0", "validation errors": "0", "unknown name": "0",
}


@_query(f"""{_USER_RULES}, t AS (SELECT count(*) FILTER (WHERE valid_to IS NULL) AS now, count(*) AS every, sum(purchases) FILTER (WHERE valid_to IS NULL) AS bought FROM closed), e AS (SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM events)
    {" UNION ALL ".join(f"SELECT '{k}' AS what, CAST({v} AS BIGINT) AS n FROM t, e" for k, v in _VIEWS.items())}
""")
def engine_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers of a store see, as counts: tables, versions, ledger, identity, timeline, status, exports."""
    engine = _ingested(spark, sf_dir, _user_data())
    first = engine.definitions.active()
    draft = engine.definitions.draft("v2")
    draft.add_property("user", "tier", type="string", default="free")
    engine.definitions.register_draft(draft)
    engine.definitions.activate("v2")
    ids, out = engine.identity, scratch_path(spark, "exports")
    three, old = ids.lookup("3"), engine.version(first)
    tables, status = engine.tables("user"), engine.build_status()
    tables.to_parquet(f"{out}/p")
    tables.to_csv(f"{out}/c")
    tables.snapshot(f"{out}/s")
    engine.assert_entity(three, user=3)
    told = {
        "table": engine.table("user").df.count(), "history": engine.history("user").df.count(), "version table": old.table("user").df.count(), "bought in version": old.query("SELECT sum(purchases) AS n FROM user").df.first()["n"],
        "ledger": engine.ledger.count(), "ledger of web": engine.ledger.count(source="web"), "pending": status.pending_events, "cursor": status.cursor, "names": ids.frame().count(), "timeline of 3": len(engine.timeline(three).entries),
        "events of 3": engine.ledger.events_for(three).count(), "tables": len(engine.tables(relationships=False)), "rows in sql": engine.query("SELECT count(*) AS n FROM user").df.first()["n"], "exported parquet": spark.read.parquet(f"{out}/p/user.parquet").count(),
        "exported csv": spark.read.option("header", True).csv(f"{out}/c/user.csv").count(), "snapshot columns": len(spark.read.parquet(f"{out}/s/user.parquet").columns) - 3, "graph nodes": tables.vertices().count(), "diff": engine.diff(first, "v2")["user"].count(),
        "validation errors": len(engine.validate().errors), "unknown name": len(ids.lookup_any(["no such name"])),
    }
    return spark.createDataFrame([(k, int(v)) for k, v in told.items()], "what string, n long")


# --- the machine -----------------------------------------------------------------------------------------------------


@_query(f"""{_USER_PLAIN} SELECT user_id AS "user", round(CASE WHEN purchases > 0 THEN spent / purchases ELSE 0 END, 6) AS average FROM closed WHERE valid_to IS NULL""")
def computed_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = USER_DEFS.to_dict()
    del data["entities"]["user"]["states"]["customer"]["after"]
    # a computed property sees the properties as they were before its handler's event; one that is computed from the event is current
    for state in data["entities"]["user"]["states"].values():
        if "purchase" in state["when"]:
            state["when"]["purchase"]["effects"].insert(0, {"set": {"property": "average", "compute": "(entity.spent + event.amount) / (entity.purchases + 1)"}})
    del data["entities"]["user"]["properties"]["average"]["compute"]
    data["entities"]["user"]["properties"]["average"]["default"] = 0.0
    data["entities"]["user"]["properties"]["doubled"] = {"type": "number", "compute": "entity.average * 2"}
    defs = Definitions(data)
    fold = EntityFold(defs.entities["user"], defs.field_kinds())
    rows = H.current(H.entity_rows(fold_entities(_user_events(spark, sf_dir), fold), fold.entity))
    return rows.select("user", F.round(F.col("doubled") / 2, 6).alias("average"))


def _ruled(rule: dict[str, Any]) -> Definitions:
    """Users who sign up once and are moved by a rule alone; a view is an event that shows that it was overdue."""
    body = {
        "starts": "on", "identity": {"user": {}}, "properties": {"views": {"type": "integer", "default": 0}, "note": {"type": "string", "default": "-"}},
        "states": {"on": {"when": {"signup": {"effects": ["create"]}, "view": {"effects": [{"increment": {"property": "views"}}]}}, "after": [rule]}, "off": {"when": {"view": {"effects": [{"increment": {"property": "views"}}]}}}},
    }
    return Definitions({"entities": {"user": body}, "sources": USER_DEFS.to_dict()["sources"]})


def _ruled_rows(spark: SparkSession, sf_dir: str, rule: dict[str, Any]) -> DataFrame:
    defs = _ruled(rule)
    fold = EntityFold(defs.entities["user"], defs.field_kinds())
    rows = H.entity_rows(fold_entities(_user_events(spark, sf_dir), fold), fold.entity)
    return rows.filter("user_state = 'off'").groupBy("user_id").agg(F.min("valid_from").alias("at"), F.min("views").alias("views"), F.max("note").alias("note")).select(F.col("user_id").alias("entity_id"), _text(F.col("at")).alias("at"), "views", "note")


#: From sign-up on the rule's time runs; the first event after it shows that it is over. Views up to then count.
_RULED_SQL = """
    WITH born AS (SELECT user_id, min(ts) AS born FROM events WHERE event_type = 'signup' GROUP BY user_id),
    shown AS (SELECT user_id, born FROM born JOIN events USING (user_id) GROUP BY user_id, born HAVING max(ts) > born + INTERVAL 10 DAY)
    SELECT CAST(user_id AS VARCHAR) AS entity_id, strftime(born + INTERVAL 10 DAY, '%Y-%m-%d %H:%M:%S.%f') AS at,
           (SELECT count(*) FROM events e WHERE e.user_id = shown.user_id AND event_type = 'view' AND ts > born AND ts <= born + INTERVAL 10 DAY) AS views, '{note}' AS note
    FROM shown
"""


@_query(_RULED_SQL.format(note="-"))
def time_rule_state_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ruled_rows(spark, sf_dir, {"type": "state_duration", "threshold": "10d", "effects": [{"transition": {"to": "off"}}]})


@_query(_RULED_SQL.format(note="expired"))
def time_rule_expiration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule that sets a property as well."""
    return _ruled_rows(spark, sf_dir, {"type": "expiration", "threshold": "10d", "effects": [{"set": {"property": "note", "value": "expired"}}, {"transition": {"to": "off"}}]})


@_query(f"{_USER_RULES.replace('WHERE seen <= ts + INTERVAL 5 DAY AND next_event > ts', 'WHERE seen <= ts + INTERVAL 5 DAY AND coalesce(next_event, (SELECT max(ts) FROM events)) > ts')} SELECT user_id AS \"user\", state, CAST(purchases AS BIGINT) AS purchases, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS valid_from FROM closed")
def stream_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream whose rules fire by the watermark: users without a next event grow dormant as well."""
    rows = _streamed(spark, sf_dir, USER_DEFS, timers="0 seconds")
    p = F.from_json("properties", "user long, purchases long")
    return rows.filter("not late and error is null").withColumn("p", p).select("p.user", "state", "p.purchases", _text(F.col("valid_from")).alias("valid_from"))


def _streamed(spark: SparkSession, sf_dir: str, defs: Definitions, timers: str | None = None) -> DataFrame:
    from chronofold.streaming.stream import Consumer, fold_stream, read_raw

    root = scratch_path(spark, "stream")
    _raw_events(spark, sf_dir).select("raw").write.text(f"{root}/raw")
    normal = Normalizer(defs).normalize(read_raw(spark, f"{root}/raw", 1_000), "web").filter("error is null")
    keyed = normal.select(F.col("data.user").cast("string").alias("entity_id"), "ts", "event_type", "event_id", "data")
    Consumer(fold_stream(keyed, defs, "user", timers), f"{root}/out", f"{root}/checkpoint").run_once()
    return spark.read.parquet(f"{root}/out")


@_query("""
    SELECT CAST(user_id AS VARCHAR) AS entity_id, 'increment on an entity that does not exist' AS error, 0 AS rows_that_count FROM events
    GROUP BY user_id HAVING min(ts) FILTER (WHERE event_type = 'error') < min(ts) FILTER (WHERE event_type = 'signup') OR (count(*) FILTER (WHERE event_type = 'signup') = 0 AND count(*) FILTER (WHERE event_type = 'error') > 0)
""")
def stream_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity that fails in a stream fails as in a batch: whole, and alone."""
    from chronofold.streaming.stream import settled

    data = USER_DEFS.to_dict()
    data["entities"]["user"]["always"] = {"error": {"effects": [{"increment": {"property": "errors"}}]}}
    rows = _streamed(spark, sf_dir, Definitions(data))
    counted = settled(rows).groupBy("entity_id").agg(F.count("*").alias("n"))
    return rows.filter("error is not null").join(counted, "entity_id", "left").select("entity_id", "error", F.coalesce(F.col("n").cast("int"), F.lit(0)).alias("rows_that_count"))


# --- expressions and identity ----------------------------------------------------------------------------------------


@_query("""
    SELECT c_custkey, list_contains(string_split(c_name, '#'), 'Customer') AS has, CAST(len(string_split(c_mktsegment, 'I')) AS BIGINT) AS parts, CAST(2024 AS BIGINT) AS this_year, CAST(152 AS BIGINT) AS days
    FROM customer
""")
def fn_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    compile_ = Compiler(column_env({"c_name": "string", "c_mktsegment": "string"}), F.lit("2024-06-01 00:00:00").cast("timestamp"))
    texts = {"has": "contains(split(c_name, '#'), 'Customer')", "parts": "len(split(c_mktsegment, 'I'))", "this_year": "year_of(now())", "days": "days_between(now(), parse_datetime('2024-01-01 00:00:00', '%Y-%m-%d %H:%M:%S'))"}
    return _t(spark, sf_dir, "customer").select("c_custkey", *(compile_(t).value.alias(k) for k, t in texts.items()))


@_query(f"{_HOUSE_SQL} SELECT entity_id, count(*) AS names, count(*) FILTER (WHERE value LIKE 'h%') AS houses, min(value) AS first_name FROM ids GROUP BY entity_id")
def identity_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.resolve(_household_events(spark, sf_dir))
    return found.groupBy("entity_id").agg(F.count("*").alias("names"), F.count_if(F.col("field") == "house").alias("houses"), F.min("value").alias("first_name"))


@_query(f"""{_HOUSE_SQL}, w AS (SELECT entity_id AS winner FROM ids WHERE value = 'k1'), l AS (SELECT entity_id AS loser FROM ids WHERE value = 'k11')
    SELECT 'person' AS entity_type, value, CASE WHEN entity_id = loser THEN winner ELSE entity_id END AS entity_id FROM ids, w, l""")
def merge_by_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The household of customer 11 becomes part of that of customer 1, which names both whatever the ids."""
    events = _household_events(spark, sf_dir)
    ids = {r["value"]: r["entity_id"] for r in I.resolve(events).filter("value in ('k1', 'k11')").collect()}
    forced = spark.createDataFrame([(ids["k11"], ids["k1"], "person")], "loser string, winner string, entity_type string")
    return I.resolve(events, forced).select("entity_type", "value", "entity_id")


@_query(f"{_HOUSE_SQL} SELECT 'person' AS entity_type, value, entity_id FROM ids")
def identity_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in two lots: the second extends what the first has named, and renames what it joins."""
    events = _household_events(spark, sf_dir)
    known = I.resolve(events.filter("sequence % 3 != 0")).select("entity_type", "value", "field", "candidate", "entity_id")
    rows, renames = I.extend(events.filter("sequence % 3 = 0"), known.select("entity_type", "value", "entity_id"))
    every = known.unionByName(rows).join(renames.withColumnRenamed("from_entity_id", "entity_id"), "entity_id", "left")
    return every.select("entity_type", "value", F.coalesce("into_entity_id", "entity_id").alias("entity_id"))


# --- definitions -----------------------------------------------------------------------------------------------------


def _edited(path: str, value: Any, base: Definitions = USER_DEFS) -> dict[str, Any]:
    data = base.to_dict()
    at = data
    *above, last = path.split("/")
    for name in above:
        at = at[name]
    at[last] = value
    return data


_CHANGES = {
    "nothing": ("entities/user/starts", "lead"), "source": ("sources/web/timestamp", "when"), "identity": ("entities/user/identity/user", {"match": "exact", "normalize": "value"}), "property": ("entities/user/properties/x", {"type": "string"}),
}


@_query("SELECT * FROM (VALUES ('nothing', 'INCREMENTAL', 0), ('source', 'FULL_RENORMALIZE', 1), ('identity', 'FULL_WITH_IDENTITY_RESET', 2), ('property', 'FULL', 1), ('first', 'FULL', 0)) t(change, mode, hashes)")
def build_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a change of definitions makes the next build do, and how many of the three hashes it changes."""
    base = USER_DEFS.hashes()
    found = {k: Definitions(_edited(*edit)).hashes() for k, edit in _CHANGES.items()}
    rows = [(k, build_mode(base, h)[0], sum(h[x] != base[x] for x in base)) for k, h in found.items()]
    return spark.createDataFrame([*rows, ("first", build_mode(None, base)[0], 0)], "change string, mode string, hashes int")


_MISTAKES: dict[str, tuple[dict[str, Any], str]] = {
    "start": (_edited("entities/user/starts", "nowhere"), "no state"), "identity": (_edited("entities/user/identity", {}), "no identity"), "type": (_edited("entities/user/properties/spent", {"type": "money"}), "unknown type"),
    "default": (_edited("entities/user/properties/spent", {"type": "number", "default": "x"}), "not of type"), "system name": (_edited("entities/user/properties/valid_from", {"type": "string"}), "system column"),
    "syntax": (_edited("entities/user/properties/average", {"type": "number", "compute": "1 +"}), "expected"), "function": (_edited("entities/user/properties/average", {"type": "number", "compute": "f(1)"}), "unknown function"),
    "unreached": (_edited("entities/user/states/island", {}), "cannot be reached"), "rule": (_edited("entities/user/states/dormant", {"after": [{"type": "never", "threshold": "1d", "effects": []}]}), "time rule"),
    "undeclared": (_edited("entities/user/states/dormant", {"when": {"view": {"effects": [{"set": {"property": "none", "value": 1}}]}}}), "undeclared"),
    "two sources": (_edited("entities/user/states/dormant", {"when": {"view": {"effects": [{"set": {"property": "spent", "value": 1, "from": "event.k"}}]}}}), "needs one of"),
    "effect": (_edited("entities/user/states/dormant", {"when": {"view": {"effects": [{"explode": {}}]}}}), "unknown effect"), "cardinality": (_edited("entities/user/relationships", [{"type": "ab", "target": "user", "cardinality": "some"}]), "cardinality"),
    "inverse": (_edited("entities/customer/relationships", [], ORDER_DEFS), "no relationship back"), "timestamp": (_edited("sources/web/timestamp", ""), "empty"), "hints": (_edited("sources/web/events/view/hints", {}), "no identity hints"),
    "hint field": (_edited("sources/web/events/view/hints", {"user": ["k"]}), "identifies no"), "mapping": (_edited("sources/web/events/view/mappings", {"user": {"from": "a", "compute": "1"}}), "both"),
    "schema field": (_edited("schemas", {"signup": {"fields": {"age": {"type": "integer", "required": True}}}}), "requires 'age'"),
}


@_query("SELECT unnest([" + ", ".join(f"'{k}'" for k in _MISTAKES) + "]) AS mistake, FALSE AS valid, TRUE AS told UNION ALL SELECT 'none', TRUE, TRUE")
def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions with one mistake each: refused, with an error that names it."""
    found = {k: validate_definitions(data) for k, (data, _) in _MISTAKES.items()}
    rows = [(k, r.valid, any(_MISTAKES[k][1] in e for e in r.errors)) for k, r in found.items()]
    return spark.createDataFrame([*rows, ("none", USER_DEFS.validate().valid, True)], "mistake string, valid boolean, told boolean")


@_query("SELECT unnest(['dead end', 'sensitivity', 'unused event', 'never read']) AS warning, TRUE AS told")
def validation_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = USER_DEFS.to_dict()
    data["entities"]["user"]["properties"]["phone"] = {"type": "string", "treatment": "mask"}
    data["entities"]["user"]["states"]["customer"]["when"]["view"] = {"effects": [{"transition": {"to": "gone"}}]}
    data["entities"]["user"]["states"]["customer"]["when"]["click"] = {"effects": [{"set": {"property": "phone", "value": "x"}}]}
    data["entities"]["user"]["states"]["gone"] = {}
    text = " ".join(Definitions(data).validate().warnings)
    words = {"dead end": "dead end", "sensitivity": "without a sensitivity", "unused event": "no state handles", "never read": "no guard or computed property reads it"}
    return spark.createDataFrame([(k, w in text) for k, w in words.items()], "warning string, told boolean")


@_query("SELECT unnest(['customer', 'dormant', 'lead']) AS state, 1 AS leads_to")
def state_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each state of the user leads, by handlers and by time rules."""
    graph = USER_DEFS.entities["user"].state_graph()
    return spark.createDataFrame([(k, len(set(v))) for k, v in graph.items()], "state string, leads_to int")


@_query("SELECT * FROM (VALUES ('add property', 'done'), ('add it again', 'refused'), ('unknown type', 'refused'), ('transition to no state', 'refused'), ('add state', 'done'), ('add transition', 'done'), ('add handler', 'done'), ('update identity', 'done'), ('remove property', 'done'), ('remove no state', 'refused'), ('impact', 'FULL_WITH_IDENTITY_RESET'), ('valid', 'true')) t(step, outcome)")
def definition_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of a draft: those that break something are refused and leave the draft as it was."""
    draft = Draft(USER_DEFS, "v2")
    steps: dict[str, Callable[[], None]] = {
        "add property": lambda: draft.add_property("user", "tier", type="string", default="free"), "add it again": lambda: draft.add_property("user", "tier", type="string"), "unknown type": lambda: draft.add_property("user", "x", type="money"),
        "transition to no state": lambda: draft.add_transition("user", "lead", "view", "mars"), "add state": lambda: draft.add_state("user", "gone"), "add transition": lambda: draft.add_transition("user", "dormant", "view", "gone", guard="event.k > 1"),
        "add handler": lambda: draft.add_handler("user", "gone", "signup", [{"transition": {"to": "lead"}}]), "update identity": lambda: draft.update_identity("user", mail={"match": "exact"}), "remove property": lambda: draft.remove_property("user", "errors"),
        "remove no state": lambda: draft.remove_state("user", "mars"),
    }
    rows = []
    for name, step in steps.items():
        before = draft.definitions().hashes() if rows else None
        try:
            step()
            rows.append((name, "done"))
        except DefinitionError:
            rows.append((name, "refused" if before is None or draft.definitions().hashes() == before else "broken"))
    rows += [("impact", draft.impact()["build_mode"]), ("valid", str(draft.validate().valid).lower())]
    return spark.createDataFrame(rows, "step string, outcome string")
