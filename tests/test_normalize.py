import datetime as dt
import hashlib
import json

from pyspark.sql import functions as F

from chronofold.operators import identity as I
from chronofold.plans.definitions import Definitions
from chronofold.sources.normalize import Normalizer, json_path

DEFS = Definitions(
    {
        "entities": {"person": {"starts": "on", "identity": {"mail": {"normalize": "str::to_lowercase(str::trim(value))"}, "code": {"normalize": "to_int(value)"}, "plain": {}}, "states": {"on": {"when": {"seen": {"effects": ["create"]}}}}}},
        "sources": {
            "s": {
                "event_type": "meta.kind", "timestamp": "at",
                "events": {
                    "seen": {
                        "raw_type": "user.seen",
                        "mappings": {
                            "mail": {"from": "user.mail"}, "code": {"from": "code", "type": "string"}, "plain": {"from": "plain", "type": "integer"}, "score": {"from": "list.1.x", "type": "number", "default": -1.5}, "ok": {"from": "ok", "type": "boolean"},
                            "day": {"from": "day", "type": "datetime"}, "total": {"compute": "event.a + event.b * 2", "type": "number"}, "label": {"compute": "coalesce(event.name, 'none')", "type": "string"}, "nothing": {"type": "string"},
                        },
                        "hints": {"person": ["mail", "code", "plain"]},
                    }
                },
            }
        },
    }
)


def run(spark, *events):
    rows = [(k, e if isinstance(e, (str, type(None))) else json.dumps({"meta": {"kind": "user.seen"}, "at": 1700000000, **e})) for k, e in enumerate(events)]
    df = Normalizer(DEFS).normalize(spark.createDataFrame(rows, "n int, raw string"), "s")
    return [r.asDict(True) for r in df.orderBy("n").collect()]


def test_values(spark):
    full, bare, odd = run(
        spark,
        {"user": {"mail": " Ann@X.org "}, "code": 17, "plain": 3.0, "list": [0, {"x": "2.5"}], "ok": "YES", "day": "2024-05-01T10:00:00+02:00", "a": 1, "b": 2.5, "name": "é"},
        {},
        {"user": {"mail": {"deep": 1}}, "code": True, "plain": "12", "list": [[1, 2]], "ok": 0, "day": 86400.5, "a": 1, "name": [1]},
    )
    assert full["error"] is None
    assert {k: v for k, v in full["data"].items() if k != "day"} == {"mail": " Ann@X.org ", "code": "17", "plain": 3, "score": 2.5, "ok": True, "total": 6.0, "label": "é", "nothing": None}
    assert full["data"]["day"].astimezone(dt.timezone.utc) == dt.datetime(2024, 5, 1, 8, tzinfo=dt.timezone.utc)
    assert [(h["field"], h["value"]) for h in full["hints"]] == [("mail", "ann@x.org"), ("code", "17"), ("plain", "3")]
    assert bare["error"].startswith("field 'total'")
    assert odd["error"].startswith("field 'total'") and odd["data"]["mail"] is None and odd["data"]["ok"] is False and odd["data"]["score"] == -1.5 and odd["data"]["plain"] == 12


def test_failures_stay_in_their_rows(spark):
    rows = run(spark, "{", None, "[]", '{"meta": {"kind": "other"}}', '{"meta": {"kind": "user.seen"}}', {"at": "yesterday"}, {"at": "2024-01-01 10:00:00Z", "a": 1, "b": 1, "plain": "x"}, {"at": "2024-01-01T10:00:00.5Z", "a": 1, "b": 1}, {"a": 1, "b": 1, "ok": "maybe"})
    told = [r["error"] for r in rows]
    assert told[0] == told[1] == "not a JSON event" and told[2].startswith("missing event type") and told[3] == "unknown event type: other" and told[4].startswith("missing or malformed") and told[5].startswith("missing or malformed")
    assert told[6].startswith("field 'plain'") and told[7] is None and told[8].startswith("field 'ok'")
    assert [r["event_id"] is None for r in rows] == [t is not None for t in told] and rows[7]["event_type"] == "seen"


def test_event_ids_are_made_of_tagged_fields(spark):
    (row,) = run(spark, {"user": {"mail": 'q"\n'}, "code": "c", "a": 1, "b": 1, "day": "2024-05-01T10:00:00.25Z"})
    body = [["code", {"String": "c"}], ["day", {"DateTime": "2024-05-01T10:00:00.250Z"}], ["label", {"String": "none"}], ["mail", {"String": 'q"\n'}], ["nothing", "Null"], ["ok", "Null"], ["plain", "Null"], ["score", {"Float": -1.5}], ["total", {"Float": 3.0}]]
    assert row["event_id"] == "e_" + hashlib.sha256(("seen|" + json.dumps(body, separators=(",", ":"), ensure_ascii=False)).encode()).hexdigest()


def test_paths():
    assert json_path("a.0.b") == "$['a'][0]['b']"


def test_identity(spark):
    h = lambda *v: [{"entity_type": "p", "field": "f", "value": x} for x in v]
    events = spark.createDataFrame([(1, h("a", "b")), (2, h("c")), (3, h("b", "d")), (4, h("e", "e")), (5, []), (6, h("a"))], "sequence long, hints array<struct<entity_type:string,field:string,value:string>>")
    table = {r["value"]: r["entity_id"] for r in I.resolve(events).collect()}
    assert len(table) == 5 and table["a"] == table["b"] == table["d"] and len(set(table.values())) == 3
    names = {r["value"]: r["candidate"] for r in I.hints_of(events).collect()}
    assert table["a"] == min(names[x] for x in "abd")
    of = {r["sequence"]: r["entity_id"] for r in I.event_entities(events, I.resolve(events)).collect()}
    assert of == {1: table["a"], 2: table["c"], 3: table["a"], 4: table["e"], 6: table["a"]}
    forced = spark.createDataFrame([(table["a"], table["c"], "p")], "loser string, winner string, entity_type string")
    after = {r["value"]: r["entity_id"] for r in I.resolve(events, forced).collect()}
    assert after["a"] == after["c"] == after["d"] == table["c"]
    log = [tuple(r) for r in I.merge_log(I.resolve(events), I.resolve(events, forced)).collect()]
    assert log == [(table["a"], table["c"])]
    shards = spark.range(50).select(F.concat(F.lit("x"), "id").alias("e")).select("e", I.shard_of(F.col("e"), 7).alias("s")).collect()
    assert all(r["s"] == int.from_bytes(hashlib.sha256(r["e"].encode()).digest()[:4], "big") % 7 for r in shards)
