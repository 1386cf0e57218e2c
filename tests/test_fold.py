"""The Catalyst fold against the Python fold, on random machines and events."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chronofold.operators import history as H
from chronofold.plans.definitions import Definitions
from chronofold.plans.fold import CHUNK, EntityFold, fold_entities
from chronofold.plans.pyfold import FoldError, PyFold

UTC = dt.timezone.utc
START = dt.datetime(2024, 1, 1, tzinfo=UTC)
KINDS = {"i": "integer", "x": "number", "s": "string", "b": "boolean"}
NAMES = ["e0", "e1", "e2", "e3"]


def random_machine(r):
    states = [f"s{k}" for k in range(r.randint(2, 4))]
    props = {"n": {"type": "integer", "default": 0}, "m": {"type": "number"}, "t": {"type": "string", "default": "-"}, "f": {"type": "boolean", "default": False}, "c": {"type": "number", "compute": "entity.n * 2 + 1"}}

    def effect():
        kind = r.choice(["set", "set", "inc", "go", "go", "compute", "from_entity"])
        out = {
            "set": lambda: {"set": {"property": p, "from": f"event.{q}"}} if (p := r.choice(["n", "m", "t", "f"])) and (q := {"n": "i", "m": "x", "t": "s", "f": "b"}[p]) else None,
            "inc": lambda: {"increment": {"property": r.choice(["n", "n", "m"]), "by": r.choice([1, 2, 0.5 if r.random() < 0.2 else 3])}},
            "go": lambda: {"transition": {"to": r.choice(states)}},
            "compute": lambda: {"set": {"property": "m", "compute": r.choice(["event.x * 2", "entity.n / 2.0", "event.x / event.i", "if event.b then 1.5 else 0.5"])}},
            "from_entity": lambda: {"set": {"property": "t", "compute": "entity.t + str::substring(event.s, 0, 1)"}},
        }[kind]()
        if out.get("increment", {}).get("by") == 0.5:
            out["increment"]["property"] = "m"
        if r.random() < 0.25:
            next(iter(out.values()))["condition"] = r.choice(["event.i > 2", "entity.n < 5", "event.b == true", "entity.t != 'z'"])
        return out

    def handler(create=False):
        body = {"effects": (["create"] if create else []) + [effect() for _ in range(r.randint(1, 3))]}
        if r.random() < 0.3 and not create:
            body["guard"] = r.choice(["event.i >= 2", "entity.n <= 6", "event.b", "event.s == 'ab' or event.b", "event.x > 0"])
        return body

    body = {name: {"when": {e: handler() for e in NAMES if r.random() < 0.6}} for name in states}
    body["s0"]["when"]["e0"] = handler(create=True)
    for name in states[1:]:
        body["s0"]["when"].setdefault("e3", {"effects": []})["effects"].append({"transition": {"to": name}})
    if r.random() < 0.6:
        body[r.choice(states)]["after"] = [{"type": r.choice(["inactivity", "expiration", "state_duration"]), "threshold": r.choice(["2h", "10h", "3d"]), "effects": [{"transition": {"to": r.choice(states)}}, {"set": {"property": "t", "value": "late"}}]}]
    entity = {"starts": "s0", "identity": {"k": {}}, "properties": props, "states": body}
    if r.random() < 0.3:
        entity["always"] = {"e2": {"guard": "entity.n == entity.n", "effects": [{"set": {"property": "f", "value": True}}]}}
    return Definitions({"entities": {"thing": entity}}).entities["thing"]


def random_events(r, entities=25, most=40):
    out = []
    for k in range(entities):
        at = START
        for q in range(r.randint(1, most)):
            at += dt.timedelta(minutes=r.choice([0, 5, 90, 700, 5000]))
            out.append((f"k{k}", at, len(out), r.choice(NAMES), f"ev{len(out)}", (r.choice([None, 0, 1, 2, 3, 4, 7]), r.choice([None, -1.5, 0.0, 2.5]), r.choice([None, "ab", "zz", ""]), r.choice([None, True, False]))))
    r.shuffle(out)
    return out


def by_python(entity, events):
    out = {}
    for key in {e[0] for e in events}:
        machine, state, rows = PyFold(entity), None, []
        state = machine.empty()
        try:
            for _, ts, seq, name, event_id, (i, x, s, b) in sorted((e for e in events if e[0] == key), key=lambda e: (e[1], e[2])):
                rows += machine.step(state, {"ts": ts, "event_type": name, "event_id": event_id, "data": {"i": i, "x": x, "s": s, "b": b}})
            out[key] = [(m["state"], *(m["props"][p] for p in entity.properties), m["valid_from"], m["last_event_time"], m["state_entered_time"], m["created_time"], m["event_id"]) for m in rows]
        except FoldError:
            out[key] = "error"
    return out


def events_frame(spark, events):
    return spark.createDataFrame(events, "entity_id string, ts timestamp, seq long, event_type string, event_id string, data struct<i:bigint,x:double,s:string,b:boolean>")


def by_spark(spark, entity, events):
    folded = fold_entities(events_frame(spark, events), EntityFold(entity, KINDS))
    out = {}
    for r in folded.collect():
        if r["err"] is not None:
            out[r["entity_id"]] = "error"
            continue
        at = lambda t: t.astimezone(UTC) if t is not None and t.tzinfo else t.replace(tzinfo=UTC) if t is not None else None
        out[r["entity_id"]] = [(s["state"], *(s[f"p_{p}"] for p in entity.properties), at(s["valid_from"]), at(s["last_event_time"]), at(s["state_entered_time"]), at(s["created_time"]), s["event_id"]) for s in r["snaps"]]
    return out


@pytest.mark.parametrize("seed", range(8))
def test_random_machines(spark, seed):
    r = random.Random(seed)
    entity, events = random_machine(r), random_events(r)
    want, got = by_python(entity, events), by_spark(spark, entity, events)
    handled = {k for k, v in want.items() if v != []}
    for key in want:
        assert got.get(key, []) == want[key], (seed, key)
    assert handled


def test_more_events_than_a_chunk(spark):
    r = random.Random(99)
    entity = random_machine(random.Random(3))
    events = random_events(r, entities=2, most=3 * CHUNK + 7) + [("long", START + dt.timedelta(minutes=k), 10**6 + k, "e0", f"x{k}", (1, 1.0, "ab", True)) for k in range(2 * CHUNK)]
    assert by_spark(spark, entity, events).items() >= {k: v for k, v in by_python(entity, events).items() if v}.items()


def test_histories_hold_together(spark):
    """Rows of an entity follow each other without gaps or overlaps, one of them open; arrival order does not matter."""
    r = random.Random(5)
    entity, events = random_machine(random.Random(12)), random_events(random.Random(6))
    fold = EntityFold(entity, KINDS)
    rows = H.entity_rows(fold_entities(events_frame(spark, events), fold), entity).collect()
    r.shuffle(events)
    again = H.entity_rows(fold_entities(events_frame(spark, events).repartition(3), fold), entity).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again)) and rows
    for key in {x["thing_id"] for x in rows}:
        own = sorted((x for x in rows if x["thing_id"] == key), key=lambda x: x["valid_from"])
        assert [x["valid_to"] for x in own] == [x["valid_from"] for x in own[1:]] + [None]


def test_no_events(spark):
    assert by_spark(spark, random_machine(random.Random(1)), []) == {}


def test_scd_of_any_snapshots(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 3, "z"), ("b", 2, "w")], "id string, valid_from int, v string")
    got = sorted(tuple(r) for r in H.close_and_insert(df, "id", order=["v"]).collect())
    assert got == [("a", 1, "x", 3), ("a", 3, "z", None), ("b", 2, "w", None)]


def test_tombstones_and_merges(spark):
    h = spark.createDataFrame([("a", 1, None, None), ("b", 2, 5, None), ("b", 5, None, None)], "x_id string, valid_from int, valid_to int, merged_into string").withColumns({c: F.timestamp_seconds(c) for c in ("valid_from", "valid_to")})
    gone = spark.createDataFrame([("b", "a", 9)], "from_entity_id string, into_entity_id string, at int").withColumn("at", F.timestamp_seconds("at"))
    ended = H.tombstones(h, "x_id", gone)
    assert sorted((r["x_id"], r["merged_into"]) for r in ended.filter("merged_into is not null").collect()) == [("b", "a")]
    assert H.current(ended).count() == 1
    assert H.resolve_merges(H.current(ended), ended, "x_id").count() == 3


@pytest.mark.parametrize("seed", [2, 3, 7, 12])
def test_long_entities_give_the_same_rows(spark, seed):
    r = random.Random(seed)
    entity, events = random_machine(r), random_events(r)
    frame = events_frame(spark, events)
    fold = EntityFold(entity, KINDS)
    want, _, want_failed = H.build_history(frame, fold, limit=10**9)
    got, _, got_failed = H.build_history(frame, fold, limit=10)
    order = ["thing_id", "valid_from"]
    plain = lambda df: sorted(repr(tuple(x)) for x in df.orderBy(*order).collect())
    assert plain(got) == plain(want)
    assert {x["entity_id"] for x in got_failed.collect()} == {x["entity_id"] for x in want_failed.collect()}
