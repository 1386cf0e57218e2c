"""Incremental builds, shards, redaction, tiers, buffers: what a store does over several operations."""

import copy
import json

import pytest
from pyspark.sql import functions as F

import chronofold.engine as engine_module
from chronofold.engine import REDACTED, Engine
from chronofold.errors import ConfigError
from chronofold.sources.normalize import redacted
from tests.test_engine import SHOP, signup, state_of, upgrade


def rows_of(engine, name="customer"):
    return sorted(map(repr, engine.history(name).df.drop("last_event_time").collect()))


def rows_read(spark, run):
    """Rows that scans of files gave while ``run`` ran, by Spark's own count."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark.sparkContext._jsc.sc().statusStore()
    count = lambda: {s.stageId(): s.inputRecords() for s in (lambda found: (found.apply(k) for k in range(found.size())))(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None))}
    before = count()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for k, n in count().items() if k not in before)


def people(n, first=0):
    return [signup(f"p{k}@x.org", f"{1000 + k}", "2024-01-01T00:00:00Z") for k in range(first, first + n)] + [upgrade(f"p{k}@x.org", "pro", k + 1, "2024-01-02T00:00:00Z") for k in range(first, first + n)]


def test_redacted_text_changes_in_the_named_places_only(spark):
    raw = '{"a":1.50,"b":{"c":[{"d":"x","e":2},{"d":"y"}],"k":null},"email":"m","n":7,"big":12345678901234567890}'
    df = spark.createDataFrame([(raw,), ("[1]",), ("no json",), (None,), ('{"b":5}',)], "raw string")
    got = [r[0] for r in df.select(redacted(F.col("raw"), ["email", "b.c.0.d", "n", "absent"])).collect()]
    want = json.loads(raw)
    want["email"] = want["n"] = want["b"]["c"][0]["d"] = REDACTED
    assert json.loads(got[0]) == want and got[1] == got[2] == got[3] == json.dumps(REDACTED) and json.loads(got[4]) == {"b": 5}
    assert json.loads(df.select(redacted(F.col("raw"), ["b", "b.c"])).first()[0])["b"] == REDACTED


@pytest.fixture
def store(spark, tmp_path):
    e = Engine(spark, SHOP, str(tmp_path / "store"))
    e.ingest("app", people(3), process=True)
    return e


def test_redacted_people_stay_apart(store):
    e = store
    ids = [e.identity.lookup(f"p{k}@x.org") for k in range(3)]
    before = {r["customer_id"]: (r["phone"], r["plan"], r["paid"]) for r in e.table("customer").df.collect()}
    assert e.redact(ids[0]) == 2 and e.redact(ids[1]) == 2
    assert e.build().mode == "INCREMENTAL"
    rows = {r["customer_id"]: r for r in e.table("customer").df.collect()}
    assert set(rows) == set(ids) and {i: (r["phone"], r["plan"], r["paid"]) for i, r in rows.items()} == before
    assert [rows[i]["email"] for i in ids] == [REDACTED, REDACTED, "p2@x.org"]
    seen = rows_of(e)
    # the same from raw; later events of theirs still find them, and their old events are not taken in again
    assert e.build(from_raw=True).mode == "FULL_RENORMALIZE" and rows_of(e) == seen
    done = e.ingest("app", [*people(1), upgrade("p0@x.org", "max", 50, "2024-01-05T00:00:00Z")], process=True)
    assert (done.events_ingested, done.duplicates_skipped) == (1, 2)
    row = e.table("customer").df.filter(F.col("customer_id") == ids[0]).first()
    assert (row["plan"], row["paid"], row["email"]) == ("max", 50.0, REDACTED)


def files_with(folder, text):
    import pyarrow.parquet as pq

    return [p for p in folder.rglob("*.parquet") if any(text in repr(r) for r in pq.read_table(p).to_pylist())]


def test_what_is_erased_or_redacted_leaves_the_files(store, tmp_path):
    e = store
    e.erase(e.identity.lookup("p0@x.org"))
    e.redact(e.identity.lookup("p1@x.org"))
    e.build()
    seen, hints = rows_of(e), e.identity.frame().count()
    e.compact()
    e.vacuum()
    assert rows_of(e) == seen and e.identity.frame().count() == hints
    assert not files_with(tmp_path / "store", "p0@x.org")
    assert e.ledger.count() == 4 and all("p1@x.org" not in r["raw"] for r in e.ledger.frame().collect())


def test_a_second_build_reads_what_is_new_and_touched(spark, store):
    e = store
    e.ingest("app", people(400, 100), process=True)
    e.compact()
    e.ingest("app", [upgrade("p101@x.org", "max", 9, "2024-01-03T00:00:00Z")])
    done = []
    read = rows_read(spark, lambda: done.append(e.build()))
    assert done[0].mode == "INCREMENTAL" and done[0].events_processed == 1 and (done[0].entities_created, done[0].entities_updated) == (0, 1)
    # identity and ids are read whole, two narrow rows for each event; of events and histories one bucket in 64
    narrow = e.identity.frame().count() * 3 + e.ledger.count() * 2
    assert read < narrow + 800, read
    full = rows_of(e)
    assert e.build(full=True).mode == "FULL" and rows_of(e) == full
    whole = rows_read(spark, lambda: e.build(from_raw=True))
    assert rows_of(e) == full and whole > 2 * read


def test_many_increments_are_as_one_build(spark, tmp_path, monkeypatch):
    """Merges by shared hints across increments, late events, more parts than a table keeps; against one full build."""
    lots = [people(6), [signup("p0@x.org", "1001", "2024-01-03T00:00:00Z")], [signup("p2@x.org", "1003", "2024-01-04T00:00:00Z"), upgrade("p5@x.org", "mid", 2, "2024-01-01T12:00:00Z")], [signup("p1@x.org", "1002", "2024-01-05T00:00:00Z"), signup("p9@x.org", "1005", "2024-01-06T00:00:00Z")]]
    monkeypatch.setattr(engine_module, "PARTS", 2)
    events = [x for lot in lots for x in lot]
    one = Engine(spark, SHOP, str(tmp_path / "one"))
    one.ingest("app", events, process=True)
    many = Engine(spark, SHOP, str(tmp_path / "many"))
    modes = [many.ingest("app", lot, process=True).build_result.mode for lot in lots]
    assert modes == ["FULL"] + ["INCREMENTAL"] * (len(lots) - 1)
    own = [r[0] for r in one.table("customer").df.select("customer_id").collect()]  # those that were merged away keep the rows that they had until then
    live = lambda e: sorted(map(repr, e.history("customer").df.filter(F.col("customer_id").isin(own)).drop("last_event_time").collect()))
    assert live(many) == live(one) and many.table("customer").df.count() == 2 + 1
    assert sorted(map(repr, many.identity.frame().select("value", "entity_id").collect())) == sorted(map(repr, one.identity.frame().select("value", "entity_id").collect()))
    stones = many.history("customer").df.filter("merged_into is not null")
    assert stones.count() >= 3 and many.history("customer").resolve_merges().df.count() == many.history("customer").df.count()
    state = many._state()
    assert all(len(p) <= 3 for p in many._build_of(state)["history"].values())


def test_shards_together_are_the_whole(spark, store, tmp_path):
    e = store
    e.ingest("till", [{"kind": "order.made", "when": 1704800000 + k, "id": k, "who": f"p{k % 3}@x.org", "lines": [{"sum": k}]} for k in range(9)], process=True)
    parts = [Engine(spark, SHOP, e.root, shard=k, shards=2) for k in range(2)]
    for p in parts:
        assert p.build().mode == "FULL" and p.build().mode == "SKIP"
    for name in ("customer", "order"):
        assert sorted(x for p in parts for x in rows_of(p, name)) == rows_of(e, name)
    owned = [{r[0] for r in p.ledger.replay_for_shard(k, 2).select("entity_id").collect()} for k, p in enumerate(parts)]
    assert not owned[0] & owned[1] and len(owned[0] | owned[1]) == 12
    assert sum(p.ledger.replay_for_shard(k, 2).count() for k, p in enumerate(parts)) == e._members(e._build_of(e._state()), e._defs()).count()
    # an increment in each shard, and the whole in the store without shards
    parts[0].ingest("app", [upgrade("p1@x.org", "max", 3, "2024-02-01T00:00:00Z")])
    assert [p.build().mode for p in parts] == ["INCREMENTAL"] * 2 and e.build().mode == "INCREMENTAL"
    assert sorted(x for p in parts for x in rows_of(p)) == rows_of(e)
    with pytest.raises(ConfigError):
        Engine(spark, SHOP, str(tmp_path / "bad"), shard=3, shards=3)


def test_replays(spark, tmp_path):
    e = Engine(spark, SHOP, str(tmp_path / "r"))
    e.ingest("app", people(4), process=True)
    assert [r["sequence"] for r in e.ledger.replay(6).collect()] == [6, 7, 8] and e.ledger.cursor() == 8 and e.ledger.replay(9).count() == 0
    ids = list(e.identity.lookup_any(["p0@x.org", "p1@x.org", "ghost"]).values())
    assert len(ids) == 2 and e.ledger.replay_for_entities(ids).count() == 4 == e.ledger.replay_for_entities(spark.createDataFrame([(i,) for i in ids + ids], "entity_id string")).count()
    assert e.ledger.replay_for_entities([]).count() == 0
    # after a renormalization that drops a field of the id, events that differ in it alone are one
    data = copy.deepcopy(SHOP)
    data["sources"]["app"]["event_id"] = ["email", "plan"]
    e.definitions.register("v2", data)
    e.ingest("app", [upgrade("p0@x.org", "pro", 77, "2024-01-09T00:00:00Z")])
    assert e.definitions.activate("v2").mode == "FULL"
    assert e.ledger.replay().count() == 8 and e.ledger.replay(include_duplicates=True).count() == 9
    assert [(r["sequence"], r["duplicate_of"]) for r in e.ledger.replay(include_duplicates=True).filter("duplicate_of is not null").collect()] == [(9, 5)]


def test_a_cold_ledger(spark, tmp_path):
    e = Engine(spark, SHOP, str(tmp_path / "hot"), cold=str(tmp_path / "cold"))
    e.ingest("app", people(3), process=True)
    e.ingest("app", people(2, 3), process=True)
    seen, replay = rows_of(e), [tuple(r) for r in e.ledger.replay().collect()]
    assert e.ledger.tiers() == {"hot": 2, "cold": 0} and e.ledger.flush() == 2 and e.ledger.tiers() == {"hot": 0, "cold": 1} and e.ledger.flush() == 0
    assert e.ledger.prune() > 0 and [tuple(r) for r in e.ledger.replay().collect()] == replay
    e.ingest("app", people(1, 5), process=True)
    assert e.ledger.tiers() == {"hot": 1, "cold": 1} and e.ledger.count() == 12 and sorted(r["sequence"] for r in e.ledger.replay(10).collect()) == [10, 11, 12]
    assert e.ingest("app", people(2)).duplicates_skipped == 4  # also of cold ones
    e.build(from_raw=True)
    assert set(seen) < set(rows_of(e)) and e.redact(e.identity.lookup("p0@x.org")) == 2
    e.build()
    assert e.ledger.flush() > 0 and e.ledger.count() == 12 and e.table("customer").df.filter(F.col("email") == REDACTED).count() == 1
    assert list((tmp_path / "cold").rglob("*.parquet"))


def test_events_wait_for_a_batch(spark, tmp_path):
    e = Engine(spark, SHOP, str(tmp_path / "b"), batch_size=3)
    first = e.ingest("app", people(1), process=True)
    assert first.events_ingested == 2 and first.build_result is None and e.ledger.count() == 0
    order = {"kind": "order.made", "when": 1704800000, "id": 7, "who": "p0@x.org", "lines": [{"sum": 3.5}]}
    done = e.ingest("till", [order, {**order, "id": 8}], process=True)
    assert done.events_ingested == 3 and done.build_result.entities_created == 2 and e.ledger.count() == 3
    assert e.build().events_processed == 1 and e.ledger.count() == 4  # what was left over
    e.ingest("app", [upgrade("p0@x.org", "max", 5, "2024-03-01T00:00:00Z")], process=True)
    assert state_of(e)[0][2] is not None and e.table("customer").df.first()["plan"] == "max"  # a reader takes it in
    e.ingest("app", [upgrade("p0@x.org", "min", 1, "2024-04-01T00:00:00Z")], process=True)
    e.close()
    assert e.ledger.count() == 6 and e.table("customer").df.first()["plan"] == "min"


def test_writers_that_meet(spark, store, monkeypatch):
    """Another writer commits between a writer's look and its commit; a vacuum runs meanwhile."""
    e, other = store, Engine(spark, SHOP, store.root)
    inner, met = e._commit, []

    def commit(state):
        if not met:
            met.append(other.vacuum())
            other.ingest("app", people(1, 50))
        inner(state)

    monkeypatch.setattr(e, "_commit", commit)
    assert e.ingest("app", people(1, 60)).events_ingested == 2
    monkeypatch.undo()
    assert e.ledger.count() == 10 and sorted(r["sequence"] for r in e.ledger.frame().collect()) == list(range(1, 11))
    e.build()
    assert e.table("customer").df.count() == 5


def test_all_failures_are_kept(spark, tmp_path):
    e = Engine(spark, SHOP, str(tmp_path / "f"))
    done = e.ingest("app", [{"type": "odd", "k": k} for k in range(150)])
    assert done.events_failed == 150 and len(done.failures) == 100 and spark.read.parquet(done.failures_path).count() == 150
    e.vacuum()
    assert spark.read.parquet(done.failures_path).count() == 150
