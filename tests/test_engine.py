import pytest

from chronofold.engine import REDACTED, Engine, connect
from chronofold.errors import ConfigError, DefinitionError, NotFoundError, QueryError, StorageError
from chronofold.sources.manifest import ManifestStore

SHOP = {
    "entities": {
        "customer": {
            "starts": "lead",
            "identity": {"email": {"normalize": "str::to_lowercase(value)"}, "phone": {}},
            "properties": {"email": {"type": "string", "sensitive": "pii", "treatment": "mask"}, "phone": {"type": "string"}, "plan": {"type": "string", "default": "free"}, "paid": {"type": "number", "default": 0}, "yearly": {"type": "number", "compute": "entity.paid * 12"}},
            "relationships": [{"type": "placed", "target": "order", "cardinality": "has_many"}],
            "states": {
                "lead": {"when": {"signup": {"effects": ["create", {"set": {"property": "email", "from": "event.email"}}, {"set": {"property": "phone", "from": "event.phone"}}, {"transition": {"to": "trial"}}]}}},
                "trial": {"when": {"upgrade": {"effects": [{"set": {"property": "plan", "from": "event.plan"}}, {"set": {"property": "paid", "from": "event.paid"}}, {"transition": {"to": "active"}}]}}, "after": [{"type": "state_duration", "threshold": "14d", "effects": [{"transition": {"to": "gone"}}]}]},
                "active": {"when": {"upgrade": {"guard": "event.plan != entity.plan", "effects": [{"set": {"property": "plan", "from": "event.plan"}}, {"set": {"property": "paid", "from": "event.paid"}}]}}, "after": [{"type": "inactivity", "threshold": "90d", "effects": [{"transition": {"to": "gone"}}]}]},
                "gone": {},
            },
        },
        "order": {
            "starts": "placed",
            "identity": {"order": {}},
            "properties": {"total": {"type": "number"}},
            "relationships": [{"type": "placed_by", "target": "customer", "cardinality": "belongs_to"}],
            "states": {"placed": {"when": {"ordered": {"effects": ["create", {"set": {"property": "total", "from": "event.total"}}, {"relate": {"type": "placed_by", "target": "customer", "hints": {"customer": ["email"]}}}]}}}},
        },
    },
    "sources": {
        "app": {
            "event_type": "type",
            "timestamp": "at",
            "events": {
                "signup": {"mappings": {"email": {"from": "email", "type": "string"}, "phone": {"from": "phone", "type": "string"}}, "hints": {"customer": ["email", "phone"]}},
                "upgrade": {"mappings": {"email": {"from": "email", "type": "string"}, "plan": {"from": "plan", "type": "string"}, "paid": {"from": "money.paid", "type": "number"}}, "hints": {"customer": ["email"]}},
            },
        },
        "till": {"event_type": "kind", "timestamp": "when", "events": {"ordered": {"raw_type": "order.made", "mappings": {"order": {"from": "id", "type": "string"}, "email": {"from": "who", "type": "string"}, "total": {"from": "lines.0.sum", "type": "number"}}, "hints": {"order": ["order"], "customer": ["email"]}}}},
    },
}


def signup(email, phone, at="2024-01-01T10:00:00Z"):
    return {"type": "signup", "at": at, "email": email, "phone": phone}


def upgrade(email, plan, paid, at):
    return {"type": "upgrade", "at": at, "email": email, "plan": plan, "money": {"paid": paid}}


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, SHOP, str(tmp_path / "store"), dead_letter=str(tmp_path / "dead"))
    done = e.ingest("app", [signup("Ann@x.org", "1"), signup("bob@x.org", "2", "2024-01-02T10:00:00Z"), upgrade("ann@x.org", "pro", 10, "2024-01-03T10:00:00Z"), upgrade("ann@x.org", "pro", 10, "2024-01-03T10:00:00Z"), {"type": "odd"}, {"type": "signup", "at": "?"}], process=True)
    assert (done.events_ingested, done.events_failed, done.duplicates_skipped) == (3, 2, 1)
    assert done.build_result.mode == "FULL" and done.build_result.entities_created == 2
    return e


def state_of(e, name="customer"):
    return sorted((r[f"{name}_state"], *[r[c] for c in e.table(name).df.columns[2:4]]) for r in e.table(name).df.collect())


def test_life_of_a_store(spark, engine, tmp_path):
    e = engine
    assert spark.read.json(e.dead_letter).count() == 2
    assert [(r["customer_state"], r["plan"], r["paid"], r["yearly"]) for r in e.table("customer").df.orderBy("customer_state").collect()] == [("active", "pro", 10.0, 120.0), ("trial", "free", 0.0, 0.0)]
    assert e.build().mode == "SKIP"
    ann, bob = e.identity.lookup("ann@x.org"), e.identity.lookup("bob@x.org")
    assert ann != bob and e.identity.lookup("none") is None and e.identity.hints(ann) == {"email": ["ann@x.org"], "phone": ["1"]}
    # several sources, nested fields, relationships
    e.ingest("till", [{"kind": "order.made", "when": 1704800000, "id": 7, "who": "ann@x.org", "lines": [{"sum": 3.5}]}], process=True)
    order = e.identity.lookup("7")
    assert [r["total"] for r in e.table("order").df.collect()] == [3.5]
    assert [(r["entity_id"], r["direction"]) for r in e.neighbors(order).df.collect()] == [(ann, "outbound")]
    assert e.path(ann, order) == [ann, order] and e.path(bob, order) == []
    assert sorted(r["depth"] for r in e.traverse(order, "placed_by", 3).df.collect()) == [0, 1]
    assert e.related(order, "placed_by").df.first()["customer_id"] == ann
    with pytest.raises(ValueError):
        e.traverse(order, "no_such")
    assert e.graph.connected_components().df.count() == 2 and e.graph.centrality("degree").df.count() == 2
    # a guard that does not pass changes nothing; a late event is folded where it belongs
    done = e.ingest("app", [upgrade("ann@x.org", "pro", 99, "2024-01-04T10:00:00Z"), upgrade("bob@x.org", "pro", 5, "2024-01-02T11:00:00Z")], process=True)
    assert done.build_result.late_arrivals == 2 and done.build_result.mode == "INCREMENTAL"
    rows = e.history("customer").df.filter(f"customer_id = '{bob}'").orderBy("valid_from").collect()
    assert [(r["customer_state"], r["plan"]) for r in rows] == [("trial", "free"), ("active", "pro")] and rows[0]["valid_to"] == rows[1]["valid_from"]
    assert e.history("customer").as_of("2024-01-02 10:30:00").df.filter("plan = 'free'").count() == 2
    # incremental builds give what a full build gives
    before = sorted(map(repr, e.history("customer").df.collect()))
    assert e.build(full=True).mode == "FULL"
    assert sorted(map(repr, e.history("customer").df.collect())) == before
    # SQL, timeline, assertions
    assert e.query("SELECT count(*) AS n FROM customer_history h JOIN relationships r ON r.target_id = h.customer_id").df.first()["n"] > 0
    for bad in ("SELECT nope FROM customer", "SELECT * FROM ghost"):
        with pytest.raises(QueryError):
            e.query(bad)
    told = e.timeline(bob)
    assert [x.effects for x in told.entries][0] == ["Entity created"] and "State: trial → active" in told.entries[1].effects and told.entries[0].event_type == "signup"
    assert e.timeline("ghost").entries == []
    e.assert_entity(bob, state="active", plan="pro")
    with pytest.raises(AssertionError, match="expected 'gone'"):
        e.assert_entity(bob, state="gone")
    with pytest.raises(AssertionError, match="not found"):
        e.assert_entity("ghost")
    # time rules
    done = e.tick("2024-12-01T00:00:00Z")
    assert done.transitions == 2 and {r["customer_state"] for r in e.table("customer").df.collect()} == {"gone"}
    assert e.tick("2024-12-02").effects_produced == 0
    # reopening
    again = connect(spark, e.root)
    assert again.table("customer").df.count() == 2 and again.ledger.count() == e.ledger.count() and again.ledger.count(source="till") == 1
    assert again.build_status().pending_events == 0 and again.ledger.events_for(bob).count() == 2
    again.ledger.export(str(tmp_path / "out"), since_sequence=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == again.ledger.count() - 2
    n = again.ledger.count()
    assert again.ledger.compact() > 1 and again.ledger.count() == n
    rows = sorted(map(repr, again.history("customer").df.collect()))
    assert again.vacuum() > 5 and again.vacuum() == 0 and again.ledger.count() == n
    assert sorted(map(repr, again.history("customer").df.collect())) == rows and again.build(full=True).mode == "FULL"


def test_shared_hints_merge(engine):
    e = engine
    ann, bob = e.identity.lookup("ann@x.org"), e.identity.lookup("bob@x.org")
    done = e.ingest("app", [signup("ann@x.org", "2", "2024-02-01T00:00:00Z")], process=True)
    assert done.build_result.merges_detected == 1
    winner, loser = min(ann, bob), max(ann, bob)
    assert e.identity.lookup("ann@x.org") == e.identity.lookup("bob@x.org") == winner
    assert e.table("customer").df.count() == 1
    stone = e.history("customer").df.filter(f"customer_id = '{loser}' and merged_into is not null").collect()
    assert [r["merged_into"] for r in stone] == [winner] and stone[0]["valid_to"] is not None
    assert e.history("customer").resolve_merges().df.count() == e.history("customer").df.count()
    assert e.table("customer").resolve_merges().df.filter(f"customer_id = '{loser}'").count() >= 1
    assert e.identity.merges(loser).count() == 1
    # erasing the winner takes the loser with it, and no build brings them back
    gone = e.erase(winner)
    assert gone.entities_erased == 2 and gone.events_deleted == 4 and e.ledger.count() == 0
    assert e.identity.lookup("ann@x.org") is None and e.history("customer").df.count() == 0
    with pytest.raises(NotFoundError):
        e.erase(winner)
    e.build(full=True)
    assert e.history("customer").df.count() == 0


def test_merge_by_hand_and_redaction(engine):
    e = engine
    ann, bob = e.identity.lookup("ann@x.org"), e.identity.lookup("bob@x.org")
    winner, loser = max(ann, bob), min(ann, bob)
    done = e.merge(loser, winner, "same person")
    assert done.tombstones_produced == 1 and e.identity.lookup("ann@x.org") == e.identity.lookup("bob@x.org") == winner
    assert [r["customer_id"] for r in e.table("customer").df.collect()] == [winner]
    e.build(full=True)
    assert e.identity.lookup("ann@x.org") == winner
    with pytest.raises(NotFoundError):
        e.merge("ghost", winner)
    assert e.redact(winner) == 3
    raws = [r["raw"] for r in e.ledger.frame().collect()]
    assert all(REDACTED in r and "@x.org" not in r for r in raws)


def test_versions_and_drafts(engine):
    e = engine
    first = e.definitions.active()
    draft = e.definitions.draft("v2")
    draft.add_property("customer", "tier", type="string", default="basic")
    told = e.definitions.register_draft(draft)
    assert told.build_mode == "FULL" and told.changes["modified"]["customer"]["added_properties"] == ["tier"]
    with pytest.raises(DefinitionError):
        e.definitions.register("v2", SHOP)
    assert e.definitions.activate("v2").mode == "FULL"
    assert {r["tier"] for r in e.table("customer").df.collect()} == {"basic"}
    assert "tier" not in e.version(first).table("customer").df.columns and e.version(first).query("SELECT * FROM customer").df.count() == 2
    assert e.diff(first, "v2")["customer"].count() == 0 and {v["version"] for v in e.definitions.versions()} == {first, "v2"}
    with pytest.raises(NotFoundError):
        e.version("v3")


def test_collections(engine, tmp_path):
    c = engine.tables("customer", ["order"])
    assert list(c) == ["customer", "order"] and len(engine.tables()) == 2
    told = c.to_graph_json()
    assert len(told["nodes"]) == 2 and told["edges"] == [] and all("entity_type" in n for n in told["nodes"])
    c.to_parquet(str(tmp_path / "p"))
    c.to_csv(str(tmp_path / "c"))
    c.snapshot(str(tmp_path / "s"))
    assert engine.spark.read.parquet(str(tmp_path / "p" / "customer.parquet")).count() == 2
    assert "valid_to" not in engine.spark.read.parquet(str(tmp_path / "s" / "customer.parquet")).columns
    c.to_duckdb(str(tmp_path / "d.db"))
    import duckdb

    assert duckdb.connect(str(tmp_path / "d.db")).sql("SELECT count(*) FROM customer").fetchall() == [(2,)]
    assert set(c.to_pandas()) == {"customer", "order"} and c.to_cypher() == []
    t = engine.table("customer")
    assert t.filter("plan = 'pro'").groupBy("plan").count().df.first()["count"] == 1 and t.to_pyarrow().num_rows == 2 and t.sql()
    with pytest.raises(QueryError):
        engine.table("ghost")


def test_refusals(spark, tmp_path):
    with pytest.raises(ConfigError):
        Engine(spark, None, str(tmp_path / "none"))
    with pytest.raises(DefinitionError):
        Engine(spark, {"entities": {"a": {}}}, str(tmp_path / "bad"))
    e = Engine(spark, SHOP, str(tmp_path / "ok"))
    assert e.ingest("app", []).events_ingested == 0 and e.build().mode == "FULL" and e.table("customer").df.count() == 0
    with pytest.raises(NotFoundError):
        e.ingest("ghost", [])


def test_manifests_never_overwrite(spark, tmp_path):
    m = ManifestStore(spark, str(tmp_path / "m"))
    assert m.read() == (0, {}) and m.commit(0, {"a": 1}) == 1
    with pytest.raises(StorageError):
        m.commit(0, {"a": 2})
    assert m.read() == (1, {"a": 1}) and m.versions() == [1]


def test_strict_stores_hold_events_to_their_schemas(spark, tmp_path):
    import copy

    data = copy.deepcopy(SHOP)
    data["schemas"] = {
        "signup": {"fields": {"email": {"type": "string", "required": True, "regex": "@"}, "phone": {"type": "string", "min_length": 2}}},
        "upgrade": {"fields": {"email": {"type": "string"}, "plan": {"type": "string", "allowed": ["pro", "max"]}, "paid": {"type": "number", "min": 1, "max": 99}}},
        "ordered": {"fields": {"order": {"type": "string"}, "email": {"type": "string"}, "total": {"type": "number"}}},
    }
    at = "2024-01-03T10:00:00Z"
    events = [signup("a@x.org", "12"), signup(None, "12"), signup("a.x.org", "12"), signup("a@x.org", "1"), upgrade("a@x.org", "free", 5, at), upgrade("a@x.org", "pro", 0.5, at), upgrade("a@x.org", "pro", 100, at), upgrade("a@x.org", "max", 99, at)]
    done = Engine(spark, data, str(tmp_path / "strict"), strict=True).ingest("app", events)
    assert done.events_ingested == 2
    assert sorted(f.error for f in done.failures) == sorted(["field 'email': required", "field 'email': does not match its pattern", "field 'phone': shorter than 2", "field 'plan': not an allowed value", "field 'paid': below 1", "field 'paid': above 99"])
    assert Engine(spark, data, str(tmp_path / "loose")).ingest("app", events).events_ingested == 8
