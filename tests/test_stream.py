import json

from pyspark.sql import functions as F

from chronofold.plans.fold import EntityFold, fold_entities
from chronofold.queries import USER_DEFS
from chronofold.sources.normalize import Normalizer
from chronofold.streaming.stream import Consumer, Sink, fold_stream, publish, read_effects, read_raw, settled, to_kafka


def lines(events):
    return "\n".join(json.dumps(e) for e in events)


def test_a_stream_folds_as_a_batch_does(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    first = [{"type": "signup", "at": "2024-01-01T00:00:00Z", "user_id": k, "value": 1} for k in range(3)]
    second = [{"type": "purchase", "at": f"2024-01-0{2 + k}T00:00:00Z", "user_id": k, "value": 30 + k} for k in range(3)] + [{"type": "purchase", "at": "2024-01-20T00:00:00Z", "user_id": 0, "value": 50}, {"bad": 1}]
    norm = Normalizer(USER_DEFS)

    def keyed(df):
        n = norm.normalize(df, "web").filter("error is null")
        return n.select(F.col("data.user").cast("string").alias("entity_id"), "ts", "event_type", "event_id", "data")

    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")
    counts = []
    consumer = Consumer(fold_stream(keyed(read_raw(spark, str(raw), 1)), USER_DEFS, "user"), out, checkpoint, lambda b, n: counts.append(n))
    (raw / "a.json").write_text(lines(first))
    assert consumer.run_once().batches_written >= 1
    (raw / "b.json").write_text(lines(second))
    consumer.run_once()
    (raw / "c.json").write_text(lines([{"type": "purchase", "at": "2024-01-05T00:00:00Z", "user_id": 0, "value": 99}]))
    consumer.run_once()
    rows = spark.read.parquet(out)
    late = rows.filter("late").collect()
    assert [r["entity_id"] for r in late] == ["0"]
    got = sorted((r["entity_id"], r["state"], json.loads(r["properties"])["spent"], str(r["valid_from"])) for r in rows.filter("not late").collect())
    batch = keyed(spark.createDataFrame([(json.dumps(e),) for e in first + second], "raw string")).withColumn("seq", F.lit(0))
    folded = fold_entities(batch, EntityFold(USER_DEFS.entities["user"], norm.kinds)).select("entity_id", F.explode("snaps").alias("s"))
    want = sorted((r["entity_id"], r["s"]["state"], r["s"]["p_spent"], str(r["s"]["valid_from"])) for r in folded.collect())
    assert got == want and ("0", "dormant", 30.0, "2024-01-07 00:00:00") in got
    assert len(counts) >= 2 and consumer.status().last_write_time is not None
    told = to_kafka(rows.filter("not late")).first()
    assert json.loads(told["value"])["entity_id"] == told["key"]
    consumer.close()


def test_a_failed_entity_takes_in_no_more(spark, tmp_path):
    from chronofold.plans.definitions import Definitions

    data = USER_DEFS.to_dict()
    data["entities"]["user"]["always"] = {"error": {"effects": [{"increment": {"property": "errors"}}]}}
    defs = Definitions(data)
    raw = tmp_path / "raw"
    raw.mkdir()
    at = lambda d: f"2024-01-{d:02d}T00:00:00Z"
    (raw / "a.json").write_text(lines([{"type": "error", "at": at(1), "user_id": 1, "value": 1}, {"type": "signup", "at": at(2), "user_id": 2, "value": 1}]))
    norm = Normalizer(defs).normalize(read_raw(spark, str(raw), 1), "web").filter("error is null")
    keyed = norm.select(F.col("data.user").cast("string").alias("entity_id"), "ts", "event_type", "event_id", "data")
    consumer = Consumer(fold_stream(keyed, defs, "user"), str(tmp_path / "out"), str(tmp_path / "check"))
    consumer.run_once()
    (raw / "b.json").write_text(lines([{"type": "signup", "at": at(3), "user_id": 1, "value": 1}, {"type": "error", "at": at(3), "user_id": 2, "value": 1}]))
    consumer.run_once()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert [(r["entity_id"], r["error"]) for r in rows.filter("error is not null").collect()] == [("1", "increment on an entity that does not exist")]
    assert rows.filter("entity_id = '1'").count() == 1 and {r["entity_id"] for r in settled(rows).collect()} == {"2"} and settled(rows).count() == 2


def test_effects_by_way_of_a_sink(spark, tmp_path):
    sink = Sink("json", path=str(tmp_path / "topic"))
    schema = "entity_id string, entity_type string, state string, properties string, valid_from timestamp, last_event_time timestamp, state_entered_time timestamp, created_time timestamp, event_id string, late boolean, error string, merged_into string"
    import datetime as dt

    day = dt.datetime(2024, 1, 1)
    rows = [("a", "user", "on", "{}", day, day, day, day, "e", False, None, None), ("b", "user", None, None, day, None, None, None, None, False, None, None), ("c", "user", "on", "{}", day, day, day, day, "e", False, None, "a")]
    publish(spark.createDataFrame(rows, schema), sink)
    seen = []
    Consumer(read_effects(spark, sink), str(tmp_path / "out"), str(tmp_path / "check"), lambda batch, n: seen.extend((r["entity_id"], r["kind"], r["state"], r["valid_from"]) for r in batch.collect())).run_once()
    assert sorted(seen) == [("a", "snapshot", "on", day), ("b", "delete", None, day), ("c", "tombstone", "on", day)]
    import pytest

    for bad in ({"format": "kafka", "path": "x"}, {"format": "json"}, {"format": "kafka", "servers": "s"}):
        with pytest.raises(ValueError):
            Sink(**bad)
