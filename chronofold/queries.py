"""Queries over the driver's tables, one for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.functions.compile import Compiler, column_env
from chronofold.operators import graph as G
from chronofold.operators import history as H
from chronofold.operators import identity as I
from chronofold.plans.definitions import Definitions
from chronofold.plans.fold import EntityFold, fold_entities
from chronofold.query import Table, Views
from chronofold.session import cut, scratch_path, spread
from chronofold.sources.normalize import Normalizer, failures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            if spark.conf.get("spark.sql.session.timeZone") != "UTC":
                spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS")


# --- ingestion -------------------------------------------------------------------------------------------------------

#: A user's life in the events table.
USER_DEFS = Definitions(
    {
        "entities": {
            "user": {
                "starts": "lead",
                "identity": {"user": {"match": "exact"}},
                "properties": {
                    "user": {"type": "integer"},
                    "purchases": {"type": "integer", "default": 0},
                    "spent": {"type": "number", "default": 0.0},
                    "errors": {"type": "integer", "default": 0},
                    "average": {"type": "number", "compute": "if entity.purchases > 0 then entity.spent / entity.purchases else 0.0"},
                },
                "states": {
                    "lead": {
                        "when": {
                            "signup": {"effects": ["create", {"set": {"property": "user", "from": "event.user"}}]},
                            "purchase": {
                                "guard": "event.amount > 20",
                                "effects": [{"increment": {"property": "purchases"}}, {"set": {"property": "spent", "compute": "entity.spent + event.amount"}}, {"transition": {"to": "customer"}}],
                            },
                        }
                    },
                    "customer": {
                        "when": {"purchase": {"guard": "event.amount > 20", "effects": [{"increment": {"property": "purchases"}}, {"set": {"property": "spent", "compute": "entity.spent + event.amount"}}]}},
                        "after": [{"type": "inactivity", "threshold": "5d", "effects": [{"transition": {"to": "dormant"}}]}],
                    },
                    "dormant": {"when": {"purchase": {"guard": "event.amount > 20", "effects": [{"increment": {"property": "purchases"}}, {"set": {"property": "spent", "compute": "entity.spent + event.amount"}}, {"transition": {"to": "customer"}}]}}},
                },
            },
        },
        "sources": {
            "web": {
                "event_type": "type",
                "timestamp": "at",
                "events": {
                    name: {"mappings": {"user": {"from": "user_id", "type": "integer"}, "amount": {"from": "value", "type": "number"}, "k": {"from": "props.k", "type": "integer", "default": -1}}, "hints": {"user": ["user"]}}
                    for name in ("signup", "purchase", "view", "click", "error")
                },
            }
        },
    }
)


def _raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as raw JSON, in the order of its ids."""
    e = spread(_t(spark, sf_dir, "events"))
    body = F.struct(
        F.col("event_type").alias("type"),
        F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("at"),
        "user_id",
        "value",
        F.from_json("props", "k int").alias("props"),
    )
    return e.select(F.col("event_id").alias("sequence"), F.to_json(body).alias("raw"))


def _normal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Normalizer(USER_DEFS).normalize(_raw_events(spark, sf_dir), "web")


@_query("""
    SELECT event_id AS sequence, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at, user_id AS "user", round(value, 4) AS amount,
           coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) AS k, 'user' AS hint_type, CAST(user_id AS VARCHAR) AS hint_value
    FROM events
""")
def normalize_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _normal_events(spark, sf_dir)
    return e.select("sequence", "event_type", _text(F.col("ts")).alias("at"), "data.user", F.round("data.amount", 4).alias("amount"), "data.k", F.col("hints")[0]["entity_type"].alias("hint_type"), F.col("hints")[0]["value"].alias("hint_value"))


@_query("""
    SELECT event_id AS sequence,
           CASE event_id % 4 WHEN 0 THEN 'unknown event type: nothing' WHEN 1 THEN 'missing or malformed timestamp ''at''' WHEN 2 THEN 'field ''amount'': cannot read as number: many'
                ELSE 'not a JSON event' END AS error, 'normalization' AS stage, 'web' AS source
    FROM events
""")
def normalize_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    bad = F.when(F.col("event_id") % 4 == 0, F.to_json(F.struct(F.lit("nothing").alias("type")))).when(F.col("event_id") % 4 == 1, F.to_json(F.struct("event_type", F.col("event_type").alias("type"), F.lit("soon").alias("at"))))
    bad = bad.when(F.col("event_id") % 4 == 2, F.to_json(F.struct(F.col("event_type").alias("type"), F.lit(1700000000).alias("at"), F.lit("many").alias("value")))).otherwise(F.lit("{oops"))
    normal = Normalizer(USER_DEFS).normalize(e.select(F.col("event_id").alias("sequence"), bad.alias("raw")), "web")
    return failures(normal, keep=["sequence"]).select("sequence", "error", "stage", "source")


@_query("""
    SELECT event_id AS sequence,
           'e_' || sha256(event_type || '|[["amount",{"Float":' || CAST(CAST(round(value) AS DOUBLE) AS VARCHAR) || '}],["k",' || '{"Int":' || CAST(json_extract(props, '$.k') AS VARCHAR)
                  || '}],["user",{"Int":' || CAST(user_id AS VARCHAR) || '}]]') AS event_id
    FROM events
""")
def event_id_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _t(spark, sf_dir, "events").select(
        F.col("event_id").alias("sequence"),
        F.to_json(F.struct(F.col("event_type").alias("type"), F.lit(1700000000).alias("at"), "user_id", F.round("value").cast("double").alias("value"), F.from_json("props", "k int").alias("props"))).alias("raw"),
    )
    return Normalizer(USER_DEFS).normalize(raw, "web").select("sequence", "event_id")


@_query("""
    WITH again AS (SELECT event_id AS sequence, event_type, user_id, value FROM events UNION ALL SELECT event_id + 10000000, event_type, user_id, value FROM events WHERE event_id % 3 = 0)
    SELECT min(sequence) AS sequence, event_type, user_id AS "user", count(*) AS seen FROM again GROUP BY event_type, user_id, value
""")
def dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    again = e.select("event_id", "event_type", "user_id", "value").unionByName(e.filter("event_id % 3 = 0").select((F.col("event_id") + 10000000).alias("event_id"), "event_type", "user_id", "value"))
    raw = again.select(F.col("event_id").alias("sequence"), F.to_json(F.struct(F.col("event_type").alias("type"), F.lit(1700000000).alias("at"), "user_id", "value")).alias("raw"))
    n = Normalizer(USER_DEFS).normalize(raw, "web")
    first = n.groupBy("event_id").agg(F.min("sequence").alias("sequence"), F.count("*").alias("seen"))
    return n.join(first, ["event_id", "sequence"]).select("sequence", "event_type", "data.user", "seen")


# --- expressions -----------------------------------------------------------------------------------------------------


def _compiled(df: DataFrame, kinds: dict[str, str], keys: list[str], **texts: str) -> DataFrame:
    """Expressions of the language over a frame's columns; errors give null."""
    compile_ = Compiler(column_env(kinds), F.lit("2024-06-01 00:00:00").cast("timestamp"))
    out = []
    for name, text in texts.items():
        got = compile_(text)
        value = got.value if got.error is None else F.when(got.error.isNull(), got.value)
        out.append((_text(value) if got.kind == "datetime" else F.round(value, 6) if got.kind == "number" else value).alias(name))
    return df.select(*keys, *out)


@_query("""
    SELECT c_custkey, lower(c_name) AS low, upper(c_mktsegment) AS up, trim('  ' || c_mktsegment || ' ') AS trimmed, substr(c_name, 3, 4) AS part, starts_with(c_name, 'Customer') AS starts,
           ends_with(c_name, '7') AS ends, contains(c_name, '00') AS has, replace(c_mktsegment, 'E', '3') AS replaced, regexp_matches(c_name, '[0-9]+5$') AS matched,
           CASE WHEN regexp_matches(c_name, '#?0*([1-9][0-9]*)') THEN regexp_extract(c_name, '#?0*([1-9][0-9]*)', 1) END AS extracted, strlen(c_name) AS bytes,
           string_split(c_mktsegment, 'I')[1] AS first_part, array_to_string(string_split(c_mktsegment, 'I'), '-') AS joined, c_name || '/' || c_mktsegment AS together, substr(c_name, -1) AS last_char
    FROM customer
""")
def fn_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compiled(
        _t(spark, sf_dir, "customer"), {"c_name": "string", "c_mktsegment": "string"}, ["c_custkey"],
        low="str::to_lowercase(c_name)", up="str::to_uppercase(c_mktsegment)", trimmed="str::trim('  ' + c_mktsegment + ' ')", part="str::substring(c_name, 2, 4)", starts="starts_with(c_name, 'Customer')",
        ends="ends_with(c_name, '7')", has="contains(c_name, '00')", replaced="replace(c_mktsegment, 'E', '3')", matched="regex_match(c_name, '[0-9]+5$')",
        extracted="regex_extract(c_name, '#?0*([1-9][0-9]*)')", bytes="len(c_name)", first_part="split(c_mktsegment, 'I')[0]", joined="join(split(c_mktsegment, 'I'), '-')", together="c_name + '/' + c_mktsegment", last_char="c_name[-1]",
    )


@_query("""
    SELECT o_orderkey, round(abs(o_totalprice - 100000), 6) AS off, CAST(floor(o_totalprice) AS BIGINT) AS down, CAST(ceil(o_totalprice) AS BIGINT) AS up, CAST(round(o_totalprice) AS BIGINT) AS near,
           round(least(o_totalprice, 50000.0), 6) AS low, greatest(o_custkey, 500) AS high, o_orderkey // 7 AS sevenths, round(o_totalprice / 3, 6) AS third, (o_custkey % 10) ** 2 AS square_input_free,
           -o_custkey AS negative, CAST(CASE WHEN o_custkey = 7 THEN NULL ELSE trunc(1000.0 / (o_custkey - 7)) END AS BIGINT) AS guarded
    FROM (SELECT *, 0 FROM orders)
""".replace("(o_custkey % 10) ** 2 AS square_input_free", "CAST(o_custkey * o_custkey AS BIGINT) AS square"))
def fn_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compiled(
        _t(spark, sf_dir, "orders"), {"o_totalprice": "number", "o_custkey": "integer", "o_orderkey": "integer"}, ["o_orderkey"],
        off="math::abs(o_totalprice - 100000)", down="floor(o_totalprice)", up="ceil(o_totalprice)", near="round(o_totalprice)", low="min(o_totalprice, 50000)", high="max(o_custkey, 500)", sevenths="o_orderkey / 7",
        third="o_totalprice / 3", square="o_custkey ** 2", negative="-o_custkey", guarded="1000 / (o_custkey - 7)",
    )


@_query("""
    SELECT event_id, CAST(year(ts) AS BIGINT) AS y, CAST(month(ts) AS BIGINT) AS m, CAST(day(ts) AS BIGINT) AS d, CAST(hour(ts) AS BIGINT) AS h, CAST(minute(ts) AS BIGINT) AS mi, CAST(isodow(ts) - 1 AS BIGINT) AS weekday,
           strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S.%f') AS hour_start, CAST(abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:30:00')) // 86400000000 AS BIGINT) AS days,
           CAST(abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:30:00')) // 3600000000 AS BIGINT) AS hours, CAST(abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:30:00')) // 60000000 AS BIGINT) AS minutes,
           CAST(abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-06-01 00:00:00')) // 86400000000 AS BIGINT) AS since, strftime(ts + INTERVAL 36 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS later,
           ts > TIMESTAMP '2024-01-15 12:30:00' AS after_it
    FROM events
""")
def fn_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    mid = "parse_datetime('2024-01-15 12:30:00', '%Y-%m-%d %H:%M:%S')"
    return _compiled(
        e, {"ts": "datetime"}, ["event_id"], y="year_of(ts)", m="month_of(ts)", d="day_of(ts)", h="hour_of(ts)", mi="minute_of(ts)", weekday="day_of_week(ts)", hour_start="date_trunc(ts, 'hour')",
        days=f"days_between(ts, {mid})", hours=f"hours_between(ts, {mid})", minutes=f"minutes_between(ts, {mid})", since="days_since(ts)", later="ts + 1d + 12h", after_it=f"ts > {mid}",
    )


@_query("""
    SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS as_text, TRY_CAST(o_orderpriority[1] AS BIGINT) AS priority, CAST(o_custkey AS DOUBLE) AS as_number, CAST(trunc(o_totalprice) AS BIGINT) AS cut,
           coalesce(nullif(o_orderstatus, 'O'), 'open') AS status, CAST(o_orderstatus = 'F' AS BIGINT) AS flag
    FROM orders
""")
def fn_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compiled(
        _t(spark, sf_dir, "orders"), {"o_orderkey": "integer", "o_orderpriority": "string", "o_custkey": "integer", "o_totalprice": "number", "o_orderstatus": "string"}, ["o_orderkey"],
        as_text="to_string(o_orderkey)", priority="to_int(o_orderpriority[0])", as_number="to_float(o_custkey)", cut="to_int(o_totalprice)", status="coalesce(if o_orderstatus == 'O' then null else o_orderstatus, 'open')", flag="to_int(o_orderstatus == 'F')",
    )


@_query("""
    SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) + l_tax, 6) AS net, l_quantity > 20 AND l_returnflag = 'R' AS both, l_quantity > 20 OR NOT (l_returnflag = 'R') AS either,
           CASE WHEN l_discount >= 0.05 THEN 'high' ELSE 'low' END AS band, l_linenumber <> 3 AS other, l_orderkey - l_partkey * 2 AS mixed, power(2.0, l_linenumber) AS power
    FROM lineitem
""")
def fn_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"l_quantity": "number", "l_extendedprice": "number", "l_discount": "number", "l_tax": "number", "l_returnflag": "string", "l_linenumber": "integer", "l_orderkey": "integer", "l_partkey": "integer"}
    df = _t(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("long"))
    return _compiled(
        df, kinds, ["l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber")],
        net="l_extendedprice * (1 - l_discount) + l_tax", both="l_quantity > 20 and l_returnflag == 'R'", either="l_quantity > 20 || !(l_returnflag == 'R')", band="if l_discount >= 0.05 then 'high' else 'low'",
        other="l_linenumber != 3", mixed="l_orderkey - l_partkey * 2", power="2.0 ** l_linenumber",
    )


@_query("SELECT event_id, user_id, round(value, 4) AS value FROM events WHERE event_type = 'purchase' AND value * 2 > 60 AND NOT (user_id < 20)")
def guard_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    guard = Compiler(column_env({"event_type": "string", "value": "number", "user_id": "integer"}))("event_type == 'purchase' and value * 2 > 60 and not (user_id < 20)")
    return e.filter(guard.value & (guard.error.isNull() if guard.error is not None else F.lit(True))).select("event_id", "user_id", F.round("value", 4).alias("value"))


# --- state machine ---------------------------------------------------------------------------------------------------


def _user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the entity that they belong to: the user's number, as its own id."""
    e = _normal_events(spark, sf_dir).filter("error is null")
    return e.select(F.col("data.user").cast("string").alias("entity_id"), "ts", F.col("sequence").alias("seq"), "event_type", "event_id", "data")


def _user_fold(spark: SparkSession, sf_dir: str, rules: bool = True) -> tuple[DataFrame, EntityFold]:
    defs = USER_DEFS
    if not rules:
        data = USER_DEFS.to_dict()
        del data["entities"]["user"]["states"]["customer"]["after"]
        defs = Definitions(data)
    fold = EntityFold(defs.entities["user"], defs.field_kinds(), F.lit("2024-06-01").cast("timestamp"))
    return fold_entities(_user_events(spark, sf_dir), fold), fold


#: Snapshots of USER_DEFS without and with its time rule, worked out by windows.
_USER_SQL = """
    WITH born AS (SELECT user_id, min(ts) AS born FROM events WHERE event_type = 'signup' GROUP BY user_id),
    told AS (
        SELECT user_id, ts, event_id, event_type, value,
               count(*) FILTER (WHERE event_type = 'purchase') OVER w AS purchases, coalesce(sum(value) FILTER (WHERE event_type = 'purchase') OVER w, 0) AS spent,
               max(ts) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
        FROM events JOIN born USING (user_id)
        WHERE ts >= born AND (event_type = 'signup' OR event_type = 'purchase' AND value > 20)
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    kept AS (SELECT * FROM told WHERE event_type = 'purchase' OR purchases = 0),
    {extra}
    closed AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS valid_to FROM snaps)
"""
_USER_PLAIN = _USER_SQL.format(extra="snaps AS (SELECT user_id, ts, CASE WHEN purchases > 0 THEN 'customer' ELSE 'lead' END AS state, purchases, spent FROM kept),")
_USER_RULES = _USER_SQL.format(
    extra="""snaps AS (
        SELECT user_id, ts, CASE WHEN purchases > 0 THEN 'customer' ELSE 'lead' END AS state, purchases, spent FROM kept
        UNION ALL
        SELECT user_id, ts + INTERVAL 5 DAY, 'dormant', purchases, spent
        FROM (SELECT *, lead(seen) OVER (PARTITION BY user_id ORDER BY seen, event_id) AS next_event FROM (
                SELECT e.user_id, e.ts AS seen, e.event_id, k.ts, k.purchases, k.spent FROM events e ASOF JOIN (SELECT * FROM kept WHERE purchases > 0) k ON e.user_id = k.user_id AND e.ts >= k.ts))
        WHERE seen <= ts + INTERVAL 5 DAY AND next_event > ts + INTERVAL 5 DAY),"""
)


def _user_select(df: DataFrame) -> DataFrame:
    return df.select("user", F.col("user_state").alias("state"), "purchases", F.round("spent", 3).alias("spent"), _text(F.col("valid_from")).alias("valid_from"), _text(F.col("valid_to")).alias("valid_to"))


_USER_OUT = """user_id AS "user", state, CAST(purchases AS BIGINT) AS purchases, round(spent, 3) AS spent, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS valid_from, strftime(valid_to, '%Y-%m-%d %H:%M:%S.%f') AS valid_to FROM closed"""


@_query(f"{_USER_PLAIN} SELECT {_USER_OUT}")
def state_fold_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded, fold = _user_fold(spark, sf_dir, rules=False)
    return _user_select(H.entity_rows(folded, fold.entity))


@_query(f"{_USER_RULES} SELECT {_USER_OUT}")
def time_rule_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded, fold = _user_fold(spark, sf_dir)
    return _user_select(H.entity_rows(folded, fold.entity))


@_query(f"{_USER_PLAIN} SELECT {_USER_OUT} WHERE valid_to IS NULL")
def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded, fold = _user_fold(spark, sf_dir, rules=False)
    return _user_select(H.current(H.entity_rows(folded, fold.entity)))


@_query(f"{_USER_PLAIN} SELECT {_USER_OUT} WHERE ts <= TIMESTAMP '2024-01-12 06:00:00' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-12 06:00:00')")
def as_of_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded, fold = _user_fold(spark, sf_dir, rules=False)
    return _user_select(Table(H.entity_rows(folded, fold.entity), "user").as_of("2024-01-12 06:00:00").df)


@_query(f"""{_USER_PLAIN}, b AS (SELECT *, lag(state) OVER w AS was_state, lag(purchases) OVER w AS was_purchases, lag(spent) OVER w AS was_spent, row_number() OVER w AS n FROM closed WINDOW w AS (PARTITION BY user_id ORDER BY ts))
    SELECT CAST(user_id AS VARCHAR) AS entity_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at, was_state AS state_before, state AS state_after,
           CASE WHEN n = 1 THEN 'Entity created' ELSE array_to_string(list_filter([CASE WHEN state <> was_state THEN 'State: ' || was_state || ' → ' || state END,
                CASE WHEN purchases <> was_purchases THEN 'purchases: ' || was_purchases || ' → ' || purchases END], lambda x: x IS NOT NULL), '; ') END AS effects
    FROM b
""")
def timeline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded, fold = _user_fold(spark, sf_dir, rules=False)
    told = H.timeline(H.entity_rows(folded, fold.entity), "user", ["purchases"])
    return told.select("entity_id", _text(F.col("timestamp")).alias("at"), "state_before", "state_after", F.array_join("effects", "; ").alias("effects"))


@_query(f"""{_USER_PLAIN}, now AS (SELECT * FROM closed WHERE valid_to IS NULL AND state = 'customer')
    SELECT CAST(user_id AS VARCHAR) AS entity_id, 'dormant' AS state, strftime(ts + INTERVAL 5 DAY, '%Y-%m-%d %H:%M:%S.%f') AS entered FROM now WHERE TIMESTAMP '2024-02-02 00:00:00' - ts > INTERVAL 5 DAY
""")
def time_rule_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain, _ = _user_fold(spark, sf_dir, rules=False)
    fold = EntityFold(USER_DEFS.entities["user"], USER_DEFS.field_kinds())
    at = F.lit("2024-02-02 00:00:00").cast("timestamp")
    ticked = plain.withColumn("t", fold.time_rules(F.col("s"), at)).filter("t.fired")
    return ticked.select("entity_id", F.col("t.state").alias("state"), _text(F.col("t.entered")).alias("entered"))


@_query("""
    SELECT CAST(user_id AS VARCHAR) AS entity_id, 'increment on an entity that does not exist' AS error FROM events
    GROUP BY user_id HAVING min(ts) FILTER (WHERE event_type = 'error') < min(ts) FILTER (WHERE event_type = 'signup') OR (count(*) FILTER (WHERE event_type = 'signup') = 0 AND count(*) FILTER (WHERE event_type = 'error') > 0)
""")
def always_handler_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An always handler that comes before the entity fails the entity, and it alone."""
    data = USER_DEFS.to_dict()
    data["entities"]["user"]["always"] = {"error": {"effects": [{"increment": {"property": "errors"}}]}}
    defs = Definitions(data)
    folded = fold_entities(_user_events(spark, sf_dir), EntityFold(defs.entities["user"], defs.field_kinds()))
    return folded.filter("err is not null").select("entity_id", F.col("err").alias("error"))


@_query("""
    WITH born AS (SELECT user_id, min(ts) AS born FROM events WHERE event_type = 'signup' GROUP BY user_id)
    SELECT CAST(user_id AS VARCHAR) AS entity_id, count(*) FILTER (WHERE event_type = 'error' AND ts > born) AS errors,
           round(coalesce(max(value) FILTER (WHERE event_type = 'view' AND ts > born), 0), 4) AS best
    FROM events JOIN born USING (user_id) GROUP BY user_id
""")
def effect_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions see what earlier effects of the handler have done."""
    body = {
        "starts": "on", "identity": {"user": {}}, "properties": {"best": {"type": "number", "default": 0.0}, "errors": {"type": "integer", "default": 0}},
        "states": {"on": {"when": {"signup": {"effects": ["create"]}, "error": {"effects": [{"increment": {"property": "errors"}}]}, "view": {"effects": [{"set": {"property": "best", "from": "event.amount", "condition": "event.amount > entity.best"}}]}}}},
    }
    defs = Definitions({"entities": {"user": body}, "sources": USER_DEFS.to_dict()["sources"]})
    folded = fold_entities(_user_events(spark, sf_dir), EntityFold(defs.entities["user"], defs.field_kinds()))
    return folded.filter("s.alive").select("entity_id", F.col("s.p_errors").alias("errors"), F.round("s.p_best", 4).alias("best"))


# --- several entities, relationships ---------------------------------------------------------------------------------

ORDER_DEFS = Definitions(
    {
        "entities": {
            "customer": {
                "starts": "known", "identity": {"customer": {}}, "properties": {"orders": {"type": "integer", "default": 0}}, "relationships": [{"type": "placed", "target": "order", "cardinality": "has_many"}],
                "states": {"known": {"when": {"placed": {"effects": ["create", {"increment": {"property": "orders"}}]}}}},
            },
            "order": {
                "starts": "open", "identity": {"order": {}}, "properties": {"total": {"type": "number"}, "lines": {"type": "integer", "default": 0}},
                "relationships": [{"type": "placed_by", "target": "customer", "cardinality": "belongs_to"}],
                "states": {
                    "open": {"when": {
                        "placed": {"effects": ["create", {"set": {"property": "total", "from": "event.total"}}, {"relate": {"type": "placed_by", "target": "customer", "hints": {"customer": ["customer"]}}}]},
                        "shipped": {"effects": [{"increment": {"property": "lines"}}, {"transition": {"to": "shipped"}}]},
                    }},
                    "shipped": {"when": {"shipped": {"effects": [{"increment": {"property": "lines"}}]}}},
                },
            },
        },
        "sources": {
            "shop": {"event_type": "type", "timestamp": "at", "events": {
                "placed": {"mappings": {"order": {"from": "order", "type": "string"}, "customer": {"from": "customer", "type": "string"}, "total": {"from": "total", "type": "number"}}, "hints": {"order": ["order"], "customer": ["customer"]}},
            }},
            "dock": {"event_type": "type", "timestamp": "at", "event_id": ["order", "line"], "events": {
                "shipped": {"mappings": {"order": {"from": "order", "type": "string"}, "line": {"from": "line", "type": "integer"}}, "hints": {"order": ["order"]}},
            }},
        },
    }
)


def _order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = Normalizer(ORDER_DEFS)
    at = lambda c: F.concat(F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("at")
    o, li = spread(_t(spark, sf_dir, "orders")), spread(_t(spark, sf_dir, "lineitem"))
    placed = o.select(F.col("o_orderkey").alias("sequence"), F.to_json(F.struct(F.lit("placed").alias("type"), at("o_orderdate"), F.concat(F.lit("o"), "o_orderkey").alias("order"), F.concat(F.lit("c"), "o_custkey").alias("customer"), F.col("o_totalprice").alias("total"))).alias("raw"))
    shipped = li.select((F.lit(10**12) + F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("sequence"), F.to_json(F.struct(F.lit("shipped").alias("type"), at("l_shipdate"), F.concat(F.lit("o"), "l_orderkey").alias("order"), F.col("l_linenumber").alias("line"))).alias("raw"))
    return norm.normalize(placed, "shop").unionByName(norm.normalize(shipped, "dock")).filter("error is null").drop("raw", "error")


def _order_fold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, EntityFold]:
    fold = EntityFold(ORDER_DEFS.entities["order"], ORDER_DEFS.field_kinds())
    e = _order_events(spark, sf_dir)
    keyed = e.select(F.col("data.order").alias("entity_id"), "ts", F.col("sequence").alias("seq"), "event_type", "event_id", "data", I.candidate_id(F.lit("customer"), F.col("data.customer")).alias("_link_customer_customer"))
    return fold_entities(keyed, fold), fold


@_query("""
    WITH placed AS (SELECT o_orderkey, o_orderdate AS placed_at, o_totalprice FROM orders),
    lines AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS n FROM lineitem JOIN placed ON l_orderkey = o_orderkey WHERE l_shipdate >= placed_at)
    SELECT 'o' || o_orderkey AS order_id, CASE WHEN coalesce(max(n), 0) > 0 THEN 'shipped' ELSE 'open' END AS state, round(o_totalprice, 4) AS total, CAST(coalesce(max(n), 0) AS BIGINT) AS lines
    FROM placed LEFT JOIN lines ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice
""")
def order_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded, _ = _order_fold(spark, sf_dir)
    return folded.filter("s.alive").select(F.col("entity_id").alias("order_id"), F.col("s.state").alias("state"), F.round("s.p_total", 4).alias("total"), F.col("s.p_lines").alias("lines"))


@_query("""
    SELECT 'o' || o_orderkey AS source_id, 'customer_' || substr(sha256('customer|c' || o_custkey), 1, 24) AS target_id, 'placed_by' AS relationship_type, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS valid_from, CAST(NULL AS VARCHAR) AS valid_to
    FROM orders
""")
def relationship_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded, _ = _order_fold(spark, sf_dir)
    return H.relationship_rows(folded).select("source_id", "target_id", "relationship_type", _text(F.col("valid_from")).alias("valid_from"), _text(F.col("valid_to")).alias("valid_to"))


@_query("""
    WITH s AS (SELECT l_orderkey AS id, l_shipdate AS valid_from, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey, l_shipdate ORDER BY l_linenumber) AS n FROM lineitem)
    SELECT id, l_linenumber AS line, strftime(valid_from, '%Y-%m-%d') AS valid_from, strftime(lead(valid_from) OVER (PARTITION BY id ORDER BY valid_from), '%Y-%m-%d') AS valid_to FROM s WHERE n = 1
""")
def scd_close_and_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("valid_from"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return H.close_and_insert(s, "id", order=["line"]).select("id", "line", day("valid_from"), day("valid_to"))


# --- identity --------------------------------------------------------------------------------------------------------


def _household_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that name themselves, their household of five, and, every 25th, the household after theirs."""
    c = _t(spark, sf_dir, "customer")
    hint = lambda field, value: F.struct(F.lit("person").alias("entity_type"), F.lit(field).alias("field"), value.alias("value"))
    house = F.floor((F.col("c_custkey") - 1) / 5)
    more = F.when(F.col("c_custkey") % 25 == 0, F.array(hint("house", F.concat(F.lit("h"), house + 1))))
    base = F.array(hint("key", F.concat(F.lit("k"), "c_custkey")), hint("house", F.concat(F.lit("h"), house)))
    return c.select(F.col("c_custkey").alias("sequence"), F.concat(base, F.coalesce(more, F.filter(base, lambda x: F.lit(False)))).alias("hints"))


_HOUSE_SQL = """
    WITH h AS (SELECT c_custkey, 'k' || c_custkey AS key, CAST(floor((c_custkey - 1) / 5.0) AS BIGINT) AS house FROM customer),
    grp AS (SELECT *, CASE WHEN house % 5 = 0 AND EXISTS (SELECT 1 FROM customer x WHERE x.c_custkey = house * 5) THEN house - 1 ELSE house END AS g FROM h),
    named AS (SELECT key AS value, g FROM grp UNION SELECT 'h' || house, g FROM grp UNION SELECT 'h' || (house + 1), g FROM grp WHERE c_custkey % 25 = 0),
    ids AS (SELECT value, min('person_' || substr(sha256('person|' || value), 1, 24)) OVER (PARTITION BY g) AS entity_id FROM (
        SELECT value, min(g) AS g FROM named GROUP BY value))
"""


@_query(f"{_HOUSE_SQL} SELECT 'person' AS entity_type, value, entity_id FROM ids")
def identity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.resolve(_household_events(spark, sf_dir)).select("entity_type", "value", "entity_id")


@_query(f"{_HOUSE_SQL} SELECT c_custkey AS sequence, 'person' AS entity_type, entity_id FROM h JOIN ids ON ids.value = h.key")
def event_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _household_events(spark, sf_dir)
    return I.event_entities(e, I.resolve(e))


@_query(f"""{_HOUSE_SQL}, early AS (SELECT value, min('person_' || substr(sha256('person|' || value), 1, 24)) OVER (PARTITION BY house) AS entity_id FROM (SELECT key AS value, house FROM h UNION SELECT 'h' || house, house FROM h))
    SELECT early.entity_id AS from_entity_id, min(ids.entity_id) AS into_entity_id FROM early JOIN ids USING (value) WHERE early.entity_id <> ids.entity_id GROUP BY early.entity_id
""")
def merge_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _household_events(spark, sf_dir)
    before = I.resolve(e.withColumn("hints", F.slice("hints", 1, 2)))
    return I.merge_log(before, I.resolve(e))


@_query("""
    SELECT o_orderkey, CAST(('0x' || substr(sha256('order_' || o_orderkey), 1, 8))::BIGINT % 16 AS INTEGER) AS shard FROM orders
""")
def shard_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderkey", I.shard_of(F.concat(F.lit("order_"), "o_orderkey"), 16).alias("shard"))


def _merged_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    rows = c.select(F.concat(F.lit("c"), "c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"), F.lit("2024-01-01").cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.lit(None).cast("string").alias("merged_into"))
    lost = c.filter("c_custkey % 10 = 3").select(F.concat(F.lit("c"), "c_custkey").alias("from_entity_id"), F.concat(F.lit("c"), F.col("c_custkey") - 1).alias("into_entity_id"), F.lit("2024-02-01").cast("timestamp").alias("at"))
    return H.tombstones(rows, "customer_id", lost)


@_query("""
    SELECT 'c' || c_custkey AS customer_id, c_mktsegment AS segment, CASE WHEN c_custkey % 10 = 3 THEN '2024-02-01' END AS valid_to, CASE WHEN c_custkey % 10 = 3 THEN 'c' || (c_custkey - 1) END AS merged_into FROM customer
""")
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged_customers(spark, sf_dir).select("customer_id", "segment", F.date_format("valid_to", "yyyy-MM-dd").alias("valid_to"), "merged_into")


@_query("""
    SELECT 'c' || c_custkey AS customer_id, CASE WHEN c_custkey % 10 = 3 THEN 'c' || (c_custkey - 1) END AS merged_into FROM customer WHERE c_custkey % 10 = 2 OR c_custkey % 10 = 3
""")
def resolve_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _merged_customers(spark, sf_dir)
    winners = h.filter("merged_into is null and customer_id like 'c%2'")
    return Table(winners, "customer", h).resolve_merges().df.select("customer_id", "merged_into")


@_query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 95)")
def erase_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    return e.join(e.filter("event_type = 'error' and value > 95").select("user_id").distinct(), "user_id", "left_anti").select("event_id", "user_id")


# --- graph -----------------------------------------------------------------------------------------------------------


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers to nations, nations to regions."""
    edge = lambda df, a, x, b, y, kind: df.select(F.concat(F.lit(a), x).alias("source_id"), F.concat(F.lit(b), y).alias("target_id"), F.lit(kind).alias("relationship_type"))
    c = edge(_t(spark, sf_dir, "customer"), "c", "c_custkey", "n", "c_nationkey", "lives_in")
    s = edge(_t(spark, sf_dir, "supplier"), "s", "s_suppkey", "n", "s_nationkey", "based_in")
    n = edge(_t(spark, sf_dir, "nation"), "n", "n_nationkey", "r", "n_regionkey", "part_of")
    return c.unionByName(s).unionByName(n)


_EDGE_SQL = """
    WITH RECURSIVE e AS (
        SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b, 'lives_in' AS t FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'based_in' FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'part_of' FROM nation)
"""


@_query(f"{_EDGE_SQL} SELECT a AS entity_id, t AS relationship_type, 'inbound' AS direction FROM e WHERE b = 'n3' UNION ALL SELECT b, t, 'outbound' FROM e WHERE a = 'n3'")
def graph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbors(_edges(spark, sf_dir), "n3")


@_query(f"""{_EDGE_SQL}, u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), walk AS (SELECT 'c1' AS id, 0 AS d UNION SELECT u.b, d + 1 FROM walk JOIN u ON u.a = walk.id WHERE d < 4)
    SELECT id AS entity_id, CAST(min(d) AS INTEGER) AS depth FROM walk GROUP BY id""")
def graph_traverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.traverse(_edges(spark, sf_dir), "c1", depth=4, directed=False)


@_query(f"{_EDGE_SQL} SELECT 'c1' AS entity_id, 0 AS depth UNION ALL SELECT b, 1 FROM e WHERE a = 'c1' UNION ALL SELECT y.b, 2 FROM e x JOIN e y ON y.a = x.b WHERE x.a = 'c1'")
def graph_traverse_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.traverse(_edges(spark, sf_dir), "c1", depth=3)


@_query("""
    SELECT CAST(i AS INTEGER) AS place, CASE i WHEN 0 THEN 'c1' WHEN 1 THEN 'n' || (SELECT c_nationkey FROM customer WHERE c_custkey = 1) WHEN 2 THEN 'r' || (SELECT n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1) END AS entity_id
    FROM range(3) t(i)
""")
def graph_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = _t(spark, sf_dir, "customer").filter("c_custkey = 1").join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).first()["n_regionkey"]
    found = G.path(_edges(spark, sf_dir), "c1", f"r{region}")
    return spark.createDataFrame(list(enumerate(found)), "place int, entity_id string")


@_query("SELECT 'n' || n_nationkey AS nation_id, n_name AS name, 'lives_in' AS relationship_type FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey = 5")
def graph_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = _t(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("nation_id"), F.col("n_name").alias("name"))
    return G.related(_edges(spark, sf_dir), nations, "nation_id", "c5", "lives_in")


@_query(f"""{_EDGE_SQL}, m AS (SELECT a AS id, n_regionkey AS r FROM e JOIN nation ON b = 'n' || n_nationkey UNION SELECT 'n' || n_nationkey, n_regionkey FROM nation UNION SELECT 'r' || n_regionkey, n_regionkey FROM nation)
    SELECT id AS entity_id, min(id) OVER (PARTITION BY r) AS component FROM m""")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.connected_components(_edges(spark, sf_dir))


@_query(f"""{_EDGE_SQL}, d AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY id)
    SELECT id AS entity_id, round(n / (SELECT count(*) - 1 FROM d), 9) AS score FROM d""")
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degree_centrality(_edges(spark, sf_dir)).select("entity_id", F.round("score", 9).alias("score"))


@_query(f"""{_EDGE_SQL}, ids AS (SELECT a AS id FROM e UNION SELECT b FROM e), n AS (SELECT count(*) AS n FROM ids), o AS (SELECT a, count(*) AS deg FROM e GROUP BY a),
    p0 AS (SELECT id, 1.0::DOUBLE / n AS x FROM ids, n),
    {', '.join(f"g{i} AS MATERIALIZED (SELECT b AS id, sum(x / deg) AS got FROM p{i - 1} JOIN e ON a = id JOIN o USING (a) GROUP BY b), h{i} AS MATERIALIZED (SELECT sum(x) AS held FROM p{i - 1} WHERE id NOT IN (SELECT a FROM o)), p{i} AS MATERIALIZED (SELECT ids.id, 0.15 / n + 0.85 * (coalesce(got, 0) + held / n) AS x FROM ids LEFT JOIN g{i} USING (id), n, h{i})" for i in range(1, 21))}
    SELECT id AS entity_id, round(x, 9) AS score FROM p20""")
def graph_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pagerank(_edges(spark, sf_dir)).select("entity_id", F.round("score", 9).alias("score"))


@_query("SELECT 'c' || c_custkey AS entity_id, 1.0::DOUBLE AS score FROM customer WHERE c_custkey <> 1 AND c_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 1) ORDER BY entity_id LIMIT 5")
def graph_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.similar(_edges(spark, sf_dir).filter("relationship_type = 'lives_in'"), "c1", 5)


@_query(f"""{_EDGE_SQL}, u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), l0 AS (SELECT DISTINCT a AS id, a AS c FROM u),
    {', '.join(f"l{i} AS MATERIALIZED (SELECT id, c FROM (SELECT id, c, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, c) AS place FROM (SELECT u.a AS id, c FROM u JOIN l{i - 1} ON u.b = l{i - 1}.id UNION ALL SELECT id, c FROM l{i - 1}) GROUP BY id, c) WHERE place = 1)" for i in range(1, 21))}
    SELECT id AS entity_id, c AS community FROM l20""")
def graph_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.communities(_edges(spark, sf_dir), "label_propagation")


@_query()
def graph_louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.communities(_edges(spark, sf_dir), "louvain")


#: Every path of two steps leads through a nation, and is the only one between its ends.
@_query(f"""{_EDGE_SQL}, ids AS (SELECT a AS id FROM e UNION SELECT b FROM e), n AS (SELECT count(*) AS n FROM ids), through AS (SELECT x.b AS id, count(*) AS paths FROM e x JOIN e y ON y.a = x.b GROUP BY x.b)
    SELECT id AS entity_id, round(coalesce(paths, 0) / ((n - 1.0) * (n - 2.0)), 12) AS score FROM ids LEFT JOIN through USING (id), n""")
def graph_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.betweenness(_edges(spark, sf_dir)).select("entity_id", F.round("score", 12).alias("score"))


@_query(f"""{_EDGE_SQL}, u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), k AS (SELECT a AS id, count(*) AS k FROM u GROUP BY a), m AS (SELECT count(*) AS m FROM u),
    r AS (SELECT 'c' || c_custkey AS id, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT 's' || s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT 'n' || n_nationkey, n_regionkey FROM nation UNION SELECT 'r' || n_regionkey, n_regionkey FROM nation),
    q AS (SELECT sum(part) AS q FROM (SELECT sum(k) / max(m) - (sum(k) / max(m)) ** 2 AS part FROM r JOIN k USING (id), m GROUP BY r))
    SELECT (SELECT count(*) FROM k) AS entities, round(q, 9) AS of_regions, TRUE AS as_good FROM q""")
def graph_louvain_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities are at least as good as the components, which are the regions."""
    edges = _edges(spark, sf_dir)
    found = cut(G.communities(edges, "louvain"))
    regions = G.connected_components(edges).withColumnRenamed("component", "community")
    own, of_regions = G.modularity(edges, found), G.modularity(edges, regions)
    return found.agg(F.count("*").alias("entities")).select("entities", F.round(F.lit(of_regions), 9).alias("of_regions"), F.lit(own >= of_regions - 1e-9).alias("as_good"))


# --- query layer and passthrough -------------------------------------------------------------------------------------


@_query("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment")
def sql_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {"customer": _t(spark, sf_dir, "customer"), "orders": _t(spark, sf_dir, "orders")}
    return Views(spark, lambda: frames).query("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment").df


@_query("SELECT n_name, count(c_custkey) AS customers, count(DISTINCT c_mktsegment) AS segments FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = Table(_t(spark, sf_dir, "nation")), Table(_t(spark, sf_dir, "customer"))
    return n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count("c_custkey").alias("customers"), F.count_distinct("c_mktsegment").alias("segments"))


@_query("SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey")
def join_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "supplier")
    return c.join(s, F.col("c_custkey") == F.col("s_suppkey"), "full").select("c_custkey", "s_suppkey")


@_query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "orders").filter("o_orderstatus = 'F'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@_query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 47)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").join(_t(spark, sf_dir, "lineitem").filter("l_quantity > 47"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("p_partkey")


@_query("""
    SELECT e.event_id, p.event_id AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts
""")
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase before each error: one pass over a union by window, so a user costs its rows and no pairs."""
    e = _t(spark, sf_dir, "events").filter("event_type in ('error', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "purchase", 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("last_purchase", last).filter("event_type = 'error'").select("event_id", "last_purchase")


@_query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_tax), 6) AS tax, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_tax"), 6).alias("tax"), F.count("*").alias("n"))


@_query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def aggregate_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@_query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def aggregate_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@_query("SELECT o_custkey, o_orderkey, row_number() OVER w AS nth, round(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS running, lag(o_orderkey) OVER w AS previous FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    total = F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("nth"), F.round(total, 2).alias("running"), F.lag("o_orderkey").over(w).alias("previous"))


@_query("SELECT p_partkey FROM part WHERE p_size > 25 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT p_partkey FROM part".replace("EXCEPT SELECT l_partkey", "EXCEPT (SELECT l_partkey").replace("SELECT p_partkey FROM part".join(["INTERSECT ", ""]), "INTERSECT SELECT p_partkey FROM part)"))
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, li = _t(spark, sf_dir, "part"), _t(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return p.filter("p_size > 25").select("p_partkey").subtract(li.intersect(p.select("p_partkey")))


@_query("SELECT c_custkey AS id, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind")).unionByName(_t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind")))


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@_query("SELECT strftime(date_trunc('hour', ts) - INTERVAL (hour(ts) % 6) HOUR, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def window_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@_query("""
    WITH marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM marked)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS n FROM numbered GROUP BY user_id, session
""")
def window_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "4 hours")).agg(F.count("*").alias("n")).select("user_id", _text(F.col("session_window.start")).alias("start"), "n")


@_query(f"{_USER_PLAIN} SELECT {_USER_OUT}")
def late_arrival_refold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive in two halves, the older one last; the entities that it touches are folded anew and replace their rows."""
    data = USER_DEFS.to_dict()
    del data["entities"]["user"]["states"]["customer"]["after"]
    defs = Definitions(data)
    fold = EntityFold(defs.entities["user"], defs.field_kinds(), F.lit("2024-06-01").cast("timestamp"))
    events = _user_events(spark, sf_dir)
    middle = F.lit("2024-01-20").cast("timestamp")
    first, late = events.filter(F.col("ts") >= middle), events.filter(F.col("ts") < middle)
    before = cut(H.entity_rows(fold_entities(first, fold), fold.entity))
    touched = late.select("entity_id").distinct()
    again = H.entity_rows(fold_entities(events.join(touched, "entity_id", "left_semi"), fold), fold.entity)
    return _user_select(before.join(touched.withColumnRenamed("entity_id", "user_id"), "user_id", "left_anti").unionByName(again))


_USER_ROWS = """user_id AS "user", state, CAST(purchases AS BIGINT) AS purchases, round(spent, 3) AS spent, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS valid_from FROM closed"""


@_query(f"{_USER_RULES} SELECT {_USER_ROWS}")
def stream_fold_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same history from a stream: raw lines in files, a stateful fold, micro-batches of Parquet."""
    from chronofold.streaming.stream import Consumer, fold_stream, read_raw

    root = scratch_path(spark, "stream")
    _raw_events(spark, sf_dir).select("raw").coalesce(1).write.text(f"{root}/raw")
    normal = Normalizer(USER_DEFS).normalize(read_raw(spark, f"{root}/raw"), "web").filter("error is null")
    keyed = normal.select(F.col("data.user").cast("string").alias("entity_id"), "ts", "event_type", "event_id", "data")
    Consumer(fold_stream(keyed, USER_DEFS, "user"), f"{root}/out", f"{root}/checkpoint").run_once()
    rows = spark.read.parquet(f"{root}/out").filter("not late and error is null")
    p = F.from_json("properties", "user long, purchases long, spent double")
    # of rows that begin at one time the first one stays, as in every history
    return rows.withColumn("p", p).select("p.user", "state", "p.purchases", F.round("p.spent", 3).alias("spent"), _text(F.col("valid_from")).alias("valid_from"))


@_query(f"{_USER_RULES} SELECT {_USER_OUT}")
def engine_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same history by way of a store: ingest, build, read the table."""
    from chronofold.engine import Engine

    data = USER_DEFS.to_dict()
    for event in data["sources"]["web"]["events"].values():
        event["mappings"]["moment"] = {"from": "at", "type": "string"}  # an event's id leaves out its time, but no mapped field
    engine = Engine(spark, data, scratch_path(spark, "store"))
    engine.ingest("web", _raw_events(spark, sf_dir).orderBy("sequence").select("raw"), process=True)
    return _user_select(engine.history("user").df)


@_query("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS qty FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def aggregate_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {"lineitem": _t(spark, sf_dir, "lineitem")}
    return Views(spark, lambda: frames).query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())").df


@_query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY user_id")
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "purchase"]).count().na.fill(0)


@_query("""
    WITH w AS (SELECT date_trunc('hour', ts) - INTERVAL (k) HOUR AS start, value FROM events, range(4) r(k) WHERE (hour(ts) - k) % 2 = 0)
    SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 3) AS total FROM w GROUP BY start
""")
def window_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "4 hours", "2 hours")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "total")


@_query("SELECT DISTINCT p_brand, p_size FROM part")
def distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_brand", "p_size").distinct()


@_query("SELECT c_mktsegment, s_nationkey, count(*) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal > s_acctbal GROUP BY ALL")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "supplier")
    return c.join(s, (F.col("c_nationkey") == F.col("s_nationkey")) & (F.col("c_acctbal") > F.col("s_acctbal"))).groupBy("c_mktsegment", "s_nationkey").agg(F.count("*").alias("n"))


FLAGSHIP = "time_rule_history"

from chronofold import store_queries  # noqa: E402, F401  adds the queries that go through a store
