"""The state machine as a Catalyst expression: an ordered fold of an entity's events into snapshots.

Events of an entity are gathered, sorted by (time, sequence) and folded with ``aggregate``. The array is folded in chunks,
each of which yields its own list of snapshots, so no list is copied for every event: the work is n * CHUNK, not n * n.
An error (a null comparison, a zero divisor, ...) is a value in the state; an entity that has one yields no snapshots.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.errors import DefinitionError
from chronofold.functions.compile import Compiler, Typed, as_text, bind, first_error, read_as, spark_type
from chronofold.plans.definitions import Effect, Entity, Handler

CHUNK = 128
_TIMES = ("entered", "created", "last")
RELATION = "struct<relation:string,target_type:string,target_id:string>"


def link_name(effect: Effect) -> str:
    """The event field with the entity that a relate effect resolves to."""
    return f"_link_{effect.target}_{'_'.join(effect.hints.get(effect.target, ()))}"


def links(entity: Entity) -> dict[str, Effect]:
    return {link_name(e): e for _, e in entity.effects() if e.kind == "relate"}


def coerce(x: Typed, kind: str) -> Typed:
    """A value for a property of some kind: numbers and text convert where the text parses, else it is an error."""
    if x.kind in (kind, "null", "any") or x.kind == "integer" and kind == "number":
        return read_as(x, kind)
    if kind == "string" and not x.kind.startswith("array:"):
        return Typed(as_text(x.value, x.kind), kind, x.error)
    if x.kind.startswith("array:") or x.kind == "duration":
        raise DefinitionError(f"cannot keep {x.kind} in a property of type {kind}")
    got = x.value.try_cast(spark_type(kind))
    return Typed(got, kind, first_error(x.error, F.when(x.value.isNotNull() & got.isNull(), F.lit(f"value is not of kind {kind}"))))


class _Cell:
    """A state while one event is applied: what each field has become, in terms of the state before."""

    def __init__(self, fold: EntityFold, at: Column):
        self.fold = fold
        self.fields: dict[str, Column] = {name: at[name] for name in fold.names}
        self.touched: set[str] = set()

    def copy(self) -> _Cell:
        new = object.__new__(_Cell)
        new.fold, new.fields, new.touched = self.fold, dict(self.fields), set(self.touched)
        return new

    def put(self, name: str, value: Column) -> None:
        self.fields[name] = value.cast(self.fold.types[name])
        self.touched.add(name)

    def fail(self, error: Column | None) -> None:
        if error is not None:
            self.put("err", F.coalesce(self.fields["err"], error))

    def struct(self) -> Column:
        return F.struct(*(self.fields[n].alias(n) for n in self.fold.names))


class EntityFold:
    """A compiled state machine. kinds: the event fields' kinds; now: the moment of ``now()``, the same for a whole build."""

    def __init__(self, entity: Entity, kinds: dict[str, str], now: Column | None = None):
        self.entity, self.kinds = entity, kinds
        self.now = now if now is not None else F.current_timestamp()
        self.props = {name: p.type for name, p in entity.properties.items()}
        self.types = {
            "alive": "boolean", "state": "string", "entered": "timestamp", "created": "timestamp", "last": "timestamp", "err": "string", "changed": "boolean", "fired": "boolean",
            "rels": f"array<{RELATION}>", **{f"p_{k}": spark_type(v) for k, v in self.props.items()},
        }
        self.names = list(self.types)
        self.has_rules = any(s.after for s in entity.states.values())
        self.computed = {k: p.compute for k, p in entity.properties.items() if p.compute}

    # pieces

    def empty(self) -> Column:
        start = {"alive": F.lit(False), "changed": F.lit(False), "fired": F.lit(False), "rels": F.array()}
        return F.struct(*(start.get(n, F.lit(None)).cast(t).alias(n) for n, t in self.types.items()))

    def _env(self, cell: _Cell, event: Column | None) -> Callable[[tuple[str, ...]], Typed | None]:
        def env(path: tuple[str, ...]) -> Typed | None:
            if path[0] == "entity" and len(path) == 2 and path[1] in self.props:
                return Typed(cell.fields[f"p_{path[1]}"], self.props[path[1]])
            if path[0] == "event" and len(path) == 2 and event is not None and path[1] in self.kinds:
                return Typed(event["data"][path[1]], self.kinds[path[1]])
            return Typed(F.lit(None).cast("string"), "null") if path[0] in ("entity", "event") else None

        return env

    def _compile(self, text: str, cell: _Cell, event: Column | None) -> Typed:
        return Compiler(self._env(cell, event), self.now)(text)

    def _default(self, name: str) -> Column:
        value = self.entity.properties[name].default
        return F.lit(value).cast(spark_type(self.props[name]))

    def _source(self, effect: Effect, cell: _Cell, event: Column | None) -> Typed:
        kind, given = effect.source
        if kind == "value":
            return Typed(F.lit(given).cast(spark_type(self.props[effect.property])), self.props[effect.property])
        if kind == "from":
            found = self._env(cell, event)(tuple(str(given).split(".")[:2])) or Typed(F.lit(None).cast("string"), "null")
            return coerce(found, self.props[effect.property])
        return coerce(self._compile(str(given), cell, event), self.props[effect.property])

    def _reads(self, effect: Effect) -> bool:
        return effect.condition is not None or effect.kind == "increment" or effect.kind == "set" and effect.source[0] in ("compute", "from") and "entity" in str(effect.source[1])

    # effects

    def _apply(self, effect: Effect, cell: _Cell, event: Column, ts: Column) -> None:
        """Change the cell by one effect. Errors only mark the state: all else in it is lost with them."""
        old = cell.copy()
        test = None
        if effect.condition is not None:
            found = self._compile(effect.condition, cell, event)
            test = F.coalesce(found.value, F.lit(False)) if found.kind == "boolean" else F.lit(False)
            cond_error = found.error
            # comparing with null is an error of the expression, a value that is no boolean merely does not apply
            cell.fail(cond_error)
        alive = cell.fields["alive"]
        missing = F.when(~alive, F.lit(f"{effect.kind} on an entity that does not exist"))
        if effect.kind == "create":
            cell.put("changed", cell.fields["changed"] | ~alive)
            for name in self.props:
                cell.put(f"p_{name}", F.when(alive, cell.fields[f"p_{name}"]).otherwise(self._default(name)))
            cell.put("state", F.when(alive, cell.fields["state"]).otherwise(F.lit(self.entity.starts)))
            for name in ("entered", "created"):
                cell.put(name, F.when(alive, cell.fields[name]).otherwise(ts))
            cell.put("alive", F.lit(True))
        elif effect.kind == "transition":
            cell.fail(missing)
            cell.put("state", F.lit(effect.to))
            cell.put("entered", ts)
            cell.put("changed", F.lit(True))
        elif effect.kind == "set":
            value = self._source(effect, cell, event)
            cell.fail(first_error(missing, value.error))
            cell.put(f"p_{effect.property}", value.value)
            cell.put("changed", F.lit(True))
        elif effect.kind == "increment":
            name = f"p_{effect.property}"
            now = cell.fields[name]
            whole = self.props[effect.property] == "integer" and float(effect.by).is_integer()
            value = F.try_add(now, F.lit(int(effect.by)).cast("bigint")) if whole else now.cast("double") + F.lit(float(effect.by))
            cell.fail(first_error(missing, F.when(now.isNull(), F.lit(f"increment of '{effect.property}', which is null")), F.when(value.isNull(), F.lit("integer overflow"))))
            cell.put(name, value)
            cell.put("changed", F.lit(True))
        elif effect.kind == "relate":
            target = event[link_name(effect)]
            cell.fail(missing)
            rel = F.struct(F.lit(effect.relation).alias("relation"), F.lit(effect.target).alias("target_type"), target.alias("target_id"))
            cell.put("rels", F.when(target.isNotNull(), F.concat(cell.fields["rels"], F.array(rel))).otherwise(cell.fields["rels"]))
            cell.put("changed", cell.fields["changed"] | target.isNotNull())
        if test is not None:
            for name in list(self.names):
                if cell.fields[name] is not old.fields[name]:
                    kept = F.coalesce(old.fields["err"], cond_error) if name == "err" and cond_error is not None else old.fields[name]
                    cell.put(name, F.when(test, cell.fields[name]).otherwise(kept))

    def _effects(self, effects: list[Effect], cell: _Cell, event: Column, ts: Column, then: Callable[[_Cell], Column]) -> Column:
        """Apply effects one after the other. Before one that reads the state, what has changed so far is computed and bound."""
        for i, effect in enumerate(effects):
            if cell.touched and self._reads(effect):
                return self._rebind(effects[i:], cell, event, ts, then)
            self._apply(effect, cell, event, ts)
        return then(cell)

    def _rebind(self, effects: list[Effect], cell: _Cell, event: Column, ts: Column, then: Callable[[_Cell], Column]) -> Column:
        def go(s: Column) -> Column:
            fresh = _Cell(self, s)
            self._apply(effects[0], fresh, event, ts)
            return self._effects(effects[1:], fresh, event, ts, then)

        return bind(cell.struct(), go)

    def _handler(self, handler: Handler, s: Column, event: Column) -> Column:
        """The state after a handler."""
        ts = event["ts"]
        whole = lambda cell: cell.struct()
        done = self._effects(list(handler.effects), _Cell(self, s), event, ts, whole)
        if handler.guard is None:
            return done
        cell = _Cell(self, s)
        guard = self._compile(handler.guard, cell, event)
        if guard.kind == "any":
            guard = read_as(guard, "boolean")
        wrong = F.lit(f"guard must be boolean, not {guard.kind}") if guard.kind != "boolean" else F.when(guard.value.isNull(), F.lit("guard must be boolean, not null"))
        cell.fail(first_error(guard.error, wrong))
        passed = guard.value if guard.kind == "boolean" else F.lit(False)
        return F.when(cell.fields["err"].isNotNull(), cell.struct()).when(passed, done).otherwise(s)

    def _on_event(self, s: Column, event: Column) -> Column:
        """The state after the handlers of an event: the state's own, then the one for any state."""
        by_type: Column | None = None
        for name in sorted(self.entity.event_types()):
            own: Column | None = None
            for state, body in self.entity.states.items():
                handler = body.when.get(name)
                if handler is None:
                    continue
                here = s["alive"] & (s["state"] == state)
                if state == self.entity.starts and any(e.kind == "create" for e in handler.effects):
                    here = here | ~s["alive"]
                result = self._handler(handler, s, event)
                own = F.when(here, result) if own is None else own.when(here, result)
            after = own.otherwise(s) if own is not None else s
            if name in self.entity.always:
                after = self._bound_always(after, self.entity.always[name], event)
            by_type = F.when(event["event_type"] == name, after) if by_type is None else by_type.when(event["event_type"] == name, after)
        return by_type.otherwise(s) if by_type is not None else s

    def _bound_always(self, after: Column, handler: Handler, event: Column) -> Column:
        return bind(after, lambda x: self._handler(handler, x, event))

    # time rules

    def time_rules(self, s: Column, as_of: Column) -> Column:
        """The state after the overdue rules of its state, ``fired`` if there were any. Rules of a state entered thereby wait for the next check."""
        found: Column | None = None
        for name, state in self.entity.states.items():
            if not state.after:
                continue
            result = self._rules(list(state.after), s, as_of)
            here = s["alive"] & (s["state"] == name) & s["err"].isNull()
            found = F.when(here, result) if found is None else found.when(here, result)
        return found.otherwise(s) if found is not None else s

    def _rules(self, rules: list, s: Column, as_of: Column) -> Column:
        rule, rest = rules[0], rules[1:]
        since = s[{"inactivity": "last", "expiration": "created", "state_duration": "entered"}[rule.type]]
        # no time is negative: an earlier as_of counts as none elapsed
        overdue = F.coalesce(F.unix_micros(as_of) - F.unix_micros(since) > F.lit(rule.micros).cast("bigint"), F.lit(False)) & (F.unix_micros(as_of) >= F.unix_micros(since))
        crossing = F.timestamp_micros(F.unix_micros(since) + F.lit(rule.micros).cast("bigint"))
        cell = _Cell(self, s)
        for effect in rule.effects:
            if effect.kind == "transition":
                cell.put("state", F.lit(effect.to))
                cell.put("entered", crossing)
                cell.put("fired", F.lit(True))
            elif effect.kind == "set":
                value = self._source(effect, cell, None)
                cell.fail(value.error)
                cell.put(f"p_{effect.property}", value.value)
                cell.put("fired", F.lit(True))
        after = F.when(overdue, cell.struct()).otherwise(s)
        return bind(after, lambda x: self._rules(rest, x, as_of)) if rest else after

    # the fold

    def snapshot(self, s: Column, valid_from: Column, event: Column | None) -> Column:
        fields = {"state": s["state"], **{f"p_{k}": s[f"p_{k}"] for k in self.props}, "valid_from": valid_from, "last_event_time": s["last"], "state_entered_time": s["entered"], "created_time": s["created"]}
        fields["rels"] = s["rels"] if event is not None else F.array().cast(f"array<{RELATION}>")
        fields["event_id"] = event["event_id"] if event is not None else F.lit(None).cast("string")
        fields["event_type"] = event["event_type"] if event is not None else F.lit(None).cast("string")
        return F.struct(*(c.alias(n) for n, c in fields.items()))

    def snapshot_type(self) -> str:
        props = "".join(f"p_{k}:{spark_type(v)}," for k, v in self.props.items())
        return f"struct<state:string,{props}valid_from:timestamp,last_event_time:timestamp,state_entered_time:timestamp,created_time:timestamp,rels:array<{RELATION}>,event_id:string,event_type:string>"

    def _finish_event(self, s: Column, event: Column) -> Column:
        """Computed properties, all from the values before any of them, and the time of the change."""
        cell, before = _Cell(self, s), _Cell(self, s)
        cell.put("last", F.when(s["changed"], event["ts"]).otherwise(s["last"]))
        for name, text in self.computed.items():
            value = coerce(self._compile(text, before, event=None), self.props[name])
            cell.fail(F.when(s["changed"], value.error) if value.error is not None else None)
            cell.put(f"p_{name}", F.when(s["changed"], value.value).otherwise(s[f"p_{name}"]))
        return cell.struct()

    def _reset(self, s: Column) -> Column:
        cell = _Cell(self, s)
        cell.put("changed", F.lit(False))
        cell.put("fired", F.lit(False))
        cell.put("rels", F.array())
        return cell.struct()

    def _step(self, acc: Column, event: Column) -> Column:
        kind = f"array<{self.snapshot_type()}>"
        none = F.array().cast(kind)

        def handle(s: Column, first: Column) -> Column:
            after = F.when(s["err"].isNotNull(), s).otherwise(self._on_event(s, event))
            # what an event leaves alone is passed on as it is, not built anew
            finished = bind(after, lambda x: F.when(x["changed"], self._finish_event(x, event)).otherwise(x))
            own = lambda x: F.when(x["changed"] & x["err"].isNull(), F.array(self.snapshot(x, event["ts"], event)).cast(kind)).otherwise(none)
            busy = lambda x: x["changed"] | x["fired"]
            return bind(
                finished,
                lambda x: F.struct(F.when(busy(x), self._reset(x)).otherwise(x).alias("s"), F.when(busy(x), F.concat(acc["snaps"], first, own(x))).otherwise(acc["snaps"]).alias("snaps")),
            )

        if not self.has_rules:
            return handle(acc["s"], none)

        def after_rules(s: Column) -> Column:
            cell = _Cell(self, s)
            cell.put("last", s["entered"])
            first = lambda x: F.when(x["fired"] & x["err"].isNull(), F.array(self.snapshot(x, x["entered"], None)).cast(kind)).otherwise(none)
            return bind(F.when(s["fired"], cell.struct()).otherwise(s), lambda x: handle(x, first(x)))

        return bind(self.time_rules(acc["s"], event["ts"]), after_rules)

    def fold(self, events: Column, start: Column | None = None) -> Column:
        """struct(s: the last state, snaps: all snapshots) of a sorted array of events."""
        kind = f"array<{self.snapshot_type()}>"
        empty = F.array().cast(kind)
        zero = F.struct((start if start is not None else self.empty()).alias("s"), F.array().cast(f"array<{kind}>").alias("lists"))
        chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(events) - 1) / F.lit(CHUNK)).cast("int"))), lambda i: F.slice(events, i * CHUNK + 1, F.lit(CHUNK)))

        def one_chunk(acc: Column, chunk: Column) -> Column:
            done = F.aggregate(chunk, F.struct(acc["s"].alias("s"), empty.alias("snaps")), lambda a, e: self._step(a, e))
            return bind(done, lambda d: F.struct(d["s"].alias("s"), F.concat(acc["lists"], F.array(d["snaps"])).alias("lists")))

        return F.aggregate(chunks, zero, one_chunk, lambda acc: F.struct(acc["s"].alias("s"), F.flatten(acc["lists"]).alias("snaps")))


def history_of(snaps: Column) -> Column:
    """Snapshots as history rows: of equal start times the first stays; each row ends where the next one starts."""
    placed = F.array_sort(F.transform(snaps, lambda x, i: F.struct(x["valid_from"].alias("t"), i.alias("i"), x.alias("x"))), lambda a, b: F.when(a["t"] < b["t"], -1).when(a["t"] > b["t"], 1).otherwise(a["i"] - b["i"]))
    kept = bind(placed, lambda p: F.filter(p, lambda x, i: (i == 0) | (x["t"] != F.get(p, i - 1)["t"])))
    return bind(kept, lambda k: F.transform(k, lambda x, i: F.struct(x["x"].alias("row"), F.get(k, i + 1)["t"].alias("valid_to"))))


def fold_entities(events: DataFrame, fold: EntityFold, by: str = "entity_id") -> DataFrame:
    """(entity_id, s, snaps, err) of each entity. One shuffle, on the entity; ``events`` has ts, seq, event_type, event_id, data and links."""
    wanted = ["ts", "seq", "event_type", "event_id", "data", *links(fold.entity)]
    handled = events.filter(F.col("event_type").isin(sorted(fold.entity.event_types()))) if not fold.has_rules else events
    gathered = handled.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*wanted))).alias("_events"))
    # one row out for each row in, so that a filter on the outcome does not fold a second time
    folded = gathered.select(by, F.inline(F.array(fold.fold(F.col("_events")))))
    return folded.select(by, "s", "snaps", F.col("s.err").alias("err"))
