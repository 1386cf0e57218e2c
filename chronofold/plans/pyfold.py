"""The state machine on Python values: one event at a time, whatever the number of events.

Streams keep its state between batches, and entities with too many events for one array go through it in order.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import Any

from chronofold.functions.evaluate import INT_MAX, INT_MIN, EvalError, Evaluator, kind_of
from chronofold.functions.formats import rust_text
from chronofold.functions.syntax import parse
from chronofold.plans.definitions import Effect, Entity, Handler
from chronofold.plans.fold import link_name


class FoldError(Exception):
    """An event that an entity cannot take; nothing of the entity's events counts then."""


def coerce(value: Any, kind: str) -> Any:
    have = kind_of(value)
    if have in (kind, "null"):
        return value
    try:
        if kind == "number":
            return float(value)
        if kind == "integer":
            return int(float(value)) if have == "number" else int(value)
        if kind == "string" and have != "array":
            return rust_text(value)
        if kind == "boolean" and have == "string":
            return {"true": True, "false": False}[value.lower()]
        if kind == "boolean":
            return bool(value)
        if kind == "datetime" and have == "string":
            return datetime.fromisoformat(value.replace("Z", "+00:00"))
    except (KeyError, ValueError) as error:
        raise FoldError(f"value is not of kind {kind}") from error
    raise FoldError(f"value is not of kind {kind}")


class PyFold:
    """state: a dict with alive, state, entered, created, last, props; events: dicts with ts, event_type, event_id, data, links."""

    def __init__(self, entity: Entity, now: datetime | None = None):
        self.entity, self.evaluate, self._trees = entity, Evaluator(now), {}

    def empty(self) -> dict[str, Any]:
        return {"alive": False, "state": None, "entered": None, "created": None, "last": None, "props": dict.fromkeys(self.entity.properties)}

    def _value(self, text: str, event: dict[str, Any] | None, props: dict[str, Any]) -> Any:
        tree = self._trees.get(text)
        if tree is None:
            tree = self._trees[text] = parse(text)
        try:
            return self.evaluate(tree, {"entity": props, "event": (event or {}).get("data") or {}})
        except EvalError as error:
            raise FoldError(str(error)) from error

    def _snapshot(self, s: dict[str, Any], valid_from: datetime, event: dict[str, Any] | None, rels: list) -> dict[str, Any]:
        return {
            "state": s["state"], "props": dict(s["props"]), "valid_from": valid_from, "last_event_time": s["last"], "state_entered_time": s["entered"], "created_time": s["created"],
            "rels": rels, "event_id": (event or {}).get("event_id"), "event_type": (event or {}).get("event_type"),
        }

    def _source(self, effect: Effect, s: dict[str, Any], event: dict[str, Any] | None) -> Any:
        kind, given = effect.source
        if kind == "value":
            return given
        if kind == "from":
            root, _, name = str(given).partition(".")
            name = name.split(".")[0]
            return s["props"].get(name) if root == "entity" else ((event or {}).get("data") or {}).get(name)
        return self._value(str(given), event, s["props"])

    def _effect(self, effect: Effect, s: dict[str, Any], event: dict[str, Any], rels: list) -> bool:
        if effect.condition is not None and self._value(effect.condition, event, s["props"]) is not True:
            return False
        ts, props = event["ts"], s["props"]
        if effect.kind == "create":
            if s["alive"]:
                return False
            s.update(alive=True, state=self.entity.starts, entered=ts, created=ts)
            for name, prop in self.entity.properties.items():
                props[name] = coerce(prop.default, prop.type)
            return True
        if not s["alive"]:
            raise FoldError(f"{effect.kind} on an entity that does not exist")
        if effect.kind == "transition":
            s.update(state=effect.to, entered=ts)
            return True
        if effect.kind == "set":
            props[effect.property] = coerce(self._source(effect, s, event), self.entity.properties[effect.property].type)
            return True
        if effect.kind == "increment":
            now = props[effect.property]
            if now is None:
                raise FoldError(f"increment of '{effect.property}', which is null")
            if isinstance(now, int) and float(effect.by).is_integer():
                if not INT_MIN <= now + int(effect.by) <= INT_MAX:
                    raise FoldError("integer overflow")
                props[effect.property] = now + int(effect.by)
            else:
                props[effect.property] = coerce(float(now) + float(effect.by), self.entity.properties[effect.property].type)
            return True
        target = (event.get("links") or {}).get(link_name(effect))
        if target is None:
            return False
        rels.append({"relation": effect.relation, "target_type": effect.target, "target_id": target})
        return True

    def _handler(self, handler: Handler, s: dict[str, Any], event: dict[str, Any], rels: list) -> bool:
        if handler.guard is not None:
            passed = self._value(handler.guard, event, s["props"])
            if not isinstance(passed, bool):
                raise FoldError(f"guard must be boolean, not {kind_of(passed)}")
            if not passed:
                return False
        return any([self._effect(e, s, event, rels) for e in handler.effects])

    def time_rules(self, s: dict[str, Any], as_of: datetime) -> bool:
        """Apply the overdue rules of the state; whether there were any."""
        fired = False
        if not s["alive"]:
            return False
        for rule in self.entity.states[s["state"]].after if s["state"] in self.entity.states else ():
            since = s[{"inactivity": "last", "expiration": "created", "state_duration": "entered"}[rule.type]]
            threshold = timedelta(microseconds=rule.micros)
            if since is None or as_of < since or as_of - since <= threshold:
                continue
            for effect in rule.effects:
                if effect.kind == "transition":
                    s.update(state=effect.to, entered=since + threshold)
                    fired = True
                elif effect.kind == "set":
                    s["props"][effect.property] = coerce(self._source(effect, s, None), self.entity.properties[effect.property].type)
                    fired = True
        return fired

    def step(self, s: dict[str, Any], event: dict[str, Any]) -> list[dict[str, Any]]:
        """Apply an event to the state, in place; the snapshots that it makes. FoldError leaves the state useless."""
        out: list[dict[str, Any]] = []
        if self.time_rules(s, event["ts"]):
            s["last"] = s["entered"]
            out.append(self._snapshot(s, s["entered"], None, []))
        name = event["event_type"]
        handlers = []
        if s["alive"]:
            state = self.entity.states.get(s["state"])
            handlers += [state.when[name]] if state and name in state.when else []
        else:
            first = self.entity.states[self.entity.starts].when.get(name)
            handlers += [first] if first and any(e.kind == "create" for e in first.effects) else []
        handlers += [self.entity.always[name]] if name in self.entity.always else []
        rels: list[dict[str, Any]] = []
        if any([self._handler(h, s, event, rels) for h in handlers]):
            s["last"] = event["ts"]
            before = dict(s["props"])
            for prop, spec in self.entity.properties.items():
                if spec.compute:
                    s["props"][prop] = coerce(self._value(spec.compute, None, before), spec.type)
            out.append(self._snapshot(s, event["ts"], event, rels))
        return out
