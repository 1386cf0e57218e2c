"""Definitions: entities as state machines, sources as mappings, event schemas. Loading, checking, hashing, drafting."""

from __future__ import annotations

import copy
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from chronofold.errors import DefinitionError
from chronofold.functions.compile import FUNCTIONS
from chronofold.functions.syntax import Call, Ref, parse, parse_span
from chronofold.results import ValidationResult

# The names that definitions may use.
PROPERTY_TYPES = {"string": str, "number": (int, float), "integer": int, "boolean": bool, "datetime": str}
NUMERIC = ("number", "integer")
CARDINALITIES = ("belongs_to", "has_many", "has_one", "many_to_many")
CARDINALITY_PAIRS = {("has_many", "belongs_to"), ("has_one", "belongs_to"), ("belongs_to", "has_many"), ("belongs_to", "has_one"), ("many_to_many", "many_to_many")}
TIME_RULES = ("inactivity", "expiration", "state_duration")
SYSTEM_COLUMNS = ("valid_from", "valid_to", "merged_into", "last_event_time", "state_entered_time", "created_time")


@dataclass(frozen=True)
class Property:
    type: str
    default: Any = None
    sensitive: str | None = None
    treatment: str | None = None
    allowed: tuple | None = None
    min: float | None = None
    max: float | None = None
    compute: str | None = None


@dataclass(frozen=True)
class IdentityField:
    match: str = "exact"
    normalize: str | None = None


@dataclass(frozen=True)
class Effect:
    kind: str
    to: str | None = None
    property: str | None = None
    source: tuple[str, Any] | None = None
    n_sources: int = 0
    by: float = 1
    relation: str | None = None
    target: str | None = None
    hints: dict[str, tuple[str, ...]] = field(default_factory=dict)
    condition: str | None = None


@dataclass(frozen=True)
class Handler:
    effects: tuple[Effect, ...]
    guard: str | None = None


@dataclass(frozen=True)
class TimeRule:
    type: str
    threshold: str
    effects: tuple[Effect, ...]

    @property
    def micros(self) -> int:
        return parse_span(self.threshold)


@dataclass(frozen=True)
class State:
    when: dict[str, Handler]
    after: tuple[TimeRule, ...] = ()


@dataclass(frozen=True)
class Relationship:
    type: str
    target: str
    cardinality: str
    properties: dict[str, Property] = field(default_factory=dict)


@dataclass(frozen=True)
class Entity:
    name: str
    starts: str
    identity: dict[str, IdentityField]
    properties: dict[str, Property]
    states: dict[str, State]
    relationships: tuple[Relationship, ...] = ()
    always: dict[str, Handler] = field(default_factory=dict)

    def handlers(self) -> Iterator[tuple[str, str | None, str, Handler]]:
        """(where, state or None for always, event type, handler)."""
        for name, state in self.states.items():
            for event, handler in state.when.items():
                yield f"state '{name}' on '{event}'", name, event, handler
        for event, handler in self.always.items():
            yield f"always on '{event}'", None, event, handler

    def effects(self) -> Iterator[tuple[str, Effect]]:
        for where, _, _, handler in self.handlers():
            for effect in handler.effects:
                yield where, effect
        for name, state in self.states.items():
            for rule in state.after:
                for effect in rule.effects:
                    yield f"state '{name}' after {rule.type}", effect

    def event_types(self) -> set[str]:
        return {event for _, _, event, _ in self.handlers()}

    def state_graph(self) -> dict[str, set[str]]:
        """For each state, the states that its handlers, its time rules or the always handlers lead to."""
        anywhere = {e.to for h in self.always.values() for e in h.effects if e.kind == "transition" and e.to}
        out = {}
        for name, state in self.states.items():
            own = [e for h in state.when.values() for e in h.effects] + [e for r in state.after for e in r.effects]
            out[name] = {e.to for e in own if e.kind == "transition" and e.to} | anywhere
        return out

    def reachable_states(self) -> set[str]:
        graph, seen, todo = self.state_graph(), {self.starts}, [self.starts]
        while todo:
            new = graph.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        return seen


@dataclass(frozen=True)
class SourceEvent:
    name: str
    mappings: dict[str, dict[str, Any]]
    hints: dict[str, tuple[str, ...]]
    raw_type: str | None = None


@dataclass(frozen=True)
class Source:
    name: str
    event_type: str
    timestamp: str
    events: dict[str, SourceEvent]
    event_id: tuple[str, ...] | None = None


@dataclass(frozen=True)
class SchemaField:
    type: str
    required: bool = False
    allowed: tuple | None = None
    min: float | None = None
    max: float | None = None
    min_length: int | None = None
    regex: str | None = None


@dataclass(frozen=True)
class Schema:
    name: str
    fields: dict[str, SchemaField]


def _known(cls: type, body: dict[str, Any]) -> dict[str, Any]:
    names = {f for f in cls.__dataclass_fields__}
    return {k: tuple(v) if isinstance(v, list) else v for k, v in body.items() if k in names}


def _effect(body: Any, where: str) -> Effect:
    if body == "create":
        return Effect("create")
    if not isinstance(body, dict) or len(body) != 1:
        raise DefinitionError(f"{where}: an effect is 'create' or one of set, transition, increment, relate with its settings, not {body!r}")
    (kind, inner), = body.items()
    inner = inner or {}
    condition = inner.get("condition")
    if kind == "create":
        return Effect("create", condition=condition)
    if kind == "transition":
        return Effect("transition", to=inner["to"] if isinstance(inner, dict) else inner, condition=condition)
    if kind == "set":
        given = [(k, inner[k]) for k in ("from", "value", "compute") if inner.get(k) is not None or k == "value" and k in inner]
        return Effect("set", property=inner["property"], source=given[0] if given else None, n_sources=len(given), condition=condition)
    if kind == "increment":
        return Effect("increment", property=inner["property"], by=inner.get("by", 1), condition=condition)
    if kind == "relate":
        return Effect("relate", relation=inner["type"], target=inner["target"], hints={k: tuple(v) for k, v in (inner.get("hints") or {}).items()}, condition=condition)
    raise DefinitionError(f"{where}: unknown effect '{kind}'")


def _handler(body: dict[str, Any] | None, where: str) -> Handler:
    body = body or {}
    return Handler(tuple(_effect(e, where) for e in body.get("effects") or []), body.get("guard"))


def _entity(name: str, body: dict[str, Any]) -> Entity:
    try:
        states = {}
        for state, own in (body.get("states") or {}).items():
            own = own or {}
            where = f"Entity '{name}' state '{state}'"
            rules = tuple(TimeRule(r["type"], str(r["threshold"]), tuple(_effect(e, where) for e in r.get("effects") or [])) for r in own.get("after") or [])
            states[state] = State({event: _handler(h, where) for event, h in (own.get("when") or {}).items()}, rules)
        relations = tuple(
            Relationship(r["type"], r["target"], r.get("cardinality", "has_many"), {k: Property(**_known(Property, v)) for k, v in (r.get("properties") or {}).items()})
            for r in body.get("relationships") or []
        )
        return Entity(
            name,
            body.get("starts", ""),
            {k: IdentityField(**_known(IdentityField, v or {})) for k, v in (body.get("identity") or {}).items()},
            {k: Property(**_known(Property, v or {})) for k, v in (body.get("properties") or {}).items()},
            states,
            relations,
            {event: _handler(h, f"Entity '{name}' always") for event, h in (body.get("always") or {}).items()},
        )
    except (KeyError, TypeError, AttributeError) as error:
        raise DefinitionError(f"Entity '{name}': {type(error).__name__}: {error}") from error


def _source(name: str, body: dict[str, Any]) -> Source:
    try:
        events = {
            event: SourceEvent(event, {k: dict(v) if isinstance(v, dict) else {"from": v} for k, v in (own.get("mappings") or {}).items()}, {k: tuple(v) for k, v in (own.get("hints") or {}).items()}, own.get("raw_type"))
            for event, own in ((e, o or {}) for e, o in (body.get("events") or {}).items())
        }
        given = body.get("event_id")
        return Source(name, body.get("event_type", ""), body.get("timestamp", ""), events, tuple(given) if given else None)
    except (KeyError, TypeError, AttributeError, ValueError) as error:
        raise DefinitionError(f"Source '{name}': {type(error).__name__}: {error}") from error


def _schema(name: str, body: dict[str, Any]) -> Schema:
    return Schema(name, {k: SchemaField(**_known(SchemaField, v or {})) for k, v in ((body or {}).get("fields") or {}).items()})


def _fits(value: Any, kind: str) -> bool:
    return isinstance(value, PROPERTY_TYPES[kind]) and (kind == "boolean" or not isinstance(value, bool))


class Definitions:
    """A set of definitions. ``data`` is the plain form that hashes, versions and drafts work on."""

    def __init__(self, data: dict[str, Any]):
        self.data = {k: copy.deepcopy(data.get(k) or {}) for k in ("entities", "sources", "schemas")}
        self.entities = {k: _entity(k, v or {}) for k, v in self.data["entities"].items()}
        self.sources = {k: _source(k, v or {}) for k, v in self.data["sources"].items()}
        self.schemas = {k: _schema(k, v or {}) for k, v in self.data["schemas"].items()}

    # loading

    @classmethod
    def load(cls, given: dict[str, Any] | str | Path | Definitions) -> Definitions:
        if isinstance(given, Definitions):
            return given
        return cls(given) if isinstance(given, dict) else cls.from_directory(given)

    @classmethod
    def from_directory(cls, path: str | Path) -> Definitions:
        """YAML files below ``entities/``, ``sources/`` and ``schemas/`` or ``events/``, one or more definitions in each."""
        import yaml

        found: dict[str, dict[str, Any]] = {"entities": {}, "sources": {}, "schemas": {}}
        for folder, kind in (("entities", "entities"), ("sources", "sources"), ("schemas", "schemas"), ("events", "schemas")):
            for file in sorted(p for p in (Path(path) / folder).glob("*") if p.suffix in (".yaml", ".yml")):
                for name, body in (yaml.safe_load(file.read_text()) or {}).items():
                    if name in found[kind]:
                        raise DefinitionError(f"'{name}' is defined twice below {folder}/")
                    found[kind][name] = body
        return cls(found)

    def to_dict(self) -> dict[str, Any]:
        return copy.deepcopy(self.data)

    # hashes

    def hashes(self) -> dict[str, str]:
        """SHA-256 of the entities, the sources and the entities' identity blocks, each in canonical JSON."""
        identity = {k: v["identity"] for k, v in self.data["entities"].items() if v and "identity" in v}
        digest = lambda x: hashlib.sha256(json.dumps(x, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()
        return {"definition_hash": digest(self.data["entities"]), "source_hash": digest(self.data["sources"]), "identity_hash": digest(identity)}

    def content_version(self) -> str:
        return hashlib.sha256(json.dumps(self.data, sort_keys=True, default=str).encode()).hexdigest()[:8]

    # kinds

    def field_kinds(self) -> dict[str, str]:
        """The kind of each mapped event field over all sources; ``any`` where it is undeclared or they differ."""
        kinds: dict[str, str] = {}
        for source in self.sources.values():
            for event in source.events.values():
                for name, mapping in event.mappings.items():
                    kind = mapping.get("type") or "any"
                    known = kinds.setdefault(name, kind)
                    if known != kind:
                        kinds[name] = "number" if {known, kind} == {"number", "integer"} else "any"
        return kinds

    # checks

    def validate(self) -> ValidationResult:
        """All errors (they block) and warnings, each naming its place."""
        errors: list[str] = []
        for entity in self.entities.values():
            errors += _entity_errors(entity)
        for source in self.sources.values():
            errors += _source_errors(source)
        for schema in self.schemas.values():
            errors += _schema_errors(schema)
        errors += [*self._hint_errors(), *self._relationship_errors(), *self._schema_use_errors()]
        return ValidationResult(not errors, errors, list(self._warnings()))

    def check(self) -> Definitions:
        found = self.validate()
        if not found.valid:
            raise DefinitionError("; ".join(found.errors), {"errors": found.errors})
        return self

    def _hint_errors(self) -> Iterator[str]:
        for source in self.sources.values():
            for event in source.events.values():
                where = f"Source '{source.name}' event '{event.name}'"
                for name, fields in event.hints.items():
                    if name not in self.entities:
                        yield f"{where}: no entity '{name}' for its hints"
                        continue
                    for f in fields:
                        if f not in self.entities[name].identity:
                            yield f"{where}: '{f}' identifies no '{name}' (identity: {sorted(self.entities[name].identity)})"

    def _relationship_errors(self) -> Iterator[str]:
        for entity in self.entities.values():
            for rel in entity.relationships:
                where = f"Entity '{entity.name}' relationship '{rel.type}'"
                if ":" in rel.type:
                    yield f"{where}: ':' is reserved"
                if rel.target not in self.entities:
                    yield f"{where}: no entity '{rel.target}'"
                    continue
                back = next((r for r in self.entities[rel.target].relationships if r.target == entity.name), None)
                if back is None:
                    yield f"{where}: '{rel.target}' declares no relationship back"
                elif (rel.cardinality, back.cardinality) not in CARDINALITY_PAIRS:
                    yield f"{where}: cardinality '{rel.cardinality}' does not go with '{back.cardinality}' of '{rel.target}.{back.type}'"

    def _schema_use_errors(self) -> Iterator[str]:
        if not self.schemas:
            return
        for entity in self.entities.values():
            for event in sorted(entity.event_types() - self.schemas.keys()):
                yield f"Entity '{entity.name}' handles '{event}', which has no schema"
        for source in self.sources.values():
            for event in source.events.values():
                schema = self.schemas.get(event.name)
                if schema is None:
                    yield f"Source '{source.name}' yields '{event.name}', which has no schema"
                    continue
                for name, f in schema.fields.items():
                    if f.required and name not in event.mappings:
                        yield f"Schema '{event.name}' requires '{name}', which source '{source.name}' does not map"
                for name in event.mappings:
                    if name not in schema.fields:
                        yield f"Source '{source.name}' maps '{name}' of '{event.name}', which its schema does not declare"

    def _warnings(self) -> Iterator[str]:
        for entity in self.entities.values():
            where = f"Entity '{entity.name}'"
            for name, prop in entity.properties.items():
                if prop.treatment and not prop.sensitive:
                    yield f"{where} property '{name}': a treatment without a sensitivity label"
            graph = entity.state_graph()
            for name, state in entity.states.items():
                if name != entity.starts and not graph[name] and not state.when and not state.after:
                    yield f"{where}: state '{name}' is a dead end"
            for source in self.sources.values():
                for event in source.events.values():
                    if entity.name in event.hints and event.name not in entity.event_types():
                        yield f"{where}: no state handles '{event.name}' of source '{source.name}'"
            written = {e.property for _, e in entity.effects() if e.kind in ("set", "increment")}
            texts = [h.guard for *_, h in entity.handlers()] + [e.condition for _, e in entity.effects()] + [p.compute for p in entity.properties.values()]
            read = {path[1] for t in texts if t for path in references(t) if len(path) > 1 and path[0] == "entity"}
            for name in sorted(written - read - set(entity.identity)):
                yield f"{where} property '{name}': written, but no guard or computed property reads it"


def references(text: str) -> set[tuple[str, ...]]:
    """Paths that an expression refers to; none if it does not parse."""
    try:
        todo: list[Any] = [parse(text)]
    except DefinitionError:
        return set()
    found = set()
    while todo:
        node = todo.pop()
        if isinstance(node, Ref):
            found.add(node.path)
        elif isinstance(node, tuple):
            todo += node
        elif hasattr(node, "__dataclass_fields__"):
            todo += [getattr(node, f) for f in node.__dataclass_fields__]
    return found


def _expression_errors(text: str | None, where: str) -> Iterator[str]:
    if text is None:
        return
    try:
        todo: list[Any] = [parse(str(text))]
    except DefinitionError as error:
        yield f"{where}: {error}"
        return
    while todo:
        node = todo.pop()
        if isinstance(node, Call) and node.name not in FUNCTIONS and node.name not in ("coalesce", "now", "days_since"):
            yield f"{where}: unknown function '{node.name}'"
        if isinstance(node, tuple):
            todo += node
        elif hasattr(node, "__dataclass_fields__"):
            todo += [getattr(node, f) for f in node.__dataclass_fields__]


def _value_errors(prop: Property, where: str) -> Iterator[str]:
    values = ([("default", prop.default)] if prop.default is not None else []) + [("allowed value", v) for v in prop.allowed or ()]
    for what, value in values:
        if not _fits(value, prop.type):
            yield f"{where}: {what} {value!r} is not of type '{prop.type}'"


def _effect_errors(entity: Entity, effect: Effect, where: str) -> Iterator[str]:
    yield from _expression_errors(effect.condition, f"{where}: condition")
    if effect.kind == "transition" and effect.to not in entity.states:
        yield f"{where}: transition to '{effect.to}', which is no state ({sorted(entity.states)})"
    if effect.kind == "relate" and effect.relation not in {r.type for r in entity.relationships}:
        yield f"{where}: relate uses undeclared relationship '{effect.relation}'"
    if effect.kind not in ("set", "increment"):
        return
    prop = entity.properties.get(effect.property)
    if prop is None:
        yield f"{where}: {effect.kind} of undeclared property '{effect.property}'"
    if effect.kind == "increment":
        if prop is not None and prop.type not in NUMERIC:
            yield f"{where}: increment of '{effect.property}', whose type '{prop.type}' is not numeric"
        return
    if effect.n_sources != 1:
        yield f"{where}: set of '{effect.property}' needs one of 'from', 'value' and 'compute', not {effect.n_sources}"
    elif effect.source[0] == "value" and prop is not None and prop.type in PROPERTY_TYPES and effect.source[1] is not None and not _fits(effect.source[1], prop.type):
        yield f"{where}: set of '{effect.property}' to {effect.source[1]!r}, which is not of type '{prop.type}'"
    elif effect.source[0] == "compute":
        yield from _expression_errors(effect.source[1], f"{where}: set of '{effect.property}'")


def _entity_errors(entity: Entity) -> Iterator[str]:
    me = f"Entity '{entity.name}'"
    if not entity.states:
        yield f"{me}: no states"
    if entity.starts not in entity.states:
        yield f"{me}: starts in '{entity.starts}', which is no state ({sorted(entity.states)})"
    if not entity.identity:
        yield f"{me}: no identity fields"
    for name, f in entity.identity.items():
        if f.match not in ("exact", "case_insensitive"):
            yield f"{me} identity '{name}': unknown match '{f.match}'"
        yield from _expression_errors(f.normalize, f"{me} identity '{name}'")
    for name, prop in entity.properties.items():
        where = f"{me} property '{name}'"
        if name in (f"{entity.name}_id", f"{entity.name}_state", *SYSTEM_COLUMNS):
            yield f"{where}: the name is taken by a system column"
        if prop.type not in PROPERTY_TYPES:
            yield f"{where}: unknown type '{prop.type}' ({sorted(PROPERTY_TYPES)})"
            continue
        yield from _value_errors(prop, where)
        yield from _expression_errors(prop.compute, where)
    for rel in entity.relationships:
        if rel.cardinality not in CARDINALITIES:
            yield f"{me} relationship '{rel.type}': unknown cardinality '{rel.cardinality}' ({sorted(CARDINALITIES)})"
    for where, _, _, handler in entity.handlers():
        yield from _expression_errors(handler.guard, f"{me} {where}: guard")
    for where, effect in entity.effects():
        yield from _effect_errors(entity, effect, f"{me} {where}")
    for name, state in entity.states.items():
        for rule in state.after:
            if rule.type not in TIME_RULES:
                yield f"{me} state '{name}': unknown time rule '{rule.type}'"
            try:
                parse_span(rule.threshold)
            except DefinitionError as error:
                yield f"{me} state '{name}': {error}"
    start = entity.states.get(entity.starts)
    if start is not None:
        if not any(e.kind == "create" for h in start.when.values() for e in h.effects):
            yield f"{me}: no handler of '{entity.starts}' has a 'create' effect, so none can come to be"
        for name in sorted(set(entity.states) - entity.reachable_states()):
            yield f"{me}: state '{name}' cannot be reached"


def _source_errors(source: Source) -> Iterator[str]:
    me = f"Source '{source.name}'"
    for what in ("event_type", "timestamp"):
        if not getattr(source, what):
            yield f"{me}: '{what}' is empty"
    for event in source.events.values():
        where = f"{me} event '{event.name}'"
        if not any(event.hints.values()):
            yield f"{where}: no identity hints"
        for name, mapping in event.mappings.items():
            if "from" in mapping and "compute" in mapping:
                yield f"{where} mapping '{name}': both 'from' and 'compute'"
            if mapping.get("type") not in (None, *PROPERTY_TYPES):
                yield f"{where} mapping '{name}': unknown type '{mapping['type']}'"
            yield from _expression_errors(mapping.get("compute"), f"{where} mapping '{name}'")


def _schema_errors(schema: Schema) -> Iterator[str]:
    for name, f in schema.fields.items():
        where = f"Schema '{schema.name}' field '{name}'"
        if f.type not in PROPERTY_TYPES:
            yield f"{where}: unknown type '{f.type}'"
            continue
        for what, kinds in (("min", NUMERIC), ("max", NUMERIC), ("min_length", ("string",)), ("regex", ("string",))):
            if getattr(f, what) is not None and f.type not in kinds:
                yield f"{where}: '{what}' is for {' or '.join(kinds)}, not {f.type}"


def changes(old: Definitions | None, new: Definitions) -> dict[str, Any]:
    """What differs between two sets of entities: added, removed, and for modified ones in what."""
    before, after = (old.data["entities"] if old else {}), new.data["entities"]
    modified = {}
    for name in sorted(before.keys() & after.keys()):
        if before[name] == after[name]:
            continue
        told: dict[str, Any] = {}
        for part in ("properties", "states"):
            a, b = set(before[name].get(part) or {}), set(after[name].get(part) or {})
            if b - a:
                told[f"added_{part}"] = sorted(b - a)
            if a - b:
                told[f"removed_{part}"] = sorted(a - b)
        if before[name].get("identity") != after[name].get("identity"):
            told["identity_changed"] = True
        modified[name] = told or {"handlers_changed": True}
    return {"added": {k: after[k] for k in after.keys() - before.keys()}, "removed": {k: before[k] for k in before.keys() - after.keys()}, "modified": modified}


def build_mode(old: dict[str, str] | None, new: dict[str, str]) -> tuple[str, str]:
    """(mode, why) that going from one set of hashes to another needs."""
    if old is None:
        return "FULL", "nothing to compare with"
    if old["source_hash"] != new["source_hash"]:
        return "FULL_RENORMALIZE", "source mappings changed"
    if old["identity_hash"] != new["identity_hash"]:
        return "FULL_WITH_IDENTITY_RESET", "identity changed"
    if old["definition_hash"] != new["definition_hash"]:
        return "FULL", "entity definitions changed"
    return "INCREMENTAL", "no definition changed"


class Draft:
    """Changes to a set of definitions. Each one is checked at once and undone if it breaks something."""

    def __init__(self, base: Definitions, version: str):
        self.base, self.version, self.data = base, version, base.to_dict()

    def _change(self, name: str, edit: Any) -> None:
        if name not in self.data["entities"]:
            raise DefinitionError(f"no entity '{name}'")
        before = copy.deepcopy(self.data)
        try:
            edit(self.data["entities"][name])
            Definitions(self.data)
            for error in (e for e in _entity_errors(Definitions(self.data).entities[name]) if "reached" not in e):
                raise DefinitionError(error)
        except DefinitionError:
            self.data = before
            raise

    def add_property(self, entity: str, name: str, *, type: str, **settings: Any) -> None:
        def edit(body: dict) -> None:
            own = body.setdefault("properties", {})
            if name in own:
                raise DefinitionError(f"property '{name}' is there already")
            own[name] = {"type": type, **{k: v for k, v in settings.items() if v is not None}}

        self._change(entity, edit)

    def add_state(self, entity: str, name: str, *, when: dict | None = None, after: list | None = None) -> None:
        def edit(body: dict) -> None:
            if name in body.setdefault("states", {}):
                raise DefinitionError(f"state '{name}' is there already")
            body["states"][name] = {k: v for k, v in (("when", when), ("after", after)) if v}

        self._change(entity, edit)

    def _state(self, body: dict, name: str) -> dict:
        if name not in body.get("states", {}):
            raise DefinitionError(f"no state '{name}'")
        body["states"][name] = body["states"][name] or {}
        return body["states"][name]

    def add_transition(self, entity: str, from_state: str, event: str, to: str, *, guard: str | None = None) -> None:
        def edit(body: dict) -> None:
            handler = self._state(body, from_state).setdefault("when", {}).setdefault(event, {"effects": []})
            handler.setdefault("effects", []).append({"transition": {"to": to}})
            if guard:
                handler["guard"] = guard

        self._change(entity, edit)

    def add_handler(self, entity: str, state: str, event: str, effects: list, *, guard: str | None = None) -> None:
        def edit(body: dict) -> None:
            self._state(body, state).setdefault("when", {})[event] = {"effects": effects, **({"guard": guard} if guard else {})}

        self._change(entity, edit)

    def update_identity(self, entity: str, **fields: Any) -> None:
        self._change(entity, lambda body: body.setdefault("identity", {}).update(fields))

    def remove_property(self, entity: str, name: str) -> None:
        self._change(entity, lambda body: self._drop(body, "properties", name))

    def remove_state(self, entity: str, name: str) -> None:
        self._change(entity, lambda body: self._drop(body, "states", name))

    @staticmethod
    def _drop(body: dict, part: str, name: str) -> None:
        if name not in body.get(part, {}):
            raise DefinitionError(f"'{name}' is not among the {part}")
        del body[part][name]

    def definitions(self) -> Definitions:
        return Definitions(self.data)

    def diff(self) -> dict[str, Any]:
        return changes(self.base, self.definitions())

    def impact(self) -> dict[str, str]:
        mode, reason = build_mode(self.base.hashes(), self.definitions().hashes())
        return {"build_mode": mode, "reason": reason}

    def validate(self) -> ValidationResult:
        return self.definitions().validate()


def validate_definitions(given: dict[str, Any] | Definitions | str) -> ValidationResult:
    """Check definitions without an engine."""
    try:
        return Definitions.load(given).validate()
    except DefinitionError as error:
        return ValidationResult(False, [str(error)])
