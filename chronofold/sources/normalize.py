"""Raw JSON events to normalized events, one ``select`` for each source; a bad event becomes an error in its own row."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.functions.compile import Compiler, Typed, as_text, first_error, spark_type
from chronofold.plans.definitions import Definitions, Source, SourceEvent

HINT = "struct<entity_type:string,field:string,value:string>"
_RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def json_path(path: str) -> str:
    """A dotted path, numbers for places in arrays, as a JSON path."""
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split("."))


class _Json:
    """A place in the raw event: columns with its JSON type and its text."""

    def __init__(self, type: Column, text: Column):
        self.type, self.text = type, text
        self.is_number = type.startswith("BIGINT") | type.startswith("DECIMAL") | (type == "DOUBLE") | (type == "FLOAT")


class _Places:
    """The places of a raw event that a source looks at. Each is looked up once, in a projection of its own."""

    def __init__(self) -> None:
        self.paths: dict[str, int] = {}

    def at(self, path: str) -> _Json:
        i = self.paths.setdefault(path, len(self.paths))
        return _Json(F.col(f"_t{i}"), F.col(f"_x{i}"))

    def stage(self, df: DataFrame, raw_col: str) -> DataFrame:
        df = df.withColumn("_v", F.try_parse_json(F.col(f"`{raw_col}`")))
        df = df.withColumns({f"_s{i}": F.try_variant_get("_v", json_path(path), "variant") for path, i in self.paths.items()})
        kinds = {f"_t{i}": F.coalesce(F.schema_of_variant(f"_s{i}"), F.lit("VOID")) for i in self.paths.values()}
        df = df.withColumns(kinds)
        plain = lambda i: ~(F.col(f"_t{i}").startswith("OBJECT") | F.col(f"_t{i}").startswith("ARRAY") | (F.col(f"_t{i}") == "VOID"))
        return df.withColumns({f"_x{i}": F.when(plain(i), F.try_variant_get(f"_s{i}", "$", "string")) for i in self.paths.values()})


def read_timestamp(at: _Json) -> Column:
    """RFC 3339 text, or seconds since 1970 as a number; null if neither."""
    text = F.when(F.rlike(at.text, F.lit(_RFC3339)), at.text.try_cast("timestamp"))
    seconds = at.text.try_cast("double")
    return F.when(at.type == "STRING", text).when(at.is_number, F.timestamp_micros(F.round(seconds * 1e6).cast("bigint")))


def coerce_json(at: _Json, kind: str | None) -> tuple[Column, Column | None]:
    """(value, error) of a place in the raw event as a declared kind; null stays null, what does not convert is an error."""
    text = at.text
    if kind in (None, "any"):
        return text, None
    if kind == "string":
        value = text
    elif kind == "number":
        value = F.when(at.type == "BOOLEAN", F.lit(None)).otherwise(text.try_cast("double"))
    elif kind == "integer":
        value = F.when(at.is_number, F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))).when(at.type == "STRING", text.try_cast("bigint"))
    elif kind == "boolean":
        low = F.lower(text)
        value = F.when(low.isin("true", "1", "yes"), F.lit(True)).when(low.isin("false", "0", "no"), F.lit(False))
    else:
        value = read_timestamp(at)
    return value.cast(spark_type(kind)), F.when(text.isNotNull() & value.isNull(), F.concat(F.lit(f"cannot read as {kind}: "), text))


def _tagged(value: Column, kind: str, json_type: Column | None) -> Column:
    """A value with its kind, in the form that event ids are made from."""
    text = lambda tag: F.concat(F.lit(f'{{"{tag}":'), F.to_json(F.struct(value.cast("string").alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(value.cast("string").alias("v")))) - 6), F.lit("}"))
    bare = lambda tag, x: F.concat(F.lit(f'{{"{tag}":'), x, F.lit("}"))
    if kind == "integer":
        got = bare("Int", value.cast("string"))
    elif kind == "number":
        got = bare("Float", value.cast("string"))
    elif kind == "boolean":
        got = bare("Bool", value.cast("string"))
    elif kind == "datetime":
        got = F.concat(F.lit('{"DateTime":"'), F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"), F.regexp_replace(F.date_format(value, ".SSSSSS"), r"\.000000$|(?<=\.\d{3})000$", ""), F.lit('Z"}'))
    elif json_type is not None:
        got = F.when(json_type == "BOOLEAN", bare("Bool", value)).when(json_type.startswith("BIGINT"), bare("Int", value)).when(json_type == "STRING", text("String")).otherwise(bare("Float", value))
    else:
        got = text("String")
    return F.when(value.isNotNull(), got).otherwise(F.lit('"Null"'))


class Normalizer:
    """Compiled mappings of a set of definitions."""

    def __init__(self, definitions: Definitions, now: Column | None = None, strict: bool = False):
        """strict: events must fit their schemas, too."""
        self.definitions, self.kinds = definitions, definitions.field_kinds()
        self.now, self.strict = now, strict

    def schema(self) -> str:
        """The type of ``data``: all mapped fields of all sources."""
        return "struct<" + ",".join(f"`{k}`:{spark_type(v)}" for k, v in sorted(self.kinds.items())) + ">" if self.kinds else "struct<_none:string>"

    def _fields(self, event: SourceEvent, places: _Places) -> dict[str, tuple[Column, str, Column | None, Column | None]]:
        """name: (value, kind, error, JSON type where the kind is unknown) of each mapped field."""
        found = {}
        for name, mapping in event.mappings.items():
            kind, default = mapping.get("type"), mapping.get("default")
            json_type = None
            if "from" in mapping:
                at = places.at(str(mapping["from"]))
                value, error = coerce_json(at, kind)
                json_type = at.type if kind is None else None
            elif "compute" in mapping:
                typed = Compiler(self._raw_env(places), self.now)(mapping["compute"])
                value, error = self._as(typed, kind)
                kind = kind or typed.kind
                json_type = None
            else:
                value, error = F.lit(None).cast(spark_type(kind or "any")), None
            if default is not None:
                value = F.coalesce(value, F.lit(default).cast(spark_type(kind or "any")))
            found[name] = (value, kind or "any", error, json_type)
        return found

    @staticmethod
    def _as(typed: Typed, kind: str | None) -> tuple[Column, Column | None]:
        if kind is None or typed.kind == kind:
            return typed.value, typed.error
        value = as_text(typed.value, typed.kind) if kind == "string" else typed.value.try_cast(spark_type(kind))
        return value, first_error(typed.error, F.when(typed.value.isNotNull() & value.isNull(), F.lit(f"cannot read as {kind}")))

    @staticmethod
    def _raw_env(places: _Places) -> Callable[[tuple[str, ...]], Typed | None]:
        return lambda path: Typed(places.at(".".join(path[1:])).text, "any") if path[0] == "event" and len(path) > 1 else None

    def _hints(self, event: SourceEvent, fields: dict) -> Column:
        found = []
        for entity, names in event.hints.items():
            identity = self.definitions.entities[entity].identity if entity in self.definitions.entities else {}
            for name in names:
                if name not in fields:
                    continue
                value, kind, _, json_type = fields[name]
                if kind not in ("string", "integer", "number", "any"):
                    continue
                text = as_text(value, kind)
                if json_type is not None:
                    text = F.when(json_type != "BOOLEAN", text)
                rule = identity.get(name)
                if rule is not None and rule.normalize:
                    typed = Compiler(lambda path, text=text: Typed(text, "string") if path == ("value",) else None, self.now)(rule.normalize)
                    if typed.kind in ("string", "any"):
                        made = typed.value if typed.error is None else F.when(typed.error.isNull(), typed.value)
                        text = F.coalesce(made, text)
                found.append(F.struct(F.lit(entity).alias("entity_type"), F.lit(name).alias("field"), text.alias("value")))
        listed = F.array(*found) if found else F.array()
        return F.filter(listed.cast(f"array<{HINT}>"), lambda h: h["value"].isNotNull())

    def _event_id(self, source: Source, event: SourceEvent, fields: dict) -> Column:
        names = sorted(source.event_id or fields)
        parts = [F.concat(F.lit(f"[{json.dumps(n)},"), _tagged(fields[n][0], fields[n][1], fields[n][3]) if n in fields else F.lit('"Null"'), F.lit("]")) for n in names]
        body = F.concat(F.col("_name"), F.lit("|["), F.concat_ws(",", *parts), F.lit("]"))
        return F.concat(F.lit("e_"), F.sha2(body, 256))

    def normalize(self, raw: DataFrame, source: str, raw_col: str = "raw") -> DataFrame:
        """``raw`` with event_id, event_type, ts, source, data, hints and error. Rows with an error have no event_id.

        raw_col: the event as JSON text. Null, malformed and unknown events are errors; other columns stay.
        """
        spec = self.definitions.sources[source]
        places = _Places()
        raw_type, at = places.at(spec.event_type), places.at(spec.timestamp)
        # events with the same mappings and hints are one case
        groups: dict[str, list[SourceEvent]] = {}
        for event in spec.events.values():
            groups.setdefault(json.dumps([event.mappings, event.hints, event.name if self.strict else ""], sort_keys=True, default=str), []).append(event)
        cases = []
        for events in groups.values():
            fields = self._fields(events[0], places)
            cases.append((F.col("_name").isin(*(e.name for e in events)), events[0], fields))

        def choose(make: Callable[[SourceEvent, dict], Column | None], kind: str) -> Column:
            found: Column | None = None
            for test, event, fields in cases:
                value = make(event, fields)
                if value is not None:
                    found = F.when(test, value) if found is None else found.when(test, value)
            return (found if found is not None else F.lit(None)).cast(kind)

        def one(name: str) -> Column:
            return choose(lambda _, f: self._carry(*f[name][:2], self.kinds[name]) if name in f else None, spark_type(self.kinds[name]))

        def wrong(event: SourceEvent, fields: dict) -> Column | None:
            misfits = self._misfits(event, fields) if self.strict else []
            return first_error(*misfits, *(F.when(e.isNotNull(), F.concat(F.lit(f"field '{k}': "), e)) for k, (_, _, e, _) in fields.items() if e is not None))

        names = F.create_map(*(x for e in spec.events.values() for x in (F.lit(e.raw_type or e.name), F.lit(e.name)))) if spec.events else F.create_map()
        staged = places.stage(raw, raw_col).withColumn("_name", F.get(F.map_values(F.map_filter(names, lambda k, _: k == raw_type.text)), 0) if spec.events else F.lit(None).cast("string"))
        data = F.struct(*(one(k).alias(k) for k in sorted(self.kinds))) if self.kinds else F.struct(F.lit(None).cast("string").alias("_none"))
        made = staged.withColumns({"_ts": read_timestamp(at), "_wrong": choose(wrong, "string"), "_data": data, "_hints": choose(self._hints, f"array<{HINT}>"), "_id": choose(lambda e, f: self._event_id(spec, e, f), "string")})
        error = F.coalesce(
            F.when(F.col("_v").isNull(), F.lit("not a JSON event")),
            F.when(raw_type.text.isNull(), F.lit(f"missing event type field '{spec.event_type}'")),
            F.when(F.col("_name").isNull(), F.concat(F.lit("unknown event type: "), raw_type.text)),
            F.when(F.col("_ts").isNull(), F.lit(f"missing or malformed timestamp '{spec.timestamp}'")),
            F.col("_wrong"),
        )
        keep = [F.col(f"`{c}`") for c in raw.columns if c not in ("event_id", "event_type", "ts", "source", "data", "hints", "error")]
        # one row out for each row in; a filter on what comes out (as on the error) is not rewritten in terms of the raw text
        row = F.struct(
            F.when(error.isNull(), F.col("_id")).alias("event_id"),
            F.col("_name").alias("event_type"),
            F.col("_ts").alias("ts"),
            F.lit(source).alias("source"),
            F.col("_data").alias("data"),
            F.coalesce("_hints", F.array().cast(f"array<{HINT}>")).alias("hints"),
            error.alias("error"),
        )
        return made.select(*keep, F.inline(F.array(row)))

    def _misfits(self, event: SourceEvent, fields: dict) -> list[Column]:
        """What is wrong with an event by its schema."""
        schema = self.definitions.schemas.get(event.name)
        found: list[Column] = []
        for name, rule in (schema.fields if schema else {}).items():
            if name not in fields:
                continue
            value, kind, _, _ = fields[name]
            told = lambda test, what, name=name: found.append(F.when(test, F.lit(f"field '{name}': {what}")))
            if rule.required:
                told(value.isNull(), "required")
            if rule.allowed is not None:
                told(~as_text(value, kind).isin(*(str(a).lower() if isinstance(a, bool) else str(a) for a in rule.allowed)), "not an allowed value")
            number = value.try_cast("double")
            if rule.min is not None:
                told(number < rule.min, f"below {rule.min}")
            if rule.max is not None:
                told(number > rule.max, f"above {rule.max}")
            if rule.min_length is not None:
                told(F.char_length(value.cast("string")) < rule.min_length, f"shorter than {rule.min_length}")
            if rule.regex is not None:
                told(~F.rlike(value.cast("string"), F.lit(rule.regex)), "does not match its pattern")
        return found

    @staticmethod
    def _carry(value: Column, kind: str, to: str) -> Column:
        return value if kind == to else as_text(value, kind) if to in ("any", "string") else value


def redacted(raw: Column, paths: list[str], mark: str = "[REDACTED]") -> Column:
    """JSON text with ``mark`` at the given dotted paths, as far as they are there; all else keeps its value and type.

    Numbers in a path are places in arrays. Text that is no JSON object becomes the mark itself, as it may hold anything.
    """
    tree: dict[str, Any] = {}
    for path in paths:
        node = tree
        *above, last = path.split(".")
        for name in above:
            if node.get(name) is True:
                break
            node = node.setdefault(name, {})
        else:
            node[last] = True
    hidden = F.parse_json(F.lit(json.dumps(mark)))

    def edit(value: Column, node: dict[str, Any]) -> Column:
        made = lambda old, below: hidden if below is True else edit(old, below)

        def change(name: Column, old: Column, names: dict[str, Any]) -> Column:
            found = old
            for key, below in names.items():
                found = F.when(name == key, made(old, below)).otherwise(found)
            return found

        as_map = F.transform_values(F.try_variant_get(value, "$", "map<string,variant>"), lambda k, v: change(k, v, node))
        places = {k: v for k, v in node.items() if k.isdigit()}
        as_array = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v, i: change(i.cast("string"), v, places)) if places else None
        kind = F.schema_of_variant(value)
        out = F.when(kind.startswith("OBJECT"), F.to_variant_object(as_map))
        if as_array is not None:
            out = out.when(kind.startswith("ARRAY"), F.to_variant_object(as_array))
        return out.otherwise(value)

    whole = F.try_parse_json(raw)
    return F.when(F.schema_of_variant(whole).startswith("OBJECT"), F.to_json(edit(whole, tree))).otherwise(F.lit(json.dumps(mark))) if tree else raw


def failures(normalized: DataFrame, raw_col: str = "raw", keep: list[str] | None = None) -> DataFrame:
    """The rows that failed, as a dead letter has them; keep: columns of theirs to carry along."""
    return normalized.filter(F.col("error").isNotNull()).select(*(keep or []), F.col(raw_col).alias("raw"), "error", F.lit("normalization").alias("stage"), "source", F.lit(False).alias("recoverable"))
