"""The expression language as Spark columns.

An expression becomes a value column and an error column: null, or why there is no value. Nothing raises while rows run,
so one bad event fails alone. Kinds are static; ``any`` is a JSON scalar of unknown kind kept as text, read as whatever
stands on the other side. Durations are microseconds in a bigint.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronofold.errors import DefinitionError
from chronofold.functions import syntax as S
from chronofold.functions.formats import FormatError, to_java_format

SPARK_TYPES = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean", "datetime": "timestamp", "duration": "bigint", "any": "string", "null": "string"}


@dataclass(frozen=True)
class Typed:
    """A compiled expression. kind: a name of SPARK_TYPES, or ``array:`` and one; text: a literal string's value."""

    value: Column
    kind: str
    error: Column | None = None
    text: str | None = None


def spark_type(kind: str) -> str:
    return f"array<{SPARK_TYPES[kind[6:]]}>" if kind.startswith("array:") else SPARK_TYPES[kind]


def first_error(*errors: Column | None) -> Column | None:
    found = [e for e in errors if e is not None]
    return None if not found else found[0] if len(found) == 1 else F.coalesce(*found)


def _null(kind: str) -> Column:
    return F.lit(None).cast(spark_type(kind))


def _why(test: Column, message: str) -> Column:
    return F.when(test, F.lit(message))


def read_as(x: Typed, kind: str) -> Typed:
    """x as another kind, where that loses nothing; text of unknown kind is parsed, and is an error if it does not parse."""
    if x.kind == kind:
        return x
    if x.kind == "null":
        return replace(x, value=_null(kind), kind=kind)
    if x.kind == "integer" and kind == "number":
        return replace(x, value=x.value.cast("double"), kind=kind)
    if x.kind == "any":
        got = x.value.try_cast(spark_type(kind)) if kind != "string" else x.value
        bad = _why(x.value.isNotNull() & got.isNull(), f"value is not of kind {kind}")
        return Typed(got, kind, first_error(x.error, bad if kind != "string" else None))
    raise DefinitionError(f"cannot read {x.kind} as {kind}")


def join_kinds(a: str, b: str) -> str | None:
    if a == b or b == "null":
        return a
    if a == "null":
        return b
    if {a, b} == {"integer", "number"}:
        return "number"
    if "any" in (a, b):
        return a if b == "any" else b
    return None


def _fail(kind: str, message: str, *parts: Typed) -> Typed:
    return Typed(_null(kind), kind, first_error(*(p.error for p in parts), F.lit(message)))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: a one-element array mapped and opened again."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), 0)


def number_text(x: Column) -> Column:
    """A double without exponent, 3.0 as 3."""
    whole = x.cast("bigint").cast("string")
    exact = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    special = F.when(F.isnan(x), F.lit("NaN")).when(x == float("inf"), F.lit("inf")).when(x == float("-inf"), F.lit("-inf"))
    return F.coalesce(special, F.when((F.floor(x) == x) & (F.abs(x) < 9e15), whole).when(F.abs(x) < 1e19, exact).otherwise(F.format_string("%.0f", x)))


def as_text(x: Column, kind: str) -> Column:
    if kind == "number":
        return number_text(x)
    if kind == "datetime":
        return F.concat(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return x.cast("string")


#: Kinds of arguments: a tuple of kinds, ``*`` for any kind.
_S, _I, _N, _T = ("string",), ("integer",), ("integer", "number"), ("datetime",)


def _same_kind(a: Typed, b: Typed) -> str:
    return "integer" if a.kind == b.kind == "integer" else "number"


def _pattern(x: Typed) -> None:
    if x.text is None:
        return
    if re.search(r"\(\?(?:[=!]|<[=!])|(?<!\\)(?:\\\\)*\\[1-9]", x.text):
        raise DefinitionError(f"pattern {x.text!r}: look-around and back-references are not supported")
    try:
        re.compile(x.text)
    except re.error as error:
        raise DefinitionError(f"pattern {x.text!r}: {error}") from error


def _groups(x: Typed) -> int:
    return re.compile(x.text).groups if x.text is not None else 0


class Compiler:
    """env: gives a Ref's typed value, or None for an unknown name; now: the moment of ``now()``."""

    def __init__(self, env: Callable[[tuple[str, ...]], Typed | None], now: Column | None = None):
        self.env, self.now = env, now if now is not None else F.current_timestamp()

    def __call__(self, tree: object | str) -> Typed:
        tree = S.parse(tree) if isinstance(tree, str) else tree
        if isinstance(tree, S.Lit):
            return self._literal(tree.value)
        if isinstance(tree, S.Span):
            return Typed(F.lit(tree.micros).cast("bigint"), "duration")
        if isinstance(tree, S.Ref):
            found = self.env(tree.path)
            if found is not None:
                return found
            return _fail("null", f"unknown root '{tree.path[0]}'") if len(tree.path) > 1 else Typed(_null("null"), "null")
        if isinstance(tree, S.If):
            return self._if(self(tree.test), self(tree.then), self(tree.other))
        if isinstance(tree, S.At):
            return self._at(self(tree.base), self(tree.index))
        if isinstance(tree, S.Unary):
            return self._unary(tree.op, self(tree.arg))
        if isinstance(tree, S.Binary):
            a, b = self(tree.left), self(tree.right)
            if tree.op in ("and", "or"):
                return self._logic(tree.op, a, b)
            if tree.op in ("==", "!="):
                return self._equal(tree.op, a, b)
            if tree.op in (">", "<", ">=", "<="):
                return self._compare(tree.op, a, b)
            return self._arithmetic(tree.op, a, b)
        return self._call(tree.name, [self(x) for x in tree.args])

    @staticmethod
    def _literal(x: str | int | float | bool | None) -> Typed:
        if x is None:
            return Typed(_null("null"), "null")
        kind = "boolean" if isinstance(x, bool) else {str: "string", int: "integer", float: "number"}[type(x)]
        return Typed(F.lit(x).cast(spark_type(kind)), kind, text=x if kind == "string" else None)

    def _if(self, test: Typed, then: Typed, other: Typed) -> Typed:
        kind = join_kinds(then.kind, other.kind)
        if kind is None:
            raise DefinitionError(f"the branches of 'if' are of kinds {then.kind} and {other.kind}")
        if test.kind == "any":
            test = read_as(test, "boolean")
        if test.kind != "boolean":
            return _fail(kind, f"'if' needs a boolean, not {test.kind}", test)
        then, other = read_as(then, kind), read_as(other, kind)
        none = F.lit(None).cast("string")
        branch = F.when(test.value, then.error if then.error is not None else none).otherwise(other.error if other.error is not None else none)
        missing = _why(test.value.isNull(), "'if' needs a boolean, not null")
        return Typed(F.when(test.value, then.value).otherwise(other.value), kind, first_error(test.error, missing, branch if then.error is not None or other.error is not None else None))

    def _at(self, base: Typed, index: Typed) -> Typed:
        index = read_as(index, "integer") if index.kind == "any" else index
        inner = base.kind[6:] if base.kind.startswith("array:") else "string"
        if index.kind != "integer":
            return _fail(inner, "an index must be an integer", base, index)
        if base.kind == "any":
            base = read_as(base, "string")
        error = first_error(base.error, index.error, _why(base.value.isNull(), "cannot index null"), _why(index.value.isNull(), "an index must be an integer"))
        if base.kind == "string":
            n = F.char_length(base.value).cast("bigint")
            at = F.when(index.value < 0, n + index.value).otherwise(index.value)
            return Typed(F.when((at >= 0) & (at < n), F.substring(base.value, (at + 1).cast("int"), F.lit(1))), "string", error)
        if not base.kind.startswith("array:"):
            return _fail("null", f"cannot index {base.kind}", base, index)
        n = F.size(base.value).cast("bigint")
        at = F.when(index.value < 0, n + index.value).otherwise(index.value)
        return Typed(F.when((at >= 0) & (at < n), F.get(base.value, at.cast("int"))), inner, error)

    def _unary(self, op: str, x: Typed) -> Typed:
        x = read_as(x, "boolean" if op == "not" else "number") if x.kind == "any" else x
        if op == "not" and x.kind == "boolean":
            return Typed(~x.value, "boolean", first_error(x.error, _why(x.value.isNull(), "cannot apply 'not' to null")))
        if op == "-" and x.kind in ("integer", "number"):
            value = F.try_subtract(F.lit(0).cast("bigint"), x.value) if x.kind == "integer" else -x.value
            return Typed(value, x.kind, first_error(x.error, _why(x.value.isNull(), "cannot apply '-' to null"), _why(value.isNull(), "integer overflow") if x.kind == "integer" else None))
        return _fail("boolean" if op == "not" else "number", f"cannot apply '{op}' to {x.kind}", x)

    def _logic(self, op: str, a: Typed, b: Typed) -> Typed:
        a, b = (read_as(x, "boolean") if x.kind == "any" else x for x in (a, b))
        if a.kind != "boolean" or b.kind != "boolean":
            return _fail("boolean", f"'{op}' needs booleans, not {a.kind} and {b.kind}", a, b)
        missing = _why(a.value.isNull() | b.value.isNull(), f"'{op}' needs booleans, not null")
        return Typed(a.value & b.value if op == "and" else a.value | b.value, "boolean", first_error(a.error, b.error, missing))

    def _equal(self, op: str, a: Typed, b: Typed) -> Typed:
        error = first_error(a.error, b.error)
        if a.kind.startswith("array:") or b.kind.startswith("array:"):
            same = a.value.isNull() & b.value.isNull()  # arrays never equal, whatever they hold
        elif "null" in (a.kind, b.kind):
            same = a.value.isNull() & b.value.isNull()
        elif "any" in (a.kind, b.kind) and a.kind != b.kind:
            loose, fixed = (a, b) if a.kind == "any" else (b, a)
            kind = "number" if fixed.kind == "integer" else fixed.kind
            other = read_as(fixed, kind).value
            got = loose.value.try_cast(spark_type(kind))
            same = F.when(loose.value.isNull(), other.isNull()).otherwise(F.coalesce(got == other, F.lit(False)))
        else:
            kind = join_kinds(a.kind, b.kind)
            same = a.value.isNull() & b.value.isNull() if kind is None else read_as(a, kind).value.eqNullSafe(read_as(b, kind).value)
        return Typed(same if op == "==" else ~same, "boolean", error)

    def _compare(self, op: str, a: Typed, b: Typed) -> Typed:
        if a.kind == "any" and b.kind in ("any", "null", "boolean"):
            a = read_as(a, "string")
        kind = join_kinds(a.kind, b.kind)
        kind = "number" if kind == "integer" and "any" in (a.kind, b.kind) else kind
        if kind not in ("integer", "number", "string", "datetime", "duration") or "null" in (a.kind, b.kind):
            return _fail("boolean", f"cannot compare {a.kind} with {b.kind}", a, b)
        a, b = read_as(a, kind), read_as(b, kind)
        value = {">": a.value > b.value, "<": a.value < b.value, ">=": a.value >= b.value, "<=": a.value <= b.value}[op]
        return Typed(value, "boolean", first_error(a.error, b.error, _why(a.value.isNull() | b.value.isNull(), f"cannot compare with null by '{op}'")))

    def _arithmetic(self, op: str, a: Typed, b: Typed) -> Typed:
        numeric = ("integer", "number")
        if a.kind == "any":
            a = read_as(a, "number" if b.kind in (*numeric, "any") else b.kind if b.kind == "string" else "datetime")
        if b.kind == "any":
            b = read_as(b, "number" if a.kind in numeric else a.kind)
        nulls = _why(a.value.isNull() | b.value.isNull(), f"cannot apply '{op}' to null")
        errors = [a.error, b.error, nulls]
        x, y = a.value, b.value
        if a.kind == b.kind == "integer":
            zero = F.lit(0).cast("bigint")
            if op == "/":
                return Typed(F.call_function("div", x, F.nullif(y, zero)), "integer", first_error(*errors, _why(y == 0, "division by zero"), _why((y == -1) & (x == -(2**63)), "integer overflow")))
            if op == "**":
                # exact for what a double holds exactly; beyond that an overflow
                power = F.pow(x.cast("double"), y.cast("double"))
                fits = F.abs(power) <= 2.0**53
                return Typed(F.when(fits, power.cast("bigint")), "integer", first_error(*errors, _why(y < 0, "negative exponent"), _why(~fits, "integer overflow")))
            value = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
            return Typed(value, "integer", first_error(*errors, _why(value.isNull(), "integer overflow")))
        if a.kind in numeric and b.kind in numeric:
            x, y = x.cast("double"), y.cast("double")
            if op == "/":
                return Typed(x / F.nullif(y, F.lit(0.0)), "number", first_error(*errors, _why(y == 0, "division by zero")))
            return Typed({"+": x + y, "-": x - y, "*": x * y, "**": F.pow(x, y)}[op], "number", first_error(*errors))
        if op == "+" and a.kind == b.kind == "string":
            return Typed(F.concat(x, y), "string", first_error(*errors))
        if a.kind == "datetime" and b.kind == "duration" and op in "+-":
            return Typed(F.timestamp_micros(F.unix_micros(x) + y if op == "+" else F.unix_micros(x) - y), "datetime", first_error(*errors))
        span = None
        if op == "-" and a.kind == b.kind == "datetime":
            span = F.unix_micros(x) - F.unix_micros(y)
        elif a.kind == b.kind == "duration" and op in ("+", "-"):
            span = x + y if op == "+" else x - y
        elif op == "*" and {a.kind, b.kind} == {"duration", "integer"}:
            span = F.try_multiply(x, y)
        if span is None:
            return _fail("null", f"cannot apply '{op}' to {a.kind} and {b.kind}", a, b)
        return Typed(span, "duration", first_error(*errors, _why(span < 0, "a duration would be negative")))

    def _call(self, name: str, args: list[Typed]) -> Typed:
        if name == "coalesce":
            if not args:
                raise DefinitionError("coalesce needs an argument")
            kind = args[0].kind
            for x in args[1:]:
                kind = join_kinds(kind, x.kind) or "any"
            read = [read_as(x, kind) if kind != "any" else replace(x, value=as_text(x.value, x.kind), kind="any") for x in args]
            return Typed(F.coalesce(*(x.value for x in read)), kind, first_error(*(x.error for x in read)))
        if name == "now" and not args:
            return Typed(self.now, "datetime")
        if name == "days_since":
            name, args = "days_between", [Typed(self.now, "datetime"), *args]
        maker = FUNCTIONS.get(name)
        if maker is None:
            raise DefinitionError(f"unknown function '{name}'")
        kinds, result, build = maker
        if len(args) != len(kinds):
            raise DefinitionError(f"{name} takes {len(kinds)} arguments, not {len(args)}")
        read: list[Typed] = []
        for x, allowed in zip(args, kinds):
            if x.kind == "any" and allowed != "*":
                x = read_as(x, "number" if "number" in allowed and "string" not in allowed else "string" if "string" in allowed else allowed[0])
            if allowed != "*" and not (x.kind in allowed or x.kind.startswith("array:") and "array" in allowed):
                return _fail(result if isinstance(result, str) else "null", f"{name} does not take {x.kind}", *args)
            read.append(x)
        free = name in ("to_string",)
        nulls = None if free else [_why(x.value.isNull(), f"{name} does not take null") for x, allowed in zip(read, kinds) if allowed != "*"]
        value, more = build(*read)
        kind = result if isinstance(result, str) else result(*read)
        return Typed(value, kind, first_error(*(x.error for x in read), *(nulls or []), more))


def _simple(use: Callable[..., Column]) -> Callable:
    return lambda *xs: (use(*(x.value for x in xs)), None)


def _trim(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def _substring(s: Column, start: Column, n: Column) -> Column:
    return F.when((start < 0) | (n < 0), F.lit("")).otherwise(F.substring(s, F.least(start + 1, F.lit(2**31 - 1)).cast("int"), F.least(n, F.lit(2**31 - 1)).cast("int")))


def _contains(a: Typed, b: Typed) -> tuple[Column, Column | None]:
    if a.kind == "string":
        if b.kind not in ("string", "any"):
            return F.lit(None).cast("boolean"), F.lit(f"contains does not take {b.kind}")
        return F.contains(a.value, b.value), _why(b.value.isNull(), "contains does not take null")
    inner = a.kind[6:]
    if b.kind not in (inner, "null", "any"):
        return F.lit(False), None
    return F.exists(a.value, lambda x: x.eqNullSafe(b.value.cast(spark_type(inner)))), None


def _match(s: Typed, p: Typed) -> tuple[Column, Column | None]:
    _pattern(p)
    return F.rlike(s.value, p.value), None


def _extract(s: Typed, p: Typed) -> tuple[Column, Column | None]:
    _pattern(p)
    return F.when(F.rlike(s.value, p.value), F.regexp_extract(s.value, p.text, min(1, _groups(p))) if p.text is not None else F.regexp_substr(s.value, p.value)), None


def _length(x: Typed) -> tuple[Column, Column | None]:
    return (F.octet_length(x.value) if x.kind == "string" else F.size(x.value)).cast("bigint"), None


def _saturating(use: Callable[[Column], Column]) -> Callable:
    def build(x: Typed) -> tuple[Column, Column | None]:
        if x.kind == "integer":
            return x.value, None
        low, high = -(2.0**63), 2.0**63
        v = x.value
        return F.when(F.isnan(v), F.lit(0).cast("bigint")).when(v >= high, F.lit(2**63 - 1)).when(v <= low, F.lit(-(2**63))).otherwise(use(v).cast("bigint")), None

    return build


def _pick(use: Callable[..., Column]) -> Callable:
    def build(a: Typed, b: Typed) -> tuple[Column, Column | None]:
        kind = _same_kind(a, b)
        return use(read_as(a, kind).value, read_as(b, kind).value), None

    return build


def _abs(x: Typed) -> tuple[Column, Column | None]:
    lowest = _why(x.value == -(2**63), "integer overflow") if x.kind == "integer" else None
    return F.abs(F.when(x.value > -(2**63), x.value)) if x.kind == "integer" else F.abs(x.value), lowest


def _between(unit: str) -> Callable:
    return _simple(lambda a, b: F.abs(F.timestamp_diff(unit, a, b)).cast("bigint"))


def _whole(use: Callable[[Column], Column]) -> Callable:
    return _simple(lambda t: use(t).cast("bigint"))


def _trunc(t: Typed, unit: Typed) -> tuple[Column, Column | None]:
    known = unit.value.isin("year", "month", "day", "hour", "minute")
    value = F.when(known, F.date_trunc(unit.text, t.value) if unit.text is not None else F.call_function("date_trunc", unit.value, t.value))
    return value, _why(~known, "unknown unit")


def _parse_datetime(s: Typed, fmt: Typed) -> tuple[Column, Column | None]:
    if fmt.text is None:
        raise DefinitionError("parse_datetime needs a literal format")
    try:
        value = F.try_to_timestamp(s.value, F.lit(to_java_format(fmt.text)))
    except FormatError as error:
        raise DefinitionError(str(error)) from error
    return value, _why(value.isNull(), f"cannot read the value as '{fmt.text}'")


def _to_int(x: Typed) -> tuple[Column, Column | None]:
    if x.kind == "number":
        return _saturating(lambda v: v)(x)
    if x.kind == "string":
        value = F.when(F.rlike(x.value, F.lit(r"^[+-]?[0-9]+$")), x.value.try_cast("bigint"))
        return value, _why(value.isNull(), "cannot convert the value to an integer")
    return x.value.cast("bigint"), None


def _to_float(x: Typed) -> tuple[Column, Column | None]:
    if x.kind == "string":
        value = F.when(~F.rlike(x.value, F.lit(r"\s|[dDfF]$")), x.value.try_cast("double"))
        return value, _why(value.isNull(), "cannot convert the value to a number")
    return x.value.cast("double"), None


def _split(s: Column, d: Column) -> Column:
    return F.when(d == "", F.concat(F.array(F.lit("")), F.split(s, F.lit(""), -1), F.array(F.lit("")))).otherwise(F.split(s, F.concat(F.lit("\\Q"), d, F.lit("\\E")), -1))


def _join(a: Typed, d: Typed) -> tuple[Column, Column | None]:
    inner = a.kind[6:]
    return F.array_join(F.transform(a.value, lambda x: as_text(x, inner)), d.text if d.text is not None else "", "null") if d.text is not None else F.call_function("array_join", F.transform(a.value, lambda x: as_text(x, inner)), d.value, F.lit("null")), None


def _replace(s: Typed, old: Typed, new: Typed) -> tuple[Column, Column | None]:
    between = F.regexp_replace(s.value, F.lit(""), F.regexp_replace(new.value, F.lit(r"([\\$])"), F.lit(r"\\$1")))
    return F.when(old.value == "", between).otherwise(F.replace(s.value, old.value, new.value)), None


_STRING_OR_ARRAY = ("string", "array")
#: Name: (kinds of arguments, kind of the result or how it follows from them, builder of (value, error)).
FUNCTIONS: dict[str, tuple] = {
    "str::to_lowercase": ((_S,), "string", _simple(F.lower)),
    "str::to_uppercase": ((_S,), "string", _simple(F.upper)),
    "str::trim": ((_S,), "string", _simple(_trim)),
    "str::substring": ((_S, _I, _I), "string", _simple(_substring)),
    "starts_with": ((_S, _S), "boolean", _simple(F.startswith)),
    "ends_with": ((_S, _S), "boolean", _simple(F.endswith)),
    "contains": ((_STRING_OR_ARRAY, "*"), "boolean", _contains),
    "replace": ((_S, _S, _S), "string", _replace),
    "regex_match": ((_S, _S), "boolean", _match),
    "regex_extract": ((_S, _S), "string", _extract),
    "to_string": (("*",), "string", lambda x: (F.coalesce(as_text(x.value, x.kind), F.lit("")), None)),
    "len": ((_STRING_OR_ARRAY,), "integer", _length),
    "math::abs": ((_N,), lambda x: x.kind, _abs),
    "floor": ((_N,), "integer", _saturating(F.floor)),
    "ceil": ((_N,), "integer", _saturating(F.ceil)),
    "round": ((_N,), "integer", _saturating(F.round)),
    "min": ((_N, _N), _same_kind, _pick(F.least)),
    "max": ((_N, _N), _same_kind, _pick(F.greatest)),
    "days_between": ((_T, _T), "integer", _between("DAY")),
    "hours_between": ((_T, _T), "integer", _between("HOUR")),
    "minutes_between": ((_T, _T), "integer", _between("MINUTE")),
    "year_of": ((_T,), "integer", _whole(F.year)),
    "month_of": ((_T,), "integer", _whole(F.month)),
    "day_of": ((_T,), "integer", _whole(F.dayofmonth)),
    "hour_of": ((_T,), "integer", _whole(F.hour)),
    "minute_of": ((_T,), "integer", _whole(F.minute)),
    "day_of_week": ((_T,), "integer", _whole(F.weekday)),
    "date_trunc": ((_T, _S), "datetime", _trunc),
    "parse_datetime": ((_S, _S), "datetime", _parse_datetime),
    "to_int": ((("integer", "number", "boolean", "string"),), "integer", _to_int),
    "to_float": ((("integer", "number", "string"),), "number", _to_float),
    "split": ((_S, _S), "array:string", _simple(_split)),
    "join": ((("array",), _S), "string", _join),
}


def column_env(kinds: dict[str, str], root: str | None = None) -> Callable[[tuple[str, ...]], Typed | None]:
    """References to a frame's columns, as ``name`` or ``root.name``."""

    def env(path: tuple[str, ...]) -> Typed | None:
        name = path[-1] if root is None or path[0] == root else None
        if len(path) > (1 if root is None else 2):
            return None
        return Typed(F.col(name), kinds[name]) if name in kinds else None

    return env
