"""Text forms: numbers as text, and date formats in other notations."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from decimal import Decimal
from typing import Any


class FormatError(ValueError):
    """A date format that cannot be carried over."""


# Strftime fields in Java's notation.
JAVA_FIELDS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "j": "DDD", "I": "hh", "p": "a", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm", "f": "SSSSSS", "z": "xx", "%": "%"}
PYTHON_FIELDS = {"F": "%Y-%m-%d", "T": "%H:%M:%S", "D": "%m/%d/%y", "R": "%H:%M"}


def to_java_format(fmt: str) -> str:
    """A strftime format for Spark's parser."""
    out, at = "", 0
    for m in re.finditer(r"%(.)", fmt):
        out += _quoted(fmt[at : m.start()])
        if m[1] not in JAVA_FIELDS:
            raise FormatError(f"date field %{m[1]} is not supported")
        out += JAVA_FIELDS[m[1]]
        at = m.end()
    return out + _quoted(fmt[at:])


def _quoted(text: str) -> str:
    return re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", text.replace("'", "''"))


def to_python_format(fmt: str) -> str:
    to_java_format(fmt)  # the same fields are supported
    return re.sub(r"%(.)", lambda m: PYTHON_FIELDS.get(m[1], m[0]), fmt)


def rust_text(x: Any) -> str:
    """A value as text: booleans lower-case, numbers without exponent, 3.0 as 3."""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, float):
        if x != x:
            return "NaN"
        if x in (float("inf"), float("-inf")):
            return "inf" if x > 0 else "-inf"
        text = format(Decimal(repr(x)), "f")
        return text.rstrip("0").rstrip(".") if "." in text else text
    if isinstance(x, datetime):
        return x.isoformat()
    if isinstance(x, timedelta):
        return f"{x.total_seconds():g}s"
    return str(x)
