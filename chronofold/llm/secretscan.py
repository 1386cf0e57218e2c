"""Secret scans: patterns, and structural confirmation of what is encoded.

Three plain patterns report what they match. Besides them, stretches that look like base64 or hex are decoded, and
reported only if what comes out has the structure of a secret: a DER object whose nested lengths add up, an SSH or PGP
key, a token whose header is JSON that names a signature algorithm, or text with a secret of the plain kinds.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import BATCH_CHARS, per_text, sha256_hex

# The plain patterns, the least lengths, and the order of kinds.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the same as all runs of [0-9a-f]+ that are long enough
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
BASE_KINDS = ["assign", "access", "hex"]
KINDS = [*BASE_KINDS, "pem", "jwt", "der", "ssh", "encoded"]

_JWT = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
_PEM_LABEL = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*?(?:PRIVATE KEY(?: BLOCK)?))-----")
# The shortest plain secret has 12 bytes (token=abcdef): 16 characters of base64, 24 of hex.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){12,}(?![0-9A-Fa-f])")
_BREAK = r"[\x20\t]*(?:\r?\n|(?:\\+r)?\\+n)[\x20\t]*"  # also as escaped in JSON
_RUN = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{16,}}+(?:{_BREAK}[A-Za-z0-9+/_-]++)+={{0,2}}")
_NEXT = re.compile(_BREAK)
_SSH_NAMES = (b"ssh-", b"ecdsa-sha2-", b"sk-")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the plain patterns, by start and then kind as listed."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(a, BASE_KINDS[k], b) for a, k, b in sorted(found)]


def _unbase64(text: str) -> bytes | None:
    plain = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """(length, where the content starts) of the length field at ``at``."""
    if at >= len(data):
        return None
    first = data[at]
    if first < 0x80:
        return first, at + 1
    n = first & 0x7F
    if not 1 <= n <= 4 or at + 1 + n > len(data):
        return None
    length = int.from_bytes(data[at + 1 : at + 1 + n], "big")
    return (length, at + 1 + n) if length >= 0x80 else None


def is_der(data: bytes) -> bool:
    """Whether all of ``data`` is one SEQUENCE of at least two elements whose nested lengths fit exactly."""
    if len(data) < 24 or data[0] != 0x30:
        return False
    todo, seen = [(0, len(data), 0)], 0
    while todo:
        at, end, depth = todo.pop()
        while at < end:
            tag, size = data[at], _der_length(data, at + 1)
            if tag & 0x1F == 0x1F or size is None or size[1] + size[0] > end:
                return False
            seen += 1
            if tag in (0x30, 0x31) and depth < 16:
                todo.append((size[1], size[1] + size[0], depth + 1))
            elif tag not in (0x30, 0x31) and tag < 0x80 and not 1 <= tag <= 0x1E:
                return False
            at = size[1] + size[0]
            if depth == 0 and at != len(data):
                return False
    return seen >= 3


def is_ssh(data: bytes) -> bool:
    """An OpenSSH private key, or a key blob: strings with 4-byte lengths that add up, the first of which names a key type."""
    if data.startswith(b"openssh-key-v1\0"):
        return True
    at, n = 0, 0
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if n == 0 and not data[at + 4 : at + 4 + size].startswith(_SSH_NAMES):
            return False
        at += 4 + size
        n += 1
    return n >= 2 and at == len(data)


def is_signed_token(text: str) -> bool:
    header = _unbase64(text.split(".", 1)[0])
    if not header or header[:1] != b"{":
        return False
    try:
        told = json.loads(header)
    except ValueError:
        return False
    return isinstance(told, dict) and isinstance(told.get("alg"), str) and _unbase64(text.split(".")[1]) is not None


def _confirm(data: bytes | None) -> str | None:
    if not data:
        return None
    if is_der(data):
        return "der"
    if is_ssh(data):
        return "ssh"
    try:
        inner = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    if re.sub(r"\s", "", inner).isprintable():
        if (ACCESS.search(inner) or ASSIGN.search(inner)) and base_spans(inner):
            return "encoded"
    return None


def _wrapped(text: str) -> Iterator[tuple[int, str, int]]:
    """(start, kind, end) of base64 over several lines: lines as wide as the first, and a shorter last one if it belongs."""
    for m in _RUN.finditer(text):
        ends = [(b.start(), b.end()) for b in _NEXT.finditer(text, m.start(), m.end())]
        lines = list(zip([m.start(), *(b for _, b in ends)], [*(a for a, _ in ends), m.end()]))
        words = [text[a:b] for a, b in lines]
        k = 0
        while k < len(lines):
            first, wide = k, len(words[k].rstrip("="))
            k += 1
            while k < len(lines) and len(words[k].rstrip("=")) == wide:
                k += 1
            if wide < 16:
                continue
            for last in (k + 1, k):
                if first + 1 < last <= len(lines) and (last == k or len(words[k]) <= wide) and (kind := _confirm(_unbase64("".join(words[first:last])))):
                    yield lines[first][0], kind, lines[last - 1][1]
                    k = last
                    break


def _pem(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, label, body) of each BEGIN up to the next END of its label, in one pass from the right and one from the left."""
    marks = list(_PEM_LABEL.finditer(text))
    ends: list[re.Match | None] = []
    last: dict[str, re.Match] = {}
    for m in reversed(marks):
        ends.append(last.get(m[2]))
        if m[1] == "END":
            last[m[2]] = m
    at = 0
    for m, end in zip(marks, reversed(ends)):
        if m[1] == "BEGIN" and m.start() >= at and end:
            at = end.end()
            yield m.start(), at, m[2], text[m.end() : end.start()]


class _Inside:
    """Whether a stretch lies within one of some spans: by the furthest end among those that start before it."""

    def __init__(self, spans: list[tuple[int, str, int]]):
        self.starts, self.reach = [], []
        for a, _, b in sorted(spans):
            self.starts.append(a)
            self.reach.append(max(b, self.reach[-1] if self.reach else 0))

    def __call__(self, a: int, b: int) -> bool:
        k = bisect.bisect_right(self.starts, a)
        return k > 0 and b <= self.reach[k - 1]


def confirmed_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of what is a secret by its structure, by start and then kind."""
    found = []
    if "-----BEGIN" in text:
        for start, end, label, inner in _pem(text):
            body = re.sub(r"(?m)^[A-Za-z-]+:.*$|^=.{4}$|\s+", "", re.sub(r"\\+[nr]", "\n", inner))
            data = _unbase64(body)
            if data and (is_der(data) or is_ssh(data) or "PGP" in label and data[0] & 0x80 or "ENCRYPTED" in inner):
                found.append((start, "pem", end))
    if "eyJ" in text or "ey" in text and "." in text:
        found += [(m.start(), "jwt", m.end()) for m in _JWT.finditer(text) if is_signed_token(m[0])]
    inside = _Inside(found)
    found += [(a, kind, b) for a, kind, b in _wrapped(text) if not inside(a, b)]
    inside = _Inside(found)
    for pattern, decode in ((_BASE64, _unbase64), (_HEX_ANY, bytes.fromhex)):
        for m in pattern.finditer(text):
            if not inside(m.start(), m.end()) and (kind := _confirm(decode(m[0]))):
                found.append((m.start(), kind, m.end()))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def _join(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def scan_text(text: str) -> tuple[int, int, int, str, str]:
    """Counts of the plain kinds, digest of their spans, and all spans, in time linear in the text."""
    base = base_spans(text)
    counts = [sum(k == kind for _, k, _ in base) for kind in BASE_KINDS]
    every = sorted([*base, *confirmed_spans(text)], key=lambda s: (s[0], KINDS.index(s[1]), s[2]))
    return *counts, sha256_hex(_join(base)), _join(every)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of every whole text; offsets in code points, ends exclusive.

    Null and empty texts have no spans (the digest is that of the empty string). Repeated rows give repeated rows; other
    columns are not carried. No shuffle.
    """

    return per_text(df, id_col, text_col, lambda: scan_text, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_text(text: str) -> str:
    """The text with every secret replaced by its kind; overlapping ones become one."""
    out, at = [], 0
    merged: list[list] = []
    for a, kind, b in sorted([*base_spans(text), *confirmed_spans(text)]):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([a, kind, b])
    for a, kind, b in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]]) if merged else text


def redact(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with all columns, secrets in ``text_col`` replaced and ``size_col`` brought up to date. Null texts stay null."""
    names, schema = docs.columns, docs.schema
    at = names.index(text_col)
    size = names.index(size_col) if size_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            start = 0
            while start < whole.num_rows:
                texts, held, first = [], 0, start
                while start < whole.num_rows and held < BATCH_CHARS:
                    text = whole.column(at)[start].as_py()
                    texts.append(text if text is None else redact_text(text))
                    held += len(text or "")
                    start += 1
                batch = whole.slice(first, start - first)
                columns = list(batch.columns)
                columns[at] = pa.array(texts, columns[at].type)
                if size is not None:
                    old = columns[size].to_pylist()
                    changed = [n if t is None or t == b.as_py() else len(t) for n, t, b in zip(old, texts, batch.column(at))]
                    columns[size] = pa.array(changed, columns[size].type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)
