"""Byte-level BPE: pre-tokenisation without regular expressions, cached pair merging, decoding by offsets.

The pre-tokeniser reads a text as an array of code-point classes. Each class is a function from automaton states to
states; functions compose associatively, and all that can arise are listed once with their composition table. A prefix
scan by doubling (position ``i`` takes in what stands ``1, 2, 4, ..`` before it) then gives the state at every position
at once. It ends as soon as every composed function is constant, here after a few characters whatever the text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronofold.llm.common import per_text, sha256_hex

# classes of code points
LETTER, STMD, RV, L, E, NUMBER, OTHER, QUOTE, BLANK, SPACE = range(10)
# automaton states: what the last character belongs to
IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_BLANK, AFTER_SPACE, AT_QUOTE, QUOTE_RV, QUOTE_L, CONTRACTED = range(9)
#: The code points of Unicode's property White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
#: Texts scanned side by side, in characters.
SCAN_CHARS = 1_000_000
#: Pieces whose merges are kept by a worker at most; then it starts afresh.
CACHE_PIECES = 400_000
#: Bytes decoded at once.
DECODE_BYTES = 1 << 20


def _transition(state: int, kind: int) -> int:
    if kind == STMD and state == AT_QUOTE or kind == E and state == QUOTE_RV or kind == L and state == QUOTE_L:
        return CONTRACTED
    if kind == RV and state == AT_QUOTE:
        return QUOTE_RV
    if kind == L and state == AT_QUOTE:
        return QUOTE_L
    if kind == QUOTE:
        return IN_OTHER if state in (IN_OTHER, AFTER_BLANK, AT_QUOTE) else AT_QUOTE
    return {NUMBER: IN_NUMBERS, OTHER: IN_OTHER, BLANK: AFTER_BLANK, SPACE: AFTER_SPACE}.get(kind, IN_LETTERS)


def _begins(state: int, kind: int) -> bool:
    """Whether a piece begins at a character that is no white space. A contraction of two letters is mended afterwards."""
    if state == AFTER_BLANK:
        return False
    if kind == NUMBER:
        return state != IN_NUMBERS
    if kind in (OTHER, QUOTE):
        return state not in (IN_OTHER, AT_QUOTE)
    return state not in (IN_LETTERS, QUOTE_RV, QUOTE_L) and not (kind == STMD and state == AT_QUOTE)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, ...]:
    """(class of each code point, function of each class, composition, state of each constant function or 255, begins)."""
    kinds = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for code in range(sys.maxunicode + 1):
        general = unicodedata.category(chr(code))[0]
        if general == "L":
            kinds[code] = LETTER
        elif general == "N":
            kinds[code] = NUMBER
    kinds[WHITE_SPACE] = SPACE
    for chars, kind in ((" ", BLANK), ("'", QUOTE), ("stmd", STMD), ("rv", RV), ("l", L), ("e", E)):
        kinds[[ord(c) for c in chars]] = kind
    states, classes = range(9), range(10)
    basic = [tuple(_transition(s, c) for s in states) for c in classes]
    constant = [(s,) * 9 for s in states]
    known = {f: i for i, f in enumerate(dict.fromkeys([*basic, *constant]))}
    todo = list(known)
    while todo:  # close under composition
        f = todo.pop()
        for g in list(known):
            for first, then in ((f, g), (g, f)):
                h = tuple(then[first[s]] for s in states)
                if h not in known:
                    known[h] = len(known)
                    todo.append(h)
    listed = list(known)
    compose = np.array([[known[tuple(g[f[s]] for s in states)] for g in listed] for f in listed], np.uint8)
    value = np.array([f[0] if len(set(f)) == 1 else 255 for f in listed], np.uint8)
    begins = np.array([[_begins(s, c) for c in classes] for s in states])
    of_class = np.array([known[f] for f in basic], np.uint8)
    return kinds, of_class, compose, value, begins, np.array([known[f] for f in constant], np.uint8)


def piece_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where pieces begin in texts laid end to end. points: code points; firsts: where the (non-empty) texts begin."""
    kinds_of, of_class, compose, value, begins, constant = _tables()
    kind = kinds_of[points]
    func = of_class[kind]
    # nothing stands before a text: as after white space that is no blank
    func[firsts] = constant[[_transition(AFTER_SPACE, int(c)) for c in kind[firsts]]]
    width = compose.shape[0]
    flat = compose.ravel()
    reach = 1
    while True:
        fixed = value[func]
        if fixed.max(initial=0) < 255:
            break
        func[reach:] = flat[func[:-reach].astype(np.uint16) * width + func[reach:]] if len(func) > reach else func[reach:]
        reach *= 2
    before = np.empty_like(fixed)
    before[1:] = fixed[:-1]
    before[firsts] = AFTER_SPACE
    start = begins.ravel()[before * np.uint8(10) + kind]
    white = kind >= BLANK
    follows = np.zeros(len(kind), bool)  # a character that is no white space comes next, in the same text
    follows[:-1] = ~white[1:]
    follows[firsts[1:] - 1] = False
    start[white] = (before[white] != AFTER_BLANK) & (before[white] != AFTER_SPACE) | follows[white]
    two = np.flatnonzero((fixed == CONTRACTED) & (before != AT_QUOTE))
    start[two] = start[two - 1] = False
    start[firsts] = True
    return np.flatnonzero(start)


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a token in base64 and its rank, on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the adjacent pair of lowest rank, leftmost first, is joined until none is left. O(n log n)."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    ends, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = ends[i] if alive[i] else n
        if j >= n or ends[j] != end:
            continue
        alive[j] = False
        ends[i] = end
        if end < n:
            prev[end] = i
            if (r := ranks.get(piece[i : ends[end]])) is not None:
                heapq.heappush(heap, (r, i, ends[end]))
        if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    return [ranks[piece[i : ends[i]]] for i in range(n) if alive[i]]


class _Pieces(dict):
    """Packed ids of each piece of text."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(merge(piece.encode("utf-8", "surrogatepass"), self.ranks), np.uint32).tobytes()
        if len(self) >= CACHE_PIECES:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class ByteBPE:
    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.tokens = [b""] * (1 + max(self.ranks.values()))
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.pieces = _Pieces(self.ranks)

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as uint32."""
        out: list[np.ndarray] = []
        group: list[str] = []
        held = 0
        for k, text in enumerate(texts):
            group.append(text)
            held += len(text)
            if held >= SCAN_CHARS or k + 1 == len(texts):
                out += self._encode_group(group)
                group, held = [], 0
        return out

    def encode(self, text: str) -> np.ndarray:
        return self._encode_group([text])[0]

    def _encode_group(self, texts: list[str]) -> list[np.ndarray]:
        sizes = np.array([len(t) for t in texts])
        begins = np.cumsum(sizes) - sizes
        joined = "".join(texts)
        if not joined:
            return [np.empty(0, np.uint32) for _ in texts]
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = piece_starts(points, begins[sizes > 0])
        bounds = [*starts.tolist(), len(joined)]
        known = self.pieces
        packed = [known[joined[a:b]] for a, b in zip(bounds, bounds[1:])]
        cut = np.searchsorted(starts, begins).tolist() + [len(packed)]
        return [np.frombuffer(b"".join(packed[a:b]), np.uint32) for a, b in zip(cut, cut[1:])]

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)])

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each token's bytes begin in the encoded text, and its length at the end."""
        return np.concatenate([[0], np.cumsum(self.sizes[ids])])

    def decode_span(self, ids: np.ndarray, offsets: np.ndarray, a: int, b: int) -> bytes:
        """Bytes [a, b) of the encoded text: only the tokens that offsets place there are decoded."""
        first = max(0, int(np.searchsorted(offsets, a, side="right")) - 1)
        last = int(np.searchsorted(offsets, b, side="left"))
        found = self.decode(ids[first:last])
        return found[max(0, a - int(offsets[first])) : max(0, b - int(offsets[first]))]


@lru_cache(2)
def _tool(path: str) -> ByteBPE:
    """One for each worker process, whose ranks and cache last over its tasks."""
    return ByteBPE(path)


def _vocabulary(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, ids array<int>, offsets array<long>) of every whole text; null and empty texts have no ids and the offset 0.

    offsets: where each token begins in the text's UTF-8, then its length, so any run of tokens maps back to its bytes.
    Repeated rows give repeated rows; other columns are not carried. No shuffle; a worker holds one batch and the cache.
    """
    path = _vocabulary(vocabulary)

    def make():
        tool = _tool(path)

        def one(text: str) -> tuple:
            ids = tool.encode(text)
            return ids.tolist(), tool.offsets(ids).tolist()

        return one

    return per_text(df, id_col, text_col, make, "ids array<int>, offsets array<long>")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(id, bytes) of every row of ids; null ids give empty bytes."""
    path = _vocabulary(vocabulary)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _tool(path)
        for batch in batches:
            data = [tool.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=[id_col, "bytes"])

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, bytes binary")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, n_bytes, offsets_crc32): every whole text encoded, and its ids decoded again.

    Decoding goes span by span of DECODE_BYTES, by the offsets; n_bytes is where they end, offsets_crc32 the checksum of
    all of them as little-endian 64-bit integers. Cases as :func:`encode`.
    """
    path = _vocabulary(vocabulary)
    kind = df.schema[id_col].dataType.simpleString()
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "offsets_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _tool(path)
        numbers = [str(i) for i in range(len(tool.tokens))]
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, held, first = [], 0, at
                while at < batch.num_rows and held < SCAN_CHARS:
                    texts.append(batch.column(1)[at].as_py() or "")
                    held += len(texts[-1])
                    at += 1
                rows = []
                for ids in tool.encode_many(texts):
                    offsets, digest = tool.offsets(ids), hashlib.sha256()
                    for a in range(0, int(offsets[-1]), DECODE_BYTES):
                        digest.update(tool.decode_span(ids, offsets, a, min(a + DECODE_BYTES, int(offsets[-1]))))
                    rows.append((len(ids), sha256_hex(" ".join([numbers[i] for i in ids.tolist()])), digest.hexdigest(), int(offsets[-1]), zlib.crc32(offsets.astype("<i8").tobytes())))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, at - first), *(pa.array(c, k) for c, k in zip(zip(*rows), types))], names=names)

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, offsets_crc32 long")
