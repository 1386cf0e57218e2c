"""SimHash near-duplicates with pigeonring filtering.

A 64-bit fingerprint is read as a ring of four segments. If two fingerprints differ in at most 3 bits, some segment
starts a chain round the ring whose first ``l`` segments differ in at most ``3 l / 4`` bits, for every ``l``: none in the
first, one in two, two in three. The first one thus is a key; the rest, cut into four, has a part without difference as
well, so a key has 28 bits and buckets stay small however many fingerprints there are. Within a bucket the chain is
checked before the whole distance.

Near copies by five-word shingles differ in far more than 3 bits, and need longer fingerprints: see :func:`near_copies`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm.common import per_text
from chronofold.operators.components import connected_components
from chronofold.session import cut, store

SHINGLE = 3
MAX_BITS = 3
#: A bucket with more fingerprints is cut into chunks of about this many, which meet in pairs.
CHUNK = 2_000
#: Near copies: shingles of so many words, and the Jaccard likeness from which on their sets are alike.
WORDS, LIKENESS = 5, 0.8
#: Their fingerprints have so many bits, signs of projections; DIM * ROTATIONS projections are made, in segments of SEGMENT.
BITS, DIM, ROTATIONS, SEGMENT = 1_024, 4_096, 8, 512
#: Candidates agree in the strongest bits of so many consecutive segments.
CHAIN = 3
#: Texts projected at once, and words whose hashes a worker keeps at most; then it starts afresh.
GROUP, CACHE_WORDS = 64, 200_000
#: Values of a search tree's front that meet the rest of a bucket at once.
FRONT = 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SEED = 42


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bit by bit the majority of the shingles' hashes; 0 without words."""
    listed = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not listed:
        return 0
    if len(listed) < shingle:
        parts = [b" ".join(listed)]
    else:
        parts = map(b" ".join, zip(*(listed[k:] for k in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(p, _SEED) for p in parts], np.uint64)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[a : a + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp long) of every whole text; null texts have no words. No shuffle."""

    def make():
        return lambda text: (np.uint64(fingerprint(text, shingle)).astype(np.int64).item(),)

    return per_text(df, id_col, text_col, make, "fp long")


def _keys(fp: Column) -> Column:
    """The sixteen keys: segment i as it is, and part q of the other three."""
    whole = lambda shift, width: F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))
    keys = []
    for i in range(4):
        rest = F.lit(0).cast("long")
        for k in range(1, 4):  # the three that follow on the ring, end to end
            rest = rest.bitwiseOR(F.shiftleft(whole(16 * ((i + k) % 4), 16), 16 * (k - 1)))
        for q in range(4):
            part = F.shiftrightunsigned(rest, 12 * q).bitwiseAND(F.lit(0xFFF))
            keys.append(F.lit((4 * i + q) << 28).cast("long").bitwiseOR(F.shiftleft(whole(16 * i, 16), 12)).bitwiseOR(part))
    return F.array(*keys)


def _near(x: np.ndarray, y: np.ndarray, start: int) -> np.ndarray:
    """Which pairs pass the chain from a ring segment on, and so differ in at most 3 bits in all."""
    differ = x[:, None] ^ y[None, :]
    passed = np.ones(differ.shape, bool)
    total = np.zeros(differ.shape, np.uint8)
    for step in range(4):
        total += np.bitwise_count(differ >> np.uint64(16 * ((start + step) % 4)) & np.uint64(0xFFFF))
        passed &= total <= MAX_BITS * (step + 1) // 4
        if not passed.any():
            break
    return passed


def _tree(values: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links (places in ``values``) that join what is near in a bucket: a search tree of each component, at most one link for each value."""
    left, found = np.arange(len(values)), []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            hit = np.full(len(left), -1)
            for a in range(0, len(front), FRONT):
                open_ = np.flatnonzero(hit < 0)
                if not len(open_):
                    break
                close = near(values[front[a : a + FRONT]], values[left[open_]])
                new = close.any(axis=0)
                hit[open_[new]] = a + close[:, new].argmax(axis=0)
            got = hit >= 0
            found += zip(front[hit[got]].tolist(), left[got].tolist())
            front, left = left[got], left[~got]
    return found


def _deal(keyed: DataFrame) -> DataFrame:
    """(key, lo, hi, node): rows of (node, key) whose key others share, dealt to the pairs of chunks that meet.

    Keys are counted first, map-side combined. A key of more than CHUNK rows is cut into c chunks of about CHUNK, and each
    goes to the c pairs that it is part of; so no task holds more than two chunks, at the price of c copies of a row.
    """
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = keyed.join(shared, "key").withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    own = met.select("key", "node", "chunks", chunk.alias("c"))
    return own.select("key", "node", "c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("d")).select("key", F.least("c", "d").alias("lo"), F.greatest("c", "d").alias("hi"), "node")


def _solve(dealt: DataFrame, tree: Callable[[np.ndarray, int], list[tuple[int, int]]], node: str) -> DataFrame:
    """(a, b): the links that ``tree(values, key)`` finds within each (key, lo, hi); the last column has the values, node the type of a and b.

    Rows stream through in order of their group; a task holds an Arrow batch and one group.
    """
    sorted_ = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last group so far: it may go on in the next batch

        def solve(batch: pa.RecordBatch) -> pa.RecordBatch:
            key, lo, hi = (batch.column(k).to_numpy() for k in range(3))
            values = _values(batch.column(batch.num_columns - 1))
            edge = np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            found: list[tuple[int, int]] = []
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(key)]):
                if b - a > 1:
                    found += [(a + x, a + y) for x, y in tree(values[a:b], int(key[a]))]
            pairs = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([batch.column(3).take(pa.array(pairs[:, k])) for k in (0, 1)], names=["a", "b"])

        def place(batch: pa.RecordBatch, row: int) -> list:
            return [batch.column(k)[row].as_py() for k in range(3)]

        for batch in batches:
            if not batch.num_rows:
                continue
            if held and place(held[0], 0) != place(batch, batch.num_rows - 1):
                batch, held = pa.concat_batches([*held, batch]), []
            if held:
                held.append(batch)
                continue
            same = np.logical_and.reduce([batch.column(k).to_numpy() == batch.column(k)[-1].as_py() for k in range(3)])
            at = int(np.argmax(same))
            if at:
                yield solve(batch.slice(0, at))
            held = [batch.slice(at)]
        if held:
            yield solve(pa.concat_batches(held))

    return sorted_.mapInArrow(run, f"a {node}, b {node}").distinct()


def _values(column: pa.Array) -> np.ndarray:
    """64-bit words: one for each row, or a row of them for each binary of equal width."""
    if pa.types.is_int64(column.type):
        return column.to_numpy().view(np.uint64)
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint64).reshape(len(rows), -1)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``fp``) within 3 bits that join exactly what all such pairs join."""
    keyed = distinct.select(F.col("fp").alias("node"), F.explode(_keys(F.col("fp"))).alias("key"))
    return _solve(_deal(keyed), lambda values, key: _tree(values, lambda x, y: _near(x, y, (key >> 28) // 4)), "long")


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp, component_id) of every row; component_id: the smallest id reachable over links, the row's own included.

    Equal fingerprints are one node, so groups of copies cost one row each; nodes link within 3 bits. Null and empty texts
    share the fingerprint 0 and are linked like any other. Rows with a null id take part; a component of such rows alone
    has a null component_id. Repeated rows give repeated rows; an empty table gives an empty result.
    """
    prints = cut(fingerprints(df, id_col, text_col, shingle))
    nodes = cut(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
    found = connected_components(links(nodes.select("fp")))
    linked = found.select(F.col("node").alias("fp"), "component")
    named = nodes.join(linked, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    label = cut(named.join(least, "component").select("fp", "component_id"))
    return prints.join(label, "fp").select(id_col, "fp", "component_id")


# near copies: five words, a similarity of 0.8


def most_bits(likeness: float = LIKENESS, bits: int = BITS) -> int:
    """The Hamming distance up to which fingerprints count as alike: what sets of this Jaccard likeness differ by on average, and one standard deviation."""
    share = math.acos(2 * likeness / (1 + likeness)) / math.pi
    return round(bits * share + math.sqrt(bits * share * (1 - share)))


class _Hashes(dict):
    """Words' 64-bit hashes, each worked out when it is met first."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, _SEED)
        return found


class Projection:
    """Random projections of texts' sets of word shingles: the fingerprint's bits are signs of projections.

    A set is hashed with signs into DIM numbers, and these are turned ROTATIONS times by signed Hadamard transforms. The
    strongest bit of a segment of projections is the one of largest amount: the least likely to flip between near copies.
    """

    def __init__(self, shingle: int = WORDS):
        self.shingle, self.words = shingle, _Hashes()
        draw = np.random.default_rng(_SEED)
        self.signs = draw.choice(np.array([-1, 1], np.float32), (ROTATIONS + 1, DIM))
        side = math.isqrt(DIM)
        self.hadamard = np.ones((1, 1), np.float32)
        while len(self.hadamard) < side:
            self.hadamard = np.block([[self.hadamard, self.hadamard], [self.hadamard, -self.hadamard]])

    def shingles(self, text: str) -> np.ndarray:
        """Distinct hashes of the shingles; of fewer words: one, of all; of none: none."""
        listed = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
        wide = min(self.shingle, len(listed))
        if not wide:
            return np.empty(0, np.uint64)
        each = np.fromiter(map(self.words.__getitem__, listed), np.uint64, len(listed))
        with np.errstate(over="ignore"):
            total = np.full(len(each) - wide + 1, wide, np.uint64)
            for k in range(wide):
                total = total * np.uint64(0x9E3779B97F4A7C15) + each[k : len(each) - wide + 1 + k]
            total = (total ^ (total >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(total ^ (total >> np.uint64(29)))

    def _turn(self, x: np.ndarray) -> np.ndarray:
        side = len(self.hadamard)
        return np.matmul(self.hadamard, np.matmul(x.reshape(-1, side, side), self.hadamard)).reshape(len(x), DIM)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprints as bytes, strongest bits of the segments: 2 * place + sign)."""
        sets = [self.shingles(t) for t in texts]
        every = np.concatenate([np.empty(0, np.uint64), *sets])
        slot = np.repeat(np.arange(len(sets)), [len(s) for s in sets]) * DIM + (every & np.uint64(DIM - 1)).astype(np.int64)
        sign = 1.0 - 2.0 * (every >> np.uint64(40) & np.uint64(1)).astype(np.float64)
        x = np.bincount(slot, sign, len(sets) * DIM).astype(np.float32).reshape(len(sets), DIM)
        x = self._turn(x * self.signs[0])  # spreads a few shingles over all dimensions
        turned = np.stack([self._turn(x * s) for s in self.signs[1:]], axis=1).reshape(len(sets), -1, SEGMENT)
        place = np.abs(turned).argmax(axis=2)
        positive = np.take_along_axis(turned, place[:, :, None], 2)[:, :, 0] > 0
        bits = np.packbits(turned.reshape(len(sets), -1)[:, :BITS] > 0, axis=1, bitorder="little")
        return bits, 2 * place + positive


@lru_cache(2)
def _projection(shingle: int) -> Projection:
    """One for each worker process."""
    return Projection(shingle)


def chain_keys(strongest: np.ndarray) -> np.ndarray:
    """For each segment of the ring the strongest bits of the chain of CHAIN segments that starts there, and its number."""
    wide = (2 * SEGMENT - 1).bit_length()
    keys = np.broadcast_to(np.arange(strongest.shape[1]), strongest.shape).astype(np.int64)
    for k in range(CHAIN):
        keys = (keys << wide) | np.roll(strongest, -k, axis=1)
    return keys


def prints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WORDS) -> DataFrame:
    """(id, digest, fp, keys) of every whole text: the text's hash, its fingerprint of BITS bits and its chains' keys. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _projection(shingle)
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                bits, strongest = tool([t or "" for t in part.column(2).to_pylist()])
                keys = chain_keys(strongest)
                edges = pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([b.tobytes() for b in bits], pa.binary()), pa.ListArray.from_arrays(edges, pa.array(keys.ravel()))], names=["id", "digest", "fp", "keys"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, digest long, fp binary, keys array<long>")


def alike(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Which pairs of fingerprints (rows of 64-bit words) differ in at most ``most`` bits, by the pigeonring over their words.

    Some chain round the ring starts at a word from which on every run of ``l`` words differs in at most ``l`` shares of
    the budget. Pairs without a word within its share drop out; the others follow their chains, then the whole count.
    """
    words = x.shape[1]
    differ = np.stack([np.bitwise_count(x[:, None, k] ^ y[None, :, k]) for k in range(words)], axis=2).astype(np.int16)
    close = np.zeros(differ.shape[:2], bool)
    some = np.flatnonzero((differ * words <= most).any(axis=2))
    if not len(some):
        return close
    ring = differ.reshape(-1, words)[some]
    ring = np.concatenate([ring, ring[:, :-1]], axis=1).cumsum(axis=1)
    chained = np.zeros(len(some), bool)
    share = most * np.arange(1, words + 1)
    for start in range(words):
        runs = ring[:, start : start + words] - (ring[:, start - 1 : start] if start else 0)
        chained |= (runs * words <= share).all(axis=1)
    close.ravel()[some[chained]] = ring[chained, words - 1] <= most
    return close


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", likeness: float = LIKENESS, shingle: int = WORDS) -> DataFrame:
    """(id, digest, component) of every row: texts are linked where their fingerprints say that their sets of shingles are alike.

    Texts with equal fingerprints are one node. Two nodes are candidates if they agree in the strongest bits of a chain of
    CHAIN segments; within a key the pigeonring prunes, the whole Hamming distance decides, and a search tree's links join
    what all alike pairs of the key join. So nothing is lost but pairs that share no chain (README: measured recall). Null
    and empty texts are one node; rows with a null id take part; an empty table gives an empty result.
    """
    found = store(prints(df, id_col, text_col, shingle).withColumn("node", F.unhex(F.md5("fp"))), "prints")
    nodes = store(found.groupBy("node").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys")), "nodes")
    dealt = _deal(nodes.select("node", F.explode("keys").alias("key"))).join(nodes.select("node", "fp"), "node").select("key", "lo", "hi", "node", "fp")
    most = most_bits(likeness)
    joined = _solve(dealt, lambda values, _: _tree(values, lambda x, y: alike(x, y, most)), "binary")
    linked = connected_components(joined)
    return found.select("id", "digest", "node").join(linked, "node", "left").select("id", "digest", F.coalesce("component", "node").alias("component"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", likeness: float = LIKENESS, shingle: int = WORDS) -> DataFrame:
    """``docs``, all columns, with one row of each group of near copies: that of the smallest id (of repeated ids: one of them).

    Rows with a null id are kept apart as they are: no id tells them from each other.
    """
    found = near_copies(docs.filter(F.col(id_col).isNotNull()), id_col, text_col, likeness, shingle)
    each = found.groupBy("component", "id", "digest").agg(F.count("*").alias("rows"))
    keep = cut(each.groupBy("component").agg(F.min(F.struct("id", "digest", "rows")).alias("k")).select(F.col("k.id").alias("_keep"), F.col("k.digest").alias("_digest"), F.col("k.rows").alias("_rows")))
    kept = docs.join(keep, (docs[id_col] == keep["_keep"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == keep["_digest"]))
    if not keep.filter("_rows > 1").isEmpty():
        nth = F.row_number().over(Window.partitionBy("_keep", "_digest").orderBy("_digest"))
        kept = kept.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")
    return kept.drop("_keep", "_digest", "_rows").unionByName(docs.filter(F.col(id_col).isNull()))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
