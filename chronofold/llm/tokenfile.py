"""Token ids as wavelet matrices: one succinct shard answers access, count and occurrence, and decodes whole.

A shard holds a run of documents. Its ids are split into bit-planes from the highest bit down; after each plane the ids
are dealt stably, those with a 0 first. A plane is kept as bits with the number of ones before every block. On disk the
bits are compressed in chunks with a directory, so that a question inflates the chunks that it asks, and no others.
"""

from __future__ import annotations

import codecs
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm.common import bucket_of, id_cuts, partitions
from chronofold.session import scratch_path

BITS = 16
END_ID = 2
#: A shard is closed with the document in which it reaches this many ids.
SHARD_IDS = 1_000_000
BLOCK = 2048
#: Bytes of a plane that are compressed together.
CHUNK = 4096
#: Stretches of text whose ids a worker keeps at most; then it starts afresh.
CACHE_STRETCHES = 1_200_000
#: Bytes of texts encoded at once, in whole texts; among these each distinct stretch is looked up once.
BATCH_BYTES = 8_000_000
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class _Stored:
    """The bit-planes of a stored shard; chunks are inflated when they are asked for, and kept."""

    def __init__(self, data: bytes, n: int, at: int):
        self.wide = (n + 7) // 8
        self.chunks = -(-self.wide // CHUNK)
        self.data, self.edges = data, np.frombuffer(data, np.uint32, BITS * self.chunks + 1, at).astype(np.int64) + at + 4 * (BITS * self.chunks + 1)
        self.tool, self.inflated = zstandard.ZstdDecompressor(), {}

    def _chunk(self, k: int) -> bytes:
        if k not in self.inflated:
            self.inflated[k] = self.tool.decompress(self.data[self.edges[k] : self.edges[k + 1]])
        return self.inflated[k]

    def __call__(self, level: int, a: int, b: int) -> np.ndarray:
        """Bytes [a, b) of a plane, as far as there are."""
        b = min(b, self.wide)
        if a >= b:
            return np.empty(0, np.uint8)
        first, last = a // CHUNK, (b - 1) // CHUNK
        found = b"".join([self._chunk(level * self.chunks + k) for k in range(first, last + 1)])
        return np.frombuffer(found, np.uint8)[a - first * CHUNK : b - first * CHUNK]


class Wavelet:
    """A sequence of ids below 2**16."""

    def __init__(self, n: int, plane: Callable[[int, int, int], np.ndarray], ranks: np.ndarray):
        """plane(level, a, b): bytes of a plane's packed bits, highest plane first, little bit order; ranks: for each plane the ones before each block of BLOCK bits, and in all."""
        self.n, self.plane, self.ranks = n, plane, ranks
        self.zeros = (n - ranks[:, -1].astype(np.int64)).tolist()

    @classmethod
    def of(cls, ids: np.ndarray) -> Wavelet:
        seq, dealt, planes = ids.astype(np.uint16), np.empty(len(ids), np.uint16), []
        ranks = np.zeros((BITS, (len(ids) + BLOCK - 1) // BLOCK + 1), np.uint32)
        for level in range(BITS):
            bit = (seq & np.uint16(1 << (BITS - 1 - level))) != 0
            packed = np.packbits(bit, bitorder="little")
            planes.append(packed)
            if len(packed):
                ranks[level, 1:] = np.cumsum(np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), BLOCK // 8), dtype=np.int64))
            zeros = len(ids) - int(ranks[level, -1])
            seq.take(np.flatnonzero(~bit), out=dealt[:zeros], mode="clip")  # no place is beyond; other modes copy
            seq.take(np.flatnonzero(bit), out=dealt[zeros:], mode="clip")
            seq, dealt = dealt, seq
        return cls(len(ids), lambda level, a, b: planes[level][a:b], ranks)

    def to_bytes(self) -> bytes:
        """The length, the ranks, a directory of where each compressed chunk of each plane begins, and the chunks."""
        tool, wide = zstandard.ZstdCompressor(level=1), (self.n + 7) // 8
        parts = [tool.compress(self.plane(level, a, a + CHUNK).tobytes()) for level in range(BITS) for a in range(0, wide, CHUNK)]
        edges = np.cumsum([0, *map(len, parts)]).astype(np.uint32)
        return b"".join([self.n.to_bytes(8, "little"), self.ranks.tobytes(), edges.tobytes(), *parts])

    @classmethod
    def from_bytes(cls, data: bytes) -> Wavelet:
        n = int.from_bytes(data[:8], "little")
        blocks = (n + BLOCK - 1) // BLOCK + 1
        ranks = np.frombuffer(data, np.uint32, BITS * blocks, 8).reshape(BITS, blocks)
        return cls(n, _Stored(data, n, 8 + ranks.nbytes), ranks)

    def _rank(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block = i // BLOCK
        ones = int(self.ranks[level, block])
        if i % BLOCK:
            part = self.plane(level, block * BLOCK // 8, i // 8 + 1)
            whole = i // 8 - block * BLOCK // 8
            ones += int(_ONES[part[:whole]].sum()) + (int(_ONES[part[whole] & ((1 << i % 8) - 1)]) if i % 8 else 0)
        return ones

    def _select(self, level: int, bit: int, k: int) -> int:
        """Where the ``k``-th (from 0) bit of this kind stands: blocks by bisection, then one block."""
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if bit else np.minimum(np.arange(len(ranks)) * BLOCK, self.n) - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        a = block * BLOCK
        bits = np.unpackbits(self.plane(level, a // 8, a // 8 + BLOCK // 8), bitorder="little")[: self.n - a]
        return a + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        value = 0
        for level in range(BITS):
            ones = self._rank(level, i)
            bit = int(self.plane(level, i // 8, i // 8 + 1)[0] >> (i % 8)) & 1
            i = self.zeros[level] + ones if bit else i - ones
            value = 2 * value + bit
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(BITS):
            a, b = self._rank(level, lo), self._rank(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (BITS - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often a token occurs in [lo, hi)."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def occurrence(self, token: int, k: int) -> int:
        """Where a token occurs for the ``k``-th time (from 0), or -1."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            return -1
        i = a + k
        for level in reversed(range(BITS)):
            bit = token >> (BITS - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, token: int) -> np.ndarray:
        """All places of a token, ascending: a select for each, or one decoding where it occurs often."""
        found = self.count(token)
        if 32 * found > self.n:
            return np.flatnonzero(self.decode() == token)
        return np.array([self.occurrence(token, k) for k in range(found)], np.int64)

    def decode(self) -> np.ndarray:
        """All ids: the stable deals undone from the lowest plane up."""
        seq, up = np.zeros(self.n, np.uint16), np.empty(self.n, np.uint16)
        for level in reversed(range(BITS)):
            bit = np.unpackbits(self.plane(level, 0, (self.n + 7) // 8), count=self.n, bitorder="little").view(bool)
            zeros = self.zeros[level]
            seq[zeros:] |= np.uint16(1 << (BITS - 1 - level))
            up[np.flatnonzero(~bit)] = seq[:zeros]
            up[np.flatnonzero(bit)] = seq[zeros:]
            seq, up = up, seq
        return seq


class _Known(dict):
    """Packed ids of stretches of text, each worked out by the library when it is met first."""

    def __init__(self, encoder: LibraryEncoder, blank: str):
        self.encoder, self.blank = encoder, blank

    def __missing__(self, part: str) -> bytes:
        if len(self) >= CACHE_STRETCHES:
            self.clear()
        ids = self.encoder.word(part, self.blank) if part.isalpha() else self.encoder.stretch(part, self.blank)
        joined = 0 < part.find("\n") < len(part) - 1 and part.replace("\n", "", 1).isprintable()  # of two that are kept
        if len(part) <= 64 and not joined:
            self[part] = ids
        return ids


class LibraryEncoder:
    """Encodes with the tokenizers library, each distinct stretch of text once.

    A byte-level pre-tokeniser always cuts before a blank that follows a character other than white space, so what
    stands between such blanks can be encoded apart. It cuts as well around a lone line feed and between letters and the
    marks that end a word; a word of letters alone is one piece and goes to the library's BPE model as it is. A text in
    which a blank follows white space, and any other stretch, goes through the library whole.
    """

    #: What Python calls white space, and a blank.
    _HARD = r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
    #: Marks at a word's end that are encoded apart; no apostrophe, which may belong to a contraction.
    _MARKS = ".,;:!?*#$%&|()"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.model = self.tool.model
        size = self.tool.get_vocab_size()
        if size > 1 << BITS:
            raise ValueError(f"ids of this vocabulary have more than {BITS} bits")
        self.two = [np.uint16(i).tobytes() for i in range(size)]
        # how this vocabulary writes each byte: printable ones as they are, the others as the characters from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        letters = {**{b: chr(b) for b in plain}, **{b: chr(256 + k) for k, b in enumerate(others)}}
        self.letters = "".join(letters[b] for b in range(256))
        self.blank = self.letters[32]
        self.known, self.bare = _Known(self, " "), _Known(self, "")
        self.feed = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return np.array(self.tool.encode(text, add_special_tokens=False).ids, np.uint16).tobytes()

    def word(self, word: str, blank: str) -> bytes:
        """Ids of letters, with one blank before them or none."""
        written = word if word.isascii() else codecs.charmap_decode(word.encode(), "strict", self.letters)[0]
        two = self.two
        return b"".join([two[t.id] for t in self.model.tokenize(self.blank + written if blank else written)])

    def stretch(self, part: str, blank: str) -> bytes:
        """Ids of a stretch that holds no blank and not letters alone, with one blank before it or none."""
        stem = part.rstrip(self._MARKS)
        if stem.isalpha():
            return (self.known if blank else self.bare)[stem] + self.bare[part[len(stem) :]]
        head, feed, rest = part.partition("\n")
        if feed and head.isprintable() and rest.isprintable() and head and rest:  # printable: no white space
            return (self.known if blank else self.bare)[head] + self.feed + self.bare[rest]
        return self.whole(blank + part)

    def packed(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 16-bit integers."""
        return self.packed_all(pa.array([text]), b"")[0].as_py()

    def packed_all(self, texts: pa.Array, closing: bytes) -> pa.Array:
        """Ids of each text (null: empty) as little-endian unsigned 16-bit integers, each followed by ``closing``.

        Arrow splits the texts and numbers their stretches, so that Python meets a distinct one once; the ids of each
        are then put where it stands. A text's first stretch, with no blank before it, has an entry of its own; a text
        that the library encodes whole is that entry alone.
        """
        texts = texts.cast(pa.string()).fill_null("")
        hard = pc.match_substring_regex(texts, self._HARD)
        split = pc.split_pattern(pc.if_else(hard, "", texts) if pc.any(hard).as_py() else texts, " ")
        offsets, numbered = split.offsets.to_numpy(), split.values.dictionary_encode()
        del split
        n, distinct, begins = len(texts), len(numbered.dictionary), offsets[:-1]
        at = numbered.indices.to_numpy().copy()
        firsts = [self.bare[first] if first else b"" for first in numbered.dictionary.take(pa.array(at[begins])).to_pylist()]
        for k in np.flatnonzero(hard.to_numpy(zero_copy_only=False)).tolist():
            firsts[k] = self.whole(texts[k].as_py())
        at[begins] = distinct + np.arange(n)
        used = np.zeros(distinct + n, bool)
        used[at] = True
        parts = numbered.dictionary.to_numpy(zero_copy_only=False)
        del numbered
        entries = list(map(self.known.get, parts))
        for k in [k for k, ids in enumerate(entries) if ids is None]:
            if used[k]:
                entries[k] = self.known[parts[k]]
        placed = pa.array([*entries, *firsts, closing], pa.binary()).take(pa.array(np.insert(at, offsets[1:], distinct + n)))
        edges = np.frombuffer(placed.buffers()[1], np.int32, len(placed) + 1)[np.append(begins + np.arange(n), len(placed))]
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(edges), placed.buffers()[2]])


_ENCODERS: dict[str, LibraryEncoder] = {}


def _encoder(path: str) -> LibraryEncoder:
    """One for each worker process, whose cache lasts over its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


def _forget() -> None:
    """Free what this worker process knows of stretches: its texts are encoded."""
    for tool in _ENCODERS.values():
        tool.known.clear()
        tool.bare.clear()
    pa.default_memory_pool().release_unused()


def _vocabulary(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Write every whole text's ids, each document closed by ``end_id``, in ascending id order as shards below ``path``.

    Ids are dealt by ranges of document ids (ties: by their ids' bytes; null ids first), packed, once; a task writes its
    range as a run of shards and holds one. Shards go through Spark's writer, so each is whole or absent. Null texts
    count as empty; an empty table gives no shards. Other columns are not carried.
    """
    vocab = _vocabulary(vocabulary)
    cuts = id_cuts(df, id_col, partitions(df.sparkSession))
    closing = np.array([end_id], np.uint16).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _encoder(vocab)
        for batch in batches:
            held = np.cumsum(pc.binary_length(batch.column(2)).fill_null(0).to_numpy(), dtype=np.int64) // BATCH_BYTES
            edges = [0, *(np.flatnonzero(np.diff(held)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), tool.packed_all(part.column(2), closing)], names=["id", "bucket", "ids"])

    placed = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).select("id", bucket_of("id", cuts).cast("int").alias("bucket"), "text")
    packed = placed.mapInArrow(encode, "id long, bucket int, ids binary")
    dealt = packed.repartitionById(len(cuts) + 1, F.col("bucket")).sortWithinPartitions("bucket", F.col("id").asc_nulls_first(), "ids")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {"bucket": None, "first": 0, "number": 0}
        _forget()
        docs: list[int | None] = []
        sizes: list[int] = []
        parts: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            data = Wavelet.of(np.frombuffer(b"".join(parts), np.uint16)).to_bytes()
            row = [[state["bucket"]], [state["number"]], [state["first"]], [held], [list(docs)], [list(sizes)], [data]]
            state["first"], state["number"] = state["first"] + held, state["number"] + 1
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, types)], names=names)

        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        names = ["bucket", "number", "first", "n_ids", "docs", "sizes", "wavelet"]
        for batch in batches:
            for doc, bucket, ids in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if docs and (bucket != state["bucket"] or held >= SHARD_IDS):
                    yield close()
                    docs, sizes, parts, held = [], [], [], 0
                if bucket != state["bucket"]:
                    state |= {"bucket": bucket, "first": 0, "number": 0}
                docs.append(doc)
                sizes.append(len(ids) // 2)
                parts.append(ids)
                held += len(ids) // 2
        if docs:
            yield close()

    kinds = "bucket int, number int, first long, n_ids long, docs array<long>, sizes array<long>, wavelet binary"
    # the planes are compressed already, chunk by chunk
    dealt.mapInArrow(shards, kinds).write.option("compression", "uncompressed").parquet(path)


def _shards(spark: SparkSession, path: str) -> tuple[DataFrame, list[int]]:
    """The shards below ``path``, and for each range of document ids how many ids are before it: one number each."""
    shards = spark.read.schema("bucket int, number int, first long, n_ids long, docs array<long>, sizes array<long>, wavelet binary").parquet(path)
    totals = {r["bucket"]: r["n"] for r in shards.groupBy("bucket").agg(F.sum("n_ids").alias("n")).collect()}
    starts = [0]
    for b in range(max(totals, default=0)):
        starts.append(starts[-1] + totals.get(b, 0))
    return shards, starts


def _begins(starts: list[int]) -> Column:
    """Where a shard begins among all ids."""
    return F.get(F.lit(starts).cast("array<bigint>"), F.col("bucket")) + F.col("first")


def access(spark: SparkSession, path: str, places: list[int]) -> DataFrame:
    """(place, token) of the given places among all ids, in the order of documents; places that are none have no row.

    Shards without such a place are skipped by what Parquet tells of them; of the others 16 chunks are inflated for each place.
    """
    shards, starts = _shards(spark, path)
    wanted = np.array(sorted(set(places)), np.int64)
    rows = shards.select(_begins(starts).alias("begin"), "n_ids", "wavelet")
    held = F.lit(False)
    for a in range(0, len(wanted), 100):  # ranges of places: a filter of bounded size that never drops a shard with one
        held = held | ((F.col("begin") <= int(wanted[a : a + 100][-1])) & (F.col("begin") + F.col("n_ids") > int(wanted[a])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, n, data in zip(*(batch.column(k) for k in range(3))):
                own = wanted[np.searchsorted(wanted, begin.as_py()) : np.searchsorted(wanted, begin.as_py() + n.as_py())]
                if len(own):
                    shard = Wavelet.from_bytes(data.as_py())
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([shard.access(int(p) - begin.as_py()) for p in own], pa.int32())], names=["place", "token"])

    return rows.filter(held).mapInArrow(run, "place long, token int")


def count(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """(token, n): how often each of the given tokens occurs in all documents; tokens that do not occur have 0.

    A task inflates at most 32 chunks of a shard for each token; sums are combined map-side.
    """
    wanted = sorted(set(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                shard = Wavelet.from_bytes(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int32()), pa.array([shard.count(t) for t in wanted], pa.int64())], names=["token", "n"])

    none = spark.createDataFrame([(t, 0) for t in wanted], "token int, n long")
    found = _shards(spark, path)[0].select("wavelet").mapInArrow(run, "token int, n long")
    return found.unionByName(none).groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, path: str, token: int, id_col: str = "doc_id") -> DataFrame:
    """(id, place) of each occurrence of a token; place: among all ids, in the order of documents."""
    shards, starts = _shards(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                begin, docs, sizes, data = (batch.column(k)[i] for k in range(4))
                found = Wavelet.from_bytes(data.as_py()).occurrences(token)
                owner = np.searchsorted(np.cumsum(sizes.values.to_numpy()), found, side="right")
                yield pa.RecordBatch.from_arrays([docs.values.take(pa.array(owner)), pa.array(found + begin.as_py())], names=[id_col, "place"])

    return shards.select(_begins(starts).alias("begin"), "docs", "sizes", "wavelet").mapInArrow(run, f"`{id_col}` long, place long")


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, decoded from the shards below ``path``; no shuffle.

    start: ids of all documents before it. The driver adds up one number for each range of document ids.
    """
    shards, starts = _shards(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                base = starts[batch.column(0)[i].as_py()] + batch.column(1)[i].as_py()
                ids = Wavelet.from_bytes(batch.column(4)[i].as_py()).decode().astype("<u4")
                sizes = batch.column(3)[i].values.to_numpy()
                ends = np.cumsum(sizes)
                begins = ends - sizes
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(2)[i].values, pa.array(begins + base, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    return shards.select("bucket", "first", "docs", "sizes", "wavelet").mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def write_and_read(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids written below the shared folder and read back: see :func:`write` and :func:`read`."""
    path = scratch_path(df.sparkSession, "tokens")
    write(df, path, id_col, text_col)
    return read(df.sparkSession, path, id_col)
