"""Document fingerprints by randomised edit embedding.

A text is walked from its first character: at step ``j`` the walk reads the character under it and stays or advances
by a coin that depends on ``j`` and the character only. All texts share the coins, so two texts that differ by few
edits fall into step again soon after each edit, and the Hamming distance of the two walks follows the texts' edit
distance. The fingerprint samples the walk at shared random steps (those of the lowest priority below twice the
length, so texts of similar length sample the same steps), one byte for each; 0 marks a step after the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import bucket_of, id_cuts, partitions, sha256_hex

SAMPLES = 256
SEED = 0x5EED
#: Texts are walked side by side up to this many characters at once.
GROUP_CHARS = 4_000_000
#: ... and so many texts at once: each has ``samples`` steps to look up, whatever its length.
GROUP_TEXTS = 1_500
#: Lengths whose sampled steps are kept at most; then they are found afresh.
KNOWN_LENGTHS = 2_048
#: Rows of an Arrow batch that a worker holds as Python objects at once.
SLICE_ROWS = 500
#: Below so many running walks a plain loop is quicker than an array step.
FEW = 24
STEPS = 64
#: A band of more rows, or of more characters, is cut into chunks of about so many, which meet in pairs.
BAND_ROWS = 500
BAND_CHARS = 16_000_000
#: Characters are counted in so many classes before edits are.
CLASSES = 64


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: 64 well-mixed bits for each number."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class EditEmbedding:
    """Walks texts. Coins and priorities are computed on demand and kept, as long as the longest walk so far."""

    def __init__(self, samples: int = SAMPLES, seed: int = SEED):
        self.samples, self.seed = samples, seed
        self._coins = np.empty(0, np.uint64)
        self._levels: list[np.ndarray] = []
        self._known = 0
        self._steps: dict[int, np.ndarray] = {}

    def _salt(self, k: int) -> np.uint64:
        return np.uint64((self.seed * 0x9E3779B97F4A7C15 + k * 0xD1342543DE82EF95) % 2**64)

    def coins(self, n: int) -> np.ndarray:
        """A word for each of the first ``n`` steps (at least); bit ``c`` is the coin for characters of class ``c``."""
        if len(self._coins) < n:
            self._coins = _mix(np.arange(max(n, 2 * len(self._coins), 4096), dtype=np.uint64) ^ self._salt(1))
        return self._coins

    def _priority(self, steps: np.ndarray) -> np.ndarray:
        return _mix(steps.astype(np.uint64) ^ self._salt(2))

    def _level(self, level: int, limit: int) -> np.ndarray:
        """Steps below ``limit`` (at least) with a priority in the lowest 2**-level."""
        if self._known < limit:
            self._known = max(limit, 2 * self._known, 1 << 16)
            u, at = self._priority(np.arange(self._known)), np.arange(self._known)
            self._levels = [at]
            while len(at) > self.samples:
                at = at[u[at] < np.uint64(2 ** (64 - len(self._levels)))]
                self._levels.append(at)
        return self._levels[min(level, len(self._levels) - 1)]

    def steps_of(self, n: int) -> np.ndarray:
        """The sampled steps of a text of ``n`` characters, ascending."""
        if n not in self._steps:
            if len(self._steps) >= KNOWN_LENGTHS:
                self._steps.clear()
            self._steps[n] = self._find_steps(2 * n)
        return self._steps[n]

    def _find_steps(self, length: int) -> np.ndarray:
        if length <= self.samples:
            return np.arange(length)
        level = max(0, (length // (2 * self.samples)).bit_length() - 1)
        while True:
            near = self._level(level, length)
            near = near[: np.searchsorted(near, length)]
            if len(near) >= self.samples or not level:
                return np.sort(near[np.argpartition(self._priority(near), self.samples - 1)[: self.samples]])
            level -= 1

    def walk(self, texts: list[str], scales: list[int] | None = None) -> list[bytes]:
        """The sampled characters' bytes of each text, ``samples`` long (shorter texts: padded with zeros).

        scales: lengths to choose the steps by, in place of the texts' own.
        """
        scales = scales or [len(t) for t in texts]
        out: list[bytes] = [b""] * len(texts)
        group: list[int] = []
        held = 0
        for i, text in enumerate(texts):
            group.append(i)
            held += len(text)
            if held >= GROUP_CHARS or len(group) >= GROUP_TEXTS or i + 1 == len(texts):
                self._walk_group(texts, scales, group, out)
                group, held = [], 0
        return out

    def _walk_group(self, texts: list[str], scales: list[int], group: list[int], out: list[bytes]) -> None:
        group = sorted(group, key=lambda i: len(texts[i]))
        sizes = np.array([len(texts[i]) for i in group], np.int64)
        ends = np.cumsum(sizes + 1) - 1
        begins = ends - sizes
        # every text is followed by one line feed, overwritten below by class 64: all coins there are 0 and the walk stays
        points = np.frombuffer("\n".join([*(texts[i] for i in group), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        mixed = (points * np.uint32(0x9E3779B1)) >> np.uint32(8)
        kinds = (mixed & np.uint32(63)).astype(np.uint8)
        marks = (1 + (mixed >> np.uint32(6)) % np.uint32(255)).astype(np.uint8)
        kinds[ends], marks[ends] = 64, 0
        wanted = [self.steps_of(scales[i]) for i in group]
        counts = np.array([len(w) for w in wanted])
        found = np.zeros((len(group), self.samples), np.uint8)
        slot = np.repeat(np.arange(len(group)), counts)
        step = np.concatenate(wanted) if len(wanted) else np.empty(0, np.int64)
        column = np.arange(len(step)) - np.repeat(np.cumsum(counts) - counts, counts)
        order = np.argsort(step, kind="stable")
        slot, step, column = slot[order], step[order], column[order]
        classes = np.arange(65, dtype=np.uint64)
        first = int(np.searchsorted(sizes, 1))  # the running walks are those from here on, as texts lie by length
        at = begins[first:].copy()
        base, done = 0, 0
        path = np.empty((STEPS, len(at)), np.int64)
        while len(at) > FEW and done < len(step):
            coins = self.coins(base + STEPS)
            turn = ((coins[base : base + STEPS, None] >> classes) & np.uint64(1)).astype(np.int64)
            turn[:, 64] = 0
            rows = path[:, : len(at)]
            for t in range(STEPS):
                rows[t] = at
                at += turn[t].take(kinds.take(at))
            upto = int(np.searchsorted(step, base + STEPS))
            s = slot[done:upto]
            live = s >= first
            s, j, c = s[live], step[done:upto][live], column[done:upto][live]
            found[s, c] = marks[rows[j - base, s - first]]
            base, done = base + STEPS, upto
            more = int(np.argmax(at < ends[first:])) if (at < ends[first:]).any() else len(at)
            first, at = first + more, at[more:].copy()
        coins_list: list[int] | None = None
        for k in range(first, len(group)):
            if coins_list is None:
                last = int(step[-1]) + 1 if len(step) else 0
                coins_list = self.coins(last)[:last].tolist()
            kind = kinds[begins[k] : ends[k] + 1].tobytes()
            i, j = int(at[k - first] - begins[k]), base
            size, row = int(sizes[k]), found[k]
            steps = wanted[k]
            mark = marks[begins[k] : ends[k] + 1]
            for c in range(int(np.searchsorted(steps, base)), len(steps)):
                until = int(steps[c])
                for word in coins_list[j:until]:
                    i += (word >> kind[i]) & 1
                j = until
                if i >= size:
                    break
                row[c] = mark[i]
        for k, i in enumerate(group):
            out[i] = found[k].tobytes()

    def likeness(self, n: int, a: bytes, m: int, b: bytes) -> float:
        """Share of sampled steps at which both walks read the same character: 1 for equal texts, also empty ones."""
        if n == m and a == b:
            return 1.0
        if not n or not m:
            return 0.0
        x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
        most = max(np.count_nonzero(x), np.count_nonzero(y))
        if n == m:
            return float(np.count_nonzero((x == y) & (x != 0)) / most)
        s, t = self.steps_of(n), self.steps_of(m)
        where = np.minimum(np.searchsorted(t, s), len(t) - 1)
        both = t[where] == s
        return float(np.count_nonzero(both & (x[: len(s)] == y[where]) & (x[: len(s)] != 0)) / most)


@lru_cache(2)
def _tool(samples: int, seed: int) -> EditEmbedding:
    """One for each worker process, whose coins and steps last over its tasks."""
    return EditEmbedding(samples, seed)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def as_string(n: int, marks: bytes) -> str:
    return f"{n:08x}{marks.hex()}"


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(id, n_chars, fingerprint) of every row, whole texts; null texts count as empty, whose fingerprint is all zeros.

    Repeated rows give repeated rows; other columns are not carried. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _tool(samples, SEED)
        for batch in _slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            prints = [as_string(len(t), m) for t, m in zip(texts, tool.walk(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(prints, pa.string())], names=[id_col, "n_chars", "fingerprint"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_chars long, fingerprint string")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 20, bands: int = 24, band_samples: int = 6) -> DataFrame:
    """(a, b, edits): links between rows whose texts are within ``max_edits`` edits, verified by the edit distance itself.

    Candidates share a band: ``band_samples`` steps sampled below the length rounded down to a power of 1.25, hashed.
    A text within ``max_edits`` of a step of that scale joins both scales, so neighbours across it meet. Within a band
    nothing is lost: a search tree over its texts gives links that join exactly what all its pairs within ``max_edits``
    join, at most one link for each row and chunk, not every pair. Bands are samples, so a pair of many edits for its length may
    share none (README: measured recall). A text is shuffled once for each band that it shares. Equal texts become one
    class first and link to its smallest id with 0 edits. Null and empty texts are one class; rows with a null id have
    no links; an empty table gives no links.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("id is not null")
    classed = rows.select("id", F.sha2("text", 256).alias("h"), "text")
    heads = classed.groupBy("h").agg(F.min("id").alias("head"), F.first("text").alias("text"))
    copies = classed.join(heads.select("h", "head"), "h").filter("id != head").select(F.col("head").alias("a"), F.col("id").alias("b"), F.lit(0).alias("edits")).distinct()

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _tool(bands * band_samples, SEED + 1)
        for batch in _slices(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            todo = []
            for i, text in zip(ids, texts):
                scales = {_scale(max(1, len(text) - max_edits)), _scale(len(text)), _scale(len(text) + max_edits)}
                todo += [(i, s, text) for s in scales]
            keys, owners, sizes = [], [], []
            for (i, scale, text), marks in zip(todo, tool.walk([t for *_, t in todo], [s for _, s, _ in todo])):
                for k in range(bands):
                    owners.append(i)
                    keys.append(sha256_hex(b"%d:%d:" % (scale, k) + marks[k::bands]))
                    sizes.append(len(text))
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(keys, pa.string()), pa.array(sizes, pa.int64())], names=["id", "band", "size"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, texts = None, [], []

        def solve() -> pa.RecordBatch:
            found = _tree(ids, texts, max_edits)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found) if found else [[]] * 3, [pa.int64(), pa.int64(), pa.int32()])], names=["a", "b", "edits"])

        for batch in _slices(batches):
            for band, lo, hi, i, text in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if (band, lo, hi) != group:
                    if len(ids) > 1:
                        yield solve()
                    group, ids, texts = (band, lo, hi), [], []
                ids.append(i)
                texts.append(text)
        if len(ids) > 1:
            yield solve()

    sides = heads.select(F.col("head").cast("long").alias("id"), "text")
    banded = sides.mapInArrow(band, "id long, band string, size long")
    shared = banded.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("chars")).filter("n > 1")
    chunks = F.greatest(F.ceil(F.col("n") / BAND_ROWS), F.ceil(F.col("chars") / BAND_CHARS)).cast("int")
    met = banded.join(shared.select("band", chunks.alias("chunks")), "band")
    own = met.select("band", "id", "chunks", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("c"))
    spread = own.select("band", "id", "c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("d")).select("band", F.least("c", "d").alias("lo"), F.greatest("c", "d").alias("hi"), "id")
    dealt = spread.join(sides, "id").select("band", "lo", "hi", "id", "text").repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "id")
    near = dealt.mapInArrow(verify, "a long, b long, edits int").distinct()
    return near.unionByName(copies.select(F.col("a").cast("long"), F.col("b").cast("long"), "edits"))


def _edits(x: str, y: str, most: int) -> int:
    """Edit distance, -1 if over ``most``: by the furthest point on each diagonal for each number of edits."""
    n, m = len(x), len(y)
    end = m - n
    if abs(end) > most:
        return -1

    def run(i: int, j: int) -> int:  # where x[i:] and y[j:] part, by doubling and halving steps
        left, step = min(n - i, m - j), 1
        while step <= left and x[i : i + step] == y[j : j + step]:
            i, j, left, step = i + step, j + step, left - step, 2 * step
        while step > 1:
            step //= 2
            if step <= left and x[i : i + step] == y[j : j + step]:
                i, j, left = i + step, j + step, left - step
        return i

    reach: dict[int, int] = {}
    for e in range(most + 1):
        new = {}
        for d in range(max(-e, end - (most - e)), min(e, end + most - e) + 1):
            i = max(reach.get(d, -2) + 1, reach.get(d - 1, -2), reach.get(d + 1, -2) + 1) if e else 0
            i = min(i, n, m - d)
            if i >= 0 and i + d >= 0:
                new[d] = run(i, i + d)
        if new.get(end) == n:
            return e
        reach = new
    return -1


def _tree(ids: list[int], texts: list[str], most: int) -> list[tuple[int, int, int]]:
    """(a, b, edits): links that join what is within ``most`` edits: a search tree of each component.

    An edit changes the counts of at most two classes of characters by one, so counts further apart spare the comparison.
    """
    counts = np.array([np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) % CLASSES, minlength=CLASSES) for t in texts], np.int32)
    left, links = np.arange(len(ids)), []
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        for f in front:  # grows by what is found
            if not len(left):
                break
            differ = counts[left] - counts[f]
            likely = np.flatnonzero((np.abs(differ).sum(axis=1) <= 2 * most) & (np.abs(differ.sum(axis=1)) <= most))
            got = []
            for k in likely.tolist():
                to = int(left[k])
                edits = _edits(texts[f], texts[to], most)
                if edits >= 0:
                    links.append((min(ids[f], ids[to]), max(ids[f], ids[to]), edits))
                    front.append(to)
                    got.append(k)
            left = np.delete(left, got)
    return links


def _scale(n: int) -> int:
    k = 0
    while int(1.25 ** (k + 1)) <= n:
        k += 1
    return int(1.25**k)


def with_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness (see the result's columns below).

    A row's edited text ends in the head of the next row's, by ascending id (ties: by text; null ids first). Rows are
    dealt by ranges of ids, texts moving once. The first row of each range goes to the range before it as well, as the
    successor of that one's last row; so no task needs more than its own range, and the ranges' first ids are all that
    the driver sees. One row alone is its own successor; an empty table gives an empty result.
    """
    spark = df.sparkSession
    cuts = id_cuts(df, id_col, partitions(spark))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    placed = rows.withColumn("bucket", bucket_of("id", cuts))
    firsts = {r["bucket"]: r["first"] for r in placed.groupBy("bucket").agg(F.min(F.struct(F.col("id").isNotNull().alias("there"), F.col("id").alias("id")))["id"].alias("first")).collect()}
    ring = sorted(firsts)
    number = F.col("bucket").cast("int")
    first_id = F.get(F.array(*[F.lit(firsts.get(b)).cast("long") for b in range(max(ring, default=0) + 1)]), number)
    before = {b: ring[k - 1] for k, b in enumerate(ring)}
    before_it = F.get(F.array(*[F.lit(before.get(b)).cast("int") for b in range(max(ring, default=0) + 1)]), number)
    home = F.struct(number.alias("bucket"), F.lit(False).alias("successor"))
    also = F.struct(before_it.alias("bucket"), F.lit(True).alias("successor"))
    spread = placed.select("id", "text", F.inline(F.when(F.col("id").eqNullSafe(first_id), F.array(home, also)).otherwise(F.array(home))).alias("bucket", "successor"))
    dealt = spread.repartitionById(max(ring, default=0) + 1, F.col("bucket")).sortWithinPartitions("bucket", "successor", F.col("id").asc_nulls_first(), "text")
    columns = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _tool(SAMPLES, SEED)
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            pairs = [(a, b) for a, b in zip(held, held[1:]) if a[2] == b[2] and not a[3]]
            edited = []
            for a, b in pairs:
                cut = len(a[1]) // 4
                edited.append(a[1][: len(a[1]) - cut] + b[1][:cut])
            texts = list({x[1]: None for x in held})
            walks = dict(zip(texts, tool.walk(texts)))
            out = []
            for (a, b), e, w in zip(pairs, edited, tool.walk(edited)):
                n, x = len(a[1]), walks[a[1]]
                out.append((a[0], n, sha256_hex(e), as_string(n, x), as_string(len(e), w), tool.likeness(n, x, len(e), w), tool.likeness(n, x, len(b[1]), walks[b[1]])))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 7, types)], names=[id_col, *columns])

        for batch in _slices(batches):
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                held.append(row)
                size += len(row[1])
                if size >= GROUP_CHARS or len(held) > GROUP_TEXTS:
                    yield flush()
                    held, size = [row], len(row[1])
        if held:
            yield flush()

    return dealt.select("id", "text", "bucket", "successor").mapInArrow(run, f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
