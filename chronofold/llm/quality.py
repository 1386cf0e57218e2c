"""A quality classifier: factorisation machine over hashed words, structure statistics and metadata.

A text is a sparse vector. The score is the logistic function of a bias, a weight for each feature, and for each pair of
features the product of their low-rank vectors, summed in linear time by the identity
``sum_{i<j} <v_i,v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``.
"""

from __future__ import annotations

import itertools
import math
import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed words and word shapes share so many features; those of structure and metadata follow.
BUCKETS = 1 << 16
RANK = 8
#: The model is fitted on a sample of at most so many labelled rows, chosen by the hash of their id.
SAMPLE_ROWS = 6_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
EPOCHS = 4
#: Words whose features a worker keeps at most; then it starts afresh.
CACHE_WORDS = 200_000
#: Texts of an Arrow batch that a worker holds as Python strings at once.
SLICE_ROWS = 500
_SHAPES = [(re.compile(r"[^\W\d_]*[a-zß-öø-ÿ][^\W\d_]*"), "a"), (re.compile(r"[^\W\d_]+"), "A"), (re.compile(r"\d+"), "9")]
STATISTICS = [
    "length", "lines", "mean_word", "long_words", "short_words", "distinct", "repeated_next", "repeated_lines", "upper", "digits", "marks", "other", "blank",
    "capitalised", "shouted", "marked_words", "bare_marks", "bullets", "ends_sentence", "commonest", "letters_per_word_spread",
]


def _shape(word: str) -> str:
    for pattern, letter in _SHAPES:
        word = pattern.sub(letter, word)
    return word[:12]


#: What is kept of each word: two hashed features, and numbers that a text's statistics are sums of.
_SUMS = ["one", "length", "square", "upper", "digits", "letters", "shouted", "capitalised", "marked", "bare", "long", "short"]


class _Words(dict):
    """Places of words in tables of their features and numbers, each worked out when a word is met first."""

    def __init__(self) -> None:
        self.hashed = np.zeros((1024, 2), np.int64)
        self.sums = np.zeros((1024, len(_SUMS)))

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.hashed):
            self.hashed, self.sums = (np.concatenate([t, np.zeros_like(t)]) for t in (self.hashed, self.sums))
        shape, n = _shape(word), len(word)
        self.hashed[at] = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % BUCKETS, zlib.crc32(b"shape:" + shape.encode("utf-8", "surrogatepass")) % BUCKETS
        letters = [(x.isupper(), x.isdigit(), x.isalpha(), x.isalnum()) for x in word]
        upper, digits, alpha, either = (sum(kind) for kind in zip(*letters))
        self.sums[at] = 1, n, n * n, upper, digits, alpha, word.isupper() and n > 1, word.istitle(), n > 2 and not letters[-1][3] and not letters[-2][3], not either, n > 12, n < 4
        self[word] = at
        return at


class Features:
    """Sparse features of whole texts; metadata is what the text itself tells (its size), never its labels, language or source."""

    def __init__(self) -> None:
        self.words = _Words()

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(indices, values), indices ascending and distinct. An empty text has statistics only."""
        listed = text.split()
        counts = Counter(listed)
        if len(self.words) + len(counts) > CACHE_WORDS:
            self.words = _Words()
        at = np.fromiter(map(self.words.__getitem__, counts), np.int64, len(counts))
        n = np.fromiter(counts.values(), np.float64, len(counts))
        index, back = np.unique(self.words.hashed[at], return_inverse=True)
        value = np.log1p(np.bincount(back.ravel(), np.repeat(n, 2), len(index)))
        value /= max(1e-9, math.sqrt(float(value @ value)))
        stats = np.array(self._statistics(text, listed, dict(zip(_SUMS, (n @ self.words.sums[at]).tolist())), len(counts), float(n.max(initial=0))))
        return np.concatenate([index, BUCKETS + np.arange(len(stats))]).astype(np.int32), np.concatenate([value, stats]).astype(np.float32)

    @staticmethod
    def _statistics(text: str, words: list[str], sums: dict[str, float], distinct: int, commonest: float) -> list[float]:
        n, w = max(1, len(text)), max(1, len(words))
        lines = text.split("\n")
        total, mean = sums["length"], sums["length"] / w
        again = sum(map(operator.eq, words, itertools.islice(words, 1, None)))
        return [
            min(1.0, math.log1p(n) / 14), min(1.0, math.log1p(len(lines)) / 10), min(1.0, mean / 20), sums["long"] / w, sums["short"] / w, distinct / w, again / w, 1 - len(set(lines)) / len(lines),
            sums["upper"] / n, sums["digits"] / n, (total - sums["letters"] - sums["digits"]) / n, max(0, n - total - text.count(" ") - text.count("\n")) / n, (n - total) / n,
            sums["capitalised"] / w, sums["shouted"] / w, sums["marked"] / w, sums["bare"] / w,
            sum(x[:1] in "-*•" for x in lines if x) / len(lines), sum(x[-1:] in ".!?" for x in lines if x) / len(lines), commonest / w,
            min(1.0, math.sqrt(max(0.0, sums["square"] / w - mean * mean)) / 10),
        ]


@dataclass
class FactorisationMachine:
    bias: float
    weight: np.ndarray
    vectors: np.ndarray

    def raw(self, index: np.ndarray, value: np.ndarray) -> float:
        v = self.vectors[index] * value[:, None]
        return float(self.bias + self.weight[index] @ value + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum()))

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.raw(index, value)))))

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, rank: int = RANK, epochs: int = EPOCHS, rate: float = 0.03, decay: float = 2e-4, seed: int = 7) -> FactorisationMachine:
        """Log loss by AdaGrad over shuffled small batches. Without rows of both labels the bias alone is fitted."""
        draw = np.random.default_rng(seed)
        share = (labels.sum() + 1) / (len(labels) + 2)
        model = cls(float(np.log(share / (1 - share))), np.zeros(size), draw.normal(0, 0.01, (size, rank)))
        if len(set(labels.tolist())) < 2:
            return model
        g_b, g_w, g_v = 1e-8, np.full(size, 1e-8), np.full((size, rank), 1e-8)
        for _ in range(epochs):
            order = draw.permutation(len(rows))
            for a in range(0, len(order), 32):
                own = order[a : a + 32]
                index = np.concatenate([rows[i][0] for i in own])
                value = np.concatenate([rows[i][1] for i in own]).astype(np.float64)
                edge = np.cumsum([0] + [len(rows[i][0]) for i in own])
                v = model.vectors[index]
                xv = v * value[:, None]
                total = np.add.reduceat(xv, edge[:-1], axis=0)
                raw = model.bias + np.add.reduceat(model.weight[index] * value, edge[:-1]) + 0.5 * ((total**2).sum(axis=1) - np.add.reduceat((xv**2).sum(axis=1), edge[:-1]))
                error = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[own]
                each = np.repeat(error / len(own), np.diff(edge))
                spread = np.repeat(total, np.diff(edge), axis=0)
                d_w, d_v = each * value, each[:, None] * (value[:, None] * spread - xv * value[:, None])
                used, back = np.unique(index, return_inverse=True)
                s_w, s_v = np.bincount(back, d_w, len(used)), np.zeros((len(used), rank))
                np.add.at(s_v, back, d_v)
                s_w += decay * model.weight[used]
                s_v += decay * model.vectors[used]
                g_w[used] += s_w**2
                g_v[used] += s_v**2
                model.weight[used] -= rate * s_w / np.sqrt(g_w[used])
                model.vectors[used] -= rate * s_v / np.sqrt(g_v[used])
                s_b = float(error.mean())
                g_b += s_b * s_b
                model.bias -= rate * s_b / math.sqrt(g_b)
        return model


def fold(id_col: str) -> Column:
    """The remainder of crc32(id as text); null ids: -1, so they neither train nor are held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)), F.lit(-1)).cast("int")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_ROWS) -> FactorisationMachine:
    """Fit on at most ``sample`` labelled rows out of the folds that may train, by the smallest hashes of their ids.

    Features are taken where the texts are; the driver gets the sample's sparse vectors, one for each id: of repeated ids
    the least text counts, and the greatest label. Rows without a label, and labels without a row, count for nothing.
    Without labelled rows the model scores every text 1/2.
    """
    chosen = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(id_col) != HELD_OUT))
        .select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
        .groupBy("id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Features()
        for batch in batches:
            pairs = [tool(t or "") for t in batch.column(1).to_pylist()]
            arrays = [batch.column(0), batch.column(2), *(pa.array([p[k].tobytes() for p in pairs], pa.binary()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "y", "index", "value"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    told = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text")).select("id", "text", "y")
    rows = sorted(told.mapInArrow(run, f"id {kind}, y int, index binary, value binary").collect(), key=lambda r: (r["id"], bytes(r["index"]), bytes(r["value"])))
    vectors = [(np.frombuffer(r["index"], np.int32), np.frombuffer(r["value"], np.float32)) for r in rows]
    return FactorisationMachine.fit(vectors, np.array([float(r["y"] > 0) for r in rows]), BUCKETS + len(STATISTICS))


def score(docs: DataFrame, model: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every whole text; null texts are empty, and empty ones get a score as well.

    Repeated rows give repeated rows; other columns are not carried. No shuffle; the model (a few MB, its size is fixed
    by BUCKETS and RANK) goes to each executor once.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.weight.astype(np.float32), model.vectors.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tool = FactorisationMachine(*sent.value), Features()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                scores = [own.score(*tool(t or "")) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], names=["id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), (fold(id_col) == HELD_OUT).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``docs``, all columns, without the rows that score below the threshold."""
    model = train(docs, labels, id_col, text_col, label_col)
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.weight.astype(np.float32), model.vectors.astype(np.float32)))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tool = FactorisationMachine(*sent.value), Features()
        for batch in batches:
            passed: list[bool] = []
            for start in range(0, batch.num_rows, SLICE_ROWS):
                passed += [own.score(*tool(t or "")) >= THRESHOLD for t in batch.column(at).slice(start, SLICE_ROWS).to_pylist()]
            yield batch.filter(pa.array(passed, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
