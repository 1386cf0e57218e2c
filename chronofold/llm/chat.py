"""Chat formatting on the level of tokens.

A conversation is ``<s>`` and then, for each turn, ``[INST]role[/INST]text</s>``. The control strings are reserved ids
that are spliced between the separately encoded roles and texts, so no text can yield one. Control strings inside roles
and texts are escaped as well: a backslash is put behind their first character, one more where there are some already;
hence the formatted text can be parsed back without the ids, too. The loss mask covers the texts of assistants: +1 where
one begins, -1 where it ends, summed up along the ids.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.bpe import ByteBPE, _vocabulary
from chronofold.llm.common import partitions

#: The control strings, in the order of their reserved ids.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]"]
BEGIN, END, ROLE, TEXT = range(4)
#: A part of a conversation ends with the turn in which it reaches this many ids.
PART_IDS = 1_000_000
_ESCAPE = re.compile(r"(<)(\\*)(/?s>)|(\[)(\\*)(/?INST\])")
_UNESCAPE = re.compile(r"(<)\\(\\*)(/?s>)|(\[)\\(\\*)(/?INST\])")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: f"{m[1] or m[4]}\\{m[2] or m[5] or ''}{m[3] or m[6]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: f"{m[1] or m[4]}{m[2] or m[5] or ''}{m[3] or m[6]}", text)


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(conv_id, part, n_turns, ids array<int>, loss_mask array<boolean>): each conversation's turns by turn number.

    Rows are encoded where they are; packed ids move to their conversation's task once, which reads them in order and
    holds one part at a time, so a conversation of any length fits. Ties in the turn number: by role, then text;
    repeated rows stay. Null roles and texts are empty; null turn numbers come first; rows with a null id are one
    conversation. An empty table gives an empty result; other columns are not carried.
    """
    path = _vocabulary(vocabulary)
    kind = df.schema[conv_col].dataType.simpleString()
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = ByteBPE(path)
        for batch in batches:
            packed = [
                pa.array([x.astype(np.uint32).tobytes() for x in tool.encode_many([escape(t) for t in batch.column(k).to_pylist()])], pa.binary()) for k in (2, 3)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *packed], names=["conv_id", "turn", "role", "role_ids", "text_ids"])

    encoded = rows.mapInArrow(encode, f"conv_id {kind}, turn long, role string, role_ids binary, text_ids binary")
    dealt = encoded.repartition(partitions(df.sparkSession), "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text_ids")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = len(ByteBPE(path).tokens) + 1  # one id stays free for the end of a document
        control = [np.array([base + k], np.uint32) for k in range(len(CONTROLS))]
        rows = (row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(5))))
        ready: list[tuple] = []
        held = 0
        for conv, turns in groupby(rows, key=lambda r: r[0]):
            pieces, marks, at, n, part = [control[BEGIN]], [], 1, 0, 0
            for _, _, role, role_ids, text_ids in turns:
                head, text = np.frombuffer(role_ids, np.uint32), np.frombuffer(text_ids, np.uint32)
                if at >= PART_IDS:
                    ready.append((conv, part, n, *_finish(pieces, marks, at)))
                    held += at
                    pieces, marks, at, n, part = [], [], 0, 0, part + 1
                pieces += [control[ROLE], head, control[TEXT], text, control[END]]
                if role == "assistant":
                    marks.append((at + len(head) + 2, len(text)))
                at += len(head) + len(text) + 3
                n += 1
                if held >= PART_IDS:
                    yield _batch(ready, kind)
                    ready, held = [], 0
            ready.append((conv, part, n, *_finish(pieces, marks, at)))
            held += at
        yield _batch(ready, kind)

    return dealt.mapInArrow(assemble, f"conv_id {kind}, part int, n_turns long, ids array<int>, loss_mask array<boolean>").withColumnRenamed("conv_id", conv_col)


def _finish(pieces: list[np.ndarray], marks: list[tuple[int, int]], size: int) -> tuple[np.ndarray, np.ndarray]:
    steps = np.zeros(size + 1, np.int8)
    for start, n in marks:
        steps[start] += 1
        steps[start + n] -= 1
    return np.concatenate(pieces).astype(np.int32), np.cumsum(steps[:-1]) > 0


def _batch(ready: list[tuple], kind: str) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    columns = [[r[k] for r in ready] for k in range(5)]
    kinds = [to_arrow_type(_parse_datatype_string(kind)) if kind != "bigint" else pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.bool_())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "part", "n_turns", "ids", "loss_mask"])


def read_back(formatted: DataFrame, conv_col: str = "conv_id", vocabulary: str | None = None, in_order: bool = False) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the ids and the mask alone.

    in_order: a conversation's parts follow each other already (as :func:`format_conversations` hands them out).
    """
    path = _vocabulary(vocabulary)
    kind = formatted.schema[conv_col].dataType.simpleString()
    rows = formatted.select(F.col(conv_col).alias("conv_id"), "part", "ids", "loss_mask")
    if not in_order:
        rows = rows.repartition(partitions(formatted.sparkSession), "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type
        from pyspark.sql.types import _parse_datatype_string

        tool = ByteBPE(path)
        base = len(tool.tokens) + 1
        id_type = pa.int64() if kind == "bigint" else to_arrow_type(_parse_datatype_string(kind))
        text_of = lambda ids: tool.decode(ids).decode("utf-8", "surrogatepass")
        parts = ((batch.column(0)[i].as_py(), batch.column(2)[i].values.to_numpy(), batch.column(3)[i].values.to_numpy(zero_copy_only=False)) for batch in batches for i in range(batch.num_rows))
        out: list[tuple] = []
        for conv, group in groupby(parts, key=lambda p: p[0]):
            turns, loss, n_turns, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, ids, mask in group:
                spots = np.flatnonzero(ids >= base)
                chars += sum(len(CONTROLS[ids[s] - base]) for s in spots)
                ends = [*spots.tolist(), len(ids)]
                segments = [(int(ids[a]) - base, text_of(ids[a + 1 : b])) for a, b in zip(ends, ends[1:])]
                for (kind_of, text), a in zip(segments, ends):
                    chars += len(text)
                    plain = unescape(text)
                    if kind_of == ROLE:
                        turns.update(f"{plain}\n".encode("utf-8", "surrogatepass"))
                    elif kind_of == TEXT:
                        turns.update(f"{plain}\n".encode("utf-8", "surrogatepass"))
                        n_turns += 1
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                    plain = unescape(text_of(ids[a:b]))
                    loss.update(plain.encode("utf-8", "surrogatepass"))
                    loss_chars += len(plain)
            out.append((conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) >= 5000:
                yield _digests(out, id_type)
                out = []
        yield _digests(out, id_type)

    fields = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.mapInArrow(run, fields).withColumnRenamed("conv_id", conv_col)


def _digests(out: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)
