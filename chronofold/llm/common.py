"""Pieces that several operators share."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of one batch handed on at once, in characters: bounds the memory of a Python worker.
BATCH_CHARS = 8_000_000


def sha256_hex(data: bytes | str) -> str:
    return hashlib.sha256(data.encode("utf-8", "surrogatepass") if isinstance(data, str) else data).hexdigest()


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, other letters as they are. Texts that are all ASCII take the faster built-in."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def per_text(df: DataFrame, id_col: str, text_col: str, make: Callable[[], Callable[[str], tuple]], fields: str) -> DataFrame:
    """One row per input row: the id and what ``make()(text)`` returns (null text: empty), in Arrow batches.

    ``make`` runs once per task, so models and caches load once. Other columns of ``df`` are not carried, hence names
    cannot clash. Output rows keep the input's partitioning; nothing is shuffled.
    """
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {fields}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            start, rows, held = 0, [], 0
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                rows.append(work(text))
                held += len(text)
                if held >= BATCH_CHARS or i + 1 == batch.num_rows:
                    columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), types)]
                    yield pa.RecordBatch.from_arrays([ids.slice(start, i + 1 - start), *columns], names=names)
                    start, rows, held = i + 1, [], 0

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    parsed = StructType.fromDDL(schema)
    names, types = parsed.names, [to_arrow_type(f.dataType) for f in parsed.fields[1:]]
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, parsed)


def id_cuts(df: DataFrame, id_col: str, n: int) -> list[int]:
    """Where to cut the ids into up to ``n`` ranges of about as many rows each (ascending; fewer where ids repeat).

    Only ids are read, and the driver gets at most ``n`` numbers.
    """
    if n < 2:
        return []
    found = df.agg(F.percentile_approx(id_col, [i / n for i in range(1, n)], 10 * n).alias("q")).first()["q"]
    return sorted(set(found or []))


def bucket_of(id_col: str, cuts: list[int]) -> Column:
    """Index of an id's range: the number of cuts not above it (null: 0). Two looks at about sqrt(n) literals each."""
    if not cuts:
        return F.lit(0)
    width = math.isqrt(len(cuts)) + 1
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    row = lambda xs: F.array(*[F.lit(int(x)).cast("long") for x in xs])
    below = lambda marks: F.coalesce(F.size(F.filter(marks, lambda m: m <= F.col(id_col))), F.lit(0))
    full = below(row([g[-1] for g in groups]))
    return F.when(F.col(id_col).isNull(), 0).otherwise(full * width + F.coalesce(below(F.get(F.array(*map(row, groups)), full)), F.lit(0)))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
