"""Tables kept as parts in one folder: a change writes what it changes, and a manifest names what counts.

A part takes keys out of the parts before it and adds rows of its own. So an incremental build costs what it touches, and
reading costs an anti-join with the keys that later parts took out; after some parts a table is written as one again.
Rows dealt into buckets by a key are read by the buckets that a set of keys needs. Whoever writes leaves a mark first and
takes it away when the manifest names the files; files of marked writers are not for the vacuum.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
#: A table of more parts is written as one.
PARTS = 8
#: Marks older than this are those of writers that died.
ABANDONED_S = 7 * 86_400


def bucket(key: Column | str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def part(rows: str | list[str] | None, gone: str | None = None) -> dict[str, Any]:
    """rows: the folder of the part's rows; gone: the folder of the keys that it takes out of the parts before it."""
    return {"rows": rows, "gone": gone}


class Folder:
    """Writes and reads frames below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._writer: str | None = None

    @contextmanager
    def writing(self) -> Iterator[None]:
        """Files saved within are safe from :meth:`vacuum` until this ends, when the manifest should name them."""
        if self._writer:
            yield
            return
        self._writer = uuid.uuid4().hex
        mark = self._hadoop.Path(f"{self.root}/marks/{self._writer}")
        self._fs.create(mark, False).close()
        try:
            yield
        finally:
            self._writer = None
            self._fs.delete(mark, False)

    def save(self, df: DataFrame, what: str, by: list[str] | None = None, root: str | None = None) -> str:
        """The folder of a frame written as Parquet; by: columns that it is partitioned by, of which ``bucket`` spreads the work."""
        path = f"{root or self.root}/data/{what}-{self._writer or 'x'}-{uuid.uuid4().hex}"
        writer = (df.hint("rebalance", *by) if by else df).write
        (writer.partitionBy(*by) if by else writer).parquet(path)
        return path

    def frame(self, paths: str | list[str] | None, schema: str) -> DataFrame:
        paths = [paths] if isinstance(paths, str) else paths
        if not paths:
            return self.spark.createDataFrame([], schema)
        if "bucket int" not in schema:
            return self.spark.read.schema(schema).parquet(*paths)
        found = [self.spark.read.schema(schema).parquet(p) for p in paths]  # partitioned folders are roots of their own
        return reduce(DataFrame.unionByName, found)

    def kept(self, df: DataFrame, what: str) -> DataFrame:
        """The frame computed once, read back."""
        return self.spark.read.schema(df.schema).parquet(self.save(df, what))

    def read(self, parts: list[dict[str, Any]], schema: str, key: str, key_type: str = "string", within: list[int] | None = None) -> DataFrame:
        """A table's rows; within: only these of its buckets."""
        found: list[DataFrame] = []
        later: DataFrame | None = None
        group: list[str] = []

        def close() -> None:
            if group:
                df = self.frame(list(group), schema)
                df = df if within is None else df.filter(F.col("bucket").isin(within))
                found.append(df if later is None else df.join(later, key, "left_anti").select(df.columns))
                group.clear()

        for p in reversed(parts):
            if p["rows"]:
                group += p["rows"] if isinstance(p["rows"], list) else [p["rows"]]
            if p["gone"]:
                close()
                keys = self.frame(p["gone"], f"`{key}` {key_type}")
                later = keys if later is None else later.unionByName(keys)
        close()
        if not found:
            return self.frame(None, schema)
        return reduce(DataFrame.unionByName, found)

    def buckets_of(self, keys: DataFrame, key: str) -> list[int]:
        """The buckets that some keys lie in: at most BUCKETS numbers."""
        return sorted(r[0] for r in keys.select(bucket(key)).distinct().collect())

    def vacuum(self, named: Callable[[], str], abandoned_s: float = ABANDONED_S) -> list[str]:
        """Delete what ``named()`` does not name. Files are listed first, then marks, then the names; so a file's writer has its mark still, or has committed."""
        data, marks = self._names("data"), self._names("marks")
        text = named()
        running = [m for m, age in marks.items() if age < abandoned_s]
        gone = [n for n in data if n not in text and not any(m in n for m in running)]
        for n in gone:
            self._fs.delete(self._hadoop.Path(f"{self.root}/data/{n}"), True)
        for m, age in marks.items():
            if age >= abandoned_s:
                self._fs.delete(self._hadoop.Path(f"{self.root}/marks/{m}"), False)
        return gone

    def _names(self, folder: str) -> dict[str, float]:
        path = self._hadoop.Path(f"{self.root}/{folder}")
        now = time.time()
        return {s.getPath().getName(): now - s.getModificationTime() / 1000 for s in self._fs.listStatus(path)} if self._fs.exists(path) else {}
