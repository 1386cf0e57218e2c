"""Versioned JSON manifests with atomic commits, on any file system that Spark reaches."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession

from chronofold.errors import ConflictError, StorageError


class ManifestStore:
    """Versions ``v000000000001.json``, ... below a folder. A version, once there, never changes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        self._fs.mkdirs(self._path(""))

    def _path(self, name: str) -> Any:
        return self._hadoop.Path(f"{self.folder}/{name}" if name else self.folder)

    def versions(self) -> list[int]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path("")))
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def read(self, version: int | None = None) -> tuple[int, dict[str, Any]]:
        """(version, content), by default of the newest; (0, {}) if there is none."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if not version:
            return 0, {}
        stream = self._fs.open(self._path(f"v{version:012d}.json"))
        try:
            return version, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, base: int, content: dict[str, Any]) -> int:
        """Make ``content`` the version after ``base``; ConflictError if another writer was first."""
        made = self._path(f".{uuid.uuid4().hex}")
        out = self._fs.create(made, False)
        out.write(bytearray(json.dumps(content, default=str).encode()))
        out.close()
        final = self._path(f"v{base + 1:012d}.json")
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf)
        nothing = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(context.makeQualified(made), context.makeQualified(final), nothing)
        except Exception as error:
            self._fs.delete(made, False)
            if "FileAlreadyExists" in str(error):
                raise ConflictError(f"version {base + 1} of {self.folder} is there already") from error
            raise StorageError(f"version {base + 1} of {self.folder} could not be written") from error
        return base + 1
