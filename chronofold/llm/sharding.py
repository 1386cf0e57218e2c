"""Size-tiered compaction of immutable shards under a versioned manifest; DataFrame writers and the file system only.

Arrivals become small shards. Runs of similar size (one tier: within a factor of ``fan``) merge, once there are ``fan``
of them, into files of about the target size, which are final. Every change ends in one atomic step, the creation of the
next manifest version, which fails if another writer was first; readers see a whole version or the one before.

A version names lists of shards, not shards: a commit writes the lists that it changes and no other, so its cost follows
the change and not the store. Whoever writes leaves a mark first and takes it away after the commit; files of marked runs
are not for the vacuum.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Shards are merged into files of about this size.
TARGET_BYTES = 64 << 20
#: Shards of one tier differ in size by this factor at most; so many of them merge.
FAN = 4
#: A list holds at most so many shards.
LIST_SHARDS = 5_000
#: Marks of writers, and manifest versions, that are older than so many seconds are vacuumed.
ABANDONED_S, VERSION_S = 7 * 86_400, 3_600
#: Whole numbers from the narrowest to the widest: a column may widen.
_WHOLE = ["byte", "short", "integer", "long"]


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    run: str


@dataclass(frozen=True)
class ShardList:
    name: str
    shards: int
    small: int


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class SchemaMismatch(ValueError):
    """A column comes with a type that neither is nor widens the one that the store has."""


def _wider(a: Any, b: Any) -> Any:
    """The type that holds values of both, or None."""
    names = (a.typeName(), b.typeName())
    if a == b:
        return a
    if all(n in _WHOLE for n in names):
        return max((a, b), key=lambda t: _WHOLE.index(t.typeName()))
    return DoubleType() if set(names) == {"float", "double"} else None


def merged(old: StructType | None, new: StructType) -> StructType:
    """The store's columns in their order, then those that are new to it, all nullable; names that differ in case only are one.

    A column may widen (whole numbers; float to double); SchemaMismatch where its types differ otherwise.
    """
    fields = {f.name.lower(): f for f in (old.fields if old else [])}
    for f in new.fields:
        have = fields.get(f.name.lower())
        kind = f.dataType if have is None else _wider(have.dataType, f.dataType)
        if kind is None:
            raise SchemaMismatch(f"column {f.name}: {f.dataType.simpleString()} does not go with {have.dataType.simpleString()}")
        fields[f.name.lower()] = StructField(have.name if have else f.name, kind, True)
    return StructType(list(fields.values()))


class ShardStore:
    """A table as immutable shards below ``root``, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan: int = FAN):
        self.spark, self.root, self.target, self.fan = spark, root.rstrip("/"), target_bytes, fan
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        for folder in ("manifest", "lists", "marks", "data"):
            self._fs.mkdirs(self._path(f"{self.root}/{folder}"))

    # files

    def _names(self, folder: str) -> dict[str, float]:
        """Files of a folder with the seconds since they were written."""
        now = time.time()
        return {s.getPath().getName(): now - s.getModificationTime() / 1000 for s in self._fs.listStatus(self._path(f"{self.root}/{folder}"))}

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> Any:
        path = self._path(f"{self.root}/{name}")
        out = self._fs.create(path, False)
        out.write(bytearray(text.encode()))
        out.close()
        return path

    def _drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), False)

    # manifest

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._names("manifest") if n.startswith("v") and n.endswith(".json"))

    def _version(self, version: int | None = None) -> dict[str, Any]:
        """What a version says, by default the newest; version 0 is empty."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "id": "", "parent": "", "schema": None, "lists": []}
        told = json.loads(self._text(f"manifest/v{version:012d}.json"))
        return told | {"lists": [ShardList(**x) for x in told["lists"]]}

    def _shards(self, lists: list[ShardList]) -> list[Shard]:
        return [Shard(**json.loads(line)) for x in lists for line in self._text(f"lists/{x.name}").splitlines()]

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard], str | None]:
        """(version, shards, schema) of a version, by default the newest; version 0 is empty."""
        told = self._version(version)
        return told["version"], self._shards(told["lists"]), told["schema"]

    def _list(self, mark: str, shards: list[Shard]) -> list[ShardList]:
        """Lists written for shards, named by the writer's mark."""
        made = []
        for k in range(0, len(shards), LIST_SHARDS):
            part = shards[k : k + LIST_SHARDS]
            name = f"{mark}-{uuid.uuid4().hex}.json"
            self._put(f"lists/{name}", "\n".join(json.dumps(asdict(s)) for s in part))
            made.append(ShardList(name, len(part), sum(s.bytes < self.target // 2 for s in part)))
        return made

    def commit(self, base: int, shards: list[Shard], schema: str | None) -> int:
        """Make ``shards`` the version after ``base``."""
        mark = self._mark()
        try:
            return self._commit(self._version(base), self._list(mark, shards), schema)
        finally:
            self._drop(f"marks/{mark}")

    def _commit(self, base: dict[str, Any], lists: list[ShardList], schema: str | None) -> int:
        """The version after ``base``: written apart, then moved to its name without overwriting; Conflict if there is one."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        number, own = base["version"] + 1, uuid.uuid4().hex
        made = self._put(f"manifest/.{own}", json.dumps({"version": number, "id": own, "parent": base["id"], "schema": schema, "lists": [asdict(x) for x in lists]}))
        final = self._path(f"{self.root}/manifest/v{number:012d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.getFileSystem(conf).getUri(), conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(context.makeQualified(made), context.makeQualified(final), none)
        except Exception as error:
            self._fs.delete(made, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {number} is there already") from error
            raise
        # a writer that was away for long may have taken a number that others have left behind and vacuumed
        known = self.versions()
        if known[-1] > number and (number + 1 not in known or self._version(number + 1)["parent"] != own):
            self._drop(f"manifest/{final.getName()}")
            raise Conflict(f"there are versions after {number} already")
        return number

    def _mark(self) -> str:
        mark = uuid.uuid4().hex
        self._put(f"marks/{mark}", "")
        return mark

    # data

    def _files(self, folder: str) -> list[tuple[str, int]]:
        found, it = [], self._fs.listFiles(self._path(folder), True)
        while it.hasNext():
            s = it.next()
            if s.getPath().getName().startswith("part-"):
                found.append((str(s.getPath().toString()), int(s.getLen())))
        return sorted(found)

    def _write(self, df: DataFrame, mark: str, by: str | None = None) -> list[Shard]:
        run = f"{self.root}/data/run-{mark}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(run)
        # a run is what arrived together: one folder
        return [Shard(path, size, path.rsplit("/", 1)[0]) for path, size in self._files(run)]

    def append(self, df: DataFrame, arrivals: str | None = None) -> int:
        """Add the rows of an arrival as small shards; arrivals: a column that tells several apart, written by one job.

        All rows are kept, nulls and repeated ones too. An empty arrival adds no rows. The store's columns are those of all
        arrivals: rows have null in columns that their arrival did not have (see :func:`merged`; refused before writing).
        """
        own = StructType([f for f in df.schema.fields if f.name != arrivals])
        names = {f.name.lower(): f.name for f in merged(self._schema(self._version()["schema"]), own).fields}
        mark = self._mark()
        try:
            shards = self._write(df.select(*(F.col(f"`{c}`").alias(names.get(c.lower(), c)) for c in df.columns)), mark, arrivals)
            added = self._list(mark, shards)
            while True:
                base = self._version()
                schema = merged(self._schema(base["schema"]), own)
                try:
                    return self._commit(base, base["lists"] + added, schema.json())
                except Conflict:
                    continue
        finally:
            self._drop(f"marks/{mark}")

    def _tier(self, size: int) -> int:
        return int(math.log(max(size, 1), self.fan))

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """What a round merges: for each tier with at least ``fan`` runs, the shards of these runs below half the target."""
        runs: dict[str, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target // 2:
                runs.setdefault(s.run, []).append(s)
        tiers: dict[int, list[list[Shard]]] = {}
        for own in runs.values():
            tiers.setdefault(self._tier(sum(s.bytes for s in own)), []).append(own)
        return [[s for own in found for s in own] for _, found in sorted(tiers.items()) if len(found) >= self.fan]

    def compact(self, max_rounds: int = 40) -> int:
        """Merge until no tier has enough runs. Rows and their columns stay as they are; each merge is one commit.

        Only lists with small shards are read, and those with a shard that goes are written anew.
        """
        for _ in range(max_rounds):
            base = self._version()
            todo = self.plan(self._shards([x for x in base["lists"] if x.small]))
            if not todo:
                return base["version"]
            for group in todo:
                if not self._merge(group):
                    break  # plan anew on what is there now; the files written in vain go with vacuum
        return self._version()["version"]

    def _merge(self, group: list[Shard]) -> bool:
        mark = self._mark()
        try:
            base = self._version()
            gone = {s.path for s in group}
            files = max(1, round(sum(s.bytes for s in group) / self.target))
            new = self._write(self._read(group, base["schema"]).coalesce(files), mark)
            kept, left = [], []
            for x in base["lists"]:
                own = self._shards([x]) if x.small else []
                if gone.isdisjoint(s.path for s in own):
                    kept.append(x)
                else:
                    left += [s for s in own if s.path not in gone]
            self._commit(base, kept + self._list(mark, left + new), base["schema"])
            return True
        except Conflict:
            return False
        finally:
            self._drop(f"marks/{mark}")

    @staticmethod
    def _schema(schema: str | None) -> StructType | None:
        return StructType.fromJson(json.loads(schema)) if schema else None

    def _read(self, shards: list[Shard], schema: str | None) -> DataFrame:
        kind = self._schema(schema) or StructType([])
        if not shards:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[s.path for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest. Spark itself needs the shards' names in the driver, about 150 bytes each."""
        _, shards, schema = self.manifest(version)
        return self._read(shards, schema)

    def vacuum(self, keep: int = 1, abandoned_s: float = ABANDONED_S, version_s: float = VERSION_S) -> int:
        """Delete shards and lists that none of the newest ``keep`` versions names. Returns how many shards went.

        What a writer has not committed yet is safe: files are listed first, then marks, then versions; so a file's writer
        either has its mark still, or has committed. Marks older than ``abandoned_s`` are those of writers that died.
        Older versions go once they are ``version_s`` old.
        """
        data = [path for path, _ in self._files(f"{self.root}/data")]
        lists = list(self._names("lists"))
        marks = self._names("marks")
        known = self.versions()
        running = {m for m, age in marks.items() if age < abandoned_s}
        kept = [self._version(v) for v in known[-keep:]]
        used_lists = {x.name for told in kept for x in told["lists"]}
        used = {s.path for told in kept for s in self._shards(told["lists"])}
        start = len(self._path(f"{self.root}/data").toUri().getPath()) + 1
        owner = lambda path: self._path(path).toUri().getPath()[start:].split("/", 1)[0].removeprefix("run-")
        gone = [path for path in data if path not in used and owner(path) not in running]
        for path in gone:
            self._fs.delete(self._path(path), False)
        for name in lists:
            if name not in used_lists and name.split("-", 1)[0] not in running:
                self._drop(f"lists/{name}")
        ages = self._names("manifest")
        for v in known[:-keep]:
            if ages.get(f"v{v:012d}.json", 0) >= version_s:
                self._drop(f"manifest/v{v:012d}.json")
        for m in marks:
            if m not in running:
                self._drop(f"marks/{m}")
        return len(gone)
