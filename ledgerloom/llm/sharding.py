"""Sharding by size-tiered compaction with versioned manifests, in DataFrame operations only."""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


@dataclass(frozen=True)
class Shard:
    """An immutable file of a store."""

    file: str  # path below the store's root
    bytes: int
    arrival: int  # number of the first append whose rows it holds


class ConflictError(RuntimeError):
    """Another writer has committed the same version first."""


class ShardStore:
    """A table of immutable Parquet shards under `root`, in any file system that Hadoop opens.

    append() writes an arrival as small shards. compact() merges shards of similar size: a shard's tier is the
    power of `fan_in` that its size has over `small_bytes`; when a tier holds `fan_in` shards, they become files of
    about `target_bytes`. Shards of half that size or more are final. Each change is one new manifest,
    manifest/v<number>.json, written beside its place and renamed there without overwriting, so that readers see a
    version whole or not at all, and of two writers one gets ConflictError and tries again. Files that no manifest
    names (left by failed writers) are never read; vacuum() deletes them and what later versions replaced.

    Shards keep the rows' columns as they are, whatever their names; the manifest holds the schema of all of them, so that a column which only some arrivals have is null in the others' rows. Columns of one name must be of
    one type. An empty arrival commits a version without new shards. Null values, ties, repeated rows and very long texts are stored unchanged.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, small_bytes: int = 1 << 20, fan_in: int = 4):
        self.spark, self.root, self.target_bytes, self.small_bytes, self.fan_in = spark, root.rstrip("/"), target_bytes, small_bytes, fan_in
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _list(self, name: str) -> list:
        path = self._path(name)
        return list(self._fs.listStatus(path)) if self._fs.exists(path) else []

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        names = [x.getPath().getName() for x in self._list("manifest")]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        number = self.version() if version is None else version
        if not number:
            return {"version": 0, "arrivals": 0, "schema": None, "shards": []}
        stream = self._fs.open(self._path(f"manifest/v{number:08d}.json"))
        try:
            content = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        return content | {"schema": content["schema"] and StructType.fromJson(content["schema"]), "shards": [Shard(**x) for x in content["shards"]]}

    def _commit(self, base: dict, arrivals: int, shards: list[Shard], schema: StructType | None = None) -> int:
        schema = schema or base["schema"]
        number = base["version"] + 1
        self._fs.mkdirs(self._path("manifest"))
        draft = self._path(f"manifest/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(json.dumps({"version": number, "arrivals": arrivals, "schema": schema and schema.jsonValue(), "shards": [asdict(x) for x in shards]}).encode())
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self._fs.getUri(), self._conf)
        none = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(self._path(f"manifest/v{number:08d}.json")), none)
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise ConflictError(f"version {number} is there already") from e
            raise
        return number

    def _write(self, df: DataFrame, arrival: int) -> list[Shard]:
        folder = f"data/{uuid.uuid4().hex}"
        df.write.option("compression", "snappy").parquet(f"{self.root}/{folder}")
        return self._shards(folder, arrival)

    def _shards(self, folder: str, arrival: int) -> list[Shard]:
        files = [x for x in self._list(folder) if x.getPath().getName().startswith("part-")]
        return [Shard(f"{folder}/{x.getPath().getName()}", x.getLen(), arrival) for x in sorted(files, key=lambda x: x.getPath().getName())]

    @staticmethod
    def _union(held: StructType | None, new: StructType) -> StructType:
        """The columns of both, all nullable: those held first."""
        fields = {f.name: f for f in (held.fields if held else ())}
        for f in new.fields:
            if f.name in fields and fields[f.name].dataType != f.dataType:
                raise ValueError(f"column {f.name} is held as {fields[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
            fields.setdefault(f.name, StructField(f.name, f.dataType, True))
        return StructType(list(fields.values()))

    def append(self, arrivals: DataFrame) -> int:
        """Commit the rows as small shards, one for each partition that holds rows; returns the version."""
        base = self.manifest()
        schema = self._union(base["schema"], arrivals.schema)
        return self._commit(base, base["arrivals"] + 1, base["shards"] + self._write(arrivals, base["arrivals"]), schema)

    def append_each(self, rows: DataFrame, arrival: Column, arrivals: int, alone: bool = False) -> int:
        """Commit rows as `arrivals` appends of their own, those of arrival 0 first, and compact after each; returns the version.

        All shards are written in one job, so that arrivals that wait together don't wait for each other's. `alone`: no
        one else writes to the store, so what is replaced can be deleted at once.
        """
        schema = self._union(self.manifest()["schema"], rows.schema)
        folder, name = f"data/{uuid.uuid4().hex}", "arrival"
        while name in map(str.lower, rows.columns):
            name += "_"
        rows.withColumn(name, arrival).write.partitionBy(name).option("compression", "snappy").parquet(f"{self.root}/{folder}")
        for k in range(arrivals):
            base = self.manifest()
            self._commit(base, base["arrivals"] + 1, base["shards"] + self._shards(f"{folder}/{name}={k}", base["arrivals"]), schema)
            before = self.version()
            if self.compact() > before and alone:
                self.vacuum({folder})
        return self.version()

    def tier(self, shard: Shard) -> int | None:
        """None for final shards."""
        if shard.bytes >= self.target_bytes // 2:
            return None
        return max(0, int(math.log(max(shard.bytes, 1) / self.small_bytes, self.fan_in))) if shard.bytes > self.small_bytes else 0

    def compact(self) -> int:
        """Merge until no tier holds fan_in shards; returns the version. Rows stay in order of arrival within a merge."""
        while True:
            base = self.manifest()
            tiers: dict[int, list[Shard]] = {}
            for shard in base["shards"]:
                if (t := self.tier(shard)) is not None:
                    tiers.setdefault(t, []).append(shard)
            full = [t for t, held in tiers.items() if len(held) >= self.fan_in]
            if not full:
                return base["version"]
            # a cascade in one step: the lowest full tier, and each above it that this merge would fill
            picked: list[Shard] = []
            for t in sorted(tiers):
                if t >= min(full) and (len(tiers[t]) >= self.fan_in or (picked and len(tiers[t]) + 1 >= self.fan_in)):
                    picked += tiers[t]
            picked.sort(key=lambda x: (x.arrival, x.file))
            files = max(1, round(sum(x.bytes for x in picked) / self.target_bytes))
            # coalesce() joins whole input splits: no row is shuffled
            merged = self._write(self.spark.read.schema(base["schema"]).parquet(*[f"{self.root}/{x.file}" for x in picked]).coalesce(files), picked[0].arrival)
            gone = set(picked)
            self._commit(base, base["arrivals"], [x for x in base["shards"] if x not in gone] + merged)

    def read(self, version: int | None = None) -> DataFrame | None:
        """Rows of a version, columns as they came; None if it has no shards."""
        manifest = self.manifest(version)
        return self.spark.read.schema(manifest["schema"]).parquet(*[f"{self.root}/{x.file}" for x in manifest["shards"]]) if manifest["shards"] else None

    @staticmethod
    def shard_of(rows: DataFrame) -> Column:
        """The shard of each row of read()."""
        return F.regexp_extract(rows.metadataColumn("_metadata")["file_path"], r"/(data/[0-9a-f]{32}/.+)$", 1)

    def vacuum(self, waiting: set[str] | None = None) -> int:
        """Delete data files that the newest version doesn't name; returns their number. Not while others write.

        Folders in `waiting` hold shards that are yet to be committed and stay.
        """
        held = {x.file for x in self.manifest()["shards"]}
        gone = 0

        def clear(name: str) -> bool:
            """Whether nothing of the folder is left."""
            nonlocal gone
            empty = True
            for x in self._list(name):
                below = f"{name}/{x.getPath().getName()}"
                if x.isDirectory():
                    empty &= clear(below)
                elif below in held:
                    empty = False
                else:
                    gone += x.getPath().getName().startswith("part-")
                    self._fs.delete(x.getPath(), False)
            if empty:
                self._fs.delete(self._path(name), True)
            return empty

        for folder in self._list("data"):
            if f"data/{folder.getPath().getName()}" not in (waiting or ()):
                clear(f"data/{folder.getPath().getName()}")
        return gone
