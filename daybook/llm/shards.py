"""Operator 7: a table of immutable Parquet shards with size-tiered compaction and versioned manifests.

Arrivals are appended as they come, one small shard for each task. Compaction sorts the live shards of less than the target
size into tiers (each `fan_in` times as large as the one before); where a tier holds at least two shards, runs of
similar size are merged until a run reaches the target, without a shuffle: one task reads the shards of a run and writes
one file. Every change writes new files first and then commits a manifest, a JSON list of live shards under the next
version number, by renaming a finished file to a name that must not exist. A reader opens the newest manifest and never sees
half a change; a writer that finds its version taken reads the new one and tries again. `vacuum` deletes files that no kept
version names.

All access to files goes through Spark and its file systems. A commit is atomic and exclusive where a rename is and refuses
a name that exists: on HDFS, on local and other POSIX file systems, and in object stores whose connector gives this (stores
with hierarchical names). A store that copies in place of renaming needs a single writer.

Cases: an empty table commits a version without new shards; nulls, repeated rows, very long texts and any columns are kept
as they are, one named `shard` included (the shard's column then has another name); a merge that loses its executors is run again by Spark and only finished files are committed.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Shard:
    path: str
    size: int
    generation: int  # merges behind it


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str  # JSON
    shards: tuple[Shard, ...]

    def text(self) -> str:
        return json.dumps({"version": self.version, "schema": self.schema, "shards": [asdict(s) for s in self.shards]})


class Conflict(Exception):
    """Another writer has committed this version."""


class ShardTable:
    def __init__(self, spark: SparkSession, folder: str, target_bytes: int = 128 << 20, fan_in: int = 4, runs_per_job: int = 200):
        self.spark, self.folder, self.target, self.fan_in, self.runs_per_job = spark, folder.rstrip("/"), target_bytes, fan_in, runs_per_job

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return jvm, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        jvm, fs = self._fs()
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifests/v*.json")) or []
        return sorted(int(s.getPath().getName()[1:-5]) for s in found)

    def manifest(self, version: int | None = None) -> Manifest | None:
        versions = self._versions()
        if not versions:
            return None
        jvm, fs = self._fs()
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifests/v{versions[-1] if version is None else version:012d}.json"))
        try:
            found = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Manifest(found["version"], found["schema"], tuple(Shard(**s) for s in found["shards"]))

    def _commit(self, manifest: Manifest) -> None:
        jvm, fs = self._fs()
        to = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifests/v{manifest.version:012d}.json")
        draft = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifests/draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(manifest.text().encode()))
        stream.close()
        # renaming never replaces a file: of two writers of a version one fails
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.isUriPathAbsolute() and draft.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, to, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as error:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(str(to)) from None
            raise

    def _change(self, schema: str, add: list[Shard], drop: set[str]) -> Manifest:
        while True:
            now = self.manifest()
            live = now.shards if now else ()
            if not drop <= {s.path for s in live}:
                raise Conflict("a shard to be replaced is no longer live")
            new = Manifest(now.version + 1 if now else 1, schema, tuple(s for s in live if s.path not in drop) + tuple(add))
            try:
                self._commit(new)
                return new
            except Conflict:
                continue

    def _written(self, df: DataFrame, generation: int) -> list[Shard]:
        to = f"{self.folder}/shards/{uuid.uuid4().hex}"
        df.write.parquet(to)
        jvm, fs = self._fs()
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{to}/part-*.parquet")) or []
        return [Shard(f"{to.removeprefix(self.folder)}/{s.getPath().getName()}", s.getLen(), generation) for s in found]

    def append(self, rows: DataFrame) -> Manifest:
        """One small shard for each task of rows that has any; one version."""
        now = self.manifest()
        schema = rows.schema.json()
        if now and T.StructType.fromJson(json.loads(now.schema)).simpleString() != rows.schema.simpleString():
            raise ValueError("arrivals have other columns than the table")
        return self._change(now.schema if now else schema, self._written(rows, 0), set())

    def plan(self, shards: tuple[Shard, ...]) -> list[list[Shard]]:
        """Runs of two or more shards of one tier, each up to the target size."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.size < self.target // 2:
                tiers.setdefault(max(0, int(math.log(max(s.size, 1) / self.target, self.fan_in)) + 64), []).append(s)
        runs = []
        for _, tier in sorted(tiers.items()):
            run: list[Shard] = []
            for s in sorted(tier, key=lambda s: (s.size, s.path)):
                if run and sum(x.size for x in run) + s.size > self.target * 1.25:
                    runs.append(run)
                    run = []
                run.append(s)
            runs.append(run)
        return [r for r in runs if len(r) > 1]

    def compact(self) -> Manifest | None:
        """Merges until no tier holds two shards; a version for each round."""
        now = self.manifest()
        while now and (runs := self.plan(now.shards)):
            schema = T.StructType.fromJson(json.loads(now.schema))
            merged: list[Shard] = []
            for i in range(0, len(runs), self.runs_per_job):
                part = runs[i : i + self.runs_per_job]
                frames = [self.spark.read.schema(schema).parquet(*(self.folder + s.path for s in run)).coalesce(1) for run in part]
                generation = 1 + max(s.generation for run in part for s in run)
                merged += self._one_file_each(frames, generation)
            now = self._change(now.schema, merged, {s.path for run in runs for s in run})
        return now

    def _one_file_each(self, frames: list[DataFrame], generation: int) -> list[Shard]:
        """Frames of one partition, as one task and file each: a union of such would else be one task."""
        key = "spark.sql.unionOutputPartitioning"
        before = self.spark.conf.get(key, "true")
        self.spark.conf.set(key, "false")
        try:
            return self._written(reduce(DataFrame.union, frames), generation)
        finally:
            self.spark.conf.set(key, before)

    def shard_column(self, schema: T.StructType) -> str:
        """`shard`, with underscores before it where the table has a column of that name."""
        name = "shard"
        while name in {c.lower() for c in schema.names}:
            name = f"_{name}"
        return name

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the newest), with the shard that each is in as the last column (see `shard_column`)."""
        found = self.manifest(version)
        if not found:
            raise ValueError(f"no table at {self.folder}")
        schema = T.StructType.fromJson(json.loads(found.schema))
        name = self.shard_column(schema)
        if not found.shards:
            return self.spark.createDataFrame([], schema).withColumn(name, F.lit(None).cast("string"))
        rows = self.spark.read.schema(schema).parquet(*(self.folder + s.path for s in found.shards))
        place = rows.metadataColumn("_metadata")
        return rows.select(*(F.col(f"`{c}`") for c in schema.names), F.concat_ws("/", F.element_at(F.split(place["file_path"], "/"), -2), place["file_name"]).alias(name))

    def vacuum(self, keep: int = 1, orphans_after: float = 86_400) -> int:
        """Deletes shards that none of the `keep` newest versions names, and older manifests. Files that no version names, as
        a writer that failed or lost its version leaves them, go once they are `orphans_after` seconds old. Returns how many
        files went."""
        jvm, fs = self._fs()
        versions = self._versions()
        live = {s.path for v in versions[-keep:] for s in self.manifest(v).shards}
        replaced = {s.path for v in versions[:-keep] for s in self.manifest(v).shards} - live
        root = jvm.org.apache.hadoop.fs.Path
        for path in replaced:
            fs.delete(root(self.folder + path), False)
        for v in versions[:-keep]:
            fs.delete(root(f"{self.folder}/manifests/v{v:012d}.json"), False)
        gone, now = len(replaced), time.time()
        for s in fs.globStatus(root(f"{self.folder}/shards/*/part-*.parquet")) or []:
            path = f"/shards/{s.getPath().getParent().getName()}/{s.getPath().getName()}"
            if path not in live and now - s.getModificationTime() / 1000 >= orphans_after:
                gone += bool(fs.delete(s.getPath(), False))
        return gone
