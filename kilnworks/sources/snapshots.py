"""Versioned tables in plain Parquet: new files beside the old ones, then one small file that names what is valid.

A table is a folder. `data` has one folder of Parquet files for each part that a commit wrote; `versions` has a file
for each commit, which lists the folder of every part and, for each stream that writes here, the last batch it holds.
Readers take the highest version that is whole. A commit writes its data first and its version last, and creates that
file only if nobody else has: a driver lost at any step leaves the old version valid, a second writer fails and may try
again, and a batch that runs again after it was committed is recognised by its number. Nothing is changed in place, so
running readers keep what they read until `vacuum` removes folders that no kept version names.

The version file has a line for each part (a day, say), not for each file or row.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has committed since the version that a commit started from."""


@dataclass
class Version:
    """What a version names: its number, folders by part, the schema, and last batches by stream."""

    number: int = 0
    parts: dict[str, str] = field(default_factory=dict)
    schema: str | None = None
    batches: dict[str, int] = field(default_factory=dict)


class SnapshotTable:
    """A table at a path that all executors share; `part` is the column that commits replace by value."""

    def __init__(self, spark: SparkSession, path: str, part: str) -> None:
        self.spark, self.path, self.part = spark, path.rstrip("/"), part
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _text(self, path: str) -> str:
        source = self._files.open(self._at(path))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def versions(self) -> list[int]:
        """Numbers that have a file, whole or not, in order."""
        folder = self._at(f"{self.path}/versions")
        if not self._files.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> Version:
        """The highest whole version, or the one of a number; an empty one where there is none."""
        for n in [number] if number is not None else reversed(self.versions()):
            try:
                made = json.loads(self._text(f"{self.path}/versions/{n:012d}.json"))
                return Version(**made)
            except (json.JSONDecodeError, TypeError):  # its writer was lost while writing it
                if number is not None:
                    raise
        return Version()

    def read(self, number: int | None = None, parts: list[str] | None = None) -> DataFrame | None:
        """The rows of a version (or of some of its parts); None where nothing was ever committed."""
        version = self.version(number)
        if version.schema is None:
            return None
        folders = sorted({v for k, v in version.parts.items() if parts is None or k in parts})
        schema = StructType.fromJson(json.loads(version.schema))
        reader = self.spark.read.schema(schema)
        return reader.parquet(*[f"{self.path}/data/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def commit(self, rows: DataFrame, base: Version, stream: str | None = None, batch: int | None = None, replaced: list[str] | None = None) -> Version:
        """Replaces the parts that rows hold (and those of `replaced`) in the version that base names."""
        folder = uuid.uuid4().hex
        key = F.coalesce(F.col(self.part).cast("string"), F.lit("null")).alias("__part")
        rows.withColumn("__part", key).write.partitionBy("__part").parquet(f"{self.path}/data/{folder}")
        self._step("data")
        written = {}
        for f in self._files.listStatus(self._at(f"{self.path}/data/{folder}")):
            name = f.getPath().getName()
            if name.startswith("__part="):
                written[self._unescaped(name[len("__part=") :])] = f"{folder}/{name}"
        kept = {k: v for k, v in base.parts.items() if k not in (replaced or [])}
        batches = base.batches | ({stream: batch} if stream is not None and batch is not None else {})
        taken = self.versions()
        made = Version(max([base.number, *taken]) + 1, kept | written, rows.schema.json(), batches)
        if self.version().number != base.number:
            raise Conflict(f"{self.path} is no longer at version {base.number}")
        self._publish(made)
        return made

    def _unescaped(self, name: str) -> str:
        return self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name)

    def _publish(self, version: Version) -> None:
        try:
            out = self._files.create(self._at(f"{self.path}/versions/{version.number:012d}.json"), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {version.number} of {self.path} exists already") from e
            raise
        text = json.dumps(version.__dict__).encode()
        try:
            half = len(text) // 2
            out.write(bytearray(text[:half]))
            self._step("version")
            out.write(bytearray(text[half:]))
        finally:
            out.close()

    def _step(self, name: str) -> None:
        """Called between the steps of a commit; tests lose the driver here."""

    def update(self, change: Callable[[DataFrame | None, Version], tuple[DataFrame, list[str]]], tries: int = 5, **marks: object) -> Version:
        """Commits what `change` makes of the present rows; if another writer was faster, once more from its version."""
        for left in range(tries - 1, -1, -1):
            base = self.version()
            try:
                rows, replaced = change(self.read(base.number) if base.number else None, base)
                return self.commit(rows, base, replaced=replaced, **marks)
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes data folders that none of the last `keep` whole versions names, and older version files."""
        whole = []
        for n in reversed(self.versions()):
            try:
                whole.append(self.version(n))
            except (json.JSONDecodeError, TypeError):
                continue
        named = {f.split("/")[0] for v in whole[:keep] for f in v.parts.values()}
        gone = []
        data = self._at(f"{self.path}/data")
        for f in self._files.listStatus(data) if self._files.exists(data) else []:
            if f.getPath().getName() not in named:
                self._files.delete(f.getPath(), True)
                gone.append(f.getPath().getName())
        for v in whole[keep:]:
            self._files.delete(self._at(f"{self.path}/versions/{v.number:012d}.json"), False)
        return gone


def merge_sums(held: DataFrame | None, fresh: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Rows of both sides by key, null keys included, with their sums added."""
    both = fresh if held is None else held.select(*keys, *sums).unionByName(fresh.select(*keys, *sums))
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def upsert_stream(stream: DataFrame, table: SnapshotTable, keys: list[str], sums: list[str], checkpoint: str, name: str = "stream"):
    """Starts a stream that adds the sums of its batches to a versioned table, part by part, each batch once.

    A batch reads and writes only the parts that it touches; the list of those is as long as it has parts. Its number is
    committed with its rows, so a batch that runs again, after a loss at any step, is either there whole or not at all.
    """
    columns = [table.part, *keys]

    def add(rows: DataFrame, number: int) -> None:
        fresh = rows.groupBy(*columns).agg(*[F.sum(c).alias(c) for c in sums])

        def change(held: DataFrame | None, base: Version) -> tuple[DataFrame, list[str]]:
            touched = [r[0] for r in rows.select(F.coalesce(F.col(table.part).cast("string"), F.lit("null"))).distinct().collect()]
            old = table.read(base.number, touched) if held is not None else None
            return merge_sums(old, fresh, columns, sums), touched

        if table.version().batches.get(name, -1) < number:
            table.update(change, stream=name, batch=number)

    return stream.writeStream.foreachBatch(add).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
