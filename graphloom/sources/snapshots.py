"""Tables as immutable snapshots in a shared folder: writers publish a version as a whole, readers stay with one.

A table is a folder with a data folder for each write and a file for each version, ``_versions/<number>``, that names its
data. The file is created last and never over another one, so a killed write leaves the version before it, and of two
writers of one version the second fails. Old data stays until ``prune``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.lineage import shared_folder


class WriteConflict(RuntimeError):
    """Another writer published the version first."""


@dataclass(frozen=True)
class Snapshots:
    """The versions of the table in the folder ``root``."""

    spark: SparkSession
    root: str

    def _path(self, *parts: str) -> Any:
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root.rstrip("/"), *parts)))

    def _files(self) -> Any:
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder, files = self._path("_versions"), self._files()
        return sorted(int(f.getPath().getName()) for f in files.listStatus(folder)) if files.exists(folder) else []

    def entry(self, version: int) -> dict[str, Any]:
        """What is noted of a version: data, rows are not counted; streams: the last batch of each stream that it holds."""
        stream = self._files().open(self._path("_versions", f"{version:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def data(self, version: int | None = None) -> str:
        """The data folder of a version, or of the last one."""
        last = self.versions()[-1] if version is None else version
        return f"{self.root.rstrip('/')}/{self.entry(last)['data']}"

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, or of the last one at this moment: later writes do not change what is read."""
        return self.spark.read.parquet(self.data(version))

    def publish(self, write: Callable[[str], Any], base: int | None = None, notes_after: Callable[[], dict[str, Any]] | None = None, **notes: Any) -> int:
        """Lets ``write`` fill a new folder and makes it the version after ``base`` (the last one, unless it is given), with
        ``notes`` and what ``notes_after`` gives once the folder is written."""
        known = self.versions()
        before = base if base is not None else known[-1] if known else 0
        streams = self.entry(before).get("streams", {}) if before in known else {}
        folder = f"data-{uuid.uuid4().hex}"
        write(f"{self.root.rstrip('/')}/{folder}")
        if notes_after is not None:
            notes |= notes_after()
        note = {"data": folder, "streams": {**streams, **notes.pop("streams", {})}, **notes}
        try:
            out = self._files().create(self._path("_versions", f"{before + 1:012d}"), False)
        except Exception as error:
            raise WriteConflict(f"version {before + 1} of {self.root} is there already") from error
        try:
            out.write(bytearray(json.dumps(note).encode()))
        finally:
            out.close()
        return before + 1

    def replace(self, rows: DataFrame, **notes: Any) -> int:
        return self.publish(lambda path: rows.write.parquet(path), **notes)

    def merge(self, changes: DataFrame, keys: Sequence[str], order: Sequence[str], gone: Column | None = None, fill: dict[str, Column] | None = None, **notes: Any) -> int:
        """The last change of each key (by ``order``, nulls first) takes the place of its row; changes for which ``gone``
        holds remove it. ``fill`` sets columns of rows that are replaced (a status that waits for review again)."""
        base = self.versions()[-1] if self.versions() else None
        columns = changes.columns
        best = changes.withColumn("__gone", F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False))
        # an aggregate with a partial sum before the shuffle: a key with many changes is one row a task
        place = F.struct(*order) if order else F.lit(0)
        last = best.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in best.columns if c not in keys)), place).alias("__last")).select(*keys, "__last.*")
        new = last.filter("not __gone").select(*columns)
        if base is None:
            return self.replace(new, **notes)
        old = self.read(base)
        if fill:
            known = old.select(*(F.col(k).alias(f"__{k}") for k in keys), F.lit(True).alias("__known"))
            new = new.join(known, same_keys(new, known, keys), "left").select(*(F.when(F.col("__known"), fill[c]).otherwise(F.col(c)).alias(c) if c in fill else F.col(c) for c in columns))
        changed = last.select(*(F.col(k).alias(f"__{k}") for k in keys))
        kept = old.join(changed, same_keys(old, changed, keys), "left_anti").select(*old.columns)
        return self.publish(lambda path: kept.unionByName(new.select(*old.columns)).write.parquet(path), base, **notes)

    def append_missing(self, rows: DataFrame, keys: Sequence[str], **notes: Any) -> int:
        """Adds the rows whose key the table does not have, one of each key."""
        new = rows.dropDuplicates(list(keys))
        if not self.versions():
            return self.replace(new, **notes)
        base = self.versions()[-1]
        old = self.read(base)
        there = old.select(*(F.col(k).alias(f"__{k}") for k in keys))
        more = new.join(there, same_keys(new, there, keys), "left_anti").select(*old.columns)
        return self.publish(lambda path: old.unionByName(more).write.parquet(path), base, **notes)

    def clear(self) -> tuple[int, int]:
        """Publishes an empty version; how many rows there were, and its number."""
        base = self.versions()[-1]
        old = self.read(base)
        return old.count(), self.publish(lambda path: old.limit(0).write.parquet(path), base)

    def sink(self, stream: str, apply: Callable[[DataFrame, dict[str, Any]], int]) -> Callable[[DataFrame, int], None]:
        """A function for ``foreachBatch``. ``apply`` gets the batch and the notes to publish with it. A batch that the
        table holds already, as it is sent again after a failure, changes nothing."""

        def run(batch: DataFrame, number: int) -> None:
            known = self.versions()
            if known and self.entry(known[-1]).get("streams", {}).get(stream, -1) >= number:
                return
            apply(batch, {"streams": {stream: number}})

        return run

    def prune(self, keep: int = 1) -> None:
        """Forgets all versions but the last ``keep``, and their data: once nobody reads them."""
        known, files = self.versions(), self._files()
        for version in known[: max(0, len(known) - keep)]:
            path = self._path(self.entry(version)["data"])
            files.delete(self._path("_versions", f"{version:012d}"), False)
            files.delete(path, True)


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equal keys, null ones too; those of ``right`` are named with two underscores in front."""
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[f"__{k}"])
    return condition


def scratch(spark: SparkSession, name: str) -> Snapshots:
    """A new table in the session's shared folder."""
    return Snapshots(spark, f"{shared_folder(spark).rstrip('/')}/graphloom/{name}-{uuid.uuid4().hex}")
