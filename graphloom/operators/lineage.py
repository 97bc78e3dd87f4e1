"""Reliable cuts of lineage for iterative programs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, where any executor finds what another wrote. Where none is set the warehouse
    holds it, which driver and executors share."""
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = known.get() if known.isDefined() else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if not known.isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and ends the lineage there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Steps:
    """Tables that an iterative program writes to the shared folder, and removes once it needs them no more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root = spark, f"{shared_folder(spark).rstrip('/')}/graphloom/steps-{uuid.uuid4().hex}"
        self.paths: set[str] = set()

    def keep(self, rows: DataFrame) -> DataFrame:
        """``rows`` as a written table."""
        path = f"{self.root}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        kept = self.spark.read.schema(rows.schema).parquet(path)
        self.paths.add(path)
        kept._graphloom_step = path
        return kept

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            self._remove(frame._graphloom_step)

    def drop_all(self, but: DataFrame) -> None:
        """Removes all tables but one, the result."""
        for path in self.paths - {but._graphloom_step}:
            self._remove(path)

    def _remove(self, path: str) -> None:
        self.paths.discard(path)
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
