"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session gets a temporary folder and any other master the warehouse
    folder, which is shared as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            root = tempfile.mkdtemp(prefix="graphloom-")
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("graphloom.checkpoint.dir", root)
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root


#: Paths in the shared folder that this driver has handed out and not removed.
SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What lies there stays until ``remove_scratch``, as results may read it."""
    SCRATCH.append(f"{shared_dir(spark).rstrip('/')}/graphloom/{name}-{uuid.uuid4().hex}")
    return SCRATCH[-1]


def remove_scratch(spark: SparkSession, paths: Iterable[str] | None = None) -> None:
    """Removes some scratch paths, or all: only once no DataFrame that reads them is used any more."""
    for path in list(SCRATCH if paths is None else paths):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        SCRATCH.remove(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written to the shared folder and the lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, for results that several passes read in part."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_HOLDERS: dict[str, tuple[dict, ...]] = {}


def only(name: str, *caches: dict) -> None:
    """Registers the caches that ``name`` fills in this Python process and empties those of all others: workers are
    used again by later stages, which would otherwise add their memory to what earlier ones left."""
    _HOLDERS[name] = caches
    others = [cache for other, held in _HOLDERS.items() if other != name for cache in held if cache]
    for cache in others:
        cache.clear()
    if others:
        pa.default_memory_pool().release_unused()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_key(column: Column) -> Column:
    """128 bits that stand for a text: equal texts have equal keys."""
    return F.struct(F.xxhash64(column).alias("a"), F.xxhash64(F.lit(1), column).alias("b"))


def new_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name
