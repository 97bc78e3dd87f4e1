"""Text files as tables and back: JSON lines, JSON documents and CSV."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MESSAGES = "array<struct<role: string, content: string>>"


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """One row a line that is not blank. A malformed line gives nulls, or with ``strict`` an error that names the first such
    line of each file; the lines are checked as the function is called, by splits of files."""
    if strict:
        wrong = malformed_lines(spark, path)
        found = wrong.orderBy("file", "line").limit(20).collect()
        if found:
            raise ValueError("; ".join(f"{r.file}:{r.line}: malformed line" for r in found))
    return spark.read.schema(schema).json(path)


def numbered_splits(spark: SparkSession, path: str) -> DataFrame:
    """file, start, n_lines, first_bad (from 1, null if none): the lines of each split of the text files. A task reads its
    splits line by line; a row a split leaves it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int], list] = {}
        for batch in batches:
            for file, start, bad in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                split = counts.setdefault((file, start), [0, None])
                split[0] += 1
                if bad and split[1] is None:
                    split[1] = split[0]
        rows = [(file, start, n, bad) for (file, start), (n, bad) in counts.items()]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["file", "start", "n_lines", "first_bad"])

    bad = (F.trim("value") != "") & F.get_json_object("value", "$").isNull()
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), bad.alias("bad"))
    return lines.mapInArrow(run, "file string, start long, n_lines long, first_bad long")


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1): the first malformed line of each file that has one. Lines of splits are counted where they lie, and
    the counts of the splits before, a few a file, are added."""
    splits = numbered_splits(spark, path)
    before = F.coalesce(F.sum("n_lines").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = splits.withColumn("line", before + F.col("first_bad"))
    return placed.groupBy("file").agg(F.min("line").alias("line")).filter("line is not null")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """messages, meta (a map), file_name of the lines whose messages are a list. ``path`` may be a pattern of files."""
    raw = spark.read.schema("messages string, meta map<string, string>").json(path).withColumn("file_name", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    rows = raw.filter(F.col("messages").startswith("["))
    return rows.select(F.from_json("messages", MESSAGES).alias("messages"), "meta", "file_name").filter(F.col("messages").isNotNull())


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files that each hold one JSON document or a list of them; what cannot be read gives no rows."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(rows: DataFrame, path: str, fields: Sequence[str]) -> None:
    """Files of these fields in this order, each with a header."""
    rows.select(*fields).write.mode("overwrite").option("header", True).csv(path)
