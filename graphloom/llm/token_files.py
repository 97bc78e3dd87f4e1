"""Operator 6: token ids in ORC files.

Documents are dealt to tasks by ranges of doc_id and written in ascending order, one ORC file a task. ORC
encodes the id lists as integer runs and keeps row indexes and Bloom filters on doc_id for each stripe, so
a reader can take stripes in parallel and skip those that cannot hold an id it looks for. A file holds
starts within its own part; the totals of the parts (one row a file) turn them into starts in the corpus.

Defined cases: a null text is an empty one and has the end id alone; a null doc_id comes first; equal
doc_ids stand in the order of their texts; an empty table gives no rows; other columns are not written.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import cut, scratch_path

FILE_SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"

#: The starts of the files (16 bytes a file) are broadcast up to this size and joined by shuffle beyond it.
BROADCAST_BYTES = 32 << 20

ORC_OPTIONS = {
    "compression": "lz4",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "2000",
    "orc.stripe.size": str(32 << 20),
}


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None, partitions: int | None = None) -> None:
    """Writes the ids of each document (columns doc_id, text), followed by ``end_id`` if given, under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part, at = tokens.library_cache(tokenizer_path), TaskContext.get().partitionId(), 0
        tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        for batch in batches:
            column = batch.column(1)
            for begin, end in tokens.slices(column):
                coded = [ids + tail for ids in cache.encode(tokens.texts_of(column, begin, end))]
                sizes = [len(ids) // 4 for ids in coded]
                ends = list(itertools.accumulate(sizes, initial=0))
                ids = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(coded))])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, end - begin),
                        pa.array([part] * len(coded), pa.int32()),
                        pa.array([at + x for x in ends[:-1]], pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids),
                    ],
                    ["doc_id", "part", "local_start", "n_tokens", "ids"],
                )
                at += ends[-1]

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = source.repartitionByRange(partitions, *order) if partitions else source.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order, "text").mapInArrow(run, FILE_SCHEMA).write.options(**ORC_OPTIONS).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    # one row a file: the running total over them is small
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut(totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")))
    if bases.count() * 16 <= BROADCAST_BYTES:
        bases = F.broadcast(bases)  # so that the ids stay where they are read
    return rows.join(bases, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def find_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; the reader skips the stripes whose indexes and Bloom filters exclude them."""
    return read_token_files(spark, path).filter(F.col("doc_id").isin(doc_ids))


def token_digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids of each row of ``read_token_files``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values = memoryview(lists.values.to_numpy(zero_copy_only=True)).cast("B")
            ends = lists.offsets.to_pylist()
            crc = [tokens.crc32_of(values[4 * a : 4 * b]) for a, b in itertools.pairwise(ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int | None) -> DataFrame:
    """Writes the documents' ids to files in the shared folder and returns what the files hold, as digests."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-files")
    write_token_files(docs, path, tokenizer_path, end_id)
    return token_digests(read_token_files(spark, path))
