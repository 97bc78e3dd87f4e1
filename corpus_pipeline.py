"""Corpus pipeline: toxicity, line dedup, n-gram join, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import line_dedup, ngram_join, packing, toxicity
from graphloom.llm.common import SCRATCH, documents, new_name, remove_scratch, scratch_path, text_key


def set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns of these names under others, and the columns that bring all names back, in their order."""
    others = {c: new_name(docs, c) for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed(others), [F.col(f"`{others.get(c, c)}`").alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic. It learns from the labelled documents among ``docs``. Null and
    empty texts, null ids and repeated rows are scored like others; without labels every document stays, unless all
    labels are toxic; no documents give no rows; columns that are named as the scores are keep their values."""
    apart, back = set_aside(docs, "score", "predicted")
    scored = toxicity.score_documents(apart, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.filter("predicted = 0").select(*back)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that at least five documents share, but in the last that holds them.
    n_chars follows the text. Null texts stay null; rows with a null id count as one document; repeated rows are treated
    alike; no documents give no rows; all other columns keep their values."""
    apart, back = set_aside(docs, "n_lines", "n_dropped")
    kept = line_dedup.dedup_lines(apart)
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that near-duplicate links connect: that of the smallest doc_id. Documents without
    words link with nothing and stay. Rows that share id and text are one document, of which one row stays; a null id
    gives way to any other; no documents give no rows."""
    joined = ngram_join.join_documents(docs, with_keys=True)
    key = text_key(F.coalesce(F.col("text").cast("string"), F.lit("")))
    t1, t2, gone_id, g1, g2 = (new_name(docs, x) for x in ("t1", "t2", "gone_id", "g1", "g2"))
    keyed = docs.withColumns({t1: key["a"], t2: key["b"]})
    gone = joined.filter("not kept").select(F.col("doc_id").alias(gone_id), F.col("t1").alias(g1), F.col("t2").alias(g2)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(t1) == F.col(g1)) & (F.col(t2) == F.col(g2))
    kept = keyed.join(gone.hint("shuffle_hash"), same, "left_anti")
    # a document that stands in several rows stays once
    return kept.dropDuplicates(["doc_id", t1, t2]).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document in sequences of at most 1024: a row for each piece. A null text is an empty one,
    which has the end id alone; repeated rows are documents of their own; no documents give no rows."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("packing", pack),
]

#: No stage but the second can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, last = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        before = set(SCRATCH)
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        # what the stage left, and what it read, is not needed any more
        remove_scratch(spark, [p for p in SCRATCH if p != path and (p not in before or p == last)])
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
