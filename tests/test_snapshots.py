"""Versions, merges and streams into snapshots."""

import pytest
from pyspark.sql import functions as F

from graphloom.sources.snapshots import Snapshots, WriteConflict

KIND = "id long, at long, text string, status string"


@pytest.fixture
def table(spark, tmp_path):
    return Snapshots(spark, f"file://{tmp_path}/table")


def rows(table, version=None):
    return sorted(map(tuple, table.read(version).collect()))


def test_merges_take_the_last_change_of_a_key(spark, table):
    first = spark.createDataFrame([(1, 1, "a", "new"), (1, 2, "b", "new"), (2, 1, "c", "new"), (None, 1, "n", "new")], KIND)
    assert table.merge(first, ["id"], ["at", "text"]) == 1
    assert sorted((r.id or 0, r.text) for r in table.read().collect()) == [(0, "n"), (1, "b"), (2, "c")]
    more = spark.createDataFrame([(1, 5, "d", "new"), (1, 4, "x", "new"), (2, 9, None, "gone"), (3, 1, "e", "new")], KIND)
    assert table.merge(more, ["id"], ["at", "text"], F.col("status") == "gone", {"status": F.lit("pending")}) == 2
    assert sorted((r.id or 0, r.text, r.status) for r in table.read().collect()) == [(0, "n", "new"), (1, "d", "pending"), (3, "e", "new")]
    # a reader of the first version still sees it
    assert table.read(1).count() == 3


def test_a_killed_write_leaves_the_old_version(spark, table):
    table.replace(spark.createDataFrame([(1, 1, "a", "s")], KIND))
    broken = spark.createDataFrame([(1, 1, "a", "s")], KIND).withColumn("text", F.raise_error(F.lit("stopped")).cast("string"))
    with pytest.raises(Exception, match="stopped"):
        table.replace(broken)
    assert table.versions() == [1] and rows(table) == [(1, 1, "a", "s")]


def test_two_writers_of_a_version(spark, table):
    frame = spark.createDataFrame([(1, 1, "a", "s")], KIND)
    table.replace(frame)
    table.publish(lambda path: frame.write.parquet(path), base=1)
    with pytest.raises(WriteConflict):
        table.publish(lambda path: frame.limit(0).write.parquet(path), base=1)
    assert table.read().count() == 1


def test_missing_rows_clear_and_prune(spark, table):
    table.append_missing(spark.createDataFrame([(1, 1, "a", "s"), (1, 1, "a", "s")], KIND), ["id"])
    table.append_missing(spark.createDataFrame([(1, 2, "z", "s"), (2, 2, "b", "s")], KIND), ["id"])
    assert [r[:3] for r in rows(table)] == [(1, 1, "a"), (2, 2, "b")]
    assert table.clear() == (2, 3) and rows(table) == [] and len(rows(table, 2)) == 2
    table.prune()
    assert table.versions() == [3] and rows(table) == []


def test_a_batch_that_is_sent_again_changes_nothing(spark, table, tmp_path):
    def add(batch, notes):
        return table.merge(batch, ["id"], ["at"], **notes)

    put = table.sink("feed", add)
    one, two = (spark.createDataFrame([(k, k, t, "s")], KIND) for k, t in ((1, "a"), (2, "b")))
    put(one, 0)
    put(two, 1)
    put(two, 1)
    put(one, 0)
    assert table.versions() == [1, 2] and [r[2] for r in rows(table)] == ["a", "b"]
    # another stream counts for itself
    table.sink("other", add)(one, 0)
    assert table.versions() == [1, 2, 3]


def test_a_stream_into_a_table_survives_a_restart(spark, table, tmp_path):
    source, done = str(tmp_path / "in"), str(tmp_path / "ck")

    def run():
        stream = spark.readStream.schema(KIND).parquet(source)
        query = stream.writeStream.foreachBatch(table.sink("s", lambda b, notes: table.merge(b, ["id"], ["at"], **notes))).option("checkpointLocation", done).trigger(availableNow=True).start()
        assert query.awaitTermination(120)

    spark.createDataFrame([(1, 1, "a", "s"), (2, 1, "b", "s")], KIND).coalesce(1).write.parquet(source)
    run()
    spark.createDataFrame([(1, 2, "c", "s")], KIND).coalesce(1).write.mode("append").parquet(source)
    run()
    assert [(r[0], r[2]) for r in rows(table)] == [(1, "c"), (2, "b")]
