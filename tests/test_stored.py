"""The stored graph: pruned buckets, joins without exchange, versions."""

from pathlib import Path

import pytest

from graphloom.plans import catalogue
from graphloom.sources import stored
from graphloom.sources.model import Model
from graphloom.sources.snapshots import Snapshots

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def graph(spark):
    return stored.stored_model(spark, SF)


def test_lookups_read_one_bucket_and_equal_the_batch(spark, graph):
    model = Model(spark, SF)
    for name, key, lookup in (("pathfinding_topk", "career_code", lambda k: graph.skills_of(k, 5)), ("course_rec", "item_code", lambda k: graph.courses_of(k, 3)), ("relations_both_directions", "item_code", graph.coverage_of)):
        rows = lookup([7])
        assert stored.selected_buckets(rows) and set(stored.selected_buckets(rows)) == {"1 out of 16"} and stored.exchanges(rows) == 0, name
        assert sorted(rows.collect()) == sorted(getattr(catalogue, name)(model).filter(f"{key} = 7").select(*rows.columns).collect())
        assert lookup([-1]).count() == 0
        assert set(stored.selected_buckets(lookup([7, 8]))) <= {"2 out of 16", "1 out of 16"}


def test_joins_on_a_bucketed_key_need_no_exchange(graph):
    joined = graph.stored("need_by_item").hint("merge").join(graph.teach, "item_code")
    assert stored.exchanges(joined) == 0
    assert stored.exchanges(graph.need.hint("merge").join(graph.known, "career_code")) == 0


def test_a_second_session_opens_what_is_there(spark, graph):
    again = stored.stored_model(spark.newSession(), SF)
    assert again.prefix == graph.prefix and again.skills_of([3], 2).count() == graph.skills_of([3], 2).count()


def test_readers_stay_with_their_version(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/graph")
    assert stored.build(Model(spark, SF), store, buckets=4) == 1
    first = stored.opened(spark, SF, store)
    n = first.need.count()
    stored.build(Model(spark, SF), store, buckets=8)
    assert stored.opened(spark, SF, store).prefix != first.prefix
    assert first.need.count() == n and set(stored.selected_buckets(stored.opened(spark, SF, store, 1).skills_of([1], 2))) == {"1 out of 4"}


def test_queries_store_the_tables_that_they_read(spark, tmp_path):
    for path in Path(SF).glob("*.parquet"):
        (tmp_path / path.name).write_bytes(path.read_bytes())
    model = stored.stored_model(spark, str(tmp_path), ["courses"])
    assert sorted(model.courses_of(None, 3).collect()) == sorted(catalogue.course_rec(Model(spark, SF)).select(*model.courses_of(None, 3).columns).collect())
    assert {t.name for t in spark.catalog.listTables(pattern=f"{model.prefix}_*")} == {f"{model.prefix}_courses"}
    whole = stored.stored_model(spark, str(tmp_path))
    assert len(spark.catalog.listTables(pattern=f"{whole.prefix}_*")) == len(stored.LAYOUT)
    assert stored.stored_model(spark, str(tmp_path), ["courses"]).prefix == whole.prefix
