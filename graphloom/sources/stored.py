"""The graph as bucketed, sorted tables: a lookup reads one bucket, and joins of edges on a key need no exchange.

``build`` writes the tables of a model in one version of a snapshot; ``opened`` names them in the session's catalog and
gives a model that reads them, so that every query of a model runs on it unchanged. Edges lie twice, by either end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import graph
from graphloom.operators.lineage import shared_folder
from graphloom.sources.model import Model
from graphloom.sources.snapshots import Snapshots

#: Edges to a bucket, about, so few that a task sorts them in memory beside others; and buckets at least.
EDGES_A_BUCKET, LEAST_BUCKETS = 250_000, 16
#: Tables that are written at once.
AT_ONCE = 4

#: Stored tables: what of a model they hold, and the key that their rows are bucketed and sorted by. The last three are what
#: single lookups read: edges with the columns of their other end.
LAYOUT: dict[str, tuple[Callable[[Model], DataFrame], str]] = {
    "career": (lambda m: m.career, "career_code"),
    "competency": (lambda m: m.competency, "item_code"),
    "course": (lambda m: m.course, "course_code"),
    "seed_course": (lambda m: m.seed_course, "course_code"),
    "seed_item": (lambda m: m.seed_item, "item_code"),
    "known": (lambda m: m.known, "career_code"),
    "need": (lambda m: m.need, "career_code"),
    "need_by_item": (lambda m: m.need, "item_code"),
    "teach": (lambda m: m.teach, "item_code"),
    "teach_by_course": (lambda m: m.teach, "course_code"),
    "relation": (lambda m: m.relation, "src"),
    "relation_by_dst": (lambda m: m.relation, "dst"),
    "skills": (lambda m: graph.seeded(m.need.join(m.competency, "item_code"), m.seed_item, "item_code"), "career_code"),
    "courses": (lambda m: m.teach.join(graph.seeded(m.course, m.seed_course, "course_code").withColumn("generic", T.is_generic_url(F.col("url"))).drop("url"), "course_code"), "item_code"),
    "edges": (lambda m: graph.read_edges(m.competency, m.relation, m.anchor_direction), "item_code"),
}


@dataclass(frozen=True)
class StoredModel(Model):
    """A model whose graph is read from the stored tables (names in the catalog begin with ``prefix``)."""

    prefix: str

    def stored(self, name: str) -> DataFrame:
        return self.spark.read.table(f"{self.prefix}_{name}")

    @cached_property
    def career(self) -> DataFrame:
        return self.stored("career")

    @cached_property
    def competency(self) -> DataFrame:
        return self.stored("competency")

    @cached_property
    def course(self) -> DataFrame:
        return self.stored("course")

    @cached_property
    def seed_course(self) -> DataFrame:
        return self.stored("seed_course")

    @cached_property
    def seed_item(self) -> DataFrame:
        return self.stored("seed_item")

    @cached_property
    def need(self) -> DataFrame:
        return self.stored("need")

    @cached_property
    def teach(self) -> DataFrame:
        return self.stored("teach")

    @cached_property
    def relation(self) -> DataFrame:
        return self.stored("relation")

    @cached_property
    def known(self) -> DataFrame:
        return self.stored("known")


    def skills_of(self, careers: Sequence[int] | None, k: int) -> DataFrame:
        """The first skills of some careers, or of all."""
        # both sides lie in the same buckets, so a merge needs no exchange and no second job
        return graph.first_skills(some(self.career, "career_code", careers).hint("merge"), some(self.stored("skills"), "career_code", careers), k)

    def courses_of(self, items: Sequence[int] | None, k: int) -> DataFrame:
        """The first courses of some competencies, or of all."""
        return graph.first_courses(some(self.stored("courses"), "item_code", items), k)

    def coverage_of(self, items: Sequence[int] | None) -> DataFrame:
        """Edges that some competencies, or all, read, and against their direction."""
        return graph.covered_items(some(self.competency, "item_code", items), some(self.stored("edges"), "item_code", items))


def some(rows: DataFrame, key: str, values: Sequence[int] | None) -> DataFrame:
    return rows if values is None else rows.filter(F.col(key).isin(*values))


def build(model: Model, store: Snapshots, buckets: int | None = None, names: Sequence[str] = tuple(LAYOUT)) -> int:
    """Writes tables of ``LAYOUT``, all unless ``names`` says which, as one new version, with one number of buckets, so that any two that share a key join
    bucket by bucket. Edges of one key lie in one file, sorted."""
    n = buckets or max(LEAST_BUCKETS, -(-model.table("lineitem").count() // EDGES_A_BUCKET))

    def write(path: str) -> None:
        def save(name: str) -> None:
            rows, key = LAYOUT[name]
            # only the files are kept: the name in the catalog goes at once
            temporary = f"graphloom_build_{hashlib.md5(path.encode()).hexdigest()[:12]}_{name}"
            rows(model).repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", f"{path}/{name}").saveAsTable(temporary)
            model.spark.sql(f"DROP TABLE {temporary}")

        # small tables leave most tasks idle, so some are written at once
        with ThreadPoolExecutor(AT_ONCE) as pool:
            list(pool.map(save, names))

    return store.publish(write, buckets=n, tables=list(names))


def opened(spark: SparkSession, sf_dir: str, store: Snapshots, version: int | None = None) -> StoredModel:
    """A model on the tables of a version; they are named in the catalog of this session where they are not yet."""
    version = store.versions()[-1] if version is None else version
    path, entry = store.data(version), store.entry(version)
    n = entry["buckets"]
    prefix = f"graphloom_{hashlib.md5(path.encode()).hexdigest()[:12]}"
    known = {t.name for t in spark.catalog.listTables(pattern=f"{prefix}_*")}
    for name in entry.get("tables", LAYOUT):
        key = LAYOUT[name][1]
        if f"{prefix}_{name}" not in known:
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/{name}").schema)
            spark.sql(f"CREATE TABLE {prefix}_{name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {n} BUCKETS LOCATION '{path}/{name}'")
            # sizes, so that small tables are sent to the tasks of large ones
            spark.sql(f"ANALYZE TABLE {prefix}_{name} COMPUTE STATISTICS NOSCAN")
    return StoredModel(spark, sf_dir, prefix)


def fingerprint(spark: SparkSession, sf_dir: str, names: Sequence[str]) -> str:
    """What the source files were when they were read: paths, lengths and times."""
    lines = []
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        lines += sorted(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in files.listStatus(path))
    return hashlib.md5("\n".join(lines).encode()).hexdigest()


SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "pages")


def stored_model(spark: SparkSession, sf_dir: str, names: Sequence[str] | None = None) -> StoredModel:
    """The stored graph of these source tables: built in the shared folder where no version of them is there. With ``names``
    only those tables are built, unless the whole graph is there."""
    mark = fingerprint(spark, sf_dir, SOURCES)
    root = f"{shared_folder(spark).rstrip('/')}/graphloom/graph-{mark}"
    store = Snapshots(spark, root)
    if names is not None and not store.versions():
        store = Snapshots(spark, f"{root}-{'-'.join(sorted(names))}")
    if not store.versions():
        build(Model(spark, sf_dir), store, names=tuple(LAYOUT) if names is None else names)
    return opened(spark, sf_dir, store)


def selected_buckets(rows: DataFrame) -> list[str]:
    """What the plan says of the buckets that its scans read ("1 out of 16")."""
    plan = rows._jdf.queryExecution().explainString(rows.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [line.split(":", 1)[1].strip() for line in plan.splitlines() if line.startswith("SelectedBucketsCount")]


def exchanges(rows: DataFrame) -> int:
    """How many shuffles the plan has."""
    plan = rows._jdf.queryExecution().explainString(rows.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    return plan.count("Exchange hashpartitioning")


