"""Reports on evaluation runs, gold sets, chats and tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Where gold answers come from.
DERIVED_SOURCES = ("derived_from_graph_repository", "derived_from_retrieval_v2")
INDEPENDENT_SOURCES = ("human_verified_from_excel", "excel_derived")
#: Cohorts of cases, and the source of the new one.
NEW_SOURCE, NEW_COHORT, OLD_COHORT = "quality_gold_v2.2", "v22_new14", "v21_legacy"


def of_source(cases: DataFrame, wanted: str | None) -> DataFrame:
    """Cases of independent or derived gold, or all. A case without a source is a derived one."""
    source = F.coalesce("gold_source", F.lit(""))
    if not wanted or wanted == "all":
        return cases
    if wanted == "independent":
        return cases.filter(source.isin(*INDEPENDENT_SOURCES))
    if wanted == "derived":
        return cases.filter(source.isin("", *DERIVED_SOURCES))
    raise ValueError(f"unknown gold source: {wanted}")


def with_gold(cases: DataFrame, lists: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Cases that have something to find: one of the lists is not empty or one of the names is not blank."""
    has = [F.coalesce(F.size(c) > 0, F.lit(False)) for c in lists] + [F.coalesce(F.trim(c) != "", F.lit(False)) for c in names]
    return cases.filter(reduce(lambda a, b: a | b, has))


def source_comparison(derived: DataFrame, independent: DataFrame, mode: str, value: str) -> DataFrame:
    """Mean of each mode on derived and on independent gold, and the difference; a mode without either is left out."""
    means = [rows.groupBy(mode).agg(F.round(F.avg(value), 4).alias(name)) for rows, name in ((derived, "derived"), (independent, "independent"))]
    both = means[0].join(means[1], mode, "full").filter("derived IS NOT NULL OR independent IS NOT NULL")
    return both.withColumn("delta", F.round(F.col("independent") - F.col("derived"), 4))


def breakdown(rows: DataFrame, strata: Sequence[str], value: str) -> DataFrame:
    """Number and mean of each stratum's rows that have a value."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*strata).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 4).alias("mean"))


def by_match(rows: DataFrame, case: str, mode: str, value: str) -> DataFrame:
    """Questions without a hint by whether the graph matched them (easy, hard, unknown): the cases of each group, and
    the mean of each mode."""
    group = F.when(F.col("matched"), "easy").when(~F.col("matched"), "hard").otherwise("unknown")
    bare = rows.filter(~F.coalesce("hint", F.lit(True))).withColumn("bucket", group)
    cases = bare.groupBy("bucket").agg(F.count_distinct(case).alias("n_cases"))
    return bare.groupBy("bucket", mode).agg(F.round(F.avg(value), 4).alias("mean")).join(cases, "bucket")


def mean_deltas(before: DataFrame, after: DataFrame, keys: Sequence[str], mode: str, values: Sequence[str], drop: float) -> DataFrame:
    """mode, metric, n_paired, mean_delta and n_regressions (a loss of more than ``drop``) of the runs that both have."""
    def long(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*keys, *values).unpivot(list(keys), list(values), "metric", name)

    paired = long(before, "old").join(long(after, "new"), [*keys, "metric"]).withColumn("delta", F.col("new") - F.col("old")).filter("delta IS NOT NULL")
    return paired.groupBy(mode, "metric").agg(F.count(F.lit(1)).alias("n_paired"), F.round(F.avg("delta"), 4).alias("mean_delta"), F.count_if(F.col("delta") < -drop).alias("n_regressions"))


def one_schema(cases: DataFrame) -> DataFrame:
    """Cases of two schemas in one: question, intent, expected_intent and the expected careers, skills and courses.
    Blank strings and empty lists count as absent."""
    def text(*names: str) -> Column:
        return F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names))

    def listed(*names: str) -> Column:
        return F.coalesce(*(F.when(F.size(n) > 0, F.col(n)) for n in names))

    none = F.array().cast("array<string>")
    intent = F.coalesce(text("intent"), F.lit("pathfinding"))
    career = F.coalesce(listed("expected_careers"), F.array_compact(F.array(text("career", "expected_career"))))
    asked = F.when((intent == "course_rec") & text("competency").isNotNull(), F.array("competency"))
    return cases.select(
        "id", F.coalesce(text("question", "query"), F.lit("")).alias("question"), intent.alias("intent"), F.coalesce(text("expected_intent"), intent).alias("expected_intent"),
        career.alias("expected_careers"), F.coalesce(listed("expected_skills", "gold_skills"), asked, none).alias("expected_skills"),
        F.coalesce(listed("expected_courses", "gold_course_codes"), none).alias("expected_courses"),
    )


def cohort(given: Column, source: Column) -> Column:
    """The cohort of a case: as given, else by the source of its gold."""
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), F.when(source.startswith(NEW_SOURCE), NEW_COHORT).otherwise(OLD_COHORT))


def first_names(rows: DataFrame, owner: str, name: str, order: Sequence[Column], most: int) -> DataFrame:
    """owner, names: the first ``most`` different names of each owner. Which is a report of bounded length."""
    firsts = rows.filter(F.coalesce(F.col(name), F.lit("")) != "").groupBy(owner, F.col(name).alias("n")).agg(F.min(F.struct(*order)).alias("at"))
    ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy(owner).orderBy("at", "n"))).filter(F.col("rank") <= most)
    return ranked.groupBy(owner).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "n"))), lambda r: r["n"]).alias("names"))


def chat_export(pairs: DataFrame, intents: Sequence[str], approved_only: bool) -> DataFrame:
    """Answers fit for training: of a wanted intent, with a graph behind them, not of low confidence, and approved by
    a reviewer, or at least not rejected. ``pairs`` has intent, found, confidence, status."""
    good = F.col("intent").isin(*intents) & F.coalesce("found", F.lit(False)) & (F.coalesce("confidence", F.lit("")) != "low")
    status = F.coalesce("status", F.lit(""))
    return pairs.filter(good & (status == "approved" if approved_only else status != "rejected"))


def learning_queue(answers: DataFrame, newest: Column, scan: int = 500, most: int = 100) -> DataFrame:
    """The newest answers that are worth a label, and why: of the last ``scan`` answers the first ``most`` with a
    negative rating, a low confidence or nothing found. ``answers`` has rating, confidence, found; a report of fixed length."""
    reason = F.when(F.col("rating") == -1, "negative_feedback").when((F.col("confidence") == "low") | ~F.coalesce("found", F.lit(False)), "low_confidence")
    return answers.orderBy(newest.desc()).limit(scan).withColumn("reason", reason).filter("reason IS NOT NULL").orderBy(newest.desc()).limit(most)


def profile(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, n_rows, n_null, n_blank of each column, in one pass over the table."""
    counts = [F.count(F.lit(1)).alias("n_rows")]
    for c in columns:
        counts += [F.count_if(F.col(c).isNull()).alias(f"{c}#null"), F.count_if(F.trim(F.col(c).cast("string")) == "").alias(f"{c}#blank")]
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col("n_rows"), F.col(f"`{c}#null`").alias("n_null"), F.col(f"`{c}#blank`").alias("n_blank")) for c in columns)))
    return table.agg(*counts).select(rows.alias("r")).select("r.*")


def edge_audit(edges: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """edge, n_edges, n_ends, n_orphans: for each named edge table, its column and the nodes that it points to."""
    parts = []
    for name, (rows, column, nodes, key) in edges.items():
        ends = rows.groupBy(F.col(column).alias("end")).agg(F.count(F.lit(1)).alias("n"))
        met = ends.join(nodes.select(F.col(key).alias("key")).distinct(), F.col("end") == F.col("key"), "left")
        parts.append(met.agg(F.lit(name).alias("edge"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_edges"), F.count("end").alias("n_ends"), F.count_if(F.col("key").isNull()).alias("n_orphans")))
    return reduce(DataFrame.unionByName, parts)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table, as reported before all are emptied."""
    return reduce(DataFrame.unionByName, [t.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows")) for name, t in tables.items()])


def probes(relation: DataFrame, asked: DataFrame) -> DataFrame:
    """Whether edges (src, rel_type, dst) are there, and whether that is as expected."""
    there = relation.select("src", "rel_type", "dst", F.lit(True).alias("there")).distinct()
    found = F.coalesce("there", F.lit(False))
    return asked.join(there, ["src", "rel_type", "dst"], "left").select("src", "rel_type", "dst", found.alias("found"), (found == F.col("expected")).alias("passed"))


def from_graph_where_missing(cases: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Cases (gold, an array) with the labels that the graph gives for ``key`` where they have none, and their source."""
    rows = cases.join(labels.select(key, F.col("gold").alias("from_graph")), key, "left")
    own = F.coalesce(F.size("gold") > 0, F.lit(False))
    none = F.array().cast("array<string>")
    return rows.withColumn("source", F.when(own, "given").when(F.col("from_graph").isNotNull(), "graph").otherwise("none")).withColumn("gold", F.when(own, F.col("gold")).otherwise(F.coalesce("from_graph", none))).drop("from_graph")


def apply_reviews(feedback: DataFrame, reviews: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Feedback with the status of its last review (``keys``, status, at); feedback without one keeps its own."""
    last = reviews.groupBy(*keys).agg(F.max_by("status", "at").alias("reviewed"))
    return feedback.join(last, list(keys), "left").withColumn("status", F.coalesce("reviewed", "status")).drop("reviewed")
