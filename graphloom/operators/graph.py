"""Pattern queries over the graph: every function answers for all anchors at once; a single lookup is a filter on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators.lineage import Steps
from graphloom.sources.model import KINDS, PRIORITY


def rank_of(column: Column, order: Sequence[str] | dict[str, int], other: int) -> Column:
    """The place of a value in a fixed order."""
    places = order if isinstance(order, dict) else {v: i for i, v in enumerate(order)}
    out = F.lit(other)
    for value, place in places.items():
        out = F.when(column == value, F.lit(place)).otherwise(out)
    return out


def priority_rank(column: Column, strict_numeric: bool = False) -> Column:
    """Rank of a priority group. With ``strict_numeric`` only whole numbers count, all else is 999."""
    return F.coalesce(column.try_cast("int"), F.lit(999)) if strict_numeric else rank_of(column, PRIORITY, 999)


def seeded(rows: DataFrame, seeds: DataFrame | None, key: str) -> DataFrame:
    """``rows`` with a flag is_seed: whether ``seeds`` holds the key; without seeds none is."""
    if seeds is None:
        return rows.withColumn("is_seed", F.lit(False))
    return rows.join(seeds.select(key).distinct().withColumn("is_seed", F.lit(True)), key, "left").fillna(False, ["is_seed"])


def skill_order(strict_numeric: bool = False) -> list[Column]:
    """Seeds first, then by priority, kind and name."""
    return [F.desc("is_seed"), priority_rank(F.col("priority_group"), strict_numeric), rank_of(F.col("kind"), KINDS, 99), F.col("item_name").asc_nulls_last(), F.col("item_code")]


def pathfinding(career: DataFrame, need: DataFrame, competency: DataFrame, k: int, per_kind: bool = False, seeds: DataFrame | None = None) -> DataFrame:
    """The first ``k`` required competencies of each career, or of each career and kind, and found: a career without
    any stays, as one row without a competency."""
    return first_skills(career, seeded(need.join(competency, "item_code"), seeds, "item_code"), k, per_kind)


def first_skills(career: DataFrame, rows: DataFrame, k: int, per_kind: bool = False) -> DataFrame:
    """``pathfinding`` on needs that have the columns of their competencies and is_seed."""
    keys = ["career_code", "kind"] if per_kind else ["career_code"]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*skill_order()))).filter(F.col("rank") <= k)
    joined = career.join(ranked, "career_code", "left")
    return joined.select("career_code", "career_name", "industry", "rank", "item_code", "item_name", "kind", "priority_group", F.coalesce("is_seed", F.lit(False)).alias("is_seed"))


def course_order() -> list[Column]:
    """Courses with a page of their own first, then the highest coverage, seeds, names."""
    return [F.col("generic"), F.coalesce("coverage_level", F.lit(0)).desc(), F.desc("is_seed"), F.coalesce("course_name", F.lit("")), F.col("course_code")]


def top_courses(teach: DataFrame, course: DataFrame, k: int, seeds: DataFrame | None = None) -> DataFrame:
    """The first ``k`` courses of each competency."""
    # the order of courses by URL, seed and name is found once a course, not once an edge
    known = seeded(course, seeds, "course_code").withColumn("generic", T.is_generic_url(F.col("url"))).drop("url")
    return first_courses(teach.join(known, "course_code"), k)


def first_courses(rows: DataFrame, k: int) -> DataFrame:
    """``top_courses`` on edges that have the columns of their courses, generic and is_seed."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item_code").orderBy(*course_order())))
    return ranked.filter(F.col("rank") <= k).select("item_code", "rank", "course_code", "course_name", "organization", "level", "coverage_level", "is_seed")


def course_fallback(teach: DataFrame, course: DataFrame, competency: DataFrame, relation: DataFrame, least: int, k: int) -> DataFrame:
    """For competencies without a course of coverage ``least``: the courses of what they are built on."""
    good = teach.filter(F.col("coverage_level") >= least)
    bare = competency.select("item_code").join(good.select("item_code").distinct(), "item_code", "left_anti")
    base = relation.filter(F.col("rel_type") == "BUILT_ON").select(F.col("src").alias("item_code"), F.col("dst").alias("via_code"))
    rows = bare.join(base, "item_code").join(good.withColumnRenamed("item_code", "via_code"), "via_code").join(course, "course_code")
    order = Window.partitionBy("item_code").orderBy(F.desc("coverage_level"), "course_name", "course_code", "via_code")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_code", "rank", "via_code", "course_code", "course_name", "coverage_level")


def career_skill_courses(need: DataFrame, teach: DataFrame, course: DataFrame, k: int, seeds: DataFrame | None = None) -> DataFrame:
    """Career to competency to course. The courses of a competency do not depend on the career, so they are cut to
    ``k`` before the join."""
    return need.select("career_code", "item_code").join(top_courses(teach, course, k, seeds), "item_code").select("career_code", "item_code", "rank", "course_code", "course_name", "coverage_level")


def subject_careers(competency: DataFrame, teach: DataFrame, need: DataFrame, career: DataFrame, k: int) -> DataFrame:
    """Careers that need competencies of a subject that some course teaches: the first ``k`` of each subject."""
    taught = competency.select("item_code", "subject").join(teach.select("item_code").distinct(), "item_code")
    rows = taught.join(need, "item_code").groupBy("subject", "career_code").agg(F.count(F.lit(1)).alias("n_items"))
    order = Window.partitionBy("subject").orderBy(F.desc("n_items"), "career_code")
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(career, "career_code").select("subject", "rank", "career_code", "career_name", "n_items")


def neighbourhood(relation: DataFrame) -> DataFrame:
    """item_code, direction, rel_type, other_code: each edge seen from both ends."""
    ends = (("src", "outgoing", "dst"), ("dst", "incoming", "src"))
    seen = [F.struct(F.col(own).alias("item_code"), F.lit(direction).alias("direction"), F.col("rel_type").alias("rel_type"), F.col(other).alias("other_code")) for own, direction, other in ends]
    return relation.select(F.inline(F.array(*seen)))


def relation_coverage_of_items(competency: DataFrame, relation: DataFrame, directions: DataFrame) -> DataFrame:
    """Edges in the direction in which a competency of its type reads them (``directions``: rel_type, type_code,
    direction) and against it: full, partial or none."""
    return covered_items(competency, read_edges(competency, relation, directions))


def read_edges(competency: DataFrame, relation: DataFrame, directions: DataFrame) -> DataFrame:
    """item_code, direction, rel_type, other_code, is_read: each edge from both ends, and whether that end reads it so."""
    typed = neighbourhood(relation).join(competency.select("item_code", "type_code"), "item_code")
    # one row a relation type and type code
    edges = typed.join(F.broadcast(directions.withColumnRenamed("direction", "read_direction")), ["rel_type", "type_code"])
    return edges.select("item_code", "direction", "rel_type", "other_code", (F.col("read_direction") == F.col("direction")).alias("is_read"))


def covered_items(competency: DataFrame, edges: DataFrame) -> DataFrame:
    """``relation_coverage_of_items`` on the edges of ``read_edges``."""
    read = F.col("is_read")
    counts = edges.groupBy("item_code").agg(F.count_if(read).alias("n_read"), F.count_if(~read).alias("n_against"))
    joined = competency.select("item_code", "item_name").join(counts, "item_code", "left").fillna(0, ["n_read", "n_against"])
    coverage = F.when(F.col("n_read") > 0, "full").when(F.col("n_against") > 0, "partial").otherwise("none")
    return joined.withColumn("coverage", coverage)


def prerequisites(items: DataFrame, relation: DataFrame, registry: DataFrame, competency: DataFrame) -> DataFrame:
    """What the competencies in ``items`` (item_code) are ordered after."""
    ordering = relation.join(F.broadcast(registry.filter("ordering").select("rel_type")), "rel_type")
    named = competency.select(F.col("item_code").alias("dst"), F.col("item_name").alias("prerequisite_name"))
    rows = items.select("item_code").distinct().join(ordering, F.col("item_code") == F.col("src")).join(named, "dst")
    return rows.select("item_code", "rel_type", F.col("dst").alias("prerequisite_code"), "prerequisite_name")


def gap_split(need: DataFrame, known: DataFrame, missing: bool) -> DataFrame:
    """Needs of the careers that have known competencies: those known, or those missing."""
    mine = need.join(known.select("career_code").distinct(), "career_code", "left_semi")
    return mine.join(known, ["career_code", "item_code"], "left_anti" if missing else "left_semi").select("career_code", "item_code", "priority_group")


def gap_by_kind(need: DataFrame, known: DataFrame, competency: DataFrame) -> DataFrame:
    """Known and missing competencies by career and kind, in one pass over all kinds."""
    mine = need.join(known.select("career_code").distinct(), "career_code", "left_semi")
    flagged = mine.join(known.withColumn("has", F.lit(True)), ["career_code", "item_code"], "left").join(competency.select("item_code", "kind"), "item_code")
    return flagged.groupBy("career_code", "kind").agg(F.count_if(F.col("has")).alias("n_known"), F.count_if(F.col("has").isNull()).alias("n_missing"))


def coverage_ratio(need: DataFrame, relation: DataFrame, threshold: float) -> DataFrame:
    """Share of the needed competencies that have outgoing relations, against a gate."""
    needed = need.select("item_code").distinct()
    flagged = needed.join(relation.select(F.col("src").alias("item_code")).distinct().withColumn("has", F.lit(1)), "item_code", "left")
    out = flagged.agg(F.count(F.lit(1)).alias("n_items"), F.count("has").alias("n_covered"))
    ratio = F.round(F.col("n_covered") / F.greatest("n_items", F.lit(1)), 6)
    return out.select("n_items", "n_covered", ratio.alias("ratio"), (ratio >= threshold).alias("passed"))


def dangling(edges: DataFrame, column: str, nodes: DataFrame, key: str) -> DataFrame:
    """Edges whose end is not a node."""
    return edges.join(nodes.select(F.col(key).alias(column)), column, "left_anti")


def duplicate_keys(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def upsert_latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key."""
    last = Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return rows.withColumn("__rn", F.row_number().over(last)).filter("__rn = 1").drop("__rn")


def short_cycles(edges: DataFrame) -> DataFrame:
    """Cycles of two to four edges (src, dst), each from its smallest node: length, nodes."""
    e = edges.select("src", "dst").distinct()
    paths = e.filter(F.col("src") < F.col("dst")).select(F.array("src", "dst").alias("nodes"), F.col("dst").alias("at"))
    found = None
    for _ in range(3):
        grown = paths.join(e.select(F.col("src").alias("at"), F.col("dst").alias("then")), "at")
        start = F.col("nodes")[0]
        closed = grown.filter(F.col("then") == start).select(F.size("nodes").alias("length"), F.array_join(F.col("nodes").cast("array<string>"), ">").alias("nodes"))
        found = closed if found is None else found.unionByName(closed)
        paths = grown.filter((F.col("then") > start) & ~F.array_contains("nodes", F.col("then"))).select(F.concat("nodes", F.array("then")).alias("nodes"), F.col("then").alias("at"))
    return found


def contracted(edges: DataFrame, steps: Steps) -> tuple[DataFrame, list[DataFrame]]:
    """What is left of ``edges`` (src, dst) where ends are trimmed and chains are cut short; and for each round the nodes taken
    out of chains (node, before, after).

    A node that nothing leads to, or that leads nowhere, is on no cycle. A node with one edge in and one out is on a cycle if its
    neighbours are on one together; those whose hash is the least among its neighbours go in one round, about a third, so a
    chain of n nodes takes as many rounds as the logarithm of n."""
    now, rounds = steps.keep(edges.select("src", "dst").distinct().filter("src <> dst")), []
    while True:
        out = now.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_out"), F.min("dst").alias("after"))
        into = now.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in"), F.min("src").alias("before"))
        nodes = steps.keep(out.join(into, "node", "full"))
        ends = nodes.filter("n_in is null or n_out is null").select("node")
        order = F.struct(F.xxhash64("node", F.lit(len(rounds))).alias("h"), "node")
        chain = nodes.filter("n_in = 1 and n_out = 1").select("node", "before", "after", order.alias("own"))
        around = [chain.select(F.col("node").alias(c), F.col("own").alias(f"own_{c}")) for c in ("before", "after")]
        placed = chain.join(around[0], "before", "left").join(around[1], "after", "left")
        least = F.coalesce(F.col("own") < F.col("own_before"), F.lit(True)) & F.coalesce(F.col("own") < F.col("own_after"), F.lit(True))
        taken = steps.keep(placed.filter(least).select("node", "before", "after"))
        gone = ends.unionByName(taken.select("node"))
        if gone.isEmpty():
            steps.drop(nodes, taken)
            return now, rounds
        joined = now.unionByName(taken.select(F.col("before").alias("src"), F.col("after").alias("dst"))).filter("src <> dst")
        rest = joined.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        then = steps.keep(rest.select("src", "dst").distinct())
        steps.drop(nodes, now)
        rounds.append(taken)
        now = then


def nodes_on_cycles(edges: DataFrame) -> DataFrame:
    """item_code, component of every node on a cycle of any length: the smallest node of its strongly connected part.

    Ends are trimmed and chains contracted. In what is left each node spreads the smallest node that reaches it, and the smallest
    that it reaches; where both are one node the node is in that part. Parts that are settled leave, the rest goes on. Then the
    nodes of chains come back, last ones first. Tables of single rounds are removed."""
    steps = Steps(edges.sparkSession)
    left, rounds = contracted(edges, steps)
    kind = edges.schema["src"].dataType.simpleString()
    found = steps.keep(left.select(F.col("src").alias("node"), F.col("src").alias("part")).limit(0))
    while not left.isEmpty():
        ahead, back = _spread(left, "src", "dst", steps), _spread(left, "dst", "src", steps)
        own = ahead.withColumnRenamed("least", "a").join(back.withColumnRenamed("least", "b"), "node")
        settled = steps.keep(own.filter("a = b").select("node", F.col("a").alias("part")))
        # a part of one node is no cycle
        more = settled.join(settled.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("part"), "part").select("node", "part")
        found = steps.keep(found.unionByName(more))
        rest = left.join(settled.select(F.col("node").alias("src")), "src", "left_anti").join(settled.select(F.col("node").alias("dst")), "dst", "left_anti")
        left, again = contracted(rest.select("src", "dst"), steps)
        rounds += again
    for taken in reversed(rounds):
        # a loop is a cycle of a node and nodes that were taken out
        loops = taken.filter("before = after").select(F.col("before").alias("node")).distinct()
        alone = loops.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("part"))
        known = found.unionByName(alone)
        sides = taken.join(known.select(F.col("node").alias("before"), F.col("part").alias("p")), "before").join(known.select(F.col("node").alias("after"), F.col("part").alias("q")), "after")
        before = found
        found = steps.keep(known.unionByName(sides.filter("p = q").select("node", F.col("p").alias("part"))))
        steps.drop(before, taken)
    least = found.groupBy("part").agg(F.min("node").alias("component"))
    named = steps.keep(found.join(least, "part").select(F.col("node").cast(kind).alias("item_code"), "component"))
    steps.drop_all(named)
    return named


def _spread(edges: DataFrame, start: str, end: str, steps: Steps) -> DataFrame:
    """node, least: the smallest node that reaches it along the edges, itself included. A node also takes what reaches its least
    node, so labels jump ahead."""
    now = steps.keep(edges.select(F.col(start).alias("node")).unionByName(edges.select(F.col(end).alias("node"))).distinct().withColumn("least", F.col("node")))
    total = None
    while True:
        told = edges.join(now.withColumnRenamed("node", start), start).select(F.col(end).alias("node"), "least")
        jumped = now.select("node", F.col("least").alias("via")).join(now.select(F.col("node").alias("via"), "least"), "via").select("node", "least")
        then = steps.keep(now.unionByName(told).unionByName(jumped).groupBy("node").agg(F.min("least").alias("least")))
        steps.drop(now)
        now, before, total = then, total, then.agg(F.sum(F.col("least").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return now


def topological_order(nodes: DataFrame, edges: DataFrame, group: str) -> DataFrame:
    """Kahn's order inside each group: ``nodes`` (group, item_code, item_name, sort_rank), ``edges`` (item_code after
    prerequisite_code) kept where both ends are in the group. Of the nodes that are free the smallest (sort_rank,
    item_name, item_code) comes first. A group without such edges or with a cycle keeps its order by that key.

    One group is one career's gap, which is bounded by the catalogue, not by the data."""
    import heapq

    import pandas as pd

    inside = nodes.select(group, "item_code").join(edges, "item_code")
    inside = inside.join(nodes.select(group, F.col("item_code").alias("prerequisite_code")), [group, "prerequisite_code"])
    after = inside.groupBy(group, "item_code").agg(F.collect_set("prerequisite_code").alias("after"))
    plain = Window.partitionBy(group).orderBy("sort_rank", "item_name", "item_code")
    rows = nodes.withColumn("place", F.row_number().over(plain)).join(after, [group, "item_code"], "left").select(group, "item_code", "place", "after")

    def order(frame: pd.DataFrame) -> pd.DataFrame:
        codes = dict(zip(frame["place"], frame["item_code"], strict=True))
        waits = {c: set(a) if a is not None else set() for c, a in zip(frame["item_code"], frame["after"], strict=True)}
        places, frees = {c: p for p, c in codes.items()}, {}
        for c, a in waits.items():
            for p in a:
                frees.setdefault(p, []).append(c)
        heap, done = [places[c] for c, a in waits.items() if not a], []
        heapq.heapify(heap)
        while heap:
            code = codes[heapq.heappop(heap)]
            done.append(code)
            for c in frees.get(code, ()):
                waits[c].discard(code)
                if not waits[c]:
                    heapq.heappush(heap, places[c])
        if len(done) < len(codes):
            done = [codes[p] for p in sorted(codes)]
        return pd.DataFrame({group: frame[group].iloc[0], "item_code": done, "position": range(1, len(done) + 1)})

    return rows.groupBy(group).applyInPandas(order, f"{group} long, item_code long, position int")


def month_allocation(courses: DataFrame, group: str, months: int) -> DataFrame:
    """``courses`` (group, rank, course_code) dealt to months in turn: month i gets those of rank i, i + months, ..."""
    return courses.select(group, "course_code", "rank", (F.pmod(F.col("rank") - 1, F.lit(months)) + 1).cast("int").alias("month"))


def chunk_months(rows: DataFrame, group: str, order: Sequence[str], months: int) -> DataFrame:
    """Rows of each group cut in order into at most ``months`` chunks of ceil(n / months)."""
    window = Window.partitionBy(group)
    n = F.count(F.lit(1)).over(window)
    place = F.row_number().over(window.orderBy(*order))
    return rows.withColumn("month", (F.floor((place - 1) / F.ceil(n / months)) + 1).cast("int"))


def weak_skills(need: DataFrame, known: DataFrame, competency: DataFrame, missing: DataFrame, k: int = 3) -> DataFrame:
    """Of the known needs of a career the first ``k`` by priority and name whose names are not missing."""
    names = competency.select("item_code", "item_name")
    gone = missing.join(names, "item_code").select("career_code", F.lower(F.trim("item_name")).alias("low")).distinct()
    mine = need.join(known, ["career_code", "item_code"], "left_semi").join(names, "item_code").withColumn("low", F.lower(F.trim("item_name")))
    order = Window.partitionBy("career_code").orderBy(priority_rank(F.col("priority_group")), "item_name", "item_code")
    ranked = mine.join(gone, ["career_code", "low"], "left_anti").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("career_code", "rank", "item_code", "item_name")


def context_lines(career: DataFrame, need: DataFrame, competency: DataFrame, courses: DataFrame, skills: int = 12, most_courses: int = 8) -> DataFrame:
    """career_code, context: a line a kind with its first skills, and a line of the courses that teach what is needed."""
    rows = need.join(competency, "item_code")
    order = Window.partitionBy("career_code", "kind").orderBy(priority_rank(F.col("priority_group")), "item_name", "item_code")
    first = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= skills)
    kinds = first.groupBy("career_code", "kind").agg(F.array_sort(F.collect_list(F.struct("rank", "item_name"))).alias("s"))
    lines = kinds.select("career_code", rank_of(F.col("kind"), KINDS, 99).alias("place"), F.concat("kind", F.lit(": "), F.array_join(F.transform("s", lambda x: x["item_name"]), ", ")).alias("line"))
    named = need.select("career_code", "item_code").join(courses.select("item_code", "course_name"), "item_code").select("career_code", "course_name").distinct()
    by_name = F.row_number().over(Window.partitionBy("career_code").orderBy("course_name"))
    some = named.withColumn("rn", by_name).filter(F.col("rn") <= most_courses).groupBy("career_code").agg(F.concat(F.lit("Courses: "), F.array_join(F.array_sort(F.collect_list("course_name")), ", ")).alias("line"))
    everything = lines.unionByName(some.select("career_code", F.lit(1000).alias("place"), "line"))
    joined = everything.groupBy("career_code").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("l"))
    return career.join(joined, "career_code", "left").select("career_code", F.concat_ws("\n", "career_name", F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("context"))


def allocate_months(courses: DataFrame, topics: DataFrame, group: str, months: int, per_month: int) -> DataFrame:
    """group, month, place, title: the courses of a plan. ``courses``: group, skill, place, title in the order of the
    pool; ``topics``: group, month (from 0), topic.

    A month takes courses of the skills that its topics match, at most ``per_month``; if none matches, those of the
    skill of its number; then unused courses of the pool, from where the month before stopped. One group is one
    person's plan, which is small."""
    import pyarrow as pa

    def plan(key: tuple, pool: pa.Table, wanted: pa.Table) -> pa.Table:
        rows = sorted(zip(*(pool.column(c).to_pylist() for c in ("place", "skill", "title")), strict=True), key=lambda r: (r[0] is None, r[0] or 0))
        titles, of_skill, topics, cursor, out = [r[2] for r in rows], {}, {}, 0, []
        for _, skill, title in rows:
            of_skill.setdefault(skill, {})[title] = None
        for month, topic in zip(wanted.column("month").to_pylist(), wanted.column("topic").to_pylist(), strict=True):
            topics.setdefault(month, []).append(topic)
        skills = list(of_skill)
        for month in range(months):
            taken: dict[str, None] = {}
            for topic in topics.get(month, ()):
                for skill in skills:
                    # a word of a topic is a part of it
                    if skill and topic and (skill in topic or topic in skill):
                        taken |= of_skill[skill]
            if not taken and skills:
                taken = of_skill[skills[min(month, len(skills) - 1)]]
            chosen = list(taken)[:per_month]
            while len(chosen) < per_month and cursor < len(titles):
                if titles[cursor] not in chosen:
                    chosen.append(titles[cursor])
                cursor += 1
            out += [(month, place, title) for place, title in enumerate(chosen)]
        columns = [pa.array([key[0].as_py()] * len(out), pa.int64()), *(pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string())))]
        return pa.table(columns, [group, "month", "place", "title"])

    low = courses.select(group, F.lower("skill").alias("skill"), "place", F.lower("title").alias("title"))
    asked = topics.select(F.col(group).alias("asked_by"), F.col("month").alias("month"), F.lower("topic").alias("topic"))
    # both sides come from one table: fresh names keep their columns apart
    low = low.toDF(group, "skill", "place", "title")
    return low.groupBy(group).cogroup(asked.groupBy("asked_by")).applyInArrow(plan, f"{group} long, month int, place int, title string")


def overlay_urls(listed: DataFrame, known: DataFrame) -> DataFrame:
    """key, title, url of listed courses (key, title, url) with the page of the graph's course (title, url, position) of
    that title, else of the first whose title holds it or is held by it; a generic URL of a course without one goes."""
    from graphloom.operators.resolve import containing

    asked = listed.withColumn("low", F.lower(F.trim(F.coalesce("title", F.lit("")))))
    first = known.withColumn("graph_low", F.lower(F.trim("title"))).filter("graph_low <> ''").groupBy("graph_low").agg(F.min_by(F.struct("url", "position"), "position").alias("b")).select("graph_low", "b.*")
    texts = asked.select("low").distinct().filter("low <> ''")
    exact = texts.join(first, F.col("low") == F.col("graph_low")).select("low", F.col("url").alias("found"))
    rest = texts.join(exact.select("low"), "low", "left_anti")
    part = containing(rest, first.select("graph_low", "url", "position"), "low", "graph_low").select("low", "url", "position")
    whole = containing(first, rest, "graph_low", "low").select("low", "url", "position")
    near = part.unionByName(whole).groupBy("low").agg(F.min_by("url", "position").alias("found"))
    met = asked.join(exact.unionByName(near), "low", "left")
    return met.select("key", "title", F.coalesce(F.nullif(F.trim("found"), F.lit("")), F.when(~T.is_generic_url(F.col("url")), F.col("url"))).alias("url"))


def distinct_names(rows: DataFrame, name: str) -> DataFrame:
    """The different names, trimmed, without blank ones."""
    return rows.select(F.trim(name).alias(name)).filter(F.col(name) != "").distinct()


def course_entries(course: DataFrame, teach: DataFrame, competency: DataFrame) -> DataFrame:
    """Every course with its organization, level and the names of what it teaches, in order; none are an empty text."""
    named = teach.select("course_code", "item_code").join(competency.select("item_code", "item_name"), "item_code")
    taught = named.groupBy("course_code").agg(F.array_join(F.array_sort(F.collect_set("item_name")), ", ").alias("teaches"))
    rows = course.join(taught, "course_code", "left")
    return rows.select("course_code", "course_name", F.coalesce("organization", F.lit("")).alias("organization"), F.coalesce("level", F.lit("")).alias("level"), F.coalesce("teaches", F.lit("")).alias("teaches"))


def known_by_type(known: DataFrame, competency: DataFrame) -> DataFrame:
    """The names of what each person knows, by type code, in order; codes that there are not are left out."""
    named = known.join(competency.select("item_code", "item_name", "type_code"), "item_code")
    return named.groupBy("career_code", "type_code").agg(F.array_sort(F.collect_set("item_name")).alias("names"))


def gap_of_types(gap: DataFrame, competency: DataFrame, types: Sequence[str], k: int) -> DataFrame:
    """The first ``k`` missing competencies of some types for each career, by priority and name."""
    rows = gap.join(competency.filter(F.col("type_code").isin(*types)).select("item_code", "item_name", "type_code"), "item_code")
    order = Window.partitionBy("career_code").orderBy(priority_rank(F.col("priority_group")), "item_name", "item_code")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("career_code", "rank", "item_code", "item_name", "type_code")
