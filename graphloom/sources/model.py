"""The property graph as typed tables, built from relational source tables.

Node tables: career, competency, course, subject. Edge tables: need (career to competency), teach (course to
competency), relation (competency to competency). Each edge type is a column value, not a table of its own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Relation types, in the order of their numbers.
REL_TYPES = ("BUILT_ON", "VALIDATES", "SUPPORTS", "REQUIRES", "REQUIRES_KNOWLEDGE", "PREFERS_LANG")

#: Type codes of competencies.
TYPE_CODES = ("CT_LANG", "CT_FRAM", "CT_PLAT", "CT_TOOL", "CT_KNOW", "CT_SOFT", "CT_CERT")

#: Registry of relation types. Type codes of the source and the target, those an anchor mainly has, the
#: direction in which an anchor reads the type, whether it orders competencies, whether questions may ask for it.
REGISTRY = (
    ("BUILT_ON", ["CT_FRAM"], ["CT_LANG"], ["CT_FRAM"], "outgoing", True, True),
    ("VALIDATES", ["CT_CERT"], ["CT_PLAT"], ["CT_CERT", "CT_PLAT"], "outgoing", False, True),
    ("SUPPORTS", ["CT_KNOW"], ["CT_LANG"], ["CT_KNOW"], "outgoing", True, True),
    ("REQUIRES", ["CT_SOFT"], ["CT_SOFT"], ["CT_SOFT"], "outgoing", True, True),
    ("REQUIRES_KNOWLEDGE", ["CT_FRAM"], ["CT_KNOW"], ["CT_FRAM"], "outgoing", True, True),
    ("PREFERS_LANG", ["CT_PLAT"], ["CT_LANG"], ["CT_PLAT"], "outgoing", False, False),
)
#: Where the direction depends on the anchor's type.
ANCHOR_DIRECTIONS = (("VALIDATES", "CT_CERT", "outgoing"), ("VALIDATES", "CT_PLAT", "incoming"))

#: Order of priority groups; others come last (999).
PRIORITY = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4, "5-LOW": 5}

#: Order of competency kinds; others come last (99).
KINDS = ("STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY", "PROMO")

#: Type code of each kind.
KIND_TYPES = {"STANDARD": "CT_LANG", "SMALL": "CT_FRAM", "MEDIUM": "CT_PLAT", "LARGE": "CT_KNOW", "ECONOMY": "CT_SOFT", "PROMO": "CT_CERT"}


#: Rows of edges that a task gathers at once, about.
EDGES_A_TASK = 500_000


@dataclass(frozen=True)
class Model:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def career(self) -> DataFrame:
        nation, region = F.broadcast(self.table("nation")), F.broadcast(self.table("region"))
        joined = self.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        return joined.select(F.col("c_custkey").alias("career_code"), F.col("c_name").alias("career_name"), F.col("n_name").alias("industry"), F.col("r_name").alias("taxonomy"))

    @cached_property
    def competency(self) -> DataFrame:
        type_code = F.element_at(F.create_map(*(F.lit(x) for pair in KIND_TYPES.items() for x in pair)), F.col("p_type"))
        return self.table("part").select(
            F.col("p_partkey").alias("item_code"), F.col("p_name").alias("item_name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("subject"), type_code.alias("type_code")
        )

    @cached_property
    def course(self) -> DataFrame:
        nation = F.broadcast(self.table("nation"))
        level = F.when(F.col("s_acctbal") < 0, "beginner").when(F.col("s_acctbal") < 5000, "intermediate").otherwise("advanced")
        pages = self.table("pages").select("page_id", "url")
        # a course without an organisation or a page stays
        joined = self.table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(pages, F.col("s_suppkey") == F.col("page_id"), "left")
        return joined.select(F.col("s_suppkey").alias("course_code"), F.col("s_name").alias("course_name"), F.col("n_name").alias("organization"), level.alias("level"), "url")

    @cached_property
    def seed_course(self) -> DataFrame:
        """Courses that a search by vectors brought up."""
        return self.table("embeddings").filter("label = 1").select(F.col("vec_id").alias("course_code")).distinct()

    @cached_property
    def seed_item(self) -> DataFrame:
        """Competencies that a search by vectors brought up."""
        return self.table("embeddings").filter("label = 0").select(F.col("vec_id").alias("item_code")).distinct()

    @cached_property
    def edge_tasks(self) -> int:
        """How many tasks gather edges: as many as the number of lines asks for, and as a shuffle has at least, so
        that joins take them as they lie. Parquet files tell the number without a pass over the rows."""
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(self.table("lineitem").count() / EDGES_A_TASK))

    @cached_property
    def teach(self) -> DataFrame:
        """One edge a pair; the highest coverage level stays. Few pairs come twice, so lines are dealt as they are, in tasks of a
        bounded size, by the key that courses are joined on."""
        lines = self.table("lineitem").select("l_suppkey", "l_partkey", "l_quantity").repartition(self.edge_tasks, "l_suppkey")
        return lines.groupBy(F.col("l_suppkey").alias("course_code"), F.col("l_partkey").alias("item_code")).agg(F.max(F.col("l_quantity").cast("int")).alias("coverage_level"))

    @cached_property
    def need(self) -> DataFrame:
        """One edge a pair; the most urgent priority group stays. Dealt as ``teach``, by the key that competencies are joined on."""
        lines = self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        lines = lines.select("o_custkey", "l_partkey", "o_orderpriority").repartition(self.edge_tasks, "l_partkey")
        return lines.groupBy(F.col("o_custkey").alias("career_code"), F.col("l_partkey").alias("item_code")).agg(F.min("o_orderpriority").alias("priority_group"))

    @cached_property
    def relation(self) -> DataFrame:
        """Competencies that follow each other inside an order."""
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
        pairs = self.table("lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"))
        types = F.element_at(F.array(*map(F.lit, REL_TYPES)), (F.pmod("src", F.lit(6)) + 1).cast("int"))
        return pairs.filter(F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))).distinct().select("src", "dst", types.alias("rel_type"))

    @cached_property
    def known(self) -> DataFrame:
        """Competencies that a person on the way to a career has."""
        bought = self.table("events").filter(F.col("event_type") == "purchase")
        # keys of competencies are gapless from 0; one in 25 events names one that there is not
        n_items = F.broadcast(self.table("part").agg(F.count(F.lit(1)).alias("n_items")))
        code = F.when(F.col("event_id") % 25 == 0, F.col("n_items") + F.col("event_id")).otherwise(F.pmod("event_id", F.col("n_items")))
        return bought.crossJoin(n_items).select(F.col("user_id").alias("career_code"), code.alias("item_code")).distinct()

    @cached_property
    def registry(self) -> DataFrame:
        schema = "rel_type string, from_types array<string>, to_types array<string>, anchor_types array<string>, direction string, ordering boolean, exposed boolean"
        return self.spark.createDataFrame(list(REGISTRY), schema)

    @cached_property
    def anchor_direction(self) -> DataFrame:
        """The direction in which an anchor of each type reads each relation type."""
        types = self.spark.createDataFrame([(t,) for t in TYPE_CODES], "type_code string")
        special = self.spark.createDataFrame(list(ANCHOR_DIRECTIONS), "rel_type string, type_code string, special string")
        rows = self.registry.select("rel_type", "direction").crossJoin(types).join(special, ["rel_type", "type_code"], "left")
        return rows.select("rel_type", "type_code", F.coalesce("special", "direction").alias("direction"))


_REL = " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(REL_TYPES))

#: The same tables as SQL, for common table expressions.
MODEL_SQL = f"""
career AS (SELECT c_custkey AS career_code, c_name AS career_name, n_name AS industry, r_name AS taxonomy
           FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
competency AS (SELECT p_partkey AS item_code, p_name AS item_name, p_type AS kind, p_brand AS subject,
                      CASE p_type WHEN 'STANDARD' THEN 'CT_LANG' WHEN 'SMALL' THEN 'CT_FRAM' WHEN 'MEDIUM' THEN 'CT_PLAT' WHEN 'LARGE' THEN 'CT_KNOW'
                                  WHEN 'ECONOMY' THEN 'CT_SOFT' WHEN 'PROMO' THEN 'CT_CERT' END AS type_code FROM part),
course AS (SELECT s_suppkey AS course_code, s_name AS course_name, n_name AS organization,
                  CASE WHEN s_acctbal < 0 THEN 'beginner' WHEN s_acctbal < 5000 THEN 'intermediate' ELSE 'advanced' END AS level, url
           FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN pages ON s_suppkey = page_id),
seed_course AS (SELECT DISTINCT vec_id AS course_code FROM embeddings WHERE label = 1),
seed_item AS (SELECT DISTINCT vec_id AS item_code FROM embeddings WHERE label = 0),
teach AS (SELECT l_suppkey AS course_code, l_partkey AS item_code, max(CAST(trunc(l_quantity) AS INT)) AS coverage_level
          FROM lineitem GROUP BY 1, 2),
need AS (SELECT o_custkey AS career_code, l_partkey AS item_code, min(o_orderpriority) AS priority_group
         FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
relation AS (SELECT DISTINCT src, dst, CASE src % 6 {_REL} END AS rel_type
             FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst
                   FROM lineitem) WHERE dst IS NOT NULL AND src <> dst),
known AS (SELECT DISTINCT user_id AS career_code, CASE WHEN event_id % 25 = 0 THEN event_id + (SELECT count(*) FROM part) ELSE event_id % (SELECT count(*) FROM part) END AS item_code
          FROM events WHERE event_type = 'purchase'),
registry AS (SELECT * FROM (VALUES
    ('BUILT_ON', ['CT_FRAM'], ['CT_LANG'], ['CT_FRAM'], true, true), ('VALIDATES', ['CT_CERT'], ['CT_PLAT'], ['CT_CERT', 'CT_PLAT'], false, true),
    ('SUPPORTS', ['CT_KNOW'], ['CT_LANG'], ['CT_KNOW'], true, true), ('REQUIRES', ['CT_SOFT'], ['CT_SOFT'], ['CT_SOFT'], true, true),
    ('REQUIRES_KNOWLEDGE', ['CT_FRAM'], ['CT_KNOW'], ['CT_FRAM'], true, true), ('PREFERS_LANG', ['CT_PLAT'], ['CT_LANG'], ['CT_PLAT'], false, false))
    AS t(rel_type, from_types, to_types, anchor_types, ordering, exposed))
"""
