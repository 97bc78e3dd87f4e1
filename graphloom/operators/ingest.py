"""Ingest as dataflow: rows of workbooks become nodes and edges. The last row of a key wins, edges need both ends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bare(column: str | Column) -> Column:
    """A cell as trimmed text; a null is empty."""
    cell = F.col(column) if isinstance(column, str) else column
    return F.trim(F.coalesce(cell.cast("string"), F.lit("")))


def merge_supplement(base: DataFrame, extra: DataFrame, key: str, position: Sequence[str]) -> DataFrame:
    """All rows of ``base``, and of ``extra`` those without a key and the first of each key that ``base`` does not have."""
    keyed = extra.filter(bare(key) != "").join(base.filter(bare(key) != "").select(key).distinct(), key, "left_anti")
    place = F.row_number().over(Window.partitionBy(key).orderBy(*position))
    new = keyed.withColumn("first_of_key", place).filter("first_of_key = 1").select(*base.columns)
    return base.unionByName(new).unionByName(extra.filter(bare(key) == "").select(*base.columns))


def append_missing(base: DataFrame, extra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` and the rows of ``extra`` whose key it does not have."""
    return base.unionByName(extra.join(base.select(*keys).distinct(), list(keys), "left_anti").select(*base.columns))


def delete_keys(rows: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), list(keys), "left_anti").select(*rows.columns)


def typed_edges(rows: DataFrame, left: DataFrame, right: DataFrame, ends: tuple[str, str], position: Sequence[str], types: Sequence[str], denied: DataFrame | None = None) -> DataFrame:
    """The edges of ``rows`` (both ends, type_code, properties): rows of a known type code whose ends are not blank,
    not denied and both nodes; of the rows of an edge of one type the last."""
    a, b = ends
    good = rows.filter((bare(a) != "") & (bare(b) != "") & bare("type_code").isin(*types)).withColumn("type_code", bare("type_code"))
    if denied is not None:
        good = good.join(denied.select(a, b).distinct(), [a, b], "left_anti")
    last = F.row_number().over(Window.partitionBy(a, b, "type_code").orderBy(*(F.col(c).desc_nulls_last() for c in position)))
    kept = good.withColumn("from_end", last).filter("from_end = 1").drop("from_end")
    return kept.join(left.select(a).distinct(), a, "left_semi").join(right.select(b, "type_code").distinct(), [b, "type_code"], "left_semi").select(*rows.columns)


def of_relation(rows: DataFrame, wanted: str) -> DataFrame:
    """Rows whose relation type is ``wanted``; a missing type is that one."""
    kind = F.when(F.col("relation_type").isNull(), F.lit(wanted)).otherwise(F.upper(F.trim("relation_type")))
    return rows.filter(kind == wanted)


def dimension_nodes(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """dimension, name: the distinct names of each column, trimmed, without blanks."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), bare(c).alias("name")) for c in columns)))
    return rows.select(cells.alias("x")).select("x.*").filter("name <> ''").distinct()


def dimension_links(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key, dimension, name: the distinct links of rows to those nodes."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), bare(c).alias("name")) for c in columns)))
    return rows.filter(F.col(key).isNotNull()).select(key, cells.alias("x")).select(key, "x.*").filter("name <> ''").distinct()


def row_errors(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """The rows that break a rule of the registry, with errors: no or an unknown relation type; a type code of an end
    that the type does not allow; an end without a code."""
    names = ("from_type_code", "to_type_code", "from_item_code", "to_item_code")
    marked = rows.withColumns({f"cell_{c}": bare(c) for c in names} | {"rel_type": F.upper(bare("relation_type"))})
    # one row a relation type
    joined = marked.join(F.broadcast(registry.select("rel_type", "from_types", "to_types")), "rel_type", "left")
    known, rel = F.col("from_types").isNotNull(), F.col("rel_type")
    rules = [F.when(rel == "", "missing relation_type"), F.when((rel != "") & ~known, F.concat(F.lit("unknown relation_type: "), rel))]
    for end in ("from", "to"):
        code = F.col(f"cell_{end}_type_code")
        rules.append(F.when(known & (code != "") & ~F.array_contains(f"{end}_types", code), F.concat(rel, F.lit(f": {end}_type_code "), code)))
    rules += [F.when(known & (F.col(f"cell_{end}_item_code") == ""), f"missing {end}_item_code") for end in ("from", "to")]
    out = joined.withColumn("errors", F.array_join(F.array_compact(F.array(*rules)), "; ")).filter("errors <> ''")
    return out.select(*rows.columns, "errors")


def types_for_anchor(registry: DataFrame, types: Sequence[str]) -> DataFrame:
    """type_code, rel_type, primary, exposed: the relation types that an anchor of each type code can have."""
    anchors = registry.sparkSession.createDataFrame([(t,) for t in types], "type_code string")
    met = anchors.crossJoin(registry)  # some types by some relations
    has = {c: F.array_contains(c, F.col("type_code")) for c in ("anchor_types", "from_types", "to_types")}
    return met.filter(has["anchor_types"] | has["from_types"] | has["to_types"]).select("type_code", "rel_type", has["anchor_types"].alias("primary"), "exposed")


def upsert_feedback(feedback: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last feedback of each message; a message that was reviewed before waits for review again."""
    last = Window.partitionBy(key).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    kept = feedback.withColumn("from_end", F.row_number().over(last)).filter("from_end = 1").drop("from_end")
    return kept.withColumn("status", F.lit("pending"))
