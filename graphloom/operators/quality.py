"""Scores of answers against gold sets and contexts: all cases in one plan, by set operations on arrays of labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T

#: Policies for answers that mention nothing.
LEGACY_ONE, EXCLUDE, PENALIZE = "legacy_one", "exclude", "penalize"


def labels(values: Column) -> Column:
    """The distinct labels of an array of names, without empty ones."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), T.label), lambda x: x != ""))


def cited(reply: Column) -> Column:
    """Labels of the course codes that a reply cites in brackets."""
    return labels(F.regexp_extract_all(F.coalesce(reply, F.lit("")), F.lit(r"(?i)\[Course:\s*([^\]]+)\]"), 1))


def mentions(reply: Column, vocabulary: Column) -> Column:
    """The labels of a vocabulary, of two characters or more, that a reply holds, and the codes that it cites."""
    low = T.label(reply)
    found = F.filter(vocabulary, lambda v: (F.length(v) >= 2) & low.contains(v))
    return F.when(F.coalesce(reply, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_union(found, cited(reply)))


def share_in(values: Column, allowed: Column) -> Column:
    """Share of the values that are allowed; null without any value."""
    return F.when(F.size(values) > 0, F.size(F.array_intersect(values, allowed)) / F.size(values))


def set_recall(predicted: Column, gold: Column) -> Column:
    return F.when(F.size(gold) == 0, 1.0).otherwise(F.size(F.array_intersect(predicted, gold)) / F.size(gold))


def set_f1(predicted: Column, gold: Column) -> Column:
    both, n, g = F.size(F.array_intersect(predicted, gold)), F.size(predicted), F.size(gold)
    return F.when((n == 0) & (g == 0), 1.0).when((n == 0) | (g == 0), 0.0).otherwise(2 * both / (n + g))


def code_recall(predicted: Column, gold: Column) -> Column:
    """Recall of codes, compared in upper case without label rules."""

    def codes(values: Column) -> Column:
        return F.array_distinct(F.filter(F.transform(values, lambda x: F.upper(F.trim(x))), lambda x: x != ""))

    return set_recall(codes(predicted), codes(gold))


def claim_rate(reply: Column, allowed: Column) -> Column:
    """Share of the sentences with two mentions or more of allowed labels or cited codes in which all are allowed; null
    if nothing is allowed or no sentence makes such a claim."""
    claims = F.filter(F.transform(T.sentences(reply), lambda s: mentions(s, allowed)), lambda m: F.size(m) >= 2)
    good = F.filter(claims, lambda m: F.size(F.array_except(m, allowed)) == 0)
    return F.when((F.size(allowed) > 0) & (F.size(claims) > 0), F.size(good) / F.size(claims))


def prepared(cases: DataFrame) -> DataFrame:
    """``cases`` (reply; predicted, gold, graph_context, vector_context: arrays of names) with labels and mentions."""
    names = ("predicted", "gold", "graph_context", "vector_context")
    rows = cases.withColumns({c: labels(F.col(c)) for c in names})
    rows = rows.withColumn("full_context", F.array_union("graph_context", "vector_context"))
    vocabulary = F.array_union(F.array_union("full_context", "predicted"), F.col("gold"))
    rows = rows.withColumn("mentioned", mentions(F.col("reply"), vocabulary))
    return rows.withColumn("mentioned", F.when(F.size("mentioned") > 0, F.col("mentioned")).otherwise(F.col("predicted")))


def scores_v1(cases: DataFrame, keys: Sequence[str], policy: str = LEGACY_ONE, empty_reply_penalty: bool = False, min_chars: int = 8) -> DataFrame:
    """faithfulness, skill_accuracy, hallucination_rate, n_mentions, n_hallucinated against the joint context."""
    rows = prepared(cases)
    n, hits = F.size("mentioned"), F.size(F.array_intersect("mentioned", "full_context"))
    one = F.lit(policy == LEGACY_ONE)
    if empty_reply_penalty:
        one = one & (F.length(F.trim(F.coalesce("reply", F.lit("")))) >= min_chars)
    return rows.select(
        *keys,
        F.round(F.when(n > 0, hits / n).when(one, 1.0).otherwise(0.0), 6).alias("faithfulness"),
        F.round(set_f1(F.col("predicted"), F.col("gold")), 6).alias("skill_accuracy"),
        F.round(F.when(n > 0, (n - hits) / n).otherwise(0.0), 6).alias("hallucination_rate"),
        n.alias("n_mentions"),
        (n - hits).alias("n_hallucinated"),
        (n == 0).alias("no_mention_case"),
    )


V2_SCORES = ("ontology_f1", "answer_entity_f1", "full_grounding_rate", "graph_grounding_rate", "exclusive_graph_rate", "vector_only_rate", "hallucination_rate", "code_recall", "claim_grounding_rate")


def scores_v2(cases: DataFrame, keys: Sequence[str], policy: str = PENALIZE) -> DataFrame:
    """Scores with separate contexts. Rates are null for an answer without mentions (1, 1, 0, 0 by the legacy policy);
    a mention outside the graph's context counts as hallucinated."""
    raw = cases.withColumns({"raw_predicted": F.col("predicted"), "raw_gold": F.col("gold")})
    rows = prepared(raw)
    some = F.size("mentioned") > 0
    m, graph, vector = F.col("mentioned"), F.col("graph_context"), F.col("vector_context")

    def rate(value: Column, legacy: float) -> Column:
        return F.when(some, value).otherwise(F.lit(legacy) if policy == LEGACY_ONE else F.lit(None).cast("double"))

    in_graph = share_in(m, graph)
    values = {
        "ontology_f1": set_f1(F.col("predicted"), F.col("gold")),
        "answer_entity_f1": set_f1(m, F.col("gold")),
        "full_grounding_rate": rate(share_in(m, F.col("full_context")), 1.0),
        "graph_grounding_rate": rate(in_graph, 1.0),
        "exclusive_graph_rate": rate(share_in(m, F.array_except(graph, vector)), 0.0),
        "vector_only_rate": rate(share_in(m, F.array_except(vector, graph)), 0.0),
        "hallucination_rate": F.when(some, 1 - in_graph).otherwise(0.0),
        "code_recall": code_recall(F.col("raw_predicted"), F.col("raw_gold")),
        "claim_grounding_rate": claim_rate(F.col("reply"), graph),
    }
    return rows.select(*keys, *(F.round(v, 6).alias(k) for k, v in values.items()), F.size("mentioned").alias("n_mentions"))


LAYER_SCORES = ("retrieval_recall", "retrieval_hit", "answer_f1", "graph_grounding_rate", "off_graph_rate", "vector_only_rate")


def layer_scores(cases: DataFrame, keys: Sequence[str], mode: str = "mode") -> DataFrame:
    """Scores of what was retrieved (against gold) and of what was answered (against gold_answer). The graph's rates do
    not apply to the mode vector_only, the vectors' not to graph_only."""
    rows = cases.withColumns({c: labels(F.col(c)) for c in ("predicted", "gold", "gold_answer", "graph_context", "vector_context")})
    rows = rows.withColumn("full_context", F.array_union("graph_context", "vector_context"))
    vocabulary = F.array_union(F.array_union("full_context", "predicted"), F.array_union("gold", "gold_answer"))
    rows = rows.withColumn("mentioned", mentions(F.col("reply"), vocabulary))
    rows = rows.withColumn("mentioned", F.when(F.size("mentioned") > 0, F.col("mentioned")).otherwise(F.col("predicted")))
    m, some = F.col("mentioned"), F.size("mentioned") > 0
    in_graph = share_in(m, F.col("graph_context"))
    values = {
        "retrieval_recall": set_recall(F.col("predicted"), F.col("gold")),
        "retrieval_hit": F.when(F.arrays_overlap("predicted", "gold") | (F.size("gold") == 0), 1.0).otherwise(0.0),
        "answer_f1": set_f1(m, F.col("gold_answer")),
        "graph_grounding_rate": F.when(F.col(mode) != "vector_only", in_graph),
        "off_graph_rate": F.when(F.col(mode) != "vector_only", F.when(some, 1 - in_graph).otherwise(0.0)),
        "vector_only_rate": F.when(F.col(mode) != "graph_only", share_in(m, F.array_except("vector_context", "graph_context"))),
    }
    return rows.select(*keys, *(F.round(v, 6).alias(k) for k, v in values.items()))


def roll_up(scores: DataFrame, by: Sequence[str], values: Sequence[str], digits: int = 4, empty: float | None = 0.0) -> DataFrame:
    """Means of the values that are not null over every prefix of ``by``, "all" for what is left out; ``empty`` where
    there is no value."""
    columns = [F.col(c) for c in by]
    sets = scores.groupingSets([columns[:n] for n in range(len(by) + 1)], *columns)
    means = [F.round(F.avg(v), digits).alias(v) for v in values]
    rows = sets.agg(*(F.grouping(c).alias(f"no_{c}") for c in by), F.count(F.lit(1)).alias("n_cases"), *means)
    named = [F.when(F.col(f"no_{c}") == 1, "all").otherwise(F.col(c).cast("string")).alias(c) for c in by]
    filled = [(F.coalesce(F.col(v), F.lit(empty)) if empty is not None else F.col(v)).alias(v) for v in values]
    return rows.select(*named, "n_cases", *filled)


def error_tags(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is wrong with an answer: few skills, off the graph or badly grounded, no mention at all."""
    weak_ground = (F.col("hallucination_rate") > 0.15) | (F.coalesce("graph_grounding_rate", F.lit(1.0)) < 0.6)
    rules = [F.when(F.col("ontology_f1") < 0.35, "low_skill_f1"), F.when(weak_ground, "off_graph"), F.when(F.col("n_mentions") == 0, "no_mention")]
    return scores.select(*keys, F.array_join(F.array_compact(F.array(*rules)), ",").alias("tags")).filter("tags <> ''")


def gap_buckets(rows: DataFrame, owner: str) -> DataFrame:
    """owner, known, missing, weak: disjoint buckets of labels from ``rows`` (owner, bucket, name). What is known is in
    no other bucket, and what is missing is not weak."""

    def bucket(name: str) -> Column:
        return F.array_sort(labels(F.collect_set(F.when(F.col("bucket") == name, F.col("name"))))).alias(name)

    made = rows.groupBy(owner).agg(*(bucket(b) for b in ("known", "missing", "weak")))
    missing = F.array_except("missing", "known")
    return made.select(owner, "known", missing.alias("missing"), F.array_except(F.array_except("weak", "known"), missing).alias("weak"))


def document_entities(docs: DataFrame, key: str, fields: Sequence[str], text: str) -> DataFrame:
    """key, entities: labels of the named fields and of the words of three characters or more of a document's text."""
    words = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_#+.]+"), 0), lambda w: F.length(w) >= 3)
    return docs.select(key, F.array_sort(labels(F.concat(F.array(*(F.col(f).cast("string") for f in fields)), words))).alias("entities"))
