"""Dataset building: dedupe with priorities, grouped splits, stratified samples, corpus texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: str) -> Column:
    """A fixed pseudo-random order that any SQL engine can reproduce."""
    return F.md5(F.col(key).cast("string"))


def priority_dedupe(rows: DataFrame, text: str, key: str, priority: Column) -> DataFrame:
    """One row a text: the highest priority, then the smallest key. Only hashes are shuffled, not the texts."""
    hashed = rows.select(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("text_sha256"), F.col(key), priority.alias("priority"))
    best = F.min_by(F.struct(key, "priority"), F.struct(-F.col("priority"), F.col(key)))
    return hashed.groupBy("text_sha256").agg(best.alias("b"), F.count(F.lit(1)).alias("n_rows")).select("text_sha256", "b.*", "n_rows")


def grouped_split(rows: DataFrame, group: str, key: str, share: float, least: int = 4) -> DataFrame:
    """Train or validation for each row: of a group of ``least`` rows or more, max(1, floor(share * n)) go to
    validation, in hash order; of a smaller group none. The cut is a rank inside hash ranges of the group, so a
    large group is not sorted in one task."""
    order = hash_order(key)
    rows = rows.select(group, key).withColumns({"__h": order, "__r": F.conv(F.substring(order, 1, 2), 16, 10).cast("int")})
    sizes = rows.groupBy(group, "__r").agg(F.count(F.lit(1)).alias("c"))
    by_range = Window.partitionBy(group).orderBy("__r")
    before = F.coalesce(F.sum("c").over(by_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("c").over(Window.partitionBy(group))
    sizes = sizes.select(group, "__r", before.alias("before"), total.alias("n"))
    inside = F.row_number().over(Window.partitionBy(group, "__r").orderBy("__h", key))
    ranked = rows.withColumn("rn", inside).join(sizes, [group, "__r"])
    n_val = F.when(F.col("n") >= least, F.greatest(F.lit(1), F.floor(F.col("n") * share))).otherwise(0)
    return ranked.select(group, key, F.when(F.col("before") + F.col("rn") <= n_val, "val").otherwise("train").alias("split"))


def stratified_sample(rows: DataFrame, stratum: str, key: str, size: int) -> DataFrame:
    """max(1, round(share of the stratum * size)) rows of each stratum, in hash order."""
    counts = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    quota = counts.crossJoin(F.broadcast(total)).select(stratum, F.greatest(F.lit(1), F.bround(F.col("n") * size / F.col("total"), 0).cast("long")).alias("quota"))
    ranked = rows.select(stratum, key).withColumn("rn", F.row_number().over(Window.partitionBy(stratum).orderBy(hash_order(key), key))).filter(F.col("rn") <= size)
    return ranked.join(quota, stratum).filter(F.col("rn") <= F.col("quota")).select(stratum, key, "rn", "quota")


def ordered_dedupe(rows: DataFrame, keys: list[str], position: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*position))).filter("__rn = 1").drop("__rn")


def competency_texts(competency: DataFrame, courses: DataFrame, relations: DataFrame, most: int) -> DataFrame:
    """Index text of each competency: its name, kind, best courses and up to ``most`` relation lines."""
    taught = courses.groupBy("item_code").agg(F.array_sort(F.collect_list(F.struct("rank", "course_name"))).alias("c"))
    order = Window.partitionBy("src").orderBy("rel_type", "dst")
    lines = relations.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most)
    related = lines.groupBy(F.col("src").alias("item_code")).agg(F.array_sort(F.collect_list(F.struct("rn", F.concat_ws(" ", "rel_type", F.col("dst").cast("string")).alias("line")))).alias("r"))
    rows = competency.join(taught, "item_code", "left").join(related, "item_code", "left")
    parts = [
        F.concat(F.lit("Competency: "), "item_name"),
        F.concat(F.lit("Kind: "), "kind"),
        F.when(F.col("c").isNotNull(), F.concat(F.lit("Courses: "), F.array_join(F.transform("c", lambda x: x["course_name"]), ", "))),
        F.when(F.col("r").isNotNull(), F.array_join(F.transform("r", lambda x: x["line"]), "\n")),
    ]
    return rows.select("item_code", F.concat_ws("\n", *parts).alias("index_text"))


def training_rows(pairs: DataFrame) -> DataFrame:
    """Question and answer pairs that pass the export rules, with a key of the question."""
    good = pairs.filter(F.col("user_text").isNotNull() & (F.length("text") >= 20) & (F.length("user_text") >= 20))
    return good.select("conv_id", "turn", F.substring(F.sha2("user_text", 256), 1, 16).alias("dedup_key"), F.length("user_text").alias("n_question"), F.length("text").alias("n_answer"))


def validation_errors(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Rule violations of each row: missing text, short text, a key or a text that other rows have too."""
    sha = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    marked = rows.select(key, F.length(text).alias("n"), sha.alias("sha"))
    keys = marked.groupBy(key).agg(F.count(F.lit(1)).alias("n_key"))
    texts = marked.groupBy("sha").agg(F.count(F.lit(1)).alias("n_text"))
    joined = marked.join(keys, key).join(texts, "sha")
    rules = [
        F.when(F.coalesce("n", F.lit(0)) == 0, F.lit("missing_text")),
        F.when(F.col("n") < 200, F.lit("short_text")),
        F.when(F.col("n_key") > 1, F.lit("duplicate_key")),
        F.when(F.col("n_text") > 1, F.lit("duplicate_text")),
    ]
    return joined.select(key, F.array_join(F.array_compact(F.array(*rules)), ",").alias("errors")).filter(F.col("errors") != "")


#: The intents of training rows.
INTENTS = ("pathfinding", "course_rec", "competency_relation", "skills_gap")


def content(place: int) -> Column:
    """The text of a message of a row (messages: array of role and content)."""
    return F.coalesce(F.get("messages", F.lit(place))["content"], F.lit(""))


def entity_key(meta: str = "meta") -> Column:
    """Whom a row is about: by its meta data, else by the snapshot in the user's message, else unknown."""
    named = [F.nullif(F.col(meta)[k], F.lit("")) for k in ("entity_key", "career", "competency")]
    snapshot = F.regexp_extract(content(1), r"(?s)(\{.*\})", 1)
    found = [F.nullif(F.get_json_object(snapshot, f"$.{k}"), F.lit("")) for k in ("career_name", "competency_name")]
    return F.lower(F.coalesce(*named, *found, F.lit("unknown")))


def intent_of(meta: str = "meta", file_name: str = "file_name") -> Column:
    """What a row teaches: by its meta data, else the name of its file, else the words of the system's message."""
    own, name = F.col(meta)["intent"], F.regexp_extract(F.col(file_name), r"ft_generator_([a-z_]+)\.jsonl", 1)
    low = F.lower(content(0))
    return F.when(own.isin(*INTENTS), own).when(name != "", name).when(low.contains("course"), "course_rec").otherwise("pathfinding")


def dedup_key(entity: Column, question: Column) -> Column:
    """Rows with one key ask the same about the same."""
    return F.concat(F.lit("hash:"), F.substring(F.sha2(F.concat_ws("\n", entity, F.trim(question)), 256), 1, 16))


def source_priority(meta: str = "meta") -> Column:
    source = F.coalesce(F.col(meta)["source"], F.lit(""))
    return F.when(source == "chat", 2).when(source == "synthetic", 1).when(F.col(meta)["message_id"].isNotNull(), 2).otherwise(0)


def merge_training_rows(rows: DataFrame) -> DataFrame:
    """``rows`` (messages, meta, file_name) of all sources with entity, intent and key: of the rows of an intent with
    one key that of the highest priority, then the first."""
    question = F.regexp_extract(content(1), r"(?s)Question:\s*(.+)$", 1)
    keyed = rows.withColumns({"entity": entity_key(), "intent": intent_of()})
    keyed = keyed.withColumn("key", dedup_key(F.col("entity"), F.when(question != "", question).otherwise(content(1))))
    order = Window.partitionBy("intent", "key").orderBy(F.desc(source_priority()), "file_name", F.xxhash64("messages"))
    return keyed.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def message_errors(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose messages are not one system, one user and one assistant message in turn, or lack text."""
    roles = F.transform("messages", lambda m: F.coalesce(m["role"], F.lit("")))
    rules = [
        F.when(F.size("messages") < 3, "too_few_messages"),
        F.when(F.slice(roles, 1, 3) != F.array(*map(F.lit, ("system", "user", "assistant"))), "role_order"),
        F.when(F.exists("messages", lambda m: F.trim(F.coalesce(m["content"], F.lit(""))) == ""), "empty_content"),
    ]
    return rows.select(key, F.array_join(F.array_compact(F.array(*rules)), ",").alias("errors")).filter("errors <> ''")


def topped_up_sample(rows: DataFrame, strata: list[str], key: str, size: int) -> DataFrame:
    """key and stratum of ``size`` rows: from the largest stratum to the smallest max(1, round(share)) rows each while
    any are left, the last stratum what is left; then rows of any stratum fill up. Rows come in hash order."""
    stratum = F.concat_ws("|", *(F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("_")) for c in strata))
    marked = rows.select(key, stratum.alias("stratum"), hash_order(key).alias("h"))
    counts = marked.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    # one row a stratum
    order, everything = Window.orderBy(F.desc("n"), "stratum"), Window.partitionBy()
    shares = counts.withColumns({"place": F.row_number().over(order), "last": F.count(F.lit(1)).over(everything), "total": F.sum("n").over(everything)})
    want = F.least(F.col("n"), F.greatest(F.lit(1), F.bround(size * F.col("n") / F.col("total"), 0).cast("long")))
    shares = shares.withColumn("want", F.when(F.col("place") == F.col("last"), F.col("n")).otherwise(want))
    before = F.coalesce(F.sum("want").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quotas = shares.withColumn("quota", F.greatest(F.lit(0), F.least(F.col("want"), size - before))).select("stratum", "quota")
    inside = F.row_number().over(Window.partitionBy("stratum").orderBy("h", key))
    ranked = marked.withColumn("rn", inside).filter(F.col("rn") <= size).join(quotas, "stratum")
    # at most twice the sample is left here
    picked = ranked.filter(F.col("rn") <= F.col("quota")).withColumn("extra", F.lit(0))
    others = ranked.filter(F.col("rn") > F.col("quota")).orderBy("h", key).limit(size).withColumn("extra", F.lit(1))
    return picked.unionByName(others).orderBy("extra", "h", key).limit(size).select(key, "stratum")


def gold_errors(rows: DataFrame) -> DataFrame:
    """Rule violations of gold cases (id, intent, question, gold_source, careers, courses): what an intent requires, and
    ids that an earlier case (position) has."""
    empty = F.coalesce(F.size("careers"), F.lit(0)) <= 0
    place = F.row_number().over(Window.partitionBy("id").orderBy("position"))
    rules = [
        F.when(F.trim(F.coalesce("question", F.lit(""))) == "", "missing question"),
        F.when(F.trim(F.coalesce("gold_source", F.lit(""))) == "", "missing gold_source"),
        F.when(F.col("place") > 1, "duplicate id"),
        F.when((F.col("intent") == "pathfinding") & empty, "no expected careers"),
        F.when((F.col("intent") == "course_rec") & F.col("courses").isNull(), "no expected courses"),
        F.when((F.col("intent") == "skills_gap") & empty, "no career"),
    ]
    marked = rows.withColumn("intent", F.coalesce(F.nullif("intent", F.lit("")), F.lit("pathfinding"))).withColumn("place", place)
    return marked.select("position", "id", F.array_join(F.array_compact(F.array(*rules)), "; ").alias("errors")).filter("errors <> ''")


def representative(rows: DataFrame, group: str, text: str, key: str) -> DataFrame:
    """The query that stands for each entity: one with marked letters before others, then the shortest."""
    marked = F.col(text).rlike("[\\p{L}&&[^\\p{ASCII}]]")
    best = F.min_by(F.struct(key, text), F.struct((~marked).alias("m"), F.length(text).alias("n"), F.col(key)))
    return rows.groupBy(group).agg(best.alias("b")).select(group, "b.*")


def from_templates(entities: DataFrame, templates: list[str], key: str, name: str) -> DataFrame:
    """key, place, text: each template with the entity's name in it, in turn."""
    texts = F.posexplode(F.array(*(F.replace(F.lit(t), F.lit("{name}"), F.col(name)) for t in templates)))
    return entities.select(key, texts.alias("place", "text"))
