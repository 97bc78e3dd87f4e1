"""Messages within sessions, and the latest rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def previous_user_message(messages: DataFrame) -> DataFrame:
    """As-of join: for each assistant message the nearest earlier user message of its session."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    user = F.when(F.col("role") == "user", F.struct("turn", "text"))
    rows = messages.withColumn("asked", F.last(user, ignorenulls=True).over(before)).filter(F.col("role") == "assistant")
    return rows.select("conv_id", "turn", "text", F.col("asked.turn").alias("user_turn"), F.col("asked.text").alias("user_text"))


def session_previews(messages: DataFrame, chars: int) -> DataFrame:
    """Number of messages and start of the first user message of each session, in one aggregate."""
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    rows = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"), first.alias("first_user"), F.count_if(F.col("role") == "user").alias("n_user"))
    preview = F.when(F.col("n_user") > 0, F.substring("first_user", 1, chars))
    return rows.select("conv_id", "n_messages", preview.alias("preview"))


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last ``n`` messages of each session, numbered in ascending order."""
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = messages.withColumn("from_end", F.row_number().over(last)).filter(F.col("from_end") <= n)
    position = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return rows.select("conv_id", "turn", "role", position.alias("position"))


def latest(rows: DataFrame, key: str, order: Column, columns: list[str]) -> DataFrame:
    """The columns of the row with the greatest ``order`` of each key: an aggregate, not a sort."""
    best = F.max_by(F.struct(*columns), order)
    return rows.groupBy(key).agg(best.alias("b")).select(key, "b.*")


def phases(messages: DataFrame) -> DataFrame:
    """Replay of a session: how many user and assistant turns came before each message, and the phase it is in."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.coalesce(F.sum((F.col("role") == "user").cast("int")).over(before), F.lit(0))
    said = F.coalesce(F.sum((F.col("role") == "assistant").cast("int")).over(before), F.lit(0))
    rows = messages.withColumns({"n_asked": asked, "n_answered": said})
    phase = F.when(F.col("n_asked") == 0, "idle").when(F.col("n_answered") < 2, "collecting").when(F.col("n_answered") < 4, "gap_summary").otherwise("course")
    return rows.select("conv_id", "turn", "role", "n_asked", "n_answered", phase.alias("phase"))


def feedback_queue(messages: DataFrame, feedback: DataFrame) -> DataFrame:
    """Assistant messages with their latest feedback, if any, and the reason to review them."""
    rows = messages.filter(F.col("role") == "assistant").join(feedback, ["conv_id", "turn"], "left")
    reason = F.when(F.col("rating") == -1, "negative").when(F.length("text") < 80, "short").when(F.col("rating").isNull(), "unrated")
    return rows.select("conv_id", "turn", "rating", reason.alias("reason")).filter(F.col("reason").isNotNull())


def approved_examples(messages: DataFrame, feedback: DataFrame, most: int) -> DataFrame:
    """The newest ``most`` assistant messages whose feedback was approved: a top-k report."""
    good = feedback.filter("status = 'approved'").select("conv_id", "turn", "created")
    return messages.filter("role = 'assistant'").join(good, ["conv_id", "turn"]).orderBy(F.desc("created"), "conv_id", "turn").limit(most)


def recent_sessions(messages: DataFrame, touched: DataFrame, since: Column) -> DataFrame:
    """Sessions (conv_id, created, updated) created at ``since`` or later, with their number of messages."""
    counts = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"))
    return touched.filter(F.col("created") >= since).join(counts, "conv_id", "left").fillna(0, ["n_messages"])
