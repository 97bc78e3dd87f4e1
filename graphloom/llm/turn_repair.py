"""Operator 13: conversation structure repair by signatures.

A conversation is good when the initials of its roles are those of ``(s?(ua)+)?``. Each row is encoded as one character: what
its role begins with and whether it is whole, cut short (upper case) or to be deleted (``x``). The string of a conversation
is its signature, in pieces of ``PIECE`` rows. Each distinct piece is solved once, by a memoised recursion over the place
in the piece and the state of the pattern, from every state it may begin in to every state it may end in. Pieces of a
conversation are then joined end to end (the last state of one is the first of the next), the audits are joined back to their
rows by piece, and the rows are replayed in order.

States: 0 nothing yet, 1 after a system turn, 2 an assistant turn is due, 3 after a pair. Edits, by initial: Keep (0), Rerole to
user or assistant (3), Delete (4), Insert an empty user or assistant turn (3); a row cut short that is not deleted
costs 3 more. Of the cheapest edits the audit that is least in ASCII stands; it tells the edits entirely, as the pattern
says which role a turn of each place must have.

The digest of a repaired conversation is sequential, so one conversation is read in order by one task, in constant memory:
sorting spills, and audits come piece by piece. Where signatures are solved, copies of a conversation, however many, are one row.

Cases. Null roles and texts are one space; rows without a turn come first and count for no gap; a null conv_id is a
conversation too. Rows of equal turn are ordered by the role and text that damage left. A conversation of any length is repaired whole. A conversation without
rows has no cost, an empty audit and the digest of the empty string. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import written

KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 3, 4, 3, 3
#: Rows of a piece of a signature.
PIECE = 1024
#: What a turn's first letter does to a state of the pattern.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: The states in which a conversation may end, and the name of the turn that is due in each state.
GOOD_ENDS, DUE = (0, 3), {0: "user", 1: "user", 2: "assistant", 3: "user"}
OPTIONS = "array<struct<first: int, last: int, cost: long, audit: string>>"


def cheapest(signature: str, first: int, closes: bool) -> dict[int, tuple[int, str]]:
    """last state: (cost, audit) of the cheapest edits of a piece that begins in state ``first``, ties by ASCII. Turns are
    inserted before rows, and after the last only where the conversation ``closes``, which then ends in a good state."""

    @cache
    def rest(i: int, state: int, last: int, room: int) -> tuple[int, str] | None:
        found = []

        def then(edit: str, cost: int, i: int, state: int, room: int = 2) -> None:
            if (tail := rest(i, state, last, room)) is not None:
                found.append((cost + tail[0], edit + tail[1]))

        turned = STEP[state, "a" if state == 2 else "u"]
        if i == len(signature):
            if state == last:
                found.append((0, ""))
            if closes and room:
                then("I", INSERT, i, turned, room - 1)
        else:
            row = signature[i].lower()
            then("D", DELETE, i + 1, state)
            if row != "x":
                short = CUT_SHORT if signature[i].isupper() else 0
                if (state, row) in STEP:
                    then("K", KEEP + short, i + 1, STEP[state, row])
                then("R", REROLE + short, i + 1, turned)
            # more than two turns in a row come back to a state that was cheaper
            if room:
                then("I", INSERT, i, turned, room - 1)
        return min(found, default=None)

    # from the end, so that no recursion is deep
    ends = GOOD_ENDS if closes else (0, 1, 2, 3)
    for i in range(len(signature), -1, -1):
        for last in ends:
            for state in range(4):
                rest(i, state, last, 2)
    return {last: found for last in ends if (found := rest(0, first, last, 2)) is not None}


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage of the contract, and copy: null for a row that was dropped (it tells that
    there was a conversation), else 0, or 1 for the second of a repeated row. Damage follows crc32 of "conv_id:turn" mod 20."""

    def said(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    key = F.concat_ws(":", said("conv_id"), said("turn"))
    harm = F.crc32(F.encode(key, "utf-8")) % 20
    rows = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), harm.alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("harm") == 0, F.array(F.lit(None).cast("int"))).when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def marked(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, copy) in order, as a written table: pos (from 0, null for dropped rows), piece,
    mark (the character of the signature), fault (blank, duplicate, truncated or null), new_turn and illegal (0 or 1)."""
    order = ["turn", "role", "text", "copy"]
    # one exchange serves all windows: they only sort anew
    dealt = rows.repartition("conv_id").withColumn("there", F.col("copy").isNotNull())
    in_turn = Window.partitionBy("conv_id", "there").orderBy(*order)
    same = Window.partitionBy("conv_id", "there", F.xxhash64("role", "text"), F.xxhash64(F.lit(1), "role", "text")).orderBy(*order)
    dealt = dealt.withColumn("seen", F.row_number().over(same) > 1)
    initial = F.substring("role", 1, 1)
    before = F.lag(initial).over(in_turn)
    space = r"[\x20\x09-\x0D]"
    blank, cut = F.col("text").rlike(rf"\A{space}*\z"), ~F.col("text").rlike(rf"[.!?]{space}*\z")
    fault = F.when(blank, "blank").when(F.col("seen"), "duplicate").when(cut, "truncated")
    dealt = dealt.withColumns({
        "pos": F.row_number().over(in_turn) - 1, "fault": fault, "initial": initial,
        "illegal": F.when(before.isNotNull() & ~F.concat(before, initial).isin("su", "ua", "au"), 1).otherwise(0),
        "new_turn": F.when(F.col("turn").isNotNull() & ~F.lag("turn").over(in_turn).eqNullSafe(F.col("turn")), 1).otherwise(0),
    })
    kind = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    mark = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)
    there = F.col("there")
    out = dealt.select("conv_id", "turn", "role", "text", *(F.when(there, c).alias(n) for c, n in ((F.col("pos"), "pos"), (F.floor(F.col("pos") / PIECE).cast("int"), "piece"), (mark, "mark"), (F.col("fault"), "fault"), (F.col("new_turn"), "new_turn"), (F.col("illegal"), "illegal"))))
    return written(out, "marked-turns")


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, piece, signature, closes: the marks of each piece in order; the last piece of a conversation closes it."""
    pieces = rows.filter("piece is not null").groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list(F.struct("pos", "mark"))).alias("m"))
    last = rows.groupBy(F.col("conv_id").alias("other")).agg(F.max("piece").alias("last"))
    joined = pieces.join(last, F.col("conv_id").eqNullSafe(F.col("other")))
    return joined.select("conv_id", "piece", F.array_join(F.transform("m", lambda x: x["mark"]), "").alias("signature"), (F.col("piece") == F.col("last")).alias("closes"))


def solved(pieces: DataFrame) -> DataFrame:
    """signature, begins, closes, options: the distinct pieces, each solved once. One that begins a conversation does so in state 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for signature, begins, closes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                options = [
                    {"first": first, "last": last, "cost": cost, "audit": audit}
                    for first in ((0,) if begins else (0, 1, 2, 3))
                    for last, (cost, audit) in cheapest(signature, first, closes).items()
                ]
                yield pa.RecordBatch.from_arrays([pa.array([signature]), pa.array([begins]), pa.array([closes]), pa.array([options], kind)], ["signature", "begins", "closes", "options"])

    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    distinct = pieces.select("signature", (F.col("piece") == 0).alias("begins"), "closes").distinct()
    return distinct.mapInArrow(run, f"signature string, begins boolean, closes boolean, options {OPTIONS}")


def best_chain(pieces: list[list[dict]]) -> tuple[int, list[str]]:
    """The cost and the audits by piece of the cheapest way from state 0 through all pieces, ties by ASCII of the whole.

    Ways of equal cost to one state never begin one another (one would have inserted more), so the least of each state
    is enough; what all ways share is settled and leaves the comparison."""
    live: dict[int, tuple[int, str]] = {0: (0, "")}
    back: list[dict[int, tuple[int, str]]] = []
    for options in pieces:
        found: dict[int, tuple[int, str]] = {}
        came: dict[int, tuple[int, str]] = {}
        for o in options:
            if o["first"] in live:
                cost, said = live[o["first"]]
                way = (cost + o["cost"], said + o["audit"])
                if o["last"] not in found or way < found[o["last"]]:
                    found[o["last"]], came[o["last"]] = way, (o["first"], o["audit"])
        back.append(came)
        shared = common_start([said for _, said in found.values()])
        live = {state: (cost, said[shared:]) for state, (cost, said) in found.items()}
    state = min(live, key=lambda s: live[s])
    cost, audits = live[state][0], []
    for came in reversed(back):
        state, audit = came[state]
        audits.append(audit)
    return cost, audits[::-1]


def common_start(texts: list[str]) -> int:
    least, most = min(texts), max(texts)
    return next((i for i, (a, b) in enumerate(zip(least, most, strict=False)) if a != b), min(len(least), len(most)))


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, piece, audit of each piece and, in the row of piece 0, the cost of the conversation."""
    pieces = signatures(rows)
    known = solved(pieces)
    joined = pieces.withColumn("begins", F.col("piece") == 0).join(known, ["signature", "begins", "closes"])
    alone = joined.filter("begins and closes")
    # the only piece: it may end in either good state
    best = F.array_min(F.transform("options", lambda o: F.struct(o["cost"].alias("cost"), o["audit"].alias("audit"))))
    alone = alone.select("conv_id", "piece", best.alias("b")).select("conv_id", "piece", "b.audit", "b.cost")
    kind = rows.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finished(conv, pieces: list[list[dict]]) -> pa.RecordBatch:
            cost, said = best_chain(pieces)
            m = len(said)
            return pa.RecordBatch.from_arrays([pa.array([conv] * m, id_type), pa.array(range(m), pa.int32()), pa.array(said), pa.array([cost] + [None] * (m - 1), pa.int64())], ["conv_id", "piece", "audit", "cost"])

        held: list[list[dict]] = []
        now = None
        for batch in batches:
            for conv, piece, options in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if piece == 0 and held:
                    yield finished(now, held)
                    held = []
                now = conv
                held.append(options)
        if held:
            yield finished(now, held)

    id_type = to_arrow_type(kind)
    longer = joined.filter("not (begins and closes)").select("conv_id", "piece", "options").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    chained = longer.mapInArrow(run, f"conv_id {kind.simpleString()}, piece int, audit string, cost long")
    return alone.unionByName(chained)


def replayed(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """conv_id, audit, repaired_sha256 of each conversation: its rows and the audits of its pieces meet in order."""
    kind = rows.schema["conv_id"].dataType
    # the audit of a piece comes before its rows; a conversation without rows has one empty audit
    empty = rows.groupBy("conv_id").agg(F.count("piece").alias("n")).filter("n = 0").select("conv_id", F.lit(0).alias("piece"), F.lit(-1).cast("int").alias("pos"), F.lit("").alias("role"), F.lit("").alias("text"))
    plans = chosen.select("conv_id", "piece", F.lit(-1).cast("int").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text"))
    turns = rows.filter("piece is not null").select("conv_id", "piece", F.col("pos").cast("int").alias("pos"), "role", "text")
    stream = turns.unionByName(plans).unionByName(empty).repartition("conv_id").sortWithinPartitions("conv_id", "piece", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_now, digest, written_turns, state, edits, said = None, False, hashlib.sha256(), 0, 0, "", []
        done: tuple[list, list, list] = ([], [], [])

        def turn(role: str, text: str) -> None:
            nonlocal written_turns, state
            digest.update((("\n" if written_turns else "") + role + ":" + text).encode())
            written_turns += 1
            state = STEP[state, role[:1]]

        def insert() -> None:
            nonlocal edits
            while edits.startswith("I"):
                edits = edits[1:]
                turn(DUE[state], "")

        def finish() -> None:
            insert()
            for held, value in zip(done, (now, "".join(said), digest.hexdigest()), strict=True):
                held.append(value)

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(done[0], id_type), pa.array(done[1], pa.string()), pa.array(done[2], pa.string())], ["conv_id", "audit", "repaired_sha256"])
            for held in done:
                held.clear()
            return out

        for batch in batches:
            for conv, piece, pos, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if pos < 0:
                    if piece == 0:
                        if open_now:
                            finish()
                        now, open_now, digest, written_turns, state, said = conv, True, hashlib.sha256(), 0, 0, []
                    else:
                        insert()
                    edits = text
                    said.append(text)
                    continue
                insert()
                edit, edits = edits[0], edits[1:]
                if edit == "K":
                    turn(role, text)
                elif edit == "R":
                    turn(DUE[state], text)
            if done[0]:
                yield batch_of()
        if open_now:
            finish()
            yield batch_of()

    id_type = to_arrow_type(kind)
    return stream.mapInArrow(run, f"conv_id {kind.simpleString()}, audit string, repaired_sha256 string")


def repair(turns: DataFrame) -> DataFrame:
    """A row for each conversation of ``turns`` (conv_id, turn, role, text, and copy, null for rows that only name their
    conversation): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = marked(turns)
    there = F.col("pos").isNotNull()
    gaps = F.max(F.when(there, F.col("turn"))) - F.min(F.when(there, F.col("turn"))) + 1 - F.sum("new_turn")
    counts = rows.groupBy("conv_id").agg(
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), *(F.count_if(F.col("fault") == c).alias(c) for c in ("blank", "duplicate", "truncated")), F.coalesce(F.sum("illegal"), F.lit(0)).cast("long").alias("illegal")
    )
    chosen = written(audits(rows), "audits")
    costs = chosen.filter("piece = 0").select(F.col("conv_id").alias("c1"), "cost")
    repaired = replayed(rows, chosen).withColumnRenamed("conv_id", "c2")
    out = counts.join(costs, F.col("conv_id").eqNullSafe(F.col("c1")), "left").join(repaired, F.col("conv_id").eqNullSafe(F.col("c2")))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.coalesce("cost", F.lit(0)).cast("long").alias("cost"), "audit", "repaired_sha256")
