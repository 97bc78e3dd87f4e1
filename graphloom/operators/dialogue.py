"""The dialogue that collects what a person knows, type by type, towards a career.

A message is read once into signs (``with_signs``), by column expressions and one scan for names of skills; ``advance`` takes
a state and the signs of one message to the next state. Replay of stored sessions (``replayed``) and the stream
(``graphloom.streaming.dialogue``) both call it, so they agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import without_marks
from graphloom.operators.resolve import name_finder
from graphloom.sources.model import TYPE_CODES

#: Messages of a session that later turns can see.
WINDOW = 24

#: Answers that skip a type; on the text as it was typed.
SKIP = r"^(không|ko|k\b|none|chưa|bỏ qua|skip|bỏ|không có|chưa biết)\b"
#: Commands that end the collection; on the text without marks.
EXIT = (
    r"(bo\s*qua\s*(tat\s*ca|het|toan\s*bo)|skip\s*all|"
    r"xem\s*(tong\s*ket|ket\s*qua|luon|ngay)|"
    r"den\s*(luon|thang)?\s*(lo\s*trinh|ket\s*qua|tong\s*ket)|"
    r"di\s*den\s*(tong\s*ket|ket\s*qua)|"
    r"dung\s*(thu\s*thap|hoi)|khong\s*(thu\s*thap|hoi)\s*(nua|them)|"
    r"end\s*flow|stop\s*collecting)"
)
#: Free questions; on the text without marks.
QUESTION = (
    r"(\?|la\s+gi|la\s+ai|lam\s+sao|lam\s+the\s+nao|"
    r"tai\s*sao|vi\s*sao|so\s*sanh|khac\s+nhau|"
    r"giai\s*thich|cho\s+(minh|toi|em)\s+(biet|hoi)|"
    r"toi\s+muon\s+(hoi|biet)|minh\s+muon\s+(hoi|biet)|"
    r"em\s+muon\s+(hoi|biet))"
)
#: Signs of a wish for courses, in a summary and as a follow-up; of a wish for a roadmap; skills named in questions.
COURSES = r"khóa|course|học\s+gì"
COURSE_FOLLOW_UP = r"khóa\s*học|khoa\s*hoc|course|học\s+.*\s+nào|gợi\s*ý\s*khóa|khóa\s+\w+\s+nào|nên\s+học\s+gì"
ROADMAP = (
    r"lộ\s*trình|roadmap|khóa\s*học|khoa\s*hoc|học\s+(như|ra)\s*sao|"
    r"skills?\s*gap|điểm\s+còn\s+thiếu|gợi\s*ý\s*(học|khóa)|cần\s+học\s+gì|"
    r"muốn\s+học|nên\s+học|tư\s*vấn\s+tiếp|bước\s+tiếp"
)
SINGLE_COURSE = r"khóa\s+\w+\s+nào|khóa\s*học\s+cho\s+\w+$"
HINT = (
    r"\b(SQL|Python|Java|JavaScript|React|Docker|Kubernetes|AWS|"
    r"HTML|CSS|Node\.?js|C\+\+|C#|PHP|Go|Rust|TypeScript)\b"
)
#: How an enumeration is split; signs of a follow-up on relations, and of a turn to courses.
LIST_SIGNS = "[,;、\n]+"
RELATION_FOLLOW_UP = r"^(thế còn|the con|con)\s+"
COURSE_PIVOT = r"khoa\s*hoc|\bkhoa\b|\bcourse\b|dang\s*ky|enroll|goi\s*y\s*khoa|cho\s+(minh|toi|em)\s+khoa"

SIGNS = "intent string, empty boolean, exits boolean, asks boolean, skips boolean, courses boolean, follows boolean, roadmap boolean, hint string, relation string, skills array<string>"
STEPS = "conv_id long, turn long, route string, handled boolean, action string, phase string, type_code string, n_known long, n_window long"

#: A session before its first message.
START: dict[str, Any] = {"phase": "idle", "at": 0, "known": {}, "last": None, "n": 0}


def has(text: Column, pattern: str) -> Column:
    return text.rlike("(?iU)" + pattern)


def with_signs(messages: DataFrame, names: dict[str, str]) -> DataFrame:
    """``messages`` (conv_id, turn, text, intent and others) with their signs. ``names``: aliases in lower case and the skills
    they stand for. A text that names none may enumerate labels: short ones between commas, semicolons or line breaks."""
    text = F.trim(F.coalesce("text", F.lit("")))
    plain = without_marks(text)
    part = F.transform(F.split(text, LIST_SIGNS), lambda p: F.trim(p))
    label = F.filter(part, lambda p: F.length(p).between(2, 30) & ~has(p, SKIP) & ~has(without_marks(p), QUESTION) & (F.length(p) - F.length(F.replace(p, F.lit(" "), F.lit(""))) < 4))
    listed = F.when(has(text, LIST_SIGNS), label).otherwise(F.array().cast("array<string>"))
    found = name_finder(names)(F.lower(text))
    hint = F.nullif(F.regexp_extract(text, "(?iU)" + HINT, 1), F.lit(""))
    alias = F.get(found, F.lit(0))
    rest = F.trim(F.regexp_replace(F.regexp_replace(text, "(?iU)" + RELATION_FOLLOW_UP, ""), r"^[ ?.]+|[ ?.]+$", ""))
    short = has(text, RELATION_FOLLOW_UP) | (F.size(F.split(text, r"\s+")) <= 4)
    # what a follow-up on relations is about
    relation = F.when((text == "") | has(plain, COURSE_PIVOT) | ((F.length(text) > 80) & ~has(text, RELATION_FOLLOW_UP)), None).otherwise(F.coalesce(hint, alias, F.when(short, F.nullif(rest, F.lit("")))))
    bulk = has(text, COURSE_FOLLOW_UP) & hint.isNull() & alias.isNull()
    return messages.withColumns({
        "empty": text == "", "exits": has(plain, EXIT), "asks": has(plain, QUESTION), "skips": has(text, SKIP), "courses": has(text, COURSES), "follows": has(text, COURSE_FOLLOW_UP),
        "bulk": bulk, "roadmap": has(text, ROADMAP) & ~(hint.isNotNull() & has(text, SINGLE_COURSE)), "hint": hint, "relation": relation,
        "skills": F.when(F.size(found) > 0, found).otherwise(F.array_distinct(listed)),
    })


def route(state: dict[str, Any], m: Any) -> str:
    """The intent of a message: what the state forces, else what it was routed to."""
    if state["last"] == "competency_relation" and m.relation is not None:
        return "competency_relation"
    going = state["phase"] == "collecting" and m.has_career
    if going and m.exits:
        return "competency_slot_fill"
    if going and (state["at"] > 0 or state["known"]) and m.intent in ("slot_fill", "competency_slot_fill") and not m.asks:
        return "competency_slot_fill"
    if m.profiled and m.roadmap:
        return "roadmap_followup"
    done = state["phase"] in ("gap_summary", "course")
    if m.has_career and done and m.bulk:
        return "competency_slot_fill"
    if m.has_career and m.follows and (done or state["last"] in ("pathfinding", "competency_slot_fill")):
        return "course_rec" if m.intent == "course_rec" or m.hint is not None else m.intent
    return m.intent


def advance(state: dict[str, Any], m: Any, needed: set[str]) -> tuple[dict[str, Any], str, str]:
    """The state after a message, its route and what is done: prompt, unrecognised, summary, courses or none. ``needed``: the
    types of which the career needs anything; others are passed over."""
    state = {**state, "n": min(WINDOW, state["n"] + 1)}
    intent = route(state, m)
    state["last"] = intent
    if intent != "competency_slot_fill" or not m.has_career:
        return state, intent, "none"

    def summary() -> tuple[dict[str, Any], str, str]:
        state["phase"] = "course" if m.courses else state["phase"]
        return state, intent, "courses" if m.courses else "summary"

    def passed() -> bool:
        while state["at"] < len(TYPE_CODES) and TYPE_CODES[state["at"]] not in needed:
            state["at"] += 1
        if state["at"] == len(TYPE_CODES):
            state["phase"] = "gap_summary"
        return state["at"] == len(TYPE_CODES)

    if not m.empty and m.exits:
        state["phase"] = "gap_summary"
    if state["phase"] == "gap_summary":
        return summary()
    if state["phase"] == "course":
        return summary() if m.courses else (state, intent, "none")
    state["phase"] = "collecting"
    if passed():
        return summary()
    if m.empty:
        return state, intent, "prompt"
    if not m.skips:
        if m.asks:
            return state, intent, "none"
        if not len(m.skills):
            return state, intent, "unrecognised"
        here = TYPE_CODES[state["at"]]
        known = list(state["known"].get(here, []))
        for skill in m.skills:
            if skill.lower() not in {k.lower() for k in known}:
                known.append(skill)
        state["known"] = {**state["known"], here: known}
    state["at"] += 1
    return summary() if passed() else (state, intent, "prompt")


def step(state: dict[str, Any], m: Any) -> tuple[dict[str, Any], tuple]:
    """The state after a message and its row of ``STEPS``."""
    state, intent, action = advance(state, m, set(m.needed) if m.needed is not None else set())
    here = TYPE_CODES[state["at"]] if state["phase"] == "collecting" and state["at"] < len(TYPE_CODES) else None
    return state, (m.conv_id, m.turn, intent, action != "none", action, state["phase"], here, sum(map(len, state["known"].values())), state["n"])


def columns_of(steps: str) -> list[str]:
    return [c.split()[0] for c in steps.split(", ")]


def as_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns_of(STEPS))


def replayed(messages: DataFrame) -> DataFrame:
    """A row of ``STEPS`` for each message (with signs; has_career, profiled, needed): each session is read in order of turns,
    by one task and with its state alone in memory. Rows of equal turn are taken in order of their text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, START
        for batch in batches:
            rows = []
            for m in batch.itertuples(index=False):
                if m.conv_id != now:
                    now, state = m.conv_id, START
                state, row = step(state, m)
                rows.append(row)
            yield as_frame(rows)

    ordered = messages.filter("conv_id is not null").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "text")
    return ordered.mapInPandas(run, STEPS)


def typed_needs(need: DataFrame, competency: DataFrame) -> DataFrame:
    """career_code, needed: the types of which each career needs anything."""
    typed = need.select("career_code", "item_code").join(competency.select("item_code", "type_code"), "item_code")
    return typed.filter(F.col("type_code").isNotNull()).groupBy("career_code").agg(F.sort_array(F.collect_set("type_code")).alias("needed"))


Transition = Callable[[dict[str, Any], Any], tuple[dict[str, Any], tuple]]
