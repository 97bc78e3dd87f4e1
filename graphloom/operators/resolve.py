"""Free text to entities: matches by name, alias and similarity. Candidates come from equi-joins on pieces of strings that no
true match can miss, so no text meets the whole catalogue and no match is lost."""

from __future__ import annotations

import bisect
import heapq
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import similarity

#: Aliases that tasks may hold as one automaton.
MOST_ALIASES = 2_000_000
#: Names and needles that a task compares, tasks at least, and partitions at most that they are dealt to.
NAMES, NEEDLES, LEAST_TASKS, MOST_TASKS = 1_000_000, 5_000, 32, 4_000
#: From this length on difflib leaves out frequent characters.
LONG = 200
#: Characters of names in which a frequent text is looked for.
PROBED = 100_000

#: Names of skills that are search terms wherever they stand.
KNOWN_TOKENS = (
    r"\b(?:SQL|Python|Java(?:Script)?|React|Docker|Kubernetes|AWS|Azure|GCP|"
    r"HTML|CSS|Node\.?js|C\+\+|C#|PHP|Go|Rust|TypeScript|CBAP|PMP|Scrum|Agile)\b"
)
#: Least length of aliases by kind.
LEAST_ALIAS = {"career": 2, "competency": 2, "soft_skill": 3, "subject": 3}


def pieces(text: Column, n: int | Column) -> Column:
    """The distinct runs of ``n`` characters of a text."""
    size = F.lit(n) if isinstance(n, int) else n
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substr(text, i, size)))


def containing(holders: DataFrame, parts: DataFrame, holder: str, part: str) -> DataFrame:
    """Pairs of rows where the text ``holder`` contains the text ``part`` (not empty). Different texts meet, then their rows:
    a part looks its holders up by that of its runs of three characters (or its whole, if shorter) which the fewest have,
    so by none where some run is in no holder."""
    held = F.concat(*(pieces(F.col(holder), n) for n in (1, 2, 3)))
    postings = holders.select(holder).distinct().withColumn("piece", F.explode(held))
    counts = postings.groupBy("piece").agg(F.count(F.lit(1)).alias("n_holders"))
    size = F.least(F.length(part), F.lit(3))
    texts = parts.select(part).distinct().filter(F.length(part) > 0)
    looked = texts.withColumn("piece", F.explode(pieces(F.col(part), size))).join(counts, "piece", "left")
    rarest = looked.groupBy(part).agg(F.min_by(F.struct("piece", "n_holders"), F.struct(F.coalesce("n_holders", F.lit(0)), "piece")).alias("r"))
    asked = rarest.filter("r.n_holders is not null").select(part, "r.piece")
    # the planner takes exploded rows for as few as the texts they are made from, so it must not broadcast them
    met = postings.hint("merge").join(asked, "piece").filter(F.col(holder).contains(F.col(part))).select(holder, part)
    return met.join(holders.hint("merge"), holder).join(parts.hint("merge"), part)


def name_tiers(names: DataFrame, needles: DataFrame, code: str, name: str) -> DataFrame:
    """needle, code, name, tier of all pairs: 0 equal, 1 the name holds the needle, 2 the needle holds the name."""
    a = names.select(code, name, F.lower(F.trim(name)).alias("low_name"))
    b = needles.select("needle").distinct().withColumn("low_needle", F.lower(F.trim("needle")))
    holds = containing(a, b, "low_name", "low_needle").withColumn("tier", F.when(F.col("low_name") == F.col("low_needle"), 0).otherwise(1))
    held = containing(b, a, "low_needle", "low_name").filter("low_name <> low_needle").withColumn("tier", F.lit(2))
    columns = ["needle", code, name, "tier"]
    return holds.select(*columns).unionByName(held.select(*columns))


def first_names_of(names: DataFrame, key: Column, *order: Column, columns: tuple[str, ...]) -> DataFrame:
    """``columns`` of the first row of each ``key``, so that names that are often there meet a text once."""
    return names.groupBy(key.alias("key")).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("b")).select("b.*")


def best_match(names: DataFrame, needles: DataFrame, code: str, name: str) -> DataFrame:
    """For each needle the name of the lowest tier, then the shortest, then by code."""
    # rows of one name in lower case are in one tier
    firsts = first_names_of(names, F.lower(F.trim(name)), F.length(name), F.col(code), columns=(code, name))
    best = F.min_by(F.struct(code, name, "tier"), F.struct("tier", F.length(name), code))
    return name_tiers(firsts, needles, code, name).groupBy("needle").agg(best.alias("b")).select("needle", "b.*")


def first_of_each(values: Column) -> Column:
    """The values of an array without those that stand before in any case."""
    low = F.transform(values, lambda v: F.lower(v))
    return F.filter(values, lambda v, i: F.array_position(low, F.lower(v)) == i + 1)


def search_terms(text: Column) -> Column:
    """Known skill names and acronyms of a text; without any the text itself if it has 64 characters at most, else its
    three longest words of three letters or more."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    found = first_of_each(F.concat(F.regexp_extract_all(bare, F.lit("(?i)" + KNOWN_TOKENS), 0), F.regexp_extract_all(bare, F.lit(r"\b[A-Z]{3,}\b"), 0)))
    words = first_of_each(F.filter(F.regexp_extract_all(bare, F.lit(r"[\p{L}\p{N}_#+]{2,}"), 0), lambda w: F.length(w) >= 3))
    longest = F.slice(F.transform(F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))), lambda x: x["w"]), 1, 3)
    return F.when(bare == "", F.array().cast("array<string>")).when(F.size(found) > 0, found).when(F.length(bare) <= 64, F.array(bare)).otherwise(longest)


def spurious(needle: Column, name: Column) -> Column:
    """Whether a name of one or two characters is no word of the needle."""
    n, c = F.lower(F.trim(needle)), F.lower(F.trim(name))
    word = F.regexp_like(n, F.concat(F.lit("\\b\\Q"), c, F.lit("\\E\\b")))
    return (n == "") | (c == "") | ((n != c) & (F.length(c) <= 2) & ~word)


def match_competencies(names: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, term, item_code, item_name for each question (query_id, text) that has one: of its search terms the
    first that a name equals or, with two characters or more, that a name holds; equal names come before others, longer
    ones before shorter ones. Names that are too short to be meant do not count."""
    terms = asked.select("query_id", "text", F.posexplode(search_terms(F.col("text"))).alias("place", "term")).withColumn("low_term", F.lower(F.trim("term")))
    firsts = first_names_of(names.filter(F.col("item_name").isNotNull()), F.lower(F.trim("item_name")), -F.length("item_name"), F.col("item_code"), columns=("item_code", "item_name"))
    low = firsts.withColumn("low_name", F.lower(F.trim("item_name")))
    met = containing(low, terms.select("low_term").distinct(), "low_name", "low_term").filter((F.col("low_name") == F.col("low_term")) | (F.length("low_term") >= 2))
    best = F.min_by(F.struct("item_code", "item_name"), F.struct((F.col("low_name") != F.col("low_term")).alias("d"), (-F.length("item_name")).alias("n"), F.col("item_code").alias("c")))
    by_term = met.groupBy("low_term").agg(best.alias("b")).select("low_term", "b.*")
    good = terms.join(by_term, "low_term").filter(~spurious(F.col("text"), F.col("item_name")))
    return good.groupBy("query_id").agg(F.min_by(F.struct("term", "item_code", "item_name"), "place").alias("b")).select("query_id", "b.*")


_AUTOMATA: dict[str, Any] = {}


def automaton_of(mark: str, names: Callable[[], dict[str, Any]]) -> Any:
    """The automaton of the keys of ``names``, built once in a process: the last one asked for is kept."""
    import ahocorasick

    if mark not in _AUTOMATA:
        automaton = ahocorasick.Automaton()
        for alias, targets in names().items():
            automaton.add_word(alias, (alias, targets))
        if len(automaton):
            automaton.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[mark] = automaton
    return _AUTOMATA[mark]


def names_in(automaton: Any, text: str) -> Iterator[tuple[str, Any]]:
    """The names that a text holds, with what they stand for: as whole words, or as parts from four characters on."""

    def word(c: str) -> bool:
        return c.isascii() and c.isalnum()

    for end, (alias, targets) in automaton.iter(text) if len(automaton) and text else ():
        begin = end - len(alias) + 1
        if len(alias) < 4 and ((begin and word(text[begin - 1])) or (end + 1 < len(text) and word(text[end + 1]))):
            continue
        yield alias, targets


def name_finder(names: dict[str, str]) -> Callable[[Column], Column]:
    """A function from a text in lower case to the distinct names (values of ``names``, by alias in lower case) that it
    holds, in order. The names are a catalogue of at most ``MOST_ALIASES``."""
    if len(names) > MOST_ALIASES:
        raise ValueError(f"more than {MOST_ALIASES} aliases: scan them in parts")
    mark = uuid.uuid4().hex

    @F.pandas_udf("array<string>")
    def find(texts: pd.Series) -> pd.Series:
        automaton = automaton_of(mark, lambda: names)
        return texts.map(lambda text: sorted({name for _, name in names_in(automaton, text)}))

    return find


def alias_scan(texts: DataFrame, aliases: DataFrame, least: dict[str, int] | None = None) -> DataFrame:
    """doc_id, kind, canonical, alias: of each text (doc_id, text) the aliases (kind, alias, canonical) that it equals,
    holds as a whole word, or holds as a part if they have four characters or more; of each canonical name the longest.

    Texts are read once, where they lie, by an automaton of all aliases, which tasks hold up to ``MOST_ALIASES``."""
    least = LEAST_ALIAS if least is None else least
    rows = aliases.filter(F.length("alias") > 0).select("kind", F.lower("alias").alias("alias"), "canonical").distinct().limit(MOST_ALIASES + 1).collect()
    if len(rows) > MOST_ALIASES:
        raise ValueError(f"more than {MOST_ALIASES} aliases: scan them in parts")
    by_alias: dict[str, list[tuple[str, str]]] = {}
    for r in rows:
        if len(r.alias) >= least.get(r.kind, 1):
            by_alias.setdefault(r.alias, []).append((r.kind, r.canonical))
    shared = texts.sparkSession.sparkContext.broadcast(by_alias)
    mark = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = automaton_of(mark, lambda: shared.value)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["low"], strict=True):
                best: dict[tuple[str, str], str] = {}
                for alias, targets in names_in(automaton, text):
                    for target in targets:
                        if target not in best or (-len(alias), alias) < (-len(best[target]), best[target]):
                            best[target] = alias
                out += [(doc_id, kind, canonical, alias) for (kind, canonical), alias in best.items()]
            yield pd.DataFrame(out, columns=["doc_id", "kind", "canonical", "alias"])

    low = texts.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    return low.mapInPandas(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, kind string, canonical string, alias string")


def as_letters(texts: DataFrame, column: str, own: str) -> DataFrame:
    """``column`` (distinct, not blank) and ``own``: its characters, each with how often it stood before, so that common
    elements of two such sets count common characters; its length, that of its distinct words side by side, and the words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch[column]:
                seen: dict[str, int] = {}
                letters = []
                for c in text:
                    c = " " if c.isspace() else c
                    seen[c] = seen.get(c, 0) + 1
                    letters.append(f"{c}{seen[c]}")
                words = sorted(set(text.split()))
                rows.append({"letters": letters, "size": len(text), "least": len(" ".join(words)), "words": words})
            yield pd.DataFrame({column: batch[column], own: rows})

    whole = texts.select(column).filter(F.col(column).isNotNull()).distinct()
    return whole.mapInPandas(run, f"{column} string, {own} struct<letters: array<string>, size: int, least: int, words: array<string>>").filter(F.size(f"{own}.words") > 0)


def sharing_letters(left: DataFrame, right: DataFrame, need: float) -> DataFrame:
    """Pairs of rows of ``as_letters`` (needle, a; name, b), each once, that may have a share ``need`` of the ``least``
    length of the shorter one in common, counted in characters.

    The shorter one looks the other up by its rarest characters alone, so many that no pair that has enough in common
    can miss all of them; a pair is met at the first of them that both have."""
    counts = right.select(F.explode("b.letters").alias("letter")).groupBy("letter").agg(F.count(F.lit(1)).alias("n"))

    def rarest(rows: DataFrame, key: str, own: str) -> DataFrame:
        each = rows.select(key, own, F.explode(f"{own}.letters").alias("letter")).join(counts, "letter", "left")
        rare = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "letter")))
        ordered = each.groupBy(key).agg(F.first(own).alias(own), rare.alias("rare"))
        enough = F.greatest(F.lit(1), F.ceil(need * F.col(f"{own}.least") - 1e-9).cast("int"))
        return ordered.withColumn("rare", F.transform(F.slice("rare", F.lit(1), F.size("rare") - enough + 1), lambda x: x["letter"]))

    shorter = F.col("a.least") <= F.col("b.least")
    parts = []
    for rows, key, own, others, other, side in ((left, "needle", "a", right, "b", shorter), (right, "name", "b", left, "a", ~shorter)):
        asked = rarest(rows, key, own).withColumn("letter", F.explode("rare"))
        met = asked.join(others.withColumn("letter", F.explode(f"{other}.letters")), "letter").filter(side)
        first = F.element_at(F.array_intersect("rare", f"{other}.letters"), 1)
        parts.append(met.filter(first == F.col("letter")).select("needle", "a", "name", "b"))
    return parts[0].unionByName(parts[1])


def ratio_bound(common: Column, n: Column, m: Column) -> Column:
    """No ratio of two strings of at least these lengths is higher, where so many characters are common."""
    return F.least(F.lit(100.0), 200.0 * common / (n + m))


def likeness_bound(a: str, b: str) -> Column:
    """No weighted ratio of the strings of two structs of ``as_letters`` is higher: in each tier the longest common
    subsequence has at most the common characters, and a shared word lets the tiers of words reach their most."""
    common = F.size(F.array_intersect(f"{a}.letters", f"{b}.letters"))
    n, m, n1, m1 = (F.col(f"{x}.{c}") for c in ("size", "least") for x in (a, b))
    least, most = F.least(n, m), F.greatest(n, m)
    shared = F.arrays_overlap(f"{a}.words", f"{b}.words")
    words = F.when(shared, 100.0).otherwise(ratio_bound(common, n1, m1))
    piece = F.when(most < 8 * least, 0.9).otherwise(0.6)
    inside = F.least(common, least)
    short = F.least(n1, m1)
    pieces = ratio_bound(inside, least, inside)
    word_pieces = F.when(shared, 100.0).otherwise(ratio_bound(F.least(common, short), short, F.least(common, short)))
    return F.greatest(ratio_bound(common, n, m), F.when(most < 1.5 * least, 0.95 * words).otherwise(piece * F.greatest(pieces, 0.95 * word_pieces)))


def needed_share(cutoff: float) -> float:
    """The share of the shorter string's characters that the other must have for a weighted ratio of ``cutoff`` without a
    word in common. Whole strings need cutoff / 100. A piece of the longer one must reach r = cutoff / 0.9, for which it has
    at least r / (200 - r) of the shorter one's characters."""
    r = cutoff / 0.9
    return cutoff / 100 if r > 100 else min(cutoff / 100, r / (200 - r))


def fuzzy_pairs(needles: DataFrame, names: DataFrame, cutoff: float) -> DataFrame:
    """needle, name for all distinct strings whose weighted ratio can reach the cutoff. Those with a word in common meet
    at that word, others at a rare character; a bound on the ratio then leaves few to be compared."""
    left, right = as_letters(needles, "needle", "a"), as_letters(names, "name", "b")
    words = left.withColumn("word", F.explode("a.words")).join(right.withColumn("word", F.explode("b.words")), "word")
    by_word = words.filter(F.element_at(F.array_intersect("a.words", "b.words"), 1) == F.col("word")).select("needle", "a", "name", "b")
    by_letter = sharing_letters(left, right, needed_share(cutoff)).filter(~F.arrays_overlap("a.words", "b.words"))
    return by_word.unionByName(by_letter).filter(likeness_bound("a", "b") >= cutoff - 1e-6).select("needle", "name")


def scored_pairs(pairs: DataFrame, score: Callable[[str, str], float]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(score=[round(score(a, b), 6) for a, b in zip(batch["needle"], batch["name"], strict=True)])

    return pairs.mapInPandas(run, "needle string, name string, score double")


def fuzzy_top(needles: DataFrame, names: DataFrame, cutoff: float, k: int = 1) -> DataFrame:
    """needle, rank, code, name, score: the ``k`` names (code, name) most like each needle, of a score of ``cutoff`` or
    more. A name that several rows have stands for the last of them."""
    last = names.groupBy("name").agg(F.max("code").alias("code"))
    scored = scored_pairs(fuzzy_pairs(needles, last, cutoff), similarity.weighted_ratio).filter(F.col("score") >= cutoff)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("needle").orderBy(F.desc("score"), "name"))).filter(F.col("rank") <= k)
    return ranked.join(last, "name").select("needle", "rank", "code", "name", "score")


def best_offers(needle: str, names: list[str], sizes: np.ndarray, count: Callable[[str], np.ndarray], k: int, least: float) -> list[tuple[float, str]]:
    """score, name of the first ``k`` of ``names`` (in order) for what was typed, by score and name, of a score of ``least`` or more.

    Common characters bound a score, and common subsequences more closely. Names are compared from the highest bound down, and in order where bounds are equal, until
    no other can come before the ``k``-th."""
    low = needle.lower()
    places = similarity.places_of(low)
    common = np.zeros(len(names), np.int64)
    for c in set(low):
        common += np.minimum(count(c), low.count(c))
    bound = 2.0 * common / (len(low) + sizes) + np.where(common == len(low), 0.35, 0.0)
    bound[bound < least - 1e-6] = -1.0
    best: list[tuple[float, str]] = []
    while True:
        top = bound.max(initial=-1.0)
        most = round(float(top), 6)
        if top < 0 or (len(best) == k and most < -best[-1][0]):
            break
        for i in np.flatnonzero(bound == top).tolist():
            # names come in order, so no later one of this bound can come before the last
            if len(best) == k and most <= -best[-1][0] and names[i] > best[-1][1]:
                break
            name = names[i].lower()
            # matching blocks are a common subsequence, whose length is found faster
            reach = 2.0 * similarity.common_length(low, name, places) / (len(low) + len(name)) + (0.35 if low in name else 0.0)
            if len(best) == k and (-round(reach, 6), names[i]) > best[-1]:
                continue
            score = round(similarity.suggestion_score(needle, names[i]), 6)
            if score >= least:
                bisect.insort(best, (-score, names[i]))
                del best[k:]
        bound[bound == top] = -1.0
    return [(-score, name) for score, name in best]


class OfferedNames:
    """Distinct names, to search those that come first for what was typed.

    Names of one length lie in order, as leaves of a tree of their characters: what a beginning has in common with the
    needle bounds the score of all names that have it, so a search looks at few of them. Names that are long, or that lower
    case does not change character by character, are compared by ``best_offers``."""

    def __init__(self, names: Iterable[str]):
        self.rest: list[str] = []
        self.groups: dict[int, tuple[list[str], str]] = {}
        by_size: dict[int, list[str]] = {}
        for name in sorted(names):
            plain = len(name) < LONG and (name.isascii() or [c.lower() for c in name] == list(name.lower()))
            (by_size.setdefault(len(name), []) if plain else self.rest).append(name)
        for size in sorted(by_size):
            self.groups[size] = by_size[size], "\n".join(name.lower() for name in by_size[size])
        low = [name.lower() for name in self.rest]
        self.sizes = np.array([len(name) for name in low], np.int64)
        self.count = cache(lambda c: np.fromiter((name.count(c) for name in low), np.int32, len(low)))

    def holders(self, lows: Iterable[str], k: int) -> dict[str, list[str]]:
        """The first ``k`` names that hold each text: shorter ones score higher. Texts that many names hold are found at
        once, others by an automaton that reads the names once for all."""
        import ahocorasick

        found: dict[str, list[str]] = {low: [] for low in lows}
        automaton = ahocorasick.Automaton()

        def note(low: str, size: int, names: list[str], at: int) -> int:
            """Where the next name begins, or may hold the text."""
            i, begin = divmod(at, size + 1)
            if begin + len(low) > size:
                return at + 1
            if found[low][-1:] != [names[i]]:
                found[low].append(names[i])
            return (i + 1) * (size + 1)

        for low, held in found.items():
            for size, (names, text) in self.groups.items():
                if size >= len(low):
                    at = text.find(low, 0, PROBED)
                    while at >= 0 and len(held) < k:
                        at = text.find(low, note(low, size, names, at), PROBED)
                    break
            if len(held) < k:
                held.clear()
                automaton.add_word(low, low)
        if len(automaton):
            automaton.make_automaton()
            for size, (names, text) in self.groups.items():
                for end, low in automaton.iter(text):
                    if len(found[low]) < k:
                        note(low, size, names, end - len(low) + 1)
        return found

    def first(self, needle: str, holders: list[str], k: int, least: float) -> list[tuple[float, str]]:
        """score, name of the first ``k`` names by score and name, of a score of ``least`` or more."""
        low = needle.lower()
        n, places, bits = len(low), similarity.places_of(low), {}
        best = [(-round(similarity.suggestion_score(needle, name), 6), name) for name in holders]
        held = {name for _, name in best}
        floor = max(least, -max(best)[0]) if len(best) == k else least
        # what is not done: the names lo..hi-1 of a size have d characters in common, which leave ``row`` of the needle
        heap: list[tuple] = [(score, name, True) for score, name in best]

        def push(size: int, names: list[str], scores: list[float], lo: int, hi: int, d: int, row: int) -> None:
            one, two = names[lo], names[hi - 1]
            while d < size and (c := one[d]) == two[d]:
                if c not in bits:
                    bits[c] = places.get(c.lower(), 0)
                if hit := row & bits[c]:
                    row = (row + hit) | (row - hit)
                d += 1
            # of the needle's last characters as many can follow as the names have left
            bound = scores[n - (row & ((1 << max(0, n - size + d)) - 1)).bit_count()]
            if bound >= floor:
                heapq.heappush(heap, (-bound, one, False, size, names, scores, lo, hi, d, row))

        for size, (names, _) in self.groups.items():
            push(size, names, [round(2.0 * c / (n + size), 6) for c in range(n + 1)], 0, len(names), 0, (1 << n) - 1)
        out: list[tuple[float, str]] = []
        while heap and len(out) < k:
            bound, name, done, *node = heapq.heappop(heap)
            if done:
                if -bound >= least:
                    out.append((-bound, name))
                continue
            size, names, scores, lo, hi, d, row = node
            if hi - lo == 1:
                if name not in held:
                    heapq.heappush(heap, (-round(similarity.suggestion_score(needle, name), 6), name, True))
                continue
            while lo < hi:
                c = names[lo][d]
                end = hi if names[hi - 1][d] == c else bisect.bisect_left(names, names[lo][:d] + chr(ord(c) + 1), lo + 1, hi)
                push(size, names, scores, lo, end, d, row)
                lo = end
        if self.rest:
            out += best_offers(needle, self.rest, self.sizes, self.count, k, least)
            out = sorted(out, key=lambda x: (-x[0], x[1]))[:k]
        return out


def offers(typed: DataFrame, offered: DataFrame, k: int, least: float) -> DataFrame:
    """needle, name, score: the first ``k`` offered names of each needle in each block of names. A task compares some needles
    with one block, so its memory is bounded."""
    n_needles, n_names = (rows.count() for rows in (typed, offered))
    blocks = max(1, -(-n_names // NAMES))
    chunks = max(1, min(n_needles, max(-(-n_needles // NEEDLES), -(-LEAST_TASKS // blocks))))
    block, chunk = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    asked = typed.withColumn("chunk", F.pmod(F.xxhash64("needle"), F.lit(chunks)).cast("int")).select("needle", "chunk", block.alias("block"))
    held = offered.withColumn("at", F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int")).select("name", "at", chunk.alias("part"))

    def meet(needles: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
        block = OfferedNames(names["name"])
        held = block.holders({needle.lower() for needle in needles["needle"]}, k)
        rows = [(needle, name, score) for needle in needles["needle"] for score, name in block.first(needle, held[needle.lower()], k, least)]
        return pd.DataFrame(rows, columns=["needle", "name", "score"])

    # groups are long to work on and small, so adaptive execution must not put many into one task
    tasks = min(MOST_TASKS, 4 * blocks * chunks)
    asked, held = asked.repartition(tasks, "chunk", "block"), held.repartition(tasks, "part", "at")
    return asked.groupBy("chunk", "block").cogroup(held.groupBy("part", "at")).applyInPandas(meet, "needle string, name string, score double")


def suggestions(needles: DataFrame, names: DataFrame, k: int = 6, least: float = 0.25) -> DataFrame:
    """needle, rank, name, score: names to offer for what was typed. A name that equals it is the only one; of others
    the first ``k`` (1 to 12) of a score of ``least`` or more, where a name that holds the needle has 0.35 more."""
    k = max(1, min(12, k))
    typed = needles.select(F.trim("needle").alias("needle")).filter("needle <> ''").distinct()
    offered = names.select(F.trim("name").alias("name")).filter("name <> ''").distinct()
    equal = typed.join(offered, F.lower("needle") == F.lower("name")).select("needle", "name")
    rest = typed.join(equal.select("needle").distinct(), "needle", "left_anti")
    scored = offers(rest, offered, k, least).unionByName(equal.withColumn("score", F.lit(1.0)))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("needle").orderBy(F.desc("score"), "name"))).filter(F.col("rank") <= k)


#: What an item code looks like, and the scores of its tiers.
ITEM_CODE = "^[A-Z]{1,3}_[A-Z0-9_]+$"
EXACT, ALIAS, ALIAS_HINT, FUZZY_HINT, FUZZY_MISS = 100.0, 95.0, 10.0, 15.0, -5.0


def exact_and_alias(asked: DataFrame, catalogue: DataFrame, aliases: DataFrame) -> DataFrame:
    """needle, code, name, type_code, score, source of the candidates by code, or where no code fits by alias.

    ``asked``: needle, hint (a type code or null); ``catalogue``: code, name, type_code; ``aliases``: alias, canonical."""
    asked = asked.withColumn("key", F.trim("needle")).filter("key <> ''")
    by_code = asked.filter(F.upper("key").rlike(ITEM_CODE)).join(catalogue, F.upper("key") == F.upper("code"))
    exact = by_code.select("needle", "code", "name", "type_code", F.lit(EXACT).alias("score"), F.lit("exact").alias("source"))
    rest = asked.join(exact.select("needle").distinct(), "needle", "left_anti")
    meant = rest.join(aliases.select(F.lower("alias").alias("low_alias"), "canonical").distinct(), F.lower("key") == F.col("low_alias"))
    found = meant.join(catalogue, F.lower("canonical") == F.lower("name"))
    score = F.lit(ALIAS) + F.when(F.col("hint") == F.col("type_code"), ALIAS_HINT).otherwise(0.0)
    return exact.unionByName(found.select("needle", "code", "name", "type_code", score.alias("score"), F.lit("alias").alias("source")))


def best_candidates(candidates: DataFrame, k: int = 5) -> DataFrame:
    """The best score of each code, then the first ``k`` of each needle by score and name."""
    best = candidates.groupBy("needle", "code").agg(F.max_by(F.struct("name", "type_code", "score", "source"), F.struct("score", "source")).alias("b")).select("needle", "code", "b.*")
    order = Window.partitionBy("needle").orderBy(F.desc("score"), "name", "code")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def resolve_competencies(asked: DataFrame, catalogue: DataFrame, aliases: DataFrame, threshold: float = 78.0, k: int = 5) -> DataFrame:
    """Candidates of each needle from all tiers: a code that fits stands alone; else aliases and the most similar name."""
    direct = exact_and_alias(asked, catalogue, aliases)
    rest = asked.join(direct.filter("source = 'exact'").select("needle").distinct(), "needle", "left_anti")
    similar = fuzzy_top(rest.select("needle"), catalogue.select("code", "name"), max(50.0, threshold - 15))
    typed = similar.join(catalogue.select("code", "type_code"), "code").join(rest.select("needle", "hint"), "needle")
    score = F.col("score") + F.when(F.col("hint").isNull(), 0.0).when(F.col("hint") == F.col("type_code"), FUZZY_HINT).otherwise(FUZZY_MISS)
    fuzzy = typed.select("needle", "code", "name", "type_code", score.alias("score"), F.lit("fuzzy").alias("source"))
    return best_candidates(direct.unionByName(fuzzy), k)


def ambiguous(ranked: DataFrame, margin: float = 5.0) -> DataFrame:
    """Whether the two best candidates of a needle differ by less than ``margin``."""
    scores = ranked.groupBy("needle").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("b"))
    return scores.select("needle", F.coalesce(F.col("a") - F.col("b") < margin, F.lit(False)).alias("ambiguous"))


def match_careers(needles: DataFrame, names: DataFrame, aliases: DataFrame, abbreviations: DataFrame, threshold: float | None = 78.0) -> DataFrame:
    """needle, name, source: the career that is meant, by alias, by abbreviation (ASCII, six characters at most), by
    name in any case, and unless ``threshold`` is null by similarity; the first of these that gives a known name."""
    asked = needles.select("needle", F.trim("needle").alias("key")).filter("key <> ''").distinct()
    known = names.select("name").distinct()

    def by(table: DataFrame, source: str, rows: DataFrame) -> DataFrame:
        keyed = table.select(F.lower("alias").alias("low_alias"), F.col("canonical").alias("name")).join(known, "name")
        return rows.join(keyed, F.lower("key") == F.col("low_alias")).groupBy("needle").agg(F.min("name").alias("name")).withColumn("source", F.lit(source))

    short = asked.filter((F.length("key") <= 6) & F.col("key").rlike(r"^[\x00-\x7F]*$"))
    same = known.select("name", F.col("name").alias("alias"), F.col("name").alias("canonical"))
    tiers = [by(aliases, "alias", asked), by(abbreviations, "abbreviation", short), by(same, "exact", asked)]
    found = tiers[0]
    for tier in tiers[1:]:
        found = found.unionByName(tier.join(found.select("needle"), "needle", "left_anti"))
    if threshold is None:
        return found
    rest = asked.join(found.select("needle"), "needle", "left_anti").select("needle")
    similar = fuzzy_top(rest, known.withColumn("code", F.lit(0)), threshold).select("needle", "name", F.lit("fuzzy").alias("source"))
    return found.unionByName(similar)


def known_codes(tokens: DataFrame, form: DataFrame, aliases: DataFrame, catalogue: DataFrame, label: Callable[[Column], Column]) -> DataFrame:
    """owner, code: the item codes that typed tokens (owner, token) stand for. A code stands for itself; else a token
    that the form map knows (form: token, codes) gives its codes; else the catalogue (code, name) is asked for the
    names that its aliases (alias, canonical) and the token itself have under ``label``."""
    asked = tokens.withColumn("key", F.trim("token")).filter((F.col("key") != "") & (F.lower("key") != "none")).withColumn("low", F.lower(F.regexp_replace("key", r"\s+", " ")))
    is_code = F.upper("key").rlike(ITEM_CODE)
    direct = asked.filter(is_code).select("owner", F.upper("key").alias("code"))
    mapped = asked.filter(~is_code).join(form.select(F.lower("token").alias("low"), "codes"), "low", "left")
    by_form = mapped.filter(F.col("codes").isNotNull()).select("owner", F.explode("codes").alias("code"))
    rest = mapped.filter(F.col("codes").isNull())
    index = catalogue.groupBy(label(F.col("name")).alias("label")).agg(F.max("code").alias("code")).filter("label <> ''")
    other = rest.join(aliases.select(F.lower("alias").alias("low"), "canonical"), "low").select("owner", label(F.col("canonical")).alias("label"))
    by_name = other.unionByName(rest.select("owner", label(F.col("key")).alias("label"))).join(index, "label").select("owner", "code")
    return direct.unionByName(by_form).unionByName(by_name).distinct()


def with_mapped(matches: DataFrame, subjects: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Competencies that a text names (``key``, place, name) and those that its subjects stand for (subject; mapping:
    subject, at, name), each once: the named ones first, then in the order of subjects and mapping."""
    named = matches.select(key, F.struct(F.lit(0).alias("arm"), F.col("place").alias("a"), F.lit(0).alias("b")).alias("at"), "name")
    # of a subject only its first place can give a name, and of a name only its first position in the mapping
    firsts = subjects.groupBy(key, "subject").agg(F.min("place").alias("place"))
    names = mapping.withColumn("name", F.trim("name")).filter("name <> ''").groupBy("subject", "name").agg(F.min("at").alias("at"))
    mapped = firsts.join(names, "subject").select(key, F.struct(F.lit(1).alias("arm"), F.col("place").alias("a"), F.col("at").alias("b")).alias("at"), "name")
    return named.unionByName(mapped).groupBy(key, "name").agg(F.min("at").alias("at")).select(key, "name", F.col("at.arm").alias("arm"), F.col("at.a").alias("place"), F.col("at.b").alias("position"))
