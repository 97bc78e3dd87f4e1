"""Similarity of short strings, for candidates that a join has found."""

from __future__ import annotations

from difflib import SequenceMatcher


def places_of(a: str) -> dict[str, int]:
    """A bit for each place of a character."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    return places


def common_length(a: str, b: str, places: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, by bit operations on a number of len(a) bits (``places`` of a, if known)."""
    places = places_of(a) if places is None else places
    whole = (1 << len(a)) - 1
    row = whole
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & whole
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """0 to 100: twice the common length over both lengths."""
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a piece of the longer one that is at most as long."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    pieces = {b[max(0, end - n) : end] for end in range(1, len(b) + n) if max(0, end - n) < len(b)}
    return max(ratio(a, p) for p in pieces)


def _words(a: str, b: str) -> tuple[str, str, str]:
    x, y = set(a.split()), set(b.split())
    return " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))


def word_ratio(a: str, b: str) -> float:
    """The best of the ratio of sorted words and those between the shared words and either side's words."""
    shared, left, right = _words(a, b)
    if not (a.split() and b.split()):
        return 0.0
    if shared and not (left and right):
        return 100.0
    one, two = f"{shared} {left}".strip(), f"{shared} {right}".strip()
    best = max(ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), ratio(one, two))
    return max(best, ratio(shared, one), ratio(shared, two)) if shared else best


def partial_word_ratio(a: str, b: str) -> float:
    shared, left, right = _words(a, b)
    if not (a.split() and b.split()):
        return 0.0
    if shared:
        return 100.0
    return max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial_ratio(left, right))


def weighted_ratio(a: str, b: str) -> float:
    """0 to 100: the plain ratio, or a discounted one of words; of pieces too where one string is much longer."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    if longer < 1.5:
        return max(ratio(a, b), 0.95 * word_ratio(a, b))
    piece = 0.9 if longer < 8 else 0.6
    return max(ratio(a, b), piece * partial_ratio(a, b), 0.95 * piece * partial_word_ratio(a, b))


def suggestion_score(query: str, name: str) -> float:
    """0 to 1.35: the ratio of matching blocks, and 0.35 more if the name holds the query."""
    a, b = query.lower(), name.lower()
    return SequenceMatcher(None, a, b).ratio() + (0.35 if a in b else 0.0)
