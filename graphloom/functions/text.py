"""Column expressions on text and URLs."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path segments that do not name a single course page.
GENERIC_SEGMENTS = ("", "courses", "course", "learn", "browse", "catalog", "training", "certification", "certifications")
#: Locale segments that may stand before a generic one.
LOCALES = ("en-us", "en", "vi", "vi-vn")


def normalised(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def slug(text: Column, most: int) -> Column:
    return F.substring(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), 1, most)


#: Letters with marks and the plain letter of each, by plain letter.
MARKED = {
    "a": "àáảãạăằắẳẵặâầấẩẫậäåāą", "e": "èéẻẽẹêềếểễệëēęě", "i": "ìíỉĩịîïīį", "o": "òóỏõọôồốổỗộơờớởỡợöōő", "u": "ùúủũụưừứửữựûüūůű",
    "y": "ỳýỷỹỵÿ", "c": "çćč", "d": "đď", "n": "ñńň", "s": "śšş", "z": "źżž", "r": "ř", "t": "ťţ", "g": "ğ", "l": "ľĺ",
}


@cache
def composed() -> tuple[str, str]:
    """All single characters that are composed with marks, and what they are without: first those of ``MARKED``."""
    marked = "".join(MARKED.values())
    plain = "".join(k * len(v) for k, v in MARKED.items())
    table = dict(zip(marked + marked.upper(), plain + plain.upper(), strict=True))
    for c in map(chr, (*range(0xC0, 0xD800), *range(0xF900, 0x30000))):
        if c not in table and unicodedata.decomposition(c)[:1] not in ("", "<"):
            bare = unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x)[0] != "M"))
            if len(bare) == 1 and bare != c:
                table[c] = bare
    return "".join(table), "".join(table.values())


def without_marks(text: Column) -> Column:
    """Letters without their diacritic marks, by a table; lower and upper case stay."""
    return F.translate(F.regexp_replace(text, r"\p{M}+", ""), *composed())


def ascii_pattern(pattern: str) -> str:
    """A pattern where words, their ends and white space are those of ASCII and only a line feed ends a line, as in RE2: to
    this version of Java a letter such as a sharp s is no end of a word."""
    edge = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
    ascii = {r"\b": edge, r"\s": r"[\t\n\f\r ]"}
    return "(?d)" + re.sub(r"\\.", lambda m: ascii.get(m[0], m[0]), pattern)


def trimmed(text: Column) -> Column:
    """Without space characters of any script at both ends."""
    return F.regexp_replace(text, r"^\p{Zs}+|\p{Zs}+$", "")


#: Words that may stand before a skill's name and a colon.
LABEL_PREFIXES = ("platform", "tool", "language", "framework", "library", "domain")


def label(text: Column) -> Column:
    """What a skill is compared by: without a prefix such as "tool:", trimmed, in lower case."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?i)^({'|'.join(LABEL_PREFIXES)})\s*:\s*", "")
    return F.lower(F.trim(bare))


def is_generic_url(url: Column) -> Column:
    """No URL, no host, no path, or a path of one generic segment, or of a locale and a generic segment."""
    raw = F.trim(F.coalesce(url, F.lit("")))
    full = F.when(raw.contains("://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    bare = F.regexp_replace(full, r"[?#].*$", "")
    host = F.regexp_extract(bare, r"^[^:]*://([^/]*)", 1)
    parts = F.filter(F.split(F.lower(F.regexp_extract(bare, r"^[^:]*://[^/]*(.*)$", 1)), "/"), lambda s: s != "")
    one = (F.size(parts) == 1) & F.get(parts, F.lit(0)).isin(*GENERIC_SEGMENTS)
    two = (F.size(parts) == 2) & F.get(parts, F.lit(0)).isin(*LOCALES) & F.get(parts, F.lit(1)).isin(*GENERIC_SEGMENTS)
    return (raw == "") | (host == "") | (F.size(parts) == 0) | F.coalesce(one, F.lit(False)) | F.coalesce(two, F.lit(False))


def links(html: Column) -> Column:
    """Targets of the links in a page, in order."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit('href="([^"]*)"'), 1)


def sentences(text: Column) -> Column:
    """Non-empty pieces between full stops, question and exclamation marks and line breaks."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)
