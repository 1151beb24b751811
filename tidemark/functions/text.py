"""Text cleaning as column expressions: everything stays in whole-stage code, no Python worker.

White space is Unicode's, and the four separators U+001C to U+001F. HTML entities are those of HTML 5, all of them:
named (also the old names without a semicolon, the longest that fits) and numeric, as browsers read them.
"""

from __future__ import annotations

import json
from functools import cache, reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values ---------------------------------------------------------------
PLACEHOLDERS = ("[deleted]", "[removed]", "deleted", "removed")
PROMOTIONAL = (
    r"\breferral\s+(?:link|code)\b",
    r"\bref\s+code\b",
    r"\bpromo\s+code\b",
    r"\baffiliate\s+link\b",
    r"\bjoin\s+(?:my|our)\s+telegram\b",
    r"\bjoin\s+(?:my|our)\s+discord\b",
    r"\bguaranteed\s+(?:profit|return|returns)\b",
    r"\bdouble\s+your\s+(?:btc|bitcoin|eth|ethereum|crypto)\b",
)
RECURRING = (
    r"^\s*daily\s+discussion\b",
    r"^\s*bitcoin\s+daily\s+discussion\b",
    r"^\s*daily\s+bitcoin\s+discussion\b",
    r"^\s*daily\s+altcoin\s+discussion\b",
    r"^\s*altcoin\s+discussion\b",
)
#: Steps of clean_text after unescaping: pattern, replacement.
CLEANING = (
    (r"[\u200B-\u200D\uFEFF]", ""),
    (r"(?s)```.*?```", " "),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"(?iU)https?://[^\s\x1C-\x1F]+", " "),
    (r"(?iU)www\.[^\s\x1C-\x1F]+", " "),
    (r"<[^>]+>", " "),
    (r"[*_~`]+", ""),
    (r"(?mU)^[\s\x1C-\x1F]*>[\s\x1C-\x1F]?", ""),
)
# ----------------------------------------------------------------------------

Text = Column | str


def _col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_text(c: Text) -> Column:
    """Null becomes ''."""
    return F.coalesce(_col(c), F.lit(""))


#: Unicode white space; patterns that hold it begin with (?U).
SPACE = r"[\s\x1C-\x1F]"


def strip(c: Text) -> Column:
    """Without the Unicode white space at both ends (trim() only knows blanks)."""
    return F.regexp_replace(_col(c), rf"(?U)^{SPACE}+|{SPACE}+$", "")


def squeeze(c: Text) -> Column:
    """Runs of Unicode white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), rf"(?U){SPACE}+", " "))


@cache
def _numeric_exceptions() -> dict[int, str]:
    """Code points that a numeric entity doesn't stand for itself: those of Windows-1252, carriage return, and what HTML leaves out."""
    out = {0: "\ufffd", 0x0D: "\r"}
    for n in range(0x80, 0xA0):
        out[n] = bytes([n]).decode("cp1252", "ignore") or chr(n)
    dropped = [*range(1, 9), 0x0B, *range(0x0E, 0x20), 0x7F, *range(0xFDD0, 0xFDF0)]
    dropped += [plane << 16 | low for plane in range(17) for low in (0xFFFE, 0xFFFF)]
    return out | dict.fromkeys(dropped, "")


def _map(pairs: dict) -> Column:
    """A constant map of strings: one literal, which the optimizer reads once, in place of thousands."""
    return F.from_json(F.lit(json.dumps({str(k): v for k, v in pairs.items()})), "map<string,string>")


def unescape(c: Text) -> Column:
    """HTML entities as the characters they name; texts without & skip the work."""
    text = _col(c)
    closed = {k: v for k, v in html5.items() if k.endswith(";")}
    open_ = {k: v for k, v in html5.items() if not k.endswith(";")}
    longest_first = "|".join(sorted(open_, key=lambda k: (-len(k), k)))

    def number(part: Column, pattern: str, base: int, most: int) -> Column:
        """The character of the digits after # (or #x), U+FFFD beyond Unicode."""
        digits = F.regexp_replace(F.regexp_extract(part, pattern, 1), "^0+(?=.)", "")
        code = F.when(F.length(digits) > most, 0x110000).otherwise(F.conv(digits, base, 10).cast("int"))
        own = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        bad = (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        return F.when(bad, F.lit("\ufffd")).otherwise(F.coalesce(F.element_at(_map(_numeric_exceptions()), code.cast("string")), own))

    def decode(part: Column) -> Column:
        decimal, hexadecimal = r"^#([0-9]+);?", r"^#[xX]([0-9a-fA-F]+);?"
        name = F.regexp_extract(part, r"^([^\t\n\f <&#;]{1,32};)", 1)
        named, old = F.element_at(_map(closed), name), F.regexp_extract(part, f"^({longest_first})", 1)
        rest = lambda n: F.substring(part, n + 1, F.length(part))
        whole = F.concat(F.lit("&"), part)
        numeric = F.when(part.rlike(decimal), F.concat(number(part, decimal, 10, 7), F.regexp_replace(part, decimal, ""))).when(part.rlike(hexadecimal), F.concat(number(part, hexadecimal, 16, 6), F.regexp_replace(part, hexadecimal, "")))
        word = F.coalesce(F.concat(named, rest(F.length(name))), F.concat(F.element_at(_map(open_), old), rest(F.length(old))))
        return F.coalesce(F.when(part.startswith("#"), numeric).otherwise(word), whole)

    parts = F.split(text, "&")
    found = F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), decode), ""))
    return F.when(text.contains("&"), found).otherwise(text)


def clean_text(c: Text) -> Column:
    """Text without mark-up, links and invisible characters; case, punctuation and emoji stay."""
    return squeeze(reduce(lambda t, step: F.regexp_replace(t, *step), CLEANING, unescape(safe_text(c))))


def matching_key(c: Text) -> Column:
    """Lower-case letters, digits and single blanks: equal keys are exact duplicates."""
    text = unescape(F.lower(safe_text(c)))
    for pattern in (r"(?U)https?://[^\s\x1C-\x1F]+", r"(?U)www\.[^\s\x1C-\x1F]+", r"(?U)[^a-z0-9\s\x1C-\x1F]"):
        text = F.regexp_replace(text, pattern, " ")
    return squeeze(text)


def letter_count(c: Text) -> Column:
    """Unicode letters in the text."""
    return F.length(F.regexp_replace(safe_text(c), r"\P{L}+", ""))


def is_placeholder(c: Text) -> Column:
    return F.lower(strip(safe_text(c))).isin(*PLACEHOLDERS)


def matches_any(c: Text, patterns) -> Column:
    """Whether any pattern is found, whatever the case: one alternation, one pass."""
    return safe_text(c).rlike("(?i)(?:" + "|".join(patterns) + ")")


def combine(title: Text, body: Text) -> Column:
    """'title. body' if both have text, else the one that has."""
    t, b = safe_text(title), safe_text(body)
    return F.when(t == "", b).when(b == "", t).otherwise(F.concat(t, F.lit(". "), b))


def present(c: Text) -> Column:
    """Whether an optional id is there: not blank, 'nan' or 'none'."""
    return ~F.lower(strip(safe_text(c))).isin("", "nan", "none")


def model_input(c: Text) -> Column:
    """Mentions as @user and links as http, word by word."""
    words = F.split(safe_text(c), " ")
    one = lambda w: F.when(w.startswith("@") & (F.length(w) > 1), "@user").when(w.startswith("http"), "http").otherwise(w)
    return F.array_join(F.transform(words, one), " ")


def slug(c: Text) -> Column:
    """Lower case, other than letters and digits as single underscores, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "_"), F.lit("_"))
