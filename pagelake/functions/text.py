"""Text, number and score scalars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases that mark a line of a page's text as noise.
NOISE_PHRASES = [
    "sign in", "sign up", "log in", "log out", "cookie", "privacy policy", "terms of service", "accept all", "reject all", "manage cookies",
    "skip to content", "skip to main", "toggle navigation", "close menu", "block user", "report abuse", "learn more about blocking",
    "you must be logged in", "loading", "please wait",
]
MAX_CLEAN = 2000


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def cut_bytes(text: Column, size: int) -> Column:
    """At most size bytes of UTF-8; a code point that would be split is left out."""
    data = F.substring(F.encode(text, "UTF-8"), 1, size)
    return F.when(F.octet_length(text) <= size, text).otherwise(F.regexp_replace(F.make_valid_utf8(data.cast("string")), "\ufffd+$", ""))


def contains_any(text: Column, phrases: list[str]) -> Column:
    """Whether the text holds one of the phrases; one pass, no phrase is a pattern."""
    quoted = "|".join("\\Q" + p + "\\E" for p in phrases)
    return text.rlike(quoted)


def clean_lines(text: Column, limit: int = MAX_CLEAN) -> Column:
    """Lines trimmed, without short, noisy and repeated ones, cut to limit bytes."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))  # F.trim alone would take the line's index as what to trim
    kept = F.filter(lines, lambda x: (F.octet_length(x) >= 3) & ~contains_any(F.lower(x), NOISE_PHRASES))
    return cut_bytes(F.array_join(F.array_distinct(kept), "\n"), limit)


def clean_body(text: Column, limit: int = MAX_CLEAN) -> Column:
    """A page's collapsed text as one line: empty if a noise phrase stands anywhere in it."""
    return F.when((F.octet_length(text) < 3) | contains_any(F.lower(text), NOISE_PHRASES), F.lit("")).otherwise(cut_bytes(text, limit))


def clean_number(text: Column) -> Column:
    """A number's text: a k or m at its end multiplies, other signs than digits, point and minus go."""
    t = F.lower(F.trim(text))
    digits = F.regexp_replace(t, "[^0-9.-]", "")
    scaled = lambda f: F.floor(digits.try_cast("double") * f).cast("bigint").cast("string")
    return F.coalesce(F.when(t.endswith("k"), scaled(1000)), F.when(t.endswith("m"), scaled(1_000_000)), digits)


def first_non_blank(*columns: Column) -> Column:
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def action_name(text: Column) -> Column:
    """Lower-cased, every run of other signs than letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def strip_fence(text: Column) -> Column:
    """The text inside a ``` fence, if it is fenced."""
    return F.trim(F.regexp_replace(F.trim(text), r"(?s)^```[a-zA-Z]*\n?(.*?)\n?```$", "$1"))


def redact(text: Column) -> Column:
    """A secret's first 8 and last 4 characters; nothing of one of 16 bytes or less."""
    return F.when(F.octet_length(text) <= 16, F.lit("<redacted>")).otherwise(F.concat(F.left(text, F.lit(8)), F.lit("…"), F.right(text, F.lit(4))))


def human_bytes(n: Column) -> Column:
    """A size in the largest unit that it reaches, to one decimal; halves go to the even digit."""
    out = F.concat(n.cast("string"), F.lit("B"))
    for power, unit in enumerate("KMGTPE", 1):
        out = F.when(n >= 1 << 10 * power, F.concat(F.format_string("%.1f", F.bround(n / float(1 << 10 * power), 1)), F.lit(f"{unit}B"))).otherwise(out)
    return out


def backoff_ms(attempt: Column, base_ms: int = 500, most_ms: int = 5000) -> Column:
    """Wait before a retry, without jitter."""
    return F.least(F.lit(base_ms) * F.pow(F.lit(2.0), attempt), F.lit(float(most_ms))).cast("bigint")


def ttl_seconds(text: Column) -> Column:
    """Seconds of a duration such as 7d, 12h, 30m or 45s; null for others."""
    unit = F.regexp_extract(text, r"^(\d+)([smhd])$", 2)
    factor = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    return F.regexp_extract(text, r"^(\d+)([smhd])$", 1).try_cast("bigint") * factor


def strip_script_style(html: Column) -> Column:
    """Without script and style elements; an unclosed one stays."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1[^>]*>", "")


def strip_tags(html: Column) -> Column:
    return collapse_whitespace(F.regexp_replace(strip_script_style(html), r"<[^>]*>", " "))


def is_thin(html: Column, least: int = 500) -> Column:
    """Whether a page has under `least` bytes of text."""
    return F.octet_length(strip_tags(html)) < least


def schema_type(name: Column) -> Column:
    """The page type of a schema.org type."""
    t = F.lower(name)
    has = lambda *words: F.lit(False) if not words else t.rlike("|".join(words))
    return (
        F.when(has("article", "blogposting", "newsarticle"), "article")
        .when(has("person", "profilepage"), "profile")
        .when(has("product"), "product")
        .when(t.isin("itemlist", "searchresultspage"), "listing")
        .when(has("apireference"), "documentation")
        .otherwise("generic")
    )


def merged_confidence(a: Column, b: Column) -> Column:
    """The greater one; values of zero or less count as absent."""
    up = lambda x: F.when(x > 0, x)
    return F.coalesce(F.greatest(up(a), up(b)), F.lit(0.0))
