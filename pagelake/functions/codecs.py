"""Digests and encodings of texts as Columns, and the envelope of a registry's answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha1_hex(text: Column) -> Column:
    return F.sha1(text.cast("binary"))


def base64_text(text: Column) -> Column:
    """The standard alphabet, padded, in one line."""
    return F.regexp_replace(F.base64(text.cast("binary")), r"[\r\n]", "")


def base64_url(text: Column) -> Column:
    """The alphabet of URLs, without padding."""
    return F.regexp_replace(F.translate(base64_text(text), "+/", "-_"), "=+$", "")


def from_base64(text: Column) -> Column:
    """The text behind a base64 text of either alphabet, padded or not, line ends aside; null if it is neither."""
    plain = F.regexp_replace(text, r"[\r\n]", "")
    groups = lambda signs: rf"^(?:[{signs}]{{4}})*(?:[{signs}]{{2}}(?:==)?|[{signs}]{{3}}=?)?$"
    known = plain.rlike(groups("A-Za-z0-9+/")) | plain.rlike(groups("A-Za-z0-9_-"))
    bare = F.regexp_replace(F.translate(plain, "-_", "+/"), "=+$", "")
    return F.when(known, F.unbase64(F.rpad(bare, F.ceil(F.length(bare) / 4).cast("int") * 4, F.lit("="))).cast("string"))


def hex_text(text: Column) -> Column:
    return F.lower(F.hex(text.cast("binary")))


def from_hex(text: Column) -> Column:
    """The text behind pairs of hex digits of any case; null if it is anything else."""
    return F.when(text.rlike("^(?:[0-9A-Fa-f]{2})*$"), F.unhex(text).cast("string"))


def unwrapped(body: Column) -> Column:
    """What a registry's answer {success, data, error: {code, message}} holds: data as JSON if it succeeded, else the error's code and message."""
    value = F.try_parse_json(body)
    ok = F.coalesce(F.try_variant_get(value, "$.success", "boolean"), F.lit(False))
    text = lambda path: F.when(~ok, F.coalesce(F.try_variant_get(value, path, "string"), F.lit("")))
    data = F.when(ok, F.to_json(F.try_variant_get(value, "$.data", "variant")))
    return F.struct(ok.alias("ok"), data.alias("data"), text("$.error.code").alias("code"), text("$.error.message").alias("message"))
