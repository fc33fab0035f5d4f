"""Templates that differ by row, as Column expressions: {name} filled from variables, {{name}} rendered from a map.

A template is cut at its slots by one pattern, the slots are looked up and the pieces joined again, so no Python sees a row. What the
reference treats as an error is null here: an unclosed {{, an unknown filter, a variable without a value. Values stand as they are: slots
that a value holds are not rendered again.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import urls

SLOT = r"(?s)\{\{(.*?)\}\}"
VARIABLES = "array<struct<name:string,source:string,pattern:string>>"


def query_escaped(text: Column) -> Column:
    """A text as it stands in a query or a form: blanks as +, letters, digits and -_.~ as they are."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def json_text(text: Column) -> Column:
    """A text as a JSON string; <, > and & and the two line separators escaped as well."""
    out = F.to_json(F.array(text))
    out = F.substring(out, 2, F.length(out) - 2)
    for sign in "<>&\u2028\u2029":
        out = F.replace(out, F.lit(sign), F.lit(f"\\u{ord(sign):04x}"))
    return out


def _rendered(template: Column, values: Column, cookies: Column | None, made: Callable[[Column, Column], Column], filters: bool) -> Column:
    """The template with made(value, filter) in place of each slot."""
    jar = F.create_map().cast("map<string,string>") if cookies is None else cookies

    def slot(inner: Column) -> Column:
        name = F.trim(F.regexp_extract(inner, r"(?s)^([^|]*)", 1), F.lit(" \t\r\n")) if filters else F.trim(inner, F.lit(" \t\r\n"))
        filtered = F.trim(F.regexp_extract(inner, r"(?s)^[^|]*\|(.*)$", 1), F.lit(" \t\r\n"))
        value = F.when(name.startswith("cookie."), F.try_element_at(jar, F.substring(name, 8, 1 << 30))).otherwise(F.try_element_at(values, name))
        return made(F.coalesce(value, F.lit("")), filtered)

    texts = F.split(template, SLOT, -1)
    slots = F.transform(F.regexp_extract_all(template, F.lit(SLOT), 1), slot)
    closed = ~F.element_at(texts, -1).contains("{{")
    whole = F.concat(F.get(texts, 0), F.array_join(F.zip_with(slots, F.slice(texts, 2, F.greatest(F.size(texts), F.lit(1))), lambda s, t: F.concat(s, t)), ""))
    return F.when(closed & ~F.exists(slots, lambda s: s.isNull()), whole)


def render(template: Column, values: Column, cookies: Column | None = None) -> Column:
    """{{name}} and {{cookie.name}} as they are, unknown ones empty; for URLs and headers."""
    return _rendered(template, values, cookies, lambda value, _: value, False)


def render_form(template: Column, values: Column, cookies: Column | None = None) -> Column:
    """{{name}} escaped for a form body."""
    return _rendered(template, values, cookies, lambda value, _: query_escaped(value), False)


def render_json(template: Column, values: Column, cookies: Column | None = None) -> Column:
    """{{name}} as the inside of a JSON string, {{name|json}} as a JSON string, {{name|json_array}} as the JSON strings of its
    comma-separated parts, without brackets."""

    def made(value: Column, how: Column) -> Column:
        quoted = json_text(value)
        blank = F.trim(value, F.lit(" \t\r\n")) == ""
        parts = F.array_join(F.transform(F.split(value, ",", -1), lambda p: json_text(F.trim(p, F.lit(" \t\r\n")))), ",")
        return F.when(how == "", F.substring(quoted, 2, F.length(quoted) - 2)).when(how == "json", quoted).when(how == "json_array", F.when(blank, "").otherwise(parts))

    return _rendered(template, values, cookies, made, True)


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _valid(patterns: pd.Series) -> pd.Series:
    def ok(pattern: str | None) -> bool:
        try:
            re.compile(pattern or "")
        except re.error:
            return False
        return True

    return patterns.map(lambda row: None if row is None else [ok(p) for p in row])


def checked(variables: Column) -> Column:
    """Variables with whether their pattern is one; to be asked once for each endpoint, before targets meet it."""
    found = _valid(F.transform(variables, lambda v: v["pattern"]))
    named = lambda p: F.replace(p, F.lit("(?P<"), F.lit("(?<"))
    return F.zip_with(variables, found, lambda v, ok: F.struct(v["name"].alias("name"), v["source"].alias("source"), named(v["pattern"]).alias("pattern"), ok.alias("ok")))


def variable(v: Column, url: Column) -> Column:
    """The value of a checked variable (name, source, pattern, ok) out of a URL; null if it has none."""
    path = F.regexp_replace(urls.path(url), r"^/+|/+\z", "")
    path = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    parts, index = F.split(path, "/", -1), F.when(v["pattern"].rlike(r"^[+-]?\d{1,9}$"), v["pattern"].cast("int"))
    fits = F.filter(F.reverse(parts), lambda s: F.rlike(s, v["pattern"]))
    last = F.get(F.filter(F.reverse(parts), lambda s: s != ""), 0)
    rest = F.when((index >= 0) & (index < F.size(parts)), F.array_join(F.slice(parts, index + 1, F.greatest(F.size(parts), F.lit(1))), "/"))
    pairs = F.transform(F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p != ""), lambda p: F.struct(F.try_url_decode(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), F.try_url_decode(F.regexp_extract(p, r"(?s)^[^=]*=(.*)\z", 1)).alias("v")))
    asked = F.coalesce(F.get(F.filter(pairs, lambda p: p["k"] == v["pattern"]), 0)["v"], F.lit(""))
    by_path = F.when(index.isNotNull(), F.get(parts, index)).when(v["ok"], F.get(fits, 0)).otherwise(last)
    return F.when(v["source"] == "fixed", v["pattern"]).when(v["source"] == "query", asked).when(v["source"] == "path_rest", rest).when(v["source"].isin("path", "url"), by_path)


def fill(template: Column, variables: Column, url: Column) -> Column:
    """{name} of each checked variable in turn; null if any of them has no value."""
    return F.aggregate(variables, template, lambda out, v: F.replace(out, F.concat(F.lit("{"), v["name"], F.lit("}")), variable(v, url)))
