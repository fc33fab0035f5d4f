"""Templates: {name} in URLs (strict and lenient), action templates, {{name}} in headers and JSON or form bodies."""

from __future__ import annotations

import json
import re
from urllib.parse import quote_plus

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls


class TemplateError(ValueError):
    """A variable or filter that the template needs is not there."""


def variable_value(url: Column, source: str, pattern: str) -> Column:
    """A variable's value out of a URL; null if its path index or its pattern finds nothing.

    path: an index, else a pattern that is tried from the last segment on; url: the last segment that the pattern matches,
    with its first group if it has one; path_rest: segments from an index on; query: a key's first value; fixed: the
    pattern itself.
    """
    parts = urls.segments(urls.path(url))
    if source == "fixed":
        return F.lit(pattern)
    if source == "query":
        return urls.query_value(url, pattern)
    if source == "path_rest":
        at = int(pattern)
        return F.when(F.size(parts) > at, F.array_join(F.slice(parts, at + 1, F.greatest(F.size(parts), F.lit(1))), "/"))
    if source not in ("path", "url"):
        raise TemplateError(f"source {source!r}")
    if pattern.isdigit():
        return F.get(parts, int(pattern))
    try:
        groups = re.compile(pattern).groups
    except re.error:
        return F.element_at(F.concat(F.array(F.lit(None).cast("string")), parts), -1)
    hits = F.filter(F.reverse(parts), lambda s: s.rlike(pattern))
    return F.get(F.transform(hits, lambda s: F.regexp_extract(s, pattern, min(groups, 1))), 0)


def fill_strict(template: Column, url: Column, variables: list[tuple[str, str, str]]) -> Column:
    """The template with every variable in place, in order; null if one of those that it names has no value."""
    out = template
    for name, source, pattern in variables:
        place = F.lit("{" + name + "}")
        out = F.when(~out.contains(place), out).otherwise(F.replace(out, place, variable_value(url, source, pattern)))
    return out


def fill_lenient(template: Column, url: Column, variables: list[tuple[str, str, str]]) -> Column:
    """As fill_strict, but what has no value stays as it is."""
    out = template
    for name, source, pattern in variables:
        out = F.coalesce(F.replace(out, F.lit("{" + name + "}"), variable_value(url, source, pattern)), out)
    return out


def fill_action(template: Column, name: str, value: Column, in_url: bool = False) -> Column:
    """An action's URL: the value escaped unless it stands for a URL; an escaped placeholder is replaced as well."""
    coded = value if in_url else F.url_encode(value)
    return F.replace(F.replace(template, F.lit("{" + name + "}"), coded), F.lit("%7B" + name + "%7D"), coded)


def render(template: str, values: dict[str, str], cookies: dict[str, str] | None = None) -> str:
    """{{name}} and {{cookie.name}} as they are, unknown ones empty; values are rendered again if they hold {{."""
    for _ in range(1000):
        start = template.find("{{")
        if start < 0:
            return template
        end = template.find("}}", start)
        if end < 0:
            raise TemplateError("unclosed {{")
        name = template[start + 2 : end].strip()
        value = (cookies or {}).get(name[7:], "") if name.startswith("cookie.") else values.get(name, "")
        template = template[:start] + value + template[end + 2 :]
    raise TemplateError("values that name each other")


_SLOT = re.compile(r"\{\{\s*([^|}]+?)\s*(?:\|\s*(\w+)\s*)?\}\}")


def render_json(template: str, values: dict[str, str]) -> str:
    """{{name}} raw, {{name|json}} as a JSON string, {{name|json_array}} as an array of its comma-separated parts."""

    def one(m: re.Match) -> str:
        value = values.get(m[1], "")
        if m[2] is None:
            return value
        if m[2] == "json":
            return json.dumps(value, ensure_ascii=False)
        if m[2] == "json_array":
            text = value.strip()
            if text.startswith("["):
                return json.dumps(json.loads(text), ensure_ascii=False)
            return json.dumps([p.strip() for p in text.split(",") if p.strip()], ensure_ascii=False)
        raise TemplateError(f"filter {m[2]!r}")

    return _SLOT.sub(one, template)


def render_form(template: str, values: dict[str, str]) -> str:
    return _SLOT.sub(lambda m: quote_plus(values.get(m[1], "")), template)
