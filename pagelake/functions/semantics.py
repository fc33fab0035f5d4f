"""How well an endpoint's answer fits a target URL: scores of its URL and of the leaves of its body, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import jsons, urls

#: The score without signals, and JSON keys whose value names a thing.
NO_SIGNALS = 0.6
NAMING_KEYS = ("slug", "handle", "subreddit", "repo", "owner", "name", "title", "path", "permalink", "url", "link", "html_url", "canonical_url")


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _own_path(url: Column) -> Column:
    """The decoded path, lower-cased, without slashes at its ends."""
    path = F.replace(urls.path(url), F.lit("+"), F.lit("%2B"))
    return F.lower(F.regexp_replace(_decoded(path), "^/+|/+$", ""))


def _without_json(path: Column) -> Column:
    return F.regexp_replace(path, r"\.json$", "")


def target_signals(url: Column) -> Column:
    """What a target URL tells: raw, path, last (segment), pair (the last two), tokens (of the last), ids (query values)."""
    path = _own_path(url)
    parts = F.filter(F.transform(F.split(path, "/"), lambda s: F.trim(_without_json(s))), lambda s: s != "")
    last = F.element_at(F.concat(F.array(F.lit("")), parts), -1)
    values = F.transform(F.split(urls.query(url), "&"), lambda p: F.lower(F.trim(_decoded(F.regexp_replace(p, "^[^=]*=?", "")))))
    return F.struct(
        F.lower(F.trim(url)).alias("raw"),
        path.alias("path"),
        last.alias("last"),
        F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), "/")).otherwise(F.lit("")).alias("pair"),
        F.filter(F.split(last, "[-_./]"), lambda t: t != "").alias("tokens"),
        F.filter(values, lambda v: v != "").alias("ids"),
    )


def _holds(text: Column, part: Column) -> Column:
    return (part != "") & text.contains(part)


def url_score(signals: Column, url: Column) -> Column:
    """How an endpoint's path fits: equal, equal but for .json, holding the target's last two segments or its last."""
    own, path = _own_path(url), signals["path"]
    return (
        F.when((own == path) & (own != ""), 0.72)
        .when((_without_json(own) == path) & (own != ""), 0.82)
        .when(_holds(own, signals["pair"]), 0.66)
        .when(_holds(own, signals["last"]), 0.58)
        .otherwise(0.0)
    )


def text_score(signals: Column, key: Column, value: Column) -> Column:
    """How a JSON text under a key names the target: from the URL itself down to a mere query value."""
    v, k, path, last, pair, tokens = F.lower(F.trim(value)), F.lower(key), signals["path"], signals["last"], signals["pair"], signals["tokens"]
    own, is_url = _own_path(v), v.rlike("^https?://")
    found = F.size(F.filter(tokens, lambda t: v.contains(t)))
    return (
        F.when(v == "", 0.0)
        .when(v == signals["raw"], 1.0)
        .when(is_url & (own == path) & (own != ""), 1.0)
        .when(is_url & (_without_json(own) == path) & (own != ""), 0.94)
        .when(is_url & _holds(own, pair), 0.88)
        .when((k == "full_name") & _holds(v, pair), 0.95)
        .when(k.isin(*NAMING_KEYS) & (last != "") & (v == last), 0.9)
        .when(_holds(v, last) & (F.size(tokens) == 0), 0.74)
        .when(_holds(v, last) & (found == F.size(tokens)), 0.84)
        .when(_holds(v, last) & (found > 0), 0.7)
        .when(_holds(v, pair), 0.86)
        .when(F.array_contains(signals["ids"], v), 0.94)
        .otherwise(0.0)
    )


def leaf_score(signals: Column, leaf: Column) -> Column:
    """Of a leaf (key, type, text): texts by their ladder, numbers under id or *_id that the target's query holds."""
    key = F.lower(leaf["key"])
    number = leaf["text"].try_cast("double").cast("bigint").cast("string")
    is_id = (leaf["type"] == "number") & ((key == "id") | key.endswith("_id")) & F.array_contains(signals["ids"], number)
    return F.when(leaf["type"] == "string", text_score(signals, key, leaf["text"])).when(is_id, 0.96).otherwise(0.0)


def body_score(signals: Column, body: Column) -> Column:
    """The best leaf of a JSON body, five levels down and twelve items along; 0 for none or no JSON."""
    return F.coalesce(F.array_max(F.transform(jsons.leaves_column(body), lambda x: leaf_score(signals, x))), F.lit(0.0))


def semantic_score(target: Column, url: Column, body: Column) -> Column:
    """The better of the URL's and the body's score; a target without path and query values tells nothing."""
    signals = target_signals(target)
    score = F.greatest(url_score(signals, url), body_score(signals, body))
    return F.when((signals["path"] == "") & (F.size(signals["ids"]) == 0), NO_SIGNALS).otherwise(score)
