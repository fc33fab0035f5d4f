"""JSON embedded in scripts: named script ids, assignments to variables and window properties, JSON.parse calls."""

from __future__ import annotations

import json
import re

from .dom import Node

#: Fixed values: (name, kind, key) in order; the first that yields a value for a name wins.
PATTERNS = [
    ("__NEXT_DATA__", "id", "__NEXT_DATA__"),
    ("__UNIVERSAL_DATA_FOR_REHYDRATION__", "id", "__UNIVERSAL_DATA_FOR_REHYDRATION__"),
    ("__FRONTITY_CONNECT_STATE__", "id", "__FRONTITY_CONNECT_STATE__"),
    ("SIGI_STATE", "id", "SIGI_STATE"),
    ("__NUXT_DATA__", "id", "__NUXT_DATA__"),
    ("__MODERN_ROUTER_DATA__", "id", "__MODERN_ROUTER_DATA__"),
    ("ytInitialData", "var", "ytInitialData"),
    ("ytInitialPlayerResponse", "var", "ytInitialPlayerResponse"),
    ("SIGI_STATE", "window", "SIGI_STATE"),
    ("__INITIAL_STATE__", "window", "__INITIAL_STATE__"),
    ("__APOLLO_STATE__", "window", "__APOLLO_STATE__"),
    ("__PRELOADED_STATE__", "window", "__PRELOADED_STATE__"),
    ("__remixContext", "window", "__remixContext"),
    ("__NUXT__", "window", "__NUXT__"),
    ("__MODERN_ROUTER_DATA__", "window", "__MODERN_ROUTER_DATA__"),
]
JSON_TYPES = ("application/json", "application/ld+json")
GENERIC_BYTES, ASSIGNMENT_BYTES = 100, 20

_LITERALS = re.compile(r"([:\[,])(\s*)(undefined|NaN|-Infinity|Infinity)\b")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}
_ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|(.))", re.S)


def _strict(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_constant=_strict)


def parse_json(text: str):
    """The value, or None if it is not JSON or is null or empty."""
    try:
        value = json.loads(text.strip(), parse_constant=_strict)
    except (ValueError, RecursionError):
        return None
    return None if value in ({}, [], None) else value


def sanitize_literals(text: str) -> str:
    """undefined, NaN and infinities after a colon, bracket or comma become null."""
    return _LITERALS.sub(r"\1\2null", text)


def unescape_js(text: str) -> str:
    def one(m: re.Match) -> str:
        return chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[3])

    return _ESCAPE.sub(one, text)


def leading_json(text: str):
    """The JSON object or array that text starts with; literals of JavaScript are mended if need be."""
    if text[:1] not in ("{", "["):
        return None
    for candidate in (text, sanitize_literals(text)):
        try:
            value, _ = _DECODER.raw_decode(candidate)
        except (ValueError, RecursionError):
            continue
        return None if value in ({}, []) else value
    return None


def _parse_call(text: str):
    m = re.match(r"JSON\.parse\(\s*(?:'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\")", text, re.S)
    return parse_json(unescape_js(m[1] if m[1] is not None else m[2])) if m else None


def _assigned(text: str, starts: list[str]):
    for start in starts:
        for m in re.finditer(start, text):
            if after := re.compile(r"\s*=\s*").match(text, m.end()):
                rest = text[after.end() :]
                if (value := leading_json(rest)) is not None or (value := _parse_call(rest)) is not None:
                    return value
    return None


def _value(kind: str, key: str, text: str):
    name = re.escape(key)
    if kind == "var":
        return _assigned(text, [rf"var {name}(?=[ \t=\n;]|$)"])
    return _assigned(text, [rf"window\.{name}", rf"window\['{name}'\]", rf'window\["{name}"\]'])


def script_values(script: Node, found: dict) -> None:
    """Adds what a script element holds to found, by name; names that are there stay."""
    text, own_id = "".join(c.text for c in script.children), script.attr("id")
    named = [p for p in PATTERNS if p[1] == "id" and p[2] == own_id]
    if named:
        value = parse_json(text)
        if value is not None:
            found.setdefault(named[0][0], value)
        return
    size = len(text.encode("utf-8", "replace"))
    if own_id and script.attr("type").strip().lower() in JSON_TYPES and size >= GENERIC_BYTES and own_id not in found:
        value = parse_json(text)
        if value is not None:
            found[own_id] = value
    if size < ASSIGNMENT_BYTES:
        return
    for name, kind, key in PATTERNS:
        if kind != "id" and name not in found and key in text:
            value = _value(kind, key, text)
            if value is not None:
                found[name] = value


def embedded(document: Node) -> dict:
    """All embedded values of a document, by name."""
    found: dict = {}
    for node in document.elements():
        if node.tag == "script":
            script_values(node, found)
    return found
