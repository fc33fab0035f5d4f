"""CSS selectors over the HTML tree: groups, combinators, attributes, :first-child, :last-child, :nth-child, :not, :has, :contains."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from .dom import Node

Test = Callable[[Node], bool]

_NAME = r"-?(?:[_a-zA-Z\u0080-￿]|\\.)(?:[-_a-zA-Z0-9\u0080-￿]|\\.)*"
_TOKEN = re.compile(
    rf"""(?P<space>\s*(?P<comb>[>+~,])\s*|\s+)|(?P<tag>\*|{_NAME})|\#(?P<id>(?:[-_a-zA-Z0-9\u0080-￿]|\\.)+)|\.(?P<cls>{_NAME})
    |\[\s*(?P<attr>[-_:a-zA-Z0-9]+)\s*(?:(?P<op>[~|^$*!]?=)\s*(?P<val>"[^"]*"|'[^']*'|[^\]\s]+)\s*(?P<flag>[iI])?\s*)?\]|:(?P<pseudo>[-a-zA-Z]+)""",
    re.X,
)


class SelectorError(ValueError):
    """The text is not a selector that is understood here."""


def _siblings(node: Node) -> list[Node]:
    return [n for n in node.parent.children if n.tag] if node.parent else [node]


def _attribute(name: str, op: str | None, value: str, fold: bool) -> Test:
    value = value.lower() if fold else value

    def test(node: Node) -> bool:
        if name not in node.attrs:
            return op == "!="
        own = node.attrs[name].lower() if fold else node.attrs[name]
        match op:
            case None:
                return True
            case "=":
                return own == value
            case "!=":
                return own != value
            case "~=":
                return value in own.split()
            case "|=":
                return own == value or own.startswith(value + "-")
            case "^=":
                return bool(value) and own.startswith(value)
            case "$=":
                return bool(value) and own.endswith(value)
        return bool(value) and value in own

    return test


def _nth(text: str) -> tuple[int, int]:
    text = text.replace(" ", "").lower()
    if text in ("odd", "even"):
        return 2, int(text == "odd")
    if m := re.fullmatch(r"([+-]?\d*)n([+-]\d+)?", text):
        step = m[1] if m[1] not in ("", "+", "-") else m[1] + "1"
        return int(step), int(m[2] or 0)
    if re.fullmatch(r"[+-]?\d+", text):
        return 0, int(text)
    raise SelectorError(f"position {text!r}")


def _pseudo(name: str, inner: str | None) -> Test:
    if name in ("not", "has", "matches", "is") and inner is not None:
        found = compile_selector(inner)
        if name == "not":
            return lambda n: not found(n)
        return found if name != "has" else lambda n: any(found(x) for c in n.children for x in c.elements())
    if name in ("contains", "containsown") and inner is not None:
        want = inner.strip().strip("\"'").lower()
        return lambda n: want in (n.text_content() if name == "contains" else "".join(c.text for c in n.children if not c.tag)).lower()
    if name == "empty":
        return lambda n: not any(c.tag or c.text for c in n.children)
    if name == "root":
        return lambda n: n.parent is not None and n.parent.tag == "#document"
    positions = {"first-child": (0, 1, 0, 0), "last-child": (0, 1, 1, 0), "first-of-type": (0, 1, 0, 1), "last-of-type": (0, 1, 1, 1)}
    if name in ("only-child", "only-of-type"):
        return lambda n: sum(1 for s in _siblings(n) if name == "only-child" or s.tag == n.tag) == 1
    if name in positions:
        step, offset, reverse, typed = positions[name]
    elif inner is not None and name in ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type"):
        (step, offset), reverse, typed = _nth(inner), "last" in name, "type" in name
    else:
        raise SelectorError(f":{name}")

    def test(node: Node) -> bool:
        same = [s for s in _siblings(node) if not typed or s.tag == node.tag]
        place = (len(same) - same.index(node)) if reverse else same.index(node) + 1
        left = place - offset
        return left == 0 if step == 0 else left % step == 0 and left // step >= 0

    return test


def _argument(text: str, at: int) -> tuple[str, int]:
    depth = 0
    for k in range(at, len(text)):
        depth += (text[k] == "(") - (text[k] == ")")
        if not depth:
            return text[at + 1 : k], k + 1
    raise SelectorError("unclosed (")


def _unescaped(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name)


def _joined(left: Test, comb: str, right: Test) -> Test:
    def test(node: Node) -> bool:
        if not right(node):
            return False
        if comb == ">":
            return node.parent is not None and left(node.parent)
        if comb in "+~":
            row = _siblings(node)
            before = row[: row.index(node)]
            return any(map(left, before[-1:] if comb == "+" else before))
        up = node.parent
        while up is not None:
            if left(up):
                return True
            up = up.parent
        return False

    return test


@functools.lru_cache(maxsize=4096)
def compile_selector(text: str) -> Test:
    """The selector as a test of a node; SelectorError if it cannot be read."""
    text = text.strip()
    if not text:
        raise SelectorError("empty selector")
    groups: list[Test] = []
    left: Test | None = None
    comb = ""
    parts: list[Test] = []
    at = 0

    def close() -> Test:
        if not parts:
            raise SelectorError(f"nothing to match in {text!r}")
        own = tuple(parts)
        parts.clear()
        compound: Test = lambda n: bool(n.tag) and n.tag != "#document" and all(p(n) for p in own)
        return compound if left is None else _joined(left, comb, compound)

    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SelectorError(f"{text[at:]!r}")
        at = m.end()
        if m["space"] is not None:
            left = close()
            comb = m["comb"] or " "
            if comb == ",":
                groups.append(left)
                left = None
        elif m["tag"] is not None:
            if parts:
                raise SelectorError(f"{text!r}")
            name = _unescaped(m["tag"]).lower()
            parts.append((lambda n: True) if name == "*" else (lambda n, name=name: n.tag == name))
        elif m["id"] is not None:
            parts.append(lambda n, v=_unescaped(m["id"]): n.attrs.get("id") == v)
        elif m["cls"] is not None:
            parts.append(lambda n, v=_unescaped(m["cls"]): v in n.attrs.get("class", "").split())
        elif m["attr"] is not None:
            value = m["val"] or ""
            parts.append(_attribute(m["attr"].lower(), m["op"], value[1:-1] if value[:1] in "\"'" and value else value, bool(m["flag"])))
        else:
            inner = None
            if text[at : at + 1] == "(":
                inner, at = _argument(text, at)
            parts.append(_pseudo(m["pseudo"].lower(), inner))
    groups.append(close())
    return groups[0] if len(groups) == 1 else lambda n: any(g(n) for g in groups)


def select_one(root: Node, selector: str) -> Node | None:
    """The first element below root that matches (root too); None if none does or the selector is bad."""
    try:
        test = compile_selector(selector)
    except SelectorError:
        return None
    return root.find(test)


def select_all(root: Node, selector: str) -> list[Node]:
    try:
        test = compile_selector(selector)
    except SelectorError:
        return []
    return [n for n in root.elements() if test(n)]
