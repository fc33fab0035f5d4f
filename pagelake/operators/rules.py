"""Rule-driven extraction: CSS rules to typed entities, article content, and grouped table rows."""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.css import SelectorError, compile_selector, select_all, select_one
from ..functions.dom import Node, collapse, parse_html, trim
from .extract import dumps, map_pages


@dataclasses.dataclass(frozen=True)
class Field:
    """A value to extract: type string, number or list; fallbacks are tried in order; row: its row in a group."""

    name: str
    selector: str = ""
    selectors: tuple[str, ...] = ()
    attribute: str = ""
    type: str = "string"
    required: bool = False
    item_fields: tuple[Field, ...] = ()
    row: int = 0


@dataclasses.dataclass(frozen=True)
class Rules:
    content_selector: str = ""
    title_selector: str = ""
    author_selector: str = ""
    date_selector: str = ""
    ignore_selectors: tuple[str, ...] = ()
    page_type: str = ""
    fields: tuple[Field, ...] = ()
    entity_fields: tuple[Field, ...] = ()
    container: str = ""
    group_size: int = 1
    row_fields: tuple[Field, ...] = ()


def check_rules(rules: Rules) -> list[str]:
    """What is wrong with the rules: selectors that cannot be read, a group size under 1."""
    faults = [] if rules.group_size >= 1 else [f"group_size {rules.group_size}: at least 1 is needed"]

    def look(place: str, selector: str) -> None:
        if selector:
            try:
                compile_selector(selector)
            except SelectorError as error:
                faults.append(f"{place}: {error}")

    def deep(field: Field, place: str) -> None:
        for s in (field.selector, *field.selectors):
            look(f"{place}{field.name}", s)
        for sub in field.item_fields:
            deep(sub, f"{place}{field.name}.")

    for name in ("content_selector", "title_selector", "author_selector", "date_selector", "container"):
        look(name, getattr(rules, name))
    for s in rules.ignore_selectors:
        look("ignore_selectors", s)
    for f in (*rules.fields, *rules.entity_fields, *rules.row_fields):
        deep(f, "")
    return faults


def number_text(text: str) -> str:
    """A number's digits: a k or m at the end multiplies, other signs than digits, point and minus go."""
    text = text.strip()
    for end, factor in (("k", 1000), ("m", 1_000_000)):
        if text.lower().endswith(end):
            try:
                return str(int(float(re.sub(r"[^0-9.-]", "", text[:-1])) * factor))
            except ValueError:
                pass
    return re.sub(r"[^0-9.-]", "", text)


def number(text: str) -> int | float | None:
    for kind in (int, float):
        try:
            return kind(number_text(text))
        except ValueError:
            continue
    return None


def _raw(node: Node | None, attribute: str) -> str:
    if node is None:
        return ""
    return node.attr(attribute) if attribute else trim(node.text_content())


def entity(root: Node, field: Field):
    """The field's value below root, None if no selector yields one."""
    for selector in (field.selector, *field.selectors):
        if field.type == "list":
            if field.item_fields:
                found = [{f.name: v for f in field.item_fields if (v := entity(n, f)) is not None} for n in select_all(root, selector)]
            else:
                found = [n.text_content().strip() for n in select_all(root, selector)]
            value = [x for x in found if x] or None
        else:
            raw = _raw(select_one(root, selector), field.attribute)
            value = number(raw) if field.type == "number" else raw or None
        if value is not None:
            return value
    return None


def _without(document: Node, selectors: Sequence[str]) -> Node:
    for selector in selectors:
        for node in select_all(document, selector):
            if node.parent is not None and node in node.parent.children:
                node.parent.children.remove(node)
    return document


def _title(document: Node, rules: Rules) -> str:
    title = _raw(select_one(document, rules.title_selector), "") if rules.title_selector else ""
    for fallback in ("h1", "title"):
        title = title or _raw(select_one(document, fallback), "")
    return title


def clean_content(html: str, rules: Rules) -> dict:
    """title, author, date, content and extra fields; all null where the content selector finds nothing."""
    document = _without(parse_html(html), rules.ignore_selectors)
    content = collapse(_raw(select_one(document, rules.content_selector), ""))
    if not content:
        return dict.fromkeys(("title", "author", "date", "content", "fields"))
    extra = {f.name: v for f in rules.fields if (v := _raw(select_one(document, f.selector), f.attribute))}
    one = lambda s: (_raw(select_one(document, s), "") or None) if s else None
    return {"title": _title(document, rules) or None, "author": one(rules.author_selector), "date": one(rules.date_selector), "content": content, "fields": extra or None}


def entities(html: str, rules: Rules) -> dict:
    """data (JSON of title, type and the entity fields) and missing_required."""
    document = _without(parse_html(html), rules.ignore_selectors)
    data: dict = {}
    if title := _title(document, rules):
        data["title"] = title
    if rules.page_type:
        data["type"] = rules.page_type
    missing = []
    for field in rules.entity_fields:
        value = entity(document, field)
        if value is not None:
            data[field.name] = value
        elif field.required:
            missing.append(field.name)
    return {"data": dumps(data), "missing_required": missing or None}


def row_groups(html: str, rules: Rules) -> list[dict]:
    """One item per whole group of group_size rows of the container (its first tbody if it has one)."""
    if rules.group_size < 1:
        raise ValueError("group_size must be at least 1")
    container = select_one(parse_html(html), rules.container)
    if container is None:
        return []
    inner = next((c for c in container.children if c.tag == "tbody"), container)
    rows = [c for c in inner.children if c.tag == "tr"]
    items = []
    for start in range(0, len(rows) - rules.group_size + 1, rules.group_size):
        item = {}
        for f in rules.row_fields:
            if 0 <= f.row < rules.group_size:
                row = rows[start + f.row]
                raw = _raw(select_one(row, f.selector) if f.selector else row, f.attribute)
                value = number(raw) if f.type == "number" and raw else raw
                if value not in ("", None):
                    item[f.name] = value
        if item:
            items.append(item)
    return items


def table_rows(html: str, rules: Rules) -> dict:
    """data (JSON of title, type and the items) and what the first item lacks; null data without items."""
    items = row_groups(html, rules)
    if not items:
        return {"data": None, "missing_required": None}
    data: dict = {"type": rules.page_type} if rules.page_type else {}
    if rules.title_selector and (title := _raw(select_one(parse_html(html), rules.title_selector), "")):
        data["title"] = title
    data[rules.entity_fields[0].name if rules.entity_fields else "items"] = items
    return {"data": dumps(data), "missing_required": [f.name for f in rules.row_fields if f.required and f.name not in items[0]] or None}


CONTENT = {"title": "string", "author": "string", "date": "string", "content": "string", "fields": "map<string,string>"}
ENTITIES = {"data": "string", "missing_required": "array<string>"}


def _checked(rules: Rules) -> Rules:
    if faults := check_rules(rules):
        raise ValueError("; ".join(faults))
    return rules


def extract_content(pages: DataFrame, rules: Rules) -> DataFrame:
    rules = _checked(rules)
    return map_pages(pages, lambda h, u: clean_content(h, rules), tuple(CONTENT), CONTENT)


def extract_entities(pages: DataFrame, rules: Rules) -> DataFrame:
    rules = _checked(rules)
    return map_pages(pages, lambda h, u: entities(h, rules), tuple(ENTITIES), ENTITIES)


def extract_rows(pages: DataFrame, rules: Rules) -> DataFrame:
    rules = _checked(rules)
    return map_pages(pages, lambda h, u: table_rows(h, rules), tuple(ENTITIES), ENTITIES)


def select_nodes(pages: DataFrame, selector: str) -> DataFrame:
    """pages with nodes: tag, attributes, own text and whole text of every element that the selector matches."""
    compile_selector(selector)
    kinds = {"nodes": "array<struct<tag:string,attrs:map<string,string>,text:string,text_content:string>>"}

    def make(html: str, _: str) -> dict:
        found = select_all(parse_html(html), selector)
        own = lambda n: "".join(c.text for c in n.children if not c.tag)
        return {"nodes": [{"tag": n.tag, "attrs": list(n.attrs.items()), "text": own(n), "text_content": n.text_content()} for n in found]}

    return map_pages(pages, make, ("nodes",), kinds)
