"""Page extraction: html to one record per page, parsed once for all fields.

The tree is built in one Arrow stage (mapInArrow), so that later filters and projections never parse a page again;
`fields` names the parts to return, so that unwanted ones are not built. Lengths are in bytes, cut on code points.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.dom import HEADINGS, Node, collapse, cut_bytes, parse_html, trim
from ..functions.scan import parse_json, script_values

MAX_BODY, MAX_HEADINGS, MAX_LINKS, MAX_IMAGES, MAX_FORMS, MAX_LINK_TEXT = 5000, 50, 50, 30, 10, 200
MAX_INPUT = 50 << 20
#: Records, and bytes, of a batch: pages are large; one alone may be larger.
BATCH_ROWS, BATCH_BYTES = 500, 32 << 20

#: Subtrees without visible text, elements that start a line, marks of hidden elements.
SKIPPED = frozenset("script style noscript nav footer header dialog template svg".split())
HIDDEN_CLASSES = ("sr-only", "visually-hidden", "hidden", "modal", "dropdown-menu", "tooltip")
HIDDEN_ROLES = ("dialog", "alert", "navigation")

_FIELD = "struct<name:string,type:string,value:string,required:boolean,options:array<string>>"
PAGE = {
    "title": "string",
    "description": "string",
    "language": "string",
    "canonical": "string",
    "open_graph": "map<string,string>",
    "meta": "map<string,string>",
    "json_ld": "array<string>",
    "next_data": "string",
    "embedded_scripts": "map<string,string>",
    "headings": "array<struct<level:int,text:string>>",
    "links": "array<struct<text:string,href:string>>",
    "images": "array<struct<src:string,alt:string>>",
    "forms": f"array<struct<name:string,method:string,action:string,fields:array<{_FIELD}>>>",
    "body_text": "string",
    "has_article": "boolean",
}


def dumps(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def resolve(base: str, href: str) -> str:
    """href against base; what cannot be parsed stays as it is."""
    try:
        return urljoin(base, href) if base else href
    except ValueError:
        return href


def _hidden(node: Node) -> bool:
    a = node.attrs
    return (
        a.get("aria-hidden") == "true"
        or "hidden" in a
        or a.get("role") in HIDDEN_ROLES
        or any(c in a["class"] for c in HIDDEN_CLASSES if "class" in a)
    )


def visible_text(root: Node) -> str:
    """Text of the visible nodes, blanks collapsed."""
    parts: list[str] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if not node.tag:
            parts.append(node.text)
            continue
        if node.tag in SKIPPED or _hidden(node):
            continue
        todo.extend(reversed(node.children))
    return collapse(" ".join(parts))


def _page_text(document: Node) -> str:
    """All text outside of head, scripts and styles."""
    parts: list[str] = []
    todo = [document]
    while todo:
        node = todo.pop()
        if not node.tag:
            parts.append(node.text)
        elif node.tag not in ("head", "script", "style", "noscript"):
            todo.extend(reversed(node.children))
    return collapse(" ".join(parts))


def main_content(document: Node) -> Node | None:
    tests = [
        lambda n: n.attr("role") == "main",
        lambda n: n.tag == "main",
        lambda n: n.tag == "article",
        lambda n: n.attr("id") == "content",
        lambda n: n.attr("id") == "main-content",
        lambda n: n.attr("id") == "main",
    ]
    return next((found for t in tests if (found := document.find(t)) is not None), None)


def select_options(select: Node) -> tuple[list[str], str]:
    """The options' values and the chosen one: the first, or the last that is marked."""
    options, chosen = [], ""
    for option in select.elements():
        if option.tag == "option" and (value := option.attr("value") or option.text_content().strip()):
            options.append(value)
            if not chosen or "selected" in option.attrs:
                chosen = value
    return options, chosen


def form_fields(form: Node) -> list[dict]:
    fields: dict[tuple[str, str], dict] = {}
    for node in form.elements():
        name = node.attr("name").strip()
        if node.tag not in ("input", "textarea", "select") or not name or (node.tag, name) in fields:
            continue
        field = {"name": name, "type": node.tag, "value": "", "required": "required" in node.attrs, "options": None}
        if node.tag == "input":
            field["type"] = node.attr("type").strip().lower() or "text"
            if field["type"] in ("checkbox", "radio") and "checked" not in node.attrs:
                continue
            field["value"] = node.attr("value")
        elif node.tag == "textarea":
            field["value"] = node.text_content()
        else:
            field["options"], field["value"] = select_options(node)
        fields[node.tag, name] = field
    return list(fields.values())


def _form(node: Node, base: str) -> dict | None:
    action = resolve(base, node.attr("action").strip() or base)
    fields = form_fields(node) if action else []
    if not fields:
        return None
    name = node.attr("name") if node.attr("name").strip() else node.attr("id")
    return {"name": name or None, "method": node.attr("method").strip().upper() or "GET", "action": action, "fields": fields}


def _link(node: Node, base: str) -> dict | None:
    href = node.attr("href")
    if not href or href.startswith(("#", "javascript:")):
        return None
    to = resolve(base, href)
    return {"text": cut_bytes(node.text_content().strip(), MAX_LINK_TEXT), "href": to} if to else None


def extract_page(html: str, base: str, fields: Sequence[str] = tuple(PAGE)) -> dict:
    """The page's record with the fields asked for; never fails, whatever the markup."""
    document = parse_html(html or "")
    want = set(fields)
    out: dict = {k: None for k in fields}
    og: dict[str, str] = {}
    meta: dict[str, str] = {}
    scripts: dict = {}
    json_ld: list[str] = []
    headings: list[dict] = []
    links: dict[str, dict] = {}
    images: list[dict] = []
    forms: list[dict] = []
    head = next(n for n in document.elements() if n.tag == "head")
    in_head = {id(n) for n in head.elements()}
    for node in document.elements():
        match node.tag:
            case "html":
                out["language"] = node.attr("lang") or None
            case "title" if id(node) in in_head:
                for text in node.children:
                    out["title"] = trim(text.text) or out.get("title")
            case "meta" if node.attr("content"):
                name, prop, content = node.attr("name"), node.attr("property"), node.attr("content")
                if name == "description":
                    out["description"] = content
                elif name and name != "viewport":
                    meta[name] = content
                if prop.startswith("og:"):
                    og[prop[3:]] = content
            case "link" if id(node) in in_head and node.attr("rel") == "canonical":
                out["canonical"] = resolve(base, node.attr("href")) or None
            case "script":
                if node.attr("type") == "application/ld+json":
                    value = parse_json(node.text_content()) if "json_ld" in want else None
                    if value is not None:
                        json_ld.append(dumps(value))
                elif node.attr("id") == "__NEXT_DATA__":
                    value = parse_json(node.text_content()) if "next_data" in want else None
                    out["next_data"] = dumps(value) if value is not None else out.get("next_data")
                elif "embedded_scripts" in want:
                    script_values(node, scripts)
            case "h1" | "h2" | "h3" | "h4" | "h5" | "h6" if len(headings) < MAX_HEADINGS:
                if text := trim(node.text_content()):
                    headings.append({"level": HEADINGS.index(node.tag) + 1, "text": text})
            case "article":
                out["has_article"] = True
            case "a" if "links" in want and len(links) < MAX_LINKS:
                if link := _link(node, base):
                    links.setdefault(link["href"], link)
            case "img" if len(images) < MAX_IMAGES and node.attr("src") and not node.attr("src").startswith("data:"):
                images.append({"src": resolve(base, node.attr("src")), "alt": node.attr("alt")})
            case "form" if "forms" in want and len(forms) < MAX_FORMS:
                if form := _form(node, base):
                    forms.append(form)
    scripts.pop("__NEXT_DATA__", None)
    if "body_text" in want:
        main = main_content(document)
        out["body_text"] = cut_bytes(_page_text(document) if main is None else visible_text(main), MAX_BODY)
    out["has_article"] = bool(out.get("has_article"))
    out |= {"open_graph": og or None, "meta": meta or None, "json_ld": json_ld or None, "headings": headings or None}
    out |= {"embedded_scripts": {k: dumps(v) for k, v in scripts.items()} or None, "links": list(links.values()) or None, "images": images or None, "forms": forms or None}
    return {k: out.get(k) for k in fields}


def _schema(df: DataFrame, fields: Sequence[str], kinds: dict[str, str]) -> T.StructType:
    own = [f for f in df.schema.fields if f.name not in fields]
    return T.StructType(own + T.StructType.fromDDL(", ".join(f"{k} {kinds[k]}" for k in fields)).fields)


def map_pages(pages: DataFrame, make, fields: Sequence[str], kinds: dict[str, str], html: str = "html", url: str = "url") -> DataFrame:
    """pages without html, with make(html, url)'s fields; one parse for a row, in batches of BATCH_ROWS and BATCH_BYTES at most."""
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    rows = pages.withColumn(html, F.substring(F.col(html).cast("string"), 1, MAX_INPUT))
    kept = [c for c in pages.columns if c not in (html, *fields)]
    schema = _schema(pages.select(*kept), fields, kinds)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [make(h or "", u or "") for h, u in zip(batch.column(html).to_pylist(), batch.column(url).to_pylist())]
            made = [pa.array([_arrow(r[k]) for r in found], arrow.field(k).type) for k in fields]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *made], schema=pa.schema([arrow.field(c) for c in [*kept, *fields]]))

    columns = list(dict.fromkeys([*kept, html, url]))
    return rows.select(*columns).mapInArrow(run, schema)


def _arrow(value):
    return list(value.items()) if isinstance(value, dict) and not any(isinstance(v, (list, dict)) for v in value.values()) else value


def extract_pages(pages: DataFrame, fields: Sequence[str] = tuple(PAGE), html: str = "html", url: str = "url") -> DataFrame:
    """pages (html, url, ...) with a page's record in place of its html."""
    return map_pages(pages, lambda h, u: extract_page(h, u, fields), fields, PAGE, html, url)


def extract_pattern(pages: DataFrame, name: str, html: str = "html", url: str = "url") -> DataFrame:
    """pages with the JSON of one named embedded pattern, null where there is none."""
    from ..functions.scan import embedded

    def one(text: str, _: str) -> dict:
        value = embedded(parse_html(text)).get(name) if name in text else None
        return {"pattern_json": None if value is None else dumps(value)}

    return map_pages(pages, one, ("pattern_json",), {"pattern_json": "string"}, html, url)


def host_of(url: str) -> str:
    try:
        return urlsplit(url).netloc.rpartition("@")[2]
    except ValueError:
        return ""
