"""The compact record of a page: its best structured source, JSON-LD and Open Graph merged, pagination surfaced."""

from __future__ import annotations

import json
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .extract import PAGE, dumps, extract_page, map_pages

#: JSON-LD keys that are kept.
LD_KEYS = (
    "@type", "name", "author", "datePublished", "dateModified", "description", "image", "url", "headline", "publisher", "mainEntityOfPage",
    "price", "priceCurrency", "brand", "sku", "availability", "aggregateRating", "offers", "jobTitle", "worksFor", "address",
)
STRUCTURED = {"record": "string", "source": "string", "page_type": "string"}


def page_type(page: dict) -> str:
    og = (page.get("open_graph") or {}).get("type", "")
    for kind in ("article", "profile", "product"):
        if og.startswith(kind):
            return kind
    if page.get("has_article"):
        return "article"
    for block in map(json.loads, page.get("json_ld") or ()):
        if isinstance(block, dict) and isinstance(block.get("@type"), str):
            return _mapped(block["@type"])
        break
    return "generic"


def _mapped(name: str) -> str:
    low = name.lower()
    if any(x in low for x in ("article", "blogposting")):
        return "article"
    if any(x in low for x in ("person", "profilepage")):
        return "profile"
    if "product" in low:
        return "product"
    if low in ("itemlist", "searchresultspage"):
        return "listing"
    return "documentation" if "apireference" in low else "generic"


def next_payload(text: str | None) -> dict | None:
    """The page props with two keys at least, the richest cached entry of them merged over."""
    if not text:
        return None
    data = json.loads(text)
    props = data.get("props", {}).get("pageProps") if isinstance(data, dict) and isinstance(data.get("props"), dict) else None
    if not isinstance(props, dict) or len(props) < 2:
        return None
    try:
        cache = json.loads(props["gdpClientCache"])
        entries = [cache[k] for k in sorted(cache) if isinstance(cache[k], dict)]
    except (KeyError, TypeError, ValueError):
        return props
    best = max(entries, key=len, default={})
    return {k: v for k, v in props.items() if k != "gdpClientCache"} | best


def _flat(value):
    return value.get("name", value) if isinstance(value, dict) else value


def _merge_ld(record: dict, blocks: list) -> None:
    extra = []
    for k, block in enumerate(blocks):
        if not isinstance(block, dict):
            continue
        if k:
            if block.get("@type") and block["@type"] != "BreadcrumbList":
                extra.append(block)
            continue
        for key in LD_KEYS:
            if key not in block or key in ("name", "headline") and "title" in record or key == "description" and key in record:
                continue
            record["schema_type" if key == "@type" else key] = _flat(block[key]) if key in ("author", "publisher") else block[key]
    if extra:
        record["additional_data"] = extra


def _pagination(data, base: str) -> dict | None:
    """Totals and the next URL of a search state, wherever it stands within three levels."""
    todo = [(data, 0)]
    while todo:
        value, depth = todo.pop(0)
        if not isinstance(value, dict):
            continue
        if "totalResultCount" in value or "totalPages" in value:
            following = (value.get("pagination") or {}).get("nextUrl") if isinstance(value.get("pagination"), dict) else value.get("nextUrl")
            found = {"total_results": value.get("totalResultCount"), "total_pages": value.get("totalPages"), "next_url": following and urljoin(base, following)}
            return {k: v for k, v in found.items() if v is not None}
        if depth < 3:
            todo += [(value[k], depth + 1) for k in sorted(value)]
    return None


def clean_body(text: str | None) -> str:
    """The text as one line, empty if it holds a noise phrase."""
    low = (text or "").lower()
    if len(low.encode("utf-8", "replace")) < 3 or any(p in low for p in tx.NOISE_PHRASES):
        return ""
    data = text.encode("utf-8", "replace")
    return text if len(data) <= tx.MAX_CLEAN else data[: tx.MAX_CLEAN].decode("utf-8", "ignore")


def structured_record(html: str, base: str) -> dict:
    """record (JSON), the source that it comes from, and the page type."""
    page = extract_page(html, base, tuple(PAGE))
    record: dict = {k: page[k] for k in ("title", "description", "language") if page[k]}
    kind = page_type(page)
    record["type"] = kind
    blocks = [json.loads(b) for b in page["json_ld"] or ()]
    source = "body"
    payload = next_payload(page["next_data"])
    if payload is not None:
        record |= payload
        source = "next_data"
        if paging := _pagination(payload, base):
            record["_pagination"] = paging
    elif page["embedded_scripts"]:
        record["data"] = {k: json.loads(v) for k, v in page["embedded_scripts"].items()}
        source = "embedded"
    elif blocks:
        source = "json_ld"
    elif page["open_graph"]:
        source = "open_graph"
    _merge_ld(record, blocks)
    og = page["open_graph"] or {}
    for key in ("site_name", "image", "url"):
        if key in og:
            record.setdefault(key, og[key])
    if page["canonical"]:
        record["url"] = page["canonical"]
    if source in ("body", "json_ld", "open_graph") and (body := clean_body(page["body_text"])):
        record["body_text"] = body
    if page["headings"]:
        record["headings"] = [h["text"] for h in page["headings"]]
    return {"record": dumps(record), "source": source, "page_type": kind}


def structure_pages(pages: DataFrame) -> DataFrame:
    return map_pages(pages, structured_record, tuple(STRUCTURED), STRUCTURED)


def is_useful(page: DataFrame) -> Column:
    """Whether extracted pages hold content: an embedded object of three keys, or marks of an article and 500 bytes of text."""
    rich = F.exists(F.map_values(F.coalesce("embedded_scripts", F.create_map().cast("map<string,string>"))), lambda v: F.size(F.json_object_keys(v)) >= 3)
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    h1 = F.coalesce(F.exists("headings", lambda h: h["level"] == 1), F.lit(False))
    marks = h1 | F.col("has_article") | (count("json_ld") > 0) | (count("links") >= 20)
    return rich | (marks & (F.octet_length("body_text") > 500))


def shape_output(page: DataFrame) -> DataFrame:
    """Extracted pages as JSON texts without empty parts."""
    return page.select(*[c for c in page.columns if c not in PAGE], F.to_json(F.struct(*[c for c in page.columns if c in PAGE])).alias("json"))
