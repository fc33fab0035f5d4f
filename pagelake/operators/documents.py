"""Documents for analysis by a model, each under a budget of bytes: captured traffic, pages, and failed captures.

A document is made of sections in order. A running sum of their bytes, a window over the document's sections, says where the budget
ends: sections before stand whole, the one that crosses it is cut on a code point's border and marked, later ones are left out and counted.
Every section has LEAST bytes or more, so only budget / LEAST of them can count; the rest never move, as a rank filter drops them before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .traffic import relevant_headers

#: Bytes of a DOM snapshot, of a page's html, and of a body.
DOM_BYTES, HTML_BYTES, BODY_BYTES = 3000, 15000, 2000
BUDGET, LEAST = 64_000, 8
CUT = "\n[cut]"


def marked_cut(text: Column, size: int, mark: str = CUT) -> Column:
    """At most size bytes of a text; a longer one is cut on a code point's border and marked, the mark included in size."""
    return F.when(F.octet_length(text) <= size, text).otherwise(F.concat(tx.cut_bytes(text, size - len(mark.encode())), F.lit(mark)))


def _cut_to(text: Column, size: Column) -> Column:
    """The longest beginning of whole code points of at most `size` bytes."""
    data = F.encode(text, "UTF-8")
    # from the byte after the cut back to one that begins a code point
    byte = lambda at: F.conv(F.hex(F.substring(data, at, F.lit(1))), 16, 10).cast("int")
    back = F.filter(F.array(*[size - k for k in range(4)]), lambda at: (at <= 0) | ~byte(at + 1).between(0x80, 0xBF))
    return F.substring(data, F.lit(1), F.greatest(F.get(back, 0), F.lit(0))).cast("string")


def budgeted(sections: DataFrame, keys: list[str], order: list[str], budget: int = BUDGET, mark: str = CUT) -> DataFrame:
    """One document for each of keys from sections (keys, order, section): document, n_sections, n_left_out and n_bytes, at most budget.

    Sections are parted by a blank line; empty ones and nulls are padded to LEAST bytes by nothing else than their place, so give them a heading.
    """
    most = budget // LEAST + 1
    totals = sections.groupBy(*keys).agg(F.count(F.lit(1)).alias("__all"))
    by = Window.partitionBy(*keys).orderBy(*order)
    rows = sections.select(*keys, *order, F.coalesce("section", F.lit("")).alias("section")).withColumn("__n", F.row_number().over(by)).filter(F.col("__n") <= most)
    size = F.octet_length("section") + F.when(F.col("__n") > 1, 2).otherwise(0)
    rows = rows.withColumn("__to", F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__from", F.col("__to") - size)
    room = (budget - F.col("__from") - F.when(F.col("__n") > 1, 2).otherwise(0) - len(mark.encode())).cast("int")
    whole = F.col("__to") <= budget
    rows = rows.filter(whole | ((F.col("__from") <= budget) & (room > 0)))
    rows = rows.select(*keys, "__n", F.when(whole, F.col("section")).otherwise(F.concat(_cut_to(F.col("section"), room), F.lit(mark))).alias("__text"))
    made = rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__text"))), lambda x: x["__text"]), "\n\n").alias("document"), F.count(F.lit(1)).alias("n_sections"))
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    both = totals.alias("t").join(made.alias("m"), same, "left")
    document, n = F.coalesce("m.document", F.lit("")), F.coalesce("m.n_sections", F.lit(0))
    return both.select(*[F.col(f"t.{k}").alias(k) for k in keys], document.alias("document"), n.cast("bigint").alias("n_sections"), (F.col("t.__all") - n).cast("bigint").alias("n_left_out"), F.octet_length(document).cast("bigint").alias("n_bytes"))


def entry_section(number: Column) -> Column:
    """What a document says of a captured entry: method, url, status, type, size, headers that matter in order, the start of its body."""
    headers = relevant_headers(F.coalesce(F.col("req_headers"), F.create_map().cast("map<string,string>")))
    lines = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(F.lit("header "), e["key"], F.lit(": "), e["value"]))
    body = F.coalesce("body", F.lit(""))
    return F.concat_ws(
        "\n", F.format_string("## %d. %s %s", number, "method", "url"), F.concat(F.lit("status "), F.col("status").cast("string")), F.concat(F.lit("type "), "content_type"),
        F.concat(F.lit("bytes "), F.octet_length(body).cast("string")), F.array_join(F.when(F.size(lines) > 0, lines), "\n"), F.nullif(marked_cut(body, BODY_BYTES), F.lit("")),
    )


def traffic_documents(captures: DataFrame, entries: DataFrame, budget: int = BUDGET) -> DataFrame:
    """A document for each capture (capture_id, url, dom): its url, the start of its DOM, and its entries in order, as far as the budget goes."""
    head = captures.select("capture_id", F.lit(-1).alias("ord"), F.concat_ws("\n", F.lit("# URL"), F.coalesce("url", F.lit("")), F.lit("# DOM"), marked_cut(F.coalesce("dom", F.lit("")), DOM_BYTES)).alias("section"))
    place = F.row_number().over(Window.partitionBy("capture_id").orderBy("ord"))
    known = entries.withColumn("__place", place).filter(F.col("__place") <= budget // LEAST + 1)
    body = known.select("capture_id", F.col("__place").alias("ord"), entry_section(F.col("__place")).alias("section"))
    return budgeted(head.unionByName(body), ["capture_id"], ["ord"], budget)


def page_documents(pages: DataFrame, size: int = HTML_BYTES) -> DataFrame:
    """A document for each page (page_id, url, html): its url, and its html without scripts and styles as far as size goes."""
    html = marked_cut(tx.strip_script_style(F.coalesce("html", F.lit(""))), size)
    return pages.select("page_id", F.concat_ws("\n", F.lit("# URL"), F.coalesce("url", F.lit("")), F.lit("# HTML"), html).alias("document"))


def failure_documents(targets: DataFrame) -> DataFrame:
    """A document for each target (url, reason) whose capture failed: its url and why."""
    return targets.select("url", F.concat_ws("\n", F.lit("# URL"), F.coalesce("url", F.lit("")), F.lit("# Capture failed"), F.coalesce(F.nullif(F.trim("reason"), F.lit("")), F.lit("unknown"))).alias("document"))
