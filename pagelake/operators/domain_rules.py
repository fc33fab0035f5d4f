"""Extraction rules as rows: stored answers of a model, the latest of each domain, applied to that domain's pages.

An answer is the JSON text of one domain's rules, as a model gave it: it may stand in a code fence or among other words. Pages meet the newest
answer of their domain in an equi-join, and one Arrow stage extracts all domains; a task compiles each answer once. A page of a domain
without an answer, or with one that is no rules, comes out with a status that says so.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .extract import map_pages
from .rules import ENTITIES, Field, Rules, check_rules, entities, table_rows

#: Compiled answers that a task keeps.
KEPT_RULES = 256


def answer_json(answer: str | None) -> dict | None:
    """The JSON object of an answer: all of it, else what a code fence holds, else from the first brace to the last."""
    text = (answer or "").strip()
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    for part in (text, fenced and fenced[1], text[text.find("{") : text.rfind("}") + 1]):
        try:
            found = json.loads(part or "")
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


def _field(d: dict) -> Field:
    names = ("name", "selector", "attribute", "type", "required", "row")
    own = {k: d[k] for k in names if d.get(k) is not None}
    return Field(**own, selectors=tuple(d.get("selectors") or ()), item_fields=tuple(map(_field, d.get("item_fields") or ())))


def rules_of(found: dict) -> Rules:
    """Rules from their JSON object."""
    table = found.get("table_rows") or {}
    texts = {k: found[k] for k in ("content_selector", "title_selector", "author_selector", "date_selector", "page_type") if found.get(k)}
    return Rules(
        **texts, ignore_selectors=tuple(found.get("ignore_selectors") or ()), fields=tuple(map(_field, found.get("fields") or ())), entity_fields=tuple(map(_field, found.get("entity_fields") or ())),
        container=table.get("container") or "", group_size=table.get("group_size", 1), row_fields=tuple(map(_field, table.get("fields") or ())),
    )


@lru_cache(KEPT_RULES)
def _compiled(answer: str) -> tuple[Rules | None, str]:
    """Rules and their strategy; None and what is wrong."""
    found = answer_json(answer)
    if found is None:
        return None, "no JSON"
    try:
        rules = rules_of(found)
        faults = check_rules(rules)
    except (TypeError, KeyError, AttributeError) as error:
        return None, f"not rules: {type(error).__name__}"
    return (None, "; ".join(faults)) if faults else (rules, "table_rows" if found.get("strategy") == "table_rows" or rules.container else "css_selector")


def latest_answers(answers: DataFrame) -> DataFrame:
    """The answer (domain, version, answered_at, answer) of each domain's greatest version, the later and then the greater text of equal ones."""
    newest = F.max_by(F.struct("version", "answer"), F.struct("version", "answered_at", F.coalesce("answer", F.lit(""))))
    return answers.filter("domain is not null").groupBy("domain").agg(newest.alias("a")).select("domain", F.col("a.version").alias("rules_version"), "a.answer")


def extract_by_domain(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """pages (url, html) with domain, rules_version, status, and data and missing_required in place of html.

    status: ok, nothing (the rules found no field), invalid (with the fault in `fault`), or no_rules.
    """
    own = pages.withColumn("domain", urls.bare_host(F.col("url")))
    both = own.join(latest_answers(answers), "domain", "left")
    kinds = {"status": "string", "fault": "string", **ENTITIES}
    # the answer travels beside the url, as the stage hands on two texts of a row
    both = both.withColumn("__asked", F.to_json(F.struct("answer")))

    def make(html: str, asked: str) -> dict:
        answer = json.loads(asked).get("answer") if asked else None
        nothing = {"fault": None, "data": None, "missing_required": None}
        if answer is None:
            return {"status": "no_rules", **nothing}
        rules, how = _compiled(answer)
        if rules is None:
            return {"status": "invalid", **nothing, "fault": how}
        found = (table_rows if how == "table_rows" else entities)(html, rules)
        empty = not found["data"] or found["data"] == "{}"
        return {"status": "nothing" if empty else "ok", "fault": None, **found}

    return map_pages(both, make, tuple(kinds), kinds, url="__asked").drop("__asked", "answer")
