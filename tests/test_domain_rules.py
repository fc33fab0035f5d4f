"""Rules as rows: two domains with rules of their own, versions, answers that are no rules, domains without any."""

import json

from pyspark.sql import functions as F

from pagelake.operators import domain_rules

ANSWERS = "domain string, version int, answered_at string, answer string"
NEWS = {"page_type": "article", "title_selector": "h1", "entity_fields": [{"name": "points", "selector": ".none", "selectors": [".p"], "type": "number", "required": True}, {"name": "tags", "selector": "li", "type": "list"}]}
SHOP = {"strategy": "table_rows", "page_type": "listing", "table_rows": {"container": "table", "group_size": 2, "fields": [{"name": "item", "row": 0, "selector": "td"}, {"name": "price", "row": 1, "selector": "td", "type": "number", "required": True}]}}


def test_each_domain_has_its_own_rules(spark):
    pages = spark.createDataFrame([
        (1, "https://news.com/a", "<h1>T</h1><b class=p>1.2k</b><ul><li>x<li>y</ul>"), (2, "https://www.shop.com/l", "<table><tr><td>pen<tr><td>$3<tr><td>ink<tr><td>4.5</table>"),
        (3, "https://none.com/", "<h1>T</h1>"), (4, "https://bad.com/", "<h1>T</h1>"), (5, "https://odd.com/", "<h1>T</h1>"), (6, "https://news.com/empty", None), (7, None, "<p>"), (8, "https://list.com/", "<h1>x</h1>"),
    ], "page_id int, url string, html string")
    answers = spark.createDataFrame([
        ("news.com", 1, "2024-01-01", json.dumps(SHOP)), ("news.com", 2, "2024-01-01", "Here you are:\n```json\n" + json.dumps(NEWS) + "\n```"), ("news.com", 2, "2023-01-01", "older"),
        ("shop.com", 1, "2024-01-01", "The rules are " + json.dumps(SHOP) + " as asked."), ("bad.com", 1, "2024-01-01", '{"title_selector": "div["}'), ("odd.com", 7, "2024-01-01", "I cannot help"),
        ("list.com", 1, "2024-01-01", '{"entity_fields": ["x"]}'), (None, 1, "2024-01-01", "{}"),
    ], ANSWERS)
    found = {r.page_id: r for r in domain_rules.extract_by_domain(pages, answers).collect()}
    assert {k: r.status for k, r in found.items()} == {1: "ok", 2: "ok", 3: "no_rules", 4: "invalid", 5: "invalid", 6: "ok", 7: "no_rules", 8: "invalid"}
    assert json.loads(found[1].data) == {"title": "T", "type": "article", "points": 1200, "tags": ["x", "y"]} and found[1].rules_version == 2
    assert json.loads(found[2].data) == {"type": "listing", "items": [{"item": "pen", "price": 3}, {"item": "ink", "price": 4.5}]} and found[2].domain == "shop.com"
    assert found[6].missing_required == ["points"] and "title_selector" in found[4].fault and found[5].fault == "no JSON" and found[3].rules_version is None
    assert domain_rules.extract_by_domain(pages, answers.limit(0)).filter("status = 'no_rules'").count() == 8


def test_answers(spark):
    assert domain_rules.answer_json('{"a": 1}') == {"a": 1} and domain_rules.answer_json(None) is None and domain_rules.answer_json("[1]") is None
    assert domain_rules.answer_json("x ```\n{\"a\": {}}\n``` {") == {"a": {}}
    rows = spark.createDataFrame([("a", 1, "2024-01-02", "x"), ("a", 1, "2024-01-01", "z"), ("a", None, "2025-01-01", "n"), ("b", None, None, None)], ANSWERS)
    assert {r.domain: (r.rules_version, r.answer) for r in domain_rules.latest_answers(rows).collect()} == {"a": (1, "x"), "b": (None, None)}
    assert "Window" not in domain_rules.latest_answers(rows.withColumn("domain", F.upper("domain")))._jdf.queryExecution().optimizedPlan().toString()
