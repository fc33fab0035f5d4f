"""Best payloads and what other responses include, against a direct program over made captures."""

import json
import random

from pyspark.sql import functions as F

from pagelake.operators import responses

ENTRIES = "capture_id int, ord int, url string, status int, body string"


def by_hand(rows, path):
    """{capture: (best ord, included, payload)}"""
    out = {}
    parts = [s.lower() for s in path.strip("/").split("/") if len(s) > 2]
    for capture in {r[0] for r in rows}:
        best, top, items, seen = None, 0, [], set()
        for _, n, url, status, body in sorted(r for r in rows if r[0] == capture):
            if status != 200 or not body:
                continue
            try:
                found = json.loads(body)
            except ValueError:
                continue
            if isinstance(found, dict) and isinstance(found.get("included"), list):
                for item in found["included"]:
                    if isinstance(item, dict):
                        urn = item.get("entityUrn")
                        if isinstance(urn, str):
                            if urn in seen:
                                continue
                            seen.add(urn)
                        items.append(item)
            low = url.lower()
            score = len(body.encode()) + 50_000 * sum(s in low for s in parts) + 10_000 * ("graphql" in low or "/api/" in low) - 30_000 * any(x in low for x in ("setting", "messaging", "notification", "policy"))
            if score > top:
                best, top = (n, found), score
        if best or items:
            payload = best[1] if best else None
            if items:
                payload = {**payload, "included": items} if isinstance(payload, dict) else {"included": items}
            out[capture] = (best and best[0], len(items), payload)
    return out


def run(spark, rows, path="/shop/Items/12", **limits):
    found = responses.complete_payloads(spark.createDataFrame(rows, ENTRIES), F.lit(path), **limits).collect()
    return {r.capture_id: (r.best_ord, r.n_included, json.loads(r.payload)) for r in found}, {r.capture_id: r for r in found}


def test_payloads_are_what_a_direct_program_gives(spark):
    rng = random.Random(7)
    item = lambda: rng.choice([{"entityUrn": f"urn:{rng.randrange(6)}", "v": rng.randrange(9)}, {"entityUrn": rng.randrange(3)}, {"entityUrn": None, "é": 'a "b"\\'}, {"v": [1, {"x": None}]}, 5, "text", [1], None])
    def body():
        kind = rng.randrange(7)
        if kind < 3:
            return json.dumps({"data": {"n": rng.randrange(99), "b": "ü"}, "included": [item() for _ in range(rng.randrange(5))], "a b": True})
        return rng.choice(["", None, "not json", "[1, 2]", '{"x": 1}', '{"included": {"no": "list"}}', "7", '"s"'])
    urls = ["https://x.com/api/items/12", "https://x.com/settings", "https://x.com/SHOP/items", "https://x.com/graphql", "https://x.com/p"]
    rows = [(c, n, rng.choice(urls), rng.choice([200, 200, 200, 404, 204]), body()) for c in range(60) for n in range(rng.randrange(1, 9))]
    rows += [(900, 0, "https://x.com/settings", 200, '{"included": [{"a": 1}]}'), (901, 0, "https://x.com/p", 200, "[1, {}]")]
    found, _ = run(spark, rows)
    assert found == by_hand(rows, "/shop/Items/12")
    assert any(x[0] is None for x in found.values()) and any(isinstance(x[2], list) for x in found.values())


def test_a_wall_or_an_error_is_no_payload(spark):
    rows = [(1, 0, "https://x.com/api/items", 403, '{"big": "%s"}' % ("x" * 999)), (1, 1, "https://x.com/api/items", 200, "Just a moment... " * 99), (1, 2, "https://x.com/p", 200, '{"ok": 1}'), (2, 0, "https://x.com/api", 500, "{}")]
    assert run(spark, rows)[0] == {1: (2, 0, {"ok": 1})}


def test_the_list_is_bounded_in_bytes(spark):
    rows = [(1, k, "https://x.com/p", 200, json.dumps({"included": [{"entityUrn": f"u{k}", "v": "x" * 100}]})) for k in range(20)]
    found, full = run(spark, rows, max_bytes=700)
    assert found[1][1] == 5 and full[1].n_left_out == 15 and [x["entityUrn"] for x in found[1][2]["included"]] == [f"u{k}" for k in range(5)]
    assert len(json.dumps(found[1][2]["included"], separators=(",", ":"))) <= 700
    assert run(spark, rows[:0])[0] == {}
