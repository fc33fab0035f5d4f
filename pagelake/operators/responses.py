"""The best payload of a capture, completed by what its other responses include: JSON bodies as VARIANT values.

Only responses of status 200 whose body is JSON count. Their `included` lists are gathered in order, objects only, the first of each
entityUrn that is a text and all without one; the payload of the highest score gets the gathered list in place of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .traffic import response_score

#: Bytes of gathered items that one payload may hold; a capture's further ones are left out, and told.
MAX_INCLUDED = 64 << 20


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def json_responses(entries: DataFrame) -> DataFrame:
    """Entries of status 200 with a JSON body, and that as a variant in column json."""
    parsed = entries.filter((F.col("status") == 200) & (F.coalesce("body", F.lit("")) != "")).withColumn("json", F.try_parse_json("body"))
    return parsed.filter(F.col("json").isNotNull())


def included_items(responses: DataFrame) -> DataFrame:
    """The distinct objects of each capture's included lists: capture_id, ord, pos, urn (null: none that is a text) and item."""
    lists = F.when(_kind(F.col("json")) == "OBJECT", F.try_variant_get("json", "$.included", "array<variant>"))
    items = responses.select("capture_id", "ord", F.posexplode(lists).alias("pos", "item")).filter(_kind(F.col("item")) == "OBJECT")
    urn = F.try_variant_get("item", "$.entityUrn", "variant")
    items = items.withColumn("urn", F.when(_kind(urn) == "STRING", F.try_variant_get("item", "$.entityUrn", "string")))
    # what repeats is aggregated before it moves; the item itself stands beside its place
    where = F.struct("ord", "pos")
    named = items.filter("urn is not null").groupBy("capture_id", "urn").agg(F.min_by("item", where).alias("item"), F.min(where).alias("at"))
    named = named.select("capture_id", "at.ord", "at.pos", "urn", "item")
    return named.unionByName(items.filter("urn is null").select("capture_id", "ord", "pos", "urn", "item"))


def gathered(items: DataFrame, max_bytes: int = MAX_INCLUDED) -> DataFrame:
    """Each capture's items as one JSON list in order, as far as max_bytes go: capture_id, included, n_included, n_left_out."""
    items = items.withColumn("text", F.to_json("item"))
    order = Window.partitionBy("capture_id").orderBy("ord", "pos")
    before = F.sum(F.octet_length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0))
    kept = items.withColumn("fits", before + 1 <= max_bytes)
    one = F.sort_array(F.collect_list(F.when(F.col("fits"), F.struct("ord", "pos", "text"))))
    rows = kept.groupBy("capture_id").agg(one.alias("items"), F.count_if(~F.col("fits")).alias("n_left_out"))
    text = F.concat(F.lit("["), F.array_join("items.text", ","), F.lit("]"))
    return rows.select("capture_id", text.alias("included"), F.size("items").cast("bigint").alias("n_included"), "n_left_out")


def best_payloads(responses: DataFrame, target_path: Column) -> DataFrame:
    """Each capture's response of the highest positive score, the first on a tie: capture_id, best_ord, score and its body."""
    scored = responses.withColumn("score", response_score(F.col("url"), F.col("body"), target_path).cast("bigint")).filter("score > 0")
    best = scored.groupBy("capture_id").agg(F.max_by(F.struct("ord", "score", "body"), F.struct("score", -F.col("ord"))).alias("best"))
    return best.select("capture_id", F.col("best.ord").alias("best_ord"), "best.score", "best.body")


def overlaid(body: Column, included: Column) -> Column:
    """A JSON text with the member included replaced, members in the order of their names; what is no object gives way to the list."""
    members = F.from_json(body, "map<string,variant>")
    names = F.array_sort(F.array_union(F.map_keys(members), F.array(F.lit("included"))))
    pair = lambda k: F.concat(_quoted(k), F.lit(":"), F.when(k == "included", included).otherwise(F.to_json(F.try_element_at(members, k))))
    whole = F.concat(F.lit("{"), F.array_join(F.transform(names, pair), ","), F.lit("}"))
    is_object = _kind(F.try_parse_json(body)) == "OBJECT"
    return F.when(included.isNull(), F.to_json(F.try_parse_json(body))).when(is_object, whole).otherwise(F.concat(F.lit('{"included":'), included, F.lit("}")))


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, 2, F.length(listed) - 2)


def complete_payloads(entries: DataFrame, target_path: Column, max_bytes: int = MAX_INCLUDED) -> DataFrame:
    """One row a capture that has a payload or included items: capture_id, best_ord (null: none), n_included, n_left_out and payload."""
    responses = json_responses(entries)
    both = best_payloads(responses, target_path).join(gathered(included_items(responses), max_bytes), "capture_id", "full")
    count = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return both.select("capture_id", "best_ord", count("n_included"), count("n_left_out"), overlaid(F.col("body"), F.col("included")).alias("payload"))
