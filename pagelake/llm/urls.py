"""URL filter: rules first, then the ratio of two character language models.

Two variable-order Markov models (contexts of up to ORDER characters, Witten-Bell smoothed from order to order) are
counted over the URLs that rules allow and that rules block. A URL that no rule fits is judged by the difference of
its log-likelihoods per character, against a threshold calibrated on rule-judged URLs that the models did not see.
Counts, models and scores are tables keyed by n-gram that grow with the URLs. A join's rows of one key (the first n-gram
of every URL, a URL of a third of all rows) never meet in one task: keys of over a share of 1 / HOT_KEYS of all rows, so
fewer than HOT_KEYS of them, are broadcast to where their rows are; only the others move, by key.

Defined cases: a null URL or one without :// has an empty host and path; equal URLs are scored once and weigh by their
number; without URLs of both kinds to learn from, the method allows; repeated rows are judged each; an empty table gives
no row; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .fingerprints import LOWER, UPPER

ORDER = 4
#: Symbols that a context of order 0 falls back on, in equal shares.
SYMBOLS = 256
#: One of so many rule-judged URLs calibrates the threshold; the others are learnt from.
CALIBRATION = 5
#: Width of the score's bins in calibration.
BIN = 0.01
#: A key of over one in so many rows is hot; there are fewer than this many of them, which bounds what is broadcast.
HOT_KEYS = 1000
START, END = "\x02", "\x03"

#: Verdict, host and path of each rule.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, to, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == to) | host.endswith("." + to)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(to + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(text: Column) -> Column:
    """All runs of ORDER + 1 characters that end at a character of the text or at its end mark."""
    chars = F.split(F.concat(F.lit(START * ORDER), text, F.lit(END)), "")
    return F.transform(F.array(chars), lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - ORDER), lambda i: F.array_join(F.slice(c, i, ORDER + 1), "")))[0]


def _model(counts: DataFrame) -> DataFrame:
    """gram and llr, the log ratio of its last character's probability after the others, for every gram of counts."""
    levels = [counts]
    for k in range(ORDER, 0, -1):
        levels.append(levels[-1].groupBy(F.expr(f"substring(gram, 2, {k})").alias("gram")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")))
    lower: DataFrame | None = None
    for k, level in enumerate(reversed(levels)):
        context = Window.partitionBy(F.expr(f"substring(gram, 1, {k})"))
        level = level.select("gram", "allow", "block", *[f(x) for x in ("allow", "block") for f in (
            lambda x: F.sum(x).over(context).alias(f"n_{x}"),
            lambda x: F.sum((F.col(x) > 0).cast("int")).over(context).alias(f"t_{x}"),
        )])
        if lower is None:
            level = level.withColumns({f"l_{x}": F.lit(1.0 / SYMBOLS) for x in ("allow", "block")})
        else:
            shorter = lower.select(F.col("gram").alias("short"), F.col("p_allow").alias("l_allow"), F.col("p_block").alias("l_block"))
            level = level.withColumn("short", F.expr(f"substring(gram, 2, {k})")).join(shorter, "short")
        lower = level.select("gram", *[
            F.when(F.col(f"n_{x}") > 0, (F.col(x) + F.col(f"t_{x}") * F.col(f"l_{x}")) / (F.col(f"n_{x}") + F.col(f"t_{x}"))).otherwise(F.col(f"l_{x}")).alias(f"p_{x}")
            for x in ("allow", "block")
        ])
    return lower.select("gram", (F.log("p_allow") - F.log("p_block")).alias("llr"))


def _joined(rows: DataFrame, looked_up: DataFrame, on: list[str], share: int = HOT_KEYS) -> DataFrame:
    """Inner join of rows with looked_up, one row per key; its column n_rows counts the key's rows, sums to all rows, and is dropped."""
    total = looked_up.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    is_hot = F.col("n_rows") * share > total
    hot, cold = F.broadcast(looked_up.filter(is_hot).drop("n_rows")), looked_up.filter(~is_hot).drop("n_rows")
    moved = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold, on)
    return rows.join(hot, on).unionByName(moved)


def _threshold(scored: DataFrame) -> float | None:
    """The bin edge that tells the calibration URLs apart best (mean of both kinds' right shares); None without both kinds."""
    bins = scored.filter("calibrates").groupBy(F.floor(F.col("score") / BIN).alias("bin"), "verdict").agg(F.sum("n").alias("n"))
    by: dict[int, list[int]] = {}
    for r in bins.collect():  # as many rows as bins: scores lie within a few units
        by.setdefault(r["bin"], [0, 0])[r["verdict"] == "allow"] += r["n"]
    blocked, allowed = (sum(x[k] for x in by.values()) for k in (0, 1))
    if not blocked or not allowed:
        return None
    best, edges, below = -1.0, [], [0, 0]
    for at in [*sorted(by), max(by) + 1]:
        right = below[0] / blocked + 1 - below[1] / allowed
        if right > best + 1e-12:
            best, edges = right, [at]
        elif right > best - 1e-12:
            edges.append(at)
        below = [below[k] + by.get(at, [0, 0])[k] for k in (0, 1)]
    return sum(edges) / len(edges) * BIN


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (null where no rule-judged URLs of both kinds teach the models)."""
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    text = F.concat("host", "path")
    rows = rows.withColumns({"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit("second"), text)})
    urls = rows.groupBy("k1", "k2").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.first("fit.verdict").alias("verdict"), F.count(F.lit(1)).alias("n"))
    urls = urls.withColumn("calibrates", F.col("verdict").isNotNull() & (F.pmod(F.col("k1"), F.lit(CALIBRATION)) == 0))
    learnt = lambda kind: F.when(~F.col("calibrates") & (F.col("verdict") == kind), F.col("n")).otherwise(0)
    urls = urls.withColumns({"allow": learnt("allow"), "block": learnt("block")})
    grams = written(urls.select("k1", "k2", "verdict", "n", "calibrates", "allow", "block", F.explode(_grams(text)).alias("gram")), "url-grams")
    counts = grams.groupBy("gram").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"), F.count(F.lit(1)).alias("n_rows"))
    counts = written(counts, "url-gram-counts")
    llr = written(_model(counts.drop("n_rows")).join(counts.select("gram", "n_rows"), "gram"), "url-models")
    scored = _joined(grams, llr, ["gram"]).groupBy("k1", "k2").agg(
        F.avg("llr").alias("score"), *[F.first(x).alias(x) for x in ("verdict", "n", "calibrates", "allow", "block")]
    )
    scored = written(scored, "url-scores")
    taught = scored.agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()
    edge = _threshold(scored) if taught["allow"] and taught["block"] else None
    if edge is None:
        edge = 0.0 if taught["allow"] and taught["block"] else -math.inf
    # the models' verdict for a URL is fixed here, so that rows join on narrow keys alone
    method = F.when(F.col("score") >= edge, F.lit("allow")).otherwise(F.lit("block")) if edge > -math.inf else F.lit("allow")
    return _joined(rows, scored.select("k1", "k2", "score", F.col("n").alias("n_rows")), ["k1", "k2"]).select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), method).alias("verdict"), "score"
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


QUERIES = {"op1_url_filter": op1_url_filter}
