"""URL filter: rules first, then logistic regression on hashed character n-grams (operator 1, DataFrame operations only).

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; the path
goes on up to ``?``, ``#`` or the end. Features are the distinct n-grams of ``SIZES`` characters of ``^host`` and of
the path, hashed to ``BUCKETS`` buckets by field. The model is fitted on a small labelled table of at most
``max_labels`` URLs in dual form: the weights are a combination of the labelled URLs' feature vectors, so an
update is a product with their Gram matrix, all of it in array functions on one row. The bucket weights, a fixed
number, are then a literal of the scoring plan: one scan, no exchange.

A rule (host, path, verdict) fits its host and all subdomains where the URL's path starts with the rule's; the
longest rule wins, the alphabetically first of equal length. Rules are a driver-side list: up to ``MAX_RULES`` of them are a
part of the scan, more meet the distinct hosts in a join.

Defined results: a null URL or one without ``://`` has empty host and path, fits no rule and has no n-grams, so the
method allows it; repeated rows are judged each; input columns besides id and URL are ignored; an empty table
gives an empty result; labels that are null are left out.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.workspace import Workspace

SIZES, BUCKETS = (3, 4), 4096
MAX_LABELS, STEPS, RATE, DECAY, MAX_RULES = 400, 60, 2.0, 1e-3, 500

#: The small labelled table: a line per URL, 1 for unwanted sites and 0 for others.
LABELS = Path(__file__).resolve().parent / "url_labels.tsv"


def seed_labels(spark: SparkSession) -> DataFrame:
    """``(url, blocked)`` of the labelled table, which the driver reads and passes on as a literal."""
    rows = [line.split("\t") for line in LABELS.read_text().splitlines()]
    literal = F.from_json(F.lit(json.dumps([{"url": url, "blocked": int(label)} for label, url in rows])), "array<struct<url:string,blocked:int>>")
    return spark.range(1).select(F.inline(literal))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _grams(host: Column, path: Column) -> Column:
    """Sorted distinct buckets of the n-grams of both fields."""
    def grams(field: str, text: Column, n: int) -> Column:
        spots = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda i: F.pmod(F.xxhash64(F.lit(f"{field}{n}"), F.substring(text, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))

    fields = {"h": F.when(host == "", F.lit("")).otherwise(F.concat(F.lit("^"), host)), "p": path}
    parts = [grams(field, text, n) for field, text in fields.items() for n in SIZES]
    return F.array_distinct(F.concat(*parts))


def train(labels: DataFrame, ws: Workspace, max_labels: int = MAX_LABELS) -> list[float]:
    """Bucket weights and, last, the intercept, from ``labels(url, blocked)``."""
    picked = labels.filter(F.col("url").isNotNull() & F.col("blocked").isin(0, 1)).select("url", F.col("blocked").cast("double").alias("y")).distinct()
    picked = picked.orderBy(F.xxhash64("url"), "url", "y").limit(max_labels)
    rows = picked.select("url", "y", _grams(host_of(F.col("url")), path_of(F.col("url"))).alias("g"))
    # one row of at most max_labels structs: the table is bounded by the parameter
    packed = rows.agg(F.array_sort(F.collect_list(F.struct("url", "y", "g"))).alias("t"))
    kernel = F.transform("t", lambda a: F.transform("t", lambda b: F.size(F.array_intersect(a["g"], b["g"])) + F.lit(1.0)))
    # scaled so that a step cannot overshoot
    packed = packed.filter(F.size("t") > 0).select("t", kernel.alias("k"))
    trace = F.aggregate(F.transform("k", lambda r: F.array_max(r)), F.lit(1.0), lambda a, x: F.greatest(a, x))
    # written, as the optimiser would otherwise put the Gram matrix's expression into every step
    packed = ws.save(packed, "gram")
    packed = ws.save(packed.select("t", "k", trace.alias("top")), "scaled")
    dot = lambda row, alpha: F.aggregate(F.zip_with(row, alpha, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    step = lambda alpha, _: F.transform(
        F.arrays_zip(F.col("k").alias("r"), alpha.alias("a"), F.col("t").alias("t")),
        lambda z: z["a"] * (1 - DECAY) + RATE / F.col("top") * (z["t"]["y"] - 1 / (1 + F.exp(-dot(z["r"], alpha)))),
    )
    fitted = packed.select("t", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.transform("t", lambda _: F.lit(0.0)), step).alias("alpha"))
    each = fitted.select(F.explode(F.arrays_zip(F.col("t.g").alias("g"), F.col("alpha").alias("a"))).alias("z")).select("z.g", "z.a")
    weights = each.select(F.explode(F.concat("g", F.array(F.lit(BUCKETS)))).alias("f"), "a").groupBy("f").agg(F.sum("a").alias("w"))
    out = [0.0] * (BUCKETS + 1)
    for row in weights.collect():  # at most BUCKETS + 1 rows
        out[row["f"]] = row["w"]
    return out


def _rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The winning rule's text and verdict, or nulls."""
    text = verdict = None
    for rule_host, rule_path, rule_verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        text = F.when(fits, rule_host + rule_path) if text is None else text.when(fits, rule_host + rule_path)
        verdict = F.when(fits, rule_verdict) if verdict is None else verdict.when(fits, rule_verdict)
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, verdict)


def _with_many_rules(parts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``parts`` with the winning rule's text and verdict by joins: rules meet the distinct hosts' domains, and hosts their pages."""
    literal = F.from_json(F.lit(json.dumps([{"h": h, "p": p, "v": v} for h, p, v in rules])), "array<struct<h:string,p:string,v:string>>")
    table = parts.sparkSession.range(1).select(F.inline(literal))
    labels = F.split("host", "[.]")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    own = parts.select("host").distinct().select("host", F.explode(domains).alias("h")).join(table, "h")
    entry = F.struct((-F.length(F.concat("h", "p"))).alias("n"), "h", "p", "v")
    own = own.groupBy("host").agg(F.collect_set(entry).alias("fit"))  # at most the rules of one host's domains
    met = parts.join(own, "host", "left")
    best = F.array_min(F.filter("fit", lambda r: F.col("path").startswith(r["p"])))
    return met.withColumn("best", best).select(*parts.columns, F.concat("best.h", "best.p").alias("rule"), F.col("best.v").alias("ruled"))


def judge(pages: DataFrame, weights: list[float], rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule``, ``verdict``, ``p_block``."""
    parts = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    grams = _grams(F.col("host"), F.col("path"))
    z = F.aggregate(grams, F.lit(0.0), lambda a, g: a + F.get(table, g)) + F.lit(weights[-1])
    scored = parts.withColumn("p_block", F.when(F.size(grams) == 0, F.lit(0.0)).otherwise(1 / (1 + F.exp(-z))))
    if len(rules) > MAX_RULES:
        ruled = _with_many_rules(scored, rules)
    else:
        text, verdict = _rule(F.col("host"), F.col("path"), rules)
        ruled = scored.withColumns({"rule": text, "ruled": verdict})
    method = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return ruled.select(id_col, "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "p_block")
