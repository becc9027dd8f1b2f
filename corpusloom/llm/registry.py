"""Queries of the operators in this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontam, exact_dedup, license_scan, minhash, packing, secrets, token_counts, toxicity, url_filter, warc_zstd
from corpusloom.llm.workspace import Workspace, bounded_batches, table_buckets
from corpusloom.sources import io


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return io.read_table(spark, sf_dir, name)


#: Host, path and verdict of the rules that go before the model.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = url_filter.train(url_filter.seed_labels(spark), Workspace(spark, "op1"))
    return url_filter.judge(_table(spark, sf_dir, "pages"), weights, URL_RULES)


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of operator 1: hosts, paths and the rules' part of the verdict."""
    judged = url_filter.judge(_table(spark, sf_dir, "pages"), [0.0] * (url_filter.BUCKETS + 1), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


def op2_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "op2")
    folder = ws.mkdirs("archives")
    warc_zstd.write_pages(_table(spark, sf_dir, "pages"), ws, folder)
    read = warc_zstd.read_pages(spark, folder)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "op3")
    docs = _table(spark, sf_dir, "documents")
    cache = token_counts.CountCache(spark, f"counts_{uuid.uuid4().hex[:12]}", f"{ws.path}/cache", table_buckets(docs.count()))
    counts = token_counts.count_tokens(docs, cache, ws, public_tokenizers.path("word_bpe_49k.json"))
    cache.close()
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op4_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces, _ = packing.pack(
        _table(spark, sf_dir, "documents"),
        Workspace(spark, "op4"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
    )
    return pieces


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return secrets.digest_columns(secrets.scan_documents(_table(spark, sf_dir, "documents")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), Workspace(spark, "op6"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "op7")
    docs = _table(spark, sf_dir, "documents")
    index = exact_dedup.DigestIndex(spark, f"digests_{uuid.uuid4().hex[:12]}", f"{ws.path}/index", exact_dedup.index_buckets(docs))
    assigned = exact_dedup.assign(docs, index, ws)
    index.close()
    return assigned


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels"), Workspace(spark, "op8")))


def op9_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), Workspace(spark, "op9"), percent=85)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the table has no paths: sources are trees of languages and of ten folders each
    path = F.concat_ws("/", "source", "lang", (F.col("doc_id") % 10).cast("string"), F.concat(F.lit("doc"), F.col("doc_id")))
    files = _table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    ws = Workspace(spark, "op10")
    return license_scan.resolve(license_scan.own_licences(files, ws), ws)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "url_rules": url_rules,
    "op2_warc_archives": op2_warc_archives,
    "op3_token_counts": op3_token_counts,
    "op4_curve_packing": op4_curve_packing,
    "op5_secret_scan": op5_secret_scan,
    "op6_decontamination": op6_decontamination,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_minhash_components": op9_minhash_components,
    "op10_license_scan": op10_license_scan,
}

#: Base32 of 40 hex digits: each five of them are four characters.
_BASE32 = (
    "array_to_string(flatten(list_transform(range(8), lambda i: list_transform([15, 10, 5, 0], lambda k:"
    " substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, i * 5 + 1, 5))::INT >> k) & 31)::INT + 1, 1)))), '')"
)
_RULE_CASE = lambda column: "CASE " + " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if column == 'rule' else v}'"
    for h, p, v in sorted(URL_RULES, key=lambda r: (-len(r[0] + r[1]), r))
) + " END"

ORACLES: dict[str, str] = {
    "url_rules": f"""
        WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
        SELECT page_id, host, path, {_RULE_CASE('rule')} AS rule, {_RULE_CASE('ruled')} AS ruled FROM parts""",
    "op2_warc_archives": f"""
        WITH k AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
        o AS (SELECT *, max(page_id) OVER (PARTITION BY t) AS owner FROM k)
        SELECT page_id, octet_length(encode(t)) AS payload_bytes, {_BASE32} AS payload_digest,
            CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to FROM o""",
    "op7_exact_dedup": """
        WITH k AS (SELECT doc_id, coalesce(text, '') AS t, sha256(coalesce(text, '')) AS h FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
        FROM k WINDOW w AS (PARTITION BY t)""",
}
