"""Token counts through a digest cache (operator 3).

The cache has one Parquet table ``(digest, n_tokens)`` per tokenizer, bucketed and sorted by the content's SHA-256 and named
by the SHA-256 of the vocabulary file. A batch is reduced to its distinct digests, those are joined to the cache by a
sort-merge join that does not move the cache, only distinct contents that it lacks are encoded, and what was encoded is
appended, so a second run over the same texts encodes nothing. Where a counted number of digests is copied or known already, contents that
occur once are encoded by the tasks that read them, and only copied ones move; else texts move once, copies merged before.

Normalisation must not change a count, hence only null is normalised, to the empty text. Defined
results: null and empty texts have 0 bytes and 0 tokens; equal texts are encoded once; every input row
gives one row, repeated rows included; an empty table gives an empty result. Texts are encoded whole.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import tokens
from corpusloom.llm.exact_dedup import text_digest
from corpusloom.llm.workspace import DigestTable, Workspace, salted_lookup

#: Digests up to this number (about 150 bytes each) are broadcast to the texts; more are joined.
BROADCAST_KEYS = 500_000


class CountCache:
    """Token counts by content below ``path``, one bucketed table per tokenizer; an existing path is continued."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 16):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets
        self.tables: dict[str, DigestTable] = {}

    def table(self, tokenizer: str) -> DigestTable:
        short = tokenizer[:16]
        if short not in self.tables:
            self.tables[short] = DigestTable(self.spark, f"{self.name}_{short}", f"{self.path}/{short}", "digest STRING, n_tokens BIGINT", self.buckets)
        return self.tables[short]

    def close(self) -> None:
        for table in self.tables.values():
            table.close()


def _encoder(path: str):
    def run(batches):
        memo = tokens.memo(path, True)
        for batch in batches:
            counts = memo.encode_all(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def count_tokens(
    docs: DataFrame, cache: CountCache, ws: Workspace, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``n_tokens``; the cache gains the batch's new contents.

    The result reads written tables and no longer the cache, which may be closed.
    """
    table = cache.table(tokens.version_digest(tokenizer_path))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text"), text_digest(text).alias("digest"))
    rows = keyed.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("copies"), F.first(F.octet_length("text")).cast("long").alias("n_bytes"))
    rows = ws.save(rows, "rows")
    sizes = ws.save(rows.groupBy("digest").agg(F.sum("copies").alias("size")), "sizes")
    missing = ws.save(table.lacking(sizes.select("digest")).withColumn("missing", F.lit(True)), "missing")
    special = ws.save(sizes.join(missing, "digest", "left").filter("missing is null or size > 1").select("digest", "missing"), "special")
    texts = keyed.select("digest", "text")
    # copies are merged before the exchange
    once = lambda df: df.groupBy("digest").agg(F.first("text").alias("text"))
    if special.count() <= BROADCAST_KEYS:  # contents that occur once are encoded where they are read
        alone = texts.join(F.broadcast(special.select("digest")), "digest", "left_anti")
        copied = once(texts.join(F.broadcast(special.filter("missing").select("digest")), "digest", "left_semi"))
        contents = [alone, copied]
    elif missing.count() <= BROADCAST_KEYS:
        contents = [once(texts.join(F.broadcast(missing.select("digest")), "digest", "left_semi"))]
    else:
        contents = [once(texts).join(missing, "digest", "left_semi").select("digest", "text")]
    encoded = [c.mapInArrow(_encoder(tokenizer_path), "digest string, n_tokens bigint") for c in contents]
    table.append(encoded[0] if len(encoded) == 1 else encoded[0].unionByName(encoded[1]))
    # an append that was repeated after a failure may have left a digest twice; grouping a bucketed table moves nothing
    known = table.rows().groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    known = ws.save(sizes.join(known.hint("merge"), "digest"), "counts")
    found = salted_lookup(rows, known, "digest", F.col("id"), F.col("size"))
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
