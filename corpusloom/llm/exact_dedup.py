"""Exact deduplication against a persistent digest index (operator 7, DataFrame operations only).

The index is a Parquet table bucketed and sorted by digest, so looking a batch up is a sort-merge
join that moves the batch's digests and never the index. A batch is reduced to one row per digest
before anything is joined, hence a text that makes up a third of the input costs one row per map task.

Defined results: a null text counts as empty. Of rows with equal texts the largest id stays, a null id
being smaller than any other. Of repeated rows (same id and text) exactly one stays; where their other columns differ, ``keep``
keeps the one whose columns, as JSON, have the smallest digest. A digest that the
index already holds keeps its earlier owner, so every new row with another id is dropped. An empty batch
gives an empty result. Columns besides id and text pass through ``keep`` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.workspace import DigestTable, Workspace, keep_rows, row_key, salted_lookup, table_buckets


def text_digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text in UTF-8; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


class DigestIndex(DigestTable):
    """A table ``(digest, keep_id)``; ``buckets`` fixes the number of files per append (see ``index_buckets``)."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 16, id_type: str = "bigint"):
        super().__init__(spark, name, path, f"digest STRING, keep_id {id_type}", buckets)

    def append_new(self, groups: DataFrame) -> None:
        """Append the digests of ``groups(digest, keep_id)`` that the index lacks; running it twice adds nothing."""
        self.append(self.lacking(groups.select("digest", "keep_id")))


def index_buckets(docs: DataFrame) -> int:
    """Buckets for an index that is begun with ``docs``; counting a Parquet scan reads its footers only."""
    return table_buckets(docs.count())


def assign(
    docs: DataFrame, index: DigestIndex, ws: Workspace, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``; the index grows.

    The result reads written tables and no longer the index, which may be closed.
    """
    keyed = docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest"))
    rows = ws.save(keyed.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("copies")), "rows")
    groups = ws.save(rows.groupBy("digest").agg(F.max("id").alias("top_id"), F.sum("copies").alias("group_size")), "groups")
    index.append_new(groups.withColumnRenamed("top_id", "keep_id"))
    owners = ws.save(groups.select("digest", "group_size").join(index.rows().hint("merge"), "digest"), "owners")
    owned = salted_lookup(rows, owners, "digest", F.col("id"), F.col("group_size"))
    each = owned.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep(docs: DataFrame, assigned: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``assign`` keeps, with all their columns, one per kept id and text."""
    decided = assigned.select(row_key(F.col(id_col), F.col("text_sha256")).alias("key"), "kept")
    return keep_rows(docs, row_key(docs[id_col], text_digest(docs[text_col])), decided, ws)
