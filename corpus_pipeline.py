"""The corpus pipeline: toxicity, exact dedup, near dedup, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept. All but the last return
the columns of ``documents``, whatever they are; the last returns the pieces of packed sequences.

Every stage decides by row, never by id alone: a row is told apart by its id and its text together, so null ids and
rows that share an id are judged each by their own text. Null texts count as empty. Rows with equal id and text are repeated rows. Empty
tables pass through all stages.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontam, exact_dedup, minhash, packing, toxicity
from corpusloom.llm.workspace import Workspace, keep_rows, row_key
from corpusloom.sources import io


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that the ordinal model, fitted on the labelled documents, takes for toxic.

    Null and empty texts are not toxic and stay; repeated rows are judged each; columns of any name pass through; texts are scored whole.
    """
    every = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(every, labels, Workspace(spark, "toxic")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the row with the largest id, a null id being smaller than any other.

    Null and empty texts are equal, so one of them all stays; of repeated rows one stays, the one whose columns, as JSON, have the smallest digest.
    """
    ws = Workspace(spark, "exact")
    index = exact_dedup.DigestIndex(spark, f"digests_{uuid.uuid4().hex[:12]}", f"{ws.path}/index", exact_dedup.index_buckets(docs))
    assigned = exact_dedup.assign(docs, index, ws)
    index.close()
    return exact_dedup.keep(docs, assigned, ws)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a similarity of 0.8 on five-word shingles keep one row, that of the smallest id.

    A null id is larger than any other here; rows of equal id go by a digest of id and text, repeated rows as in the exact stage. Null, empty and blank
    texts are linked with nothing and stay (repeated rows of them once).
    """
    ws = Workspace(spark, "near")
    key = row_key(docs["doc_id"], exact_dedup.text_digest(docs["text"]))
    order = F.struct(docs["doc_id"].isNull().alias("none"), docs["doc_id"].alias("id"), key.alias("key"))
    groups = minhash.near_duplicates(docs.select(order.alias("row"), docs["text"].alias("text")), ws, percent=80, id_col="row")
    return keep_rows(docs, key, groups.select("row.key", "kept"), ws)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage; null and empty texts hold none, repeated rows are judged alike."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Workspace(spark, "leaks"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left along the Hilbert curve; a null or empty text is the end id alone, repeated rows are packed each."""
    pieces, _ = packing.pack(
        docs,
        Workspace(spark, "pack"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
    )
    return pieces


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Training, MinHash components and tokenizers are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again."""
    ws = Workspace(spark, "pipeline")
    docs = io.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return docs
