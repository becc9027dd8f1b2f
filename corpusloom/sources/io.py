"""Readers and writers (IO4-IO16). Network download and PDF parsing stay outside; parsing plugs in as a function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPANS = "doc_id string, page int, seq int, size double, text string, bbox array<double>, error string"


#: Tables below this size are read as they lie.
SPREAD_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table with fewer scan tasks than the session has cores, dealt over all cores; any other as it is.

    A file of one row group is one task whatever its size, and expressions over texts cost far more than moving a small table. A
    table that fills the cores is never moved.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    if size < SPREAD_BYTES or df._jdf.javaRDD().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``folder``, over all cores."""
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def scan_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", limit: int | None = None) -> DataFrame:
    """Files below a folder by name, with their bytes (IO4)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).orderBy("path")
    return files if limit is None else files.limit(limit)


def in_categories(found: DataFrame, wanted: list[str], column: str = "categories", limit: int | None = None) -> DataFrame:
    """Records of a search that share a category with ``wanted``, newest first (IO3, FL9); all where none is asked for."""
    rows = found.filter(F.arrays_overlap(column, F.array(*map(F.lit, wanted)))) if wanted else found
    rows = rows.orderBy(F.desc("published"), "id")
    return rows if limit is None else rows.limit(limit)


def parse_files(files: DataFrame, parse: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    """Spans by ``parse(content) -> (page, seq, size, text, bbox)``; a failing file gives one row with its error (IO5, IO6)."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [(path, *span, None) for span in parse(content)]
                except Exception as e:  # one bad file must not end the job
                    rows.append((path, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "seq", "size", "text", "bbox", "error"])

    return files.select("path", "content").mapInPandas(run, SPANS)


def parse_pages(files: DataFrame, pages: Callable[[bytes], Iterator[tuple[int, Callable[[], Iterator[tuple]]]]]) -> DataFrame:
    """As ``parse_files`` for a parser that gives ``(page, read)``, where ``read()`` gives ``(seq, size, text, bbox)``.

    A page that fails gives one row with its error and costs no other page (IO5).
    """

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    for page, read in pages(content):
                        try:
                            rows += [(path, page, *span, None) for span in list(read())]
                        except Exception as e:
                            rows.append((path, page, None, None, None, None, str(e)))
                except Exception as e:
                    rows.append((path, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "seq", "size", "text", "bbox", "error"]).astype(object)

    return files.select("path", "content").mapInPandas(run, SPANS)


def write_texts(texts: DataFrame, path: str, name_col: str, text_col: str = "text", mode: str = "errorifexists") -> None:
    """One text file per row, in a folder of the row's name (IO6)."""
    named = texts.select(F.replace(F.col(name_col).cast("string"), F.lit("/"), F.lit("_")).alias("name"), F.col(text_col).alias("value"))
    named.repartition("name").write.mode(mode).partitionBy("name").option("lineSep", "\n").text(path)


def write_report(report: dict, path: str) -> None:
    """A report of a few figures as one JSON file (IO17)."""
    import json
    from pathlib import Path

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(report, ensure_ascii=False, indent=2), encoding="utf-8")


def load_extracted(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, title, text)`` of text files; the title is the first line without its prefix (IO8)."""
    files = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.regexp_extract("value", r"^(?:# TITLE: )?([^\n]*)", 1).alias("title"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of all text files below a folder (IO12); unreadable files are skipped."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").option("ignoreCorruptFiles", True).text(folder)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per row, non-ASCII text as it is (IO9, IO10, IO17)."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


class VectorTable:
    """A Parquet table of chunks with vectors; created when first written, appended to later (IO13-IO15).

    Rows that are added must have the table's columns and types, and vectors of ``dim`` entries where it is given.
    """

    def __init__(self, spark: SparkSession, path: str, text_chars: int = 16_000, dim: int | None = None, vector: str = "embedding"):
        self.spark, self.path, self.text_chars, self.dim, self.vector = spark, path, text_chars, dim, vector

    def exists(self) -> bool:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)

    def add(self, chunks: DataFrame) -> None:
        capped = chunks.withColumn("text", F.substring("text", 1, self.text_chars)) if "text" in chunks.columns else chunks
        if self.exists():
            old, new = ({f.name: f.dataType for f in df.schema} for df in (self.rows(), capped))
            if old != new:
                raise ValueError(f"the table has {sorted(old)}, the rows have {sorted(new)}, or types differ")
        if self.dim is not None and self.vector in capped.columns:
            wrong = F.raise_error(F.lit(f"a vector has not {self.dim} entries"))
            capped = capped.withColumn(self.vector, F.when(F.size(self.vector) == self.dim, F.col(self.vector)).otherwise(wrong))
        capped.write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def count(self) -> int:
        """Number of rows, 0 where nothing was written yet."""
        return self.rows().count() if self.exists() else 0
