"""Shared-folder tables: how the operators of this subpackage cut lineage.

Intermediate results are written as Parquet below the folder that the session names in
``spark.checkpoint.dir``. Every executor can read them, so a lost executor costs a task retry and
nothing else.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.scratch import delete, shared_dir

#: Rows per Python batch and per batch of the Parquet reader, where the session has Spark's own defaults: texts can be
#: very long, and a batch is held whole.
BATCH_ROWS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "500"),
    "spark.sql.parquet.columnarReaderBatchSize": ("4096", "512"),
}


def bounded_batches(spark: SparkSession) -> None:
    """Smaller batches for the session, where it has Spark's defaults."""
    for key, (default, rows) in BATCH_ROWS.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, rows)


class Workspace:
    """A folder of Parquet tables below the shared folder, deleted by ``close`` or when the driver ends.

    Opening one also makes the session's batches smaller (see ``BATCH_ROWS``) where they are Spark's defaults.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/corpusloom/{label}-{uuid.uuid4().hex[:12]}"
        bounded_batches(spark)
        atexit.register(delete, spark, self.path)

    def save(self, df: DataFrame, name: str, mode: str = "error") -> DataFrame:
        """Write ``df`` and give it back as a scan of the written files."""
        path = f"{self.path}/{name}"
        df.write.mode(mode).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no later plan reads."""
        delete(self.spark, f"{self.path}/{name}")

    def mkdirs(self, name: str) -> str:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)
        return f"{self.path}/{name}"

    def close(self) -> None:
        """Delete all tables, once no plan reads them."""
        delete(self.spark, self.path)


#: Keys with more rows than this are dealt over several tasks; at most HOT_KEYS keys can have more than their fair share.
FAIR_ROWS, HOT_KEYS = 10_000, 50_000


def salted_lookup(many: DataFrame, one: DataFrame, key: str, spread: Column, size: Column) -> DataFrame:
    """Inner-join ``many`` to the single row of ``one`` per ``key`` with hot keys dealt over as many tasks as they need.

    ``one`` is a written table, and ``size`` on it says how many rows of ``many`` have the key. A key is hot beyond
    ``FAIR_ROWS`` rows or a ``HOT_KEYS``-th of all rows, whichever is more, so there are at most ``HOT_KEYS`` hot keys: they
    alone are broadcast, and only their rows of ``one`` are copied, once for each such share. ``spread`` is an
    expression on ``many`` that deals a key's rows out.
    """
    total = one.agg(F.sum(size)).first()[0] or 0
    fair = max(FAIR_ROWS, -(-int(total) // HOT_KEYS))
    shares = F.when(size > fair, F.ceil(size / F.lit(fair)).cast("int")).otherwise(F.lit(1))
    hot = one.filter(size > fair).select(key, shares.alias("__shares"))
    if hot.isEmpty():
        return many.join(one, key)
    left = many.join(F.broadcast(hot), key, "left").withColumn("__salt", F.pmod(F.xxhash64(spread), F.coalesce("__shares", F.lit(1))).cast("int"))
    right = one.withColumn("__salt", F.explode(F.sequence(F.lit(0), shares - 1)))
    return left.drop("__shares").join(right, [key, "__salt"]).drop("__salt")


#: Row keys up to this number (about 100 bytes each) are broadcast; more are joined by sort-merge.
BROADCAST_KEYS = 1_000_000


def few(keys: DataFrame) -> DataFrame:
    """A written table of row keys, to be broadcast if its number of rows is within the bound."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def row_key(id_: Column, text_digest: Column) -> Column:
    """What tells the rows of a corpus apart where ids are null or repeated: 16 bytes of the digest of id and text, never null."""
    both = F.concat(F.when(id_.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), id_.cast("string"))), F.lit(":"), text_digest)
    return F.unhex(F.substring(F.sha2(both, 256), 1, 32))


def keep_rows(docs: DataFrame, key: Column, decided: DataFrame, ws: Workspace) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is kept in ``decided(key, kept)``, which has one row per row of ``docs``.

    Only keys that are dropped or repeated are written and joined: up to ``BROADCAST_KEYS`` of them no
    document moves, and otherwise documents move once. Of rows with equal kept keys the one stays whose columns, as JSON, have the
    smallest digest.
    """
    name = free_name(docs)
    per = decided.groupBy("key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    special = ws.save(per.filter("not kept or rows > 1").select(F.col("key").alias(name), "kept"), "special")
    tagged = docs.withColumn(name, key)
    rest = tagged.join(few(special.select(name)), name, "left_anti").drop(name)
    repeated = special.filter("kept").select(name)
    if repeated.isEmpty():
        return rest
    whole = F.struct(*columns_of(docs))
    firsts = tagged.join(few(repeated), name, "left_semi").groupBy(name).agg(F.min_by(whole, F.sha2(F.to_json(whole), 256)).alias("__row"))
    return rest.unionByName(firsts.select("__row.*"))


def columns_of(df: DataFrame) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def free_name(df: DataFrame) -> str:
    """A column name that ``df`` does not have."""
    name = "__key"
    while name in df.columns:
        name += "_"
    return name


def table_buckets(rows: int) -> int:
    """Buckets of a digest table for about this many rows in each of its appends, a power of two."""
    return 1 << max(4, (max(1, rows) // 4_000_000).bit_length())


class DigestTable:
    """A Parquet table bucketed and sorted by ``digest`` at ``path``, so that looking digests up never moves the table.

    The catalog entry is needed for bucketed scans only; ``close`` drops it and leaves the files. Opening a path that holds a
    table continues it, with the number of buckets that it was made with.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, columns: str, buckets: int):
        self.spark, self.name, self.buckets = spark, name, buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def lacking(self, found: DataFrame) -> DataFrame:
        """The rows of ``found`` whose digest the table lacks, by sort-merge anti-join."""
        return found.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, rows: DataFrame) -> None:
        rows.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
