"""Queries over the sparse search: DuckDB's rows, and less moved than the table has postings."""

import random

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from corpusloom.operators import retrieval
from tests.test_oracles import plain

NAMES = ("rrf_fuse", "mrr_at_10", "citation_grounding", "citation_prf", "recall_at_k")


def moved(spark):
    """Rows that the session has written to shuffles so far."""
    jvm = spark.sparkContext._gateway
    none = jvm.jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, jvm.new_array(jvm.jvm.double, 0), none)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """400 documents of the same frequent words: most documents match most queries. One is null, one empty, and two are alike."""
    dice, folder = random.Random(3), tmp_path_factory.mktemp("search")
    words = [f"word{i}" for i in range(120)]
    texts = [". ".join(" ".join(dice.choices(words, k=10)) for _ in range(8)) for _ in range(400)]
    texts[7], texts[9], texts[51] = None, "", texts[50]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    vectors = [(i, [dice.uniform(-1, 1) for _ in range(8)]) for i in range(400) if i != 100]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return folder, sum(len(set((t or "").replace(".", "").split())) for t in texts)


@pytest.mark.parametrize("name", NAMES)
def test_moves_less_than_the_postings(spark, tables, name):
    folder, postings = tables
    before = moved(spark)
    df = entry.queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert sum(n for stage, n in moved(spark).items() if stage not in before) < postings / 2
    duck = duckdb.connect()
    for table in ("documents", "embeddings"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    relation = duck.sql(entry.oracle_sql()[name])
    places = [relation.columns.index(c) for c in columns]
    assert ours == sorted(tuple(plain(r[i]) for i in places) for r in relation.fetchall())


def test_small_batches_are_put_together_and_large_ones_cut():
    rows = [(i, ["t"] * n) for i, n in enumerate([3, 0, 4, 2, 9, 1, 1, 1, 0, 6])]
    whole = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "terms": pa.array([t for _, t in rows], pa.list_(pa.string()))})
    for step in (1, 3, 10):
        got = list(retrieval._pieces((whole.slice(i, step) for i in range(0, 10, step)), 1, 10))
        assert [b.column(0).to_pylist() for b in got] == [[0, 1, 2], [3], [4], [5, 6, 7, 8], [9]]
        assert pa.concat_batches(got).equals(whole)
    assert list(retrieval._pieces(iter([whole.slice(0, 0)]), 1, 10)) == []


def test_batch_rows_come_back(spark):
    was = spark.conf.get(retrieval.scratch.BATCH)
    sizes = spark.range(5000).coalesce(1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    assert {r["n"] for r in retrieval.scratch.written(sizes, "sizes", 100).collect()} == {100}
    assert spark.conf.get(retrieval.scratch.BATCH) == was
