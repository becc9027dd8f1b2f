"""Structure, retrieval, evaluation, sources and streaming on small tables."""

import json
import math
import random
import re

from pyspark.sql import functions as F

from corpusloom.operators import answers, datasets, evaluation, retrieval, structure
from corpusloom.sources import io
from corpusloom.streaming.ingest import ingest

BLOCKS = "doc_id long, pos int, page int, type string, level int, text string"


def secs(spark, rows):
    return structure.sections(spark.createDataFrame([(1, i, 0, *r) for i, r in enumerate(rows)], BLOCKS))


def test_text_before_a_section_is_dropped_and_parents_are_nearest_smaller_levels(spark):
    found = secs(spark, [("paragraph", 0, "lost"), ("heading", 2, "A"), ("heading", 1, "B"), ("heading", 2, "C"), ("paragraph", 0, "x"), ("paragraph", 0, "y")])
    assert [(r["title"], r["parent_pos"], r["text"]) for r in found.orderBy("sec_pos").collect()] == [("A", None, ""), ("B", None, ""), ("C", 2, "x\n\ny")]


def test_chunks_are_numbered_in_preorder_and_blank_sections_pass_their_parent(spark):
    rows = [("heading", 1, "A"), ("paragraph", 0, "p" * 700), ("heading", 2, "B"), ("paragraph", 0, "q"), ("heading", 1, "C"), ("heading", 2, "D"), ("paragraph", 0, "r")]
    got = structure.chunk(secs(spark, rows)).orderBy("chunk_id").collect()
    assert [(r["chunk_id"][-1], r["parent_id"] and r["parent_id"][-1], r["section_path"], r["is_section"]) for r in got] == [
        ("1", None, "A", True), ("2", "1", "A", False), ("3", "1", "A", False), ("4", "1", "A > B", True), ("5", "4", "A > B", False), ("6", None, "C > D", True), ("7", "6", "C > D", False),
    ]
    assert structure.jump_to_parent(structure.chunk(secs(spark, rows)), structure.chunk(secs(spark, rows))).count() == 7


def test_empty_tables(spark):
    empty = secs(spark, [])
    assert structure.chunk(empty).count() == 0
    index = retrieval.build_sparse(spark.createDataFrame([], "doc_id long, text string"))
    assert retrieval.search_sparse(spark.createDataFrame([(1, "q")], "qid long, query string"), index).count() == 0


def test_sparse_search_pads_with_zeros_in_corpus_order(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, "gamma delta"), (4, None), (5, "zeta eta")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "delta"), (8, "the")], "qid long, query string")
    rows = retrieval.search_sparse(asked, retrieval.build_sparse(docs), 3).orderBy("qid", "rank").collect()
    assert [(r["qid"], r["doc_id"]) for r in rows] == [(7, 3), (7, 1), (7, 2), (8, 1), (8, 2), (8, 3)]
    assert rows[0]["score"] > 0 == rows[1]["score"]


def test_negative_scores_stay_and_come_after_zeros(spark):
    docs = spark.createDataFrame([(1, "common"), (2, "common"), (3, "common"), (4, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "common")], "qid long, query string")
    rows = retrieval.search_sparse(asked, retrieval.build_sparse(docs), 3).orderBy("rank").collect()
    assert [r["doc_id"] for r in rows] == [4, 1, 2] and rows[0]["score"] == 0 > rows[1]["score"]


def test_dense_blocks_give_what_one_block_gives(spark):
    vectors = spark.range(200).select(F.col("id").alias("doc_id"), F.array(*((F.col("id") * k % 17).cast("float") for k in (3, 5, 7))).alias("embedding"))
    asked = vectors.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "qid")
    for metric in ("dot", "cosine"):
        whole = retrieval.search_dense(asked, vectors, 7, metric, skip_self=True).collect()
        assert len(whole) == 70 and sorted(whole) == sorted(retrieval.search_dense(asked, vectors, 7, metric, skip_self=True, query_block=3).collect())
    for row in whole:
        a, b = (next(r["embedding"] for r in vectors.filter(F.col("doc_id") == i).collect()) for i in (row["qid"], row["doc_id"]))
        norm = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        assert abs(row["score"] - (sum(x * y for x, y in zip(a, b, strict=True)) / norm if norm else 0.0)) < 1e-6
        break
    assert retrieval.search_dense(asked.limit(0), vectors).count() == 0 and retrieval.search_dense(asked, vectors.limit(0)).count() == 0


def test_hits_are_restored_with_defaults(spark):
    chunks = spark.createDataFrame([("a", 1, "t", "A > B", 3, ""), ("b", 2, None, None, None, "p")], "chunk_id string, doc_id long, text string, section_path string, page int, parent_id string")
    hits = spark.createDataFrame([("a", 0.5), ("b", 0.4), ("gone", 0.3)], "chunk_id string, score double")
    rows = {r["chunk_id"]: tuple(r)[2:] for r in retrieval.restore(hits, chunks).collect()}
    assert rows == {"a": ("1", "t", "A > B", 3, None), "b": ("2", "", "", 0, "p"), "gone": ("", "", "", 0, None)}
    vectors = spark.createDataFrame([([1.0, 2.0],)], "embedding array<double>")
    assert (retrieval.dimension(vectors), retrieval.dimension(vectors, 384), retrieval.dimension(vectors.limit(0))) == (2, 384, 0)


def test_settings_reach_the_configuration():
    from corpusloom.plans import config

    found = config.RetrievalConfig.of(config.load("bm25: {k1: 1.2}\nfusion: {weights: {sparse: 2}}\nreranker: {name: null}\nembedder: {dim: 8}"))
    assert (found.k1, found.b, found.w_sparse, found.w_dense, found.rerank, found.dim) == (1.2, 0.75, 2, 1.0, False, 8)
    assert config.RetrievalConfig.of({}) == config.RetrievalConfig()
    assert config.EvalConfig.of({"self_rag": {"citation_threshold": 0.6}}) == config.EvalConfig(citation=0.6)
    assert config.resolve("a/b", "/r/") == "/r/a/b" and config.resolve("/a", "/r") == "/a" and config.resolve("s3://a", "/r") == "s3://a"


def test_spans_end_at_the_next_end_marker(spark):
    a, e = datasets.START + datasets.ROLE, datasets.END
    texts = [f"{a}\nx {a} y{e}", f"{a}\nopen {a} more", f"{a}{e}{a}\nz{e}", "none", "", f"{e}{a}\nk{e}tail {a}"]

    def spans(text):
        out, at = [], 0
        while (start := text.find(a, at)) >= 0:
            body = start + len(a)
            body += text[body : body + 1] == "\n"
            end = text.find(e, body)
            if end < 0:
                break
            out.append((body, end))
            at = end + len(e)
        return out

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", datasets.assistant_spans(F.col("t")).alias("s"))
    assert {r["i"]: [tuple(x) for x in r["s"]] for r in df.collect()} == {i: spans(t) for i, t in enumerate(texts)}


def test_deep_sections_have_whole_paths_and_nearest_parents(spark):
    rows = [("heading", 1, "A"), ("paragraph", 0, " a "), ("heading", 2, "B"), ("heading", 3, ""), ("paragraph", 0, "c"), ("heading", 4, "D"), ("paragraph", 0, "d")]
    got = structure.chunk(secs(spark, rows)).filter("is_section").orderBy("chunk_id").collect()
    assert [(r["section_path"], r["text"], r["parent_id"] and r["parent_id"][-1]) for r in got] == [("A", "a", None), ("A > B", "c", "1"), ("A > B >  > D", "d", "3")]


def test_answers_without_hits_are_not_grounded(spark):
    hits = spark.createDataFrame([(1, 5, 1, 0.5, "t")], "qid long, doc_id long, rank int, score double, text string")
    rows = {r["qid"]: json.loads(r["payload"]) for r in answers.template_answer(hits, spark.createDataFrame([(1,), (2,)], "qid long")).collect()}
    assert rows[1]["is_grounded"] and not rows[2]["is_grounded"] and rows[2]["citations"] == [] and rows[2]["confidence"] == 0.0
    assert set(rows[1]) == set(rows[2]) == set(answers.REQUIRED)


def test_every_summary_occurs(spark):
    from corpusloom.plans import queries

    found = {r["summary"] for r in queries.self_eval_report(spark, "/root/testdata/sf0.01").select("summary").distinct().collect()}
    assert found == {"faithful", "partly_faithful", "unfaithful", "no_claims", "irrelevant"}


def test_failed_documents_cost_only_themselves(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, None, "broken"), (3, "b", None)], "doc_id long, text string, error string")
    rows, errors = datasets.per_document(docs, lambda d: d.select("doc_id"), failed=F.col("error"))
    assert [r[0] for r in rows.orderBy("doc_id").collect()] == [1, 3] and [tuple(r) for r in errors.collect()] == [(2, "broken")]
    assert [r[0] for r in datasets.per_document(docs, lambda d: d.select("doc_id"), limit=1)[0].collect()] == [1]


def test_entry_without_what_the_operators_need(tmp_path):
    """Where a package of theirs is missing, the operators' queries are, and all others stay."""
    import os
    import subprocess
    import sys

    (tmp_path / "public_tokenizers.py").write_text("raise ModuleNotFoundError('blocked', name='public_tokenizers')")
    path = os.pathsep.join([str(tmp_path), os.environ["PYTHONPATH"]])
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], env={**os.environ, "PYTHONPATH": path}, cwd=path.split(os.pathsep)[1], check=True)


def test_sparse_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "doc_id long, text string")
    index = retrieval.build_sparse(docs)
    index.save(str(tmp_path))
    asked = spark.createDataFrame([(7, "beta")], "qid long, query string")
    again = retrieval.search_sparse(asked, retrieval.SparseIndex.load(spark, str(tmp_path)), 2).collect()
    assert sorted(again) == sorted(retrieval.search_sparse(asked, index, 2).collect())


def plain_sparse(docs, asked, k, k1=1.5, b=0.75):
    """Okapi scores of every document in the plainest way."""
    from corpusloom.functions.text import STOPWORDS

    cut = lambda text: [w for w in re.findall(r"[a-z0-9+#.-]{2,}", (text or "").lower()) if w not in STOPWORDS]
    words = {i: cut(text) for i, text in docs}
    mean = sum(map(len, words.values())) / len(words)
    df = {t: sum(t in w for w in words.values()) for t in {t for w in words.values() for t in w}}
    raw = {t: math.log(len(words) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    idf = {t: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, x in raw.items()}
    out = []
    for qid, query in asked:
        scored = []
        for i, w in words.items():
            parts = [idf[t] * w.count(t) * (k1 + 1) / (w.count(t) + k1 * (1 - b + b * len(w) / mean)) for t in cut(query) if t in w]
            scored.append((-round(sum(parts), 7) + 0.0, i))
        out += [(qid, i, rank) for rank, (_, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def test_sparse_search_moves_k_documents_of_a_query_and_no_matches(spark, monkeypatch):
    dice = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, None if i % 40 == 7 else " ".join(dice.choices(words[: 3 if i % 9 == 0 else 60], [60 / (j + 1) for j in range(3 if i % 9 == 0 else 60)], k=dice.randrange(1, 30)))) for i in range(300)]
    docs += [(300 + i, "w0 w1 w55 common") for i in range(50)]
    asked = [(i, " ".join(dice.choices(words, k=6)) + " common" * (i % 2)) for i in range(20)] + [(98, "unseen"), (99, None)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    queries = spark.createDataFrame(asked, "qid long, query string")
    monkeypatch.setattr(retrieval, "PIECE", 150)  # several pieces in a task, so that later ones meet the best of earlier ones
    index = retrieval.build_sparse(rows)
    found = retrieval.search_sparse(queries, index, 4)
    assert sorted((r["qid"], r["doc_id"], r["rank"]) for r in found.collect()) == plain_sparse(docs, asked, 4)
    small = retrieval.search_sparse(queries, index, 4, 1.2, 0.6, query_block=3)
    assert sorted((r["qid"], r["doc_id"], r["rank"]) for r in small.collect()) == plain_sparse(docs, asked, 4, 1.2, 0.6)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and not re.search(r"hashpartitioning\(qid#\d+L?, doc_id", plan)
    built = index.entries._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in built


def test_fusion_sums_and_breaks_ties_by_dense_rank(spark):
    ranks = "qid long, doc_id long, rank int"
    fused = retrieval.fuse(spark.createDataFrame([(1, 10, 1), (1, 11, 2)], ranks), spark.createDataFrame([(1, 12, 1), (1, 11, 2)], ranks), 5)
    assert [r["doc_id"] for r in fused.orderBy("rank").collect()] == [11, 10, 12]


def test_citations(spark):
    scores = evaluation.citation_scores(F.col("p"), F.col("g"))
    rows = spark.createDataFrame([(["a", "a", "b"], ["a"]), ([], ["a"]), (["a"], [])], "p array<string>, g array<string>")
    got = rows.select(*(c.alias(k) for k, c in scores.items())).collect()
    assert [tuple(r)[:2] for r in got] == [(1.0, 0.5), (0.0, 0.0), (0.0, 0.0)]


def test_claims(spark):
    long = " ".join(f"This is sentence number {i}." for i in range(10))
    rows = spark.createDataFrame([("",), ("Nineteen characters",), (long,), (None,)], "a string").select(F.size(evaluation.claims(F.col("a"))).alias("n"))
    assert [r["n"] for r in rows.collect()] == [0, 0, 8, 0]


def test_summaries(spark):
    gates = spark.createDataFrame([(1, True), (2, True), (3, True), (4, True), (5, False)], "qid long, relevant boolean")
    rows = [(q, i, "c", 1, 0.6, True, i < k) for q, k, n in ((1, 4, 5), (2, 1, 2), (3, 0, 2), (5, 1, 1)) for i in range(n)]
    verdicts = spark.createDataFrame(rows, "qid long, claim_no int, claim string, doc_id long, score double, supported boolean, grounded boolean")
    assert [r["summary"] for r in evaluation.report(gates, verdicts).orderBy("qid").collect()] == ["faithful", "partly_faithful", "unfaithful", "no_claims", "irrelevant"]


def test_padding(spark):
    rows = spark.createDataFrame([(1, [5], [5]), (1, [6, 7, 8], [-100, 7, 8])], "b int, input_ids array<int>, labels array<int>")
    got = datasets.pad_batches(rows, "b").orderBy("input_ids").collect()
    assert (got[0]["input_ids"], got[0]["attention_mask"], got[0]["labels"]) == ([5, 0, 0], [1, 0, 0], [5, -100, -100])


def test_validation(spark):
    good = {"answer": "a", "reasoning": "r", "citations": [{"chunk_id": "c", "confidence": 0.5}], "confidence": 0.5, "is_grounded": True}
    rows = [good, good | {"extra": 1}, {k: v for k, v in good.items() if k != "answer"}, good | {"citations": [{"confidence": 1}]}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)] + [(4, None), (5, "no")], "i int, j string").orderBy("i")
    got = df.select(answers.is_valid(F.col("j")), answers.is_valid(F.col("j"), full=False)).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, True), (False, False), (False, True), (False, False), (False, False)]
    sent = df.filter("i in (0, 5)").select(answers.envelope(F.col("j")).alias("e")).collect()
    assert [json.loads(json.loads(r["e"])["choices"][0]["message"]["content"])["is_grounded"] for r in sent] == [True, False]


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# TITLE: T\nbody\n", encoding="utf-8")
    (tmp_path / "b.pdf").write_bytes(b"2")
    (tmp_path / "c.pdf").write_bytes(b"x")
    assert [(r["title"], r["text"]) for r in io.load_extracted(spark, str(tmp_path)).collect()] == [("T", "# TITLE: T\nbody\n")]
    assert io.read_lines(spark, str(tmp_path)).count() == 2
    spans = io.parse_files(io.scan_files(spark, str(tmp_path)), lambda content: [(0, 0, 12.0, str(int(content)), [0.0])])
    assert {(r["doc_id"][-5:], r["text"], r["error"] is None) for r in spans.collect()} == {("b.pdf", "2", True), ("c.pdf", None, False)}
    io.write_jsonl(spark.createDataFrame([(1, "é")], "i int, t string"), f"{tmp_path}/out")
    assert io.read_jsonl(spark, f"{tmp_path}/out", "i int, t string").first()["t"] == "é"
    table = io.VectorTable(spark, f"{tmp_path}/vectors", text_chars=2)
    assert table.count() == 0
    table.add(spark.createDataFrame([(1, "abc")], "i int, text string"))
    table.add(spark.createDataFrame([(2, "abc")], "i int, text string"))
    assert table.count() == 2 and table.rows().first()["text"] == "ab"


def test_stream_ingest(spark, tmp_path):
    good = "One sentence stands here. Another sentence stands there. And a third one ends the text of this row."
    rows = spark.createDataFrame([(1, good), (2, good), (3, "short")], "doc_id long, text string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    ingest(stream, f"{tmp_path}/table", f"{tmp_path}/ck").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/table").count() == 1


def test_plans_limit_ranks_early_and_keep_python_out(spark):
    from corpusloom.plans import queries

    plan = queries.bm25_topk(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Python" not in plan and "Pandas" not in plan


def test_small_functions(spark, tmp_path):
    from corpusloom.operators import vocab
    from corpusloom.plans import config

    found = spark.createDataFrame([("a", ["x"], 1), ("b", ["y", "z"], 2), ("c", ["z"], 3)], "id string, categories array<string>, published int")
    assert [r["id"] for r in io.in_categories(found, ["x", "z"], limit=2).collect()] == ["c", "b"]
    assert io.in_categories(found, []).count() == 3
    tokens = spark.createDataFrame([('{"b": 1, "a": 2}',)], "j string").select(F.explode(vocab.added_tokens(F.col("j"))).alias("token"))
    vocab.write_tokens(tokens, f"{tmp_path}/tokens")
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/tokens").collect()) == ["a", "b"]
    assert config.load("a: {b: 1}", {"a": {"c": 2}}) == {"a": {"b": 1, "c": 2}}


def test_failing_pages_cost_only_themselves(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"1,x,3")
    (tmp_path / "b.pdf").write_bytes(b"?")

    def pages(content):
        for no, part in enumerate(content.decode().split(",")):
            yield no, lambda part=part: [(0, 12.0, str(int(part)), [0.0])]

    rows = [(r["doc_id"][-5:], r["page"], r["text"], r["error"] is None) for r in io.parse_pages(io.scan_files(spark, str(tmp_path)), pages).collect()]
    assert sorted(rows, key=str) == sorted([("a.pdf", 0, "1", True), ("a.pdf", 1, None, False), ("a.pdf", 2, "3", True), ("b.pdf", 0, None, False)], key=str)


def test_files_per_text_reports_and_table_checks(spark, tmp_path):
    import pytest

    io.write_texts(spark.createDataFrame([("a/b", "x\ny"), ("c", "z")], "doc_id string, text string"), f"{tmp_path}/texts", "doc_id")
    assert {r["name"]: r["value"] for r in spark.read.text(f"{tmp_path}/texts", wholetext=True).collect()} == {"a_b": "x\ny\n", "c": "z\n"}
    io.write_report({"recall": {"hybrid": 1.0}}, f"{tmp_path}/r/report.json")
    assert json.loads((tmp_path / "r" / "report.json").read_text()) == {"recall": {"hybrid": 1.0}}
    table = io.VectorTable(spark, f"{tmp_path}/v", dim=2)
    table.add(spark.createDataFrame([(1, [0.5, 1.0])], "i int, embedding array<double>"))
    with pytest.raises(ValueError):
        table.add(spark.createDataFrame([("1", [0.5, 1.0])], "i string, embedding array<double>"))
    with pytest.raises(Exception, match="2 entries"):
        table.add(spark.createDataFrame([(2, [0.5])], "i int, embedding array<double>"))
    assert table.count() == 1
    assert retrieval.SparseIndex.load(spark, f"{tmp_path}/nothing") is None


def test_service(spark):
    from corpusloom.plans.queries import letter_encoder
    from corpusloom.plans.service import Service

    texts = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta epsilon"), (3, "zeta eta theta")], "doc_id long, text string")
    service = Service(spark, texts, retrieval.build_sparse(texts), retrieval.encode(texts, letter_encoder), letter_encoder)
    assert service.health() == {"status": "ok", "documents": 3}
    rows = service.retrieve(["delta", "theta zeta"], top_k=1).orderBy("qid").collect()
    assert [(r["qid"], r["doc_id"]) for r in rows] == [(0, 2), (1, 3)] and rows[0]["sources"] == ["dense", "sparse", "rerank"]
    assert service.retrieve(["delta"], 1, "sparse").first()["sources"] == ["sparse"]
    chats = spark.createDataFrame([(7, 0, "user", "hello"), (7, 1, "assistant", "yes"), (7, 2, "user", "delta")], "conv_id long, turn long, role string, text string")
    answer = json.loads(json.loads(service.complete(chats).first()["response"])["choices"][0]["message"]["content"])
    assert answer["citations"][0]["chunk_id"] == "2" and answer["is_grounded"]


def test_small_tables_are_dealt_over_the_cores(spark, tmp_path):
    spark.range(100_000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("t")).coalesce(1).write.parquet(f"{tmp_path}/big.parquet")
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/small.parquet")
    big, small = io.read_table(spark, str(tmp_path), "big"), io.read_table(spark, str(tmp_path), "small")
    assert big.rdd.getNumPartitions() == 4 and big.count() == 100_000 and small.rdd.getNumPartitions() == 1


def test_schema_of_a_file(spark):
    schema = {"required": ["answer", "n"], "properties": {"answer": {"type": "string"}, "n": {"type": "integer"}, "c": {"type": "array", "items": {"type": "object", "properties": {"id": {"type": "string"}}}}}}
    columns, required = answers.schema_of(json.dumps(schema))
    row = spark.createDataFrame([('{"answer": "a", "n": 2, "c": [{"id": "x"}]}',)], "j string").select(F.from_json("j", columns).alias("o"), answers.missing_keys(F.lit('{"n": 1}'), required).alias("m")).first()
    assert (row["o"]["n"], row["o"]["c"][0]["id"], row["m"]) == (2, "x", ["answer"])


def test_texts_are_cut_before_they_are_moved(spark):
    texts = spark.createDataFrame([(i, f"{i} " + "x" * 600) for i in range(3)], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "1 x")], "qid long, query string")
    found = spark.createDataFrame([(7, 1, 1, 0.51234567, ["sparse"]), (7, 2, 2, 0.2, ["sparse"])], "qid long, doc_id long, rank int, score double, sources array<string>")
    below = lambda df: (plan := df._jdf.queryExecution().executedPlan().toString()).index("Join") < plan.rindex("substring(")
    shown, again = retrieval.present(found, asked, texts), retrieval.rerank(found, asked, texts, 2)
    assert below(shown) and below(again)
    assert [(r["doc_id"], len(r["text"]), r["score"]) for r in shown.orderBy("rank").collect()] == [(1, 500, 0.5123), (2, 500, 0.2)]
    said = answers.template_answer(found.join(texts, "doc_id"))
    assert re.search(r"collect_list\([^\n]*substring\(", said._jdf.queryExecution().executedPlan().toString())
    assert json.loads(said.first()["payload"])["answer"] == "Found 2 passages. Best: 1 " + "x" * 178
