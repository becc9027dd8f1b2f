"""One query per operator over the whole driver tables, and DuckDB SQL that says the same.

Docstrings name the operator's handle. Queries take ``(spark, sf_dir)``; searches ask with every row whose id is
divisible by 50. Inputs that the tables lack are pure functions of them, written the same way in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import udfs
from corpusloom.operators import answers, datasets, evaluation, quality, retrieval, structure, vocab
from corpusloom.plans import config
from corpusloom.plans.config import RetrievalConfig
from corpusloom.sources import io, scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return io.read_table(spark, sf, name)


# --- SQL fragments -----------------------------------------------------------------------------------------------

_STOP = "[" + ",".join(f"'{w}'" for w in T.STOPWORDS) + "]"


def _tok(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower({c}), '[a-z0-9+#.-]{{2,}}'), lambda x: NOT list_contains({_STOP}, x))"


def _squeeze(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


def _sentences(c: str) -> str:
    return rf"string_split(regexp_replace({c}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_EVAL = f"""
    squeezed AS (SELECT doc_id, {_squeeze("text")} AS s FROM documents),
    asked AS (SELECT doc_id AS qid, left(array_to_string({_sentences("s")}[1:2], ' '), 140) AS query FROM squeezed
              WHERE length(s) >= 250 AND doc_id % 50 = 0),
    queries AS (SELECT * FROM asked WHERE length(query) >= 40)"""
_POSTINGS = f"""
    tokens AS MATERIALIZED (SELECT doc_id, {_tok("coalesce(text, '')")} AS w FROM documents),
    lengths AS MATERIALIZED (SELECT doc_id, len(w) AS dl FROM tokens),
    postings AS MATERIALIZED (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM tokens) GROUP BY ALL),
    stats AS MATERIALIZED (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths),
    raw AS MATERIALIZED (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw
            FROM postings, stats GROUP BY term),
    mean AS MATERIALIZED (SELECT avg(raw) AS m FROM raw),
    terms AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END AS idf FROM raw, mean)"""
_SPARSE = f"""
    qterms AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({_tok("query")}) AS term FROM queries) GROUP BY ALL),
    hits AS (SELECT qid, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
             FROM qterms JOIN terms USING (term) JOIN postings USING (term) JOIN lengths USING (doc_id), stats GROUP BY ALL),
    padded AS (SELECT * FROM hits UNION ALL (SELECT qid, doc_id, 0.0 FROM queries, (SELECT doc_id FROM lengths ORDER BY 1 LIMIT 39) f
               WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.qid = queries.qid AND h.doc_id = f.doc_id))),
    sparse AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM padded QUALIFY rank <= 20)"""
_DOT = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[])"
_DENSE = f"""
    vq AS (SELECT qid, embedding AS asked FROM queries JOIN embeddings ON vec_id = qid),
    dense AS (SELECT qid, vec_id AS doc_id, round({_DOT.format("embedding", "asked")}, 9) AS score,
              row_number() OVER (PARTITION BY qid ORDER BY round({_DOT.format("embedding", "asked")}, 9) DESC, vec_id) AS rank
              FROM vq, embeddings QUALIFY rank <= 20)"""
_FUSED = """
    merged_ranks AS (SELECT qid, doc_id, d.rank AS dr, s.rank AS sr, coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0) AS score
             FROM dense d FULL JOIN sparse s USING (qid, doc_id)),
    fused AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, dr NULLS LAST, sr NULLS LAST) AS rank
              FROM merged_ranks QUALIFY rank <= 30)"""


def _overlap(q: str, t: str) -> str:
    return f"len(list_intersect(list_distinct({_tok(q)}), {_tok(t)}))::DOUBLE / greatest(len(list_distinct({_tok(q)})), 1)"


_HYBRID = f"""
    rescored AS (SELECT qid, doc_id, f.rank AS was, round({_overlap("query", "left(text, 512)")}, 9) AS score
                 FROM fused f JOIN queries USING (qid) JOIN documents USING (doc_id)),
    hybrid AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, was) AS rank FROM rescored)"""
_ALL = f"WITH {_EVAL}, {_POSTINGS}, {_SPARSE}, {_DENSE}, {_FUSED}, {_HYBRID}"

# --- text --------------------------------------------------------------------------------------------------------


_STAMP = "arXiv:2101.01234  v2 [cs.CL] 12 3 2021 10:20 UTC "


def _injected() -> Column:
    return F.concat(F.lit(_STAMP + "\\textbf{"), "lang", F.lit("} {x} \\emph\u200b  "), "text", F.lit("\n\n\n\n \u00a0Submitted to venue"))


def _cleaning(prefix: str) -> str:
    return rf"""WITH a AS (SELECT doc_id, '{prefix}{_STAMP}\textbf{{' || lang || '}} {{x}} \emph' || chr(8203) || '  ' || text || repeat(chr(10), 4) || ' ' || chr(160) || 'Submitted to venue' AS t FROM documents),
    b AS (SELECT doc_id, replace(replace(t, chr(160), ' '), chr(8203), '') AS t FROM a),
    c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\\[a-zA-Z]+\{{([^}}]*)\}}', '\1', 'g'), '\\[a-zA-Z]+', ' ', 'g') AS t FROM b),
    d AS (SELECT doc_id, regexp_replace(t, '[{{}}]', ' ', 'g') AS t FROM c),
    e AS (SELECT doc_id, regexp_replace(t, 'arXiv:\d{{4}}\.\d{{4,5}}\s+v\d+\s+\[[^\]]+\]\s+[\d\s:UTC]+', ' ', 'g') AS t FROM d),
    f AS (SELECT doc_id, regexp_replace(t, '(?i)\bSubmitted to\b[^\n]*(\n?)\z', ' \1') AS t FROM e),
    g AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM f)
    SELECT doc_id, regexp_replace(t, '^\s+|\s+$', '', 'g') AS cleaned FROM g"""


@query(_cleaning(""))
def clean_text(spark, sf):
    """CL1b-h on texts with injected markup."""
    return _read(spark, sf, "documents").select("doc_id", T.clean_markup(_injected()).alias("cleaned"))


@query(_cleaning("fi1 "))
def clean_text_nfkc(spark, sf):
    """CL1 with compatibility normalisation: the injected ligature and wide digit are taken apart, the tables hold no other."""
    raw = F.concat(F.lit("\ufb01\uff11 "), _injected())
    return _read(spark, sf, "documents").select("doc_id", T.clean_markup(udfs.nfkc(raw)).alias("cleaned"))


@query(f"SELECT doc_id, len({_tok('text')}) AS n, array_to_string({_tok('text')}, ' ') AS tokens FROM documents")
def bm25_tokens(spark, sf):
    """TX1."""
    tokens = T.sparse_tokens(F.col("text"))
    return _read(spark, sf, "documents").select("doc_id", F.size(tokens).alias("n"), F.array_join(tokens, " ").alias("tokens"))


@query(f"SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS sentence FROM (SELECT doc_id, {_sentences('text')} AS p FROM documents)")
def sentence_split(spark, sf):
    """TX4."""
    return _read(spark, sf, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@query(
    r"""SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS paragraph FROM (SELECT doc_id,
    list_filter(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda x: length(regexp_replace(x, '\s', '', 'g')) > 0) AS p FROM documents)"""
)
def paragraph_split(spark, sf):
    """TX7."""
    text = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return _read(spark, sf, "documents").select("doc_id", F.posexplode(T.paragraphs(text)).alias("pos", "paragraph"))


@query(f"SELECT doc_id, {_squeeze('text')} AS squeezed FROM documents")
def whitespace_squeeze(spark, sf):
    """TX8."""
    return _read(spark, sf, "documents").select("doc_id", T.squeeze(F.col("text")).alias("squeezed"))


@query(
    r"""SELECT doc_id, regexp_replace(t, '\[chunk_[^\]]+\]', '', 'g') AS bare, trim('["' || source || '"]', '[]"'' ') AS cited,
    replace(source || '/' || lang, '/', '_') AS safe, array_to_string(regexp_extract_all(text, '[0-9]+'), ',') AS digits
    , list_last(string_split(source || '/' || lang, '/')) AS segment
    FROM (SELECT *, text || '[chunk_' || doc_id || '] [chunk_]' AS t FROM documents)"""
)
def citation_and_name_functions(spark, sf):
    """TX9, TX10, TX13, TX16 and digit extraction."""
    t = F.concat("text", F.lit("[chunk_"), F.col("doc_id").cast("string"), F.lit("] [chunk_]"))
    return _read(spark, sf, "documents").select(
        "doc_id", T.strip_citations(t).alias("bare"), T.citation_id(F.concat(F.lit('["'), "source", F.lit('"]'))).alias("cited"),
        T.safe_name(F.concat_ws("/", "source", "lang")).alias("safe"), F.array_join(F.regexp_extract_all("text", F.lit("([0-9]+)"), F.lit(1)), ",").alias("digits"),
        T.last_segment(F.concat_ws("/", "source", "lang")).alias("segment"),
    )


# --- corpus ------------------------------------------------------------------------------------------------------

_REASON = r"""quality AS (SELECT doc_id, CASE WHEN length(s) < 80 THEN 'short'
    WHEN len(list_filter(string_split_regex(s, '[.!?。！？]\s'), lambda x: length(regexp_replace(x, '\s', '', 'g')) > 0)) < 2 THEN 'few_sentences'
    WHEN list_max(map_values(list_aggregate(string_split(lower(s), ''), 'histogram'))) / greatest(length(s), 1) > 0.5 THEN 'repetitive'
    WHEN length(regexp_replace(s, '[^\p{L}]', '', 'g')) / greatest(length(s), 1) < 0.15 THEN 'few_letters' ELSE 'ok' END AS reason
    FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM documents))"""


@query(f"WITH {_REASON} SELECT doc_id, reason FROM quality")
def quality_reasons(spark, sf):
    """FL1-FL4 with the rule that fails."""
    return _read(spark, sf, "documents").select("doc_id", quality.quality_reason(F.col("text")).alias("reason"))


@query(f"WITH {_REASON} SELECT doc_id, reason = 'ok' AS passes FROM quality")
def quality_filter(spark, sf):
    """FL1-FL4."""
    return _read(spark, sf, "documents").select("doc_id", (quality.quality_reason(F.col("text")) == "ok").alias("passes"))


_EDGES = {"blank": "regexp_replace(text, '[^ .\\n]', 'z', 'g')", "digits": "translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', '01234567890123456789012345')"}


@query(
    "WITH " + ", ".join(_REASON.replace("quality AS", f"{name} AS").replace("FROM documents", f"FROM (SELECT doc_id, {text} AS text FROM documents)") for name, text in _EDGES.items())
    + " SELECT doc_id, blank.reason AS one_letter, digits.reason AS digits FROM blank JOIN digits USING (doc_id)"
)
def quality_edges(spark, sf):
    """FL3 and FL4 on texts that they reject: every letter the same one, and letters turned to digits."""
    same = F.regexp_replace("text", "[^ .\\n]", "z")
    digits = F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz", "01234567890123456789012345")
    return _read(spark, sf, "documents").select("doc_id", quality.quality_reason(same).alias("one_letter"), quality.quality_reason(digits).alias("digits"))


@query(f"WITH {_REASON} SELECT reason, quality AS label, count(*) AS n FROM quality q JOIN labels USING (doc_id) GROUP BY ALL")
def quality_vs_labels(spark, sf):
    """FL1-FL4 against labels."""
    judged = _read(spark, sf, "documents").select("doc_id", quality.quality_reason(F.col("text")).alias("reason"))
    return judged.join(_read(spark, sf, "labels"), "doc_id").groupBy("reason", F.col("quality").alias("label")).agg(F.count(F.lit(1)).alias("n"))


_SHINGLE = """hashed AS (SELECT doc_id, md5(CASE WHEN len(w) < 8 THEN array_to_string(w, ' ') ELSE array_to_string(list_sort(list_distinct(
    list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' ')))), ' ') END) AS shingle_hash
    FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents))"""


@query(f"WITH {_SHINGLE} SELECT * FROM hashed")
def shingle_hash(spark, sf):
    """TX2, TX3."""
    return _read(spark, sf, "documents").select("doc_id", T.shingle_hash(F.col("text")).alias("shingle_hash"))


@query(f"WITH {_SHINGLE} SELECT shingle_hash, min(doc_id) AS doc_id, count(*) AS group_size FROM hashed GROUP BY 1")
def shingle_dedup(spark, sf):
    """DD1."""
    return quality.shingle_dedup(_read(spark, sf, "documents"))


_LINES = r"""SELECT doc_id, line_no, line FROM (SELECT doc_id, line_no, regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '[{}]', ' ', 'g'), '(?i)\bSubmitted to\b[^\n]*\z', ' '), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS line
    FROM (SELECT doc_id, unnest(range(len(p))) AS line_no, unnest(p) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))) WHERE length(line) BETWEEN 10 AND 500"""


@query(f"WITH {_SHINGLE} SELECT doc_id, text FROM (SELECT doc_id, row_number() OVER (PARTITION BY shingle_hash ORDER BY doc_id) AS n FROM hashed) JOIN documents USING (doc_id) WHERE n = 1")
def dedup_records(spark, sf):
    """DD1 with whole records."""
    return quality.dedup_records(_read(spark, sf, "documents").select("doc_id", "text"))


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(text, '\b\d+(?:\.\d+)?(?:%|x|×)?\b'), ',') AS numbers FROM documents")
def number_extract(spark, sf):
    """TX11."""
    return _read(spark, sf, "documents").select("doc_id", F.array_join(T.numbers(F.col("text")), ",").alias("numbers"))


@query(_LINES)
def corpus_lines(spark, sf):
    """IO12, FL5."""
    return quality.corpus_lines(_read(spark, sf, "documents"))


# --- retrieval ---------------------------------------------------------------------------------------------------


def _queries(docs: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
    asked = docs.filter(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("qid"), T.eval_query(F.col("text")).alias("query")).filter("query is not null")
    if embeddings is None:
        return asked
    return asked.join(embeddings.select(F.col("vec_id").alias("qid"), "embedding"), "qid", "left")


def _vectors(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")


def _heads(docs: DataFrame) -> DataFrame:
    """What a template answer shows of each text: a join moves no more of it."""
    return docs.select("doc_id", F.substring("text", 1, answers.BEST_CHARS).alias("text"))


@query(f"WITH {_EVAL} SELECT * FROM queries")
def eval_queries(spark, sf):
    """ME8, FL7."""
    return _queries(_read(spark, sf, "documents"))


@query(f"WITH {_POSTINGS} SELECT n AS n_docs, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM terms) AS n_terms, (SELECT count(*) FROM postings) AS n_postings FROM stats")
def bm25_index_stats(spark, sf):
    """SP1."""
    index = retrieval.build_sparse(_read(spark, sf, "documents"), written=True)
    terms = index.terms.agg(F.count(F.lit(1)).alias("n_terms"), F.sum("df").alias("n_postings"))
    return index.stats.join(F.broadcast(terms), how="inner").select("n_docs", F.round("avgdl", 6).alias("avgdl"), "n_terms", "n_postings")


@query(f"WITH {_POSTINGS} SELECT term, doc_id, tf, df, round(idf, 6) AS idf FROM postings JOIN terms USING (term)")
def bm25_postings(spark, sf):
    """SP1."""
    index = retrieval.build_sparse(_read(spark, sf, "documents"), written=True)
    return index.postings.join(index.terms, "term").select("term", "doc_id", "tf", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_EVAL}, {_POSTINGS}, {_SPARSE} SELECT qid, doc_id, round(score, 6) AS score, rank FROM sparse")
def bm25_topk(spark, sf):
    """SP2, SP3, SP4."""
    docs = _read(spark, sf, "documents")
    found = retrieval.search_sparse(_queries(docs), retrieval.build_sparse(docs, written=True))
    return found.select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


def _vector_sql(score: str) -> str:
    return f"""SELECT q.vec_id AS qid, e.vec_id AS doc_id, round({score}, 6) AS score,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY round({score}, 9) DESC, e.vec_id) AS rank
        FROM embeddings q JOIN embeddings e ON q.vec_id != e.vec_id WHERE q.vec_id % 50 = 0 QUALIFY rank <= 20"""


def _search(spark, sf, metric: str) -> DataFrame:
    vectors = _read(spark, sf, "embeddings")
    asked = vectors.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), "embedding")
    found = retrieval.search_dense(asked, _vectors(vectors), 20, metric, skip_self=True)
    return found.select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


_QE = _DOT.format("q.embedding", "e.embedding")
_QQ, _EE = _DOT.format("q.embedding", "q.embedding"), _DOT.format("e.embedding", "e.embedding")


@query(_vector_sql(_QE))
def dense_dot_topk(spark, sf):
    """DE2."""
    return _search(spark, sf, "dot")


@query(_vector_sql(_QE))
def dense_appended(spark, sf):
    """DE2, DE5, IO13-IO15: the vectors are put into a table in two parts, and the table is searched."""
    vectors = _read(spark, sf, "embeddings")
    table = io.VectorTable(spark, scratch.folder(spark, "vectors"), dim=retrieval.dimension(vectors))
    for odd in (0, 1):
        table.add(_vectors(vectors).filter(F.col("doc_id") % 2 == odd))
    rows = table.rows()
    found = retrieval.search_dense(rows.filter(F.col("doc_id") % 50 == 0).withColumnRenamed("doc_id", "qid"), rows, skip_self=True)
    return found.select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(_vector_sql(f"{_QE} / sqrt({_EE} * {_QQ})"))
def dense_cosine_topk(spark, sf):
    """DE3."""
    return _search(spark, sf, "cosine")


def _both(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    docs, emb = _read(spark, sf, "documents"), _read(spark, sf, "embeddings")
    queries = _queries(docs, emb)
    dense = retrieval.search_dense(queries.filter("embedding is not null"), _vectors(emb), 20)
    sparse = retrieval.search_sparse(queries, retrieval.build_sparse(docs, written=True), 20)
    # a few rows per query, which the fused ranking reads again
    dense, sparse = scratch.written(dense, "dense"), scratch.written(sparse, "sparse")
    return docs, queries, dense, sparse, retrieval.fuse(dense, sparse, 30)


@query(f"WITH {_EVAL}, {_POSTINGS}, {_SPARSE}, {_DENSE}, {_FUSED} SELECT qid, doc_id, round(score, 9) AS score, rank FROM fused")
def rrf_fuse(spark, sf):
    """FU1, FU2, DD4."""
    *_, fused = _both(spark, sf)
    return fused.select("qid", "doc_id", F.round("score", 9).alias("score"), "rank")


def _retrieve(spark, sf, method: str, config: RetrievalConfig | None = None) -> DataFrame:
    docs, emb = _read(spark, sf, "documents"), _read(spark, sf, "embeddings")
    queries = _queries(docs, emb)
    found = retrieval.retrieve(queries, retrieval.build_sparse(docs, written=True), _vectors(emb), docs, method, config)
    shown = retrieval.present(found, queries, docs)
    return shown.select("qid", "doc_id", "score", "rank", "text", F.array_join("sources", ",").alias("sources"))


def _shown(table: str, sources: str) -> str:
    return f"SELECT qid, doc_id, round(score, 4) AS score, rank, left(text, 500) AS text, '{sources}' AS sources FROM {table} JOIN documents USING (doc_id) WHERE rank <= 5"


@query(f"WITH {_EVAL}, {_DENSE} {_shown('dense', 'dense')}")
def retrieve_dense(spark, sf):
    """FU4."""
    return _retrieve(spark, sf, "dense")


@query(f"WITH {_EVAL}, {_POSTINGS}, {_SPARSE} {_shown('sparse', 'sparse')}")
def retrieve_sparse(spark, sf):
    """FU4."""
    return _retrieve(spark, sf, "sparse")


@query(f"{_ALL} {_shown('hybrid', 'dense,sparse,rerank')}")
def retrieve_hybrid(spark, sf):
    """FU3, FU4, RR1, IO18."""
    return _retrieve(spark, sf, "hybrid")


_SETTINGS = "bm25: {k1: 1.2, b: 0.6}\nfusion: {rrf_k: 30, weights: {dense: 0.5, sparse: 2.0}}\nreranker: {name: null, top_k: 5}\ndense_k: 15\nsparse_k: 10\n"


@query(
    f"""WITH {_EVAL}, {_POSTINGS}, {_SPARSE.replace("tf * 2.5", "tf * 2.2").replace("1.5 * (0.25 + 0.75", "1.2 * (0.4 + 0.6").replace("rank <= 20", "rank <= 10").replace("LIMIT 39", "LIMIT 19")},
    {_DENSE.replace("rank <= 20", "rank <= 15")}, {_FUSED.replace("1.0::DOUBLE / (60 + d.rank)", "0.5::DOUBLE / (30 + d.rank)").replace("1.0::DOUBLE / (60 + s.rank)", "2.0::DOUBLE / (30 + s.rank)")}
    {_shown('fused', 'dense,sparse')}"""
)
def retrieve_fused(spark, sf):
    """FU3 without a reranker: fused scores stay; CF1-CF3: settings from YAML reach the plan."""
    return _retrieve(spark, sf, "hybrid", RetrievalConfig.of(config.load(_SETTINGS)))


@query(f"WITH {_EVAL} SELECT qid, query FROM queries ORDER BY md5(qid::VARCHAR || ':42'), qid LIMIT 50")
def sampled_queries(spark, sf):
    """ME8 with its seeded sample."""
    return evaluation.sample_queries(_queries(_read(spark, sf, "documents")), 50, 42)


@query(f"WITH {_EVAL}, {_POSTINGS}, {_SPARSE}, {_DENSE}, {_FUSED} SELECT qid, doc_id, 0.0::DOUBLE AS score, row_number() OVER (PARTITION BY qid ORDER BY f.rank) AS rank FROM fused f JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY f.rank) <= 5")
def rerank_fallback(spark, sf):
    """RR2."""
    docs, queries, *_, fused = _both(spark, sf)
    return retrieval.rerank(fused, queries, docs, 5, scorer=None)


# --- metrics -----------------------------------------------------------------------------------------------------


def _gold(queries: DataFrame) -> DataFrame:
    return queries.select("qid", F.col("qid").alias("doc_id"))


_METHODS = ("dense", "sparse", "hybrid")


@query(
    f"{_ALL}, ranks AS (" + " UNION ALL ".join(f"SELECT '{m}' AS method, q.qid, x.rank FROM queries q LEFT JOIN {m} x ON x.qid = q.qid AND x.doc_id = q.qid" for m in _METHODS) + ")"
    " SELECT method, metric, round(value, 6) AS value FROM (SELECT method, 'recall@5' AS metric, avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END) AS value FROM ranks GROUP BY 1"
    " UNION ALL SELECT method, 'recall@10', avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END) FROM ranks GROUP BY 1"
    " UNION ALL SELECT method, 'mrr@10', avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0.0 END) FROM ranks GROUP BY 1)"
)
def method_comparison(spark, sf):
    """ME1, ME2, ME7, ME9: the flagship; every method ranks, every ranking is scored, in one plan."""
    docs, queries, dense, sparse, fused = _both(spark, sf)
    hybrid = retrieval.rerank(fused, queries, docs, 30)
    return evaluation.compare({"dense": dense, "sparse": sparse, "hybrid": hybrid}, _gold(queries))


@query(f"WITH {_EVAL}, {_POSTINGS}, {_SPARSE} SELECT q.qid, max(CASE WHEN s.rank <= 5 THEN 1.0::DOUBLE ELSE 0.0 END) AS recall FROM queries q LEFT JOIN sparse s ON s.qid = q.qid AND s.doc_id = q.qid GROUP BY 1")
def recall_at_k(spark, sf):
    """ME1."""
    docs = _read(spark, sf, "documents")
    queries = _queries(docs)
    return evaluation.recall(retrieval.search_sparse(queries, retrieval.build_sparse(docs, written=True)), _gold(queries), 5)


@query(f"WITH {_EVAL}, {_POSTINGS}, {_SPARSE} SELECT q.qid, round(max(CASE WHEN s.rank <= 10 THEN 1.0::DOUBLE / s.rank ELSE 0.0 END), 6) AS rr FROM queries q LEFT JOIN sparse s ON s.qid = q.qid AND s.doc_id = q.qid GROUP BY 1")
def mrr_at_10(spark, sf):
    """ME2."""
    docs = _read(spark, sf, "documents")
    queries = _queries(docs)
    return evaluation.reciprocal_rank(retrieval.search_sparse(queries, retrieval.build_sparse(docs, written=True)), _gold(queries)).withColumn("rr", F.round("rr", 6))


_CITED = f"""WITH {_EVAL}, {_POSTINGS}, {_SPARSE}, {_DENSE}, p AS (SELECT qid, list(doc_id ORDER BY rank) AS pred FROM dense WHERE rank <= 3 GROUP BY 1),
    r AS (SELECT qid, list(doc_id ORDER BY rank) AS found FROM sparse WHERE rank <= 5 GROUP BY 1)"""


def _cited(spark, sf) -> DataFrame:
    _, _, dense, sparse, _ = _both(spark, sf)
    ids = lambda found, k, name: found.filter(F.col("rank") <= k).groupBy("qid").agg(F.collect_set("doc_id").alias(name))
    return ids(dense, 3, "pred").join(ids(sparse, 5, "found"), "qid")


@query(
    f"{_CITED}, h AS (SELECT qid, len(list_intersect(pred, [qid])) AS h, len(pred) AS n FROM p JOIN r USING (qid)) SELECT qid, h::DOUBLE AS citation_recall, round(h::DOUBLE / n, 6) AS citation_precision,"
    " round(CASE WHEN h > 0 THEN 2.0 * (h::DOUBLE / n) * h / (h::DOUBLE / n + h) ELSE 0.0 END, 6)::DOUBLE AS citation_f1, h AS hits FROM h"
)
def citation_prf(spark, sf):
    """ME3, DD2."""
    scores = evaluation.citation_scores(F.col("pred"), F.array("qid"))
    return _cited(spark, sf).select(
        "qid", scores["citation_recall"].alias("citation_recall"), F.round(scores["citation_precision"], 6).alias("citation_precision"),
        F.round(scores["citation_f1"], 6).alias("citation_f1"), F.size(scores["hit"]).cast("long").alias("hits"),
    )


@query(f"{_CITED} SELECT qid, round(len(list_intersect(pred, found))::DOUBLE / len(pred), 6) AS grounding FROM p JOIN r USING (qid)")
def citation_grounding(spark, sf):
    """ME6."""
    return _cited(spark, sf).select("qid", F.round(evaluation.grounding(F.col("pred"), F.col("found")), 6).alias("grounding"))


@query(
    f"""WITH {_EVAL}, {_POSTINGS}, {_SPARSE}, {_DENSE}, p AS (SELECT qid, list(doc_id) AS pred FROM dense WHERE rank <= 3 GROUP BY 1), g AS (SELECT qid, list(doc_id) AS gold FROM sparse WHERE rank <= 3 GROUP BY 1),
    h AS (SELECT qid, len(list_intersect(pred, gold)) AS h FROM p JOIN g USING (qid)) SELECT qid, round(h / 3.0, 4)::DOUBLE AS citation_recall, round(h / 3.0, 4)::DOUBLE AS citation_precision, round(h / 3.0, 4)::DOUBLE AS citation_f1 FROM h"""
)
def payload_citations(spark, sf):
    """ME4: the citations of one answer's JSON against another's."""
    docs, _, dense, sparse, _ = _both(spark, sf)
    payload = lambda found, name: answers.template_answer(found.join(_heads(docs), "doc_id")).withColumnRenamed("payload", name)
    both = payload(dense, "p").join(payload(sparse, "g"), "qid")
    scores = evaluation.citation_scores(evaluation.cited_ids(F.col("p")), evaluation.cited_ids(F.col("g")))
    return both.select("qid", *(F.round(scores[n], 4).alias(n) for n in ("citation_recall", "citation_precision", "citation_f1")))


# --- structure ---------------------------------------------------------------------------------------------------

_SPANS = r"""lines AS (SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS line FROM (SELECT doc_id,
        list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '\s', '', 'g')) > 0) AS p FROM documents)),
    spans AS (SELECT doc_id, i // 20 AS page, i AS seq, CASE WHEN i = 0 THEN 18.0::DOUBLE WHEN i % 12 = 6 THEN 13.0 WHEN i % 12 = 9 THEN 11.5 ELSE 10.0 END AS size,
        CASE WHEN i = 6 AND doc_id % 3 = 0 THEN line || ' Abstract' ELSE line END AS text FROM lines),
    body AS (SELECT doc_id, coalesce(quantile_cont(size, 0.5) FILTER (size > 0), 12.0) AS body FROM spans GROUP BY 1),
    numbered AS (SELECT *, row_number() OVER o - 1 AS pos, coalesce(sum(CASE WHEN size > body * 1.35 THEN 1 ELSE 0 END) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
        FROM spans JOIN body USING (doc_id) WINDOW o AS (PARTITION BY doc_id ORDER BY page, seq)),
    blocks AS (SELECT doc_id, pos, page, text, CASE WHEN size >= body * 1.12 THEN 'heading' ELSE 'paragraph' END AS type,
        CASE WHEN size > body * 1.35 AND earlier = 0 THEN 0 WHEN size >= body * 1.22 THEN 1 WHEN size >= body * 1.12 THEN 2 ELSE 0 END AS level FROM numbered)"""
_MERGED = _SPANS + """,
    flagged AS (SELECT *, CASE WHEN type = 'paragraph' AND lag(type) OVER o = 'paragraph' AND lag(page) OVER o = page THEN 0 ELSE 1 END AS fresh FROM blocks WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
    islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS island FROM flagged),
    merged AS (SELECT doc_id, island::INT AS pos, page, type, level, string_agg(text, ' ' ORDER BY pos) AS text FROM islands GROUP BY doc_id, island, page, type, level)"""
_SECTIONS = _MERGED + """,
    owned AS (SELECT *, last_value(CASE WHEN type = 'heading' AND level >= 1 THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sec_pos FROM merged),
    heads AS (SELECT doc_id, pos AS sec_pos, level, text AS title, page FROM owned WHERE type = 'heading' AND level >= 1),
    texts AS (SELECT doc_id, sec_pos, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS text FROM owned WHERE type = 'paragraph' AND sec_pos IS NOT NULL GROUP BY 1, 2),
    secs AS (SELECT doc_id, sec_pos, CASE WHEN level = 2 THEN last_value(CASE WHEN level = 1 THEN sec_pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY sec_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent_pos,
        level, title, page, coalesce(text, '') AS text FROM heads LEFT JOIN texts USING (doc_id, sec_pos))"""
_ABSTRACT = """abstracts AS (SELECT doc_id, regexp_replace(string_agg(text, chr(10) || chr(10) ORDER BY pos), '^\\s+|\\s+$', '', 'g') AS abstract FROM (
        SELECT *, min(CASE WHEN hit THEN no END) OVER (PARTITION BY doc_id) AS first FROM (
        SELECT *, type = 'heading' AND regexp_matches(text, '(?i)\\babstract\\b') AS hit, sum(CASE WHEN type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS no FROM merged))
        WHERE no = first AND type = 'paragraph' GROUP BY 1)"""


def _spans(docs: DataFrame) -> DataFrame:
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(T.strip(x)) > 0)
    rows = docs.select("doc_id", F.posexplode(lines).alias("i", "line"))
    size = F.when(F.col("i") == 0, 18.0).when(F.col("i") % 12 == 6, 13.0).when(F.col("i") % 12 == 9, 11.5).otherwise(10.0)
    text = F.when((F.col("i") == 6) & (F.col("doc_id") % 3 == 0), F.concat("line", F.lit(" Abstract"))).otherwise(F.col("line"))
    return rows.select("doc_id", F.floor(F.col("i") / 20).cast("int").alias("page"), F.col("i").alias("seq"), size.alias("size"), text.alias("text"))


def _blocks(spark, sf) -> DataFrame:
    return structure.merge_paragraphs(structure.classify(_spans(_read(spark, sf, "documents"))))


@query(f"WITH {_SPANS} SELECT * FROM body")
def body_median(spark, sf):
    """LY1."""
    return structure.body_sizes(_spans(_read(spark, sf, "documents")))


@query(f"WITH {_SPANS} SELECT doc_id, pos, page, text, type, level FROM blocks")
def classify_blocks(spark, sf):
    """LY2, LY3."""
    return structure.classify(_spans(_read(spark, sf, "documents")))


@query(f"WITH {_MERGED} SELECT * FROM merged")
def merge_paragraphs(spark, sf):
    """LY4."""
    return _blocks(spark, sf)


@query(f"WITH {_MERGED}, {_ABSTRACT} SELECT * FROM abstracts")
def abstract_extract(spark, sf):
    """LY5, TX14."""
    return structure.abstracts(_blocks(spark, sf))


@query(f"WITH {_SECTIONS} SELECT * FROM secs")
def section_tree(spark, sf):
    """LY6, LY7."""
    return structure.sections(_blocks(spark, sf))


@query(f"WITH {_MERGED} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS full_text FROM merged GROUP BY 1")
def full_text(spark, sf):
    """LY9."""
    return _blocks(spark, sf).groupBy("doc_id").agg(structure.joined("pos", "text", "\n\n").alias("full_text"))


@query(
    f"""WITH {_SECTIONS}, {_ABSTRACT}, parts AS (SELECT doc_id, string_agg(chr(10) || repeat('#', CASE WHEN parent_pos IS NULL THEN 2 ELSE 3 END) || ' ' || title || CASE WHEN text != '' THEN chr(10) || text ELSE '' END, chr(10) ORDER BY sec_pos) AS b FROM secs GROUP BY 1),
    titles AS (SELECT doc_id, text AS t FROM merged WHERE type = 'heading' AND level = 0)
    SELECT doc_id, '# TITLE: ' || coalesce(t, '') || CASE WHEN coalesce(abstract, '') != '' THEN chr(10) || chr(10) || '# ABSTRACT' || chr(10) || abstract ELSE '' END || CASE WHEN b IS NOT NULL THEN chr(10) || b ELSE '' END AS rendered
    FROM (SELECT DISTINCT doc_id FROM merged) LEFT JOIN titles USING (doc_id) LEFT JOIN abstracts USING (doc_id) LEFT JOIN parts USING (doc_id)"""
)
def doc_render(spark, sf):
    """IO7."""
    blocks = _blocks(spark, sf)
    return structure.render(blocks, structure.sections(blocks))


@query(
    """SELECT doc_id, i AS piece, regexp_replace(substr(text, i * 520 + 1, 600), '^\\s+|\\s+$', '', 'g') AS text FROM (SELECT doc_id, text,
    unnest(range(CASE WHEN length(text) <= 600 THEN 1 ELSE ceil((length(text) - 600) / 520)::INT + 1 END)) AS i FROM documents)"""
)
def hard_windows(spark, sf):
    """CK4."""
    return _read(spark, sf, "documents").select("doc_id", F.posexplode(T.windows(F.col("text"))).alias("piece", "text"))


def _packed(source: str, key: str, text: str) -> str:
    """CTEs ``packed(key, pieces)``: paragraphs of ``source`` put together one by one."""
    windows = r"list_transform(range(CASE WHEN length(x) <= 600 THEN 1 ELSE ceil((length(x) - 600) / 520)::INT + 1 END), lambda w: regexp_replace(substr(x, w * 520 + 1, 600), '^\s+|\s+$', '', 'g'))"
    return rf"""paras AS (SELECT {key}, list_filter(string_split_regex({text}, '\n\s*\n'), lambda x: length(regexp_replace(x, '\s', '', 'g')) > 0) AS p FROM {source}),
    walk AS (SELECT {key}, 0 AS i, '' AS open, []::VARCHAR[] AS done FROM paras UNION ALL
        SELECT {key}, i + 1, CASE WHEN length(x) > 600 THEN '' WHEN open = '' THEN x WHEN length(open) + length(x) + 2 <= 600 THEN open || chr(10) || chr(10) || x ELSE x END,
            CASE WHEN length(x) > 600 THEN list_concat(list_concat(done, CASE WHEN open = '' THEN [] ELSE [open] END), {windows}) WHEN open = '' OR length(open) + length(x) + 2 <= 600 THEN done ELSE list_append(done, open) END
        FROM (SELECT {key}, i, open, done, p[i + 1] AS x FROM walk JOIN paras USING ({key}) WHERE i < len(p))),
    packed AS (SELECT {key}, list_concat(done, CASE WHEN open = '' THEN [] ELSE [open] END) AS pieces FROM walk JOIN paras USING ({key}) WHERE i = len(p))"""


_CHUNKS = rf"""{_SECTIONS},
    solid AS (SELECT * REPLACE (regexp_replace(text, '^\s+|\s+$', '', 'g') AS text) FROM secs WHERE length(regexp_replace(text, '\s', '', 'g')) > 0),
    {_packed("solid", "doc_id, sec_pos", "text")},
    placed AS MATERIALIZED (SELECT s.*, pieces, 1 + coalesce(sum(len(pieces) + 1) OVER (PARTITION BY doc_id ORDER BY sec_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM solid s JOIN packed USING (doc_id, sec_pos)),
    named AS (SELECT n.doc_id, n.sec_pos, n.text, n.page, n.level, n.pieces, n.no, CASE WHEN u.title IS NULL THEN n.title ELSE u.title || ' > ' || n.title END AS section_path, m.no AS up_no
        FROM placed n LEFT JOIN secs u ON u.doc_id = n.doc_id AND u.sec_pos = n.parent_pos LEFT JOIN placed m ON m.doc_id = n.doc_id AND m.sec_pos = n.parent_pos),
    chunks AS MATERIALIZED (SELECT doc_id, format('{{}}__{{:05d}}', doc_id, no::BIGINT) AS chunk_id, CASE WHEN up_no IS NOT NULL THEN format('{{}}__{{:05d}}', doc_id, up_no::BIGINT) END AS parent_id,
            left(text, 2400) AS text, section_path, page, level, true AS is_section, NULL::INT AS piece FROM named
        UNION ALL SELECT doc_id, format('{{}}__{{:05d}}', doc_id, (no + 1 + i)::BIGINT), format('{{}}__{{:05d}}', doc_id, no::BIGINT), pieces[i + 1], section_path, page, level, false, i::INT
        FROM (SELECT *, unnest(range(len(pieces))) AS i FROM named))"""


@query(f"WITH RECURSIVE split AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents), {_packed('split', 'doc_id', 't')} SELECT doc_id, unnest(range(len(pieces)))::INT AS piece, unnest(pieces) AS text FROM packed")
def greedy_pack(spark, sf):
    """CK3."""
    text = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return _read(spark, sf, "documents").select("doc_id", F.posexplode(T.pack_paragraphs(text)).alias("piece", "text"))


@query(f"WITH RECURSIVE {_CHUNKS} SELECT * FROM chunks")
def section_chunks(spark, sf):
    """CK1, CK2, CK5, CK6."""
    return structure.chunk(structure.sections(_blocks(spark, sf)))


@query(f"WITH RECURSIVE {_CHUNKS} SELECT c.chunk_id, coalesce(c.parent_id, c.chunk_id) AS context_id, coalesce(u.text, c.text) AS context_text FROM chunks c LEFT JOIN chunks u ON u.chunk_id = c.parent_id WHERE NOT c.is_section")
def parent_jump(spark, sf):
    """RR3."""
    chunks = structure.chunk(structure.sections(_blocks(spark, sf)))
    return structure.jump_to_parent(chunks.filter("not is_section"), chunks).select("chunk_id", "context_id", "context_text")


_LETTERS = "etaonirs"


def letter_encoder(texts: list[str]) -> np.ndarray:
    """Counts of eight letters: an encoder that SQL can say, where a model would be."""
    return np.array([[t.lower().count(c) for c in _LETTERS] for t in texts], np.float64)


def _letters_sql(c: str) -> str:
    counts = f"[{', '.join(f"(length(lower({c})) - length(replace(lower({c}), '{x}', '')))::DOUBLE" for x in _LETTERS)}]"
    return f"list_transform({counts}, lambda v: (v / greatest(sqrt(list_dot_product({counts}, {counts})), 1e-12))::FLOAT)"


@query(f"SELECT doc_id, array_to_string(list_transform({_letters_sql('text')}, lambda v: round(v::DOUBLE, 4)::DECIMAL(9, 4)), ',') AS embedding, 8 AS dim FROM documents")
def encode_texts(spark, sf):
    """DE1 with batches of 16 and unit length, DE6."""
    made = retrieval.encode(_read(spark, sf, "documents"), letter_encoder)
    text = F.array_join(F.transform("embedding", lambda v: F.round(v.cast("double"), 4).cast("decimal(9,4)").cast("string")), ",")
    return made.select("doc_id", text.alias("embedding"), F.lit(retrieval.dimension(made)).alias("dim"))


_POOL = f"""{_CHUNKS}, pool AS MATERIALIZED (SELECT chunk_id AS doc_id, text FROM chunks),
    squeezed AS (SELECT chunk_id AS doc_id, {_squeeze("text")} AS s FROM chunks WHERE NOT is_section),
    asked AS (SELECT doc_id AS qid, left(array_to_string({_sentences("s")}[1:2], ' '), 140) AS query FROM squeezed WHERE length(s) >= 250),
    queries AS MATERIALIZED (SELECT * FROM asked WHERE length(query) >= 40 ORDER BY md5(qid || ':42'), qid LIMIT 50), {_POSTINGS.replace("FROM documents", "FROM pool")}, {_SPARSE},
    vectors AS MATERIALIZED (SELECT doc_id, {_letters_sql("text")} AS embedding FROM pool), vq AS MATERIALIZED (SELECT qid, {_letters_sql("query")} AS asked FROM queries),
    dense AS (SELECT qid, doc_id, round({_DOT.format("embedding", "asked")}, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY round({_DOT.format("embedding", "asked")}, 9) DESC, doc_id) AS rank FROM vq, vectors QUALIFY rank <= 20),
    {_FUSED}, {_HYBRID.replace("JOIN documents", "JOIN pool")}, hits AS (SELECT qid, rank, score, h.doc_id AS chunk_id, c.section_path, c.page, c.text, coalesce(u.text, c.text) AS context_text
        FROM hybrid h JOIN chunks c ON c.chunk_id = h.doc_id LEFT JOIN chunks u ON u.chunk_id = c.parent_id WHERE rank <= 5)"""


@query(
    f"""WITH RECURSIVE {_POOL.replace(" hits AS (SELECT qid, doc_id", " shits AS (SELECT qid, doc_id").replace("SELECT * FROM hits UNION", "SELECT * FROM shits UNION").replace("FROM hits h WHERE", "FROM shits h WHERE")}
    SELECT qid, string_agg('[' || chunk_id || '] section: ' || CASE WHEN section_path = '' THEN '-' ELSE section_path END || ', page: ' || page || chr(10) || context_text, chr(10) || chr(10) ORDER BY rank) AS context,
    'Found ' || count(*) || ' passages. Best: ' || left(arg_min(text, rank), 180) AS answer, array_to_string(list(chunk_id ORDER BY rank)[1:3], ',') AS cited, round(arg_min(score, rank), 3) AS confidence FROM hits GROUP BY 1"""
)
def chunk_answers(spark, sf):
    """From documents to answers: CK1-CK6 chunks, both indexes over them, ME8 sampled questions, FU3, RR1, DE4, RR3, TX15, JS4."""
    chunks = scratch.written(structure.chunk(structure.sections(_blocks(spark, sf))), "chunks")
    pool = chunks.select(F.col("chunk_id").alias("doc_id"), "text")
    asked = chunks.filter("not is_section").select(F.col("chunk_id").alias("qid"), T.eval_query(F.col("text")).alias("query")).filter("query is not null")
    queries = retrieval.encode(evaluation.sample_queries(asked, 50, 42), letter_encoder, "query")
    queries = scratch.written(queries, "queries")
    found = retrieval.retrieve(queries, retrieval.build_sparse(pool, written=True), retrieval.encode(pool, letter_encoder), pool)
    hits = retrieval.restore(found.withColumnRenamed("doc_id", "chunk_id").drop("sources"), chunks)
    jumped = structure.jump_to_parent(hits, chunks)
    context = answers.context_of(jumped.select("qid", "rank", "chunk_id", "section_path", "page", F.col("context_text").alias("text")))
    made = answers.template_answer(hits.select("qid", F.col("chunk_id").alias("doc_id"), "rank", "score", "text"), queries)
    made = made.select("qid", F.from_json("payload", answers.SCHEMA).alias("p"))
    return context.join(made, "qid").select("qid", "context", "p.answer", F.array_join("p.citations.chunk_id", ",").alias("cited"), "p.confidence")


# --- self-evaluation ---------------------------------------------------------------------------------------------

_CLAIMS = r"""answers AS (SELECT conv_id * 100 + turn AS qid, conv_id, turn, text AS answer FROM conversations WHERE role = 'assistant'),
    pieces AS (SELECT qid, conv_id, whole, list_filter(list_transform(string_split(regexp_replace(whole, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 20) AS p
        FROM (SELECT *, regexp_replace(coalesce(answer, ''), '^\s+|\s+$', '', 'g') AS whole FROM answers)),
    kept AS (SELECT qid, conv_id, (CASE WHEN len(p) > 0 THEN p WHEN length(whole) >= 20 THEN [whole] ELSE [] END)[1:8] AS c FROM pieces),
    claims AS (SELECT qid, conv_id, unnest(range(len(c))) AS claim_no, unnest(c) AS claim FROM kept)"""
def _answers(spark, sf) -> DataFrame:
    turns = _read(spark, sf, "conversations").filter("role = 'assistant'")
    return turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("qid"), "conv_id", "turn", F.col("text").alias("answer"))


@query(f"WITH {_CLAIMS} SELECT qid, claim_no, claim FROM claims")
def claims(spark, sf):
    """SE2, TX5, FL8."""
    return _answers(spark, sf).select("qid", F.posexplode(evaluation.claims(F.col("answer"))).alias("claim_no", "claim"))


#: Answers made of a document's own first sentences and of the next document's, in shares that go by its id; the evidence is the document in
#: windows, and every fifth question is the next document's.
_JUDGED = f"""s AS (SELECT doc_id, text, {_sentences("text")} AS p FROM documents),
    answers AS (SELECT a.doc_id AS qid, array_to_string(list_concat(a.p[1:(a.doc_id % 5)::INT], coalesce(b.p, [])[1:(4 - a.doc_id % 5)::INT]), ' ') AS answer,
        CASE WHEN a.doc_id % 5 = 2 THEN coalesce(b.p[1], '') ELSE a.p[1] END AS query, a.text FROM s a LEFT JOIN s b ON b.doc_id = a.doc_id + 1),
    evidence AS (SELECT qid, qid * 100000 + i AS doc_id, i + 1 AS rank, regexp_replace(substr(text, i * 520 + 1, 600), '^\\s+|\\s+$', '', 'g') AS text FROM (SELECT qid, text,
        unnest(range(least(6, CASE WHEN length(text) <= 600 THEN 1 ELSE ceil((length(text) - 600) / 520)::INT + 1 END))) AS i FROM answers)),
    pieces AS (SELECT qid, whole, list_filter(list_transform(string_split(regexp_replace(whole, '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) >= 20) AS p
        FROM (SELECT qid, regexp_replace(answer, '^\\s+|\\s+$', '', 'g') AS whole FROM answers)),
    kept AS (SELECT qid, (CASE WHEN len(p) > 0 THEN p WHEN length(whole) >= 20 THEN [whole] ELSE [] END)[1:8] AS c FROM pieces),
    claims AS (SELECT qid, unnest(range(len(c))) AS claim_no, unnest(c) AS claim FROM kept),
    shares AS MATERIALIZED (SELECT qid, claim_no, claim, doc_id, rank, text, {_overlap("claim", "left(text, 512)")} AS share FROM claims JOIN evidence USING (qid))"""
_BEST = """verdicts AS MATERIALIZED (SELECT qid, claim_no, claim, doc_id, left(text, 200) AS evidence, score, score >= 0.5 AS supported, score >= 0.5 AND score >= 0.35 AS grounded
    FROM scored QUALIFY row_number() OVER (PARTITION BY qid, claim_no ORDER BY raw DESC, rank) = 1)"""
_VERDICTS = f"{_JUDGED}, scored AS (SELECT *, 1 / (1 + exp(-raw)) AS score FROM (SELECT *, round(ln((share + 0.01) / (1.01 - share)), 9) AS raw FROM shares)), {_BEST}"
_ENTAILED = f"""{_JUDGED}, scored AS (SELECT *, raw AS score FROM (SELECT *, round(exp(2 * share - 1) / (exp(-share) + exp(0.2) + exp(2 * share - 1)), 9) AS raw FROM shares)), {_BEST}"""
_GATE = f"""gates AS MATERIALIZED (SELECT qid, coalesce(max(score) >= 0.3, true) AS relevant FROM (SELECT a.qid, round({_overlap("query", "left(e.text, 1024)")}, 9) AS score FROM answers a LEFT JOIN evidence e ON e.qid = a.qid) GROUP BY 1)"""


def _judged(spark, sf) -> tuple[DataFrame, DataFrame]:
    s = _read(spark, sf, "documents").select("doc_id", "text", T.sentences(F.col("text")).alias("p"))
    after = s.select((F.col("doc_id") - 1).alias("doc_id"), F.col("p").alias("q"))
    none = F.array().cast("array<string>")
    k = F.pmod("doc_id", F.lit(5)).cast("int")
    both = s.join(after, "doc_id", "left").withColumn("q", F.coalesce("q", none))
    answer = F.array_join(F.concat(F.when(k > 0, F.slice("p", F.lit(1), F.greatest(k, F.lit(1)))).otherwise(none), F.when(k < 4, F.slice("q", F.lit(1), F.greatest(4 - k, F.lit(1)))).otherwise(none)), " ")
    question = F.when(k == 2, F.coalesce(F.get("q", 0), F.lit(""))).otherwise(F.get("p", 0))
    said = both.select(F.col("doc_id").alias("qid"), answer.alias("answer"), question.alias("query"), "text")
    near = said.select("qid", F.posexplode(F.slice(T.windows(F.col("text")), 1, 6)).alias("i", "t"))
    near = near.select("qid", (F.col("qid") * 100000 + F.col("i")).alias("doc_id"), (F.col("i") + 1).alias("rank"), F.col("t").alias("text"))
    return said.drop("text"), near


@query(f"WITH {_VERDICTS} SELECT qid, claim_no, claim, doc_id, evidence, round(score, 6) AS score, supported, grounded FROM verdicts")
def judge_claims(spark, sf):
    """SE3, FL11 with log odds."""
    return evaluation.judge(*_judged(spark, sf)).withColumn("score", F.round("score", 6))


def _classes(claim: Column, text: Column) -> Column:
    """Class scores made of the overlap, standing in for a model's: against, neither, entailed."""
    share = evaluation.overlap_score(claim, text)
    return F.array(-share, F.lit(0.2), 2 * share - 1)


@query(f"WITH {_ENTAILED} SELECT qid, claim_no, claim, doc_id, evidence, round(score, 6) AS score, supported, grounded FROM verdicts")
def judge_entailment(spark, sf):
    """SE3, FL11 with three classes."""
    return evaluation.judge(*_judged(spark, sf), scorer=_classes, classes=True).withColumn("score", F.round("score", 6))


def _gates(said: DataFrame, near: DataFrame) -> DataFrame:
    met = said.select("qid", "query").join(near, "qid")
    cut = F.substring("text", 1, evaluation.RELEVANCE_CHARS)
    return evaluation.relevance(said, met.select("qid", F.round(evaluation.overlap_score(F.col("query"), cut), 9).alias("score")))


@query(f"WITH {_JUDGED}, {_GATE} SELECT * FROM gates")
def relevance_gate(spark, sf):
    """SE1, FL10."""
    return _gates(*_judged(spark, sf))


@query(
    f"""WITH {_VERDICTS}, {_GATE}, per AS (SELECT qid, count(*) AS n, count(*) FILTER (supported) AS supported, avg(CASE WHEN grounded THEN 1.0 ELSE 0.0 END) AS ratio, round(avg(score), 6) AS mean_score,
        coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY claim_no) FILTER (grounded), '') AS citations FROM verdicts GROUP BY 1)
    SELECT qid, relevant, coalesce(n, 0) AS n, coalesce(supported, 0) AS supported, round(coalesce(ratio, 0), 6)::DOUBLE AS ratio, mean_score, coalesce(citations, '') AS citations,
        CASE WHEN NOT relevant THEN 'irrelevant' WHEN coalesce(n, 0) = 0 THEN 'no_claims' WHEN ratio >= 0.8 THEN 'faithful' WHEN ratio >= 0.5 THEN 'partly_faithful' ELSE 'unfaithful' END AS summary
    FROM gates LEFT JOIN per USING (qid)"""
)
def self_eval_report(spark, sf):
    """SE4."""
    said, near = _judged(spark, sf)
    return evaluation.report(_gates(said, near), evaluation.judge(said, near))


@query(
    f"""WITH {_VERDICTS}, per AS (SELECT qid, count(*) AS n, count(*) FILTER (supported) AS supported, avg(CASE WHEN supported THEN 1.0::DOUBLE ELSE 0.0 END) AS ratio, avg(score) AS mean_score,
        string_agg(claim_no || ':' || doc_id || ':' || supported, ',' ORDER BY claim_no) AS verdicts FROM verdicts GROUP BY 1)
    SELECT qid, coalesce(n, 0) AS n, coalesce(supported, 0) AS supported, round(coalesce(ratio, 0), 6)::DOUBLE AS ratio, round(coalesce(mean_score, 0), 6) AS mean_score, coalesce(verdicts, '') AS verdicts FROM answers LEFT JOIN per USING (qid)"""
)
def faithfulness(spark, sf):
    """ME5."""
    said, near = _judged(spark, sf)
    found = evaluation.faithfulness(said, evaluation.judge(said, near))
    line = lambda v: F.concat_ws(":", v["claim_no"].cast("string"), v["doc_id"].cast("string"), v["supported"].cast("string"))
    verdicts = F.coalesce(F.array_join(F.transform("verdicts", line), ","), F.lit(""))
    return found.select("qid", "n", "supported", F.round("ratio", 6).alias("ratio"), F.round("mean_score", 6).alias("mean_score"), verdicts.alias("verdicts"))


# --- datasets ----------------------------------------------------------------------------------------------------

_QA = f"""parts AS (SELECT doc_id, {_sentences("text")} AS s FROM documents),
    qa AS (SELECT doc_id AS qid, 'Summarise: ' || s[1] AS question, '1. ' || s[1] || chr(10) || '2. ' || s[2] || chr(10) || '3. ' || s[3] || chr(10) || '[chunk_1]' AS answer FROM parts WHERE len(s) >= 3)"""


def _qa(spark, sf) -> DataFrame:
    parts = _read(spark, sf, "documents").select("doc_id", T.sentences(F.col("text")).alias("s")).filter(F.size("s") >= 3)
    s = lambda i: F.get("s", i)
    answer = F.concat(F.lit("1. "), s(0), F.lit("\n2. "), s(1), F.lit("\n3. "), s(2), F.lit("\n[chunk_1]"))
    return parts.select(F.col("doc_id").alias("qid"), F.concat(F.lit("Summarise: "), s(0)).alias("question"), answer.alias("answer"))


@query(
    """WITH m AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS messages FROM conversations GROUP BY 1)
    SELECT conv_id, array_to_string(list_transform(messages, lambda m: '<|im_start|>' || m.role || chr(10) || m.content || '<|im_end|>' || chr(10)), '') AS rendered FROM m"""
)
def chat_render(spark, sf):
    """TK1, DS5."""
    return _chats(spark, sf).select("conv_id", datasets.render_chat(F.col("messages")).alias("rendered"))


def _chats(spark, sf) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return _read(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(rows, lambda r: F.struct(r["role"].alias("role"), r["content"].alias("content"))).alias("messages"))


@query(
    """WITH t AS (SELECT conv_id, turn, role, length(role) + 13 AS head, length(role) + 13 + length(text) + 11 AS whole, text FROM conversations),
    o AS (SELECT *, coalesce(sum(whole) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM t)
    SELECT conv_id, (begun + head)::INT AS span_start, (begun + head + length(text))::INT AS span_end FROM o WHERE role = 'assistant'"""
)
def assistant_spans(spark, sf):
    """TK2."""
    text = _chats(spark, sf).select("conv_id", datasets.render_chat(F.col("messages")).alias("text"))
    spans = text.select("conv_id", F.explode(datasets.assistant_spans(F.col("text"))).alias("s"))
    return spans.select("conv_id", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))


def _offsets(text: Column) -> Column:
    """Offsets of ten characters each, standing in for a tokenizer's."""
    spots = lambda n: F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 10).cast("int")), lambda i: F.struct((i * 10).alias("start"), F.least(i * 10 + 10, n).alias("end")))
    return T.once(F.length(text), spots)


def _masked(spark, sf) -> DataFrame:
    text = _chats(spark, sf).select("conv_id", datasets.render_chat(F.col("messages")).alias("text"))
    rows = text.select("conv_id", _offsets(F.col("text")).alias("o"), datasets.assistant_spans(F.col("text")).alias("spans"))
    rows = rows.select("conv_id", "o", "spans", F.transform("o", lambda o: F.floor(o["start"] / 10).cast("int")).alias("input_ids"))
    return rows.select("conv_id", datasets.truncate(F.col("input_ids")).alias("input_ids"), datasets.truncate(datasets.label_mask(F.col("input_ids"), F.col("o"), F.col("spans"))).alias("labels"))


_MASK = """WITH t AS (SELECT conv_id, turn, role, length(role) + 13 AS head, length(role) + 13 + length(text) + 11 AS whole, text FROM conversations),
    o AS (SELECT *, coalesce(sum(whole) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM t),
    s AS (SELECT conv_id, list({'a': begun + head, 'b': begun + head + length(text)}) FILTER (role = 'assistant') AS spans, sum(whole) AS n FROM o GROUP BY 1),
    m AS (SELECT conv_id, list_transform(range(least((n + 9) // 10, 2048)::INT), lambda i: i::INT) AS ids, list_transform(range(least((n + 9) // 10, 2048)::INT), lambda i: CASE WHEN len(list_filter(coalesce(spans, []),
        lambda x: x.a <= (i * 10 + least(i * 10 + 10, n)) / 2 AND (i * 10 + least(i * 10 + 10, n)) / 2 <= x.b)) > 0 THEN i::INT ELSE -100 END) AS labels FROM s)"""


@query(f"{_MASK} SELECT conv_id, array_to_string(labels, ',') AS labels FROM m")
def label_mask(spark, sf):
    """TK3, TK4."""
    return _masked(spark, sf).select("conv_id", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"))


@query(
    f"""{_MASK}, w AS (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id // 8) AS longest FROM m), f AS (SELECT *, list_transform(range(longest - len(ids)), lambda i: 0) AS gap FROM w)
    SELECT conv_id, array_to_string(list_concat(ids, gap), ',') AS input_ids, array_to_string(list_concat(list_transform(ids, lambda x: 1), gap), ',') AS attention_mask,
    array_to_string(list_concat(labels, list_transform(gap, lambda x: -100)), ',') AS labels FROM f"""
)
def pad_batch(spark, sf):
    """TK6."""
    rows = _masked(spark, sf).withColumn("batch", F.floor(F.col("conv_id") / 8))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return datasets.pad_batches(rows, "batch").select("conv_id", text("input_ids"), text("attention_mask"), text("labels"))


@query(f"WITH {_QA} SELECT qid, regexp_replace(answer, '\\[chunk_[^\\]]+\\]', '', 'g') AS rejected FROM qa")
def pref_strip_citations(spark, sf):
    """DS8, TX10."""
    return _qa(spark, sf).select("qid", T.strip_citations(F.col("answer")).alias("rejected"))


@query(
    rf"""WITH {_QA}, parted AS (SELECT qid, answer, regexp_extract_all(answer, '\d+[\.、]\s*[^\n]+') AS f, string_split_regex(answer, '\d+[\.、]\s*[^\n]+') AS g FROM qa)
    SELECT qid, CASE WHEN len(f) >= 3 THEN array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce(list_append(f[2:], f[1])[i], '')), '') ELSE answer END AS rejected FROM parted"""
)
def pref_rotate(spark, sf):
    """DS7 as intended, TX12."""
    return _qa(spark, sf).select("qid", datasets.rotate_steps(F.col("answer")).alias("rejected"))


@query()
def pref_corrupt_numbers(spark, sf):
    """DS6, TX11."""
    docs = _read(spark, sf, "documents")
    return docs.select("doc_id", udfs.corrupt_numbers(F.col("text"), F.col("doc_id")).alias("rejected"))


@query()
def pref_pairs(spark, sf):
    """DS10, DS9, Q14, with all three kinds of negative; changed numbers are not SQL."""
    return datasets.preference_pairs(_qa(spark, sf), udfs.corrupt_numbers)


#: Chosen and rejected answers of the two kinds of negative that SQL can make.
_PAIRS = rf"""{_QA}, chosen AS (SELECT qid, question, CASE WHEN strpos(answer, '[chunk_') = 0 THEN answer || chr(10) || 'Cited: [chunk_1]' ELSE answer END AS chosen FROM qa),
    kinds AS (SELECT qid, unnest(list_transform(list_sort([{{'h': md5(qid || ':numbers'), 'k': 'numbers'}}, {{'h': md5(qid || ':citations'), 'k': 'citations'}}, {{'h': md5(qid || ':steps'), 'k': 'steps'}}])[1:2], lambda x: x.k)) AS kind FROM chosen),
    parted AS (SELECT *, regexp_extract_all(chosen, '\d+[\.、]\s*[^\n]+') AS f, string_split_regex(chosen, '\d+[\.、]\s*[^\n]+') AS g, regexp_replace(chosen, '\[chunk_[^\]]+\]', '', 'g') AS bare FROM chosen),
    pairs AS (SELECT qid, kind, question, chosen, CASE WHEN kind = 'steps' AND len(f) >= 3 AND turned != chosen THEN turned ELSE bare END AS rejected FROM (SELECT *,
        array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce(list_append(f[2:], f[1])[i], '')), '') AS turned FROM parted) JOIN kinds USING (qid) WHERE kind != 'numbers')"""


def _pairs(spark, sf) -> DataFrame:
    return datasets.preference_pairs(_qa(spark, sf), udfs.corrupt_numbers, mode="intended").filter("kind != 'numbers'")


@query(f"WITH {_PAIRS} SELECT * FROM pairs")
def pref_text_pairs(spark, sf):
    """DS7-DS10, TX12."""
    return _pairs(spark, sf)


_SOLID = """shown AS (SELECT doc_id, sec_pos, parent_pos, title, CASE WHEN parent_pos IS NULL THEN '' ELSE '  ' END || '### ' || title || chr(10) || text AS part, length(regexp_replace(text, '\\s', '', 'g')) > 0 AS solid FROM secs)"""


def _turn(role: str, body: str) -> str:
    return f"'<|im_start|>{role}' || chr(10) || {body} || '<|im_end|>' || chr(10)"


@query(
    f"""WITH {_PAIRS}, {_SECTIONS}, {_SOLID}, contexts AS (SELECT doc_id AS qid, left(string_agg(part, chr(10) || chr(10) ORDER BY sec_pos) FILTER (solid), 2000) AS context FROM shown GROUP BY 1)
    SELECT qid, {_turn("user", "'Text:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || question")} || '<|im_start|>assistant' || chr(10) AS prompt,
    {_turn("system", f"'{datasets.SYSTEM}'")} || {_turn("user", "question")} || {_turn("assistant", "chosen")} AS chosen,
    {_turn("system", f"'{datasets.SYSTEM}'")} || {_turn("user", "question")} || {_turn("assistant", "rejected")} AS rejected FROM pairs LEFT JOIN contexts USING (qid)"""
)
def pref_messages(spark, sf):
    """DS11, TK5."""
    contexts = datasets.focused_context(structure.sections(_blocks(spark, sf))).select(F.col("doc_id").alias("qid"), "context")
    rows = datasets.preference_messages(_pairs(spark, sf).join(contexts, "qid", "left"), F.coalesce("context", F.lit("")))
    return rows.select("qid", *(datasets.render_chat(F.col(c), prompt=c == "prompt").alias(c) for c in ("prompt", "chosen", "rejected")))


_KEPT = """tops AS (SELECT *, last_value(CASE WHEN parent_pos IS NULL THEN sec_pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY sec_pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM secs),
    counts AS (SELECT doc_id, top, count(*) FILTER (length(regexp_replace(text, '\\s', '', 'g')) > 0) AS k FROM tops GROUP BY 1, 2),
    earlier AS (SELECT doc_id, top, coalesce(sum(k) OVER (PARTITION BY doc_id ORDER BY top ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM counts),
    kept AS (SELECT t.doc_id, t.title, left(CASE WHEN parent_pos IS NULL THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') ELSE text END, 3000) AS text, row_number() OVER (PARTITION BY t.doc_id ORDER BY t.sec_pos) AS no
        FROM tops t JOIN earlier e ON e.doc_id = t.doc_id AND e.top = t.top WHERE before < 8 AND length(regexp_replace(text, '\\s', '', 'g')) > 0)"""


@query(
    f"""WITH {_SECTIONS}, {_KEPT}, {_SOLID},
    qa AS (SELECT doc_id, no, title AS focus, 'Summarise the section: ' || title AS question, '1. The section is about: ' || title || chr(10) || '2. It says: ' || array_to_string({_sentences("text")}[1:2], ' ')
        || chr(10) || '3. The conclusion follows from the context.' || chr(10) || 'Cited: [chunk_' || no || ']' AS answer FROM kept WHERE no <= 3),
    own AS (SELECT s.*, focus, strpos(title, focus) > 0 AS own FROM shown s JOIN (SELECT DISTINCT doc_id, focus FROM qa) USING (doc_id)),
    hit AS (SELECT o.*, o.own OR EXISTS (SELECT 1 FROM own c WHERE c.doc_id = o.doc_id AND c.focus = o.focus AND c.parent_pos = o.sec_pos AND c.own) AS hit FROM own o),
    seen AS (SELECT h.*, h.hit AND coalesce(u.hit, true) AS visible FROM hit h LEFT JOIN hit u ON u.doc_id = h.doc_id AND u.focus = h.focus AND u.sec_pos = h.parent_pos),
    contexts AS (SELECT doc_id, focus, left(coalesce(string_agg(part, chr(10) || chr(10) ORDER BY sec_pos) FILTER (solid AND visible), string_agg(part, chr(10) || chr(10) ORDER BY sec_pos) FILTER (solid), ''), 2000) AS context FROM seen GROUP BY 1, 2)
    SELECT doc_id, no, {_turn("system", f"'{datasets.SYSTEM}'")} || {_turn("user", "'Text:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || question")} || {_turn("assistant", "answer")} AS rendered FROM qa JOIN contexts USING (doc_id, focus)"""
)
def sft_messages(spark, sf):
    """DS1, DS3, DS4, DS5, LY8."""
    secs = structure.sections(_blocks(spark, sf))
    qa = datasets.template_qa(datasets.section_blocks(secs))
    contexts = datasets.focused_context(secs, qa.select("doc_id", F.col("section_title").alias("focus")).distinct())
    return datasets.sft_messages(qa, contexts).select("doc_id", "no", datasets.render_chat(F.col("messages")).alias("rendered"))


@query(
    f"""WITH {_SECTIONS}, solid AS (SELECT doc_id, sec_pos, title, left(CASE WHEN parent_pos IS NULL THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') ELSE text END, 3000) AS text FROM secs WHERE length(regexp_replace(text, '\\s', '', 'g')) > 0),
    tops AS (SELECT *, last_value(CASE WHEN parent_pos IS NULL THEN sec_pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY sec_pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM secs),
    counts AS (SELECT doc_id, top, count(*) FILTER (length(regexp_replace(text, '\\s', '', 'g')) > 0) AS k FROM tops GROUP BY 1, 2),
    earlier AS (SELECT doc_id, top, coalesce(sum(k) OVER (PARTITION BY doc_id ORDER BY top ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM counts),
    kept AS (SELECT s.*, row_number() OVER (PARTITION BY s.doc_id ORDER BY s.sec_pos) AS no FROM solid s JOIN tops t ON s.doc_id = t.doc_id AND s.sec_pos = t.sec_pos JOIN earlier e ON e.doc_id = t.doc_id AND e.top = t.top WHERE before < 6)
    SELECT doc_id, left(string_agg('[' || no || '] (' || title || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY no), 12000) AS prompt FROM kept GROUP BY 1"""
)
def qa_prompts(spark, sf):
    """DS2's prompt of six sections, LY8."""
    return datasets.qa_prompt(datasets.section_blocks(structure.sections(_blocks(spark, sf)), datasets.PROMPT_SECTIONS))


@query(
    f"""WITH {_SECTIONS}, short AS (SELECT doc_id FROM documents WHERE length(text) < 200), tops AS (SELECT doc_id, sec_pos, title, text, row_number() OVER (PARTITION BY doc_id ORDER BY sec_pos) AS no FROM secs WHERE length(regexp_replace(text, '\\s', '', 'g')) > 0 AND doc_id NOT IN (FROM short))
    SELECT doc_id, count(*) AS rows, NULL AS error FROM tops WHERE no <= 3 GROUP BY 1 UNION ALL SELECT doc_id, 0, 'too short' FROM short"""
)
def dataset_errors(spark, sf):
    """DS12: documents that fail give their error and no rows; the others are not touched by them."""
    docs = _read(spark, sf, "documents").select("doc_id", "text")
    failed = F.when(F.length("text") < 200, F.lit("too short"))
    build = lambda kept: datasets.template_qa(datasets.section_blocks(structure.sections(structure.merge_paragraphs(structure.classify(_spans(kept))))))
    rows, errors = datasets.per_document(docs, build, failed=failed)
    made = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.lit(None).cast("string").alias("error"))
    return made.unionByName(errors.select("doc_id", F.lit(0).cast("long").alias("rows"), "error"))


@query(
    """WITH h AS (SELECT string_agg(t, chr(10) ORDER BY doc_id) AS t FROM (SELECT doc_id, left(text, 2000) AS t FROM documents ORDER BY doc_id LIMIT 30))
    SELECT no, substr(t, no * 512 + 1, 512) AS text FROM (SELECT t, unnest(range(least(128, ceil(length(t) / 512)::INT)))::INT AS no FROM h)"""
)
def calibration_samples(spark, sf):
    """MX4: windows of 512 without overlap, the first 128."""
    return datasets.calibration_samples(_read(spark, sf, "documents"))


@query("SELECT event_id AS id, row_number() OVER (ORDER BY ts DESC, event_id) AS newest FROM events WHERE list_has_any([event_type, 'user' || user_id % 7], ['error', 'user3'])")
def category_search(spark, sf):
    """IO3, FL9: records that share a category with what is asked for; the events stand in for records."""
    categories = F.array("event_type", F.concat(F.lit("user"), (F.col("user_id") % 7).cast("string")))
    records = _read(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("published"), categories.alias("categories"))
    found = io.in_categories(records, ["error", "user3"])
    return found.select("id", F.row_number().over(Window.orderBy(F.desc("published"), "id")).alias("newest"))


# --- vocabulary --------------------------------------------------------------------------------------------------

_FREQ = rf"""lines AS ({_LINES}), freq AS (SELECT token, count(*) AS freq FROM (SELECT unnest(regexp_split_to_array(line, '\s+')) AS token FROM lines) WHERE token != '' GROUP BY 1),
    base AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '\s+')) AS token FROM benchmark)"""


@query(f"WITH {_FREQ} SELECT * FROM freq")
def token_freq(spark, sf):
    """VO2 on cleaned lines (IO12, FL5)."""
    return vocab.token_counts(quality.corpus_lines(_read(spark, sf, "documents")))


@query(
    f"""WITH {_FREQ} SELECT token, freq, freq * (ceil(length(token) / 4)::INT - 1) AS gain FROM freq WHERE freq >= 5 AND token NOT IN (SELECT token FROM base) AND length(token) >= 2
    AND regexp_matches(token, '[A-Za-z]') AND length(regexp_replace(token, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / length(token) >= 0.5 AND ceil(length(token) / 4) - 1 >= 1 ORDER BY gain DESC, token LIMIT 2000"""
)
def vocab_gain_topn(spark, sf):
    """VO3, VO4, FL6: the base vocabulary is that of the benchmark's words."""
    return vocab.select_tokens(_read(spark, sf, "documents"), vocab.token_counts(_read(spark, sf, "benchmark"), "text").select("token"))


@query(
    f"""WITH {_FREQ}, top AS (SELECT token, freq * (ceil(length(token) / 4)::INT - 1) AS gain FROM freq WHERE freq >= 5 AND token NOT IN (SELECT token FROM base) AND length(token) >= 2
    AND regexp_matches(token, '[A-Za-z]') AND length(regexp_replace(token, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / length(token) >= 0.5 AND ceil(length(token) / 4) - 1 >= 1 ORDER BY gain DESC, token LIMIT 100)
    SELECT row_number() OVER (ORDER BY length(token) DESC, token) AS position, token FROM top"""
)
def vocab_extension(spark, sf):
    """VO5, VO4, DD3: from documents to the tokens that extend a vocabulary, in the order in which they are added."""
    base = vocab.token_counts(_read(spark, sf, "benchmark"), "text").select("token")
    return vocab.extension(_read(spark, sf, "documents"), base, top_n=100)


# --- answers -----------------------------------------------------------------------------------------------------


@query("SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1")
def last_user_message(spark, sf):
    """JS7."""
    return answers.last_user_message(_read(spark, sf, "conversations"))


@query("SELECT conv_id, turn, text AS decoded FROM conversations")
def sse_decode(spark, sf):
    """JS6: what was encoded comes back."""
    stream = answers.encode_events(F.transform(F.split("text", " ", -1), lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.lit(" "), w))))
    return _read(spark, sf, "conversations").select("conv_id", "turn", answers.decode_events(stream).alias("decoded"))


@query(
    f"""WITH {_EVAL}, {_POSTINGS}, {_SPARSE}, top AS (SELECT qid, doc_id, rank, score, text FROM sparse JOIN documents USING (doc_id) WHERE rank <= 5)
    SELECT qid, 'Found ' || count(*) || ' passages. Best: ' || left(arg_min(text, rank), 180) AS answer, array_to_string(list(doc_id ORDER BY rank)[1:3], ',') AS cited, round(arg_min(score, rank), 3) AS confidence FROM top GROUP BY 1"""
)
def mock_answer(spark, sf):
    """JS4."""
    docs = _read(spark, sf, "documents")
    found = retrieval.search_sparse(_queries(docs), retrieval.build_sparse(docs, written=True), 5).join(_heads(docs), "doc_id")
    made = answers.template_answer(found).withColumn("p", F.from_json("payload", answers.SCHEMA))
    return made.select("qid", "p.answer", F.array_join("p.citations.chunk_id", ",").alias("cited"), "p.confidence")


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE text || CASE WHEN turn % 4 = 3 THEN ' {\"}' ELSE '' END END AS answer, CASE WHEN turn % 4 IN (0, 3) THEN turn END AS n FROM conversations")
def extract_json(spark, sf):
    """JS1: an object in noise, an invalid first object, none at all, and braces and quotes inside a string."""
    kind = F.col("turn") % 4
    inside = F.concat("text", F.when(kind == 3, F.lit(' {"}')).otherwise(F.lit("")))
    whole = F.to_json(F.struct(inside.alias("answer"), F.col("turn").alias("n")))
    noisy = F.when(kind == 1, F.concat(F.lit("{no json} "), whole)).when(kind == 2, F.concat(F.lit("none: "), F.translate("text", "{}", ""))).otherwise(F.concat(F.lit("Sure: "), whole, F.lit(" done}")))
    found = _read(spark, sf, "conversations").select("conv_id", "turn", F.from_json(udfs.extract_json(noisy), "answer string, n bigint").alias("o"))
    return found.select("conv_id", "turn", "o.answer", "o.n")


@query(
    """SELECT conv_id, turn, k IN (0) AS valid, k IN (0, 2, 3, 4) AS has_keys, CASE k WHEN 1 THEN 'is_grounded' WHEN 5 THEN 'answer,citations,confidence,is_grounded,reasoning' ELSE '' END AS missing,
    CASE k WHEN 2 THEN 'mood' ELSE '' END AS extra FROM (SELECT *, (conv_id + turn) % 6 AS k FROM conversations)"""
)
def validate_answer(spark, sf):
    """JS2, JS3: a whole answer, one without a key, with one too many, with a citation without an id, with a wrong type, and no JSON."""
    k = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6))
    cited = F.array(F.struct(F.when(k != 3, F.lit("c1")).alias("chunk_id"), F.lit(0.5).alias("confidence")))
    fields = [F.col("text").alias("answer"), F.lit("why").alias("reasoning"), cited.alias("citations"), F.when(k == 4, "high").otherwise("0.5").alias("confidence")]
    whole = F.to_json(F.struct(*fields, F.when(k != 1, F.lit(True)).alias("is_grounded"), F.when(k == 2, F.lit("glad")).alias("mood")))
    # the confidence is a number but for the wrong type
    made = F.when(k == 5, F.translate("text", "{}", "")).when(k == 4, whole).otherwise(F.replace(whole, F.lit('"confidence":"0.5"'), F.lit('"confidence":0.5')))
    turns = _read(spark, sf, "conversations").select("conv_id", "turn", made.alias("p"))
    names = lambda c: F.array_join(c, ",")
    p = F.col("p")
    return turns.select("conv_id", "turn", answers.is_valid(p).alias("valid"), answers.is_valid(p, full=False).alias("has_keys"), names(answers.missing_keys(p)).alias("missing"), names(answers.extra_keys(p)).alias("extra"))


@query(
    """SELECT conv_id, turn, 'chat.completion' AS object, text AS answer, turn % 2 = 0 AS grounded, CASE WHEN turn % 2 = 0 THEN NULL ELSE 'the model''s output is no JSON object' END AS warning FROM conversations"""
)
def response_envelope(spark, sf):
    """JS5: a payload as it is, and text that is no JSON as an ungrounded answer with a warning."""
    payload = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.col("text").alias("answer"), F.lit(True).alias("is_grounded")))).otherwise(F.col("text"))
    kind = "object string, warning string, choices array<struct<message:struct<content:string>>>"
    made = _read(spark, sf, "conversations").select("conv_id", "turn", F.from_json(answers.envelope(payload), kind).alias("e"))
    content = F.from_json(F.get("e.choices", 0)["message"]["content"], "answer string, is_grounded boolean")
    return made.select("conv_id", "turn", "e.object", content["answer"].alias("answer"), content["is_grounded"].alias("grounded"), "e.warning")


@query("SELECT event_id, json_extract_string(props, '$.' || list_extract(json_keys(props), 1)) AS first_value FROM events")
def json_props(spark, sf):
    """JS2's key functions on event properties."""
    events = _read(spark, sf, "events")
    key = F.get(F.json_object_keys("props"), 0)
    return events.select("event_id", F.try_element_at(F.from_json("props", "map<string,string>"), key).alias("first_value"))
