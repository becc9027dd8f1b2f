"""Structured answers: parsing, validation, template answers and event streams (JS)."""

from __future__ import annotations

import json as json_library

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

#: The fields of an answer.
SCHEMA = "answer string, reasoning string, citations array<struct<chunk_id:string,confidence:double>>, confidence double, is_grounded boolean"
REQUIRED = ("answer", "reasoning", "citations", "confidence", "is_grounded")

#: Characters of the best text that a template answer shows.
BEST_CHARS = 180


def schema_of(text: str) -> tuple[str, tuple[str, ...]]:
    """The columns and the required keys that a JSON schema names (JS3)."""
    names = {"string": "string", "number": "double", "integer": "bigint", "boolean": "boolean"}

    def kind(node: dict) -> str:
        if node.get("type") == "array":
            return f"array<{kind(node.get('items', {'type': 'string'}))}>"
        if node.get("type") == "object":
            return "struct<" + ",".join(f"`{k}`:{kind(v)}" for k, v in node.get("properties", {}).items()) + ">"
        return names.get(node.get("type", "string"), "string")

    schema = json_library.loads(text)
    return ", ".join(f"`{k}` {kind(v)}" for k, v in schema["properties"].items()), tuple(schema.get("required", ()))


def missing_keys(json: Column, required: tuple[str, ...] = REQUIRED) -> Column:
    """Required keys that an object lacks, sorted; all of them where it does not parse (JS2)."""
    need = F.array(*map(F.lit, required))
    return F.array_sort(F.array_except(need, F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))))


def extra_keys(json: Column, known: tuple[str, ...] = REQUIRED) -> Column:
    return F.array_sort(F.array_except(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), F.array(*map(F.lit, known))))


def is_valid(json: Column, full: bool = True) -> Column:
    """All required keys; in full, no other ones, every citation with an id, and values of the declared types."""
    ok = json.isNotNull() & (F.size(missing_keys(json)) == 0)
    if not full:
        return ok
    parsed = F.from_json(json, SCHEMA)
    cited = F.coalesce(F.forall(parsed["citations"], lambda c: c["chunk_id"].isNotNull()), F.lit(False))
    typed = F.forall(F.array(*(parsed[k].isNotNull() for k in REQUIRED)), lambda present: present)
    return F.coalesce(ok & (F.size(extra_keys(json)) == 0) & cited & typed, F.lit(False))


def template_answer(hits: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """``(qid, payload)`` from ``hits(qid, doc_id, rank, score, text)``: the first text, three citations (JS4).

    With ``queries(qid)`` those without a hit get an answer that says so, without citations and not grounded.
    """
    rows = F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("chunk_id"), F.round("score", 3).alias("confidence"), F.substring("text", 1, BEST_CHARS).alias("text"))))
    per = hits.groupBy("qid").agg(rows.alias("r"))
    if queries is not None:
        per = queries.select("qid").join(per, "qid", "left")
    top, n = F.get("r", 0), F.coalesce(F.size("r"), F.lit(0))
    found = F.when(top.isNotNull(), F.concat(F.lit(" passages. Best: "), top["text"])).otherwise(F.lit(" passages. Nothing relevant was found."))
    cited = F.transform(F.slice("r", 1, 3), lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["confidence"].alias("confidence")))
    payload = F.struct(
        F.concat(F.lit("Found "), F.greatest(n, F.lit(0)).cast("string"), found).alias("answer"),
        F.lit("ranked passages").alias("reasoning"),
        F.coalesce(cited, F.array().cast("array<struct<chunk_id:string,confidence:double>>")).alias("citations"),
        F.coalesce(top["confidence"], F.lit(0.0)).alias("confidence"),
        top.isNotNull().alias("is_grounded"),
    )
    return per.select("qid", F.to_json(payload).alias("payload"))


def envelope(payload: Column) -> Column:
    """The response object around a payload; text that is no JSON object becomes an ungrounded answer with a warning (JS5)."""
    ok = F.json_object_keys(payload).isNotNull()
    bad = F.to_json(F.struct(payload.alias("answer"), F.lit("").alias("reasoning"), F.array().cast("array<string>").alias("citations"), F.lit(0.0).alias("confidence"), F.lit(False).alias("is_grounded")))
    message = F.struct(F.lit("assistant").alias("role"), F.when(ok, payload).otherwise(bad).alias("content"))
    return F.to_json(
        F.struct(
            F.lit("chatcmpl").alias("id"), F.lit("chat.completion").alias("object"), F.array(F.struct(F.lit(0).alias("index"), message.alias("message"))).alias("choices"),
            F.when(~ok, F.lit("the model's output is no JSON object")).alias("warning"),
        )
    )


def context_of(hits: DataFrame) -> DataFrame:
    """``(qid, context)`` from ``hits(qid, rank, chunk_id, section_path, page, text)``: a block per hit in order, a blank line between (TX15)."""
    block = T.context(F.col("chunk_id"), F.col("section_path"), F.col("page"), F.col("text"))
    rows = F.array_sort(F.collect_list(F.struct("rank", block.alias("t"))))
    return hits.groupBy("qid").agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n\n").alias("context"))


def encode_events(tokens: Column) -> Column:
    """``data:`` frames of an array of tokens, ended by ``[DONE]`` (JS6)."""
    frames = F.transform(tokens, lambda t: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(t.alias("content")).alias("delta"))).alias("choices"))), F.lit("\n\n")))
    return F.concat(F.array_join(frames, ""), F.lit("data: [DONE]\n\n"))


def decode_events(stream: Column) -> Column:
    """The text of a stream of frames, up to ``[DONE]``."""
    body = F.split_part(stream, F.lit("data: [DONE]"), F.lit(1))
    frames = F.regexp_extract_all(body, F.lit("data: ([^\n]*)"), F.lit(1))
    return F.array_join(F.transform(frames, lambda f: F.coalesce(F.get_json_object(f, "$.choices[0].delta.content"), F.lit(""))), "")


def last_user_message(turns: DataFrame) -> DataFrame:
    """The last user turn of each conversation (JS7)."""
    return turns.filter(F.col("role") == "user").groupBy("conv_id").agg(F.max_by("text", F.struct("turn", "text")).alias("text"))
