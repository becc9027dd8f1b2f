"""Instruction, preference and loss-masked training rows (DS, TK)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

SYSTEM = "Answer from the given text only, and cite the passages that you use."
START, END, ROLE = "<|im_start|>", "<|im_end|>", "assistant"
IGNORED = -100


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def template_qa(blocks: DataFrame, num: int = 3) -> DataFrame:
    """Question and answer per section of ``blocks(doc_id, no, title, text)``, the first ``num`` of a document (DS1)."""
    core = F.array_join(F.slice(T.sentences(F.col("text")), 1, 2), " ")
    answer = F.concat(
        F.lit("1. The section is about: "), "title", F.lit("\n2. It says: "), core, F.lit("\n3. The conclusion follows from the context.\nCited: [chunk_"), F.col("no").cast("string"), F.lit("]")
    )
    question = F.concat(F.lit("Summarise the section: "), F.col("title"))
    return blocks.filter(F.col("no") <= num).select("doc_id", "no", F.col("title").alias("section_title"), question.alias("question"), answer.alias("answer"))


#: Sections that a template answers from, and that a prompt to an outside model shows.
TEMPLATE_SECTIONS, PROMPT_SECTIONS = 8, 6


def qa_prompt(blocks: DataFrame, chars: int = 12_000) -> DataFrame:
    """``(doc_id, prompt)``: a document's sections, numbered, as the text to ask an outside model about (DS2).

    ``blocks`` are ``section_blocks`` up to PROMPT_SECTIONS. The answer of such a model, where there is none, falls back to ``template_qa``.
    """
    part = F.struct("no", F.concat(F.lit("["), F.col("no").cast("string"), F.lit("] ("), "title", F.lit(")\n"), "text").alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["t"]), "\n\n")
    return blocks.groupBy("doc_id").agg(F.substring(joined, 1, chars).alias("prompt"))


def section_blocks(secs: DataFrame, limit: int = TEMPLATE_SECTIONS, chars: int = 3000) -> DataFrame:
    """Non-blank sections of two levels in order; a document stops after the top section that reaches ``limit`` (LY8)."""
    order = Window.partitionBy("doc_id").orderBy("sec_pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    tops = secs.withColumn("top", F.last(F.when(F.col("parent_pos").isNull(), F.col("sec_pos")), ignorenulls=True).over(upto))
    tops = tops.filter(F.col("parent_pos").isNull() | (F.col("parent_pos") == F.col("top")))
    full = tops.withColumn("has", (F.length(T.strip(F.col("text"))) > 0).cast("int"))
    per = Window.partitionBy("doc_id").orderBy("top").rangeBetween(Window.unboundedPreceding, -1)
    kept = full.withColumn("before", F.coalesce(F.sum("has").over(per), F.lit(0))).filter((F.col("before") < limit) & (F.col("has") == 1))
    text = F.when(F.col("parent_pos").isNull(), T.strip(F.col("text"))).otherwise(F.col("text"))  # a top section's text is stripped before the cut
    return kept.select("doc_id", F.row_number().over(order).alias("no"), "title", F.substring(text, 1, chars).alias("text"))


def _below(secs: DataFrame, levels: int) -> DataFrame:
    """``(doc_id, sec_pos, top, hop)``: every section with itself and each section above it."""
    up = secs.select("doc_id", F.col("sec_pos").alias("top"), "parent_pos")
    reach = secs.select("doc_id", "sec_pos", F.col("sec_pos").alias("top"), F.lit(0).alias("hop"))
    out = reach
    for hop in range(1, levels):
        reach = reach.join(up, ["doc_id", "top"]).filter("parent_pos is not null").select("doc_id", "sec_pos", F.col("parent_pos").alias("top"), F.lit(hop).alias("hop"))
        out = out.unionByName(reach)
    return out


def focused_context(secs: DataFrame, focus: DataFrame | None = None, chars: int = 2000, levels: int = 2) -> DataFrame:
    """``(doc_id, focus, context)``: sections whose own or a descendant's title holds the focus and whose ancestors
    all do so too, else all of them (DS3, DS4); without a ``focus`` all of them. ``levels`` is how deep sections nest."""
    focus = secs.select("doc_id").distinct().withColumn("focus", F.lit(None).cast("string")) if focus is None else focus
    own = secs.join(focus, "doc_id").withColumn("own", F.coalesce(F.instr("title", F.col("focus")) > 0, F.lit(True)))
    chain = _below(secs, levels)
    hit = own.select("doc_id", "focus", "sec_pos", "own").join(chain, ["doc_id", "sec_pos"]).groupBy("doc_id", "focus", F.col("top").alias("sec_pos")).agg(F.max("own").alias("hit"))
    above = chain.join(hit.select("doc_id", "focus", F.col("sec_pos").alias("top"), "hit"), ["doc_id", "top"])
    seen = above.groupBy("doc_id", "focus", "sec_pos").agg(F.min("hit").alias("show"), F.max("hop").alias("depth"))
    full = own.join(seen.withColumnRenamed("focus", "f"), (own["doc_id"] == seen["doc_id"]) & own["focus"].eqNullSafe(F.col("f")) & (own["sec_pos"] == seen["sec_pos"]))
    full = full.select(own["doc_id"], own["focus"], own["sec_pos"], "title", "text", "show", "depth")
    part = F.struct("sec_pos", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("### "), "title", F.lit("\n"), "text").alias("t"))
    solid = F.length(T.strip(F.col("text"))) > 0
    parts = full.groupBy("doc_id", "focus").agg(
        F.array_sort(F.collect_list(F.when(solid & F.col("show"), part))).alias("some"), F.array_sort(F.collect_list(F.when(solid, part))).alias("whole")
    )
    rows = F.when(F.size("some") > 0, F.col("some")).otherwise(F.col("whole"))
    return parts.select("doc_id", "focus", F.substring(F.array_join(F.transform(rows, lambda r: r["t"]), "\n\n"), 1, chars).alias("context"))


def sft_messages(qa: DataFrame, contexts: DataFrame) -> DataFrame:
    """``(doc_id, no, messages)``: system, user with context, assistant (DS5)."""
    full = qa.join(contexts.withColumnRenamed("focus", "section_title"), ["doc_id", "section_title"])
    user = F.concat(F.lit("Text:\n"), "context", F.lit("\n\nQuestion: "), "question")
    return full.select("doc_id", "no", F.array(message("system", F.lit(SYSTEM)), message("user", user), message(ROLE, F.col("answer"))).alias("messages"))


def grounded(answer: Column) -> Column:
    """An answer with a citation added if it has none (DS9)."""
    return F.when(F.instr(answer, "[chunk_") == 0, F.concat(answer, F.lit("\nCited: [chunk_1]"))).otherwise(answer)


def rotate_steps(c: Column) -> Column:
    """Numbered steps moved on by one, from three steps on (DS7 as intended)."""
    found = T.steps(c)
    turned = F.concat(F.slice(found, F.lit(2), F.size(found)), F.slice(found, 1, 1))
    # every step is replaced in place: the text between the steps stays
    gaps = F.split(F.regexp_replace(c, F.lit(T.U + T.STEP), F.lit("\u0001")), "\u0001", -1)
    pieces = F.zip_with(gaps, turned, lambda g, s: F.concat(g, F.coalesce(s, F.lit(""))))
    return F.when(F.size(found) >= 3, F.array_join(pieces, "")).otherwise(c)


def preference_pairs(qa: DataFrame, corrupt, num: int = 2, mode: str = "reference") -> DataFrame:
    """``num`` of three kinds of negative per question, in hash order; an unchanged one falls back to stripping (DS10).

    ``corrupt(text, seed)`` is the number-changing expression. In ``reference`` mode rotated steps count as unchanged.
    """
    asked = qa.filter(F.coalesce("question", F.lit("")) != "").withColumn("chosen", grounded(F.coalesce("answer", F.lit(""))))
    kinds = F.explode(F.slice(F.array_sort(F.transform(F.array(*map(F.lit, ("numbers", "citations", "steps"))), lambda k: F.struct(F.md5(F.concat(F.col("qid").cast("string"), F.lit(":"), k)).alias("h"), k.alias("kind")))), 1, num))
    each = asked.select("qid", "question", "chosen", kinds.alias("k")).select("qid", "question", "chosen", "k.kind")
    turned = rotate_steps(F.col("chosen")) if mode == "intended" else F.col("chosen")
    bare = T.strip_citations(F.col("chosen"))
    changed = each.filter("kind = 'numbers'").withColumn("made", corrupt(F.col("chosen"), F.col("qid")))
    other = each.filter("kind != 'numbers'").withColumn("made", F.when(F.col("kind") == "steps", turned).otherwise(bare))
    pairs = changed.unionByName(other)
    rejected = F.when(T.strip(F.col("made")) == T.strip(F.col("chosen")), bare).otherwise(F.col("made"))
    return pairs.select("qid", "kind", "question", "chosen", rejected.alias("rejected"))


def preference_messages(pairs: DataFrame, context: Column) -> DataFrame:
    """Message lists; only the prompt carries the context, which is that of the whole document (DS11)."""
    asked = F.concat(F.lit("Text:\n"), context, F.lit("\n\nQuestion: "), F.col("question"))
    turn = lambda c: F.array(message("system", F.lit(SYSTEM)), message("user", F.col("question")), message(ROLE, c))
    return pairs.select("qid", F.array(message("user", asked)).alias("prompt"), turn(F.col("chosen")).alias("chosen"), turn(F.col("rejected")).alias("rejected"))


def render_chat(messages: Column, prompt: bool = False) -> Column:
    """Messages between start and end markers; ``prompt`` opens an assistant turn at the end (TK1, TK5)."""
    parts = F.transform(messages, lambda m: F.concat(F.lit(START), m["role"], F.lit("\n"), m["content"], F.lit(f"{END}\n")))
    text = F.array_join(parts, "")
    return F.concat(text, F.lit(f"{START}{ROLE}\n")) if prompt else text


def assistant_spans(text: Column) -> Column:
    """Array of ``(start, end)`` of assistant contents (TK2).

    A span goes from a start marker and the line break behind it to the next end marker, whatever lies between; the search
    goes on behind that, and stops for good at a span without an end.
    """
    kind = "array<struct<start:int,end:int>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans"))

    def walk(whole: Column) -> Column:
        find = lambda marker, at: F.position(F.lit(marker), whole, at + 1) - 1
        # one step per start marker; a step behind the last span finds nothing and changes nothing
        steps = F.size(F.split(whole, r"\Q" + START + ROLE + r"\E", -1)) - 1

        def step(acc: Column, _: Column) -> Column:
            start = find(START + ROLE, F.greatest(acc["at"], F.lit(0)))
            body = start + len(START + ROLE)
            body = body + F.when(F.substr(whole, body + 1, F.lit(1)) == "\n", 1).otherwise(0)
            stop = find(END, body)
            span = F.struct(body.cast("int").alias("start"), stop.cast("int").alias("end"))
            found = (acc["at"] >= 0) & (start >= 0) & (stop >= 0)
            return F.struct(
                F.when(found, stop + len(END)).otherwise(F.lit(-1)).cast("int").alias("at"),
                F.when(found, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
            )

        turns = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(turns, zero, step, lambda acc: acc["spans"])

    return T.once(text, walk)


def label_mask(ids: Column, offsets: Column, spans: Column) -> Column:
    """Ids whose midpoint lies in a span, ends included; others, and empty offsets, are ``IGNORED`` (TK3)."""
    def keep(i: Column, o: Column, bound: Column) -> Column:
        mid = (o["start"] + o["end"]) / 2
        inside = F.exists(bound, lambda s: (s["start"] <= mid) & (mid <= s["end"]))
        return F.when(inside & ~((o["start"] == 0) & (o["end"] == 0)), i).otherwise(F.lit(IGNORED))

    return T.once(spans, lambda bound: F.zip_with(ids, offsets, lambda i, o: keep(i, o, bound)))


def truncate(c: Column, n: int = 2048) -> Column:
    return F.slice(c, 1, n)


def pad_batches(rows: DataFrame, batch: str, pad_id: int = 0) -> DataFrame:
    """Ids, mask and labels filled up to the longest row of their batch (TK6)."""
    longest = F.max(F.size("input_ids")).over(Window.partitionBy(batch))
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), F.col("longest") - F.size("input_ids")))
    ones = F.transform("input_ids", lambda _: F.lit(1))
    padded = rows.withColumn("longest", longest)
    return padded.withColumns({"attention_mask": fill(ones, 0), "labels": fill(F.col("labels"), IGNORED), "input_ids": fill(F.col("input_ids"), pad_id)}).drop("longest")


def per_document(ids: DataFrame, build: Callable[[DataFrame], DataFrame], id_col: str = "doc_id", limit: int | None = None, failed: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``build`` on the first ``limit`` documents by id (all without one) that are not ``failed``, and the ids and errors of those that are (DS12).

    A document whose parse failed has an error in place of content; it costs its own rows and no others.
    """
    taken = ids if limit is None else ids.orderBy(id_col).limit(limit)
    error = F.lit(None).cast("string") if failed is None else failed
    return build(taken.filter(error.isNull())), taken.filter(error.isNotNull()).select(id_col, error.alias("error"))


def calibration_samples(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", files: int = 30, head: int = 2000, width: int = 512, samples: int = 128) -> DataFrame:
    """``(no, text)``: windows without overlap over the joined heads of the first files, the first ``samples`` of them (MX4)."""
    first = texts.select(F.col(id_col).alias("k"), F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, head).alias("t")).orderBy("k").limit(files)
    rows = F.array_sort(F.collect_list(F.struct("k", "t")))  # at most ``files`` heads
    joined = first.agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n").alias("t"))
    n = F.least(F.ceil(F.length("t") / width).cast("int"), F.lit(samples))
    spots = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return joined.select("t", F.explode(spots).alias("no")).select("no", F.substr(F.col("t"), F.col("no") * width + 1, F.lit(width)).alias("text"))
