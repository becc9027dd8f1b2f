"""Benchmark decontamination with spaced seeds (operator 6, DataFrame operations only).

Tokens are maximal runs of letters and digits, lower-cased. ``MASKS`` are fixed patterns of SPAN tokens that
ignore some positions; each mask hashes the kept tokens at every position of an item and of a document.
Equal hashes give a diagonal (document position minus item position), on which all of the item's tokens are
compared one by one. A document is contaminated by an item if at least ``MIN_SHARE`` of the item's tokens, or of
some ``WINDOW`` of them in a row, are the same on the diagonal. Every arrangement of up to 20 % substitutions in 8 or more
tokens is hit: ``SHORT_MASK`` helps where an item has 8 to 10 of them, and a test enumerates the arrangements.
Items of MIN_TOKENS to 7 tokens must occur word for word; their mask keeps all of their tokens.

What is broadcast are rows of three numbers per window of an item and mask, whatever an item's length, in blocks of about
``BLOCK_SEEDS``; a block that one frequent window makes much larger is cut further. Documents are read once, or, where there
are several blocks, tokenised once and written. Hits are merged to distinct diagonals per task before they move, and only then meet
the tokens of the documents that have any, which are read again by their keys; the keys are broadcast up to a number.

Defined results: null and empty texts and documents shorter than an item are clean of it; items of fewer than MIN_TOKENS
tokens are no evidence and not searched for; repeated rows and repeated items give one row per (document id, item id), with the
best overlap of the texts of that id, then the most matches; null ids stay null; an empty table gives an empty result; other
columns are ignored by ``find`` and kept by ``drop_contaminated``, which drops rows by id and text together: a clean row that shares
its id, or has none, stays. Texts of any length are searched whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.exact_dedup import text_digest
from corpusloom.llm.workspace import Workspace, few, free_name, row_key

SPAN = 8
#: Kept token positions of each mask (fixed values).
MASKS = ((0, 4, 5, 6, 7), (0, 2, 3, 6, 7), (0, 1, 2, 5, 7))
SHORT_MASK = (0, 1, 2, 3, 5)
SHORT_ITEMS = range(8, 11)
MIN_SHARE, WINDOW, MIN_TOKENS = 0.8, 30, 4
#: Seeds per broadcast block; a seed row takes about 32 bytes.
BLOCK_SEEDS = 1_000_000


def token_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased tokens of a text, in order."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def masks_for(sizes: set[int]) -> list[tuple[tuple[int, ...], int, int]]:
    """``(kept positions, fewest, most item tokens)`` of the masks that items of these sizes need."""
    out = [(mask, SPAN, 1 << 30) for mask in MASKS] if any(n >= SPAN for n in sizes) else []
    if any(n in SHORT_ITEMS for n in sizes):
        out.append((SHORT_MASK, SHORT_ITEMS[0], SHORT_ITEMS[-1]))
    return out + [(tuple(range(n)), n, n) for n in sorted(sizes) if n < SPAN]


def _anchor(tokens: Column, at: Column, span: int) -> Column:
    """Hash of the first and the last token of a window: what all masks of a span keep, so what any hit must share."""
    return F.xxhash64(F.lit(span), F.get(tokens, at), F.get(tokens, at + (span - 1)))


def _seed(tokens: Column, at: Column, mask: tuple[int, ...]) -> Column:
    return F.xxhash64(F.lit(",".join(map(str, mask))), *(F.get(tokens, at + k) for k in mask))


def _items(benchmark: DataFrame, id_col: str, text_col: str, ws: Workspace) -> DataFrame:
    items = benchmark.select(F.col(id_col).alias("item_id"), token_hashes(F.col(text_col)).alias("item"))
    items = items.filter(F.size("item") >= MIN_TOKENS).distinct()
    return ws.save(items.withColumn("item_no", F.monotonically_increasing_id()), "items")


def _item_seeds(items: DataFrame, masks: list, blocks: int) -> DataFrame:
    """``(block, anchor, seed, item_no, item_at)``."""
    out = None
    for mask, low, high in masks:
        span = mask[-1] + 1
        at = F.explode(F.sequence(F.lit(0), F.size("item") - span)).alias("item_at")
        rows = items.filter(F.size("item").between(low, high)).select("item_no", "item", at)
        rows = rows.select(_anchor(F.col("item"), F.col("item_at"), span).alias("anchor"), _seed(F.col("item"), F.col("item_at"), mask).alias("seed"), "item_no", "item_at")
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("block", F.pmod("anchor", F.lit(blocks)).cast("int"))


def _block_hits(read: DataFrame, seeds: DataFrame, masks: list) -> DataFrame:
    """``(key, item_no, diagonal)`` of one block, repeated as often as masks hit."""
    spans = sorted({mask[-1] + 1 for mask, *_ in masks})
    tokens, n = F.col("tokens"), F.size("tokens")
    # one run of positions per span; what reaches over the end has nulls and cannot be verified later
    run = lambda span: F.transform(F.sequence(F.lit(0), n - 1), lambda i: _anchor(tokens, i, span))
    runs = [run(s) for s in spans]
    probes = read.select("key", "tokens", F.posexplode(F.concat(*runs) if len(runs) > 1 else runs[0]).alias("pos", "anchor"))
    # most windows end here; the masks' hashes are computed for the others
    probes = probes.join(F.broadcast(seeds.select("anchor").distinct()), "anchor", "left_semi")
    at = F.col("pos") % n if len(spans) > 1 else F.col("pos")
    probes = probes.withColumn("at", at.cast("int"))
    made = [(mask, _seed(tokens, F.col("at"), mask)) for mask, *_ in masks]
    if len(spans) > 1:
        of = F.floor(F.col("pos") / n)
        choice = [F.array(*(seed for mask, seed in made if mask[-1] + 1 == s)) for s in spans]
        seed = F.coalesce(*(F.when(of == k, c) for k, c in enumerate(choice)))
    else:
        seed = F.array(*(seed for _, seed in made))
    probes = probes.select("key", "at", F.explode(seed).alias("seed"))
    hits = probes.join(F.broadcast(seeds.select("seed", "item_no", "item_at")), "seed")
    return hits.select("key", "item_no", (F.col("at") - F.col("item_at")).alias("diagonal"))


def _judge(tokens: Column, item: Column, diagonal: Column) -> Column:
    """``(overlap, matched)`` on a diagonal: the item's share, or where that is too low its best window's."""
    n = F.size(item)
    at = lambda j: diagonal + j
    # 1 where the item's token and the document's on the diagonal are the same; outside the document 0
    same = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda j: F.when((at(j) >= 0) & (F.get(item, j) == F.get(tokens, F.greatest(F.lit(0), at(j)))), 1).otherwise(0),
    )
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    windows = lambda a: F.array_max(F.transform(F.sequence(F.lit(0), n - WINDOW), lambda s: total(F.slice(a, s + 1, WINDOW))))

    def shares(a: Column, matched: Column) -> Column:
        whole = matched / n
        share = F.when((whole >= MIN_SHARE) | (n <= WINDOW), whole).otherwise(F.greatest(whole, windows(a) / WINDOW))
        return F.struct(share.alias("overlap"), matched.alias("matched"))

    # bound once: the optimiser would evaluate an inlined array again for each use
    bound = F.transform(F.array(same), lambda a: F.transform(F.array(total(a)), lambda m: shares(a, m)))
    return F.get(F.get(bound, 0), 0)


def _found(docs: DataFrame, benchmark: DataFrame, ws: Workspace, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """``(key, id, item_id, matched, item_tokens, overlap)`` of contaminated rows by their key."""
    items = _items(benchmark, item_col, item_text_col, ws)
    # the benchmark's own size decides how many blocks it takes; at most eight rows
    sizes = items.groupBy(F.least(F.size("item"), F.lit(SHORT_ITEMS[-1] + 1)).alias("n")).agg(F.sum(F.size("item")).alias("tokens")).collect()
    masks = masks_for({r["n"] for r in sizes}) or masks_for({SPAN})
    blocks = max(1, math.ceil(sum(r["tokens"] for r in sizes) * len(MASKS) / BLOCK_SEEDS))
    seeds = _item_seeds(items, masks, blocks)
    counts = {0: 0}
    if blocks > 1:
        seeds = ws.save(seeds, "seeds")
        counts = {r["block"]: r["n"] for r in seeds.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(F.col(id_col), text_digest(F.col(text_col))).alias("key"))
    read = keyed.select("key", token_hashes(F.col("text")).alias("tokens")).filter(F.size("tokens") >= min(mask[-1] + 1 for mask, *_ in masks))
    read = ws.save(read, "tokens") if blocks > 1 else read
    hits = None
    for block, size in sorted(counts.items()):
        own = seeds.filter(F.col("block") == block) if blocks > 1 else seeds
        chunks = max(1, math.ceil(size / (2 * BLOCK_SEEDS)))  # a window that very many items share can fill a block alone
        for chunk in range(chunks):
            few_seeds = own if chunks == 1 else own.filter(F.pmod(F.xxhash64("item_no", "item_at"), F.lit(chunks)) == chunk)
            part = _block_hits(read, few_seeds, masks)
            hits = part if hits is None else hits.unionByName(part)
    hits = ws.save(hits.distinct(), "hits")
    per = hits.groupBy("key", "item_no").agg(F.collect_set("diagonal").alias("diagonals"))  # at most one per token of the document
    found = ws.save(hits.select("key").distinct(), "found")
    rows = keyed.join(few(found), "key", "left_semi").dropDuplicates(["key"])
    rows = rows.select("key", "id", token_hashes(F.col("text")).alias("tokens"))
    met = per.join(rows, "key").join(items, "item_no")
    best = F.array_max(F.transform("diagonals", lambda d: _judge(F.col("tokens"), F.col("item"), d)))
    n = F.size("item")
    judged = met.select("key", "id", "item_id", n.alias("item_tokens"), best.alias("best"))
    judged = judged.select("key", "id", "item_id", "best.matched", "item_tokens", "best.overlap")
    return judged.filter(F.col("overlap") >= F.when(F.col("item_tokens") < SPAN, 1.0).otherwise(MIN_SHARE))


def find(
    docs: DataFrame, benchmark: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per contaminated document and item: id, ``item_id``, ``matched``, ``item_tokens``, ``overlap``."""
    found = _found(docs, benchmark, ws, id_col, text_col, item_col, item_text_col)
    best = found.groupBy("id", "item_id").agg(F.max(F.struct("overlap", "matched", "item_tokens")).alias("best"))
    return best.select(F.col("id").alias(id_col), "item_id", "best.matched", "best.item_tokens", "best.overlap")


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs``, all columns kept, that hold no item."""
    bad = ws.save(_found(docs, benchmark, ws, id_col, text_col, item_col, item_text_col).select("key").distinct(), "bad")
    name = free_name(docs)
    tagged = docs.withColumn(name, row_key(docs[id_col], text_digest(docs[text_col])))
    return tagged.join(few(bad.withColumnRenamed("key", name)), name, "left_anti").drop(name)
