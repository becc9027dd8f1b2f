"""Spans to blocks, blocks to sections, sections to chunks (LY1-LY9, CK1-CK6).

A document's order is an explicit key at each level, and every window is by document, so partitions grow
with a document's length and never with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

BODY_SIZE, TITLE_RATIO, HEADING_RATIO, TOP_RATIO, LEVELS = 12.0, 1.35, 1.12, 1.22, 6
ABSTRACT = r"(?iU)\babstract\b"


def body_sizes(spans: DataFrame) -> DataFrame:
    """Median of a document's positive span sizes, or 12 (LY1)."""
    return spans.groupBy("doc_id").agg(F.coalesce(F.percentile(F.when(F.col("size") > 0, F.col("size")), 0.5), F.lit(BODY_SIZE)).alias("body"))


def classify(spans: DataFrame) -> DataFrame:
    """Blocks ``(doc_id, pos, page, text, type, level)``: the first large span is the title at level 0 (LY2, LY3)."""
    sized = spans.join(body_sizes(spans), "doc_id")
    order = Window.partitionBy("doc_id").orderBy("page", "seq")
    large = F.col("size") > F.col("body") * TITLE_RATIO
    seen = F.sum(F.when(large, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    title = large & (F.coalesce(seen, F.lit(0)) == 0)
    kind = F.when(title | (F.col("size") >= F.col("body") * HEADING_RATIO), "heading").otherwise("paragraph")
    level = F.when(title, 0).when(F.col("size") >= F.col("body") * TOP_RATIO, 1).when(F.col("size") >= F.col("body") * HEADING_RATIO, 2).otherwise(0)
    return sized.select("doc_id", (F.row_number().over(order) - 1).alias("pos"), "page", "text", kind.alias("type"), level.alias("level"))


def joined(order: str, text: Column | str, sep: str, only: Column | None = None) -> Column:
    """Texts of a group in the order of a key; ``collect_list`` alone has no order after a shuffle."""
    row = F.struct(F.col(order).alias("k"), (F.col(text) if isinstance(text, str) else text).alias("t"))
    rows = F.array_sort(F.collect_list(row if only is None else F.when(only, row)))
    return F.array_join(F.transform(rows, lambda r: r["t"]), sep)


def merge_paragraphs(blocks: DataFrame) -> DataFrame:
    """Neighbouring paragraphs of a page become one (LY4)."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    follows = (F.col("type") == "paragraph") & (F.lag("type").over(order) == "paragraph") & (F.lag("page").over(order) == F.col("page"))
    islands = blocks.withColumn("new", F.when(follows, 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
    merged = islands.groupBy("doc_id", "island", "page", "type", "level").agg(joined("pos", "text", " ").alias("text"))
    return merged.select("doc_id", (F.col("island") - 1).cast("int").alias("pos"), "page", "type", "level", "text")


def abstracts(blocks: DataFrame) -> DataFrame:
    """Text between the first heading that names an abstract and the next heading (LY5)."""
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("type") == "heading"
    hit = heading & F.col("text").rlike(ABSTRACT)
    marked = blocks.withColumn("no", F.sum(heading.cast("int")).over(order)).withColumn("hit", F.when(hit, F.col("no")))
    marked = marked.withColumn("first", F.min("hit").over(order))
    inside = marked.filter((F.col("no") == F.col("first")) & ~heading)
    return inside.groupBy("doc_id").agg(T.strip(joined("pos", "text", "\n\n")).alias("abstract"))


def sections(blocks: DataFrame) -> DataFrame:
    """Adjacency list ``(doc_id, sec_pos, parent_pos, level, title, page, text)`` in preorder (LY6).

    The parent of a heading is the latest earlier heading of a smaller level; text before any section is dropped.
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    head = (F.col("type") == "heading") & (F.col("level") >= 1)
    owned = blocks.withColumn("sec_pos", F.last(F.when(head, F.col("pos")), ignorenulls=True).over(upto)).filter("sec_pos is not null")
    owned = owned.filter(head | (F.col("type") == "paragraph"))
    titles = owned.groupBy("doc_id", "sec_pos").agg(
        F.max(F.when(head, F.col("level"))).alias("level"),
        F.max(F.when(head, F.col("text"))).alias("title"),
        F.max(F.when(head, F.col("page"))).alias("page"),
        joined("pos", "text", "\n\n", ~head).alias("text"),
    )
    before = Window.partitionBy("doc_id").orderBy("sec_pos").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.when(F.col("level") > n, F.last(F.when(F.col("level") == n, F.col("sec_pos")), ignorenulls=True).over(before)) for n in range(1, LEVELS)]
    return titles.withColumn("parent_pos", F.greatest(*last)).select("doc_id", "sec_pos", "parent_pos", "level", "title", "page", "text")


def render(blocks: DataFrame, secs: DataFrame) -> DataFrame:
    """A document as text with one ``#`` more than its depth before each title (IO7)."""
    title = blocks.filter((F.col("type") == "heading") & (F.col("level") == 0)).select("doc_id", F.col("text").alias("doc_title"))
    parent = secs.select("doc_id", F.col("sec_pos").alias("parent_pos"), F.lit(1).alias("nested"))
    depth = F.coalesce(F.col("nested"), F.lit(0)) + 2  # two levels of headings
    body = secs.join(parent, ["doc_id", "parent_pos"], "left")
    line = F.concat(F.lit("\n"), F.repeat(F.lit("#"), depth), F.lit(" "), F.col("title"), F.when(F.col("text") != "", F.concat(F.lit("\n"), F.col("text"))).otherwise(""))
    parts = body.groupBy("doc_id").agg(joined("sec_pos", line, "\n").alias("body"))
    head = blocks.select("doc_id").distinct().join(title, "doc_id", "left").join(abstracts(blocks), "doc_id", "left").join(parts, "doc_id", "left")
    text = F.concat(
        F.lit("# TITLE: "), F.coalesce("doc_title", F.lit("")),
        F.when(F.coalesce("abstract", F.lit("")) != "", F.concat(F.lit("\n\n# ABSTRACT\n"), F.col("abstract"))).otherwise(""),
        F.when(F.col("body").isNotNull(), F.concat(F.lit("\n"), F.col("body"))).otherwise(""),
    )
    return head.select("doc_id", text.alias("rendered"))


def chunk(secs: DataFrame, size: int = 600, overlap: int = 80, levels: int = LEVELS) -> DataFrame:
    """A chunk per section that is not blank, followed by its pieces, numbered in preorder (CK1, CK2, CK5, CK6).

    Texts are stripped first; a section's own chunk holds its first ``4 * size`` characters. A path names all sections above, blank titles left
    out at its end only; a parent is the nearest section above that is not blank. Sections climb a map of their own document's titles,
    which lie in the same partition as its sections, so no level costs an exchange.
    """
    stripped = secs.withColumn("text", T.strip(F.col("text")))
    node = F.struct(F.col("parent_pos").alias("parent"), F.coalesce("title", F.lit("")).alias("title"), (F.length("text") > 0).alias("solid"))
    nodes = stripped.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("sec_pos", node))).alias("nodes"))
    kind = secs.schema["sec_pos"].dataType
    full = stripped.filter(F.length("text") > 0).join(nodes, "doc_id")
    full = full.withColumns({"titles": F.array().cast("array<string>"), "up": F.col("parent_pos"), "near": F.lit(None).cast(kind)})
    for _ in range(levels - 1):
        full = full.withColumn("node", F.try_element_at("nodes", F.col("up")))
        full = full.withColumns({
            "titles": F.when(F.col("node").isNull(), F.col("titles")).otherwise(F.concat(F.array("node.title"), F.col("titles"))),
            "near": F.coalesce("near", F.when(F.col("node.solid"), F.col("up"))),
            "up": F.col("node.parent"),
        })
    full = full.drop("nodes", "node", "up")
    path = F.when(F.coalesce("title", F.lit("")) == "", F.array_join("titles", " > ", "")).otherwise(F.array_join(F.concat("titles", F.array("title")), " > ", ""))
    full = full.withColumn("pieces", T.pack_paragraphs(F.col("text"), size, overlap))
    before = Window.partitionBy("doc_id").orderBy("sec_pos").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum(F.size("pieces") + 1).over(before), F.lit(0)) + 1
    full = full.withColumn("no", first).withColumn("section_path", path)
    ids = full.select("doc_id", F.col("sec_pos").alias("near"), F.col("no").alias("up_no"))
    full = full.join(ids, ["doc_id", "near"], "left")
    name = lambda n: F.format_string("%s__%05d", F.col("doc_id").cast("string"), n)
    head = full.select(
        "doc_id", name(F.col("no")).alias("chunk_id"), F.when(F.col("up_no").isNotNull(), name(F.col("up_no"))).alias("parent_id"),
        F.substring("text", 1, 4 * size).alias("text"), "section_path", "page", "level", F.lit(True).alias("is_section"), F.lit(None).cast("int").alias("piece"),
    )
    parts = full.select("*", F.posexplode("pieces").alias("piece", "part")).select(
        "doc_id", name(F.col("no") + 1 + F.col("piece")).alias("chunk_id"), name(F.col("no")).alias("parent_id"),
        F.col("part").alias("text"), "section_path", "page", "level", F.lit(False).alias("is_section"), "piece",
    )
    return head.unionByName(parts)


def jump_to_parent(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each hit's parent chunk, or the hit itself where it has none (RR3)."""
    up = chunks.select(F.col("chunk_id").alias("parent_id"), F.col("text").alias("parent_text"))
    found = hits.join(up, "parent_id", "left")
    return found.withColumn("context_id", F.coalesce("parent_id", "chunk_id")).withColumn("context_text", F.coalesce("parent_text", "text"))
