"""Licence scan (operator 10, DataFrame operations only).

Texts with a licence cue are compared to licence templates by the cosine of TF-IDF vectors over lower-cased words: the
whole text, each of its paragraphs with a cue (the headers of source files, without comment signs) and each line or sentence with
one. Templates are whole licence texts, the headers that licences ask files to carry, titles, SPDX tags and short notices. The best
template of at least ``MIN_COSINE`` (``MIN_LONG`` where more than ``LONG`` words are compared) is the text's own licence.

A file is a licence file, and holds for its directory, if the whole of it is like a template, or if at least ``FILE_SHARE`` of its
words are lines and sentences that are. A file without a licence of its own takes that of the nearest directory above it that has one,
found by joining directories to their ancestors; directories, not files, are joined, and a directory with many files
is merged per task first and its files are dealt out.

Equal texts are judged once. Words meet the templates' vectors, which are broadcast; their size follows from the templates alone
(about 3,000 words and 150 templates), not from the corpus. Only texts with a cue move.

Defined results: null and empty texts have no licence of their own and may inherit; a null path is in no directory;
several licence files in a directory: the highest cosine counts, then the name; equal cosines in a
text: the alphabetically first name; null ids and repeated rows are resolved each; an empty table gives an empty result; texts of any
length are compared whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import licence_templates
from corpusloom.llm.exact_dedup import text_digest
from corpusloom.llm.workspace import Workspace, salted_lookup

MIN_COSINE, FILE_SHARE = 0.6, 0.1
#: Legal prose is alike, so longer texts than LONG words must be closer to a template.
LONG, MIN_LONG = 100, 0.85
CUE = "(?i)licen[cs]e|copyright|public domain|released under|spdx|permission is hereby granted"
COMMENT = r"(?m)^[ \t]*(?:/\*+|\*+/|\*+|//+|#+|--+|;+|%+|<!--|-->)[ \t]*"
PARTS = "\\n|(?<=[.!?])\\s+"


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters and digits, with one spelling of licence."""
    return [w for w in re.split("[^a-z0-9]+", text.lower().replace("licence", "license")) if w]


@lru_cache(maxsize=4)
def model(templates: tuple[tuple[str, str], ...]) -> tuple[list[str], dict[str, tuple[float, list[float]]], float]:
    """Names of the templates in alphabetical order, ``word -> (idf, its part in each unit vector)``, and the idf of any other word."""
    ordered = sorted(templates)
    counts = [Counter(words_of(text)) for _, text in ordered]
    seen = Counter(w for c in counts for w in c)
    idf = {w: math.log((1 + len(ordered)) / (1 + n)) + 1 for w, n in seen.items()}
    length = [math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items())) for c in counts]
    table = {w: (idf[w], [c[w] * idf[w] / size if w in c else 0.0 for c, size in zip(counts, length, strict=True)]) for w in seen}
    return [name for name, _ in ordered], table, math.log(1 + len(ordered)) + 1


def _vectors(spark: SparkSession, table: dict) -> DataFrame:
    """``(word, idf, at, part)`` from a literal: the templates that have a word, and its part in their unit vectors."""
    rows = [{"w": w, "f": idf, "i": [k for k, x in enumerate(part) if x], "x": [x for x in part if x]} for w, (idf, part) in table.items()]
    literal = F.from_json(F.lit(json.dumps(rows)), "array<struct<w:string,f:double,i:array<int>,x:array<double>>>")
    each = spark.range(1).select(F.inline(literal))
    return each.select(F.col("w").alias("word"), F.col("f").alias("idf"), F.col("i").alias("at"), F.col("x").alias("part"))


def _units(text: Column) -> Column:
    """``(kind, text)`` of what is compared: the whole, and the paragraphs and statements that have a cue."""
    bare = F.regexp_replace(text, COMMENT, "")
    cued = lambda parts: F.filter(parts, lambda p: p.rlike(CUE))
    unit = lambda kind, t: F.struct(F.lit(kind).alias("kind"), t.alias("t"))
    paragraphs = F.transform(cued(F.split(bare, "\\n\\s*\\n")), lambda p: unit("paragraph", p))
    statements = F.transform(cued(F.split(bare, PARTS)), lambda p: unit("statement", p))
    return F.concat(F.array(unit("whole", bare)), F.array_distinct(paragraphs), F.array_distinct(statements))


def judge(contents: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """``(digest, own, cosine, holds)`` of ``contents(digest, text)``, which has each digest once and is grouped by it."""
    names, table, unseen = model(tuple(templates))
    units = contents.select("digest", F.posexplode(_units(F.col("text"))).alias("unit", "u")).select("digest", "unit", "u.kind", "u.t")
    low = F.replace(F.lower("t"), F.lit("licence"), F.lit("license"))
    words = units.select("digest", "unit", "kind", F.explode(F.split(low, "[^a-z0-9]+")).alias("word")).filter("word != ''")
    counted = words.groupBy("digest", "unit", "kind", "word").agg(F.count(F.lit(1)).alias("tf"))
    met = counted.join(F.broadcast(_vectors(contents.sparkSession, table)), "word", "left")
    met = met.withColumn("u", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    # one row per word and template that has it; the first of them, or a row of its own, also counts for the length
    spread = met.select("digest", "unit", "kind", "tf", "u", F.posexplode_outer(F.arrays_zip("at", "part")).alias("nth", "v"))
    first = F.coalesce(F.col("nth"), F.lit(0)) == 0
    square = F.when(first, F.col("u") * F.col("u")).otherwise(0.0)
    dots = spread.groupBy("digest", "unit", "kind", "v.at").agg(
        F.sum(F.col("u") * F.col("v.part")).alias("dot"), F.sum(square).alias("square"), F.sum(F.when(first, F.col("tf")).otherwise(0)).alias("n")
    )
    label = F.element_at(F.array(*map(F.lit, names)), F.col("at") + 1)
    length = F.sqrt(F.sum("square")).alias("length")
    per = dots.groupBy("digest", "unit", "kind").agg(length, F.sum("n").alias("n"), F.collect_list(F.when(F.col("at").isNotNull(), F.struct("dot", label.alias("name")))).alias("found"))
    cosines = F.transform("found", lambda f: F.struct((-F.round(f["dot"] / F.col("length"), 9)).alias("c"), f["name"].alias("name")))
    scored = per.select("digest", "kind", "n", F.array_min(cosines).alias("near"))
    hit = F.coalesce(-F.col("near.c") >= F.when(F.col("n") > LONG, MIN_LONG).otherwise(MIN_COSINE), F.lit(False))
    best = F.min(F.when(hit, F.col("near"))).alias("best")
    said = F.sum(F.when(hit & (F.col("kind") == "statement"), F.col("n")).otherwise(0))
    whole = F.max(F.when(F.col("kind") == "whole", hit).otherwise(False))
    total = F.max(F.when(F.col("kind") == "whole", F.col("n")))
    own = scored.groupBy("digest").agg(best, (whole | (said / total >= FILE_SHARE)).alias("holds"))
    return own.select("digest", F.col("best.name").alias("own"), (-F.col("best.c")).alias("cosine"), "holds")


def own_licences(
    files: DataFrame, ws: Workspace, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text"
) -> DataFrame:
    """One row per file: id, path, ``own`` (or null), ``cosine`` and ``holds``, whether it is a licence file."""
    rows = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cued = F.col("text").rlike(CUE)
    narrow = ws.save(rows.select("id", "path", F.when(cued, text_digest(F.col("text"))).alias("digest")), "files")
    # one text per digest; copies are merged before the exchange, after which all grouping is in place
    texts = rows.filter(cued).select(text_digest(F.col("text")).alias("digest"), "text")
    contents = texts.groupBy("digest").agg(F.first("text").alias("text"))
    judged = judge(contents, licence_templates.templates() if templates is None else templates)
    sizes = narrow.filter("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("files"))
    judged = ws.save(sizes.join(judged, "digest", "left"), "judged")
    found = salted_lookup(narrow.filter("digest is not null"), judged, "digest", F.monotonically_increasing_id(), F.col("files"))
    none = lambda kind: F.lit(None).cast(kind)
    plain = narrow.filter("digest is null").select("id", "path", none("string").alias("own"), none("double").alias("cosine"), F.lit(False).alias("holds"))
    return found.select("id", "path", "own", "cosine", F.coalesce("holds", F.lit(False)).alias("holds")).unionByName(plain)


def _directory(path: Column) -> Column:
    """All but the last segment; a file without one is in the root, the empty string."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def resolve(own: DataFrame, ws: Workspace, id_col: str = "doc_id") -> DataFrame:
    """One row per file: id, ``path``, ``licence``, ``origin`` (own or inherited, else null), ``directory``, ``cosine``."""
    own = ws.save(own.withColumn("dir", _directory(F.col("path"))), "own")
    holds = own.filter(F.col("holds") & F.col("own").isNotNull() & F.col("dir").isNotNull())
    holds = holds.groupBy("dir").agg(F.min(F.struct(-F.col("cosine"), "own")).alias("file"))
    holds = ws.save(holds.select(F.col("dir").alias("above"), F.col("file.own").alias("own")), "holds")
    open_files = own.filter(F.col("own").isNull() & F.col("dir").isNotNull())
    dirs = ws.save(open_files.groupBy("dir").agg(F.count(F.lit(1)).alias("files")), "dirs")
    steps = F.split("dir", "/")
    chain = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))
    above = dirs.select("dir", F.posexplode(F.array_distinct(F.concat(chain, F.array(F.col("dir"))))).alias("depth", "above"))
    near = above.join(holds, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "own")).alias("near"))
    given = dirs.join(near, "dir", "left").select("dir", "files", "near.above", F.col("near.own").alias("given"))
    given = ws.save(given, "given")
    inherited = salted_lookup(open_files, given, "dir", F.monotonically_increasing_id(), F.col("files"))
    cols = lambda df, licence, origin, directory: df.select(
        F.col("id").alias(id_col), "path", licence.alias("licence"), origin.alias("origin"), directory.alias("directory"), "cosine"
    )
    none = F.lit(None).cast("string")
    direct = own.filter(F.col("own").isNotNull() | F.col("dir").isNull())
    return cols(direct, F.col("own"), F.when(F.col("own").isNotNull(), "own"), none).unionByName(
        cols(inherited, F.col("given"), F.when(F.col("given").isNotNull(), "inherited"), F.col("above"))
    )
