"""Quality rules and shingle deduplication (FL1-FL5, DD1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def common_share(c: Column) -> Column:
    """Share of the most common lower-cased character, spaces included (FL3).

    A character's count is the length that its removal takes away, one native scan per distinct character.
    """

    def count(low: Column) -> Column:
        chars = F.array_distinct(F.filter(F.split(low, ""), lambda x: x != ""))
        return F.array_max(F.transform(chars, lambda x: F.length(low) - F.length(F.replace(low, x, F.lit("")))))

    most = T.once(F.lower(c), count)
    return F.coalesce(most, F.lit(0)) / F.greatest(F.length(c), F.lit(1))


def majority_share(c: Column) -> Column:
    """The most common character's share if that is above one half, else a share of one half or less (FL3).

    A character that fills more than half of a text stands twice in a row somewhere or comes first, so only such
    characters are counted.
    """
    def count(low: Column) -> Column:
        doubled = F.regexp_extract_all(low, F.lit(r"(?s)(.)\1"), F.lit(1))
        chars = F.filter(F.array_distinct(F.array_append(doubled, F.substring(low, 1, 1))), lambda x: x != "")
        return F.array_max(F.transform(chars, lambda x: F.length(low) - F.length(F.replace(low, x, F.lit("")))))

    most = T.once(F.lower(c), count)
    return F.coalesce(most, F.lit(0)) / F.greatest(F.length(c), F.lit(1))


def letter_share(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", "")) / F.greatest(F.length(c), F.lit(1))


def quality_reason(c: Column, min_chars: int = 80, min_parts: int = 2, max_common: float = 0.5, min_letters: float = 0.15) -> Column:
    """The first rule that a text breaks, or ``ok``; later rules are not evaluated for it."""
    share = majority_share if max_common >= 0.5 else common_share

    def judge(text: Column) -> Column:
        parts = F.filter(T.sentences(text, T.SENTENCE_MARK), lambda p: F.length(T.strip(p)) > 0)
        return (
            F.when(F.length(text) < min_chars, "short")
            .when(F.size(parts) < min_parts, "few_sentences")
            .when(share(text) > max_common, "repetitive")
            .when(letter_share(text) < min_letters, "few_letters")
            .otherwise("ok")
        )

    return T.once(T.strip(F.coalesce(c, F.lit(""))), judge)


def shingle_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 8) -> DataFrame:
    """One row per shingle hash: the smallest id and the group's size. Only hashes and ids are shuffled."""
    keyed = docs.select(F.col(id_col), T.shingle_hash(F.col(text_col), k).alias("shingle_hash"))
    return keyed.groupBy("shingle_hash").agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("group_size"))


def dedup_records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 8) -> DataFrame:
    """The whole records that ``shingle_dedup`` names: the first per shingle hash (DD1). Records meet ids, and move only where ids are many."""
    first = shingle_dedup(docs, id_col, text_col, k).select(id_col)
    return docs.join(first, id_col, "left_semi")


def corpus_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: int = 10, high: int = 500) -> DataFrame:
    """Cleaned lines of ``low`` to ``high`` characters (IO12, FL5)."""
    lines = docs.select(id_col, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line"))
    lines = lines.withColumn("line", T.clean_markup(F.col("line")))
    return lines.filter(F.length("line").between(low, high))
