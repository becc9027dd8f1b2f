"""Vocabulary mining: token counts ranked by what adding a token would save (VO2-VO4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.quality import corpus_lines


def token_counts(lines: DataFrame, text_col: str = "line") -> DataFrame:
    """``(token, freq)`` of words; counts are merged per task before the exchange."""
    return lines.select(F.explode(F.split(F.col(text_col), r"(?U)\s+")).alias("token")).filter("token != ''").groupBy("token").agg(F.count(F.lit(1)).alias("freq"))


def pieces_by_length(token: Column) -> Column:
    """Pieces that a base vocabulary would make of a token, taken as one per four characters."""
    return F.ceil(F.length(token) / 4).cast("int")


def gains(counts: DataFrame, base: DataFrame, pieces: Callable[[Column], Column] = pieces_by_length, min_freq: int = 5) -> DataFrame:
    """``(token, freq, gain)`` of new tokens that pass the filters (FL6)."""
    letters = F.length(F.regexp_replace("token", r"[^\p{L}\p{N}]", "")) / F.length("token")
    fit = counts.filter((F.col("freq") >= min_freq) & (F.length("token") >= 2) & F.col("token").rlike("[A-Za-z]") & (letters >= 0.5))
    saved = pieces(F.col("token")) - 1
    return fit.join(base, "token", "left_anti").filter(saved >= 1).select("token", "freq", (F.col("freq") * saved).alias("gain"))


def top(gained: DataFrame, n: int = 2000) -> DataFrame:
    return gained.orderBy(F.desc("gain"), "token").limit(n)


def select_tokens(docs: DataFrame, base: DataFrame, top_n: int = 2000, min_freq: int = 5, pieces: Callable[[Column], Column] = pieces_by_length) -> DataFrame:
    """Cleaned lines, word counts, gains against ``base(token)`` and the best ``top_n`` (VO2, VO3)."""
    return top(gains(token_counts(corpus_lines(docs)), base, pieces, min_freq), top_n)


def extension(docs: DataFrame, base: DataFrame, top_n: int = 2000, min_freq: int = 5, pieces: Callable[[Column], Column] = pieces_by_length) -> DataFrame:
    """``(position, token)``: the tokens that extend a vocabulary, in the order in which they are added (VO5). At most ``top_n`` rows are numbered."""
    chosen = select_tokens(docs, base, top_n, min_freq, pieces)
    order = Window.orderBy(F.desc(F.length("token")), "token")
    return chosen.select(F.row_number().over(order).alias("position"), "token")


def addition_order(tokens: DataFrame) -> DataFrame:
    """New tokens longest first, as they are to be added (VO4, DD3)."""
    return tokens.select("token").distinct().orderBy(F.desc(F.length("token")), "token")


def added_tokens(json: Column) -> Column:
    """Names in a stored map of added tokens (VO6)."""
    return F.map_keys(F.from_json(json, "map<string,int>"))


def write_tokens(tokens: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One token per line, in alphabetical order (IO19)."""
    tokens.select("token").distinct().orderBy("token").write.mode(mode).text(path)
