"""Text functions as Column expressions. Patterns carry ``(?Ud)``: Unicode classes, and only newline as line end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

U = "(?Ud)"

#: Words that the sparse tokenizer drops.
STOPWORDS = (
    "the", "a", "an", "of", "to", "in", "on", "for", "and", "or", "is", "are", "was", "were", "be", "been",
    "with", "from", "as", "by", "at", "that", "this", "these", "those", "we", "our", "it", "its", "they", "their",
)

#: What cleaning replaces, in order.
CLEANING = (
    (r"\\[a-zA-Z]+\{([^}]*)\}", "$1"),
    (r"\\[a-zA-Z]+", " "),
    (r"[{}]", " "),
    (r"arXiv:\d{4}\.\d{4,5}\s+v\d+\s+\[[^\]]+\]\s+[\d\s:UTC]+", " "),
    (r"(?i)\bSubmitted to\b.*$", " "),
    (r"[ \t]+", " "),
    (r"\n{3,}", "\n\n"),
)
#: What texts are split and searched by.
SENTENCE_END, SENTENCE_END_WIDE, SENTENCE_MARK = r"(?<=[.!?])\s+", r"(?<=[.!?。！？])\s+", r"[.!?。！？]\s"
NUMBER, STEP, CITATION = r"\b\d+(?:\.\d+)?(?:%|x|×)?\b", r"(\d+[\.、]\s*[^\n]+)", r"\[chunk_[^\]]+\]"


def once(c: Column, then: Callable[[Column], Column]) -> Column:
    """``then(c)`` with ``c`` evaluated once per row, also where ``then`` names it inside lambdas."""
    return F.get(F.transform(F.array(c), then), 0)


def strip(c: Column) -> Column:
    """Drop Unicode white space from both ends."""
    return F.regexp_replace(c, rf"{U}^\s+|\s+\z", "")


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; none at the ends (TX8)."""
    return strip(F.regexp_replace(c, rf"{U}\s+", " "))


def clean_markup(c: Column) -> Column:
    """Cleaning after NFKC (CL1b-h): odd spaces, markup, page stamps, runs of blanks, ends."""
    c = F.translate(c, "\u00a0\u200b", " ")
    for pattern, other in CLEANING:
        c = F.regexp_replace(c, F.lit(U + pattern), F.lit(other))
    return strip(c)


def sparse_tokens(c: Column) -> Column:
    """Lower-cased runs of at least two of ``a-z0-9+#.-`` without stop words (TX1)."""
    words = F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9+#.-]{2,})"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(*STOPWORDS))


def shingle_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))


def shingle_hash(c: Column, k: int = 8) -> Column:
    """MD5 of the sorted distinct k-token shingles, or of all tokens where there are fewer (TX3)."""

    def digest(tokens: Column) -> Column:
        n = F.size(tokens)
        grams = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.array_join(F.slice(tokens, i, F.lit(k)), " "))
        return F.md5(F.when(n < k, F.array_join(tokens, " ")).otherwise(F.array_join(F.array_sort(F.array_distinct(grams)), " ")))

    return once(shingle_tokens(F.coalesce(c, F.lit(""))), digest)


def sentences(c: Column, pattern: str = SENTENCE_END) -> Column:
    """Split behind sentence marks and white space (TX4, TX5) or at them (TX6)."""
    return F.split(c, U + pattern, -1)


def paragraphs(c: Column) -> Column:
    """Parts between blank lines that are not blank (TX7)."""
    return F.filter(F.split(c, rf"{U}\n\s*\n", -1), lambda p: F.length(strip(p)) > 0)


def strip_citations(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(CITATION), F.lit(""))


def citation_id(c: Column) -> Column:
    """A cited id without brackets, quotes and blanks around it (TX13)."""
    return F.btrim(c, F.lit("[]\"' "))


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"{U}({NUMBER})"), F.lit(1))


def steps(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(U + STEP), F.lit(1))


def safe_name(c: Column) -> Column:
    """Slashes become underscores (TX16)."""
    return F.replace(c, F.lit("/"), F.lit("_"))


def last_segment(c: Column) -> Column:
    """What follows the last slash (TX16)."""
    return F.substring_index(c, "/", -1)


def context(chunk_id: Column, path: Column, page: Column, text: Column, none: str = "-") -> Column:
    """``[id] section: path, page: n`` and the text below it (TX15)."""
    where = F.when(F.coalesce(path, F.lit("")) == "", F.lit(none)).otherwise(path)
    return F.concat(F.lit("["), chunk_id, F.lit("] section: "), where, F.lit(", page: "), page.cast("string"), F.lit("\n"), text)


def eval_query(c: Column) -> Column:
    """First two sentences of the squeezed text, cut to 140; null where text or query is short (ME8, FL7)."""
    text = squeeze(c)
    query = F.substring(F.array_join(F.slice(sentences(text), 1, 2), " "), 1, 140)
    return F.when((F.length(text) >= 250) & (F.length(query) >= 40), query)


def pack_paragraphs(c: Column, size: int = 600, overlap: int = 80) -> Column:
    """Pieces of at most ``size`` characters: whole paragraphs packed greedily, longer ones in windows (CK3, CK4)."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def close(acc: Column) -> Column:
        return F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))

    def add(acc: Column, p: Column) -> Column:
        long = F.length(p) > size
        fits = F.length(acc["open"]) + F.length(p) + 2 <= size
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit("\n\n"), p))
        done = F.when(long, F.concat(close(acc), windows(p, size, overlap))).when((acc["open"] == "") | fits, acc["done"]).otherwise(close(acc))
        opened = F.when(long, F.lit("")).when((acc["open"] == "") | fits, joined).otherwise(p)
        return F.struct(done.alias("done"), opened.alias("open"))

    return F.aggregate(paragraphs(c), empty, add, close)


def windows(c: Column, size: int = 600, overlap: int = 80) -> Column:
    """Windows of ``size`` characters that start ``size - overlap`` apart, stripped; the last one reaches the end (CK4)."""
    step = size - overlap
    n = F.when(F.length(c) <= size, F.lit(1)).otherwise(F.ceil((F.length(c) - size) / step).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: strip(F.substring(c, i * step + 1, F.lit(size))))
