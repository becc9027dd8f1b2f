"""Hand-made rows for what the tables never hold, and properties of the text functions."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.udfs import corrupt, first_object, nfkc
from corpusloom.operators import datasets, quality, vocab
from corpusloom.plans.config import ChunkConfig, merge


def one(spark, value, *exprs):
    row = spark.createDataFrame([(value,)], "t string").select(*(e(F.col("t")).alias(f"c{i}") for i, e in enumerate(exprs))).first()
    return row[0] if len(exprs) == 1 else tuple(row)


@pytest.mark.parametrize(
    ("raw", "cleaned"),
    [
        ("\\textbf{x}", "x"), ("\\emph y", "y"), ("{z}", "z"), ("a b​c", "a bc"), ("Submitted to A\nnext", "Submitted to A\nnext"),
        ("x Submitted to A", "x"), ("arXiv:1706.03762 v5 [cs.CL] 6 Dec 2017", "Dec 2017"), ("arXiv:1706.03762v5 [cs.CL] 6 Dec 2017", "arXiv:1706.03762v5 [cs.CL] 6 Dec 2017"),
        ("a\n\n\n\nb", "a\n\nb"), ("", ""), (None, None),
    ],
)
def test_clean(spark, raw, cleaned):
    assert one(spark, raw, T.clean_markup) == cleaned


def test_nfkc(spark):
    assert one(spark, "ﬁ１", nfkc) == "fi1"


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ("a" * 79, "short"), ("word " * 20, "few_sentences"), ("word one. " * 9, "ok"), ("aaaaaaaaaa. " * 9, "repetitive"),
        ("12345 6789. 98765 4321. " * 6, "few_letters"), (None, "short"), ("", "short"),
    ],
)
def test_quality(spark, text, reason):
    assert one(spark, text, quality.quality_reason) == reason


def test_common_share_at_half(spark):
    assert one(spark, "ab" * 50, quality.common_share) == 0.5
    assert one(spark, "", quality.common_share) == 0.0


@pytest.mark.parametrize("text", ["abab", "ababa", "aab", "xaaa", "b" * 51 + "a" * 49, "a" * 50 + "b" * 50, "AaA", "", "éé\n\n\n", "abcabc"])
def test_majority_share_agrees_above_one_half(spark, text):
    common, majority = one(spark, text, quality.common_share, quality.majority_share)
    assert (common > 0.5) == (majority > 0.5) and (common == majority or common <= 0.5)


def test_shingle_hash_of_no_tokens(spark):
    assert one(spark, "äöü", T.shingle_hash) == one(spark, None, T.shingle_hash) == "d41d8cd98f00b204e9800998ecf8427e"


def greedy(text, size=600, overlap=80):
    """The packing rule in plain Python."""
    out, held = [], ""
    for p in (p for p in text.split("\n\n") if p.strip()):
        if len(p) > size:
            if held:
                out.append(held)
            held, start = "", 0
            while True:
                out.append(p[start : start + size].strip())
                if start + size >= len(p):
                    break
                start += size - overlap
        elif held and len(held) + 2 + len(p) <= size:
            held += "\n\n" + p
        else:
            if held:
                out.append(held)
            held = p
    return out + ([held] if held else [])


@pytest.mark.parametrize("lengths", [(299, 299), (300, 299), (600,), (601,), (1120,), (1121,), (10, 2000, 20, 30), ()])
def test_packing(spark, lengths):
    text = "\n\n".join(chr(97 + i) * n for i, n in enumerate(lengths))
    assert one(spark, text, T.pack_paragraphs) == greedy(text)


def test_packing_of_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", T.pack_paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("p")).collect()
    assert all(r["p"] == greedy(r["text"].replace("\n", "\n\n")) for r in rows)


def test_overlap_must_be_smaller():
    with pytest.raises(ValueError):
        T.pack_paragraphs(F.lit("x"), 80, 80)
    with pytest.raises(ValueError):
        ChunkConfig(80, 80)


def test_windows_rebuild_the_text(spark):
    text = "".join(chr(33 + i % 90) for i in range(1999))
    pieces = one(spark, text, T.windows)
    assert len(pieces) == 1 + math.ceil((1999 - 600) / 520)
    assert pieces[0] + "".join(p[80:] for p in pieces[1:]) == text


@pytest.mark.parametrize(
    ("text", "json"),
    [
        ('x {"a": "}"} y', '{"a": "}"}'), ('{"a": "\\"}"}', '{"a": "\\"}"}'), ('{bad} {"a": 1}', None), ("none", None), ("{", None), ('{"a": {"b": 1}}}', '{"a": {"b": 1}}'),
    ],
)
def test_first_object(text, json):
    assert first_object(text) == json


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.integers() | st.text(), lambda x: st.dictionaries(st.text(), x, max_size=3), max_leaves=8).filter(lambda x: isinstance(x, dict)), st.text(alphabet="ab\" \\", max_size=5))
def test_first_object_finds_any_object(value, tail):
    import json

    text = json.dumps(value)
    assert first_object("say: " + text + tail) == text


def test_corrupt():
    assert corrupt("50% of", 1) != "50% of"
    assert corrupt("3x chunk_1", 1) == "3x chunk_1"
    assert corrupt("none", 1) == "none"


def test_strip_citations(spark):
    assert one(spark, "a [chunk_1] [chunk_]", T.strip_citations) == "a  [chunk_]"


def test_rotate(spark):
    assert one(spark, "1. a\n2. b\n3. c", datasets.rotate_steps) == "2. b\n3. c\n1. a"
    assert one(spark, "1. a\n2. b", datasets.rotate_steps) == "1. a\n2. b"


def test_assistant_spans(spark):
    start, end = "<|im_start|>assistant", "<|im_end|>"
    text = f"{start}\nab{end} {start}c{end} {start} open"
    assert [text[s["start"] : s["end"]] for s in one(spark, text, datasets.assistant_spans)] == ["ab", "c"]


def test_merge_settings():
    assert merge({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 9}, "d": {"e": 4}}) == {"a": {"b": 9, "c": 2}, "d": {"e": 4}}


def test_addition_order(spark):
    rows = vocab.addition_order(spark.createDataFrame([("bb",), ("aaa",), ("bb",), ("ab",)], "token string")).collect()
    assert [r[0] for r in rows] == ["aaa", "ab", "bb"]
