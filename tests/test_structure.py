"""Sections, chunks, contexts and pairs of all documents against plain-Python versions of the rules."""

from collections import defaultdict

import pytest

from corpusloom.operators import datasets, structure
from corpusloom.plans import queries
from tests.test_text import greedy

SF = "/root/testdata/sf0.001"


class Node:
    def __init__(self, title, level, page):
        self.title, self.level, self.page, self.text, self.below = title, level, page, "", []


def tree(blocks):
    root = Node("", 0, 0)
    path, now = [root], root
    for b in blocks:
        if b["type"] == "heading" and b["level"] >= 1:
            now = Node(b["text"], b["level"], b["page"])
            while path[-1].level >= now.level:
                path.pop()
            path[-1].below.append(now)
            path.append(now)
        elif b["type"] == "paragraph":
            now.text = f"{now.text}\n\n{b['text']}" if now.text else b["text"]
    return root.below


@pytest.fixture(scope="module")
def trees(spark):
    by = defaultdict(list)
    for b in queries.merge_paragraphs(spark, SF).orderBy("doc_id", "pos").collect():
        by[b["doc_id"]].append(b)
    return {k: tree(v) for k, v in by.items()}


def test_chunks(spark, trees):
    want = []
    for doc, tops in trees.items():
        count = 0

        def walk(nodes, path, parent):
            nonlocal count
            for n in nodes:
                own = parent
                if n.text.strip():
                    count += 1
                    own = f"{doc}__{count:05d}"
                    want.append((own, parent, n.text[:2400], " > ".join([*path, n.title]), True, None))
                    for i, piece in enumerate(greedy(n.text)):
                        count += 1
                        want.append((f"{doc}__{count:05d}", own, piece, " > ".join([*path, n.title]), False, i))
                walk(n.below, [*path, n.title], own)

        walk(tops, [], None)
    got = [(r["chunk_id"], r["parent_id"], r["text"], r["section_path"], r["is_section"], r["piece"]) for r in queries.section_chunks(spark, SF).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_greedy_pack(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = [(r["doc_id"], i, p) for r in rows for i, p in enumerate(greedy(r["text"].replace("\n", "\n\n")))]
    assert sorted(map(tuple, queries.greedy_pack(spark, SF).collect())) == sorted(want)


def test_parent_jump(spark):
    chunks = {r["chunk_id"]: r for r in queries.section_chunks(spark, SF).collect()}
    rows = queries.parent_jump(spark, SF).collect()
    assert len(rows) == sum(not c["is_section"] for c in chunks.values())
    assert all(r["context_id"] == chunks[r["chunk_id"]]["parent_id"] and r["context_text"] == chunks[r["context_id"]]["text"] for r in rows)


def test_focused_contexts(spark, trees):
    def titles(n):
        return [n.title, *(t for b in n.below for t in titles(b))]

    def render(nodes, depth, focus):
        for n in nodes:
            if focus is None or any(focus in t for t in titles(n)):
                if n.text.strip():
                    yield "  " * depth + f"### {n.title}\n{n.text}"
                yield from render(n.below, depth + 1, focus)

    secs = structure.sections(structure.merge_paragraphs(structure.classify(queries._spans(spark.read.parquet(f"{SF}/documents.parquet")))))
    focus = secs.selectExpr("doc_id", "title as focus").unionByName(secs.selectExpr("doc_id", "'no such title' as focus")).distinct()
    rows = datasets.focused_context(secs, focus).collect()
    assert len(rows) == focus.count()
    for r in rows:
        parts = list(render(trees[r["doc_id"]], 0, r["focus"])) or list(render(trees[r["doc_id"]], 0, None))
        assert r["context"] == "\n\n".join(parts)[:2000]


def test_preference_pairs(spark):
    rows = queries.pref_pairs(spark, SF).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["qid"]].append(r["kind"])
        assert r["rejected"].strip() != r["chosen"].strip()
        assert "[chunk_" in r["chosen"]
        if r["kind"] != "numbers":
            assert "[chunk_1]" not in r["rejected"]
    assert all(len(set(k)) == 2 for k in by.values())


def test_rotated_steps(spark):
    for r in queries._qa(spark, SF).join(queries.pref_rotate(spark, SF), "qid").collect():
        assert sorted(r["answer"].split("\n")) == sorted(r["rejected"].split("\n"))


def test_messages(spark):
    assert all(r["rendered"].count("<|im_start|>") == 3 and r["rendered"].endswith("<|im_end|>\n") for r in queries.sft_messages(spark, SF).collect())
    assert all(r["prompt"].endswith("<|im_start|>assistant\n") and r["chosen"] != r["rejected"] for r in queries.pref_messages(spark, SF).collect())
