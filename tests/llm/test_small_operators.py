"""Hand-made and brute-force rows for the operators: nulls, empties, ties, repeated rows, empty tables, extra columns."""

import base64
import gzip
import hashlib
import itertools
import re
import urllib.parse
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from corpusloom.llm import components, decontam, exact_dedup, license_scan, minhash, packing, registry, secrets, token_counts, tokens, toxicity, url_filter, warc_zstd
from corpusloom.llm.workspace import Workspace

DOCS = "doc_id long, text string, id int, n long, digest string, salt int"
EDGE = [(1, None), (2, ""), (3, " "), (4, "one two"), (5, "one two"), (5, "one two"), (None, "one two"), (6, "a b c d e f"), (7, "A b c d e f"), (8, "long " * 30_000)]


def docs_of(spark, rows=EDGE):
    return spark.createDataFrame([(*r, 0, 0, "x", 1) for r in rows], DOCS)


@pytest.fixture
def ws(spark):
    return Workspace(spark, "test")


# --- exact dedup


def index(spark, ws, name="index"):
    return exact_dedup.DigestIndex(spark, f"t_{ws.path[-12:]}_{name}", f"{ws.path}/{name}", buckets=4)


def test_exact_dedup_of_edges(spark, ws):
    got = exact_dedup.assign(docs_of(spark), index(spark, ws), ws).collect()
    assert len(got) == len(EDGE)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["keep_id"], r["group_size"], r["kept"]))
    assert by[1] == [(2, 2, False)] and by[2] == [(2, 2, True)]
    assert by[4] == [(5, 4, False)] and sorted(by[5]) == [(5, 4, False), (5, 4, True)] and by[None] == [(5, 4, False)]
    assert {r["text_sha256"] for r in got if r["doc_id"] == 6} == {hashlib.sha256(b"a b c d e f").hexdigest()}


def test_exact_dedup_keeps_whole_rows(spark, ws):
    docs = docs_of(spark)
    kept = exact_dedup.keep(docs, exact_dedup.assign(docs, index(spark, ws), ws), ws)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5, 6, 7, 8]


def test_exact_dedup_against_an_earlier_batch(spark, ws):
    own = index(spark, ws)
    exact_dedup.assign(docs_of(spark, [(1, "a"), (2, "b")]), own, ws).collect()
    again = exact_dedup.assign(docs_of(spark, [(9, "a"), (8, "c")]), own, Workspace(spark, "t2")).collect()
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in again} == {(9, 1, False), (8, 8, True)}
    assert own.rows().count() == 3


def test_exact_dedup_of_nothing(spark, ws):
    assert exact_dedup.assign(docs_of(spark, []), index(spark, ws), ws).count() == 0


# --- tokens

ODD = ["a  b", "a \n b", "\n a", " a", "  a", "a ", "don't  stop", "a<|endoftext|> b <|startoftext|>c", "é ́x", "", "a　 b", "x\x1c y", "tab\t tab", "İ Σ ΣΑΣ", "a b", "١٢ x²", "…„x“ y"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunk_memo_matches_the_library(name):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    counts = tokens.ChunkMemo(public_tokenizers.path(name), True)
    ids = tokens.ChunkMemo(public_tokenizers.path(name), False)

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.characters(codec="utf-8", categories=("L", "N", "P", "S", "Z", "Cc", "M")), max_size=40) | st.sampled_from(ODD))
    def check(text):
        want = library.encode(text, add_special_tokens=False).ids
        assert counts.encode_all([text]) == [len(want)]
        assert np.frombuffer(ids.encode_all([text])[0], ids.dtype).tolist() == want

    check()


def test_rank_encoder_matches_the_library():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fast = tokens.ByteLevelIds(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert fast.ranks is not None

    @settings(max_examples=400, deadline=None)
    @given(st.text(max_size=60) | st.text(alphabet="aé ’'.s\n\t<|endoftext>1²ж中", max_size=40) | st.sampled_from(ODD))
    def check(text):
        assert fast.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids

    check()


def test_counts_of_edges_and_cache(spark, ws):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    cache = token_counts.CountCache(spark, f"c_{ws.path[-12:]}", f"{ws.path}/cache", 4)
    for run in range(2):
        got = token_counts.count_tokens(docs_of(spark), cache, Workspace(spark, f"c{run}"), path).collect()
        want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in EDGE]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
        assert spark.read.option("recursiveFileLookup", True).parquet(f"{ws.path}/cache").count() == 6  # nothing is encoded twice
    assert token_counts.count_tokens(docs_of(spark, []), cache, Workspace(spark, "c3"), path).count() == 0


# --- packing


@pytest.mark.parametrize(("total", "tail"), [(0, []), (2048, []), (2049, [2048]), (4095, [2048, 3072, 3584, 3840, 3968, 4032, 4064, 4080, 4088, 4092, 4094])])
def test_cuts(total, tail):
    assert packing.cuts(total, 2048) == (total // 2048, tail)


def test_hilbert_steps_to_neighbours():
    grid = np.array(list(itertools.product(range(8), repeat=3)))
    order = grid[np.argsort(packing.hilbert(grid, 3))]
    assert len(set(packing.hilbert(grid, 3))) == 512
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def check_pieces(pieces, texts, max_len=2048):
    """Every document's ids lie in pieces once, and sequences are gapless and need no padding."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        by[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append(p)
    for doc_id, text in texts.items():
        ids, at = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for p in sorted(by[doc_id], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids))
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == own[0]["sequence_length"] <= max_len and at & (at - 1) == 0


def test_packing_of_edges(spark, ws):
    rows = {i: t for i, t in EDGE if i not in (5, None)}
    pieces, _ = packing.pack(docs_of(spark, list(rows.items())), ws, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    check_pieces(pieces.collect(), rows)


def test_packing_of_repeated_rows_and_nothing(spark, ws):
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces, _ = packing.pack(docs_of(spark), ws, path)
    assert sum(p["length"] for p in pieces.collect() if p["doc_id"] == 5) == 2 * 3
    pieces, _ = packing.pack(docs_of(spark, []), Workspace(spark, "p2"), path)
    assert pieces.count() == 0


# --- secrets

TOKEN = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'


def wrapped():
    b64 = lambda b: base64.b64encode(b).decode()
    quote = urllib.parse.quote
    yield from (TOKEN, quote(TOKEN), quote(quote(TOKEN)), b64(TOKEN.encode()), b64(quote(TOKEN).encode()), b64(gzip.compress(TOKEN.encode())))
    yield from (b64(zlib.compress(b64(TOKEN.encode()).encode())), "".join(f"\\u{ord(c):04x}" for c in TOKEN), quote(b64(b64(TOKEN.encode()).encode())))


@pytest.mark.parametrize("layer", list(wrapped()))
def test_layers_are_unwrapped_and_spans_mapped(layer):
    text = f"àb {layer} z"
    base, spans = secrets.find_secrets(text)
    assert set(base) <= set(spans)
    kinds = {k for _, _, k in spans}
    assert {0, 2} <= kinds
    assert all(3 <= a < b <= 3 + len(layer) for a, b, _ in spans)


def test_base_spans_consume_short_matches():
    assert secrets.find_secrets("secret: token: abcdefghijklmnop") == ([], [])
    assert [(a, b) for a, b, k in secrets.find_secrets("x AKIAABCDEFGHIJKLMN AKIASHORT")[0]] == [(2, 20)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="tokenSECRT=: \"'abcdef0123456789AKIZ%\\u", max_size=80))
def test_base_spans_by_the_letter(text):
    want = [(m.start(), m.end(), 0) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 12]
    want += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    want += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    assert secrets.find_secrets(text)[0] == sorted(want, key=lambda s: (s[0], s[2]))


def test_secret_rows(spark):
    got = secrets.digest_columns(secrets.scan_documents(docs_of(spark, [*EDGE, (9, TOKEN)])))
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and rows[1]["spans"] == ""
    assert (rows[9]["n_assign"], rows[9]["n_hex"], rows[9]["spans"]) == (1, 1, "assign:0:49,hex:9:49")
    assert got.count() == len(EDGE) + 1 and secrets.digest_columns(secrets.scan_documents(docs_of(spark, []))).count() == 0


# --- decontamination


def test_masks_hit_every_arrangement_of_substitutions():
    for n in range(8, 24):
        masks = [mask for mask, low, high in decontam.masks_for({n}) if low <= n <= high]
        hits = [{i + k for k in mask} for mask in masks for i in range(n - mask[-1])]
        assert all(any(not h & set(sub) for h in hits) for sub in itertools.combinations(range(n), n // 5)), n


def test_leaks_with_substitutions(spark, ws):
    item = [f"word{i}" for i in range(20)]
    changed = ["x" if i in (3, 8, 13, 18) else w for i, w in enumerate(item)]
    half = item[:10] + [f"y{i}" for i in range(10)]
    long = [f"long{i}" for i in range(60)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "too short"), (3, None), (4, " ".join(long)), (1, " ".join(item))], "item_id long, text string")
    rows = [(10, "A " + " ".join(item).upper() + "!"), (11, "so, " + ", ".join(changed)), (12, " ".join(half)), (13, " ".join(long[20:52])), (14, " ".join(long[20:40]))]
    docs = docs_of(spark, EDGE + rows)
    got = decontam.find(docs, bench, ws)
    assert {(r["doc_id"], r["item_id"], r["matched"]) for r in got.collect()} == {(10, 1, 20), (11, 1, 16), (13, 4, 32)}
    clean = decontam.drop_contaminated(docs, bench, Workspace(spark, "d"))
    assert clean.columns == docs.columns and clean.count() == len(EDGE) + 2
    assert decontam.find(docs, bench.limit(0), Workspace(spark, "d")).count() == 0 and decontam.find(docs.limit(0), bench, Workspace(spark, "d")).count() == 0


# --- MinHash


def brute_components(rows, percent):
    """Smallest id reachable over links of full shingle sets."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(lower))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            up[root(i)] = root(j)
    groups = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        groups[root(i)].append(k)
    least = lambda ids: min((x for x in ids if x is not None), default=None)
    return [(k, len(sets[i]), least(groups[root(i)])) for i, (k, _) in enumerate(rows)]


def family(n, words=120, edits=6, seed=1):
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 5000, words)]
    for i in range(n):
        own = list(base)
        for at in rng.integers(0, words, rng.integers(0, edits)):
            own[at] = f"e{rng.integers(0, 10**9)}"
        yield 100 + i, " ".join(own)


@pytest.mark.parametrize("percent", [80, 85])
def test_components_match_brute_force(spark, ws, percent):
    rows = EDGE + list(family(150, seed=percent)) + [(1000 + i, t) for i, t in family(5, words=6, edits=2, seed=4)]
    got = minhash.near_duplicates(docs_of(spark, rows), ws, percent)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect() if r["doc_id"] is not None) == sorted(x for x in brute_components(rows, percent) if x[0] is not None)


def test_block_comparison_is_exact_without_leaders(spark, ws, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 8)
    rows = list(family(80, edits=9, seed=7))
    got = minhash.near_duplicates(docs_of(spark, rows), ws, 85)
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == sorted((a, c) for a, _, c in brute_components(rows, 85))


def test_near_duplicates_of_nothing(spark, ws):
    assert minhash.near_duplicates(docs_of(spark, []), ws).count() == 0


def test_long_chains_are_one_component(spark, ws):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = dict(map(tuple, components.connected_components(edges, ws, "t").collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# --- toxicity


def test_toxicity_learns_marking_words_and_grades(spark, ws):
    rng = np.random.default_rng(3)
    vocabulary = [f"plain{i}" for i in range(400)]
    bad = ["idiot", "moron", "scum", "trash"]
    rows, labels = [], []
    for i in range(600):
        words = list(rng.choice(vocabulary, 40))
        toxic = i % 4 == 0
        for w in rng.choice(bad, 1 + i % 3, replace=False) if toxic else ():
            words[int(rng.integers(0, 40))] = str(w)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    labels += [(0, 1), (1, None), (None, 1), (5000, 1), (3, 1)]  # repeated, null, unknown, contradicting
    docs = docs_of(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), ws)
    probe = docs_of(spark, [(1, None), (2, ""), (3, "plain1 you MORON, plain2"), (4, "idiot moron scum trash"), (5, "plain3 plain4")])
    got = {r["doc_id"]: r for r in toxicity.score(probe, model).collect()}
    assert [got[i]["toxic"] for i in range(1, 6)] == [False, False, True, True, False]
    assert got[4]["expected_severity"] > got[3]["expected_severity"] > 1 / 2 > got[5]["expected_severity"]
    assert sorted(r["doc_id"] for r in toxicity.keep_clean(probe, model).collect()) == [1, 2, 5]
    assert toxicity.score(probe.limit(0), model).count() == 0


def test_one_class_rejects_nothing(spark, ws):
    docs = docs_of(spark)
    model = toxicity.train(docs, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int"), ws)
    assert toxicity.score(docs, model).filter("toxic").count() == 0


def test_held_out_accuracy(spark, ws):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels.filter("doc_id % 3 != 0"), ws)
    held = toxicity.score(docs, model).join(labels.filter("doc_id % 3 = 0").withColumnRenamed("toxic", "label"), "doc_id").collect()
    hit = sum(r["toxic"] and r["label"] == 1 for r in held)
    assert hit >= 0.9 * sum(r["label"] for r in held)
    assert sum(r["toxic"] and r["label"] == 0 for r in held) <= 0.02 * len(held)


# --- URLs


def test_hosts_paths_and_rules(spark):
    urls = [None, "", "no scheme", "https://EXAMPLE.org/es/x?q#f", "http://a.example.org/en/17", "http://badexample.org/x", "http://x.com/fr/", "http://x.com", "a://b://c/d", "http://www.casino-win.example.net/en/5", "http://ÄB.net/é\n/2?x"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rows = {r["page_id"]: r for r in url_filter.judge(pages, [0.0] * (url_filter.BUCKETS) + [-1.0], registry.URL_RULES).collect()}
    got = [(rows[i]["host"], rows[i]["path"], rows[i]["rule"], rows[i]["verdict"]) for i in range(len(urls))]
    assert got[:3] == [("", "", None, "allow")] * 3
    assert got[3:8] == [("example.org", "/es/x", "example.org/es/", "block"), ("a.example.org", "/en/17", "example.org/en/1", "block"), ("badexample.org", "/x", "org/", "allow"), ("x.com", "/fr/", "com/fr/", "allow"), ("x.com", "", None, "allow")]
    assert got[8][:2] == ("b:", "//c/d") and got[10][:2] == ("Äb.net", "/é\n/2")


def test_url_model(spark, ws):
    weights = url_filter.train(url_filter.seed_labels(spark), ws)
    pages = spark.createDataFrame([(1, "http://blog.free-bets.example.net/en/3"), (2, "http://therti.example.net/en/3")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, weights, []).collect()}
    assert got == {1: "block", 2: "allow"}
    nothing = url_filter.train(spark.createDataFrame([(None, 1)], "url string, blocked int"), Workspace(spark, "u"))
    assert not any(nothing)


# --- WARC


def test_warc_round_trip(spark, ws):
    rows = [(1, "http://a/", "<p>é</p>"), (2, "http://b/\r\nX: y", "<p>é</p>"), (3, None, None), (4, "http://d/", ""), (4, "http://d/", ""), (None, "http://e/", "<p>é</p>"), (5, "http://f/", "x" * 300_000), (6, "u", "WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, owner int")
    folder = ws.mkdirs("archives")
    manifest = warc_zstd.write_pages(pages, ws, folder, archive_bytes=1000).collect()
    assert sum(m["records"] for m in manifest) == len(rows)
    got = warc_zstd.read_pages(spark, folder).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"]) for r in got) == sorted((str(i), len((t or "").encode()), digest(t)) for i, _, t in rows)
    kinds = defaultdict(list)
    for r in got:
        kinds[r["page_id"]].append((r["record_type"], r["refers_to"]))
    assert kinds[2] == [("response", None)] and kinds[1] == kinds[None] == [("revisit", 2)]
    assert sorted(kinds[4]) == [("response", None), ("revisit", 4)] and kinds[3] == [("revisit", 4)]
    assert warc_zstd.write_pages(pages.limit(0), Workspace(spark, "w"), ws.mkdirs("none")).count() == 0


def test_archive_has_its_dictionary():
    records = [warc_zstd.record(i, "u", f"<html><body>{i} common words of every page {i * i}</body></html>".encode(), "D", True, i) for i in range(400)]
    data, size = warc_zstd.write_archive(records)
    assert data[:4] == b"\x5d\x2a\x4d\x18" and size > 0
    assert [h["x-page-id"] for h, _ in warc_zstd.read_archive(data)] == [str(i) for i in range(400)]


# --- licences


def test_licences_and_inheritance(spark, ws):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, "a/LICENSE", mit), (2, "a/b/c/x", "text"), (3, "a/b/LICENSE", apache), (4, "a/y", None), (5, "top", ""), (6, None, "text"),
        (7, "a/b/z", "some prose of many words that goes on and on and on and on and on for long\n" + mit), (8, "q/r", "a licence of no kind that we know of"), (2, "a/b/c/x", "text"),
    ]
    files = spark.createDataFrame([(*r, "o", "d") for r in rows], "doc_id long, path string, text string, own string, dir string")
    got = [(r["doc_id"], r["licence"], r["origin"], r["directory"]) for r in license_scan.resolve(license_scan.own_licences(files, ws), ws).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, "MIT", "own", None), (2, "Apache-2.0", "inherited", "a/b"), (2, "Apache-2.0", "inherited", "a/b"), (3, "Apache-2.0", "own", None), (4, "MIT", "inherited", "a"), (5, None, None, None), (6, None, None, None), (7, "MIT", "own", None), (8, None, None, None)], key=str,
    )
    assert license_scan.resolve(license_scan.own_licences(files.limit(0), Workspace(spark, "l0")), Workspace(spark, "l")).count() == 0


# --- pipeline


def test_pipeline_stages_keep_clean_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = Workspace(spark, name).save(stage(spark, docs, sf), "out")
        assert docs.columns == columns
        left = {r["doc_id"] for r in docs.collect()}
        if name == "exact_dedup":
            assert left == {max(i for i, t in rows if t == u) for u in {t for _, t in rows}}
        if name == "near_dedup":
            assert left == {k for k, _, c in brute_components(rows, 80) if k == c}
        if name == "decontamination":
            norm = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
            items = [norm(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert not [i for i, t in rows if i in left and any(x in norm(t) for x in items)]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    check_pieces(corpus_pipeline.pack(spark, docs, sf).collect(), texts)


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
