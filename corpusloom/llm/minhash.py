"""Near-duplicate groups by MinHash (operator 9).

1. Every text gives its set of 5-word shingles, a digest of that set and ``bands * ROWS`` minima under
   universal hash functions. Texts with equal sets form a class, and only classes go on.
2. Classes that agree in all rows of a band share a bucket. In each bucket every class is compared to
   the bucket's smallest one: signatures first, then the full sets.
3. The links found so far give components. Two classes of a bucket that are in the same component need no
   comparison; the rest of each bucket (all that is outside its most frequent component, against all of
   its members) is compared in blocks of bounded size, signatures first and full sets after. No pair of
   a bucket is left out, and a bucket of linked copies costs one comparison per member.
4. The links of 2 and 3 together give the components, by large-star and small-star.

A pair is missed only if no band holds both, which for a pair at the threshold has a probability below
``MISS``, or if its signatures agree in fewer rows than six standard deviations below the expectation.

Defined results: null and empty texts, and texts without words, have no shingles and are linked with
nothing; a text of fewer than five words has its whole sequence as the one shingle; repeated rows and
equal texts are one class and all named by the smallest id; null ids are never a component's name unless
all its ids are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.components import connected_components
from corpusloom.llm.shingles import mix, shingle_sets, text_slices
from corpusloom.llm.workspace import Workspace, salted_lookup

WORDS, ROWS, MISS, SEED = 5, 4, 1e-7, 9
#: A block holds about this many queries and members, or fewer where their sets would pass BLOCK_SHINGLES.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1_000_000
#: Candidate ids up to this number (at most about 100 bytes each) are broadcast to the documents; beyond it they are joined.
BROADCAST_IDS = 1_000_000


def band_count(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def least_agreeing(percent: int) -> int:
    """Agreeing rows that a pair at the threshold has but for six standard deviations."""
    n, p = band_count(percent) * ROWS, percent / 100
    return math.floor(n * p - 6 * math.sqrt(n * p * (1 - p)))


def _signature(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of ``(a * x + b) >> 32`` over 32-bit keys, in blocks of bounded size."""
    out = np.full(len(a), 2**64 - 1, np.uint64)
    for i in range(0, len(keys), 8192):
        np.minimum(out, (a[:, None] * keys[i : i + 8192] + b[:, None]).min(1), out=out)
    return (out >> np.uint64(32)).astype("<u4")


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band of each signature (rows x hashes)."""
    rows = signatures.reshape(len(signatures), -1, ROWS).astype(np.uint64)
    key = np.arange(rows.shape[1], dtype=np.uint64)[None, :] + np.uint64(1)
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, j])
    return key.view(np.int64)


def _digest(keys: np.ndarray) -> bytes:
    return hashlib.blake2b(keys.tobytes(), digest_size=16).digest()


def _sign(percent: int):
    def run(batches):
        rng = np.random.default_rng(SEED)
        a, b = (rng.integers(0, 2**64, band_count(percent) * ROWS, dtype=np.uint64) for _ in range(2))
        for batch in batches:
            for first, data, bounds in text_slices(batch.column(1)):
                sets = shingle_sets(data, bounds, WORDS)
                signed = [_signature(s & np.uint64(0xFFFFFFFF), a, b).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array(signed, pa.binary()),
                    ],
                    ["id", "n", "digest", "signature"],
                )

    return run


def _bands(batches):
    for batch in batches:
        nodes, sizes = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        if not len(nodes):
            continue
        keys = band_keys(np.stack([np.frombuffer(x, "<u4") for x in batch.column(1).to_pylist()]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(nodes, keys.shape[1])), pa.array(keys.ravel()), pa.array(np.repeat(sizes, keys.shape[1]))],
            ["node", "bucket", "n"],
        )


def _resets(batches):
    for batch in batches:
        for first, data, bounds in text_slices(batch.column(1)):
            sets = shingle_sets(data, bounds, WORDS)
            yield pa.RecordBatch.from_arrays(
                [pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["digest", "shingles"],
            )


def _agree(least: int):
    def run(batches):
        for batch in batches:
            x, y = ([np.frombuffer(v, "<u4") for v in batch.column(k).to_pylist()] for k in (2, 3))
            if x:
                yield batch.filter(pa.array((np.stack(x) == np.stack(y)).sum(1) >= least)).select([0, 1])

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            x, y = ([np.frombuffer(v, np.uint64) for v in batch.column(k).to_pylist()] for k in (2, 3))
            yield batch.filter(pa.array([_linked(p, q, percent) for p, q in zip(x, y, strict=True)], pa.bool_())).select([0, 1])

    return run


def _blocks(batches):
    """The rows of each block (bucket, qc, mc), which lie together in the sorted input, as one table."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
        edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for start, end in zip([0, *edges], [*edges, len(keys)], strict=True):
            now = tuple(keys[start])
            if now != key and held:
                yield pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def _open_pairs(t: pa.Table, percent: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of queries, rows of members, and which pairs of them are still to be compared in this block."""
    query, member = (np.flatnonzero(t.column(k).to_numpy(zero_copy_only=False)) for k in ("query", "member"))
    comp, size = t.column("comp").to_numpy(), t.column("n").to_numpy()
    bucket = t.column("bucket")[0].as_py()
    todo = comp[query][:, None] != comp[member][None, :]
    small = np.minimum(size[query][:, None], size[member][None, :])
    todo &= 100 * small >= percent * np.maximum(size[query][:, None], size[member][None, :])
    if todo.any():
        signed = np.stack([np.frombuffer(x, "<u4") for x in t.column("signature").to_pylist()])
        keys = band_keys(signed)
        band = int(np.flatnonzero(keys[0] == bucket)[0])
        for j in range(band):  # a pair is compared in the first band that holds both
            todo &= keys[query, j][:, None] != keys[member, j][None, :]
        agree = np.zeros(todo.shape, np.int16)
        for j in range(signed.shape[1]):
            agree += signed[query, j][:, None] == signed[member, j][None, :]
        todo &= agree >= least
    return query, member, todo


def _survivors(percent: int, least: int):
    def run(batches):
        for t in _blocks(batches):
            query, member, todo = _open_pairs(t, percent, least)
            rows = np.union1d(query[todo.any(1)], member[todo.any(0)])
            if len(rows):
                yield from t.select(["bucket", "qc", "mc", "node", "comp", "query", "member"]).take(pa.array(rows)).to_batches()

    return run


def _block_links(percent: int, least: int):
    def run(batches):
        for t in _blocks(batches):
            query, member, todo = _open_pairs(t, percent, least)
            nodes, comp = t.column("node").to_numpy(), t.column("comp").to_numpy()
            sets = t.column("shingles").to_pylist()
            size = t.column("n").to_numpy()
            members = [np.frombuffer(sets[m], np.uint64) for m in member]
            keys = np.concatenate(members)
            owner = np.repeat(np.arange(len(member)), [len(x) for x in members])
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            found = []
            for i, q in enumerate(query):
                if not todo[i].any():
                    continue
                own = np.frombuffer(sets[q], np.uint64)
                low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
                n = high - low
                hits = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                common = np.bincount(owner[hits], minlength=len(member))
                ok = todo[i] & (100 * common >= percent * (len(own) + size[member] - common))
                # one link to each other component joins them
                _, first = np.unique(comp[member[ok]], return_index=True)
                found += [(int(nodes[q]), int(m)) for m in nodes[member[ok]][first]]
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def near_duplicates(
    docs: DataFrame, ws: Workspace, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked where ``100 * |intersection| >= percent * |union|`` of their shingle sets.
    """
    least = least_agreeing(percent)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = ws.save(
        source.mapInArrow(_sign(percent), f"id {kind}, n bigint, digest binary, signature binary"), "signed"
    )
    classes = signed.filter("n > 0").groupBy("digest").agg(
        F.min("id").alias("top_id"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.first("signature").alias("signature")
    )
    classes = ws.save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    banded = ws.save(classes.select("node", "signature", "n").mapInArrow(_bands, "node bigint, bucket bigint, n bigint"), "banded")
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("leader"))
    shared = ws.save(shared.filter("members > 1").drop("members"), "shared")
    buckets = ws.save(banded.join(shared, "bucket"), "buckets")
    ws.drop("banded")

    sets = _sets(source, classes, buckets, ws)
    star = buckets.filter("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    star = ws.save(star, "star")
    signatures = classes.select("node", "n", "signature")
    sized = _with_ends(star, signatures, ["n", "signature"])
    sized = sized.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    likely = sized.select("a", "b", "signature_a", "signature_b").mapInArrow(_agree(least), "a bigint, b bigint")
    likely = ws.save(likely, "likely")
    compared = _with_ends(likely, sets.select("node", "shingles"), ["shingles"])
    links = ws.save(
        compared.select("a", "b", "shingles_a", "shingles_b").mapInArrow(_confirm(percent), "a bigint, b bigint"), "links"
    )
    first = ws.save(connected_components(links, ws, "star-cc"), "first")

    rest = _compare_rest(buckets, first, sets, ws, percent, least)
    every = links.unionByName(rest)
    joined = ws.save(connected_components(every, ws, "cc"), "joined")
    names = joined.join(classes.select("node", "top_id"), "node").groupBy("component").agg(F.min("top_id").alias("component_id"))
    named = joined.join(names, "component").select("node", "component_id")
    owners = classes.select("node", "digest", "size", "top_id").join(named, "node", "left")
    owners = owners.select("digest", "size", "top_id", F.coalesce("component_id", "top_id").alias("component_id"))
    owners = ws.save(owners, "owners")

    rows = signed.filter("n > 0").select("id", "n", "digest")
    found = salted_lookup(rows, owners, "digest", F.monotonically_increasing_id(), F.col("size"))
    found = found.select("id", "n", "component_id")
    empty = signed.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return found.unionByName(empty).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def _with_ends(pairs: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs(a, b)`` with the columns of both ends, suffixed ``_a`` and ``_b``."""
    for end in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns)), end)
    return pairs


def _sets(source: DataFrame, classes: DataFrame, buckets: DataFrame, ws: Workspace) -> DataFrame:
    """``(node, n, signature, shingles)`` of every class that shares a bucket, from one of its texts."""
    wanted = classes.join(buckets.select("node").distinct(), "node", "left_semi")
    wanted = ws.save(wanted.select("node", "digest", "top_id", "n", "signature"), "wanted")
    ids = wanted.select(F.col("top_id").alias("id")).distinct()
    if wanted.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = source.join(ids, source["id"].eqNullSafe(ids["id"]), "left_semi")
    made = texts.mapInArrow(_resets, "digest binary, shingles binary")
    # a text that occurs twice under the class's id gives its set twice
    made = made.join(wanted, "digest").groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "signature", "shingles")))
    return ws.save(made, "sets")


def _compare_rest(
    buckets: DataFrame, first: DataFrame, sets: DataFrame, ws: Workspace, percent: int, least: int
) -> DataFrame:
    """Links among a bucket's members besides its leader that are in different components so far."""
    others = buckets.filter("node != leader").select("bucket", "node", "n").join(first, "node", "left")
    others = ws.save(others.select("bucket", "node", "n", F.coalesce("component", "node").alias("comp")), "others")
    groups = others.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("shingles"))
    active = groups.groupBy("bucket").agg(
        F.max_by("comp", F.struct("k", "comp")).alias("major"),
        F.sum("k").alias("s"),
        (F.sum("k") - F.max("k")).alias("u"),
        F.sum("shingles").alias("all_shingles"),
    )
    chunks = lambda n: F.ceil(F.greatest(F.col(n) / BLOCK_ROWS, F.col("all_shingles") * F.col(n) / F.col("s") / BLOCK_SHINGLES)).cast("int")
    active = ws.save(active.filter("u > 0").select("bucket", "major", chunks("u").alias("nq"), chunks("s").alias("nm")), "active")
    rows = others.join(active, "bucket").select(
        "bucket", "node", "comp", (F.col("comp") != F.col("major")).alias("query"), "nq", "nm"
    )
    dealt = lambda n, salt: F.pmod(F.xxhash64(F.col("node"), F.lit(salt)), F.col(n)).cast("int")
    steps = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    member = rows.select("*", steps("nq").alias("qc"), dealt("nm", 1).alias("mc"), F.lit(True).alias("member"))
    # a single chunk of queries is a part of the members that carry the flag; else queries meet each member chunk
    member = member.withColumn("query", F.col("query") & (F.col("nq") == 1) & (F.col("nm") == 1))
    query = rows.filter("query and (nq > 1 or nm > 1)")
    query = query.select("*", dealt("nq", 0).alias("qc"), steps("nm").alias("mc"), F.lit(False).alias("member"))
    cols = ["bucket", "qc", "mc", "node", "comp", "query", "member"]
    blocks = ws.save(member.select(*cols).unionByName(query.select(*cols)), "blocks")

    def grouped(df: DataFrame) -> DataFrame:
        return df.repartition("bucket", "qc", "mc").sortWithinPartitions("bucket", "qc", "mc")

    head = "bucket bigint, qc int, mc int, node bigint, comp bigint, query boolean, member boolean"
    signed = blocks.join(sets.select("node", "n", "signature"), "node").select(*cols, "n", "signature")
    alive = ws.save(grouped(signed).mapInArrow(_survivors(percent, least), head), "alive")
    full = alive.join(sets, "node").select(*cols, "n", "signature", "shingles")
    return ws.save(grouped(full).mapInArrow(_block_links(percent, least), "a bigint, b bigint"), "rest")
