"""Packing along a space-filling curve (operator 4).

Each document's ids are hashed to a term vector, projected to three dimensions and given a Hilbert
key; documents are range-sorted by it and cut, in that order, into sequences of ``max_len`` ids. A
document may be cut anywhere, so every sequence but the last is full; what is left at the very end is
cut into sequences of power-of-two lengths, which need no padding either.

The order is fixed by a range exchange of keys and lengths whose tasks also number their ids from 0. Where a
task's ids begin in the whole order follows from the tasks' totals, one number per task. The encoded documents
are written once and moved once, to meet their places. Equal keys are ordered by id, and the exchange ranges over both, so a large group of copies is
dealt over many tasks.

Defined results: a null or empty text is the end id alone; repeated rows are packed as often as they
occur; null ids are kept; an empty table gives no pieces; input columns besides id and text are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import tokens
from corpusloom.llm.workspace import Workspace

DIMS, BITS, BUCKETS, SEED = 3, 10, 1024, 20
PIECES = (
    "doc_id {id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, sequence_length bigint"
)


@lru_cache(maxsize=1)
def projection() -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((BUCKETS, DIMS))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of non-negative integer points (one per row), as int64."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations from the coarsest level down
        p = q - 1
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(vectors: np.ndarray) -> np.ndarray:
    """Hilbert keys of hashed term counts (documents x BUCKETS)."""
    weights = np.sqrt(vectors)
    norms = np.maximum(np.sqrt((weights**2).sum(1, keepdims=True)), 1e-12)
    spread = np.clip((weights / norms) @ projection() / 6 + 0.5, 0, 1 - 1e-9)
    return hilbert((spread * (1 << BITS)).astype(np.int64))


def _encode(path: str, rank_path: str | None, end_id: int):
    def run(batches):
        encoder = tokens.byte_level(path, rank_path)
        for batch in batches:
            for part in (batch.slice(i, 100) for i in range(0, batch.num_rows, 100)):
                ids = [np.append(encoder.encode(t or ""), encoder.dtype.type(end_id)) for t in part.column(1).to_pylist()]
                hashed = np.stack([np.bincount(x % BUCKETS, minlength=BUCKETS) for x in ids])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(curve_keys(hashed)), pa.array([x.tobytes() for x in ids], pa.binary())],
                    ["doc_id", "curve_key", "ids"],
                )

    return run


def _number(batches):
    """Number the ids of a task's documents from 0."""
    part, start = TaskContext.get().partitionId(), 0
    for batch in batches:
        sizes = batch.column(1).to_numpy()
        ends = start + np.cumsum(sizes)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([part] * len(sizes), pa.int32()), pa.array(ends - sizes), batch.column(1)],
            ["row", "part", "part_start", "doc_tokens"],
        )
        start = int(ends[-1]) if len(ends) else start


def cuts(total: int, max_len: int) -> tuple[int, list[int]]:
    """Number of full sequences, and the starts of the power-of-two ones that hold the rest."""
    full, rest = divmod(total, max_len)
    starts, at = [], full * max_len
    for bit in range(max_len.bit_length(), -1, -1):
        if rest >> bit & 1:
            starts.append(at)
            at += 1 << bit
    return full, starts


def _cut(bases: dict[int, int], total: int, max_len: int, dtype: str):
    full, tail = cuts(total, max_len)
    tail_ends = [*tail[1:], total]

    def run(batches):
        for batch in batches:
            rows = {k: [] for k in ("i", "start", "length", "crc", "doc_tokens", "seq", "offset", "seq_len")}
            cols = [batch.column(k).to_pylist() for k in range(1, 5)]
            for i, (ids, part, part_start, n) in enumerate(zip(*cols, strict=True)):
                whole = np.frombuffer(ids, dtype).astype("<u4")
                first = bases[part] + part_start
                at = first
                while at < first + n:
                    if at < full * max_len:
                        seq, begin = at // max_len, at // max_len * max_len
                        end = begin + max_len
                    else:
                        k = max(j for j, s in enumerate(tail) if s <= at)
                        seq, begin, end = full + k, tail[k], tail_ends[k]
                    stop = min(end, first + n)
                    piece = whole[at - first : stop - first]
                    for k, v in zip(rows, (i, at - first, stop - at, zlib.crc32(piece.tobytes()), n, seq, at - begin, end - begin), strict=True):
                        rows[k].append(v)
                    at = stop
            docs = batch.column(0).take(pa.array(rows.pop("i"), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [docs, *(pa.array(v, pa.int64()) for v in rows.values())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"],
            )

    return run


def pack(
    docs: DataFrame,
    ws: Workspace,
    tokenizer_path: str,
    rank_path: str | None = None,
    max_len: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """The pieces of all sequences, and the encoded documents ``(doc_id, ids, ...)`` in curve order."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    kind = docs.schema[id_col].dataType.simpleString()
    dtype = tokens.byte_level(tokenizer_path, None).dtype
    coded = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        _encode(tokenizer_path, rank_path, end_id), f"doc_id {kind}, curve_key bigint, ids binary"
    )
    # written once; a range exchange would run the encoder twice, and ordering needs the keys alone
    coded = ws.save(coded.withColumn("row", F.monotonically_increasing_id()), "coded")
    keys = coded.select("row", (F.octet_length("ids") / dtype.itemsize).cast("long").alias("n"), "curve_key", "doc_id")
    ranged = keys.repartitionByRange("curve_key", "doc_id").sortWithinPartitions("curve_key", "doc_id", "n", "row")
    numbered = ws.save(
        ranged.select("row", "n").mapInArrow(_number, "row bigint, part int, part_start bigint, doc_tokens bigint"), "order"
    )
    totals = numbered.groupBy("part").agg(F.max(F.col("part_start") + F.col("doc_tokens")).alias("n"))
    bases, total = {}, 0
    for row in sorted(totals.collect()):  # one number per task of the range exchange
        bases[row["part"]], total = total, total + row["n"]
    placed = coded.join(numbered, "row").select("doc_id", "ids", "part", "part_start", "doc_tokens")
    pieces = placed.mapInArrow(_cut(bases, total, max_len, dtype.str), PIECES.format(id=kind))
    return pieces.withColumnRenamed("doc_id", id_col), placed
