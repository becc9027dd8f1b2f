"""Toxicity by cumulative-link ordinal regression on sparse text features (operator 8).

``P(grade > k) = sigmoid(w . x - theta_k)``: all thresholds share the weights. ``x`` has one binary entry per
hashed word and per hashed word prefix of ``PREFIXES`` bytes, lower-cased in A-Z, over the whole text. The
output has the probability of each excess and the expected grade, their sum.

Training rows are a bounded sample: of the labelled ids, the ``per_class`` toxic and as many other
ones that come first by hash; where several documents have such an id, the text with the smallest digest is taken. How many of them
have a feature is counted by Spark, and only what the model uses comes to the driver: the at most ``MAX_FEATURES`` features that
depend most on toxicity, and which of them each training row has. Labels are binary, so grades of toxic rows are derived: rows with at
least the median number of such features are grade 2, the others grade 1.
Scoring reads every document and sends the weights, a fixed number of bytes, with the task.

Defined results: null and empty texts have no features and get the scores of an empty ``x`` (not toxic, as the
thresholds are held at or above ``FLOOR``); repeated rows are scored each; a label without a document, with
a null value or with two values is left out; with fewer than two classes nothing is toxic; null ids are scored and never trained on; empty tables
give empty results; texts of any length are scored whole; input columns besides id and text are ignored by ``score`` and kept by ``keep_clean``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shingles import SpanHasher, text_slices, word_bounds
from corpusloom.llm.workspace import Workspace

PREFIXES, GRADES, FLOOR = (4, 5, 6, 7, 8), 3, 1.0
PER_CLASS, EPOCHS, RATE, DECAY, SEED = 3000, 2000, 0.05, 1e-5, 8
CHI_SQUARE, LIFT, MIN_ROWS, MAX_FEATURES = 12.0, 6.0, 4, 10_000
#: A document whose probability of any toxicity reaches this is rejected.
REJECT = 0.5

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _numbers(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and 32-bit feature number of every occurrence, and each text's word count."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(len(bounds) - 1, np.int64)
    starts, ends, counts = word_bounds(data, bounds, ~_LETTER[data])
    spans = SpanHasher(data)
    hashes, owner = [spans(starts, ends)], [np.repeat(np.arange(len(counts)), counts)]
    for n in PREFIXES:
        long = ends - starts > n
        hashes.append(spans(starts[long], starts[long] + n))
        owner.append(owner[0][long])
    return np.concatenate(owner), (np.concatenate(hashes) >> np.uint64(32)).astype(np.uint32), counts


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct feature numbers of each text, and its word count."""
    owner, number, counts = _numbers(data, bounds)
    pairs = np.unique(owner.astype(np.uint64) << np.uint64(32) | number)
    cut = np.searchsorted(pairs >> np.uint64(32), np.arange(1, len(counts)).astype(np.uint64))
    return np.split(pairs.astype(np.uint32), cut), counts


@dataclass
class OrdinalModel:
    keys: np.ndarray  # ascending feature numbers
    weights: np.ndarray  # one per key
    thresholds: np.ndarray  # ascending, GRADES - 1

    def __post_init__(self):
        #: Most occurrences fall through this table of leading bits.
        self.table = np.zeros(1 << 20, bool)
        self.table[self.keys >> 12] = True

    def excess(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """P(grade > k) for each text and k."""
        owner, number, counts = _numbers(data, bounds)
        maybe = self.table[number >> 12]
        owner, number = owner[maybe], number[maybe]
        at = np.minimum(np.searchsorted(self.keys, number), max(0, len(self.keys) - 1))
        hit = self.keys[at] == number if len(self.keys) else np.zeros(len(number), bool)
        pairs = np.unique(owner[hit] * max(1, len(self.keys)) + at[hit])
        z = np.bincount(pairs // max(1, len(self.keys)), self.weights[pairs % max(1, len(self.keys))], len(counts))
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -50, 50)))


def derive_grades(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Grade 0 for the others; of toxic rows, 2 for those with at least the median number of the model's features."""
    found = np.array([len(x) for x in rows])
    grades = toxic.astype(np.int64)
    if (toxic == 1).any():
        grades[(toxic == 1) & (found >= np.median(found[toxic == 1]))] = 2
    return grades


@dataclass
class Problem:
    """Rows as positions in the model's features, with their grades and weights in the likelihood."""

    owner: np.ndarray
    index: np.ndarray
    grades: np.ndarray
    share: np.ndarray
    features: int

    @classmethod
    def of(cls, rows: list[np.ndarray], grades: np.ndarray, features: int) -> Problem:
        owner = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        index = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
        share = np.where(grades > 0, 0.5 / max(1, (grades > 0).sum()), 0.5 / max(1, (grades == 0).sum()))
        return cls(owner, index, grades, share, features)

    def loss_and_slope(self, free: np.ndarray) -> tuple[float, np.ndarray]:
        """Weighted mean negative log likelihood with decay on the weights, and its gradient; ``free`` is weights, then thresholds."""
        w, theta = free[: self.features], free[self.features :]
        n, each = len(self.grades), np.arange(len(self.grades))
        z = np.bincount(self.owner, w[self.index], n)
        above = 1 / (1 + np.exp(np.clip(theta[None, :] - z[:, None], -50, 50)))
        padded = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], 1)
        p = np.maximum(padded[each, self.grades] - padded[each, self.grades + 1], 1e-9)
        slope = padded * (1 - padded)
        dz = -(slope[each, self.grades] - slope[each, self.grades + 1]) / p * self.share
        dtheta = np.zeros(len(theta))
        for k in range(len(theta)):
            sign = (self.grades == k + 1) * 1.0 - (self.grades == k) * 1.0
            dtheta[k] = (sign * slope[:, k + 1] / p * self.share).sum()
        dw = np.bincount(self.index, dz[self.owner], self.features) + DECAY * w
        return float(-(np.log(p) * self.share).sum() + DECAY / 2 * (w * w).sum()), np.concatenate([dw, dtheta])


def fit(keys: np.ndarray, rows: list[np.ndarray], grades: np.ndarray) -> OrdinalModel:
    """Full-batch descent with moment estimates on the mean negative log likelihood with classes weighted alike."""
    theta = np.array([FLOOR + k for k in range(GRADES - 1)])
    if len(np.unique(grades > 0)) < 2:
        return OrdinalModel(np.zeros(0, np.uint32), np.zeros(0), theta + 10)
    problem = Problem.of(rows, grades, len(keys))
    free = np.concatenate([np.zeros(len(keys)), theta])
    mean, square = np.zeros(len(free)), np.zeros(len(free))
    for step in range(1, EPOCHS + 1):
        _, slope = problem.loss_and_slope(free)
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope * slope
        free = free - RATE * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
        free[len(keys) :] = np.maximum.accumulate(np.maximum(free[len(keys) :], FLOOR))
    return OrdinalModel(keys, free[: len(keys)], free[len(keys) :])


def _featurize(batches):
    for batch in batches:
        for first, data, bounds in text_slices(batch.column(2)):
            rows, _ = features(data, bounds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, len(rows)), batch.column(1).slice(first, len(rows)), pa.array([x.tobytes() for x in rows], pa.binary())],
                ["id", "toxic", "features"],
            )


def _each_feature(batches):
    for batch in batches:
        for toxic, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            numbers = np.frombuffer(found, np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int64)), pa.array(np.full(len(numbers), toxic, np.int32))], ["feature", "toxic"])


def _restrict(keys: np.ndarray):
    def run(batches):
        for batch in batches:
            rows = [np.flatnonzero(np.isin(keys, np.frombuffer(x, np.uint32), assume_unique=True)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tolist() for x in rows], pa.list_(pa.int32()))], ["id", "toxic", "at"])

    return run


def sample_rows(docs: DataFrame, labels: DataFrame, ws: Workspace, per_class: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, toxic, features)`` of the training rows, one per id."""
    clean = labels.filter(F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
    clean = clean.filter((F.col("toxic") == F.col("other")) & F.col("id").isNotNull() & F.col("toxic").isin(0, 1))
    order = F.xxhash64("id", F.lit(SEED)), F.col("id")
    picked = [clean.filter(F.col("toxic") == side).orderBy(*order).limit(per_class) for side in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]).select("id", F.col("toxic").cast("int").alias("toxic")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(sample, "id")
    one = found.groupBy("id", "toxic").agg(F.min_by("text", F.sha2(F.col("text").cast("binary"), 256)).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return ws.save(one.mapInArrow(_featurize, f"id {kind}, toxic int, features binary"), "features")


def train(
    docs: DataFrame, labels: DataFrame, ws: Workspace, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text"
) -> OrdinalModel:
    """Fit on at most ``per_class`` toxic and ``per_class`` other labelled documents."""
    rows = sample_rows(docs, labels, ws, per_class, id_col, text_col)
    sizes = {r["toxic"]: float(r["n"]) for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    other, ones = sizes.get(0, 0.0), sizes.get(1, 0.0)
    counted = rows.select("toxic", "features").mapInArrow(_each_feature, "feature bigint, toxic int")
    counted = counted.groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
    n, total = other + ones, F.col("t") + F.col("o")
    spread = F.greatest(total * (n - total) * ones * other / max(n, 1.0), F.lit(1e-9))
    chi = (F.col("t") * n - total * ones) ** 2 / spread
    lift = F.col("t") / max(1.0, ones) / ((F.col("o") + 0.5) / max(1.0, other))
    # features that depend on toxicity and that toxic rows have LIFT times as often
    marking = counted.select("feature", chi.alias("chi"), lift.alias("lift"), "t").filter((F.col("chi") >= CHI_SQUARE) & (F.col("lift") >= LIFT) & (F.col("t") >= MIN_ROWS))
    best = marking.orderBy(F.desc("chi"), "feature").limit(MAX_FEATURES).select("feature").collect()
    keys = np.sort(np.array([r["feature"] for r in best], np.int64)).astype(np.uint32)
    kind = rows.schema["id"].dataType.simpleString()
    found = sorted(rows.mapInArrow(_restrict(keys), f"id {kind}, toxic int, at array<int>").collect(), key=lambda r: r["id"])
    toxic = np.array([r["toxic"] for r in found], np.int64)
    positions = [np.array(r["at"], np.int64) for r in found]
    return fit(keys, positions, derive_grades(positions, toxic))


def _score(model: OrdinalModel):
    def run(batches):
        for batch in batches:
            for first, data, bounds in text_slices(batch.column(1)):
                over = model.excess(data, bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(over)),
                        pa.array(over.sum(1)),
                        pa.array((over >= 0.5).sum(1).astype(np.int32)),
                        pa.array(over[:, 0]),
                        pa.array(over[:, 0] >= REJECT),
                    ],
                    ["id", "expected_severity", "grade", "p_toxic", "toxic"],
                )

    return run


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``expected_severity``, ``grade``, ``p_toxic``, ``toxic``."""
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(
        _score(model), f"id {kind}, expected_severity double, grade int, p_toxic double, toxic boolean"
    )
    return out.withColumnRenamed("id", id_col)


def _clean(model: OrdinalModel, position: int):
    def run(batches):
        for batch in batches:
            for first, data, bounds in text_slices(batch.column(position)):
                over = model.excess(data, bounds)
                yield batch.slice(first, len(over)).filter(pa.array(over[:, 0] < REJECT))

    return run


def keep_clean(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns kept, whose documents are not toxic."""
    return docs.mapInArrow(_clean(model, docs.columns.index(text_col)), docs.schema)
