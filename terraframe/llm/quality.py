"""Quality classifier: a Gaussian kernel over document statistics by random Fourier features.

Statistics of every whole text are computed once and kept as a slim table. The
training rows' features give normal equations, summed within partitions and
then by blocks of rows across them; the driver solves a small ridge system,
with the penalty picked by out-of-fold error. Out-of-fold scores, counted in
bins, are calibrated by isotonic regression.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import id_bucket, shared_dir, table, utf8, written

FEATURES = 256
FOLDS = 4
SEED = 42
#: Resolution of raw scores in calibration.
BINS = 2048
PENALTIES = (1e-4, 1e-3, 1e-2, 1e-1)
#: Rows of the normal equations that are summed as one block.
ROWS = 32
#: Sums that a first level makes of each block, before a second adds those up.
LANES = 64

_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "blank": b" \t",
    "line": b"\n",
    "stop": b".",
    "comma": b",",
    "exclaim": b"!?",
    "bar": b"|",
    "symbol": b"#$%&*@^~=+<>_\\/",
    "quote": b"\"'`()[]{}:;-",
    "high": bytes(range(128, 256)),
}
_TABLE = np.zeros((256, len(_CLASSES)))
for _i, _c in enumerate(_CLASSES.values()):
    _TABLE[list(_c), _i] = 1


def statistics(body: bytes) -> list[float]:
    """The statistics of a whole text; an empty one has zeros."""
    n = len(body)
    if not n:
        return [0.0] * N_STATS
    shares = (np.bincount(np.frombuffer(body, np.uint8), minlength=256) @ _TABLE) / n
    words = body.lower().split()
    m = max(1, len(words))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    sizes = np.array([len(w) for w in words] or [0], float)
    lines = [x for x in body.split(b"\n") if x.strip()] or [b""]
    ends = sum(1 for w in words if not w[-1:].isalnum() and w[-1] < 128)
    bare = sum(1 for w in words if not any(c in w for c in _VOWELS) and len(w) > 2)
    return [
        np.log1p(n),
        np.log1p(len(words)),
        *shares,
        np.log1p(sizes.mean()),
        np.log1p(sizes.std()),
        len(seen) / m,
        np.sqrt(len(seen)) / np.log1p(m) if words else 0.0,
        max(seen.values(), default=0) / m,
        ends / m,
        bare / m,
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        shares[1] / max(1e-9, shares[0] + shares[1]),
    ]


_VOWELS = [bytes([c]) for c in b"aeiouy"]
N_STATS = 2 + len(_CLASSES) + 10


def features(docs: DataFrame) -> DataFrame:
    """``docs`` has ``id`` and the bytes ``body`` and other slim columns, which stay; adds ``x``."""
    names = [c for c in docs.columns if c != "body"]

    def run(batches):
        for b in batches:
            x = [statistics(v.as_py()) for v in b.column("body")]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(x, pa.list_(pa.float64()))], names=[*names, "x"])

    return docs.mapInArrow(run, ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + ", x array<double>")


class Fourier:
    """cos(w x + b) of standardised statistics: inner products approximate a Gaussian kernel."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, features: int = FEATURES, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        # kernel width: the root of the dimension, a typical distance of standardised rows
        self.w = r.standard_normal((len(mean), features)) / np.sqrt(len(mean) / 2)
        self.b = r.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6)
        return np.concatenate([np.ones((len(x), 1)), np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), z / 6], axis=1)


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def _fold(ids) -> np.ndarray:
    return np.array([zlib.crc32(b"fold%d" % (i or 0)) % FOLDS for i in ids])


def normal_equations(train: DataFrame, phi: Fourier) -> tuple[np.ndarray, int]:
    """For each fold the matrix [Z'Z, Z'y; y'Z, y'y] with Z = phi(x), and the number of rows."""
    d = FEATURES + N_STATS + 2

    def local(batches):
        sums, any_ = np.zeros((FOLDS, d, d)), False
        lane = TaskContext.get().partitionId() % LANES
        for b in batches:
            if b.num_rows:
                any_ = True
                z = np.concatenate([phi(_matrix(b)), b.column("y").to_numpy(zero_copy_only=False).astype(float)[:, None]], axis=1)
                f = _fold(b.column("id").to_pylist())
                for k in range(FOLDS):
                    part = z[f == k]
                    sums[k] += part.T @ part
        for k in range(FOLDS if any_ else 0):
            for i in range(0, d, ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([i]), pa.array([lane]), pa.array([sums[k, i : i + ROWS].tobytes()])], names=["fold", "at", "lane", "part"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            for p in b.column("part"):
                total = total + np.frombuffer(p.as_py())
        yield pa.RecordBatch.from_pydict({"fold": [key[0].as_py()], "at": [key[1].as_py()], "lane": [key[2].as_py()], "part": [total.tobytes()]})

    schema = "fold long, at long, lane long, part binary"
    out = np.zeros((FOLDS, d, d))
    lanes = train.select("id", "x", "y").mapInArrow(local, schema).groupBy("fold", "at", "lane").applyInArrow(add, schema)
    for r in lanes.withColumn("lane", F.lit(0).cast("long")).groupBy("fold", "at", "lane").applyInArrow(add, schema).collect():
        out[r.fold, r.at : r.at + ROWS] = np.frombuffer(r.part).reshape(-1, d)
    return out, round(out[:, 0, 0].sum())


def ridge(sums: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights on all rows, weights for each fold without it), at the penalty with the least out-of-fold error."""
    total, best = sums.sum(axis=0), None
    solve = lambda a, p: np.linalg.solve(a[:-1, :-1] + p * n * np.diag([1e-9] + [1.0] * (len(a) - 2)), a[:-1, -1])
    for p in PENALTIES:
        out = np.array([solve(total - s, p) for s in sums])
        error = sum(s[-1, -1] - 2 * w @ s[:-1, -1] + w @ s[:-1, :-1] @ w for w, s in zip(out, sums, strict=True))
        if best is None or error < best[0]:
            best = error, solve(total, p), out
    return best[1], best[2]


def isotonic(bins: np.ndarray, counts: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in order: knots (bin, rate), not decreasing, a prior of one row towards the mean in each block."""
    mean = ones.sum() / counts.sum()
    blocks: list[list[float]] = []
    for b, n, k in zip(bins, counts, ones, strict=True):
        blocks.append([b * n, n, k])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            x = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], x, strict=True)]
    knots = np.array([x / n for x, n, _ in blocks])
    return knots, np.maximum.accumulate([(k + mean) / (n + 1) for _, n, k in blocks])


class Model:
    def __init__(self, phi: Fourier | None, weights, knots, rates):
        self.phi, self.weights, self.knots, self.rates = phi, weights, knots, rates

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.phi is None:
            return np.full(len(x), float(self.rates))
        return np.clip(np.interp(_bin(self.phi(x) @ self.weights), self.knots, self.rates), 0, 1)


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.round(np.clip(raw, -1, 2) * BINS)


def fit(train: DataFrame) -> Model:
    """``train`` has ``id``, ``x`` and ``y`` (0 or 1). Without rows of both labels the score is their rate, 0.5 if there are none."""
    r = train.agg(F.count("*").alias("n"), F.coalesce(F.avg("y"), F.lit(0.5)).alias("rate")).first()
    if r.n < 2 or r.rate in (0.0, 1.0):
        return Model(None, None, None, r.rate)
    by = {s.pos: s for s in train.select(F.posexplode("x")).groupBy("pos").agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("s")).collect()}
    phi = Fourier(np.array([by[i].m for i in range(N_STATS)]), np.array([by[i].s for i in range(N_STATS)]))
    sums, n = normal_equations(train, phi)
    weights, without = ridge(sums, n)

    def raw(batches):
        for b in batches:
            z, f = phi(_matrix(b)), _fold(b.column("id").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(_bin((z * without[f]).sum(axis=1)).astype(np.int64)), b.column("y").cast(pa.int64())], names=["bin", "y"])

    bins = sorted(train.select("id", "x", "y").mapInArrow(raw, "bin long, y long").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("k")).collect())
    return Model(phi, weights, *isotonic(*(np.array([r[i] for r in bins], float) for i in range(3))))


def score(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` has ``x``; its other columns stay, with ``score`` and ``predicted``."""
    names = [c for c in rows.columns if c != "x"]

    def run(batches):
        for b in batches:
            s = model(_matrix(b)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names) + ", score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row ``(doc_id, held_out, score, predicted)`` for each row of ``docs``.

    A document is held out if crc32 of its id's text modulo 3 is 1; its labels are not read. Null labels and
    labels other than 0 and 1 are left out, several labels of a document count each. A null text counts as empty, which
    has statistics and a score like any other, and a text of any length is read whole; a null id is not held out and has no label.
    Repeated rows are scored each, an empty table gives an empty one.
    """
    slim = docs.select(F.col(id).alias("id"), (id_bucket(id, 3) == 1).alias("held_out"), utf8(text).alias("body"))
    base = shared_dir(docs.sparkSession)
    rows = written(features(slim), f"{base}/features")
    known = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)").where(id_bucket("id", 3) != 1)
    # read by the means, the normal equations and the calibration
    train = written(rows.where("not held_out").join(known, "id").select("id", "x", "y"), f"{base}/train")
    return score(rows, fit(train)).withColumnRenamed("id", "doc_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op5_quality": op5_quality}
