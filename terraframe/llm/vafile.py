"""Exact top-k search by vector-approximation files.

Every component is an integer, floor(256 x), of any size. The approximation of a
vector keeps one byte a component: its cell among 256 between its block's
extremes. Two files are written once: the cells, in blocks, and the exact
vectors, a row each; of equal vectors, one stands for the few smallest ids that
can matter. Queries scan the cells for bounds of the inner product, with a k-th
best lower bound that runs across blocks. Then exact vectors are read in order of the
upper bound until the k-th best score is certain: the first few of each query,
and of the rest those whose bound reaches the k-th exact score so far.

Plan: a slot of cells is one task's build side, blocks of queries stream past
it, and bounds of survivors leave it; no exact vector moves before that. The
stated query set is a fixed share of the rows. Exact vectors are joined by key to the
survivors only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._util import long_id, null_id, shared_dir, shuffle_partitions, table, written

SCALE = 256
CELLS = 256
BLOCK = 2048
QUERIES_BLOCK = 512
#: Exact vectors that a query reads first, as a multiple of k + 1.
FIRST = 2
#: Doubles below this have 256 x floored exactly; larger ones are integers already.
WHOLE = 1 << 45
#: Bytes of cells of a slot, which a task holds.
SLOT_BYTES = 1 << 26
#: Largest component whose products and sums stay exact in 64-bit integers, at 2 ** 20 components.
WIDE = 1 << 21


def integers(df: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id`` and ``v``, floor(256 x) / 256 of every component, exact at any size. Vectors that are null or hold null or non-finite components are left out."""
    x = F.transform(F.col(vector), lambda e: e.cast("double"))
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    ok = df.where(F.col(vector).isNotNull()).select(long_id(id).alias("id"), x.alias("x")).where(~F.coalesce(bad, F.lit(True)))
    return ok.select("id", F.transform("x", lambda e: F.when(F.abs(e) < float(WHOLE), F.floor(e * float(SCALE)).cast("double") / float(SCALE)).otherwise(e)).alias("v"))


def exact_product(a, b) -> int:
    """The inner product of floor(256 x), from integers() of both."""
    # at and beyond WHOLE a component is an integer, which 256 times may be no double
    scaled = lambda x: int(x * SCALE) if abs(x) < WHOLE else int(x) * SCALE
    return sum(scaled(x) * scaled(y) for x, y in zip(a, b, strict=True))


def sortable(score: int) -> bytes:
    """Bytes that sort as the integers do, of any size."""
    n = (abs(score).bit_length() + 7) // 8
    if score >= 0:
        return b"\x01" + n.to_bytes(4, "big") + score.to_bytes(n, "big")
    return b"\x00" + ((1 << 32) - 1 - n).to_bytes(4, "big") + ((1 << (8 * n)) - 1 + score).to_bytes(n, "big")


def _floor(score: int) -> float:
    """A double not above the score, in the scale of integers()."""
    try:
        x = float(score) / SCALE**2
    except OverflowError:
        return -np.inf if score < 0 else 1e300
    return x - abs(x) * 1e-12


def _blocks(rows: DataFrame, size: int, cells: bool) -> DataFrame:
    """Packs rows (key, v) by dimension into ``size`` at a time: their cells, or the vectors themselves."""

    def run(batches):
        held: dict[int, tuple[list, list]] = {}

        def out(dim):
            keys, vs = held.pop(dim)
            vs = np.array(vs, np.float64).reshape(len(keys), dim)
            body = Approximation(vs).pack() if cells else vs.tobytes()
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(keys)], pa.int32()), pa.array([np.array(keys, np.int64).tobytes()]), pa.array([body], pa.binary())], names=["dim", "n", "keys", "body"])

        for b in batches:
            for i, v in zip(b.column("key").to_pylist(), b.column("v"), strict=True):
                v = v.values.to_numpy(zero_copy_only=False)
                keys, vs = held.setdefault(len(v), ([], []))
                keys.append(i)
                vs.append(v)
                if len(keys) >= max(64, min(size, (1 << 22) // max(1, len(v)))):
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    return rows.select("key", "v").mapInArrow(run, "dim int, n int, keys binary, body binary")


class Approximation:
    """The cells of a block of vectors: extremes and a byte for each component."""

    def __init__(self, vectors: np.ndarray):
        with np.errstate(all="ignore"):
            self.lo, hi = (vectors.min(axis=0), vectors.max(axis=0)) if len(vectors) else (np.zeros(vectors.shape[1]),) * 2
            self.width = (hi - self.lo) / CELLS
            at = np.where((self.width > 0) & np.isfinite(self.width), (vectors - self.lo) / self.width, 0)
            self.codes = np.clip(np.nan_to_num(at), 0, CELLS - 1).astype(np.uint8)

    def pack(self) -> bytes:
        return self.lo.tobytes() + self.width.tobytes() + self.codes.tobytes()

    @classmethod
    def unpack(cls, body: bytes, n: int, dim: int) -> Approximation:
        out = cls.__new__(cls)
        out.lo, out.width = np.frombuffer(body, np.float64, 2 * dim).reshape(2, dim)
        out.codes = np.frombuffer(body, np.uint8, n * dim, 16 * dim).reshape(n, dim)
        return out

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the inner product, queries x vectors, from the cells alone; infinite where doubles can't tell."""
        with np.errstate(all="ignore"):
            # a cell reaches half its width from its middle
            mid = queries @ (self.codes * self.width + (self.lo + self.width / 2)).T
            size = np.abs(queries)
            slack = (size @ (self.width / 2))[:, None]
            # far above the rounding of sums of doubles
            slack = slack + 1e-9 * (size @ (np.abs(self.lo) + CELLS * self.width))[:, None] + 1e-9
            low, up = mid - slack, mid + slack
        low[np.isnan(low)] = -np.inf
        up[np.isnan(up)] = np.inf
        return low, up


class Survivors:
    """What is left of the candidates of one block of queries, as blocks of cells pass by."""

    def __init__(self, keys: np.ndarray, k: int):
        self.keys, self.k = keys, k
        self.best = np.full((len(keys), k + 1), -np.inf)
        self.held: list[tuple[np.ndarray, ...]] = []

    def add(self, keys: np.ndarray, low: np.ndarray, up: np.ndarray) -> None:
        n = min(self.k + 1, low.shape[1])
        top = np.partition(low, low.shape[1] - n, axis=1)[:, low.shape[1] - n :]
        self.best = np.sort(np.concatenate([self.best, top], axis=1), axis=1)[:, n:]
        # one of k + 1 may be the query's own vector
        i, j = np.nonzero(up >= self.best[:, :1])
        self.held.append((i, keys[j], low[i, j], up[i, j]))

    def rows(self) -> pa.RecordBatch:
        i, key, low, up = (np.concatenate(x) for x in zip(*self.held, strict=True))
        ok = up >= self.best[i, 0]
        return pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (self.keys[i], key, low, up)], names=["qkey", "key", "low", "up"])


def survivors(queries: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """``qkey, key, low, up, nth``: the vectors whose upper bound reaches the query's (k+1)-th best lower bound, numbered by it, best first.

    ``queries`` has ``key`` and ``v``, ``cells`` the packed blocks and their ``slot``.
    """
    n = shuffle_partitions(cells.sparkSession)
    packed = _blocks(queries, QUERIES_BLOCK, False).select("dim", F.col("n").alias("qn"), F.col("keys").alias("qkeys"), F.col("body").alias("qbody"))
    # every block of queries goes to each slot that has cells of its length
    sent = packed.join(cells.select("dim", "slot").distinct(), "dim").repartition(n, "dim", "slot")
    paired = sent.join(cells.repartition(n, "dim", "slot").hint("shuffle_hash"), ["dim", "slot"])

    def run(batches):
        block, left = None, None
        for b in batches:
            for dim, qn, qkeys, qbody, m, keys, body in zip(*(b.column(c).to_pylist() for c in ("dim", "qn", "qkeys", "qbody", "n", "keys", "body")), strict=True):
                if (dim, qkeys) != block:
                    if left:
                        yield left.rows()
                    block, left = (dim, qkeys), Survivors(np.frombuffer(qkeys, np.int64), k)
                    q = np.frombuffer(qbody, np.float64).reshape(qn, dim)
                left.add(np.frombuffer(keys, np.int64), *Approximation.unpack(body, m, dim).bounds(q))
        if left:
            yield left.rows()

    found = paired.select("dim", "qn", "qkeys", "qbody", "n", "keys", "body").mapInArrow(run, "qkey long, key long, low double, up double")
    own = Window.partitionBy("qkey")
    ranked = found.withColumn("place", F.row_number().over(own.orderBy(F.col("low").desc(), "key")))
    told = ranked.withColumn("kth", F.max(F.when(F.col("place") == k + 1, F.col("low"))).over(own)).where(F.col("kth").isNull() | (F.col("up") >= F.col("kth")))
    return told.withColumn("nth", F.row_number().over(own.orderBy(F.col("up").desc(), "key"))).select("qkey", "key", "low", "up", "nth")


def _scored(pairs: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Exact scores of ``pairs`` (qkey, key), a row for each id of a vector but one that is the query's own."""
    q = queries.select(F.col("key").alias("qkey"), F.col("id").alias("query_id"), F.col("v").alias("q"))
    both = pairs.select("qkey", "key").join(vectors, "key").join(q, "qkey")

    def run(batches):
        for b in batches:
            v, q = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("v", "q"))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in b.column("v")])]).astype(np.int64)
            small = max(np.abs(v).max(initial=0), np.abs(q).max(initial=0)) * SCALE <= WIDE
            if small:
                # differences of running sums: an empty vector has none
                run_ = np.concatenate([[0], np.cumsum((v * SCALE).astype(np.int64) * (q * SCALE).astype(np.int64))])
                scores = (run_[ends[1:]] - run_[ends[:-1]]).tolist()
            else:
                scores = [exact_product(v[i:j].tolist(), q[i:j].tolist()) for i, j in zip(ends, ends[1:], strict=False)]
            got = []
            for r, (qkey, qid, ids) in enumerate(zip(*(b.column(c).to_pylist() for c in ("qkey", "query_id", "ids")), strict=True)):
                if qid in ids and (v[ends[r] : ends[r + 1]] == q[ends[r] : ends[r + 1]]).all():
                    ids.remove(qid)
                s = scores[r]
                got += [(qkey, qid, i, sortable(s), max(-(2**63), min(2**63 - 1, s)), _floor(s)) for i in ids]
            cols = list(zip(*got, strict=True)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["qkey", "query_id", "vec_id", "order", "score", "value"])

    return both.select("qkey", "query_id", "q", "ids", "v").mapInArrow(run, "qkey long, query_id long, vec_id long, order binary, score long, value double")


def search(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """Both have ``id`` and ``v``; a query's own row is the candidate with its id and vector, once.

    Returns ``query_id, rank, vec_id, score``: each query row's k best by integer inner product, ties to the
    smaller id. Only vectors of the query's own length are candidates. Of repeated rows with the query's id and
    vector, one is the query's own and the others are candidates; ranks follow exact scores of any size, and those beyond
    64 bits return as the largest or smallest long. A null id comes before all others. Empty tables give an empty one.
    """
    return searched(queries, rows, k)[0]


def searched(queries: DataFrame, rows: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """search(), and the pairs (qkey, key) whose exact vectors it has read."""
    spark = rows.sparkSession
    base, n = shared_dir(spark), shuffle_partitions(spark)
    # of equal vectors no more than k + 1 can count, one of which may be the query's own
    least = rows.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("place") <= k + 1)
    vectors = written(least.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("key", F.monotonically_increasing_id()), f"{base}/vectors")
    asked = written(queries.select("id", "v").withColumn("key", F.monotonically_increasing_id()), f"{base}/queries")
    size = vectors.agg(F.sum(F.size("v"))).first()[0] or 0
    slots = max(n, -(-size // SLOT_BYTES))
    cells = _blocks(vectors, BLOCK, True).withColumn("slot", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(slots)).cast("int"))
    found = written(survivors(asked, written(cells, f"{base}/cells"), k), f"{base}/survivors")
    # read in order of the bound: the first few, then those that may still beat the k-th exact score
    own = Window.partitionBy("qkey").orderBy(F.col("order").desc(), "vec_id")
    first = found.where(F.col("nth") <= FIRST * (k + 1))
    sure = written(_scored(first, asked, vectors), f"{base}/first")
    kth = sure.withColumn("place", F.row_number().over(own)).where(F.col("place") == k).select("qkey", F.col("value").alias("kth"))
    rest = found.where(F.col("nth") > FIRST * (k + 1)).join(kth, "qkey", "left").where(F.col("kth").isNull() | (F.col("up") >= F.col("kth")))
    late = written(rest.select("qkey", "key"), f"{base}/rest")
    ranked = sure.unionByName(_scored(late, asked, vectors)).withColumn("rank", F.row_number().over(own).cast("int")).where(F.col("rank") <= k)
    return ranked.select(null_id(F.col("query_id")).alias("query_id"), "rank", null_id(F.col("vec_id")).alias("vec_id"), "score"), first.select("qkey", "key").unionByName(late)


def op6_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integers(table(spark, sf_dir, "embeddings"))
    return search(rows.where(F.col("id") % 50 == 0), rows)


QUERIES = {"op6_vafile": op6_vafile}
ORACLE = {
    "op6_vafile": """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
}
