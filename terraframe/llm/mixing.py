"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a target by weighted water filling. A target of e whole sizes
and a rest takes every document e times and, for the rest, a subset: documents
are counted by exact length, bounded-knapsack dynamic programming over those
counts says how many of each length to take, and seeded ranks say which.

Plan: sizes in JVM expressions; counts by (source, length) and by (source,
length, slice of the seeded hash) with partial sums; one dynamic programme for
each source over its counts, never over documents; ranks within a slice only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._util import by_key, keyed, nested, shared_dir, table, unnested, written

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 42
#: Slices of the seeded hash. Only the slice in which a length's count ends is ranked.
SLICES = 4096
#: Budget in words that the dynamic programme spans, as a multiple of the longest document; what lies above it is filled in proportion.
SPAN = 2


#: Columns of a mix.
MIXED = ("doc_id", "size", "source_size", "target", "taken", "times")


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """``sizes`` has ``source`` and ``source_size``, a row each; adds ``target``.

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of all sizes; what
    a source can't use above ``most`` times its size is shared out again until none is above.
    """
    # one slim row for each source passes here, streamed in order by one task
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight)
    level, cap = None, F.col("source_size") * F.lit(float(most))
    total = None
    while True:
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        r = rows.agg(F.sum("source_size").alias("t"), F.sum(F.when(above, cap)).alias("held"), F.sum(F.when(~above, F.col("weight"))).alias("w")).first()
        total = r.t or 0
        nxt = (total - (r.held or 0.0)) / r.w if r.w else (level or 0.0)
        # levels only rise: a source once held stays held
        if level is not None and nxt <= level:
            break
        level = nxt
    return rows.withColumn("target", F.least(F.col("weight") * F.lit(level), cap).cast("double")).drop("weight")


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, span: int = SPAN) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest to ``budget`` (at or below it first).

    Counts are taken in proportion until the rest is small against the longest document; then a
    bounded knapsack over the documents still free fills it.
    """
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return counts.copy()
    longest = int(lengths.max())
    goal = max(0, budget - span * longest // 2)
    take = (counts.astype(object) * goal // total).astype(np.int64)
    left = budget - int((lengths * take).sum())
    # proportional floors leave up to one document of each length: longest first, while they overshoot the span
    for i in np.argsort(-lengths):
        if left <= span * longest:
            break
        n = min(int(counts[i] - take[i]), (left - longest) // int(lengths[i])) if lengths[i] else 0
        if n > 0:
            take[i] += n
            left -= n * int(lengths[i])
    return take + _knapsack(lengths, counts - take, left)


def _knapsack(lengths: np.ndarray, free: np.ndarray, budget: int) -> np.ndarray:
    """Counts within ``free`` whose words reach the largest sum up to ``budget``."""
    out = np.zeros(len(lengths), np.int64)
    reach, mask = 1, (1 << (budget + 1)) - 1
    first = np.full(budget + 1, -1, np.int32)  # the item that first reached a sum; those before it reach the rest
    items: list[tuple[int, int]] = []
    for i in np.argsort(-lengths):
        w, n = int(lengths[i]), int(free[i])
        if not w or w > budget:
            continue
        n, k = min(n, budget // w), 1
        while n > 0:
            c = min(k, n)
            items.append((int(i), c))
            new = (reach << (w * c)) & mask & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8), bitorder="little")
                first[np.flatnonzero(bits)] = len(items) - 1
                reach |= new
            n, k = n - c, k * 2
        if reach >> budget & 1:
            break
    s = reach.bit_length() - 1
    while s:
        i, c = items[first[s]]
        out[i] += c
        s -= c * int(lengths[i])
    return out


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, most: int = MOST, seed: int = SEED, also: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, size, source_size, target, taken, times`` and its slim columns ``also``.

    ``taken`` is the document's words times how often the mix takes it, at most ``most`` times. A null
    text has size 0 and takes no words; a null source is a source, in last place. Rows that are equal in id and text
    are interchangeable; of ``also``, a name that the mix has itself is left out. Texts of any length are counted whole. An empty table gives an empty one. Reruns agree: ranks come from seeded hashes.
    """
    spark = docs.sparkSession
    base = shared_dir(spark)
    draw = F.xxhash64(F.col(id).cast("string"), F.col(text), F.lit(seed))
    thin = written(docs.select(F.col(id).alias("doc_id"), nested(also).alias("row"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), draw.alias("draw"), F.shiftrightunsigned(draw, 64 - SLICES.bit_length() + 1).cast("int").alias("slice")), f"{base}/thin")
    lengths = written(thin.groupBy("source", "size", "slice").agg(F.count("*").alias("n")), f"{base}/lengths")
    sizes = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aims = written(targets(written(sizes, f"{base}/sizes"), weights, most), f"{base}/targets")

    counted = _with(lengths.groupBy("source", "size").agg(F.sum("n").alias("n")), aims)

    def plan(group: pa.Table) -> pa.Table:
        size, n = group["size"].to_numpy(), group["n"].to_numpy()
        order = np.argsort(size)
        size, n = size[order], n[order]
        target, total = group["target"][0].as_py(), int((size * n).sum())
        whole = min(most, int(target // total)) if total else 0
        rest = round(target - whole * total) if whole < most else 0
        return pa.table({"source": pa.array(group["source"][:1].to_pylist() * len(size), pa.string()), "size": size, "whole": np.full(len(size), whole, np.int32), "more": fit(size, n, rest)})

    plans = counted.withColumn("source", F.col("source").cast("string")).groupBy("source").applyInArrow(plan, "source string, size long, whole int, more long")
    plans = written(plans, f"{base}/plans")
    # of each length the documents with the smallest draws: whole slices below the cut, ranks inside the one it falls in
    below = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = _with(lengths.withColumn("below", below), plans, ("source", "size")).select("source", "size", "slice", "whole", (F.col("more") - F.col("below")).alias("room"), "n")
    rows = _with(_with(thin, aims), cuts, ("source", "size", "slice"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("draw", "doc_id", "row"))
    part = rows.where("room > 0 and room < n").withColumn("extra", (rank <= F.col("room")).cast("int"))
    rest = rows.where("not (room > 0 and room < n)").withColumn("extra", (F.col("room") > 0).cast("int"))
    times = F.col("whole") + F.col("extra")
    return part.unionByName(rest).select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("times"), *unnested(also, MIXED))


def _with(left: DataFrame, right: DataFrame, on: tuple[str, ...] = ("source",)) -> DataFrame:
    """Null-safe equi-join; the right side has one row for each key."""
    r = right.select(*[F.col(c).alias(f"_{c}" if c in on else c) for c in right.columns])
    cond = None
    for c in on:
        eq = left[c].eqNullSafe(r[f"_{c}"])
        cond = eq if cond is None else cond & eq
    return left.join(r, cond).drop(*[f"_{c}" for c in on])


def mixed(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken."""
    # rows of one id and text but of different columns aren't interchangeable: the key holds the whole row
    whole = F.xxhash64(*[F.struct(F.lit(i), F.col(f"row.`{c}`")) for i, c in enumerate(docs.columns)])
    rows = keyed(docs, id, text).withColumn("th", whole)
    slim = rows.select("id", "th", F.col(f"row.`{text}`").alias("text"), F.col(f"row.`{source}`").alias("source"))
    times = mix(slim, "id", "text", "source", also=("th",), **how).groupBy(F.col("doc_id").alias("id"), "th").agg(F.sum("times").alias("n"))
    return by_key(rows, times)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("times")


QUERIES = {"op7_mixing": op7_mixing}
