"""Near-duplicates by the Jaccard similarity of word shingles: SimHash balls and MinHash bands propose, the shingle sets decide.

Texts of equal shingle sets are one node. Nodes whose SimHashes collide in the balls of ``simhash`` are proposed,
and so are nodes that agree on all rows of a MinHash band, for texts at the threshold differ in more SimHash
bits than any ball holds. A pair at 0.8 shares none of the bands with probability (1 - 0.8^5)^30 = 7e-6.

A band's bucket is no place for all its pairs, nor for one task: each of its nodes is compared with the bucket's
leader, as rows of a join. Buckets that this leaves in several components are dealt in blocks: the nodes outside
the bucket's largest component, a block at a time, meet all its nodes, a block at a time, and a forest of what is alike
leaves the task. So every two nodes of a bucket are of one component or have been compared, and every edge is the
exact similarity's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraframe.operators.components import connected_components

from ._util import by_key, keyed, null_id, removed, shared_dir, tidy, written
from .simhash import ball_links, majority, shingles

SHINGLE = 5
#: Similarity from which two texts are linked, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 30, 5
#: Nodes of either side that meet in one task.
SIDE = 512
#: Orders by which buckets choose their leaders.
LEADERS = 3
#: Shingles that a task hashes at a time.
BLOCK = 1 << 18

_DRAW = np.random.default_rng(42)
_A = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def hashes(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles, repeats included."""
    s = shingles(text, n)
    return np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in s), np.uint64, len(s))


def shingle_set(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(hashes(text, n))


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """Band keys of sets that aren't empty, a row each."""
    h = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), BANDS), np.uint64)
    for b in range(BANDS):
        k = np.full(len(sets), b + 1, np.uint64)
        for i in range(b * ROWS, (b + 1) * ROWS):
            v = h * _A[i] + _B[i]
            v ^= v >> np.uint64(32)
            k = (k ^ np.minimum.reduceat(v * _MIX, starts)) * _MIX
            k ^= k >> np.uint64(29)
        out[:, b] = k
    return out


def alike(shared, a, b, least: tuple[int, int] = LEAST):
    """Whether sets of sizes a and b with so many elements in common reach the similarity."""
    return shared * least[1] >= (a + b - shared) * least[0]


def links(one: list[np.ndarray], two: list[np.ndarray], at: np.ndarray, of: np.ndarray, least: tuple[int, int] = LEAST) -> list[tuple[int, int]]:
    """(i, j) for sets one[i] and two[j] that are alike, of components at[i] and of[j] that differ: one j for each i and component."""
    size = np.array([len(s) for s in two], np.int64)
    owner = np.repeat(np.arange(len(two)), size)
    whole, number = np.unique(np.concatenate(two), return_inverse=True)
    by = np.argsort(number, kind="stable")
    owner, start = owner[by], np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(whole)))])
    out = []
    for i, s in enumerate(one):
        place = np.searchsorted(whole, s)
        own = place[(place < len(whole)) & (whole[np.minimum(place, len(whole) - 1)] == s)]
        n = start[own + 1] - start[own]
        if not (total := int(n.sum())):
            continue
        spots = np.repeat(start[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
        shared = np.bincount(owner[spots], minlength=len(two))
        found = np.flatnonzero(alike(shared, size, len(s), least) & (of != at[i]))
        _, first = np.unique(of[found], return_index=True)
        out += [(i, int(j)) for j in found[first]]
    return out


def _nodes(docs: DataFrame, n: int) -> DataFrame:
    """``docs`` has ``body``; its other columns with ``node``, the key of the shingle set, ``fp``, the SimHash, and ``bands``; no shingles: 0, 0 and none."""
    names = [c for c in docs.columns if c != "body"]

    def run(batches):
        for batch in batches:
            node, keys, lengths, fps = [], [np.zeros(0, np.uint64)], [], [np.zeros(0, np.uint64)]
            held, all_, size = [], [], 0

            def flush():
                if held:
                    keys.append(bands(held).ravel())
                if all_:
                    fps.append(majority(np.concatenate(all_), np.array([len(h) for h in all_], np.int64)))
                held.clear()
                all_.clear()

            for x in batch.column("body"):
                h = hashes(x.as_py(), n)
                s = np.unique(h)
                node.append(xxhash.xxh64_intdigest(s.tobytes(), 42) if len(s) else 0)
                lengths.append(BANDS if len(s) else 0)
                all_.append(h)
                if len(s):
                    held.append(s)
                    size += len(h)
                if size > BLOCK:
                    flush()
                    size = 0
            flush()
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(np.concatenate(keys).view(np.int64)))
            longs = [pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(np.concatenate(fps).view(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [*longs, lists], [*names, "node", "fp", "bands"])
        tidy()

    return docs.mapInArrow(run, ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + ", node long, fp long, bands array<long>")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(node, items) for ``docs`` of ``node`` and ``body``."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([shingle_set(x.as_py(), n).tobytes() for x in b.column("body")], pa.binary())], ["node", "items"])

    return docs.mapInArrow(run, "node long, items binary")


def _verified(pairs: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) whose ``sets`` are alike."""

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("items_a"), batch.column("items_b"), strict=True):
                a, b = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                keep.append(bool(alike(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), least)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        tidy()

    one, two = (sets.select(F.col("node").alias(k), F.col("items").alias(f"items_{k}")) for k in "ab")
    length = F.octet_length
    both = pairs.join(one, "a").join(two, "b").where((length("items_a") * least[1] >= length("items_b") * least[0]) & (length("items_b") * least[1] >= length("items_a") * least[0]))
    return both.select("a", "b", "items_a", "items_b").mapInArrow(run, "a long, b long")


def _met(group: pa.Table, least: tuple[int, int]) -> pa.Table:
    """A block of a bucket's smaller components against one of all its nodes."""
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in group["items"]]
    node, comp, few = (group[c].to_numpy(zero_copy_only=False) for c in ("node", "comp", "few"))
    i, j = np.flatnonzero(few), np.flatnonzero(~few)
    if not len(i) or not len(j):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    found = links([sets[k] for k in i], [sets[k] for k in j], comp[i], comp[j], least)
    return pa.table({"a": pa.array([node[i[a]] for a, _ in found], pa.int64()), "b": pa.array([node[j[b]] for _, b in found], pa.int64())})


def _components(edges: DataFrame) -> DataFrame:
    return connected_components(edges, "a", "b").select("node", F.col("component").alias("comp"))


def _split(met: DataFrame, comps: DataFrame) -> DataFrame:
    """Of ``met`` (node, band) the buckets in several components: ``node, band, comp, few, i, j``, once for each pair of blocks that the node is in.

    ``few``: as one of the components other than the bucket's largest; each node is also there as one of all.
    """
    named = met.join(comps, "node", "left").select("node", "band", F.coalesce("comp", "node").alias("comp"))
    sizes = named.groupBy("band", "comp").agg(F.count("*").alias("n"))
    largest = F.max_by("comp", F.struct("n", "comp"))
    # of two nodes there is one pair, and it has been compared
    torn = sizes.groupBy("band").agg(F.count("*").alias("comps"), F.sum("n").alias("all"), largest.alias("large"), F.max("n").alias("most")).where("comps > 1 and all > 2")
    blocks: Column = F.ceil(F.col("all") / SIDE).cast("int")
    others = F.ceil((F.col("all") - F.col("most")) / SIDE).cast("int")
    rows = named.join(torn, "band").select("node", "band", "comp", (F.col("comp") != F.col("large")).alias("small"), blocks.alias("blocks"), others.alias("others"))
    at = F.pmod(F.xxhash64("node", F.lit(1)), "blocks").cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(2)), "others").cast("int")
    every = rows.select("node", "band", "comp", F.lit(False).alias("few"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("i"), at.alias("j"))
    few = rows.where("small").select("node", "band", "comp", F.lit(True).alias("few"), own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    return every.unionByName(few)


def near_duplicates(rows: DataFrame, n: int = SHINGLE, least: tuple[int, int] = LEAST) -> DataFrame:
    """``rows`` are keyed(); one row ``(id, th, component)`` for each.

    Linked are texts whose sets of n-word shingles have a Jaccard similarity of ``least`` or more; texts without
    words are alike. A text of fewer words is one shingle.
    """
    spark = rows.sparkSession
    base = shared_dir(spark)
    slim = rows.select("id", "th", "body")
    all_ = written(_nodes(slim, n), f"{base}/nodes")
    nodes = written(all_.groupBy("node").agg(F.min(F.struct("id", "th")).alias("row"), F.min("fp").alias("fp"), F.first("bands").alias("bands")), f"{base}/distinct")
    worded = nodes.where(F.size("bands") > 0)
    dealt = worded.select("node", F.explode("bands").alias("band"))
    # a few different leaders among the buckets of one group, lest a poor one leads them all
    lead = F.min_by("node", F.xxhash64("node", F.pmod("band", F.lit(LEADERS))))
    led = dealt.groupBy("band").agg(lead.alias("lead"), F.count("*").alias("count")).where("count > 1").select("band", "lead")
    met = written(dealt.join(led, "band"), f"{base}/met")
    stars = met.select(F.col("lead").alias("a"), F.col("node").alias("b"))
    # fingerprints that collide in a ball; of nodes with one fingerprint each with the first
    fps = written(worded.groupBy("fp").agg(F.min("node").alias("node")), f"{base}/fps")
    balls = written(ball_links(fps.select("fp")), f"{base}/balls")
    root = fps.select(F.col("fp").alias("root"), F.col("node").alias("a"))
    same = worded.join(fps.withColumnRenamed("node", "a"), "fp").select("a", F.col("node").alias("b"))
    near = balls.join(root, "root").join(fps, "fp").select("a", F.col("node").alias("b")).unionByName(same)
    pairs = written(stars.unionByName(near).where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{base}/pairs")
    # the sets of nodes that met another, from one text each
    needed = nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
    texts = slim.join(needed.select("node", F.col("row.id").alias("id"), F.col("row.th").alias("th")), ["id", "th"]).dropDuplicates(["node"])
    sets = written(_sets(texts.select("node", "body"), n), f"{base}/sets")
    comps = written(_components(written(_verified(pairs, sets, least), f"{base}/edges")), f"{base}/comps")
    split = written(_split(met, comps), f"{base}/split")
    if not split.isEmpty():
        late = split.join(sets, "node").groupBy("band", "i", "j").applyInArrow(lambda g: _met(g, least), "a long, b long")
        late = written(late.distinct(), f"{base}/late")
        if not late.isEmpty():
            comps = _components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(late))
    for used in ("distinct", "met", "fps", "balls", "pairs", "split"):
        removed(spark, f"{base}/{used}")
    return all_.join(comps, "node", "left").select("id", "th", F.coalesce("comp", "node").alias("component"))


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = SHINGLE, least: tuple[int, int] = LEAST) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest id, null last; of rows with that id, the one with the least hash of the text."""
    rows = keyed(docs, id, text)
    first = near_duplicates(rows, n, least).groupBy("component").agg(F.min(F.struct(null_id(F.col("id")).isNull(), "id", "th")).alias("k"))
    return by_key(rows, first.select("k.id", "k.th", F.lit(1).alias("n")))
