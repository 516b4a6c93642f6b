"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at d or fewer differing bits share a variant at d/2 or fewer
bits from each. Every distinct fingerprint's ball of such variants is dealt out
by prefix: what travels is the fingerprint, once to each prefix that its ball
reaches, and the task of a prefix makes the variants under it, sorts them, and
verifies each colliding fingerprint against the first of its variant. That is
the shuffle on variants with the variants written down on the far side only,
tens of copies of 8 bytes in place of thousands. Prefixes with too many
fingerprints are dealt again by a longer prefix.

Colliding pairs leave a task as a spanning forest, not as all pairs; components
of the forests are the link classes.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.operators.components import connected_components

from ._util import by_key, keyed, long_id, nested, null_id, removed, shared_dir, table, unnested, utf8, written

BITS = 64
SHINGLE = 4
DISTANCE = 4
#: Bits of the first prefix, and of that for a few thousand fingerprints, of which many prefixes would hold none; longer only where prefixes would hold over HOT on average.
PREFIX, SHORT_PREFIX, FEW = 12, 4, 1 << 14
#: Variants that a task sorts at a time; more are split by further bits.
VARIANTS = 1 << 22
#: Fingerprints that share a prefix above which they are dealt again by a longer one.
HOT = 1 << 16


def shingles(text: bytes, n: int) -> list[bytes]:
    """Space-joined runs of n words, repeats included; fewer words give one run, none give none."""
    words = text.lower().split()  # on bytes both concern ASCII only: A-Z, and \x20 \x09-\x0D
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    return [joined[s:e] for s, e in zip(starts, ends[n - 1 :], strict=False)]


def majority(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For consecutive runs of hashes, the bits set in over half of each run; an empty run gives 0."""
    out = np.zeros(len(lengths), np.uint64)
    full = np.flatnonzero(lengths)
    if not len(full):
        return out
    # 16 passes of four 16-bit counters; runs are cut so that no counter overflows
    run, piece = lengths[full], 1 << 15
    parts = -(-run // piece)
    first = np.concatenate([[0], np.cumsum(run)[:-1]])
    owner = np.repeat(np.arange(len(full)), parts)
    starts = first[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * piece
    lane, heads = np.uint64(0x0001000100010001), np.cumsum(parts) - parts
    for k in range(16):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & lane, starts)
        for j in range(4):
            count = np.add.reduceat((sums >> np.uint64(16 * j)) & np.uint64(0xFFFF), heads)
            out[full] |= (2 * count > run.astype(np.uint64)).astype(np.uint64) << np.uint64(16 * j + k)
    return out


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    h = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles(text, n)], np.uint64)
    return int(majority(h, np.array([len(h)]))[0])


def fingerprints(docs: DataFrame, n: int = SHINGLE, block: int = 1 << 21) -> DataFrame:
    """``docs`` has the bytes ``body`` and slim columns, which stay; adds ``fp``, the fingerprint as a signed long."""
    names = [c for c in docs.columns if c != "body"]

    def run(batches):
        digest = xxhash.xxh64_intdigest
        for b in batches:
            hashes, lengths, out, size = [], [], [], 0

            def flush():
                out.append(majority(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.array(lengths, np.int64)))
                hashes.clear()
                lengths.clear()

            for x in b.column("body"):
                s = shingles(x.as_py(), n)
                hashes.append(np.fromiter((digest(g, 42) for g in s), np.uint64, len(s)))
                lengths.append(len(s))
                size += len(s)
                if size > block:
                    flush()
                    size = 0
            if lengths:
                flush()
            fp = np.concatenate(out) if out else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(fp.view(np.int64))], [*names, "fp"])

    return docs.mapInArrow(run, ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + ", fp long")


def flips(low: int, high: int, most: int) -> list[tuple[int, int]]:
    """(mask, bits set) for every choice of at most ``most`` of the bits low..high-1."""
    return [(sum(1 << i for i in c), k) for k in range(most + 1) for c in combinations(range(low, high), k)]


def _masks(low: int, high: int, most: int) -> np.ndarray:
    return np.array([m for m, _ in flips(low, high, most)], np.uint64)


def _deal(rows: DataFrame, frm: int, to: int, most: int) -> DataFrame:
    """Rows (fp, used, key) by prefix of ``frm`` bits, to those of ``to`` bits: one for each way to flip added bits."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    ways = F.array(*[F.struct(F.lit(signed(m)).cast("long").alias("mask"), F.lit(k).alias("bits")) for m, k in flips(BITS - to, BITS - frm, most)])
    w = rows.select("fp", "used", "key", F.explode(ways).alias("w")).where(F.col("used") + F.col("w.bits") <= most)
    cut = F.lit(-(1 << (BITS - to)) if to else 0).cast("long")
    # the key holds the variant's leading bits, the fingerprint's own below them cut away
    key = F.col("key").bitwiseOR(F.col("fp").bitwiseXOR(F.col("w.mask")).bitwiseAND(cut).bitwiseAND(F.lit(~signed(-(1 << (BITS - frm)) & (2**64 - 1)) if frm else -1).cast("long")))
    return w.select("fp", (F.col("used") + F.col("w.bits")).cast("int").alias("used"), key.alias("key"))


def ball_links(uniq: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``uniq`` has distinct ``fp``; returns (fp, root), a forest whose every edge was verified and whose trees span the link classes within each prefix."""
    most = (distance + 1) // 2
    n = uniq.count()
    p = PREFIX if n > FEW else SHORT_PREFIX
    while p < 32 and n >> p > HOT:
        p += 4
    rows = _deal(uniq.select("fp", F.lit(0).alias("used"), F.lit(0).cast("long").alias("key")), 0, p, most)
    done = None
    while True:
        # a ball is largest under its own prefix, so those rows tell
        hot = rows.where("used = 0").groupBy("key").count().where(F.col("count") > HOT).select("key")
        deep = p < 48 and not hot.isEmpty()
        cold = rows.join(hot, "key", "left_anti") if deep else rows
        at = cold.select("fp", "used", "key", F.lit(p).alias("p"))
        done = at if done is None else done.unionByName(at)
        if not deep:
            break
        rows, p = _deal(rows.join(hot, "key", "left_semi").select("fp", "used", "key"), p, p + 8, most), p + 8

    def link(key, group):
        return _forest(group, key[0].as_py(), most, distance)

    return done.groupBy("p", "key").applyInArrow(link, "fp long, root long").distinct()


def _colliding(fp: np.ndarray, at: np.ndarray, used: np.ndarray, key: np.uint64, p: int, most: int, distance: int):
    """Packed (first, other) places of fingerprints that share a variant under the prefix ``key`` of p bits; ``at`` picks them, with ``used`` flips spent."""
    masks = {u: _masks(0, BITS - p, most - u) for u in range(most + 1)}
    parts = {u: at[used == u] for u in masks}
    if sum(len(parts[u]) * len(m) for u, m in masks.items()) > VARIANTS and p <= BITS - 4:
        low = np.uint64(BITS - p - 4)
        nibble = (fp[at] >> low) & np.uint64(15)
        for sub in range(16):
            spent = used + np.bitwise_count(nibble ^ np.uint64(sub)).astype(used.dtype)
            ok = spent <= most
            yield from _colliding(fp, at[ok], spent[ok], key | (np.uint64(sub) << low), p + 4, most, distance)
        return
    low = np.uint64((1 << (BITS - p)) - 1)
    v = np.concatenate([(((fp[parts[u]] & low) | key)[:, None] ^ m[None, :]).ravel() for u, m in masks.items()])
    o = np.concatenate([np.repeat(parts[u].astype(np.int32), len(m)) for u, m in masks.items()])
    if not len(v):
        return
    by = np.argsort(v)
    v, o = v[by], o[by]
    same = v[1:] == v[:-1]
    if not same.any():
        return
    hit = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    v, o = v[hit], o[hit]
    new = np.concatenate([[True], v[1:] != v[:-1]])
    # the one nearest to the variant leads: of an odd distance's ball, whoever is linked through a variant is linked to it
    near = np.bitwise_count(fp[o] ^ v).astype(np.int64) << 32 | o
    leader = (np.minimum.reduceat(near, np.flatnonzero(new)) & 0xFFFFFFFF)[np.cumsum(new) - 1]
    clash = leader != o
    a, b = leader[clash], o[clash]
    ok = np.bitwise_count(fp[a] ^ fp[b]) <= distance
    yield np.unique(a[ok].astype(np.int64) << 32 | b[ok])


def _forest(group: pa.Table, p: int, most: int, distance: int) -> pa.Table:
    fp = group["fp"].to_numpy().view(np.uint64)
    order = np.argsort(fp)
    fp, used = fp[order], group["used"].to_numpy()[order].astype(np.int8)
    key = np.uint64(group["key"][0].as_py() & (2**64 - 1))
    pairs = list(_colliding(fp, np.arange(len(fp)), used, key, p, most, distance))
    if not pairs:
        return pa.table({"fp": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
    both = np.unique(np.concatenate(pairs))
    a, b = both >> 32, both & 0xFFFFFFFF
    # the label of a tree is its smallest member; pointer jumping until nothing moves
    lab = np.arange(len(fp))
    while True:
        was = lab.copy()
        np.minimum.at(lab, b, lab[a])
        np.minimum.at(lab, a, lab[b])
        lab = lab[lab]
        if (lab == was).all():
            break
    member = np.flatnonzero(lab != np.arange(len(fp)))
    return pa.table({"fp": fp[member].view(np.int64), "root": fp[lab[member]].view(np.int64)})


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = SHINGLE, distance: int = DISTANCE, also: tuple[str, ...] = ()) -> DataFrame:
    """One row ``(doc_id, fingerprint, component_id, component)`` for each row of ``docs``, repeated rows included, with its slim columns ``also``.

    ``component`` tells classes apart, also where ids repeat or are null.

    A null text, like one without words, has fingerprint zero and links like any other. A null id stays
    null; component_id is the smallest id reachable that is not null. An empty table gives an empty one. Texts of any
    length are hashed whole. Of ``also``, a name that the result has itself is left out.
    """
    spark = docs.sparkSession
    base = shared_dir(spark)
    fps = written(fingerprints(docs.select(long_id(id).alias("id"), nested(also).alias("row"), utf8(text).alias("body")), n), f"{base}/fps")
    uniq = written(fps.groupBy("fp").agg(F.min(null_id(F.col("id"))).alias("least")), f"{base}/uniq")
    trees = connected_components(ball_links(uniq, distance), "fp", "root")
    own = uniq.join(trees.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    own = written(own, f"{base}/own")
    named = own.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = own.join(named, "component").select("fp", "component_id", "component")
    removed(spark, f"{base}/uniq")
    return fps.join(by_fp, "fp").select(null_id(F.col("id")).alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component", *unnested(also, ("doc_id", "fingerprint", "component_id", "component")))


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest id, null last; of rows with that id, the one with the least hash of the text."""
    rows = keyed(docs, id, text)
    found = near_duplicates(rows.select("id", "th", F.col("body").cast("string").alias("text")), "id", "text", n, distance, ("th",))
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("k"))
    return by_key(rows, first.select(long_id("k.doc_id").alias("id"), "k.th", F.lit(1).alias("n")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")


QUERIES = {"op2_simhash": op2_simhash}
