"""Exact substring dedup by super-k-mer partitioning.

A window is ``width`` consecutive words of one document; a word goes if a window
that covers it has a word sequence that also starts earlier (smaller id, or same
document and earlier start). Consecutive windows whose smallest hash of
MINIMISER words agrees form a super-k-mer; it travels as one packed string to
its minimiser's bucket, so equal windows meet without any window travelling on
its own. In a bucket, windows are sorted by a rolling hash and equal hashes are
compared word by word, so the result is exact.

Before the shuffle, each batch of a map task settles windows that repeat inside
it: only the earliest of equals travels, so a passage in a third of all
documents reaches its bucket once from each batch. All super-k-mers of a batch
for one bucket share one compressed row.

Shuffles: the packed strings, then the removed spans with the texts by document.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import long_id, nested, pa_schema, shared_dir, shuffle_partitions, table, tidy, unnested, utf8, written

WIDTH = 20
#: Words whose joint hash is a candidate minimiser: enough that single frequent words don't attract windows.
MINIMISER = 4
#: UTF-8 bytes of text that a map task handles at a time.
BLOCK_BYTES = 1 << 23
#: Bytes whose words are hashed at a time.
SLICE_BYTES = 1 << 18
#: Bytes of text for each bucket, at most, and for each partition of buckets.
BUCKET_BYTES = 1 << 21
PARTITION_BYTES = 1 << 28
#: Ids of several rows up to which they are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1 << 16

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_NONE = np.zeros(0, np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than ASCII white space."""
    gap = np.ones(len(buf) + 2, bool)
    gap[1:-1] = _SPACE[buf]
    turn = np.flatnonzero(gap[1:] != gap[:-1])
    small = np.int32 if len(buf) < 1 << 31 else np.int64
    return turn[::2].astype(small), turn[1::2].astype(small)


@lru_cache(4)
def _slice_powers(base: int) -> np.ndarray:
    return _powers(SLICE_BYTES, np.uint64(base))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    if n < SLICE_BYTES:
        return _slice_powers(int(base))[: n + 1]
    out = np.empty(n + 1, np.uint64)
    out[0] = 1
    np.multiply.accumulate(np.full(n, base, np.uint64), out=out[1:])
    return out


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each word: differences of one running sum, brought to the same power. In slices, as sums take 8 bytes for each of text."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        # whole words only; a word longer than a slice has one of its own
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_BYTES)))
        lo, hi = int(starts[i]), int(ends[j - 1])
        run = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((buf[lo:hi] + np.uint64(1)) * _powers(hi - lo, _P)[:-1], dtype=np.uint64, out=run[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = _mix((run[e] - run[s]) * _powers(hi - lo, _PINV)[s] + (e - s).astype(np.uint64))
        i = j
    return out


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    run = np.concatenate([[np.uint64(0)], np.cumsum(h * _powers(len(h), _P)[:-1], dtype=np.uint64)])
    return _mix((run[n:] - run[:-n]) * _powers(len(h), _PINV)[: len(h) - n + 1])


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    have = 1
    while have < n:
        step = min(have, n - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


class Windows:
    """All windows of some stretches of words: which repeat, and which comes first among equals."""

    def __init__(self, buf: bytes, doc: np.ndarray, row: np.ndarray, base: np.ndarray, n_words: np.ndarray, width: int):
        """Stretch i has n_words[i] words of document (doc[i], row[i]), from its word base[i] on; ``buf`` holds their words in turn."""
        self.width, self.buf = width, np.frombuffer(buf, np.uint8)
        self.starts, self.ends = words(self.buf)
        self.h = word_hashes(self.buf, self.starts, self.ends)
        self.owner = owner = np.repeat(np.arange(len(n_words), dtype=np.int32), n_words)
        self._doc, self._row, self._base = doc, row, base - (np.cumsum(n_words) - n_words)
        self.roll = rolling(self.h, width)
        self.whole = owner[: len(self.roll)] == owner[width - 1 :] if len(self.roll) else np.zeros(0, bool)

    def doc(self, i: np.ndarray) -> np.ndarray:
        """The documents of words i."""
        return self._doc[self.owner[i]]

    def row(self, i: np.ndarray) -> np.ndarray:
        return self._row[self.owner[i]]

    def at(self, i: np.ndarray) -> np.ndarray:
        """The places of words i in their documents."""
        return self._base[self.owner[i]] + i

    def repeats(self) -> np.ndarray:
        """True for windows whose word sequence also starts earlier, here."""
        out = np.zeros(len(self.roll), bool)
        todo = np.flatnonzero(self.whole)
        todo = todo[np.argsort(self.roll[todo], kind="stable")]
        r = self.roll[todo]
        same = r[1:] == r[:-1]
        todo = todo[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(todo) else todo
        while len(todo):
            # the earliest of each hash leads; equals of the leader are settled, windows that only share its hash go round again
            todo = todo[np.lexsort((self.at(todo), self.row(todo), self.doc(todo), self.roll[todo]))]
            r = self.roll[todo]
            head = np.concatenate([[True], r[1:] != r[:-1]])
            lead = todo[np.flatnonzero(head)[np.cumsum(head) - 1]]
            equal = self.equal(todo, lead)
            # the same window of one document, read twice, is not earlier than itself
            apart = (self.doc(todo) != self.doc(lead)) | (self.row(todo) != self.row(lead)) | (self.at(todo) != self.at(lead))
            out[todo[equal & apart]] = True
            todo = todo[~equal]
        return out

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the windows' words are equal, byte by byte."""
        wid = self.ids()
        ok = np.ones(len(a), bool)
        for k in range(self.width):
            ok &= wid[a + k] == wid[b + k]
        return ok

    def ids(self) -> np.ndarray:
        """An exact number for each distinct word."""
        if not hasattr(self, "wid"):
            joined = self.buf[~_SPACE[self.buf]]
            offsets = np.concatenate([[0], np.cumsum(self.ends - self.starts)]).astype(np.int32)
            strings = pa.Array.from_buffers(pa.binary(), len(self.starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined)])
            self.wid = strings.dictionary_encode().indices.to_numpy()
        return self.wid


def pack(w: Windows, travel: np.ndarray, buckets: int, minimiser: int):
    """Super-k-mers of the windows that travel, one compressed row for each bucket."""
    where = np.flatnonzero(travel)
    if not len(where):
        return
    least = sliding_min(rolling(w.h, minimiser), w.width - minimiser + 1)[where]
    new = np.concatenate([[True], (where[1:] != where[:-1] + 1) | (least[1:] != least[:-1]) | (w.owner[where[1:]] != w.owner[where[:-1]])])
    heads = np.flatnonzero(new)
    start = where[heads]
    count = np.diff(np.concatenate([heads, [len(where)]])) + w.width - 1
    bucket = (_mix(least[heads]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    start, count, bucket = start[order], count[order], bucket[order]
    lo, hi = w.starts[start], w.ends[start + count - 1]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    view, zip_ = memoryview(w.buf), zstandard.ZstdCompressor(level=3)
    for i, j in zip(cuts, cuts[1:], strict=False):
        head = np.stack([w.doc(start[i:j]), w.row(start[i:j]), w.at(start[i:j]), count[i:j]]).astype(np.int64).tobytes()
        body = b"\n".join([view[a:b] for a, b in zip(lo[i:j].tolist(), hi[i:j].tolist(), strict=True)])
        yield int(bucket[i]), int(j - i), zip_.compress(head + body)


def unpack(rows) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    heads, bodies, unzip = [], [], zstandard.ZstdDecompressor()
    for n, blob in rows:
        raw = unzip.decompress(blob)
        heads.append(np.frombuffer(raw, np.int64, 4 * n).reshape(4, n))
        bodies.append(raw[32 * n :])
    doc, row, base, count = np.concatenate(heads, axis=1) if heads else np.zeros((4, 0), np.int64)
    return b"\n".join(bodies), doc, row, base, count


def _by_document(w: Windows, lo: np.ndarray, hi: np.ndarray):
    """(document, row, packed spans) for runs lo..hi of windows."""
    doc, row, lo, hi = w.doc(lo), w.row(lo), w.at(lo), w.at(hi - 1) + 1
    order = np.lexsort((lo, row, doc))
    doc, row, lo, hi = doc[order], row[order], lo[order], hi[order]
    cuts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]), [True]])) if len(doc) else []
    for i, j in zip(cuts, cuts[1:], strict=False):
        yield int(doc[i]), int(row[i]), np.stack([lo[i:j], hi[i:j]]).astype(np.int32).tobytes()


def removed_spans(docs: DataFrame, width: int = WIDTH, minimiser: int = MINIMISER) -> DataFrame:
    """``docs`` has ``id``, ``row`` (both long; documents in their order) and the bytes ``body``; returns ``id``, ``row`` and ``spans``: packed starts and ends of runs of removed windows' starts, in words."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    buckets = max(shuffle_partitions(spark), -(-size // BUCKET_BYTES))
    schema = "bucket long, n int, blob binary, id long, row long"

    def cut(batches):
        def rows(ids, each, bodies):
            ids, each = np.array(ids, np.int64), np.array(each, np.int64)
            buf = b"\n".join(bodies)
            own = np.cumsum([len(b) + 1 for b in bodies]) - 1  # where each body ends in buf
            starts, _ = words(np.frombuffer(buf, np.uint8))
            n = np.diff(np.concatenate([[0], np.searchsorted(starts, own)]))
            w = Windows(buf, ids, each, np.zeros(len(ids), np.int64), n, width)
            again = w.repeats()
            for b, k, blob in pack(w, w.whole & ~again, buckets, minimiser):
                yield b, k, blob, None, None
            # a run of windows may pass from one document to the next
            for d, r, packed in _by_document(w, *_cut_runs(*spans(again), w.owner)):
                yield buckets + (d ^ r) % buckets, 0, packed, d, r

        for some in _blocks(batches, BLOCK_BYTES):
            got = list(rows(*some))
            cols = list(zip(*got, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, pa_schema_, strict=True)], names=pa_schema_.names)
            del got, cols
            tidy()

    pa_schema_ = pa_schema(spark, schema)

    def settle(key, group):
        if key[0].as_py() >= buckets:  # spans settled before the shuffle pass by
            return group.select(["id", "row", "blob"]).rename_columns(["id", "row", "spans"])
        w = Windows(*unpack(zip(group["n"].to_pylist(), group["blob"].to_pylist(), strict=True)), width)
        got = list(_by_document(w, *_cut_runs(*spans(w.repeats()), w.owner)))
        return pa.table({"id": pa.array([d for d, _, _ in got], pa.int64()), "row": pa.array([r for _, r, _ in got], pa.int64()), "spans": pa.array([x for _, _, x in got], pa.binary())})

    packed = docs.select("id", "row", "body").mapInArrow(cut, schema)
    # by the size of the texts, whatever the session's number of partitions is
    dealt = packed.repartition(max(shuffle_partitions(spark), -(-size // PARTITION_BYTES)), "bucket")
    return dealt.groupBy("bucket").applyInArrow(settle, "id long, row long, spans binary")


def _cut_runs(lo: np.ndarray, hi: np.ndarray, owner: np.ndarray):
    """Runs lo..hi cut where the owner changes."""
    if not len(lo):
        return _NONE, _NONE
    change = np.flatnonzero(owner[1:] != owner[:-1]) + 1
    at = np.searchsorted(change, lo, side="right")
    end = np.searchsorted(change, hi, side="left")
    extra = end - at
    if not extra.any():
        return lo, hi
    inner = np.concatenate([change[a:e] for a, e in zip(at, end, strict=True) if e > a])
    return np.sort(np.concatenate([lo, inner])), np.sort(np.concatenate([hi, inner]))


def _blocks(batches, size: int):
    ids, rows, bodies, have = [], [], [], 0
    for b in batches:
        for i, r, x in zip(b.column("id").to_pylist(), b.column("row").to_pylist(), b.column("body"), strict=True):
            ids.append(i)
            rows.append(r)
            bodies.append(x.as_py())
            have += len(bodies[-1])
            if have >= size:
                yield ids, rows, bodies
                ids, rows, bodies, have = [], [], [], 0
    if ids:
        yield ids, rows, bodies


def kept_words(body: bytes, packed: list[bytes] | None, width: int = WIDTH) -> tuple[int, list[bytes]]:
    """(words, the kept ones)."""
    all_ = body.split()
    if not packed or not all_:
        return len(all_), all_
    mark = np.zeros(len(all_) + 1, np.int32)
    for p in packed:
        lo, hi = np.frombuffer(p, np.int32).reshape(2, -1)
        np.add.at(mark, lo, 1)
        np.add.at(mark, np.minimum(hi + width - 1, len(all_)), -1)
    keep = np.cumsum(mark[:-1]) == 0
    return len(all_), [w for w, k in zip(all_, keep.tolist(), strict=True) if k]


def with_rows(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` (``id``, ``body``, ``keep``) with ``row``: 0 for an id of one row, else a hash of the row; whether any is of the second kind."""
    many = written(docs.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(True).alias("many")), f"{shared_dir(docs.sparkSession)}/many")
    if not (n := many.count()):
        return docs.withColumn("row", F.lit(0).cast("long")), False
    told = docs.join(F.broadcast(many) if n <= BROADCAST_IDS else many, "id", "left")
    return told.withColumn("row", F.when(F.col("many"), F.xxhash64("body", "keep")).otherwise(F.lit(0)).cast("long")).drop("many"), True


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, also: tuple[str, ...] = (), verbatim: bool = False) -> DataFrame:
    """The id of each row of ``docs`` and its columns ``also`` with ``n_words``, ``n_removed``, ``kept`` (kept words joined by one space) and ``kept_sha256``.

    With ``verbatim``, a text that loses no word stays as it is. Every row returns; texts of any length are taken whole. A null text has no words; so
    has an empty one. Fewer than ``width`` words are never removed. Each row is a document of its own: those of one id come in the order of a hash of
    the row, null ids before all others, and of equal rows one is the earlier document, so the others lose all their windows. An
    empty table gives an empty one. Of ``also``, a name that the result has itself is left out.
    """
    out = "n_words long, n_removed long, kept string, kept_sha256 string"
    added, slim = pa_schema(docs.sparkSession, out), docs.select(nested(dict.fromkeys((id, *also))).alias("keep"), long_id(id).alias("id"), utf8(text).alias("body"))
    rows, repeats = with_rows(slim)
    found = removed_spans(rows, width).groupBy("id", "row").agg(F.collect_list("spans").alias("spans"))
    told = rows.join(found, ["id", "row"], "left")
    parts = [told.where("row = 0").withColumn("copy", F.lit(1))] if repeats else [told.withColumn("copy", F.lit(1))]
    if repeats:
        # of equal rows one stands for all until here
        one = told.where("row != 0").groupBy("id", "row").agg(*[F.first(c).alias(c) for c in ("keep", "body", "spans")], F.count("*").cast("int").alias("n"))
        parts.append(one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))))

    def run(batches):
        for b in batches:
            got = []
            for body, packed, copy in zip(b.column("body"), b.column("spans"), b.column("copy").to_pylist(), strict=True):
                n, keep = kept_words(body.as_py(), packed.as_py(), width)
                if copy > 1 and n >= width:
                    keep = []
                joined = b" ".join(keep)
                got.append((n, n - len(keep), (body.as_py() if verbatim and len(keep) == n else joined).decode("utf-8", "replace"), hashlib.sha256(joined).hexdigest()))
            cols = list(zip(*got, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column("keep")] + [pa.array(v, f.type) for v, f in zip(cols, added, strict=True)], names=["keep"] + added.names)

    spec = f"keep {slim.schema['keep'].dataType.simpleString()}, {out}"
    each = [x.select("keep", "body", "spans", "copy").mapInArrow(run, spec) for x in parts]
    whole = each[0].unionByName(each[1]) if repeats else each[0]
    return whole.select(*unnested(tuple(dict.fromkeys((id, *also))), tuple(added.names), "keep"), *added.names)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {"op3_substring_dedup": op3_substring_dedup}
ORACLE = {
    "op3_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS rid, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), p AS (
  SELECT doc_id, rid, ws, unnest(range(1, len(ws) - 18)) AS pos FROM w WHERE len(ws) >= 20
), n AS (
  SELECT rid, pos, row_number() OVER (PARTITION BY array_to_string(ws[pos : pos + 19], ' ') ORDER BY doc_id, rid, pos) AS nth FROM p
), gone AS (
  SELECT DISTINCT rid, unnest(range(pos, pos + 20)) AS i FROM n WHERE nth > 1
), u AS (
  SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w
), k AS (
  SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM u ANTI JOIN gone USING (rid, i) GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (rid)
""",
}
