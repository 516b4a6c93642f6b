"""A large list inside one JSON document, read by tasks in stretches of its bytes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that one task reads.
SPLIT = 1 << 23
#: Values of the root in a stretch, and bytes between them, beyond which a document isn't one of a few large lists.
VALUES, BETWEEN = 1000, 1 << 24
#: Bytes and elements that a task hands on at once.
BATCH, ROWS = 1 << 22, 4096

_OPEN, _CLOSE, _COMMA = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[list(b"{[")], _KIND[list(b"}]")], _KIND[ord(",")] = _OPEN, _CLOSE, _COMMA
_STEP = np.array([0, 1, -1, 0])


def store(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _marks(data: bytes, run: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Number of quotes; place and kind of brackets and commas, and whether an odd number of quotes is before each. ``run``: backslashes right before ``data``."""
    b = np.frombuffer(data, np.uint8)
    quotes, back = np.flatnonzero(b == ord('"')), np.flatnonzero(b == ord("\\"))
    if run or len(back):
        starts = back[np.diff(back, prepend=-2) != 1]
        n = np.zeros(len(quotes), np.int64)
        after = (quotes > 0) & (b[quotes - 1] == ord("\\"))
        n[after] = quotes[after] - starts[np.searchsorted(starts, quotes[after]) - 1]
        n[n == quotes] += run
        quotes = quotes[n % 2 == 0]
    at = np.flatnonzero(_KIND[b])
    return len(quotes), at, _KIND[b[at]], np.searchsorted(quotes, at) & 1


def _run(f, at: int) -> int:
    """Backslashes right before ``at``."""
    n, size = 0, 64
    while n < at:
        piece = f.read_at(min(size, at - n), max(0, at - n - size))
        kept = len(piece.rstrip(b"\\"))
        n += len(piece) - kept
        if kept:
            break
        size *= 2
    return n


def _structure(f, begin: int, end: int, inside: int, depth: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, int]:
    """The bytes of a stretch; place, kind and depth behind of what is outside of texts; whether the stretch ends in a text. ``inside``: whether it begins in one."""
    data = f.read_at(end - begin, begin)
    n, at, kind, odd = _marks(data, _run(f, begin))
    own = odd == inside
    at, kind = at[own], kind[own]
    return data, at, kind, depth + np.cumsum(_STEP[kind]), (inside + n) % 2


def _each(spark: SparkSession, rows: list[tuple], ddl: str, call, out: str) -> DataFrame:
    """``call`` with the values of each of the ``rows``, one to a task, gives Arrow batches of ``out``."""

    def run(batches):
        for b in batches:
            for values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield from call(*values)

    return spark.createDataFrame(rows, ddl).repartitionByRange(len(rows), "begin").mapInArrow(run, out)


def _states(spark: SparkSession, path: str, size: int, split: int) -> list[tuple[int, int, int, int]] | None:
    """(first byte, end, whether it begins in a text, depth) of each stretch; None if the last leaves something open."""

    def call(begin, end):
        where, name = store(path)
        with where.open_input_file(name) as f:
            n, _, kind, odd = _marks(f.read_at(end - begin, begin), _run(f, begin))
        steps = _STEP[kind]
        yield pa.RecordBatch.from_pydict({"begin": [begin], "end": [end], "quotes": [n], "even": [int(steps[odd == 0].sum())], "odd": [int(steps[odd == 1].sum())]})

    out, inside, depth = [], 0, 0
    found = _each(spark, [(a, min(a + split, size)) for a in range(0, size, split)], "begin long, end long", call, "begin long, end long, quotes long, even long, odd long")
    for r in sorted(found.collect()):
        out.append((r.begin, r.end, inside, depth))
        depth += r.odd if inside else r.even
        inside = (inside + r.quotes) % 2
    return None if inside or depth else out


class Root:
    """The values of a document's root object: plain ones as they are, lists and objects by their place."""

    def __init__(self, path: str, states: list[tuple[int, int, int, int]], nested: list[tuple[int, int, int]], commas: list[int], values: dict):
        self.path, self.states, self.nested, self.commas, self.values = path, states, nested, commas, values

    def text(self, keys: list[str]) -> str:
        """A JSON object of those of the ``keys`` that are there."""
        where, name = store(self.path)
        parts = []
        with where.open_input_file(name) as f:
            for k in keys:
                v = self.values.get(k)
                if isinstance(v, list):
                    begin, end, _ = self.nested[v[0]]
                    v = f.read_at(end + 1 - begin, begin).decode("utf-8")
                else:
                    v = json.dumps(v)
                parts.append(f"{json.dumps(k)}: {v}")
        return "{" + ", ".join(parts) + "}"

    def elements(self, spark: SparkSession, key: str) -> DataFrame | None:
        """``i`` from 0 and ``text`` of each element of the list called ``key``; None if that is no list."""
        v, path = self.values.get(key), self.path
        if not isinstance(v, list):
            return None
        low, high, before = self.nested[v[0]]
        where, name = store(path)
        with where.open_input_file(name) as f:
            if f.read_at(1, low) != b"[":
                return None
        rows = [(*s, low, high, max(0, c - before)) for s, c in zip(self.states, self.commas, strict=True) if s[0] <= high and s[1] > low]

        def call(begin, end, inside, depth, low, high, first) -> Iterator[pa.RecordBatch]:
            where, name = store(path)
            with where.open_input_file(name) as f:
                data, at, kind, behind, inside = _structure(f, begin, end, inside, depth)
                depth = int(behind[-1]) if len(behind) else depth
                # an element belongs to the stretch of the bracket or comma before it
                cuts = at[(behind == 2) & (kind == _COMMA) & (at + begin > low) & (at + begin < high)]
                number = first + 1
                if begin <= low:
                    cuts, number = np.concatenate([[low - begin], cuts]), 0
                if not len(cuts):
                    return
                stop, end = high - begin, begin + len(data)
                if stop > len(data):
                    rest, stop = [data], len(data)
                    while end < high:
                        more, at, kind, behind, inside = _structure(f, end, min(end + SPLIT, high), inside, depth)
                        depth = int(behind[-1]) if len(behind) else depth
                        found = at[(behind == 2) & (kind == _COMMA)]
                        rest.append(more[: found[0]] if len(found) else more)
                        stop += len(rest[-1])
                        if len(found):
                            break
                        end += len(more)
                    data = b"".join(rest)
            ends = np.append(cuts[1:], stop)
            if number == 0 and len(cuts) == 1 and begin + stop == high and not data[cuts[0] + 1 : stop].strip():
                return  # an empty list
            i = 0
            while i < len(cuts):
                j = min(max(i + 1, int(np.searchsorted(ends, cuts[i] + BATCH, "right"))), i + ROWS)
                texts = [data[a + 1 : b] for a, b in zip(cuts[i:j].tolist(), ends[i:j].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(number + i, number + j, dtype=np.int64)), pa.array(texts, pa.binary())], ["i", "text"])
                i = j

        found = _each(spark, rows, "begin long, end long, inside int, depth int, low long, high long, first long", call, "i long, text binary")
        return found.select("i", F.col("text").cast("string").alias("text"))


def root(spark: SparkSession, path: str, split: int = SPLIT) -> Root | None:
    """The root of a document of more than ``split`` bytes; None if it is smaller, no plain UTF-8 file of one object, or one of very many values."""
    try:
        where, name = store(path)
        info = where.get_file_info(name)
        if info.type != fs.FileType.File or info.size <= split:
            return None
        with where.open_input_file(name) as f:
            head = f.read_at(1024, 0)
    except (OSError, ValueError, pa.ArrowException):
        return None  # a pattern, a folder's list or a store that only Spark reads
    if b"\0" in head or not head.removeprefix(b"\xef\xbb\xbf").lstrip().startswith(b"{"):
        return None
    states = _states(spark, path, info.size, split)
    if states is None:
        return None

    def call(begin, end, inside, depth):
        where, name = store(path)
        with where.open_input_file(name) as f:
            _, at, kind, behind, _ = _structure(f, begin, end, inside, depth)
        step = _STEP[kind]
        level, comma = np.minimum(behind, behind - step), at[(kind == _COMMA) & (behind == 2)]
        top = (level <= 1) & (step != 0)
        places = at[top]
        yield pa.RecordBatch.from_pydict(
            {"begin": [begin], "at": [(places + begin).tolist()[: 2 * VALUES + 1]], "behind": [behind[top].tolist()[: 2 * VALUES + 1]], "commas": [np.searchsorted(comma, places).tolist()[: 2 * VALUES + 1]], "all": [len(comma)]},
            pa.schema([("begin", pa.int64()), ("at", pa.list_(pa.int64())), ("behind", pa.list_(pa.int64())), ("commas", pa.list_(pa.int64())), ("all", pa.int64())]),
        )

    events, commas, total = [], [], 0
    found = _each(spark, states, "begin long, end long, inside int, depth int", call, "begin long, at array<long>, behind array<long>, commas array<long>, all long")
    for r in sorted(found.collect(), key=lambda r: r.begin):
        if len(r["at"]) > 2 * VALUES:
            return None
        commas.append(total)
        events += [(a, d, total + c) for a, d, c in zip(r["at"], r["behind"], r["commas"], strict=True)]
        total += r["all"]
    levels = [d for _, d, _ in events]
    if len(levels) % 2 or levels != [1, *[2, 1] * (len(levels) // 2 - 1), 0]:
        return None
    nested = [(a, b, c) for (a, _, c), (b, _, _) in zip(events[1:-1:2], events[2:-1:2], strict=True)]
    gaps = list(zip([0, *[b + 1 for _, b, _ in nested]], [*[a for a, _, _ in nested], info.size], strict=True))
    if sum(b - a for a, b in gaps) > BETWEEN:
        return None
    with where.open_input_file(name) as f:
        pieces = [f.read_at(b - a, a) for a, b in gaps]
    try:
        # each list or object stands as its number in brackets
        text = pieces[0] + b"".join(b"[%d]%s" % (i, p) for i, p in enumerate(pieces[1:]))
        values = json.loads(text.decode("utf-8-sig"))
    except ValueError:
        return None
    return Root(path, states, nested, commas, values)
