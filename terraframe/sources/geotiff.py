"""GeoTIFF: metadata, windowed reads and chunk tables; strips or tiles, classic or big, raw, deflate, LZW or PackBits.

Files are opened through pyarrow's filesystems, so any task can read the blocks
of its own window and no more. Chunk rows hold one block of one band each.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe import schemas

#: Fixed values of the format.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, PER_PIXEL, ROWS_PER_STRIP, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_W, TILE_H, TILE_OFFSETS, TILE_COUNTS, FORMAT = 322, 323, 324, 325, 339
SCALE, TIE, MATRIX, GEO_KEYS, NODATA = 33550, 33922, 34264, 34735, 42113
GEOGRAPHIC_KEY, PROJECTED_KEY = 2048, 3072


class GeoTiff:
    def __init__(self, uri: str):
        if "://" in uri or uri.startswith("file:"):
            store, path = fs.FileSystem.from_uri(uri)
        else:
            store, path = fs.LocalFileSystem(), uri
        self.uri, self.file = uri, store.open_input_file(path)
        head = self.file.read_at(16, 0)
        if head[:2] not in (b"II", b"MM"):
            raise ValueError(f"not a TIFF file: {uri}")
        self.order = "<" if head[:2] == b"II" else ">"
        magic = struct.unpack(self.order + "H", head[2:4])[0]
        if magic not in (42, 43):
            raise ValueError(f"not a TIFF file: {uri}")
        self.big = magic == 43
        at = struct.unpack(self.order + ("Q" if self.big else "I"), head[8:16] if self.big else head[4:8])[0]
        self.tags = self._directory(at)
        one = lambda t, d=None: self.tags.get(t, (d,))[0]
        self.width, self.height, self.bands = one(WIDTH), one(HEIGHT), one(PER_PIXEL, 1)
        self.compression, self.predictor, self.planar = one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
        if self.compression not in (1, 5, 8, 32773, 32946):
            raise ValueError(f"compression {self.compression} is not supported: {uri}")
        kind = {1: "u", 2: "i", 3: "f"}.get(one(FORMAT, 1))
        if kind is None or len(set(self.tags.get(BITS, (8,)))) > 1 or one(BITS, 8) % 8:
            raise ValueError(f"sample format is not supported: {uri}")
        self.dtype = np.dtype(f"{kind}{one(BITS, 8) // 8}")
        self.tiled = TILE_W in self.tags
        self.bw, self.bh = (one(TILE_W), one(TILE_H)) if self.tiled else (self.width, min(one(ROWS_PER_STRIP, self.height), self.height))
        self.offsets, self.counts = self.tags[TILE_OFFSETS if self.tiled else OFFSETS], self.tags[TILE_COUNTS if self.tiled else COUNTS]
        self.across = -(-self.width // self.bw)
        self.down = -(-self.height // self.bh)
        nodata = self.tags.get(NODATA)
        self.nodata = float(nodata[0].strip("\0 ")) if nodata and nodata[0].strip("\0 ") else None
        self.transform = self._affine()
        self.crs = self._crs()

    def _directory(self, at: int) -> dict:
        wide = self.big
        n = struct.unpack(self.order + ("Q" if wide else "H"), self.file.read_at(8 if wide else 2, at))[0]
        size, start = (20, at + 8) if wide else (12, at + 2)
        raw, out = self.file.read_at(n * size, start), {}
        for i in range(n):
            e = raw[i * size : (i + 1) * size]
            tag, kind = struct.unpack(self.order + "HH", e[:4])
            count = struct.unpack(self.order + ("Q" if wide else "I"), e[4 : 12 if wide else 8])[0]
            field = e[12:] if wide else e[8:]
            need = _SIZES.get(kind, 1) * count
            data = field[:need] if need <= len(field) else self.file.read_at(need, struct.unpack(self.order + ("Q" if wide else "I"), field)[0])
            if kind == 2:
                out[tag] = (data.decode("latin-1"),)
            elif kind in _CODES:
                out[tag] = struct.unpack(f"{self.order}{count}{_CODES[kind]}", data)
        return out

    def _affine(self) -> tuple[float, ...]:
        if MATRIX in self.tags:
            m = self.tags[MATRIX]
            return m[0], m[1], m[3], m[4], m[5], m[7]
        if SCALE in self.tags and TIE in self.tags:
            (sx, sy, *_), (i, j, _, x, y, *_) = self.tags[SCALE], self.tags[TIE]
            return sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy
        return 1.0, 0.0, 0.0, 0.0, 1.0, 0.0

    def _crs(self) -> str | None:
        keys = self.tags.get(GEO_KEYS, ())
        found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        code = found.get(PROJECTED_KEY) or found.get(GEOGRAPHIC_KEY)
        return f"EPSG:{code}" if code and code < 32767 + 1 else None

    def _block(self, k: int, samples: int, rows: int) -> np.ndarray:
        raw = self.file.read_at(self.counts[k], self.offsets[k])
        shape = (rows, self.bw, samples)
        size = rows * self.bw * samples * self.dtype.itemsize
        if self.compression in (8, 32946):
            raw = zlib.decompress(raw)
        elif self.compression == 5:
            raw = lzw(raw)
        elif self.compression == 32773:
            raw = packbits(raw)
        raw = raw[:size].ljust(size, b"\0")
        if self.predictor == 3:
            b = np.frombuffer(raw, np.uint8).reshape(rows, -1, samples)
            b = np.cumsum(b, axis=1, dtype=np.uint8).reshape(rows, self.dtype.itemsize, self.bw * samples)
            return np.ascontiguousarray(b[:, ::-1].transpose(0, 2, 1)).view(self.dtype.newbyteorder("<")).reshape(shape)
        a = np.frombuffer(raw, self.dtype.newbyteorder(self.order)).reshape(shape).astype(self.dtype)
        return np.cumsum(a, axis=1, dtype=self.dtype) if self.predictor == 2 else a

    def read(self, x: int, y: int, w: int, h: int, bands: tuple[int, ...] = (1,)) -> np.ndarray:
        """A window as [h, w, bands]; only the blocks that it touches are read."""
        if x < 0 or y < 0 or x + w > self.width or y + h > self.height or max(bands) > self.bands:
            raise ValueError("the window reaches outside the raster")
        out = np.zeros((h, w, len(bands)), self.dtype)
        for by in range(y // self.bh, -(-(y + h) // self.bh)):
            rows = self.bh if self.tiled else min(self.bh, self.height - by * self.bh)
            for bx in range(x // self.bw, -(-(x + w) // self.bw)):
                top, left = by * self.bh, bx * self.bw
                r0, r1, c0, c1 = max(y, top), min(y + h, top + rows), max(x, left), min(x + w, left + self.bw)
                k = by * self.across + bx
                if self.planar == 1:
                    block = self._block(k, self.bands, rows)[r0 - top : r1 - top, c0 - left : c1 - left]
                    out[r0 - y : r1 - y, c0 - x : c1 - x] = block[:, :, [b - 1 for b in bands]]
                else:
                    for i, b in enumerate(bands):
                        block = self._block(k + (b - 1) * self.across * self.down, 1, rows)
                        out[r0 - y : r1 - y, c0 - x : c1 - x, i] = block[r0 - top : r1 - top, c0 - left : c1 - left, 0]
        return out

    def rgb(self, x: int, y: int, w: int, h: int) -> np.ndarray:
        """Bands 1 to 3, or the first one three times; clamped to 0..255 and cut to whole numbers."""
        a = self.read(x, y, w, h, (1, 2, 3)) if self.bands >= 3 else np.repeat(self.read(x, y, w, h), 3, axis=2)
        return np.clip(np.nan_to_num(a), 0, 255).astype(np.uint8)

    def decimated(self, x: int, y: int, w: int, h: int, size: int = 64) -> np.ndarray:
        """Band 1 of a window at size x size samples, the nearest to each cell's centre."""
        rows = ((np.arange(size) + 0.5) * h / size).astype(int)
        cols = ((np.arange(size) + 0.5) * w / size).astype(int)
        return np.stack([self.read(x, y + int(r), w, 1)[0, cols, 0] for r in rows])

    def info(self) -> tuple:
        a, b, c, d, e, f = self.transform
        corners = [(a * i + b * j + c, d * i + e * j + f) for i in (0, self.width) for j in (0, self.height)]
        xs, ys = zip(*corners, strict=True)
        return self.uri, self.width, self.height, self.bands, self.crs, (a, b, c, d, e, f), (min(xs), max(xs), min(ys), max(ys)), abs(a), abs(e), self.nodata


def lzw(data: bytes) -> bytes:
    out, table, width, at, prev = bytearray(), [], 9, 0, None
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    bits = int.from_bytes(data, "big")
    total = len(data) * 8
    while at + width <= total:
        code = (bits >> (total - at - width)) & ((1 << width) - 1)
        at += width
        if code == 257:
            break
        if code == 256:
            table, width, prev = list(base), 9, None
            continue
        if prev is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else prev + prev[:1]
            table.append(prev + entry[:1])
        out += entry
        prev = entry
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def write(path: str, data: np.ndarray, transform=(1.0, 0.0, 0.0, 0.0, -1.0, 0.0), epsg: int | None = None, nodata: float | None = None, tile: int | None = None, deflate: bool = False, predictor: int = 1) -> None:
    """A little-endian GeoTIFF of [h, w] or [h, w, bands]."""
    data = np.atleast_3d(data)
    h, w, bands = data.shape
    data = np.ascontiguousarray(data.astype(data.dtype.newbyteorder("<")))
    bw, bh = (tile, tile) if tile else (w, max(1, min(h, 65536 // max(1, w * bands * data.itemsize))))
    blocks = []
    for y in range(0, h, bh):
        for x in range(0, w, bw):
            b = data[y : y + bh, x : x + bw]
            if tile:
                b = np.pad(b, ((0, bh - b.shape[0]), (0, bw - b.shape[1]), (0, 0)))
            if predictor == 2:
                b = np.concatenate([b[:, :1], np.diff(b, axis=1)], axis=1)
            raw = np.ascontiguousarray(b).tobytes()
            blocks.append(zlib.compress(raw) if deflate else raw)
    a, b, c, d, e, f = transform
    kind = {"u": 1, "i": 2, "f": 3}[data.dtype.kind]
    tags: list[tuple[int, int, tuple]] = [(WIDTH, 4, (w,)), (HEIGHT, 4, (h,)), (BITS, 3, (data.itemsize * 8,) * bands), (COMPRESSION, 3, (8 if deflate else 1,)), (262, 3, (2 if bands >= 3 else 1,)), (PER_PIXEL, 3, (bands,)), (PREDICTOR, 3, (predictor,)), (FORMAT, 3, (kind,) * bands), (MATRIX, 12, (a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0))]
    if epsg:
        geographic = epsg == 4326
        tags.append((GEO_KEYS, 3, (1, 1, 0, 2, 1024, 0, 1, 2 if geographic else 1, GEOGRAPHIC_KEY if geographic else PROJECTED_KEY, 0, 1, epsg)))
    if nodata is not None:
        tags.append((NODATA, 2, tuple(f"{nodata:g}\0".encode())))
    where, at = [], 8
    for x in blocks:
        where.append(at)
        at += len(x) + len(x) % 2
    tags += [(TILE_W, 3, (bw,)), (TILE_H, 3, (bh,)), (TILE_OFFSETS, 4, tuple(where)), (TILE_COUNTS, 4, tuple(map(len, blocks)))] if tile else [(ROWS_PER_STRIP, 4, (bh,)), (OFFSETS, 4, tuple(where)), (COUNTS, 4, tuple(map(len, blocks)))]
    tags.sort()
    extra, entries, free = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag, k, values in tags:
        raw = bytes(values) if k == 2 else struct.pack(f"<{len(values)}{_CODES[k]}", *values)
        entries += struct.pack("<HHI", tag, k, len(values)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", free + len(extra)))
        extra += raw + b"\0" * (len(raw) % 2) if len(raw) > 4 else b""
    body = b"".join(x + b"\0" * (len(x) % 2) for x in blocks)
    store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with store.open_output_stream(name) as out:
        out.write(b"II*\0" + struct.pack("<I", at) + body + struct.pack("<H", len(tags)) + entries + b"\0" * 4 + extra)


def raster_info(spark: SparkSession, path: str) -> DataFrame:
    """One row of metadata."""
    return spark.createDataFrame([GeoTiff(path).info()], schemas.RASTER_INFO)


def chunks(spark: SparkSession, path: str, size: int = 512, bands: tuple[int, ...] = (1,)) -> DataFrame:
    """The raster as chunk rows (schemas.CHUNK); tasks read their own chunks."""
    t = GeoTiff(path)
    grid = spark.range(-(-t.height // size)).select((F.col("id") * size).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(t.width - 1), F.lit(size))))
    n = min(4096, max(1, (-(-t.height // size)) * (-(-t.width // size)) // 4))
    width, height, nodata = t.width, t.height, t.nodata

    def run(batches):
        own = GeoTiff(path)
        for b in batches:
            for y, x in zip(b.column("y").to_pylist(), b.column("x").to_pylist(), strict=True):
                w, h = min(size, width - x), min(size, height - y)
                data = own.read(x, y, w, h, bands)
                for i, band in enumerate(bands):
                    row = [path, band, x, y, w, h, own.dtype.str, nodata, np.ascontiguousarray(data[:, :, i]).tobytes()]
                    kinds = [pa.string(), *[pa.int32()] * 5, pa.string(), pa.float64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["raster_id", "band", "x_off", "y_off", "w", "h", "dtype", "nodata", "data"])

    return grid.repartition(n).mapInArrow(run, schemas.CHUNK)


def cells(chunks_: DataFrame) -> DataFrame:
    """Chunk rows as cells ``row, col, z``; no-data and NaN become null."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                z = np.frombuffer(r["data"], r["dtype"]).astype(np.float64)
                bad = np.isnan(z) | (z == r["nodata"] if r["nodata"] is not None else False)
                row, col = np.divmod(np.arange(len(z)), r["w"])
                yield pa.RecordBatch.from_arrays([pa.array((row + r["y_off"]).astype(np.int32)), pa.array((col + r["x_off"]).astype(np.int32)), pa.array(z, mask=bad)], names=["row", "col", "z"])

    return chunks_.mapInArrow(run, "row int, col int, z double")


def regridded(spark: SparkSession, fine: str, coarse: str, size: int = 512) -> DataFrame:
    """Cells ``row, col, z, ground`` of the raster ``fine`` with the bilinear value of ``coarse`` at their centres; north-up rasters of one system.

    A task reads a chunk of the one and, with a cell more on each side, what lies under it of the other: nothing is
    shuffled. A neighbour that is no-data or outside leaves its weight to the others; none at all gives null.
    """
    a, _, c, _, e, f = GeoTiff(fine).transform

    def under(own: GeoTiff, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ta, _, tc, _, te, tf = own.transform
        fr, fc = (y - tf) / te - 0.5, (x - tc) / ta - 0.5
        r0, c0 = np.floor(fr).astype(int), np.floor(fc).astype(int)
        top, left = max(0, r0.min()), max(0, c0.min())
        h, w = min(own.height, r0.max() + 2) - top, min(own.width, c0.max() + 2) - left
        if h <= 0 or w <= 0:
            return np.full((len(y), len(x)), np.nan)
        z = own.read(left, top, w, h)[:, :, 0].astype(np.float64)
        ok = ~np.isnan(z) & (z != own.nodata if own.nodata is not None else True)
        z, value, weight = np.where(ok, z, 0), 0.0, 0.0
        for i in (0, 1):
            for j in (0, 1):
                r, k = r0 + i - top, c0 + j - left
                there = ((r >= 0) & (r < h))[:, None] & ((k >= 0) & (k < w))[None, :]
                at = np.ix_(np.clip(r, 0, h - 1), np.clip(k, 0, w - 1))
                share = (fr - r0 if i else 1 - fr + r0)[:, None] * (fc - c0 if j else 1 - fc + c0)[None, :] * (there & ok[at])
                value, weight = value + share * z[at], weight + share
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(weight > 0, value / weight, np.nan)

    def run(batches):
        own = GeoTiff(coarse)
        for b in batches:
            for r in b.to_pylist():
                z = np.frombuffer(r["data"], r["dtype"]).astype(np.float64)
                rows, cols = np.arange(r["h"]) + r["y_off"], np.arange(r["w"]) + r["x_off"]
                ground = under(own, c + (cols + 0.5) * a, f + (rows + 0.5) * e).ravel()
                bad = np.isnan(z) | (z == r["nodata"] if r["nodata"] is not None else False)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows, len(cols)).astype(np.int32)), pa.array(np.tile(cols, len(rows)).astype(np.int32)), pa.array(z, mask=bad), pa.array(ground, mask=np.isnan(ground))], names=["row", "col", "z", "ground"])

    return chunks(spark, fine, size).mapInArrow(run, "row int, col int, z double, ground double")


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format("geotiff").load(path)`` give chunk rows; options: chunk, band."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.path, self.size, self.band = options["path"], int(options.get("chunk", "512")), int(options.get("band", "1"))

        def partitions(self):
            t = GeoTiff(self.path)
            return [InputPartition((y, t.width, t.height)) for y in range(0, t.height, self.size)]

        def read(self, partition):
            (y, width, height), t = partition.value, GeoTiff(self.path)
            for x in range(0, width, self.size):
                w, h = min(self.size, width - x), min(self.size, height - y)
                yield self.path, self.band, x, y, w, h, t.dtype.str, t.nodata, np.ascontiguousarray(t.read(x, y, w, h, (self.band,))[:, :, 0]).tobytes()

    class Source(DataSource):
        @classmethod
        def name(cls):
            return "geotiff"

        def schema(self):
            return schemas.CHUNK

        def reader(self, schema):
            return Reader(self.options)

    spark.dataSource.register(Source)
