"""Tile inference: letterboxing, head decoding, masks and contours, in numpy inside Arrow tasks.

One tile is held at a time; each mask becomes a polygon before the next is made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

COEFFICIENTS = 32
GREY = np.float32(114 / 255)


def is_blank(rgb: np.ndarray) -> bool:
    """All samples 0 or all 255."""
    return bool((rgb == 0).all() or (rgb == 255).all())


def letterbox(rgb: np.ndarray, size: int) -> tuple[np.ndarray, float, int, int]:
    """(CHW input in 0..1, scale, left pad, top pad) of an HWC tile: scaled to fit, bilinear at half-pixel centres, padded grey.

    The lower weights are not clamped at the top and left edges, where they may extrapolate a little.
    """
    h, w = rgb.shape[:2]
    scale = min(size / w, size / h)
    nw, nh = int(np.floor(w * scale + 0.5)), int(np.floor(h * scale + 0.5))
    px, py = (size - nw) // 2, (size - nh) // 2

    def axis(n, full):
        at = np.minimum((np.arange(n) + 0.5) / scale - 0.5, full - 1)
        lo = np.maximum(np.floor(at), 0).astype(int)
        return lo, np.minimum(lo + 1, full - 1), at - lo

    y0, y1, fy = axis(nh, h)
    x0, x1, fx = axis(nw, w)
    src = rgb.astype(np.float64)
    rows = src[y0] * (1 - fy)[:, None, None] + src[y1] * fy[:, None, None]
    out = rows[:, x0] * (1 - fx)[None, :, None] + rows[:, x1] * fx[None, :, None]
    chw = np.full((3, size, size), GREY, np.float32)
    chw[:, py : py + nh, px : px + nw] = out.transpose(2, 0, 1) / 255
    return chw, scale, px, py


def decode_head(head: np.ndarray, confidence: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(boxes x0 y0 x1 y1, scores, mask coefficients) of a [4 + classes + 32, N] head, scores at or above the threshold."""
    classes = head.shape[0] - 4 - COEFFICIENTS
    score = np.maximum(head[4 : 4 + classes].max(axis=0, initial=0), 0)
    keep = np.flatnonzero(score.astype(np.float64) >= confidence)
    cx, cy, w, h = head[:4, keep].astype(np.float64)
    return np.stack([cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2], axis=1), score[keep].astype(np.float64), head[4 + classes :, keep].T


def box_nms(boxes: np.ndarray, scores: np.ndarray, threshold: float, area: np.ndarray | None = None) -> np.ndarray:
    """Places of kept boxes by score, greedy; equal scores stay in order. ``area``, if known, spares the rounding of corner differences."""
    order, kept = np.argsort(-scores, kind="stable"), []
    area = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1]) if area is None else area
    while len(order):
        i, order = order[0], order[1:]
        kept.append(i)
        w = np.minimum(boxes[order, 2], boxes[i, 2]) - np.maximum(boxes[order, 0], boxes[i, 0])
        h = np.minimum(boxes[order, 3], boxes[i, 3]) - np.maximum(boxes[order, 1], boxes[i, 1])
        inter = np.maximum(w, 0) * np.maximum(h, 0)
        union = area[order] + area[i] - inter
        order = order[np.where(union > 0, inter / np.where(union > 0, union, 1), 0) <= threshold]
    return np.array(kept, int)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def instance_mask(coefficients: np.ndarray, protos: np.ndarray, box: np.ndarray, w: int, h: int, size: int, scale: float, px: int, py: int) -> np.ndarray:
    """Mask of a detection on its tile: prototypes weighted and squashed, cropped to the box, sampled back bilinearly with clamped weights."""
    n, mh, mw = protos.shape
    small = sigmoid((coefficients.astype(np.float64) @ protos.reshape(n, -1).astype(np.float64)).astype(np.float32)).reshape(mh, mw)
    ratio = size / mw

    def axis(full, pad, n, lo, hi):
        at = (np.arange(full) * scale + pad) / ratio
        i0 = np.clip(np.floor(at - 0.5), 0, n - 1).astype(int)
        return i0, np.minimum(i0 + 1, n - 1), np.clip(at - 0.5 - i0, 0, 1), (at >= lo) & (at <= hi)

    y0, y1, fy, iny = axis(h, py, mh, box[1] / ratio, box[3] / ratio)
    x0, x1, fx, inx = axis(w, px, mw, box[0] / ratio, box[2] / ratio)
    rows = small[y0] * (1 - fy)[:, None] + small[y1] * fy[:, None]
    out = rows[:, x0] * (1 - fx)[None, :] + rows[:, x1] * fx[None, :]
    return np.where(iny[:, None] & inx[None, :], out, 0).astype(np.float32)


def contours(mask: np.ndarray, level: float = 0.5) -> list[np.ndarray]:
    """Closed rings around samples at or above the level, by marching squares with linear interpolation; samples sit at pixel centres.

    Rings around an inside turn one way, rings around a hole the other; see outer().
    """
    v = np.pad(mask.astype(np.float64), 1)
    on = v >= level
    a, b, c, d = on[:-1, :-1], on[:-1, 1:], on[1:, 1:], on[1:, :-1]
    case = a * 8 + b * 4 + c * 2 + d * 1
    rows, cols = np.nonzero((case > 0) & (case < 15))
    # sides of a cell: 0 top, 1 right, 2 bottom, 3 left; each step runs with the inside on its right
    steps = {1: [(3, 2)], 2: [(2, 1)], 3: [(3, 1)], 4: [(1, 0)], 5: [(3, 2), (1, 0)], 6: [(2, 0)], 7: [(3, 0)], 8: [(0, 3)], 9: [(0, 2)], 10: [(0, 3), (2, 1)], 11: [(0, 1)], 12: [(1, 3)], 13: [(1, 2)], 14: [(2, 3)]}
    name = lambda r, c, side: (r, c, 0) if side == 0 else (r, c + 1, 1) if side == 1 else (r + 1, c, 0) if side == 2 else (r, c, 1)
    nxt = {name(r, c, s): name(r, c, e) for r, c in zip(rows.tolist(), cols.tolist(), strict=True) for s, e in steps[int(case[r, c])]}

    def place(edge):
        r, c, upright = edge
        p, q = v[r, c], v[r + upright, c + 1 - upright]
        t = (level - p) / (q - p)
        return (c - 0.5 + (0 if upright else t), r - 0.5 + (t if upright else 0))

    rings = []
    while nxt:
        first, at = next(iter(nxt.items()))
        del nxt[first]
        ring = [place(first)]
        while at != first:
            ring.append(place(at))
            at = nxt.pop(at)
        ring.append(ring[0])
        rings.append(np.array(ring))
    return rings


def signed(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def outer(mask: np.ndarray, level: float = 0.5) -> np.ndarray | None:
    """The outer ring of the largest area, the first of equals; holes and other parts are given up."""
    best, area = None, 0.0
    for ring in contours(mask, level):
        s = signed(ring)
        if s * _OUTSIDE > 0 and abs(s) > area:
            best, area = ring, abs(s)
    return best if best is not None and len(best) >= 3 else None


#: The sign of rings around an inside.
_OUTSIDE = float(np.sign(signed(contours(np.ones((1, 1)))[0])))


def detect(rgb: np.ndarray, run, size: int, confidence: float, iou: float) -> list[tuple[np.ndarray, float]]:
    """(ring in tile pixels, score) of each detection on a tile. ``run`` maps a [1, 3, size, size] input to (head, prototypes)."""
    if is_blank(rgb):
        return []
    h, w = rgb.shape[:2]
    chw, scale, px, py = letterbox(rgb, size)
    head, protos = run(chw[None])
    boxes, scores, coefficients = decode_head(np.asarray(head)[0], confidence)
    out = []
    for i in box_nms(boxes, scores, iou):
        ring = outer(instance_mask(coefficients[i], np.asarray(protos)[0], boxes[i], w, h, size, scale, px, py))
        if ring is not None:
            out.append((ring, float(scores[i])))
    return out


_SESSIONS: dict = {}


def onnx_runner(path: str):
    """A runner of the model at ``path``, one session a worker process: CUDA where it starts, else the CPU."""
    if path not in _SESSIONS:
        import onnxruntime as ort

        try:
            s = ort.InferenceSession(path, providers=["CUDAExecutionProvider"])
        except Exception:
            s = ort.InferenceSession(path, providers=["CPUExecutionProvider"])
        _SESSIONS[path] = s
    s = _SESSIONS[path]
    return lambda x: s.run(None, {s.get_inputs()[0].name: x})[:2]


def infer(tiles: DataFrame, read, runner, size: int = 1280, confidence: float = 0.4, iou: float = 0.5) -> DataFrame:
    """Raw detections of ``tiles`` (x_off, y_off, w, h), in global pixels.

    ``read(x, y, w, h)`` gives an HWC array, ``runner()`` a function from input to (head, prototypes); both run in the
    workers. ``det_id`` holds tile row, tile column and rank in the tile, so that its order is that of the scan. A tile
    that fails is reported in ``error`` by a row without a polygon.
    """

    def run(batches):
        model = runner()
        for b in batches:
            for t in b.to_pylist():
                x, y, rows = t["x_off"], t["y_off"], []
                try:
                    found = detect(read(x, y, t["w"], t["h"]), model, size, confidence, iou)
                    for k, (ring, score) in enumerate(found):
                        rows.append(((y * (1 << 20) + x) * (1 << 12) + k, [[{"x": float(p), "y": float(q)} for p, q in ring + (x, y)]], score, x, y, None))
                except Exception as e:
                    rows.append(((y * (1 << 20) + x) * (1 << 12), None, None, x, y, str(e)[:200]))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    ring_type = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
                    kinds = [pa.int64(), ring_type, pa.float64(), pa.int32(), pa.int32(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["det_id", "geom", "confidence", "tile_x", "tile_y", "error"])

    return tiles.select("x_off", "y_off", "w", "h").mapInArrow(run, "det_id long, geom array<array<struct<x:double,y:double>>>, confidence double, tile_x int, tile_y int, error string")
