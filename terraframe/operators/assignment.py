"""Optimal one-to-one assignment of predictions to references, by total IoU.

Pairs without overlap add nothing and never pass the threshold, so components
of the graph IoU > 0 are solved apart, each from its own edges and in memory that
grows with them; ties go to the smallest ids at any size. The threshold is
applied after the assignment.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraframe.operators.components import _folder, _write, connected_components

#: Reduced costs up to this count as nil, so that equal totals are told from unequal ones.
EPS = 1e-12
#: Edges that share a call.
BUCKET = 20_000


class _Matching:
    """The largest total gain over sparse edges: shortest augmenting paths with potentials, in memory that grows with the edges.

    Each reference has edges to predictions and a place of its own, numbered after the predictions, that gains nothing.
    """

    def __init__(self, edges: list[list[tuple[int, float]]], predictions: int):
        self.n, self.m = len(edges), predictions
        self.edges = [sorted(e) + [(predictions + r, 0.0)] for r, e in enumerate(edges)]
        self.u = [min(-g for _, g in e) for e in self.edges]
        self.v = [0.0] * (predictions + self.n)
        self.owner = [-1] * (predictions + self.n)
        self.match = [-1] * self.n
        for r in range(self.n):
            self._augment(r)

    def _augment(self, start: int) -> None:
        far, via, done = {}, {}, {}
        heap: list[tuple[float, int]] = []
        row, base = start, 0.0
        while True:
            for c, g in self.edges[row]:
                d = base + max(0.0, -g - self.u[row] - self.v[c])
                if c not in done and d < far.get(c, float("inf")):
                    far[c], via[c] = d, row
                    heapq.heappush(heap, (d, c))
            while heap[0][1] in done:
                heapq.heappop(heap)
            base, c = heapq.heappop(heap)
            done[c] = base
            if self.owner[c] < 0:
                break
            row = self.owner[c]
        for k, d in done.items():
            self.v[k] -= base - d
            if self.owner[k] >= 0:
                self.u[self.owner[k]] += base - d
        self.u[start] += base
        while True:
            r = via[c]
            left = self.match[r]
            self.owner[c], self.match[r] = r, c
            c = left
            if r == start:
                break

    def least(self) -> list[int]:
        """For each reference its prediction, or a number from ``m`` on: of equal totals the matching that gives the first reference the smallest prediction, then the next.

        Every best matching lies on edges without reduced cost and covers the predictions with a price; a
        swap along a cycle of such edges leads from one to the other, free places being one more node.
        """
        tight = [[c for c, g in e if -g - self.u[r] - self.v[c] <= EPS] for r, e in enumerate(self.edges)]
        unpriced = [c for c in range(len(self.v)) if self.v[c] >= -EPS]
        for r in range(self.n):
            for c in tight[r]:
                if c == self.match[r] or (self.owner[c] < 0 or self.owner[c] > r) and self._swap(r, c, tight, unpriced):
                    break
        return self.match

    def _swap(self, r: int, c: int, tight: list[list[int]], unpriced: list[int]) -> bool:
        """Gives ``c`` to reference ``r`` if the others can do without it; references up to ``r`` keep theirs otherwise."""
        free, goal = -1, self.match[r]
        start = self.owner[c]
        came: dict[int, tuple[int, int]] = {start: (start, -1)}
        queue = [start]
        for node in queue:
            for k in unpriced if node == free else tight[node]:
                if k == goal:
                    # the cycle closes: each node on the way takes what it reached
                    while True:
                        last, taken = came[node]
                        self.owner[k] = node
                        if node != free:
                            self.match[node] = k
                        if node == start:
                            break
                        node, k = last, taken
                    self.owner[c], self.match[r] = r, c
                    return True
                nxt = self.owner[k]
                if nxt not in came and (nxt == free or nxt > r):
                    came[nxt] = (node, k)
                    queue.append(nxt)
        return False


def best_pairs(t: np.ndarray, r: np.ndarray, gain: np.ndarray) -> list[int]:
    """Places of the edges (prediction, reference, gain > 0) of the largest total; of equal totals the first reference gets the smallest prediction, then the next."""
    if len(t) == 1:
        return [0]
    ts, i = np.unique(t, return_inverse=True)
    rs, j = np.unique(r, return_inverse=True)
    edges: list[list[tuple[int, float]]] = [[] for _ in rs]
    for a, b, g in zip(i.tolist(), j.tolist(), gain.tolist(), strict=True):
        edges[b].append((a, g))
    match = _Matching(edges, len(ts)).least()
    return [k for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)) if match[b] == a]


def assign(edges: DataFrame, t: str = "t", r: str = "r", iou: str = "iou") -> DataFrame:
    """``edges`` holds every pair with IoU > 0; returns the pairs ``t, r, iou`` of the optimal assignment."""
    e = edges.where(F.col(iou) > 0).select(F.col(t).cast("long").alias("t"), F.col(r).cast("long").alias("r"), F.col(iou).cast("double").alias("iou"))
    e = _write(e, f"{_folder(edges.sparkSession)}/edges")
    # predictions and references number their nodes apart: even and odd
    comp = connected_components(e.select((F.col("t") * 2).alias("a"), (F.col("r") * 2 + 1).alias("b")), "a", "b")
    buckets = max(1, -(-e.count() // BUCKET))
    of = e.join(comp, F.col("t") * 2 == F.col("node")).select("component", "t", "r", "iou", F.pmod(F.xxhash64("component"), F.lit(buckets)).alias("bucket"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        # most components are a few edges; a bucket of them shares one call
        pdf = pdf.sort_values(["component", "t", "r"])
        c, t_, r_, g = (pdf[k].to_numpy() for k in ("component", "t", "r", "iou"))
        cuts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1], [True]]))
        out = []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            out += [(t_[lo + k], r_[lo + k], g[lo + k]) for k in best_pairs(t_[lo:hi], r_[lo:hi], g[lo:hi])]
        return pd.DataFrame(out, columns=["t", "r", "iou"]).astype({"t": "int64", "r": "int64", "iou": "float64"})

    return of.groupBy("bucket").applyInPandas(solve, "t long, r long, iou double")
