"""Two-phase density clustering: hierarchical density clusters within blocks of rows, then their centroids are merged.

Phase one looks at a block of consecutive rows at a time, as the density hierarchy of all rows has no distributed form
with bounded groups. A block bounds a task: its time grows with the square of ``block``, its memory in proportion. Phase two
works on a model-sized table of centroids: near ones merge, and rows get the merged name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import clusters
from .shards import with_ordinal

BLOCK, LEAST, NEIGHBOURS, EPSILON, NEAR = 8192, 1000, 2000, 0.05, 0.1
NOISE = -1
#: Distances that are held at once; the least distance that a density is taken of.
CELLS, TINY = 1 << 24, 1e-9


def density_labels(m: np.ndarray, least: int, neighbours: int, epsilon: float = 0.0) -> np.ndarray:
    """The density cluster of each row, numbered in order of their first rows; -1 for noise.

    Cosine distances are raised to the rows' core distances (to the ``neighbours``-th nearest, itself counted), a
    spanning tree of them gives the hierarchy, parts below ``least`` rows fall out of it, and the parts with the most excess of
    mass are chosen. What parts at less than ``epsilon`` is not parted. The whole is never a cluster of its own, so a
    block without structure is noise.
    """
    n = len(m)
    if least < 2:
        raise ValueError("a cluster has at least two rows")
    if n < 2 * least:
        return np.full(n, NOISE)
    left, right, weight = _merges(*_spanning_tree(m, min(neighbours, n)))
    parent, birth, stability, own = _condensed(left, right, weight, n, least)
    return _in_order(_named(_chosen(parent, birth, stability, epsilon), parent)[own])


def _spanning_tree(m: np.ndarray, neighbours: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of the least spanning tree of mutual reachability: ends and weights."""
    n, size = len(m), np.linalg.norm(m, axis=1, keepdims=True)
    unit = m / np.where(size > 0, size, 1)
    core, step = np.empty(n), max(1, CELLS // n)
    for i in range(0, n, step):
        core[i : i + step] = np.partition(_distance(unit[i : i + step], unit), neighbours - 1, 1)[:, neighbours - 1]
    near, by, out = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, bool)
    a, b, w, at = np.empty(n - 1, np.int64), np.empty(n - 1, np.int64), np.empty(n - 1), 0
    for k in range(n - 1):
        out[at], near[at] = True, np.inf
        d = np.maximum(np.maximum(_distance(unit[at : at + 1], unit)[0], core), core[at])
        closer = ~out & (d < near)
        near[closer], by[closer] = d[closer], at
        at = int(near.argmin())
        a[k], b[k], w[k] = by[at], at, near[at]
    return a, b, w


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(np.round(1.0 - a @ b.T, clusters.DIGITS), 0.0)


def _merges(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hierarchy: merge i makes node n + i of two nodes, at a weight."""
    n = len(w) + 1
    up, left, right = np.arange(2 * n - 1), np.empty(n - 1, np.int64), np.empty(n - 1, np.int64)

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    order = np.lexsort((b, a, w))
    for i, e in enumerate(order):
        left[i], right[i] = top(a[e]), top(b[e])
        up[left[i]] = up[right[i]] = n + i
    return left, right, w[order]


def _condensed(left: np.ndarray, right: np.ndarray, weight: np.ndarray, n: int, least: int) -> tuple[list[int], list[float], list[float], np.ndarray]:
    """The hierarchy of parts with at least ``least`` rows: parent, density at birth and stability of each (parents before
    children, the whole first), and the last such part that each row belongs to."""
    size = np.ones(2 * n - 1, np.int64)
    for i in range(n - 1):
        size[n + i] = size[left[i]] + size[right[i]]
    parent, birth, stability, own = [-1], [0.0], [0.0], np.zeros(n, np.int64)
    todo = [(2 * n - 2, 0)]
    while todo:
        node, part = todo.pop()
        ends, density = (int(left[node - n]), int(right[node - n])), 1 / max(weight[node - n], TINY)
        large = [x for x in ends if size[x] >= least]
        leaving = size[node] if len(large) != 1 else size[node] - size[large[0]]
        stability[part] += float(leaving) * (density - birth[part])
        if len(large) == 2:
            for x in large:
                parent.append(part)
                birth.append(density)
                stability.append(0.0)
                todo.append((x, len(parent) - 1))
            continue
        todo += [(x, part) for x in large]
        below = [x for x in ends if size[x] < least]
        while below:
            x = below.pop()
            if x < n:
                own[x] = part
            else:
                below += [int(left[x - n]), int(right[x - n])]
    return parent, birth, stability, own


def _chosen(parent: list[int], birth: list[float], stability: list[float], epsilon: float) -> set[int]:
    """The parts of most excess of mass, each raised to where it parts at ``epsilon`` or more."""
    mass, inner = [0.0] * len(parent), [False] * len(parent)
    for k in range(len(parent) - 1, 0, -1):
        inner[k] = mass[k] > stability[k]
        mass[k] = max(mass[k], stability[k])
        mass[parent[k]] += mass[k]
    found, covered = set(), [False] * len(parent)
    for k in range(1, len(parent)):
        covered[k] = covered[parent[k]] or (parent[k] > 0 and not inner[parent[k]])
        if not covered[k] and not inner[k]:
            while birth[k] * epsilon >= 1 and parent[k] > 0:
                k = parent[k]
            found.add(k)
    return found


def _named(chosen: set[int], parent: list[int]) -> np.ndarray:
    """For each part the outermost chosen one that it lies in."""
    name = np.full(len(parent), NOISE)
    for k in range(1, len(parent)):
        name[k] = name[parent[k]] if name[parent[k]] != NOISE else k if k in chosen else NOISE
    return name


def _in_order(labels: np.ndarray) -> np.ndarray:
    known, first = np.unique(labels[labels != NOISE], return_index=True)
    number = dict(zip(known[np.argsort(first)].tolist(), range(len(known))))
    return np.array([number.get(x, NOISE) for x in labels.tolist()], np.int64)


def density_clusters(vectors: DataFrame, block: int = BLOCK, least: int = LEAST, neighbours: int = NEIGHBOURS, epsilon: float = EPSILON) -> DataFrame:
    """Phase one: ``idx, cluster, vector``. Blocks are of ``block`` rows in the order of ``idx``; a cluster's number is its
    block's times ``block div least`` and its own, so numbers of different blocks differ; noise is -1. Rows with a null
    vector or index are left out, and an empty table gives no row."""
    width = max(1, block // least)
    rows = vectors.filter("idx is not null and vector is not null").select(F.col("idx").cast("long"), F.col("vector").cast("array<double>"))

    def run(table: pa.Table) -> pa.Table:
        m = np.array(table.column("vector").to_pylist(), float)
        order = np.argsort(table.column("idx").to_numpy(), kind="stable")
        labels = np.empty(len(m), np.int64)
        labels[order] = density_labels(m[order], least, neighbours, epsilon)
        own = np.where(labels == NOISE, NOISE, table.column("block").to_numpy() * width + labels)
        return pa.table({"idx": table.column("idx"), "cluster": pa.array(own, pa.int32()), "vector": table.column("vector")})

    placed = with_ordinal(rows, "idx").select(F.expr(f"ordinal div {block}").alias("block"), "idx", "vector")
    return placed.groupBy("block").applyInArrow(run, "idx long, cluster int, vector array<double>")


def two_phase(vectors: DataFrame, block: int = BLOCK, least: int = LEAST, neighbours: int = NEIGHBOURS, epsilon: float = EPSILON, near: float = NEAR) -> DataFrame:
    """``idx, cluster``: density clusters of blocks, those whose centroids are nearest to each other and nearer than
    ``near`` merged, under their lowest number; a cluster that merges with none keeps its own, noise stays -1."""
    from ..sources.shared import written

    first = written(density_clusters(vectors, block, least, neighbours, epsilon), "density")
    centers = written(clusters.centroids(first.filter(F.col("cluster") != NOISE)), "centroids")
    mapping = clusters.merge_pairs(clusters.between(centers, nearest=True), near)
    return clusters.relabel(first.select("idx", "cluster"), mapping)
