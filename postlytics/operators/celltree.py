"""A regression tree without a limit on its nodes (L2).

A tree over binned features sees its rows only through their cell (the bins of all
features) and, by cell, the number, sum and sum of squares of the label.  So the rows are
summed by cell once, and the tree is grown on cells: from the top, a scan a level, as long
as a node holds more than ``local_cells`` cells -- such nodes are few, and the driver sees
their histograms only -- and below that a node a group, in NumPy.  Bins, gain, ties and
stopping are those of Spark's ``DecisionTreeRegressor`` (32 bins by a sample's quantiles,
variance), which holds a histogram of every node of a level and the whole tree at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MAX_BINS = 32
SAMPLE_ROWS = 10_000     # rows that the bins are taken from, as in Spark
LOCAL_CELLS = 20_000
EPSILON = 2.0 ** -52


def thresholds(values: np.ndarray, bins: int = MAX_BINS) -> np.ndarray:
    """At most ``bins`` - 1 ascending thresholds between the distinct ``values``: all
    midpoints, or those nearest to equal shares of the values."""
    distinct, counts = np.unique(values, return_counts=True)
    middle = (distinct[:-1] + distinct[1:]) / 2
    if len(middle) <= bins - 1:
        return middle
    stride = len(values) / bins
    found, target, upto = [], stride, np.cumsum(counts)
    for i in range(1, len(distinct)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            found.append(middle[i - 1])
            target += stride
    return np.array(found)


def _gains(n: np.ndarray, s: np.ndarray, ss: np.ndarray) -> np.ndarray:
    """The gain of each split (last axis: behind each bin but the last) of histograms of the
    rows' number, sum and sum of squares; -inf where a side is empty."""
    n, s, ss = (np.cumsum(h, axis=-1) for h in (n, s, ss))

    def variance(n, s, ss):
        with np.errstate(divide="ignore", invalid="ignore"):
            return (ss - s * s / n) / n

    total = [h[..., -1:] for h in (n, s, ss)]
    left = [h[..., :-1] for h in (n, s, ss)]
    right = [t - h for t, h in zip(total, left)]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = variance(*total) - left[0] / total[0] * variance(*left) - right[0] / total[0] * variance(*right)
    return np.where((left[0] > 0) & (right[0] > 0), gain, -np.inf)


def _best(hist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of histograms (nodes x features x 3 x bins): feature, last bin on the left and gain of
    each node's best split, the first of equals."""
    gain = _gains(hist[:, :, 0], hist[:, :, 1], hist[:, :, 2])
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(axis=1)
    return at // gain.shape[2], at % gain.shape[2], flat[np.arange(len(flat)), at]


def _histograms(node: np.ndarray, bins: np.ndarray, sums: np.ndarray, nodes: int) -> np.ndarray:
    """nodes x features x sums x MAX_BINS of the cells' ``sums`` (cells x sums)."""
    out = np.empty((nodes, bins.shape[1], sums.shape[1], MAX_BINS))
    for f in range(bins.shape[1]):
        key = node * MAX_BINS + bins[:, f]
        for j in range(sums.shape[1]):
            out[:, f, j] = np.bincount(key, sums[:, j], nodes * MAX_BINS).reshape(nodes, MAX_BINS)
    return out


def _pure(n: np.ndarray, s: np.ndarray, ss: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return ~(np.abs((ss - s * s / n) / n) >= EPSILON)


def grow(bins: np.ndarray, sums: np.ndarray, depth: int) -> np.ndarray:
    """The prediction for each cell (``bins``: cells x features; ``sums``: number, sum and sum of
    squares of its training rows, 0 for a cell without any) of the tree of ``depth`` levels."""
    prediction = np.zeros(len(bins))
    at, node = np.arange(len(bins)), np.zeros(len(bins), np.int64)   # cells of the open nodes
    for level in range(depth + 1):
        if not len(at):
            break
        _, node = np.unique(node, return_inverse=True)
        count = int(node.max()) + 1
        n, s, ss = (np.bincount(node, sums[at, j], count) for j in range(3))
        prediction[at] = (s / np.where(n > 0, n, 1))[node]
        split = ~_pure(n, s, ss) if level < depth else np.zeros(count, bool)
        keep = split[node]
        at, node = at[keep], node[keep]
        if not len(at):
            break
        _, node = np.unique(node, return_inverse=True)
        feature, cut, gain = _best(_histograms(node, bins[at], sums[at], int(node.max()) + 1))
        keep = (gain > 0)[node]
        at, node = at[keep], node[keep]
        node = 2 * node + (bins[at, feature[node]] > cut[node])
    return prediction


class _Top:
    """The nodes above the local trees: children (-1: none), feature and last left bin."""

    def __init__(self):
        self.left, self.feature, self.cut, self.depth = [-1], [0], [0], [0]

    def split(self, node: int, feature: int, cut: int) -> int:
        """The left child's number; the right child's is the next."""
        self.left[node], self.feature[node], self.cut[node] = len(self.left), feature, cut
        for column, value in ((self.left, -1), (self.feature, 0), (self.cut, 0), (self.depth, self.depth[node] + 1)):
            column.extend([value, value])
        return self.left[node]

    def route(self, bins: np.ndarray) -> np.ndarray:
        left, feature, cut = map(np.array, (self.left, self.feature, self.cut))
        node = np.zeros(len(bins), np.int64)
        while True:
            inner = np.flatnonzero(left[node] >= 0)
            if not len(inner):
                return node
            here = node[inner]
            node[inner] = left[here] + (bins[inner, feature[here]] > cut[here])


def _arrays(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    bins = np.frombuffer(b"".join(batch.column("cell").to_pylist()), np.uint8).reshape(-1, k).astype(np.int64)
    return bins, np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n", "s", "ss")], axis=1)


def _level(cells: DataFrame, top: _Top, open_nodes: list[int], k: int) -> np.ndarray:
    """The histograms (nodes x features x 4 x bins) of the open nodes: number, sum and sum
    of squares of the training rows, and number of cells."""
    place = np.full(len(top.left), -1)
    place[open_nodes] = np.arange(len(open_nodes))
    size = len(open_nodes) * k * MAX_BINS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(open_nodes), k, 4, MAX_BINS))
        for batch in batches:
            if batch.num_rows:
                bins, sums = _arrays(batch, k)
                node = place[top.route(bins)]
                mine = np.flatnonzero(node >= 0)
                total += _histograms(node[mine], bins[mine], np.column_stack([sums[mine], np.ones(len(mine))]), len(open_nodes))
        flat = total.transpose(2, 0, 1, 3).reshape(4, size)
        met = np.flatnonzero(flat[3])
        yield pa.RecordBatch.from_arrays([pa.array(met), *(pa.array(h[met]) for h in flat)], ["at", "n", "s", "ss", "m"])

    parts = cells.mapInArrow(run, "at long, n double, s double, ss double, m double")
    summed = parts.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss", "m")]).toArrow()
    flat = np.zeros((4, size))
    for j, c in enumerate(("n", "s", "ss", "m")):
        flat[j, summed["at"].to_numpy()] = summed[c].to_numpy()
    return flat.reshape(4, len(open_nodes), k, MAX_BINS).transpose(1, 2, 0, 3)


def predicted_cells(cells: DataFrame, k: int, max_depth: int, local_cells: int = LOCAL_CELLS) -> DataFrame:
    """``cells`` (``cell``: k bytes, the bins; ``n``, ``s`` and ``ss`` of the training rows; stored, as it
    is read a level) to ``cell`` and ``prediction``."""
    top, open_nodes = _Top(), [0] if cells.count() > local_cells else []
    closed: dict[int, float] = {}   # large nodes that are leaves: not gathered in a group
    while open_nodes:
        hist = _level(cells, top, open_nodes, k)
        feature, cut, gain = _best(hist[:, :, :3])
        n, s, ss = hist[:, 0, :3].sum(axis=-1).T
        below = []
        for i, node in enumerate(open_nodes):
            if gain[i] > 0 and top.depth[node] < max_depth and not _pure(n[i], s[i], ss[i]):
                child = top.split(node, int(feature[i]), int(cut[i]))
                left = hist[i, feature[i], 3, :cut[i] + 1].sum()
                sizes = left, hist[i, feature[i], 3].sum() - left
                below += [child + side for side in (0, 1) if sizes[side] > local_cells]
            else:
                closed[node] = float(s[i] / n[i]) if n[i] else 0.0
        open_nodes = below

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = top.route(_arrays(batch, k)[0]) if batch.num_rows else np.zeros(0, np.int64)
            mean = pa.array([closed.get(i) for i in node.tolist()], pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(node), mean, *batch.columns], ["node", "prediction", *batch.schema.names])

    def leaves(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        bins = np.frombuffer(b"".join(group["cell"]), np.uint8).reshape(-1, k).astype(np.int64)
        depth = max_depth - top.depth[int(key[0])]
        return pd.DataFrame({"cell": group["cell"], "prediction": grow(bins, group[["n", "s", "ss"]].to_numpy(float), depth)})

    placed = cells.select("cell", "n", "s", "ss").mapInArrow(place, "node long, prediction double, cell binary, n long, s double, ss double")
    grown = placed.where(F.col("prediction").isNull()).groupBy("node").applyInPandas(leaves, "cell binary, prediction double")
    return grown.unionByName(placed.where(F.col("prediction").isNotNull()).select("cell", "prediction")) if closed else grown


def tree_predictions(df: DataFrame, features: list[str], label: str, test: str, max_depth: int, seed: int) -> DataFrame:
    """``label`` and ``prediction`` of the rows of ``df`` (stored; no nulls) where ``test`` holds,
    by the tree of the others.  The bins come from a sample of the training rows."""
    from postlytics.llm.common import store
    train = df.where(~F.col(test))
    n = train.count()
    if not n:
        raise ValueError("no training rows")
    sample = train.select(*features)
    if n > SAMPLE_ROWS:
        sample = sample.sample(fraction=SAMPLE_ROWS / n, seed=seed)
    seen = sample.toArrow()
    edges = [thresholds(seen[f].to_numpy().astype(float), min(MAX_BINS, n)) for f in features]
    k = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.stack([np.searchsorted(e, batch.column(f).to_numpy(zero_copy_only=False))
                             for f, e in zip(features, edges)], axis=1).astype(np.uint8)
            cell = pa.Array.from_buffers(pa.binary(k), batch.num_rows, [None, pa.py_buffer(bins.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([cell, batch.column(label), batch.column(test)], ["cell", "y", "test"])

    rows = df.select(*features, F.col(label).cast("double").alias(label), test).mapInArrow(run, "cell binary, y double, test boolean")
    y = F.when(~F.col("test"), F.col("y"))
    cells = store(rows.groupBy("cell").agg(F.count(y).alias("n"), F.coalesce(F.sum(y), F.lit(0.0)).alias("s"),
                                           F.coalesce(F.sum(y * y), F.lit(0.0)).alias("ss")), "tree-cells")
    held = rows.where("test").select("cell", F.col("y").alias(label))
    return held.join(predicted_cells(cells, k, max_depth), "cell").select(label, "prediction")
