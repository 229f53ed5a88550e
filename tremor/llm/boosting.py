"""Gradient-boosted trees for a binary label, on histograms, with calibrated probabilities.

``boost`` takes arrays, ``boost_cases`` a table of any size: each level of a tree is one pass over
the table, whose tasks add up the histograms of the open nodes; only sums reach the driver.  A table
of at most ``HELD`` different cases is read once and held by the driver instead.  The sums are of
whole numbers, so the model is the same either way, and however the table is cut into tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import mapped, record

BINS = 32
# Trees after which the cases are written again with what all trees so far say of them.
GENERATION = 5
# Different cases, of some 100 bytes, that the driver holds.
HELD = 100_000
# Steps to one: gradients and margins of tables are added up and counted as whole numbers of steps.
FINE = 1 << 20
STEPS = 256

_CASES = "x binary, y int, n long, margin double"
_CASE_SCHEMA = pa.schema([("x", pa.binary()), ("y", pa.int32()), ("n", pa.int64()), ("margin", pa.float64())])


@dataclass
class Tree:
    """Splits by heap position: feature (-1 at a leaf), the bin up to which rows go left, and the value of a leaf."""

    feature: np.ndarray
    bound: np.ndarray
    value: np.ndarray

    def at(self, binned: np.ndarray) -> np.ndarray:
        return self.value[self.leaf(binned)]

    def leaf(self, binned: np.ndarray) -> np.ndarray:
        node = np.zeros(len(binned), dtype=np.int64)
        rows = np.arange(len(binned))
        while True:
            feature = self.feature[node]
            inner = feature >= 0
            if not inner.any():
                return node
            right = binned[rows, np.maximum(feature, 0)] > self.bound[node]
            node = np.where(inner, 2 * node + 1 + right, node)


@dataclass
class Boosted:
    edges: list[np.ndarray]
    start: float
    rate: float
    trees: list[Tree] = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(self.edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.added(self.trees, self.binned(x))

    def added(self, trees: list[Tree], binned: np.ndarray) -> np.ndarray:
        return self.rate * sum((t.at(binned) for t in trees), np.zeros(len(binned)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.margin(x) + self.shift)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _grow(histograms: Callable, depth: int, penalty: float, least: float) -> Tree:
    """A tree, level by level; ``histograms(tree, nodes)`` gives the sums of gradients and of curvatures by node, feature and bin."""
    n = 2 ** (depth + 1) - 1
    tree = Tree(np.full(n, -1), np.zeros(n, dtype=np.int64), np.zeros(n))
    nodes = [0]
    for _ in range(depth):
        if not nodes:
            break
        split = []
        for node, g, h in zip(nodes, *histograms(tree, nodes), strict=True):
            total_g, total_h = g[0].sum(), h[0].sum()
            tree.value[node] = total_g / (total_h + penalty)
            left_g, left_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
            right_g, right_h = total_g - left_g, total_h - left_h
            gain = left_g ** 2 / (left_h + penalty) + right_g ** 2 / (right_h + penalty) - total_g ** 2 / (total_h + penalty)
            gain[(left_h < least) | (right_h < least)] = 0
            if gain.max() <= 1e-6:
                continue
            place = np.unravel_index(gain.argmax(), gain.shape)
            tree.feature[node], tree.bound[node] = place
            tree.value[2 * node + 1] = left_g[place] / (left_h[place] + penalty)
            tree.value[2 * node + 2] = right_g[place] / (right_h[place] + penalty)
            split += [2 * node + 1, 2 * node + 2]
        nodes = split
    return tree


def _cells(tree: Tree, nodes: list[int], binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums by node, feature and bin over the rows that lie in the nodes."""
    slot = np.full(len(tree.feature), -1)
    slot[nodes] = np.arange(len(nodes))
    of = slot[tree.leaf(binned)]
    rows = np.flatnonzero(of >= 0)
    shape = (len(nodes), binned.shape[1], BINS)
    cell = ((of[rows, None] * shape[1] + np.arange(shape[1])) * BINS + binned[rows]).reshape(-1)
    return tuple(np.bincount(cell, np.repeat(w[rows], shape[1]), shape[0] * shape[1] * BINS).reshape(shape) for w in (g, h))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.25, penalty: float = 1.0, least: float = 2.0) -> Boosted:
    """Fit to the log loss; every step's tree follows the gradient with Newton leaves."""
    edges = [np.unique(np.quantile(x[:, i], np.arange(1, BINS) / BINS)) for i in range(x.shape[1])]
    share = np.clip(y.mean(), 0.01, 0.99)
    model = Boosted(edges, float(np.log(share / (1 - share))), rate)
    binned = model.binned(x)
    margin = np.full(len(y), model.start)
    for _ in range(trees):
        p = sigmoid(margin)
        g, h = y - p, p * (1 - p)
        model.trees.append(_grow(lambda tree, nodes, g=g, h=h: _cells(tree, nodes, binned, g, h), depth, penalty, least))
        margin += model.added(model.trees[-1:], binned)
    return model


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The bins of a batch of cases, a row each."""
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), np.uint8).reshape(batch.num_rows, -1)


def boost_cases(cases: DataFrame, edges: list[np.ndarray], trees: int = 50, depth: int = 4, rate: float = 0.25, penalty: float = 1.0, least: float = 2.0, held: int = HELD) -> Boosted:
    """The same from a written table of ``x, y, n``: n cases of the bins x (by ``edges``, a byte each) and the label y.

    Every case takes part in every tree.  The table holds both labels.
    """
    ones, n, different = cases.agg(F.sum(F.col("y") * F.col("n")), F.sum("n"), F.count(F.lit(1))).first()
    share = np.clip(ones / n, 0.01, 0.99)
    model = Boosted(edges, float(np.log(share / (1 - share))), rate)
    table, told = cases.select("x", "y", "n", F.lit(model.start).alias("margin")), 0
    if different <= held:
        table = pa.RecordBatch.from_pylist([r.asDict() for r in table.collect()], _CASE_SCHEMA)
    for _ in range(trees):
        if len(model.trees) - told == GENERATION:
            table, told = _told(table, model, model.trees[told:]), len(model.trees)
        model.trees.append(_grow(lambda tree, nodes, table=table, told=told: _summed(table, model, model.trees[told:], tree, nodes), depth, penalty, least))
    return model


def _told(table: DataFrame | pa.RecordBatch, model: Boosted, later: list[Tree]) -> DataFrame | pa.RecordBatch:
    """The cases with a margin that includes the later trees."""

    def told(batch: pa.RecordBatch) -> pa.RecordBatch:
        margin = batch.column("margin").to_numpy() + model.added(later, _matrix(batch))
        return record(_CASE_SCHEMA, x=batch.column("x"), y=batch.column("y"), n=batch.column("n"), margin=pa.array(margin))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield told(batch)

    return told(table) if isinstance(table, pa.RecordBatch) else written(mapped(table, run, _CASES), "cases")


def _summed(table: DataFrame | pa.RecordBatch, model: Boosted, later: list[Tree], tree: Tree, nodes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The histograms of the open nodes over all cases."""
    schema = pa.schema([("cell", pa.int32()), ("g", pa.int64()), ("h", pa.int64())])
    shape = (len(nodes), len(model.edges), BINS)

    def sums(batch: pa.RecordBatch) -> np.ndarray:
        binned, y, n = _matrix(batch), batch.column("y").to_numpy(), batch.column("n").to_numpy()
        p = sigmoid(batch.column("margin").to_numpy() + model.added(later, binned))
        # Whole numbers, which doubles add up without a rest: the order of adding does not matter.
        return np.array(_cells(tree, nodes, binned, n * np.rint((y - p) * FINE), n * np.rint(p * (1 - p) * FINE))).astype(np.int64)

    def run(batches):
        total = np.zeros((2, *shape), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                total += sums(batch)
        g, h = total.reshape(2, -1)
        some = np.flatnonzero((g != 0) | (h != 0))
        yield record(schema, cell=pa.array(some.astype(np.int32)), g=pa.array(g[some]), h=pa.array(h[some]))

    if isinstance(table, pa.RecordBatch):
        return tuple(sums(table) / FINE)
    total = np.zeros((2, int(np.prod(shape))))
    for cell, g, h in mapped(table, run, "cell int, g long, h long").groupBy("cell").agg(F.sum("g"), F.sum("h")).collect():
        total[:, cell] = g, h
    return tuple(total.reshape(2, *shape) / FINE)


def margin_counts(cases: DataFrame, model: Boosted, kinds: int) -> DataFrame:
    """``kind, y, step, n``: how many cases of a kind (the first of the first ``kinds`` features that is set) and label have a margin, in ``STEPS`` to one."""
    schema = pa.schema([("kind", pa.int32()), ("y", pa.int32()), ("step", pa.int32()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                binned = _matrix(batch)
                step = np.rint(np.clip(model.start + model.added(model.trees, binned), -30, 30) * STEPS).astype(np.int32)
                yield record(schema, kind=pa.array(binned[:, :kinds].argmax(axis=1).astype(np.int32)), y=batch.column("y"), step=pa.array(step), n=batch.column("n"))

    return mapped(cases.select("x", "y", "n"), run, "kind int, y int, step int, n long").groupBy("kind", "y", "step").agg(F.sum("n").alias("n"))


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray) -> None:
    """Platt scaling on cases that were set aside."""
    platt(model, model.margin(x), y, np.ones(len(y)))


def platt(model: Boosted, z: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
    """Platt scaling on ``n`` cases of each margin and label, with targets that allow for one wrong case a label."""
    up, down = (n * y).sum(), (n * (1 - y)).sum()
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * z + b)
        w = n * p * (1 - p) + 1e-9
        gradient = np.array([(n * (t - p) * z).sum(), (n * (t - p)).sum()])
        hessian = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hessian, gradient)
        a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    model.slope, model.shift = float(max(a, 0.05)), float(b)
