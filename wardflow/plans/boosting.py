"""Boosted trees over blocks of binned rows, in few Spark jobs.

A booster on Spark starts several jobs for every tree, and over some 300,000 rows a job is mostly its start. Here a
block of rows keeps one byte per feature (the bin of the value). A level of a tree is one stage without a shuffle:
each task adds up the histograms of its block, their sum, a few nodes' bins however many rows there are, comes to
the driver, and the best splits are read from it. Rows stay where they are. Up to `ONE_BLOCK` rows are one block,
and all rounds over it one task: from about there on starting the jobs costs less than what many tasks save.

The method is that of Spark ML's boosters: 32 bins, gain in variance, a first tree on the label, further ones
on the negative gradient with weight `stepSize`, a share of the rows drawn anew for each tree. Edges of bins are
halfway between quantiles of all rows. Settings with the same names mean the same. Blocks hold their rows in order, so a fit does
not depend on the order in which they arrive. Splits that part the rows alike differ by rounding only; the one of
the first feature is taken.

Almost all time goes into histograms. Two or three features are counted in one pass over the rows, by a code for their
bins together, and the cells are summed up to the bins of each.

Lost blocks are made again from the table fitted on: every `ANCHOR` rounds the predictions start from it, so that
no chain of rounds grows longer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 32
#: Quantiles read per feature; a feature with no more distinct ones than edges keeps them all.
RANKS = [k / 256 for k in range(1, 256)]
#: Rows that are boosted in one task; rounds between predictions added up anew; blocks whose histograms the driver adds up.
ONE_BLOCK, ANCHOR, DIRECT = 1 << 21, 20, 64
#: Most cells of features counted together, few enough for a near cache; relative gain up to which splits are alike.
CELLS, ALIKE = 1 << 12, 1e-10


class Tree(NamedTuple):
    """Per node its feature (-1 in a leaf), the last bin that goes left, and its value."""

    feature: np.ndarray
    split: np.ndarray
    value: np.ndarray


class Joint(NamedTuple):
    """Some features, how many bins each has, and per row one code for its bins together."""

    features: list[int]
    bins: list[int]
    codes: np.ndarray


class Block(NamedTuple):
    """Rows of one partition: bins per feature and of joint features, label, and the sum of the trees so far."""

    number: int
    codes: np.ndarray
    joints: list[Joint]
    y: np.ndarray
    margin: np.ndarray


def bin_edges(df: DataFrame, features: str) -> tuple[list[np.ndarray], int]:
    """Upper edges of all bins but the last, per feature, and the number of rows."""
    values = df.select(F.posexplode(vector_to_array(features)).alias("at", "value"))
    found = values.groupBy("at").agg(
        F.percentile_approx("value", RANKS, 10_000).alias("q"), F.count(F.lit(1)).alias("n")
    ).orderBy("at").collect()
    if not found:
        raise ValueError("no rows to fit on")
    edges = []
    for row in found:
        distinct = np.unique(row.q)
        last = distinct[:-1] if len(distinct) <= BINS else np.setdiff1d(row.q[7::8], distinct[-1:])
        # halfway to the next value, for values that the table does not have
        edges.append((last + distinct[np.searchsorted(distinct, last) + 1]) / 2)
    return edges, found[0].n


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins of a matrix of rows, one line per feature."""
    return np.stack([np.searchsorted(e, x[:, f]).astype(np.uint8) for f, e in enumerate(edges)])


def joined(codes: np.ndarray, bins: list[int]) -> list[Joint]:
    """Neighbouring features joined as long as they have at most `CELLS` cells together."""
    joints: list[Joint] = []
    for f, (line, n) in enumerate(zip(codes, bins)):
        last = joints[-1] if joints else None
        if last and np.prod(last.bins) * n <= CELLS:
            joints[-1] = Joint([*last.features, f], [*last.bins, n], last.codes * np.uint16(n) + line)
        else:
            joints.append(Joint([f], [n], line.astype(np.uint16)))
    return joints


def below(codes: np.ndarray, tree: Tree, node: np.ndarray, level: int) -> np.ndarray:
    """Nodes of the rows one level down; rows in a leaf stay. Children of node i are 2i + 1 and 2i + 2."""
    out = node.copy()
    for at in range(2**level - 1, 2 ** (level + 1) - 1):
        if tree.feature[at] >= 0:
            right = codes[tree.feature[at]] > tree.split[at]
            out += (node == at) * (right + node.dtype.type(at + 1))
    return out


def root(rows: int, depth: int) -> np.ndarray:
    """The first node for every row, in a type that holds all nodes."""
    return np.zeros(rows, np.min_scalar_type(2 ** (depth + 1)))


def leaves(codes: np.ndarray, tree: Tree, depth: int) -> np.ndarray:
    """Nodes of the rows after `depth` levels."""
    node = root(codes.shape[1], depth)
    for level in range(depth):
        node = below(codes, tree, node, level)
    return node


def summed(codes: np.ndarray, trees: list[Tree], depth: int) -> np.ndarray:
    """Sum of the trees per row."""
    out = np.zeros(codes.shape[1])
    for tree in trees:
        out += tree.value[leaves(codes, tree, depth)]
    return out


def moved(block: Block, trees: list[Tree], depth: int) -> Block:
    """The block with some trees added to its predictions."""
    return block._replace(margin=block.margin + summed(block.codes, trees, depth))


def drawn(block: Block, draws: list[int], share: float) -> np.ndarray:
    return np.flatnonzero(np.random.default_rng([*draws, block.number]).random(len(block.y)) < share)


def histograms(joints: list[Joint], g: np.ndarray, at: np.ndarray, nodes: int) -> np.ndarray:
    """Counts and sums of g by bin, per node and feature, of rows at places 0 to nodes - 1 (others: -1)."""
    rows = np.flatnonzero(at >= 0)
    place, weight = at[rows], g[rows]
    out = np.zeros((2, sum(len(j.features) for j in joints), nodes, BINS))
    for j in joints:
        size = int(np.prod(j.bins))
        key = place * size + j.codes.take(rows)
        for kind, weights in enumerate((None, weight)):
            cells = np.bincount(key, weights, minlength=nodes * size).reshape(nodes, *j.bins)
            for axis, f in enumerate(j.features, 1):
                others = tuple(a for a in range(1, cells.ndim) if a != axis)
                out[kind, f, :, : cells.shape[axis]] = cells.sum(others)
    return out.transpose(2, 0, 1, 3)


def places(size: int, build: list[int]) -> np.ndarray:
    """Place of each node among those to build, -1 for the others."""
    place = np.full(size, -1)
    place[build] = np.arange(len(build))
    return place


def level_of(
    block: Block, tree: Tree, level: int, build: list[int], downhill, draws: list[int], share: float
) -> np.ndarray:
    """What one block adds to the histograms of a level."""
    at = np.full(len(block.y), -1)
    rows = drawn(block, draws, share)
    at[rows] = places(len(tree.feature), build)[leaves(block.codes, tree, level)[rows]]
    return histograms(block.joints, downhill(block.y, block.margin), at, len(build))


def boosted(block: Block, trees: int, depth: int, rate: float, downhill, seed: int, share: float) -> list[Tree]:
    """All rounds over one block."""
    found, margin = [], block.margin
    for t in range(trees):
        g, rows, node = (downhill if t else _label)(block.y, margin), drawn(block, [seed, t], share), None
        joints, g = [j._replace(codes=j.codes[rows]) for j in block.joints], g[rows]

        def count(tree: Tree, level: int, build: list[int]) -> np.ndarray:
            nonlocal node
            node = below(block.codes, tree, node, level - 1) if level else root(len(block.y), depth)
            return histograms(joints, g, places(len(tree.feature), build)[node[rows]], len(build))

        tree = grown(count, depth)
        found.append(tree._replace(value=tree.value * (rate if t else 1.0)))
        margin = margin + summed(block.codes, found[-1:], depth)
    return found


def best_split(histogram: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray] | None:
    """Feature, bin and (count, sum) left and right of the split that lowers the variance most."""
    under = histogram.cumsum(-1)
    whole = under[:, 0, -1]
    (n, s), (rest_n, rest_s) = under, whole[:, None, None] - under
    able = (n > 0) & (rest_n > 0)
    gain = np.full(n.shape, -np.inf)
    gain[able] = s[able] ** 2 / n[able] + rest_s[able] ** 2 / rest_n[able]
    best = gain.max()
    if not best > whole[1] ** 2 / max(whole[0], 1):
        return None
    feature, split = np.unravel_index((gain >= best * (1 - ALIKE)).argmax(), gain.shape)
    left = under[:, feature, split]
    return int(feature), int(split), left, whole - left


def grown(count: Callable[[Tree, int, list[int]], np.ndarray], depth: int) -> Tree:
    """One tree from the histograms that `count` gives for the nodes of a level.

    Only the smaller child of a split is counted; its sibling is the parent less it.
    """
    size = 2 ** (depth + 1) - 1
    tree, build, known = Tree(np.full(size, -1), np.zeros(size, int), np.zeros(size)), [0], {}
    for level in range(depth):
        for at, histogram in zip(build, count(tree, level, build)):
            known[at] = histogram
            if at:
                known[at + 1 if at % 2 else at - 1] = known[(at - 1) // 2] - histogram
            else:
                n, s = histogram[:, 0].sum(-1)
                tree.value[0] = s / max(n, 1)
        build = []
        for at in range(2**level - 1, 2 ** (level + 1) - 1):
            best = best_split(known[at]) if at in known else None
            if best:
                tree.feature[at], tree.split[at], left, right = best
                tree.value[2 * at + 1 : 2 * at + 3] = left[1] / left[0], right[1] / right[0]
                build.append(2 * at + 1 if left[0] <= right[0] else 2 * at + 2)
        if not build:
            break
    return tree


def _label(y: np.ndarray, margin: np.ndarray) -> np.ndarray:
    return y


def _squared(y: np.ndarray, margin: np.ndarray) -> np.ndarray:
    return 2 * (y - margin)


def _logistic(y: np.ndarray, margin: np.ndarray) -> np.ndarray:
    return 4 * y / (1 + np.exp(np.clip(2 * y * margin, -700, 700)))


class _Booster(Estimator):
    """Settings of a fit."""

    downhill: Callable[[np.ndarray, np.ndarray], np.ndarray]
    result: type

    def __init__(
        self, labelCol: str, featuresCol: str = "features", maxIter: int = 20, maxDepth: int = 5,
        stepSize: float = 0.1, subsamplingRate: float = 1.0, seed: int = 0,
    ):
        super().__init__()
        self.label, self.features, self.trees, self.depth = labelCol, featuresCol, maxIter, maxDepth
        self.rate, self.share, self.draws = stepSize, subsamplingRate, seed

    def _target(self):
        return F.col(self.label).cast("double")

    def _blocks(self, dataset: DataFrame, edges: list[np.ndarray]) -> RDD:
        """One block per partition."""

        def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lines, labels = [np.empty((len(edges), 0), np.uint8)], [np.empty(0)]
            for b in batches:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(edges))
                lines.append(binned(x, edges))
                labels.append(b.column(1).to_numpy(zero_copy_only=False))
            codes, y = np.concatenate(lines, axis=1), np.concatenate(labels)
            if np.isnan(y).any():
                raise ValueError("a row to fit on has no label")
            order = np.lexsort([*codes, y])
            cells = [pa.array([a.tobytes()], pa.binary()) for a in (codes[:, order], y[order])]
            yield pa.RecordBatch.from_arrays(cells, ["codes", "y"])

        def opened(number: int, rows: Iterable) -> Iterator[Block]:
            for row in rows:
                y, codes = np.frombuffer(row.y), np.frombuffer(row.codes, np.uint8).reshape(len(edges), -1)
                yield Block(number, codes, joined(codes, [len(e) + 1 for e in edges]), y, np.zeros(len(y)))

        rows = dataset.select(vector_to_array(self.features), self._target())
        return rows.mapInArrow(packed, "codes binary, y binary").rdd.mapPartitionsWithIndex(opened)

    def _fit(self, dataset: DataFrame) -> _BoosterModel:
        """A block holds a partition of the dataset, or all of it if that is no more than `ONE_BLOCK` rows."""
        edges, n = bin_edges(dataset, self.features)
        downhill = type(self).downhill
        if n <= ONE_BLOCK:
            rounds = partial(
                boosted, trees=self.trees, depth=self.depth, rate=self.rate, downhill=downhill, seed=self.draws,
                share=self.share,
            )
            trees = self._blocks(dataset.coalesce(1), edges).map(rounds).first()
        else:
            trees = self._rounds(self._blocks(dataset, edges), downhill)
        return self.result(self.features, edges, trees, self.depth)

    def _rounds(self, start: RDD, downhill) -> list[Tree]:
        """All rounds over many blocks, a job for each level."""
        keep = StorageLevel.MEMORY_AND_DISK
        levels = 1 if start.getNumPartitions() <= DIRECT else 2
        trees, held = [], [start.persist(keep)]
        for t in range(self.trees):

            def count(tree: Tree, level: int, build: list[int]) -> np.ndarray:
                part = partial(
                    level_of, tree=tree, level=level, build=build, downhill=downhill if t else _label,
                    draws=[self.draws, t], share=self.share,
                )
                return held[-1].map(part).treeReduce(np.add, levels)

            tree = grown(count, self.depth)
            trees.append(tree._replace(value=tree.value * (self.rate if t else 1.0)))
            # the blocks of the round are stored by now; of those before it only the first are read again
            for blocks in held[1:-1]:
                blocks.unpersist()
            del held[1:-1]
            base, added = (held[-1], trees[-1:]) if (t + 1) % ANCHOR else (start, list(trees))
            held.append(base.map(partial(moved, trees=added, depth=self.depth)).persist(keep))
        for blocks in held:
            blocks.unpersist()
        return trees


class _BoosterModel(Model):
    """Trees with weighted values."""

    def __init__(self, features: str, edges: list[np.ndarray], trees: list[Tree], depth: int):
        super().__init__()
        self.features, self.edges, self.trees, self.depth = features, edges, trees, depth

    def _margin(self):
        edges, trees, depth = self.edges, self.trees, self.depth

        @F.pandas_udf("double")
        def margin(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype="float64")
            return pd.Series(summed(binned(np.stack(features.to_numpy()), edges), trees, depth))

        return margin(vector_to_array(F.col(self.features)))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn("prediction", self._margin())


class _ClassifierModel(_BoosterModel):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Adds the probability of label 1."""
        return dataset.withColumn("probability", 1 / (1 + F.exp(-2 * self._margin())))


class PooledRegressor(_Booster):
    downhill, result = staticmethod(_squared), _BoosterModel


class PooledClassifier(_Booster):
    """Labels 0 and 1."""

    downhill, result = staticmethod(_logistic), _ClassifierModel

    def _target(self):
        return 2 * super()._target() - 1
