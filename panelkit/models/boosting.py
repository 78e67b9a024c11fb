"""Second-order boosting of trees on feature histograms.

Every level of a tree is one aggregate over the rows: sums of gradient, curvature and rows for each node, feature and
bin. Of two siblings only the one with fewer rows is summed; the other is what remains of their parent. A node's gain
does not depend on other nodes, so the tree is grown by levels and then cut back to the leaves that growing the best
leaf first would have made. Rows are kept in blocks, as bytes: their bins and a margin that is written anew every few
trees; tasks send sums of a size that rows have no part in.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.session import cut_lineage, sum_blocks

LEAST_GAIN = 1e-9
ACCURACY = 10_000
ROWS_PER_TASK = 65_536  # at most, if they are dealt evenly; fewer while cores are idle
FEWEST_ROWS = 16_384  # of a task: jobs are short and many


@dataclass
class Tree:
    """Nodes by number; a leaf has feature -1. Values up to the split go left, all others and unknown ones right."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``x``."""
        own, inner = np.arange(len(self.feature)), self.feature >= 0
        feature = np.maximum(self.feature, 0)
        # A leaf leads to itself.
        child = np.column_stack([np.where(inner, self.right, own), np.where(inner, self.left, own)]).ravel()
        cells, first = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        node = np.zeros(len(x), np.int64)
        while inner.take(node).any():
            goes_left = cells.take(first + feature.take(node)) <= self.split.take(node)
            node = child.take(2 * node + goes_left)
        return node


def edges(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Inner bin borders of each feature: values at its quantiles, each once, from one aggregate of sketches."""
    shares = [i / bins for i in range(1, bins)]
    value = {f: F.col(f).cast("double") for f in features}
    row = df.agg(*[F.percentile_approx(F.when(~F.isnan(v), v), shares, ACCURACY) for v in value.values()]).first()
    return [np.unique(np.asarray(q or [], "float64")) for q in row]


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-margin))


class _Growth:
    """One tree while it grows: node sums, best splits, histograms of the last level."""

    def __init__(self, sizes: Sequence[int], least_rows: int, ridge: float):
        self.sizes, self.least_rows, self.ridge = sizes, least_rows, ridge
        self.sums, self.best, self.children = [None], {}, {}

    def weight(self, sums: np.ndarray) -> float:
        return -sums[0] / (sums[1] + self.ridge) if sums[1] + self.ridge > 0 else 0.0

    def look(self, node: int, histogram: np.ndarray) -> None:
        """The best split of a node from its histogram (feature, bin, [gradient, curvature, rows])."""
        self.sums[node] = total = histogram[0].sum(axis=0)
        below = histogram.cumsum(axis=1)
        above = total - below
        score = lambda s: s[..., 0] ** 2 / np.maximum(s[..., 1] + self.ridge, 1e-300)
        gain = score(below) + score(above) - score(total)
        enough = (below[..., 2] >= self.least_rows) & (above[..., 2] >= self.least_rows)
        enough &= (below[..., 1] > 1e-3) & (above[..., 1] > 1e-3)
        gain = np.where(enough, gain, -np.inf)
        for j, size in enumerate(self.sizes):
            gain[j, size:] = -np.inf
        feature, cell = np.unravel_index(int(np.argmax(gain)), gain.shape)
        if gain[feature, cell] > LEAST_GAIN:
            self.best[node] = (float(gain[feature, cell]), int(feature), int(cell))

    def split(self, node: int) -> tuple[int, int]:
        self.children[node] = pair = (len(self.sums), len(self.sums) + 1)
        self.sums += [None, None]
        return pair

    def tree(self, wanted: set[int], rate: float) -> Tree:
        """The tree with the ``wanted`` nodes split, in bins; nodes keep their numbers."""
        n = len(self.sums)
        out = Tree(np.full(n, -1), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n))
        for node in range(n):
            if node in wanted:
                out.feature[node], out.split[node] = self.best[node][1:]
                out.left[node], out.right[node] = self.children[node]
            elif self.sums[node] is not None:
                out.value[node] = rate * self.weight(self.sums[node])
        return out

    def best_first(self, leaves: int) -> set[int]:
        """The nodes that are split if the leaf of highest gain always goes first."""
        split, heap = set(), [(-self.best[0][0], 0)] if 0 in self.best else []
        while heap and len(split) + 1 < leaves:
            _, node = heapq.heappop(heap)
            if node not in self.children:
                continue
            split.add(node)
            for child in self.children[node]:
                if child in self.best:
                    heapq.heappush(heap, (-self.best[child][0], child))
        return split


@dataclass
class HistogramBoosting:
    """A fitted two-class model: start margin and trees over ``features``."""

    features: list
    start: float
    trees: list

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str], label: str, rounds: int = 100, depth: int = 5,
            leaves: int = 31, rate: float = 0.1, bins: int = 255, least_rows: int = 20, ridge: float = 0.0,
            keep_every: int = 10) -> HistogramBoosting:
        """Logistic loss; ``bins`` (255 at most) quantile bins a feature. Nulls and NaN go right at every split.

        A feature without two values is never split on; labels of one class or an empty frame give no tree.
        """
        if not 2 <= bins <= 255:
            raise ValueError("bins must lie between 2 and 255")
        names, width = list(features), bins + 1
        cuts = edges(df, names, bins)
        totals = df.agg(F.count(label).alias("n"), F.sum(F.col(label).cast("double")).alias("ones")).first()
        n, ones = totals["n"], totals["ones"] or 0.0
        start = float(np.log((ones + 1e-9) / (n - ones + 1e-9))) if n else 0.0
        model = cls(names, start, [])
        if not 0 < ones < n:
            return model

        def binned(frames):
            for pdf in frames:
                x = pdf[names].to_numpy("float64")
                cells = np.stack([np.where(np.isnan(x[:, j]), width - 1, np.searchsorted(c, x[:, j], side="left"))
                                  for j, c in enumerate(cuts)], axis=1).astype(np.uint8)
                yield pd.DataFrame({"b": [cells.tobytes()], "y": [pdf["_y"].to_numpy("float64").tobytes()],
                                    "m": [np.full(len(pdf), start).tobytes()]})

        schema = "b binary, y binary, m binary"
        at_once = df.sparkSession.sparkContext.defaultParallelism
        tasks = max(-(-n // ROWS_PER_TASK), min(-(-n // FEWEST_ROWS), at_once))
        data = cut_lineage(df.where(F.col(label).isNotNull()).select(
            F.col(label).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f) for f in names]).coalesce(
            tasks).mapInPandas(binned, schema))
        blocks = data.rdd
        pending: list[Tree] = []

        def rows_of(b, m, known):
            x = np.frombuffer(b, np.uint8).reshape(-1, len(names))
            margin = np.frombuffer(m) + sum(t.value.take(t.leaves(x)) for t in known)
            return x, margin

        def histograms(tree: Tree, wanted: Sequence[int]) -> np.ndarray:
            known, place = list(pending), np.full(len(tree.feature), -1)
            place[list(wanted)] = np.arange(len(wanted))
            size = len(wanted) * len(names) * width * 3

            def partial(number, rows):
                total = np.zeros((len(names), 3, len(wanted) * width))
                for b, y, m in rows:
                    x, margin = rows_of(b, m, known)
                    p, at = _chance(margin), place.take(tree.leaves(x))
                    keep = at >= 0
                    x, p, at, y = np.ascontiguousarray(x[keep].T), p[keep], at[keep], np.frombuffer(y)[keep]
                    for j in range(len(names)):
                        cell = at * width + x[j]
                        for k, w in enumerate((p - y, p * (1 - p), None)):
                            total[j, k] += np.bincount(cell, weights=w, minlength=total.shape[2])
                yield number, total.tobytes()

            summed = sum_blocks(blocks.mapPartitionsWithIndex(partial), size)
            return summed.reshape(len(names), 3, len(wanted), width).transpose(2, 0, 3, 1)

        for _ in range(rounds):
            growth = _Growth([len(c) for c in cuts], least_rows, ridge)
            level = {0: histograms(growth.tree(set(), rate), [0])[0]}
            growth.look(0, level[0])
            for step in range(depth):
                parents = [node for node in level if node in growth.best]
                if not parents:
                    break
                pairs = {node: growth.split(node) for node in parents}
                less = {}
                for node, (left, right) in pairs.items():
                    _, feature, cell = growth.best[node]
                    low = level[node][feature, :cell + 1].sum(axis=0)
                    growth.sums[left], growth.sums[right] = low, growth_total(level[node]) - low
                    less[node] = left if 2 * low[2] <= growth_total(level[node])[2] else right
                if step == depth - 1:
                    break
                small = dict(zip(less.values(), histograms(growth.tree(set(growth.children), rate), list(less.values()))))
                below = {}
                for node, pair in pairs.items():
                    other = pair[0] if less[node] == pair[1] else pair[1]
                    below[less[node]] = small[less[node]]
                    below[other] = level[node] - small[less[node]]
                level = below
                for node, histogram in level.items():
                    growth.look(node, histogram)
            split = growth.best_first(leaves)
            if not split:
                break
            grown = growth.tree(split, rate)
            pending.append(grown)
            model.trees.append(Tree(grown.feature, np.array([
                cuts[f][int(s)] if f >= 0 else 0.0 for f, s in zip(grown.feature, grown.split)]),
                grown.left, grown.right, grown.value))
            if len(pending) == keep_every:
                known, old = list(pending), data

                def moved(frames):
                    for pdf in frames:
                        yield pdf.assign(m=[rows_of(b, m, known)[1].tobytes() for b, m in zip(pdf["b"], pdf["m"])])

                data = cut_lineage(data.mapInPandas(moved, schema))
                data.count()
                blocks = data.rdd
                old.unpersist()
                pending.clear()
        data.unpersist()
        return model

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((t.value[t.leaves(x)] for t in self.trees), np.zeros(len(x)))

    def probability(self) -> Column:
        """Probability of class 1 from the feature columns, in Arrow batches."""
        width = len(self.features)

        @F.pandas_udf("double")
        def chance(x: pd.Series) -> pd.Series:
            return pd.Series(_chance(self.margins(np.array(x.to_list(), "float64").reshape(-1, width))))

        return chance(F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in self.features]))


def growth_total(histogram: np.ndarray) -> np.ndarray:
    """Sums of a node: those over all bins of any feature."""
    return histogram[0].sum(axis=0)
