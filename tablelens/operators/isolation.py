"""Isolation forest (Liu, Ting & Zhou 2008): rows that are unusual as a combination of numbers.

A forest has a fixed size whatever the table: each tree is grown in one task from at most 256 rows, and
all trees together have about fifty thousand nodes. Which rows a tree sees is decided by a hash of the
row and the tree number, so that the same table gives the same forest on any cluster. Scoring is
one scan that ships only the numeric columns to vectorised code.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablelens.functions.fingerprint import fingerprint
from tablelens.operators.quantiles import quantile
from tablelens.operators.rows import complete_cases
from tablelens.schema import as_double, classify, col, normalize
from tablelens.sources.scratch import materialize
from tablelens.thresholds import DEFAULTS, Thresholds

_UNIT = float(1 << 53)
_NODES = "tree int, node int, feature int, split double, left int, right int, depth int, size int"


def _uniform(key: list[Column], *salt) -> Column:
    """A number in [0, 1) that depends on the row key only."""
    bits = F.shiftrightunsigned(F.xxhash64(*[s if isinstance(s, Column) else F.lit(s) for s in salt], *key), 11)
    return bits.cast("double") / F.lit(_UNIT)


def _copies(pdf: pd.DataFrame, limit: float, blocks: int, seed: int) -> Iterator[pd.DataFrame]:
    """The draws below ``limit`` of rows that occur ``n`` times: the smallest of n uniform numbers, one after another.

    They are found through their spacings, so a row that occurs a billion times costs as many draws as a tree
    can use and is never written out a billion times.
    """
    for row in pdf.itertuples(index=False):
        for b in range(blocks):
            rng = np.random.default_rng([seed, b, row.fp_a & (2**64 - 1), row.fp_b & (2**64 - 1)])
            drawn, done, low = [], 0, 0.0
            while done < row.n:
                m = min(row.n - done, int(row.n * limit * 1.2) + 16)
                tail = low + np.cumsum(np.log1p(-rng.random(m)) / (row.n - done - np.arange(m)))
                u = -np.expm1(tail)
                drawn.append(u[u < limit])
                done, low = done + m, tail[-1]
                if u[-1] >= limit:
                    break
            u = np.concatenate(drawn)
            if len(u):
                yield pd.DataFrame({"x": [row.x] * len(u), "fp_a": row.fp_a, "fp_b": row.fp_b, "block": b, "u": u})


def tree_samples(df: DataFrame, features: list[str], key: list[str], n: int,
                 limits: Thresholds = DEFAULTS) -> DataFrame:
    """``(tree, draw, x)``: up to 256 rows for each tree, drawn without replacement from the whole table.

    Each row is offered to a tree with four times the needed probability and the tree keeps the smallest draws,
    so that about a hundred thousand rows are shuffled at any table size. A number per row and block of trees
    says to which tree of the block a row is offered: a large table costs one hash per row. It is a hash of key
    and features. Without a key, equal rows are counted, and each copy gets a number of its own.
    """
    psi = min(limits.forest_subsample, n)
    share = min(1.0, 4 * psi / n)
    per_block = max(1, math.floor(1 / share))
    blocks = math.ceil(limits.forest_trees / per_block)
    x = F.array(*[as_double(f) + F.lit(0.0) for f in features]).alias("x")
    if key:
        rows, copies = df.select(x, *fingerprint(df, [*key, *features])), None
    else:
        counted = df.select(x).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
        counted = counted.select("x", "n", *fingerprint(counted, ["x"]))
        rows, limit, seed = counted.filter("n = 1"), min(1.0, per_block * share), limits.seed
        copies = counted.filter("n > 1").mapInPandas(
            lambda parts: (out for pdf in parts for out in _copies(pdf, limit, blocks, seed)),
            "x array<double>, fp_a bigint, fp_b bigint, block int, u double")
    draws = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.struct(
        b.alias("block"), _uniform([F.col("fp_a"), F.col("fp_b")], limits.seed, b).alias("u")))
    offered = rows.select("x", "fp_a", "fp_b", F.inline(F.filter(draws, lambda d: d["u"] < per_block * share)))
    if copies is not None:
        offered = offered.unionByName(copies)
    nth = F.floor(F.col("u") / share)
    tree = (F.col("block") * per_block + nth).cast("int")
    offered = offered.filter(nth < per_block).select("x", "fp_a", "fp_b", tree.alias("tree"), (F.col("u") - nth * share).alias("draw"))
    per_tree = Window.partitionBy("tree").orderBy("draw", "fp_a", "fp_b")
    return (offered.filter(F.col("tree") < limits.forest_trees)
            .withColumn("nth", F.row_number().over(per_tree)).filter(F.col("nth") <= psi)
            .select("tree", "draw", "x"))


def _grow(x: np.ndarray, tree: int, limits: Thresholds, height: int) -> list[tuple]:
    rng = np.random.default_rng([limits.seed, tree])
    nodes: list[list] = []
    todo = [(x, 0, -1, 0)]
    while todo:
        part, depth, parent, side = todo.pop()
        me = len(nodes)
        nodes.append([tree, me, -1, 0.0, me, me, depth, len(part)])
        if parent >= 0:
            nodes[parent][4 + side] = me
        low, high = part.min(axis=0), part.max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= height or len(part) <= 1 or len(varying) == 0:
            continue
        f = int(rng.choice(varying))
        split = float(rng.uniform(low[f], high[f]))
        split = low[f] if split >= high[f] else split
        nodes[me][2:4] = f, split
        goes_left = part[:, f] <= split
        todo += [(part[~goes_left], depth + 1, me, 1), (part[goes_left], depth + 1, me, 0)]
    return [tuple(n) for n in nodes]


def _mean_depth(n: np.ndarray) -> np.ndarray:
    """Average depth of an unsuccessful search in a binary search tree of ``n`` values."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(big - 1) + np.euler_gamma) - 2 * (big - 1) / big))


@dataclass(frozen=True)
class Forest:
    features: tuple[str, ...]
    psi: int
    trees: tuple[tuple[np.ndarray, ...], ...]   # feature, split, (left, right) pairs, path length per node
    height: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """All rows walk down a tree together; a leaf is its own child."""
        depth = np.zeros(len(x))
        flat, first = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        for feature, split, children, length in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.height):
                right = flat.take(first + feature.take(at)) > split.take(at)
                at = children.take(2 * at + right)
            depth += length.take(at)
        return -np.exp2(-depth / len(self.trees) / _mean_depth(np.array(self.psi)))


def fit_forest(df: DataFrame, features: list[str], key: list[str], n: int, limits: Thresholds = DEFAULTS) -> Forest:
    psi = min(limits.forest_subsample, n)
    height = math.ceil(math.log2(max(psi, 2)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("draw", kind="stable")
        nodes = _grow(np.stack(pdf["x"].to_numpy()), int(pdf["tree"].iloc[0]), limits, height)
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "split", "left", "right", "depth", "size"])

    # The model itself: at most trees * (2 * 256 - 1) rows.
    nodes = tree_samples(df, features, key, n, limits).groupBy("tree").applyInPandas(grow, _NODES) \
        .orderBy("tree", "node").toPandas()
    trees = []
    for _, t in nodes.groupby("tree"):
        leaf = (t["feature"] < 0).to_numpy()
        trees.append((
            np.where(leaf, 0, t["feature"]).astype(np.int64), np.where(leaf, np.inf, t["split"]),
            t[["left", "right"]].to_numpy(np.int64).ravel(),
            t["depth"].to_numpy(float) + np.where(leaf, _mean_depth(t["size"].to_numpy()), 0.0),
        ))
    return Forest(tuple(features), psi, tuple(trees), height)


def score_rows(df: DataFrame, forest: Forest) -> DataFrame:
    """Add ``anomaly_score``: lower is more unusual."""
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = shared.value
        for batch in batches:
            yield pd.Series(model.score(np.column_stack([c.to_numpy(dtype=float) for c in batch])))

    return df.withColumn("anomaly_score", score(*[as_double(f) for f in forest.features]))


@dataclass
class IsolationReport:
    ran: bool
    reason: str | None = None
    rows_checked: int = 0
    anomalous: int = 0
    threshold: float | None = None
    scored: DataFrame | None = None
    top: DataFrame | None = None

    @property
    def pct(self) -> float:
        return round(100 * self.anomalous / self.rows_checked, 1) if self.rows_checked else 0.0


def isolation_forest(df: DataFrame, key: Iterable[str] = (), exclude: Iterable[str] = (),
                     limits: Thresholds = DEFAULTS) -> IsolationReport:
    """Flag the five percent of the complete numeric rows that are isolated soonest.

    ``key`` names the columns that identify a row; it is no feature. Without one, equal rows are counted first
    and drawn copy by copy. The result does not depend on how the table is partitioned, with or without a key.
    """
    df, key = normalize(df), list(key)
    features = list(classify(df, set(exclude) | set(key)).numeric)
    if len(features) < limits.forest_min_columns:
        return IsolationReport(False, f"At least {limits.forest_min_columns} numeric columns are needed.")
    rows = complete_cases(df.select(*[col(k) for k in key], *[col(f) for f in features]), features)
    n = rows.count()
    if n < limits.forest_min_rows:
        return IsolationReport(False, f"At least {limits.forest_min_rows} complete numeric rows are needed.")
    return judge(rows, fit_forest(rows, features, key, n, limits), n, [*key, *features], limits)


def judge(rows: DataFrame, forest: Forest, n: int, order: list[str], limits: Thresholds = DEFAULTS) -> IsolationReport:
    """Score ``n`` complete rows with a forest and flag the lowest five percent; ``order`` decides ties of the top rows."""
    # Scores cost a pass through Python and are read several times below.
    scored = materialize(score_rows(rows, forest), "scores")
    threshold = quantile(scored, "anomaly_score", limits.contamination)
    flagged = scored.filter(F.col("anomaly_score") < threshold)
    top = (flagged.orderBy("anomaly_score", *[col(c) for c in order]).limit(limits.forest_top_rows)
           .withColumn("anomaly_score", F.bround("anomaly_score", 3)))
    return IsolationReport(True, None, n, flagged.count(), threshold, scored, top)


def forest_of(features: list[str], trees: list[tuple], psi: int) -> Forest:
    """A forest from trees that are given, each (feature, split, tree up to the split, tree above it) or a leaf's number of rows."""
    built, deepest = [], 1
    for tree in trees:
        nodes, todo = [], [(tree, 0, None, 0)]
        while todo:
            node, depth, parent, side = todo.pop()
            me, leaf = len(nodes), not isinstance(node, tuple)
            deepest = max(deepest, depth)
            nodes.append([0 if leaf else features.index(node[0]), math.inf if leaf else node[1], [me, me],
                          depth + (float(_mean_depth(np.array(node))) if leaf else 0.0)])
            if parent is not None:
                nodes[parent][2][side] = me
            if not leaf:
                todo += [(node[3], depth + 1, me, 1), (node[2], depth + 1, me, 0)]
        feature, split, children, length = zip(*nodes)
        built.append((np.array(feature, np.int64), np.array(split, float), np.array(children, np.int64).ravel(), np.array(length, float)))
    return Forest(tuple(features), psi, tuple(built), deepest)
