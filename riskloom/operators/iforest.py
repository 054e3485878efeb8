"""Isolation forest: trees grown from bounded samples, scored by vectorised descent in Arrow batches.

The rows with the smallest hashes form a pool of at most trees * samples rows;
every tree draws from it without replacement with a seed of its own, so reruns
agree.  Trees are bounded by 2 * samples - 1 nodes, so the forest is too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "tree int, node int, feature int, cut double, left int, right int, size int"


def expected_depth(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary search tree of n keys."""
    n = np.asarray(n, float)
    big = np.maximum(n, 3)
    out = 2 * (np.log(big - 1) + np.euler_gamma) - 2 * (big - 1) / big
    return np.where(n < 2, 0.0, np.where(n == 2, 1.0, out))


def grow(rows: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (feature or -1, cut, left, right, size) of one tree."""
    nodes: list[tuple] = []

    def add(part: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, -1, -1, len(part)))
        low, high = part.min(axis=0), part.max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth >= limit or len(part) < 2 or not len(varied):
            return at
        f = int(rng.choice(varied))
        cut = rng.uniform(low[f], high[f])
        below = part[:, f] < cut
        if below.all() or not below.any():  # the cut fell on the smallest value
            below = part[:, f] <= low[f]
            cut = float(np.nextafter(low[f], np.inf))
        nodes[at] = (f, float(cut), add(part[below], depth + 1), add(part[~below], depth + 1), len(part))
        return at

    add(rows, 0)
    return nodes


@dataclass
class Forest:
    trees: list[dict[str, np.ndarray]]
    psi: int

    @staticmethod
    def of(table: pd.DataFrame, psi: int) -> Forest:
        trees = []
        for _, part in table.sort_values(["tree", "node"]).groupby("tree"):
            trees.append({c: part[c].to_numpy() for c in ("feature", "cut", "left", "right", "size")})
        return Forest(trees, psi)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean depth / expected depth): near 1 for outliers, below 0.5 for ordinary rows."""
        depth = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in self.trees:
            at, d = np.zeros(len(x), np.int64), np.zeros(len(x))
            while True:
                inner = t["feature"][at] >= 0
                if not inner.any():
                    break
                i, node = rows[inner], at[inner]
                below = x[i, t["feature"][node]] < t["cut"][node]
                at[inner] = np.where(below, t["left"][node], t["right"][node])
                d[inner] += 1
            depth += d + expected_depth(t["size"][at])
        return 2 ** -(depth / max(1, len(self.trees)) / max(float(expected_depth(self.psi)), 1e-12))


def fit(scaled: DataFrame, columns: list[str], n_trees: int = 200, samples: int = 256, seed: int = 42) -> tuple[DataFrame, int]:
    """The nodes of the forest, and the sample size; ``scaled`` has user_id and the feature columns."""
    spark = scaled.sparkSession
    pool = (
        scaled.select(F.xxhash64(F.col("user_id").cast("string"), F.lit(seed)).alias("_h"), F.col("user_id").cast("string").alias("_u"), *columns)
        .orderBy("_h", "_u").limit(n_trees * samples).select(*columns).toPandas().to_numpy(float)
    )
    psi = min(samples, len(pool))
    if not psi:
        raise ValueError("no rows to fit on")
    shared = spark.sparkContext.broadcast(pool)
    limit = math.ceil(math.log2(max(psi, 2)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tree in batch["id"]:
                rng = np.random.default_rng([seed, int(tree)])
                nodes = grow(shared.value[rng.choice(len(shared.value), psi, replace=False)], rng, limit)
                yield pd.DataFrame([(int(tree), i, *n) for i, n in enumerate(nodes)], columns=["tree", "node", "feature", "cut", "left", "right", "size"])

    return spark.range(n_trees).mapInPandas(run, NODES), psi


def score(scaled: DataFrame, columns: list[str], forest: Forest, out: str = "raw") -> DataFrame:
    """All columns of ``scaled`` and the forest score; no shuffle."""
    shared = scaled.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{out: shared.value.score(batch[columns].to_numpy(float))})

    return scaled.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in scaled.dtypes) + f", {out} double")
