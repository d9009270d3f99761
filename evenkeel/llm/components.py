"""Connected components of a link table, by contraction.

Each round hooks every node to its smallest neighbour, halves the hooks once and replaces both
ends of every link by their hooks, so the links shrink until none is left. Aggregates
combine before the shuffle and joins can be split, so a hub needs no task of its own;
no labels, links or nodes come to the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.operators.runtime import settle


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``: the smallest node reachable.

    Rows with a null end or two equal ends link nothing; no links give no rows.
    """
    edges = settle(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(
            edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        hook = settle(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("to")))
        step = hook.select(F.col("node").alias("to"), F.col("to").alias("_far"))
        hook = settle(hook.join(step, "to").select("node", F.col("_far").alias("to")))
        if labels is None:
            labels = hook.select("node", F.col("to").alias("component"))
        else:
            labels = settle(labels.join(hook.select(F.col("node").alias("component"), "to"), "component", "left").select(
                "node", F.coalesce("to", "component").alias("component")))
        ends = edges.join(hook.select(F.col("node").alias("a"), F.col("to").alias("_a")), "a").join(
            hook.select(F.col("node").alias("b"), F.col("to").alias("_b")), "b")
        edges = settle(ends.select(F.greatest("_a", "_b").alias("a"), F.least("_a", "_b").alias("b")).where("a != b").distinct())
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels


class Forest:
    """Links found inside one task, kept only as far as they join what was apart."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while (to := up.get(x, x)) != x:
            up[x] = up.get(to, to)
            x = to
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            i, j = self.root(x), self.root(y)
            if i != j:
                self.up[max(i, j)] = min(i, j)
                self.links.append((x, y))
