"""Connected components of edges, on executors and inside a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialise


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest position connected with each of n positions by the edges a-b."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return root
        a, b = a[open_], b[open_]
        np.minimum.at(root, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b) -> (node, component) of every node on an edge: the smallest node reachable.

    Large-star and small-star in turn (Kiveris and others 2014): every node links its larger neighbours, then its smaller
    ones, to the smallest of its neighbourhood, until every edge leads to a root. Rounds grow with the logarithm of
    the nodes; each is a table in the shared folder, and only a row of totals comes to the driver. Edges lead from the
    larger node to the smaller. A hub's edges meet its one row in a join that Spark can split."""
    spark = edges.sparkSession
    own = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    before = None
    with Scratch(spark):
        e = materialise(edges.select(*own).where("a <> b").distinct(), "edges")
        for _ in range(most_rounds):
            # The smallest of b and its neighbours: of edges that lead down, b's own tell it.
            least = e.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("least"))
            large = e.join(least, "b", "left").select("a", F.coalesce("least", "b").alias("b"))
            # (node, smaller neighbour) edges; the smallest of each node's smaller neighbours takes over.
            least = large.groupBy("a").agg(F.min("b").alias("least"))
            small = large.join(least, "a").select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
            e = materialise(small, "edges")
            now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
            if now == before or now[0] == 0:
                roots = e.select(F.col("b").alias("node")).distinct()
                out = e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
                return materialise(out, "components", keep=True)
            before = now
    raise RuntimeError("components did not settle")
