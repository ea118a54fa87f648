"""Connected components of a graph whose edges are a DataFrame.

Edges are first contracted within each partition, by union-find, to a forest of its
nodes; then large-star and small-star rounds alternate until every node points at the
smallest of its component. The number of rounds grows with the logarithm of the
longest path that contraction leaves. A graph of few edges is contracted in one task,
which ends it at once. Nothing of the graph goes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import attach, cut

ROUNDS = 100
#: Edges that one task may contract.
FEW = 250_000


def forest(edges) -> dict:
    """Each node of edges (pairs) to the smallest node that it is connected with."""
    parent: dict = {}

    def find(x):
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs: list = []
    for batch in batches:
        pairs += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        if len(pairs) > 500_000:
            pairs = [(x, r) for x, r in forest(pairs).items() if x != r]
    rows = [(x, r) for x, r in forest(pairs).items() if x != r]
    for i in range(0, len(rows), 65_536):
        own = rows[i : i + 65_536]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in own], pa.int64()), pa.array([r for _, r in own], pa.int64())], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """edges (two bigint columns; repeated edges and loops are allowed) -> node, component, the smallest node of its component.

    Nodes that stand only in loops, and null ends, have no row.
    """
    a, b = edges.columns
    pairs = edges.filter(F.col(a) != F.col(b)).select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v"))
    held = cut(pairs.mapInArrow(_contract, "u long, v long"))  # u > v throughout
    few = held.count() <= FEW
    if few:
        held = cut(held.coalesce(1).mapInArrow(_contract, "u long, v long"))
    else:
        held = cut(held.distinct())
    seen = None
    for _ in range(0 if few else ROUNDS):
        now = held.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        total = 2 * now[0]
        both = cut(held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = cut(attach(both, least, ["u"], "n", total, "inner").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        small = attach(large, least, ["u"], "n", total, "inner").select(F.greatest("v", "m").alias("u2"), F.least("v", "m").alias("v2")).filter("u2 > v2").select(F.col("u2").alias("u"), F.col("v2").alias("v"))
        held = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    roots = held.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return held.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
