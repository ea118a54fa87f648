"""Near-duplicate vectors: cross-polytope hashing with multiprobe buckets and verified pairs.

Equal vectors of a label become one class with a multiplicity, so copies cost nothing
further. For each table a class is rotated by three rounds of random signs and a fast
Hadamard transform; the coordinate of the largest magnitude, with its sign, is the
nearest vertex of the cross-polytope and names the vector's home bucket (a tuple of
`hashes` independent vertices does). Besides its home every vector is put into the
buckets of its next nearest vertices, and two vectors of a bucket are candidates if it
is the home of one of them.

Buckets are dealt into blocks that meet in pairs. A pair of blocks is verified at once
by cosines in double precision; a pair of vectors that shares several buckets counts in
the first table where it does, and there in the smaller one. Blocks give each vector its number of links and one edge
to the smallest vector that it is connected with there, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.near_dedup import runs
from millrace.llm.session import attach, cut, partitions, small_batches, table
from millrace.operators.components import components

THRESHOLD = 0.98
#: Nearest vertices that are tried for each vertex of a bucket's name. In 64 dimensions a pair at
#: the threshold then shares a bucket of one table with a chance of 0.996 for names of one vertex
#: and of 0.99 for names of two.
PROBES = 4
TABLES = {1: 2}
MORE_TABLES = 3
BLOCK = 512
#: Blocks that a bucket of the largest label is meant to fill; a vector is sent once for each.
BLOCKS = 4


def plan(largest: int, dimension: int, probes: int = PROBES) -> tuple[int, int]:
    """(vertices of a bucket's name, tables) for so many distinct vectors of one label.

    Names grow with the logarithm of the vectors, so that buckets, and with them the times
    that a vector is sent, don't. The chance to miss a pair at exactly the threshold
    is below 0.00002 up to 64 dimensions and about 0.0002 at 768; it falls fast above it.
    """
    names = 2 << max(0, (dimension - 1).bit_length())
    vertices = 1
    while largest * probes**vertices > BLOCKS * BLOCK * names**vertices and probes < names:
        vertices += 1
    return vertices, TABLES.get(vertices, MORE_TABLES)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, whose length is a power of two."""
    n = x.shape[1]
    step = 1
    while step < n:
        pairs = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


def rotated(unit: np.ndarray, number: int) -> np.ndarray:
    """The rows of unit, padded to a power of two, under the number-th rotation."""
    size = 1 << max(0, (unit.shape[1] - 1).bit_length())
    x = np.zeros((len(unit), size))
    x[:, : unit.shape[1]] = unit
    signs = np.random.default_rng(1000 + number)
    for _ in range(3):
        x = hadamard(x * signs.choice(np.array([-1.0, 1.0]), size))
    return x


def buckets(unit: np.ndarray, number: int, vertices: int = 1, probes: int = PROBES) -> np.ndarray:
    """(rows, probes) bucket names of one table; the first is the home. -1 where there are fewer."""
    count = len(unit)
    names, losses = np.zeros((count, 1), np.int64), np.zeros((count, 1))
    for v in range(vertices):
        x = rotated(unit, number * vertices + v)
        most = min(probes, x.shape[1])
        size = np.abs(x)
        order = np.argsort(-size, axis=1, kind="stable")[:, :most]
        taken = np.take_along_axis(size, order, 1)
        vertex = order * 2 + (np.take_along_axis(x, order, 1) < 0)
        names = (names[:, :, None] * (2 * x.shape[1]) + vertex[:, None, :]).reshape(count, -1)
        losses = (losses[:, :, None] + (taken[:, :1] - taken)[:, None, :]).reshape(count, -1)
        best = np.argsort(losses, axis=1, kind="stable")[:, : probes**vertices]
        names, losses = np.take_along_axis(names, best, 1), np.take_along_axis(losses, best, 1)
    out = np.full((count, probes**vertices), -1, np.int64)
    out[:, : names.shape[1]] = names
    return out


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, whose rows are equally long, as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _place(batches: Iterator[pa.RecordBatch], tables: int, vertices: int, probes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False) if len(batch.column(2)) else np.zeros(0)
        for size in np.unique(sizes):
            own = batch.take(pa.array(np.flatnonzero(sizes == size)))
            unit = unit_rows(matrix(own.column(2)))
            node, label = own.column(0).to_numpy(), own.column(1)
            for t in range(tables):
                found = buckets(unit, t, vertices, probes)
                at, probe = np.nonzero(found >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), label.take(pa.array(at)), pa.array(np.full(len(at), int(size))), pa.array(np.full(len(at), t, np.int32)), pa.array(found[at, probe]), pa.array(probe == 0)], ["node", "label", "size", "tbl", "bucket", "home"])


def _compare(batches: Iterator[pa.RecordBatch], threshold: float, vertices: int, probes: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, tbl, bucket, side, node, home, copies, embedding) sorted by block -> node, links, root."""
    for group in runs(batches):
        side, node = group.column("side").to_numpy(), group.column("node").to_numpy()
        home, copies = group.column("home").to_numpy(zero_copy_only=False), group.column("copies").to_numpy()
        number = int(group.column("tbl")[0].as_py())
        unit = unit_rows(matrix(group.column("embedding")))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        own = not len(right)
        if own:
            right = left
        live = (unit[left] @ unit[right].T >= threshold) & (home[left][:, None] | home[right][None, :])
        if own:
            live = np.triu(live, 1)
        a, b = np.nonzero(live)
        bucket = int(group.column("bucket")[0].as_py())
        for t in range(number + 1):  # not again what an earlier table has, or this one's other bucket
            if not len(a):
                break
            used = np.unique(np.concatenate([left[a], right[b]]))
            found = np.full((len(unit), probes**vertices), -2, np.int64)
            found[used] = buckets(unit[used], t, vertices, probes)
            keep = np.ones(len(a), bool)
            for i in range(0, len(a), 65_536):
                x, y = found[left[a[i : i + 65_536]]], found[right[b[i : i + 65_536]]]
                at_x, at_y = (y == x[:, :1]).any(1), (x == y[:, :1]).any(1)  # met in the home of x, of y
                keep[i : i + 65_536] = ~(at_x | at_y) if t < number else ~(at_x & at_y) | (np.minimum(x[:, 0], y[:, 0]) == bucket)
            a, b = a[keep], b[keep]
        if not len(a):
            continue
        i, j = left[a], right[b]
        links = np.bincount(i, copies[j], len(unit)) + np.bincount(j, copies[i], len(unit))
        root = node.copy()
        while True:  # smallest node reachable within the block
            least = root.copy()
            np.minimum.at(least, i, root[j])
            np.minimum.at(least, j, root[i])
            if (least == root).all():
                break
            root = least
        at = np.flatnonzero(links > 0)
        yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(links[at].astype(np.int64)), pa.array(root[at])], ["node", "links", "root"])


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tables: int | None = None, vertices: int | None = None, probes: int = PROBES) -> DataFrame:
    """vectors (vec_id, embedding, label) -> vec_id, n_links, component_id, kept.

    Vectors are compared only when their labels are equal and not null, and their lengths
    equal. A vector that is null, empty, zero, or holds a null, NaN or infinity links with
    nothing, nor does one without id. Repeated rows are vectors of their own, linked with
    each other; so are the vectors of an id that has several, or the same under several
    labels, which are linked only if they are alike. Empty input gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    v = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding", F.coalesce(sound, F.lit(False)).alias("sound"))
    keyed = cut(rows.select("vec_id", "label", "sound", F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(7), F.col("embedding"), F.size("embedding")).alias("k2")))
    key = ["label", "k1", "k2"]
    total = keyed.count()
    classes = cut(keyed.filter("sound").groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least")))
    # a class is a node named by its least id, or by its key where that id stands for several classes
    several = cut(classes.groupBy("least").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("least", F.lit(True).alias("several")))
    renamed = several.head(1) != []
    if renamed:
        classes = cut(classes.join(several, "least", "left").withColumn("node", F.when(F.col("several"), F.xxhash64(*key)).otherwise(F.col("least"))).drop("several"))
    else:
        classes = classes.withColumn("node", F.col("least"))
    # one vector of each class
    held = rows.filter("sound").withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.xxhash64(F.lit(7), F.col("embedding"), F.size("embedding")))
    held = held.join(classes.select(*key, "copies", "node", F.col("least").alias("vec_id")), [*key, "vec_id"]).select("node", "label", "embedding", "copies").dropDuplicates(["node"])
    held = cut(held)
    sizes = held.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).agg(F.max("n").alias("n"), F.max("d").alias("d")).first()
    planned = plan(sizes["n"] or 0, sizes["d"] or 1, probes)
    vertices, tables = vertices or planned[0], tables or planned[1]
    placed = cut(held.select("node", "label", "embedding").mapInArrow(partial(_place, tables=tables, vertices=vertices, probes=probes), "node long, label string, size long, tbl int, bucket long, home boolean"))
    name = ["label", "size", "tbl", "bucket"]
    full = placed.groupBy(*name).agg(F.count(F.lit(1)).alias("members"), F.max("home").alias("any_home")).filter("members > 1 AND any_home").drop("any_home")
    full = cut(full)
    dealt = attach(placed, full, name, "members", tables * probes**vertices * total, "inner").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    block = F.xxhash64(*name, F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select(block.alias("block"), "tbl", "bucket", (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "home")
    met = dealt.join(held.drop("label"), "node").select("block", "tbl", "bucket", "side", "node", "home", "copies", "embedding").repartition(partitions(spark), "block").sortWithinPartitions("block", "side", "node")
    found = cut(met.mapInArrow(partial(_compare, threshold=threshold, vertices=vertices, probes=probes), "node long, links long, root long"))
    reached = components(found.select("node", "root"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    where = classes.join(links, "node", "left").join(reached, "node", "left")
    where = cut(where.select(*key, "copies", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")))
    if renamed:  # a component is named by the least id of its classes
        least = cut(where.groupBy("component_id").agg(F.min("least").alias("id"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
        placed = attach(where, least, ["component_id"], "n", total)
        where = cut(placed.select(*key, "copies", "n_links", F.coalesce("id", "least").alias("component_id")))
    known = attach(keyed.filter("sound"), where, key, "copies", total, "inner").select("vec_id", "n_links", "component_id")
    other = keyed.filter("NOT sound").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = known.unionByName(other)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op9_embedding_dedup(spark, sf_dir):
    """Every vector's links and component."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
