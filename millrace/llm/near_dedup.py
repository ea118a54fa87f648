"""Near duplicates: banded MinHash candidates, sequential Bayesian pruning, exact verification.

1. Sketch. Every text becomes its set of hashed five-word shingles. Texts whose words
   are the same sequence (SHA-256 over it) have the same set and are one class at once,
   so copies cost nothing further; texts with equal sets in another order are linked by
   verification like all others. A class's signature holds HASHES minima of 16 bits, in
   BANDS bands.
2. Classes that share a band are candidates, tested in passes:
   a. Stars: every class is paired with one member of its buckets, the smallest of
      most of them. The links found give components.
   b. The rest: all candidates whose ends are in different components still. (A pair
      within a component can't change it.) A bucket of BLOCK members at most is one
      block. A pair that shares several bands is looked at in the first one.
   c. Members of larger buckets meet through prefixes instead: two sets that are near
      duplicates share a shingle among the (100 - THRESHOLD) % of either that come first
      in any fixed order, so with the order from rare to frequent a passage that many
      documents have in common brings none of them together. The rows are a part of the
      documents' shingles, whatever the size of their buckets.
   d. A shingle that still more than BLOCK members have in their prefixes, in different
      components, has members that such filters can't tell apart: they are dealt into
      blocks of DEALT that meet in pairs, but for those of the largest component with one
      another. Only there a row is made once for every DEALT members that it must meet.
3. Pruning. The signatures of a pair are compared BATCH minima at a time; after each
   batch the posterior of its similarity (uniform prior) tells whether it may still
   reach the threshold, and pairs with a chance below MISS are dropped.
4. Survivors are verified on the full sets, 100 * intersection >= 75 * union, and
   verified links alone make components.

No pair of a group is emitted as a row: blocks give each member with its partners, and
verified blocks give the links that join components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrays import BLANKS, column_bytes, gram_hashes, lower_ascii, mixed, run_hashes, sequence_digests, spans, tidy
from millrace.llm.session import attach, cut, documents, partitions, small_batches, small_enough, table
from millrace.operators.components import components

#: Words of a shingle, and the similarity (in hundredths) of near duplicates.
WORDS, THRESHOLD = 5, 75
#: A pair at the threshold shares no band with a chance of (1 - .75**5)**32 = 0.0002.
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Minima compared at a time, and the chance of a link below which a pair is dropped.
BATCH, MISS = 32, 1e-4
#: Members that meet one copy of a star's centre, of a bucket that is one block, and of a block of a larger one.
STAR, BLOCK, DEALT = 64, 128, 512
#: Shingles whose frequency orders the prefixes; all others count as rare. It bounds what is broadcast and has no influence on results.
FREQUENT = 1 << 16
#: Distinct shingles that a task counts before it forgets those seen once.
COUNTED = 1 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; a row of fewer than k words has its whole sequence as one."""
    starts, ends, first = spans(data, offsets, BLANKS)
    words = run_hashes(lower_ascii(data), starts, ends)
    grams = gram_hashes(words, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        out.append(np.unique(grams[a : b - k + 1]) if b - a >= k else gram_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def permutations(hashes: int = HASHES, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return (r.integers(0, 1 << 32, hashes, dtype=np.uint64) | np.uint64(1)).astype(np.uint32), r.integers(0, 1 << 32, hashes, dtype=np.uint64).astype(np.uint32)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The low 16 bits of each permutation's minimum."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        np.minimum(least, (x[i : i + 256, None] * a + b).min(0), out=least)
    return (least & np.uint32(0xFFFF)).astype(np.uint16)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(rows, BANDS) 64-bit keys; a key holds its band's number."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        h = mixed(h + parts[:, :, i] + np.uint64(1))
    return h


def least_matches(n: int, threshold: float = THRESHOLD / 100, miss: float = MISS) -> int:
    """The fewest matches of n with which similarity >= threshold has a posterior chance of miss at least."""
    s = (np.arange(20_000) + 0.5) / 20_000
    for m in range(n + 1):
        log = m * np.log(s) + (n - m) * np.log1p(-s)
        p = np.exp(log - log.max())
        if p[s >= threshold].sum() >= miss * p.sum():
            return m
    return n


def prune(left: np.ndarray, right: np.ndarray, live: np.ndarray, bounds: list[int]) -> np.ndarray:
    """live (left rows x right rows), without the pairs that some batch of minima rules out."""
    matches = np.zeros(live.shape, np.int16)
    for k, bound in enumerate(bounds):
        if not live.any():
            break
        own = slice(k * BATCH, (k + 1) * BATCH)
        rows, columns = np.flatnonzero(live.any(1)), np.flatnonzero(live.any(0))
        part = np.zeros((len(rows), len(columns)), np.int16)
        for j in range(own.start, min(own.stop, left.shape[1])):
            part += left[rows, j][:, None] == right[columns, j][None, :]
        matches[np.ix_(rows, columns)] += part
        live = live & (matches >= bound)
    return live


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = permutations()
    for batch in batches:
        data, offsets = column_bytes(batch.column(2))
        sets = shingle_sets(data, offsets)
        signatures = np.stack([signature(s, a, b) for s in sets]) if sets else np.zeros((0, HASHES), np.uint16)
        keys = band_keys(signatures).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(sequence_digests(lower_ascii(data), offsets, BLANKS), pa.binary()),
             pa.ListArray.from_arrays(pa.array(np.arange(0, len(sets) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1))), pa.array([s.tobytes() for s in signatures], pa.binary())],
            ["doc_id", "x", "n_shingles", "digest", "bands", "signature"],
        )


def _merged(shingles: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles, ascending, with the sums of their counts."""
    order = np.argsort(shingles, kind="stable")
    shingles, counts = shingles[order], counts[order]
    first = np.flatnonzero(np.r_[True, shingles[1:] != shingles[:-1]]) if len(shingles) else np.zeros(0, np.int64)
    return shingles[first], np.add.reduceat(counts, first) if len(first) else counts


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> shingle, n: the shingles that several sets of the task hold, with a lower bound of their number."""
    shingles, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        found = [shingles, *shingle_sets(*column_bytes(batch.column(0)))]
        counts = np.concatenate([counts, np.ones(sum(map(len, found[1:])), np.int64)])
        shingles, counts = _merged(np.concatenate(found), counts)
        if len(shingles) > COUNTED:
            shingles, counts = shingles[counts > 1], counts[counts > 1]
    again = counts > 1
    yield pa.RecordBatch.from_arrays([pa.array(shingles[again].view(np.int64)), pa.array(counts[again])], ["shingle", "n"])


def prefix(shingles: np.ndarray, frequent: np.ndarray, counts: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """The first shingles of a sorted set, from rare to frequent, of which two near duplicates share one. frequent ascends."""
    n = len(shingles)
    at = np.searchsorted(frequent, shingles)
    at[at == len(frequent)] = 0
    weight = np.where(frequent[at] == shingles, counts[at], 0) if len(frequent) else np.zeros(n, np.int64)
    return shingles[np.lexsort((shingles, weight))][: n - (threshold * n + 99) // 100 + 1]


def _prefixes(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [prefix(s, frequent, counts).view(np.int64) for s in shingle_sets(*column_bytes(batch.column(3)))]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "x", "component", "prefix"])


def runs(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """The rows of each value of a column, which is sorted; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        edges = [0, *cuts.tolist(), len(keys)]
        for a, b in zip(edges[:-1], edges[1:]):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


def _first_met(kind: str, mark: int, signatures: np.ndarray, prefixes: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows have in this bucket the first that they share: of bands, the lowest; of prefixes, the smallest shingle."""
    out = np.ones(len(a), bool)
    if kind == "bands" and mark:
        for i in range(0, len(a), 65_536):
            same = signatures[a[i : i + 65_536], : mark * ROWS] == signatures[b[i : i + 65_536], : mark * ROWS]
            out[i : i + 65_536] = ~same.reshape(len(same), mark, ROWS).all(2).any(1)
    elif kind == "prefixes":
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            out[i] = np.intersect1d(prefixes[x], prefixes[y], assume_unique=True)[:1] == [mark]
    return out


def _pruned(batches: Iterator[pa.RecordBatch], bounds: list[int], kind: str) -> Iterator[pa.RecordBatch]:
    """Rows (block, mark, side, doc_id, x, component, signature, prefix) sorted by block -> block, doc_id, x, component, partners.

    kind: in a star's block those of side 0 are its centre and meet the others. In a
    pair of blocks ("bands", "prefixes") side 0 meets side 1; a block that meets itself
    has side 0 alone. mark is the number of the band, or the shingle, that they share.
    """
    for group in runs(batches):
        side = group.column("side").to_numpy()
        doc = group.column("doc_id").to_numpy()
        component = group.column("component").to_numpy()
        signatures = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint16).reshape(len(doc), -1)
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1)
        own = kind != "stars" and not len(right)
        if own:
            right = left
        live = (doc[left][:, None] != doc[right][None, :]) if kind == "stars" else component[left][:, None] != component[right][None, :]
        if own:
            live &= np.triu(np.ones(live.shape, bool), 1)
        live = prune(signatures[left], signatures[right], live, bounds)
        a, b = np.nonzero(live)
        if kind != "stars" and len(a):
            prefixes = [np.frombuffer(x, np.int64) for x in group.column("prefix").to_pylist()] if kind == "prefixes" else []
            first = _first_met(kind, int(group.column("mark")[0].as_py()), signatures, prefixes, left[a], right[b])
            live[a[~first], b[~first]] = False
        partners = [doc[right[row]].tolist() for row in live]
        wanted = live.any(0)
        rows = [(int(left[i]), p) for i, p in enumerate(partners) if p]
        held = {i for i, _ in rows}
        rows += [(int(right[j]), []) for j in np.flatnonzero(wanted) if int(right[j]) not in held]
        at = pa.array([i for i, _ in rows], pa.int64())
        yield pa.RecordBatch.from_arrays([*(group.column(c).combine_chunks().take(at) if len(at) else group.column(c).combine_chunks().slice(0, 0) for c in ("block", "doc_id", "x", "component")), pa.array([p for _, p in rows], pa.list_(pa.int64()))], ["block", "doc_id", "x", "component", "partners"])


def linked(left: np.ndarray, right: np.ndarray, threshold: int = THRESHOLD) -> bool:
    """Whether 100 * intersection >= threshold * union, of sorted distinct arrays."""
    small, large = (left, right) if len(left) <= len(right) else (right, left)
    if not len(small) or 100 * len(small) < threshold * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= threshold * (len(small) + len(large) - both)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, doc_id, component, partners, text) sorted by block -> verified links a, b that join components."""
    for group in runs(batches):
        data, offsets = column_bytes(group.column("text"))
        sets: dict[int, list[np.ndarray]] = {}
        doc = group.column("doc_id").to_pylist()
        component = dict(zip(doc, group.column("component").to_pylist()))
        for d, s in zip(doc, shingle_sets(data, offsets)):
            sets.setdefault(d, []).append(s)  # an id may have several texts
        parent: dict = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        found = []
        for d, partners in zip(doc, group.column("partners").to_pylist()):
            for p in partners:
                a, b = find(component[d]), find(component[p])
                if a != b and any(linked(x, y) for x in sets[d] for y in sets[p]):
                    parent[max(a, b)] = min(a, b)
                    found.append((d, p))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def _links(blocks: DataFrame, signatures: DataFrame, texts: DataFrame, bounds: list[int], kind: str) -> DataFrame:
    """Verified links of blocks (block, mark, side, doc_id, component); signatures has prefixes if they are of that kind.

    The work on a row isn't in proportion to its bytes, so the number of tasks is given.
    """
    tasks = partitions(blocks.sparkSession)
    columns = ["block", "mark", "side", "doc_id", "x", "component", "signature", *(["prefix"] if kind == "prefixes" else [])]
    placed = blocks.join(signatures, "doc_id").select(*columns).repartition(tasks, "block").sortWithinPartitions("block", "side", "doc_id")
    survivors = cut(placed.mapInArrow(tidy(partial(_pruned, bounds=bounds, kind=kind)), "block long, doc_id long, x long, component long, partners array<long>"))
    ids = survivors.select("doc_id", "x").distinct()
    ids = F.broadcast(ids) if small_enough(survivors.select("doc_id", "x")) else ids
    own = texts.join(ids, ["doc_id", "x"], "left_semi")
    rows = survivors.join(own, ["doc_id", "x"]).select("block", "doc_id", "component", "partners", "text").repartition(tasks, "block").sortWithinPartitions("block", "doc_id")
    return cut(rows.mapInArrow(tidy(_verified), "a long, b long"))


def _several_components(rows: DataFrame, total: int) -> DataFrame:
    """rows (key, mark, doc_id, component) of the keys with several components, with the members of their key."""
    keys = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members")).filter("low <> high").select("key", "members")
    return cut(attach(rows, cut(keys), ["key"], "members", total, "inner"))


def _whole(placed: DataFrame) -> DataFrame:
    """Keys of BLOCK members at most as a block each (block, mark, side, doc_id, component)."""
    return placed.filter(F.col("members") <= BLOCK).select(F.xxhash64("key", F.lit(2)).alias("block"), "mark", F.lit(0).alias("side"), "doc_id", "component")


def _dealt(placed: DataFrame, total: int) -> DataFrame:
    """The other keys, dealt into blocks that meet in pairs, but for those of one component."""
    rows = placed.filter(F.col("members") > BLOCK)
    counts = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("key").agg(F.sum("n").alias("members"), F.max(F.struct("n", "component")).alias("l"))
    sizes = cut(sizes.select("key", "members", F.col("l.component").alias("major"), F.ceil(F.col("l.n") / DEALT).cast("int").alias("majors"), F.ceil((F.col("members") - F.col("l.n")) / DEALT).cast("int").alias("minors")))
    rows = attach(rows.drop("members"), sizes, ["key"], "members", total, "inner").withColumn("is_major", F.col("component") == F.col("major"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.when(F.col("is_major"), F.col("majors")).otherwise(F.col("minors"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_major = F.transform(upto("minors"), lambda j: F.struct(F.xxhash64("key", F.lit(1), "own", j).alias("block"), F.lit(0).alias("side")))
    with_majors = F.transform(upto("majors"), lambda i: F.struct(F.xxhash64("key", F.lit(1), i, "own").alias("block"), F.lit(1).alias("side")))
    with_minors = F.transform(upto("minors"), lambda j: F.struct(F.xxhash64("key", F.lit(0), F.least("own", j), F.greatest("own", j)).alias("block"), (F.col("own") > j).cast("int").alias("side")))
    blocks = F.when(F.col("is_major"), as_major).otherwise(F.concat(with_majors, with_minors))
    return rows.withColumn("b", F.explode(blocks)).select("b.block", "mark", "b.side", "doc_id", "component")


def _postings(members: DataFrame, texts: DataFrame) -> DataFrame:
    """members (doc_id, x, component) with their prefixes, as lists."""
    members = cut(members)
    members = F.broadcast(members) if small_enough(members) else members  # so that texts stay where they are
    own = cut(texts.join(members, ["doc_id", "x"]).select("doc_id", "x", "component", "text"))
    counted = own.select("text").mapInArrow(tidy(_frequent), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    found = counted.orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()  # bounded
    shingles, counts = (found.column(c).to_numpy().astype(np.int64) for c in ("shingle", "n"))
    ascending = np.argsort(shingles.view(np.uint64))
    order = partial(_prefixes, frequent=shingles.view(np.uint64)[ascending], counts=counts[ascending])
    return cut(own.mapInArrow(tidy(order), "doc_id long, x long, component long, prefix array<long>"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([np.sort(np.array(p, np.int64)).tobytes() for p in batch.column(2).to_pylist()], pa.binary())], ["doc_id", "x", "prefix"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, kept.

    Words are runs other than white space, A-Z lower-cased; a text of fewer than five
    words has one shingle, its whole sequence; a text without words, or null, has none
    and is linked with nothing. component_id is the smallest doc_id reachable by links.
    One row per row. Rows repeated with id and text are one document; an id with several
    texts has the links of each. Rows without id are linked with nothing and not kept.
    Empty input gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = documents(docs).withColumn("x", F.xxhash64("text"))
    sketch = cut(own.select("doc_id", "x", "text").mapInArrow(tidy(_sketch), "doc_id long, x long, n_shingles long, digest binary, bands array<long>, signature binary"))
    slim = sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "x", "n_shingles", "digest")
    total = slim.count()
    classes = slim.groupBy("digest").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("doc_id", "x")).alias("first")).select("digest", "members", F.col("first.doc_id").alias("node"), F.col("first.x").alias("node_x"))
    classes = cut(classes.filter("members > 1"))
    copies = cut(attach(slim.drop("n_shingles"), classes, ["digest"], "members", total, "inner").filter("doc_id <> node OR x <> node_x").select("doc_id", "x", "node"))
    gone = copies.select("doc_id", "x")
    reps = sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL").join(F.broadcast(gone) if small_enough(gone) else gone, ["doc_id", "x"], "left_anti")
    texts = own.select("doc_id", "x", "text").filter("doc_id IS NOT NULL")
    ids = cut(slim.groupBy("doc_id").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", (F.col("low") != F.col("high")).alias("several")))
    if ids.head(1):  # rows repeated with id and text are one document
        reps = cut(reps.dropDuplicates(["doc_id", "x"]))
        texts = texts.dropDuplicates(["doc_id", "x"])
    # an id with several texts ties the classes of all of them
    tied = cut(copies.join(ids.filter("several"), "doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    bounds = [least_matches(n) for n in range(BATCH, HASHES + 1, BATCH)]
    signatures = reps.select("doc_id", "x", "signature")

    bands = reps.select("doc_id", F.posexplode("bands").alias("mark", "key"))
    buckets = cut(bands.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("members")).filter("most > least"))
    rows = cut(attach(bands, buckets.drop("most"), ["key"], "members", total, "inner"))
    star = rows.filter("doc_id <> least").groupBy("doc_id", "least").agg(F.count(F.lit(1)).alias("shared")).groupBy("doc_id").agg(F.max(F.struct("shared", (-F.col("least")).alias("c"))).alias("best")).select("doc_id", (-F.col("best.c")).alias("centre"))
    star = cut(star)
    sizes = cut(star.groupBy("centre").agg(F.count(F.lit(1)).alias("n")))
    spread = attach(star, sizes, ["centre"], "n", total, "inner").select("doc_id", "centre", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / STAR)).cast("int").alias("part"))
    block = F.xxhash64("centre", "part")
    members = cut(spread.select(block.alias("block"), F.lit(0).alias("mark"), F.lit(1).alias("side"), "doc_id", F.col("doc_id").alias("component"), "centre", "part"))
    centres = members.select("block", "mark", F.lit(0).alias("side"), F.col("centre").alias("doc_id"), F.col("centre").alias("component")).distinct()
    links = _links(members.drop("centre", "part").unionByName(centres), signatures, texts, bounds, "stars")

    reached = cut(components(links))
    rows = rows.select("key", "mark", "doc_id").join(reached.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    rows = _several_components(cut(rows), total)
    links = links.unionByName(_links(_whole(rows), signatures, texts, bounds, "bands"))
    crowded = cut(rows.filter(F.col("members") > BLOCK).select("doc_id", "component").distinct())
    if crowded.head(1):
        crowded = F.broadcast(crowded) if small_enough(crowded) else crowded
        own_prefix = _postings(reps.select("doc_id", "x").join(crowded, "doc_id"), texts)
        shared = own_prefix.select("doc_id", "component", F.explode("prefix").alias("key")).withColumn("mark", F.col("key"))
        shared = _several_components(shared, total)
        packed = cut(own_prefix.select("doc_id", "x", "prefix").mapInArrow(tidy(_packed), "doc_id long, x long, prefix binary"))
        packed = F.broadcast(packed) if small_enough(packed) else packed
        links = links.unionByName(_links(_whole(shared).unionByName(_dealt(shared, total)), signatures.join(packed, ["doc_id", "x"]), texts, bounds, "prefixes"))

    reached = cut(components(links.unionByName(tied)))
    # a class is where its node is; nodes and components are joined once a class
    where = classes.join(reached, "node", "left").select("digest", "members", F.coalesce("component", "node").alias("component"))
    where = cut(where)
    placed = attach(slim, where, ["digest"], "members", total)
    alone = placed.filter("members IS NULL").select("doc_id", "n_shingles").join(reached.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    out = placed.filter("members IS NOT NULL").select("doc_id", "n_shingles", "component").unionByName(alone)
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    rest = sketch.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = out.unionByName(rest)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def kept_documents(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one document of each component; rows without words or id stay."""
    gone = cut(near_duplicates(docs).filter("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("gone_id")))
    return docs.join(F.broadcast(gone) if small_enough(gone) else gone, F.col("doc_id").cast("bigint") == F.col("gone_id"), "left_anti")


def op10_near_dedup(spark, sf_dir):
    """Every document's component of near duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents"))
