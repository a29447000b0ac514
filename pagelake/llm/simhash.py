"""SimHash near-duplicates: 64-bit fingerprints, linked at a few differing bits through sharded BK-trees.

Only distinct fingerprints are compared. The bits are cut into `radius + 2` blocks; two fingerprints within the radius
agree on at least two whole blocks, so each pair of blocks and its value is a shard, and every link lies in some shard.
A shard is searched by a BK-tree: the children of a node are keyed by their integer Hamming distance to it, and a query
follows only the edges within the radius. A shard with more than `hot` fingerprints is first cut again by the blocks of
its remaining bits, which loses no link. Trees meet their queries in one shuffle rather than by broadcast, since the
size of all trees has no bound. A shard yields at most one edge per fingerprint (a spanning forest), never all pairs.

Null, empty or blank text: fingerprint zero, linked like any other. Fewer words than a shingle: the whole sequence is
the one shingle. Repeated rows share a fingerprint and stay rows. A null doc_id keeps its row; it never names a
component unless no other document is in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm._common import raw, ship, stored
from pagelake.llm.components import components

BITS = 64
POPULAR = 20_000


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a UTF-8 text, as an unsigned integer."""
    import xxhash

    words = text.lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), seed)
    line = b" ".join(words)
    at, starts = 0, []
    for w in words:
        starts.append(at)
        at += len(w) + 1
    starts.append(at)
    h = np.fromiter((digest(line[i : j - 1], seed) for i, j in zip(starts, starts[shingle:])), dtype=np.uint64, count=len(words) - shingle + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):  # in slices: a long text needs no more memory
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp holds the bits of the unsigned fingerprint as a signed long."""
    ship(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t or b"", shingle) for t in raw(b.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(make, f"doc_id {kind}, fp long")


class BkTree:
    """Integers under Hamming distance; the children of a node are keyed by their distance to it."""

    def __init__(self):
        self.root = None

    def insert(self, x: int) -> None:
        if self.root is None:
            self.root = (x, {})
            return
        node = self.root
        while True:
            d = (node[0] ^ x).bit_count()
            if d == 0:
                return
            child = node[1].get(d)
            if child is None:
                node[1][d] = (x, {})
                return
            node = child

    def within(self, x: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            y, children = todo.pop()
            d = (y ^ x).bit_count()
            if d <= radius:
                found.append(y)
            if children:
                if len(children) <= 2 * radius:
                    todo += [c for k, c in children.items() if d - radius <= k <= d + radius]
                else:
                    todo += [children[k] for k in range(d - radius, d + radius + 1) if k in children]
        return found


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges that join the values linked within the radius, directly or through others of them: a spanning forest."""
    if len(values) == 2:
        return [(values[0], values[1])] if (values[0] ^ values[1]).bit_count() <= radius else []
    tree, parent, edges = BkTree(), {}, []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x in values:
        if x in parent:
            continue
        parent[x] = x
        for y in tree.within(x, radius):
            a, b = find(x), find(y)
            if a != b:
                parent[a] = b
                edges.append((x, y))
        tree.insert(x)
    return edges


def _cuts(width: int, parts: int) -> list[tuple[int, int]]:
    """(shift, width) of `parts` nearly equal blocks."""
    edges = [width * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _block(fp, cut):
    return F.shiftrightunsigned(fp, cut[0]).bitwiseAND(F.lit((1 << cut[1]) - 1))


def shards(fps: DataFrame, radius: int = 3, hot: int = POPULAR) -> DataFrame:
    """(key, fp): fingerprints within the radius share at least one key."""
    cuts = _cuts(BITS, radius + 2)
    pairs = [(i, j) for i in range(len(cuts)) for j in range(i)]
    fp = F.col("fp")
    keys = F.array(*[F.struct(F.lit(n).alias("n"), F.shiftleft(_block(fp, cuts[i]), cuts[j][1]).bitwiseOR(_block(fp, cuts[j])).alias("v")) for n, (i, j) in enumerate(pairs)])
    first = fps.select("fp", F.explode(keys).alias("k")).select("fp", F.xxhash64("k.n", "k.v").alias("key"))
    big = first.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("key", F.lit(True).alias("big"))
    marked = first.join(big, "key", "left")
    # within a hot shard, the bits are cut anew into radius + 1 blocks: one of them is equal as well
    fine = _cuts(BITS, radius + 1)
    again = F.array(*[F.xxhash64("key", F.lit(n), _block(fp, cut)) for n, cut in enumerate(fine)])
    return marked.select("fp", F.explode(F.when(F.col("big"), again).otherwise(F.array("key"))).alias("key"))


def links(fps: DataFrame, radius: int = 3, hot: int = POPULAR) -> DataFrame:
    """Edges (a, b) that connect every two distinct fingerprints within the radius, as a forest per shard."""
    spark = fps.sparkSession
    ship(spark)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_v = np.empty(0, np.int64), np.empty(0, np.int64)

        def edges(keys, values):
            out = []
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            ends = np.r_[starts[1:], len(keys)]
            for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
                out += forest(values[s:e].view(np.uint64).tolist(), radius)
            pairs = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            k = np.r_[held_k, batch.column(0).to_numpy()]
            v = np.r_[held_v, batch.column(1).to_numpy()]
            last = int(np.searchsorted(k, k[-1]))  # the last key may go on in the next batch
            if last:
                yield edges(k[:last], v[:last])
            held_k, held_v = k[last:], v[last:]
        if len(held_k):
            yield edges(held_k, held_v)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = shards(fps, radius, hot).repartition(n, "key").sortWithinPartitions("key", "fp")
    return keyed.select("key", "fp").mapInArrow(search, "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 3, hot: int = POPULAR) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that can be reached over links."""
    prints = stored(fingerprints(docs, shingle), "simhash")
    fps = prints.groupBy("fp").agg(F.min("doc_id").alias("m"))
    roots = components(links(fps.select("fp"), radius, hot))
    named = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "m", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("m").alias("component_id"))
    classes = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")
