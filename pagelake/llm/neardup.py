"""SimHash near-duplicates at a Jaccard similarity of 0.8 or more, over sets of five-word shingles.

Equal texts are one class, named by the MD5 of the text; a class has a SimHash fingerprint of 1024 bits of its set. Two
sets of a similarity of 0.8 differ in 155 of them on average (deviation 11.5), a share at which the blocks of bits that
shard small radii (`simhash.py`) hold some 6 bits each and shard nothing. A shard here is a value of a band of five least
hashes, of which each class has 32: two sets of exactly 0.8 share no shard with odds of (1 - 0.8**5)**32, about 3 in a
million. Within a shard, pairs beyond `RADIUS` differing bits are left out (4.6 deviations for 0.8, more above; a wider
radius for sets so small that their bits are coarse); the others are verified by the exact Jaccard of the two sets (of
64-bit hashes of shingles; two sets of 20,000 collide with odds of about 1 in 10**11).

Every class of a shard first meets the shard's least class: a native aggregation and a join that AQE can split where a
shard is hot, so a crowd of near copies costs one pair each. What no verified link has joined by then is searched with
one BK-tree of fingerprints for each shard, whose children are keyed by their Hamming distance, for pairs of different
components within the radius. A shard of more than `hot` such classes is cut into blocks instead, every two of which meet
unless the sizes of their sets or their roots leave no pair: the same pairs, whatever `hot` is, at a cost that grows with
the square of what such a shard holds.

Words are parted by ASCII white space, and ASCII letters are folded to lower case. Fewer words than a shingle: the whole
sequence is the one shingle. Null, empty and blank texts are alike. Only doc_id and text are read: other columns may have
any name. An empty table has no classes. A long text is hashed in slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm._common import lean, passing, ship, stored
from pagelake.llm.components import components
from pagelake.llm.simhash import POPULAR, BkTree

SHINGLE, BANDS, ROWS = 5, 32, 5
#: Longs of a fingerprint; the radius, and that of pairs with a set of fewer than SMALL shingles; pairs that one task compares with one class.
LONGS, RADIUS, WIDE, SMALL, TOGETHER = 16, 208, 256, 8, 1024
#: The least Jaccard similarity, as a fraction of integers.
OVER, UNDER = 4, 5
_R = np.random.default_rng(42)
MASKS = _R.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)
ODD = _R.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPREAD = _R.integers(0, 1 << 63, (1, LONGS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WEIGHTS = _R.integers(0, 1 << 63, (1, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def text_key() -> Column:
    """The name of the class of equal texts that a row is in."""
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The set of the hashes of a text's shingles, in order."""
    import xxhash

    words = text.lower().split()  # bytes: lower() and split() know ASCII only
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], dtype=np.uint64)
    c = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(words) - size + 1
    h = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        h = (h ^ c[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ h >> np.uint64(32))


def bands(h: np.ndarray) -> np.ndarray:
    """The hash of each band of the MinHash signature of a set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(h), 2048):  # in slices: a long text needs no more memory
        x = (h[i : i + 2048] ^ MASKS) * ODD
        np.minimum(least, (x ^ x >> np.uint64(32)).min(axis=1), out=least)
    mixed = (least.reshape(BANDS, ROWS) * WEIGHTS).sum(axis=1, dtype=np.uint64)
    return (mixed ^ mixed >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) + np.arange(BANDS, dtype=np.uint64)


def fingerprint(h: np.ndarray) -> bytes:
    """The SimHash of a set: each of 1024 bits is that of over half the hashes."""
    ones = np.zeros(64 * LONGS, dtype=np.int64)
    for i in range(0, len(h), 255):  # as many as a byte counts
        x = h[i : i + 255, None] * SPREAD
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h)).tobytes()


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets is the least one or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return UNDER * both >= OVER * (len(a) + len(b) - both)


def _each(column: pa.Array) -> Iterator[bytes]:
    """The values of a binary or string column, one at a time."""
    for x in column.cast(pa.large_binary()):
        yield x.as_buffer().to_pybytes()


def banded(docs: DataFrame) -> DataFrame:
    """(key, n, fp, bands) of every row: n is the size of its set."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            n, fp, found = [], [], [np.empty(0, np.uint64)]
            for h in map(shingles, _each(b.column(1))):
                n.append(len(h))
                fp.append(fingerprint(h))
                found.append(bands(h))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(found).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(fp, pa.binary()), lists], ["key", "n", "fp", "bands"])

    return docs.select(text_key().alias("key"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(make, "key binary, n int, fp binary, bands array<long>")


def sets_of(named: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, h): the sets of the named classes, written to the shared folder: texts are shuffled once for all that is verified."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            for k in range(0, b.num_rows, 64):
                c = b.slice(k, 64)
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array([shingles(t).tobytes() for t in _each(c.column(1))], pa.binary())], ["key", "h"])

    texts = docs.select(text_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    texts = passing(texts, "key", named)[0].join(named, "key", "left_semi")
    return stored(texts.dropDuplicates(["key"]).mapInArrow(sets, "key binary, h binary"), "neardup-sets")


def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are alike. The set of a goes before those of its partners; a class with many
    partners is compared in several tasks, and a task holds one set and streams the others past it."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = None
        lean()
        for b in batches:
            ok = []
            for partner, h in zip(b.column(2), _each(b.column(3))):
                h = np.frombuffer(h, dtype=np.uint64)
                if not partner.is_valid:
                    mine = h
                ok.append(partner.is_valid and alike(mine, h))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    parts = F.ceil(F.count("*") / TOGETHER).cast("int")
    many = pairs.groupBy("a").agg(parts.alias("parts"))
    one = many.join(held, many["a"] == held["key"]).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("binary").alias("b"), "h")
    two = pairs.join(many, "a").join(held, pairs["b"] == held["key"]).select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b", "h")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = one.unionByName(two).repartition(n, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return stored(met.mapInArrow(compare, "a binary, b binary"), "neardup-links")


def _apart(x: Column, y: Column) -> Column:
    """The number of differing bits of two fingerprints."""
    longs = lambda c: [F.conv(F.hex(F.substring(c, 1 + 8 * k, 8)), 16, -10).cast("long") for k in range(LONGS)]
    return sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(longs(x), longs(y))), F.lit(0))


def _close(m: str, n: str) -> Column:
    """Whether sets of these sizes can be alike at all."""
    return F.least(m, n) * UNDER >= F.greatest(m, n) * OVER


def _emitted(found: Iterator[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    """Pairs as batches of bounded size."""
    while out := list(islice(found, 1 << 16)):
        a, b = zip(*out)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def tree_pairs(apart: DataFrame, hot: int) -> DataFrame:
    """Pairs (a, b), a < b, of classes of one shard but different roots, within the radius, whatever `hot` is: a BK-tree
    for each shard, blocks that meet for one of more than `hot` classes."""

    def searched(rows: Iterator[tuple]) -> Iterator[tuple[bytes, bytes]]:
        shard, tree, at = None, BkTree(), {}
        for s, key, n, fp, root in rows:
            if s != shard:
                shard, tree, at = s, BkTree(), {}
            fp = int.from_bytes(fp)
            for y in tree.within(fp, WIDE if n < 2 * SMALL else RADIUS):
                d = (y ^ fp).bit_count()
                yield from ((o, key) for o, m, r in at[y] if r != root and UNDER * min(m, n) >= OVER * max(m, n) and (d <= RADIUS or min(m, n) < SMALL))
            if fp in at:
                at[fp].append((key, n, root))
            else:
                at[fp] = [(key, n, root)]
                tree.insert(fp)

    sizes = stored(apart.groupBy("band").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("band"), "neardup-hot")
    small = apart.join(sizes, "band", "left_anti").select("band", "key", "n", "fp", "root")
    n = int(apart.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = small.repartition(n, "band").sortWithinPartitions("band", "key")
    trees = sorted_.mapInArrow(lambda batches: _emitted(searched(_rows(batches))), "a binary, b binary")
    return trees.unionByName(block_pairs(apart.join(sizes, "band"), hot)).distinct()


def block_pairs(large: DataFrame, size: int) -> DataFrame:
    """The pairs of `tree_pairs` in hot shards. A shard's classes are cut by the size of their sets, where only neighbours
    can be alike, by whether they have the shard's most frequent root, whose classes needn't meet each other, and by key
    into blocks of about `size`. Every two blocks that can hold a pair meet in a cell, so none is lost; a task holds one
    block and streams the other past it."""

    def searched(rows: Iterator[tuple]) -> Iterator[tuple[bytes, bytes]]:
        cell, held, block = None, [], None
        for band, lo, hi, side, n, key, fp, root in rows:
            if (band, lo, hi) != cell:
                cell, held, block = (band, lo, hi), [], None
            if side == 0:
                held.append((key, n, fp, root))
                continue
            if block is None:
                keys, ns, fps, roots = zip(*held) if held else ((),) * 4
                block = keys, np.array(ns, np.int64), np.frombuffer(b"".join(fps), np.uint64).reshape(-1, LONGS), np.frombuffer(b"".join(roots), np.uint64).reshape(-1, 2)
                held = []
            keys, ns, fps, roots = block
            first = np.searchsorted(ns, -(-n * OVER // UNDER))
            last = np.searchsorted(ns, n if lo == hi else n * UNDER // OVER, "right")  # of a block with itself, the larger set looks for the smaller
            for i in range(first, last, 2048):  # in slices that stay in the cache
                k = slice(i, min(i + 2048, last))
                d = np.bitwise_count(fps[k] ^ np.frombuffer(fp, np.uint64)).sum(axis=1, dtype=np.uint16)
                ok = (d <= np.where(np.minimum(ns[k], n) < SMALL, WIDE, RADIUS)) & (roots[k] != np.frombuffer(root, np.uint64)).any(axis=1)
                yield from ((min(keys[j], key), max(keys[j], key)) for j in (i + np.flatnonzero(ok)).tolist())

    crowd = large.groupBy("band", "root").agg(F.count("*").alias("c")).groupBy("band").agg(F.max(F.struct("c", "root"))["root"].alias("most"))
    # steps of over a fourth: sets that can be alike are at most one apart; then one bit for the crowd
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.26))) * 2 + (F.col("root") == F.col("most")).cast("long")
    rows = large.join(crowd, "band").withColumn("kind", step).drop("most")
    parts = rows.groupBy("band", "kind").agg(F.ceil(F.count("*") / size).alias("parts"))
    ours = F.pmod(F.xxhash64("key"), F.col("parts"))
    rows = rows.join(parts, ["band", "kind"]).withColumn("mine", F.shiftleft("kind", 32) + ours).drop("parts")
    other = parts.select("band", F.col("kind").alias("other"), "parts")
    near = (F.abs(F.shiftright("kind", 1) - F.shiftright("other", 1)) <= 1) & (F.col("kind").bitwiseAND(F.col("other")).bitwiseAND(1) == 0)
    cells = rows.join(other, "band").where(near).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cells = cells.withColumn("theirs", F.shiftleft("other", 32) + F.col("part"))
    sides = F.when(F.col("mine") == F.col("theirs"), F.array(F.lit(0), F.lit(1))).otherwise(F.array((F.col("mine") > F.col("theirs")).cast("int")))
    cells = cells.select("band", F.least("mine", "theirs").alias("lo"), F.greatest("mine", "theirs").alias("hi"), F.explode(sides).alias("side"), "n", "key", "fp", "root")
    parts = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = cells.repartition(parts, "band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "side", "n", "key")
    return sorted_.mapInArrow(lambda batches: _emitted(searched(_rows(batches))), "a binary, b binary")


def near_classes(docs: DataFrame, hot: int = POPULAR) -> DataFrame:
    """(key, root) of the classes with a link: root is the least class that can be reached."""
    ship(docs.sparkSession)
    rows = banded(docs).dropDuplicates(["key"])
    rows = stored(rows, "neardup-prints").select("key", "n", "fp", F.explode("bands").alias("band"))
    shared = stored(rows.groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select("band"), "neardup-shared")
    few = passing(rows, "band", shared)[0].join(shared, "band")
    least = few.groupBy("band").agg(F.min(F.struct("key", "n", "fp")).alias("m"))
    met = stored(few.join(least, "band").select("band", "key", "n", "fp", "m"), "neardup-bands")
    held = sets_of(met.select("key").distinct(), docs)

    # texts and bands that meet no other never leave their partition
    within = _apart(F.col("fp"), F.col("m.fp")) <= F.when(F.least("n", "m.n") < SMALL, WIDE).otherwise(RADIUS)
    starred = met.where("key <> m.key").where(_close("m.n", "n")).where(within)
    first = stored(starred.select(F.col("m.key").alias("a"), F.col("key").alias("b")).distinct(), "neardup-pairs")
    edges = verified(first, held)
    roots = components(edges)

    at = met.select("band", "key", "n", "fp").join(roots, met["key"] == roots["node"], "left").select("band", "key", "n", "fp", F.coalesce("root", "key").alias("root"))
    several = at.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    apart = stored(at.join(several, "band", "left_semi"), "neardup-apart")
    rest = stored(tree_pairs(apart, hot).join(first, ["a", "b"], "left_anti"), "neardup-rest")
    found = edges.unionByName(verified(rest, held))
    return components(found).select(F.col("node").alias("key"), "root")
