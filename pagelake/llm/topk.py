"""Exact top-k by inner product over norm buckets.

Vectors are range-sorted by length, longest first, into a table in the shared folder; a bucket is a run of that table. A
task holds one block of queries and streams the buckets past it, keeping k results per query. For each bucket and query
the local cosine threshold t = kth score / (|q| * longest of the bucket) says what to do: above 1 nothing in this or any
later bucket can enter; otherwise the bucket is pruned by length (its vectors of at least kth score / |q|, which come
first) or by coordinates (the feasible range of the query's strongest coordinates). Which of the two is learned on the
way: for each tenth of t, coordinates are tried on `TRIES` queries and go on being used while they leave under half. What
is left is verified by exact products: in doubles below 2**52, in 64-bit integers below 2**62, in Python's integers
beyond. Every comparison leaves room for rounding and keeps ties, so pruning loses nothing.

Vectors that are null or hold a null or non-finite component take no part, nor do rows with a null vec_id. Every finite
vector takes part, however long; scores are ranked exactly, and one beyond 64 bits is returned as the nearest 64-bit
integer. Vectors are compared with those of their own dimension, empty ones with one another at score 0. Rows that share
the query's vec_id are its own. Fewer candidates than k: all of them. Repeated rows count each. Only vec_id and embedding
are read: other columns may have any name. An empty table has no result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm._common import scratch, ship

BUCKET, BLOCK = 4096, 1024
#: Queries that are cut by length together; queries on which coordinates are tried in each tenth of t.
GROUP, TRIES = 64, 8
DOUBLES, LONGS, MOST = 2.0**52, 2.0**62, 2**63 - 1


def prepared(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, dim, norm, v): v holds the components as little-endian doubles, norm is the length of the integers."""
    e, times = F.col("embedding").cast("array<double>"), F.lit(float(scale))
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = lambda x: F.when(F.abs(x * times) < 2.0**53, F.floor(x * times).cast("double")).otherwise(x * times)
    norm = F.sqrt(F.aggregate(F.transform(e, whole), F.lit(0.0), lambda a, x: a + x * x))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(3)
            data, at = x.values.to_numpy(zero_copy_only=False).astype("<f8"), x.offsets.to_numpy()
            v = pa.array([data[i:j].tobytes() for i, j in zip(at, at[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], v], ["vec_id", "dim", "norm", "v"])

    ship(vectors.sparkSession)
    return vectors.where(ok).select("vec_id", F.size(e).alias("dim"), norm.alias("norm"), e.alias("x")).mapInArrow(pack, "vec_id long, dim int, norm double, v binary")


class Vectors:
    """Integer vectors: as doubles, which hold each component exactly or overflow, and as Python's integers on demand."""

    def __init__(self, ids: np.ndarray, norms: np.ndarray, column, dim: int, scale: int = 256):
        self.ids, self.norms, self.scale = ids, norms, scale
        self.raw = np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(len(ids), dim)
        with np.errstate(over="ignore"):
            self.v = np.floor(self.raw * float(scale))

    def exact(self, i: int, j: int) -> np.ndarray:
        return np.array([[floor(Fraction(x) * self.scale) for x in row] for row in self.raw[i:j].tolist()], dtype=object).reshape(j - i, self.raw.shape[1])


def products(q: Vectors, i: int, b: Vectors, places: np.ndarray) -> np.ndarray:
    """The exact products of query i and the bucket's vectors at the places, which ascend: lengths descend."""
    with np.errstate(invalid="ignore"):
        bound = np.nan_to_num(q.norms[i] * b.norms[places], nan=np.inf)
    huge, wide = int((bound >= LONGS).sum()), int((bound >= DOUBLES).sum())
    parts = [(b.v[places[wide:]] @ q.v[i]).astype(np.int64)]
    if wide > huge:
        parts.insert(0, b.v[places[huge:wide]].astype(np.int64) @ q.v[i].astype(np.int64))
    if huge:
        mine = q.exact(i, i + 1)[0]
        parts.insert(0, np.array([sum(map(int.__mul__, b.exact(p, p + 1)[0], mine)) for p in places[:huge].tolist()], dtype=object))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


class Block:
    """The best k of a block of queries so far. pruned counts the products that each way of pruning saved."""

    def __init__(self, queries: Vectors, k: int):
        self.q, self.k = queries, k
        self.best: list[list[tuple[int, int]]] = [[] for _ in queries.ids]
        self.kth = np.full(len(queries.ids), -np.inf)
        self.tried, self.left, self.pruned = Counter(), Counter(), Counter()

    def offer(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        other = ids != self.q.ids[i]
        scores, ids = scores[other], ids[other]
        if len(scores) > self.k:
            if scores.dtype == object:
                least = sorted(scores)[-self.k]
            else:
                least = np.partition(scores, -self.k)[-self.k]
            keep = scores >= least
            scores, ids = scores[keep], ids[keep]
        if len(self.best[i]) == self.k:
            keep = scores >= -self.best[i][-1][0]
            scores, ids = scores[keep], ids[keep]
        if len(scores):
            self.best[i] = sorted(self.best[i] + [(-s, v) for s, v in zip(scores.tolist(), ids.tolist())])[: self.k]
            if len(self.best[i]) == self.k:
                s = -self.best[i][-1][0]
                self.kth[i] = s if abs(s) < 1 << 1000 else np.inf if s > 0 else -np.inf

    def bucket(self, b: Vectors) -> bool:
        """Meets a bucket, longest first. False: no later bucket can matter."""
        slack, n, longest = 1 + 1e-9, len(b.ids), b.norms[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            most = np.nan_to_num(self.q.norms * longest, nan=0.0, posinf=np.inf)  # inf * 0: every score is 0
            t = np.nan_to_num(self.kth / most, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            live = np.flatnonzero(~(self.kth > most * slack + 1e-6))
            least = np.nan_to_num(self.kth / self.q.norms, nan=-np.inf, posinf=np.inf, neginf=-np.inf) / slack - 1e-6
        self.pruned["stop"] += (len(self.kth) - len(live)) * n
        if not len(live):
            return False
        ends = np.searchsorted(-b.norms, -least[live], side="right")  # only vectors of at least kth / |q| can enter
        self.pruned["length"] += int((n - ends).sum())
        order = np.argsort(ends, kind="stable")
        dense = []
        for i, end in zip(live[order].tolist(), ends[order].tolist()):
            at = self._coordinates(i, t[i] / slack, b, end)
            if at is None:
                dense.append((i, end))
            else:
                self.offer(i, products(self.q, i, b, at), b.ids[at])
        for k in range(0, len(dense), GROUP):
            group = dense[k : k + GROUP]
            end = group[-1][1]
            if not end:
                continue
            who = np.array([i for i, _ in group])
            if self.q.norms[who].max() * longest < DOUBLES:
                scores = (self.q.v[who] @ b.v[:end].T).astype(np.int64)
                for i, row in zip(who.tolist(), scores):
                    self.offer(i, row, b.ids[:end])
            else:
                for i in who.tolist():
                    self.offer(i, products(self.q, i, b, np.arange(end)), b.ids[:end])
        return True

    def _coordinates(self, i: int, t: float, b: Vectors, end: int) -> np.ndarray | None:
        """Places whose unit vectors lie in the feasible ranges of the query's three strongest coordinates; None where
        coordinates don't pay."""
        tenth = int(10 * min(t, 1)) if t > 0 else 0
        if tenth < 1 or not end or not np.isfinite(b.norms[0]) or not 0 < self.q.norms[i] < np.inf:
            return None
        if self.tried[tenth] >= TRIES and 2 * self.left[tenth] > self.pruned[f"met {tenth}"]:
            return None
        unit = self.q.v[i] / self.q.norms[i]
        at = np.arange(end)
        for f in np.argsort(-np.abs(unit))[:3]:
            x = b.v[at, f] / np.maximum(b.norms[at], 1e-300)
            half = np.sqrt(max(0.0, (1 - t * t) * (1 - unit[f] ** 2))) + 1e-6
            lo, hi = unit[f] * t - half, unit[f] * t + half
            # a cosine above t widens the range up to the query's own coordinate
            at = at[(x >= min(lo, unit[f] - half)) & (x <= max(hi, unit[f] + half))]
        self.tried[tenth] += 1
        self.left[tenth] += len(at)
        self.pruned[f"met {tenth}"] += end
        self.pruned["coordinates"] += end - len(at)
        return at


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each row whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    sets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    to = scratch(spark, "topk")
    prepared(vectors, scale).repartitionByRange(sets, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id").write.parquet(to)
    table = spark.read.schema("vec_id long, dim int, norm double, v binary").parquet(to)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        fs, root = pafs.FileSystem.from_uri(to)
        files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".parquet"))
        for b in batches:
            for start in range(0, b.num_rows, block):
                c = b.slice(start, block)
                dims = c.column(1).to_numpy()
                for dim in np.unique(dims):
                    mine = c.filter(pa.array(dims == dim))
                    held = Block(Vectors(mine.column(0).to_numpy(), mine.column(3).to_numpy(), mine.column(2), int(dim), scale), k)
                    _stream(fs, files, pq, held, int(dim))
                    rows = [(q, r + 1, v, max(-MOST - 1, min(MOST, -s))) for q, best in zip(held.q.ids.tolist(), held.best) for r, (s, v) in enumerate(best)]
                    q, r, v, s = zip(*rows) if rows else ([], [], [], [])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q, pa.int64()), pa.array(r, pa.int32()), pa.array(v, pa.int64()), pa.array(s, pa.int64())], ["query_id", "rank", "vec_id", "score"]
                    )

    def _stream(fs, files, pq, held, dim) -> None:
        for name in files:
            with fs.open_input_file(name) as f:
                for b in pq.ParquetFile(f).iter_batches(batch_size=bucket):
                    b = b.filter(pa.array(b.column(1).to_numpy() == dim))
                    if b.num_rows and not held.bucket(Vectors(b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(3), dim, scale)):
                        return

    queries = table.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "dim", "v", "norm").repartition(sets)
    return queries.mapInArrow(search, "query_id long, rank int, vec_id long, score long")
