"""Packing along a space-filling curve: documents that are alike share sequences.

A document's tokens are counted into hashed buckets; fixed random directions project the counts to a few dimensions; the
cell of the projection gets its Hilbert key. Documents are range-sorted by (key, doc_id) and their ids laid end to end
along the curve, cut wherever a sequence is full, so only the last sequence of a partition is padded, and that one is cut
into sequences of powers of two, which need no padding. Tokenising runs once: its result is a table in the shared folder.

Sequence ids are unique, not dense: partition * 2**40 + place. Null text: the end id alone. Null doc_id: packed like any.
Repeated rows are packed once per row. The order is total up to equal rows, so a lost task gives the same pieces again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm._common import raw, ship, stored, tokenizer_path
from pagelake.llm.wordbpe import word_bpe

BUCKETS, DIMS, DEPTH = 256, 4, 12
LENGTH = 4096


def directions(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BUCKETS, DIMS))


def hilbert(cell: list[int], depth: int = DEPTH) -> int:
    """The place of a cell of a grid of 2**depth per side on the Hilbert curve (Skilling's transpose)."""
    x, n = list(cell), len(cell)
    q = 1 << (depth - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (depth - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    key = 0
    for b in range(depth - 1, -1, -1):
        for i in range(n):
            key = key << 1 | ((x[i] ^ t) >> b & 1)
    return key


def curve_key(ids: np.ndarray, basis: np.ndarray) -> int:
    """The Hilbert key of a document's ids: counts in hashed buckets, projected, squashed into the grid."""
    h = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
    v = np.bincount(h.astype(np.int64), minlength=BUCKETS).astype(float)
    v /= np.linalg.norm(v) or 1.0
    unit = 0.5 + 0.5 * np.tanh(v @ basis)
    return hilbert(np.minimum((unit * (1 << DEPTH)).astype(np.int64), (1 << DEPTH) - 1).tolist())


def tokenised(docs: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    """(doc_id, key, ids): ids as little-endian unsigned 16-bit integers."""
    ship(docs.sparkSession)
    path = path or tokenizer_path("word_bpe_49k.json")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, basis, end = word_bpe(path), directions(), np.array([end_id], dtype=np.uint16)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                c = b.slice(i, 500)
                ids = [np.concatenate([bpe.encode(t or b""), end]) for t in raw(c.column(1))]
                keys = pa.array([curve_key(x, basis) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([c.column(0), keys, pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "key", "ids"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, key long, ids binary")


def powers(rest: int) -> list[int]:
    """The powers of two that make up `rest`, largest first."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class Packer:
    """Lays documents end to end; gives back pieces (document, start, length, crc, tokens, sequence, offset).

    Only the pieces of the sequence that is still open are held; they are cut again once it is known to be the last.
    """

    def __init__(self, first: int, length: int = LENGTH):
        self.next, self.length, self.fill, self.open = first, length, 0, []

    def add(self, doc_id, ids: np.ndarray) -> list[tuple]:
        done, at = [], 0
        while at < len(ids):
            n = min(len(ids) - at, self.length - self.fill)
            self.open.append((doc_id, at, ids[at : at + n].astype("<u4"), len(ids)))
            self.fill, at = self.fill + n, at + n
            if self.fill == self.length:
                done += self._close([self.length])
        return done

    def finish(self) -> list[tuple]:
        return self._close(powers(self.fill)) if self.fill else []

    def _close(self, sizes: list[int]) -> list[tuple]:
        out, offset, sizes = [], 0, list(sizes)
        for doc_id, start, ids, total in self.open:
            while len(ids):
                n = min(len(ids), sizes[0] - offset)
                out.append((doc_id, start, n, zlib.crc32(ids[:n].tobytes()), total, self.next, offset))
                ids, start, offset = ids[n:], start + n, offset + n
                if offset == sizes[0]:
                    sizes.pop(0)
                    self.next, offset = self.next + 1, 0
        self.open, self.fill = [], 0
        return out


PIECE = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, path: str | None = None, end_id: int = 2, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    table = stored(tokenised(docs, path, end_id), "packing")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(TaskContext.get().partitionId() << 40, length)

        def rows(pieces, of):
            columns = list(zip(*pieces)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(columns[0], of), *[pa.array(c, pa.int64()) for c in columns[1:]]], ["doc_id", *PIECE])

        of = None
        for b in batches:
            of = b.schema.field(0).type
            done = []
            for doc_id, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                done += packer.add(doc_id, np.frombuffer(ids, dtype="<u2"))
            yield rows(done, of)
        if of is not None:
            yield rows(packer.finish(), of)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    along = table.repartitionByRange(n, "key", "doc_id").sortWithinPartitions("key", "doc_id", "ids")
    return along.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in PIECE))
