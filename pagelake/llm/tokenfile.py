"""Token-id files: independent zstandard frames, a trailing seek table, a checksum per frame.

A file holds the ids of consecutive documents as little-endian unsigned 32-bit integers. A frame holds whole documents
(or one part of a document longer than a frame) and is compressed on its own. After the frames come the entries of the
seek table (compressed and plain size, CRC-32 of the plain bytes, first document), the documents' entries (doc_id and
ids), and a footer of fixed size that says where they begin, all in a skippable frame: to any zstandard tool the file is
the ids. A reader loads the tables, then only the frames it needs; a document is found by bisection.

Documents are range-sorted by doc_id, so file k holds smaller ids than file k + 1; a document's start is the ids of the
files before (one number per file) plus its place in the file. Null text: only the end id. Null doc_id: such documents
come first and their start counts too. Rows that repeat a doc_id stay, ordered by text. A file is written under a name
of its own attempt and renamed, so a lost task leaves nothing half-written behind.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm._common import raw, scratch, ship, tokenizer_path
from pagelake.llm.wordbpe import word_bpe

FRAME = 1 << 16  # ids
FOOTER = struct.Struct("<QQQI8s")
SKIPPED = struct.Struct("<II")  # the magic number of a skippable frame, and its size
MAGIC = b"PLTOKEN1"
SEEK = np.dtype([("at", "<u8"), ("size", "<u4"), ("plain", "<u4"), ("crc", "<u4"), ("first", "<u8")])
DOCS = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("start", "<u8"), ("n", "<u8")])


class Writer:
    """Writes one file; memory is one frame and the tables."""

    def __init__(self, out, frame: int = FRAME):
        import zstandard

        self.out, self.frame, self.zip = out, frame, zstandard.ZstdCompressor(level=3)
        self.at, self.ids = 0, 0
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.seek, self.docs = [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is not None, self.ids, len(ids)))
        for i in range(0, len(ids), self.frame):
            part = ids[i : i + self.frame]
            if self.n_held + len(part) > self.frame:
                self.flush()
            self.held.append(part)
            self.n_held += len(part)
            self.ids += len(part)

    def flush(self) -> None:
        if not self.n_held:
            return
        plain = np.concatenate(self.held).astype("<u4").tobytes()
        data = self.zip.compress(plain)
        self.out.write(data)
        self.seek.append((self.at, len(data), len(plain), zlib.crc32(plain), self.ids - self.n_held))
        self.at += len(data)
        self.held, self.n_held = [], 0

    def close(self) -> int:
        self.flush()
        tables = np.array(self.seek, dtype=SEEK).tobytes() + np.array(self.docs, dtype=DOCS).tobytes()
        self.out.write(SKIPPED.pack(0x184D2A5E, len(tables) + FOOTER.size))
        self.out.write(tables)
        self.out.write(FOOTER.pack(self.at + SKIPPED.size, len(self.seek), len(self.docs), zlib.crc32(tables), MAGIC))
        self.out.close()
        return self.ids


class Reader:
    """Opens a file by its tables; reads the frames of the documents that are asked for."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - FOOTER.size)
        at, frames, docs, crc, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        file.seek(at)
        tables = file.read(size - FOOTER.size - at)
        if zlib.crc32(tables) != crc:
            raise ValueError("the tables are damaged")
        cut = frames * SEEK.itemsize
        self.frames = np.frombuffer(tables[:cut], dtype=SEEK)
        self.docs = np.frombuffer(tables[cut:], dtype=DOCS)
        self.last = (-1, None)

    def frame(self, k: int) -> np.ndarray:
        import zstandard

        if self.last[0] != k:
            e = self.frames[k]
            self.file.seek(int(e["at"]))
            plain = zstandard.ZstdDecompressor().decompress(self.file.read(int(e["size"])), max_output_size=int(e["plain"]))
            if zlib.crc32(plain) != e["crc"]:
                raise ValueError(f"frame {k} is damaged")
            self.last = (k, np.frombuffer(plain, dtype="<u4"))
        return self.last[1]

    def parts(self, d: int) -> Iterator[np.ndarray]:
        """The ids of the document in place d, frame by frame."""
        at, n = int(self.docs[d]["start"]), int(self.docs[d]["n"])
        k = int(np.searchsorted(self.frames["first"], at, side="right")) - 1
        while n:
            ids = self.frame(k)[at - int(self.frames[k]["first"]) :][:n]
            yield ids
            at, n, k = at + len(ids), n - len(ids), k + 1

    def find(self, doc_id: int) -> list[int]:
        """Places of a document; the file has unknown ids first, then the others in ascending order."""
        first = int(np.searchsorted(self.docs["known"], 1))
        ids = self.docs["doc_id"][first:]
        lo, hi = np.searchsorted(ids, doc_id, side="left"), np.searchsorted(ids, doc_id, side="right")
        return list(range(first + int(lo), first + int(hi)))


def write_tokens(docs: DataFrame, to: str, path: str | None = None, end_id: int = 2, frame: int = FRAME) -> DataFrame:
    """Writes documents in ascending doc_id order under `to`; returns the manifest (file, part, n_docs, n_ids)."""
    spark = docs.sparkSession
    ship(spark)
    path = path or tokenizer_path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, part, writer, n = word_bpe(path), TaskContext.get().partitionId(), None, 0
        fs, root = pafs.FileSystem.from_uri(to)
        draft = f"{root}/.{part}-{uuid.uuid4().hex}"
        end = np.array([end_id], dtype=np.uint16)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), raw(b.column(1))):
                if writer is None:
                    fs.create_dir(root)
                    writer = Writer(fs.open_output_stream(draft), frame)
                writer.add(doc_id, np.concatenate([bpe.encode(text or b""), end]))
                n += 1
        if writer is not None:
            ids = writer.close()
            name = f"{root}/part-{part:06d}.tokens"
            fs.move(draft, name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part]), pa.array([n]), pa.array([ids])], ["file", "part", "n_docs", "n_ids"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # no hash of the text rides along: ties of doc_id are ordered by the text itself
    placed = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return placed.mapInArrow(run, "file string, part long, n_docs long, n_ids long")


def read_tokens(manifest: DataFrame, to: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read from the files of a manifest; start counts the ids of all documents before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(to)
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with fs.open_input_file(name) as f:
                    r = Reader(f)
                    for i in range(0, len(r.docs), 10_000):
                        d = r.docs[i : i + 10_000]
                        crcs = []
                        for k in range(i, i + len(d)):
                            crc = 0
                            for ids in r.parts(k):
                                crc = zlib.crc32(ids.tobytes(), crc)
                            crcs.append(crc)
                        ids = pa.array(d["doc_id"].tolist(), pa.int64(), mask=d["known"] == 0) if len(d) else pa.array([], pa.int64())
                        yield pa.RecordBatch.from_arrays(
                            [ids, pa.array(d["start"].astype(np.int64) + base), pa.array(d["n"].astype(np.int64)), pa.array(crcs, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    # one row per file: the running sum over files is as small as their list
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.withColumn("base", F.coalesce(before, F.lit(0))).select("file", "base")
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str | None = None, end_id: int = 2, frame: int = FRAME) -> DataFrame:
    """Documents written as token files in the shared folder and read back."""
    spark = docs.sparkSession
    to = scratch(spark, "tokens")
    manifest = scratch(spark, "manifest")
    write_tokens(docs, to, path, end_id, frame).write.parquet(manifest)
    return read_tokens(spark.read.schema("file string, part long, n_docs long, n_ids long").parquet(manifest), to)
