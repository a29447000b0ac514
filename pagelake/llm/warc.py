"""WARC archives with revisits, and a capture index made by an external merge.

A writer task puts one gzip member per record into an archive of its own. An indexer reads each archive back, checks every
record against its digest, and writes runs of bounded size, each sorted by URL key and timestamp. The runs are then
merged: while there are more than `FAN`, groups of them are merged into one each; then the key space is cut into ranges,
also within the captures of one popular URL, and the merger of a range takes the slice of every run that falls into it
through a k-way loser tree. So the ranges in order are the globally ordered capture histories. A merger reads its slices
as streams and holds one batch of each.

Files carry names of their attempt, and the manifests that Spark commits name those that count, so a task that is retried
or runs twice can't pair one attempt's archive with another's offsets; files of lost attempts stay in the shared folder.

Pages with equal payloads of at least `least` bytes: the one of the largest page_id is the response, the others are
revisits that refer to it and carry headers only. Null html: an empty payload. Null url: an empty target. Rows that
repeat a page_id are records of their own; among equal payloads those of the largest page_id are all responses. A null
page_id is kept and never referred to. A very long payload is held whole, one at a time. Only page_id, url and html are
read: other columns may have any name. An empty table has no archives and an empty index.
"""

from __future__ import annotations

import base64
import gzip
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha1
from itertools import islice
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm._common import passing, raw, scratch, ship, stored

LEAST = 1000
#: Captures of a run; runs that are merged at once.
RUN, FAN = 20_000, 64
EPOCH = 1_577_836_800  # 2020-01-01: a page's capture time is its id in seconds after this
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str) -> str:
    """The sort-friendly form of a URL: host labels reversed, then the path and query, lower-cased."""
    try:
        p = urlsplit(url.strip().lower())
        host = ",".join(reversed((p.hostname or "").removeprefix("www.").split(".")))
    except ValueError:
        return url
    return f"{host}){p.path or '/'}" + f"?{p.query}" * bool(p.query)


def timestamp(page_id: int | None) -> str:
    from datetime import datetime, timezone

    return datetime.fromtimestamp((EPOCH + (page_id or 0) % 1_000_000_000), timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(page_id: int | None) -> str:
    """A URN that holds the page_id in its last 64 bits; null has a bit of its own."""
    n = (1 << 64 if page_id is None else 0) | (page_id or 0) % (1 << 64)
    return f"<urn:uuid:{uuid.UUID(int=n)}>"


def page_of(record: str) -> int | None:
    n = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    low = n % (1 << 64)
    return None if n >> 64 else low - (1 << 64) if low >> 63 else low


def record(page_id, url: str, payload: bytes, digest: bytes, refers: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {timestamp(page_id)}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
    ]
    if refers is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(file, chunk: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, size, plain bytes) of each gzip member of a file; a member is one record, and one is held at a time."""
    at, data = 0, b""
    while data or (data := file.read(chunk)):
        unzip, plain, size = zlib.decompressobj(31), [], 0
        while not unzip.eof:
            if not data and not (data := file.read(chunk)):
                raise ValueError("the archive ends within a record")
            plain.append(unzip.decompress(data))
            size += len(data) - len(unzip.unused_data)
            data = unzip.unused_data
        yield at, size, b"".join(plain)
        at += size


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and the block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    pairs = (line.partition(":") for line in head.decode().split("\r\n")[1:])
    headers = {name.strip().lower(): value.strip() for name, _, value in pairs}
    return headers, rest[: int(headers["content-length"])]


class LoserTree:
    """Merges k sorted iterators: a tournament whose inner nodes keep the losers, so a step costs log2(k) comparisons."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.k = len(runs)
        self.head = [next(r, None) for r in runs]
        self.tree = [-1] * max(self.k, 1)
        for i in range(self.k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        if a < 0 or b < 0:  # an empty place wins while the tree is built
            return a < 0
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, i: int) -> None:
        winner, node = i, (i + self.k) // 2
        while node > 0:
            if self._less(self.tree[node], winner):
                winner, self.tree[node] = self.tree[node], winner
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while self.k and self.head[self.tree[0]] is not None:
            i = self.tree[0]
            yield self.head[i]
            self.head[i] = next(self.runs[i], None)
            self._play(i)


def planned(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, and refers_to for revisits. Digests alone are grouped, pre-aggregated before they move; of the
    html, only that of pages whose payload may be met again is shuffled."""
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    slim = p.where(F.octet_length("html") >= least).select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("d"), F.octet_length("html").alias("n"))
    many = slim.groupBy("d", "n").agg(F.max("page_id").alias("last"), F.count("*").alias("c")).where("c > 1 and last is not null").select("d", "n", "last")
    refers = slim.join(many, ["d", "n"]).where("page_id <> last").groupBy("page_id", "d").agg(F.max("last").alias("refers_to"))
    p = p.withColumn("d", F.when(F.octet_length("html") >= least, F.sha1(F.encode("html", "UTF-8"))).otherwise(""))
    met, alone = passing(p, "d", refers.select("d"))
    alone = alone.select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"))
    return met.join(refers, ["page_id", "d"], "left").select("page_id", "url", "html", "refers_to").unionByName(alone)


def write_archives(pages: DataFrame, to: str, least: int = LEAST) -> DataFrame:
    """Writes archives under `to`; returns (archive, n)."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(to)
        name, out, n = f"{root}/{uuid.uuid4().hex}.warc.gz", None, 0
        for b in batches:
            for page_id, url, html, refers in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw(b.column(2)), b.column(3).to_pylist()):
                if out is None:
                    fs.create_dir(root)
                    out = fs.open_output_stream(name, compression=None)
                url = " ".join(url.split())
                out.write(gzip.compress(record(page_id, url, html, sha1(html).digest(), refers), 6, mtime=0))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["archive", "n"])

    return planned(pages, least).mapInArrow(run, "archive string, n long")


CAPTURE = pa.schema(
    [
        ("url_key", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("size", pa.int64()),
    ]
)
INDEX = "url_key string, ts string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, size long"


def order(row: tuple) -> tuple:
    """The place of a capture: URL key, timestamp, page_id with null last, then where it is."""
    return row[0], row[1], row[2] is None, row[2] or 0, row[8], row[9]


def captures(fs, name: str) -> Iterator[tuple]:
    """The captures of an archive, each checked against its digest."""
    with fs.open_input_stream(name, compression=None) as f:
        for at, length, data in members(f):
            h, block = parsed(data)
            head, _, payload = block.partition(b"\r\n\r\n")
            size = int(head.decode().lower().partition("content-length:")[2].split("\r\n")[0])
            digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
            if h["warc-type"] == "response" and (len(payload) != size or sha1(payload).hexdigest() != digest):
                raise ValueError(f"damaged record {h['warc-record-id']}")
            refers = page_of(h["warc-refers-to"]) if "warc-refers-to" in h else None
            url = h["warc-target-uri"]
            yield url_key(url), h["warc-date"], page_of(h["warc-record-id"]), url, size, digest, h["warc-type"], refers, name, at, length


def _write(fs, root: str, rows: Iterator[tuple]) -> str:
    """A run of rows in order, in row groups of bounded size."""
    import pyarrow.parquet as pq

    name, held = f"{root}/{uuid.uuid4().hex}.run.parquet", []
    with pq.ParquetWriter(fs.open_output_stream(name), CAPTURE) as w:
        put = lambda: w.write_table(pa.table([pa.array(c, f.type) for c, f in zip(zip(*held), CAPTURE)], schema=CAPTURE))
        for row in rows:
            held.append(row)
            if len(held) == 5000:
                put()
                held = []
        if held:
            put()
    return name


def _read(fs, name: str, lo: tuple | None = None, hi: tuple | None = None) -> Iterator[tuple[tuple, tuple]]:
    """(order, capture) of a run's rows from lo to below hi."""
    import pyarrow.parquet as pq

    with fs.open_input_file(name) as f:
        p = pq.ParquetFile(f)
        for g in range(p.num_row_groups):
            s = p.metadata.row_group(g).column(0).statistics
            if s is not None and s.has_min_max and (lo is not None and s.max < lo[0] or hi is not None and s.min > hi[0]):
                continue
            for b in p.iter_batches(batch_size=500, row_groups=[g]):
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    k = order(row)
                    if (lo is None or k >= lo) and (hi is None or k < hi):
                        yield k, row


def sorted_runs(manifest: DataFrame, to: str, size: int = RUN) -> DataFrame:
    """(run, n): reads the archives back into runs of at most `size` captures, each in order."""
    ship(manifest.sparkSession)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(to)
        for b in batches:
            for name in b.column(0).to_pylist():
                found = captures(fs, name)
                while held := list(islice(found, size)):
                    run = _write(fs, root, sorted(held, key=order))
                    yield pa.RecordBatch.from_arrays([pa.array([run]), pa.array([len(held)], pa.int64())], ["run", "n"])

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(manifest.select("archive").repartition(parts, "archive").mapInArrow(index, "run string, n long"), "warc-runs")


def fewer_runs(runs: DataFrame, to: str, fan: int) -> DataFrame:
    """(run, n): groups of `fan` runs merged into one each."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(to)
        for b in batches:
            for names, n in zip(*(c.to_pylist() for c in b.columns)):
                run = _write(fs, root, (row for _, row in LoserTree([_read(fs, x) for x in names])))
                yield pa.RecordBatch.from_arrays([pa.array([run]), pa.array([n], pa.int64())], ["run", "n"])

    spark = runs.sparkSession
    names = [(r.run, r.n) for r in runs.sort("run").collect()]  # one name per run of many captures
    groups = [names[k : k + fan] for k in range(0, len(names), fan)]
    rows = spark.createDataFrame([([r for r, _ in g], sum(n for _, n in g)) for g in groups], "runs array<string>, n long")
    return stored(rows.repartition(len(groups), "n").mapInArrow(merge, "run string, n long"), "warc-runs")


def merged_index(runs: DataFrame, to: str, ranges: int, fan: int = FAN) -> DataFrame:
    """(range, place) and the captures of all runs in global order; `ranges` key ranges merge side by side."""
    spark = runs.sparkSession
    ship(spark)
    while runs.count() > fan:
        runs = fewer_runs(runs, to, fan)
    names = [r.run for r in runs.select("run").collect()]  # at most `fan`
    cuts = _cuts(spark.read.parquet(*names), ranges) if names else []
    kind = "struct<k:string,ts:string,no:boolean,page:long,archive:string,at:long>"
    bounds = spark.createDataFrame([(k, lo, hi) for k, (lo, hi) in enumerate(zip([None, *cuts], [*cuts, None]))], f"part long, lo {kind}, hi {kind}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(to)
        bound = lambda x: None if x is None else tuple(x.values())
        for b in batches:
            for part, lo, hi in zip(*(c.to_pylist() for c in b.columns)):
                held, place = [], 0
                for _, row in LoserTree([_read(fs, n, bound(lo), bound(hi)) for n in names]):
                    held.append((part, place, *row))
                    place += 1
                    if len(held) == 5000:
                        yield rows(held)
                        held = []
                yield rows(held)

    schema = pa.schema([("part", pa.int64()), ("place", pa.int64()), *CAPTURE])

    def rows(held):
        columns = list(zip(*held)) or [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)

    return bounds.repartition(max(1, ranges), "part").mapInArrow(run, f"part long, place long, {INDEX}")


def _cuts(rows: DataFrame, ranges: int) -> list[tuple]:
    """Places that cut the captures into ranges, from a sample that is bounded by their number; any cuts give right results."""
    n = rows.count()
    sample = rows.select("url_key", "ts", "page_id", "archive", "offset").sample(min(1.0, 100 * ranges / max(n, 1)), seed=7).limit(400 * ranges).collect()
    found = sorted((r.url_key, r.ts, r.page_id is None, r.page_id or 0, r.archive, r.offset) for r in sample)
    return sorted({found[len(found) * k // ranges] for k in range(1, ranges)}) if found else []


def archived(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """The capture index of the pages, merged from archives that were written and read back."""
    spark = pages.sparkSession
    to = scratch(spark, "warc")
    manifest = stored(write_archives(pages, to, least), "warc-manifest")
    return merged_index(sorted_runs(manifest, to), to, int(spark.conf.get("spark.sql.shuffle.partitions")))
