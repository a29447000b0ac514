"""Structured Streaming: incremental extraction, stateful de-duplication, windows, and replays of pacing and breakers."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.session import scratch


def source(spark: SparkSession, path: str, like: DataFrame | None = None, per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files that arrive under a path; timestamps without zone become UTC instants."""
    schema = (like or spark.read.parquet(path)).schema
    reader = spark.readStream.schema(schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    # one file is read as the folder it is in, by name
    folder, _, name = path.rstrip("/").rpartition("/")
    df = reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and not _is_folder(spark, path) else reader.parquet(path)
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.simpleString() == "timestamp_ntz"})


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now, into a table in the shared folder beside its checkpoint."""
    to = scratch(df.sparkSession, "drained")
    w = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{to}-checkpoint")
    if mode == "append":
        q = w.format("parquet").start(to)
    else:  # each batch is the whole result so far
        q = w.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(to)).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(to)


def each_batch(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """A fan-out sink: `write` gets each micro-batch. The checkpoint makes a restart go on where it stopped."""
    w = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def deduplicated(df: DataFrame, keys: list[str], ts: str, delay: str = "1 day") -> DataFrame:
    return df.withWatermark(ts, delay).dropDuplicates(keys)


def tumbling(df: DataFrame, ts: str, size: str, *by: str) -> DataFrame:
    return df.groupBy(F.window(ts, size).alias("w"), *by)


#: Rows that a host's replay holds at a time, and what stands for a missing event_id or status in an array of integers
SLICE, NONE = 1 << 17, -(2**63)


def _rows(part: pd.DataFrame) -> np.ndarray:
    """at, event_id and status of some rows, sorted: three numbers a row, whatever the columns."""
    found = np.empty(len(part), [("at", "f8"), ("event", "i8"), ("status", "i8")])
    found["at"] = part["at"].to_numpy("f8", na_value=np.nan)
    for name, column in (("event", "event_id"), ("status", "status")):
        found[name] = part[column].fillna(NONE).astype("int64")
    return _sorted(found)


def _sorted(rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort((rows["status"], rows["event"], rows["at"]))]


def _upto(rows: np.ndarray, last) -> int:
    """How many of the sorted rows aren't after this one."""
    lo, hi = 0, len(rows)
    for name in ("at", "event", "status"):
        part = rows[name][lo:hi]
        lo, hi = lo + int(np.searchsorted(part, last[name], "left")), lo + int(np.searchsorted(part, last[name], "right"))
    return hi


def _merged(file, runs: list[tuple[int, int]], size: int) -> Iterator[np.ndarray]:
    """Sorted runs of a file, each (first row, rows), as slices in order. A piece of each is held; what isn't after the
    least of their ends is complete, so one piece at least is used up each time."""
    kind = np.dtype([("at", "f8"), ("event", "i8"), ("status", "i8")])
    piece = max(1024, size // len(runs))
    ways = [[start, start + n, np.empty(0, kind)] for start, n in runs]
    while ways:
        for w in ways:
            if not len(w[2]) and w[0] < w[1]:
                n = min(piece, w[1] - w[0])
                file.seek(w[0] * kind.itemsize)
                w[0], w[2] = w[0] + n, np.frombuffer(file.read(n * kind.itemsize), kind)
        ends = [w[2][-1:] for w in ways if w[0] < w[1]]
        last = _sorted(np.concatenate(ends))[0] if ends else None
        cuts = [len(w[2]) if last is None else _upto(w[2], last) for w in ways]
        yield _sorted(np.concatenate([w[2][:n] for w, n in zip(ways, cuts)]))
        for w, n in zip(ways, cuts):
            w[2] = w[2][n:]
        ways = [w for w in ways if len(w[2]) or w[0] < w[1]]


def _in_order(rows: Iterator[pd.DataFrame], size: int | None = None) -> Iterator[list[tuple]]:
    """Slices of (at, event_id, status) of a host's rows of a batch, in order. Beyond `size` rows they are sorted in runs
    of a file in Spark's local folder and merged, so memory doesn't grow with the host."""
    size = size or SLICE
    with tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) as file:
        runs, held, n, at = [], [], 0, 0
        for part in rows:
            held.append(_rows(part))
            n += len(part)
            if n >= size:
                _sorted(np.concatenate(held)).tofile(file)
                runs.append((at, n))
                held, n, at = [], 0, at + n
        if runs and n:
            _sorted(np.concatenate(held)).tofile(file)
            runs.append((at, n))
        slices = _merged(file, runs, size) if runs else [_sorted(np.concatenate(held))] if n else []
        for found in slices:
            for k in range(0, len(found), 1 << 14):  # as Python's numbers, few at a time
                part = found[k : k + (1 << 14)].tolist()
                yield part if found["event"][k : k + (1 << 14)].min() > NONE else [(a, None if e == NONE else e, s) for a, e, s in part]


def paced(df: DataFrame, rate: float, burst: float = 1.0) -> DataFrame:
    """When a token bucket per host lets each request through: rows (host, event_id, at in seconds) with scheduled_at.

    State per host is two numbers; a batch's rows of a host are taken in order of time. 429 and 503 halve the rate,
    down to a twentieth, and ten good answers in a row raise it by a tenth.
    """

    def run(key, rows, state):
        tokens, last, share, good = state.get if state.exists else (burst, 0.0, 1.0, 0)
        for part in _in_order(rows):
            out = []
            for at, event, status in part:
                now = max(at, last)
                tokens = min(burst, tokens + (now - last) * rate * share)
                if tokens < 1:
                    now += (1 - tokens) / (rate * share)
                    tokens = 1.0
                tokens, last = tokens - 1, now
                if status in (429, 503, 509):
                    share, good = max(0.05, share / 2), 0
                elif (good := good + 1) >= 10:
                    share, good = min(1.0, share * 1.1), 0
                out.append((key[0], event, now))
            yield pd.DataFrame(out, columns=["host", "event_id", "scheduled_at"])
        state.update((float(tokens), float(last), float(share), int(good)))

    return df.groupBy("host").applyInPandasWithState(run, "host string, event_id long, scheduled_at double", "tokens double, last double, share double, good int", "append", "NoTimeout")


def breaker(df: DataFrame, streak: int = 5, window: int = 20, least: int = 10, rate: float = 0.5, cooldown: float = 30.0, most: float = 900.0) -> DataFrame:
    """A circuit breaker per host over (host, event_id, at, status): state before each request and whether it may go.

    It opens after a streak of failures or at a failure rate over the last outcomes; the cooldown doubles with each
    opening; half-open admits every request, a success closes it, a failure opens it again.
    """

    def run(key, rows, state):
        mode, fails, opened, trips, recent = state.get if state.exists else ("closed", 0, 0.0, 0, "")
        for part in _in_order(rows):
            out = []
            for at, event, status in part:
                if mode == "open" and at >= opened + min(most, cooldown * 2 ** (trips - 1)):
                    mode = "half-open"
                allowed = mode != "open"
                out.append((key[0], event, mode, allowed))
                if not allowed:
                    continue
                bad = status >= 400
                fails = fails + 1 if bad else 0
                recent = (recent + ("x" if bad else "."))[-window:]
                if bad and (mode == "half-open" or fails >= streak or len(recent) >= least and recent.count("x") / len(recent) >= rate):
                    mode, opened, trips, recent = "open", float(at), trips + 1, ""
                elif not bad and mode == "half-open":
                    mode, trips = "closed", 0
            yield pd.DataFrame(out, columns=["host", "event_id", "state", "allowed"])
        state.update((mode, int(fails), float(opened), int(trips), recent))

    return df.groupBy("host").applyInPandasWithState(run, "host string, event_id long, state string, allowed boolean", "mode string, fails int, opened double, trips int, recent string", "append", "NoTimeout")
