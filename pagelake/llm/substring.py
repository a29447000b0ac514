"""Substring de-duplication: FM-indexes per shard, searched backwards for windows of words seen in an earlier document.

1. Equal texts are one class; its smallest doc_id stands for it, the others lose every word that a window covers.
2. A window of `width` words is filed under its minimizer, the least hash of the short word runs within it. Equal windows
   have equal minimizers, so a minimizer that only one class has needs no search. Consecutive windows of one minimizer
   form a segment.
3. Segments of the other minimizers are shuffled by minimizer. A shard is a bounded number of words of whole minimizers;
   its distinct segments go into a compressed FM-index (the Burrows-Wheeler transform in a wavelet matrix, and every
   eighth place of the suffix array), and the segments are searched backwards against it, all at once: from each word
   leftwards, as long as the match has a second occurrence. Where these matching statistics reach `width`, the interval's
   occurrences are located and the smallest doc_id among them is reported; intervals of neighbours are joined.
4. A minimizer that more than `hot` classes have is not held: its windows go one by one to the shard of their own hash,
   sorted, where the first row of equal windows is the smallest doc_id and the others stream past it.

Null or blank text: no words. Fewer words than a window: nothing is removed. Rows that repeat a doc_id aren't smaller than
each other. A null doc_id counts as larger than any other. Any window width works. An empty table gives an empty result, a
very long text is cut into segments of bounded length, and columns other than doc_id and text may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm._common import raw, ship

WIDTH, GRAM = 13, 4
SHARD, HOT, LONGEST = 400_000, 50_000, 256
TOP = (1 << 63) - 1


def minima(words: list[bytes], width: int = WIDTH, gram: int = GRAM) -> np.ndarray:
    """The minimizer of each window of a text."""
    c = np.fromiter(map(crc32, words), dtype=np.uint64, count=len(words))
    n = len(words) - gram + 1
    with np.errstate(over="ignore"):
        g = np.zeros(n, dtype=np.uint64)
        for k in range(gram):
            g = (g ^ c[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            g ^= g >> np.uint64(29)
        g *= np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(32)
    out = g[: n - (width - gram)].copy()
    for k in range(1, width - gram + 1):
        np.minimum(out, g[k : k + len(out)], out=out)
    return out.view(np.int64)


def runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of the runs of equal minimizers, none longer than LONGEST."""
    cut = np.flatnonzero(h[1:] != h[:-1]) + 1
    starts, ends = np.r_[0, cut], np.r_[cut, len(h)]
    if len(h) > LONGEST and (ends - starts).max() > LONGEST:
        starts = np.concatenate([np.arange(s, e, LONGEST) for s, e in zip(starts, ends)])
        ends = np.r_[starts[1:], len(h)]
    return starts, ends


class WaveletMatrix:
    """Ranks of symbols in a sequence: one packed bit vector per bit of a symbol, with counts every 64 bits."""

    def __init__(self, x: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.levels = []
        n = len(x)
        for level in range(self.bits - 1, -1, -1):
            bit = (x >> level & 1).astype(bool)
            words = np.packbits(np.r_[bit, np.zeros(-n % 64 + 64, bool)], bitorder="little").view(np.uint64)
            counts = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)][:-1]
            self.levels.append((level, words, counts, int(n - bit.sum())))
            x = np.concatenate([x[~bit], x[bit]])
        self.first = self._map(np.arange(symbols), np.zeros(symbols, np.int64))

    def _map(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, words, counts, zeros in self.levels:
            at = i >> 6
            ones = counts[at] + np.bitwise_count(words[at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where(c >> level & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before i."""
        return self._map(c, i) - self.first[c]

    def symbol(self, i: np.ndarray) -> np.ndarray:
        """The symbols at i."""
        c = np.zeros(len(i), np.int64)
        for level, words, counts, zeros in self.levels:
            at, b = i >> 6, (i & 63).astype(np.uint64)
            bit = (words[at] >> b & np.uint64(1)).astype(np.int64)
            ones = counts[at] + np.bitwise_count(words[at] & ((np.uint64(1) << b) - np.uint64(1)))
            c |= bit << level
            i = np.where(bit, zeros + ones, i - ones)
        return c


class FmIndex:
    """A compressed index of integer symbols, each segment of which ends in the separator 0: the Burrows-Wheeler transform
    in a wavelet matrix, and a sample of the suffix array. Suffixes are sorted to the end of their segment."""

    def __init__(self, text: np.ndarray, symbols: int, every: int = 8):
        n, ends = len(text), text == 0
        r = text.astype(np.int64)
        r[ends] = np.arange(ends.sum())  # separators differ, so no comparison passes one
        r[~ends] += ends.sum()
        step = 1
        while True:  # ranks of the first 2, 4, 8, ... symbols
            key = r * (int(r.max()) + 2) + np.r_[r[step:] + 1, np.zeros(min(step, n), np.int64)]
            r = np.unique(key, return_inverse=True)[1]
            if int(r.max()) + 1 == n:
                break
            step *= 2
        places = np.empty(n, np.int64)
        places[r] = np.arange(n)
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=symbols))]
        last = text[places - 1].astype(np.int64)
        self.bwt = WaveletMatrix(last, symbols)
        kept = (places % every == 0) | (last == 0)  # a walk back stops at the start of a segment at the latest
        self.kept, self.upto = kept, np.cumsum(kept, dtype=np.int32)
        self.sample = places[kept].astype(np.int32)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places in the text of suffixes: walks back to the nearest one that is in the sample."""
        out, live, walked = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(live):
            hit = self.kept[rows]
            out[live[hit]] = self.sample[self.upto[rows[hit]] - 1] + walked
            live, rows, walked = live[~hit], rows[~hit], walked + 1
            if len(live):
                c = self.bwt.symbol(rows)
                rows = self.before[c] + self.bwt.rank(c, rows)
        return out

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of cP from those of P."""
        both = self.before[np.r_[c, c]] + self.bwt.rank(np.r_[c, c], np.r_[lo, hi])
        return both[: len(c)], both[len(c) :]


def least_owner(segments: list[bytes], owner: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """For the windows of all segments in order, the smallest owner of an occurrence; and where each segment's begin."""
    ids: dict[bytes, int] = {}
    parts, sizes = [], []
    for s in segments:
        w = s.split(b" ")
        parts += [ids.setdefault(x, len(ids) + 1) for x in w]
        parts.append(0)
        sizes.append(len(w))
    text, sizes = np.array(parts, dtype=np.int64), np.array(sizes)
    begin = np.r_[0, np.cumsum(sizes + 1)][:-1]
    count = sizes - width + 1
    first = np.r_[0, np.cumsum(count)]
    at = np.repeat(begin - first[:-1], count) + np.arange(first[-1])
    least = np.repeat(owner, count)
    index = FmIndex(text, len(ids) + 1)
    live = np.arange(len(at))
    c = text[at + width - 1]
    lo, hi = index.before[c], index.before[c + 1]
    for j in range(width - 2, -1, -1):
        on = hi - lo > 1
        live, lo, hi = live[on], lo[on], hi[on]
        if not len(live):
            return least, first
        lo, hi = index.step(text[at[live] + j], lo, hi)
    on = hi - lo > 1
    live, lo, hi = live[on], lo[on], hi[on]
    if len(live):
        # equal windows have one interval, different ones have none in common
        lo, one, back = np.unique(lo, return_index=True, return_inverse=True)
        n = hi[one] - lo
        ends = np.cumsum(n)
        rows = np.arange(ends[-1]) + np.repeat(lo - (ends - n), n)
        of = np.repeat(owner, sizes + 1)[index.locate(rows)]
        least[live] = np.minimum.reduceat(of, ends - n)[back]
    return least, first


def covered(flags: np.ndarray, row: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the words that runs of flagged windows cover; windows are by row, then place."""
    k = np.flatnonzero(flags)
    if not len(k):
        return k, k, k
    r, a = row[k], at[k]
    new = np.r_[True, (r[1:] != r[:-1]) | (a[1:] != a[:-1] + 1)]
    s = np.flatnonzero(new)
    e = np.r_[s[1:], len(k)] - 1
    return r[s], a[s], a[e] + width


#: a word and the white space that follows it
PIECE = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def _classes(docs: DataFrame, parts: int, keep=()) -> DataFrame:
    """doc, text, th, least: rows shuffled once by the hash of the text; least is the smallest doc of equal texts."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(TOP)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"), *keep)
    placed = rows.withColumn("th", F.xxhash64("text")).repartition(parts, "th")
    w = Window.partitionBy("th", "text").orderBy("doc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.withColumn("least", F.first("doc").over(w)).withColumn("n", F.count("*").over(w))


def _shared(classes: DataFrame, parts: int, width: int, hot: int) -> DataFrame:
    """(th, h, hot): the minimizers of a class that another class has too."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            th, hs = [], []
            for t, text in zip(b.column(0).to_pylist(), raw(b.column(1))):
                w = text.split()
                if len(w) >= width:
                    h = np.unique(minima(w, width))
                    hs.append(h)
                    th.append(np.full(len(h), t, dtype=np.int64))
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), pa.array(np.concatenate(th))], ["h", "th"])

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of at most `hot` rows are held; of a longer one the rows pass through as they come."""
        hk, tk, crowded = np.empty(0, np.int64), np.empty(0, np.int64), None

        def out(h, t, flag):
            return pa.RecordBatch.from_arrays([pa.array(t), pa.array(h), pa.array(np.full(len(h), flag) if np.isscalar(flag) else flag)], ["th", "h", "hot"])

        for b in batches:
            h, t = b.column(0).to_numpy(), b.column(1).to_numpy()
            if crowded is not None:
                k = int(np.searchsorted(h, crowded, side="right"))
                if k:
                    yield out(h[:k], t[:k], True)
                h, t = h[k:], t[k:]
                if len(h):
                    crowded = None
            h, t = np.r_[hk, h], np.r_[tk, t]
            if not len(h):
                continue
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            size = np.diff(np.r_[starts, len(h)])
            n = int(starts[-1])
            whole = size[:-1]
            keep = np.repeat(whole > 1, whole)
            if keep.any():
                yield out(h[:n][keep], t[:n][keep], np.repeat(whole > hot, whole)[keep])
            hk, tk = h[n:], t[n:]
            if len(hk) > hot:
                yield out(hk, tk, True)
                crowded = int(hk[0])
                hk, tk = hk[:0], tk[:0]
        if len(hk) > 1:
            yield out(hk, tk, len(hk) > hot)

    mins = classes.where("n = 1").select("th", "text").mapInArrow(emit, "h long, th long")
    # a hash that two texts share makes rows that are equal: they count as two classes
    return mins.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(grouped, "th long, h long, hot boolean")


def _segments(classes: DataFrame, shared: DataFrame, width: int) -> DataFrame:
    """(key, hot, seg, doc, th, pos): segments of shared minimizers, and single windows of crowded ones."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                b = batch.slice(start, 500)
                keys, hots, segs, docs, ths, poss = [], [], [], [], [], []
                for th, doc, text, hs, cs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw(b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist()):
                    w = text.split()
                    if len(w) < width:
                        continue
                    h = minima(w, width)
                    s, e = runs(h)
                    mine = np.array(hs, dtype=np.int64)
                    on = np.flatnonzero(np.isin(h[s], mine))
                    crowd = {x for x, c in zip(hs, cs) if c}
                    for key, i, j in zip(h[s[on]].tolist(), s[on].tolist(), e[on].tolist()):
                        if key in crowd:
                            for p in range(i, j):
                                seg = b" ".join(w[p : p + width])
                                keys.append(xxh64_intdigest(seg) - (1 << 63))
                                hots.append(True)
                                segs.append(seg)
                                poss.append(p)
                            n = j - i
                        else:
                            keys.append(key)
                            hots.append(False)
                            segs.append(b" ".join(w[i : j + width - 1]))
                            poss.append(i)
                            n = 1
                        docs += [doc] * n
                        ths += [th] * n
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, pa.int64()), pa.array(hots), pa.array(segs, pa.binary()), pa.array(docs, pa.int64()), pa.array(ths, pa.int64()), pa.array(poss, pa.int64())],
                        ["key", "hot", "seg", "doc", "th", "pos"],
                    )

    lists = shared.groupBy("th").agg(F.collect_list("h").alias("hs"), F.collect_list("hot").alias("cs"))
    rows = classes.where("n = 1").select("th", "doc", "text").join(lists, "th").select("th", "doc", "text", "hs", "cs")
    return rows.mapInArrow(emit, "key long, hot boolean, seg binary, doc long, th long, pos long")


def _intervals(segments: DataFrame, parts: int, width: int, shard: int) -> DataFrame:
    """(th, doc, s, e): words [s, e) of the class's text that a window of a smaller doc covers."""

    def out(th, doc, s, e):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (th, doc, s, e)], ["th", "doc", "s", "e"])

    def search(keys, segs, docs, ths, poss):
        entry, of, owner, texts = {}, np.empty(len(segs), np.int64), [], []
        for k, pair in enumerate(zip(keys, segs)):
            i = entry.get(pair)
            if i is None:
                i = entry[pair] = len(texts)
                texts.append(pair[1])
                owner.append(docs[k])
            elif docs[k] < owner[i]:
                owner[i] = docs[k]
            of[k] = i
        least, first = least_owner(texts, np.array(owner, dtype=np.int64), width)
        n = (first[1:] - first[:-1])[of]
        row = np.repeat(np.arange(len(of)), n)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        doc, pos = np.array(docs, dtype=np.int64), np.array(poss, dtype=np.int64)
        r, s, e = covered(least[first[of][row] + inside] < doc[row], row, inside, width)
        return out(np.array(ths, dtype=np.int64)[r], doc[r], pos[r] + s, pos[r] + e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[], [], [], [], []]
        words, last, window = 0, None, (None, None)
        for b in batches:
            found = [[], [], [], []]
            for key, hot, seg, doc, th, pos in zip(*(c.to_pylist() for c in b.columns)):
                if hot:  # sorted by window, then doc: the first is the smallest
                    if window[0] != seg:
                        window = (seg, doc)
                    elif doc > window[1]:
                        for x, v in zip(found, (th, doc, pos, pos + width)):
                            x.append(v)
                    continue
                if words > shard and key != last:
                    yield search(*held)
                    held, words = [[], [], [], [], []], 0
                for x, v in zip(held, (key, seg, doc, th, pos)):
                    x.append(v)
                words += seg.count(b" ") + 2
                last = key
            if found[0]:
                yield out(*found)
        if held[0]:
            yield search(*held)

    placed = segments.repartition(parts, "key").sortWithinPartitions("hot", "key", "seg", "doc")
    return placed.select("key", "hot", "seg", "doc", "th", "pos").mapInArrow(run, "th long, doc long, s long, e long")


def marked(docs: DataFrame, width: int = WIDTH, hot: int = HOT, shard: int = SHARD, keep=()) -> DataFrame:
    """doc, text, least, cover (list of start, end, ... or null): what is to be removed from each row. A row with
    doc > least is a copy and loses every word, if its text has a window at all."""
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    classes = _classes(docs, parts, keep)
    found = _intervals(_segments(classes, _shared(classes, parts, width, hot), width), parts, width, shard)
    # joined on th alone: with more keys Spark would shuffle the texts once more, by all of them
    lists = found.groupBy("th").agg(F.collect_list(F.struct("doc", "s", "e")).alias("l"))
    mine = F.filter("l", lambda x: x["doc"] == F.col("least"))
    cover = F.when(F.size(mine) > 0, F.flatten(F.transform(mine, lambda x: F.array(x["s"], x["e"]))))
    return classes.join(lists, "th", "left").select("doc", "text", "least", cover.alias("cover"), *keep)


def kept_words(text: bytes, copy: bool, cover: list[int] | None, width: int = WIDTH) -> tuple[list[bytes], np.ndarray]:
    """The words of a text and which of them stay."""
    w = text.split()
    stay = np.ones(len(w), dtype=bool)
    if copy and len(w) >= width:
        stay[:] = False
    elif cover:
        for s, e in zip(cover[::2], cover[1::2]):
            stay[s:e] = False
    return w, stay


def substring_digests(docs: DataFrame, width: int = WIDTH, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, sha = [], [], []
            for doc, text, least, cover in zip(b.column(0).to_pylist(), raw(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()):
                w, stay = kept_words(text, doc > least, cover, width)
                n.append(len(w))
                removed.append(len(w) - int(stay.sum()))
                left = w if not removed[-1] else [x for x, s in zip(w, stay.tolist()) if s]
                sha.append(sha256(b" ".join(left)).hexdigest())
            ids = pa.array([None if d == TOP else d for d in b.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return marked(docs, width, hot, shard).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without(text: bytes, copy: bool, cover: list[int] | None, width: int = WIDTH) -> bytes:
    """The text without the words to be removed; what stays keeps the white space after it."""
    w, stay = kept_words(text, copy, cover, width)
    if stay.all():
        return text
    return b"".join(p for p, s in zip(PIECE.findall(text), stay.tolist()) if s).strip()


def cleaned(docs: DataFrame, width: int = WIDTH, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """docs with the text that is left; n_chars follows it. A null text stays null."""
    @F.pandas_udf("string")
    def strip(text: pd.Series, copy: pd.Series, cover: pd.Series) -> pd.Series:
        return pd.Series([t if c is None and not k else without(t.encode(), k, list(c) if c is not None else None, width).decode() for t, k, c in zip(text, copy, cover)])

    rest = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"], F.col("text").isNull().alias("none")).alias("_rest")
    df = marked(docs.withColumn("_rest", rest).select("doc_id", "text", "_rest"), width, hot, shard, ("_rest",))
    df = df.withColumn("_text", F.when(~F.col("_rest.none"), strip("text", F.col("doc") > F.col("least"), "cover")))

    def column(i: int, name: str):
        if name == "text":
            return F.col("_text").alias("text")
        if name == "n_chars":
            return F.length("_text").cast(docs.schema[name].dataType).alias(name)
        return F.col(f"_rest.c{i}").alias(name)

    return df.select(*[column(i, c) for i, c in enumerate(docs.columns)])
