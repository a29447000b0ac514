"""Byte-level BPE as a bounded-lookahead streaming transducer, and its decoder.

`Merges.lookahead` is the merge list's sufficient lookahead, computed from the list. A difference to the right of a
position can reach further left only by a merge (a, z) whose right part z starts where the difference has got to, and,
in a proper list, only by a merge of a later rank than the one before. So the longest chain of ranks r1 < r2 < ..., each
rule's right part having the previous rule's left part on its left spine, weighted by the bytes of the left parts,
bounds how far any text to come can reach back: tokens that end that many bytes before the end of what was read are
final. Every text is fed to an `Encoder` in slices: what a slice completes is final at once, as no merge crosses the end
of a word, and of a word that goes on for long, the tokens that the lookahead makes final are emitted and the rest is
kept. So memory is constant, whatever the length of a text or word. The memo of words only saves time; it is bounded.

A null text is an empty one. Control strings of the vocabulary in a text become their ids, as in the library. Repeated rows
are rows each; an empty table gives an empty result; columns other than doc_id and text may have any name.
"""

from __future__ import annotations

import codecs
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm._common import Recent, raw, ship, tokenizer_path
from pagelake.llm.wordbpe import _bytes_of

#: Unicode White_Space, which is what parts units; Python's own idea of it has four more characters
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: within a unit of at most one space and what is not white space, or of white space, the pieces of a word are independent
UNIT = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+")
#: a run that is neither letters nor digits takes an apostrophe in, though one at its start would begin a contraction
OTHERS = regex.compile(rf"[^{SPACE}\p{{L}}\p{{N}}]+")
#: characters: of a unit that is memoised, of a slice, and of an unfinished word from which on stable tokens are emitted
LONG, FEED, HELD = 256, 1 << 14, 1 << 10


class Merges:
    """A merge list: ranks of pairs of token ids, and its sufficient lookahead in bytes (None if the list isn't proper)."""

    def __init__(self, vocab: dict[str, int], merges: list):
        byte = _bytes_of()
        self.first = [0] * 256
        for c, b in byte.items():
            if c in vocab:
                self.first[b] = vocab[c]
        self.text = {i: bytes(byte[c] for c in t) for t, i in vocab.items() if all(c in byte for c in t)}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        made: dict[int, list[int]] = {}
        parts: dict[int, list[tuple[int, int]]] = {}
        for r, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((x, y), (r, z))
            made.setdefault(z, []).append(r)
            parts.setdefault(z, []).append((x, y))
        proper = all(max(made.get(x, [-1])) < r and max(made.get(y, [-1])) < r for (x, y), (r, _) in self.rank.items())
        self.lookahead = self._chain(parts) if proper else None

    def _chain(self, parts) -> int:
        reach: dict[int, int] = {}  # by the left part of a rule: the longest chain that ends in such a rule so far
        most = 1
        for (a, z), _ in sorted(self.rank.items(), key=lambda x: x[1][0]):
            back, spine, seen = 0, [z], set()
            while spine:
                t = spine.pop()
                if t not in seen:
                    seen.add(t)
                    back = max(back, reach.get(t, 0))
                    spine += [x for x, _ in parts.get(t, [])]
            back += len(self.text[a])
            reach[a] = max(reach.get(a, 0), back)
            most = max(most, back)
        return most

    def apply(self, data: bytes) -> list[int]:
        """The tokens of one piece: the pair of least rank merges first, the leftmost of equals."""
        first, rank = self.first, self.rank
        ids = [first[b] for b in data]
        if len(ids) > 48:
            return self._apply_long(ids)
        while len(ids) > 1:
            best, at, new = 1 << 60, -1, 0
            for i, pair in enumerate(zip(ids, ids[1:])):
                r = rank.get(pair)
                if r is not None and r[0] < best:
                    best, new = r
                    at = i
            if at < 0:
                break
            ids[at : at + 2] = [new]
        return ids

    def _apply_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list: n log n for long pieces."""
        from heapq import heapify, heappop, heappush

        n, rank = len(ids), self.rank
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1])))]
        heapify(heap)
        while heap:
            _, i, x, y, z = heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != x or ids[j] != y:
                continue
            ids[i], alive[j], after[i] = z, False, after[j]
            if after[j] < n:
                before[after[j]] = i
                if r := rank.get((z, ids[after[j]])):
                    heappush(heap, (r[0], i, z, ids[after[j]], r[1]))
            if before[i] >= 0:
                k = before[i]
                if r := rank.get((ids[k], z)):
                    heappush(heap, (r[0], k, ids[k], z, r[1]))
        return [x for x, live in zip(ids, alive) if live]


class Vocabulary:
    """A byte-level vocabulary file, its merges and a memo of the units of texts."""

    def __init__(self, path: str, memo: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = Merges(spec["model"]["vocab"], spec["model"]["merges"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.text = self.merges.text | {i: s.encode() for s, i in self.special.items()}
        self.pieces = Recent(lambda p: array("I", self.merges.apply(p.encode())).tobytes(), memo)
        self.units = Recent(self._unit, memo)

    def _unit(self, unit: str) -> bytes:
        body = unit[1:] if unit[0] == " " else unit
        if body.isalpha():
            return self.pieces[unit]
        return b"".join([self.pieces[p] for p in PIECE.findall(unit)])


class Encoder:
    """Text in, ids out (bytes of little-endian unsigned 32-bit integers), in constant memory: feed(), then finish()."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.tail = ""  # the unit that isn't complete yet
        self.inside = False  # whether the tail goes on with a run of OTHERS
        self.look = vocabulary.merges.lookahead

    def feed(self, text: str) -> bytes:
        text = self.tail + text
        units = UNIT.findall(text)
        # the last unit may go on, and so may white space before it
        keep = units[-2:] if len(units) > 1 and units[-2].isspace() else units[-1:]
        self.tail = "".join(keep)
        out = self._units(units[: len(units) - len(keep)])
        if len(self.tail) > 4 * HELD and self.look:
            if len(keep) > 1 and not keep[1].isspace():  # the white space before a long word is complete
                out += self._units(keep[:1])
                self.tail = keep[1]
            out += self._long()
        return out

    def _units(self, units: list[str]) -> bytes:
        if not units:
            return b""
        if self.inside:
            first = b"".join([array("I", self.v.merges.apply(p.encode())).tobytes() for p in self._cut(units[0])])
            self.inside = False
            return first + self._units(units[1:])
        if max(map(len, units)) <= LONG:
            return b"".join(map(self.v.units.__getitem__, units))
        return b"".join([self.v.units[u] if len(u) <= LONG else self._pieces(u) for u in units])

    def _pieces(self, unit: str) -> bytes:
        """A unit too long for the memo."""
        return b"".join([array("I", self.v.merges.apply(p.encode())).tobytes() for p in PIECE.findall(unit)])

    def _cut(self, text: str) -> list[str]:
        head = OTHERS.match(text) if self.inside else None
        return [head[0], *PIECE.findall(text[head.end() :])] if head else PIECE.findall(text)

    def _long(self) -> bytes:
        """What is final of a word that has no end yet: its complete pieces, and the stable tokens of its last one."""
        if self.tail.isspace():  # its last character may belong to the next word
            return self._stable(self.tail[:-1], self.tail[-1])
        pieces = self._cut(self.tail)
        done, body = pieces[:-1], pieces[-1]
        if len(body) <= HELD:  # short pieces: hold the last two, a contraction may go on
            self.tail, done = "".join(pieces[-2:]), pieces[:-2]
            self.inside = self.inside and not done
            return b"".join([array("I", self.v.merges.apply(p.encode())).tobytes() for p in done])
        out = b"".join([array("I", self.v.merges.apply(p.encode())).tobytes() for p in done])
        self.inside = bool(OTHERS.match(body[-1]))
        return out + self._stable(body, "")

    def _stable(self, body: str, rest: str) -> bytes:
        data = body.encode()
        out, at = [], 0
        for t in self.v.merges.apply(data):
            n = len(self.v.text[t])
            end = at + n
            # a token is final if nothing to come can reach it, and must end where a character ends to be resumed
            if end > len(data) - self.look - 4:
                break
            out.append(t)
            at = end
        while out and at < len(data) and data[at] & 0xC0 == 0x80:
            at -= len(self.v.text[out.pop()])
        self.tail = data[at:].decode() + rest
        return array("I", out).tobytes()

    def finish(self) -> bytes:
        units = UNIT.findall(self.tail)
        self.tail = ""
        return self._units(units)


def encode(text: str, vocabulary: Vocabulary) -> Iterator[bytes]:
    """The ids of a text, piece by piece."""
    at = 0
    for m in [*vocabulary.cut.finditer(text), None] if any(s in text for s in vocabulary.special) else [None]:
        encoder = Encoder(vocabulary)
        end = m.start() if m else len(text)
        for i in range(at, end, FEED):
            yield encoder.feed(text[i : min(end, i + FEED)])
        yield encoder.finish()
        if m:
            yield array("I", [vocabulary.special[m[0]]]).tobytes()
            at = m.end()


class Decoder:
    """Ids in, text out. The state is the bytes of a character that isn't complete: three at most."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes = vocabulary.text
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self.machine.decode(b"".join(map(self.bytes.__getitem__, ids)))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per Python worker."""
    return Vocabulary(path)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): the ids of every text, and the text that they decode to. For texts that fit a row."""
    return _run(docs, path, "ids array<int>, decoded string", _whole)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded and decoded as streams, no text's ids are held whole."""
    return _run(docs, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", _digest)


def _whole(text: str, v: Vocabulary) -> tuple:
    ids = array("I", b"".join(encode(text, v)))
    d = Decoder(v)
    return list(ids), d.feed(ids) + d.finish()


def _digest(text: str, v: Vocabulary) -> tuple:
    n, of_ids, of_text, decoder = 0, sha256(), sha256(), Decoder(v)
    for part in encode(text, v):
        of_ids.update(part)
        n += len(part) // 4
        of_text.update(decoder.feed(array("I", part)).encode())
    of_text.update(decoder.finish().encode())
    return n, of_ids.hexdigest(), of_text.hexdigest()


def _run(docs: DataFrame, path: str | None, columns: str, make) -> DataFrame:
    ship(docs.sparkSession)
    path = path or tokenizer_path("byte_bpe_50k.json")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {columns}"
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    types = [kinds[c.split()[1]] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            rows = [make((t or b"").decode("utf-8", "replace"), v) for t in raw(b.column(1))]
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], ["doc_id", *names])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)
