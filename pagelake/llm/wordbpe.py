"""A fast front for the lower-casing word BPE of `word_bpe_49k.json`, equal to the tokenizers library's ids.

White space parts this tokenizer's pieces and is dropped, so the ids of a text are those of its white-space chunks in
order. Chunks are memoised in a bounded memo; a new chunk is cut into pieces, and a piece is merged by tiktoken, whose
merge ranks are read from the same file (a spare byte stands for the end of a word). What that can't express exactly
(control strings of the vocabulary, letters beyond the Latin blocks) goes to the tokenizers library itself.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np

from pagelake.llm._common import Recent

END = b"\xff"
PIECES = re.compile(r"[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d|\d|(?:[^\w\s]|_)+")
#: a text with anything beyond these goes chunk by chunk, and such a chunk to the library
PLAIN = re.compile(r"[\t-\r -~¡-©«-¬®-±´-¸»¿-ɏ]*")


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class WordBpe:
    def __init__(self, path: str, memo: int = 150_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        byte = _bytes_of()
        suffix = spec["model"]["end_of_word_suffix"]

        def plain(token: str) -> bytes:
            end = token.endswith(suffix)
            return bytes(byte[c] for c in (token[: -len(suffix)] if end else token)) + END * end

        ranks: dict[bytes, int] = {}
        for b in range(256):
            ranks[bytes([b])] = len(ranks)
        for b in range(255):
            ranks[bytes([b]) + END] = len(ranks)
        for pair in spec["model"]["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            ranks.setdefault(plain(a + b), len(ranks))
        self.ids = [0] * len(ranks)
        for token, i in spec["model"]["vocab"].items():
            key = plain(token)
            if key in ranks:
                self.ids[ranks[key]] = i
        self.merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        # a word that is a token is looked up whole there; where its own merges don't lead to it, the library decides
        self.odd = {}
        for token, i in spec["model"]["vocab"].items():
            if token.endswith(suffix):
                got = [t.id for t in self.library.model.tokenize(token[: -len(suffix)])]
                if got != [i]:
                    self.odd[plain(token)[:-1]] = got
        self.rank = {i: r for r, i in enumerate(self.ids)}
        for t in spec["added_tokens"]:
            self.rank[t["id"]] = len(self.ids)
            self.ids.append(t["id"])
        self.odd = {k: self._ranks(v) for k, v in self.odd.items()}
        self.table = np.array(self.ids, dtype=np.uint16)
        self.plain = Recent(self._plain, memo)
        self.chunks = Recent(self._chunk, 20_000)

    def _ranks(self, ids) -> bytes:
        return array("H", [self.rank[i] for i in ids]).tobytes()

    def _piece(self, piece: str) -> bytes:
        key = piece.encode()
        return self.odd.get(key) or array("H", self.merge(key + END)).tobytes()

    def _plain(self, chunk: str) -> bytes:
        """A lower-cased chunk of plain characters; its pieces are chunks of their own, in the same memo."""
        if chunk.isalpha():
            return self._piece(chunk)
        pieces = PIECES.findall(chunk)
        if len(pieces) == 1:
            return self._piece(pieces[0])
        return b"".join(map(self.plain.__getitem__, pieces))

    @staticmethod
    def _lower(text: str) -> str:
        return (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        if PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return self._plain(self._lower(text))
        return self._ranks(self.library.encode(text, add_special_tokens=False).ids)

    def encode(self, text: bytes) -> np.ndarray:
        """The ids of a UTF-8 text, as unsigned 16-bit integers (the vocabulary has fewer than 65,536)."""
        whole = text.decode("utf-8", "replace")
        if PLAIN.fullmatch(whole) and not any(s in whole for s in self.special):
            ranks = b"".join(map(self.plain.__getitem__, self._lower(whole).split()))
        else:
            ranks = b"".join(map(self.chunks.__getitem__, text.split()))
        return self.table[np.frombuffer(ranks, dtype=np.uint16)]


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One per Python worker."""
    return WordBpe(path)
