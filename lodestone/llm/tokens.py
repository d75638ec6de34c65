"""Exact, fast encoding with a public tokenizer.

word_bpe_49k.json drops white space, lower-cases and never merges across the pieces of its pre-tokenizer, so a text's ids
are those of its pieces, one after the other. Texts of plain Latin letters are cut into those pieces here, many at a time
in NumPy; each distinct piece goes through the tokenizer once and its cells are kept. Other texts go through the library whole.
Pieces of at most eight bytes are told apart by those bytes, longer ones by 64 bits of hash.
"""

from __future__ import annotations

import gc
import os
import re
from functools import lru_cache

import numpy as np

from .common import mix, trim

END_ID = 2
#: Characters of the texts whose pieces are looked up together, about; a bound on memory.
GROUP = 1 << 18
#: Distinct pieces that a worker remembers, and bytes of the longest; a bound on memory.
KEEP, LONGEST = 500_000, 64

#: Texts of these characters only are normalised by lower-casing alone and have the pieces that Pieces finds.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
#: Kinds of bytes: 0 white space, 1 letters (those beyond ASCII are two bytes of such), 2 digits, 3 others.
_KIND = np.full(256, 3, np.uint8)
_KIND[[0x09, 0x0A, 0x0D, 0x20]] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_KIND[0x30:0x3A] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BYTE_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def default_path() -> str:
    """word_bpe_49k.json as the public_tokenizers package places it."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _groups(rows: list[int], texts: list[str | None]):
    """rows in runs whose texts have GROUP characters in all, or one text that has more."""
    part, n = [], 0
    for i in rows:
        size = len(texts[i] or "")
        if part and n + size > GROUP:
            yield part
            part, n = [], 0
        part.append(i)
        n += size
    if part:
        yield part


def _pieces(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of plain text, and where the tokenizer's pieces start and end in them."""
    data = np.frombuffer(raw + b" " * (LONGEST + 8), np.uint8)
    kind, data = _KIND[data], _LOWER[data]
    if not raw.isascii():
        # Capitals beyond ASCII differ from small letters in their second byte.
        capital = (data[1:] < 0x9F) & (data[1:] >= 0x80) & (data[:-1] == 0xC3)
        data[1:][capital] += 0x20
    new = np.empty(len(kind), bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new |= kind == 2
    # A run of other signs that starts with an apostrophe may be an English ending of its own: 's 't 'm 'd 're 've 'll.
    quote = np.flatnonzero((data == 0x27) & new) if b"'" in raw else ()
    if len(quote):
        x, y = data[quote + 1], data[quote + 2]
        one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
        two = ((y == 0x65) & ((x == 0x72) | (x == 0x76))) | ((x == 0x6C) & (y == 0x6C))
        new[quote[one | two] + 1] = False
        for n, which in ((2, one), (3, two & ~one)):
            after = quote[which] + n
            new[after[kind[after] == 1]] = True
    new |= kind == 0
    edge = np.flatnonzero(new)
    first, last = edge[:-1], edge[1:]
    word = kind[first] != 0
    return data, first[word], last[word]


def _keys(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A number for each piece, never 0."""
    n = np.minimum(last - first, LONGEST)
    wide = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    eight = lambda at: np.ascontiguousarray(wide[at]).view("<u8")[:, 0]
    key = mix(eight(first) & _BYTE_MASK[np.minimum(n, 8)])
    at = 8
    while len(more := np.flatnonzero(n > at)):
        key[more] = mix(key[more] * np.uint64(0x9E3779B97F4A7C15) + (eight(first[more] + at) & _BYTE_MASK[np.minimum(n[more] - at, 8)]) + np.uint64(at))
        at += 8
    key[key == 0] = 1
    return key


class _Store:
    """Cells of pieces by key: an open hash table and one array of all cells. Full at keep pieces; further ones aren't remembered."""

    def __init__(self, width: int, keep: int):
        size = 1 << max(12, (3 * keep).bit_length())
        self.keep, self.n = keep, 0
        self.mask = np.uint64(size - 1)
        self.keys, self.place = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        self.start = np.zeros(keep + 1, np.int64)
        self.cells = np.empty((1 << 12, width), np.uint32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key's piece, or -1."""
        out, todo, slot = np.full(len(keys), -1, np.int64), np.arange(len(keys)), keys & self.mask
        while len(todo):
            there = self.keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.place[slot[hit]]
            go = ~hit & (there != 0)
            todo, slot = todo[go], (slot[go] + np.uint64(1)) & self.mask
        return out

    def stage(self, cells: np.ndarray) -> int:
        """Puts further cells behind those remembered, until the next call; gives their place."""
        at = int(self.start[self.n])
        if at + len(cells) > len(self.cells):
            self.cells = np.concatenate([self.cells, np.empty((max(len(self.cells), len(cells)), self.cells.shape[1]), np.uint32)])
        self.cells[at : at + len(cells)] = cells
        return at

    def add(self, keys: np.ndarray, many: np.ndarray) -> None:
        """Remembers the first of the pieces staged, while there is room."""
        room = min(self.keep - self.n, len(keys))
        if room <= 0:
            return
        self.start[self.n + 1 : self.n + 1 + room] = self.start[self.n] + np.cumsum(many[:room])
        todo, slot = np.arange(room), keys[:room] & self.mask
        while len(todo):
            # Of those that want one free slot, the last written has it.
            free = self.keys[slot] == 0
            self.place[slot[free]] = self.n + todo[free]
            self.keys[slot[free]] = keys[todo[free]]
            go = self.keys[slot] != keys[todo]
            todo, slot = todo[go], (slot[go] + np.uint64(1)) & self.mask
        self.n += room


class PieceEncoder:
    """Ids, and on request character spans, of whole texts. keep: distinct pieces remembered, a bound on memory."""

    def __init__(self, path: str, keep: int = KEEP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib, self.keep = Tokenizer.from_file(path), keep
        self.model = self.lib.model
        self.stores: dict[int, _Store] = {}

    def _encoded(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens each piece has, and the cells of all: ids (width 1) or spans of characters (width 2)."""
        many, cells = [], []
        for w in words:
            if w.isascii():
                got = self.model.tokenize(w.decode())
                many.append(len(got))
                cells += [t.id for t in got] if width == 1 else [t.offsets for t in got]
            else:
                e = self.lib.encode(w.decode(), add_special_tokens=False)
                many.append(len(e.ids))
                cells += e.ids if width == 1 else e.offsets
        return np.array(many, np.int64), np.array(cells, np.uint32).reshape(-1, width)

    def _plain(self, texts: list[str], width: int) -> list[np.ndarray]:
        """The cells of plain texts, spans counted from the text's start."""
        store = self.stores.get(width)
        if store is None:
            store = self.stores[width] = _Store(width, self.keep)
        raws = [t.encode() for t in texts]
        data, first, last = _pieces(b"\n".join(raws))
        keys = _keys(data, first, last)
        piece = store.find(keys)
        lost = np.flatnonzero((piece < 0) | (last - first > LONGEST))
        start, many = store.start[piece], store.start[piece + 1] - store.start[piece]
        if len(lost):
            # Each new piece once; those too long for a key are new each time.
            short = lost[last[lost] - first[lost] <= LONGEST]
            new, at, back = np.unique(keys[short], return_index=True, return_inverse=True)
            over = lost[last[lost] - first[lost] > LONGEST]
            rows = np.concatenate([short[at], over])
            n, more = self._encoded([data[a:b].tobytes() for a, b in zip(first[rows].tolist(), last[rows].tolist(), strict=True)], width)
            begin = np.concatenate([[0], np.cumsum(n)])[:-1]
            begin += store.stage(more)
            start[short], many[short] = begin[back], n[back]
            start[over], many[over] = begin[len(new) :], n[len(new) :]
            store.add(new, n[: len(new)])
        ends = np.cumsum(many)
        total = int(ends[-1]) if len(ends) else 0
        out = store.cells[np.arange(total) + np.repeat(start - (ends - many), many)]
        stops = np.cumsum([len(r) + 1 for r in raws])
        upto = np.searchsorted(first, stops)
        cuts = np.concatenate([[0], ends])[upto].tolist()
        if width == 2:
            # Characters before each piece: bytes that don't carry on a character.
            place = first if all(map(bytes.isascii, raws)) else np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[first]
            begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
            of = np.repeat(np.arange(len(texts)), np.diff(upto, prepend=0))
            out = out.astype(np.int64) + np.repeat(place - begins[of], many)[:, None]
        return [out[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def _cells(self, texts: list[str | None], width: int) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        plain, odd = [], []
        for i, x in enumerate(texts):
            (plain if PLAIN.fullmatch(x or "") and "<|" not in (x or "") else odd).append(i)
        for part in _groups(plain, texts):
            for i, cells in zip(part, self._plain([texts[i] or "" for i in part], width), strict=True):
                out[i] = cells
        for at in range(0, len(odd), 32):
            part = odd[at : at + 32]
            for i, e in zip(part, self.lib.encode_batch([texts[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids if width == 1 else e.offsets).reshape(-1, width)
        return out

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit little-endian integers; None counts as empty."""
        return [x[:, 0].astype("<u4", copy=False) for x in self._cells(texts, 1)]

    def char_spans(self, texts: list[str | None]) -> list[np.ndarray]:
        """The (first, past last) characters of each token, one row a token, as the library's offsets give them."""
        return [x.astype(np.int64, copy=False) for x in self._cells(texts, 2)]


@lru_cache(maxsize=1)
def encoder(path: str) -> PieceEncoder:
    """One encoder a worker process."""
    return PieceEncoder(path)


def released() -> None:
    """Frees the encoder at the end of a task, as workers are kept for other stages; the next task loads it anew in half a second."""
    encoder.cache_clear()
    gc.collect()
    trim()
