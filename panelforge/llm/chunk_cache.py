"""Exact, cached encoding with the tokenizers library.

A text is cut where a pre-token must begin whatever stands around it; a text that holds one of the
tokenizer's added tokens (as ``<|endoftext|>``) goes through the library whole.  The library encodes the
pieces that a worker does not know, many in one call; the ids of known pieces are joined.  A
worker process keeps what it knows, in a bounded table, from task to task.  Results never depend
on what is known.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Hashable, Iterable
from functools import lru_cache

import numpy as np

from .common import ASCII_SPACE, mix

LIMIT = 600_000


class Known(dict):
    """piece -> ids (bytes), in two generations: what was not used lately is forgotten.

    ``encode`` gives the ids of new pieces, many at once; ``tail`` may split a new piece into a
    shorter one and the ids of what follows it.
    """

    def __init__(self, encode: Callable[[list], list[bytes]], tail: Callable = lambda p: None, limit: int = LIMIT):
        super().__init__()
        self.encode, self.tail, self.limit = encode, tail, limit
        self.old: dict[Hashable, bytes] = {}

    def learn(self, pieces: Iterable) -> None:
        """Make all of these known."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        split: dict = {}
        new: set = set()
        for p in pieces:
            v = self.old.get(p)
            if v is not None:
                self[p] = v
                continue
            t = self.tail(p)
            if t is None:
                new.add(p)
                continue
            split[p] = t
            if t[0] not in self:
                v = self.old.get(t[0])
                if v is None:
                    new.add(t[0])
                else:
                    self[t[0]] = v
        todo = list(new)
        self.update(zip(todo, self.encode(todo), strict=True))
        for p, (core, v) in split.items():
            self[p] = self[core] + v

    def join(self, texts: list[list]) -> list[bytes]:
        """The joined ids of each list of pieces."""
        out: list = [None] * len(texts)
        get = self.__getitem__
        missing: set = set()
        rest = []
        for k, pieces in enumerate(texts):
            try:
                out[k] = b"".join(map(get, pieces))
            except KeyError:
                missing.update([p for p in pieces if p not in self])
                rest.append(k)
        if rest:
            kept = dict(self) if len(self) > self.limit else None
            self.learn(missing)
            if kept is not None:  # this block may need what has just been put aside
                get = lambda p: self[p] if p in self else kept[p]
            for k in rest:
                out[k] = b"".join(map(get, texts[k]))
        return out


class ShortPieces:
    """Pieces of at most ``LONGEST`` bytes -> ids, for many at once.  A piece is its bytes in three
    integers and its length, so equal keys are equal pieces.  ``at`` is a table with open
    addressing over the entries; the ids of all entries lie in ``pool``.  Full, it begins anew.
    """

    LONGEST = 24
    #: ``MASK[n]`` keeps the first n bytes of a little-endian integer.
    MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

    def __init__(self, dtype: str, limit: int):
        self.dtype, self.limit = dtype, limit
        self.clear()

    def clear(self) -> None:
        self.n = self.used = 0
        self.at = np.full(1 << 10, -1, np.int32)
        self.keys = np.zeros((512, 4), np.uint64)
        self.first, self.count = np.zeros(512, np.int64), np.zeros(512, np.int64)
        self.pool = np.zeros(4096, self.dtype)

    @classmethod
    def key(cls, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Keys of data[start : start + size]; ``data`` goes on for ``LONGEST`` bytes behind the last."""
        eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        out = np.empty((len(start), 4), np.uint64)
        for k in range(3):
            out[:, k] = eight[start + 8 * k] & cls.MASK[np.clip(size - 8 * k, 0, 8)]
        out[:, 3] = size
        return out

    def _place(self, keys: np.ndarray) -> np.ndarray:
        h = mix(keys[:, 0] ^ mix(keys[:, 1] ^ mix(keys[:, 2] ^ (keys[:, 3] << np.uint64(56)))))
        return (h & np.uint64(len(self.at) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 for those not known."""
        out = np.full(len(keys), -1, np.int64)
        place, todo = self._place(keys), np.arange(len(keys))
        while len(todo):
            e = self.at[place]
            some = e >= 0
            todo, place, e = todo[some], place[some], e[some]
            d = self.keys[e] ^ keys[todo]
            same = (d[:, 0] | d[:, 1] | d[:, 2] | d[:, 3]) == 0
            out[todo[same]] = e[same]
            todo, place = todo[~same], (place[~same] + 1) & (len(self.at) - 1)
        return out

    def _enter(self, first: int) -> None:
        """Put entries from ``first`` on into the table."""
        e = np.arange(first, self.n, dtype=np.int32)
        place = self._place(self.keys[first : self.n])
        while len(e):
            free = self.at[place] < 0
            self.at[place[free]] = e[free]
            left = self.at[place] != e
            e, place = e[left], (place[left] + 1) & (len(self.at) - 1)

    def room(self, n: int) -> bool:
        return self.n + n <= max(self.limit, n)

    def add(self, keys: np.ndarray, ids: list[bytes]) -> None:
        """New keys, all different, and their ids."""
        flat = np.frombuffer(b"".join(ids), self.dtype)
        count = np.array([len(x) for x in ids], np.int64) // self.pool.itemsize
        first, n = self.n, self.n + len(ids)
        while n > len(self.keys):
            self.keys, self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.keys, self.first, self.count))
        self.keys[first:n], self.count[first:n] = keys, count
        self.first[first:n] = self.put(flat) + np.cumsum(count) - count
        self.used += len(flat)
        self.n = n
        if 2 * n > len(self.at):
            self.at = np.full(1 << (4 * n).bit_length(), -1, np.int32)
            first = 0
        self._enter(first)

    def put(self, flat: np.ndarray) -> int:
        """Write ids behind those in use, where the next ones go; their place."""
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        return self.used


def plain_tokenizer(content: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(content.decode())


def added(t) -> list[str]:
    """The tokens that the library looks for before anything else."""
    return [x.content for x in t.get_added_tokens_decoder().values() if x.content]


#: Letters of ASCII and Latin-1, and those with both cases in one range.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: Fixed value: the letter that stands for each byte in a byte-level file: printable bytes are
#: themselves, the others follow from U+0100 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_STANDS = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}


def in_letters(text: str) -> str:
    return text if text.isascii() else text.encode().decode("latin-1").translate(_STANDS)


def _many(t, kind: str, plain: list[tuple[int, bytes, str]], other: list[tuple[int, str]]) -> list[bytes]:
    """Ids of pieces, by place.  A plain piece is one pre-token of Latin letters, which the
    library's model takes at once, after some ids known before; others go through all of the
    library's steps."""
    out: list = [b""] * (len(plain) + len(other))
    model = t.model.tokenize
    for k, before, piece in plain:
        out[k] = before + array(kind, [x.id for x in model(piece)]).tobytes()
    for (k, _), e in zip(other, t.encode_batch_fast([x for _, x in other], add_special_tokens=False), strict=True):
        out[k] = array(kind, e.ids).tobytes()
    return out


class WordIds:
    """For a tokenizer that drops white space and never joins over it: pieces are the runs
    between ASCII white space, with A-Z lowered.  Ids are little-endian unsigned 32-bit
    integers (the engine's hosts are little-endian)."""

    MARKS = (".", ",", "!", "?", ";", ":")
    PLAIN = re.compile(f"[{LETTERS}]+").fullmatch
    TAIL = re.compile(f"(?s).*[{LETTERS}][.,!?;:]").fullmatch

    def __init__(self, content: bytes, limit: int = LIMIT):
        self.t = plain_tokenizer(content)
        self.added = [x.encode().lower() for x in added(self.t)]
        self.after = {m.encode(): v for m, v in zip(self.MARKS, self.encode([m.encode() for m in self.MARKS]), strict=True)}
        self.known = Known(self.encode, self.tail, limit)

    def tail(self, w: bytes) -> tuple[bytes, bytes] | None:
        """One such mark after a letter is a pre-token of its own."""
        v = self.after.get(w[-1:])
        return (w[:-1], v) if v is not None and self.TAIL(w.decode()) else None

    def encode(self, words: list[bytes]) -> list[bytes]:
        plain, other = [], []
        for k, w in enumerate(words):
            x = w.decode()
            if self.PLAIN(x):
                plain.append((k, b"", in_letters(x.lower())))
            else:
                other.append((k, x))
        return _many(self.t, "I", plain, other)

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        low = [t.lower() for t in texts]
        odd = [k for k, t in enumerate(low) if any(map(t.__contains__, self.added))]
        whole = dict(zip(odd, _many(self.t, "I", [], [(i, texts[k].decode()) for i, k in enumerate(odd)]), strict=True))
        out = self.known.join([[] if k in whole else t.split() for k, t in enumerate(low)])
        return [whole.get(k, x) for k, x in enumerate(out)] if whole else out


class ByteIds:
    """For a byte-level tokenizer whose pre-tokens hold white space only at their beginning (at
    most one space) or are white space alone: a pre-token must begin wherever white space follows
    another character.  Pieces are a run of ASCII white space and what follows it.  Where a text
    has white space outside ASCII, the library encodes it whole.

    Short pieces are found by their bytes, all of a block at once; longer ones by keys: what follows
    one space; a line feed and what follows it; or any other piece, in a tuple.
    """

    #: Fixed value: white space outside ASCII.
    OTHER = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
    SPACE = _STANDS[32]
    MARKS = (".", ",", "!", "?", ";", ":")
    PLAIN = re.compile(f"\n?[{LETTERS}]+").fullmatch
    LETTER = re.compile(f"[{LETTERS}]").match

    def __init__(self, content: bytes, limit: int = LIMIT):
        self.t = plain_tokenizer(content)
        self.added = added(self.t)
        self.kind = "H" if self.t.get_vocab_size() <= 1 << 16 else "I"
        self.width = array(self.kind).itemsize
        self.line = self.whole(["\n"])[0]
        self.after = dict(zip(self.MARKS, self.whole(list(self.MARKS)), strict=True))
        self.known = Known(self.encode, self.tail, limit)
        self.short = ShortPieces(f"<u{self.width}", 4 * limit)

    @staticmethod
    def named(p: str) -> Hashable:
        lone = len(p) > 1 and p[1] not in " \t\n\r\x0b\x0c"
        return p[1:] if lone and p[0] == " " else p if lone and p[0] == "\n" else (p,)

    def tail(self, key) -> tuple[str, bytes] | None:
        """One such mark after a letter, with white space or the end behind it, is a pre-token."""
        v = self.after.get(key[-1]) if key and type(key) is str else None
        return (key[:-1], v) if v is not None and self.LETTER(key[-2:-1]) else None

    def whole(self, texts: list[str]) -> list[bytes]:
        return _many(self.t, self.kind, [], list(enumerate(texts)))

    def encode(self, keys: list) -> list[bytes]:
        plain, other = [], []
        for k, key in enumerate(keys):
            if type(key) is tuple:
                other.append((k, key[0]))
            elif self.PLAIN(key):
                plain.append((k, self.line, in_letters(key[1:])) if key[0] == "\n" else (k, b"", self.SPACE + in_letters(key)))
            else:
                other.append((k, key if key[:1] == "\n" else " " + key))
        return _many(self.t, self.kind, plain, other)

    def learn(self, pieces: list[bytes], keys: np.ndarray) -> None:
        """Make short pieces known.  Of one that ends in a mark, the rest may be known."""
        names = [self.named(p.decode()) for p in pieces]
        ends = [self.tail(x) for x in names]
        cut = [k for k, t in enumerate(ends) if t is not None]
        data = np.frombuffer(b"".join(pieces) + bytes(self.short.LONGEST), np.uint8)
        size = np.array([len(p) for p in pieces], np.int64)
        rest = self.short.find(self.short.key(data, (np.cumsum(size) - size)[cut], size[cut] - 1))
        ids: list = [None] * len(pieces)
        for k, e in zip(cut, rest.tolist(), strict=True):
            if e >= 0:
                at = int(self.short.first[e])
                ids[k] = self.short.pool[at : at + int(self.short.count[e])].tobytes() + ends[k][1]
        todo = [k for k, x in enumerate(ids) if x is None]
        for k, x in zip(todo, self.encode([names[k] if ends[k] is None else ends[k][0] for k in todo]), strict=True):
            ids[k] = x if ends[k] is None else x + ends[k][1]
        self.short.add(keys, ids)

    def pieces(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts that are cut at white space."""
        short = self.short
        raw = b"".join(texts)
        data = np.frombuffer(raw + bytes(short.LONGEST), np.uint8)
        off = np.cumsum([0, *map(len, texts)])
        space = ASCII_SPACE[data[: len(raw)]]
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[off[:-1][off[:-1] < len(raw)]] = True
        start = np.flatnonzero(begins)
        size = np.diff(start, append=len(raw))
        is_long = size > short.LONGEST
        few = np.flatnonzero(~is_long)
        keys = short.key(data, start[few], size[few])
        entry = short.find(keys)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            at, to = start[few[missing]].tolist(), (start + size)[few[missing]].tolist()
            new = {raw[x:y]: k for x, y, k in zip(at, to, missing.tolist(), strict=True)}
            if not short.room(len(new)):  # all of this block's pieces anew
                short.clear()
                missing = np.arange(len(few))
                new = {raw[x:y]: k for k, (x, y) in enumerate(zip(start[few].tolist(), (start + size)[few].tolist(), strict=True))}
            self.learn(list(new), keys[list(new.values())])
            entry[missing] = short.find(keys[missing])
        first, count = np.empty(len(start), np.int64), np.empty(len(start), np.int64)
        first[few], count[few] = short.first[entry], short.count[entry]
        if is_long.any():
            names = [[self.named(raw[x : x + n].decode())] for x, n in zip(start[is_long].tolist(), size[is_long].tolist(), strict=True)]
            ids = self.known.join(names)
            count[is_long] = n = np.array([len(x) for x in ids], np.int64) // self.width
            first[is_long] = short.put(np.frombuffer(b"".join(ids), short.dtype)) + np.cumsum(n) - n  # until the next block
        to = np.cumsum(count)
        flat = short.pool[np.repeat(first - to + count, count) + np.arange(to[-1] if len(to) else 0)].tobytes()
        ends = np.concatenate([[0], to])[np.searchsorted(start, off)] * self.width
        return [flat[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        odd = [k for k, t in enumerate(texts) if any(map(t.__contains__, self.added)) or (not t.isascii() and self.OTHER.search(t))]
        whole = dict(zip(odd, self.whole([texts[k] for k in odd]), strict=True))
        out = self.pieces([b"" if k in whole else t.encode() for k, t in enumerate(texts)])
        return [whole.get(k, x) for k, x in enumerate(out)] if whole else out


@lru_cache(2)
def word_ids(content: bytes, limit: int = LIMIT) -> WordIds:
    """Kept by the worker process, so that its later tasks know the pieces of the earlier."""
    return WordIds(content, limit)


@lru_cache(2)
def byte_ids(content: bytes, limit: int = LIMIT) -> ByteIds:
    return ByteIds(content, limit)
