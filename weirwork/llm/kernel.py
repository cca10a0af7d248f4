"""Vectorised text kernels: segmentation and hashing over whole Arrow slices with numpy."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
_BASE = U(0xD1342543DE82EF95)
#: The white space that separates words: space and \t \n \v \f \r.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x + _ODD
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SHORT = 1 << 16


@cache
def byte_table() -> np.ndarray:
    return mix(np.arange(256, dtype=U))


@cache
def _short_places() -> np.ndarray:
    return mix(np.arange(SHORT, dtype=U) ^ _BASE)


def places(n: int) -> np.ndarray:
    """A random factor for each of n places (no powers of a base: patterns of letters cannot cancel)."""
    return _short_places() if n <= SHORT else mix(np.arange(n, dtype=U) ^ _BASE)


def run_hashes(raw: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the consecutive non-empty runs of bytes.

    Each byte's random value is multiplied by its place's random factor, so two runs that differ
    agree by chance only. Where equality decides a result, compare `dictionary` codes instead.
    """
    if not len(lengths):
        return np.zeros(0, U)
    begin = np.cumsum(lengths) - lengths
    place = np.arange(len(raw)) - np.repeat(begin, lengths)
    sums = np.add.reduceat(byte_table()[raw] * places(int(lengths.max()))[place], begin)
    return mix(sums + lengths.astype(U) * _ODD)


def dictionary(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The index of each run of bytes among the distinct runs, and these, compared byte by byte."""
    if len(offsets) < 2:
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = runs.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def contents(runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_binary or large_string array and their len+1 offsets."""
    _, offs, data = runs.buffers()
    if not len(runs):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offs, np.int64)[runs.offset : runs.offset + len(runs) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def hashes_of(runs: pa.Array) -> np.ndarray:
    """run_hashes of the (non-empty) elements of an array."""
    raw, at = contents(runs)
    return run_hashes(raw, np.diff(at))


def owners(at: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The index of the text that holds each place; at: offsets of the texts."""
    return np.searchsorted(at, places, side="right") - 1


def segments(raw: np.ndarray, at: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and a mask of the maximal runs of bytes that are not in `outside`, cut at text ends."""
    n = len(raw)
    inside = ~outside[raw]
    first, last = inside.copy(), inside.copy()
    if n:
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        heads = at[:-1][at[:-1] < at[1:]]
        first[heads] = inside[heads]
        tails = at[1:][at[:-1] < at[1:]] - 1
        last[tails] = inside[tails]
    return np.flatnonzero(first), np.flatnonzero(last) + 1, inside


def words(raw: np.ndarray, at: np.ndarray, outside: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Starts, ends, text index and code of every word, and the distinct words by code."""
    starts, ends, inside = segments(raw, at, outside)
    codes, vocabulary = dictionary(raw[inside], np.concatenate([[0], np.cumsum(ends - starts)]))
    return starts, ends, owners(at, starts), codes, vocabulary


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of `size` consecutive values (windows across texts included)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    factor = _BASE
    with np.errstate(over="ignore"):
        for k in range(size):
            out += mix(hashes[k : k + n] ^ factor) * factor
            factor = factor * _BASE + U(2)
    return mix(out)


#: Planes with letters, numbers or white space; the others are private or unassigned.
PLANES = [*range(0x40000), *range(0xE0000, 0xE1000)]


@cache
def classes() -> np.ndarray:
    """Of each code point: 0 white space, 1 letter, 2 number, 3 other; as the tokenizers library's expressions see them,
    whose Unicode tables are not those of Python."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    places = np.array([c for c in PLANES if not 0xD800 <= c < 0xE000])
    text = "".join(map(chr, places.tolist()))
    out = np.full(0x110000, 3, np.uint8)
    for kind, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (0, r"\s+")):
        for _, (start, end) in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
            out[places[start:end]] = kind
    return out


def codepoints(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """The code points of valid UTF-8, and the place of the first byte of each (None: all have one byte)."""
    text = raw.tobytes()
    if text.isascii():
        return raw, None
    return np.frombuffer(text.decode().encode("utf-32-le"), np.uint32), np.flatnonzero((raw & 0xC0) != 0x80)


def _contractions(cp: np.ndarray, first: np.ndarray, at: np.ndarray, kind: np.ndarray, candidates: np.ndarray) -> None:
    """Move the bounds of runs for 's 't 'm 'd 're 've 'll at the candidate apostrophes."""
    if not len(candidates):
        return
    stop = at[owners(at, candidates) + 1]
    pad = np.concatenate([cp, np.zeros(3, cp.dtype)])
    one, two = pad[candidates + 1], pad[candidates + 2]
    one = np.where(candidates + 1 < stop, one, 0)
    two = np.where(candidates + 2 < stop, two, 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    for hit, size in ((short, 1), (long, 2)):
        q = candidates[hit]
        first[q + 1] = False
        after = q + 1 + size
        after = after[after < stop[hit]]
        first[after[kind[after] == 1]] = True


def clip_pieces(cp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of contractions, letter runs, single numbers and runs of other symbols; white space is left out."""
    kind = classes()[cp]
    inside = kind > 0
    first = inside.copy()
    if len(cp):
        first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        heads = at[:-1][at[:-1] < at[1:]]
        first[heads] = inside[heads]
        _contractions(cp, first, at, kind, np.flatnonzero(first & (cp == 39)))
    starts = np.flatnonzero(first)
    # a piece's length: the code points inside pieces from its start to the next start
    return starts, np.diff(np.concatenate([np.cumsum(inside)[starts] - 1, [inside.sum()]])) if len(starts) else np.zeros(0, np.int64)


def gpt_pieces(cp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the pieces of byte-level pre-tokenisation; they cover all code points."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[cp]
    space = kind == 0
    head = np.zeros(n + 1, bool)
    head[at] = True
    before = np.concatenate([[False], space[:-1]]) & ~head[:n]  # the code point before, in the same text, is white space
    plain = np.concatenate([[False], cp[:-1] == 0x20]) & ~head[:n]
    follows = np.concatenate([~space[1:], [False]]) & ~head[1:]  # another code point follows in the same text, not white space
    changed = np.concatenate([[True], kind[1:] != kind[:-1]]) | head[:n]
    first = np.where(space, ~before | follows, np.where(before, ~plain, changed))
    _contractions(cp, first, at, kind, np.flatnonzero(first & (cp == 39)))
    starts = np.flatnonzero(first)
    return starts, np.diff(np.concatenate([starts, [n]]))


class Memo:
    """Runs of numbers by word, of bounded size: when it is full, only what was asked for again stays."""

    def __init__(self, limit: int, dtype):
        self.limit, self.dtype = limit, dtype
        self.index: dict[str, int] = {}
        self.begin = self.size = np.zeros(0, np.int64)
        self.flat, self.again = np.zeros(0, dtype), np.zeros(0, bool)

    def get(self, keys: list, make: Callable[[list], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and size of each (distinct) key's run, and the numbers that they lie in.

        make: sizes and numbers, one after another, of keys that are not known.
        """
        at = np.fromiter(map(self.index.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(at < 0)
        self.again[at[at >= 0]] = True
        if len(new):
            fresh = [keys[i] for i in new.tolist()]
            size, flat = make(fresh)
            at[new] = np.arange(len(new)) + len(self.index)
            self.index.update(zip(fresh, at[new].tolist(), strict=True))
            self.begin = np.concatenate([self.begin, np.cumsum(size) - size + len(self.flat)])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, flat.astype(self.dtype, copy=False)])
            self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
        begin, size, flat = self.begin[at], self.size[at], self.flat
        if len(self.index) > self.limit:
            self._forget()
        return begin, size, flat

    def _forget(self) -> None:
        stay = np.flatnonzero(self.again)
        if len(stay) > self.limit // 2:
            stay = stay[:0]
        known = list(self.index)
        self.index = {known[i]: k for k, i in enumerate(stay.tolist())}
        self.flat = self.flat[spread(self.begin[stay], self.size[stay])]
        self.size = self.size[stay]
        self.begin, self.again = np.cumsum(self.size) - self.size, np.zeros(len(stay), bool)


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of every run, one run after another."""
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)
