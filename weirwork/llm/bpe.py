"""BPE encoding by a segment tree over adjacent pair ranks, and decoding.

The leaves of a word's tree hold (rank, position) of its adjacent symbol pairs; each inner node
holds the least of its children, so the root is the leftmost pair of lowest rank. A merge changes
three leaves (the pair itself and its neighbours), each with an update along one path to the root,
until no mergeable pair remains. Short words are merged side by side, one tree a row of an array;
long ones one by one in the same tree form.

A vocabulary file is read once a process. Distinct words are encoded once while they stay in a
memo of bounded size. Normalisation, splitting and special tokens follow the vocabulary file; classes
of characters come from the tokenizers library, and so does the normal form of texts with characters
on which Unicode tables differ.

Defined cases: a null text is an empty one (no ids, empty decoded text). Special token strings in
a text become their ids. Texts are never cut, whatever their length. Repeated rows are encoded
alike. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel as K
from .common import kept, slices, strings

NONE = np.int64(1) << np.int64(62)
PLACE_BITS = 20
PLACE = (1 << PLACE_BITS) - 1
SIDE_BY_SIDE = 65  # symbols of the longest word that is merged in an array
MEMO_WORDS = 150_000
SLICE = 2 << 20  # bytes of text that are taken apart at once; words are objects here


def byte_letters() -> list[str]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class MergeTable:
    """Ranks and results of symbol pairs, for arrays of pairs and for single ones."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + self.suffix] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.width = np.int64(len(self.tokens))
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.single = dict(zip(keys.tolist(), range(len(pairs)), strict=True))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; -1 where none merges."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


def _climb(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray) -> None:
    node = leaf >> 1
    while node.size and node[0] >= 1:
        tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
        node = node >> 1


def merge_side_by_side(table: MergeTable, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge words of at least two symbols, padded to one width. Returns symbols and which of them stay."""
    m, width = symbols.shape
    leaves = 1 << max(0, int(width - 2).bit_length())
    place = np.arange(width, dtype=np.int64)
    stays = place[None, :] < sizes[:, None]
    tree = np.full((m, 2 * leaves), NONE, np.int64)
    ranks = table.rank(symbols[:, :-1], symbols[:, 1:])
    real = (ranks >= 0) & stays[:, 1:]
    tree[:, leaves : leaves + width - 1] = np.where(real, (ranks << PLACE_BITS) | place[None, :-1], NONE)
    half = leaves
    while half > 1:
        half //= 2
        tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
    after = np.tile(place + 1, (m, 1))
    before = np.tile(place - 1, (m, 1))
    rows = np.flatnonzero(tree[:, 1] < NONE)
    while rows.size:
        root = tree[rows, 1]
        at = root & PLACE
        gone = after[rows, at]
        follow = after[rows, gone]
        symbols[rows, at] = table.result[root >> PLACE_BITS]
        stays[rows, gone] = False
        after[rows, at] = follow
        more = follow < sizes[rows]
        before[rows[more], follow[more]] = at[more]
        # the pair that has gone, if it was one
        lost = gone < width - 1
        r, leaf = rows[lost], leaves + gone[lost]
        tree[r, leaf] = NONE
        _climb(tree, r, leaf)
        # the pair that now begins here
        key = np.full(rows.size, NONE, np.int64)
        rank = table.rank(symbols[rows[more], at[more]], symbols[rows[more], follow[more]])
        key[more] = np.where(rank >= 0, (rank << PLACE_BITS) | at[more], NONE)
        leaf = leaves + np.minimum(at, leaves - 1)
        tree[rows, leaf] = key
        _climb(tree, rows, leaf)
        # the pair that now ends here
        has = before[rows, at] >= 0
        r, p, here = rows[has], before[rows[has], at[has]], at[has]
        rank = table.rank(symbols[r, p], symbols[r, here])
        tree[r, leaves + p] = np.where(rank >= 0, (rank << PLACE_BITS) | p, NONE)
        _climb(tree, r, leaves + p)
        rows = rows[tree[rows, 1] < NONE]
    return symbols, stays


def merge_one(table: MergeTable, symbols: list[int]) -> list[int]:
    """The same for one word of any length."""
    n = len(symbols)
    if n < 2:
        return symbols
    none = 1 << 100
    bits = n.bit_length() + 1
    low = (1 << bits) - 1
    leaves = 1 << (n - 1).bit_length()
    tree = [none] * (2 * leaves)
    width, ranks, results = int(table.width), table.single, table.result
    find = lambda a, b: ranks.get(a * width + b, -1)
    for i in range(n - 1):
        r = find(symbols[i], symbols[i + 1])
        if r >= 0:
            tree[leaves + i] = (r << bits) | i
    for k in range(leaves - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, key: int) -> None:
        k = leaves + i
        tree[k] = key
        k >>= 1
        while k:
            best = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == best:
                break
            tree[k] = best
            k >>= 1

    symbols = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = bytearray(b"\1") * n
    while tree[1] < none:
        root = tree[1]
        i, rank = root & low, root >> bits
        gone = after[i]
        follow = after[gone]
        symbols[i] = int(results[rank])
        alive[gone] = 0
        after[i] = follow
        put(gone, none)
        r = -1
        if follow < n:
            before[follow] = i
            r = find(symbols[i], symbols[follow])
        put(i, (r << bits) | i if r >= 0 else none)
        p = before[i]
        if p >= 0:
            r = find(symbols[p], symbols[i])
            put(p, (r << bits) | p if r >= 0 else none)
    return [s for s, a in zip(symbols, alive, strict=True) if a]


def encode_words(table: MergeTable, words: list[bytes]) -> list[list[int]]:
    """Ids of each non-empty word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(sizes)
    symbols = table.inner[raw]
    symbols[ends - 1] = table.final[raw[ends - 1]]
    begin = ends - sizes
    out: list[list[int]] = [[]] * len(words)
    lower = 1
    for width in (1, 3, 5, 9, 17, 33, SIDE_BY_SIDE):
        these = np.flatnonzero((sizes >= lower) & (sizes <= width))
        lower = width + 1
        if width == 1:
            for i in these.tolist():
                out[i] = [int(symbols[begin[i]])]
            continue
        for k in range(0, len(these), 16384):
            part = these[k : k + 16384]
            place = np.arange(width)[None, :]
            take = np.minimum(begin[part][:, None] + place, len(symbols) - 1)
            grid, stays = merge_side_by_side(table, symbols[take], sizes[part])
            flat = grid[stays].tolist()
            stop = np.cumsum(stays.sum(axis=1)).tolist()
            start = 0
            for i, e in zip(part.tolist(), stop, strict=True):
                out[i] = flat[start:e]
                start = e
    for i in np.flatnonzero(sizes > SIDE_BY_SIDE).tolist():
        out[i] = merge_one(table, symbols[begin[i] : ends[i]].tolist())
    return out


@cache
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


class Coded:
    """What is kept of a distinct word: number of ids, ids as text, ids decoded."""

    __slots__ = ("count", "decoded", "ids")

    def __init__(self, ids: list[int], table: MergeTable):
        self.count = len(ids)
        self.ids = " ".join(map(str, ids)).encode()
        self.decoded = decode(ids, table).encode()


def decode(ids: list[int], table: MergeTable) -> str:
    """What a tokenizer without a decoder makes of ids: its tokens, joined by spaces."""
    return " ".join([table.tokens[i] for i in ids])


@cache
def unsettled() -> np.ndarray:
    """Of each code point, whether the Unicode tables of Python and of the library may differ on it in composition or case:
    combining ones and those that Python does not know."""
    return np.fromiter((bool(unicodedata.combining(c)) or unicodedata.category(c) == "Cn" for c in map(chr, range(0x110000))), bool, 0x110000)


def normalise(text: str, library) -> str:
    """The text as the library's normaliser has it, but for white space. Composed text of settled characters needs no library."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFC", text) or unsettled()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
            return library.normalize_str(text)
        text = text.replace("Σ", "σ")  # lower case letter by letter, whatever follows
    return text.lower()


class WordCoder:
    """Encodes slices of texts with a word-end BPE vocabulary."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.table = merge_table(path)
        self.library = Tokenizer.from_file(path).normalizer
        self.memo: dict[bytes, Coded] = {}
        self.cut = re.compile("(" + "|".join(sorted(map(re.escape, self.table.special), key=len, reverse=True)) + ")") if self.table.special else None
        self.marks = {t: Coded([i], self.table) for t, i in self.table.special.items()}

    def words(self, distinct: list[bytes]) -> list[Coded]:
        """The coded form of distinct words; when the memo is full, only these stay in it."""
        coded: list[Coded | None] = list(map(self.memo.get, distinct))
        missing = [i for i, c in enumerate(coded) if c is None]
        if missing:
            for i, ids in zip(missing, encode_words(self.table, [distinct[i] for i in missing]), strict=True):
                coded[i] = self.memo[distinct[i]] = Coded(ids, self.table)
            if len(self.memo) > MEMO_WORDS:
                self.memo = dict(zip(distinct, coded, strict=True))
        return coded

    def pieces(self, texts: list[str]) -> tuple[list[Coded], np.ndarray, np.ndarray]:
        """Distinct coded words, the index among them of every word of the texts, and the text of every word."""
        parts: list[bytes] = []
        of, marked = [], []
        for i, text in enumerate(texts):
            if self.cut is not None and self.cut.search(text):
                for k, part in enumerate(self.cut.split(text)):
                    if k % 2:
                        marked.append((len(parts), self.marks[part]))
                        part = ""
                    parts.append(normalise(part, self.library).encode())
                    of.append(i)
            else:
                parts.append(normalise(text, self.library).encode())
                of.append(i)
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
        raw = np.frombuffer(b"".join(parts), np.uint8)
        cp, first = K.codepoints(raw)
        starts, _ = K.clip_pieces(cp, at if first is None else np.searchsorted(first, at))
        inside = K.classes()[cp] > 0
        width = 1 if first is None else np.diff(np.append(first, len(raw)))
        upto = np.concatenate([[0], np.cumsum(inside * width)])  # bytes inside words
        which, distinct = K.dictionary(raw[inside if first is None else np.repeat(inside, width)], np.append(upto[starts], upto[-1]))
        coded = self.words(distinct.to_numpy(zero_copy_only=False).tolist())
        segment = K.owners(at, starts if first is None else first[starts])
        if marked:
            which = np.concatenate([which, np.arange(len(marked)) + len(coded)])
            segment = np.concatenate([segment, [s for s, _ in marked]])
            coded = coded + [c for _, c in marked]
            order = np.argsort(segment, kind="stable")
            which, segment = which[order], segment[order]
        return coded, which, np.asarray(of, np.int64)[segment] if len(segment) else np.zeros(0, np.int64)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept(WordCoder, path)
        for part in slices(batches, "text", SLICE):
            texts = strings(part.column("text")).to_pylist()
            coded, which, of = coder.pieces(texts)
            counts = np.array([c.count for c in coded], np.int64)
            total = np.bincount(of, weights=counts[which], minlength=len(texts)).astype(np.int64) if len(which) else np.zeros(len(texts), np.int64)
            ids = np.array([c.ids for c in coded] + [None], object)[which].tolist()
            decoded = np.array([c.decoded for c in coded] + [None], object)[which].tolist()
            bounds = np.searchsorted(of, np.arange(len(texts) + 1)).tolist()
            spans = list(zip(bounds, bounds[1:], strict=False))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(total, pa.int64()),
                    pa.array([hashlib.sha256(b" ".join(ids[a:b])).hexdigest() for a, b in spans], pa.string()),
                    pa.array([hashlib.sha256(b" ".join(decoded[a:b])).hexdigest() for a, b in spans], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and the decoded text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept(WordCoder, path)
        for part in slices(batches, "text", SLICE):
            texts = strings(part.column("text")).to_pylist()
            coded, which, of = coder.pieces(texts)
            bounds = np.searchsorted(of, np.arange(len(texts) + 1)).tolist()
            words = which.tolist()
            ids = [[int(x) for w in words[a:b] for x in coded[w].ids.split()] for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([decode(x, coder.table) for x in ids], pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return narrow.mapInArrow(run, "doc_id long, ids array<int>, decoded string")
