"""Token-ID output as one wavelet matrix file a shard.

A shard's ids are renamed by falling frequency, so that the upper bit-planes are nearly empty, and
laid out as a wavelet matrix: plane k holds bit k of every code in the order that stable partition
by the planes above has left. Each plane is cut into blocks that are compressed on their own, with
the number of ones before each block; access, rank, select, counting and occurrence lookup read
only the blocks they touch. The file also holds the alphabet and each document's id and length.

Layout: MAGIC, length of the header (8 bytes, little endian), header (JSON), then the parts that
the header names by offset and length.

Defined cases: a null or empty text is the end id alone. Documents without an id come first;
documents with the same id lie side by side in any order and each gets its own start. A text is
never cut: one longer than a shard makes its shard longer. An empty table makes no file and no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator, Mapping
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .common import cut, ids_back, ids_of, kept, partitions, slices, strings, utf8

MAGIC = b"WWM1"
BLOCK = 1 << 13  # bytes of a plane in a block
SHARD_BYTES = 16 << 20  # of text in each file, at least (the last of a range: at most)
RANGE_BYTES = 512 << 20  # of the scanned input, for each range of ids
MEMO_WORDS = 500_000
MOST_DENSE = 1 << 22  # ids below this are counted in an array
LINES = 20_000  # pieces that the library gets in one text


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


def build(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The file of one shard. ids: unsigned 32-bit; lengths: ids of each document."""
    symbols, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True) if len(ids) < 1 << 14 or ids.max() >= MOST_DENSE else _dense_unique(ids)
    order = np.argsort(-counts, kind="stable")
    code = np.empty(len(symbols), np.uint32)
    code[order] = np.arange(len(symbols), dtype=np.uint32)
    seq = code[inverse]
    if len(symbols) <= 1 << 16:
        seq = seq.astype(np.uint16)
    levels = max(1, int(max(len(symbols) - 1, 1)).bit_length())
    parts: list[bytes] = []
    where = 0

    def put(b: bytes) -> list[int]:
        nonlocal where
        parts.append(b)
        where += len(b)
        return [where - len(b), len(b)]

    header: dict = {
        "n": len(ids), "levels": levels, "block": BLOCK,
        "symbols": put(_pack(symbols[order].astype("<u4"))), "counts": put(_pack(counts[order].astype("<i8"))),
        "doc_ids": put(_pack(doc_ids.astype("<i8"))), "lengths": put(_pack(lengths.astype("<i8"))), "planes": [],
    }
    squeeze = zstandard.ZstdCompressor(level=1)
    for k in range(levels):
        bit = (seq & seq.dtype.type(1 << (levels - 1 - k))).astype(bool)
        packed = np.packbits(bit, bitorder="little")
        blocks, ones = [], []
        for i in range(0, len(packed), BLOCK):
            part = packed[i : i + BLOCK]
            ones.append(int(np.bitwise_count(part).sum()))
            raw = part.tobytes()
            small = squeeze.compress(raw)
            blocks.append(small if len(small) < len(raw) else raw)
        sizes = np.array([len(b) for b in blocks], "<i8")
        before = np.concatenate([[0], np.cumsum(ones)]).astype("<i8")
        header["planes"].append({"zeros": len(bit) - int(before[-1]), "data": put(b"".join(blocks)), "sizes": put(_pack(sizes)), "ones": put(_pack(before))})
        seq = np.concatenate([seq[~bit], seq[bit]])
    head = json.dumps(header).encode()
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *parts])


def _dense_unique(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    place = np.zeros(len(counts), np.uint32)
    place[symbols] = np.arange(len(symbols), dtype=np.uint32)
    return symbols, place[ids], counts[symbols]


class WaveletFile:
    """Reads a shard's file; blocks are decompressed when touched."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        size = int.from_bytes(data[4:12], "little")
        self.head = json.loads(data[12 : 12 + size])
        self.data, self.base = data, 12 + size
        self.n, self.levels = self.head["n"], self.head["levels"]
        part = lambda name, dtype: _unpack(self._part(self.head[name]), dtype)
        self.symbols, self.counts = part("symbols", "<u4"), part("counts", "<i8")
        self.doc_ids, self.lengths = part("doc_ids", "<i8"), part("lengths", "<i8")
        self.code = {int(s): i for i, s in enumerate(self.symbols)} if self.n else {}
        self.planes = []
        for p in self.head["planes"]:
            sizes = _unpack(self._part(p["sizes"]), "<i8")
            self.planes.append((p["zeros"], p["data"][0], np.concatenate([[0], np.cumsum(sizes)]), _unpack(self._part(p["ones"]), "<i8")))
        self.kept: dict[tuple[int, int], np.ndarray] = {}

    def _part(self, span: list[int]) -> bytes:
        return self.data[self.base + span[0] : self.base + span[0] + span[1]]

    def _block(self, k: int, b: int) -> np.ndarray:
        """The bytes of a block of plane k."""
        _, start, at, _ = self.planes[k]
        raw = self.data[self.base + start + at[b] : self.base + start + at[b + 1]]
        whole = min(self.head["block"], (self.n + 7) // 8 - b * self.head["block"])
        return np.frombuffer(raw if len(raw) == whole else zstandard.ZstdDecompressor().decompress(raw), np.uint8)

    def _bits(self, k: int, b: int) -> np.ndarray:
        """Ones before each bit of a block, and the total."""
        got = self.kept.get((k, b))
        if got is None:
            bits = np.unpackbits(self._block(k, b), bitorder="little")
            got = self.kept[k, b] = np.concatenate([[0], np.cumsum(bits)])
        return got

    def _ones(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        if i >= self.n:
            return self.n - self.planes[k][0]
        b, rest = divmod(i, self.head["block"] * 8)
        return int(self.planes[k][3][b] + self._bits(k, b)[rest])

    def _select(self, k: int, bit: int, j: int) -> int:
        """The place of the j-th (from 0) such bit of plane k."""
        before = self.planes[k][3]
        if not bit:
            before = np.minimum(np.arange(len(before)) * self.head["block"] * 8, self.n) - before
        b = int(np.searchsorted(before, j, side="right")) - 1
        ones = self._bits(k, b)
        local = ones if bit else np.arange(len(ones)) - ones
        return b * self.head["block"] * 8 + int(np.searchsorted(local, j - before[b], side="right")) - 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for k in range(self.levels):
            ones = self._ones(k, i)
            bit = self._ones(k, i + 1) - ones
            code = 2 * code + bit
            i = self.planes[k][0] + ones if bit else i - ones
        return int(self.symbols[code])

    def _range(self, symbol: int, i: int) -> tuple[int, int] | None:
        """Where the occurrences of a symbol among the first i ids lie after the last plane."""
        code = self.code.get(symbol)
        if code is None:
            return None
        low, high = 0, min(i, self.n)
        for k in range(self.levels):
            if (code >> (self.levels - 1 - k)) & 1:
                low, high = self.planes[k][0] + self._ones(k, low), self.planes[k][0] + self._ones(k, high)
            else:
                low, high = low - self._ones(k, low), high - self._ones(k, high)
        return low, high

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of a symbol among the first i ids."""
        found = self._range(symbol, i)
        return 0 if found is None else found[1] - found[0]

    def count(self, symbol: int) -> int:
        code = self.code.get(symbol)
        return 0 if code is None else int(self.counts[code])

    def select(self, symbol: int, j: int) -> int:
        """The place of the j-th (from 0) occurrence of a symbol."""
        if not 0 <= j < self.count(symbol):
            raise IndexError(j)
        i, code = self._range(symbol, self.n)[0] + j, self.code[symbol]
        for k in range(self.levels - 1, -1, -1):
            bit = (code >> (self.levels - 1 - k)) & 1
            i = self._select(k, bit, i - self.planes[k][0] if bit else i)
        return i

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, j) for j in range(self.count(symbol))]

    def ids(self) -> np.ndarray:
        """All ids: the partitions undone, from the last plane up."""
        codes = np.zeros(self.n, np.uint16 if len(self.symbols) <= 1 << 16 else np.uint32)
        for k in range(self.levels - 1, -1, -1):
            blocks = [self._block(k, b) for b in range(len(self.planes[k][2]) - 1)]
            bit = np.unpackbits(np.concatenate(blocks) if blocks else np.zeros(0, np.uint8), count=self.n, bitorder="little").view(bool)
            zeros = self.planes[k][0]
            out = np.empty_like(codes)
            out[~bit] = codes[:zeros]
            out[bit] = codes[zeros:] | codes.dtype.type(1 << (self.levels - 1 - k))
            codes = out
        return self.symbols[codes] if self.n else self.symbols


def split_special(raw: np.ndarray, at: np.ndarray, special: Mapping[str, int], cut: re.Pattern[bytes] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """The texts cut at special tokens, which leave empty parts: bytes, offsets of the parts, the text of each, and (part, id) of the special ones."""
    data = raw.tobytes()
    if cut is None or cut.search(data) is None:
        return raw, at, np.arange(len(at) - 1), []
    parts: list[bytes] = []
    of, marked = [], []
    for i, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        for k, part in enumerate(cut.split(data[s:e])):
            if k % 2:
                marked.append((len(parts), special[part.decode()]))
                part = b""
            parts.append(part)
            of.append(i)
    bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
    return np.frombuffer(b"".join(parts), np.uint8), bounds, np.array(of, np.int64), marked


def special_pattern(special: Iterable[str]) -> re.Pattern[bytes] | None:
    longest_first = sorted((re.escape(t.encode()) for t in special), key=len, reverse=True)
    return re.compile(b"(" + b"|".join(longest_first) + b")") if longest_first else None


class PieceCoder:
    """Ids of texts by the tokenizers library, each distinct piece encoded once while it is remembered."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.tokenizer.encode_special_tokens = True  # they are cut out before
        self.cut = special_pattern(self.special)
        self.memo = K.Memo(MEMO_WORDS, np.uint32)
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.newline = line[0] if len(line) == 1 else None

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece, and the ids. Pieces go to the library in lines of one text: a newline
        between them is a piece of its own there, and no other piece has its id."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        sizes = np.zeros(len(pieces), np.int64)
        blank = np.fromiter(map(str.isspace, pieces), bool, len(pieces))
        inline = np.flatnonzero(~blank) if self.newline is not None else np.zeros(0, np.int64)
        alone = np.flatnonzero(blank).tolist() if self.newline is not None else list(range(len(pieces)))
        order, runs = [], []
        for k in range(0, len(inline), LINES):
            part = inline[k : k + LINES]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join([pieces[i] for i in part.tolist()])], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(ids == self.newline)
            if len(stops) != len(part) - 1:
                alone += part.tolist()  # not as expected: piece by piece below
                continue
            sizes[part] = np.diff(np.concatenate([[-1], stops, [len(ids)]])) - 1
            order.append(part)
            runs.append(ids[ids != self.newline])
        if alone:
            got = [e.ids for e in self.tokenizer.encode_batch_fast([pieces[i] for i in alone], add_special_tokens=False)]
            sizes[alone] = [len(x) for x in got]
            order.append(np.array(alone, np.int64))
            runs.append(np.fromiter(chain.from_iterable(got), np.uint32, sum(map(len, got))))
        if not order:
            return sizes, np.zeros(0, np.uint32)
        # back in the order of the pieces
        order, flat = np.concatenate(order), np.concatenate(runs)
        begin = np.zeros(len(pieces), np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        return sizes, flat[K.spread(begin, sizes)]

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids (unsigned 32-bit) of the texts (UTF-8 bytes and offsets), and how many each text has."""
        texts = len(at) - 1
        raw, at, of, marked = split_special(raw, at, self.special, self.cut)
        cp, first = K.codepoints(raw)
        starts, _ = K.gpt_pieces(cp, at if first is None else np.searchsorted(first, at))
        starts = starts if first is None else first[starts]
        which, distinct = K.dictionary(raw, np.append(starts, len(raw)))
        begin, size, flat = self.memo.get(distinct.cast(pa.large_string()).to_numpy(zero_copy_only=False).tolist(), self.encode_pieces)
        begin, size = begin[which], size[which]
        if marked:
            flat = np.concatenate([flat, np.array([i for _, i in marked], np.uint32)])
            segment = np.concatenate([K.owners(at, starts), [s for s, _ in marked]])
            order = np.argsort(segment, kind="stable")
            begin = np.concatenate([begin, len(flat) - len(marked) + np.arange(len(marked))])[order]
            size = np.concatenate([size, np.ones(len(marked), np.int64)])[order]
            counts = np.bincount(of[segment[order]], weights=size, minlength=texts).astype(np.int64)
        else:
            before = np.concatenate([[0], np.cumsum(size)])
            counts = np.diff(before[np.searchsorted(starts, at)])
        return flat[K.spread(begin, size)], counts


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))
    return pafs.LocalFileSystem(), uri


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2, ranges: int | None = None, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write files of about shard_bytes of text to the folder (shared by all executors), in ascending doc_id order.

    Rows are sorted in ranges of ids; each task streams its range and cuts a file whenever enough
    text has come, so neither the plan nor a task's memory grows with the data, nor with rows that
    repeat an id. Returns part, shard (a file's place within its part), path, n_docs and n_tokens of
    each file. A task that runs again replaces its files.
    """
    spark = docs.sparkSession
    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    if ranges is None:
        ranges = partitions(spark, docs, RANGE_BYTES)
    spread = narrow.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part, shard = kept(PieceCoder, tokenizer_path), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        doc_ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        held = 0

        def write() -> pa.RecordBatch:
            nonlocal shard, held
            n = np.concatenate(lengths)
            data = build(np.concatenate(ids), np.concatenate(doc_ids), n)
            for x in (ids, doc_ids, lengths):
                x.clear()
            fs, top = _store(folder)
            fs.create_dir(top, recursive=True)
            name = f"shard-{part:06d}-{shard:04d}.wm"
            draft = f"{top}/{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(draft) as f:
                f.write(data)
            fs.move(draft, f"{top}/{name}")
            cells = ((part, pa.int32()), (shard, pa.int32()), (name, pa.string()), (len(n), pa.int64()), (int(n.sum()), pa.int64()))
            shard, held = shard + 1, 0
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in cells], ["part", "shard", "path", "n_docs", "n_tokens"])

        for rows in slices(batches, "text"):
            raw, at = utf8(strings(rows.column("text")))
            got, counts = coder.encode(raw, at)
            doc_ids.append(ids_of(rows.column("doc_id")))
            lengths.append(counts + 1)
            ids.append(np.insert(got, np.cumsum(counts), np.uint32(end_id)))
            held += len(raw)
            if held >= shard_bytes:
                yield write()
        if ids:
            yield write()

    return cut(spread.mapInArrow(run, "part int, shard int, path string, n_docs long, n_tokens long"))


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    files = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                fs, top = _store(folder)
                with fs.open_input_stream(f"{top}/{name}") as f:
                    file = WaveletFile(f.read())
                ids = file.ids().astype("<u4", copy=False)
                ends = np.cumsum(file.lengths)
                starts = ends - file.lengths
                crc = [zlib.crc32(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids_back(file.doc_ids), pa.array(starts + base), pa.array(file.lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(files).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
