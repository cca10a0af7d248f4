"""Alignment of the tokens of two vocabularies over the bytes that they stand for.

A is a byte-level BPE file of the tokenizers library, B a sentencepiece model. Each text is encoded
by both, after one space (which B adds itself). Cumulated token lengths give the byte offsets where
tokens end; the offsets that both have (intersect1d) cut the text into groups, which searchsorted
labels; at each cut the A tokens and the B tokens that end there are linked, each with each, by
repeated indices. The counts of id pairs come from a salted shuffle in two stages. A link is best if
its pair is the commonest of its B id. For the sums over a text's links, the pairs that hold more
than 1/HOT_PAIRS of all links (HOT_PAIRS at most, whatever the corpus) are broadcast; the others,
none of them hot, are joined by shuffle.

Words are encoded once while they stay in a memo of bounded size: A's pre-tokenisation cuts texts
into pieces, and no piece of B goes on after a space, so B's segments of spaces and what follows are
independent (a model of which this is not true is given whole texts).

Defined cases: null and empty texts, and texts whose tokens of A or B do not spell a space and the
text, have no tokens: zeros and an empty groups_sha256. Special token strings are plain text.
Repeated rows count, and are given, as often as they come. An empty table gives no rows. Texts are
taken whole. Extra columns are ignored. Ids may have any type.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .bpe import byte_letters
from .common import Tables, cut, hot, kept, slices, strings, utf8
from .wavelet import PieceCoder

SLICE = 1 << 20  # bytes of text that are aligned at once; several arrays of numbers a byte
MEMO_WORDS = 200_000
HOT_PAIRS = 1 << 18
SALTS = 16
SPACE = "▁"


class TokenBytes:
    """What each id of a vocabulary stands for."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.data[K.spread(self.begin[ids], self.size[ids])]


class ByteLevel(PieceCoder):
    """Vocabulary A; special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.cut = None
        self.memo.limit = MEMO_WORDS
        back = {c: b for b, c in enumerate(byte_letters())}
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        tokens = [b""] * (1 + max(names.values()))
        for name, i in names.items():
            tokens[i] = bytes(back[c] for c in name) if all(c in back for c in name) else name.encode()
        self.bytes = TokenBytes(tokens)


class Pieces:
    """Vocabulary B: ids of texts that begin with the space that the model adds."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = TokenBytes([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)])
        self.local = not any(SPACE in p.lstrip(SPACE) for p in names)
        self.space = self.model.piece_to_id(SPACE)
        self.memo = K.Memo(MEMO_WORDS, np.uint32)

    def _encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = self.model.encode([s[1:] for s in segments], num_threads=1)
        got = [x or [self.space] for x in got]  # a lone space: the model adds none to an empty text
        size = np.fromiter(map(len, got), np.int64, len(got))
        return size, np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum()))

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (each with its space before it), and how many each has."""
        head = np.zeros(len(raw) + 1, bool)
        head[at[:-1]] = True
        if self.local:
            space = raw == 0x20
            head[:-1] |= space & ~np.concatenate([[False], space[:-1]])
        starts = np.flatnonzero(head[:-1])
        which, distinct = K.dictionary(raw, np.append(starts, len(raw)))
        begin, size, flat = self.memo.get(distinct.cast(pa.large_string()).to_numpy(zero_copy_only=False).tolist(), self._encode)
        before = np.concatenate([[0], np.cumsum(size[which])])
        return flat[K.spread(begin[which], size[which])], np.diff(before[np.searchsorted(starts, at)])


def spelled_alike(raw: np.ndarray, at: np.ndarray, ids: np.ndarray, counts: np.ndarray, tokens: TokenBytes) -> np.ndarray:
    """Which texts the ids spell byte by byte."""
    upto = np.concatenate([[0], np.cumsum(tokens.size[ids])])[np.concatenate([[0], np.cumsum(counts)])]
    good = np.diff(upto) == np.diff(at)
    got, want = tokens.spell(ids[np.repeat(good, counts)]), raw[np.repeat(good, np.diff(at))]
    stops = np.cumsum(np.diff(at)[good])
    wrong = np.searchsorted(stops, np.flatnonzero(got != want), side="right")
    good[np.flatnonzero(good)[wrong]] = False
    return good


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Common cuts, the group of every A and B token, and the linked (A, B) tokens. ends: byte offsets, ascending."""
    once = lambda ends: ends[np.diff(ends, prepend=-1) > 0]
    cuts = np.intersect1d(once(ends_a), once(ends_b), assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    low_a, low_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    many_b = np.searchsorted(ends_b, cuts, side="right") - low_b
    links = (np.searchsorted(ends_a, cuts, side="right") - low_a) * many_b
    cut_of = np.repeat(np.arange(len(cuts)), links)
    nth = np.arange(len(cut_of)) - np.repeat(np.cumsum(links) - links, links)
    return cuts, group_a, group_b, low_a[cut_of] + nth // many_b[cut_of], low_b[cut_of] + nth % many_b[cut_of]


class Aligner:
    def __init__(self, paths: tuple[str, str]):
        self.a, self.b = ByteLevel(paths[0]), Pieces(paths[1])
        most = max(len(self.a.bytes.size), len(self.b.bytes.size))
        self.most = most
        self.marked = np.array([b"%d%s" % (i, mark) for mark in (b",", b"|", b";") for i in range(most)] + [None], object)

    def groups(self, ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n_groups: int) -> np.ndarray:
        """The decimal ids with the mark that follows each, A's then B's of every group."""
        in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        out = np.empty(len(ids_a) + len(ids_b), np.int64)
        last = lambda g: np.append(g[1:] != g[:-1], [True] * bool(len(g)))
        out[np.arange(len(ids_a)) + (np.cumsum(in_b) - in_b)[group_a]] = ids_a + self.most * last(group_a)
        out[np.arange(len(ids_b)) + np.cumsum(in_a)[group_b]] = ids_b + 2 * self.most * last(group_b)
        return self.marked[out]

    def texts(self, column: pa.Array) -> dict[str, pa.Array]:
        raw, at = utf8(strings(column))
        n = len(column)
        full = np.flatnonzero(np.diff(at) > 0)
        spaced = np.full(len(raw) + len(full), 0x20, np.uint8)
        inside = np.ones(len(spaced), bool)
        inside[at[:-1][full] + np.arange(len(full))] = False
        spaced[inside] = raw
        size = np.diff(at)[full] + 1
        bounds = np.concatenate([[0], np.cumsum(size)])
        ids, counts = [], []
        good = np.ones(len(full), bool)
        for coder in (self.a, self.b):
            i, c = coder.encode(spaced, bounds) if len(full) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            good &= spelled_alike(spaced, bounds, i, c, coder.bytes)
            ids.append(i)
            counts.append(c)
        ids = [i[np.repeat(good, c)].astype(np.int64) for i, c in zip(ids, counts, strict=True)]
        counts = [c[good] for c in counts]
        stops = np.cumsum(size[good])
        cuts, group_a, group_b, link_a, link_b = align(np.cumsum(self.a.bytes.size[ids[0]]), np.cumsum(self.b.bytes.size[ids[1]]))
        whole = full[good]

        def spread(values: np.ndarray) -> pa.Array:
            out = np.zeros(n, np.int64)
            out[whole] = values
            return pa.array(out)

        upto = np.searchsorted(cuts, stops, side="right")
        n_groups = np.diff(upto, prepend=0)
        pairs = (ids[0][link_a] << 32) | ids[1][link_b]
        of = np.repeat(np.arange(len(whole)), counts[0])[link_a]
        distinct, code = np.unique(pairs, return_inverse=True)
        keyed, times = np.unique(of * max(len(distinct), 1) + code, return_counts=True)
        owner = keyed // max(len(distinct), 1)
        per = np.zeros(n, np.int64)
        per[whole] = np.bincount(owner, minlength=len(whole))
        offsets = pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32))
        marked = self.groups(*ids, group_a, group_b, len(cuts)).tolist()
        tokens_upto = np.cumsum(counts[0] + counts[1]).tolist()
        digests, start = [""] * n, 0
        for t, stop in zip(whole.tolist(), tokens_upto, strict=True):
            digests[t] = hashlib.sha256(b"".join(marked[start:stop])[:-1]).hexdigest()
            start = stop
        return {
            "n_a": spread(counts[0]), "n_b": spread(counts[1]), "n_groups": spread(n_groups), "n_links": spread(np.bincount(of, minlength=len(whole))), "groups_sha256": pa.array(digests, pa.string()),
            "pairs": pa.ListArray.from_arrays(offsets, pa.array(distinct[keyed % max(len(distinct), 1)] if len(keyed) else np.zeros(0, np.int64))),
            "times": pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64))),
        }


COUNTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, counts, groups_sha256, and the distinct linked pairs (A id * 2^32 + B id) of every row with how often each comes."""
    narrow = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = T.StructType([T.StructField("row", T.LongType()), narrow.schema["doc_id"], *T.StructType.fromDDL(f"{COUNTS}, pairs array<long>, times array<long>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, row = kept(Aligner, (path_a, path_b)), TaskContext.get().partitionId() << 40
        for part in slices(batches, "text", SLICE):
            found = aligner.texts(part.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(part.num_rows)), part.column("doc_id"), *found.values()], schema.names)
            row += part.num_rows

    return narrow.mapInArrow(run, schema)


def pair_counts(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """pair and its links over all rows, summed by salted keys first."""
    flat = rows.select(F.pmod("row", F.lit(salts)).cast("int").alias("salt"), F.inline(F.arrays_zip("pairs", "times")))
    return flat.groupBy(F.col("pairs").alias("pair"), "salt").agg(F.sum("times").alias("n")).groupBy("pair").agg(F.sum("n").alias("n"))


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    spark = docs.sparkSession
    with Tables(spark, "alignment") as tables:
        rows = tables.cut(aligned(docs, path_a, path_b, id_col, text_col))
        counts = tables.cut(pair_counts(rows))
        b_id = F.col("pair").bitwiseAND((1 << 32) - 1)
        best = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))  # a row an id of B: as many as the vocabulary has
        facts = tables.cut(counts.withColumn("b", b_id).join(F.broadcast(best), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
        common, rare = hot(facts, "n", HOT_PAIRS)
        sent = common.toArrow().sort_by("pair")
        known = spark.sparkContext.broadcast((sent["pair"].to_numpy(), sent["n"].to_numpy(), sent["best"].to_numpy()))
        summed = tables.cut(_sums(rows, known))
        flat = summed.select("row", F.inline(F.arrays_zip("pairs", "times"))).join(rare, F.col("pairs") == F.col("pair"))
        more = flat.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
        plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
        return cut(summed.drop("pairs", "times").join(more, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "more_best"), plus("count_sum", "more_sum"), "groups_sha256"))


def _sums(rows: DataFrame, known) -> DataFrame:
    """Sums over the pairs that are broadcast; the other pairs stay."""
    schema = T.StructType([f for f in rows.schema.fields if f.name not in ("pairs", "times")] + T.StructType.fromDDL("n_best long, count_sum long, pairs array<long>, times array<long>").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = known.value
        for b in batches:
            lists, times = b.column("pairs"), b.column("times").flatten().to_numpy()
            pairs, lengths = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            at = np.concatenate([[0], np.cumsum(lengths)])
            place = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            is_hot = keys[place] == pairs if len(keys) else np.zeros(len(pairs), bool)
            per = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[at])
            hot_times = np.where(is_hot, times, 0)
            place = place if len(keys) else np.zeros(0, np.int64)
            n_best = per(hot_times * best[place]) if len(keys) else np.zeros(len(lengths), np.int64)
            total = per(hot_times * n[place]) if len(keys) else np.zeros(len(lengths), np.int64)
            left = pa.array(np.concatenate([[0], np.cumsum(~is_hot)])[at].astype(np.int32))
            rest = [pa.ListArray.from_arrays(left, pa.array(x[~is_hot])) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in schema.names[:-4]), pa.array(n_best), pa.array(total), *rest], schema.names)

    return rows.mapInArrow(run, schema)
