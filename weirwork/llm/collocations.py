"""Phrase collocations by packed n-gram keys.

Words are counted by language. Of the frequent ones, those that hold more than 1/COMMON of all words
(COMMON at most, whatever the corpus) get ids and are broadcast. Texts become runs of ids, broken at
the ends of pieces and at rare words; runs of two and three ids are packed into one 64-bit key each,
pre-summed by task, sorted by range partitions (Spark sorts 64-bit keys by radix) and counted run by
run. The tail, words that are frequent enough but not common, has no bound, so it is not broadcast:
tasks get a bitmap of BITMAP_BITS bits of it, in which a rare word may look frequent (its phrases
then fall at the count), and phrases with a tail word are counted by their spelling; none of them
can be hot. Three words are counted only if both their pairs are frequent, for which a second bitmap
of the same size stands. Bitmaps only leave out what cannot be a candidate: all counts are exact.

Defined cases: a null or empty text has no words; a null language is 'und', as a language of that
name. Repeated rows count as often as they come. An empty table, or one without candidates, gives no
rows. Texts are taken whole. Extra columns are ignored. Ties are broken down to the phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .common import Tables, Tally, cut, hot, lean, slices, strings, utf8

LEAST = 10  # occurrences of a candidate
TOP = 2000  # phrases of each language
COVERED = 50  # percent of a phrase's occurrences within one longer candidate
ID_BITS = 21
COMMON = (1 << 20) - 1
BITMAP_BITS = 27
SCALE = 1_000_000
SLICE = 1 << 20  # bytes of text that are taken apart at once
SORTED_KEYS = 1 << 20  # packed keys that a task sorts at once
OUTSIDE = np.zeros(256, bool)
OUTSIDE[list(b" \t.,;:!?\n\x0b\x0c\r")] = True
BREAK = OUTSIDE.copy()
BREAK[[0x20, 0x09]] = False
U = np.uint64


def sentence_words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Of every word of a slice: the code of (language, word), and whether it follows the one before in its piece;
    and by code the 'language TAB word' keys and the words."""
    raw, at = utf8(strings(part.column("text")))
    low = K.LOWER[raw]
    starts, _, of, codes, vocabulary = K.words(low, at, outside=OUTSIDE)
    piece = np.cumsum(BREAK[raw], dtype=np.int32)[starts] if len(starts) else np.zeros(0, np.int32)
    joined = np.zeros(len(starts), bool)
    joined[1:] = (piece[1:] == piece[:-1]) & (of[1:] == of[:-1])
    langs = part.column("lang").cast(pa.large_binary()).dictionary_encode()
    names, width = langs.dictionary, max(len(vocabulary), 1)
    both = langs.indices.to_numpy()[of] * np.int64(width) + codes
    if len(names) * width <= 16 * len(both):  # a table of all pairs is small
        there = np.zeros(len(names) * width, bool)
        there[both] = True
        pairs = np.flatnonzero(there)
        place = np.zeros(len(there), np.int32)
        place[pairs] = np.arange(len(pairs))
        codes = place[both]
    else:
        pairs, codes = np.unique(both, return_inverse=True)
    words = vocabulary.take(pa.array(pairs % width))
    return codes, joined, pc.binary_join_element_wise(names.take(pa.array(pairs // width)), words, pa.scalar(b"\t", pa.large_binary())), words


def word_counts(docs: DataFrame) -> DataFrame:
    """key ('language TAB word') and n of all words. docs: lang, text."""

    def batches_of(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            yield from pa.table([t["key"].cast(pa.binary()), t["n"]], ["key", "n"]).to_batches(1 << 17)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(1 << 18)
        for part in slices(batches, "text", SLICE):
            codes, _, keys, _ = sentence_words(part)
            yield from batches_of(tally.add(keys, np.bincount(codes, minlength=len(keys))))
        yield from batches_of(tally.rest())

    return docs.mapInArrow(run, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """2^bits bits in 64-bit parts, of which those at the upper bits of the given hashes (column h) are set."""
    place = F.shiftrightunsigned("h", 64 - bits)
    parts = hashes.select(place.alias("bit")).groupBy(F.shiftright("bit", 6).alias("part")).agg(F.expr("bit_or(shiftleft(1L, CAST(bit & 63 AS INT)))").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)  # as large for any input
    out[parts["part"].to_numpy()] = parts["bits"].to_numpy()
    return out.view(U)


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    places = hashes >> U(64 - 5 - len(bits).bit_length())
    return (bits[places >> U(6)] >> (places & U(63))) & U(1) == 1


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return K.mix(first ^ K.mix(second))


def hash_rows(keys: DataFrame) -> DataFrame:
    """h: the hash of the word in the only column, or of the pair of words in the two columns."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [K.hashes_of(c.cast(pa.large_binary())) for c in b.columns]
            yield pa.RecordBatch.from_arrays([pa.array((pair_hashes(*h) if len(h) > 1 else h[0]).view(np.int64))], ["h"])

    return keys.mapInArrow(run, "h long")


class Words:
    """What tasks get: keys and counts of common words by id (from 1), and the bitmap of the tail."""

    def __init__(self, keys: list[bytes], counts: list[int], tail: np.ndarray):
        self.keys, self.counts, self.tail = pa.array(keys, pa.large_binary()), np.array(counts, np.int64), tail
        self.hashes = K.hashes_of(self.keys)
        self.order = np.argsort(self.hashes, kind="stable")
        sorted_hashes = self.hashes[self.order]
        again = np.flatnonzero(sorted_hashes[1:] == sorted_hashes[:-1]) + 1
        self.others = {keys[i]: i + 1 for i in self.order[again].tolist()}  # words whose hash another one has: next to none

    def ids(self, keys: pa.Array) -> np.ndarray:
        """Ids of common words, 0 for all others; words are compared byte by byte."""
        if not len(self.keys) or not len(keys):
            return np.zeros(len(keys), np.int64)
        h = K.hashes_of(keys)
        place = self.order[np.minimum(np.searchsorted(self.hashes, h, sorter=self.order), len(self.order) - 1)]
        ids = np.where(pc.equal(self.keys.take(pa.array(place)), keys).to_numpy(zero_copy_only=False), place + 1, 0)
        if self.others:
            for i in np.flatnonzero(ids == 0).tolist():
                ids[i] = self.others.get(keys[i].as_py(), 0)
        return ids


def id_runs(docs: DataFrame, words) -> DataFrame:
    """Texts as 32-bit ids: common words above 0, 0 where a run breaks, below 0 (from -1) the place of a tail word among `tail` of the row."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        for part in slices(batches, "text", SLICE):
            codes, joined, keys, _ = sentence_words(part)
            ids = known.ids(keys)
            unknown = np.flatnonzero(ids == 0)
            tail = unknown[has(known.tail, K.hashes_of(keys.take(pa.array(unknown))))]
            ids[tail] = -1 - np.arange(len(tail))
            seq = np.zeros(len(codes) + int((~joined).sum()), "<i4")
            seq[np.arange(len(codes)) + np.cumsum(~joined)] = ids[codes]
            yield pa.RecordBatch.from_arrays([pa.array([seq.tobytes()], pa.binary()), pa.array([keys.take(pa.array(tail)).to_pylist()], pa.list_(pa.binary()))], ["ids", "tail"])

    return docs.mapInArrow(run, "ids binary, tail array<binary>")


def phrases(runs: DataFrame, words, size: int, pairs=None) -> DataFrame:
    """Partial counts n of the phrases of `size` words: by packed key, or by spelling where a word is of the tail.

    words, pairs: broadcast Words, and for three words the bitmap of frequent pairs.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        held: list[np.ndarray] = []
        spelled = Tally(1 << 17)

        def packed_rows() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate(held) if held else np.zeros(0, np.int64)
            held.clear()
            keys.sort()
            edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else keys
            n = np.diff(np.append(edge, len(keys)))
            yield from pa.table([pa.array(keys[edge]), pa.nulls(len(edge), pa.binary()), pa.array(n)], ["packed", "spelled", "n"]).to_batches(1 << 17)

        def spelled_rows(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
            for t in tables:
                yield from pa.table([pa.nulls(t.num_rows, pa.int64()), t["key"].cast(pa.binary()), t["n"]], ["packed", "spelled", "n"]).to_batches(1 << 17)

        for b in batches:
            for blob, tail in zip(b.column("ids"), b.column("tail"), strict=True):
                ids = np.frombuffer(blob.as_buffer(), "<i4").astype(np.int64)
                tail = tail.values.cast(pa.large_binary())
                good = ids != 0
                two = good[1:] & good[:-1]
                if size == 3:
                    at = np.flatnonzero(two)
                    h = np.concatenate([known.hashes, K.hashes_of(tail)])
                    h_of = lambda i: h[np.where(i > 0, i - 1, len(known.hashes) - 1 - i)]
                    two[at] = has(pairs.value, pair_hashes(h_of(ids[at]), h_of(ids[at + 1])))
                first = np.flatnonzero(two[1:] & two[:-1] if size == 3 else two)
                whole = np.ones(len(first), bool)
                for k in range(size):
                    whole &= ids[first + k] > 0
                at = first[whole]
                key = np.zeros(len(at), np.int64)
                for k in range(size):
                    key = (key << ID_BITS) | ids[at + k]
                held.append(key)
                if sum(map(len, held)) >= SORTED_KEYS:
                    yield from packed_rows()
                at = first[~whole]
                if len(at):
                    yield from spelled_rows(spelled.add(*_spell(known.keys, tail, ids, at, size)))
        yield from packed_rows()
        yield from spelled_rows(spelled.rest())

    return runs.mapInArrow(run, "packed long, spelled binary, n long")


def _spell(common: pa.Array, tail: pa.Array, ids: np.ndarray, at: np.ndarray, size: int) -> tuple[pa.Array, np.ndarray]:
    """Distinct phrases that begin at the places, spelled after their language, and how often each comes."""
    used, code = np.unique(np.concatenate([ids[at + k] for k in range(size)]), return_inverse=True)
    codes = code.reshape(size, -1)
    number = codes[0]
    for k in range(1, size):
        if k > 1:
            _, number = np.unique(number, return_inverse=True)
        number = number * np.int64(len(used)) + codes[k]
    _, first, n = np.unique(number, return_index=True, return_counts=True)
    keys = pa.concat_arrays([tail.take(pa.array(-1 - used[used < 0])), common.take(pa.array(used[used > 0] - 1))])  # as used: ascending
    words = pc.replace_substring_regex(keys.cast(pa.large_binary()), r"(?s)\A.*\t", "")
    names = [(keys if k == 0 else words).take(pa.array(codes[k][first])) for k in range(size)]
    return pc.binary_join_element_wise(*names, pa.scalar(b" ", pa.large_binary())), n.astype(np.int64)


def _runs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and sums n of the runs of equal keys that sum to `least` or more, over batches sorted by key."""
    last, held = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        keys, n = b.column("key").to_numpy(), b.column("n").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sums, heads = np.add.reduceat(n, first), keys[first]
        if last is not None:
            if heads[0] == last:
                sums[0] += held
            else:
                heads, sums = np.concatenate([[last], heads]), np.concatenate([[held], sums])
        last, held = heads[-1], sums[-1]
        heads, sums = heads[:-1], sums[:-1]
        yield heads[sums >= least], sums[sums >= least]
    if last is not None and held >= least:
        yield np.array([last]), np.array([held])


def frequent(partial: DataFrame, words, size: int, tables: Tables, least: int = LEAST) -> DataFrame:
    """lang, phrase, its words w, a and the counts f1, f2, .. of common words (else null) of the frequent phrases."""
    spark = partial.sparkSession
    count = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = partial.filter("packed IS NOT NULL").select(F.col("packed").alias("key"), "n").repartitionByRange(count, "key").sortWithinPartitions("key")
    counts = ", ".join(f"f{k + 1} long" for k in range(size))

    @lean
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        for keys, n in _runs(batches, least):
            ids = [((keys >> ((size - 1 - k) * ID_BITS)) & ((1 << ID_BITS) - 1)) - 1 for k in range(size)]
            names = [known.keys.take(pa.array(i)) for i in ids]
            names[1:] = [pc.replace_substring_regex(x, r"(?s)\A.*\t", "") for x in names[1:]]
            key = pc.binary_join_element_wise(*names, pa.scalar(b" ", pa.large_binary())).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([key, pa.array(n), *(pa.array(known.counts[i]) for i in ids)], out)

    out = ["key", "a", *(f"f{k + 1}" for k in range(size))]
    # runs are counted and named by one function: of two in a row each would hold a worker for every task
    by_key = packed.mapInArrow(name, f"key binary, a long, {counts}")
    spelled = partial.filter("spelled IS NOT NULL").groupBy(F.col("spelled").alias("key")).agg(F.sum("n").alias("a")).filter(F.col("a") >= least)

    @lean
    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        for b in batches:
            parts = [key.rpartition(b"\t") for key in b.column("key").to_pylist()]
            split = [phrase.split(b" ") for _, _, phrase in parts]
            f = []
            for k in range(size):
                ids = known.ids(pa.array([lang + b"\t" + w[k] for (lang, _, _), w in zip(parts, split, strict=True)], pa.large_binary()))
                f.append(pa.array(known.counts[ids - 1] if len(known.counts) else np.zeros(len(ids), np.int64), mask=ids == 0))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("a"), *f], out)

    found = tables.cut(by_key.unionByName(spelled.mapInArrow(look_up, f"key binary, a long, {counts}")))
    lang, phrase = F.regexp_extract(F.col("key").cast("string"), r"(?s)\A(.*)\t", 1), F.regexp_extract(F.col("key").cast("string"), r"([^\t]*)\z", 1)
    return found.select(lang.alias("lang"), phrase.alias("phrase"), F.split(phrase, " ").alias("w"), *found.columns)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best phrases of every language."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), docs[text_col].alias("text"))
    with Tables(spark, "collocations") as tables:
        words = tables.cut(word_counts(rows))
        common, tail = hot(words, "n", COMMON)
        tail = tail.filter(F.col("n") >= least)
        sent = common.filter(F.col("n") >= least).toArrow().sort_by([("n", "descending"), ("key", "ascending")])
        tail_bits = bitmap(hash_rows(tail.select("key")), BITMAP_BITS)
        known = spark.sparkContext.broadcast(Words(sent["key"].to_pylist(), sent["n"].to_pylist(), tail_bits))
        runs = tables.cut(id_runs(rows, known))
        two = tables.cut(frequent(tables.cut(phrases(runs, known, 2)), known, 2, tables, least))
        both = hash_rows(two.select(*(F.concat("lang", F.lit("\t"), F.col("w")[k]).cast("binary").alias(f"w{k}") for k in (0, 1))))
        pairs = spark.sparkContext.broadcast(bitmap(both, BITMAP_BITS))
        three = tables.cut(frequent(tables.cut(phrases(runs, known, 3, pairs)), known, 3, tables, least))
        scored = _scored(two, three, words.filter(F.col("n") >= least))
        # a pair is covered by a longer candidate that begins or ends with it
        inner = three.select("lang", F.col("a").alias("longer"), F.explode(F.array(*(F.array_join(F.slice("w", k, 2), " ") for k in (1, 2)))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        free = scored.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
        order = (F.desc("score"), F.desc("a"), "phrase")
        buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))  # a language's candidates meet only as its buckets' first
        ranked = free.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(buckets)))
        for keys in (["lang", "bucket"], ["lang"]):
            ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= top)
        ranked = ranked.withColumn("rank", F.col("place").cast("long"))
        totals = words.groupBy(F.regexp_extract(F.col("key").cast("string"), r"(?s)\A(.*)\t", 1).alias("lang")).agg(F.sum("n").alias("n"))
        return cut(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def _scored(two: DataFrame, three: DataFrame, words: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r and score of all candidates, by their lowest-scoring cut."""
    word_key = lambda k: F.concat(F.col("lang"), F.lit("\t"), F.col("w")[k - 1]).cast("binary")

    def counted(df: DataFrame, k: int) -> DataFrame:
        """Fill f<k> of words of the tail, which no common key is among."""
        c = f"f{k}"
        todo = df.filter(F.col(c).isNull()).drop(c).withColumn("word", word_key(k))
        found = todo.join(words.select(F.col("key").alias("word"), F.col("n").alias(c)), "word").drop("word")
        return df.filter(F.col(c).isNotNull()).unionByName(found)

    for k in (1, 2):
        two = counted(two, k)
    for k in (1, 3):
        three = counted(three, k)
    pair = two.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    for c, k in (("head", 1), ("last", 2)):
        three = three.withColumn("part", F.array_join(F.slice("w", k, 2), " ")).join(pair.withColumnRenamed("f", c), ["lang", "part"]).drop("part")
    score = lambda l, r: F.expr(f"(CAST(a AS DECIMAL(16,0)) * CAST(a AS DECIMAL(16,0)) * CAST({SCALE} AS DECIMAL(7,0))) DIV (CAST({l} AS DECIMAL(19,0)) * CAST({r} AS DECIMAL(19,0)))")  # noqa: E731, E741
    cut_of = lambda k, l, r: F.struct(score(l, r).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r"))  # noqa: E731, E741
    plain = lambda df, cuts: df.withColumn("best", cuts).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    return plain(two, cut_of(1, "f1", "f2")).unionByName(plain(three, F.least(cut_of(1, "f1", "last"), cut_of(2, "head", "f3"))))
