"""A positional inverted index in blocks, ranked search that skips blocks, phrase and proximity search.

Documents are cut into ranges of at most RANGE_DOCS as they come; a range's postings are made by the
task that has its documents, so no posting is shuffled on its own. A block is a row: one term in one
range, with the places of its documents in the range, term frequencies, token positions, and its
frontier: the (tf, length) pairs that no other pair of the block beats in both. From it follows, for
any mean length, the largest score that the term gives in the range. Blocks are sorted by term, so
that a search reads the row groups of its own terms; bounds are read without the postings.

A ranked search scores the ranges of the highest bounds first; only ranges whose bound reaches the
k-th score found there are read after that. Results are those of scoring every document.

Tokens are runs of a-z in the lower-cased text; positions count tokens from 0. Defined cases: a null
or empty text has no tokens, but counts as a document. Rows without an id are left out. Ids are long.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import B, DIGITS, K1, top

RANGE_DOCS = 4096
RANGE_BYTES = 8 << 20  # of text; a longer text is a range of its own
PROBES = 4  # ranges that are scored first, for each result asked for
BLOCKS = "term string, range long, n long, ords array<int>, tfs array<int>, positions array<int>, frontier array<struct<tf:int,len:int>>"
RANGES = "range long, n long, total long, ids array<long>, lens array<int>, versions array<string>"
BUILT = f"{BLOCKS}, total long, ids array<long>, lens array<int>, versions array<string>"  # blocks and ranges in one table
MARGIN = 10.0**-DIGITS


def _lists(stops: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]).astype(np.int32)), values)


def _tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Document and term of every token, and the terms. text: large_string in lower case, without nulls."""
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    inside = (raw >= 97) & (raw <= 122)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = at[:-1][at[:-1] < at[1:]]
    first[heads] = inside[heads]
    last[heads[heads > 0] - 1] = inside[heads[heads > 0] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.concatenate([[0], np.cumsum(ends - starts)])), pa.py_buffer(raw[inside])).dictionary_encode()
    return np.searchsorted(at, starts, side="right") - 1, words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist()


def frontier(term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places of the pairs that no pair of the same term beats with more occurrences in no longer a text. Ordered by term, then falling tf."""
    order = np.lexsort((length, -tf, term))
    t, n = term[order], length[order].astype(np.int64)
    # the least length among a term's pairs of higher tf: later terms lie below all earlier ones
    low = n + (t.max(initial=0) - t) * (n.max(initial=0) + 1)
    before = np.concatenate([[np.iinfo(np.int64).max], np.minimum.accumulate(low)[:-1]])
    return order[low < before]


def range_blocks(ids: np.ndarray, text: pa.Array, versions: pa.Array, range_id: int) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """The blocks of a range, and the range's row."""
    doc, term, terms = _tokens(text)
    lens = np.bincount(doc, minlength=len(ids)).astype(np.int32)
    position = np.arange(len(doc)) - (np.cumsum(lens) - lens)[doc]
    rank = np.argsort(np.argsort(np.array(terms, object), kind="stable"), kind="stable") if terms else np.zeros(0, np.int64)
    order = np.lexsort((doc, rank[term]))  # stable: positions ascend
    key, d = rank[term][order], doc[order]
    edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (d[1:] != d[:-1])])) if len(key) else np.zeros(0, np.int64)
    tf = np.diff(np.append(edge, len(key)))
    return _blocks(sorted(terms), key[edge], d[edge], tf, position[order], lens, range_id), _row(ids, lens, versions, range_id)


def _blocks(terms: list[str], term: np.ndarray, ords: np.ndarray, tf: np.ndarray, position: np.ndarray, lens: np.ndarray, range_id: int) -> pa.RecordBatch:
    """Blocks of a range from its postings in the order of terms and documents, and from the positions in that order."""
    per = np.bincount(term, minlength=len(terms))
    best = frontier(term, tf, lens[ords])
    pairs = pa.StructArray.from_arrays([pa.array(tf[best].astype(np.int32)), pa.array(lens[ords[best]])], ["tf", "len"])
    held = np.concatenate([[0], np.cumsum(tf)])[np.cumsum(per)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(terms, pa.string()), pa.array(np.full(len(terms), range_id)), pa.array(per), _lists(np.cumsum(per), pa.array(ords.astype(np.int32))), _lists(np.cumsum(per), pa.array(tf.astype(np.int32))),
            _lists(held, pa.array(position.astype(np.int32))), _lists(np.cumsum(np.bincount(term[best], minlength=len(terms))), pairs),
        ],
        ["term", "range", "n", "ords", "tfs", "positions", "frontier"],
    )


def _row(ids: np.ndarray, lens: np.ndarray, versions: pa.Array, range_id: int) -> pa.RecordBatch:
    one = lambda values: _lists(np.array([len(values)]), values)
    return pa.RecordBatch.from_arrays([pa.array([range_id]), pa.array([len(ids)]), pa.array([int(lens.sum())]), one(pa.array(ids)), one(pa.array(lens)), one(versions)], ["range", "n", "total", "ids", "lens", "versions"])


def _one_table(b: pa.RecordBatch) -> pa.RecordBatch:
    """Blocks or ranges with the columns of both."""
    integers = pa.list_(pa.int32())
    kinds = {"term": pa.string(), "range": pa.int64(), "n": pa.int64(), "ords": integers, "tfs": integers, "positions": integers, "frontier": pa.list_(pa.struct([("tf", pa.int32()), ("len", pa.int32())]))}
    kinds |= {"total": pa.int64(), "ids": pa.list_(pa.int64()), "lens": integers, "versions": pa.list_(pa.string())}
    there = dict(zip(b.schema.names, b.columns, strict=True))
    return pa.RecordBatch.from_arrays([there[n].cast(kind) if n in there else pa.nulls(b.num_rows, kind) for n, kind in kinds.items()], list(kinds))


def repack(blocks: pa.Table, docs: pa.Table) -> pa.Table:
    """One range (column `new` or `into`) from the blocks of several and from the documents that stay, a function of applyInArrow.

    blocks: segment, range, term, ords, tfs, positions. docs: segment, range, ord, doc_id, len, version.
    """
    docs = docs.sort_by([("segment", "ascending"), ("range", "ascending"), ("ord", "ascending")])
    number = docs["into"][0].as_py() if docs.num_rows else blocks["new"][0].as_py()
    one = lambda t, c: t[c].combine_chunks()
    lens = docs["len"].to_numpy().astype(np.int32)
    # a place in an old range is its offset there; `to` has the new place, or -1
    both = pa.concat_tables([t.select(["segment", "range"]) for t in (docs, blocks)])
    _, old = np.unique(np.rec.fromarrays([both["segment"].to_numpy(), both["range"].to_numpy()]), return_inverse=True)
    of_doc, of_block = old[: docs.num_rows], old[docs.num_rows :]
    flat = lambda c: (pc.list_value_length(one(blocks, c)).to_numpy(zero_copy_only=False).astype(np.int64), one(blocks, c).flatten().to_numpy())
    per, ords = flat("ords")
    tf, (_, position) = flat("tfs")[1].astype(np.int64), flat("positions")
    place = docs["ord"].to_numpy()
    width = int(max(place.max(initial=-1), ords.max(initial=-1))) + 1
    to = np.full((int(old.max(initial=-1)) + 1) * width, -1)
    to[of_doc * width + place] = np.arange(docs.num_rows)
    new = to[np.repeat(of_block, per) * width + ords]
    named = one(blocks, "term").dictionary_encode()
    terms = named.dictionary.to_pylist()
    rank = np.argsort(np.argsort(np.array(terms, object), kind="stable"), kind="stable") if terms else np.zeros(0, np.int64)
    term = np.repeat(rank[named.indices.to_numpy()], per)
    order = np.lexsort((new, term))
    order = order[new[order] >= 0]
    begin, size = (np.cumsum(tf) - tf)[order], tf[order]
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    kept, code = np.unique(term[order], return_inverse=True)  # terms of documents that are gone have no block
    by_name = sorted(terms)
    rows = [_blocks([by_name[t] for t in kept.tolist()], code, new[order], size, position[at], lens, number)]
    if docs.num_rows:
        rows.append(_row(docs["doc_id"].to_numpy(), lens, one(docs, "version"), number))
    return pa.Table.from_batches([_one_table(b) for b in rows])


def build(docs: DataFrame, range_docs: int = RANGE_DOCS, range_bytes: int = RANGE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks and ranges in one table (columns of both; `term` is null in a range's row), to be written once and split by reading."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.lower(text).alias("text"), F.md5(text.cast("binary")).alias("version"))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, rows, size = TaskContext.get().partitionId() << 32, [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, rows, size
            t = pa.Table.from_batches(held)
            column = lambda c, kind: t[c].cast(kind).combine_chunks()
            text = column("text", pa.large_string())
            for b in range_blocks(t["doc_id"].to_numpy(), text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text, column("version", pa.string()), number):
                yield _one_table(b)
            held.clear()
            number, rows, size = number + 1, 0, 0

        for b in batches:
            at, sizes = 0, np.cumsum(np.concatenate([[0], pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False)]))
            while at < b.num_rows:
                end = min(at + range_docs - rows, int(np.searchsorted(sizes, sizes[at] + range_bytes - size, side="right")) - 1, b.num_rows)
                if end <= at and held:
                    yield from flush()
                    continue
                end = max(end, at + 1)
                held.append(b.slice(at, end - at))
                rows, size, at = rows + end - at, size + int(sizes[end] - sizes[at]), end
                if rows >= range_docs or size >= range_bytes:
                    yield from flush()
        if held:
            yield from flush()

    return narrow.mapInArrow(run, BUILT)


def by_term(blocks: DataFrame, parts: int) -> DataFrame:
    """Blocks dealt by term and range, so that a term that every range has is not in one partition, and sorted so that files and row groups hold few terms."""
    return blocks.repartitionByRange(parts, "term", "range").sortWithinPartitions("term", "range")


def split(built: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks and ranges of what build() made."""
    names = lambda ddl: [c.strip().split(" ")[0] for c in ddl.replace("tf:int,len:int", "").split(",")]
    return built.filter("term IS NOT NULL").select(*names(BLOCKS)), built.filter("term IS NULL").select(*names(RANGES))


def impact(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


class Index:
    """Blocks and ranges of a snapshot, to search in. dead: range and ords (places of documents that are gone), one row a range."""

    def __init__(self, blocks: DataFrame, ranges: DataFrame, dead: DataFrame | None = None):
        spark = blocks.sparkSession
        self.blocks, self.ranges = blocks, ranges
        self.dead = dead if dead is not None else spark.createDataFrame([], "range long, gone array<int>, n_gone long, total_gone long")
        self.spark = spark

    def stats(self) -> tuple[int, int]:
        """Documents, and tokens in them."""
        there = self.ranges.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
        gone = self.dead.agg(F.sum("n_gone").alias("n"), F.sum("total_gone").alias("total")).first()
        return (there["n"] or 0) - (gone["n"] or 0), (there["total"] or 0) - (gone["total"] or 0)

    def frequencies(self, terms: Sequence[str]) -> dict[str, int]:
        """In how many documents each term is. Postings are read only in ranges with documents that are gone."""
        mine = self.blocks.filter(F.col("term").isin(list(terms)))
        every = mine.groupBy("term").agg(F.sum("n").alias("n"))
        lost = mine.join(self.dead, "range").groupBy("term").agg(F.sum(F.size(F.array_intersect("ords", "gone"))).alias("lost"))
        return {r["term"]: r["n"] - (r["lost"] or 0) for r in every.join(lost, "term", "left").collect()}  # a row a term asked for

    def bounds(self, weights: dict[str, float], mean: float) -> DataFrame:
        """range and the largest score that a document there can have, from the blocks' frontiers alone."""
        most = F.array_max(F.transform("frontier", lambda p: impact(p["tf"], p["len"], F.lit(mean))))
        weight = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))[F.col("term")]
        return self.blocks.filter(F.col("term").isin(list(weights))).groupBy("range").agg(F.sum(weight * most).alias("bound"))

    def scored(self, weights: dict[str, float], mean: float, chosen: DataFrame) -> DataFrame:
        """doc_id and score of the documents of the chosen ranges that have a term."""
        terms = list(weights)
        blocks = self.blocks.filter(F.col("term").isin(terms)).select("range", "term", "ords", "tfs").join(chosen.select("range"), "range", "left_semi")
        flat = blocks.select("range", "term", F.inline(F.arrays_zip("ords", "tfs")))
        per = flat.groupBy("range", "ords").agg(*(F.sum(F.when(F.col("term") == t, F.col("tfs")).otherwise(0)).alias(f"tf_{i}") for i, t in enumerate(terms)))
        gone = self.dead.select("range", F.explode("gone").alias("ords"))
        facts = self.ranges.join(chosen.select("range"), "range", "left_semi").select("range", F.posexplode(F.arrays_zip("ids", "lens")).alias("ords", "x")).select("range", "ords", "x.ids", "x.lens")
        whole = per.join(gone, ["range", "ords"], "left_anti").join(facts, ["range", "ords"])
        score = F.lit(0.0)
        for i, t in enumerate(terms):
            score = score + F.when(F.col(f"tf_{i}") > 0, F.lit(weights[t]) * impact(F.col(f"tf_{i}"), F.col("lens"), F.lit(mean))).otherwise(0.0)
        return whole.select(F.col("ids").alias("doc_id"), F.round(score, DIGITS).alias("score"))

    def ranked(self, terms: Sequence[str], k: int, probes: int = PROBES) -> DataFrame:
        """doc_id and score of the k best documents by BM25, ties to the smaller id."""
        from ..sources.scratch import cut

        n, total = self.stats()
        df = self.frequencies(terms)
        weights = {t: float(np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))) for t in dict.fromkeys(terms) if df.get(t, 0) > 0}
        if not weights or not n:
            return self.spark.createDataFrame([], "doc_id long, score double")
        mean = total / n
        bounds = cut(self.bounds(weights, mean))
        first = cut(bounds.orderBy(F.desc("bound"), "range").limit(max(1, probes)))
        found = cut(top(self.scored(weights, mean, first), k))
        least = found.agg(F.min("score").alias("s"), F.count("*").alias("n")).first()
        reach = bounds.join(first.select("range"), "range", "left_anti")
        if least["n"] >= k:
            reach = reach.filter(F.col("bound") >= least["s"] - MARGIN)
        self.opened = first.count() + reach.count()  # ranges whose postings are read
        return top(found.unionByName(self.scored(weights, mean, reach)), k)

    def matches(self, terms: Sequence[str], window: int | None = None) -> DataFrame:
        """doc_id, n_matches and first: of a phrase (window None), how often it stands and at which token first;
        else of all the terms within `window` tokens in any order, how many tokens end such a window, and where the first begins."""
        wanted = list(dict.fromkeys(terms))
        mine = self.blocks.filter(F.col("term").isin(wanted))
        whole = mine.groupBy("range").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted))  # from sorted keys, without postings
        lists = mine.join(whole.select("range"), "range", "left_semi").groupBy("range").agg(F.map_from_entries(F.collect_list(F.struct("term", F.struct("ords", "tfs", "positions")))).alias("by"))
        rows = lists.join(self.ranges.select("range", "ids"), "range").join(self.dead.select("range", "gone"), "range", "left")
        slots = [wanted.index(t) for t in terms]
        cells = [F.col("by")[F.lit(t)].alias(f"t{i}") for i, t in enumerate(wanted)]
        flat = rows.select("ids", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"), *cells)
        many = len(wanted)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    values = lambda c, i=i, b=b: b.column(c)[i].values.to_numpy(zero_copy_only=False)
                    part = []
                    for t in range(many):
                        cell = b.column(f"t{t}")
                        ords, tfs, position = (cell.field(f)[i].values.to_numpy(zero_copy_only=False).astype(np.int64) for f in ("ords", "tfs", "positions"))
                        part.append((np.repeat(ords, tfs) << 32) | position)
                    hits = _phrase(part, slots) if window is None else _near(part, window)
                    hits = hits[~np.isin(hits >> 32, values("gone"))]
                    of, at, times = np.unique(hits >> 32, return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(values("ids")[of]), pa.array(times), pa.array(hits[at] & 0xFFFFFFFF)], ["doc_id", "n_matches", "first"])

        return flat.mapInArrow(run, "doc_id long, n_matches long, first long")


def _phrase(places: list[np.ndarray], slots: list[int]) -> np.ndarray:
    """(document, position) of the first token of every phrase: the terms' lists, each moved back by its place, intersected."""
    hits = places[slots[0]]
    for i, s in enumerate(slots[1:], 1):
        moved = places[s][(places[s] & 0xFFFFFFFF) >= i] - i
        hits = np.intersect1d(hits, moved, assume_unique=True)
    return np.sort(hits)


def _near(places: list[np.ndarray], window: int) -> np.ndarray:
    """(document, position) where each window of at most so many tokens that has all terms begins: the shortest one for each token that ends it."""
    at = np.concatenate(places)
    term = np.repeat(np.arange(len(places)), [len(p) for p in places])
    order = np.argsort(at, kind="stable")
    at, term = at[order], term[order]
    begin = np.full(len(at), np.iinfo(np.int64).max)
    for t in range(len(places)):
        begin = np.minimum(begin, np.maximum.accumulate(np.where(term == t, at, -1)))
    fits = (begin >= 0) & (begin >> 32 == at >> 32) & (at - begin < window)
    return np.sort(begin[fits])


def snippets(matches: DataFrame, docs: DataFrame, size: int, around: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """matches with the tokens around the first match: up to `around` before it and after its `size` tokens."""
    from .search import tokens

    texts = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("toks"))
    begin = F.greatest(F.col("first") - around, F.lit(0))
    found = matches.join(texts, "doc_id")
    return found.withColumn("snippet", F.array_join(F.slice("toks", (begin + 1).cast("int"), (F.col("first") - begin + size + around).cast("int")), " ")).drop("toks")
