"""LM scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts of up to `order` bytes, kept as one table a level: context,
next symbol (a byte, or the end of the text) and how often it came in the training texts. Levels
below the longest follow by dropping a context's oldest byte and summing. Escapes are estimated by
method C: in a context with q distinct symbols and n occurrences a symbol of count c has c / (n + q)
and the escape q / (n + q), both after exclusion of the symbols of the longer context, which
costs nothing more. What was seen after a context was also seen after its suffixes, so the excluded
set of a level is just the set of the level above, and a level needs one join with its parent level
and one window over a context's rows (257 at most). Unseen contexts are passed over at no cost;
below the empty context all symbols that are left are alike.

A text's score is the sum over its positions of log10 P(symbol | the bytes before it), with one end
symbol. The probability of each distinct (context, symbol) of all texts is computed once, in the
trie's tables. Scoring tasks get those that hold more than 1/HOT of all positions (so HOT at most,
whatever the corpus) by broadcast; each text's other ones come by a join, where none is hot. The
same holds for the words of the base score. `adaptive_scores` has no training texts: each text
starts from nothing and learns from itself.

Defined cases: a null or empty text is an end symbol (and the end token) alone. A row without an id
is not held out. Repeated rows count, and are scored, as often as they come. Without training texts
every symbol has probability 1/257. Texts are taken whole. An empty table gives no rows. Extra
columns are ignored. Ids may have any type.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .common import Tables, Tally, cut, free_worker, hot, slices, strings, utf8

ORDER = 4
END = 256
SYMBOLS = 257
SYM_BITS, LEN_BITS = 9, 3
HEAD = SYM_BITS + LEN_BITS
HOT_GRAMS = 1 << 21  # 16 bytes each
HOT_WORDS = 1 << 18
END_TOKEN = b" "  # no word holds a space


def grams(raw: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """Every position's context, its length and the symbol there, as one number; a text has one position more than bytes."""
    texts = len(at) - 1
    size = len(raw) + texts
    symbols = np.full(size, END, np.int64)
    ends = at[1:] + np.arange(texts)
    inside = np.ones(size, bool)
    inside[ends] = False
    symbols[inside] = raw
    begin = at[:-1] + np.arange(texts)
    length = np.full(size, order, np.int64)
    for k in range(order):
        here = begin + k
        length[here[here <= ends]] = k
    context = np.zeros(size, np.int64)
    for k in range(1, order + 1):
        if k < size:
            context[k:] |= (symbols[:-k] & 0xFF) << (8 * (k - 1))
    masks = np.array([(1 << 8 * k) - 1 for k in range(order + 1)], np.int64)
    return ((context & masks[length]) << HEAD) | (length << SYM_BITS) | symbols


def is_held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_codes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The text and code of every word (A-Z lower-cased), and the distinct words."""
    _, _, of, codes, vocabulary = K.words(K.LOWER[raw], at)
    return of, codes, vocabulary


def corpus_counts(docs: DataFrame) -> DataFrame:
    """gram or word, n (in training texts) and n_all of every partial count. docs: held_out, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        found = {"gram": Tally(names=("n", "n_all")), "word": Tally(limit=1 << 19, names=("n", "n_all"))}

        def rows(kind: str, tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
            for t in tables:
                none = pa.nulls(t.num_rows, pa.int64() if kind == "word" else pa.binary())
                key = t["key"] if kind == "gram" else t["key"].cast(pa.binary())
                pair = [key, none] if kind == "gram" else [none, key]
                yield from pa.table([*pair, t["n"], t["n_all"]], ["gram", "word", "n", "n_all"]).to_batches(1 << 17)

        for part in slices(batches, "text"):
            out = part.column("held_out").to_numpy(zero_copy_only=False)
            for flag in (False, True):
                rest = part.filter(pa.array(out == flag))
                if not rest.num_rows:
                    continue
                raw, at = utf8(strings(rest.column("text")))
                counted = pc.value_counts(pa.array(grams(raw, at, ORDER)))
                n = counted.field("counts").to_numpy()
                yield from rows("gram", found["gram"].add(counted.field("values"), np.zeros_like(n) if flag else n, n))
                _, codes, vocabulary = word_codes(raw, at)
                words = pa.concat_arrays([vocabulary, pa.array([END_TOKEN], pa.large_binary())])
                n = np.append(np.bincount(codes, minlength=len(vocabulary)), rest.num_rows).astype(np.int64)
                yield from rows("word", found["word"].add(words, np.zeros_like(n) if flag else n, n))
        for kind, tally in found.items():
            yield from rows(kind, tally.rest())

    return docs.mapInArrow(run, "gram long, word binary, n long, n_all long")


def trie(counts: DataFrame, tables: Tables, order: int = ORDER) -> DataFrame:
    """gram, logp (log10) and n_all of every gram. counts: gram, n (in training texts, maybe 0) and n_all, one row a gram."""
    split = counts.select(
        F.shiftright("gram", HEAD).alias("ctx"),
        F.shiftright("gram", SYM_BITS).bitwiseAND((1 << LEN_BITS) - 1).cast("int").alias("len"),
        F.col("gram").bitwiseAND((1 << SYM_BITS) - 1).cast("int").alias("sym"),
        "n", "n_all",
    )
    levels: list[DataFrame] = [counts] * (order + 1)
    for k in range(order, -1, -1):
        own = split.filter(F.col("len") == k).select("ctx", "sym", "n", "n_all", F.lit(1).alias("own"))
        if k < order:
            longer = levels[k + 1].select(F.col("ctx").bitwiseAND((1 << 8 * k) - 1).alias("ctx"), "sym", "n", F.lit(0).cast("long").alias("n_all"), F.lit(0).alias("own"))
            own = own.unionByName(longer)
            own = own.groupBy("ctx", "sym").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"), F.max("own").alias("own"))
        levels[k] = tables.cut(own)
    group = Window.partitionBy("ctx")
    seen = F.col("n") > 0
    level = levels[0].withColumns({"total": F.sum("n").over(group), "kinds": F.count(F.when(seen, 1)).over(group)})
    rest = F.when(~seen, -F.log(F.lit(float(SYMBOLS)) - F.col("kinds")))
    first = F.when(F.col("total") == 0, F.lit(-math.log(SYMBOLS))).when(seen, F.log(F.col("n") / (F.col("total") + F.col("kinds")))).otherwise(F.log(F.col("kinds") / (F.col("total") + F.col("kinds"))) + rest)
    level = tables.cut(level.withColumns({"rest": rest, "p": first}))
    found = [level.withColumn("len", F.lit(0))]
    for k in range(1, order + 1):
        above = level.select(F.col("ctx").alias("short"), "sym", *(F.col(c).alias(f"up_{c}") for c in ("n", "total", "kinds", "rest", "p")))
        joined = levels[k].withColumn("short", F.col("ctx").bitwiseAND((1 << 8 * (k - 1)) - 1)).join(above, ["short", "sym"])
        joined = joined.withColumns({"total": F.sum("n").over(group), "kinds": F.count(F.when(seen, 1)).over(group), "shut": F.sum(F.when(seen, F.col("up_n")).otherwise(0)).over(group)})
        left = F.col("up_total") - F.col("shut") + F.col("up_kinds") - F.col("kinds")
        escape = F.when(F.col("up_kinds") > F.col("kinds"), F.log((F.col("up_kinds") - F.col("kinds")) / left)).otherwise(F.lit(0.0)) + F.col("up_rest")
        rest = F.when(~seen, F.when(F.col("up_n") > 0, F.log(F.col("up_n") / left)).otherwise(escape))
        p = F.when(F.col("total") == 0, F.col("up_p")).when(seen, F.log(F.col("n") / (F.col("total") + F.col("kinds")))).otherwise(F.log(F.col("kinds") / (F.col("total") + F.col("kinds"))) + rest)
        level = tables.cut(joined.select("ctx", "sym", "n", "n_all", "own", "total", "kinds", rest.alias("rest"), p.alias("p")))
        found.append(level.withColumn("len", F.lit(k)))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    gram = F.shiftleft("ctx", HEAD).bitwiseOR(F.shiftleft(F.col("len").cast("long"), SYM_BITS)).bitwiseOR(F.col("sym").cast("long"))
    return every.filter("own = 1").select(gram.alias("gram"), (F.col("p") / math.log(10)).alias("logp"), "n_all")


def ppm_scores(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and n_symbols of every row.

    held_out: whether a row is kept out of training (is_held_out of its id where not given).
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("doc_id"), (is_held_out(docs[id_col]) if held_out is None else held_out).alias("held_out"), docs[text_col].alias("text"))
    with Tables(spark, "ppm") as tables:
        partial = tables.cut(corpus_counts(rows.select("held_out", "text")))
        sums = [F.sum(c).alias(c) for c in ("n", "n_all")]
        words = tables.cut(partial.filter("word IS NOT NULL").groupBy("word").agg(*sums))
        logs = tables.cut(trie(tables.cut(partial.filter("gram IS NOT NULL").groupBy("gram").agg(*sums)), tables))
        whole = words.agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
        train_tokens, least = whole["n"] or 0, (whole["n"] or 0) + 1 * ((whole["v"] or 0) + 1)
        hot_grams, cold_grams = hot(logs, "n_all", HOT_GRAMS)
        hot_words, cold_words = hot(words, "n_all", HOT_WORDS)
        sent = hot_grams.select("gram", "logp").toArrow().sort_by("gram")
        known = hot_words.select("word", "n").toArrow()
        model = spark.sparkContext.broadcast((sent["gram"].to_numpy(), sent["logp"].to_numpy(), dict(zip(known["word"].to_pylist(), known["n"].to_pylist(), strict=True))))
        scored = tables.cut(_scan(rows, model, least))
        cold = scored.select("row", F.inline(F.arrays_zip("grams", "times"))).join(cold_grams, F.col("grams") == F.col("gram")).select("row", (F.col("times") * F.col("logp")).alias("score"), F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("known"))
        per_word = F.log10((F.col("n") + 1) / F.lit(float(least)))
        tail = scored.select("row", F.inline(F.arrays_zip("words", "word_times"))).join(cold_words, F.col("words") == F.col("word")).select("row", F.lit(0.0).alias("score"), (F.col("word_times") * per_word).alias("base"), F.when(F.col("n") > 0, F.col("word_times")).otherwise(0).alias("known"))
        more = cold.unionByName(tail).groupBy("row").agg(F.sum("score").alias("more_score"), F.sum("base").alias("more_base"), F.sum("known").alias("more_known"))
        plus = lambda a, b, zero: F.col(a) + F.coalesce(F.col(b), F.lit(zero))
        out = scored.drop("grams", "times", "words", "word_times").join(more, "row", "left").select(
            "doc_id", "held_out", "n_tokens", plus("n_known", "more_known", 0).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
            plus("base_score", "more_base", 0.0).alias("base_score"), plus("score", "more_score", 0.0).alias("score"), "n_symbols",
        )
        return cut(out)


def _scan(rows: DataFrame, model, least: int) -> DataFrame:
    """Each row's sums over what is broadcast, and what is not: its grams and words, with how often they come."""
    kinds = "held_out boolean, n_tokens long, n_symbols long, n_known long, base_score double, score double, grams array<long>, times array<long>, words array<binary>, word_times array<long>, row long"
    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL(kinds).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        free_worker()
        keys, logps, counts = model.value
        row = TaskContext.get().partitionId() << 40
        for part in slices(batches, "text"):
            raw, at = utf8(strings(part.column("text")))
            texts = part.num_rows
            coded = pa.array(grams(raw, at, ORDER)).dictionary_encode()
            index, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy()
            place = np.minimum(np.searchsorted(keys, distinct), max(len(keys) - 1, 0))
            is_hot = keys[place] == distinct if len(keys) else np.zeros(len(distinct), bool)
            value = np.where(is_hot, logps[place], 0.0) if len(keys) else np.zeros(len(distinct))
            begin = at[:-1] + np.arange(texts)
            score = np.add.reduceat(value[index], begin)
            missing = np.flatnonzero(~is_hot[index]) if not is_hot.all() else np.zeros(0, np.int64)
            cold, times, stops = _per_text(np.searchsorted(begin, missing, side="right") - 1, index[missing], len(distinct), texts)
            of, codes, vocabulary = word_codes(raw, at)
            spelled = vocabulary.to_pylist() + [END_TOKEN]
            of = np.concatenate([of, np.arange(texts)])
            codes = np.concatenate([codes, np.full(texts, len(spelled) - 1, np.int64)])
            n = np.array([counts.get(w, -1) for w in spelled], np.int64)
            base = np.bincount(of, weights=np.where(n >= 0, np.log10((np.maximum(n, 0) + 1) / least), 0.0)[codes], minlength=texts)
            known = np.bincount(of[n[codes] > 0], minlength=texts)
            lost = np.flatnonzero(n[codes] < 0)
            rare, word_times, word_stops = _per_text(of[lost], codes[lost], len(spelled), texts)
            lists = lambda stops, values: pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), part.column("held_out"), pa.array(np.bincount(of, minlength=texts)), pa.array(np.diff(at) + 1), pa.array(known), pa.array(base), pa.array(score),
                    lists(stops, pa.array(distinct[cold])), lists(stops, pa.array(times)),
                    lists(word_stops, pa.array([spelled[i] for i in rare.tolist()], pa.binary())), lists(word_stops, pa.array(word_times)),
                    pa.array(row + np.arange(texts)),
                ],
                schema.names,
            )
            row += texts

    return rows.mapInArrow(run, schema)


def _per_text(of: np.ndarray, codes: np.ndarray, kinds: int, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes of each text, how often each comes, and the offsets of the texts."""
    pairs, times = np.unique(of * np.int64(kinds) + codes, return_counts=True)
    stops = np.concatenate([[0], np.cumsum(np.bincount(pairs // kinds, minlength=texts))])
    return pairs % kinds, times, stops


class Adaptive:
    """The same model learning symbol by symbol from the text that it codes."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.counts: dict[bytes, dict[int, int]] = {}

    def code(self, history: bytes, symbol: int, learn: bool = True) -> float:
        """log10 of the symbol's probability after history."""
        p, shut = 0.0, {}
        contexts = [history[len(history) - k :] for k in range(min(self.order, len(history)), -1, -1)]
        for c in contexts:
            seen = self.counts.get(c)
            if not seen:
                continue
            total = sum(n for s, n in seen.items() if s not in shut)
            kinds = len(seen) - sum(s in seen for s in shut)
            if kinds and symbol in seen:
                p += math.log10(seen[symbol] / (total + kinds))
                break
            if kinds:
                p += math.log10(kinds / (total + kinds))
            shut = seen
        else:
            p -= math.log10(SYMBOLS - len(shut))
        if learn:
            for c in contexts:
                seen = self.counts.setdefault(c, {})
                seen[symbol] = seen.get(symbol, 0) + 1
        return p

    def text(self, data: bytes, learn: bool = True) -> float:
        return sum(self.code(data[max(0, i - self.order) : i], data[i] if i < len(data) else END, learn) for i in range(len(data) + 1))


def adaptive_scores(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_symbols and score (log10) of every row's adaptive code length; symbol by symbol in Python, so for few or short texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data = [(t or "").encode() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) + 1 for x in data], pa.int64()), pa.array([Adaptive(order).text(x) for x in data], pa.float64())], ["doc_id", "n_symbols", "score"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_symbols", T.LongType()), T.StructField("score", T.DoubleType())])
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)
