"""Lexical, vector and hybrid search over documents. Semantics are this project's own.

Tokens are runs of a-z in the lower-cased text. BM25 has k1 = 1.2 and b = 0.75. Scores are rounded
before ranking and ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ..sources.scratch import cut

K1, B, DIGITS = 1.2, 0.75, 6
BLOCK = 4096  # vectors of a block
LANE_BLOCKS = 8  # blocks of vectors that a task compares with one block of queries
SLICE = 256  # queries compared at once


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z]+)"), 1)


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term, doc_id and term frequency: the inverted index."""
    terms = docs.select(F.col(id_col).alias("doc_id"), F.explode(tokens(F.col(text_col))).alias("term"))
    return terms.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def edges(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """source, target and weight of the graph of terms: how often two different terms stand side by side, in either order."""
    toks = docs.select(tokens(F.col(text_col)).alias("toks")).withColumn("n", F.greatest(F.size("toks") - 1, F.lit(0)))
    pairs = toks.select(F.explode(F.arrays_zip(F.slice("toks", 1, F.col("n")).alias("a"), F.slice("toks", 2, F.col("n")).alias("b"))).alias("p")).select("p.a", "p.b").filter("a <> b")
    return pairs.groupBy(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target")).agg(F.count("*").alias("weight"))


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.size(tokens(F.col(text_col))).alias("n_tokens"))


def bm25(docs: DataFrame, terms: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every document that has a query term.

    Each text is tokenised once: lengths and the counts of the query's terms are written to the
    shared folder, and both the statistics and the scores come from there.
    """
    wanted = list(dict.fromkeys(terms))
    toks = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("toks"))
    counted = cut(toks.select("doc_id", F.size("toks").alias("n_tokens"), *(F.size(F.filter("toks", _equals(t))).alias(f"tf_{i}") for i, t in enumerate(wanted))))
    stats = counted.agg(F.count("*").alias("n"), F.avg("n_tokens").alias("mean"), *(F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(wanted))))
    both = counted.filter(" OR ".join(f"tf_{i} > 0" for i in range(len(wanted)))).join(F.broadcast(stats))  # stats is one row
    score = F.lit(0.0)
    for i in range(len(wanted)):
        tf, df = F.col(f"tf_{i}"), F.col(f"df_{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n_tokens") / F.col("mean")))).otherwise(0.0)
    return both.select("doc_id", F.round(score, DIGITS).alias("score"))


def _equals(term: str):
    return lambda x: x == F.lit(term)


def top(scored: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """The k best rows by score, ties to the smaller id."""
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def cosine(a: Column, b: Column) -> Column:
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return total(a, b) / (F.sqrt(total(a, a)) * F.sqrt(total(b, b)))


def _packed(rows: DataFrame, lanes: int, name: str, dtype: str) -> DataFrame:
    """Rows (id, vector) dealt evenly over `lanes` partitions, as blocks: vectors of one width side by side."""
    most = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lane, n = TaskContext.get().partitionId(), 0
        for b in batches:
            widths = pc.fill_null(pc.list_value_length(b.column("vector")), 0).to_numpy(zero_copy_only=False)
            for width in np.unique(widths).tolist():
                mine = np.flatnonzero(widths == width)
                for at in range(0, len(mine), most):
                    part = b.take(pa.array(mine[at : at + most]))
                    x = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(dtype)  # a null component is nan
                    cells = [lane, (lane << 32) + n, width, part.column("id").to_numpy().tobytes(), x.tobytes()]
                    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], [f"{name}_{c}" for c in ("lane", "block", "width", "ids", "data")])
                    n += 1

    schema = ", ".join(f"{name}_{c}" for c in ("lane int", "block long", "width int", "ids binary", "data binary"))
    # dealt once more by lane, so that blocks are read from shuffle files instead of packed again for each pair
    return rows.repartition(lanes).mapInArrow(run, schema).repartitionById(lanes, F.col(f"{name}_lane"))


def best_of_blocks(k: int, dtype: str, asked=None):
    """A function of mapInArrow: of pairs of blocks (columns q_ and v_: block, width, ids, data; the pairs of one query block
    side by side) the k nearest vectors of each query. asked: of unit vectors of queries, by list (column of that name),
    which are to be compared with its vectors; all where not given."""
    unit, none, gone, steps = 10**DIGITS, -2 * 10**DIGITS, -3 * 10**DIGITS, SLICE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(row: dict, c: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Ids, unit vectors and whether a vector has a direction, in the order of ids."""
            ids = np.frombuffer(row[f"{c}_ids"], np.int64)
            order = np.argsort(ids, kind="stable")
            x = np.frombuffer(row[f"{c}_data"], dtype).reshape(len(ids), row[f"{c}_width"])[order].astype(np.float64)
            ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            x[~ok] = 0
            x /= np.where(ok, np.abs(x).max(axis=1, initial=0), 1)[:, None]  # so that squares neither overflow nor vanish
            return ids[order], x / np.where(ok, np.sqrt(np.einsum("ij,ij->i", x, x)), 1)[:, None], ok

        def best(ids_q: np.ndarray, found: list[tuple]) -> pa.RecordBatch:
            at, ids, points = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((ids, -points, at))
            at, ids, points = at[order], ids[order], points[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            keep = (place < k) & (points > gone)
            at, ids, points = at[keep], ids[keep], points[keep]
            return pa.RecordBatch.from_arrays([pa.array(ids_q[at]), pa.array(ids), pa.array(points / unit, mask=points == none)], ["query_id", "vec_id", "score"])

        block, found = None, []
        for b in batches:
            for i in range(b.num_rows):
                row = {name: b.column(name)[i].as_py() for name in b.schema.names}
                if row["q_block"] != block:
                    if found:
                        yield best(ids_q, found)
                    block, found = row["q_block"], []
                    ids_q, x_q, ok_q = side(row, "q")
                    wanted = asked(x_q) if asked else None
                ids_v, x_v, ok_v = side(row, "v")
                n = len(ids_v)
                take = min(k, n)
                mine = np.flatnonzero(wanted[:, row["list"]]) if asked else np.arange(len(ids_q))
                for at in range(0, len(mine), steps):
                    s = mine[at : at + steps]
                    if row["q_width"] == row["v_width"]:
                        dots = x_q[s] @ x_v.T
                        points = np.copysign(np.floor(np.abs(dots) * unit + 0.5), dots).astype(np.int64)
                        points[~(ok_q[s, None] & ok_v)] = none
                    else:
                        points = np.full((len(ids_q[s]), n), none, np.int64)
                    points[ids_q[s, None] == ids_v] = gone
                    key = points * n + np.arange(n - 1, -1, -1)  # no two alike: ties go to the smaller id
                    top_ = np.argpartition(key, n - take, axis=1)[:, n - take :]
                    found.append((np.repeat(s, take), ids_v[top_].ravel(), np.take_along_axis(points, top_, axis=1).ravel()))
        if found:
            yield best(ids_q, found)

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, vec_id, score and rank of the k vectors nearest to each query by cosine, exactly.

    Queries and vectors are both cut into blocks; a task compares a block of queries with some
    blocks of vectors and gives only its k best rows a query, which are merged by query.

    Defined cases: a row without an id is neither query nor neighbour, and no row is its own
    neighbour. Null and zero vectors, vectors with null or non-finite components and pairs of
    different length have a null score and come last.
    """
    single = all(d.schema[vector_col].dataType.elementType == FloatType() for d in (queries, vectors))
    dtype, kind = ("float32", "array<float>") if single else ("float64", "array<double>")
    rows = lambda d: d.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("vector"))
    q, v = rows(queries), rows(vectors)
    least = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lanes_q, lanes_v = max(1, -(-q.count() // BLOCK)), max(least, -(-v.count() // (BLOCK * LANE_BLOCKS)))
    pairs = _packed(q, lanes_q, "q", dtype).hint("shuffle_replicate_nl").crossJoin(_packed(v, lanes_v, "v", dtype))
    scored = pairs.mapInArrow(best_of_blocks(k, dtype), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hybrid(lexical: DataFrame, semantic: DataFrame, alpha: float = 0.5) -> DataFrame:
    """doc_id and score: alpha times the semantic score plus the rest times the lexical one over its maximum."""
    lexical = cut(lexical)  # its maximum and its rows
    most = lexical.agg(F.max("score").alias("most"))
    scaled = lexical.join(F.broadcast(most)).select("doc_id", F.when(F.col("most") > 0, F.col("score") / F.col("most")).otherwise(0.0).alias("lex"))  # most is one row
    both = semantic.select("doc_id", F.col("score").alias("sem")).join(scaled, "doc_id", "full_outer")
    return both.select("doc_id", F.round(alpha * F.coalesce("sem", F.lit(0.0)) + (1 - alpha) * F.coalesce("lex", F.lit(0.0)), DIGITS).alias("score"))


def search(lexical: DataFrame, semantic: DataFrame | None, k: int, use_vectors: bool = True, alpha: float = 0.5) -> DataFrame:
    """The k best documents: of both scores, or of the lexical one alone if vectors are switched off or absent."""
    return top(hybrid(lexical, semantic, alpha) if use_vectors and semantic is not None else lexical, k)


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, position and text of the non-empty lines of every document."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("position", "section"))
    return lines.filter(F.length(F.trim("section")) > 0)


def filter_sections(found: DataFrame, terms: Sequence[str]) -> DataFrame:
    """The rows of sections() that have one of the terms as a token."""
    return found.filter(F.arrays_overlap(tokens(F.col("section")), F.array(*map(F.lit, terms)).cast("array<string>")))


def snippets(docs: DataFrame, terms: Sequence[str], length: int = 80, text_col: str = "text") -> DataFrame:
    """docs with snippet: `length` characters from the first query term, or from the beginning."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    hits = [F.nullif(F.instr(low, t), F.lit(0)) for t in terms]
    at = F.coalesce(F.array_min(F.filter(F.array(*hits), lambda x: x.isNotNull())), F.lit(1))
    return docs.withColumn("snippet", F.substring(F.coalesce(F.col(text_col), F.lit("")), at, F.lit(length)))
