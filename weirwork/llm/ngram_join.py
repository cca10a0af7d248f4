"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

A document's set holds the 64-bit hashes of its distinct word n-grams. Documents with equal sets form
one class; all further work is on classes. The global order puts rare n-grams first (by the number
of classes that have them, then by name). Whoever shares enough with another class must share one
of its first n-grams, and an n-gram that only one class has is shared with nobody: so a class whose
unshared n-grams fill its prefix links with none and goes no further.

1. Slices of texts become packed, sorted runs of (n-gram, class), dealt by ranges of n-gram hashes;
   each range counts its n-grams and passes on those that at least two classes have. Classes are
   collapsed before they travel, once a batch of slices. An n-gram that HOT or more classes of a
   batch have goes straight to its classes as one of the most frequent, and its range is only told
   so: no task gets more than HOT - 1 entries of one n-gram from a batch.
2. They are gathered by class, put in global order, and classes with no hope are dropped.
3. Candidates: within the bucket of each prefix n-gram every class meets one centre, and after
   each round only classes that are not yet connected meet others; at the end every pair of
   unconnected classes that shares a bucket has been compared, unless the places of what their
   prefixes share rule it out.
4. The global order is cut into fragments; the overlap of a candidate pair is counted in every
   fragment by itself and summed per pair. Links are judged by the exact counts.
5. Documents get their class's component by a join in which classes and components that hold more
   than a share of all rows (few, by their share) are broadcast, so none is a hot key.

What is exact: words and sets of n-grams are known by hashes, words and n-grams by 64 bits (one
in 2^51 names of those that travel as HOT), sets by 128 bits (by 64 of them where they go with
n-grams, which is checked). Two different n-grams of one pair of documents that agree in all bits
would change a count; nothing else rests on a hash.

Defined cases: null and empty texts have no n-grams, and each is a component of its own. A text of
fewer words than n has its whole sequence as its only n-gram. Repeated rows share a class. A null
id counts as no id: its row's component is the least id it is linked with, else null. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import NO_ID, Tables, cut, free_name, free_worker, ids_back, ids_of, partitions, skewed_join, slices, strings, utf8
from .graph import components, hooked

TOKEN_BITS = 52  # of an n-gram's name: the top one set and hash bits, or its range and number
DF_CAP = (1 << (63 - TOKEN_BITS)) - 1
FLUSH = 1_000_000
TASK_BYTES = 20 << 20  # of the scanned input, for each range of n-grams
FRAGMENTS = 4
PARITY = 512
BROADCAST_ROWS = 50_000  # pairs or class ids that are broadcast (under 2 MB); more are joined by shuffle
STAR_ROUNDS = 6
FEW_PAIRS = 100_000  # so many pairs of bucket members are compared at once, without a round of centres before
U = np.uint64
HOT = 64  # classes of one batch of slices: an n-gram that so many have does not travel by its range
SALTS = (U(0x243F6A8885A308D3), U(0x13198A2E03707344))
MOST_ID = (1 << 63) - 1
RUNS, DOCS, CLASSES, KEYS, HEAVY, TOLD = range(6)  # kinds of packed rows


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of integers, byte plane by byte plane, compressed."""
    squeeze, out = zstandard.ZstdCompressor(level=1), []
    for a in arrays:
        body = squeeze.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())
        out += [len(a).to_bytes(8, "little"), a.itemsize.to_bytes(1, "little"), len(body).to_bytes(8, "little"), body]
    return b"".join(out)


def _unpack(data: bytes) -> list[np.ndarray]:
    out, i, expand = [], 0, zstandard.ZstdDecompressor()
    while i < len(data):
        n, width, size = int.from_bytes(data[i : i + 8], "little"), data[i + 8], int.from_bytes(data[i + 9 : i + 17], "little")
        raw = np.frombuffer(expand.decompress(data[i + 17 : i + 17 + size]), np.uint8)
        out.append(np.array(raw.reshape(width, n).T, order="C").view(f"<u{width}").reshape(n))
        i += 17 + size
    return out


def shingle_sets(raw: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of every text (ascending within it), how many each has, and 128 bits of each set."""
    texts = len(at) - 1
    _, _, of, codes, vocabulary = K.words(K.LOWER[raw], at)
    hashes = K.hashes_of(vocabulary)[codes]
    words = np.bincount(of, minlength=texts)
    grams = K.windows(hashes, n)
    whole = np.flatnonzero(of[n - 1 :] == of[: len(grams)]) if len(grams) else np.zeros(0, np.int64)
    gram, owner = grams[whole], of[whole]
    short = np.flatnonzero((words > 0) & (words < n))
    if len(short):
        first = np.searchsorted(of, short)
        sums = np.zeros(len(short), U)
        for k in range(n - 1):
            has = words[short] > k
            sums[has] += K.mix(K.mix(hashes[first[has] + k]) ^ K.mix(np.full(has.sum(), k + 1, U)))
        gram, owner = np.concatenate([gram, K.mix(sums ^ words[short].astype(U))]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        gram, owner = gram[order], owner[order]
    stops = np.searchsorted(owner, np.arange(texts + 1)).tolist()
    for s, e in zip(stops, stops[1:], strict=False):
        gram[s:e].sort()
    fresh = np.ones(len(gram), bool)
    fresh[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    gram, owner = gram[fresh], owner[fresh]
    sizes = np.bincount(owner, minlength=texts)
    sets = np.zeros((texts, 2), U)
    some = sizes > 0
    if len(gram):
        begin = (np.cumsum(sizes) - sizes)[some]
        for i, salt in enumerate(SALTS):
            sets[some, i] = K.mix(np.add.reduceat(K.mix(gram ^ salt), begin) ^ sizes[some].astype(U))
    return gram, sizes, sets


def _gaps(ascending: np.ndarray) -> np.ndarray:
    """Ascending numbers as the first and the steps between them: of classes dealt over all ranges most have a top byte less."""
    return np.diff(ascending, prepend=U(0))


def _spread(keys: np.ndarray, parts: int) -> np.ndarray:
    return (K.mix(keys) % U(parts)).astype(np.int64)


def _rows(parts: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.int32()), pa.array([p[2] for p in parts], pa.binary())], ["part", "kind", "blob"]
    )


def parity_bits(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """PARITY bits (as longs) of each run of keys: the parity of the keys that fall on each bit.

    Two sets differ in at least as many keys as their bits do.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    odd = np.bincount(owner * PARITY + (K.mix(keys.view(U)) % U(PARITY)).astype(np.int64), minlength=len(sizes) * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _distinct(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the distinct rows of two columns, and the index among them of every row."""
    order = np.lexsort((sets[:, 1], sets[:, 0]))
    ranked = sets[order]
    fresh = np.ones(len(sets), bool)
    fresh[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    which = np.empty(len(sets), np.int64)
    which[order] = np.cumsum(fresh) - 1
    return order[fresh], which


def _runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours, and the end."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)


def shared_ngrams(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of documents (cls null), of all classes (n_docs not null) with the keys of those with hope, in global order."""
    spark = docs.sparkSession
    parts = partitions(spark, docs, TASK_BYTES)
    width = -(-(1 << 64) // parts)
    edges = np.array([b * width for b in range(1, parts)], U)
    number_bits = TOKEN_BITS - 1 - (parts - 1).bit_length()

    def by_class(kind: int, sets: np.ndarray, owner: np.ndarray, key: np.ndarray) -> list[tuple[int, int, bytes]]:
        """Packed keys for the task that gathers each class (owner: index into sets)."""
        target = _spread(sets[owner, 0], parts)
        order = np.lexsort((key, owner, target))
        target, owner, key = target[order], owner[order], key[order]
        cuts = np.searchsorted(target, np.arange(parts + 1))
        out = []
        for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            o, k = owner[cuts[b] : cuts[b + 1]], key[cuts[b] : cuts[b + 1]]
            head = _runs(o)
            out.append((b, kind, _pack(_gaps(sets[o[head[:-1]], 0]), np.diff(head).astype(np.uint32), k)))
        return out

    def flush(held: list[tuple]) -> pa.RecordBatch:
        gram, sizes, sets, ids = (np.concatenate([h[i] for h in held]) for i in range(4))
        first, which = _distinct(sets)
        least, copies = np.full(len(first), MOST_ID, np.int64), np.bincount(which, minlength=len(first))
        some = ids != NO_ID
        np.minimum.at(least, which[some], ids[some])
        out = []
        # one copy of each class sends its n-grams
        one = np.zeros(len(sizes), bool)
        one[first] = True
        owner = np.repeat(np.arange(len(sizes)), sizes)
        mine = one[owner]
        gram, owner = gram[mine], which[owner[mine]]
        sets_of, size_of = sets[first], sizes[first]
        order = np.argsort(gram, kind="stable")
        gram, owner = gram[order], owner[order]
        edge = _runs(gram)
        here = np.repeat(np.diff(edge), np.diff(edge))
        # what many classes have here goes to them at once, known by its hash; its range hears of it
        hot = here >= HOT
        out += by_class(HEAVY, sets_of, owner[hot], (U(DF_CAP) << U(TOKEN_BITS)) | U(1 << (TOKEN_BITS - 1)) | (gram[hot] >> U(64 - TOKEN_BITS + 1)))
        told = np.unique(gram[hot])
        cuts = [0, *np.searchsorted(told, edges).tolist(), len(told)]
        out += [(b, TOLD, _pack(told[cuts[b] : cuts[b + 1]])) for b in range(parts) if cuts[b + 1] > cuts[b]]
        gram, owner = gram[~hot], owner[~hot]
        cuts = [0, *np.searchsorted(gram, edges).tolist(), len(gram)]
        for b in range(parts):
            s, e = cuts[b], cuts[b + 1]
            if e > s:
                used, place = np.unique(owner[s:e], return_inverse=True)
                place = place.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32)
                out.append((b, RUNS, _pack(np.diff(gram[s:e], prepend=gram[s : s + 1]), gram[s : s + 1], place, _gaps(sets_of[used, 0]))))
        target = _spread(sets_of[:, 0], parts)
        for b in np.unique(target[size_of > 0]).tolist():
            these = np.flatnonzero((target == b) & (size_of > 0))
            out.append((b, CLASSES, _pack(sets_of[these, 0], sets_of[these, 1], size_of[these].astype(np.uint64), least[these].view(U), copies[these].astype(np.uint64))))
        target = _spread(ids.view(U) ^ sets[:, 1], parts)
        for b in np.unique(target).tolist():
            these = np.flatnonzero(target == b)
            out.append((b, DOCS, _pack(ids[these].view(U), sets[these, 0], sets[these, 1], sizes[these].astype(np.uint64))))
        return _rows(out)

    def to_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        size, held = 0, []
        for part in slices(batches, "text"):
            held.append((*shingle_sets(*utf8(strings(part.column("text"))), n), ids_of(part.column("doc_id"))))
            size += len(held[-1][0])
            if size >= FLUSH:
                yield flush(held)
                size, held = 0, []
        if held:
            yield flush(held)

    def blobs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        for b in batches:
            yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        grams, places, sets, told, base, here = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, U)], [np.zeros(0, U)], 0, 0
        for part, kind, blob in blobs_of(batches):
            if kind == RUNS:
                step, first, place, one = _unpack(blob)
                step[0] = first[0]
                grams.append(np.cumsum(step, dtype=U))
                places.append(place.astype(np.int64) + base)
                sets.append(np.cumsum(one, dtype=U))
                base += len(one)
                here = part
            elif kind == TOLD:
                told += _unpack(blob)
            else:
                yield _rows([(part, kind, blob)])
        gram, place, sets, told = np.concatenate(grams), np.concatenate(places), np.concatenate(sets), np.unique(np.concatenate(told))
        grams = places = None
        if not len(gram):
            return
        order = np.argsort(gram)
        gram, place = gram[order], place[order]
        # drop what only one run has before looking at classes
        again = gram[1:] == gram[:-1]
        heavy = told[np.minimum(np.searchsorted(told, gram), len(told) - 1)] == gram if len(told) else np.zeros(len(gram), bool)
        many = np.concatenate([[False], again]) | np.concatenate([again, [False]]) | heavy
        gram, place, heavy = gram[many], place[many], heavy[many]
        sets, which = np.unique(sets, return_inverse=True)
        sets, cls = sets[:, None], which[place]
        order = np.lexsort((cls, gram))
        gram, cls, heavy = gram[order], cls[order], heavy[order]
        fresh = np.ones(len(gram), bool)
        fresh[1:] = (gram[1:] != gram[:-1]) | (cls[1:] != cls[:-1])
        gram, cls, heavy = gram[fresh], cls[fresh], heavy[fresh]
        edge = _runs(gram)
        df = np.repeat(np.diff(edge), np.diff(edge))
        shared = (df > 1) | heavy
        gram, cls, df, heavy = gram[shared], cls[shared], df[shared], heavy[shared]
        if not len(gram):
            return
        # an n-gram is known by its range and its number there, a heavy one by its hash
        edge = _runs(gram)
        if len(edge) > 1 << number_bits:
            raise ValueError("too many n-grams in a range")
        number = np.repeat(np.arange(len(edge) - 1, dtype=U), np.diff(edge)) | (U(here) << U(number_bits))
        name = np.where(heavy, U(1 << (TOKEN_BITS - 1)) | (gram >> U(64 - TOKEN_BITS + 1)), number)
        key = (np.where(heavy, DF_CAP, np.minimum(df, DF_CAP)).astype(U) << U(TOKEN_BITS)) | name
        for row in by_class(KEYS, sets, cls, key):
            yield _rows([row])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        known, heads, runs, keys, here = [], [np.zeros(0, U)], [np.zeros(0, np.uint32)], [np.zeros(0, U)], 0
        for part, kind, blob in blobs_of(batches):
            here = part
            got = _unpack(blob)
            if kind == DOCS:
                null = pa.nulls(len(got[0]), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids_back(got[0].view(np.int64)), *(pa.array(x.view(np.int64)) for x in got[1:]), null, null, pa.nulls(len(null), pa.list_(pa.int64())), pa.nulls(len(null), pa.int32()), pa.nulls(len(null), pa.list_(pa.int64()))], names
                )
            elif kind == CLASSES:
                known.append(np.stack(got, axis=1))
            else:
                heads.append(np.cumsum(got[0], dtype=U))
                runs.append(got[1])
                keys.append(got[2])
        if not known:
            return
        known = np.concatenate(known)
        first, which = _distinct(known[:, :2])
        sets, sizes = known[first, :2], known[first, 2].astype(np.int64)
        least, copies = np.full(len(first), MOST_ID, np.int64), np.zeros(len(first), np.int64)
        np.minimum.at(least, which, known[:, 3].view(np.int64))
        np.add.at(copies, which, known[:, 4].astype(np.int64))
        cls = (here << 40) + np.arange(len(first), dtype=np.int64)
        # the keys of each class, in global order
        heads = np.concatenate(heads)
        short = sets[:, 0]
        if len(np.unique(short)) < len(sets):
            raise ValueError("two sets of n-grams agree in 64 bits, not in 128: choose other SALTS")
        _, which = np.unique(np.concatenate([short, heads]), return_inverse=True)
        owner, key = np.repeat(which[len(sets) :], np.concatenate(runs)), np.concatenate(keys)
        order = np.lexsort((key, owner))
        owner, key = owner[order], key[order]
        if len(key):  # a heavy one that its range has named too
            fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])
            owner, key = owner[fresh], key[fresh]
        start = np.searchsorted(owner, which[: len(sets)])
        shared = np.searchsorted(owner, which[: len(sets)], side="right") - start
        prefix = sizes - (percent * sizes + 99) // 100 + 1 - (sizes - shared)  # what is left of it after the unshared n-grams
        hope = (prefix > 0) & (shared > 0)
        for k in range(0, len(cls), 2000):
            these = np.arange(k, min(k + 2000, len(cls)))
            size = np.where(hope[these], shared[these], 0)
            some = key[K.spread(start[these], size)]
            bits = pa.array(parity_bits(some, size)) if size.any() else pa.array(np.zeros(len(these) * (PARITY // 64), np.int64))
            gone = pa.array(~hope[these])
            lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)])), pa.array(some.view(np.int64))).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(least[these], pa.int64(), mask=least[these] == MOST_ID), pa.array(sets[these, 0].view(np.int64)), pa.array(sets[these, 1].view(np.int64)), pa.array(sizes[these]), pa.array(cls[these]), pa.array(copies[these]),
                    pc.if_else(gone, pa.nulls(len(these), lists.type), lists), pa.array(np.minimum(prefix, shared)[these].astype(np.int32)), pa.FixedSizeListArray.from_arrays(bits, PARITY // 64).cast(pa.list_(pa.int64())),
                ], names,
            )

    names = ["doc_id", "set1", "set2", "n_shingles", "cls", "n_docs", "keys", "prefix", "bits"]
    blobs = "part int, kind int, blob binary"
    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    ranged = narrow.mapInArrow(to_ranges, blobs).repartitionById(parts, F.col("part"))
    gathered = ranged.mapInArrow(count, blobs).repartitionById(parts, F.col("part"))
    return gathered.mapInArrow(gather, "doc_id long, set1 long, set2 long, n_shingles long, cls long, n_docs long, keys array<long>, prefix int, bits array<long>")


def _small(rows: DataFrame) -> DataFrame:
    """A written table of two longs, marked for broadcast only if its rows are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def overlaps(pairs: DataFrame, classes: DataFrame, pivots: list[int], tables: Tables) -> DataFrame:
    """a, b, n_a, n_b and the number of shared n-grams, counted fragment by fragment."""
    bounds = [-1, *pivots, (1 << 63) - 1]

    def between(lo: int, hi: int):
        return F.filter("keys", lambda k: (k > F.lit(lo)) & (k <= F.lit(hi)))

    cuts = F.array(*(between(lo, hi) for lo, hi in zip(bounds, bounds[1:], strict=False)))
    # only classes of a pair are cut into fragments
    firsts, seconds = (_small(tables.cut(pairs.select(F.col(c).alias("cls")).distinct())) for c in ("a", "b"))
    left = classes.join(firsts, "cls", "left_semi").select(F.col("cls").alias("a"), F.col("n_shingles").alias("n_a"), F.posexplode(cuts).alias("fragment", "part_a"))
    right = classes.join(seconds, "cls", "left_semi").select(F.col("cls").alias("b"), F.col("n_shingles").alias("n_b"), F.posexplode(cuts).alias("fragment", "part_b"))
    each = left.join(_small(pairs), "a").join(right, ["b", "fragment"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("part_a", "part_b")).alias("part"))
    return each.groupBy("a", "b", "n_a", "n_b").agg(F.sum("part").alias("both"))


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, fragments: int = FRAGMENTS, rounds: int = STAR_ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links of at least percent/100) of every row."""
    with Tables(docs.sparkSession, "ngrams") as tables:
        found = tables.cut(shared_ngrams(docs, n, percent, id_col, text_col))
        rows = found.filter("cls IS NULL").select("doc_id", "set1", "set2", "n_shingles")
        known = found.filter("cls IS NOT NULL")
        classes = tables.cut(known.filter("keys IS NOT NULL").select("cls", "n_shingles", "keys", "prefix", "bits"))
        roots = class_roots(classes, percent, fragments, rounds, tables)
        # the least document of each class's component; most classes are alone
        linked = tables.cut(known.select("cls", "set1", "set2", "doc_id", "n_docs").join(roots, known["cls"] == roots["node"], "left").drop("node", "cls"))
        least = linked.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_rows"))
        least = skewed_join(linked.filter("root IS NOT NULL").select("root", "set1", "set2", "n_docs"), tables.cut(least), ["root"]).drop("root")
        # a document alone in its class is its own component if its class is
        alone = linked.filter("root IS NULL AND n_docs > 1").select("set1", "set2", "n_docs", F.col("doc_id").alias("least"))
        facts = tables.cut(least.unionByName(alone).withColumnRenamed("n_docs", "n_rows"))
        placed = skewed_join(rows.filter("n_shingles > 0"), facts, ["set1", "set2"]).select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
        return cut(placed.unionByName(rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))))


def class_roots(classes: DataFrame, percent: int, fragments: int, rounds: int, tables: Tables) -> DataFrame:
    """node (class) and root (a class of its component, the same for all) for all linked classes."""
    pivots = classes.select(F.explode("keys").alias("k")).agg(F.percentile_approx("k", [i / fragments for i in range(1, fragments)], 1000).alias("p")).first()["p"] or []
    pivots = sorted(set(pivots))
    # how far a class is from sharing all it has, in powers of two: those near 0 are the cores of their groups
    own = F.floor(F.log2(F.col("n_shingles") - F.size("keys") + 1)).cast("int").alias("own")
    buckets = classes.select("cls", "n_shingles", own, F.size("keys").alias("shared"), F.posexplode(F.slice("keys", F.lit(1), F.col("prefix"))).alias("place", "key"))
    # the first n-grams of a set, of which a set of at least its size must have one
    early = F.col("place") <= F.col("shared") - F.ceil(2 * percent * F.col("n_shingles") / (100 + percent))
    buckets = tables.cut(buckets.select("cls", "n_shingles", "own", "key", early.alias("early")))
    fits = lambda x, y: (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)
    judged = None  # a, b, linked
    labels = None  # classes of one label are known to be connected
    for turn in range(rounds + 1):
        now = buckets.withColumn("comp", F.col("cls")) if labels is None else buckets.join(labels, buckets["cls"] == labels["node"], "left").withColumn("comp", F.coalesce("label", "cls")).drop("node", "label")
        # of each bucket with several components: its largest, and one member of that, another each turn
        member = F.struct("own", F.xxhash64("cls", F.lit(turn)).alias("h"), F.col("cls").alias("b"), F.col("n_shingles").alias("n_b"))
        per = now.groupBy("key", "comp").agg(F.count("*").alias("members"), F.min(member).alias("m"))
        mixed = per.groupBy("key").agg(F.count("*").alias("comps"), F.sum("members").alias("members"), F.max(F.struct("members", "m", "comp")).alias("x")).filter("comps > 1")
        mixed = tables.cut(mixed.select("key", "members", F.col("x.comp").alias("centre"), F.col("x.m.b").alias("b"), F.col("x.m.n_b").alias("n_b")))
        size = mixed.agg(F.sum("members").alias("rows"), F.sum(F.col("members") * F.col("members")).alias("pairs")).first()
        if not size["rows"]:
            break
        # only buckets that are still mixed go on: a bucket of one component never mixes again
        buckets = tables.cut(now.join(mixed, "key").select("cls", "n_shingles", "own", "key", "early", "comp", "members", "centre", "b", "n_b"))
        open_, buckets = buckets, buckets.select("cls", "n_shingles", "own", "key", "early")
        last = turn == rounds or size["pairs"] <= FEW_PAIRS + 4 * size["rows"]
        if not last:
            met = open_.filter((F.col("comp") != F.col("centre")) & fits("n_shingles", "n_b"))
            tries = met.groupBy(F.col("cls").alias("a"), "b").agg(F.count("*").alias("times"))
            if judged is not None:
                tries = tries.join(judged.select("a", "b"), ["a", "b"], "left_anti")
            pairs = tries.groupBy("a").agg(F.max(F.struct("times", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
        else:
            pairs = _remaining(open_.select("key", "cls", "n_shingles", "comp", "early"), classes, judged, percent)
        either = F.col("n_a") + F.col("n_b") - F.col("both")
        done = overlaps(tables.cut(pairs), classes, pivots, tables).select("a", "b", (F.col("both") * 100 >= either * percent).alias("linked"))
        judged = tables.cut(done if judged is None else judged.unionByName(done))
        if last:
            break
        labels = tables.cut(hooked(judged.filter("linked"), tables))
    if judged is None:
        return classes.sparkSession.createDataFrame([], "node long, root long")
    return components(judged.filter("linked"), tables)


def _remaining(open_: DataFrame, classes: DataFrame, judged: DataFrame | None, percent: int) -> DataFrame:
    """All pairs of unconnected classes that share a bucket and may still be linked.

    The larger set of a pair is met in all of its prefix, the smaller one in its first n-grams
    only. A pair is given in the bucket of its first common n-gram, and only if neither parity bits
    of the sets nor the places of what both prefixes share rule it out.
    """
    prefixes = classes.select("cls", F.slice("keys", F.lit(1), F.col("prefix")).alias("head"), (F.col("n_shingles") - F.size("keys")).alias("own"), "bits")
    side = open_.join(prefixes, "cls")
    one = side.select("key", *(F.col(c).alias(f"{c}_1") for c in ("cls", "n_shingles", "comp", "head", "own", "bits")))
    two = side.filter("early").select("key", *(F.col(c).alias(f"{c}_2") for c in ("cls", "n_shingles", "comp", "head", "own", "bits")))
    ordered = F.struct("n_shingles_1", "cls_1") > F.struct("n_shingles_2", "cls_2")
    common = F.array_intersect("head_1", "head_2")
    least_last = F.least(F.element_at("head_1", -1), F.element_at("head_2", -1))
    left = lambda k: F.col(f"n_shingles_{k}") - F.col(f"own_{k}") - F.size(F.filter(f"head_{k}", lambda x: x <= least_last))
    most = F.size(common) + F.least(left(1), left(2))
    enough = most * (100 + percent) >= (F.col("n_shingles_1") + F.col("n_shingles_2")) * percent
    # what surely differs: the n-grams that nobody else has, and the shared ones by their parity bits
    differ = F.col("own_1") + F.col("own_2")
    for i in range(PARITY // 64):
        differ = differ + F.bit_count(F.get("bits_1", F.lit(i)).bitwiseXOR(F.get("bits_2", F.lit(i))))
    alike = differ * (100 + percent) <= (F.col("n_shingles_1") + F.col("n_shingles_2")) * (100 - percent)
    fits = F.col("n_shingles_2") * 100 >= F.col("n_shingles_1") * percent
    met = one.join(two, (one["key"] == two["key"]) & ordered & (F.col("comp_1") != F.col("comp_2")) & fits & alike & (F.array_min(common) == one["key"]) & enough)
    pairs = met.select(F.col("cls_1").alias("a"), F.col("cls_2").alias("b"))
    if judged is None:
        return pairs
    seen = judged.select("a", "b").unionByName(judged.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.join(seen, ["a", "b"], "left_anti")


def one_per_component(docs: DataFrame, n: int = 5, percent: int = 80, rounds: int = STAR_ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of the smallest id of each component, with all its columns.

    Rows that repeat an id with the same text are one document; rows without an id all stay.
    """
    found = jaccard_components(docs, n=n, percent=percent, rounds=rounds, id_col=id_col, text_col=text_col)
    heads = found.filter("doc_id = component_id").select(F.col("doc_id").alias(id_col)).distinct()
    kept = docs.join(heads, id_col, "left_semi")
    if not docs.groupBy(id_col).count().filter("count > 1").isEmpty():
        digest = free_name(docs, "text_digest")
        kept = kept.withColumn(digest, F.sha2(F.col(text_col).cast("binary"), 256)).dropDuplicates([id_col, digest]).drop(digest)
    return kept.unionByName(docs.filter(F.col(id_col).isNull()))
