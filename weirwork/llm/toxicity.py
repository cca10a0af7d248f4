"""Toxic span tagging by a linear-chain conditional random field.

Tokens are runs of letters, digits and bytes above 127; their features are 64-bit hashes of the
folded word and of its prefixes. Document labels are turned into token labels: in a toxic training
document, the tokens with a feature that toxic documents have far more often than others. The
field (two states: plain, toxic) is fitted to them by gradient ascent of the ridge-penalised
conditional likelihood over all tokens: feature weights, the toxic state's bias and all four
transition potentials, each slope being the observed less the expected count. A document's score
is a logistic function of what forward-backward marginals add up to: their largest log odds and
the log of their sum. Offending offsets are the runs of tokens whose marginal reaches SPAN_LIMIT.

Only tokens with a weighted feature, and their neighbours, need a step of their own; all others
share one potential, so a gap of k of them is the k-th power of one 2x2 matrix, in closed form,
and so are the expected counts within it. That keeps inference exact for texts of any length at
the cost of a few steps.

The model is fitted on at most TRAIN_DOCS labelled documents (those with the smallest hash of
their id) of at most TRAIN_BYTES together, in one task of an executor; it is a few thousand
numbers and travels with the task. Every document is scored.

Defined cases: a null or empty text has no tokens and gets the score of no evidence. A null label
is no label, and so is one without an id; of several labels of one id the largest counts. A row
without an id is held out or not as the text 'null' would be. Texts are scored whole. Repeated rows
are scored alike. Without labelled rows of both kinds every score is 0. An empty table gives no rows. Extra
columns are ignored by `tag_toxicity` and kept by `drop_toxic`.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import NO_ID, free_worker, ids_back, ids_of, slices, strings, utf8

TRAIN_DOCS = 4000
TRAIN_BYTES = 64 << 20
CHUNK = 1 << 20
PREFIXES = (3, 4, 5, 6)
MIN_CONTEXTS = 4  # different words before a feature in toxic training documents (copies of one text have the same)
MIN_LIFT = 12.0  # times as frequent in toxic documents as in others, smoothed
CHANCE = 2.0
MAX_FEATURES = 4096
EPOCHS = 60
SPEED, RIDGE = 0.5, 0.05
SPAN_LIMIT = 0.5
#: Bytes between tokens: all of ASCII but letters and digits.
OUTSIDE = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
U = np.uint64


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray  # log potential of the toxic state that each adds
    bias: float  # log potential of the toxic state of any token
    trans: np.ndarray  # 2x2 log potentials
    calibration: tuple[float, float, float]  # intercept, largest log odds, log of the sum


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text index of the tokens, the word of each, and a row of feature hashes for each distinct word (0: none)."""
    starts, ends, of, which, vocabulary = K.words(K.LOWER[raw], at, outside=OUTSIDE)
    data, offsets = K.contents(vocabulary)
    size = np.diff(offsets)
    grid = np.zeros((len(size), 1 + len(PREFIXES)), U)
    grid[:, 0] = K.run_hashes(data, size)
    for i, k in enumerate(PREFIXES, 1):
        long = np.flatnonzero(size > k)
        heads = data[(offsets[long, None] + np.arange(k)).reshape(-1)]
        grid[long, i] = K.mix(K.run_hashes(heads, np.full(len(long), k)) ^ U(k))
    return starts, ends, of, which, grid


def emissions(model: Model, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of features: whether any has a weight, and what the weights add up to."""
    if not len(model.features):
        return np.zeros(len(grid), bool), np.zeros(len(grid))
    at = np.minimum(np.searchsorted(model.features, grid), len(model.features) - 1)
    hit = model.features[at] == grid
    return hit.any(axis=1), np.where(hit, model.weights[at], 0.0).sum(axis=1)


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


class Chain:
    """Forward-backward over sparse steps of many texts at once. Before its first token a text is in the plain state."""

    def __init__(self, bias: float, trans: np.ndarray):
        self.trans = np.exp(trans - trans.max())
        self.plain = np.array([1.0, np.exp(bias)])
        step = self.trans * self.plain[None, :]
        values, vectors = np.linalg.eig(step)
        order = np.argsort(-values.real)
        self.step = step / values[order[0]].real
        self.ratio = float((values[order[1]] / values[order[0]]).real)
        self.vectors = vectors[:, order].real
        self.inverse = np.linalg.inv(self.vectors)
        self.major = np.outer(self.vectors[:, 0], self.inverse[0])
        self.minor = np.outer(self.vectors[:, 1], self.inverse[1])

    def power(self, gaps: np.ndarray) -> np.ndarray:
        """The step matrix of plain tokens to the power of each gap, up to a factor."""
        return self.major[None] + (self.ratio ** gaps)[:, None, None] * self.minor[None]

    def _within(self, left: np.ndarray, right: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        """Expected transitions into the plain tokens of gaps between given vectors."""
        r = self.ratio
        one, two = left @ self.vectors, right @ self.inverse.T
        power = r**gaps
        sums = np.empty((len(gaps), 2, 2))  # of all ways to split a gap around one transition
        sums[:, 0, 0] = gaps
        sums[:, 1, 1] = np.where(gaps > 0, gaps * r ** np.maximum(gaps - 1, 0), 0.0)
        sums[:, 0, 1] = sums[:, 1, 0] = (1 - power) / (1 - r)
        whole = one[:, 0] * two[:, 0] + power * one[:, 1] * two[:, 1]
        weight = one[:, :, None] * sums * two[:, None, :] / whole[:, None, None]
        return self.step * (self.inverse.T @ weight.sum(axis=0) @ self.vectors.T)

    def expected(self, of: np.ndarray, place: np.ndarray, weight: np.ndarray, lengths: np.ndarray, counts: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Probability of the toxic state at the given tokens (ascending; place: index in its text of
        `lengths` tokens), and the expected transitions into all tokens of all texts."""
        total = np.zeros((2, 2))
        e0 = np.array([[1.0, 0.0]])
        if counts:
            empty = np.ones(len(lengths), bool)
            empty[of] = False
            gaps = lengths[empty & (lengths > 0)]
            total += self._within(np.repeat(e0, len(gaps), 0), np.ones((len(gaps), 2)), gaps)
        n = len(of)
        if not n:
            return np.zeros(0), total
        begin = np.concatenate([[True], of[1:] != of[:-1]])
        head = np.flatnonzero(begin)
        sizes = np.diff(np.append(head, n))
        local = np.arange(n) - np.repeat(head, sizes)
        before = np.where(begin, place, place - np.concatenate([[0], place[:-1]]) - 1)  # plain tokens before
        after = lengths[of] - place - 1
        emit = _normal(np.stack([np.ones(n), self.plain[1] * np.exp(np.minimum(weight, 50.0))], axis=1))
        gap = self.power(before)
        alpha, beta = np.zeros((n, 2)), np.ones((n, 2))
        tail = head + sizes - 1
        beta[tail] = _normal(self.power(after[tail]).sum(axis=2))
        by_step = np.argsort(local, kind="stable")
        stops = np.searchsorted(local[by_step], np.arange(int(sizes.max()) + 1))
        left = np.repeat(e0, n, 0)  # the state before the gap before each step
        for k in range(len(stops) - 1):
            i = by_step[stops[k] : stops[k + 1]]
            if k:
                left[i] = alpha[i - 1]
            alpha[i] = _normal(np.einsum("nj,njk,kl->nl", left[i], gap[i], self.trans) * emit[i])
        for k in range(len(stops) - 2, 0, -1):
            i = by_step[stops[k] : stops[k + 1]]
            beta[i - 1] = _normal(np.einsum("njk,kl,nl->nj", gap[i], self.trans, emit[i] * beta[i]))
        both = alpha * beta
        if counts:
            right = (emit * beta) @ self.trans.T
            total += self._within(left, right, before) + self._within(alpha[tail], np.ones((len(tail), 2)), after[tail])
            into = np.einsum("nj,njk->nk", left, gap)[:, :, None] * self.trans * (emit * beta)[:, None, :]
            total += (into / into.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        return both[:, 1] / both.sum(axis=1), total

    def marginals(self, of: np.ndarray, place: np.ndarray, weight: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return self.expected(of, place, weight, lengths, counts=False)[0]


def slopes(bias: float, trans: np.ndarray, weights: np.ndarray, where: np.ndarray, place: np.ndarray, hits: np.ndarray, real: np.ndarray, label: np.ndarray, seen: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Slopes of the conditional log likelihood by the weights, the bias and the transitions.

    hits, real: the features of each step and which of them are any; seen: transitions of the labels.
    """
    total = np.where(real, weights[hits], 0.0).sum(axis=1) if len(weights) else np.zeros(len(where))
    p, expected = Chain(bias, trans).expected(where, place, total, lengths)
    miss = np.broadcast_to((label - p)[:, None], hits.shape)
    by_weight = np.bincount(hits[real], weights=miss[real], minlength=len(weights)) if len(weights) else np.zeros(0)
    rest = seen - expected
    return by_weight, float(rest[:, 1].sum()), rest


def transitions(where: np.ndarray, place: np.ndarray, label: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Transitions into all tokens of labelled chains: label is that of each step, every other token is plain."""
    bad = np.flatnonzero(label > 0)
    pairs = np.count_nonzero((where[bad][1:] == where[bad][:-1]) & (place[bad][1:] == place[bad][:-1] + 1))
    left = np.count_nonzero(place[bad] + 1 < lengths[where[bad]]) - pairs
    return np.array([[lengths.sum() - len(bad) - left, len(bad) - pairs], [left, pairs]], float)


def active_steps(of: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Active tokens and their neighbours in the same text."""
    near = active.copy()
    if len(of) > 1:
        same = of[1:] == of[:-1]
        near[1:] |= active[:-1] & same
        near[:-1] |= active[1:] & same
    return np.flatnonzero(near)


def summarise(of: np.ndarray, p: np.ndarray, texts: int) -> np.ndarray:
    """Two evidence values of each text: largest log odds (at least -6) and log of 1 + the sum of marginals."""
    top, total = np.full(texts, -6.0), np.zeros(texts)
    q = np.clip(p, 1e-9, 1 - 1e-9)
    np.maximum.at(top, of, np.log(q / (1 - q)))
    np.add.at(total, of, p)
    return np.stack([top, np.log1p(total)], axis=1)


def _pairs(keys: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs with a key that is not 0, ascending by key."""
    some = keys != 0
    keys, others = keys[some], others[some]
    order = np.lexsort((others, keys))
    keys, others = keys[order], others[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (others[1:] != others[:-1])
    return keys[fresh], others[fresh]


def _chunks(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First text, number of texts, text index and features of the tokens of consecutive texts of about CHUNK characters."""
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and size < CHUNK:
            size += len(texts[stop])
            stop += 1
        raw, at = utf8(strings(pa.array(texts[start:stop], pa.large_string())))
        _, _, of, which, grid = tokens(raw, at)
        yield start, stop - start, of, grid[which]
        start = stop


def select_features(texts: list[str], toxic: np.ndarray) -> np.ndarray:
    """Features that toxic documents have far more often than others, after enough different words."""
    keys, docs, befores = [np.zeros(0, U)], [np.zeros(0, np.int64)], ([np.zeros(0, U)], [np.zeros(0, U)])
    bad_texts = [t for t, y in zip(texts, toxic.tolist(), strict=True) if y]
    for start, _, of, grid in _chunks(bad_texts):
        width = grid.shape[1]
        k, d = _pairs(grid.reshape(-1), np.repeat(of, width))
        keys.append(k)
        docs.append(d + start)
        before = np.concatenate([np.zeros(1, U), grid[:-1, 0]])
        before[1:][of[1:] != of[:-1]] = 0
        k, w = _pairs(grid.reshape(-1), np.repeat(before, width))
        befores[0].append(k)
        befores[1].append(w)
    features, bad = np.unique(np.concatenate(keys), return_counts=True)
    k, _ = _pairs(np.concatenate(befores[0]), np.concatenate(befores[1]))
    contexts = np.bincount(np.searchsorted(features, k), minlength=len(features))
    enough = contexts >= MIN_CONTEXTS
    features, bad = features[enough], bad[enough]
    if not len(features):
        return features
    good = np.zeros(len(features), np.int64)
    for _, _, of, grid in _chunks([t for t, y in zip(texts, toxic.tolist(), strict=True) if not y]):
        at = np.minimum(np.searchsorted(features, grid), len(features) - 1)
        hit = features[at] == grid
        k, _ = _pairs(at[hit].astype(U) + U(1), np.broadcast_to(of[:, None], grid.shape)[hit])
        good += np.bincount((k - U(1)).astype(np.int64), minlength=len(features))
    lift = ((bad + 0.1) / (toxic.sum() + 0.2)) / ((good + 0.5) / ((~toxic).sum() + 1.0))
    # how unlikely so many toxic documents are by chance, against the number of features tried
    chance = bad * np.log(bad / (bad + good) / toxic.mean())
    found = np.flatnonzero((chance >= np.log(len(features) + 1) + CHANCE) & (lift >= MIN_LIFT))
    best = found[np.argsort(-bad[found], kind="stable")][:MAX_FEATURES]
    return np.sort(features[best])


def fit(texts: list[str], toxic: np.ndarray) -> Model | None:
    """A model from whole texts and their labels; None without both kinds."""
    toxic = toxic.astype(bool)
    if not toxic.any() or toxic.all():
        return None
    features = select_features(texts, toxic)
    trans = np.zeros((2, 2))
    model = Model(features, np.zeros(len(features)), -4.0, trans, (0.0, 1.0, 0.0))
    held: list[tuple[np.ndarray, ...]] = []
    lengths = np.zeros(len(texts), np.int64)
    for start, count, of, grid in _chunks(texts):
        size = np.bincount(of, minlength=count)
        lengths[start : start + count] = size
        active, _ = emissions(model, grid)
        steps = active_steps(of, active)
        held.append((of[steps] + start, steps - (np.cumsum(size) - size)[of[steps]], active[steps], grid[steps]))
    where, place, active, grid = (np.concatenate(x) for x in zip(*held, strict=True))
    steps = np.arange(len(where))
    hits = np.searchsorted(features, grid) if len(features) else np.zeros((len(steps), 1), np.int64)
    hits = np.minimum(hits, max(len(features) - 1, 0))
    real = features[hits] == grid if len(features) else np.zeros(hits.shape, bool)
    label = (active & toxic[where]).astype(float)
    seen = transitions(where, place, label, lengths)
    trans = np.log((seen + 1) / (seen + 1).sum(axis=1, keepdims=True))
    weights, bias = np.full(len(features), 1.0), -2.0
    sums = np.zeros(len(features) + 5)
    for _ in range(EPOCHS):
        by_weight, by_bias, by_trans = slopes(bias, trans, weights, where, place, hits, real, label, seen, lengths)
        slope = np.concatenate([by_weight, [by_bias], by_trans.ravel()]) - RIDGE * np.concatenate([weights, [bias], trans.ravel()])
        sums += slope**2
        change = SPEED * slope / np.sqrt(sums + 1e-6)
        weights, bias, trans = weights + change[:-5], float(bias + change[-5]), trans + change[-4:].reshape(2, 2)
    total = np.where(real, weights[hits], 0.0).sum(axis=1) if len(features) else np.zeros(len(steps))
    p = Chain(bias, trans).marginals(where, place, total, lengths)
    x = np.column_stack([np.ones(len(texts)), summarise(where, p, len(texts))])
    coef = np.zeros(3)
    for _ in range(50):  # Newton steps of a ridge logistic regression
        odds = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
        hess = (x * (odds * (1 - odds))[:, None]).T @ x + 0.5 * np.eye(3)
        coef = coef + np.linalg.solve(hess, x.T @ (toxic - odds) - 0.5 * coef)
    return Model(features, weights, bias, trans, tuple(coef.tolist()))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Fit on at most `limit` labelled documents that are not held out, of at most `most_bytes` together."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).cast("long").alias("id"), (F.col("toxic") == 1).alias("toxic"))
    chosen = known.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(limit)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sizes = texts.join(F.broadcast(chosen), "id").groupBy("id", "toxic").agg(F.sum(F.octet_length("text")).alias("size")).orderBy(F.xxhash64("id"), "id").collect()  # at most `limit` rows
    taken, size = [], 0
    for r in sizes:
        if size + r["size"] <= most_bytes:  # a text that is too long leaves room for the others
            size += r["size"]
            taken.append((r["id"], r["toxic"]))
    if not taken:
        return None
    spark = docs.sparkSession
    rows = texts.join(F.broadcast(spark.createDataFrame(taken, "id long, toxic boolean")), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(list(batches), pa.schema([("id", pa.int64()), ("toxic", pa.bool_()), ("text", pa.large_string())])).sort_by([("id", "ascending"), ("text", "ascending")])
        model = fit(found.column("text").to_pylist(), found.column("toxic").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    large = rows.select("id", "toxic", "text").repartition(1)
    return pickle.loads(large.mapInArrow(_as_large(run), "model binary").first()["model"])


def _as_large(run):
    """Texts arrive as large strings, whatever the session's Arrow settings."""

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("id", pa.int64()), ("toxic", pa.bool_()), ("text", pa.large_string())])
        return run(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, kind, strict=True)], schema=kind) for b in batches)

    return cast


def score_slice(model: Model | None, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Scores of the texts and their toxic spans (character offsets, highest marginal)."""
    texts = len(at) - 1
    spans: list[list[tuple[int, int, float]]] = [[] for _ in range(texts)]
    if model is None:
        return np.zeros(texts), spans
    starts, ends, of, which, grid = tokens(raw, at)
    lengths = np.bincount(of, minlength=texts)
    active, weight = emissions(model, grid)
    steps, weight = active_steps(of, active[which]), weight[which]
    where = of[steps]
    p = Chain(model.bias, model.trans).marginals(where, steps - (np.cumsum(lengths) - lengths)[where], weight[steps], lengths)
    x = np.column_stack([np.ones(texts), summarise(where, p, texts)])
    score = 1 / (1 + np.exp(-np.clip(x @ np.array(model.calibration), -40, 40)))
    found = np.flatnonzero(p >= SPAN_LIMIT)
    if len(found):
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        base = chars[at]
        for i in found.tolist():
            t, d = steps[i], where[i]
            s, e = int(chars[starts[t]] - base[d]), int(chars[ends[t]] - base[d])
            row = spans[d]
            if row and i and steps[i - 1] == t - 1 and p[i - 1] >= SPAN_LIMIT:
                row[-1] = (row[-1][0], e, max(row[-1][2], float(p[i])))
            else:
                row.append((s, e, float(p[i])))
    return score, spans


def tag_toxicity(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and the toxic spans (begin, end, marginal) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for part in slices(batches, "text"):
            raw, at = utf8(strings(part.column("text")))
            score, spans = score_slice(model, raw, at)
            ids = ids_of(part.column("doc_id"))
            out = [zlib.crc32(b"null" if i == NO_ID else str(i).encode()) % 5 == 0 for i in ids.tolist()]
            flat = [{"begin": s, "end": e, "marginal": p} for row in spans for s, e, p in row]
            kind = pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())])
            stops = np.cumsum([0, *map(len, spans)])
            lists = pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(flat, kind))
            yield pa.RecordBatch.from_arrays(
                [ids_back(ids), pa.array(out), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), lists], ["doc_id", "held_out", "score", "predicted", "spans"]
            )

    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return narrow.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, spans array<struct<begin:long,end:long,marginal:double>>")


def drop_toxic(docs: DataFrame, model: Model | None, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose text scores under the limit, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for part in slices(batches, text_col):
            raw, at = utf8(strings(part.column(text_col)))
            yield part.filter(pa.array(score_slice(model, raw, at)[0] < limit))

    return docs.mapInArrow(run, docs.schema)
