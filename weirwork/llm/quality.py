"""Quality rules by tokeniser fertility.

Every text is measured against a public vocabulary with byte fallback, word by word: code points of
its words per token, the share of its tokens that stand for single bytes because no piece of the
vocabulary fits, and token entropy. The last is the mean entropy (bits) of blocks of BLOCK
consecutive tokens, so that it does not grow with the text; a shorter text is one block, its
entropy scaled by log(BLOCK) / log(tokens). A text is kept if the base rule holds and each measure
lies in the band of its language. The base rule is one of plain counts: enough words, few of them
in repeated windows of three words.

Words are maximal runs of bytes other than space and \\t \\n \\v \\f \\r. Words and lines are equal
if their bytes are. Every distinct word is tokenised once while it stays in a memo of bounded size.

Defined cases: a null or empty text has no words and fails the base rule. A null or unlisted
language gets the band DEFAULT (that of BANDS if the caller's bands have none). Texts are measured
whole. Repeated rows are judged alike. An empty table gives no rows. Extra columns are ignored by
`quality_rules` and kept by `keep_quality`.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel as K
from .common import kept as kept_coder
from .common import slices, strings, utf8

MEMO_WORDS = 300_000
DEFAULT = ""
MIN_WORDS = 50
MOST_REPEATED = 50  # percent of words in repeated windows
BLOCK = 96  # tokens over which entropy is measured, so that it does not grow with the text
#: Language: (least, most) characters per token, most byte-fallback share, least block entropy (bits).
BANDS: dict[str, tuple[float, float, float, float]] = {
    DEFAULT: (1.00, 8.00, 0.20, 4.80),
    "de": (1.70, 8.00, 0.20, 5.25),
    "en": (1.70, 8.00, 0.20, 5.36),
    "es": (1.55, 8.00, 0.20, 5.15),
    "fr": (1.60, 8.00, 0.20, 5.17),
}
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, chars_per_token double, byte_share double, block_entropy double"


@cache
def _pieces(path: str):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return model, np.array([model.is_byte(i) for i in range(model.get_piece_size())])


class Fertility:
    """Token counts of texts by a sentencepiece vocabulary, word by word."""

    def __init__(self, path: str):
        self.model, self.is_byte = _pieces(path)
        self.memo = K.Memo(MEMO_WORDS, np.uint16 if len(self.is_byte) <= 1 << 16 else np.uint32)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = self.model.encode(words, num_threads=1)
        size = np.fromiter(map(len, got), np.int64, len(got))
        return size, np.fromiter(chain.from_iterable(got), self.memo.dtype, int(size.sum()))

    def measure(self, of: np.ndarray, which: np.ndarray, vocabulary: pa.Array, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, byte-fallback tokens and block entropy of every text. of, which: text and code of every word."""
        if not len(which):
            return np.zeros(texts), np.zeros(texts), np.zeros(texts)
        begin, size, flat = self.memo.get(vocabulary.cast(pa.large_string()).to_numpy(zero_copy_only=False).tolist(), self._encode)
        bytes_upto = np.concatenate([[0], np.cumsum(self.is_byte[flat])])
        byte_per = bytes_upto[begin + size] - bytes_upto[begin]
        per = size[which]
        tokens = np.bincount(of, weights=per, minlength=texts)
        byte_tokens = np.bincount(of, weights=byte_per[which], minlength=texts)
        entropy = block_entropy(flat[K.spread(begin[which], per)], tokens.astype(np.int64))
        return tokens, byte_tokens, entropy


def block_entropy(ids: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Mean token entropy (bits) of the blocks of every text; the last block ends with the text."""
    out = np.zeros(len(tokens))
    stop = np.cumsum(tokens)
    start = stop - tokens
    for i in np.flatnonzero((tokens > 1) & (tokens < BLOCK)).tolist():
        runs = np.unique(ids[start[i] : stop[i]], return_counts=True)[1]
        n = int(tokens[i])
        # on the scale of whole blocks
        out[i] = (np.log2(n) - (runs * np.log2(runs)).sum() / n) * np.log2(BLOCK) / np.log2(n)
    long = np.flatnonzero(tokens >= BLOCK)
    if len(long):
        blocks = -(-tokens[long] // BLOCK)
        of = np.repeat(long, blocks)
        place = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = np.minimum(start[of] + place * BLOCK, stop[of] - BLOCK)
        total = np.zeros(len(of))
        for k in range(0, len(of), 4096):
            grid = np.sort(ids[begin[k : k + 4096, None] + np.arange(BLOCK)], axis=1)
            change = np.ones(grid.shape, bool)
            change[:, 1:] = grid[:, 1:] != grid[:, :-1]
            edge = np.flatnonzero(change)
            runs = np.diff(np.append(edge, grid.size))
            total[k : k + 4096] = np.log2(BLOCK) - np.bincount(edge // BLOCK, weights=runs * np.log2(runs), minlength=len(grid)) / BLOCK
        out[long] = np.bincount(of, weights=total, minlength=len(tokens))[long] / blocks
    return out


def repeated(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values occur more than once in their text (texts ascending)."""
    out = np.zeros(len(keys), bool)
    if len(keys):
        order = np.argsort(keys, kind="stable")  # equal keys stay in the order of their texts
        key, text = keys[order], of[order]
        same = (key[1:] == key[:-1]) & (text[1:] == text[:-1])
        out[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    return out


def triples(codes: np.ndarray, distinct: int) -> np.ndarray:
    """A number for each three consecutive codes, equal only for equal ones."""
    if distinct <= 1 << 21:
        return (codes[:-2] * distinct + codes[1:-1]) * distinct + codes[2:]
    pairs, two = np.unique(codes[:-1] * distinct + codes[1:], return_inverse=True)
    return two[:-1] * distinct + codes[2:]  # fewer pairs than words of a slice, so that this fits


def base_counts(raw: np.ndarray, at: np.ndarray) -> tuple[dict[str, np.ndarray], tuple]:
    """The plain counts of every text, and its words. Lines and words are compared byte by byte."""
    texts = len(at) - 1
    _, _, of, codes, vocabulary = K.words(raw, at)
    tally = lambda places: np.bincount(K.owners(at, places), minlength=texts)
    inside = ~K.BLANK[raw]
    upto = np.concatenate([[0], np.cumsum(inside & ((raw & 0xC0) != 0x80))])
    # lines with a word, less the distinct ones
    newline = np.zeros(256, bool)
    newline[10] = True
    line_start, line_end, line_of, line, lines = K.words(raw, at, outside=newline)
    worded = upto[line_end] > upto[line_start]
    line_of, line = line_of[worded], line[worded]
    distinct = np.unique(line_of * max(len(lines), 1) + line) // max(len(lines), 1)
    dup_lines = np.bincount(line_of, minlength=texts) - np.bincount(distinct, minlength=texts)
    # words in windows that occur again in the same text
    covered = np.zeros(len(codes), bool)
    if len(codes) > 2:
        whole = np.flatnonzero(of[2:] == of[:-2])
        twice = whole[repeated(triples(codes, len(vocabulary))[whole], of[whole])]
        for k in range(3):
            covered[twice + k] = True
    counts = {
        "n_words": np.bincount(of, minlength=texts),
        "word_chars": np.diff(upto[at]),
        "n_symbols": tally(np.flatnonzero(SYMBOLS[raw])),
        "n_dup_lines": dup_lines,
        "n_repeat_words": np.bincount(of[covered], minlength=texts),
    }
    return counts, (of, codes, vocabulary)


def judge(fertility: Fertility, text: pa.Array, lang: pa.Array, bands: Mapping[str, tuple[float, float, float, float]]) -> tuple[dict[str, np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Counts, measures, base verdict and verdict of a slice of texts."""
    raw, at = utf8(strings(text))
    counts, words = base_counts(raw, at)
    tokens, byte_tokens, entropy = fertility.measure(*words, len(text))
    some = np.maximum(tokens, 1)
    per, share = counts["word_chars"] / some, byte_tokens / some
    default = bands.get(DEFAULT, BANDS[DEFAULT])
    low, high, most, least = np.array([bands.get(x or DEFAULT, default) for x in lang.to_pylist()], float).reshape(-1, 4).T
    failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])
    kept = ~failed & (per >= low) & (per <= high) & (share <= most) & (entropy >= least)
    return counts, [per, share, entropy], failed, kept


def quality_rules(docs: DataFrame, vocabulary: str, bands: Mapping[str, tuple[float, float, float, float]] = BANDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The counts, the measures and the verdict of every row."""
    bands = dict(bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = kept_coder(Fertility, vocabulary)
        for part in slices(batches, "text"):
            counts, measures, failed, kept = judge(fertility, part.column("text"), part.column("lang"), bands)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(c.astype(np.int64)) for c in counts.values()), pa.array(failed), pa.array(kept), *map(pa.array, measures)],
                ["doc_id", *counts, "base_failed", "kept", "chars_per_token", "byte_share", "block_entropy"],
            )

    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    return narrow.mapInArrow(run, OUT)


def keep_quality(docs: DataFrame, vocabulary: str, bands: Mapping[str, tuple[float, float, float, float]] = BANDS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that the rules keep, with all their columns."""
    bands = dict(bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = kept_coder(Fertility, vocabulary)
        for part in slices(batches, text_col):
            yield part.filter(pa.array(judge(fertility, part.column(text_col), part.column(lang_col), bands)[3]))

    return docs.mapInArrow(run, docs.schema)
