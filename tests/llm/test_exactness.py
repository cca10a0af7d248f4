"""Texts that cheap hashes confuse: complementary Thue-Morse words agree under polynomial hashes modulo 2**64."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from weirwork.llm import bpe, kernel, ngram_join, quality, wavelet
from weirwork.llm.queries import tokenizer_file

POWERS = range(9, 15)


def thue_morse(power, one, two):
    a, b = one, two
    for _ in range(power):
        a, b = a + b, b + a
    return a, b


WORDS = [w for p in POWERS for pair in (("a", "b"), ("x", "é")) for w in thue_morse(p, *pair)]


def test_hashes_and_dictionary_tell_them_apart():
    runs = pa.array([w.encode() for w in WORDS], pa.large_binary())
    raw, at = kernel.contents(runs)
    assert len(set(kernel.hashes_of(runs).tolist())) == len(WORDS)
    codes, distinct = kernel.dictionary(raw, at)
    assert codes.tolist() == list(range(len(WORDS)))
    assert distinct.to_pylist() == [w.encode() for w in WORDS]


def test_ids_equal_the_library(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(WORDS)), "doc_id long, text string").coalesce(1)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        t = Tokenizer.from_file(tokenizer_file(name))
        t.no_truncation()
        t.no_padding()
        ids = [e.ids for e in t.encode_batch(WORDS, add_special_tokens=False)]
        if name.startswith("word"):
            got = {r["doc_id"]: r["ids_sha256"] for r in bpe.encode_digests(docs, tokenizer_file(name)).collect()}
            assert got == {i: hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for i, x in enumerate(ids)}
        else:
            folder = str(tmp_path / "w")
            got = {r["doc_id"]: r["ids_crc32"] for r in wavelet.read_shards(wavelet.write_shards(docs, tokenizer_file(name), folder, ranges=1), folder).collect()}
            assert got == {i: zlib.crc32(np.array([*x, 2], "<u4").tobytes()) for i, x in enumerate(ids)}


@pytest.mark.parametrize("power", POWERS)
def test_counts(power):
    a, b = thue_morse(power, "a", "b")
    raw, at = kernel.contents(pa.array([f"{a}\n{b}\n{a}", f"{a} {a} {b} {a} {b} {b}"], pa.large_string()))
    counts, _ = quality.base_counts(raw, at)
    assert counts["n_dup_lines"].tolist() == [1, 0]
    assert counts["n_repeat_words"].tolist() == [0, 0]


def test_windows_of_many_words():
    codes = np.random.default_rng(1).integers(0, 5, 3000)
    exact = quality.triples(codes, 5)
    paired = quality.triples(codes, (1 << 21) + 1)
    assert len(set(zip(exact.tolist(), paired.tolist(), strict=True))) == len(set(exact.tolist())) == len(set(paired.tolist()))


def test_documents_of_one_word_stay_apart(spark):
    docs = spark.createDataFrame(list(enumerate(WORDS)), "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()} == {(i, i) for i in range(len(WORDS))}
