import hashlib
import random
import zlib

import numpy as np
import pytest
import regex
from tokenizers import Tokenizer

from weirwork.llm import bpe, kernel, wavelet
from weirwork.llm.queries import tokenizer_file

WORD, BYTE = tokenizer_file("word_bpe_49k.json"), tokenizer_file("byte_bpe_50k.json")
ALPHABET = "ab'sStdmrevl <|>\n\té1²!\u3000ΣİßǅՀ日\U0001f600\u0301"
ODD = ["", "  ", "I'm don't 'S we'LL'VE x've're''s 's's ", "<|endoftext|>a<|startoftext|> b<|endoftext|", "ΣΑΣ İ é \u0301 a\u0301 b\x1cb\x85c", "a" * 300 + "ab" * 500, "é" * 200, "'", "''s", " \n x"]


def texts(n=1500, seed=1):
    rnd = random.Random(seed)
    return ODD + ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def test_ids_and_decoding_equal_the_library():
    t, coder, some = library(WORD), bpe.WordCoder(WORD), texts()
    coded, which, of = coder.pieces(some)
    got = [[] for _ in some]
    for w, o in zip(which.tolist(), of.tolist(), strict=True):
        got[o] += [int(x) for x in coded[w].ids.split()]
    for text, ids, ref in zip(some, got, t.encode_batch(some, add_special_tokens=False), strict=True):
        assert ids == ref.ids, repr(text)
        assert bpe.decode(ids, coder.table) == t.decode(ref.ids, skip_special_tokens=False)


def ids_of(coder, some):
    coded, which, of = coder.pieces(some)
    got = [[] for _ in some]
    for w, o in zip(which.tolist(), of.tolist(), strict=True):
        got[o] += [int(x) for x in coded[w].ids.split()]
    return got


def test_every_code_point():
    places = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    some = [f"a{chr(c)}1b" for c in places]
    w, b, coder, pieces = library(WORD), library(BYTE), bpe.WordCoder(WORD), wavelet.PieceCoder(BYTE)
    for k in range(0, len(some), 50_000):
        part = some[k : k + 50_000]
        assert ids_of(coder, part) == [e.ids for e in w.encode_batch_fast(part, add_special_tokens=False)]
        if k < 0x40000:
            ids, counts = pieces.encode(np.frombuffer("".join(part).encode(), np.uint8), np.cumsum([0, *(len(x.encode()) for x in part)]))
            want = [e.ids for e in b.encode_batch_fast(part, add_special_tokens=False)]
            assert counts.tolist() == list(map(len, want))
            assert ids.tolist() == [x for y in want for x in y]


def test_sequences_of_combining_marks():
    import unicodedata

    rnd = random.Random(11)
    marks = [chr(c) for c in range(0x20000) if unicodedata.combining(chr(c))]
    joining = [chr(c) for c in range(0x20000) if len(unicodedata.decomposition(chr(c)).split()) == 2 and not unicodedata.decomposition(chr(c)).startswith("<")]
    parts = [y for c in joining for y in unicodedata.normalize("NFD", c)]
    some = ["".join(rnd.choice((rnd.choice(marks), rnd.choice(parts), rnd.choice("aÉΣ 1İ\u0308\u1abf\uac00\u11a8"))) for _ in range(rnd.randint(1, 12))) for _ in range(20_000)]
    t, coder = library(WORD), bpe.WordCoder(WORD)
    assert ids_of(coder, some) == [e.ids for e in t.encode_batch_fast(some, add_special_tokens=False)]


def test_both_trees_merge_alike():
    table = bpe.merge_table(WORD)
    rnd = random.Random(3)
    words = ["".join(rnd.choice("aethinos") for _ in range(rnd.randint(2, 64))).encode() for _ in range(400)]
    alone = [bpe.merge_one(table, [*table.inner[list(w[:-1])].tolist(), int(table.final[w[-1]])]) for w in words]
    assert bpe.encode_words(table, words) == alone


def test_full_memos_change_nothing(monkeypatch):
    some, t = texts(600, 9), library(BYTE)
    coder = wavelet.PieceCoder(BYTE)
    coder.memo.limit = 40
    monkeypatch.setattr(bpe, "MEMO_WORDS", 30)
    words, w = bpe.WordCoder(WORD), library(WORD)
    for k in range(0, len(some), 50):
        part = some[k : k + 50]
        raw = np.frombuffer("".join(part).encode(), np.uint8)
        ids, counts = coder.encode(raw, np.cumsum([0, *(len(x.encode()) for x in part)]))
        want = [e.ids for e in t.encode_batch(part, add_special_tokens=False)]
        assert counts.tolist() == list(map(len, want))
        assert ids.tolist() == [x for y in want for x in y]
        coded, which, _ = words.pieces(part)
        assert [int(x) for c in which.tolist() for x in coded[c].ids.split()] == [x for e in w.encode_batch(part, add_special_tokens=False) for x in e.ids]
        assert len(words.memo) <= 30 + len(coded)


def test_digests(spark):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (None, "a", "x"), (5, "word " * 20000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string")
    t = library(WORD)

    def want(text):
        ids = t.encode(text or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    got = sorted(map(tuple, bpe.encode_digests(docs, WORD).collect()), key=str)
    assert got == sorted(((i, *want(text)) for i, text, _ in rows), key=str)
    assert bpe.encode_digests(docs.limit(0), WORD).count() == 0
    first = bpe.encode_documents(docs.filter("doc_id = 1"), WORD).first()
    assert first["ids"] == t.encode("Hello world", add_special_tokens=False).ids
    assert first["decoded"] == "hello</w> world</w>"


def test_pieces_equal_the_pattern():
    import public_tokenizers

    some = texts(800, 2)
    joined = "".join(some)
    cp, _ = kernel.codepoints(np.frombuffer(joined.encode(), np.uint8))
    assert cp.tolist() == list(map(ord, joined))
    at = np.cumsum([0, *map(len, some)])
    starts, sizes = kernel.gpt_pieces(cp, at)
    got = [[] for _ in some]
    for s, n, o in zip(starts.tolist(), sizes.tolist(), kernel.owners(at, starts).tolist(), strict=True):
        got[o].append(joined[s : s + n])
    assert got == [regex.findall(public_tokenizers.PATTERN, x) for x in some]


@pytest.mark.parametrize(("n", "kinds"), [(0, 5), (1, 1), (5, 3), (2000, 50), (100000, 30000), (70000, 2)])
def test_wavelet_matrix(n, kinds):
    r = np.random.default_rng(n)
    ids = np.minimum(r.zipf(1.3, n), kinds).astype(np.uint32)
    file = wavelet.WaveletFile(wavelet.build(ids, np.arange(2), np.array([n, 0])))
    assert (file.ids() == ids).all()
    for i in r.integers(0, n, 15).tolist() if n else []:
        s = int(ids[i])
        assert file.access(i) == s
        assert file.rank(s, i) == (ids[:i] == s).sum()
        assert file.count(s) == (ids == s).sum()
        assert file.select(s, file.rank(s, i)) == i
    if n == 2000:
        assert file.occurrences(3) == np.flatnonzero(ids == 3).tolist()
    assert file.rank(10**6, n) == file.count(10**6) == 0
    with pytest.raises(IndexError):
        file.access(n)


def test_shards_round_trip(spark, tmp_path):
    some = texts(60, 5)
    rows = [(i * 3 % 67, t) for i, t in enumerate(some[:67])] + [(100, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    t, start, want = library(BYTE), 0, {}
    for i, text in sorted(rows):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    manifest = wavelet.write_shards(docs, BYTE, str(tmp_path / "w"), ranges=5)
    assert manifest.count() > 1
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in wavelet.read_shards(manifest, str(tmp_path / "w")).collect()} == want
    assert wavelet.read_shards(wavelet.write_shards(docs.limit(0), BYTE, str(tmp_path / "e"), ranges=2), str(tmp_path / "e")).count() == 0
    again = spark.createDataFrame([(None, "a"), (7, "b"), (7, "b")], "doc_id long, text string")
    found = wavelet.read_shards(wavelet.write_shards(again, BYTE, str(tmp_path / "n"), ranges=3), str(tmp_path / "n")).collect()
    assert sorted(r["start"] for r in found) == [0, 2, 4]
