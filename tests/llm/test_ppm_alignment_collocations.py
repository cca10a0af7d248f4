import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from weirwork.llm import alignment, collocations, common, ppm
from weirwork.llm.bpe import byte_letters
from weirwork.llm.queries import tokenizer_file

BYTE, PIECE = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a ", "the cat  sat\n\n on", "<|endoftext|> x", "▁", "a▁b", "日本\x00é", "\t x\r\n", "x" * 3000, "</s><s> <unk>", "éﬁ", "\U0001f600 \U000e0001"]


def some_texts(n, seed):
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "cat", "sat", "on", "mat", "Mat,", "new", "york", "city.", "é", "  ", "\t", "\n", "日本", "<|endoftext|>"]
    return [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    texts = ODD + some_texts(60, 4) + ["the cat sat on the mat"] * 5
    return [(i, t, [None, "en", "und", "de"][i % 4]) for i, t in enumerate(texts)] + [(900, None, "en"), (7, "again and again", "de"), (7, "again and again", "de"), (None, "no id", "de")]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def plain_ppm(rows):
    """Contexts in dictionaries, symbol by symbol."""
    model = ppm.Adaptive()
    for i, t, _ in rows:
        if not held(i):
            data = (t or "").encode()
            for k in range(len(data) + 1):
                s = data[k] if k < len(data) else ppm.END
                for n in range(min(ppm.ORDER, k) + 1):
                    seen = model.counts.setdefault(data[k - n : k], {})
                    seen[s] = seen.get(s, 0) + 1
    tokens = lambda t: [w.lower() if w.isascii() else w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")]
    c = Counter(w for i, t, _ in rows if not held(i) for w in [*tokens(t), " "])
    n, v = sum(c.values()), len(c)
    out = []
    for i, t, _ in rows:
        words = [*tokens(t), " "]
        out.append((i, held(i), len(words), sum(c[w] > 0 for w in words), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words), model.text((t or "").encode(), learn=False)))
    return out


def close(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[-1], 6))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


@pytest.mark.parametrize("hot", [1 << 20, 40])
def test_ppm_equals_plain_tries(spark, rows, monkeypatch, hot):
    monkeypatch.setattr(ppm, "HOT_GRAMS", hot)
    monkeypatch.setattr(ppm, "HOT_WORDS", min(hot, 5) if hot == 40 else hot)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string").repartition(3)
    close([tuple(r)[:7] for r in ppm.ppm_scores(docs).collect()], plain_ppm(rows))


def test_ppm_probabilities_sum_to_one(spark):
    model = ppm.Adaptive(2)
    model.text(b"abracadabra")
    for history in (b"", b"a", b"ab", b"zz", b"ra"):
        assert sum(10 ** model.code(history, s, learn=False) for s in range(257)) == pytest.approx(1)


def test_ppm_odd_tables(spark):
    schema = "doc_id string, text string"
    assert ppm.ppm_scores(spark.createDataFrame([], schema)).count() == 0
    alone = next(str(i) for i in range(100) if held(i))
    row = ppm.ppm_scores(spark.createDataFrame([(alone, "ab")], schema)).first()
    assert (row["held_out"], row["train_tokens"], row["n_known"]) == (True, 0, 0)
    assert row["score"] == pytest.approx(-3 * math.log10(257))
    assert row["base_score"] == pytest.approx(0)
    got = {r["doc_id"]: r["score"] for r in ppm.adaptive_scores(spark.createDataFrame([("a", "aaaa" * 20), ("b", None)], schema)).collect()}
    assert got["b"] == pytest.approx(-math.log10(257))
    assert got["a"] == pytest.approx(ppm.Adaptive().text(b"aaaa" * 20))
    assert got["a"] > -81 * math.log10(257) / 5


def test_grams_read_back():
    texts = [b"abcdef", b"", b"x"]
    found = ppm.grams(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), 4).tolist()
    want = []
    for t in texts:
        for i in range(len(t) + 1):
            c = t[max(0, i - 4) : i]
            want.append((int.from_bytes(c, "big"), len(c), t[i] if i < len(t) else 256))
    assert [(g >> 12, (g >> 9) & 7, g & 511) for g in found] == want


def plain_alignment(rows):
    t = Tokenizer.from_file(BYTE)
    t.encode_special_tokens = True
    t.no_truncation()
    t.no_padding()
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    back = {c: i for i, c in enumerate(byte_letters())}
    docs, total = [], Counter()
    for i, text, _ in rows:
        want = (" " + text).encode() if text else None
        x = t.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        xb = [bytes(back[c] for c in t.id_to_token(k)) for k in x]
        yb = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in y]
        if not text or b"".join(xb) != want or b"".join(yb) != want:
            docs.append((i, [], [], [], []))
            continue
        ends = [np.cumsum([len(k) for k in z]).tolist() for z in (xb, yb)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        links = [(p, q) for p, e in zip(x, ends[0], strict=True) for q, f in zip(y, ends[1], strict=True) if e == f]
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(k) for k, e in zip(z, es, strict=True) if low < e <= c) for z, es in ((x, ends[0]), (y, ends[1]))))
            low = c
        total.update(links)
        docs.append((i, x, y, groups, links))
    most = Counter()
    for (_, q), n in total.items():
        most[q] = max(most[q], n)
    return [
        (i, len(x), len(y), len(g), len(k), sum(total[p] == most[p[1]] for p in k), sum(total[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if x else "")
        for i, x, y, g, k in docs
    ]


@pytest.mark.parametrize("hot", [1 << 18, 10])
def test_alignment_equals_plain_loops(spark, rows, monkeypatch, hot):
    monkeypatch.setattr(alignment, "HOT_PAIRS", hot)
    monkeypatch.setattr(alignment, "SLICE", 500)
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, lang string, n_a int").repartition(3)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, alignment.align_tokenizers(docs, BYTE, PIECE).collect()), key=key) == sorted(plain_alignment(rows), key=key)
    assert alignment.align_tokenizers(docs.limit(0), BYTE, PIECE).count() == 0


def test_pieces_by_segment_equal_whole_texts():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    coder, rnd = alignment.Pieces(PIECE), random.Random(8)
    texts = [t for t in ODD + ["".join(rnd.choice("ab  \n\té日.'<") for _ in range(rnd.randint(1, 40))) for _ in range(800)] if t and "▁" not in t]
    spaced = [(" " + t).encode() for t in texts]
    ids, counts = coder.encode(np.frombuffer(b"".join(spaced), np.uint8), np.cumsum([0, *map(len, spaced)]))
    got = np.split(ids, np.cumsum(counts)[:-1])
    for t, g in zip(texts, got, strict=True):
        assert g.tolist() == model.encode(t), repr(t)


def test_links_of_tokens_without_bytes():
    cuts, ga, gb, la, lb = alignment.align(np.array([2, 2, 5]), np.array([1, 2, 5, 5]))
    assert cuts.tolist() == [2, 5]
    assert (ga.tolist(), gb.tolist()) == ([0, 0, 1], [0, 0, 1, 1])
    assert list(zip(la.tolist(), lb.tolist(), strict=True)) == [(0, 1), (1, 1), (2, 2), (2, 3)]


def plain_collocations(rows, least, top):
    import re

    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    found = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    out = {}
    for (lang, *w), a in found.items():
        if any(len(t) > len(w) + 1 and t[0] == lang and tuple(w) in (t[1:3], t[2:4]) and 100 * b >= 50 * a for t, b in found.items()):
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = f[(lang, *w[:k])], f[(lang, *w[k:])]
            cuts.append((10**6 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return [(lang, r, p.decode(), -a, x, y, n[lang], -s) for lang, ps in out.items() for r, (s, a, p, x, y) in enumerate(sorted(ps)[:top], 1)]


@pytest.mark.parametrize(("common_words", "bits", "top"), [(1 << 19, 27, 2000), (6, 27, 2000), (6, 8, 7)])
def test_collocations_equal_plain_counts(spark, monkeypatch, common_words, bits, top):
    monkeypatch.setattr(collocations, "COMMON", common_words)
    monkeypatch.setattr(collocations, "BITMAP_BITS", bits)
    texts = ODD + some_texts(300, 6)
    rows = [(i, t, [None, "en", "und", "de"][i % 4]) for i, t in enumerate(texts)] + [(1, None, "en"), (2, "A b. c d" * 40, "x\ty")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, rank int").repartition(4)
    got = sorted(map(tuple, collocations.collocations(docs, top=top).collect()))
    assert got == sorted(plain_collocations(rows, 10, top))
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_frequent_phrases_take_one_worker_a_task(spark):
    """Runs are counted and named by one function: two in a row hold two workers for every core, and their memory."""

    class Kept:
        def cut(self, df):
            return df

    words = spark.sparkContext.broadcast(collocations.Words([b"en\ta", b"en\tb"], [30, 20], np.zeros(2, np.uint64)))
    key = (1 << collocations.ID_BITS) | 2
    rows = [(key, None, 6), (key, None, 5), (key + 1, None, 9), (None, b"en\ta rare", 12)]
    partial = spark.createDataFrame(rows, "packed long, spelled binary, n long")
    found = collocations.frequent(partial, words, 2, Kept())
    assert sorted((r["lang"], r["phrase"], r["a"], r["f1"], r["f2"]) for r in found.collect()) == [("en", "a b", 11, 30, 20), ("en", "a rare", 12, 30, None)]
    depth = [len(x) - len(x.lstrip(" :+-|")) for x in found._jdf.queryExecution().sparkPlan().toString().split("\n") if "MapInArrow" in x]
    assert len(depth) == 2 and depth[0] == depth[1]  # side by side below the union, none above the other


def test_worker_gives_memory_back_after_a_task(monkeypatch):
    freed = []
    monkeypatch.setattr(common, "free_worker", lambda: freed.append(len(given)))
    given = []

    @common.lean
    def task(batches):
        for b in batches:
            yield b

    for b in task(iter([1, 2])):
        given.append(b)
    assert given == [1, 2] and freed == [0, 2]


def test_scores_beyond_64_bits(spark):
    a, left, right = 3 * 10**13 + 7, 4 * 10**14 + 1, 5 * 10**13 + 9
    two = spark.createDataFrame([("en", "a b", ["a", "b"], a, left, right)], "lang string, phrase string, w array<string>, a long, f1 long, f2 long")
    three = spark.createDataFrame([], "lang string, phrase string, w array<string>, a long, f1 long, f2 long, f3 long")
    words = spark.createDataFrame([], "key binary, n long")
    assert collocations._scored(two, three, words).first()["score"] == 10**6 * a * a // (left * right)


def test_tally_gives_out_what_is_too_much():
    tally, got = common.Tally(limit=10), Counter()
    r = np.random.default_rng(0)
    want = Counter()
    for _ in range(20):
        keys = r.integers(0, 40, 15)
        want.update(keys.tolist())
        for t in tally.add(pa.array(keys), np.ones(15, np.int64)):
            got.update(dict(zip(t["key"].to_pylist(), t["n"].to_pylist(), strict=True)))
    for t in tally.rest():
        got.update(dict(zip(t["key"].to_pylist(), t["n"].to_pylist(), strict=True)))
    assert got == want
