import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weirwork.llm import quality, toxicity, transcripts, url_rules
from weirwork.llm.common import strings, utf8
from weirwork.llm.queries import tokenizer_file


def plain_marginals(bias, trans, weight):
    """Forward-backward token by token."""
    e = np.stack([np.zeros(len(weight)), bias + np.array(weight)], axis=1)
    a, b = np.zeros_like(e), np.zeros_like(e)
    a[0] = trans[0] + e[0]
    for t in range(1, len(e)):
        a[t] = e[t] + np.logaddexp.reduce(a[t - 1][:, None] + trans, axis=0)
    for t in range(len(e) - 2, -1, -1):
        b[t] = np.logaddexp.reduce(trans + e[t + 1] + b[t + 1], axis=1)
    x = a + b
    return np.exp(x[:, 1] - np.logaddexp.reduce(x, axis=1))


@pytest.mark.parametrize("seed", range(6))
def test_sparse_marginals_equal_dense_ones(seed):
    r = np.random.default_rng(seed)
    trans, bias = r.normal(size=(2, 2)), float(r.normal() - 1)
    lengths, of, place, weight, want = [1, 7, 200, 3], [], [], [], []
    for d, n in enumerate(lengths):
        w = np.where(r.random(n) < 0.2, r.normal(size=n) * 3, 0.0)
        steps = np.flatnonzero(w != 0) if d != 3 else np.arange(n)
        of += [d] * len(steps)
        place += steps.tolist()
        weight += w[steps].tolist()
        want += plain_marginals(bias, trans, w)[steps].tolist()
    got = toxicity.Chain(bias, trans).marginals(np.array(of, np.int64), np.array(place, np.int64), np.array(weight), np.array(lengths))
    assert np.allclose(got, want, atol=1e-9)


def log_likelihood(bias, trans, weights, lengths, where, place, hits, real, label):
    """Of labelled chains, token by token."""
    total = 0.0
    for d, n in enumerate(lengths):
        score, y = np.zeros(n), np.zeros(n, int)
        for i in np.flatnonzero(where == d):
            score[place[i]] = weights[hits[i]][real[i]].sum()
            y[place[i]] = int(label[i])
        a, last, path = None, 0, 0.0
        for t in range(n):
            e = np.array([0.0, bias + score[t]])
            a = e + (trans[0] if a is None else np.logaddexp.reduce(a[:, None] + trans, axis=0))
            path += trans[last, y[t]] + e[y[t]]
            last = y[t]
        total += path - (np.logaddexp.reduce(a) if n else 0.0)
    return total


@pytest.mark.parametrize("seed", range(4))
def test_slopes_equal_numerical_differences(seed):
    r = np.random.default_rng(seed)
    lengths = np.array([50, 1, 0, 8, 3, 20])
    steps = [(0, 3), (0, 4), (0, 5), (0, 30), (0, 49), (1, 0), (3, 0), (3, 7), (5, 9), (5, 10)]
    where, place = np.array([d for d, _ in steps]), np.array([t for _, t in steps])
    hits, real = r.integers(0, 3, (len(steps), 2)), r.random((len(steps), 2)) < 0.7
    label = (r.random(len(steps)) < 0.5).astype(float)
    bias, trans, weights = float(r.normal() - 1), r.normal(size=(2, 2)), r.normal(size=3)
    value = lambda b, t, w: log_likelihood(b, t, w, lengths, where, place, hits, real, label)
    h = 1e-5
    eye = np.eye(4).reshape(4, 2, 2)
    want_t = [(value(bias, trans + h * e, weights) - value(bias, trans - h * e, weights)) / (2 * h) for e in eye]
    want_w = [(value(bias, trans, weights + h * e) - value(bias, trans, weights - h * e)) / (2 * h) for e in np.eye(3)]
    want_b = (value(bias + h, trans, weights) - value(bias - h, trans, weights)) / (2 * h)
    seen = toxicity.transitions(where, place, label, lengths)
    by_weight, by_bias, by_trans = toxicity.slopes(bias, trans, weights, where, place, hits, real, label, seen, lengths)
    assert np.allclose(by_weight, want_w, atol=1e-5)
    assert np.allclose(by_trans.ravel(), want_t, atol=1e-5)
    assert abs(by_bias - want_b) < 1e-5


def labelled(n, seed):
    rnd = random.Random(seed)
    plain = ["".join(rnd.choice("abcdefghij") for _ in range(4)) for _ in range(400)]
    rows = []
    for i in range(n):
        w = [rnd.choice(plain) for _ in range(rnd.randint(5, 60))]
        toxic = i % 4 == 0
        for _ in range(rnd.randint(1, 4) * toxic):
            w.insert(rnd.randrange(len(w) + 1), rnd.choice(["zonk", "Blarg", "quxen", "quxar", "quxol"]))
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = labelled(900, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    truth = {i: y for i, _, y in rows}
    got = toxicity.tag_toxicity(docs, model).collect()
    assert {r["doc_id"] for r in got if r["held_out"]} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(r["predicted"] == truth[r["doc_id"]] == int(r["score"] >= 0.5) for r in got if r["held_out"])
    text = {i: t for i, t, _ in rows}
    cut = {text[r["doc_id"]][s["begin"] : s["end"]].lower() for r in got for s in r["spans"] if s["end"] - s["begin"] < 8}
    assert {"zonk", "blarg", "quxen"} <= cut
    kept = toxicity.drop_toxic(docs, model)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if not r["predicted"]}


def test_toxicity_defined_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "é zonk", "x"), (4, "zonk " * 30000, "x"), (4, "zonk " * 30000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = toxicity.fit([t for _, t, _ in labelled(400, 2)], np.array([y for _, _, y in labelled(400, 2)]))
    got = {r["doc_id"]: r for r in toxicity.tag_toxicity(docs, model).collect()}
    assert got[1]["score"] == got[2]["score"] < 0.5
    assert got[4]["predicted"] == 1
    assert [(s["begin"], s["end"]) for s in got[None]["spans"]] == [(2, 6)]
    assert toxicity.tag_toxicity(docs.limit(0), model).count() == 0
    none = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.tag_toxicity(docs, toxicity.train(docs, none)).collect()} == {0.0}


def plain_counts(text):
    text = text or ""
    blank = r"[^\x20\x09-\x0D]"
    w = re.findall(blank + "+", text)
    lines = [x for x in text.split("\n") if re.search(blank, x)]
    grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    repeated = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)]


def test_quality_counts_and_measures(spark):
    rnd = random.Random(4)
    texts = [None, "", " \n", "a a a a", "x\nx\n \n \nx\n", "é 日本 a|b <*>", "a\x0bb\x1cc\u00a0d", "w " * 30000] + ["".join(rnd.choice("ab \n\té*日") for _ in range(rnd.randint(0, 300))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, rnd.choice(["en", None, "xx"]), 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words int")
    path = tokenizer_file("piece_bpe_32k.model")
    model, is_byte = quality._pieces(path)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for r in quality.quality_rules(docs, path).collect():
        text = texts[r["doc_id"]]
        want = plain_counts(text)
        assert [r[n] for n in names] == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])
        ids = [i for w in re.findall(r"[^\x20\x09-\x0D]+", text or "") for i in model.encode(w)]
        assert r["chars_per_token"] == want[1] / max(len(ids), 1)
        assert r["byte_share"] == is_byte[ids].sum() / max(len(ids), 1) if ids else r["byte_share"] == 0
    assert quality.quality_rules(docs.limit(0), path).count() == 0


def test_block_entropy():
    r = np.random.default_rng(1)
    sizes = np.array([0, 1, 40, 96, 97, 500])
    ids = r.integers(0, 30, sizes.sum()).astype(np.uint16)

    def entropy(x):
        p = np.unique(x, return_counts=True)[1] / len(x)
        return -(p * np.log2(p)).sum()

    got, start, b = quality.block_entropy(ids, sizes), 0, quality.BLOCK
    for size, value in zip(sizes.tolist(), got, strict=True):
        x = ids[start : start + size]
        start += size
        if size < 2:
            assert value == 0
        elif size < b:
            assert np.isclose(value, entropy(x) * np.log2(b) / np.log2(size))
        else:
            at = [min(i, size - b) for i in range(0, size, b)]
            assert np.isclose(value, np.mean([entropy(x[i : i + b]) for i in at]))


def test_keep_quality_keeps_all_columns(spark):
    docs = spark.createDataFrame([(1, "few words", "en", 2.5)], "doc_id long, text string, lang string, extra double")
    assert quality.keep_quality(docs, tokenizer_file("piece_bpe_32k.model")).columns == docs.columns


def test_hosts_and_listed_rules(spark):
    cases = {
        None: ("", "", None), "": ("", "", None), "no-scheme.org/x": ("", "", None), "http://A.Example.ORG/es/1?x#y": ("a.example.org", "/es/1", "example.org/es/"),
        "://org/": ("org", "/", "org/"), "http://x.org": ("x.org", "", None), "http://x.org?/de/": ("x.org", "", None), "h://example.org/en/12": ("example.org", "/en/12", "example.org/en/1"),
        "h://notexample.org/en/12": ("notexample.org", "/en/12", "org/"), "h://a.com/fr/x://y": ("a.com", "/fr/x://y", "com/fr/"), "h://a.com/de/": ("a.com", "/de/", "com/de/"), "h://a.net/de/": ("a.net", "/de/", None), "h://É.com/fr/": ("É.com", "/fr/", "com/fr/"),
    }
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(cases)], "page_id long, url string, host string")
    rows = {r["page_id"]: r for r in url_rules.judge_urls(pages, None).collect()}
    verdicts = dict(url_rules.RULES)
    for i, want in enumerate(cases.values()):
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == want
        assert rows[i]["verdict"] == verdicts.get(want[2], "allow")
    assert url_rules.judge_urls(pages.limit(0), None).count() == 0


def test_mined_rules_against_counting(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(1200):
        host, lang, page = rnd.choice(["good", "spam", "news"]), rnd.choice(["en", "de"]), rnd.choice(["view", "buy"])
        bad = (host == "spam" and page == "buy") or rnd.random() < 0.02
        rows.append((i, f"http://{host}.example.net/{lang}/{page}/{i}?ref=1", bad))
    known = spark.createDataFrame(rows, "page_id long, url string, blocked boolean")
    judged = {r["page_id"]: r["verdict"] for r in url_rules.judge_urls(known.select("page_id", "url"), known.select("url", "blocked")).collect()}
    assert all((judged[i] == "block") == ("spam" in u and "buy" in u) for i, u, _ in rows)
    host, path = url_rules.host_and_path(known["url"])
    rules = url_rules.mine_rules(known.select(url_rules.url_tokens(known["url"], host, path).alias("tokens"), "blocked")).collect()
    assert [r["tokens"] for r in rules] == [["host:spam", "path:buy"]]
    hit = [b for _, u, b in rows if "spam" in u and "buy" in u]
    assert np.isclose(rules[0]["confidence"], sum(hit) / len(hit))
    assert np.isclose(rules[0]["support"], sum(hit) / len(rows))


def test_rules_hold_where_most_urls_are_blocked(spark):
    rows = [(["host:spam", f"path:{i % 2}"], True) for i in range(80)] + [(["host:good", f"path:{i % 2}"], False) for i in range(20)]
    labelled = spark.createDataFrame(rows, "tokens array<string>, blocked boolean")
    rules = {tuple(r["tokens"]): r for r in url_rules.mine_rules(labelled).collect()}
    assert np.isclose(rules["host:spam",]["confidence"], 1)
    assert np.isclose(rules["host:spam",]["lift"], 1.25)
    assert all("host:good" not in t for t in rules)
    every = url_rules.mine_rules(labelled.filter("blocked")).collect()
    assert ["host:spam"] in [r["tokens"] for r in every]


def test_a_rule_may_need_five_tokens(spark):
    all_five = [f"path:{c}" for c in "abcde"]
    rows = [(all_five, True)] * 60 + [([t for t in all_five if t != gone], False) for gone in all_five for _ in range(60)]
    labelled = spark.createDataFrame(rows, "tokens array<string>, blocked boolean")
    assert [(r["tokens"], r["confidence"]) for r in url_rules.mine_rules(labelled).collect()] == [(all_five, 1.0)]


def test_transcripts_recover_roles(spark):
    rnd = random.Random(6)
    rows = []
    for c in range(120):
        for t in range(rnd.randint(2, 7)):
            role = "system" if t == 0 and c % 3 == 0 else "user" if (t + (c % 3 == 0)) % 2 == 0 else "assistant"
            size = {"user": 12, "assistant": 90, "system": 20}[role]
            rows.append((c, t, role, "\n".join(" ".join(rnd.choice(["lorem", "ipsum", "dolor"]) for _ in range(size)) for _ in range(rnd.randint(1, 3)))))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    lines = transcripts.raw_transcripts(table)
    got = {(r["conv_id"], r["turn"]): r for r in transcripts.parse_transcripts(lines, transcripts.train(lines)).collect()}
    right = sum((c, t) in got and got[c, t]["role"] == role and got[c, t]["text"] == text for c, t, role, text in rows)
    assert right >= 0.95 * len(rows)
    one = got[rows[0][0], rows[0][1]]
    assert one["canonical"] == f"<|{one['role']}|>\n{one['text']}\n<|end|>\n"


def test_transcript_defined_cases(spark):
    model = transcripts.fit([[("user", True, "User: hi", False), ("assistant", True, "Assistant: hello there", False), ("assistant", False, "more", True)]] * 20)
    rows = [(1, 1, None), (1, 2, ""), (None, 1, "User: x"), (None, 2, "Assistant: y"), (None, 3, "z"), (2, 1, "User: a"), (2, 1, "User: a")]
    rows += [(3, i, f"{'User' if i % 2 else 'Assistant'}: line {i}") for i in range(2000)]
    lines = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, line_no int, line string, role string")
    got = transcripts.parse_transcripts(lines, model).collect()
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r["turn"]):
        by[r["conv_id"]].append((r["role"], r["text"]))
    assert 1 not in by
    assert by[None] == [("user", "x"), ("assistant", "y\nz")]
    assert by[2] == [("user", "a"), ("user", "a")]
    assert len(by[3]) == 2000
    assert transcripts.parse_transcripts(lines.limit(0), model).count() == 0


def test_transcripts_keep_blank_lines(spark):
    model = transcripts.fit([[("user", True, "User: hi", False), ("assistant", True, "Assistant: hello there", False), ("assistant", False, "more", True)]] * 20)
    text = [None, "User: x", "", "", "Assistant: y", "", None, " ", "z", "", "z", ""]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "conv_id long, line_no int, line string")
    assert [(r["role"], r["text"]) for r in transcripts.parse_transcripts(lines, model).orderBy("turn").collect()] == [("user", "x"), ("assistant", "y\n\n\n\nz\n\nz")]


def test_viterbi_equals_all_paths():
    import itertools

    rnd = np.random.default_rng(3)
    n = len(transcripts.STATES)
    model = transcripts.Model(rnd.normal(size=n), rnd.normal(size=(n, n)), rnd.normal(size=(n, 4)), rnd.normal(size=(n, 20)))
    seen = [(int(rnd.integers(4)), int(rnd.integers(20))) for _ in range(5)]
    best = max(itertools.product(range(n), repeat=5), key=lambda p: model.start[p[0]] + sum(model.trans[a, b] for a, b in itertools.pairwise(p)) + sum(model.kind[s, k] + model.shape[s, f] for s, (k, f) in zip(p, seen, strict=True)))
    d = transcripts.Decoder(model)
    out = [x for i, (k, f) in enumerate(seen) for x in d.push(k, f, i)] + d.finish()
    assert [s for s, _ in out] == list(best)


def test_utf8_of_slices():
    a = pa.array(["é", None, "xyz"]).slice(1)
    raw, at = utf8(strings(a))
    assert raw.tobytes() == b"xyz"
    assert at.tolist() == [0, 0, 3]


def test_a_url_without_a_host_is_allowed_whatever_was_mined(spark):
    rows = [(i, f"http://x{i % 7}.example.net/a?bad=1", True) for i in range(60)] + [(i + 60, f"http://x{i % 7}.example.net/a?good=1", False) for i in range(60)]
    known = spark.createDataFrame(rows, "page_id long, url string, blocked boolean")
    pages = spark.createDataFrame([(1, "no-scheme?bad=1"), (2, "http://y.example.net/b?bad=1"), (3, None)], "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["mined"]) for r in url_rules.judge_urls(pages, known.select("url", "blocked")).collect()}
    assert got == {1: ("allow", False), 2: ("block", True), 3: ("allow", False)}


def test_a_long_text_does_not_end_training(spark):
    rows = [(i, "you vile idiot scum" if i % 2 else "a calm day by the sea", i % 2) for i in range(1, 60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    first = labels.filter(~toxicity.held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").first()["doc_id"]
    longer = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat("text", 200)).otherwise(F.col("text")))
    assert toxicity.train(longer, labels, most_bytes=1500) is not None
    assert toxicity.train(longer, labels, most_bytes=10) is None


def test_a_long_conversation_does_not_end_training(spark):
    rows = [(i, k, role, f"{role} says {k}") for i in range(1, 40) for k, role in enumerate(("system", "user", "assistant"))]
    lines = transcripts.raw_transcripts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    known = lines.filter(~transcripts.held_out(F.col("conv_id")))
    first = known.orderBy(F.xxhash64("conv_id"), "conv_id").first()["conv_id"]
    longer = lines.withColumn("line", F.when(F.col("conv_id") == first, F.concat("line", F.repeat(F.lit(" x"), 3000))).otherwise(F.col("line")))
    small, none = transcripts.train(longer, most_bytes=5000), transcripts.train(lines.limit(0))
    assert not np.allclose(small.trans, none.trans)
