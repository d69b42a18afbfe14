"""Toxicity, passages, secrets, lines, n-gram join and decontamination against plain versions of the same rules."""

import hashlib
import math
import random
import re
import string
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.llm import components, contamination, lines, ngram_join, passages, secrets, shingles, toxicity

from .conftest import WORDS


def tokens(text):
    return [w.strip(string.punctuation) or w for w in re.split(r"[\t-\r\x1c-\x20]+", (text or "").lower()) if w]


def shingle_set(text):
    w = tokens(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def sentence(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


# -- shingles --


def test_words_and_shingles():
    texts = ["Hello, hello world! -- 'It' É", "", None, "a b", "x" * 5000, "one two three four five six", "no\x1cbreak here"]
    hashes, offsets, (data, first, end, _) = shingles.words(pa.array(texts))
    got = [bytes(data[a:b]).decode() for a, b in zip(first, end, strict=True)]
    assert got == [w for t in texts for w in tokens(t)]
    assert [int(n) for n in np.diff(offsets)] == [len(tokens(t)) for t in texts]
    assert len(set(hashes.tolist())) == len(set(got))
    own, at = shingles.shingles(pa.array(texts))
    assert [int(n) for n in np.diff(at)] == [max(len(tokens(t)) - 4, min(1, len(tokens(t)))) for t in texts]
    again, _ = shingles.shingles(pa.array(["zzz " * 9, texts[5]]))
    assert again[-2:].tolist() == own[at[5] : at[6]].tolist()
    assert len(shingles.words(pa.array([], pa.string()))[0]) == 0


# -- components --


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, rng.randint(101, 150)) for _ in range(40)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- 1 --


def toxic_rows(rng, n):
    rows, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        words = rng.choices(WORDS, k=rng.randint(5, 200))
        if toxic:
            for _ in range(2):
                words[rng.randrange(len(words))] = rng.choice(["rotten", "vile", "foul" + rng.choice(["ly", "est", "ing"])])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_gradients():
    p = toxicity.ToxicParams(window=4, char_dim=3, char_state=3, word_dim=2, state=3)
    net = toxicity.Network(p, ["ab"], ["a", "b", "c"])
    rows = np.array([[1, 2], [2, 3], [3, 0], [1, 0]], np.int32)
    y, weight = np.array([1.0, 0.0], np.float32), np.ones(2, np.float32)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    caught = {}
    net._update = caught.update
    words = ["ab", "abc", "c"]
    net.step(words, rows, y, weight)
    for name, value in net.w.items():
        for place in list(np.ndindex(value.shape))[:: max(1, value.size // 5)]:
            if name == "words" and place[0] == 0:
                continue
            keep, loss = value[place], []
            for h in (1e-3, -1e-3):
                value[place] = keep + h
                loss.append(net.step(words, rows, y, weight))
            value[place] = keep
            net.step(words, rows, y, weight)
            assert caught[name][place] == pytest.approx((loss[0] - loss[1]) / 2e-3, rel=0.08, abs=2e-4), (name, place)


def plain_score(net, text, known=None):
    """One number at a time: every word's letters, every window of words, attention, the worst window. known: vectors of words
    met before."""
    known = {} if known is None else known
    p, w = net.p, {k: v.astype(float).tolist() for k, v in net.w.items()}

    def sigmoid(x):
        return 1 / (1 + math.exp(-x))

    def dot(x, table, column):
        return sum(a * row[column] for a, row in zip(x, table, strict=True))

    def run(inputs, name, n):
        h, out = [0.0] * n, []
        for x in inputs:
            g = [dot(h, w[name + "_u"], j) for j in range(3 * n)]
            a = [dot(x, w[name + "_w"], j) + w[name + "_b"][j] for j in range(3 * n)]
            z, r = ([sigmoid(a[k * n + j] + g[k * n + j]) for j in range(n)] for k in (0, 1))
            c = [math.tanh(a[2 * n + j] + r[j] * g[2 * n + j]) for j in range(n)]
            h = [h[j] + (1 - z[j]) * (c[j] - h[j]) for j in range(n)]
            out.append(h)
        return out

    def vector(word):
        if word not in known:
            known[word] = spelled(word)
        return known[word]

    def spelled(word):
        own = [w["letters"][net.letter_no.get(c, len(net.letter_no) + 1)] for c in word]
        return run(own, "cf", p.char_state)[-1] + run(own[::-1], "cb", p.char_state)[-1] + w["words"][net.word_no.get(word, 0)]

    words = re.findall(r"[^\W_](?:\S{0,22}[^\W_])?|(?<!\S)(?:[^\w\s]|_){1,24}", (text or "").lower())
    best = -math.inf
    for start in range(0, max(1, len(words) - p.window + p.stride), p.stride):
        x = [vector(v) for v in words[start : start + p.window]]
        both = [a + b for a, b in zip(run(x, "f", p.state), run(x[::-1], "b", p.state)[::-1], strict=True)]
        e = [math.exp(sum(a * b for a, b in zip(s, w["att"], strict=True))) for s in both]
        pooled = [sum(a * s[j] for a, s in zip(e, both, strict=True)) / sum(e) for j in range(2 * p.state)] if both else [0.0] * (2 * p.state)
        best = max(best, sum(a * b for a, b in zip(pooled, w["out"], strict=True)) + w["bias"][0])
    return sigmoid((best - net.shift) * net.scale + math.log(0.7 / 0.3))


def test_scores_like_plain(make_docs):
    rng = random.Random(9)
    rows, labels = toxic_rows(rng, 60)
    p = toxicity.ToxicParams(rounds=1, steps=8, window=6, stride=4, char_dim=4, char_state=3, word_dim=2, state=3, letters=9)
    net = toxicity.fit([t for _, t in rows], [y for _, y in labels], p)
    texts = [t for _, t in rows[:12]] + ["", None, "!!! ???", "v@le r0tten, (well-known) under_score", "x" * 100, "日本 é"]
    got = toxicity.score_batch(net, pa.array(texts), toxicity.Memo())
    assert got.tolist() == pytest.approx([plain_score(net, t) for t in texts], abs=2e-5)
    assert len(net.letter_no) == 9


def test_toxicity(spark, make_docs):
    rng = random.Random(2)
    rows, labels = toxic_rows(rng, 400)
    rows += [(1000, None), (1001, ""), (None, "vile"), (1002, "alpha " * 30_000 + "rotten"), (0, rows[0][1])]
    marks = spark.createDataFrame([*labels, (1000, None), (None, 1), (5, labels[5][1])], "doc_id bigint, toxic int")
    p = toxicity.ToxicParams(rounds=3, steps=40)
    got = toxicity.score(make_docs(rows), marks, p).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    held = [(by_id[i]["predicted"], y) for i, y in labels if by_id[i]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert by_id[1000]["score"] == by_id[1001]["score"] and by_id[1001]["predicted"] == 0
    assert by_id[1002]["predicted"] == 1  # the last window counts
    kept = toxicity.remove(make_docs(rows), marks, p)
    assert kept.columns == make_docs(rows).columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if not r["predicted"]}
    none = toxicity.score(make_docs(rows[:3]), marks.limit(0), p).collect()
    assert [r["score"] for r in none] == [0.0] * 3
    assert toxicity.score(make_docs(rows).limit(0), marks, p).count() == 0


# -- 2 --


def plain_passages(docs, length):
    starts = {}
    texts = [(t or "").encode() for _, t in docs]
    for b in texts:
        for s in range(len(b) - length + 1):
            starts[b[s : s + length]] = starts.get(b[s : s + length], 0) + 1
    out = []
    for b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if starts[b[s : s + length]] > 1:
                gone[s : s + length] = True
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_passages(make_docs, seed):
    rng = random.Random(seed)
    shared = [sentence(rng, 30) for _ in range(4)]
    docs = []
    for i in range(50):
        parts = [sentence(rng, rng.randint(0, 25)) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            parts.insert(rng.randrange(len(parts) + 1), s[rng.randint(0, 40) : rng.randint(100, len(s))])
        docs.append((i, " ".join(parts)))
    docs += [(100, docs[1][1]), (101, docs[1][1]), (102, None), (103, ""), (104, "é" * 70), (105, "ab" * 400), (106, "x" * 63), (1, docs[1][1]), (None, docs[2][1] + "!")]
    length = 64
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in passages.remove(make_docs(docs), length, 12).collect())
    assert got == sorted((i or -1, *x) for (i, _), x in zip(docs, plain_passages(docs, length), strict=True))


def test_passages_edges(make_docs, monkeypatch):
    assert passages.remove(make_docs([(1, "x")]).limit(0)).count() == 0
    with pytest.raises(ValueError, match="gram"):
        passages.remove(make_docs([(1, "x")]), 10, 11)
    rng = random.Random(5)
    long = sentence(rng, 900)
    docs = [(1, long), (2, long[700:3000] + "tail")]
    monkeypatch.setattr(passages, "_PIECE", 1024)  # texts in pieces give the same
    got = [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in passages.remove(make_docs(docs), 100, 20).orderBy("doc_id").collect()]
    assert got == plain_passages(docs, 100)


# -- 3 --


def plain_base(text):
    key = "(password|passwd|secret|token|api_?key)"
    key = re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", key)
    found = [("assign", m.span()) for m in re.finditer(key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [("access", m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    kinds = ["assign", "access", "hex"]
    found.sort(key=lambda x: (x[1][0], kinds.index(x[0])))
    base = ",".join(f"{k}:{a}:{b}" for k, (a, b) in found)
    return (*(sum(k == x for k, _ in found) for x in kinds), hashlib.sha256(base.encode()).hexdigest()), base


def test_secrets(make_docs):
    rng = random.Random(4)
    planted = ["password: hunter22", "TOKEN='abcdef-1'", "api_key = short", "apikey=\"Zx9/+_.=-a\"", "AKIA" + "A1" * 8, "AKIA" + "B" * 15, "deadbeef" * 3, "deadbeef" * 2, "ſecret=abcdefgh", "toKen=abcdefgh",
               "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOiJI.eyJzdWIiOiIx.abc", "Bearer abcdefghijklmnop12", "ftp://me:pass@h/x", "password:password=secret1"]
    docs = []
    for i in range(150):
        words = rng.choices([*WORDS, "é日本", "pass", "tok", "bad"], k=rng.randint(0, 40))
        for _ in range(rng.randint(0, 2)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(planted))
        docs.append((i, rng.choice([" ", "\n", ""]).join(words)))
    docs += [(200, None), (201, ""), (None, planted[0]), (202, "z" * 300_000 + planted[1]), (0, docs[0][1]), (203, "0123456789abcdef" * 4000)]
    got = secrets.scan(make_docs(docs)).collect()
    want = sorted((i if i is not None else -1, *plain_base(t or "")[0]) for i, t in docs)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == want
    base_only = secrets.scan(make_docs(docs), ()).collect()
    assert sorted(r["spans"] for r in base_only) == sorted(plain_base(t or "")[1] for _, t in docs)
    said = " ".join(r["spans"] for r in got)
    assert all(k in said for k in ("key_block", "web_token", "bearer", "login_url"))
    assert secrets.scan(make_docs(docs).limit(0)).count() == 0


def test_trigram_queries():
    q = secrets.trigram_query
    assert q("[0-9a-f]+") is secrets.ALL and q("a.c") is secrets.ALL
    assert secrets.trigrams_of(q("AKIA[A-Z0-9]+")) == {"aki", "kia"}
    assert q("abc|xyz") == ("or", "abc", "xyz")
    assert secrets.trigrams_of(q(secrets.BASE[0].pattern)) >= {"pas", "sec", "tok", "api", "key"}
    assert "://" in secrets.trigrams_of(q(secrets.MORE[3].pattern))


# -- 4 --


def near_corpus(rng, n):
    docs = []
    for i in range(n):
        if docs and rng.random() < 0.6:
            words = rng.choice(docs)[1].split()
            for _ in range(rng.randint(0, 4)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(WORDS)
            text = " ".join(words)
            text = text.upper() if rng.random() < 0.1 else text
        else:
            text = sentence(rng, rng.choice([1, 3, 5, 8, 40, 80, 120]))
        docs.append((i, text))
    return docs


def plain_links(docs):
    sets = [shingle_set(t) for _, t in docs]
    links, root = [0] * len(docs), list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return links, [find(i) for i in range(len(docs))], sets


@pytest.mark.parametrize("chunk", [64, 8])
def test_ngram_join(make_docs, monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    rng = random.Random(chunk)
    docs = near_corpus(rng, 180)
    docs += [(300, None), (301, ""), (302, "... !"), (303, docs[0][1]), (304, sentence(rng, 9000))]
    links, classes, sets = plain_links(docs)
    got = {r["doc_id"]: r for r in ngram_join.join(make_docs(docs)).collect()}
    assert len(got) == len(docs)
    for k, (i, _) in enumerate(docs):
        assert (got[i]["n_links"], got[i]["class_id"], got[i]["n_shingles"]) == (links[k], docs[classes[k]][0], len(sets[k])), i
    kept = ngram_join.keep_one(make_docs(docs))
    assert kept.columns == make_docs(docs).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r["class_id"] for r in got.values()})


def test_ngram_join_edges(make_docs):
    same = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (2, None)]
    got = [(r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.join(make_docs(same)).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, 2), (1, 1, 2), (None, 1, 2), (2, 2, 0), (2, 2, 0)], key=str)
    assert sorted(r["doc_id"] for r in ngram_join.keep_one(make_docs(same)).collect()) == [1, 2, 2]
    nulls = [(None, "q w e r t y"), (None, "q w e r t y")]
    assert ngram_join.keep_one(make_docs(nulls)).count() == 1
    assert ngram_join.join(make_docs(same).limit(0)).count() == ngram_join.keep_one(make_docs(same).limit(0)).count() == 0


def test_bayes():
    least = ngram_join.least_matches(0.8, 1e-6)
    assert all(0.3 * n < m < 0.8 * n for n, m in least.items()) and list(least.values()) == sorted(least.values())


# -- 5 --


def plain_lines(docs):
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0))
    seen, out = [], [[] for _ in docs]
    for k in order:
        for n, line in enumerate((docs[k][1] or "").split("\n")):
            own = frozenset(tokens(line))
            if own:
                if any(len(own & x) >= 0.8 * len(own | x) - 1e-9 for x in seen):
                    out[k].append(n)
                seen.append(own)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_lines(make_docs, seed):
    rng = random.Random(seed)
    pool = [sentence(rng, rng.randint(1, 14)) for _ in range(40)] + ["", "!!", "a b c d", "a b c d e"]
    docs = []
    for i in range(60):
        own = []
        for _ in range(rng.randint(1, 8)):
            words = rng.choice(pool).split(" ")
            if rng.random() < 0.4:
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            own.append(" ".join(words))
        docs.append((i, "\n".join(own)))
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, " ".join(f"w{i}" for i in range(3000))), (104, " ".join(f"w{i}" for i in range(40, 3000))), (None, docs[0][1])]
    got = {r["doc_id"]: r for r in lines.remove(make_docs(docs)).collect()}
    for (i, t), gone in zip(docs, plain_lines(docs), strict=True):
        assert got[i]["removed"] == gone and got[i]["n_removed"] == len(gone), i
        assert got[i]["n_lines"] == len((t or "").split("\n"))
    texts = {r["doc_id"]: r["text"] for r in lines.cut(make_docs(docs)).collect()}
    for (i, t), gone in zip(docs, plain_lines(docs), strict=True):
        assert texts[i] == "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone)


@pytest.mark.parametrize("base", [0, 10_000_000, 2**50])
def test_lines_long_lists(make_docs, base):
    """Lists of more than SMALL sets, several variants in one document, and sets met first in later documents."""
    rng = random.Random(7)
    pool = [rng.sample(WORDS, 12) for _ in range(8)]
    docs = []
    for i in range(40):
        own = []
        for _ in range(rng.randint(1, 12)):
            words = list(rng.choice(pool))
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            own.append(" ".join(words[: rng.randint(8, 12)]))
        docs.append((base + i, "\n".join(own)))
    rng.shuffle(docs)
    got = {r["doc_id"]: r["removed"] for r in lines.remove(make_docs(docs)).collect()}
    assert got == {i: gone for (i, _), gone in zip(docs, plain_lines(docs), strict=True)}


def test_lines_null_ids(make_docs):
    """A null doc_id comes last, and its lines are met nowhere else in its task."""
    docs = [(5, "a b c d e f g h i j"), (9, "k l m n o p q r s t"), (None, "a b c d e f g h i z\nk l m n o p q r s t u\na b c k l m"), (2**63 - 1, "k l m n o p q r s x")]
    got = {r["doc_id"]: r["removed"] for r in lines.remove(make_docs(docs)).collect()}
    assert got == {5: [], 9: [], None: [0, 1], 2**63 - 1: [0]}


def test_lines_of_millions_of_words():
    """Two sets of 2,000,000 words whose rarest shared word is the 200,000th of each may match at 0.8."""
    size = int(lines.posting_size(np.array([2_000_000]), np.array([200_000]))[0])
    rows = {"list": [7, 7], "s1": [1, 2], "doc": [1, 2], "row": [0, 0], "size": [size, size], "m1": [0, 0], "m2": [0, 0]}
    got = lines.pairs_of([np.array(v) for v in rows.values()], 0.8, False)
    assert (got["a1"].to_pylist(), got["b1"].to_pylist()) == ([2], [1])


@pytest.mark.parametrize("seed", range(3))
def test_lines_split_lists(make_docs, monkeypatch, seed):
    """Words that nearly all sets share, lists split by a second word, and sets whose first candidates fail."""
    for name, value in (("LONG", 4), ("SAMPLED", 1), ("SMALL", 2), ("EARLIEST", 1)):
        monkeypatch.setattr(lines, name, value)
    rng = random.Random(seed)
    pool = [rng.sample(WORDS, 14) for _ in range(6)]
    docs = []
    for i in range(50):
        own = []
        for _ in range(rng.randint(1, 10)):
            words = list(rng.choice(pool))
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            own.append("hot " + " ".join(words[: rng.randint(9, 14)]))
        docs.append((i, "\n".join(own)))
    rng.shuffle(docs)
    got = {r["doc_id"]: r["removed"] for r in lines.remove(make_docs(docs)).collect()}
    assert got == {i: gone for (i, _), gone in zip(docs, plain_lines(docs), strict=True)}


def test_lines_split_keys():
    """Sets that match share a list however the split words lie."""
    rng = np.random.default_rng(3)
    split = np.sort(rng.choice(200, 60, replace=False)).astype(np.int64)
    for _ in range(200):
        n = int(rng.integers(4, 40))
        a = np.sort(rng.choice(200, n, replace=False)).astype(np.int64)
        b = a.copy()
        b[rng.choice(n, n // 9, replace=False)] = rng.choice(np.arange(200, 300), n // 9, replace=False)
        b = np.unique(b)
        if len(np.intersect1d(a, b)) < 0.8 * len(np.union1d(a, b)) - 1e-9:
            continue
        keys = []
        for x in (a, b):
            k = min(len(x), int(lines.prefix_length(np.array([len(x)]), 0.8)[0]) + 1)
            keys.append(set(lines.keys_of(np.array([0, k]), x[:k], np.arange(k), np.array([len(x)]), split, 0.8)[0].tolist()))
        assert keys[0] & keys[1]


def test_lines_pairs_like_plain():
    """Pairs of a list as plain loops give them, whether or not its rows' order fits into one word."""
    rng = np.random.default_rng(11)
    for low, high in ((0, 50), (0, 10**9), (-(2**63), 2**63 - 1)):
        size = 400
        sid = rng.integers(1, 60, size)
        n = 36 + sid % 12
        marks = np.bitwise_and.reduce(rng.integers(0, 2**63, (5, 60, 2)))
        rows = [rng.integers(0, 9, size), sid, rng.integers(low, high, size), rng.integers(0, 5, size), lines.posting_size(n, rng.integers(0, 2, size)), marks[sid, 0], marks[sid, 1]]
        want = set()
        for key in range(9):
            kept = {}
            for r in sorted((r for r in zip(*(x.tolist() for x in rows), strict=True) if r[0] == key), key=lambda r: (r[2], r[3], r[1])):
                kept.setdefault(r[1], r)
            for i, x in enumerate(kept.values()):
                for y in list(kept.values())[:i]:
                    (nx, px), (ny, py) = (divmod(r[4], 1 << 32) for r in (x, y))
                    shared = np.ceil(0.8 / 1.8 * (nx + ny) - 1e-9)
                    bound = (nx + ny - sum((x[k] ^ y[k]).bit_count() for k in (5, 6))) // 2
                    if min(nx, ny) >= 0.8 * max(nx, ny) - 1e-9 and min(nx - px, ny - py) >= shared and bound >= shared:
                        want.add((x[1], y[1], bound * 1000 // max(1, nx + ny - bound)))
        got = lines.pairs_of([*rows, np.ones(size, np.int64)], 0.8, True).to_pydict()
        assert want and sorted(want) == sorted(zip(got["a1"], got["b1"], got["bound"], strict=True))


def test_lines_marks():
    """Marks never rule out what two sets share, and tell sets apart that share hundreds of words."""
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 2**63, int(k), dtype=np.uint64) for k in rng.integers(1, 60, 40)]
    shared = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets += [np.concatenate((shared, rng.integers(0, 2**63, 60, dtype=np.uint64))) for _ in range(2)] + [np.concatenate((sets[0], x)) for x in sets[1:9]]
    marks = lines.set_marks(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(x) for x in sets]))), 7).tolist()
    differ = [[sum(((x ^ y) % 2**64).bit_count() for x, y in zip(a, b, strict=True)) for b in marks] for a in marks]
    for a, row in zip(sets, differ, strict=True):
        for b, d in zip(sets, row, strict=True):
            assert len(np.intersect1d(a, b)) <= (len(a) + len(b) - d) // 2
    assert differ[40][41] > 30


def test_lines_read_again(monkeypatch):
    """To verify lines, just these are split into words."""
    texts = ["", "Ein Wort\n\n\u0130stanbul, \u00c4pfel! \u00c4pfel\n", None, "\n", "a b c", "x\ny z\nx y z"]
    wanted = [(1, 0), (1, 2), (4, 0), (5, 1)]
    held = SimpleNamespace(value=np.zeros(lines.BUCKETS, np.int64))
    read, split = [], lines.line_words
    monkeypatch.setattr(lines, "line_words", lambda column: read.extend(column.to_pylist()) or split(column))
    row = np.arange(10, 16)
    places = np.sort(lines.line_places(row[[i for i, _ in wanted]], np.array([k for _, k in wanted])))
    numbers = [[k for i, k in wanted if i == j] for j in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(row), pa.array(numbers, pa.list_(pa.int32()))], ["text", "row", "wanted"])
    for way in (SimpleNamespace(value=places), None):
        read.clear()
        got = pa.Table.from_batches(lines._words_of(held, way)(iter([batch])))
        assert read == [texts[i].split("\n")[k] for i, k in wanted]
        whole = next(lines._lines(held, 0.8)(iter([pa.RecordBatch.from_arrays([pa.array(row), pa.array([b""] * len(texts)), pa.array(texts)], ["doc_id", "key", "text"])])))
        sets = {(i - 10, k): (a, b, n) for i, k, a, b, n in zip(*(whole[c].to_pylist() for c in ("doc_id", "line", "s1", "s2", "n")), strict=True)}
        assert list(zip(got["s1"].to_pylist(), got["s2"].to_pylist(), map(len, got["words"].to_pylist()), strict=True)) == [sets[x] for x in wanted]


@pytest.mark.parametrize("limits", [{"MOST_PLACES": 0}, {"FEW_PLACES": 0}, {"COUNTED": 1}])
def test_lines_ways(make_docs, monkeypatch, limits):
    """Whatever rows are counted, and however the lines to verify are found, the same lines go."""
    for name, value in {"LONG": 4, "SAMPLED": 1, "SMALL": 2, "EARLIEST": 1, **limits}.items():
        monkeypatch.setattr(lines, name, value)
    rng = random.Random(5)
    pool = [rng.sample(WORDS, 12) for _ in range(6)]
    docs = []
    for i in [*range(40), None]:
        own = []
        for _ in range(rng.randint(1, 8)):
            words = list(rng.choice(pool))
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            own.append(" ".join(words[: rng.randint(9, 12)]))
        docs.append((i, "\n".join(own) + "\n"))
    got = {r["doc_id"]: r["removed"] for r in lines.remove(make_docs(docs)).collect()}
    assert got == {i: gone for (i, _), gone in zip(docs, plain_lines(docs), strict=True)}


def test_lines_edges(make_docs):
    got = lines.remove(make_docs([(1, "a b\nc d"), (1, "a b\nc d"), (2, "a b")])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0), (1, 0), (2, 1)]  # rows alike fare alike
    assert lines.remove(make_docs([(1, "x")]).limit(0)).count() == 0
    with pytest.raises(ValueError, match="threshold"):
        lines.remove(make_docs([(1, "x")]), 0.5)


# -- 7 --


def test_contamination(spark, make_docs, monkeypatch):
    rng = random.Random(6)
    items = [(i, sentence(rng, rng.choice([1, 4, 6, 12, 20, 45, 90, 300]))) for i in range(60)]
    items += [(100, None), (101, ""), (102, items[5][1]), (None, items[6][1])]
    docs = []
    for i in range(120):
        parts = [sentence(rng, rng.randint(0, 60)) for _ in range(3)]
        if i % 3 == 0:
            words = rng.choice(items[:60])[1].split()
            if i % 2 and len(words) > 30:
                words[len(words) // 2] = "other"
            parts.insert(1, " ".join(words).upper() if i % 5 == 0 else " ".join(words))
        docs.append((i, "\n".join(parts)))
    docs += [(200, None), (201, ""), (202, sentence(rng, 20_000) + " " + items[7][1]), (0, docs[0][1]), (None, items[20][1])]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    want = []
    for i, t in docs:
        own = shingle_set(t)
        for k, x in items:
            need = shingle_set(x)
            if need and len(need & own) >= 0.8 * len(need):
                want.append((i, k, len(need), len(need & own)))
    for most in (7, 20_000):  # by a join, and by an index in all tasks
        monkeypatch.setattr(contamination, "MOST_ITEMS", most)
        got = [(r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in contamination.search(make_docs(docs), table).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        kept = contamination.remove(make_docs(docs), table)
        assert kept.columns == make_docs(docs).columns
        assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((i for i, _ in docs if i not in {x[0] for x in want}), key=str)
    assert contamination.search(make_docs(docs), table.limit(0)).count() == contamination.search(make_docs(docs).limit(0), table).count() == 0
    assert contamination.remove(make_docs(docs), table.limit(0)).count() == len(docs)


def test_contamination_short_items():
    """Items of few shingles between other words, whose shingles may hide theirs, are all found."""
    rng = random.Random(8)
    items = [" ".join(f"i{k}x{n}" for n in range(rng.choice([5, 6, 8]))) for k in range(1000)]
    docs = [f"{sentence(rng, 30)} {x} {sentence(rng, 30)}" for x in items]
    index = contamination.ItemIndex(list(range(len(items))), pa.array(items))
    assert index.candidates(*shingles.shingles(pa.array(docs))) >= {(k, k) for k in range(len(items))}


def test_columns_are_left_alone(make_docs):
    mine = {k: F.lit("mine") for k in ("_id", "_id_or", "_id_none", "_none", "root", "set_id")}
    kept = ngram_join.keep_one(make_docs([(1, "x y z"), (2, "x y z")]).withColumns(mine)).collect()
    assert len(kept) == 1 and all(kept[0][k] == "mine" for k in mine)
    df = make_docs([(1, "x y z")]).withColumn("n_removed", F.lit("mine")).withColumn("digest", F.lit(1))
    assert passages.remove(df).count() == lines.remove(df).count() == secrets.scan(df).count() == ngram_join.join(df).count() == 1
