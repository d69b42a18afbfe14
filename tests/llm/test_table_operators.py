"""Sharding, url filter, top-k search, mixing and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import mixing, sharding, topk, toxicity, url_filter

from .conftest import WORDS
from .test_text_operators import plain_links, plain_score, shingle_set


def plain_pack(vectors, shards):
    """Groups, the largest first, where the dot product with what is left is highest; in plain loops."""
    total = [sum(v[d] for v in vectors) or 1 for d in range(3)]
    share = [[v[d] / total[d] for d in range(3)] for v in vectors]
    left = [[1 / shards] * 3 for _ in range(shards)]
    out = [0] * len(vectors)
    for i in sorted(range(len(vectors)), key=lambda i: (-max(share[i]), i)):
        fits = [sum(a * b for a, b in zip(own, share[i], strict=True)) for own in left]
        top = max(fits)
        out[i] = next(s for s, x in enumerate(fits) if x > top - 1e-15)
        left[out[i]] = [a - b for a, b in zip(left[out[i]], share[i], strict=True)]
    return out


def test_pack():
    rng = np.random.default_rng(1)
    v = rng.integers(1, 1000, (2000, 3)).astype(float)
    loads = np.stack([v[sharding.pack(v, 16) == s].sum(axis=0) for s in range(16)])
    assert (loads.max(axis=0) / loads.mean(axis=0)).max() < 1.01
    for n in (1, 7, 60):
        assert sharding.pack(v[:n], 5).tolist() == plain_pack(v[:n].tolist(), 5)
    assert len(sharding.pack(np.zeros((0, 3)), 4)) == 0
    assert set(sharding.pack(np.zeros((5, 3)), 4)) <= {0, 1, 2, 3}


def test_packed_like_plain(make_docs):
    """One cell, no piece and no move: the shards are those of the plain packer. Many cells are balanced all the same."""
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices(WORDS, k=rng.randint(2, 60)))) for i in range(700)] + [(900 + i, "twice and more") for i in range(5)] + [(990, "long " * 20_000)]
    p = sharding.ShardParams(shards=4, movable=1)
    groups = {}
    for _, t in docs:
        v = groups.setdefault(hashlib.md5(t.encode()).digest(), [0, 0, 0])
        groups[hashlib.md5(t.encode()).digest()] = [v[0] + len(t.encode()) + 1, v[1] + len(t.split()), v[2] + 1]
    keys = sorted(groups)
    where = plain_pack([groups[k] for k in keys], 4)
    got = sharding.packed(make_docs(docs).sparkSession.createDataFrame([(bytearray(k), 0, *groups[k]) for k in keys], sharding.ITEMS), p).collect()
    same = sum(dict(zip(keys, where, strict=True))[bytes(r["group"])] == r["shard"] for r in got)
    assert len(got) == len(keys) and same >= len(keys) - 20  # all but those that are moved in the end
    for per_cell in (50, 20_000):
        size, rows = Counter(), sharding.shard(make_docs(docs[:-1]), sharding.ShardParams(shards=4, per_cell=per_cell)).collect()
        for r in rows:
            size[r["shard"]] += r["size"]
        assert len(rows) == len(docs) - 1 and max(size.values()) - min(size.values()) < 0.01 * sum(size.values())
        where = {}
        for r in rows:
            where.setdefault(r["text_crc32"], set()).add(r["shard"])
        assert all(len(x) == 1 for x in where.values())  # equal texts stay together


def test_sharding(make_docs):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 60)))) for i in range(900)]
    docs += [(1000 + i, "hot text") for i in range(600)] + [(5000, None), (5001, ""), (None, "n"), (None, "n"), (7, docs[7][1])]
    got = sharding.shard(make_docs(docs)).collect()
    assert len(got) == len(docs)
    text = dict(docs)
    slots = {}
    for r in got:
        own = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(own) + 1, zlib.crc32(own), "bytes", None)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    size = Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    assert max(size.values()) - min(size.values()) < 0.02 * sum(size.values()) / 16 + 10
    assert sharding.shard(make_docs(docs).limit(0)).count() == 0
    assert sharding.shard(make_docs([(1, "one")])).first()["slot"] == 0


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    at = min([k for k in (rest.find(c) for c in "/?#") if k >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
    path = rest[at:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


def test_url_filter(spark):
    rng = random.Random(3)
    urls = [None, "", "no scheme", "http://", "://x", "http://NET/a", "http://a.net", "http://a.net/x?y#z", "http://a.net?x=/en/", "http://Example.NET/en/1", "https://b.example.com/de/", "http://example.com/den", "http://x.org/fr/1://2", "http://É.NET/a\nb"]
    for i in range(600):
        host = f"{rng.choice(['www', 'blog', 'm'])}.{rng.choice(['one', 'two', 'example'])}.{rng.choice(['net', 'com', 'org'])}"
        urls.append(f"https://{host}/{rng.choice(['en', 'de', 'fr'])}/{rng.choice([str(i), f'{i}.html', 'about', 'tag-' + str(i)])}")
    urls += urls[20:25]
    got = url_filter.filter_urls(spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id bigint, url string, host string")).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, rule = plain_rule(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[0])
        assert r["verdict"] == rule[1] if rule else r["verdict"] in ("allow", "block")
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id bigint, url string")).count() == 0
    assert url_filter.filter_urls(spark.createDataFrame([(1, "http://a/b")], "page_id bigint, url string"), ()).first()["verdict"] == "allow"


def test_template_purity(spark):
    """A template whose labelled pages are nearly all blocked is rejected; its siblings are not."""
    rules = tuple(("block", "h.com", f"/ads/{i}/") for i in range(40)) + tuple(("allow", "h.com", f"/news/{i}/") for i in range(40))
    urls = [f"http://h.com/{k}/{i}/p{j}" for k in ("ads", "news") for i in range(60) for j in range(2)] + [f"http://other.com/ads/{i}/x" for i in range(20)]
    got = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), rules).collect()
    for r in got:
        if r["rule"] is None:
            assert r["verdict"] == ("block" if r["host"] == "h.com" and r["path"].startswith("/ads/") else "allow"), r


def test_deep_paths(spark, monkeypatch):
    """Templates are learned at any depth; a long list of rules gives the same verdicts as a short one."""
    rules = (*(("block", "h.com", f"/a/b/c/d/ads/{i}/") for i in range(40)), *(("allow", "h.com", f"/a/b/c/d/news/{i}/") for i in range(40)), ("allow", "x.h.com", "/"))
    urls = [f"http://h.com/a/b/c/d/{k}/{i}/p{j}" for k in ("ads", "news") for i in range(60) for j in range(2)] + ["http://x.h.com/q/1/p", "http://h.com/" + "s/" * 40, "http://q.com/" + "z" * 200_000 + "/1"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    seen = []
    for written in (200, 0):
        monkeypatch.setattr(url_filter, "WRITTEN", written)
        got = url_filter.filter_urls(df, rules).collect()
        assert len(got) == len(urls)
        for r in got:
            if r["rule"] is None and r["host"] == "h.com" and r["path"].startswith("/a/"):
                assert r["verdict"] == ("block" if "/ads/" in r["path"] else "allow"), r
        assert {r["rule"] for r in got if r["host"] == "x.h.com"} == {"x.h.com/"}
        seen.append(sorted((r["page_id"], r["rule"] or "", r["verdict"], r["template"]) for r in got))
    assert seen[0] == seen[1]


def plain_topk(rows, k=5):
    own = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in own:
        if q % 50 == 0:
            hits = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in own if i != q and len(b) == len(a))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(hits)}
    return out


def test_topk(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=8))]) for i in range(700)]
    rows += [(1000 + i, [0.5] * 8) for i in range(400)]
    rows += [(2000, None), (2050, [1.0, None] + [0.0] * 6), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (2200, []), (2250, [1.0, 2.0]), (2251, [3.0, 4.0]), (None, [9.0] * 8), (2300, [0.0] * 8), (2350, [1e12] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    monkeypatch.setattr(topk, "LEAF", 16)
    want = plain_topk([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    for block in (4096, 5):
        got = {tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0, query_block=block).collect()}
        assert got == want
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    with pytest.raises(ValueError, match="k must"):
        topk.search(df, F.lit(True), k=0)


def plain_shares(nodes, given):
    """Water filling by bisection. nodes: {name: (cap, weight)}"""
    total = sum(c for c, w in nodes.values() if w > 0)
    low, high = 0.0, 1e15
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(c, mid * w) for c, w in nodes.values()) < min(given, total) else (low, mid)
    return {k: min(c, high * w) for k, (c, w) in nodes.items()}


def test_budgets(spark):
    rng = random.Random(5)
    leaves = [(d, lang, s, rng.choice([0, 5, 50, 500, 5000])) for d in ("d0", "d1", "d2") for lang in ("en", "de", "xx") for s in ("a", "b")]
    p = mixing.MixParams(share=0.7, max_epochs=2)
    got = {r[:3]: r["given"] for r in mixing.budgets(spark.createDataFrame(leaves, "domain string, language string, origin string, tokens bigint"), p).collect()}
    cap = Counter()
    for d, lang, s, t in leaves:
        for k in ((d,), (d, lang), (d, lang, s)):
            cap[k] += 2 * t
    top = plain_shares({d: (cap[(d,)], p.domain_weights.get(d, 1)) for d in ("d0", "d1", "d2")}, int(0.7 * sum(t for *_, t in leaves)))
    for d in top:
        mid = plain_shares({x: (cap[(d, x)], p.language_weights.get(x, 1)) for x in ("en", "de", "xx")}, top[d])
        for lang in mid:
            low = plain_shares({s: (cap[(d, lang, s)], 1) for s in ("a", "b")}, mid[lang])
            for s in low:
                assert got[(d, lang, s)] == pytest.approx(low[s], abs=4), (d, lang, s)


def test_mix(make_docs):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 40))), rng.choice(["en", "de", "fr", None]), rng.choice(["src0", "src1", "src2", "src7", "odd", None])) for i in range(500)]
    docs += [(900, None, "en", "src0"), (901, "", "en", "src0"), (None, "some words here", "de", "src1"), (3, docs[3][1], docs[3][2], docs[3][3])]
    p = mixing.MixParams(share=0.8)
    got = mixing.mix(make_docs(docs), p, columns=["doc_id"]).collect()
    leaves = {(r["domain"], r["language"], r["origin"]): r for r in mixing.plan(make_docs(docs), p).collect()}
    taken = Counter()
    for r in got:
        taken[(r["domain"], r["language"], r["origin"])] += r["tokens"]
    for k, r in leaves.items():
        assert r["given"] <= taken[k] < r["given"] + 100  # the row in which the budget ends comes whole
    again = mixing.mix(make_docs(docs), p, columns=["doc_id"]).collect()
    assert sorted(got, key=str) == sorted(again, key=str)
    assert sorted(got, key=str) != sorted(mixing.mix(make_docs(docs), mixing.MixParams(share=0.8, seed=99), columns=["doc_id"]).collect(), key=str)
    assert len({(r["doc_id"], r["epoch"]) for r in got}) >= len(got) - 4  # rows of one doc_id go together
    whole = mixing.mix(make_docs(docs), p, with_place=False)
    assert whole.columns == make_docs(docs).columns and whole.count() == len(got)
    assert mixing.mix(make_docs(docs).limit(0), p).count() == 0


def test_mix_in_small_slices(make_docs, monkeypatch):
    """However far the key is sliced, the same rows come; and the caller's columns come back as they were."""
    rng = random.Random(8)
    docs = [(i % 290, " ".join(rng.choices(WORDS, k=rng.randint(1, 9))), "en", f"src{i % 3}") for i in range(300)]
    clash = {"_leaf": "mine", "_at": "mine", "_at_leaf": "mine", "_epoch": "mine", "domain": "mine", "Epoch": "mine", "tokens": "mine"}
    df = make_docs(docs).withColumns({k: F.lit(v) for k, v in clash.items()})
    taken = []
    for rows in (10_000, 0):
        monkeypatch.setattr(mixing, "SLICE_ROWS", rows)
        got = mixing.mix(df)
        assert got.columns == [*df.columns, "_domain", "language", "origin", "__epoch", "_tokens"]
        got = got.collect()
        assert all(r[k] == v for r in got for k, v in clash.items())
        taken.append(sorted((r["doc_id"], r["__epoch"]) for r in got))
        assert mixing.mix(df, with_place=False).columns == df.columns
    assert taken[0] == taken[1]


def plain_mix(rows, p=mixing.MixParams()):
    """rows (doc_id, text, lang, source) -> doc_ids, once for each epoch: shares by sorting, prefixes by sorting keys."""

    def place(r):
        number = re.search(r"([0-9]{1,9})$", r[3] or "")
        return (f"d{int(number[1]) % p.domains}" if number else "(none)", r[2] or "(none)", r[3] or "(none)")

    def share(nodes, given):
        """nodes: {name: (cap, weight)} -> {name: given}"""
        out, left, weights = {}, given, sum(w for _, w in nodes.values())
        order = sorted(nodes, key=lambda k: (nodes[k][0] / nodes[k][1], k))
        for i, k in enumerate(order):
            cap, weight = nodes[k]
            if cap / weight <= left / weights:
                out[k], left, weights = cap, left - cap, weights - weight
            else:
                return out | {x: min(nodes[x][0], math.floor(left / weights * nodes[x][1])) for x in order[i:]}
        return out

    tokens = {}
    for r in rows:
        tokens[place(r)] = tokens.get(place(r), 0) + len((r[1] or "").split())
    given = {(): math.floor(sum(tokens.values()) * p.share)}
    for depth, weights in enumerate((p.domain_weights, p.language_weights, p.source_weights), 1):
        below = {}
        for leaf, n in tokens.items():
            cap, weight = below.setdefault(leaf[: depth - 1], {}).get(leaf[:depth], (0, weights.get(leaf[depth - 1], 1)))
            below[leaf[: depth - 1]][leaf[:depth]] = (cap + n * p.max_epochs, weight)
        given = {k: v for parent, nodes in below.items() for k, v in share(nodes, given[parent]).items()}
    out = []
    for leaf, n in tokens.items():
        whole, rest = divmod(given[leaf], n) if n else (1, 0)
        before = 0
        keyed = [(hashlib.md5(f"{p.seed}:{whole + 1}:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r) for r in rows if place(r) == leaf]
        for _, r in sorted(keyed, key=lambda x: x[0]):
            out += [r[0]] * (whole + (before < rest))
            before += len((r[1] or "").split())
    return sorted(out, key=str)


def test_pipeline(spark, tmp_path, make_docs):
    """Each stage on what the one before it kept, against a plain version; columns of clashing names stay as they are."""
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(240):
        words = rng.choices(WORDS, k=rng.randint(30, 80))
        if i % 4 == 0:
            words[rng.randrange(len(words))] = "vile"
            words[rng.randrange(len(words))] = "rotten"
        docs.append((i, " ".join(words), rng.choice(["en", "de"]), f"src{i % 4}"))
        labels.append((i, int(i % 4 == 0)))
    docs += [(300 + i, docs[1][1] + " more", "en", "src1") for i in range(5)] + [(400, None, None, None), (401, "", "en", "src0"), (402, docs[3][1], "en", "src3")]
    items = [(0, docs[2][1][:200].rsplit(" ", 1)[0])]
    docs.append((500, "before " + items[0][1] + " after", "en", "src2"))
    make_docs(docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    net = toxicity.learned(at, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    rows, own = list(docs), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        if name == "sharding":
            got = out.collect()
            assert sorted((r["doc_id"] for r in got), key=str) == sorted((r[0] for r in rows), key=str)
            slots = {}
            for r in got:
                slots.setdefault(r["shard"], []).append(r["slot"])
            assert all(sorted(x) == list(range(len(x))) for x in slots.values())
            break
        assert out.columns == at.columns
        at = spark.createDataFrame(out.collect(), out.schema)
        got = at.collect()
        assert {(r["score"], r["_key"], r["key"]) for r in got} == {(0, "x", "y")}
        if name == "toxicity":
            rows = [r for r in rows if plain_score(net, r[1], own) < 0.7]
            assert not {r[0] for r in rows} & set(range(0, 240, 4))
        elif name == "ngram_join":
            _, classes, sets = plain_links([r[:2] for r in rows])
            rows = [r for k, r in enumerate(rows) if not sets[k] or r[0] == min(rows[j][0] for j in range(len(rows)) if classes[j] == classes[k])]
        elif name == "decontamination":
            need = shingle_set(items[0][1])
            rows = [r for r in rows if len(need & shingle_set(r[1])) < 0.8 * len(need)]
        else:
            by_id = {r[0]: r for r in rows}
            rows = [by_id[i] for i in plain_mix(rows)]
        assert sorted((r["doc_id"] for r in got), key=str) == sorted((r[0] for r in rows), key=str), name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(rows)


def test_pipeline_of_nothing(spark, make_docs, tmp_path):
    none = make_docs([(1, "x")]).limit(0)
    for name, schema in (("labels", "doc_id bigint, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
