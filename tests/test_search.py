import math
import random

import pytest

from gleaner.functions.text import analyze
from gleaner.operators import index, search

DOCS = [
    (1, "http://e/linux", "Linux epoll", "The epoll interface of the linux kernel scales to many descriptors. State of the art servers use it."),
    (2, "http://e/bsd", "BSD kqueue", "The kqueue interface is like epoll on linux but for bsd kernels."),
    (3, "http://e/web", "Web servers", "A running server answers requests. Servers run on machine learning clusters."),
    (4, "http://e/cooking", "Cooking", "A pressure cooker cooks rice. State in an art museum."),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return index.Index.build(spark.createDataFrame(DOCS, "doc_id bigint, url string, title string, text string"))


def urls_of(corpus, q, **how):
    return {r["url"].rpartition("/")[2] for r in search.search(corpus, q, **how).collect()}


def test_semantics(corpus):
    assert urls_of(corpus, "epoll linux") == {"linux", "bsd"}
    assert urls_of(corpus, "kqueue OR cooker") == {"bsd", "cooking"}
    assert urls_of(corpus, "epoll xyzzy") == urls_of(corpus, "") == urls_of(corpus, "  ") == urls_of(corpus, "the of") == set()
    assert urls_of(corpus, '"machine learning"') == {"web"}
    assert urls_of(corpus, '"learning machine"') == set()
    assert urls_of(corpus, '"state of the art"') == {"linux", "cooking"}  # stopwords stand for any one word
    assert urls_of(corpus, '"state art"') == set()
    assert urls_of(corpus, "Running Servers") == {"web"}
    with pytest.raises(ValueError, match="limit"):
        search.search(corpus, "epoll", limit=0)
    assert len(search.search(corpus, "epoll", limit=1).collect()) == 1


def test_parse():
    def parts(q):
        query = search.parse_query(q)
        return [[(t.stem, t.offset) for t in g] for g in query.groups], query.every

    assert parts('"machine learning" OR robotics') == ([[("machin", 0), ("learn", 1)], [("robot", 0)]], False)
    assert parts("the epoll of") == ([[("epol", 0)]], True)
    assert parts("well-known") == ([[("well", 0)], [("known", 0)]], True)
    assert parts('foo"bar baz"')[0] == [[("foo", 0)], [("bar", 0)], [("baz", 0)]]
    assert parts('"new york new"')[0] == [[("new", 0), ("york", 1)]]
    assert parts('"the"') == ([], True)
    assert parts('"a cat""dog day" x OR')[0] == [[("cat", 0)], [("dog", 0), ("dai", 1)], [("x", 0)]]
    assert parts('"open end')[0] == [[("open", 0)], [("end", 0)]]


def test_snippets(spark):
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words), "short text", "", None, "the  runner's\u00a0run\tRunning ends"]
    hits = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [r["snippet"] for r in search.with_snippets(hits, ["w50"]).orderBy("doc_id").collect()]
    assert got == ["… " + " ".join(words[35:65]) + " …", "short text", "", "", "the runner's run Running ends"]
    assert search.with_snippets(hits, ["run"], 2).where("doc_id = 4").first()["snippet"] == "… runner's run …"


def brute(docs, q, limit, k1=1.5, b=0.75):
    query = search.parse_query(q)
    groups, every = [([t.stem for t in g], [t.offset for t in g]) for g in query.groups], query.every
    an = {i: analyze(t) for i, t in docs.items()}
    length = {i: sum(map(len, a.values())) for i, a in an.items()}
    avg = sum(length.values()) / len(length) or 1.0
    terms = {t for g in groups for t in g[0]}

    def hit(a, g):
        return all(t in a for t in g[0]) and any(all(s + o in a[t] for t, o in zip(*g, strict=True)) for s in a[g[0][0]])

    out = []
    for i, a in an.items():
        if groups and (all if every else any)(hit(a, g) for g in groups):
            s = 0.0
            for t in sorted(terms):
                if t in a:
                    df = sum(t in x for x in an.values())
                    tf = len(a[t])
                    s += math.log(1 + (len(an) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[i] / avg))
            out.append((-round(s, 12), i))
    return [(i, round(-s, 6)) for s, i in sorted(out)[:limit]]


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["apple", "banana", "cherry", "the", "of", "running", "runs", "night", "x1"]
    docs = {i: " ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) for i in range(1, 120)}
    built = index.Index.build(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"))
    posted, lengths = built.postings.cache(), built.docs.select("doc_id", "length").cache()
    asked = ["apple", "apple run", '"apple banana"', '"apple the banana" OR x1', "night OR cherry", '"run run"', "cherry -x1", '"banana of the run"']
    batch: dict = {}
    for r in search.rank_batch(posted, lengths, list(enumerate(asked)), 15).orderBy("query_id", "rank").collect():
        batch.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    for n, q in enumerate(asked):
        want = brute(docs, q, 15)
        for got in ([(r["doc_id"], r["score"]) for r in search.rank_documents(posted, lengths, q, 15).orderBy("rank").collect()], batch.get(n, [])):
            assert [i for i, _ in got] == [i for i, _ in want], q
            assert all(abs(s - t) < 2e-6 for (_, s), (_, t) in zip(got, want, strict=True))


def test_bm25_limits(corpus):
    flat = search.rank_documents(corpus.postings, corpus.docs, "epoll", k1=0.0).collect()
    assert len({r["score"] for r in flat}) == 1 and [r["doc_id"] for r in flat] == sorted(r["doc_id"] for r in flat)


def test_top_k(spark):
    rows = [(i, float((i * 37 % 101) / 7)) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, score double")
    got = [(r["doc_id"], r["score"]) for r in search.top_k(df, 20).collect()]
    assert got == sorted(rows, key=lambda x: (-x[1], x[0]))[:20]
    assert "TakeOrderedAndProject" in search.top_k(df, 5)._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="k must"):
        search.top_k(df, 0)


def test_index_tables(spark, corpus):
    docs = spark.createDataFrame([(1, "search engines search the web"), (2, "")], "doc_id bigint, text string")
    built = index.Index.build(docs)
    row = built.stats.first()
    assert (row["n_docs"], row["total_length"], row["avgdl"]) == (2, 4, 2.0)
    assert {r["term"]: r["df"] for r in built.terms.collect()} == {"search": 1, "engin": 1, "web": 1}
    assert index.Index.build(docs.limit(0)).stats.first()["avgdl"] == 0.0
    ids = index.assign_ids(spark.createDataFrame([(x,) for x in (30, 10, 20)], "seq bigint"), "seq", start=6).orderBy("seq").collect()
    assert [r["doc_id"] for r in ids] == [7, 8, 9]


def test_restore(spark, corpus):
    back = corpus.restore(spark.createDataFrame([(2, "http://e/bsd", "BSD", "kqueue again"), (9, "http://e/new", "", "epoll")], "doc_id bigint, url string, title string, text string"))
    assert {r["doc_id"]: r["length"] for r in back.docs.collect()} == {1: 13, 2: 3, 3: 11, 4: 9, 9: 1} or back.docs.count() == 5
    assert urls_of(back, "epoll") == {"linux", "new"} and urls_of(back, "kqueue again") <= {"bsd"}


def test_lists(spark):
    def df(ids):
        return spark.createDataFrame([(i, 1) for i in ids], "doc_id bigint, tf int")

    a, b = df([1, 3, 5, 7]), df([2, 3, 7, 9])
    assert sorted(r["doc_id"] for r in index.intersect(a, b).collect()) == [3, 7]
    assert sorted(r["doc_id"] for r in index.intersect_all([a, b, df([7])]).collect()) == [7]
    assert sorted(r["doc_id"] for r in index.unite_all([a, b]).collect()) == [1, 2, 3, 5, 7, 9]
    assert index.intersect(a, df([])).count() == 0
