import pytest
from pyspark.sql import functions as F

from gleaner.functions import urls
from gleaner.operators import crawl, dedup, frontier, metrics, robots
from gleaner.sources.scratch import stored


def test_first_seen(spark):
    rows = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None), (5, "")], "seq bigint, text string")
    assert sorted(r["seq"] for r in dedup.first_seen(rows, "seq").collect()) == [1, 2, 4]
    seen = spark.createDataFrame([("b",)], "text string").select(dedup.digest(F.col("text")).alias("digest"))
    assert sorted(r["seq"] for r in dedup.first_seen(rows, "seq", seen=seen).collect()) == [1, 4]
    assert tuple(dedup.dedup_stats(rows).first()) == (3, 2)
    assert tuple(dedup.dedup_stats(rows.limit(0)).first()) == (0, 0)


def test_bloom(spark):
    size = dedup.BloomSize.of(2000, 0.01)
    assert size.m % 8 == 0 and size.k == 7 and size.size_bytes * 8 == size.m
    assert dedup.BloomSize.of(100_000, 0.01) == dedup.BloomSize(958_512, 7)
    items = spark.range(2000).select(F.concat(F.lit("http://in.example.com/page/"), "id").alias("url"))
    others = spark.range(8000).select(F.concat(F.lit("http://out.example.com/page/"), "id").alias("url"))
    bloom = dedup.Bloom.build(items, "url", size)
    assert bloom.probe(items, "url").where("NOT maybe").count() == 0
    rate = bloom.probe(others, "url").where("maybe").count() / 8000
    assert rate < 2 * size.theoretical_fpr(2000)
    halves = dedup.Bloom.build(items.limit(1000), "url", size).merge(dedup.Bloom.build(items, "url", size))
    assert halves.set_bits().first()[0] == bloom.set_bits().first()[0]
    for bad in ((0, 0.1), (10, 0.0), (10, 1.0)):
        with pytest.raises(ValueError, match="positive"):
            dedup.BloomSize.of(*bad)
    assert size.theoretical_fpr(0) == 0.0


ROBOTS = [
    ("", "bot", "/x", True, None),
    ("User-agent: *\nDisallow: /", "bot", "/x", False, None),
    ("User-agent: *\nDisallow: /a\nAllow: /a/b", "bot", "/a/b/c", True, None),
    ("User-agent: *\nDisallow: /a\nAllow: /a", "bot", "/a", True, None),
    ("User-agent: *\nDisallow: /*.php$", "bot", "/x/y.php", False, None),
    ("User-agent: *\nDisallow: /*.php$", "bot", "/x/y.php?q", True, None),
    ("User-agent: bot\nDisallow: /own\n\nUser-agent: *\nDisallow: /", "my-bot/1", "/x", True, None),
    ("User-agent: bo\nDisallow: /\nUser-agent: bot\nDisallow: /q", "my-bot/1", "/x", True, None),
    ("User-agent: *\nCrawl-delay: 2.5 # slow\nDisallow:", "bot", "/x", True, 2.5),
    ("User-agent: a\nUser-agent: bot\nCrawl-delay: soon\nDisallow: /z", "bot", "/z", False, None),
    ("Disallow: /\nUser-agent: *\nAllow: /", "bot", "/x", True, None),
    ("USER-AGENT: *\r\nDISALLOW: /a.b+c", "bot", "/aXbc", True, None),
]


@pytest.mark.parametrize(("said", "agent", "path", "allowed", "delay"), ROBOTS)
def test_robots(spark, said, agent, path, allowed, delay):
    texts = spark.createDataFrame([("h", said)], "host string, robots_txt string")
    own = spark.createDataFrame([("h", path), ("other", path)], "host string, path string")
    got = {r["host"]: r["allowed"] for r in robots.can_fetch(own, robots.rules(texts, agent)).collect()}
    assert got == {"h": allowed, "other": True}
    row = robots.crawl_delays(texts, agent).first()
    assert (row["crawl_delay"] if row else None) == delay
    single = robots.parse(said, agent)
    assert (single.can_fetch(path), single.crawl_delay) == (allowed, delay)


def test_robots_fetches(spark):
    rows = spark.createDataFrame([("a", 200, "x"), ("b", 404, "x"), ("c", None, None)], "host string, status int, body string")
    assert {r["host"]: r["robots_txt"] for r in robots.texts_of(rows).collect()} == {"a": "x", "b": "", "c": ""}


def test_frontier_events():
    f = frontier.Frontier(delay=1.0, capacity=4, slots=2)
    assert f.add("http://a/1", 2) and f.add("http://a/2", 0) and not f.add("http://A/2#x")
    assert f.add("http://b/1", 5) and f.add("http://c/1", 1) and not f.add("http://d/1")
    assert f.stats == {"size": 4, "enqueued": 4, "dropped": 1, "active_hosts": 0, "seen": 4}
    assert f.pop_ready(0.0)[0] == "http://a/2"  # the lowest bucket first
    assert f.pop_ready(0.0)[0] == "http://c/1"
    assert f.pop_ready(0.0) is None and f.time_until_ready(0.0) is None  # both slots are busy
    f.host_done("a", 3.0)  # drained: its slot is free, and the next in the front queues is a/1
    f.host_done("c", 3.5)
    assert f.pop_ready(3.5)[0] == "http://a/1"
    assert f.time_until_ready(3.5) == 0.0
    assert f.pop_ready(3.5)[0] == "http://b/1"
    assert len(f) == 0 and f.pop_ready(9.0) is None


def test_frontier_politeness():
    f = frontier.Frontier(delay=2.0)
    assert f.extend(["http://a/1", "http://a/2", "http://b/1"]) == 3
    assert [f.pop_ready(0.0)[0] for _ in range(2)] == ["http://a/1", "http://b/1"]
    assert f.pop_ready(5.0) is None  # a is in flight, however late it is
    f.host_done("a", 5.0)
    assert f.time_until_ready(5.5) == 1.5 and f.pop_ready(6.9) is None
    assert f.pop_ready(7.0)[0] == "http://a/2"


def test_frontier_replay(spark):
    steps = [("add", "http://a/1", None, 0, 0.0), ("add", "http://a/2", None, 0, 0.0), ("add", "http://A/1", None, 0, 0.0), ("pop", None, None, 0, 0.0), ("pop", None, None, 0, 0.0),
             ("done", None, "a", 0, 1.0), ("wait", None, None, 0, 2.0), ("pop", None, None, 0, 3.0)]
    rows = [(c, i, *s) for c in (1, 2) for i, s in enumerate(steps)]
    events = spark.createDataFrame(rows, "crawl_id bigint, seq bigint, op string, url string, host string, depth int, now double")
    got = frontier.replay(events, delay=2.0).orderBy("crawl_id", "seq").collect()
    assert [r["result"] for r in got] == 2 * ["true", "true", "false", "http://a/1", None, None, "1", "http://a/2"]


def test_frontier_tables(spark):
    rows = [("u1", "a", 0, 1), ("u2", "a", 0, 2), ("u3", "b", 12, 3), ("u4", "a", 0, 4)]
    own = spark.createDataFrame(rows, "url string, host string, depth int, seq int")
    starts = {r["url"]: r["start_s"] for r in frontier.politeness_schedule(own, 1.0, 0.5).collect()}
    assert starts == {"u1": 0.0, "u2": 1.5, "u4": 3.0, "u3": 0.0}
    assert [r["url"] for r in frontier.order(own).collect()] == ["u1", "u2", "u4", "u3"]
    assert frontier.admit(own, 2).count() == 2
    due = spark.createDataFrame([(3.0,), (5.0,)], "next_allowed_s double")
    assert frontier.time_until_ready(due, 1.0).first()[0] == 2.0
    assert frontier.time_until_ready(due, 9.0).first()[0] == 0.0
    assert frontier.time_until_ready(due.limit(0), 1.0).first()[0] is None
    assert [r["host"] for r in frontier.active_hosts(own, 1).collect()] == ["a"]


def page(title, body, *links):
    return f"<html><head><title>{title}</title></head><body><p>{body}</p>{''.join(f'<a href={x!r}>x</a>' for x in links)}</body></html>"


SITE = [
    ("http://s/", 200, "text/html; charset=utf-8", page("home", "welcome", "/a", "/b"), None),
    ("http://s/a", 200, "text/html", page("a", "alpha", "/deep"), None),
    ("http://s/b", 200, "text/html", page("b", "beta", "/missing"), None),
    ("http://s/deep", 200, "text/html", page("deep", "deep text", "/a", "/"), None),
    ("http://s/doc.pdf", 200, "application/pdf", "%PDF", None),
    ("http://s/big", 200, "text/html", "x" * 100, None),
]
WEB = "url string, status int, content_type string, body string, location string"


def crawled(spark, limits, seeds=("http://s/",), texts=None):
    rows = crawl.crawl(spark.createDataFrame([(s,) for s in seeds], "url string"), spark.createDataFrame(SITE, WEB), limits, stored, texts)
    return {r["url"]: (r["depth"], r["outcome"]) for r in rows.collect()}


def test_crawl(spark):
    got = crawled(spark, crawl.CrawlLimits(max_depth=3))
    assert got == {"http://s/": (0, "fetched"), "http://s/a": (1, "fetched"), "http://s/b": (1, "fetched"), "http://s/deep": (2, "fetched"), "http://s/missing": (2, "error")}
    assert set(crawled(spark, crawl.CrawlLimits(max_depth=0))) == {"http://s/"}
    assert len(crawled(spark, crawl.CrawlLimits(max_depth=3, max_pages=2))) == 2
    assert crawled(spark, crawl.CrawlLimits(allowed_domains=("other",)))["http://s/"] == (0, "disallowed")
    assert crawled(spark, crawl.CrawlLimits(max_page_bytes=50), ("http://s/big",))["http://s/big"] == (0, "error")
    texts = spark.createDataFrame([("s", "User-agent: *\nDisallow: /a")], "host string, robots_txt string")
    assert crawled(spark, crawl.CrawlLimits(max_depth=1), texts=texts)["http://s/a"] == (1, "disallowed")


def test_crawl_moves_and_tries(spark):
    web = [("http://s/", 0, 200, "text/html", page("home", "welcome", "/old", "/flaky", "/dead", "/out"), None), ("http://s/old", 0, 301, None, None, "/new/"), ("http://s/new", 0, 200, "text/html", page("new", "found", "/last"), None),
           ("http://s/flaky", 0, 503, None, None, None), ("http://s/flaky", 1, 200, "text/html", page("f", "at last"), None), *(("http://s/dead", i, 500, None, None, None) for i in range(9)), ("http://s/out", 0, 302, None, None, "http://else/")]
    tries = spark.createDataFrame(web, "url string, attempt int, status int, content_type string, body string, location string")
    asked = crawl.crawl(spark.createDataFrame([("http://s/",)], "url string"), tries, crawl.CrawlLimits(max_depth=2, max_retries=2, allowed_domains=("s",)), stored)
    got = {r["url"]: (r["final_url"], r["outcome"], r["retries"]) for r in asked.collect()}
    assert got == {
        "http://s/": ("http://s/", "fetched", 0), "http://s/old": ("http://s/new", "fetched", 0), "http://s/flaky": ("http://s/flaky", "fetched", 1), "http://s/dead": ("http://s/dead", "error", 2),
        "http://s/out": ("http://else/", "disallowed", 0), "http://s/last": ("http://s/last", "error", 0),
    }
    assert crawl.crawl_stats(asked).first()["retries"] == 3


def test_crawl_budget(spark):
    """Pages are asked for in the order in which their links are met, not by name."""
    site = [("http://s/", 200, "text/html", page("home", "x", "/z", "/a", "/m"), None), ("http://s/z", 200, "text/html", page("z", "x", "/z2", "/a"), None), ("http://s/a", 200, "text/html", page("a", "x", "/a1"), None), ("http://s/m", 404, None, None, None)]
    seeds = spark.createDataFrame([("http://s/", 0)], "url string, seq int")
    for n, want in ((2, {"/", "/z"}), (4, {"/", "/z", "/a", "/m"}), (5, {"/", "/z", "/a", "/m", "/z2"})):
        rows = crawl.crawl(seeds, spark.createDataFrame(site, WEB), crawl.CrawlLimits(max_depth=3, max_pages=n), stored).collect()
        assert {r["url"].removeprefix("http://s") for r in rows} == want


def test_retry_and_redirects(spark):
    tries = [("flaky", 0, 500), ("flaky", 1, 503), ("flaky", 2, 200), ("dead", 0, 500), ("dead", 1, 500), ("dead", 2, 500), ("gone", 0, 404), ("gone", 1, 200)]
    got = {r["url"]: (r["status"], r["attempts"], r["outcome"]) for r in crawl.retry_outcome(spark.createDataFrame(tries, "url string, attempt int, status int"), 2).collect()}
    assert got == {"flaky": (200, 3, "ok"), "dead": (500, 3, "error"), "gone": (404, 1, "error")}
    web = [("http://s/r", 302, None, None, "http://s/x/"), ("http://s/x", 200, "text/html", "hi", None), ("http://s/l", 301, None, None, "http://s/l"), ("http://s/n", 302, None, None, None)]
    asked = spark.createDataFrame([("http://s/r",), ("http://s/l",), ("http://s/n",), ("http://s/q",)], "url string")
    got = {r["requested"]: (r["outcome"], r["hops"], r["status"]) for r in crawl.chase_redirects(asked, spark.createDataFrame(web, WEB)).collect()}
    assert got == {"http://s/r": ("fetched", 1, 200), "http://s/l": ("too_many_redirects", 5, 301), "http://s/n": ("fetched", 0, 302), "http://s/q": ("error", 0, None)}
    moved = [("http://s/d/r", 302, None, None, "../x"), ("http://s/q", 302, None, None, "?a=1"), ("http://s/q?a=1", 301, None, None, "//t/y"), ("http://s/x", 200, "text/html", "hi", None), ("http://t/y", 200, "text/html", "there", None)]
    got = {r["requested"]: (r["url"], r["outcome"]) for r in crawl.chase_redirects(spark.createDataFrame([("http://s/d/r",), ("http://s/q",)], "url string"), spark.createDataFrame(moved, WEB)).collect()}
    assert got == {"http://s/d/r": ("http://s/x", "fetched"), "http://s/q": ("http://t/y", "fetched")}
    only = lambda df: df.withColumn("allowed", ~F.col("url").contains("/x"))
    got = {r["requested"]: r["outcome"] for r in crawl.chase_redirects(asked, spark.createDataFrame(web, WEB), only).collect()}
    assert got["http://s/r"] == "disallowed"


def test_stats(spark):
    results = spark.createDataFrame([(200, "a"), (200, "a"), (200, "b"), (404, "a"), (200, None), (201, "c")], "status int, text string")
    assert tuple(crawl.index_stats(results).first()) == (2, 1, 3)
    assert tuple(crawl.index_stats(results.limit(0)).first()) == (0, 0, 0)


def test_metrics(spark):
    values = spark.createDataFrame([(0.05,), (0.05,), (0.5,), (5.0,)], "v double")
    assert [(r["le"], r["cum"]) for r in metrics.histogram(values, "v", (0.1, 1.0, 10.0)).collect()] == [(0.1, 2), (1.0, 3), (10.0, 4), (None, 4)]
    many = spark.range(1, 101).select(F.col("id").cast("double").alias("v"))
    got = {r["percent"]: r["value"] for r in metrics.percentile_exclusive(many, "v", (50, 99)).collect()}
    assert got == {50: pytest.approx(50.5), 99: pytest.approx(99.99)}
    rows = spark.createDataFrame([(0, "n", "about", "counter", None, 3.0), (1, "n", "about", "counter", 'k="v"', 0.5)], "seq int, name string, help string, type string, labels string, value double")
    assert metrics.exposition(rows).first()["text"] == '# HELP n about\n# TYPE n counter\nn 3\nn{k="v"} 0.5'


def test_unseen(spark):
    links = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "url string")
    seen = spark.createDataFrame([("b",)], "url string")
    assert {r["url"] for r in dedup.unseen(links, seen).collect()} == {"a", None}
    assert urls.canonicalize("http://A/#x") == "http://a/"
