import json
import threading
import time
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from gleaner.api import Service, server
from gleaner.operators.dedup import first_seen
from gleaner.operators.index import Index, assign_ids
from gleaner.sources.http import Answer, Disallowed, FetchError, fetch, fetch_urls, fetch_with_retry
from gleaner.sources.settings import Settings, read_dotenv, split_csv
from gleaner.sources.store import Store
from gleaner.streaming import ingest

from .test_operators import SITE, WEB

ROWS = "seq bigint, url string, title string, text string"


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.load().docs.count() == 0 and store.next_id() == 1
    store.append(spark.createDataFrame([(1, "u1", "One", "alpha beta"), (2, "u2", None, "beta gamma gamma")], ROWS), "seq")
    store.append(spark.createDataFrame([(5, "u3", "", "delta")], ROWS), "seq")
    assert {r["doc_id"]: r["url"] for r in store.load().docs.collect()} == {1: "u1", 2: "u2", 3: "u3"}
    store.upsert(spark.createDataFrame([(1, "u2", "", "omega"), (2, "u4", "", "beta"), (3, "u2", "", "omega psi")], ROWS), "seq")
    now = store.load()
    assert {r["doc_id"]: (r["url"], r["length"]) for r in now.docs.collect()} == {1: ("u1", 3), 2: ("u2", 2), 3: ("u3", 1), 4: ("u4", 1)}
    assert {r["term"]: r["df"] for r in now.terms.collect()} == {"on": 1, "alpha": 1, "beta": 2, "delta": 1, "omega": 1, "psi": 1} or "on" not in {r["term"] for r in now.terms.collect()}
    assert {r["name"]: r["n"] for r in store.counts().collect()}["documents"] == 4
    for _ in range(2):  # as written in segments, and as one
        now = store.load()
        counted = {r["term"]: r["df"] for r in now.postings.groupBy("term").count().withColumnRenamed("count", "df").collect()}
        assert {r["term"]: r["df"] for r in now.terms.collect()} == counted
        assert tuple(now.stats.first()) == (4, 7, 1.75) and now.docs.agg({"length": "sum"}).first()[0] == 7
        assert [r["doc_id"] for r in store.scan().collect()] == [1, 2, 3, 4]
        store.compact()
    assert len(store.manifest()["segments"]) == 1 and store.next_id() == 5
    store.clear()
    assert store.load().docs.count() == 0 and store.next_id() == 1


def test_appends_cost_what_they_add(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.append(spark.range(400).selectExpr("id AS seq", "concat('u', id) AS url", "'' AS title", "concat('word', id, ' ', repeat('long text ', 50)) AS text"), "seq")

    def size():
        return sum(f.stat().st_size for f in (tmp_path / "s").rglob("*.parquet"))

    before = size()
    store.append(spark.createDataFrame([(1, "v", "", "one more")], ROWS), "seq")
    assert size() - before < 12_000 and store.load().docs.count() == 401


def test_round_trip(spark, tmp_path):
    built = Index.build(spark.createDataFrame([(1, "search the web"), (2, "")], "doc_id bigint, text string"))
    store = Store(spark, str(tmp_path / "s"))
    store.save(built)
    got = sorted((r["term"], r["doc_id"], r["positions"]) for r in store.load().postings.collect())
    assert got == sorted((r["term"], r["doc_id"], r["positions"]) for r in built.postings.collect())


def test_stream_is_batch(spark, tmp_path):
    landing, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "s"))
    first = [(i, f"u{i}", "", f"text {i % 7}", 200) for i in range(20)] + [(90, "u90", "", "bad", 404), (91, "u91", "", None, 200)]
    seen, again = [], []
    for n, rows in enumerate((first, [(i, f"v{i}", "", f"text {i % 9}", 200) for i in range(20)])):
        spark.createDataFrame(rows, ingest.PAGES).repartition(2).write.mode("append").parquet(landing)
        ingest.ingest(ingest.read_pages(spark, landing, files_per_batch=1), store, str(tmp_path / "c"), seen.append, again.append).awaitTermination()
        assert store.load().docs.count() == (7 if n == 0 else 9)
    assert sum(seen) == 9 and sum(again) == 31
    assert sorted(r["text"] for r in store.load().docs.collect()) == [f"text {i}" for i in range(9)]
    assert sorted(r["doc_id"] for r in store.load().docs.collect()) == list(range(1, 10))


def test_polite_state(spark, tmp_path):
    landing = str(tmp_path / "in")
    spark.createDataFrame([("a", "u1", 0.0), ("a", "u2", 0.1), ("b", "u3", 0.2), ("a", "u4", 9.0)], "host string, url string, at double").coalesce(1).write.parquet(landing)
    stream = spark.readStream.schema("host string, url string, at double").parquet(landing)
    q = ingest.polite_fetch_times(stream, 1.0).writeStream.format("memory").queryName("polite").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["url"]: r["start_s"] for r in spark.sql("SELECT * FROM polite").collect()} == {"u1": 0.0, "u2": 1.0, "u3": 0.2, "u4": 9.0}


def test_settings(tmp_path):
    env = {"ALLOWED_DOMAINS": " Books.com, ,x.org ", "FETCHER_WORKERS": "3", "BM25_K1": "1.2", "USER_AGENT": ""}
    got = Settings.from_env(env, dotenv=None)
    assert (got.allowed_domains, got.fetcher_workers, got.bm25_k1, got.user_agent) == (("books.com", "x.org"), 3, 1.2, Settings().user_agent)
    assert got.is_host_allowed("a.BOOKS.com") and not got.is_host_allowed("notbooks.com") and not got.is_host_allowed(None)
    assert split_csv(None) == ()
    (tmp_path / ".env").write_text("# c\nexport API_PORT='99'\nBAD\n")
    assert read_dotenv(str(tmp_path / ".env")) == {"API_PORT": "99"}
    assert Settings.from_env({}, str(tmp_path / ".env")).api_port == 99
    with pytest.raises(ValueError, match="invalid"):
        Settings.from_env({"API_PORT": "x"}, None)


def answers(**more):
    site = {"http://s/": Answer(200, {"content-type": "text/html; charset=latin-1"}, "é".encode("latin-1")), "http://s/r": Answer(302, {"location": "/"}, b""), "http://s/out": Answer(302, {"location": "http://else/"}, b"")}
    site |= {f"http://s/{k}": v for k, v in more.items()}
    return lambda url, _: site.get(url, Answer(404, {}, b""))


def test_fetch(spark):
    settings = Settings(allowed_domains=("s",), max_page_bytes=10, retry_base_delay_s=0, per_host_delay_s=0)
    assert fetch("http://S/r", settings, ask=answers()) == {"url": "http://s/", "status": 200, "content_type": "text/html", "body": "é"}
    with pytest.raises(Disallowed):
        fetch("http://s/out", settings, ask=answers())
    with pytest.raises(FetchError, match="bytes"):
        fetch("http://s/big", settings, ask=answers(big=Answer(200, {}, b"x" * 11)))
    assert fetch("http://s/ten", settings, ask=answers(ten=Answer(200, {}, b"x" * 10)))["status"] == 200
    with pytest.raises(FetchError, match="redirects"):
        fetch("http://s/loop", settings, ask=answers(loop=Answer(301, {"location": "/loop"}, b"")))
    tries = iter([500, 503, 200])
    got = fetch_with_retry("http://s/f", settings, pause=lambda _: None, ask=lambda *_: Answer(next(tries), {}, b""))
    assert (got["outcome"], got["retries"]) == ("fetched", 2)
    assert fetch_with_retry("http://s/out", settings, ask=answers())["outcome"] == "disallowed"
    said = {"robots.txt": Answer(200, {}, b"User-agent: *\nDisallow: /private")}
    rows = fetch_urls(spark.createDataFrame([("http://s/",), ("http://s/none",), ("http://s/private/x",)], "url string"), settings, ask=answers(**said)).collect()
    assert {r["requested"]: r["outcome"] for r in rows} == {"http://s/": "fetched", "http://s/none": "error", "http://s/private/x": "disallowed"}


def test_service_fetches(spark, tmp_path):
    """A service without a table of the web asks a real server: a redirect, a page that fails once, robots rules."""
    tries = []

    class Site(BaseHTTPRequestHandler):
        def do_GET(self):
            tries.append(self.path)
            said = {"/": (200, "<title>home</title><p>welcome</p><a href='/old'>o</a><a href='/flaky'>f</a><a href='/private/x'>p</a>"), "/new": (200, "<title>new</title><p>gamma</p>"), "/robots.txt": (200, "User-agent: *\nDisallow: /private")}
            said |= {"/old": (302, ""), "/flaky": (503 if tries.count("/flaky") == 1 else 200, "<p>delta</p>")}
            status, body = said.get(self.path, (404, ""))
            self.send_response(status)
            if self.path == "/old":
                self.send_header("Location", "new")
            self.send_header("Content-Type", "text/plain" if self.path == "/robots.txt" else "text/html")
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    site = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=site.serve_forever, daemon=True).start()
    service = Service(spark, Store(spark, str(tmp_path / "s")), Settings(allowed_domains=("127.0.0.1",), per_host_delay_s=0, retry_base_delay_s=0))
    assert service.start_crawl({"seeds": [f"http://127.0.0.1:{site.server_port}/"], "max_depth": 1})[0] == 202
    for _ in range(600):
        if not service.stats()[1]["crawl_running"]:
            break
        time.sleep(0.2)
    site.shutdown()
    said = service.stats()[1]
    assert said["last_error"] is None
    assert {k: said["last_crawl"][k] for k in ("fetched", "errors", "disallowed", "retries", "indexed")} == {"fetched": 3, "errors": 0, "disallowed": 1, "retries": 1, "indexed": 3}
    assert service.search("gamma")[1]["hits"][0]["url"].endswith("/new") and "/private/x" not in tries


def test_service(spark, tmp_path):
    web = spark.createDataFrame([*SITE, ("http://s/mirror", 200, "text/html", SITE[1][3].replace("<title>a", "<title>m"), None)], WEB)
    service = Service(spark, Store(spark, str(tmp_path / "s")), Settings(allowed_domains=("s",), api_port=0), web)
    assert service.start_crawl({"seeds": []})[0] == service.start_crawl([])[0] == 400
    done = service.run_crawl(["http://s/", "http://s/mirror"], max_depth=1)
    assert (done["fetched"], done["errors"], done["indexed"], done["duplicates"]) == (5, 0, 4, 1)
    http = server(service)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    ask = lambda path: json.load(urllib.request.urlopen(f"http://127.0.0.1:{http.server_port}{path}"))
    assert ask("/healthz") == {"status": "ok"}
    found = ask("/search?q=alpha&limit=5")
    assert found["count"] == 1 and found["hits"][0]["url"].startswith("http://s/")
    assert ask("/stats")["documents"] == 4
    said = urllib.request.urlopen(f"http://127.0.0.1:{http.server_port}/metrics").read().decode()
    assert "gleaner_pages_fetched_total 5" in said and 'gleaner_query_latency_seconds_bucket{le="+Inf"} 1' in said
    assert service.search("", None)[0] == service.search("x", "many")[0] == service.search("x", 0)[0] == 400
    http.shutdown()


def test_writes_move_texts_less(spark, tmp_path):
    rows = [(3, "u3", "", "the same"), (1, "u1", "Of", "alpha"), (2, None, "", "no url"), (4, "u4", None, None), (5, "u1", "", "omega the psi")]
    docs = spark.createDataFrame(rows, ROWS)
    given = assign_ids(docs, "seq", 7)
    assert {r["seq"]: r["doc_id"] for r in given.collect()} == {i: i + 7 for i in range(1, 6)}
    assert "row_number" not in given._jdf.queryExecution().toString()  # a second shuffle, by range
    seen = spark.createDataFrame([("x",)], "digest string")
    plan = first_seen(docs, "seq", seen=seen)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan.splitlines()[1]  # rows with texts are joined once, last of all
    store = Store(spark, str(tmp_path / "s"))
    store.append(docs.where("seq IN (3, 1)"), "seq")
    store.upsert(docs, "seq")
    now = store.load()
    assert {r["url"]: (r["doc_id"], r["length"], r["text"]) for r in now.docs.collect()} == {"u1": (1, 2, "omega the psi"), "u3": (2, 0, "the same"), None: (3, 1, "no url"), "u4": (4, 0, None)}
    assert {r["term"]: r["df"] for r in now.terms.collect()} == {"omega": 1, "psi": 1, "url": 1}
