"""The service: crawl, search, stats, health and metrics, as calls and as a small HTTP server."""

from __future__ import annotations

import json
import threading
import time
from functools import partial
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import crawl as crawling
from gleaner.operators import dedup, metrics, search
from gleaner.sources.http import fetch_urls
from gleaner.sources.settings import Settings
from gleaner.sources.store import Store

MAX_LIMIT = 100


class Service:
    def __init__(self, spark: SparkSession, store: Store, settings: Settings, web: DataFrame | None = None, robots: DataFrame | None = None) -> None:
        self.spark, self.store, self.settings, self.web, self.robots = spark, store, settings, web, robots
        self.totals = dict.fromkeys(("pages_fetched_total", "fetch_errors_total", "fetches_disallowed_total", "documents_indexed_total", "duplicate_pages_total"), 0)
        self.latencies: list[float] = []
        self.last_crawl: dict | None = None
        self.last_error: str | None = None
        self.frontier_depth = 0
        self._busy, self._stop = threading.Lock(), threading.Event()

    # crawl

    def start_crawl(self, body: object) -> tuple[int, dict]:
        seeds = body.get("seeds") if isinstance(body, dict) else None
        if not isinstance(seeds, list) or not seeds or not all(isinstance(s, str) for s in seeds):
            return 400, {"error": "seeds must be a list of URLs that is not empty"}
        if not self._busy.acquire(blocking=False):
            return 409, {"error": "a crawl is running"}
        threading.Thread(target=self._crawl, args=(seeds, body.get("max_pages"), body.get("max_depth", 2)), daemon=True).start()
        return 202, {"status": "started", "seeds": len(seeds)}

    def _crawl(self, seeds: list[str], max_pages: int | None, max_depth: int) -> None:
        try:
            self._stop.clear()
            self.run_crawl(seeds, max_pages, max_depth)
            self.last_error = None
        except Exception as e:  # noqa: BLE001  the thread ends; /stats tells
            self.last_error = f"{type(e).__name__}: {e}"[:500]
        finally:
            self._busy.release()

    def stop(self) -> None:
        """A running crawl ends after the level it is at."""
        self._stop.set()

    def run_crawl(self, seeds: list[str], max_pages: int | None = None, max_depth: int = 2) -> dict:
        began = time.monotonic()
        limits = crawling.CrawlLimits(max_depth, max_pages, self.settings.max_page_bytes, self.settings.allowed_domains, self.settings.max_retries)
        at = f"{self.store.path}/crawls/{int(time.time() * 1e6)}"

        def keep(rows: DataFrame, name: str) -> DataFrame:
            rows.write.parquet(f"{at}/{name}")
            kept = self.spark.read.schema(rows.schema).parquet(f"{at}/{name}")
            if name.startswith(("frontier-", "answers-")):
                self.frontier_depth = kept.count() if name.startswith("frontier-") else 0
            return kept

        web = self.web if self.web is not None else partial(fetch_urls, settings=self.settings)
        named = self.spark.createDataFrame([(s, i) for i, s in enumerate(seeds)], "url string, seq bigint")
        asked = crawling.crawl(named, web, limits, keep, self.robots, self.settings.user_agent, self._stop.is_set)
        self.frontier_depth = 0
        new = asked.where("status = 200 AND text IS NOT NULL").withColumn("url", F.col("final_url")).withColumn("seq", F.struct("depth", "url"))
        known = self.store.load().docs.select(F.col("content_hash").alias("digest"))
        kept = dedup.first_seen(new, "seq", seen=known)
        took = time.monotonic() - began
        stats = crawling.crawl_stats(asked, took).first().asDict()
        indexed, usable = kept.count(), new.count()
        self.store.append(kept.select("seq", "url", "title", "text"), "seq")
        out = {
            "fetched": stats["fetched"], "errors": stats["errors"], "disallowed": stats["disallowed"], "retries": stats["retries"],
            "indexed": indexed, "duplicates": usable - indexed, "elapsed_s": round(took, 3), "pages_per_sec": round(stats["pages_per_sec"], 1),
        }
        for name, k in zip(self.totals, ("fetched", "errors", "disallowed", "indexed", "duplicates"), strict=True):
            self.totals[name] += out[k]
        self.last_crawl = out
        return out

    # search and the rest

    def search(self, q: str | None, limit: str | int | None = None) -> tuple[int, dict]:
        q = (q or "").strip()
        if not q:
            return 400, {"error": "q is required"}
        try:
            n = min(int(10 if limit is None else limit), MAX_LIMIT)
        except ValueError:
            return 400, {"error": "limit must be a whole number"}
        if n <= 0:
            return 400, {"error": "limit must be positive"}
        began = time.monotonic()
        hits = search.search(self.store.load(), q, n, self.settings.bm25_k1, self.settings.bm25_b).collect()
        self.latencies.append(time.monotonic() - began)
        return 200, {"query": q, "count": len(hits), "hits": [{"url": h["url"], "title": h["title"], "score": round(h["score"], 4), "snippet": h["snippet"]} for h in hits]}

    def stats(self) -> tuple[int, dict]:
        index = self.store.load()
        row = index.stats.crossJoin(index.terms.agg(F.count(F.lit(1)).alias("unique_terms"))).first()  # one row each
        return 200, {
            "documents": row["n_docs"], "unique_terms": row["unique_terms"], "avg_doc_length": round(row["avgdl"], 1),
            "dedup": {"unique": row["n_docs"], "duplicates": self.totals["duplicate_pages_total"]}, "crawl_running": self._busy.locked(), "last_crawl": self.last_crawl, "last_error": self.last_error,
        }

    def healthz(self) -> tuple[int, dict]:
        return 200, {"status": "ok"}

    def metrics(self) -> str:
        size = dedup.BloomSize.of(self.settings.bloom_expected_urls, self.settings.bloom_target_fpr)
        rows = [(i, f"gleaner_{k}", k.replace("_", " "), "counter", None, float(v)) for i, (k, v) in enumerate(self.totals.items())]
        rows += [(90, "gleaner_frontier_depth", "URLs queued", "gauge", None, float(self.frontier_depth))]
        rows += [(91, "gleaner_bloom_theoretical_fpr", "False positives expected", "gauge", None, size.theoretical_fpr(self.totals["pages_fetched_total"]))]
        said = metrics.exposition(self.spark.createDataFrame(rows, "seq int, name string, help string, type string, labels string, value double"))
        out = "\n".join(r["text"] for r in said.orderBy("name").collect()) + "\n"
        return out + histogram_text("gleaner_query_latency_seconds", "Search latency", self.latencies)


def histogram_text(name: str, about: str, values: list[float], bounds: tuple[float, ...] = metrics.BOUNDS) -> str:
    said = [f"# HELP {name} {about}", f"# TYPE {name} histogram"]
    said += [f'{name}_bucket{{le="{b:g}"}} {sum(v <= b for v in values)}' for b in bounds]
    total = sum(values)
    return "\n".join([*said, f'{name}_bucket{{le="+Inf"}} {len(values)}', f"{name}_sum {int(total) if total == int(total) else total!r}", f"{name}_count {len(values)}"]) + "\n"


def server(service: Service) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _say(self, status: int, body: dict | str) -> None:
            data = (body if isinstance(body, str) else json.dumps(body)).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/plain; version=0.0.4" if isinstance(body, str) else "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            at = urlsplit(self.path)
            asked = {k: v[0] for k, v in parse_qs(at.query).items()}
            known = {"/search": lambda: service.search(asked.get("q"), asked.get("limit")), "/stats": service.stats, "/healthz": service.healthz, "/metrics": lambda: (200, service.metrics())}
            self._say(*(known[at.path]() if at.path in known else (404, {"error": "not found"})))

        def do_POST(self):
            if urlsplit(self.path).path != "/crawl":
                return self._say(404, {"error": "not found"})
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
            except ValueError:
                return self._say(400, {"error": "the body must be JSON"})
            self._say(*service.start_crawl(body))

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((service.settings.api_host, service.settings.api_port), Handler)


def main() -> None:
    settings = Settings.from_env()
    spark = SparkSession.builder.appName("gleaner").getOrCreate()
    server(Service(spark, Store(spark, settings.database_url), settings)).serve_forever()
