"""Fetching and crawling, over a table of the web or over HTTP.

``web`` is (url, status, content_type, body, location), and with attempt (from 0) one row for each try. A crawl is a loop over
depths: what a level asks for goes through a fetcher - rows with url in, ANSWERS out - and what it found is written before
the next level begins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import urls
from gleaner.functions.html import extract_pages
from gleaner.sources.scratch import stored

from . import robots
from .index import assign_ids

# Statuses that are tried again, and those that redirect.
RETRYABLE = (429, 500, 502, 503, 504)
REDIRECTS = (301, 302, 303, 307, 308)
MAX_REDIRECTS = 5


def is_success(status: Column) -> Column:
    return status.between(200, 299)


def fetch_class(status: Column) -> Column:
    return F.when(is_success(status), "ok").when(status.isin(*RETRYABLE), "retry").otherwise("error")


def mime(content_type: Column) -> Column:
    return F.trim(F.substring_index(content_type, ";", 1))


def backoff(attempt: Column, base: float, jitter: Column | None = None) -> Column:
    return F.lit(float(base)) * F.pow(F.lit(2.0), attempt) + (F.rand() if jitter is None else jitter) * F.lit(float(base))


def within_cap(body: Column, max_bytes: int) -> Column:
    return F.octet_length(body) <= max_bytes


def retry_outcome(responses: DataFrame, max_retries: int) -> DataFrame:
    """responses (url, attempt, status) -> (url, status, attempts, retries, outcome): the first answer that is not to be
    retried among attempts 0 to ``max_retries``; failed if there is none."""
    tried = responses.where(F.col("attempt") <= max_retries)
    final = F.min(F.when(~F.col("status").isin(*RETRYABLE), F.struct("attempt", "status")))
    out = tried.groupBy("url").agg(final.alias("f"), F.max(F.struct("attempt", "status")).alias("l"))
    at = F.coalesce("f", "l")
    return out.select(
        "url", at["status"].alias("status"), (at["attempt"] + 1).alias("attempts"), at["attempt"].alias("retries"),
        F.when(F.col("f").isNull(), "error").when(is_success(F.col("f.status")), "ok").otherwise("error").alias("outcome"),
    )


def chase_redirects(requests: DataFrame, web: DataFrame, permitted: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """requests (url) -> (requested, url, hops, status, content_type, body, outcome).

    Up to MAX_REDIRECTS hops, a join each, as long as something moves; where a hop leads is stored before it is taken. ``permitted`` (rows with url -> rows with allowed) is asked before every hop. A
    redirect without a location is an answer. A relative location is seen from the URL that gave it."""
    at = requests.select(F.col("url").alias("requested"), "url", F.lit(0).alias("hops"))
    done = None
    for hop in range(MAX_REDIRECTS + 1):
        asked = at if permitted is None else permitted(at)
        asked = asked if permitted is not None else asked.withColumn("allowed", F.lit(True))
        got = asked.join(web.select("url", "status", "content_type", "body", "location"), "url", "left")
        moves = F.col("allowed") & F.coalesce(F.col("status").isin(*REDIRECTS), F.lit(False)) & (F.coalesce("location", F.lit("")) != "")
        outcome = F.when(~F.col("allowed"), "disallowed").when(F.col("status").isNull(), "error")
        outcome = outcome.when(moves, "too_many_redirects").otherwise("fetched")
        here = got.where(~moves) if hop < MAX_REDIRECTS else got
        here = here.select("requested", "url", "hops", *(F.when(F.col("allowed"), F.col(c)).alias(c) for c in ("status", "content_type", "body")), outcome.alias("outcome"))
        done = here if done is None else done.unionByName(here)
        at = got.where(moves).select("requested", urls.canonical(urls.resolved(F.col("url"), F.col("location"))).alias("url"), (F.col("hops") + 1).alias("hops"))
        if hop < MAX_REDIRECTS and (at := stored(at, "redirects")).isEmpty():
            break
    return done


@dataclass(frozen=True)
class CrawlLimits:
    """max_pages: URLs asked for in all, whatever came of them. max_retries: of the table's fetcher; another has its own."""

    max_depth: int = 0
    max_pages: int | None = None
    max_page_bytes: int = 5 * 2**20
    allowed_domains: tuple[str, ...] = ()
    max_retries: int = 0


#: requested: the URL asked for; url: the one that answered. Outcomes: fetched, error, disallowed.
ANSWERS = "requested string, url string, status int, content_type string, body string, outcome string, retries int"
Fetcher = Callable[[DataFrame], DataFrame]


def last_answers(web: DataFrame, max_retries: int) -> DataFrame:
    """web -> each URL's last try, with retries: the first answer that is not to be tried again, among the first and
    ``max_retries`` more. A table without attempts gives the same answer to each try."""
    retryable = F.col("status").isin(*RETRYABLE)
    if "attempt" not in web.columns:
        return web.withColumn("retries", F.when(retryable, max_retries).otherwise(0))
    answer = F.struct("attempt", "status", "content_type", "body", "location")
    last = web.where(F.col("attempt") <= max_retries).groupBy("url").agg(F.coalesce(F.min(F.when(~retryable, answer)), F.max(answer)).alias("a"))
    return last.select("url", "a.status", "a.content_type", "a.body", "a.location", F.col("a.attempt").alias("retries"))


def table_fetcher(web: DataFrame, limits: CrawlLimits, rules: DataFrame | None = None) -> Fetcher:
    """Answers from a table: allowlist and robots rules before every hop of a redirect, retries, and the cap on bodies."""
    tries = last_answers(web, limits.max_retries)

    def permitted(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({"host": urls.host(F.col("url")), "path": urls.path_and_query(F.col("url"))})
        listed = urls.host_allowed(F.col("host"), list(limits.allowed_domains)) if limits.allowed_domains else F.lit(True)
        rows = robots.can_fetch(rows, rules) if rules is not None else rows.withColumn("allowed", F.lit(True))
        return rows.withColumn("allowed", F.col("allowed") & listed).drop("host", "path")

    def fetch(asked: DataFrame) -> DataFrame:
        got = chase_redirects(asked, tries, permitted).join(tries.select("url", "retries"), "url", "left")
        good = F.coalesce(is_success(F.col("status")) & within_cap(F.col("body"), limits.max_page_bytes), F.lit(False))
        outcome = F.when(F.col("outcome") == "disallowed", "disallowed").when((F.col("outcome") == "fetched") & good, "fetched").otherwise("error")
        return got.select("requested", "url", F.col("status").cast("int").alias("status"), mime(F.col("content_type")).alias("content_type"), "body", outcome.alias("outcome"), F.when(F.col("outcome") == "disallowed", 0).otherwise(F.coalesce("retries", F.lit(0))).cast("int").alias("retries"))

    return fetch


def crawl(seeds: DataFrame, web: DataFrame | Fetcher, limits: CrawlLimits, keep: Callable[[DataFrame, str], DataFrame], robots_texts: DataFrame | None = None, user_agent: str = "gleaner", stop: Callable[[], bool] = lambda: False) -> DataFrame:
    """seeds (url, and seq for their order) -> (url, depth, final_url, status, content_type, retries, outcome, title, text,
    links) of every URL asked for.

    web: a table, or a fetcher such as ``fetch_urls`` with its settings. keep: writes rows under a name and gives them back,
    cutting lineage. stop: asked between levels. A URL is found by its first link, in the order of the pages it stands on and
    of their links; the page budget counts every URL asked for, by depth and in that order."""
    fetch = web if callable(web) else table_fetcher(web, limits, None if robots_texts is None else robots.rules(robots_texts, user_agent))
    first = F.col("seq") if "seq" in seeds.columns else F.col("url")
    frontier = seeds.select(urls.canonical(F.col("url")).alias("url"), first.alias("found")).groupBy("url").agg(F.min("found").alias("found"))
    asked, left = None, limits.max_pages
    for depth in range(limits.max_depth + 1):
        if left is not None:
            frontier = frontier.orderBy("found", "url").limit(left)
            frontier = assign_ids(frontier.withColumn("found", F.struct("found", "url")), "found", id_column="seq")
        else:
            frontier = frontier.withColumn("seq", F.lit(0).cast("bigint"))
        frontier = keep(frontier.select("url", "seq"), f"frontier-{depth}")
        got = keep(fetch(frontier.select("url")), f"answers-{depth}")
        html = got.where("outcome = 'fetched' AND content_type = 'text/html'").select(F.xxhash64("requested").alias("page_id"), "requested", "url", F.col("body").alias("html"))
        parsed = extract_pages(html.select("page_id", "url", "html")).select("page_id", "title", "text", "links")
        pages = html.select("page_id", "requested").join(parsed, "page_id").drop("page_id")
        rows = got.select("requested", F.col("url").alias("final_url"), F.lit(depth).alias("depth"), "status", "content_type", "retries", "outcome").join(pages, "requested", "left")
        level = keep(rows.withColumnRenamed("requested", "url").select("url", "depth", "final_url", "status", "content_type", "retries", "outcome", "title", "text", "links"), f"level-{depth}")
        asked = level if asked is None else asked.unionByName(level)
        if left is not None:
            left -= frontier.count()
        if depth == limits.max_depth or (left is not None and left <= 0) or stop():
            break
        links = level.join(frontier, "url").select(F.posexplode("links").alias("at", "link"), "seq")
        frontier = links.groupBy(F.col("link").alias("url")).agg(F.min(F.struct("seq", "at")).alias("found"))
        frontier = keep(frontier.join(asked.select("url"), "url", "left_anti"), f"found-{depth}")
        if frontier.isEmpty():
            break
    return asked


def crawl_stats(asked: DataFrame, elapsed_s: float = 0.0) -> DataFrame:
    """One row: fetched, errors, disallowed, retries, pages_per_sec."""
    out = asked.agg(*(F.count_if(F.col("outcome") == o).alias(name) for o, name in (("fetched", "fetched"), ("error", "errors"), ("disallowed", "disallowed"))), F.coalesce(F.sum("retries"), F.lit(0)).alias("retries"))
    rate = F.col("fetched") / elapsed_s if elapsed_s else F.lit(0.0)
    return out.withColumn("pages_per_sec", rate)


def index_stats(results: DataFrame) -> DataFrame:
    """results (status, text or null where no page was parsed) -> indexed, duplicates, skipped."""
    usable = (F.col("status") == 200) & F.col("text").isNotNull()
    groups = results.withColumn("usable", F.coalesce(usable, F.lit(False))).groupBy("usable", F.md5(F.coalesce("text", F.lit(""))).alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.count_if("usable").alias("indexed"), F.coalesce(F.sum(F.when(F.col("usable"), F.col("n") - 1)), F.lit(0)).alias("duplicates"), F.coalesce(F.sum(F.when(~F.col("usable"), F.col("n"))), F.lit(0)).alias("skipped")
    )
