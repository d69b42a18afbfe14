"""Fetching over HTTP, in executors: URLs are dealt by host, so that one task at a time talks to a host.

Each hop of a redirect is checked against the allowlist and the host's robots.txt before it is asked for.
"""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame

from gleaner.functions.urls import canonicalize, host
from gleaner.operators.crawl import MAX_REDIRECTS, REDIRECTS, RETRYABLE
from gleaner.operators.robots import Rules, parse

from .settings import Settings


class FetchError(Exception):
    pass


class Disallowed(FetchError):
    """By the allowlist or robots.txt; never tried again."""


@dataclass(frozen=True)
class Answer:
    status: int
    headers: dict[str, str]
    body: bytes


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


def get(url: str, settings: Settings) -> Answer:
    """One GET; at most one byte more than the cap is read."""
    request = urllib.request.Request(url, headers={"User-Agent": settings.user_agent})
    try:
        with urllib.request.build_opener(_Stay).open(request, timeout=settings.request_timeout_s) as r:
            return Answer(r.status, {k.lower(): v for k, v in r.headers.items()}, r.read(settings.max_page_bytes + 1))
    except urllib.error.HTTPError as e:
        return Answer(e.code, {k.lower(): v for k, v in e.headers.items()}, e.read(settings.max_page_bytes + 1))
    except (OSError, ValueError) as e:
        raise FetchError(str(e)) from e


def fetch(url: str, settings: Settings, allowed: Callable[[str], bool] = lambda _: True, ask: Callable[[str, Settings], Answer] = get) -> dict:
    """url, status, content_type, body of the final answer."""
    url = canonicalize(url)
    for _ in range(MAX_REDIRECTS + 1):
        if not settings.is_host_allowed(urlsplit(url).hostname) or not allowed(url):
            raise Disallowed(url)
        answer = ask(url, settings)
        if answer.status in REDIRECTS and answer.headers.get("location"):
            url = canonicalize(answer.headers["location"], url)
            continue
        if len(answer.body) > settings.max_page_bytes:
            raise FetchError(f"{url}: more than {settings.max_page_bytes} bytes")
        kind, _, parameters = answer.headers.get("content-type", "").partition(";")
        charset = parameters.partition("charset=")[2].split(";")[0].strip().strip('"') or "utf-8"
        try:
            body = answer.body.decode(charset, "replace")
        except LookupError:
            body = answer.body.decode("utf-8", "replace")
        return {"url": url, "status": answer.status, "content_type": kind.strip(), "body": body}
    raise FetchError(f"{url}: more than {MAX_REDIRECTS} redirects")


def fetch_with_retry(url: str, settings: Settings, pause: Callable[[float], None] = time.sleep, **how) -> dict:
    """The answer with outcome (fetched, error, disallowed) and retries."""
    got = {"url": url, "status": None, "content_type": None, "body": None}
    for attempt in range(settings.max_retries + 1):
        try:
            got = fetch(url, settings, **how)
            if got["status"] not in RETRYABLE:
                return {**got, "outcome": "fetched" if 200 <= got["status"] < 300 else "error", "retries": attempt}
        except Disallowed:
            return {**got, "outcome": "disallowed", "retries": attempt}
        except FetchError:
            pass
        if attempt < settings.max_retries:
            pause(settings.retry_base_delay_s * (2**attempt + random.random()))
    return {**got, "outcome": "error", "retries": settings.max_retries}


class RobotsCache:
    """Each site's robots.txt, asked for once; one that is missing or not reached allows all."""

    def __init__(self, settings: Settings, ask: Callable[[str, Settings], Answer] = get) -> None:
        self._settings, self._ask = settings, ask
        self._rules: dict[tuple[str, str], Rules] = {}

    def allows(self, url: str) -> bool:
        at = urlsplit(url)
        site = (at.scheme, at.netloc)
        if site not in self._rules:
            try:
                answer = self._ask(f"{at.scheme}://{at.netloc}/robots.txt", self._settings)
                self._rules[site] = parse(answer.body.decode("utf-8", "replace"), self._settings.user_agent) if answer.status < 400 else Rules()
            except FetchError:
                self._rules[site] = Rules()
        return self._rules[site].can_fetch((at.path or "/") + (f"?{at.query}" if at.query else ""))


FETCHED = "requested string, url string, status int, content_type string, body string, outcome string, retries int"


def fetch_urls(urls: DataFrame, settings: Settings, ask: Callable[[str, Settings], Answer] = get) -> DataFrame:
    """urls (url) -> FETCHED. A host's pages are fetched one after another, ``per_host_delay_s`` apart, as its robots.txt
    allows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ended: dict[str, float] = {}
        robots = RobotsCache(settings, ask)
        for batch in batches:
            out = []
            for url, h in zip(batch["url"], batch["host"], strict=True):
                time.sleep(max(0.0, ended.get(h, 0.0) + settings.per_host_delay_s - time.monotonic()) if h in ended else 0.0)
                out.append({"requested": url, **fetch_with_retry(url, settings, allowed=robots.allows, ask=ask)})
                ended[h] = time.monotonic()
            yield pd.DataFrame(out, columns=["requested", "url", "status", "content_type", "body", "outcome", "retries"]).astype({"status": "Int32"})

    return urls.select("url", host(urls["url"]).alias("host")).repartition("host").mapInPandas(run, FETCHED)
