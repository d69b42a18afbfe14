"""Settings from the environment and .env files."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path


def split_csv(raw: str | None) -> tuple[str, ...]:
    return tuple(x for x in (p.strip().lower() for p in (raw or "").split(",")) if x)


@dataclass(frozen=True)
class Settings:
    """Each field is read from the variable of its name in capitals; unset or empty ones keep their default."""

    allowed_domains: tuple[str, ...] = ()
    user_agent: str = "gleaner-bot/0.1"
    fetcher_workers: int = 8
    request_timeout_s: float = 10.0
    max_page_bytes: int = 5 * 2**20
    max_retries: int = 3
    retry_base_delay_s: float = 0.5
    max_frontier_size: int = 100_000
    per_host_delay_s: float = 1.0
    bloom_expected_urls: int = 1_000_000
    bloom_target_fpr: float = 0.01
    database_url: str = "spark-warehouse/gleaner"
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    api_host: str = "127.0.0.1"
    api_port: int = 8080

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, dotenv: str | None = ".env") -> Settings:
        """The environment, over the lines of the .env file if there is one."""
        env = {**(read_dotenv(dotenv) if dotenv else {}), **(os.environ if env is None else env)}
        given = {}
        for f in fields(cls):
            if raw := env.get(f.name.upper()):
                given[f.name] = split_csv(raw) if f.name == "allowed_domains" else {"int": int, "float": float}.get(str(f.type), str)(raw)
        return cls(**given)

    def is_host_allowed(self, host: str | None) -> bool:
        host = (host or "").lower()
        return bool(host) and any(host == a or host.endswith(f".{a}") for a in self.allowed_domains)


def read_dotenv(path: str) -> dict[str, str]:
    out = {}
    if Path(path).is_file():
        for line in Path(path).read_text().splitlines():
            name, eq, value = line.strip().removeprefix("export ").partition("=")
            if eq and not name.lstrip().startswith("#"):
                out[name.strip()] = value.strip().strip("'\"")
    return out
