"""HTTP pages as a DataFrame; retries, robots rules and conditional requests. Errors are columns."""

from __future__ import annotations

import re
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import urls

# Headers of a request, beside the user agent.
HEADERS = {"Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8", "Accept-Language": "en-US,en;q=0.5"}
FETCHED = "url string, status int, html string, etag string, attempts int, elapsed_ms long, error_kind string, error_message string"


@dataclass(frozen=True)
class FetchConfig:
    timeout_s: float = 15
    max_retries: int = 2
    retry_delay_s: float = 0.8
    max_bytes: int | None = None
    html_only: bool = False
    per_host_per_s: float | None = None
    delay_s: float = 0  # after each page that came
    max_redirects: int = 5
    user_agent: str = "Mozilla/5.0 (compatible; weftline)"

    def copy_with(self, **changes) -> "FetchConfig":
        return replace(self, **changes)


class _Redirects(urllib.request.HTTPRedirectHandler):
    def __init__(self, most: int):
        self.max_redirections = self.max_repeats = most


def _once(url: str, config: FetchConfig, headers: dict) -> tuple[int, str | None, str | None, str | None]:
    """status, text, etag and error kind of one request."""
    own = {"User-Agent": config.user_agent, **HEADERS} | headers
    try:
        with urllib.request.build_opener(_Redirects(config.max_redirects)).open(urllib.request.Request(url, headers=own), timeout=config.timeout_s) as reply:
            kind = reply.headers.get("Content-Type", "")
            if config.html_only and (reply.status != 200 or kind and "html" not in kind):
                return reply.status, None, None, "content_type"
            body = reply.read() if config.max_bytes is None else reply.read(config.max_bytes + 1)
            if config.max_bytes is not None and len(body) > config.max_bytes:
                return reply.status, None, None, "too_large"
            charset = reply.headers.get_content_charset() or "utf-8"
            try:
                return reply.status, body.decode(charset, "replace"), reply.headers.get("ETag"), None
            except LookupError:
                return reply.status, body.decode("utf-8", "replace"), reply.headers.get("ETag"), None
    except urllib.error.HTTPError as e:
        return e.code, None, None, None if e.code == 304 else "rate_limit" if e.code == 429 else "network"
    except (OSError, ValueError) as e:
        return 0, None, None, "timeout" if isinstance(e, TimeoutError) or "timed out" in str(e) else "network"


def fetch_one(url: str, config: FetchConfig, headers: dict | None = None, sleep=time.sleep, once=_once) -> dict:
    """One row. 5xx, time-outs and other transport failures are tried again after retry_delay * attempt; 429 and other
    statuses are final."""
    began, attempt = time.time(), 0
    out = {"url": url, "status": None, "html": None, "etag": None, "attempts": 0, "elapsed_ms": 0, "error_kind": None, "error_message": None}
    if not url or not url.strip().lower().startswith(("http://", "https://")):
        return out | {"error_kind": "url", "error_message": "not an http(s) URL"}
    while True:
        attempt += 1
        status, text, etag, error = once(url.strip(), config, headers or {})
        if error is None or status == 429 or 0 < status < 500 or attempt > config.max_retries:
            break
        sleep(config.retry_delay_s * attempt)
    message = None if error is None else f"status {status}" if status else error
    return out | {"status": status or None, "html": text, "etag": etag, "attempts": attempt, "elapsed_ms": int(1000 * (time.time() - began)), "error_kind": error, "error_message": message}


def fetch(links: DataFrame, config: FetchConfig = FetchConfig(), partitions: int | None = None, etag: str | None = None, crawl_delay: str | None = None) -> DataFrame:
    """FETCHED rows for links (url[, etag][, crawl_delay]). Links of a host go to one task, which keeps the host's pace:
    the slower of the configured one and the host's crawl delay in seconds."""
    host = F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))
    rows = links.select("url", (F.col(etag) if etag else F.lit(None).cast("string")).alias("etag"), host.alias("host"), (F.col(crawl_delay) if crawl_delay else F.lit(None)).cast("double").alias("pace"))
    rows = (rows.repartition(partitions, "host") if partitions else rows.repartition("host")).sortWithinPartitions("host", "url")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for batch in batches:
            out = []
            for url, tag, name, pace in zip(batch["url"], batch["etag"], batch["host"], batch["pace"], strict=True):
                wait = max(1 / config.per_host_per_s if config.per_host_per_s else 0, pace if pace > 0 else 0)
                if wait and name in last:
                    time.sleep(max(0.0, last[name] + wait - time.time()))
                out.append(fetch_one(url, config, {"If-None-Match": tag} if isinstance(tag, str) else {}))
                if config.delay_s and out[-1]["error_kind"] is None:
                    time.sleep(config.delay_s)
                last = {name: time.time()}
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FETCHED.split(", ")])

    return rows.mapInPandas(run, FETCHED)


def retry_outcome(statuses: Column, max_retries: int = 2, delay_ms: int = 800) -> Column:
    """struct<attempts, status, waited_ms> of a fetch that meets these statuses in order (0: time-out)."""
    final = F.transform(statuses, lambda s, i: F.when((s == 0) | (s >= 500), F.lit(None).cast("int")).otherwise(i))
    first = F.coalesce(F.array_min(final), F.size(statuses) - 1)
    last = F.least(first, F.lit(max_retries), F.size(statuses) - 1)
    return F.struct((last + 1).alias("attempts"), F.get(statuses, last).alias("status"), (F.lit(delay_ms) * last * (last + 1) / 2).cast("long").alias("waited_ms"))


def split_list(c: Column) -> Column:
    """Items of a list written with commas or semicolons, trimmed, empty ones and repeats dropped."""
    return F.array_distinct(F.filter(F.transform(F.split(c, "[,;]"), lambda x: F.btrim(x)), lambda x: x != ""))


def allowed(links: DataFrame, rules: DataFrame, mode: str = "lenient") -> DataFrame:
    """links (url) with allowed, by robots rules (host, path, allow): the longest rule that starts the path decides, allow
    on a tie. Hosts without rules are allowed, but in mode strict; mode disabled allows all."""
    if mode == "disabled":
        return links.withColumn("allowed", F.lit(True))
    own = links.withColumns({"host": F.lower(F.try_parse_url("url", F.lit("HOST"))), "_path": urls.path_of(F.col("url"))})
    hits = own.join(rules, "host").where(F.startswith("_path", F.col("path")))
    best = hits.groupBy("url").agg(F.max_by("allow", F.struct(F.length("path"), F.col("allow"))).alias("_best"))
    ruled = own.join(rules.select("host").distinct().withColumn("_ruled", F.lit(True)), "host", "left").join(best, "url", "left")
    return ruled.withColumn("allowed", F.coalesce("_best", F.lit(mode != "strict") | F.coalesce("_ruled", F.lit(False)))).drop("_best", "_ruled", "_path", "host")


def _robots_group(text: str, agent: str) -> list[tuple[str, str]]:
    groups: dict[str, list] = {}
    names, open_group = [], False
    for line in text.splitlines():
        key, _, value = line.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            names = [*names, value.lower()] if open_group else [value.lower()]
            open_group = True
            groups.setdefault(value.lower(), [])
        elif key in ("allow", "disallow", "crawl-delay"):
            open_group = False
            for n in names if value else []:
                groups[n].append((key, value))
    return groups.get(agent.lower(), groups.get("*", []))


def robots_rules(text: str, agent: str = "*") -> list[tuple[str, bool]]:
    """(path, allow) rules of a robots.txt for an agent: its own group's if there is one, else the general group's."""
    return [(value, key == "allow") for key, value in _robots_group(text, agent) if key != "crawl-delay"]


def robots_delay(text: str, agent: str = "*") -> float | None:
    """Seconds between requests that the agent's group asks for: the first Crawl-delay that is a number, or None."""
    for key, value in _robots_group(text, agent):
        if key == "crawl-delay" and re.fullmatch(r"[0-9]+(\.[0-9]+)?", value):
            return float(value)
    return None


def revalidated(cached: DataFrame, fetched: DataFrame) -> DataFrame:
    """Cached rows (url, html, etag) renewed by fetched ones: a 304 keeps the cached page, a new page replaces it."""
    both = cached.select("url", F.col("html").alias("_h"), F.col("etag").alias("_e")).join(fetched.select("url", "status", "html", "etag"), "url", "full")
    fresh = F.col("html").isNotNull()
    return both.select("url", F.when(fresh, F.col("html")).otherwise(F.col("_h")).alias("html"), F.when(fresh, F.col("etag")).otherwise(F.col("_e")).alias("etag"), F.coalesce(F.col("status") == 304, F.lit(False)).alias("not_modified"))


def keep_first(df: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
