"""A fetcher for ``crawl``: HTTP answers to a frontier, polite to each host."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.urls import netloc

# Seconds for an answer, the least seconds between two requests to a host, and how many may be open there.
TIMEOUT, HOST_DELAY, HOST_OPEN = 10.0, 0.25, 2
SCHEMA = "url string, status int, content_type string, html string, error string, retry_after string"


def ask(url: str, timeout: float = TIMEOUT, agent: str = "spindrift") -> tuple:
    """(url, status, content_type, html, error, retry_after) of one request; only HTML of 200 answers is read, and bytes that are no text are left out."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:
            kind = r.headers.get("Content-Type", "")
            html = r.read().decode(r.headers.get_content_charset() or "utf-8", "ignore") if r.status == 200 and "text/html" in kind.lower() else None
            return url, r.status, kind, html, None, None
    except urllib.error.HTTPError as e:
        return url, e.code, e.headers.get("Content-Type", ""), None, f"status {e.code}", e.headers.get("Retry-After")
    except Exception as e:  # noqa: BLE001 - whatever goes wrong is the answer
        return url, None, None, None, type(e).__name__, None


def http_fetcher(timeout: float = TIMEOUT, host_delay: float = HOST_DELAY, host_open: int = HOST_OPEN, agent: str = "spindrift") -> Callable[[DataFrame], DataFrame]:
    """A ``fetch`` for ``crawl``.

    A host's URLs are dealt to at most ``host_open`` lanes, each of which asks one after the other and waits ``host_open`` times
    ``host_delay`` between the starts of two requests, so a host never sees more requests at once, or more a second, than that.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free: dict[str, float] = {}
        for pdf in parts:
            answers = []
            for url, lane in zip(pdf["url"], pdf["_lane"]):
                wait = free.get(lane, 0.0) - time.monotonic()
                if wait > 0:
                    time.sleep(wait)
                free[lane] = time.monotonic() + host_delay * host_open
                answers.append(ask(url, timeout, agent))
            yield pd.DataFrame(answers, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"status": "Int32"})

    def fetch(frontier: DataFrame) -> DataFrame:
        lane = F.concat_ws("/", netloc(F.col("url")), F.pmod(F.xxhash64("url"), F.lit(host_open)))
        # Lanes are spread over the tasks, and within a task their requests alternate: a host's wait is the others' time.
        dealt = frontier.select("url", lane.alias("_lane")).repartition("_lane").sortWithinPartitions(F.xxhash64("url"))
        return dealt.mapInPandas(run, SCHEMA)

    return fetch
