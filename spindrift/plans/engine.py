"""Serving: a search engine over a persisted index, with paging, a result cache and refresh."""

from __future__ import annotations

import logging
import threading
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from spindrift.functions.text import STOP_WORDS, cache_key
from spindrift.operators import rank
from spindrift.plans import store

# Fixed values of the serving layer.
CACHE_ENTRIES, CACHE_SECONDS, REFRESH_SECONDS, MAX_LIMIT, LOGGED_QUERY, SUMMARY_EVERY = 512, 600, 30, 50, 120, 100
#: Results of a query that are kept with it, in order; a page beyond them is looked up by itself.
HEAD = 200

_log = logging.getLogger(__name__)


@dataclass(frozen=True)
class SearchPage:
    """One page of results and the number of all."""

    results: list[dict]
    total: int

    def envelope(self) -> dict:
        return {"results": self.results, "total": self.total}

    def pages(self, limit: int = 10) -> int:
        """Pages that all results fill."""
        return -(-self.total // limit)


@dataclass(frozen=True)
class _Answer:
    """The first results of a query, at most ``HEAD``, and the number of all."""

    head: list[dict]
    total: int


class ResultCache:
    """Least recently used results with an expiry; of callers that ask for the same key at once, one works and the rest wait."""

    def __init__(self, entries: int = CACHE_ENTRIES, seconds: float = CACHE_SECONDS, clock: Callable[[], float] = time.monotonic):
        self.entries, self.seconds, self.clock = entries, seconds, clock
        self._kept: OrderedDict[str, tuple[float, object]] = OrderedDict()
        self._working: dict[str, tuple[threading.Event, list]] = {}
        self._lock = threading.Lock()

    def get(self, key: str, load: Callable[[], object]) -> tuple[object, str]:
        """(value, status); status is hit, miss or shared.  An error reaches all who wait and isn't kept."""
        with self._lock:
            if key in self._kept:
                at, value = self._kept[key]
                if self.clock() - at < self.seconds:
                    self._kept.move_to_end(key)
                    return value, "hit"
                del self._kept[key]
            waiting = self._working.get(key)
            if waiting is None:
                mine = self._working[key] = (threading.Event(), [])
        if waiting is not None:
            waiting[0].wait()
            value, error = waiting[1]
            if error is not None:
                raise error
            return value, "shared"
        value = error = None
        try:
            value = load()
        except BaseException as e:
            error = e
            raise
        finally:
            with self._lock:
                mine[1].extend((value, error))
                self._working.pop(key, None)
                if error is None:
                    self._kept[key] = (self.clock(), value)
                    while len(self._kept) > self.entries:
                        self._kept.popitem(last=False)
            mine[0].set()
        return value, "miss"

    def clear(self) -> None:
        with self._lock:
            self._kept.clear()


class SearchEngine:
    """Queries over the current version of an index folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, clock: Callable[[], float] = time.monotonic):
        self.spark, self.path, self.clock = spark, store.index_path(path), clock
        self.cache = ResultCache(clock=clock)
        self.counters = {"requests": 0, "hit": 0, "miss": 0, "shared": 0, "errors": 0, "latency_sum": 0.0, "latency_max": 0.0}
        self._tables: store.IndexTables | None = None
        self._looked = float("-inf")
        self._lock, self._counting = threading.Lock(), threading.Lock()

    @classmethod
    def open(cls, spark: SparkSession, path: str | None = None) -> SearchEngine:
        """Warm start: the tables are looked up now rather than at the first query."""
        engine = cls(spark, path)
        engine.tables()
        return engine

    def tables(self) -> store.IndexTables:
        """Tables of the current version; the manifest is looked at again after ``REFRESH_SECONDS``."""
        with self._lock:
            if self._tables is None or self.clock() - self._looked >= REFRESH_SECONDS:
                self._looked = self.clock()
                if self._tables is None or store.current_version(self.spark, self.path) != self._tables.version:
                    self._tables = store.open_index(self.spark, self.path)
                    self.cache.clear()
            return self._tables

    def health(self) -> dict:
        return {"status": "ok", "db_exists": store.current_version(self.spark, self.path) is not None}

    def _asked(self, query: str) -> DataFrame:
        return self.spark.createDataFrame([(0, query)], "query_id long, query string")

    def search(self, query: str) -> DataFrame:
        """page_id, first_pos, score, url of all results of a query, literally as written (no cache), unordered."""
        t = self.tables()
        words = _words(query)
        idf = t.idf.where(t.idf["word"].isin(*words)) if words else t.idf.limit(0)
        return rank.search(self._asked(query), store.postings_of(t, words), idf, t.pages, t.stats)

    def search_batch(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, rank, page_id, score, title, url, snippet: the first ``k`` results of each query."""
        t = self.tables()
        found = rank.top_k(rank.search(queries, t.postings, t.idf, t.pages, t.stats), k)
        return rank.with_snippets(found, queries, t.pages).select("query_id", "rank", "page_id", "score", "title", "url", "snippet")

    def search_page(self, query: str, page: int = 1, limit: int = 10) -> SearchPage:
        """A page of results through the cache.  The normalised query is used for the key and for the ranking alike."""
        return self.answer(query, page, limit)[0]

    def answer(self, query: str, page: int = 1, limit: int = 10) -> tuple[SearchPage, str]:
        """(page of results, how the cache answered: hit, miss or shared).

        What reaches the driver is the number of results and at most ``HEAD`` of them, which later pages are served
        from; a page beyond is fetched alone, under a key of its own.
        """
        if not query:
            raise ValueError("query must have at least one character")
        if page < 1:
            raise ValueError("page must be at least 1")
        if not 1 <= limit <= MAX_LIMIT:
            raise ValueError(f"limit must be 1 to {MAX_LIMIT}")
        began, key = self.clock(), cache_key(query)
        status, failed, total = "n/a", False, None
        try:
            self.tables()
            first, status = self.cache.get(key, lambda: self._first(key))
            start, total = (page - 1) * limit, first.total
            if start + limit <= len(first.head) or len(first.head) == total:
                rows = first.head[start : start + limit]
            elif start >= total:
                rows = []
            else:
                rows, status = self.cache.get(f"{key}\n{start}\n{limit}", lambda: self._rows(self.search(key), key, start, limit))
            return SearchPage(rows, total), status
        except Exception:
            failed = True
            raise
        finally:
            self._count(key, status, failed, self.clock() - began, total)

    def _count(self, query: str, status: str, failed: bool, spent: float, total: int | None) -> None:
        with self._counting:
            c = self.counters
            c["requests"] += 1
            if status in c:
                c[status] += 1
            c["errors"] += failed
            c["latency_sum"] += spent
            c["latency_max"] = max(c["latency_max"], spent)
            summary = dict(c) if c["requests"] % SUMMARY_EVERY == 0 else None
        _log.info("search seconds=%.3f cache=%s total=%s q=%r", spent, status, total, query[:LOGGED_QUERY])
        if summary:
            _log.info("metrics %s mean_latency=%.3f", summary, summary["latency_sum"] / summary["requests"])

    def _first(self, query: str) -> _Answer:
        if not query:
            return _Answer([], 0)
        found = self.search(query).persist()
        try:
            total = found.count()
            return _Answer(self._rows(found, query, 0, HEAD) if total else [], total)
        finally:
            found.unpersist()

    def _rows(self, found: DataFrame, query: str, start: int, n: int) -> list[dict]:
        """Rows ``start`` to ``start + n`` of the results, in order; texts are looked up for these only."""
        chosen = found.orderBy(*_order()).offset(start).limit(n)
        rows = rank.with_snippets(chosen, self._asked(query), self.tables().pages).orderBy(*_order()).select("title", "url", "score", "snippet")
        return [r.asDict() for r in rows.collect()]


def _order():
    from pyspark.sql import functions as F

    return F.desc("score"), F.asc("first_pos"), F.asc("page_id")


def _words(query: str) -> list[str]:
    """The query's words, as ``tokenize_query`` has them, to choose shards on the driver."""
    import re

    raw = re.findall("[a-z0-9]+", query.lower())
    return list(dict.fromkeys([w for w in raw if w not in STOP_WORDS] or raw))


def page_items(current: int, total: int) -> list[int | None]:
    """Page numbers of a pager, ``None`` for a gap."""
    if total <= 7:
        return list(range(1, total + 1))
    low, high = (1, 4) if current <= 3 else (total - 3, total) if current >= total - 2 else (current - 1, current + 1)
    shown = [1, *range(max(2, low), min(total - 1, high) + 1), total]
    out: list[int | None] = []
    for n in shown:
        if out and n - (out[-1] or 0) > 1:
            out.append(None)
        out.append(n)
    return out
