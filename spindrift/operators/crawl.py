"""Crawl control: admission, breadth-first rounds over a pluggable fetcher, retries and statistics."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.html import page_records
from spindrift.functions.urls import crawl_url, is_allowed, is_valid_url, netloc
from spindrift.plans.runtime import counted, join_checked, materialize

# Seeds, caps, and the answers that are worth another try.
SEEDS = tuple(
    """https://en.wikipedia.org/wiki/Computer_science https://en.wikipedia.org/wiki/Mathematics https://en.wikipedia.org/wiki/Database
    https://en.wikipedia.org/wiki/Artificial_intelligence https://en.wikipedia.org/wiki/Computer_Network
    https://en.wikipedia.org/wiki/Operating_system https://en.wikipedia.org/wiki/Programming_language
    https://en.wikipedia.org/wiki/Theory_of_computation https://en.wikipedia.org/wiki/Programming_paradigm
    https://en.wikipedia.org/wiki/Data_structure https://en.wikipedia.org/wiki/ https://medlineplus.gov/healthtopics.html
    https://www.nasa.gov/ https://developer.mozilla.org/en-US/docs/Web https://cs50.harvard.edu/x/ https://www.britannica.com/
    https://www.theverge.com/tech https://www.investopedia.com/ https://stackoverflow.com/questions""".split()
)
MAX_PAGES, DOMAIN_CAP = 10_000, 50
RETRY_STATUSES, MAX_RETRIES = (429, 500, 502, 503, 504), 2


def admit(candidates: DataFrame, seen: DataFrame, max_pages: int = MAX_PAGES, domain_cap: int = DOMAIN_CAP, check_domains: bool = True) -> DataFrame:
    """url, domain, place: the candidates (url, place) that are scheduled, in order of arrival.

    ``seen`` (url, domain) holds what was admitted before.  URLs are compared in canonical form; of equal ones the
    first counts.  A domain gets at most ``domain_cap`` pages and the crawl ``max_pages`` in all, earlier rounds
    included.  A URL refused by a cap isn't remembered and may come again.
    """
    known, n_seen = counted(seen, "seen")
    left = max(0, max_pages - n_seen)
    urls = candidates.select(crawl_url(F.col("url")).alias("url"), "place").where(is_valid_url(F.col("url")))
    if check_domains:
        urls = urls.where(is_allowed(F.col("url")))
    fresh = urls.groupBy("url").agg(F.min("place").alias("place")).join(known.select("url"), "url", "left_anti").withColumn("domain", netloc(F.col("url")))
    per_domain = known.groupBy("domain").agg(F.count(F.lit(1)).alias("_used"))
    # The rank of a URL in its domain is only needed up to the cap, so tasks drop the rest before the shuffle.
    nth = F.row_number().over(Window.partitionBy("domain").orderBy("place", "url"))
    ranked = fresh.withColumn("_k", nth).where(F.col("_k") <= domain_cap)
    ok = ranked.join(per_domain, "domain", "left").where(F.col("_k") <= domain_cap - F.coalesce("_used", F.lit(0)))
    return dense_places(ok.select("url", "domain", "place")).where(F.col("place") < left)


def dense_places(urls: DataFrame) -> DataFrame:
    """url, domain, place with places 0, 1, ... in the order of (place, url); counts of ranges give their first place, so no task sees all rows."""
    ranged = materialize(urls.repartitionByRange("place", "url").withColumn("_p", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # one row a range
    first = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy("place", "url"))
    placed = join_checked(ranged.withColumn("_k", inside), first, ["_p"], label="ranges")
    return placed.select("url", "domain", (F.col("_first") + F.col("_k") - 1).cast("long").alias("place"))


def domain_capped(urls: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` urls (by place) of each host."""
    host = urls.withColumn("domain", netloc(F.col("url")))
    return host.withColumn("_k", F.row_number().over(Window.partitionBy("domain").orderBy("place"))).where(F.col("_k") <= cap).drop("_k")


def fetch_all(fetch: Callable[[DataFrame], DataFrame], urls: DataFrame, retries: int = MAX_RETRIES, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """The last answer to each url, with the number of its ``attempt`` (from 0).

    Answers that are worth it are asked for again, all of an attempt at once, after the longest of their delays.  ``fetch``
    may give a ``retry_after`` column.
    """
    asked, done = urls.select("url"), None
    for attempt in range(retries + 1):
        answers = fetch(asked)
        if "retry_after" not in answers.columns:
            answers = answers.withColumn("retry_after", F.lit(None).cast("string"))
        answers = answers.select("url", "status", "content_type", "html", "error", "retry_after").withColumn("attempt", F.lit(attempt))
        answers = materialize(answers.withColumn("_again", worth_retry(F.col("status"), F.col("attempt"), retries)), "answers")
        kept = answers.where("not _again").drop("_again", "retry_after")
        done = kept if done is None else done.unionByName(kept)
        again = answers.where("_again")
        asks = again.agg(F.count(F.lit(1)).alias("n"), F.max(F.col("retry_after").try_cast("double")).alias("after")).first()
        if not asks["n"]:
            break
        wait(retry_delay(attempt, None if asks["after"] is None else str(asks["after"])))
        asked = again.select("url")
    return done


def crawl(
    fetch: Callable[[DataFrame], DataFrame], seeds: DataFrame, max_pages: int = MAX_PAGES, domain_cap: int = DOMAIN_CAP, max_rounds: int | None = None, check_domains: bool = True,
    retries: int = MAX_RETRIES, wait: Callable[[float], None] = time.sleep,
) -> tuple[DataFrame, DataFrame]:
    """(records, failed) of a breadth-first crawl.

    ``fetch`` turns a frontier (url) into (url, status, content_type, html, error); it may be a table lookup, a data
    source or a network client.  Each round fetches the frontier, with retries, extracts pages and admits their links, until no link is
    left to fetch (or ``max_rounds`` are over).  Only 200 answers of type text/html are read.  Rounds are tables; the driver
    sees counts only.
    """
    spark = seeds.sparkSession
    seen = spark.createDataFrame([], "url string, domain string")
    frontier = materialize(admit(seeds.select("url", "place"), seen, max_pages, domain_cap, check_domains), "frontier")
    records = failed = None
    rounds = 0
    while not frontier.isEmpty() and (max_rounds is None or rounds < max_rounds):
        rounds += 1
        seen = materialize(seen.unionByName(frontier.select("url", "domain")), "seen")
        answers = fetch_all(fetch, frontier, retries, wait)
        good = answers.where(is_html_answer(F.col("status"), F.col("content_type")))
        pages = materialize(page_records(good.select("url", "html")), "pages")
        bad = answers.where(~F.coalesce(F.col("status") == 200, F.lit(False))).select("url", F.coalesce("error", F.concat(F.lit("status "), F.col("status").cast("string"))).alias("error"))
        records = pages if records is None else records.unionByName(pages)
        failed = bad if failed is None else failed.unionByName(bad)
        places = frontier.select("url", "place").join(pages, "url").select("place", F.posexplode("links").alias("k", "url"))
        # Arrival order: by the linking page, then by the link's place on it.  Places are dense in each round, so the product stays small.
        links = places.select("url", (F.col("place") * 64 + F.col("k")).alias("place"))
        ranked = links.groupBy("url").agg(F.min("place").alias("place"))
        frontier = materialize(admit(ranked, seen, max_pages, domain_cap, check_domains), "frontier")
    if records is None:
        records = page_records(spark.createDataFrame([], "url string, html string"))
        failed = spark.createDataFrame([], "url string, error string")
    return records, failed


def is_html_answer(status, content_type):
    return F.coalesce((status == 200) & F.contains(F.lower(content_type), F.lit("text/html")), F.lit(False))


def worth_retry(status: Column, attempt: Column, retries: int = MAX_RETRIES) -> Column:
    """Whether an attempt (counted from 0) is repeated: without an answer, or with one of the answers that may change."""
    return (attempt < retries) & (status.isNull() | status.isin(*RETRY_STATUSES))


def retry_plan(log: DataFrame, retries: int = MAX_RETRIES) -> DataFrame:
    """fetch_id, attempt, again, delay: of each fetch (its last written row) the number of earlier fetches of its url, whether it is to be repeated, and the least seconds to wait."""
    last = last_fetches(log).where(F.col("url").isNotNull())
    attempt = F.row_number().over(Window.partitionBy("url").orderBy("fetched_at", "fetch_id")) - 1
    again = worth_retry(F.col("status"), F.col("attempt"), retries)
    return last.withColumn("attempt", attempt.cast("long")).select("fetch_id", "attempt", again.alias("again"), F.when(again, 0.5 * F.pow(F.lit(2.0), F.col("attempt"))).alias("delay"))


def should_retry(status: int | None, attempt: int, error: bool = False, retries: int = MAX_RETRIES) -> bool:
    """Whether a failed attempt (counted from 0) is repeated."""
    return attempt < retries and (error or status in RETRY_STATUSES)


def retry_delay(attempt: int, retry_after: str | None = None, jitter: float | None = None) -> float:
    """Seconds to wait: what the server asks for, else 0.5, 1, 2, ... and up to 0.3 at random."""
    if retry_after is not None:
        try:
            return max(0.0, float(retry_after))
        except ValueError:
            pass
    return 0.5 * 2**attempt + (random.uniform(0, 0.3) if jitter is None else jitter)


def last_fetches(log: DataFrame) -> DataFrame:
    """The last written row of each fetch."""
    columns = [c for c in ("written_at", "fetched_at", "status", "error", "n_bytes", "page_id", "url") if c in log.columns]
    return log.where("fetch_id is not null").groupBy("fetch_id").agg(F.max(F.struct(*columns)).alias("_r")).select("fetch_id", "_r.*")


def crawl_stats(log: DataFrame) -> DataFrame:
    """One row of counters of a fetch log; each fetch counts once, with its last written row.  ``pages_per_second``: succeeded ones between the first and the last fetch."""
    ok = F.coalesce(F.col("status") == 200, F.lit(False))
    seconds = (F.unix_micros(F.max("fetched_at").cast("timestamp")) - F.unix_micros(F.min("fetched_at").cast("timestamp"))) / 1e6
    return last_fetches(log).agg(
        F.count(F.lit(1)).alias("fetched"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.count_if(F.col("status").isin(*RETRY_STATUSES)).alias("worth_retrying"),
        F.count_if(F.col("status").isNull()).alias("no_status"), F.coalesce(F.sum(F.when(ok, F.col("n_bytes"))), F.lit(0)).alias("bytes"), F.count_distinct(F.when(ok, F.col("page_id"))).alias("pages"),
        F.round(F.when(seconds > 0, F.count_if(ok) / seconds), 6).alias("pages_per_second"),
    )


def failed_log(log: DataFrame) -> DataFrame:
    """url, error of the failed fetches, distinct."""
    bad = ~F.coalesce(F.col("status") == 200, F.lit(False))
    return log.where(bad & F.col("url").isNotNull()).select("url", F.coalesce(F.nullif(F.col("error"), F.lit("")), F.concat(F.lit("status "), F.col("status").cast("string")), F.lit("unknown")).alias("error")).distinct()


def request_metrics(requests: DataFrame, kind: str, latency: str) -> DataFrame:
    """kind, requests, mean and greatest latency of each kind of request; ``errors`` counts those of kind error."""
    return requests.groupBy(F.col(kind).alias("kind")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col(kind) == "error").alias("errors"), F.round(F.avg(latency), 6).alias("mean_latency"), F.max(latency).alias("max_latency")
    )


def server_metrics(requests: DataFrame) -> DataFrame:
    """One row for a request log (path, status, cache_status, latency): all and search requests, hits, misses and shared of the latter, errors (status 500 and above), mean and greatest latency."""
    search = F.coalesce(F.endswith(F.col("path"), F.lit("/search")), F.lit(False))
    kinds = [F.count_if(search & (F.col("cache_status") == k)).alias(n) for k, n in (("hit", "cache_hits"), ("miss", "cache_misses"), ("shared", "cache_shared"))]
    return requests.agg(
        F.count(F.lit(1)).alias("total_requests"), F.count_if(search).alias("search_requests"), *kinds, F.count_if(F.col("status") >= 500).alias("error_requests"),
        F.round(F.avg("latency"), 6).alias("mean_latency"), F.max("latency").alias("max_latency"),
    )
