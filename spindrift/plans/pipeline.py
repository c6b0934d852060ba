"""The offline pipeline: crawl, index, rank; one Spark application with timings."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spindrift.operators import crawl, graph
from spindrift.plans import store
from spindrift.sources import jsonl

STEPS = ("clean", "crawl", "index")


def run(
    spark: SparkSession,
    records_path: str,
    index_path: str,
    fetch: Callable[[DataFrame], DataFrame] | None = None,
    seeds: list[str] | None = None,
    skip: tuple[str, ...] = (),
    max_pages: int = crawl.MAX_PAGES,
    domain_cap: int = crawl.DOMAIN_CAP,
    shards: int = store.SHARDS,
    check_domains: bool = True,
    log: Callable[[str], None] = print,
) -> dict[str, float]:
    """Seconds of each step that ran.  ``clean`` drops the old records, ``crawl`` needs a fetcher, ``index`` reads the
    records, builds all tables with PageRank and switches to the new version.  An error in a step ends the run."""
    unknown = set(skip) - set(STEPS)
    if unknown:
        raise ValueError(f"unknown steps: {sorted(unknown)}")
    spent: dict[str, float] = {}

    def step(name: str, work: Callable[[], object]) -> None:
        if name in skip:
            return
        began = time.monotonic()
        work()
        spent[name] = time.monotonic() - began
        log(f"{name}: {spent[name]:.1f} s")

    def clean() -> None:
        store.remove_old(spark, index_path)
        for path in (records_path, f"{records_path}.failed"):
            fs, p = store._fs(spark, path)
            fs.delete(p, True)

    def crawl_all() -> None:
        if fetch is None:
            raise ValueError("the crawl step needs a fetcher")
        rows = [(u, k) for k, u in enumerate(seeds or crawl.SEEDS)]
        records, failed = crawl.crawl(fetch, spark.createDataFrame(rows, "url string, place long"), max_pages, domain_cap, check_domains=check_domains)
        jsonl.write_records(records, records_path, "overwrite")
        failed.write.mode("overwrite").json(f"{records_path}.failed")

    def index_all() -> None:
        records = jsonl.read_pages(spark, records_path)
        store.write_index(jsonl.pages_table(records), graph.resolve_links(records), index_path, shards)

    step("clean", clean)
    step("crawl", crawl_all)
    step("index", index_all)
    log(f"total: {sum(spent.values()):.1f} s")
    return spent
