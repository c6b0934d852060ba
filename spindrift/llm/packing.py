"""Whole texts into containers of fixed capacity: a plain start, then swap-based local search."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.plans.runtime import materialize

#: Items packed together in one task; the open containers at the end of a task are all that sharding costs.
ITEMS_A_SHARD = 20_000
# The word-punctuation tokenizer's pattern, its classes spelt out as Unicode has them.
_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]+"


def token_count(text: Column) -> Column:
    """Tokens of the public WordPunct tokenizer; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(_TOKEN)), F.lit(0)).cast("long")


class Container:
    """Items of one container by size, and the sums that one or two of them can take out of it.

    Only distinct sizes matter to an exchange.  Those of a container of capacity c are fewer than sqrt(2 c), so all its
    pairs are at most c, however many items it holds.
    """

    def __init__(self) -> None:
        self.fill, self.changes = 0, 0
        self.by_size: dict[int, list[int]] = {}
        self._sums: tuple[list[int], list[int], list[tuple[int, int]]] | None = None

    def add(self, item: int, size: int) -> None:
        self.by_size.setdefault(size, []).append(item)
        self.fill += size
        self.changes += 1
        self._sums = None

    def take(self, size: int) -> int:
        item = self.by_size[size].pop()
        if not self.by_size[size]:
            del self.by_size[size]
        self.fill -= size
        self.changes += 1
        self._sums = None
        return item

    def sums(self) -> tuple[list[int], list[int], list[tuple[int, int]]]:
        """Sizes in order; sums of two items in order, and the two sizes of each."""
        if self._sums is None:
            sizes = sorted(self.by_size)
            pairs = sorted((x + y, x, y) for k, x in enumerate(sizes) for y in sizes[k if len(self.by_size[x]) > 1 else k + 1 :])
            self._sums = sizes, [p[0] for p in pairs], [p[1:] for p in pairs]
        return self._sums

    def items(self) -> list[int]:
        return [i for held in self.by_size.values() for i in held]


def next_fit(sizes: list[int], capacity: int) -> list[Container]:
    """The plain start: items in the order given, each into the last container if it fits, else into a new one."""
    out: list[Container] = []
    for item, size in enumerate(sizes):
        if not out or out[-1].fill + size > capacity:
            out.append(Container())
        out[-1].add(item, size)
    return out


def exchange(a: Container, b: Container, capacity: int) -> bool:
    """The exchange that fills ``a`` most at the cost of ``b``, which isn't fuller, if any.

    One item of ``b`` moves into ``a``; or one or two go there for one of ``a``'s, or one for two, which are smaller together.  What
    ``a`` gains, ``b`` loses, and ``a`` was the fuller one, so the sum of squared fills grows.
    """
    gap = capacity - a.fill
    (ones, twos, split), (mine, my_twos, my_split) = b.sums(), a.sums()
    gain, move = 0, None
    for taken, sums, leaving in ((0, ones, (0,)), (1, ones, mine), (2, twos, mine), (3, ones, my_twos)):
        for k, size in enumerate(leaving):
            at = bisect.bisect_right(sums, size + gap) - 1
            if at >= 0 and sums[at] - size > gain:
                gain, move = sums[at] - size, (taken, at, k)
                if gain == gap:
                    break
        if gain == gap:
            break
    if move is None:
        return False
    taken, at, k = move
    into = split[at] if taken == 2 else (ones[at],)
    out = () if taken == 0 else my_split[k] if taken == 3 else (mine[k],)
    there, here = [(b.take(x), x) for x in into], [(a.take(x), x) for x in out]
    for item, size in there:
        a.add(item, size)
    for item, size in here:
        b.add(item, size)
    return True


def local_search(bins: list[Container], capacity: int) -> list[Container]:
    """Exchanges between underfull containers until none raises the sum of squared fills; emptied containers go.

    The emptiest container gives first, to all fuller ones from the fullest on.  A pair is tried again only when one of the two
    has changed.  The sum is a growing whole number with a bound, so the search ends by itself.
    """
    tried: dict[tuple[int, int], tuple[int, int]] = {}
    open_ = [x for x in bins if 0 < x.fill < capacity]
    changed = True
    while changed:
        changed = False
        open_ = sorted((x for x in open_ if 0 < x.fill < capacity), key=lambda x: -x.fill)
        for hi in range(len(open_) - 1, 0, -1):
            giver = open_[hi]
            for taker in open_[:hi]:
                if not giver.fill:
                    break
                if taker.fill == capacity or taker.fill < giver.fill:
                    continue
                pair, state = (id(taker), id(giver)), (taker.changes, giver.changes)
                if tried.get(pair) == state:
                    continue
                if exchange(taker, giver, capacity):
                    changed = True
                else:
                    tried[pair] = state
    return [x for x in bins if x.fill]


def pack(sizes: list[int], capacity: int, group: int = 48) -> list[list[int]]:
    """Plain start, then local search in groups of underfull containers; what stays underfull meets again in new groups.

    Each round's groups take every n-th container by fill, so full and empty ones meet; the rounds end when one group holds all
    that are left, or when a round empties none.
    """
    done, under = [], next_fit(sizes, capacity)
    while True:
        done += [x for x in under if x.fill == capacity]
        under = sorted((x for x in under if x.fill < capacity), key=lambda x: -x.fill)
        n, before = max(1, len(under) // group), len(under)
        under = [x for k in range(n) for x in local_search(under[k::n], capacity)]
        if n == 1 or sum(x.fill < capacity for x in under) == before:
            return [x.items() for x in done + under]


def _pack_shards(capacity: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in parts:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = pdf["shard"].iloc[-1]
            for _, one in pdf[pdf["shard"] != last].groupby("shard", sort=False):
                yield done(one)
            rest = pdf[pdf["shard"] == last]
        if rest is not None and len(rest):
            yield done(rest)

    def done(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf["tokens"].tolist()
        container = np.empty(len(sizes), np.int64)
        for k, b in enumerate(pack(sizes, capacity)):
            container[b] = k
        return pdf.assign(container=container)[["doc_id", "piece", "pieces", "tokens", "shard", "container"]]

    return run


def pack_documents(documents: DataFrame, capacity: int = 1024, items_a_shard: int = ITEMS_A_SHARD) -> DataFrame:
    """doc_id, piece, pieces, tokens, shard, container: where each document, or each piece of a longer one, goes.

    A document of at most ``capacity`` tokens stays whole.  A longer one is cut into full pieces, each a container of
    its own (shard -1), and a rest that is packed like a short document.  Rows are spread by a hash of their place in the
    table over shards of bounded size; (shard, container) names a container.  Only ids and sizes are moved, never texts.

    Null and empty texts and texts without tokens take no room and give no row; each row counts as a document, equal
    ids and equal texts included; an empty table gives no row.
    """
    counts = documents.select("doc_id", token_count(F.col("text")).alias("n")).where("n > 0").withColumn("_row", F.monotonically_increasing_id())
    counts = materialize(counts, "sizes")
    spark = documents.sparkSession
    total = counts.count()
    shards = max(1, -(-total // items_a_shard))
    sized = counts.withColumn("pieces", F.ceil(F.col("n") / capacity).cast("long"))
    rest = sized.withColumn("tokens", F.col("n") - (F.col("pieces") - 1) * capacity).where("tokens > 0")
    keyed = rest.select("doc_id", F.col("pieces").alias("piece"), "pieces", "tokens", F.pmod(F.xxhash64("_row"), F.lit(shards)).cast("int").alias("shard"), "_row")
    partitions = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = keyed.repartition(partitions, "shard").sortWithinPartitions("shard", "_row").mapInPandas(
        _pack_shards(capacity), "doc_id long, piece long, pieces long, tokens long, shard int, container long"
    )
    cut = sized.where("pieces > 1").select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("pieces") - 1)).alias("piece"), "pieces")
    full = cut.select("doc_id", "piece", "pieces", F.lit(capacity).cast("long").alias("tokens"), F.lit(-1).alias("shard"), F.monotonically_increasing_id().alias("container"))
    return packed.unionByName(full)


def cut_documents(documents: DataFrame, capacity: int = 1024) -> DataFrame:
    """doc_id of the documents that the packing had to cut: those of which it placed more than one piece."""
    return pack_documents(documents, capacity).where("piece > 1").select("doc_id").distinct()
