"""Evaluation passages inside a corpus: SimHash windows, multi-index Hamming blocks, exact verification."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.plans.runtime import join_checked, materialize

#: Items are searched in blocks of so many; a pass over the documents probes so many blocks, whose windows are what a task holds.
ITEMS_A_BLOCK, BLOCKS_A_PASS = 5_000, 4
#: Words of a shingle (an item of fewer words is one shingle).
SHINGLE = 5
#: 64 bits in four blocks of 16: a fingerprint within RADIUS of another equals it in one block at least.
RADIUS, BLOCKS, BLOCK_BITS = 3, 4, 16
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Runs of Unicode letters and digits, in lower case."""
    found = _WORD.findall(text)
    return "\n".join(found).lower().split("\n") if found else []


class _Bits(dict):
    """Word -> row of a table of +1/-1 votes for 64 bits."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most, self.n = most, 0
        self.table = np.empty((1024, 64), np.int8)

    def __missing__(self, word: str) -> int:
        if self.n == len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        raw = np.frombuffer(xxhash.xxh64_digest(word), np.uint8)
        self.table[self.n] = np.unpackbits(raw).astype(np.int8) * 2 - 1
        self[word] = self.n
        self.n += 1
        return self.n - 1

    def rows(self, words: list[str]) -> np.ndarray:
        if self.n > self.most:
            self.clear()
            self.n = 0
        return np.fromiter((self[w] for w in words), np.int64, len(words))


def simhash_windows(rows: np.ndarray, table: np.ndarray, window: int) -> np.ndarray:
    """Fingerprint of each window of consecutive words: the sign of the summed votes (windows of odd size have no ties)."""
    if len(rows) < window:
        return np.empty(0, np.uint64)
    sums = np.zeros((len(rows) + 1, 64), np.int16)
    np.cumsum(table[rows], axis=0, dtype=np.int16, out=sums[1:])  # wraps; differences don't
    votes = sums[window:] - sums[:-window]
    return np.packbits(votes > 0, axis=1).view(np.uint64).ravel()


def shingles_of(words: list[str], n: int = SHINGLE) -> set[tuple[str, ...]]:
    """Sequences of ``n`` consecutive words."""
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def _hash(shingle: tuple[str, ...]) -> int:
    return xxhash.xxh64_intdigest("\n".join(shingle)) - (1 << 63)


class ItemIndex:
    """The windows of a block of items, looked up by each of the four blocks of their fingerprints.

    An item is read in windows of ``window`` words, or of its own length if that is shorter.  ``weights`` gives the
    weight of each shingle's hash, from all items; without it, weights are taken within the block.
    """

    def __init__(self, texts: list[str], ids: list[int], window: int, weights: dict[int, float] | None = None):
        self.ids = ids
        bits = _Bits(most=1 << 30)
        self.words = list(map(words_of, texts))
        self.size = [min(window, len(w)) for w in self.words]
        self.mine = [shingles_of(w, min(SHINGLE, len(w))) if w else set() for w in self.words]
        by_size: dict[int, list[int]] = defaultdict(list)
        for i, n in enumerate(self.size):
            if n:
                by_size[n].append(i)
        #: window length -> (fingerprints, item of each, place of each, one lookup table for each block of bits)
        self.windows: dict[int, tuple] = {}
        for n, chosen in by_size.items():
            prints = [simhash_windows(bits.rows(self.words[i]), bits.table, n) for i in chosen]
            owner = np.repeat(np.array(chosen, np.int64), [len(p) for p in prints])
            at = np.concatenate([np.arange(len(p)) for p in prints])
            flat, tables = np.concatenate(prints), []
            for b in range(BLOCKS):
                v = self.block(flat, b)
                order = np.argsort(v, kind="stable")
                tables.append((order, np.searchsorted(v[order], np.arange((1 << BLOCK_BITS) + 1))))
            self.windows[n] = flat, owner, at, tables
        if weights is None:
            df: dict[int, int] = defaultdict(int)
            for s in (_hash(x) for mine in self.mine for x in mine):
                df[s] += 1
            weights = {s: math.log(1 + len(self.words) / n) for s, n in df.items()}
        self.weight = {x: weights[_hash(x)] for mine in self.mine for x in mine}

    @staticmethod
    def block(prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(BLOCK_BITS * b)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)

    def near(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``prints``, window of the index) within RADIUS, for windows of ``size`` words; a pair may come once for each equal block."""
        flat, _, _, tables = self.windows[size]
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for b, (order, start) in enumerate(tables):
            v = self.block(prints, b)
            n = start[v + 1] - start[v]
            rows = np.repeat(np.arange(len(prints)), n)
            if not len(rows):
                continue
            first = np.repeat(start[v] - (np.cumsum(n) - n), n)
            other = order[np.arange(len(rows)) + first]
            ok = np.bitwise_count(prints[rows] ^ flat[other]) <= RADIUS
            left.append(rows[ok])
            right.append(other[ok])
        return np.concatenate(left), np.concatenate(right)

    def verify(self, words: list[str], item: int, anchors: list[tuple[int, int]]) -> tuple[int, float]:
        """Longest run of equal consecutive words through an anchor, and the weighted share of the item's shingles that the document has.

        The shingles come first: a window that stands in the document whole brings all of its own.
        """
        own, mine, size = self.words[item], self.mine[item], self.size[item]
        k = min(SHINGLE, len(own))
        there = shingles_of(words, k) & mine
        total = sum(self.weight[s] for s in mine)
        similarity = sum(self.weight[s] for s in there) / total if total else 0.0
        longest = 0
        if not there:
            return longest, similarity
        by_diagonal = defaultdict(set)
        for i, j in anchors:
            by_diagonal[i - j].add(i)
        for d, starts in by_diagonal.items():
            done = -1
            for i in sorted(starts):
                if i < done:
                    continue
                a, b = i, i + size
                if tuple(words[a : a + k]) not in there or words[a:b] != own[a - d : b - d]:
                    continue
                while b < len(words) and b - d < len(own) and words[b] == own[b - d]:
                    b += 1
                while a > 0 and a - d > 0 and words[a - 1] == own[a - d - 1]:
                    a -= 1
                longest, done = max(longest, b - a), b - size + 1
        return longest, similarity


def _search(indexes) -> object:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks: list[ItemIndex] = indexes.value
        sizes = sorted({n for ix in blocks for n in ix.windows})
        bits = _Bits()
        for whole in parts:
            for at in range(0, len(whole), 256):
                pdf = whole.iloc[at : at + 256]
                ids = pdf["doc_id"].tolist()
                docs = [words_of(t) for t in pdf["text"]]
                ends = np.cumsum([len(d) for d in docs])
                rows_of = bits.rows([w for d in docs for w in d])
                out = []
                pairs: dict[tuple[int, int, int], list] = defaultdict(list)
                for size in sizes:
                    prints = simhash_windows(rows_of, bits.table, size)  # once for all blocks of items
                    for k, ix in enumerate(blocks):
                        if size not in ix.windows:
                            continue
                        rows, other = ix.near(prints, size)
                        doc = np.searchsorted(ends, rows, side="right")
                        inside = rows + size <= ends[doc] if len(rows) else np.empty(0, bool)
                        _, owner, place, _ = ix.windows[size]
                        for d, r, o in zip(doc[inside].tolist(), rows[inside].tolist(), other[inside].tolist()):
                            pairs[d, k, int(owner[o])].append((r - (int(ends[d]) - len(docs[d])), int(place[o])))
                out = [(ids[d], blocks[k].ids[item], *blocks[k].verify(docs[d], item, anchors)) for (d, k, item), anchors in pairs.items()]
                if out:
                    yield pd.DataFrame(out, columns=["doc_id", "item_id", "longest_run", "similarity"])

    return run


def _item_shingles(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        words = [words_of(t) for t in pdf["text"]]
        yield pdf[["item_id", "text"]].assign(shingles=[[_hash(x) for x in shingles_of(w, min(SHINGLE, len(w)))] if w else [] for w in words])


def weighed_items(items: DataFrame) -> tuple[DataFrame, int]:
    """(item_id, text, weights) with the weight ln(1 + N / n) of each shingle that n of all N items have, and N."""
    asked = materialize(items.where("item_id is not null and text <> ''").select("item_id", "text").distinct().mapInPandas(_item_shingles, "item_id long, text string, shingles array<long>"), "items")
    n = asked.count()
    each = asked.select(F.xxhash64("item_id", "text").alias("_key"), F.explode("shingles").alias("shingle"))
    df = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("_df"))
    weighed = join_checked(each, df, ["shingle"], label="shingles").withColumn("_w", F.log(1 + F.lit(n) / F.col("_df")))
    maps = weighed.groupBy("_key").agg(F.map_from_entries(F.collect_set(F.struct("shingle", "_w"))).alias("weights"))
    return asked.withColumn("_key", F.xxhash64("item_id", "text")).join(maps, "_key", "left").select("item_id", "text", "weights"), n


def leaked_items(documents: DataFrame, items: DataFrame, window: int = 13, items_a_block: int = ITEMS_A_BLOCK) -> DataFrame:
    """doc_id, item_id, longest_run, similarity of every document and item with windows near each other.

    Windows have ``window`` words, or the item's own number if it has fewer: a passage of that length is what counts as a
    leak.  The evaluation set is the stated query set: it goes to every task in blocks of ``items_a_block`` items, and a pass
    over the documents, whose texts are never moved, hashes their windows once and probes up to ``BLOCKS_A_PASS`` blocks.
    Equal windows have equal fingerprints, so every common run of a window's length is found; windows within Hamming
    distance 3 are found too.  ``longest_run`` is the exact longest common run of words (0 if under the window),
    ``similarity`` the weighted share of the item's 5-word shingles that stand in the document; weights are those of all items.

    Null or empty texts and null ids give nothing, nor do items without words; a repeated row counts once; of an item id with
    several texts all are searched.
    """
    docs = documents.where("doc_id is not null and text <> ''").select("doc_id", "text")
    spark = documents.sparkSession
    asked, n = weighed_items(items)
    asked = materialize(asked, "asked")
    blocks = max(1, math.ceil(n / items_a_block))
    found = None
    for first in range(0, blocks, BLOCKS_A_PASS):
        indexes = []
        for b in range(first, min(blocks, first + BLOCKS_A_PASS)):
            rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
            weights = {k: w for r in rows for k, w in (r["weights"] or {}).items()}
            indexes.append(ItemIndex([r["text"] for r in rows], [r["item_id"] for r in rows], window, weights))
        part = docs.mapInPandas(_search(spark.sparkContext.broadcast(indexes)), "doc_id long, item_id long, longest_run long, similarity double")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.max("longest_run").alias("longest_run"), F.max("similarity").alias("similarity"))


def leaks(documents: DataFrame, items: DataFrame, run: int = 13) -> DataFrame:
    """doc_id, item_id with at least ``run`` consecutive words in common."""
    return leaked_items(documents, items, run).where(F.col("longest_run") >= run).select("doc_id", "item_id")
