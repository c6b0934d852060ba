"""Near-duplicate pages: multi-index hashing over min-hash fingerprints, then exact similarity."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.plans.runtime import BROADCAST_ROWS, counted, join_checked, join_split, materialize

#: A fingerprint is PLACES symbols, of which SEGMENTS words of WIDTH are looked up; a Hamming ball of radius 1 around a segment has one key for each position left open.
PLACES, SEGMENTS, WIDTH = 256, 16, 7
SYMBOLS = SEGMENTS * WIDTH
#: Rounds in which each sequence falls on one place; a place that none fell on takes the least hash over all.
ROUNDS = 32
#: The columns of a page's code, a bit a place.
BITS = ["bits_a", "bits_b", "bits_c", "bits_d"]
#: Members of a bucket that meet in one task; a larger bucket is paired in blocks of this size.
BUCKET = 2_000
#: Codes of pages are broadcast up to this number (40 bytes each), else joined by a shuffle.
BROADCAST_KEYS = 200_000
_WORD = re.compile("[a-z0-9]+")
_RNG = np.random.default_rng(20240607)
_MUL = _RNG.integers(1, 2**63, ROUNDS + PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(1, 2**63, ROUNDS + PLACES, dtype=np.uint64)
_KEY = _RNG.integers(1, 2**63, SYMBOLS, dtype=np.uint64)
_ROUND = np.arange(ROUNDS + 1, dtype=np.uint64) << np.uint64(50)
_NONE = np.uint64(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shifts and odd multiplications)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Word -> row of a growing table of hashes; forgotten when it gets large."""

    def __init__(self, most: int = 1_000_000):
        super().__init__()
        self.most, self.hashes = most, np.empty(4096, np.uint64)

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.empty_like(self.hashes)])
        self.hashes[at] = xxhash.xxh64_intdigest(word)
        self[word] = at
        return at

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.hashes[at]


def shingles(text: str, words: _Words, n: int = 3) -> np.ndarray:
    """Distinct hashes of the sequences of ``n`` consecutive words (runs of a-z and 0-9 of the lower-cased text)."""
    h = words.of(_WORD.findall(text.lower()))
    if len(h) < n:
        return np.empty(0, np.uint64)
    x = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    return np.unique(_mix(x))


def symbols(s: np.ndarray) -> np.ndarray:
    """PLACES min-hash symbols of a set of hashes; two sets agree in a place with the probability of their similarity.

    In each round a hash falls on one place, and a place keeps the least (round, hash) that fell on it.  Once all places are
    taken, later rounds can't change them, so a set costs a number of hashes that hardly depends on its size.
    """
    least = np.full(PLACES, _NONE)
    step = -(-8 * PLACES // len(s))
    for r in range(0, ROUNDS, step):
        now = slice(r, min(r + step, ROUNDS))
        h = s[:, None] * _MUL[now] + _ADD[now]
        np.minimum.at(least, (h >> np.uint64(56)).astype(np.intp).ravel(), (_ROUND[now] | ((h << np.uint64(8)) >> np.uint64(14))).ravel())
        if (least != _NONE).all():
            return least
    free = np.flatnonzero(least == _NONE)
    least[free] = _ROUND[ROUNDS] | ((s[:, None] * _MUL[ROUNDS + free] + _ADD[ROUNDS + free]) >> np.uint64(14)).min(axis=0)
    return least


def _features(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words = _Words()
    for pdf in parts:
        ids, sizes, sums, xors, found = [], [], [], [], []
        for i, text in zip(pdf["page_id"].tolist(), pdf["content"]):
            s = shingles(text, words)
            if not len(s):
                continue
            ids.append(i)
            sizes.append(len(s))
            sums.append(s.sum(dtype=np.uint64))
            xors.append(np.bitwise_xor.reduce(_mix(s)))
            found.append(symbols(s))
        if not ids:
            continue
        low = _mix(np.array(found, np.uint64))
        bits = np.packbits((low & np.uint64(1)).astype(bool), axis=1).view(np.int64)
        yield pd.DataFrame(
            {
                "page_id": ids,
                "size": np.array(sizes, np.int32),
                "set_a": np.array(sums, np.uint64).view(np.int64),
                "set_b": np.array(xors, np.uint64).view(np.int64),
                **{c: bits[:, k] for k, c in enumerate(BITS)},
                "words": [x.tobytes() for x in (low[:, :SYMBOLS] >> np.uint64(32)).astype(np.uint32)],
            }
        )


def _ball(words: pd.Series) -> pd.Series:
    """The keys of a page: for each symbol of a segment the hash of the segment's others."""
    part = _mix(np.frombuffer(b"".join(words), np.uint32).reshape(-1, SYMBOLS).astype(np.uint64) ^ _KEY).reshape(-1, SEGMENTS, WIDTH)
    keys = _mix(part.sum(axis=2, dtype=np.uint64)[:, :, None] - part + _KEY.reshape(SEGMENTS, WIDTH))
    return pd.Series(list(keys.reshape(-1, SYMBOLS).view(np.int64)))


def fingerprints(pages: DataFrame) -> DataFrame:
    """page_id, size (number of sequences), set_a, set_b (identity of the set of sequences), bits_a to bits_d (a bit a place), words (the segments, 4 bytes a symbol)."""
    rows = pages.where("id is not null and content <> ''").select(F.col("id").alias("page_id"), "content")
    return rows.mapInPandas(_features, f"page_id long, size int, set_a long, set_b long, {' long, '.join(BITS)} long, words binary")


def with_keys(prints: DataFrame) -> DataFrame:
    """``prints`` with keys (the ball of each segment) in the place of words: twice their size, so they are worked out when they are read."""
    # Called nondeterministic, since a filter that is inferred from an explode would work them out a second time.
    return prints.withColumn("keys", F.pandas_udf(_ball, "array<long>").asNondeterministic()("words")).drop("words")


def candidate_pairs(prints: DataFrame, most_bits: int = 44, bucket: int = BUCKET, broadcast_keys: int = BROADCAST_KEYS, most_far: int = 68) -> DataFrame:
    """a, b: all pairs that share a key and whose codes differ in at most ``most_bits`` of the first 128 bits and ``most_far`` of all 256.

    ``bits_c`` and ``bits_d``, the other 128 bits, may be missing; then the first test is the only one.

    Only a key and a page id are shuffled to find the keys of several pages; codes are joined to what is left.  A bucket
    of more than ``bucket`` members is cut into blocks of about that size; every block
    meets the whole bucket in a task of its own, so no pair is lost and no task gets the whole product.  The tests of
    distance are part of the join, and only near pairs leave it.
    """
    bits = [c for c in BITS if c in prints.columns]
    keys = prints.select("page_id", F.explode("keys").alias("key")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1")
    codes, n = counted(prints.select("page_id", *bits).distinct(), "codes")
    blocks = keys.select("key", "page_id", F.ceil(F.col("n") / bucket).cast("int").alias("blocks"))
    shared = materialize(blocks.join(F.broadcast(codes) if n <= broadcast_keys else codes, "page_id"), "shared")
    own = F.pmod(F.xxhash64("page_id"), F.col("blocks").cast("long")).cast("int")
    a = shared.select("key", own.alias("block"), F.col("page_id").alias("a"), *(F.col(c).alias(f"_x{c}") for c in bits))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    b = shared.select("key", every.alias("block"), F.col("page_id").alias("b"), *(F.col(c).alias(f"_y{c}") for c in bits))
    apart = [F.bit_count(F.col(f"_x{c}").bitwiseXOR(F.col(f"_y{c}"))) for c in bits]
    close = (apart[0] + apart[1] <= most_bits) & (sum(apart[1:], apart[0]) <= most_far)
    return a.join(b, ["key", "block"]).where((F.col("a") < F.col("b")) & close).select("a", "b").distinct()


def _similar(threshold: float):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, sets = _Words(), {}

        def of(page: int, text: str) -> np.ndarray:
            """A page's sequences; the pages of a task come up in several pairs."""
            if page not in sets:
                if len(sets) >= 2_000:
                    sets.pop(next(iter(sets)))
                sets[page] = shingles(text, words)
            return sets[page]

        for pdf in parts:
            keep = []
            for a, b, x, y in zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["text_a"], pdf["text_b"]):
                s, t = of(a, x), of(b, y)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(both / max(1, len(s) + len(t) - both))
            out = pdf[["a", "b"]].assign(similarity=keep)
            yield out[out["similarity"] >= threshold]

    return run


def similar_classes(pages: DataFrame, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has page_id and rep, the class of pages with the same set of sequences; links has a, b,
    similarity for each pair of class representatives at or above ``threshold``.

    Candidates share a segment but for one symbol (multi-index hashing with balls of radius 1) and are near in the codes of
    their whole fingerprints; the similarity is then taken exactly over both texts.  At similarity 0.7 a pair shares such a
    segment with probability 0.9983, at 0.8 with 0.999999; the tests of distance lose less than one such pair in a million.
    Pages that have only a site's furniture in common (similarity 0.2) share one with probability 0.006 and are told apart
    by their codes inside the join, so such pairs, whose number grows with the square of a site's pages, are never written.
    """
    prints = materialize(fingerprints(pages), "prints")
    members = prints.select("page_id", "set_a", "set_b").distinct()
    reps = members.groupBy("set_a", "set_b").agg(F.min("page_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    # Copies are few, so the table with the keys is neither shuffled nor written again.
    copies = members.select("page_id").distinct().join(reps.select(F.col("rep").alias("page_id")), "page_id", "left_anti")
    own = join_checked(prints, copies, ["page_id"], "left_anti", label="copies")
    pairs = materialize(candidate_pairs(with_keys(own)), "candidates")
    sizes = own.groupBy("page_id").agg(F.min("size").alias("size"), F.max("size").alias("most"))
    with_a = pairs.join(sizes.select(F.col("page_id").alias("a"), F.col("size").alias("_sa"), F.col("most").alias("_ma")), "a")
    with_b = with_a.join(sizes.select(F.col("page_id").alias("b"), F.col("size").alias("_sb"), F.col("most").alias("_mb")), "b")
    # Sets can't be more similar than the smaller is to the larger by size: an exact test that spares the texts of the rest.
    by_size = (F.col("_ma") >= (threshold - 1e-9) * F.col("_sb")) & (F.col("_mb") >= (threshold - 1e-9) * F.col("_sa"))
    near = materialize(with_b.where(by_size).select("a", "b"), "near")
    needed = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    rows = pages.where("id is not null and content <> ''").select("id", "content")
    texts = materialize(join_checked(rows, needed, ["id"], label="needed").groupBy("id").agg(F.min("content").alias("content")), "texts")
    wide = near.join(texts.select(F.col("id").alias("a"), F.col("content").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("content").alias("text_b")), "b")
    links = wide.mapInPandas(_similar(threshold), "a long, b long, similarity double")
    multi = materialize(reps.where("n > 1").select("set_a", "set_b", "rep"), "classes")
    # Only classes of several pages need the lookup; every other page is its own class.
    classed = join_checked(members, multi, ["set_a", "set_b"], "left", label="classes")
    return classed.select("page_id", F.coalesce("rep", "page_id").alias("rep")), links


def pairs_within(members: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """page_a, page_b: all pairs of the pages (page_id) of one class (rep).

    A class of more than ``bucket`` pages is cut into blocks; each block meets the whole class in a task of its own, so the most
    copied page loads no single task with all its pairs.
    """
    several, n = counted(members.groupBy("rep").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("rep", F.ceil(F.col("_n") / bucket).cast("int").alias("_blocks")), "several")
    known = members.join(F.broadcast(several), "rep") if n <= BROADCAST_ROWS else join_split(members, several, ["rep"])
    known = materialize(known, "copies")
    own = F.pmod(F.xxhash64("page_id"), F.col("_blocks").cast("long")).cast("int")
    a = known.select("rep", own.alias("_block"), F.col("page_id").alias("page_a"))
    b = known.select("rep", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), F.col("page_id").alias("page_b"))
    return a.join(b, ["rep", "_block"]).where("page_a < page_b").select("page_a", "page_b")


def page_classes(pages: DataFrame, threshold: float = 0.7) -> DataFrame:
    """page_id, class_id, n_links: each page with the least page of its class (same sequences), and the number of other classes at or above the threshold.

    The form for large collections: no pair of copies is written out.  Pages without sequences give no row.
    """
    members, links = similar_classes(pages, threshold)
    links = materialize(links.select("a", "b"), "links")
    n_links = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    counted_ = join_checked(members, n_links, ["rep"], "left", label="n_links")
    return counted_.select("page_id", F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def similar_pairs(pages: DataFrame, threshold: float = 0.7) -> DataFrame:
    """page_a, page_b: all pairs of page ids at or above the threshold, copies included.

    Null or empty contents and contents of fewer than three words take no part; a page whose row is repeated is one
    page; an empty table gives no row.
    """
    members, links = similar_classes(pages, threshold)
    members = materialize(members, "members")
    links = materialize(links.select("a", "b"), "links")
    left = join_checked(members.select(F.col("page_id").alias("x"), F.col("rep").alias("a")), links, ["a"], label="links")
    right = join_checked(members.select(F.col("page_id").alias("y"), F.col("rep").alias("b")), left, ["b"], label="links")
    across = right.select(F.least("x", "y").alias("page_a"), F.greatest("x", "y").alias("page_b"))
    return across.unionByName(pairs_within(members)).distinct()
