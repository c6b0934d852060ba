"""Lines repeated over the documents of one source: blocks of a graph of consecutive lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.plans.runtime import join_checked, materialize, source_name

#: Sources whose frequent lines may be broadcast: a source has at most (mean lines a page) / min_share of them.
BROADCAST_SOURCES = 20_000


def _lines(content: Column) -> Column:
    """Array of (line_no, key) of the lines that count: letters only, lower case, at least four words."""
    letters = F.split(F.regexp_replace(F.lower(content), "[^a-z\n]+", " "), "\n")
    every = F.transform(letters, lambda x, i: F.struct((i + 1).alias("line_no"), F.trim(x).alias("key")))
    return F.filter(every, lambda x: F.length(x["key"]) - F.length(F.translate(x["key"], " ", "")) >= 3)


def line_table(pages: DataFrame) -> DataFrame:
    """page_id, source, line_no, node, next: the lines that count; ``node`` is the hash of a line's letters, ``next`` the node of the line that follows."""
    rows = pages.where("id is not null and content <> ''").select(F.col("id").alias("page_id"), source_name(F.col("source")).alias("source"), _lines(F.col("content")).alias("_l"))
    rows = rows.select("page_id", "source", F.transform("_l", lambda x: F.struct(x["line_no"].alias("no"), F.xxhash64(x["key"]).alias("node"))).alias("_n"))
    after = F.concat(F.slice(F.col("_n.node"), F.lit(2), F.greatest(F.size("_n"), F.lit(1))), F.array(F.lit(None).cast("long")))
    # Outer, because for the inner one the optimizer works the whole array out once more in a filter, to drop pages without lines.
    each = F.explode_outer(F.arrays_zip(F.col("_n.no").alias("no"), F.col("_n.node").alias("node"), after.alias("next")))
    lines = rows.select("page_id", "source", each.alias("_l")).where("_l is not null")
    return lines.select("page_id", "source", F.col("_l.no").alias("line_no"), F.col("_l.node").alias("node"), F.col("_l.next").alias("next"))


def repeated_nodes(lines: DataFrame, pages: DataFrame, min_pages: int = 8, min_share: float = 0.05) -> DataFrame:
    """source, node, n_pages: the high-support nodes of each source's graph of lines.

    Support is the number of distinct pages.  Counted from (source, line, page) hashes, never from a
    source's rows in one task, and whole texts are not moved.
    """
    nodes = lines.select("source", "node", "page_id").distinct().groupBy("source", "node").agg(F.count(F.lit(1)).alias("n_pages"))
    sizes = pages.where("id is not null and content <> ''").select(source_name(F.col("source")).alias("source"), "id").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("size"))
    frequent = join_checked(nodes.where(F.col("n_pages") >= min_pages), sizes, ["source"], label="sources")
    return frequent.where(F.col("n_pages") >= min_share * F.col("size")).select("source", "node", "n_pages")


def occurrences(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """page_id, source, line_no, node, next of every occurrence of a high-support node; repeated rows of a page count once.

    The frequent nodes of a source are few, however large it is, so each row looks its own up in its source's list.
    ``next`` is null where the following line isn't frequent.
    """
    known = join_checked(lines, nodes.groupBy("source").agg(F.collect_set("node").alias("bad")), ["source"], rows=BROADCAST_SOURCES, label="nodes")
    frequent = known.where(F.array_contains("bad", F.col("node")))
    return frequent.withColumn("next", F.when(F.array_contains("bad", F.col("next")), F.col("next"))).drop("bad").distinct()


def _components(pdf: pd.DataFrame) -> pd.DataFrame:
    """Blocks of one source: union-find over its frequent nodes (edges come with both ends; lone nodes with themselves)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    nodes = sorted(parent)
    return pd.DataFrame({"source": [pdf["source"].iloc[0]] * len(nodes), "node": nodes, "block": [find(x) for x in nodes]})


def repeated_blocks(found: DataFrame, nodes: DataFrame, min_pages: int = 8) -> DataFrame:
    """source, node, block: connected components of the graph of consecutive lines, over nodes and edges of high support.

    An edge weighs as many pages as have its two lines one after the other.  ``nodes`` bounds what one group can hold: a
    source has at most (mean lines a page / min_share) frequent nodes, and edges are kept only between those and from
    ``min_pages`` pages on.  A frequent line without such an edge is a block of its own.
    """
    pairs = found.where("next is not null").select("source", F.col("node").alias("a"), F.col("next").alias("b"), "page_id").distinct()
    edges = pairs.groupBy("source", "a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    both = edges.select("source", "a", "b").unionByName(nodes.select("source", F.col("node").alias("a"), F.col("node").alias("b")))
    return both.groupBy("source").applyInPandas(_components, "source string, node long, block long")


def _graph(pages: DataFrame, min_pages: int, min_share: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(occurrences, nodes, blocks) of the pages' lines; texts are read once."""
    lines = materialize(line_table(pages), "lines")
    nodes = materialize(repeated_nodes(lines, pages, min_pages, min_share), "nodes")
    found = materialize(occurrences(lines, nodes), "occurrences")
    return found, nodes, materialize(repeated_blocks(found, nodes, min_pages), "blocks")


def find_repeated(pages: DataFrame, min_pages: int = 8, min_share: float = 0.05) -> DataFrame:
    """page_id, line_no of every repeated line: the occurrences of the lines of all boilerplate blocks.

    A null source is ``other``; pages without id or content give nothing; lines of fewer than four words of letters
    don't count; a line twice on a page is one page of support and two occurrences; an empty table gives no row.
    """
    found, _, blocks = _graph(pages, min_pages, min_share)
    return join_checked(found, blocks, ["source", "node"], label="blocks").select("page_id", "line_no").distinct()


def block_report(pages: DataFrame, min_pages: int = 8, min_share: float = 0.05) -> DataFrame:
    """source, block, n_lines, n_pages: the boilerplate blocks of each source and the support of their strongest line."""
    _, nodes, blocks = _graph(pages, min_pages, min_share)
    return blocks.join(nodes, ["source", "node"]).groupBy("source", "block").agg(F.count(F.lit(1)).alias("n_lines"), F.max("n_pages").alias("n_pages"))


def clean_content(pages: DataFrame, min_pages: int = 8, min_share: float = 0.05) -> DataFrame:
    """page_id, content: each page with content, without the lines of its source's boilerplate blocks (texts stay where they are read)."""
    _, _, blocks = _graph(pages, min_pages, min_share)
    rows = pages.where("id is not null and content <> ''").select(F.col("id").alias("page_id"), source_name(F.col("source")).alias("source"), "content")
    marked = join_checked(rows, blocks.groupBy("source").agg(F.collect_set("node").alias("bad")), ["source"], "left", rows=BROADCAST_SOURCES, label="blocks")
    kept = F.filter(
        F.split("content", "\n"),
        lambda x: ~F.coalesce(F.array_contains("bad", F.xxhash64(F.trim(F.regexp_replace(F.lower(x), "[^a-z]+", " ")))), F.lit(False)),
    )
    return marked.select("page_id", F.array_join(kept, "\n").alias("content")).distinct()
