"""Main content of pages: wrapper induction from the aligned trees of each host's pages.

A page's text is read as a tree: the root holds the lines in order, a line holds its words; a run of lines that hold content
is one node, a slot.  Nodes match by label, which is a line's letters in any script, or the slot's mark.

1. Labels that stand on enough different pages of a host, or of the collection, may be constant nodes (``induce_template``).
2. Pages that have them between them all are folded into one template tree a host (``fold_trees``): each is aligned with the tree
   so far by simple tree matching, and what doesn't match is put into the tree where it stands.
3. Every page is aligned with its host's tree (``align``).  Constant nodes are template; slots are content.

Two exceptions a tree shows: a constant node whose slot is content in nearly all pages is a heading of the content, and a
long constant line that mostly stands inside the content slot is a passage that one page took from another.  A varying node that holds
no sentence of its own and isn't about the page is a slot of the template (teasers, pagers, tag lists, adverts).
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.plans.runtime import join_checked, materialize

#: Characters of a line that counts as a paragraph when a page's subject is looked for.
LONG_LINE = 150
_SPACE = r"\s\x1c-\x1f\x85\p{Z}"
_NO_LETTERS = r"[^\p{L}\p{M}]+"
#: A sentence's end, a list item, a quotation, a line of program code.
_BLANKS = "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_ENDS, _CLOSERS = (".", "!", "。", "！", "।", "؟"), "\"”')]"
_ITEM = rf"^[{_SPACE}]*(?:[-*•+][{_SPACE}]+|\d+[.)][{_SPACE}]+|[\"“>])"
#: Marks without one of which a line isn't code.
_CODE_MARK = r"[(;{}$&|=<]"
_CODE = rf"\w\(|[;{{}}][{_SPACE}]*$|^[{_SPACE}]*\$[{_SPACE}]|[&|]{{2}}|==|=>|</|\w=\w"
#: Marks that part the entries of trails, pagers, tag lists and menus.
_PARTS = rf",|[|»«›‹→·/]|<<|>>|[{_SPACE}](?:>|--|-)[{_SPACE}]"


#: Kinds of a page's nodes, and the label of a slot in a tree.
CONTENT, CONSTANT, HEADING, TITLE, OTHER, BARE = range(6)
SLOT = 0
#: Hosts whose trees may be broadcast (a tree has at most a few hundred nodes); more are joined by a shuffle.
BROADCAST_HOSTS = 5_000


def tree_matching(a: tuple, b: tuple) -> int:
    """Nodes of the largest order-preserving matching of two trees ``(label, children)`` whose roots' labels are equal."""
    if a[0] != b[0]:
        return 0
    m = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1], 1):
        for j, y in enumerate(b[1], 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + tree_matching(x, y))
    return m[-1][-1] + 1


def align(tree: dict[int, list[int]], nodes: list[int]) -> list[tuple[int, int]]:
    """(index in ``nodes``, place in the tree) of a largest order-preserving matching: ``tree_matching`` of two roots over leaves.

    ``tree`` has the places of each label in descending order, so the longest rising run of places is the matching; it is
    found by bisection, in time that grows with the number of possible matches, not with the product of the sizes.
    """
    ends: list[int] = []  # the least last place of a matching of each size
    last: list[int] = []  # its step
    steps: list[tuple[int, int, int]] = []
    for k, label in enumerate(nodes):
        for place in tree.get(label, ()):
            at = bisect.bisect_left(ends, place)
            steps.append((k, place, last[at - 1] if at else -1))
            if at == len(ends):
                ends.append(place)
                last.append(len(steps) - 1)
            else:
                ends[at], last[at] = place, len(steps) - 1
    out = []
    step = last[-1] if last else -1
    while step >= 0:
        k, place, step = steps[step]
        out.append((k, place))
    return out[::-1]


def places_of(tree: list[int]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = defaultdict(list)
    for place in range(len(tree) - 1, -1, -1):
        out[tree[place]].append(place)
    return out


def fold_trees(pages: list[list[int]]) -> list[int]:
    """The template tree of some pages' nodes: all are aligned one after the other, and nodes without a match join the tree in their gap.

    A node that the tree has elsewhere isn't put in again: it has moved, and pages are aligned until no moved node is left.
    """
    tree: list[int] = []
    for nodes in pages:
        have, matched = set(tree), dict(align(places_of(tree), nodes))
        out, at = [], 0
        for k, label in enumerate(nodes):
            if k in matched:
                out += tree[at : matched[k] + 1]
                at = matched[k] + 1
            elif label not in have:
                out.append(label)
                have.add(label)
        tree = out + tree[at:]
    return tree


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without port, ``www.`` and ``m.``; empty if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:www\.|m\.)?([^/:?#]+)", 1), F.lit(""))


def _ends_sentence(text: Column) -> Column:
    """Whether a line ends like a sentence, closing quotes, brackets and white space aside; only its end is looked at."""
    return F.right(F.rtrim(F.rtrim(text, F.lit(_BLANKS)), F.lit(_CLOSERS)), F.lit(1)).isin(*_ENDS)


def _subject(title: Column, content: Column) -> Column:
    """The title's word that is most frequent in the content's long lines, or else in all: what the page is about (null without such a word).

    Long lines come first because menus and tools, which are short, repeat words that a title may also have.
    """
    words = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), _NO_LETTERS, " "), " "), lambda w: F.length(w) >= 4))

    def best(text: Column) -> Column:
        counted = F.transform(words, lambda w: F.struct(((F.length(text) - F.length(F.replace(text, w))) / F.length(w)).alias("n"), w.alias("w")))
        return F.array_max(F.filter(counted, lambda x: x["n"] > 0))["w"]

    return F.coalesce(best(F.col("_long")), best(content))


def page_nodes(pages: DataFrame) -> DataFrame:
    """page_id, host, line_no, label, letters, words, body, slot, about: the nodes of each page's tree (blank lines are none).

    ``letters`` is given for up to four words without marks between parts (what a heading may be); ``label`` is the hash of the line's letters (null if it has none), ``body`` says whether the line is a sentence, list item, quotation or
    code, ``slot`` whether the next node is one; ``about`` whether the line has the page's title or subject and no parts.
    """
    rows = pages.where("id is not null and content <> ''").select(
        F.col("id").alias("page_id"), host_of(F.col("url")).alias("host"), "title", "content", F.lower("content").alias("_low")
    )
    # A row of its own for the long lines: inside the lambda they would be put together for every word.
    rows = rows.withColumn("_long", F.array_join(F.filter(F.split("_low", "\n"), lambda x: F.length(x) >= LONG_LINE), " "))
    rows = rows.withColumn("_subject", _subject(F.col("title"), F.col("_low"))).withColumn("_title", F.trim(F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), _NO_LETTERS, " ")))
    letters = F.split(F.regexp_replace("_low", r"[^\p{L}\p{M}\n]+", " "), "\n")
    rows = rows.select("page_id", "host", "_subject", "_title", F.arrays_zip(F.split("content", "\n").alias("text"), letters.alias("letters")).alias("_lines"))
    # Lambdas use their own element only: a column that they captured would be worked out again for every element.
    nodes = F.filter(
        F.transform("_lines", lambda x, i: F.struct((i + 1).alias("no"), x["text"].alias("text"), F.trim(x["letters"]).alias("letters"))),
        lambda x: x["text"].rlike(rf"[^{_SPACE}]"),
    )
    body = lambda t: _ends_sentence(t) | t.rlike(_ITEM) | (t.rlike(_CODE_MARK) & t.rlike(_CODE))
    rows = rows.withColumn("_nodes", nodes).withColumn("_kinds", F.array_join(F.transform("_nodes", lambda x: F.when(body(x["text"]), "b").otherwise("s")), ""))
    # Outer, because for the inner one the optimizer works the whole array out once more in a filter, to drop pages without lines.
    out = rows.select("page_id", "host", "_subject", "_title", "_kinds", F.posexplode_outer("_nodes").alias("_pos", "_n")).where("_n is not null")
    letters, text = F.col("_n.letters"), F.col("_n.text")
    words = F.length(letters) - F.length(F.translate(letters, " ", "")) + 1
    body_ = F.substring("_kinds", F.col("_pos") + 1, F.lit(1)) == "b"
    about = (letters == F.col("_title")) | F.coalesce(F.contains(F.concat(F.lit(" "), letters, F.lit(" ")), F.concat(F.lit(" "), F.col("_subject"), F.lit(" "))), F.lit(False))
    return out.select(
        "page_id",
        "host",
        F.col("_n.no").alias("line_no"),
        F.when(letters != "", F.xxhash64(letters)).alias("label"),
        F.when((words <= 4) & ~text.rlike(_PARTS), letters).alias("letters"),
        words.alias("words"),
        body_.alias("body"),
        (F.substring("_kinds", F.col("_pos") + 2, F.lit(1)) == "b").alias("slot"),
        F.when(body_, F.lit(False)).otherwise(about & ~text.rlike(_PARTS)).alias("about"),
    )


def copied_pages(nodes: DataFrame, least_own: float = 0.3) -> DataFrame:
    """page_id, copy: the pages whose body is that of other pages, and the group of copies that each belongs to.

    A body line is the page's own if it stands on no other page.  A page of whose body words less than ``least_own`` are in own
    lines is a copy, with or without small changes; the group is named by the least hash of the lines that it shares.
    """
    several = nodes.where("label is not null").select("label", "page_id").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("label", F.lit(True).alias("_met"))
    lines = join_checked(nodes.where("body").select("page_id", "label", "words"), several, ["label"], "left", label="several")
    own = F.sum(F.when(F.col("_met"), 0).otherwise(F.col("words")))
    return lines.groupBy("page_id").agg(own.alias("_own"), F.sum("words").alias("_all"), F.min(F.when(F.col("_met"), F.col("label"))).alias("copy")).where(F.col("_own") < least_own * F.col("_all")).select("page_id", "copy")


def induce_template(
    nodes: DataFrame, copies: DataFrame, host_share: float = 0.02, host_pages: int = 6, all_share: float = 0.004, all_pages: int = 4, slot_share: float = 0.75
) -> DataFrame:
    """label, letters, heading: the nodes that are constant over the pages of a host, or over the collection.

    Support is the number of different bodies: a page counts once however many rows it has and however often a line
    stands on it, and a group of ``copies`` (page_id, copy) counts as one page, so a line that only copies share isn't
    constant.  ``letters`` is only given for headings: constant nodes of at most four words that have content in their slot in
    at least ``slot_share`` of their places.  A host has at most (mean nodes a page / host_share) constant nodes.
    """
    bodies = join_checked(nodes.select("page_id", "host").distinct(), copies, ["page_id"], "left", label="copies")
    bodies = materialize(bodies.select("page_id", "host", F.coalesce("copy", F.xxhash64("page_id", F.lit("page"))).alias("_body")), "bodies")
    sized = bodies.groupBy("host").agg(F.count_distinct("_body").alias("host_n"))
    total = bodies.agg(F.count_distinct("_body").alias("_all"))
    places = nodes.where("label is not null").groupBy("label", "host", "page_id").agg(F.avg(F.col("slot").cast("int")).alias("slot"), F.min("letters").alias("letters"))
    # Copies can only lower a label's support: what stands on too few pages is dropped before the pages' bodies are looked up.
    least = places.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min(host_pages, all_pages)).select("label")
    places = join_checked(places, least, ["label"], "left_semi", label="frequent")
    places = join_checked(places, bodies, ["page_id", "host"], label="bodies")
    places = materialize(places.groupBy("label", "host", "_body").agg(F.avg("slot").alias("slot"), F.min("letters").alias("letters")), "places")
    by_host = join_checked(places.groupBy("label", "host").agg(F.count(F.lit(1)).alias("n")), sized, ["host"], label="hosts")
    constant = by_host.where((F.col("n") >= host_pages) & (F.col("n") >= host_share * F.col("host_n"))).select("label").distinct().withColumn("there", F.lit(True))
    labels = places.groupBy("label").agg(F.count_distinct("_body").alias("n"), F.avg("slot").alias("slot"), F.min("letters").alias("letters"))
    kept = labels.join(constant, "label", "left").crossJoin(F.broadcast(total)).where("there or n >= {} and n >= {} * _all".format(all_pages, all_share))
    heading = F.col("letters").isNotNull() & (F.col("letters") != "") & (F.col("slot") >= slot_share)
    return kept.select("label", heading.alias("heading"), F.when(heading, F.col("letters")).alias("letters"), (F.col("n") >= all_share * F.col("_all")).alias("wide"))


def skeletons(nodes: DataFrame, template: DataFrame) -> DataFrame:
    """page_id, host, nos, labels, kinds, words: each page's nodes in order, as arrays.

    Kinds: a constant node that is a HEADING or not (CONSTANT), a CONTENT line, a line that is about the page or a misspelt
    heading (TITLE), a line without letters (BARE), any OTHER.
    """
    # Headings that are constant over the whole collection: at most (mean nodes a page / all_share) short strings.
    headings = [r["letters"] for r in template.where("heading and wide").select("letters").collect()]
    if headings:
        known = F.array(*[F.lit(h) for h in sorted(headings)])
        misspelt = F.exists(known, lambda h: F.levenshtein(F.col("letters"), h, 2) >= 0)
    else:
        misspelt = F.lit(False)
    marked = join_checked(nodes, template.select("label", "heading"), ["label"], "left", label="template")
    near_heading = (F.length("letters") >= 4) & (F.col("words") <= 4) & misspelt
    kind = (
        F.when(F.col("heading"), HEADING).when(~F.col("heading"), CONSTANT).when(F.col("body"), CONTENT)
        .when(F.col("label").isNull(), BARE).when(F.col("about") | near_heading, TITLE).otherwise(OTHER)
    )
    lines = F.sort_array(F.collect_set(F.struct("line_no", F.coalesce("label", F.lit(SLOT)).alias("label"), kind.cast("int").alias("kind"), F.col("body").cast("int").alias("body"), "words")))
    pages = marked.groupBy("page_id", "host").agg(lines.alias("_l"))
    return pages.select("page_id", "host", *[F.col(f"_l.{c}").alias(n) for c, n in (("line_no", "nos"), ("label", "labels"), ("kind", "kinds"), ("body", "bodies"), ("words", "words"))])


def _inside(kinds: list[int]) -> tuple[int, int]:
    """Places of the first and the last content line (behind each other if there is none)."""
    body = [k for k, x in enumerate(kinds) if x == CONTENT]
    return (body[0], body[-1]) if body else (len(kinds), -1)


def _taken_lines(least_words: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for host, labels, kinds, bodies, words in zip(pdf["host"], pdf["labels"], pdf["kinds"], pdf["bodies"], pdf["words"]):
                long_ = np.flatnonzero((kinds == CONSTANT) & (bodies == 1) & (words >= least_words))
                if len(long_):
                    first, last = _inside(kinds.tolist())
                    out += [(host, int(labels[k]), 1, int(first < k < last)) for k in long_]
            if out:
                yield pd.DataFrame(out, columns=["host", "label", "n", "inside"]).groupby(["host", "label"], as_index=False).sum()

    return run


def taken_passages(pages: DataFrame, least_words: int = 10, share: float = 0.5) -> DataFrame:
    """host, label of the constant sentences of at least ``least_words`` words that stand inside the content in more than ``share`` of their places."""
    found = pages.mapInPandas(_taken_lines(least_words), "host string, label long, n long, inside long")
    return found.groupBy("host", "label").agg(F.sum("n").alias("n"), F.sum("inside").alias("inside")).where(F.col("inside") > share * F.col("n")).select("host", "label")


def tree_nodes(labels, kinds, taken=frozenset()) -> tuple[list[int], list[int]]:
    """The nodes of a page that are aligned, and the index of each: its constant lines, and one node for each run of content."""
    nodes, index = [], []
    for k, (label, kind) in enumerate(zip(labels, kinds)):
        if kind == CONSTANT and label not in taken:
            nodes.append(label)
            index.append(k)
        elif kind in (CONTENT, HEADING, CONSTANT) and (not nodes or nodes[-1] != SLOT):
            nodes.append(SLOT)
            index.append(k)
    return nodes, index


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    taken = set(pdf["taken"].iloc[0])
    rows = pdf.sort_values("page_id")
    tree = fold_trees([tree_nodes(a.tolist(), b.tolist(), taken)[0] for a, b in zip(rows["labels"], rows["kinds"])])
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "tree": [tree], "taken": [sorted(taken)]})


def template_trees(pages: DataFrame, taken: DataFrame) -> DataFrame:
    """host, tree, taken: the template tree of each host (labels in order), and its ``taken`` labels.

    For each constant label of a host the page with the least hash that has it is folded in, so every label is in the tree, and
    what a task holds is bounded by a host's labels: (mean nodes a page / host_share).
    """
    each = pages.select("page_id", "host", F.explode(F.arrays_zip("labels", "kinds")).alias("_n")).where(F.col("_n.kinds") == CONSTANT)
    chosen = each.groupBy("host", F.col("_n.labels").alias("label")).agg(F.min_by("page_id", F.xxhash64("page_id")).alias("page_id")).select("page_id").distinct()
    rows = join_checked(pages.select("page_id", "host", "labels", "kinds"), chosen, ["page_id"], "left_semi", label="chosen")
    lists = taken.groupBy("host").agg(F.collect_set("label").alias("taken"))
    rows = join_checked(rows, lists, ["host"], "left", label="taken").withColumn("taken", F.coalesce("taken", F.array().cast("array<long>")))
    return rows.groupBy("host").applyInPandas(_fold, "host string, tree array<long>, taken array<long>")


def page_furniture(nos: list[int], labels: list[int], kinds: list[int], tree: dict[int, list[int]], taken: frozenset) -> list[int]:
    """Numbers of the lines of one page that aren't its article's.

    The page's tree is aligned with its host's template tree; what was left is aligned again, until nothing matches: such nodes
    have moved.  A line about the page, or a misspelt heading, belongs to the article as long as content follows; behind it, it is an
    entry of a list of pages.  A line without letters belongs to the article inside it only.
    """
    nodes, index = tree_nodes(labels, kinds, taken)
    template: set[int] = set()
    while True:
        matched = {k for k, _ in align(tree, nodes)}
        if not matched:
            break
        template |= {index[k] for k in matched if nodes[k] != SLOT}
        rest = [k for k in range(len(nodes)) if k not in matched and nodes[k] != SLOT]
        nodes, index = [nodes[k] for k in rest], [index[k] for k in rest]
    kinds = [CONTENT if x == CONSTANT and label in taken else x for x, label in zip(kinds, labels)]
    first, last = _inside(kinds)
    out = []
    for k, kind in enumerate(kinds):
        if k in template or kind == OTHER or (kind == TITLE and k > last) or (kind == BARE and not first < k < last):
            out.append(nos[k])
    return out


def _furniture(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    trees: dict[str, tuple] = {}
    for pdf in parts:
        ids, lines = [], []
        for page, host, nos, labels, kinds, tree, taken in zip(pdf["page_id"].tolist(), pdf["host"], pdf["nos"], pdf["labels"], pdf["kinds"], pdf["tree"], pdf["taken"]):
            if host not in trees:
                if len(trees) >= 1_000:
                    trees.clear()
                trees[host] = (places_of(tree.tolist()), frozenset(taken.tolist())) if tree is not None else ({}, frozenset())
            found = page_furniture(nos.tolist(), labels.tolist(), kinds.tolist(), *trees[host])
            ids += [page] * len(found)
            lines += found
        yield pd.DataFrame({"page_id": np.array(ids, np.int64), "line_no": np.array(lines, np.int32)})


def furniture_lines(pages: DataFrame, **thresholds) -> DataFrame:
    """page_id, line_no of every non-blank line that isn't part of the page's article.

    A page without url belongs to a host of its own kind (the empty one); one without title has no subject; null or
    empty content gives no row; repeated rows of a page count once; very long lines are sentences like any other; lines are
    compared by their letters in any script, and lines without letters are never constant.
    """
    nodes = materialize(page_nodes(pages), "nodes")
    copies = materialize(copied_pages(nodes), "copies")
    template = materialize(induce_template(nodes, copies, **thresholds), "template")
    trees = materialize(skeletons(nodes, template), "skeletons")
    induced = template_trees(trees, materialize(taken_passages(trees), "taken"))
    known = join_checked(trees.select("page_id", "host", "nos", "labels", "kinds"), induced, ["host"], "left", rows=BROADCAST_HOSTS, label="trees")
    return known.mapInPandas(_furniture, "page_id long, line_no int").distinct()


def main_content(pages: DataFrame, **thresholds) -> DataFrame:
    """page_id, content: the article's own lines of each page with content, in order (blank lines are dropped)."""
    rows = pages.where("id is not null and content <> ''").groupBy("id").agg(F.min("content").alias("content")).withColumnRenamed("id", "page_id")
    out = furniture_lines(pages, **thresholds).groupBy("page_id").agg(F.collect_set("line_no").alias("_out"))
    kept = F.filter(F.split("content", "\n"), lambda x, i: x.rlike(rf"[^{_SPACE}]") & ~F.coalesce(F.array_contains("_out", (i + 1).cast("int")), F.lit(False)))
    return rows.join(out, "page_id", "left").select("page_id", F.array_join(kept, "\n").alias("content"))
