"""Tables of the data model, and checks of their constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _s(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_L, _I, _D, _S = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()
PAGE_RECORD = _s(("url", _S), ("title", _S), ("text", _S), ("source", _S), ("links", T.ArrayType(_S)))
PAGES = _s(("id", _L), ("url", _S), ("title", _S), ("content", _S), ("length", _I), ("source", _S), ("views", _L), ("published_date", _S), ("pagerank", _D))
POSTINGS = _s(("word", _S), ("page_id", _L), ("frequency", _I))
IDF = _s(("word", _S), ("df", _L), ("idf", _D))
LINKS = _s(("from_page", _L), ("to_page", _L))
STATS = _s(("n_docs", _L), ("avgdl", _D), ("n_postings", _L), ("n_terms", _L))
RESULTS = _s(("query_id", _L), ("rank", _I), ("page_id", _L), ("score", _D), ("title", _S), ("url", _S), ("snippet", _S))


def _repeats(df: DataFrame, name: str, *keys: str) -> DataFrame:
    n = df.groupBy(*keys).count().where("count > 1").agg(F.count(F.lit(1)).alias("violations"))
    return n.select(F.lit(name).alias("rule"), "violations")


def _breaks(df: DataFrame, **tests) -> DataFrame:
    """Rows that break each of some rules, from one scan; rules are named by their table, column and test."""
    counts = df.agg(*[F.count_if(F.coalesce(t, F.lit(False))).alias(name) for name, t in tests.items()])
    pairs = F.array(*[F.struct(F.lit(name.replace("__", ".").replace("_not_null", " not null").replace("_least_0", " >= 0").replace("_over_0", " > 0")).alias("rule"), F.col(name).alias("violations")) for name in tests])
    return counts.select(F.explode(pairs).alias("_v")).select("_v.*")


def violations(pages: DataFrame, postings: DataFrame | None = None, idf: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """rule, violations: how many rows break each constraint of the model (0 where it holds)."""
    parts = [
        _repeats(pages, "pages.id unique", "id"),
        _repeats(pages, "pages.url unique", "url"),
        _breaks(pages, pages__url_not_null=F.col("url").isNull(), pages__length_least_0=F.col("length") < 0, pages__views_least_0=F.col("views") < 0, pages__pagerank_least_0=F.col("pagerank") < 0),
    ]
    ids = pages.select(F.col("id").alias("_id")).distinct()
    if postings is not None:
        parts += [
            _repeats(postings, "postings (word, page_id) unique", "word", "page_id"),
            _breaks(postings, postings__frequency_over_0=F.col("frequency") <= 0),
            postings.join(ids, postings["page_id"] == ids["_id"], "left_anti").agg(F.count(F.lit(1)).alias("violations")).select(F.lit("postings.page_id in pages").alias("rule"), "violations"),
        ]
    if idf is not None:
        parts.append(_repeats(idf, "idf.word unique", "word"))
    if links is not None:
        parts.append(_repeats(links, "links (from_page, to_page) unique", "from_page", "to_page"))
        for c in ("from_page", "to_page"):
            parts.append(links.join(ids, links[c] == ids["_id"], "left_anti").agg(F.count(F.lit(1)).alias("violations")).select(F.lit(f"links.{c} in pages").alias("rule"), "violations"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validate(pages: DataFrame, **tables: DataFrame) -> None:
    """Raise ``ValueError`` if a constraint is broken, naming the rules and some repeated URLs."""
    broken = [r for r in violations(pages, **tables).collect() if r["violations"]]
    if broken:
        urls = [r["url"] for r in pages.groupBy("url").count().where("count > 1").orderBy("url").limit(5).collect()]
        raise ValueError("broken constraints: " + "; ".join(f"{r['rule']}: {r['violations']}" for r in broken) + (f"; repeated URLs such as {urls}" if urls else ""))
