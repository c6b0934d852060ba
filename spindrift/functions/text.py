"""Column functions over text.  All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as Python's ``str.isspace`` has it, as a Java character class.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"

# The words that index and queries leave out.
STOP_WORDS = tuple(
    """
    a about above after again against ain all am an and any are aren as at be because been before being below
    between both but by can couldn d did didn do does doesn doing don down during each few for from further had hadn has
    hasn have haven having he her here hers herself him himself his how i if in into is isn it its itself just ll m ma me
    mightn more most mustn my myself needn no nor not now o of off on once only or other our ours ourselves out over own
    re s same shan she should shouldn so some such t than that the their theirs them themselves then there these they this
    those through to too under until up ve very was wasn we were weren what when where which while who whom why will with
    won wouldn y you your yours yourself yourselves
    """.split()
)


def strip_ws(c: Column) -> Column:
    """``str.strip()``: trims white space of any kind, no-break spaces included."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def fold_word(c: Column) -> Column:
    """The form in which words of the index are compared: lower case, trimmed."""
    return strip_ws(F.lower(c))


def raw_tokens(c: Column) -> Column:
    """Maximal runs of ``[a-z0-9]`` of the lower-cased text, in order; null counts as empty."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def _not_stop(tokens: Column, stop: tuple[str, ...]) -> Column:
    words = F.array(*[F.lit(w) for w in stop])
    return F.filter(tokens, lambda t: ~F.array_contains(words, t))


def tokenize(c: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Index-side tokens: ``raw_tokens`` without stop words."""
    return _not_stop(raw_tokens(c), stop)


def tokenize_query(c: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Query-side tokens: like ``tokenize``, but a query of stop words only keeps its words."""
    raw = raw_tokens(c)
    kept = _not_stop(raw, stop)
    return F.when(F.size(kept) > 0, kept).otherwise(raw)


def normalize_text(c: Column) -> Column:
    """Lower case, every run outside ``[a-z0-9]`` one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def word_set(clean: Column) -> Column:
    """Distinct words of a normalised text (an empty array for an empty text)."""
    return F.filter(F.array_distinct(F.split(clean, " ")), lambda w: w != "")


def doc_length(c: Column) -> Column:
    """Number of white-space separated pieces of the raw text, stop words included."""
    pieces = F.split(F.coalesce(c, F.lit("")), f"{WS}+")
    return F.size(F.filter(pieces, lambda t: t != ""))


def sentences(c: Column) -> Column:
    """Pieces between ``. ! ?`` followed by spaces (line feeds don't separate)."""
    return F.split(c, "(?<=[.!?]) +")


def snippet(content: Column, words: Column, length: int = 200) -> Column:
    """First sentence with the most query words in it (substring hits, repeated words count again).

    The sentence is returned whole and trimmed.  Without any hit the text's first ``length`` characters
    are, with ``...`` behind them if the text is longer.  Empty or null text gives ``""``.
    """
    text = F.coalesce(content, F.lit(""))
    scored = F.transform(
        sentences(text),
        lambda s: F.struct(
            s.alias("s"),
            F.size(F.filter(words, lambda w: F.contains(F.lower(s), w))).alias("n"),
        ),
    )
    best = F.aggregate(
        scored,
        F.struct(F.lit("").alias("s"), F.lit(0).alias("n")),
        lambda acc, x: F.when(x["n"] > acc["n"], x).otherwise(acc),
    )
    head = strip_ws(F.substring(text, 1, length))
    fallback = F.when(F.length(text) > length, F.concat(head, F.lit("..."))).otherwise(head)
    return F.when(text == "", F.lit("")).when(best["n"] > 0, strip_ws(best["s"])).otherwise(fallback)


def term_shard(c: Column, shards: int) -> Column:
    """Shard of a term: CRC-32 of its UTF-8 bytes modulo the number of shards."""
    return F.pmod(F.crc32(c.cast("binary")), F.lit(shards)).cast("int")


def highlight(text: Column, terms: list[str]) -> Column:
    """HTML-escapes the text, then marks every query term, one after the other and in any case."""
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    for t in terms:
        if t:
            out = F.regexp_replace(out, F.lit("(?i)(" + "".join("\\" + ch if not ch.isalnum() and ch.isascii() else ch for ch in t) + ")"), F.lit("<mark>$1</mark>"))
    return out


def cache_key(query: str) -> str:
    """Lower case with single spaces, as the result cache compares queries."""
    return " ".join(query.lower().split())
