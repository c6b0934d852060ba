"""Scalar functions against plain Python."""

import re
import zlib
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.functions import urls as U
from spindrift.plans.engine import page_items

TEXTS = ["C++ & Ünicode_42 What", "", None, "  A-b  C! ", "İstanbul K 9", "the and of", "a\x1cb　c\x85d  e\nf", "x" * 5000]


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def run(spark, values, f):
    return [r[0] for r in column(spark, values).select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_tokenize(spark):
    expected = [[w for w in re.findall("[a-z0-9]+", (t or "").lower()) if w not in T.STOP_WORDS] for t in TEXTS]
    assert run(spark, TEXTS, T.tokenize) == expected
    assert expected[0] == ["c", "nicode", "42"]
    assert len(T.STOP_WORDS) == 153


def test_query_tokens_fall_back_to_stop_words(spark):
    assert run(spark, ["What is Database", "who is", "  "], T.tokenize_query) == [["database"], ["who", "is"], []]


def test_normalize_and_sets(spark):
    assert run(spark, ["  A-b  C! ", "", None], T.normalize_text) == ["a b c", "", ""]
    assert run(spark, ["a b a", ""], T.word_set) == [["a", "b"], []]


def test_length_and_strip_use_unicode_space(spark):
    assert run(spark, TEXTS, T.doc_length) == [len((t or "").split()) for t in TEXTS]
    values = ["  x \x1f", "　", "a b"]
    assert run(spark, values, T.strip_ws) == [v.strip() for v in values]


def python_snippet(content, words, length=200):
    if not content:
        return ""
    best, most = "", 0
    for s in re.split(r"(?<=[.!?]) +", content):
        n = sum(w in s.lower() for w in words)
        if n > most:
            best, most = s, n
    return best.strip() if most else content[:length].strip() + ("..." if len(content) > length else "")


@pytest.mark.parametrize("words", [["zz"], ["b", "b", "d"], []])
def test_snippet(spark, words):
    texts = ["A b.  C d! e? f", "x" * 201, "x" * 200, "", "One b\nd. Two.  \nThree d d.", "A database is here. Database systems! It"]
    got = run(spark, texts, lambda c: T.snippet(c, F.array(*[F.lit(w) for w in words]).cast("array<string>")))
    assert got == [python_snippet(t, words) for t in texts]


def test_shard_is_crc32(spark):
    words = ["database", "über", ""]
    assert run(spark, words, lambda c: T.term_shard(c, 256)) == [zlib.crc32(w.encode()) % 256 for w in words]
    assert zlib.crc32(b"database") % 256 == 46


def test_highlight_escapes_first(spark):
    assert run(spark, ["a <b> A+b"], lambda c: T.highlight(c, ["a+b", "a"])) == ["<mark>a</mark> &lt;b&gt; <m<mark>a</mark>rk><mark>A</mark>+b</m<mark>a</mark>rk>"]


URLS = [
    "https://www.www.x.com/a;b/?q", "HTTP://WWW.Ex.com:80/A//", "https://u:p@www.h.com/a;p=1", "http://e.com", "ftp://e.com/x", "https://host/x", "/rel/path#f",
    "https://e.com/a b|c?x#y", "https://my_host.org/A/B/", "", "mailto:x@y.z",
]


def python_canonical(url, every):
    p = urlparse(url)
    host = p.netloc.lower()
    host = host.replace("www.", "") if every else host.removeprefix("www.")
    return p._replace(scheme=p.scheme.lower(), netloc=host, path=p.path.rstrip("/"), params="", query="", fragment="").geturl()


def test_canonical_urls(spark):
    assert run(spark, URLS, U.canonical_url) == [python_canonical(u, False) for u in URLS]
    assert run(spark, URLS, U.crawl_url) == [python_canonical(u, True) for u in URLS]
    assert run(spark, ["https://www.www.x.com/a"], U.crawl_url) == ["https://x.com/a"]


def test_url_filters(spark):
    cases = ["https://en.wikipedia.org/wiki/X", "https://de.wikipedia.org/wiki/X", "https://notnasa.gov/", "https://example.org/", "https://threads.nasa.gov/stage", "https://animenewsnetwork.com/a"]
    assert run(spark, cases, U.is_allowed) == [True, False, True, False, True, True]
    assert run(spark, cases, U.has_bad_pattern) == [False, False, False, False, True, True]
    assert run(spark, ["https://a.b/x", "https://ab/x", "ftp://a.b", None], U.is_valid_url) == [True, False, False, False]
    assert run(spark, ["https://design.com/a/b/c", "https://design.com/a/b/c/d"], U.is_too_deep) == [False, True]
    assert run(spark, ["a#x", "mailto:a", "javascript:x", "/ok"], U.is_followable_href) == [False, False, False, True]
    assert run(spark, ["https://x.org/Talk:A", "https://x.org/talk:A"], U.has_banned_marker) == [True, False]
    assert run(spark, ["https://en.wikipedia.org/x", "https://stackoverflow.com/q", "https://x.y/"], U.detect_source) == ["wikipedia", "qa", "other"]
    assert run(spark, ["https://geeksforgeeks.org/x", "https://developer.mozilla.org/"], lambda c: U.detect_source(c, U.LEGACY_SOURCE_MARKERS)) == ["gfg", "mdn"]
    assert run(spark, ["https://a.medlineplus.gov.x/", "https://x.y/"], U.is_allowed_legacy) == [True, False]
    assert run(spark, ["https://x/y#a?b", "https://x/y?b#c"], U.strip_fragment_query) == ["https://x/y", "https://x/y"]
    assert run(spark, ["https://x/A_(b)", "https://x/A"], U.is_legacy_link) == [False, True]


def test_page_items():
    show = lambda c, t: " ".join("…" if x is None else str(x) for x in page_items(c, t))
    assert show(1, 7) == "1 2 3 4 5 6 7"
    assert show(1, 20) == "1 2 3 4 … 20"
    assert show(10, 20) == "1 … 9 10 11 … 20"
    assert show(20, 20) == "1 … 17 18 19 20"
    assert T.cache_key("  What   IS x ") == "what is x"


def test_display_host(spark):
    cases = {"https://www.Example.org:80/a": "example.org", "http://u@m.example.org": "m.example.org", "no url": None, "": None, None: None}
    got = spark.createDataFrame([(k,) for k in cases], "u string").select("u", U.display_host(F.col("u")).alias("h")).collect()
    assert {r["u"]: r["h"] for r in got} == cases
