"""Column functions over URLs: canonical forms, sources and crawl filters."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)"

# Markers of pages that are never shown, links that are never followed, and hosts that may be crawled.
BANNED_MARKERS = ("Talk:", "File:", "Help:", "Category:")
BAD_PATTERNS = tuple(
    """privacy terms login signup account policy cdn-cgi profile comment tag author video gallery share print download
    register advert ads ?utm_ &utm_ episode season watch review trailer characters cast staff forum user topic news""".split()
)
ALLOWED_DOMAINS = tuple(
    """wikipedia.org developer.mozilla.org docs.python.org nodejs.org rust-lang.org nextjs.org react.dev freecodecamp.org
    w3schools.com geeksforgeeks.org programiz.com tutorialspoint.com cs50.harvard.edu khanacademy.org
    nationalgeographic.com sciencedaily.com livescience.com britannica.com nasa.gov esa.int scientificamerican.com
    ocw.mit.edu medlineplus.gov cdc.gov who.int genome.gov ncbi.nlm.nih.gov nature.com science.org openstax.org ck12.org
    pll.harvard.edu theverge.com investopedia.com stackoverflow.com myanimelist.net animenewsnetwork.com ign.com
    gamespot.com""".split()
)
LEGACY_DOMAINS = ("wikipedia.org", "geeksforgeeks.org", "developer.mozilla.org", "medlineplus.gov")
LEGACY_LINK_MARKERS = ("(", ")", "File:", "Category:", "Help:", "Special:", "Talk:")
SOURCE_MARKERS = (
    ("wikipedia", "wikipedia"), ("developer.mozilla", "mdn"), ("docs.python", "docs"), ("stackoverflow", "qa"), ("investopedia", "finance"),
    ("theverge", "news"), ("nasa", "science"), ("medlineplus", "health"), ("britannica", "encyclopedia"),
)
LEGACY_SOURCE_MARKERS = (("wikipedia.org", "wikipedia"), ("geeksforgeeks.org", "gfg"), ("developer.mozilla.org", "mdn"), ("medlineplus.gov", "health"))
DEEP_HOSTS = ("myanimelist", "ign", "gamespot")


def _any(tests) -> Column:
    return reduce(or_, tests)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 1))


def netloc(url: Column) -> Column:
    """Authority as written (user and port included), not lower-cased."""
    return F.regexp_extract(url, _URL, 2)


def _path(url: Column) -> Column:
    """Path without parameters of its last segment and without slashes at the end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(url, _URL, 3), ";[^/]*$", ""), "/+$", "")


def _join(url: Column, host: Column) -> Column:
    s = scheme(url)
    return F.concat(F.when(s != "", F.concat(s, F.lit(":"))).otherwise(""), F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""), _path(url))


def canonical_url(url: Column) -> Column:
    """Form in which results are compared: scheme and host in lower case, one leading ``www.`` off, no parameters, query, fragment or slash at the end."""
    return _join(url, F.regexp_replace(F.lower(netloc(url)), r"^www\.", ""))


def crawl_url(url: Column) -> Column:
    """Form in which the crawler compares URLs: like ``canonical_url``, but every ``www.`` of the host goes."""
    return _join(url, F.replace(F.lower(netloc(url)), F.lit("www."), F.lit("")))


def strip_fragment_query(url: Column) -> Column:
    """Oldest form: cut at ``#``, then at ``?``."""
    return F.substring_index(F.substring_index(url, "#", 1), "?", 1)


def display_host(url: Column) -> Column:
    """Host as a result card shows it: lower case, without user, port and leading ``www.``; null for what is no URL."""
    host = F.regexp_replace(F.regexp_replace(F.lower(netloc(url)), r"^.*@", ""), r":\d*$", "")
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def detect_source(url: Column, markers=SOURCE_MARKERS) -> Column:
    """Source class of a URL: the first marker that its host contains."""
    host, out = netloc(url), F.lit("other")
    for text, name in reversed(markers):
        out = F.when(F.contains(host, F.lit(text)), name).otherwise(out)
    return out


def is_valid_url(url: Column) -> Column:
    """http or https, and a dot in the host; null is not valid."""
    return F.coalesce(scheme(url).isin("http", "https") & F.contains(netloc(url), F.lit(".")), F.lit(False))


def is_allowed(url: Column, domains=ALLOWED_DOMAINS) -> Column:
    """Host ends with an allowed domain; a Wikipedia host must be the English one."""
    host = netloc(url)
    return F.when(F.contains(host, F.lit("wikipedia.org")), F.contains(host, F.lit("en.wikipedia.org"))).otherwise(_any(F.endswith(host, F.lit(d)) for d in domains))


def is_allowed_legacy(url: Column, domains=LEGACY_DOMAINS) -> Column:
    """Oldest allow list: the host contains a domain."""
    host = netloc(url)
    return F.when(F.contains(host, F.lit("wikipedia.org")), F.contains(host, F.lit("en.wikipedia.org"))).otherwise(_any(F.contains(host, F.lit(d)) for d in domains))


def has_bad_pattern(url: Column, patterns=BAD_PATTERNS) -> Column:
    """One of the patterns stands anywhere in the URL; one scan for all of them."""
    return url.rlike("|".join(re.escape(p) for p in patterns))


def has_banned_marker(url: Column) -> Column:
    return _any(F.contains(url, F.lit(m)) for m in BANNED_MARKERS)


def is_followable_href(href: Column) -> Column:
    return ~(F.contains(href, F.lit("javascript:")) | F.contains(href, F.lit("mailto:")) | F.contains(href, F.lit("#")))


def is_too_deep(url: Column) -> Column:
    """More than five slashes on one of the hosts whose deep pages are of no use."""
    slashes = F.length(url) - F.length(F.translate(url, "/", ""))
    return _any(F.contains(url, F.lit(h)) for h in DEEP_HOSTS) & (slashes > 5)


def is_admissible_link(href: Column, target: Column) -> Column:
    """All tests a discovered link has to pass, in the crawler's order; ``target`` is its resolved ``crawl_url``."""
    return is_followable_href(href) & ~is_too_deep(target) & is_valid_url(target) & ~has_bad_pattern(target) & is_allowed(target)


def is_legacy_link(url: Column) -> Column:
    return ~_any(F.contains(url, F.lit(m)) for m in LEGACY_LINK_MARKERS)
