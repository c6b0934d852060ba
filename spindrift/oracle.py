"""SQL equivalents of the core queries, for an independent engine on the same tables."""

from __future__ import annotations

from spindrift.queries import SEARCHES

# Fixed values, written out here so that the SQL doesn't lean on the library's own.
STOP_WORDS = tuple(
    """
    a about above after again against ain all am an and any are aren as at be because been before being below between
    both but by can couldn d did didn do does doesn doing don down during each few for from further had hadn has hasn
    have haven having he her here hers herself him himself his how i if in into is isn it its itself just ll m ma me
    mightn more most mustn my myself needn no nor not now o of off on once only or other our ours ourselves out over
    own re s same shan she should shouldn so some such t than that the their theirs them themselves then there these
    they this those through to too under until up ve very was wasn we were weren what when where which while who whom
    why will with won wouldn y you your yours yourself yourselves
    """.split()
)
SOURCE_WEIGHTS = {
    "wikipedia": 1.0, "encyclopedia": 0.95, "science": 0.95, "health": 0.95, "mdn": 0.9, "docs": 0.9, "gfg": 0.85,
    "qa": 0.8, "finance": 0.75, "news": 0.65, "medium": 0.6, "other": 0.5,
}
FACTORS = (
    "f_source", "f_what_wiki", "f_what_qa", "f_title_miss", "f_preferred", "f_other", "f_authority", "f_title_match",
    "f_phrase", "f_coverage", "f_url",
)
SOURCE_MARKERS = (
    ("wikipedia", "wikipedia"), ("developer.mozilla", "mdn"), ("docs.python", "docs"), ("stackoverflow", "qa"),
    ("investopedia", "finance"), ("theverge", "news"), ("nasa", "science"), ("medlineplus", "health"), ("britannica",
    "encyclopedia"),
)
BAD_PATTERNS = (
    "privacy", "terms", "login", "signup", "account", "policy", "cdn-cgi", "profile", "comment", "tag", "author",
    "video", "gallery", "share", "print", "download", "register", "advert", "ads", "?utm_", "&utm_", "episode",
    "season", "watch", "review", "trailer", "characters", "cast", "staff", "forum", "user", "topic", "news",
)
BANNED_MARKERS = (
    "Talk:", "File:", "Help:", "Category:",
)
DEEP_HOSTS = (
    "myanimelist", "ign", "gamespot",
)
ALLOWED_DOMAINS = (
    "wikipedia.org", "developer.mozilla.org", "docs.python.org", "nodejs.org", "rust-lang.org", "nextjs.org",
    "react.dev", "freecodecamp.org", "w3schools.com", "geeksforgeeks.org", "programiz.com", "tutorialspoint.com",
    "cs50.harvard.edu", "khanacademy.org", "nationalgeographic.com", "sciencedaily.com", "livescience.com",
    "britannica.com", "nasa.gov", "esa.int", "scientificamerican.com", "ocw.mit.edu", "medlineplus.gov", "cdc.gov",
    "who.int", "genome.gov", "ncbi.nlm.nih.gov", "nature.com", "science.org", "openstax.org", "ck12.org",
    "pll.harvard.edu", "theverge.com", "investopedia.com", "stackoverflow.com", "myanimelist.net",
    "animenewsnetwork.com", "ign.com", "gamespot.com",
)

_WS = r"[\s\x1c-\x1f\x{85}\p{Z}]"
_VALID = rf"""valid AS (SELECT word, page_id, arg_max(frequency, indexed_at) AS frequency FROM (
  SELECT regexp_replace(lower(word), '^{_WS}+|{_WS}+$', '', 'g') AS word, page_id, frequency, indexed_at FROM inverted_index
  WHERE frequency > 0 AND page_id IN (SELECT id FROM pages)) WHERE word <> '' GROUP BY word, page_id)"""


def _len(c: str) -> str:
    return f"len(list_filter(string_split_regex({c}, '{_WS}+'), lambda x: x <> ''))"


def _norm(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


def _list(words) -> str:
    return "(" + ", ".join("'" + w + "'" for w in words) + ")"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_STOP = _list(STOP_WORDS)
_STOP_LIST = "[" + _STOP[1:-1] + "]"
_P = rf"""p AS (SELECT DISTINCT id, url, coalesce(title, '') AS title, coalesce(content, '') AS content, {_len("coalesce(content, '')")} AS length,
  coalesce(regexp_replace(lower(source), '^{_WS}+|{_WS}+$', '', 'g'), 'other') AS source, views, coalesce(pagerank, 0.0) AS pagerank FROM pages WHERE id IS NOT NULL)"""
_TF = f"""{_P}, tok AS (SELECT id AS page_id, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) AS word FROM p),
tf AS (SELECT word, page_id, count(*) AS frequency FROM tok WHERE word NOT IN {_STOP} GROUP BY word, page_id)"""
_IDF = f"{_TF}, df AS (SELECT word, count(*) AS df FROM tf GROUP BY word), w AS (SELECT word, df, ln((SELECT count(*) FROM p)::double / (1 + df)) AS idf FROM df)"
_Q = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {_quote(s)})" for k, s in SEARCHES) + ") AS t(query_id, query))"
_A = f"""{_Q}, qr AS (SELECT *, regexp_extract_all(lower(query), '[a-z0-9]+') AS raw FROM q),
qf AS (SELECT *, list_filter(raw, lambda x: NOT list_contains({_STOP_LIST}, x)) AS kept FROM qr),
a AS (SELECT query_id, query, {_norm("query")} AS clean, contains(lower(query), 'what is') AS what_is, NOT contains(lower(query), 'what is') AND contains(lower(query), 'how') AS how,
  CASE WHEN len(kept) > 0 THEN kept ELSE raw END AS words FROM qf),
u AS (SELECT query_id, unnest(words) AS word, unnest(range(len(words))) AS place FROM a),
once AS (SELECT query_id, word, min(place) AS place, count(*) AS n FROM u GROUP BY query_id, word),
t AS (SELECT query_id, word, n, row_number() OVER (PARTITION BY query_id ORDER BY place) - 1 AS pos FROM once)"""
_BM25 = f"""{_IDF}, {_A}, avgdl AS (SELECT avg(length) AS v FROM p),
base AS (SELECT t.query_id, tf.page_id, sum(w.idf * t.n * (tf.frequency * 2.5::double) / (tf.frequency + 0.375::double + 1.125::double / v * p.length)) AS base, min(t.pos) AS first_pos
  FROM t JOIN w USING (word) JOIN tf USING (word) JOIN p ON p.id = tf.page_id, avgdl GROUP BY t.query_id, tf.page_id)"""


def _canonical(www: str) -> str:
    s = r"lower(regexp_extract(url, '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)', 1))"
    h = r"lower(regexp_extract(url, '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)', 2))"
    path = r"regexp_replace(regexp_replace(regexp_extract(url, '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)', 3), ';[^/]*$', ''), '/+$', '')"
    h = f"regexp_replace({h}, '^www\\.', '')" if www == "first" else f"replace({h}, 'www.', '')"
    return f"(CASE WHEN {s} <> '' THEN {s} || ':' ELSE '' END || CASE WHEN {h} <> '' THEN '//' || {h} ELSE '' END || {path})"


_HOST = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"
_WEIGHT = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}::double" for k, v in SOURCE_WEIGHTS.items()) + " ELSE 0.5::double END"
_FEATURES = f"""prep AS (SELECT *, {_canonical("first")} AS clean_url, {_norm("title")} AS title_clean, {_norm("content")} AS content_clean FROM p),
sets AS (SELECT *, string_split(title_clean, ' ') AS tw, string_split(content_clean, ' ') AS cw FROM prep WHERE NOT ({" OR ".join(f"contains(url, '{m}')" for m in BANNED_MARKERS)})),
f AS (SELECT b.query_id, b.page_id, b.base, b.first_pos, s.clean_url, s.title, s.content, a.words, len(list_filter(a.words, lambda x: list_contains(s.tw, x))) AS m, s.source, s.pagerank, s.title_clean, s.content_clean, a.clean, a.what_is, a.how, s.cw
  FROM base b JOIN sets s ON s.id = b.page_id JOIN a ON a.query_id = b.query_id),
g AS (SELECT *, 0.7::double + 0.3::double * {_WEIGHT} AS f_source,
  CASE WHEN what_is AND source = 'wikipedia' THEN 1.5::double ELSE 1 END AS f_what_wiki, CASE WHEN what_is AND source IN ('gfg', 'stackoverflow') THEN 0.8::double ELSE 1 END AS f_what_qa,
  CASE WHEN m = 0 THEN 0.95::double ELSE 1 END AS f_title_miss,
  CASE WHEN (what_is AND source = 'wikipedia') OR (how AND source IN ('gfg', 'stackoverflow')) THEN 1.3::double ELSE 1 END AS f_preferred,
  CASE WHEN source = 'other' THEN 0.7::double ELSE 1 END AS f_other, CASE WHEN pagerank > 0 THEN 1 + 0.15::double * least(pagerank, 1.0) ELSE 1 END AS f_authority,
  CASE WHEN m > 0 THEN 1 + 0.2::double * m ELSE 1 END AS f_title_match,
  CASE WHEN contains(title_clean, clean) THEN 1.5::double WHEN contains(content_clean, clean) THEN 1.2::double ELSE 1 END AS f_phrase,
  CASE WHEN len(list_filter(words, lambda x: NOT list_contains(cw, x))) = 0 THEN 1.2::double ELSE 1 END AS f_coverage,
  CASE WHEN len(list_filter(words, lambda x: contains(clean_url, x))) > 0 THEN 1.1::double ELSE 1 END AS f_url FROM f)"""
_RESULTS = f"""{_BM25}, {_FEATURES}, s AS (SELECT *, base * {" * ".join(FACTORS)} AS score FROM g),
ok AS (SELECT *, row_number() OVER (PARTITION BY query_id, clean_url ORDER BY first_pos, page_id) AS k FROM s WHERE score >= 0.3),
res AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_pos, page_id) AS rank FROM ok WHERE k = 1)"""


def _snippet(content: str, words: str) -> str:
    """The first sentence with most hits: a list of (hits, -place, sentence) is sorted."""
    sentences = f"string_split(regexp_replace({content}, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1))"
    strip = lambda c: f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"
    hits = f"list_transform({sentences}, lambda s: len(list_filter({words}, lambda w: contains(lower(s), w))))"
    best = f"list_max({hits})"
    head = strip(f"substring({content}, 1, 200)")
    return f"CASE WHEN {content} = '' THEN '' WHEN {best} > 0 THEN {strip(f'{sentences}[list_position({hits}, {best})]')} WHEN length({content}) > 200 THEN {head} || '...' ELSE {head} END"


_EDGES = "e AS (SELECT DISTINCT from_page, to_page FROM links WHERE from_page IN (SELECT id FROM pages) AND to_page IN (SELECT id FROM pages))"
_LAST = """l AS (SELECT fetch_id, status, n_bytes, page_id, fetched_at, url FROM (SELECT *, row_number() OVER (PARTITION BY fetch_id
  ORDER BY written_at DESC NULLS LAST, fetched_at DESC NULLS LAST, status DESC NULLS LAST, error DESC NULLS LAST, n_bytes DESC NULLS LAST, page_id DESC NULLS LAST) AS k FROM fetch_log WHERE fetch_id IS NOT NULL) WHERE k = 1)"""


def _ends(host: str, domains) -> str:
    return " OR ".join(f"ends_with({host}, '{x}')" for x in domains)


def _pagerank(steps: int = 100) -> str:
    ctes = [
        "n AS (SELECT DISTINCT id FROM pages WHERE id IS NOT NULL)", "c AS (SELECT count(*)::double AS n FROM n)", _EDGES,
        "d AS (SELECT from_page, count(*) AS deg FROM e GROUP BY from_page)", "x AS (SELECT from_page, to_page, 1.0::double / deg AS w FROM e JOIN d USING (from_page))",
        "r0 AS MATERIALIZED (SELECT id, 1.0::double / n AS r FROM n, c)",
    ]
    for k in range(1, steps + 1):
        o = f"r{k - 1}"
        ctes.append(
            f"r{k} AS MATERIALIZED (SELECT n.id, 0.15::double / c.n + 0.85::double * coalesce(s.v, 0) + 0.85::double * m.v / c.n AS r FROM n CROSS JOIN c "
            f"CROSS JOIN (SELECT coalesce(sum(r), 0) AS v FROM {o} WHERE id NOT IN (SELECT from_page FROM d)) m LEFT JOIN (SELECT to_page, sum(r * w) AS v FROM {o} JOIN x ON x.from_page = {o}.id GROUP BY to_page) s ON s.to_page = n.id)"
        )
    ctes.append("every AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {k} AS k, id, r FROM r{k}" for k in range(steps + 1)) + ")")
    ctes.append(f"stop AS (SELECT coalesce(min(k), {steps}) AS k FROM (SELECT a.k, sum(abs(a.r - b.r)) AS l1 FROM every a JOIN every b ON b.id = a.id AND b.k = a.k - 1 GROUP BY a.k) WHERE l1 <= 1e-8)")
    return "WITH " + ",\n".join(ctes) + "\nSELECT id AS page_id, round(r / max(r) OVER (), 6) AS pagerank FROM every JOIN stop USING (k)"


_DOC_TOKENS = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda x: NOT list_contains({_STOP_LIST}, x))"
_BAD = "|".join(p.replace("?", r"\?") for p in BAD_PATTERNS)

ORACLE: dict[str, str] = {
    "token_counts": f"SELECT doc_id, len({_DOC_TOKENS}) AS n_tokens, len(list_distinct({_DOC_TOKENS})) AS n_terms FROM documents",
    "doc_lengths": f"""SELECT doc_id, {_len("coalesce(text, '')")} AS length FROM documents""",
    "term_frequency": f"WITH {_TF} SELECT word, page_id, frequency FROM tf",
    "posting_lists": f"WITH {_TF} SELECT word, page_id // 256 AS block, string_agg(page_id || ':' || frequency, ',' ORDER BY page_id) AS postings FROM tf GROUP BY ALL",
    "idf_weights": f"WITH {_IDF} SELECT word, df, round(idf, 6) AS idf FROM w",
    "corpus_stats": f"WITH {_P} SELECT count(*) AS n_docs, round(avg(length), 6) AS avgdl FROM p",
    "index_totals": f"WITH {_TF} SELECT count(*) AS n_postings, count(DISTINCT word) AS n_terms, sum(frequency)::BIGINT AS n_tokens FROM tf",
    "posting_lookup": f"WITH {_TF} SELECT * FROM tf WHERE word IN ('enzyme', 'socket', 'zzzzqq')",
    "query_vocabulary": f"WITH {_IDF}, {_A} SELECT query_id, word, word IN (SELECT word FROM w) AS known FROM t",
    "normalized_titles": f"WITH {_P} SELECT id, {_norm('title')} AS title_clean, len(list_filter(list_distinct(string_split({_norm('content')}, ' ')), lambda x: x <> '')) AS n_words FROM p",
    "snippets": f"WITH {_P} SELECT id, {_snippet('content', "['page', 'enzyme', 'lock']")} AS snippet FROM p",
    "query_intents": f"WITH {_A} SELECT a.query_id, a.clean, a.what_is, a.how, coalesce((SELECT string_agg(word, ' ' ORDER BY pos) FROM t WHERE t.query_id = a.query_id), '') AS terms FROM a",
    "bm25_batch": f"WITH {_BM25} SELECT query_id, page_id, round(base, 6) AS base, first_pos FROM base",
    "rank_features": f"""WITH {_P}, {_A}, base AS (SELECT a.query_id, p.id AS page_id, 1.0::double AS base, 0 AS first_pos FROM p, a), {_FEATURES}
SELECT query_id, page_id, {", ".join(f"round({x}, 6) AS {x}" for x in FACTORS)} FROM g""",
    "search_all": f"WITH {_RESULTS} SELECT query_id, page_id, round(score, 6) AS score, clean_url AS url FROM res",
    "search_top10": f"WITH {_RESULTS} SELECT query_id, rank, page_id, round(score, 6) AS score, title, clean_url AS url, {_snippet('content', 'words')} AS snippet FROM res WHERE rank <= 10",
    "search_second_page": f"WITH {_RESULTS} SELECT page_id, round(score, 6) AS score FROM res WHERE query_id = 9 AND rank BETWEEN 11 AND 20",
    "search_totals": f"WITH {_RESULTS} SELECT query_id, count(*) AS total, ceil(count(*) / 10)::BIGINT AS n_pages FROM res GROUP BY query_id",
    "canonical_urls": f"SELECT DISTINCT id, {_canonical('first')} AS canonical, {_canonical('all')} AS crawl, string_split(string_split(url, '#')[1], '?')[1] AS cut FROM pages",
    "url_groups": f"WITH {_P}, c AS (SELECT id, {_canonical('first')} AS url FROM p) SELECT url, count(*) AS n_pages, min(id) AS first_page FROM c GROUP BY url",
    "url_filters": f"""WITH {_P}, h AS (SELECT id, url, {_HOST} AS host FROM p) SELECT id,
CASE {" ".join(f"WHEN contains(host, '{m}') THEN '{s}'" for m, s in SOURCE_MARKERS)} ELSE 'other' END AS source,
coalesce(regexp_matches(lower(url), '^https?:') AND contains(host, '.'), false) AS valid,
CASE WHEN contains(host, 'wikipedia.org') THEN contains(host, 'en.wikipedia.org') ELSE {_ends('host', ALLOWED_DOMAINS)} END AS allowed,
regexp_matches(url, '{_BAD}') AS bad, {" OR ".join(f"contains(url, '{m}')" for m in BANNED_MARKERS)} AS banned,
({" OR ".join(f"contains(url, '{m}')" for m in DEEP_HOSTS)}) AND length(url) - length(replace(url, '/', '')) > 5 AS deep FROM h""",
    "source_counts": f"WITH {_P} SELECT source, count(*) AS n_pages FROM p GROUP BY source",
    "html_extract": rf"""WITH {_P}, s AS (SELECT id, title, list_transform(list_slice(string_split(content, chr(10)), 1, 10), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')) AS ls FROM p)
SELECT id, regexp_replace(title, '^{_WS}+|{_WS}+$', '', 'g') AS title, length(array_to_string(ls, ' ')) AS n_chars FROM s""",
    "link_edges": f"WITH {_EDGES} SELECT * FROM e",
    "out_degrees": f"WITH {_EDGES} SELECT from_page, count(*) AS out_degree FROM e GROUP BY from_page",
    "dangling_pages": f"WITH {_EDGES} SELECT DISTINCT id FROM pages WHERE id IS NOT NULL AND id NOT IN (SELECT from_page FROM e)",
    "pagerank_step": f"""WITH {_EDGES}, n AS (SELECT DISTINCT id FROM pages WHERE id IS NOT NULL), c AS (SELECT count(*)::double AS n FROM n), d AS (SELECT from_page, count(*) AS deg FROM e GROUP BY from_page),
s AS (SELECT to_page AS id, sum(1.0::double / deg) AS v FROM e JOIN d USING (from_page) GROUP BY to_page), m AS (SELECT count(*) AS v FROM n WHERE id NOT IN (SELECT from_page FROM d))
SELECT n.id AS page_id, round(0.15::double / c.n + 0.85::double * coalesce(s.v, 0) / c.n + 0.85::double * m.v / c.n / c.n, 10) AS rank FROM n LEFT JOIN s USING (id), c, m""",
    "pagerank": _pagerank(),
    "domain_cap": f"WITH {_P}, h AS (SELECT url, {_HOST} AS domain, id AS place FROM p) SELECT url, domain, place FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY place) AS k FROM h) WHERE k <= 5",
    "crawl_stats": f"""WITH {_LAST} SELECT count(*) AS fetched, count(*) FILTER (status = 200) AS succeeded, count(*) FILTER (status IS NULL OR status <> 200) AS failed,
count(*) FILTER (status IN (429, 500, 502, 503, 504)) AS worth_retrying, count(*) FILTER (status IS NULL) AS no_status,
coalesce(sum(n_bytes) FILTER (status = 200), 0)::BIGINT AS bytes, count(DISTINCT page_id) FILTER (status = 200) AS pages,
round(count(*) FILTER (status = 200) / ((epoch_us(max(fetched_at)) - epoch_us(min(fetched_at))) / 1e6), 6) AS pages_per_second FROM l""",
    "retry_plan": f"""WITH {_LAST}, a AS (SELECT fetch_id, status, row_number() OVER (PARTITION BY url ORDER BY fetched_at NULLS FIRST, fetch_id) - 1 AS attempt FROM l WHERE url IS NOT NULL),
b AS (SELECT fetch_id, attempt, attempt < 2 AND (status IS NULL OR status IN (429, 500, 502, 503, 504)) AS again FROM a)
SELECT fetch_id, attempt, again, CASE WHEN again THEN 0.5::double * pow(2.0, attempt) END AS delay FROM b""",
    "crawl_admission": f"""WITH u AS (SELECT {_canonical('all')} AS url, id AS place FROM pages WHERE id IS NOT NULL), once AS (SELECT url, min(place) AS place FROM u GROUP BY url),
h AS (SELECT url, {_HOST} AS domain, place FROM once WHERE regexp_matches(url, '^https?:') AND contains({_HOST}, '.')),
k AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY place, url) AS k FROM h)
SELECT url, domain, place FROM (SELECT url, domain, row_number() OVER (ORDER BY place, url) - 1 AS place FROM k WHERE k <= 3) WHERE place < 300""",
    "page_records": rf"""WITH {_P}, s AS (SELECT id, title, list_transform(list_slice(string_split(content, chr(10)), 1, 10), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')) AS ls FROM p),
t AS (SELECT id, regexp_replace(title, '^{_WS}+|{_WS}+$', '', 'g') AS title, length(array_to_string(ls, ' ')) AS n_chars FROM s)
SELECT id, title, n_chars, 0 AS n_links FROM t WHERE n_chars >= 100 AND title <> ''""",
    "resolved_links": """WITH p AS (SELECT DISTINCT id, url FROM pages WHERE id IS NOT NULL), target AS (SELECT url, max(id) AS to_page FROM p GROUP BY url)
SELECT DISTINCT l.from_page, t.to_page FROM links l JOIN p f ON f.id = l.from_page JOIN p q ON q.id = l.to_page JOIN target t ON t.url = q.url""",
    "jsonl_round_trip": f"""WITH {_P}, r AS (SELECT * FROM p WHERE url IS NOT NULL)
SELECT url, title, source, length, 0 AS first_id, 0 AS gaps, (SELECT count(*) FROM r) AS n_ids FROM r""",
    "shard_round_trip": f"WITH {_TF} SELECT word, count(*) AS df, sum(frequency)::BIGINT AS total, sum(page_id * frequency)::BIGINT AS mass FROM tf GROUP BY word",
    "pagerank_joined": _pagerank(10),
    "constraint_report": """WITH ids AS (SELECT DISTINCT id FROM pages WHERE id IS NOT NULL)
SELECT 'pages.id unique' AS rule, count(*) AS violations FROM (SELECT id FROM pages GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'pages.url unique', count(*) FROM (SELECT url FROM pages GROUP BY url HAVING count(*) > 1)
UNION ALL SELECT 'pages.url not null', count(*) FROM pages WHERE url IS NULL
UNION ALL SELECT 'pages.length >= 0', count(*) FROM pages WHERE length < 0
UNION ALL SELECT 'pages.views >= 0', count(*) FROM pages WHERE views < 0
UNION ALL SELECT 'pages.pagerank >= 0', count(*) FROM pages WHERE pagerank < 0
UNION ALL SELECT 'postings (word, page_id) unique', count(*) FROM (SELECT word, page_id FROM inverted_index GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'postings.frequency > 0', count(*) FROM inverted_index WHERE frequency <= 0
UNION ALL SELECT 'postings.page_id in pages', count(*) FROM inverted_index i WHERE NOT EXISTS (SELECT 1 FROM ids WHERE ids.id = i.page_id)
UNION ALL SELECT 'idf.word unique', count(*) FROM (SELECT word FROM idf GROUP BY word HAVING count(*) > 1)
UNION ALL SELECT 'links (from_page, to_page) unique', count(*) FROM (SELECT from_page, to_page FROM links GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'links.from_page in pages', count(*) FROM links l WHERE NOT EXISTS (SELECT 1 FROM ids WHERE ids.id = l.from_page)
UNION ALL SELECT 'links.to_page in pages', count(*) FROM links l WHERE NOT EXISTS (SELECT 1 FROM ids WHERE ids.id = l.to_page)""",
    "failed_fetches": "SELECT DISTINCT url, coalesce(nullif(error, ''), 'status ' || status, 'unknown') AS error FROM fetch_log WHERE url IS NOT NULL AND coalesce(status <> 200, true)",
    "request_metrics": "SELECT event_type AS kind, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, round(avg(value), 6) AS mean_latency, max(value) AS max_latency FROM events GROUP BY event_type",
    "request_windows": "SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, event_type, count(*) AS requests, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2",
    "p6_found": f"""WITH {_VALID}, n AS (SELECT *, count(*) OVER (PARTITION BY word) AS n, row_number() OVER (PARTITION BY word ORDER BY frequency DESC, page_id) AS k FROM valid)
SELECT word, page_id FROM n WHERE k = 1 AND n >= 0.01 * (SELECT count(*) FROM valid)""",
    "p6_totals": f"""WITH {_VALID}, w AS (SELECT regexp_replace(lower(word), '^{_WS}+|{_WS}+$', '', 'g') AS word, max(idf) AS idf FROM idf WHERE idf IS NOT NULL GROUP BY 1)
SELECT word, count(*) AS n_rows, sum(frequency)::BIGINT AS total, round(sum(idf), 4) AS weight FROM valid JOIN w USING (word) GROUP BY word""",
}
