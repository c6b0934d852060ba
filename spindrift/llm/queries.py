"""Queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import boilerplate, distinctive, frequencies, language, leakage, near_duplicates, packing, rank_walk, repeated_lines


def _t(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def p1_found(spark, d):
    return distinctive.most_telling(*_t(spark, d, "inverted_index", "pages", "idf"))


def p1_divergence(spark, d):
    from spindrift.operators.postings import valid_postings

    best = distinctive.top_terms(distinctive.term_divergence(valid_postings(*_t(spark, d, "inverted_index", "pages")), mu=100.0, min_df=3))
    return best.select("page_id", "word", F.round("score", 6).alias("score"))


def p2_found(spark, d):
    return boilerplate.furniture_lines(*_t(spark, d, "pages"))


def p2_content(spark, d):
    return boilerplate.main_content(*_t(spark, d, "pages"))


def p3_found(spark, d):
    return repeated_lines.find_repeated(*_t(spark, d, "pages"))


def p3_clean(spark, d):
    return repeated_lines.clean_content(*_t(spark, d, "pages"))


def p3_blocks(spark, d):
    return repeated_lines.block_report(*_t(spark, d, "pages")).select("source", "n_lines", "n_pages")


def p5_counts(spark, d):
    return frequencies.word_counts(*_t(spark, d, "inverted_index", "pages", "idf"))


def p5_found(spark, d):
    return p5_counts(spark, d).where("mark is not null").select("word", "mark")


def p5_ngrams(spark, d):
    """The sequences of up to three terms that are neither rare nor common."""
    return frequencies.text_ngrams(*_t(spark, d, "documents"), record="doc_id", text="text").where("mark is null").drop("mark")


def p7_found(spark, d):
    return rank_walk.first_by_positions(rank_walk.fused_order(*_t(spark, d, "candidates", "pages", "source_info")))


def p7_walk(spark, d):
    return rank_walk.first_by_mass(rank_walk.fused_order(*_t(spark, d, "candidates", "pages", "source_info")))


def p4_found(spark, d):
    return near_duplicates.similar_pairs(*_t(spark, d, "pages"))


def p4_classes(spark, d):
    return near_duplicates.page_classes(*_t(spark, d, "pages"))


def p8_found(spark, d):
    return packing.cut_documents(*_t(spark, d, "documents"))


def p8_packing(spark, d):
    return packing.pack_documents(*_t(spark, d, "documents"))


def p9_found(spark, d):
    return leakage.leaks(*_t(spark, d, "documents", "eval_items"))


def p9_similarity(spark, d):
    found = leakage.leaked_items(*_t(spark, d, "documents", "eval_items"))
    return found.where("longest_run >= 13 or similarity >= 0.8").select("doc_id", "item_id", "longest_run", F.round("similarity", 6).alias("similarity"))


def p10_found(spark, d):
    return language.language_corrections(*_t(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_divergence, p2_found, p2_content, p3_found, p3_clean, p3_blocks, p4_found, p4_classes, p5_found, p5_counts, p5_ngrams, p7_found, p7_walk, p8_found, p8_packing, p9_found, p9_similarity, p10_found)
}

_WS = r"[\s\x1c-\x1f\x{85}\p{Z}]"
_VALID = rf"""valid AS (SELECT word, page_id, arg_max(frequency, indexed_at) AS frequency FROM (
  SELECT regexp_replace(lower(word), '^{_WS}+|{_WS}+$', '', 'g') AS word, page_id, frequency, indexed_at FROM inverted_index
  WHERE frequency > 0 AND page_id IN (SELECT id FROM pages)) WHERE word <> '' GROUP BY word, page_id)"""
_SOURCE = rf"coalesce(regexp_replace(lower(source), '^{_WS}+|{_WS}+$', '', 'g'), 'other')"
_LINES = rf"""rows AS (SELECT DISTINCT id, {_SOURCE} AS source, content FROM pages WHERE content <> '' AND id IS NOT NULL),
split AS (SELECT id, source, string_split(content, chr(10)) AS ls FROM rows),
every AS (SELECT id, source, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM split),
keyed AS (SELECT *, trim(regexp_replace(lower(line), '[^a-z]+', ' ', 'g')) AS key FROM every),
lines AS (SELECT * FROM keyed WHERE length(key) - length(replace(key, ' ', '')) >= 3),
sizes AS (SELECT source, count(DISTINCT id) AS n FROM rows GROUP BY source),
bad AS (SELECT l.source, l.key FROM lines l JOIN sizes s USING (source) GROUP BY l.source, l.key, s.n
  HAVING count(DISTINCT l.id) >= 8 AND count(DISTINCT l.id) >= 0.05 * s.n)"""
_POSITIONS = f"""offered AS (SELECT query_id, page_id, max(bm25) AS bm25 FROM candidates WHERE query_id IS NOT NULL GROUP BY query_id, page_id),
info AS (SELECT DISTINCT id, pagerank, views, {_SOURCE} AS source FROM pages),
c AS (SELECT o.query_id, o.page_id, coalesce(o.bm25, '-infinity'::double) AS a, coalesce(i.pagerank, '-infinity'::double) AS b,
  coalesce(s.trust, '-infinity'::double) AS t, coalesce(i.views::double, '-infinity'::double) AS v
  FROM offered o JOIN info i ON i.id = o.page_id LEFT JOIN source_info s ON s.source = i.source),
p AS (SELECT query_id, page_id, rank() OVER (PARTITION BY query_id ORDER BY a DESC) + rank() OVER (PARTITION BY query_id ORDER BY b DESC)
  + rank() OVER (PARTITION BY query_id ORDER BY t DESC) + rank() OVER (PARTITION BY query_id ORDER BY v DESC) AS total FROM c)"""
_COUNTS = rf"""{_VALID},
used AS (SELECT word, sum(frequency)::BIGINT AS total, count(*) AS n_pages FROM valid GROUP BY word),
listed AS (SELECT DISTINCT regexp_replace(lower(word), '^{_WS}+|{_WS}+$', '', 'g') AS word FROM idf WHERE word IS NOT NULL),
counts AS (SELECT word, coalesce(total, 0) AS total, coalesce(n_pages, 0) AS n_pages FROM used FULL JOIN (SELECT word FROM listed WHERE word <> '') USING (word)),
marked AS (SELECT *, CASE WHEN n_pages < 3 THEN 'rare' WHEN n_pages * 2 > (SELECT count(DISTINCT page_id) FROM valid) THEN 'common' END AS mark FROM counts)"""

_SEQUENCES = """rows AS (SELECT DISTINCT id, content FROM pages WHERE content <> '' AND id IS NOT NULL),
words AS (SELECT id, regexp_extract_all(lower(content), '[a-z0-9]+') AS w FROM rows),
s AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) AS s FROM words WHERE len(w) >= 3),
h AS (SELECT id, hash(s) AS s FROM s), n AS (SELECT id, count(*) AS n FROM h GROUP BY id),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM h a JOIN h b ON a.s = b.s AND a.id < b.id GROUP BY a.id, b.id),
near AS (SELECT a AS page_a, b AS page_b FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE k >= 0.7 * (x.n + y.n - k))"""
_EVAL = r"""d AS (SELECT DISTINCT doc_id, list_transform(regexp_extract_all(text, '[\pL\pN]+'), lambda x: lower(x)) AS w FROM documents WHERE text <> '' AND doc_id IS NOT NULL),
i AS (SELECT DISTINCT item_id, list_transform(regexp_extract_all(text, '[\pL\pN]+'), lambda x: lower(x)) AS w FROM eval_items WHERE text <> '' AND item_id IS NOT NULL)"""


def _walk(steps: int = 150) -> str:
    """The first page of each query by the mass of a walk of so many steps, the transition written out as rows (a, b, w)."""
    above = " UNION ALL ".join(
        f"SELECT x.query_id, x.page_id AS a, y.page_id AS b, 0.25::double / count(*) OVER (PARTITION BY x.query_id, x.page_id) AS w FROM c x JOIN c y ON y.query_id = x.query_id AND y.{s} > x.{s}" for s in "abtv"
    )
    stays = " UNION ALL ".join(f"SELECT query_id, page_id AS a, page_id AS b, 0.25::double AS w FROM c x WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.query_id = x.query_id AND y.{s} > x.{s})" for s in "abtv")
    ctes = [_POSITIONS, f"m AS MATERIALIZED (SELECT query_id, a, b, sum(w) AS w FROM ({above} UNION ALL {stays}) GROUP BY ALL)", "r0 AS MATERIALIZED (SELECT query_id, page_id, count(*) OVER (PARTITION BY query_id)::double AS n, 1.0::double / count(*) OVER (PARTITION BY query_id) AS r FROM c)"]
    for k in range(1, steps + 1):
        moved = f"SELECT m.query_id, m.b, sum(r * w) AS v FROM r{k - 1} o JOIN m ON m.query_id = o.query_id AND m.a = o.page_id GROUP BY ALL"
        ctes.append(f"r{k} AS MATERIALIZED (SELECT o.query_id, o.page_id, n, 0.15::double / n + 0.85::double * coalesce(v, 0) AS r FROM r{k - 1} o LEFT JOIN ({moved}) s ON s.query_id = o.query_id AND s.b = o.page_id)")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT query_id, page_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(r, 9) DESC, page_id) AS k FROM r{steps}) WHERE k = 1"


ORACLE: dict[str, str] = {
    "p4_found": f"WITH {_SEQUENCES} SELECT page_a, page_b FROM near",
    "p4_classes": f"""WITH {_SEQUENCES}, sets AS (SELECT id, list_sort(list(s)) AS s FROM h GROUP BY id), cls AS (SELECT id, min(id) OVER (PARTITION BY s) AS rep FROM sets),
l AS (SELECT unnest([page_a, page_b]) AS rep FROM near WHERE page_a IN (SELECT rep FROM cls) AND page_b IN (SELECT rep FROM cls)), k AS (SELECT rep, count(*) AS n FROM l GROUP BY rep)
SELECT cls.id AS page_id, cls.rep AS class_id, coalesce(k.n, 0) AS n_links FROM cls LEFT JOIN k ON k.rep = cls.rep""",
    "p5_ngrams": r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text <> ''),
g AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS ngram FROM d, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n)
SELECT ngram, n::BIGINT AS n, count(*) AS total, count(DISTINCT doc_id) AS n_records FROM g GROUP BY ngram, n
HAVING count(DISTINCT doc_id) >= 3 AND count(DISTINCT doc_id) <= 0.5 * (SELECT count(DISTINCT doc_id) FROM d WHERE len(w) > 0)""",
    "p7_walk": _walk(),
    "p9_similarity": rf"""WITH RECURSIVE {_EVAL},
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda k: hash(w[k:k+4]))) AS s FROM d WHERE len(w) >= 5),
si AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda k: hash(w[k:k+4]))) AS s FROM i WHERE len(w) >= 5),
wt AS (SELECT s, ln(1 + (SELECT count(*) FROM i)::double / count(*)) AS v FROM si GROUP BY s),
whole AS (SELECT item_id, sum(v) AS v FROM si JOIN wt USING (s) GROUP BY item_id),
sim AS (SELECT doc_id, item_id, sum(wt.v) / any_value(whole.v) AS similarity FROM ds JOIN si USING (s) JOIN wt USING (s) JOIN whole USING (item_id) GROUP BY doc_id, item_id),
dw AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, unnest(list_transform(range(1, len(w) - 11), lambda k: hash(w[k:k+12]))) AS h FROM d WHERE len(w) >= 13),
iw AS (SELECT item_id, unnest(range(1, len(w) - 11)) AS q, unnest(list_transform(range(1, len(w) - 11), lambda k: hash(w[k:k+12]))) AS h FROM i WHERE len(w) >= 13),
met AS (SELECT doc_id, item_id, p, p - q AS diagonal, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS island FROM dw JOIN iw USING (h)),
runs AS (SELECT doc_id, item_id, max(n) AS longest_run FROM (SELECT doc_id, item_id, count(*) + 12 AS n FROM met GROUP BY doc_id, item_id, diagonal, island) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, coalesce(longest_run, 0) AS longest_run, round(similarity, 6) AS similarity FROM sim LEFT JOIN runs USING (doc_id, item_id) WHERE longest_run >= 13 OR similarity >= 0.8""",
    "p3_blocks": f"""WITH RECURSIVE {_LINES}, hit AS (SELECT DISTINCT l.id, l.source, l.line_no, l.key, lead(l.key) OVER (PARTITION BY l.id, l.source ORDER BY l.line_no) AS next FROM (SELECT DISTINCT id, source, line_no, key FROM lines) l),
e AS (SELECT h.source, h.key AS a, h.next AS b FROM hit h JOIN bad x ON x.source = h.source AND x.key = h.key JOIN bad y ON y.source = h.source AND y.key = h.next GROUP BY h.source, h.key, h.next HAVING count(DISTINCT h.id) >= 8),
both_ AS (SELECT source, a, b FROM e UNION SELECT source, b, a FROM e UNION SELECT source, key, key FROM bad),
reach AS (SELECT source, a, b FROM both_ UNION SELECT r.source, r.a, s.b FROM reach r JOIN both_ s ON s.source = r.source AND s.a = r.b),
blocks AS (SELECT source, a AS key, min(b) AS block FROM reach GROUP BY source, a),
size AS (SELECT l.source, l.key, count(DISTINCT l.id) AS n FROM lines l JOIN bad USING (source, key) GROUP BY l.source, l.key)
SELECT source, count(*) AS n_lines, max(n) AS n_pages FROM blocks JOIN size USING (source, key) GROUP BY source, block""",
    "p8_found": r"""SELECT DISTINCT doc_id FROM documents WHERE len(regexp_extract_all(text, '[\pL\pN_]+|[^\pL\pN_\s\x1c-\x1f\x{85}\pZ]+')) > 1024""",
    "p9_found": r"""WITH d AS (SELECT DISTINCT doc_id, list_transform(regexp_extract_all(text, '[\pL\pN]+'), lambda x: lower(x)) AS w FROM documents WHERE text <> ''),
i AS (SELECT item_id, list_transform(regexp_extract_all(text, '[\pL\pN]+'), lambda x: lower(x)) AS w FROM eval_items),
dw AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda k: hash(w[k:k+12]))) AS h FROM d WHERE len(w) >= 13),
iw AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 11), lambda k: hash(w[k:k+12]))) AS h FROM i WHERE len(w) >= 13)
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (h)""",
    "p1_found": f"""WITH {_VALID}, w AS (SELECT regexp_replace(lower(word), '^{_WS}+|{_WS}+$', '', 'g') AS word, max(idf) AS idf FROM idf WHERE idf IS NOT NULL GROUP BY 1),
s AS (SELECT page_id, word, frequency * idf AS score FROM valid JOIN w USING (word))
SELECT page_id, word FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, word) AS k FROM s) WHERE k = 1""",
    "p1_divergence": f"""WITH {_VALID}, c AS (SELECT word, sum(frequency)::double / (SELECT sum(frequency) FROM valid) AS p, count(*) AS df FROM valid GROUP BY word),
l AS (SELECT page_id, sum(frequency)::double AS n FROM valid GROUP BY page_id),
s AS (SELECT page_id, word, (frequency + 100 * p) / (n + 100) AS pd, p FROM valid JOIN c USING (word) JOIN l USING (page_id) WHERE df >= 3)
SELECT page_id, word, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, word) AS k FROM (SELECT *, pd * ln(pd / p) AS score FROM s)) WHERE k = 1""",
    "p3_found": f"WITH {_LINES} SELECT DISTINCT l.id AS page_id, l.line_no::INT AS line_no FROM lines l JOIN bad b ON b.source = l.source AND b.key = l.key",
    "p3_clean": f"""WITH {_LINES} SELECT k.id AS page_id, coalesce(string_agg(k.line, chr(10) ORDER BY k.line_no) FILTER (b.key IS NULL), '') AS content
FROM keyed k LEFT JOIN bad b ON b.source = k.source AND b.key = k.key GROUP BY k.id""",
    "p5_found": f"WITH {_COUNTS} SELECT word, mark FROM marked WHERE mark IS NOT NULL",
    "p5_counts": f"WITH {_COUNTS} SELECT word, total, n_pages, mark FROM marked",
    "p7_found": f"WITH {_POSITIONS} SELECT query_id, page_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total, page_id) AS k FROM p) WHERE k = 1",
}
