"""Boilerplate, repeated lines and near-duplicates against brute force."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spindrift.llm import boilerplate, near_duplicates, repeated_lines

PAGES = "id long, url string, title string, content string, source string"


def frame(spark, rows):
    """Pages with columns beside the needed ones, some of them named as the operators' own."""
    return spark.createDataFrame(rows, PAGES).withColumn("page_id", F.lit(-1)).withColumn("line_no", F.lit("clash")).withColumn("key", F.lit(None).cast("string"))


def key(line):
    return re.sub("[^a-z]+", " ", line.lower()).strip()


def brute_repeated(rows, min_pages, share):
    support, sizes = defaultdict(set), defaultdict(set)
    for i, _, _, c, s in rows:
        if i is None or not c:
            continue
        s = (s or "other").strip().lower()
        sizes[s].add(i)
        for line in c.split("\n"):
            if len(key(line).split()) >= 4:
                support[s, key(line)].add(i)
    out = set()
    for i, _, _, c, s in rows:
        if i is None or not c:
            continue
        s = (s or "other").strip().lower()
        for n, line in enumerate(c.split("\n"), 1):
            p = support.get((s, key(line)), ())
            if len(p) >= min_pages and len(p) >= share * len(sizes[s]):
                out.add((i, n))
    return out


def site_rows(seed=3, n=60):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lines = ["Home | Search | Help | Contact %d" % k, "", "one two three", f"An own line {' '.join(rng.choices('abcdefgh', k=5))}."]
        lines += rng.sample(["All rights are reserved here", "Share this with a friend (%d)" % k, "SHARE this, with a friend", "Read more of this now\r"], rng.randrange(0, 4))
        rng.shuffle(lines)
        rows.append((k, f"https://h.example/{k}", "T", "\n".join(lines), rng.choice(["News", " news", "docs", None])))
    return rows + rows[:5] + [(None, None, None, "x", None), (900, None, None, None, None), (901, None, None, "", "docs"), (902, None, None, "w " * 60_000, "docs")]


def test_repeated_lines(spark):
    rows = site_rows()
    got = repeated_lines.find_repeated(frame(spark, rows), 4, 0.1)
    assert got.columns == ["page_id", "line_no"]
    assert {tuple(r) for r in got.collect()} == brute_repeated(rows, 4, 0.1) and got.count() == len(brute_repeated(rows, 4, 0.1))
    assert repeated_lines.find_repeated(frame(spark, [])).collect() == []


def test_cleaned_content_and_blocks(spark):
    rows = site_rows()
    bad = brute_repeated(rows, 4, 0.1)
    got = {r["page_id"]: r["content"] for r in repeated_lines.clean_content(frame(spark, rows), 4, 0.1).collect()}
    assert got == {i: "\n".join(x for n, x in enumerate(c.split("\n"), 1) if (i, n) not in bad) for i, _, _, c, _ in rows if i is not None and c}
    pair = [(k, None, None, f"first of the two lines\nsecond of the two lines\nown {'x' * k} text of page\na lone line stands here", "s") for k in range(1, 9)]
    report = {(r["n_lines"], r["n_pages"]) for r in repeated_lines.block_report(frame(spark, pair), 4, 0.1).collect()}
    assert report == {(2, 8), (1, 8)}


def test_edges_need_support(spark):
    """Lines that follow each other on few pages are blocks of their own; all their occurrences count."""
    rows = []
    for k in range(12):
        a, b = "the first of two lines", "the second of two lines"
        lines = [a, b] if k < 3 else [a, f"an own line {'xyz'[k % 3] * (k + 1)} of this page", b]
        rows.append((k, None, None, "\n".join([*lines, "the end of every page", "of all of the site"]), "s"))
    report = sorted(r["n_lines"] for r in repeated_lines.block_report(frame(spark, rows), 8, 0.1).collect())
    assert report == [1, 3]
    assert {tuple(r) for r in repeated_lines.find_repeated(frame(spark, rows), 8, 0.1).collect()} == brute_repeated(rows, 8, 0.1)


def test_alignment_is_tree_matching():
    leaf = lambda x: ("r", tuple((a, ()) for a in x))
    assert boilerplate.tree_matching(leaf("abc"), leaf("acd")) == 3 and boilerplate.tree_matching(leaf("ab"), leaf("ba")) == 2
    assert boilerplate.tree_matching(("r", ()), ("q", ())) == 0
    rng = random.Random(7)
    for _ in range(300):
        tree, page = [rng.choices(range(6), k=rng.randrange(0, 9)) for _ in range(2)]
        found = boilerplate.align(boilerplate.places_of(tree), page)
        assert len(found) + 1 == boilerplate.tree_matching(leaf(tree), leaf(page))
        assert all(tree[p] == page[k] for k, p in found) and all(a < c and b < d for (a, b), (c, d) in zip(found, found[1:]))


def test_folded_tree_has_every_label_in_order():
    assert boilerplate.fold_trees([[1, 0, 9], [1, 2, 0, 8, 9], [3, 1, 0, 9], []]) == [3, 1, 2, 0, 8, 9]
    assert sorted(boilerplate.fold_trees([[1, 2, 3], [3, 2, 1, 4]])) == [1, 2, 3, 4]


def test_moved_lines_are_template(spark):
    """The site's lines in another order on every page, before and behind the article, are found all the same."""
    rng, rows, truth = random.Random(2), [], set()
    site = ["Home | Search | Help", "You may refuse our cookies here.", "All of it is ours.", "Share this page", "Our other sites"]
    for k in range(60):
        order = rng.sample(site, 5)
        at = rng.randrange(6)
        body = [f"The {''.join(rng.choices('bcdfgh', k=7))} has {''.join(rng.choices('klmnp', k=6))} parts that nobody named." for _ in range(3)]
        lines = order[:at] + body + order[at:]
        truth |= {(k, n) for n, x in enumerate(lines, 1) if x in site}
        rows.append((k, "https://h.example/x", None, "\n".join(lines), "s"))
    assert {tuple(r) for r in boilerplate.furniture_lines(frame(spark, rows)).collect()} == truth


def test_lines_in_other_scripts(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("абвгдежзиклмнопрст", k=7))
    rows = [(k, "https://h.example/x", word(), "\n".join(["Главная | Поиск", *(" ".join(word() for _ in range(9)) + "." for _ in range(3)), "Все права у нас"]), "s") for k in range(40)]
    assert {tuple(r) for r in boilerplate.furniture_lines(frame(spark, rows)).collect()} == {(k, n) for k in range(40) for n in (1, 5)}


def test_lines_without_letters(spark):
    """Code ends and bare numbers stay in the article; bare numbers behind it are a pager's."""
    rng = random.Random(4)
    prose = lambda: "The " + " ".join("".join(rng.choices("bcdfghklm", k=6)) for _ in range(12)) + "."
    rows = [(k, "https://h.example/x", None, "\n".join(["Home | Help", prose(), f"call_{'abcdefghij'[k % 10]}{'klmn'[k // 10]}(1) {{", "}", "42", prose(), "17"]), "s") for k in range(40)]
    assert {tuple(r) for r in boilerplate.furniture_lines(frame(spark, rows)).collect()} == {(k, n) for k in range(40) for n in (1, 7)}


def test_passages_taken_from_page_to_page_are_content(spark):
    """A long sentence that stands inside the articles of many pages is no template; a notice of its kind around them is."""
    rng = random.Random(6)
    prose = lambda: "The " + " ".join("".join(rng.choices("bcdfghklm", k=6)) for _ in range(14)) + "."
    taken = "One sentence that every tenth page of this host has taken from the first, word by word."
    notice = "We keep some of your answers for as long as you read the pages of this host."
    rows = []
    for k in range(80):
        body = [prose() for _ in range(6)]
        if k % 4 == 0:
            body[3] = taken
        rows.append((k, "https://h.example/x", None, "\n".join([notice, *body, "Home | Help"]), "s"))
    assert {tuple(r) for r in boilerplate.furniture_lines(frame(spark, rows)).collect()} == {(k, n) for k in range(80) for n in (1, 8)}


def wrapped(k, host, subject):
    rng = random.Random(k)
    prose = lambda: f"The {subject} holds {rng.randrange(9)} of the {rng.choice(['red', 'blue', 'green'])} {rng.choice(['parts', 'pieces'])} {rng.random()}. It also keeps {''.join(rng.choices('bcdfgh', k=8))} for later use."
    lines = [
        ("f", "Home | Search | Help"), ("f", f"Home > Things > {subject}"), ("f", f"Written by the {host} team, {k} March"), ("", ""), ("a", subject.title()), ("a", prose()),
        ("f", rng.choice(["Advertisement", "See new blue kites in town"])), ("a", "Background"), ("a", prose()), ("a", f"- a list about {subject}"), ("a", f"run_{subject}(1);"), ("a", f'"{prose()}"'),
        ("a", "Uses"), ("a", prose()), ("f", f"Tags: {subject}, kites"), ("f", "Related pages"), ("f", "What is a gronk?"), ("f", f"Wollop and the {''.join(rng.choices('mnpqr', k=6))}"), ("f", f"© {2000 + k} {host}. All of it is ours."),
    ]
    return lines


def test_boilerplate(spark):
    rows, truth = [], set()
    for k in range(80):
        host, subject = ["alpha", "beta"][k % 2], "snark" + "abcdefghij"[k % 10] + "klmnopqr"[k // 10]
        lines = wrapped(k, host, subject)
        rows.append((k, f"https://{'www.' if k % 7 == 0 else ''}{host}.example/{k}", subject.title(), "\n".join(x for _, x in lines), "s"))
        truth |= {(k, n) for n, (kind, _) in enumerate(lines, 1) if kind == "f"}
    got = [tuple(r) for r in boilerplate.furniture_lines(frame(spark, rows + rows[:3])).collect()]
    assert len(got) == len(set(got)) and set(got) == truth
    kept = {r["page_id"]: r["content"] for r in boilerplate.main_content(frame(spark, rows)).collect()}
    assert kept[5] == "\n".join(x for kind, x in wrapped(5, "beta", "snarkfk") if kind == "a")


def test_boilerplate_of_odd_pages(spark):
    rows = [(1, None, None, "A sentence.", None), (2, "no url", "T", "", None), (3, "https://x.example", None, None, None), (4, "https://x.example", "T", "w " * 60_000 + ".", None), (None, None, None, "x", None), (5, None, None, " \n \n", None)]
    assert boilerplate.furniture_lines(frame(spark, rows)).collect() == []
    assert boilerplate.furniture_lines(frame(spark, [])).collect() == []


def jaccard_pairs(rows, threshold):
    sets = {}
    for i, _, _, c, _ in rows:
        w = re.findall("[a-z0-9]+", (c or "").lower())
        if i is not None and len(w) >= 3:
            sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def edited_rows(seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(400)]
    rows, k = [], 0
    for _ in range(30):
        base = rng.choices(vocabulary, k=rng.randrange(40, 200))
        for _ in range(rng.randrange(1, 5)):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(0, 3)] = rng.choices(vocabulary, k=rng.randrange(0, 2))
            rows.append((k, f"u{k}", "t", rng.choice([" ", "\n"]).join(w).upper() if k % 3 else ", ".join(w), "s"))
            k += 1
    copies = [(1000 + j, "u", "t", rows[0][3], "s") for j in range(4)]
    return rows + copies + rows[:4] + [(2000, "u", None, None, None), (2001, "u", None, "", None), (2002, None, None, "two words", None), (2003, None, None, "two words", None), (None, None, None, rows[0][3], None)]


@pytest.mark.parametrize("bucket", [2_000, 2])
def test_near_duplicates(spark, monkeypatch, bucket):
    plain = near_duplicates.candidate_pairs
    monkeypatch.setattr(near_duplicates, "candidate_pairs", lambda p: plain(p, bucket=bucket))
    rows = edited_rows()
    got = [tuple(r) for r in near_duplicates.similar_pairs(frame(spark, rows)).collect()]
    expected = jaccard_pairs(rows, 0.7)
    assert len(got) == len(set(got)) and set(got) <= expected and len(expected) > 30
    # Borderline pairs are found with a probability just below 1; the rest must be there.
    assert set(got) >= jaccard_pairs(rows, 0.75) and len(got) >= len(expected) - 1


def test_pairs_of_a_class_in_blocks(spark):
    members = spark.createDataFrame([(k, 0) for k in range(23)] + [(100, 100), (101, 100), (200, 200)], "page_id long, rep long")
    got = sorted(map(tuple, near_duplicates.pairs_within(members, bucket=4).collect()))
    assert got == [(a, b) for a in range(23) for b in range(a + 1, 23)] + [(100, 101)]


def test_candidates_beyond_the_broadcast_limit(spark):
    rng = random.Random(1)
    rows = [(k, rng.getrandbits(3), 0, [rng.randrange(12), 50 + k // 2]) for k in range(60)]
    prints = spark.createDataFrame(rows, "page_id long, bits_a long, bits_b long, keys array<long>")
    plain, shuffled = ({tuple(r) for r in near_duplicates.candidate_pairs(prints, most_bits=2, broadcast_keys=n).collect()} for n in (1_000, 0))
    assert plain == shuffled and len(plain) > 50


def test_classes_and_their_links(spark):
    rows = edited_rows()
    got = {r["page_id"]: (r["class_id"], r["n_links"]) for r in near_duplicates.page_classes(frame(spark, rows)).collect()}
    pairs = {tuple(r) for r in near_duplicates.similar_pairs(frame(spark, rows)).collect()}
    assert all(got[k] == got[0] for k in range(1000, 1004)) and got[0][0] == 0
    reps = {c for c, _ in got.values()}
    links = {p for p in pairs if set(p) <= reps}
    assert all(n == sum(c in p for p in links) for c, n in got.values()) and 2000 not in got
    assert near_duplicates.page_classes(frame(spark, [])).collect() == []


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates.similar_pairs(frame(spark, [])).collect() == []


def test_no_side_is_small_enough_to_be_broadcast(spark, monkeypatch):
    """Beyond the limits every checked join is a shuffle with split hot keys; the rows are the same."""
    from spindrift.plans import runtime

    site, edited = site_rows(), edited_rows()
    with monkeypatch.context() as m:
        m.setattr(runtime, "BROADCAST_ROWS", 0)
        m.setattr(repeated_lines, "BROADCAST_SOURCES", 0)
        m.setattr(near_duplicates, "BROADCAST_ROWS", 0)
        assert {tuple(r) for r in repeated_lines.find_repeated(frame(spark, site), 4, 0.1).collect()} == brute_repeated(site, 4, 0.1)
        shuffled = {tuple(r) for r in near_duplicates.similar_pairs(frame(spark, edited)).collect()}
    assert shuffled == {tuple(r) for r in near_duplicates.similar_pairs(frame(spark, edited)).collect()}


def copied_site(n_copies=20, n_own=40):
    """Pages of one host: own articles, and copies of one article with a line changed in some; each row may be repeated."""
    rng = random.Random(5)
    prose = lambda: "The " + " ".join("".join(rng.choices("bcdfghklm", k=6)) for _ in range(18)) + "."
    article, rows = [prose() for _ in range(8)], []
    for k in range(n_copies + n_own):
        body = list(article) if k < n_copies else [prose() for _ in range(8)]
        if k < n_copies and k % 3 == 0:
            body[k % 8] = body[k % 8].replace(" ", " surely ", 1)
        rows.append((k, f"https://h.example/{k}", "Of gronks", "\n".join(["You may refuse our cookies here.", *body, "All of it is ours."]), "s"))
    return rows


def test_lines_of_copies_are_no_template(spark):
    rows = copied_site()
    got = {tuple(r) for r in boilerplate.furniture_lines(frame(spark, rows)).collect()}
    assert got == {(k, n) for k, *_ in rows for n in (1, 10)}


def test_support_counts_pages_not_rows(spark):
    rows = copied_site(0)
    again = "\n".join([rows[0][3].split("\n")[1]] * 8)
    rows[0] = (*rows[0][:3], rows[0][3] + "\n" + again, "s")
    got = {tuple(r) for r in boilerplate.furniture_lines(frame(spark, rows + [rows[1]] * 30)).collect()}
    assert got == {(k, n) for k, *_ in rows for n in (1, 10)}


def test_support_of_the_collection_counts_hosts_with_one_page(spark):
    prose = lambda k, j: f"The {'abcdefghij'[k % 10] * 5} {'klmnopqrst'[k // 10] * 5} {'uvwxyz'[j] * 5} has many parts that nobody has named yet."
    rows = [(k, f"https://h{k}.example/", None, "\n".join([*(prose(k, j) for j in range(6)), "All of it is ours."]), "s") for k in range(30)]
    assert {tuple(r) for r in boilerplate.furniture_lines(frame(spark, rows)).collect()} == {(k, 7) for k in range(30)}


def test_pairs_far_in_code_are_candidates(spark):
    rows = [(1, 0, 0, [5, 6]), (2, (1 << 44) - 1, 0, [6, 7]), (3, 0, (1 << 45) - 1, [5, 8])]
    prints = spark.createDataFrame(rows, "page_id long, bits_a long, bits_b long, keys array<long>")
    assert [tuple(r) for r in near_duplicates.candidate_pairs(prints).collect()] == [(1, 2)]


def test_pairs_at_the_threshold_with_odd_fingerprints(spark):
    rows = []
    for seed in (364, 1186, 6475, 11043):  # their codes differ in 38 to 42 bits, their similarity is 29 / 41
        rng = random.Random(seed)
        w = [f"w{rng.randrange(10**6)}" for _ in range(37)]
        rows += [(2 * seed, "u", "t", " ".join(w), "s"), (2 * seed + 1, "u", "t", " ".join([*w[:12], "other", *w[13:33], "another", *w[34:]]), "s")]
    assert {tuple(r) for r in near_duplicates.similar_pairs(frame(spark, rows)).collect()} == jaccard_pairs(rows, 0.7) == {(r[0], r[0] + 1) for r in rows[::2]}
