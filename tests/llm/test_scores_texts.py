"""Rank walk, packing, leakage and languages against brute force, properties and held-out accuracy."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import language, leakage, packing, rank_walk


def dense_walk(values, damping=0.85):
    """values: items x scores, None for null; the transition matrix written out."""
    n, k = len(values), len(values[0])
    v = np.array([[-np.inf if x is None else x for x in row] for row in values], float)
    pos = np.array([[1 + sum(v[:, s] > v[i, s]) for s in range(k)] for i in range(n)])
    m = np.zeros((n, n))
    for i in range(n):
        for s in range(k):
            above = np.flatnonzero(v[:, s] > v[i, s])
            for j in above if len(above) else [i]:
                m[i, j] += 1 / k / max(1, len(above))
    pi = np.full(n, 1 / n)
    for _ in range(3000):
        pi = (1 - damping) / n + damping * pi @ m
    return pos, pi


def groups(seed=4):
    rng = random.Random(seed)
    pick = lambda: rng.choice([None, 0.0, -1.5, 1e12, float(rng.randrange(5)), rng.random()])
    return {g: [(pick(), pick(), pick()) for _ in range(n)] for g, n in enumerate([1, 2, 3, 7, 12, 30])}


@pytest.mark.parametrize("group_rows", [20_000, 5])
def test_rank_walk(spark, group_rows):
    data = groups() if group_rows > 100 else {k: v for k, v in groups().items() if k in (1, 3)}
    rows = [(g, i, *v) for g, items in data.items() for i, v in enumerate(items)] + [(None, 1, 1.0, 1.0, 1.0), (0, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g long, item long, a double, b double, c double").withColumn("mass", F.lit("clash"))
    got = rank_walk.rank_walk(df, "g", "item", ["a", "b", "c"], group_rows=group_rows).collect()
    assert len(got) == sum(map(len, data.values()))
    for g, items in data.items():
        pos, pi = dense_walk(items)
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["item"])
        assert [[r["pos_a"], r["pos_b"], r["pos_c"]] for r in mine] == pos.tolist()
        assert [r["mass"] for r in mine] == pytest.approx(pi.tolist(), abs=1e-6)
        assert sum(r["mass"] for r in mine) == pytest.approx(1, abs=1e-6)


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_large_groups_with_ties(spark, broadcast_rows):
    """A value that most items share, blocks of two values, and sides beyond the broadcast limit."""
    rng = random.Random(11)
    items = [(rng.choice([None, 1.0, 1.0, 1.0, 2.0]), rng.random()) for _ in range(9)]
    df = spark.createDataFrame([(1, k, *v) for k, v in enumerate(items)], "g long, item long, a double, b double")
    got = sorted(rank_walk._large_groups(df, "g", "item", ["a", "b"], 0.5, tol=1e-6, block=2, broadcast_rows=broadcast_rows).collect(), key=lambda r: r["item"])
    pos, pi = dense_walk(items, 0.5)
    assert [[r["pos_a"], r["pos_b"]] for r in got] == pos.tolist()
    assert [r["mass"] for r in got] == pytest.approx(pi.tolist(), abs=1e-5)


def test_no_scale_dominates(spark):
    rows = [(1, i, float(10 - i), float(i) * s) for i in range(5) for s in (1,)]
    df = spark.createDataFrame(rows, "g long, item long, a double, b double")
    one = {r["item"]: r["mass"] for r in rank_walk.rank_walk(df, "g", "item", ["a", "b"]).collect()}
    two = {r["item"]: r["mass"] for r in rank_walk.rank_walk(df.withColumn("b", F.exp(F.col("b") * 50)), "g", "item", ["a", "b"]).collect()}
    assert one == pytest.approx(two)


def test_fused_candidates(spark):
    c = spark.createDataFrame([(1, 10, 5.0), (1, 10, 5.0), (1, 11, None), (1, 99, 9.0), (1, None, 1.0), (2, 11, float("nan"))], "query_id long, page_id long, bm25 double").withColumn("views", F.lit(0))
    p = spark.createDataFrame([(10, 0.1, 5, " Docs"), (10, 0.1, 5, " Docs"), (11, None, 7, None)], "id long, pagerank double, views long, source string")
    s = spark.createDataFrame([("docs", 5.0), ("other", 3.0)], "source string, trust double")
    fused = rank_walk.fused_order(c, p, s)
    got = {(r["query_id"], r["page_id"]): (r["pos_bm25"], r["pos_pagerank"], r["pos_trust"], r["pos_views"]) for r in fused.collect()}
    assert got == {(1, 10): (1, 1, 1, 2), (1, 11): (2, 2, 2, 1), (2, 11): (1, 1, 1, 1)}
    assert sorted(map(tuple, rank_walk.first_by_positions(fused).collect())) == [(1, 10), (2, 11)]
    assert sorted(map(tuple, rank_walk.first_by_mass(fused).collect())) == [(1, 10), (2, 11)]
    assert rank_walk.fused_order(c.limit(0), p, s).collect() == []


def test_token_counts(spark):
    texts = ["Don't stop... now", "", None, "a_b é½²٣ x̄ — «q»", "日本語 テスト!?", "     ", "x" * 100_000, "٠١ ʼn ⅷ a​b"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", packing.token_count(F.col("t")).alias("n")).orderBy("i").select("n").collect()]
    assert got == [len(re.findall(r"\w+|[^\w\s]+", t or "")) for t in texts]


def test_packing_properties(spark):
    rng = random.Random(8)
    sizes = {k: rng.choice([0, 1, 3, 40, 99, 100, 101, 250, rng.randrange(1, 100)]) for k in range(600)}
    rows = [(k, " ".join(["w"] * n)) for k, n in sizes.items()] + [(5000, None), (7, "w w w"), (None, "w w")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tokens", F.lit("clash"))
    got = packing.pack_documents(df, 100, items_a_shard=200).collect()
    fill, per_doc = {}, {}
    for r in got:
        fill[r["shard"], r["container"]] = fill.get((r["shard"], r["container"]), 0) + r["tokens"]
        per_doc.setdefault(r["doc_id"], []).append(r)
    assert max(fill.values()) <= 100
    for k, n in sizes.items():
        if k == 7:
            continue
        mine = per_doc.get(k, [])
        assert sum(r["tokens"] for r in mine) == n and len(mine) == -(-n // 100) and sorted(r["piece"] for r in mine) == list(range(1, len(mine) + 1))
    total = sum(r["tokens"] for r in got)
    assert len(fill) <= total / 100 * 1.01 + 4
    assert {r[0] for r in packing.cut_documents(df, 100).collect()} == {k for k, n in sizes.items() if n > 100}
    assert packing.pack_documents(df.limit(0)).collect() == []


def held(bins, sizes, capacity):
    """Containers with the given items."""
    out = []
    for items in bins:
        out.append(packing.Container())
        for i in items:
            out[-1].add(i, sizes[i])
    return out


def test_local_search_empties_bins():
    sizes = [60, 60, 40, 40, 30, 30, 20, 20]
    bins = [[0, 4], [1, 5], [2, 3], [6, 7]]  # fills 90, 90, 80, 40
    out = [x.items() for x in packing.local_search(held(bins, sizes, 100), 100)]
    square = lambda bs: sum(sum(sizes[i] for i in b) ** 2 for b in bs)
    assert sorted(i for b in out for i in b) == list(range(8)) and all(sum(sizes[i] for i in b) <= 100 for b in out)
    assert len(out) == 3 and square(out) > square(bins)


@pytest.mark.parametrize("bins, sizes, fills", [
    ([[0], [1]], [60, 40], [100, 0]),  # a move
    ([[0, 1], [2]], [50, 30, 45], [95, 30]),  # one for one
    ([[0, 1], [2, 3]], [50, 30, 25, 25], [100, 30]),  # two for one
    ([[0, 1, 2], [3]], [50, 20, 20, 45], [95, 40]),  # one for two
    ([[0], [1]], [70, 40], [70, 40]),
])
def test_exchanges(bins, sizes, fills):
    a, b = held(bins, sizes, 100)
    assert packing.exchange(a, b, 100) == (fills != [sum(sizes[i] for i in x) for x in bins])
    assert [a.fill, b.fill] == fills and sorted(a.items() + b.items()) == list(range(len(sizes)))


def test_search_does_what_the_plain_start_leaves():
    rng = random.Random(4)
    sizes = [rng.choice([rng.randrange(1, 300), rng.randrange(1, 1000), 512]) for _ in range(3000)]
    bins = packing.pack(sizes, 1024)
    assert sorted(i for b in bins for i in b) == list(range(3000)) and max(sum(sizes[i] for i in b) for b in bins) <= 1024
    least = -(-sum(sizes) // 1024)
    assert len(bins) <= least * 1.01 + 1 and len(packing.next_fit(sizes, 1024)) > 1.1 * len(bins)


def test_containers_of_many_small_items():
    sizes = [k % 7 + 1 for k in range(4000)]
    assert len(packing.pack(sizes, 1024)) <= -(-sum(sizes) // 1024) + 1


def test_equal_ids_share_no_container(spark):
    df = spark.createDataFrame([(3, "w " * 250)] * 2 + [(3, "w " * 40)] * 3, "doc_id long, text string")
    got = packing.pack_documents(df, 100).collect()
    fill = {}
    for r in got:
        fill[r["shard"], r["container"]] = fill.get((r["shard"], r["container"]), 0) + r["tokens"]
    assert sum(fill.values()) == 620 and max(fill.values()) <= 100 and len(fill) == 7
    assert [tuple(r) for r in packing.cut_documents(df, 100).collect()] == [(3,)]


def longest_common_run(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                new[j] = row[j - 1] + 1
                best = max(best, new[j])
        row = new
    return best


@pytest.mark.parametrize("block", [5_000, 3])
def test_leaks(spark, block):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgé", k=4)) for _ in range(60)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([8, 13, 14, 30, 60])))) for k in range(8)] + [(None, "x"), (50, None), (51, "")]
    docs = []
    for k in range(60):
        body = rng.choices(words, k=rng.randrange(0, 50))
        for _ in range(rng.randrange(0, 3)):
            own = items[rng.randrange(8)][1].split()
            n, at = rng.choice([11, 12, 13, 14, 40]), rng.randrange(0, 20)
            part, where = own[at : at + n], rng.randrange(len(body) + 1)
            body[where:where] = part
        docs.append((k, rng.choice([" ", "\n", ", -- "]).join(body).upper() if k % 2 else " ".join(body)))
    rows = docs + docs[:2] + [(None, items[0][1]), (900, None), (901, ""), (902, "long " * 30_000 + items[4][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    it = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    expected = {(d, i): n for d, t in rows if d is not None for i, x in items if i is not None and (n := longest_common_run(split(t), split(x))) >= 13}
    found = leakage.leaked_items(df, it, items_a_block=block)
    got = {(r["doc_id"], r["item_id"]): r["longest_run"] for r in found.collect()}
    assert {k: v for k, v in got.items() if v >= 13} == expected and len(expected) > 10
    assert leakage.leaks(df, it).count() == len(expected)
    assert leakage.leaks(df.limit(0), it).collect() == [] and leakage.leaks(df, it.limit(0)).collect() == []


def test_near_windows_are_found():
    a = [f"w{k}" for k in range(40)]
    index = leakage.ItemIndex([" ".join(a)], [7], 13)
    bits = leakage._Bits()
    rows, other = index.near(leakage.simhash_windows(bits.rows(a), bits.table, 13), 13)
    assert {(r, o) for r, o in zip(rows.tolist(), other.tolist())} >= {(k, k) for k in range(28)}
    assert index.verify(a, 0, [(0, 0)]) == (40, pytest.approx(1.0))
    b = a[:20] + ["other"] + a[21:]
    assert index.verify(b, 0, [(0, 0), (21, 21)])[0] == 20 and 0.8 < index.verify(b, 0, [(0, 0)])[1] < 1


def test_short_items_have_windows_of_their_own_length(spark):
    df = spark.createDataFrame([(1, "a b, it is the CAT of (the) house there"), (2, "the cat of the barn"), (3, "cat the of house")], "doc_id long, text string")
    it = spark.createDataFrame([(7, "The cat of the house"), (8, "cat"), (9, "!!")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["longest_run"], r["similarity"]) for r in leakage.leaked_items(df, it).where("longest_run > 0").collect()}
    assert got == {(1, 7): (5, 1.0), (1, 8): (1, 1.0), (2, 8): (1, 1.0), (3, 8): (1, 1.0)}
    assert leakage.leaks(df, it).collect() == []


def test_weights_are_those_of_all_items(spark):
    words = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(words[: 20 + k])) for k in range(9)]
    df = spark.createDataFrame([(1, " ".join(words[:20] + ["x"] + words[20:26]))], "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    all_, split = ({(r["doc_id"], r["item_id"]): r["similarity"] for r in leakage.leaked_items(df, it, items_a_block=n).collect()} for n in (100, 2))
    assert split == pytest.approx(all_) and len(all_) == 9 and all_[1, 0] == pytest.approx(1) and all_[1, 8] < 0.8


def test_gradients():
    model = language.ByteTagger(["a", "b", "c"], hidden=4)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(0)
    x = rng.integers(1, 6, (3, 8)).astype(np.uint8)
    x[0, 5:] = 0
    y = np.array([0, 1, 2])
    _, grads = model.gradients(x, y)
    for name, at in (("u", (0, 1, 2)), ("u", (1, 3, 11)), ("u", (0, 2, 5)), ("v", (1, 2, 0)), ("c", (1,)), ("w", (2 * 256 + int(x[1, 2]), 3)), ("w", ((4 + 0) * 256 + int(x[2, 4]), 9))):
        old, eps = model.p[name][at], 1e-3
        ends = []
        for d in (eps, -eps):
            model.p[name][at] = old + d
            ends.append(model.gradients(x, y)[0])
        model.p[name][at] = old
        assert grads[name][at] == pytest.approx((ends[0] - ends[1]) / (2 * eps), rel=2e-2, abs=2e-4)


def test_scores_without_new_arrays_are_those_of_the_forward_pass():
    model = language.ByteTagger(["a", "b", "c"], hidden=5)
    rng = np.random.default_rng(3)
    x = rng.integers(1, 250, (37, 64)).astype(np.uint8)
    for k in range(37):
        x[k, int(rng.integers(0, 65)) :] = 0
    labels = (x.reshape(37, 16, 4) != 0).sum(axis=2).T
    assert model.window_scores(x, batch=10) == pytest.approx((model.forward(x) * labels[..., None]).sum(axis=0), abs=1e-3)
    assert language.line_scores(model, ["a line", "another", "a line", ""])[[0, 3]] == pytest.approx(language.line_scores(model, ["a line", ""]), abs=1e-5)


WORDS = {
    "en": "the and of with house river under green every which after about stone never they bring", "de": "der und von mit haus fluss unter grün jeder welche nach über stein niemals bringen schön",
    "fr": "le et de avec maison fleuve sous vert chaque lequel après sur pierre jamais apporter été",
}


def _text(rng, lang, n):
    return " ".join(rng.choices(WORDS[lang].split(), k=n))


def test_languages(spark):
    rng = random.Random(6)
    rows, truth = [], set()
    for k in range(240):
        main = "en" if k % 3 else ["de", "fr"][k % 2]
        lines = [_text(rng, main, 14) for _ in range(4)]
        wrong = main
        if k % 9 == 0:
            wrong = "fr" if main != "fr" else "en"
            lines[2] = _text(rng, wrong, 10)
            truth.add((k, 3, wrong))
        lines.insert(1, "for x in list(y): print(x, 1, 2, 3, 4, 5, 6)")
        if k % 9 == 0:
            truth = (truth - {(k, 3, wrong)}) | {(k, 4, wrong)}
        label = {0: None, 1: main.upper(), 2: f"{main}-XX", 3: {"en": "English", "de": "ger", "fr": "French"}[main], 4: "und"}.get(k % 11, main)
        if k % 17 == 5:
            label = "de" if main != "de" else "it"
        named = language.NAMES.get((label or "").split("-")[0].lower())
        if named != main:
            truth.add((k, 0, main))
        rows.append((k, "\n".join(lines).upper() if k % 8 == 1 else "\n".join(lines), label))
    rows += [(900, None, "en"), (901, "", "en"), (902, "!!! 123\n", "en"), (None, "the and of", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("line_no", F.lit("clash"))
    got = {tuple(r) for r in language.language_corrections(df, docs_a_language=40, steps=150).collect() if r["doc_id"] != 902}
    assert len(got & truth) >= 0.97 * len(truth) and len(got - truth) <= 0.03 * len(truth)
    labels = language.label_languages(df, docs_a_language=40, steps=150)
    assert labels.where("confidence < 0 or confidence > 1.0001").isEmpty()
    assert language.label_languages(df.limit(0)).collect() == []
    assert language.language_corrections(df.withColumn("lang", F.lit(None).cast("string"))).collect() == []


def test_named_languages(spark):
    cases = {"en": "en", "EN-gb": "en", " Deu ": "de", "pt_BR": "pt", "Spanish": "es", "xx": None, "": None, None: None, "unknown": None, "ger": "de"}
    got = spark.createDataFrame([(k,) for k in cases], "v string").select("v", language.named_language(F.col("v")).alias("o")).collect()
    assert {r["v"]: r["o"] for r in got} == cases


def test_rare_languages_are_kept_and_wrong_labels_are_none(spark):
    rng = random.Random(9)
    rows = [(k, _text(rng, "en", 14), "en") for k in range(4800)]
    rows += [(k, "\n".join(_text(rng, "fr", 14) for _ in range(4)), "fr") for k in range(5000, 5012)]
    rows += [(k, _text(rng, "en", 14), "it") for k in range(6000, 6016)]
    rows += [(k, "\n".join([_text(rng, "en", 14), _text(rng, "en", 14), _text(rng, "fr", 14)]), "en") for k in range(7000, 7010)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {tuple(r) for r in language.language_corrections(df, docs_a_language=40, steps=150).collect()}
    assert got == {(k, 0, "en") for k in range(6000, 6016)} | {(k, 3, "fr") for k in range(7000, 7010)}
