"""Fingerprints and candidates of near-duplicates."""

import random

import numpy as np
import pytest

from spindrift.llm import near_duplicates
from tests.llm.test_pages import edited_rows, frame, jaccard_pairs


def furnished_site(n=250):
    """Pages of one host with nothing in common but a fifth of their text, and copies of ten of them with a word changed."""
    rng = random.Random(11)
    prose = lambda k: " ".join("".join(rng.choices("bcdfghklmn", k=6)) for _ in range(k))
    menu = prose(60)
    rows = [(k, "u", "t", f"{menu}\n{prose(120)}", "s") for k in range(n)]
    return rows + [(1000 + k, "u", "t", rows[k][3] + " more", "s") for k in range(10)]


def test_pages_that_share_furniture_only_are_no_candidates(spark):
    """Their number grows with the square of a site's pages; only pairs near the threshold leave the join of the buckets."""
    rows = furnished_site()
    got = {tuple(r) for r in near_duplicates.candidate_pairs(near_duplicates.with_keys(near_duplicates.fingerprints(frame(spark, rows)))).collect()}
    assert got == jaccard_pairs(rows, 0.7) == {(k, 1000 + k) for k in range(10)}


def test_codes_of_pages_beyond_the_broadcast_limit(spark):
    prints = near_duplicates.with_keys(near_duplicates.fingerprints(frame(spark, edited_rows()))).persist()
    plain, shuffled = ({tuple(r) for r in near_duplicates.candidate_pairs(prints, broadcast_keys=n).collect()} for n in (1_000, 0))
    assert plain == shuffled and len(plain) > 30


@pytest.mark.parametrize("size", [3, 20, 400])
def test_symbols_agree_as_often_as_sets_are_similar(size):
    rng = np.random.default_rng(size)
    agree = []
    for _ in range(200):
        s = near_duplicates._mix(rng.integers(0, 2**63, 5 * size, dtype=np.uint64))
        agree.append((near_duplicates.symbols(s[: 4 * size]) == near_duplicates.symbols(s[size:])).mean())
    assert np.mean(agree) == pytest.approx(0.6, abs=0.01) and min(agree) > 0.4
