import math
import random
from itertools import combinations

import numpy as np
import pytest
from helpers import SCHEMA, frame, odd_rows, words
from pyspark.sql import functions as F

from skysift.llm import minhash
from skysift.llm.components import connected_components
from skysift.llm.minhash import HASHES, least_estimate, minhash_components, near_dedup


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, pct):
    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= pct * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: (len(s), find(k)) for k, s in sets.items()}


def near_copies(n=80, seed=4):
    rng = random.Random(seed)
    base = words(rng, 150)
    rows = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = "edit%d" % rng.randrange(1000)
        rows.append((100 + k, " ".join(w), "en", "src0", None))
    return rows


@pytest.mark.parametrize("pct", [80, 85])
def test_matches_brute_force(spark, pct):
    rows = odd_rows() + near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_components(frame(spark, rows), pct).collect()}
    assert got == brute(rows, pct)


def variants(n=60, seed=8):
    """Texts of one group that mostly miss the threshold by little (0.82 by pairs), and some links among them."""
    rng = random.Random(seed)
    base, rows = words(rng, 300), []
    for k in range(n):
        w = rows[-1][1].split() if k % 6 == 5 else list(base)
        for e, at in enumerate(rng.sample(range(5, 295, 5), 1 if k % 6 == 5 else 3)):
            w[at] = "edit%dx%d" % (k, e)
        rows.append((k, " ".join(w), "en", "src0", None))
    return rows


def test_near_misses_of_a_large_group_are_no_candidates(spark, monkeypatch):
    rows, tried = variants(), []

    def counted(docs, pairs, pct, confirm=minhash.confirm_links):
        tried.append(pairs.count())
        return confirm(docs, pairs, pct)

    monkeypatch.setattr(minhash, "confirm_links", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_components(frame(spark, rows), 85).collect()}
    assert got == brute(rows, 85)
    assert sum(tried) <= 3 * len(rows)


def test_parity_bits_bound_the_difference_of_sets_of_any_width():
    rng = np.random.default_rng(3)
    for n in (1, 60, 64, 500, 9000):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[n // 10 :], rng.integers(0, 2**63, n // 6 + 1, dtype=np.uint64)])
        wide, folded = minhash._folded(minhash.parity_bits(np.concatenate([a, b]), np.array([len(a), len(b)])))
        x, y = folded[wide.min()]
        apart, differ = int(np.bitwise_count(x ^ y).sum()), len(np.setxor1d(a, b))
        assert 0 < apart <= differ and (differ - apart) % 2 == 0


@pytest.mark.parametrize("pct", [80, 85, 90, 95])
def test_pairs_at_the_threshold_pass_the_estimate(pct):
    p = pct / 100
    least = round(least_estimate(pct) * HASHES)
    assert sum(math.comb(HASHES, k) * p**k * (1 - p) ** (HASHES - k) for k in range(least)) < 4e-5


def test_empty_repeated_and_extra_columns(spark):
    assert minhash_components(frame(spark, []), 85).count() == 0
    rows = near_copies(6)
    extra = frame(spark, rows + rows[:2]).withColumns({"bands": F.lit(1), "component": F.lit("x"), "pivot": F.lit(2)})
    got = minhash_components(extra, 85).collect()
    assert len(got) == 8 and {(r.doc_id, r.component_id) for r in got} == {(k, c) for k, (_, c) in brute(rows, 85).items()}
    kept = near_dedup(extra, 85)
    assert kept.columns == extra.columns
    with pytest.raises(ValueError):
        minhash_components(extra, 50)


def test_null_ids_are_kept(spark):
    rows = [(None, "a b c d e f", None, None, 1), (1, "a b c d e f", None, None, 1)]
    assert near_dedup(spark.createDataFrame(rows, SCHEMA), 85).count() == 2


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 180)] + [(5, 5), (2, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {k: 100 for k in range(100, 180)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
