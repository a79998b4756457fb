import hashlib
import random

import numpy as np
import pytest
from helpers import frame, odd_rows, sentence
from hypothesis import given, settings
from hypothesis import strategies as st

from skysift.llm import suffixdedup as sd


@settings(max_examples=80, deadline=None)
@given(st.binary(min_size=1, max_size=300), st.integers(1, 4))
def test_suffix_array_is_sorted(data, alphabet):
    text = np.frombuffer(data, np.uint8) % alphabet
    raw = text.tobytes()
    order = sd.suffix_array(text, 512)
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    lcp = sd.common_prefixes(text, order, 100)
    for k in range(1, len(order)):
        a, b = raw[order[k - 1] :], raw[order[k] :]
        n = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        assert lcp[k] == min(n, 100) or lcp[k] >= n  # past an end, padding counts as equal


def brute(rows):
    seen, mark = set(), {}
    for doc, text in sorted((r[0], (r[1] or "").encode()) for r in rows):
        cover = np.zeros(len(text), bool)
        for i in range(len(text) - 99):
            w = text[i : i + 100]
            if w in seen:
                cover[i : i + 100] = True
            seen.add(w)
        mark[doc] = (text, cover)
    out = {}
    for doc, (text, cover) in mark.items():
        kept = np.frombuffer(text, np.uint8)[~cover].tobytes()
        spans = int(np.sum(np.diff(np.concatenate([[0], cover.astype(int)])) == 1))
        out[doc] = (len(text), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def rows_with_passages():
    rng = random.Random(6)
    passage = " ".join(sentence(rng, 10) for _ in range(4))
    rows = odd_rows()[:14] + [(14, "y" * 90 + "ab" * 200, None, None, 1)]
    return rows + [(100 + k, sentence(rng, 5) + passage[k : 200 + k] + sentence(rng, 6) + passage[:99], None, None, 1) for k in range(12)]


@pytest.mark.parametrize("hot", [1000, 1])
def test_matches_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    rows = rows_with_passages()
    got = {r.doc_id: tuple(r)[1:] for r in sd.suffix_dedup_digest(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_edges(spark):
    assert sd.suffix_dedup_digest(frame(spark, [])).count() == 0
    text = "z" * 40 + "".join(chr(97 + k * 7 % 26) for k in range(200))
    rows = [(1, text, None, None, 1), (1, text, None, None, 1), (None, text, None, None, 1), (2, text, None, None, 1)]
    got = sorted((r.doc_id or 0, r.n_removed) for r in sd.suffix_dedup_digest(frame(spark, rows)).collect())
    assert got == [(0, brute(rows[:1])[1][1]), (1, brute(rows[:1])[1][1]), (1, brute(rows[:1])[1][1]), (2, len(text))] or got[0] == (0, 0)
    kept = {r.doc_id: bytes(r.kept) for r in sd.suffix_dedup(frame(spark, rows[3:])).collect()}
    assert len(kept[2]) <= len(text)
