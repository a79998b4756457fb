"""Quality rules: document statistics, fixed base rules, and boosted trees with monotonic constraints (operator 9).

Semantics. Words are runs of bytes other than space and 0x09-0x0D of the whole text (null: none), case kept.
word_chars: code points in words. n_symbols: characters of ``[#*$%&|<>]``. n_dup_lines: \\n-split lines that hold a word
and equal an earlier line. n_repeat_words: words inside 5-word windows found twice or more in the text, first included.
base_failed: n_words < 10 or 100 * n_repeat_words > 20 * n_words. kept: not base_failed and the trees' score is at least
``threshold``. Empty and null texts fail the base rule. Every row gives one row; repeated rows give equal rows; ties of
scores do not matter as the rule is a threshold. An empty table gives an empty result; extra columns are ignored.

Model. Trees are grown in numpy by histogram splits on the logistic loss over a bounded sample of labelled rows
(``MAX_ROWS``). Chosen features are monotonic: a split that would break the sign is not taken and child values are clipped
to the bounds passed down. Trees are flattened to node arrays, so scoring is a few vectorised gathers per level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk

#: Rows used to fit, at most: those with the smallest hash of their id.
MAX_ROWS = 20_000
WINDOW = 5
FEATURES = ["log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "punct_share", "alpha_share", "distinct_share", "mean_line", "short_line_share"]
#: +1: the score may only rise with the feature; -1: only fall.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1}
STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(ch) for ch in "#*$%&|<>"]] = True
_KIND = np.zeros((4, 256), bool)  # upper, digit, punctuation, letters (bytes from 128 on count as letters)
_KIND[0, 65:91] = _KIND[1, 48:58] = _KIND[3, 65:91] = _KIND[3, 97:123] = _KIND[3, 192:] = True
_KIND[2, [ord(ch) for ch in ".,;:!?'\"()[]{}-/"]] = True


def _per_row(mask_or_value: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask_or_value, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def _covered(keys: np.ndarray, size: int) -> int:
    """Items inside windows (``keys`` has one key per window) that occur twice or more."""
    _, back, n = np.unique(keys, return_inverse=True, return_counts=True)
    rep = np.flatnonzero(n[back] > 1)
    if not len(rep):
        return 0
    mark = np.zeros(len(keys) + size, np.int32)
    np.add.at(mark, rep, 1)
    np.add.at(mark, rep + size, -1)
    return int(np.count_nonzero(np.cumsum(mark) > 0))


def document_stats(c: tk.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(base statistics 5 x rows as int64, features rows x len(FEATURES))."""
    rows = c.hi - c.lo
    starts, ends, counts = tk.word_bounds(c)
    first = np.concatenate([[0], np.cumsum(counts)])
    prefix = tk.prefix_hash(c.data, tk.CODES)
    words = tk.mix(tk.span_hash(prefix, starts, ends) + (ends - starts).astype(np.uint64) * tk.U(0xD6E8FEB86659FD93))
    runs = tk.window_hashes(words, WINDOW)
    lead = (c.data & 0xC0) != 0x80
    chars = _per_row(lead & ~tk.SPACE[c.data], c.offs)
    symbols = _per_row(_SYMBOL[c.data], c.offs)
    size = np.diff(c.offs)
    breaks = np.flatnonzero(c.data == 10)
    line_row, line_lo, line_hi = _line_spans(c, breaks)
    has_word = np.searchsorted(starts, line_hi, "left") > np.searchsorted(starts, line_lo, "left")
    line_hash = tk.mix(tk.span_hash(prefix, line_lo, line_hi) + (line_hi - line_lo).astype(np.uint64))
    base = np.zeros((5, rows), np.int64)
    base[0], base[1], base[2] = counts, chars, symbols
    distinct = np.zeros(rows)
    line_first = np.searchsorted(line_row, np.arange(rows + 1))
    for i in range(rows):
        own = line_hash[line_first[i] : line_first[i + 1]][has_word[line_first[i] : line_first[i + 1]]]
        if len(own) > 1:
            base[3, i] = len(own) - len(np.unique(own))
        n = counts[i]
        if n:
            w = words[first[i] : first[i] + n]
            distinct[i] = len(np.unique(w)) / n
            if n > WINDOW:
                base[4, i] = _covered(runs[first[i] : first[i] + n - WINDOW + 1], WINDOW)
    n = np.maximum(counts, 1)
    lines = np.maximum(np.diff(line_first), 1)
    bytes_in = np.maximum(size, 1)
    short = np.bincount(line_row, weights=(line_hi - line_lo) < 20, minlength=rows)[:rows]
    kinds = [_per_row(k[c.data], c.offs) / bytes_in for k in _KIND]
    x = np.stack(
        [np.log1p(counts), chars / n, symbols / np.maximum(chars, 1), base[3] / lines, base[4] / n, kinds[0], kinds[1], kinds[2], kinds[3], distinct, size / lines, short / lines],
        axis=1,
    )
    return base, x


def _line_spans(c: tk.Chunk, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of every \\n-split line (each row has one more line than breaks), in order."""
    rows = c.hi - c.lo
    row_of_break = np.searchsorted(c.offs, breaks, "right") - 1
    row = np.concatenate([np.arange(rows), row_of_break])
    lo = np.concatenate([c.offs[:-1], breaks + 1])
    order = np.lexsort((lo, row))
    row, lo = row[order], lo[order]
    ends = np.concatenate([breaks, c.offs[1:]])
    end_row = np.concatenate([row_of_break, np.arange(rows)])
    hi = ends[np.lexsort((ends, end_row))]
    return row, lo, hi


@dataclass
class Forest:
    """All trees in flat node arrays; a leaf points to itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                go = x[rows, self.feature[at]] <= self.cut[at]
                at = np.where(go, self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, lam: float = 2.0, least: int = 5) -> Forest:
    """Second-order boosting on the logistic loss. One class only, or no rows: a constant score."""
    pos = float(y.mean()) if len(y) else 0.5
    bias = float(np.log((pos + 1e-3) / (1 - pos + 1e-3)))
    nodes: dict[str, list] = {k: [] for k in ("feature", "cut", "left", "right", "value")}
    roots: list[int] = []
    if len(y) >= 2 * least and 0 < pos < 1:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
        sign = [MONOTONE.get(name, 0) for name in FEATURES]
        total = np.full(len(y), bias)

        def new(value: float) -> int:
            i = len(nodes["value"])
            for k, v in (("feature", 0), ("cut", np.inf), ("left", i), ("right", i), ("value", value)):
                nodes[k].append(v)
            return i

        def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
            gs, hs = g[rows].sum(), h[rows].sum()
            here = new(rate * float(np.clip(-gs / (hs + lam), low, high)))
            if level == depth or len(rows) < 2 * least:
                total[rows] += nodes["value"][here]
                return here
            best = (1e-6, -1, 0, 0.0, 0.0)
            for f, e in enumerate(edges):
                k = len(e) + 1
                if k < 2:
                    continue
                gb = np.cumsum(np.bincount(binned[rows, f], g[rows], k))[:-1]
                hb = np.cumsum(np.bincount(binned[rows, f], h[rows], k))[:-1]
                nb = np.cumsum(np.bincount(binned[rows, f], minlength=k))[:-1]
                vl, vr = np.clip(-gb / (hb + lam), low, high), np.clip(-(gs - gb) / (hs - hb + lam), low, high)
                gain = gb**2 / (hb + lam) + (gs - gb) ** 2 / (hs - hb + lam) - gs**2 / (hs + lam)
                gain[(nb < least) | (len(rows) - nb < least) | (sign[f] * (vr - vl) < 0)] = -1
                j = int(np.argmax(gain))
                if gain[j] > best[0]:
                    best = (float(gain[j]), f, j, float(vl[j]), float(vr[j]))
            _, f, j, vl, vr = best
            if f < 0:
                total[rows] += nodes["value"][here]
                return here
            mid = (vl + vr) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[sign[f]]
            go = binned[rows, f] <= j
            nodes["feature"][here], nodes["cut"][here] = f, float(edges[f][j])
            nodes["left"][here] = grow(rows[go], g, h, level + 1, *bounds[0])
            nodes["right"][here] = grow(rows[~go], g, h, level + 1, *bounds[1])
            return here

        for _ in range(trees):
            p = 1 / (1 + np.exp(-total))
            roots.append(grow(np.arange(len(y)), p - y, np.maximum(p * (1 - p), 1e-6), 0, -4.0, 4.0))
    as_array = lambda k, t: np.array(nodes[k] or [0], t)
    return Forest(as_array("feature", np.int64), as_array("cut", float), as_array("left", np.int64), as_array("right", np.int64), as_array("value", float), np.array(roots, np.int64), depth, bias)


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Forest:
    """Fit on the labelled rows with the smallest hashed ids, ``max_rows`` at most; only their features reach the driver."""
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").select("doc_id", "text", "y")
    schema = "doc_id long, y double, x array<double>"

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in tk.chunks(b.column(1)):
                _, x = document_stats(c)
                n = c.hi - c.lo
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.lo, n), b.column(2).slice(c.lo, n), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    got = rows.mapInArrow(features, schema).toArrow().sort_by("doc_id")
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit_forest(x, got.column("y").to_numpy())


def quality_rules(docs: DataFrame, forest: Forest, threshold: float = 0.25) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in tk.chunks(b.column(1)):
                base, x = document_stats(c)
                score = forest.score(x)
                failed = (base[0] < 10) | (100 * base[4] > 20 * base[0])
                cols = [b.column(0).slice(c.lo, c.hi - c.lo), *(pa.array(v) for v in base), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, f"{STATS}, base_failed boolean, kept boolean, score double")
