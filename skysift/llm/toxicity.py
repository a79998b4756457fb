"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy (operator 7).

Semantics. A text's words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased. Overlapping windows of
``WINDOW`` words start every ``STRIDE`` words, the last one at the end; a text's score is the highest window's. Every word
is in a window, those near the start and the end of a text in one only; passages of up to ``WINDOW - STRIDE`` words lie
whole in a window, longer ones may be split. Texts without words (null, empty, blank) score ``EMPTY_SCORE``. predicted is 1
when score >= 0.7. held_out: crc32 of the id as decimal text mod 3 is 1; such labels are never read. Every row gives one
row, repeated rows equal rows; an empty table gives an empty result; extra columns are ignored.

Inputs of a word: a hashed word embedding and the mean of hashed embeddings of its four-byte character runs.
Training: multiple-instance learning on a bounded, documented sample of labelled rows (``MAX_POSITIVE``, ``MAX_NEGATIVE``
rows, each text whole, whatever its length): a document's highest window carries its label. Without both labels the model stays
constant at the share of label 1.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk

WINDOW, STRIDE = 48, 24
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 8
WORD_BITS, CHAR_BITS = 18, 17
#: The sample that the model is fitted on.
MAX_POSITIVE, MAX_NEGATIVE = 1200, 4800
EPOCHS = 7
#: Small samples are gone through more often, to this many steps.
MIN_STEPS = 300
#: Windows that go through the network at once.
BATCH = 2048
EMPTY_SCORE = 0.0
THRESHOLD = 0.7
SEED = 11


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


@dataclass
class Words:
    """A chunk's words, reduced to distinct ones: hashed word ids, character-run ids with owners, and each word's number."""

    word: np.ndarray
    runs: np.ndarray
    run_at: np.ndarray
    inverse: np.ndarray
    counts: np.ndarray


def read_words(c: tk.Chunk) -> Words:
    starts, ends, counts = tk.word_bounds(c)
    h = tk.word_hashes(c, starts, ends, lower=True)
    _, pick, inverse = np.unique(h, return_index=True, return_inverse=True)
    s, n = starts[pick], np.maximum(ends[pick] - starts[pick] - 3, 0)
    run_at = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(s - run_at[:-1], n) + np.arange(run_at[-1])
    low = c.data.astype(np.uint32)
    low += np.uint32(32) * ((low >= 65) & (low <= 90)).astype(np.uint32)
    quad = (low[at] | low[at + 1] << 8 | low[at + 2] << 16 | low[at + 3] << 24) if len(at) else np.zeros(0, np.uint32)
    runs = (quad * np.uint32(2654435761)) ^ (quad >> np.uint32(15))
    runs = (runs * np.uint32(2246822519)) >> np.uint32(32 - CHAR_BITS)
    return Words((h[pick] >> np.uint64(64 - WORD_BITS)).astype(np.int64), runs.astype(np.int64), run_at, inverse, counts)


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, length) of every window; rows without words have none."""
    base = np.concatenate([[0], np.cumsum(counts)])
    many = np.where(counts > WINDOW, -(-(counts - WINDOW) // STRIDE) + 1, (counts > 0).astype(np.int64))
    row = np.repeat(np.arange(len(counts)), many)
    k = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(many)[:-1]]), many)
    first = np.minimum(k * STRIDE, np.maximum(counts[row] - WINDOW, 0))
    return row, base[row] + first, np.minimum(counts[row], WINDOW)


class BiGru:
    """Weights and both passes. Gate columns are [z, r, n], each with both directions side by side."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        g = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.p = {
            "word": g(1 << WORD_BITS, WORD_DIM, s=0.1), "char": g(1 << CHAR_BITS, CHAR_DIM, s=0.3), "wx": g(d, 6 * h, s=d**-0.5), "bx": np.zeros(6 * h, np.float32),
            "uz": g(2 * h, 4 * h, s=h**-0.5), "un": g(2 * h, 2 * h, s=h**-0.5), "att": g(2 * h, s=0.3), "out": g(2 * h, s=0.5), "bias": np.zeros(1, np.float32),
        }
        side = np.arange(2 * h) // h
        self.mask_z = (side[:, None] == np.tile(side, 2)[None, :]).astype(np.float32)
        self.mask_n = (side[:, None] == side[None, :]).astype(np.float32)
        self.constant: float | None = None

    def inputs(self, w: Words) -> np.ndarray:
        x = np.zeros((len(w.word), WORD_DIM + CHAR_DIM), np.float32)
        x[:, :WORD_DIM] = self.p["word"][w.word]
        n = np.diff(w.run_at)
        has = n > 0
        if has.any():
            x[has, WORD_DIM:] = np.add.reduceat(self.p["char"][w.runs], w.run_at[:-1][has], axis=0) / n[has, None]
        return x

    def forward(self, proj: np.ndarray, inverse: np.ndarray, first: np.ndarray, length: np.ndarray, keep: bool = False):
        """Logits of windows; proj: distinct words x 6H. With ``keep``, also what ``backward`` needs."""
        p, h2, t_max = self.p, 2 * HIDDEN, int(length.max())
        uz, un = p["uz"] * self.mask_z, p["un"] * self.mask_n
        pos = np.arange(t_max)[:, None]
        live = pos < length
        idx = inverse[np.where(live, first + pos, first)]
        full = bool(live.all())
        b = len(first)
        state = np.zeros((b, h2), np.float32)
        hs = np.empty((t_max, b, h2), np.float32)
        saved = []
        both = np.tile(np.concatenate([np.ones(HIDDEN, bool), np.zeros(HIDDEN, bool)]), 3)
        for t in range(t_max):
            a = np.where(both, proj[idx[t]], proj[idx[t_max - 1 - t]])
            zr = a[:, : 2 * h2]
            zr += state @ uz
            np.clip(zr, -30, 30, out=zr)
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:, :h2], zr[:, h2:]
            hu = state @ un
            n = a[:, 2 * h2 :]
            n += r * hu
            np.tanh(n, out=n)
            new = n + z * (state - n)
            if not full:
                m = np.where(both[:h2], live[t][:, None], live[t_max - 1 - t][:, None])
                new = np.where(m, new, state)
            if keep:
                saved.append((state, z, r, n, hu))
            state = hs[t] = new
        o = np.concatenate([hs[:, :, :HIDDEN], hs[::-1, :, HIDDEN:]], axis=2)
        e = o @ p["att"]
        if not full:
            e = np.where(live, e, -1e9)
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", w, o)
        logit = pooled @ p["out"] + p["bias"][0]
        return (logit, (idx, live, saved, o, w, pooled, uz, un)) if keep else logit

    def backward(self, kept, dlogit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Gradients of the small weights, and for each used word (numbers, gradient of its 6H projection)."""
        idx, live, saved, o, w, pooled, uz, un = kept
        h2, t_max = 2 * HIDDEN, len(saved)
        g = {"out": dlogit @ pooled, "bias": np.array([dlogit.sum()], np.float32)}
        dpool = dlogit[:, None] * self.p["out"]
        da = np.einsum("tbh,bh->tb", o, dpool)
        de = w * (da - (w * da).sum(axis=0))
        g["att"] = np.einsum("tb,tbh->h", de, o)
        do = w[:, :, None] * dpool + de[:, :, None] * self.p["att"]
        dhs = np.concatenate([do[:, :, :HIDDEN], do[::-1, :, HIDDEN:]], axis=2)
        g["uz"], g["un"] = np.zeros_like(uz), np.zeros_like(un)
        dp = np.zeros((t_max, len(dlogit), 3 * h2), np.float32)
        left = np.arange(h2) < HIDDEN
        carry = np.zeros_like(dhs[0])
        for t in range(t_max - 1, -1, -1):
            state, z, r, n, hu = saved[t]
            dh = dhs[t] + carry
            m = np.where(left, live[t][:, None], live[t_max - 1 - t][:, None])
            dnew = np.where(m, dh, 0)
            dn = dnew * (1 - z) * (1 - n * n)
            dz = dnew * (state - n) * z * (1 - z)
            dr = dn * hu * r * (1 - r)
            dzr, dhu = np.concatenate([dz, dr], axis=1), dn * r
            g["uz"] += state.T @ dzr
            g["un"] += state.T @ dhu
            carry = np.where(m, dnew * z, dh) + dzr @ uz.T + dhu @ un.T
            both = np.concatenate([dzr, dn], axis=1)
            sel = np.tile(left, 3)
            dp[t] += np.where(sel, both, 0)
            dp[t_max - 1 - t] += np.where(sel, 0, both)
        g["uz"] *= self.mask_z
        g["un"] *= self.mask_n
        return g, idx, dp

    def logits(self, c: tk.Chunk) -> np.ndarray:
        """The highest window logit of each row; -inf for rows without words."""
        w = read_words(c)
        out = np.full(c.hi - c.lo, -np.inf)
        row, first, length = windows(w.counts)
        if not len(row):
            return out
        proj = self.inputs(w) @ self.p["wx"] + self.p["bx"]
        best = np.empty(len(row), np.float32)
        order = np.argsort(-length, kind="stable")
        cuts = [0, int((length == WINDOW).sum()), len(row)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            for a in range(lo, hi, BATCH):
                pick = order[a : min(a + BATCH, hi)]
                best[pick] = self.forward(proj, w.inverse, first[pick], length[pick])
        np.maximum.at(out, row, best)
        return out

    def score(self, c: tk.Chunk) -> np.ndarray:
        if self.constant is not None:
            return np.full(c.hi - c.lo, self.constant)
        x = self.logits(c)
        with np.errstate(over="ignore"):
            return np.where(np.isneginf(x), EMPTY_SCORE, 1 / (1 + np.exp(-np.clip(x, -60, 60))))


def fit(texts: pa.ChunkedArray, y: np.ndarray, place: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> BiGru:
    """Adam on each document's highest window; embeddings by Adagrad on the rows touched. ``y[i]`` is the label of ``texts[place[i]]``."""
    net = BiGru(seed)
    if not len(y) or y.min() == y.max():
        net.constant = float(y.mean()) if len(y) else 0.0
        return net
    rng = np.random.default_rng(seed)
    small = [k for k in net.p if k not in ("word", "char")]
    m1, m2 = ({k: np.zeros_like(net.p[k]) for k in small} for _ in range(2))
    seen = {k: np.full_like(net.p[k], 1e-4) for k in ("word", "char")}
    step = 0
    pos = float(y.mean())
    weight = np.where(y > 0.5, min(1.0, 0.25 / pos), 1.0).astype(np.float32)
    per = 64
    epochs = max(epochs, -(-MIN_STEPS * per // len(texts)))
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        rate = 0.01 * (1 - 0.9 * epoch / epochs)
        for a in range(0, len(order), per):
            docs = order[a : a + per]
            chunk = next(tk.chunks(texts.take(pa.array(place[docs])).combine_chunks(), 1 << 30))
            w = read_words(chunk)
            row, first, length = windows(w.counts)
            if not len(row):
                continue
            x = net.inputs(w)
            proj = x @ net.p["wx"] + net.p["bx"]
            logit = np.concatenate([net.forward(proj, w.inverse, first[i : i + BATCH], length[i : i + BATCH]) for i in range(0, len(row), BATCH)])
            # Early on, a random window stands in now and then, so that no first guess settles the choice.
            rank = logit + (rng.gumbel(size=len(logit)) * (1.0 if epoch < 2 else 0.0)).astype(np.float32)
            by = np.lexsort((-rank, row))
            top = by[np.concatenate([[True], row[by][1:] != row[by][:-1]])]
            logit, kept = net.forward(proj, w.inverse, first[top], length[top], keep=True)
            want = y[docs][row[top]].astype(np.float32)
            d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - want) * weight[docs][row[top]] / len(top)
            g, idx, dp = net.backward(kept, d.astype(np.float32))
            used, at = np.unique(idx, return_inverse=True)
            dproj = np.zeros((len(used), dp.shape[2]), np.float32)
            np.add.at(dproj, at.reshape(-1), dp.reshape(-1, dp.shape[2]))
            g["wx"], g["bx"] = x[used].T @ dproj, dproj.sum(axis=0)
            dx = dproj @ net.p["wx"].T
            step += 1
            for k in small:
                m1[k] += 0.1 * (g[k] - m1[k])
                m2[k] += 0.01 * (g[k] ** 2 - m2[k])
                net.p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
            n = np.diff(w.run_at)[used]
            runs = np.concatenate([w.runs[w.run_at[u] : w.run_at[u + 1]] for u in used]) if len(used) else w.runs[:0]
            grads = {"word": (w.word[used], dx[:, :WORD_DIM]), "char": (runs, np.repeat(dx[:, WORD_DIM:] / np.maximum(n, 1)[:, None], n, axis=0))}
            for k, (ids, grad) in grads.items():
                rows, back = np.unique(ids, return_inverse=True)
                total = np.zeros((len(rows), grad.shape[1]), np.float32)
                np.add.at(total, back, grad)
                seen[k][rows] += total**2
                net.p[k][rows] -= 5 * rate * total / np.sqrt(seen[k][rows])
    return net


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pickled model of all rows (toxic, at, doc_id, text), label 1 first, else in the order of ``at``."""
    if got := [b for b in batches if b.num_rows]:
        rows = pa.Table.from_batches(got)
        # The texts stay where they are, as the one copy of the sample.
        order = pc.sort_indices(rows, [("toxic", "descending"), ("at", "ascending"), ("doc_id", "ascending")]).to_numpy()
        net = fit(rows.column("text"), rows.column("toxic").to_numpy().astype(float)[order], order)
        del got, rows
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net, pickle.HIGHEST_PROTOCOL)], pa.binary())], names=["model"])


def train_toxicity(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE) -> BiGru:
    """Fit on labelled rows that are not held out: those with the smallest hashed ids of each label, within the bounds."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    # Labels without a document must not use up the sample: they go before the pick.
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    ranked = [known.filter(f"toxic = {k}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k, most in ((1, max_positive), (0, max_negative))]
    sample = ranked[0].unionByName(ranked[1])
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = text.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])
    # One task learns, so that the texts and what they need meanwhile do not stay in the driver's memory.
    rows = rows.select("toxic", F.xxhash64("doc_id").alias("at"), "doc_id", "text").repartition(1)
    found = rows.mapInArrow(_learn, "model binary").collect()
    return pickle.loads(found[0].model) if found else fit(pa.chunked_array([], pa.string()), np.zeros(0), np.zeros(0, np.int64))


def score_toxicity(docs: DataFrame, net: BiGru, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for c in tk.chunks(b.column(1)):
                ids = b.column(0).slice(c.lo, c.hi - c.lo)
                s = model.score(c)
                cols = [ids, pa.array([is_held_out(i) for i in ids.to_pylist()]), pa.array(s), pa.array((s >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "score", "predicted"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, net: BiGru, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that the model rejects; the rows themselves pass through the scorer, so no join is needed."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            good = [model.score(c) < threshold for c in tk.chunks(b.column(place))]
            yield b.filter(pa.array(np.concatenate(good) if good else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
