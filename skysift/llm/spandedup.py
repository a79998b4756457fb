"""Substring dedup over sliding sentence spans (operator 3).

Semantics. A sentence ends at a word whose last byte is one of ``.!?`` or that a line feed follows, and at the end of the
text; words are runs of bytes other than space and 0x09-0x0D. A run of consecutive sentences of one text counts when it
makes at least ``MIN_SENTENCES`` sentences and ``MIN_WORDS`` words, or at least ``LONG_WORDS`` words. Two runs are equal
when their words are. Runs are ordered by (doc_id, sentence); every sentence covered by a run that is not the first of its
equals is removed, judged on the input, with the white space behind it. Spans with hashes of 64 bits taken together over sentence bounds stand for their words. Null and
empty texts have no sentences and come through unchanged; null ids come through unchanged; rows repeated with one id are
taken as one text repeated and lose the same sentences. An empty table gives an empty result; extra columns pass through.

Of all runs, two sorts of spans stand for the rest: from every sentence the fewest that count, and up to every sentence the
fewest that count. In a run that repeats sentence by sentence, each sentence either starts a span that ends within the run
or lies in the span up to the run's end, and both repeat with it. Only where a line feed splits the same words differently
in two texts can a run repeat without its spans.

Spans are aggregated by hash with map-side partials; only hashes that repeat come back, in a sort-merge join whose hot
keys adaptive execution splits. A document's covered spans are bounded by its own sentences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import fresh, materialize

MIN_SENTENCES, MIN_WORDS, LONG_WORDS = 2, 20, 50

_STOP = np.zeros(256, bool)
_STOP[[ord(ch) for ch in ".!?"]] = True


def sentences(c: tk.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, first word and end word of each sentence, sentences by row, first byte of each sentence."""
    starts, ends, counts = tk.word_bounds(c)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(counts), np.int64), none
    words = tk.word_hashes(c, starts, ends, lower=False)
    feeds = np.concatenate([[0], np.cumsum(c.data == 10)])
    nxt = np.append(starts[1:], len(c.data))
    stop = _STOP[c.data[ends - 1]] | (feeds[nxt] > feeds[ends])
    last = np.cumsum(counts)[counts > 0] - 1
    stop[last] = True
    end = np.flatnonzero(stop) + 1
    first = np.concatenate([[0], end[:-1]])
    per_row = np.diff(np.searchsorted(first, np.concatenate([[0], np.cumsum(counts)])))
    return words, first, end, per_row, starts[first]


def spans(c: tk.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, sentence within the row, sentences, hash) of every span."""
    words, first, end, per_row, _ = sentences(c)
    if not len(first):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(per_row)), per_row)
    base = np.concatenate([[0], np.cumsum(per_row)])
    at = np.arange(len(first))
    # The first sentence whose end gives enough words, by search over sentence ends.
    by_words = np.maximum(np.searchsorted(end, first + MIN_WORDS, "left"), at + MIN_SENTENCES - 1)
    by_length = np.searchsorted(end, first + LONG_WORDS, "left")
    stop = np.minimum(by_words, by_length)
    ok = stop < base[row + 1]
    # The last sentence whose start gives enough words, by search over sentence starts.
    by_words = np.minimum(np.searchsorted(first, end - MIN_WORDS, "right") - 1, at - MIN_SENTENCES + 1)
    by_length = np.searchsorted(first, end - LONG_WORDS, "right") - 1
    back = np.maximum(by_words, by_length)
    new = back >= base[row]
    # Spans that are found from both ends are given once.
    new[new] = stop[back[new]] != at[new]
    at, stop, row = np.concatenate([at[ok], back[new]]), np.concatenate([stop[ok], at[new]]), np.concatenate([row[ok], row[new]])
    prefix = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * tk.powers(len(words)), out=prefix[1:])
    a, b = first[at], end[stop]
    h = tk.mix(tk.span_hash(prefix, a, b) + (b - a).astype(np.uint64) * tk.U(0xD6E8FEB86659FD93))
    return row, at - base[row], stop - at + 1, h


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for c in tk.chunks(b.column(1)):
            row, s, k, h = spans(c)
            ids = b.column(0).slice(c.lo, c.hi - c.lo).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([ids, pa.array(s.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(h.view(np.int64))], names=["doc_id", "s", "k", "h"])


def covered_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<s, k>>) of the documents with spans that are not the first of their equals."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    rows = materialize(plain.mapInArrow(_emit, "doc_id long, s int, k int, h long"), "spans")
    first = rows.groupBy("h").agg(F.min(F.struct("doc_id", "s")).alias("lead"), F.max(F.struct("doc_id", "s")).alias("last")).filter("lead <> last").select("h", "lead")
    later = rows.join(first, "h").filter(F.struct("doc_id", "s") != F.col("lead"))
    return later.groupBy("doc_id").agg(F.collect_set(F.struct("s", "k")).alias("_spans"))


def _cut(place: int, spans_at: int, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, total, gone = [], [], []
            marks = b.column(spans_at).to_pylist()
            for c in tk.chunks(b.column(place)):
                _, _, _, per_row, begin = sentences(c)
                base = np.concatenate([[0], np.cumsum(per_row)])
                for i in range(c.hi - c.lo):
                    own, n = marks[c.lo + i], int(per_row[i])
                    data = c.data[c.offs[i] : c.offs[i + 1]]
                    drop = np.zeros(n, bool)
                    for m in own or ():
                        drop[m["s"] : m["s"] + m["k"]] = True
                    if drop.any():
                        # A sentence owns the bytes up to the next one's start; what stands before the first is kept.
                        at = np.append(begin[base[i] : base[i + 1]] - c.offs[i], len(data))
                        keep = np.concatenate([np.ones(at[0], bool), np.repeat(~drop, np.diff(at))])
                        data = data[keep]
                    texts.append(data.tobytes().decode("utf-8", "replace"))
                    total.append(n)
                    gone.append(int(drop.sum()))
            old = b.column(place)
            new = pa.array([t if v else None for t, v in zip(texts, old.is_valid().to_pylist(), strict=True)], pa.string())
            cols = [new if k == place else b.column(k) for k in range(b.num_columns) if k != spans_at]
            names = [b.schema.names[k] for k in range(b.num_columns) if k != spans_at]
            if counts:
                cols, names = [*cols, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_sentences", "n_removed"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def dedup_spans(docs: DataFrame, counts: bool = False) -> DataFrame:
    """``docs`` with covered sentences cut from ``text``; with ``counts``, also n_sentences and n_removed."""
    of, spans_ = fresh(docs.columns, "span_id", "spans")
    marks = materialize(covered_spans(docs).select(F.col("doc_id").alias(of), F.col("_spans").alias(spans_)), "covered")
    rows = docs.withColumn("text", F.col("text").cast("string"))
    rows = rows.join(marks, F.col("doc_id").cast("long") == F.col(of), "left").drop(of)
    names = rows.columns
    schema = rows.drop(spans_).schema
    if counts:
        schema = schema.add("n_sentences", "long").add("n_removed", "long")
    return rows.mapInArrow(_cut(names.index("text"), names.index(spans_), counts), schema)


def span_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_removed and the sha256 of the text that stays, of every document."""
    out = dedup_spans(docs.select("doc_id", "text"), counts=True)
    return out.select("doc_id", "n_sentences", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, str | None]:
    """The definition over every run, row by row in plain Python; for tests. Hashes mod a prime of 127 bits stand for words."""
    parsed, seen, drop = {}, set(), {}
    prime, power = (1 << 127) - 1, [1]
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        words, at = [], 0
        for w in data.split():
            at = data.index(w, at)
            words.append((at, at + len(w)))
            at += len(w)
        out, begin = [], 0
        for i, (_, e) in enumerate(words):
            nxt = words[i + 1][0] if i + 1 < len(words) else len(data)
            if data[e - 1 : e] in (b".", b"!", b"?") or b"\n" in data[e:nxt] or i + 1 == len(words):
                out.append((begin, i + 1))
                begin = i + 1
        parsed[doc] = (data, words, out)
        drop[doc] = set()
        prefix = [0]
        for x, y in words:
            prefix.append((prefix[-1] * 1_000_003 + int.from_bytes(hashlib.sha256(data[x:y]).digest()[:15], "big")) % prime)
        while len(power) < len(prefix):
            power.append(power[-1] * 1_000_003 % prime)
        for s in range(len(out)):
            covered = 0
            for k in range(1, len(out) - s + 1):
                a, b = out[s][0], out[s + k - 1][1]
                if (k >= MIN_SENTENCES and b - a >= MIN_WORDS) or b - a >= LONG_WORDS:
                    key = (prefix[b] - prefix[a] * power[b - a]) % prime
                    if key in seen:
                        covered = k
                    seen.add(key)
            drop[doc] |= set(range(s, s + covered))
    final = {}
    for doc, text in rows:
        data, words, out = parsed[doc]
        cuts = [words[a][0] for a, _ in out] + [len(data)]
        kept = data[: cuts[0]] + b"".join(data[cuts[i] : cuts[i + 1]] for i in range(len(out)) if i not in drop[doc])
        final[doc] = None if text is None else kept.decode()
    return final


def sha256(text: str | None) -> str | None:
    return None if text is None else hashlib.sha256(text.encode()).hexdigest()
