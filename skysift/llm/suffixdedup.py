"""Exact substring dedup by two-stage suffix sorting (operator 6).

Semantics. Texts are UTF-8 bytes (null: empty); matches never cross documents. Every byte covered by a 100-byte string
that also starts earlier (in a document of smaller id, or earlier in the same one) is removed; overlaps count and strings
are judged on the input. Ids name texts: rows repeated with one id are the same text once and give equal rows. Null ids
match nothing. Texts under 100 bytes lose nothing. An empty table gives an empty result; extra columns are ignored.

How the work is split. Later copies of whole texts are settled by a salted group minimum. In the other texts each 100-byte
window is represented by its minimizer, the 24-byte string in it of least hash, leftmost first; equal windows have equal
minimizers at equal places. Windows in a row with one minimizer form a fragment of at most 76 + 100 bytes. Fragments whose
minimizer occurs once cannot match. Equal fragments are aggregated to their first occurrence. All different fragments of
one minimizer go to one place, where a suffix array over them (Itoh and Tanaka: suffixes smaller than their successors are
sorted directly, the others induced by scanning buckets) and common prefixes of neighbours tell equal windows and the
earliest of each. Where a minimizer has more than ``HOT`` different fragments, so that they cannot meet in one
task, their windows are compared by a salted group minimum over hashes of 128 bits instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import materialize, shuffle_parts, with_group_min

SPAN, GRAM = 100, 24
REACH = SPAN - GRAM + 1
HOT = 20_000
#: Bytes of fragments sorted at once, about.
BLOCK = 1 << 18


def minimizers(h: np.ndarray) -> np.ndarray:
    """Place of the least of each REACH consecutive values, leftmost first."""
    val, pos, width = h, np.arange(len(h), dtype=np.int32), 1
    while width < REACH:
        step = min(width, REACH - width)
        n = len(val) - step
        take = val[step : step + n] < val[:n]
        val, pos, width = np.where(take, val[step : step + n], val[:n]), np.where(take, pos[step : step + n], pos[:n]), width + step
    return pos


def fragments(c: tk.Chunk) -> tuple[np.ndarray, ...]:
    """(row, minimizer hash, fragment hash, first window, windows) of every fragment; windows count within the row."""
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    none = np.zeros(0, np.int64)
    if len(c.data) < SPAN:
        return none, none, none, none, none
    prefix = tk.prefix_hash(c.data, tk.CODES)
    at = np.arange(len(c.data) - GRAM + 1)
    gram = tk.mix((prefix[GRAM:] - prefix[: len(at)]) * tk.powers(len(at), inverse=True))
    for i in range(c.hi - c.lo):
        a, b = c.offs[i], c.offs[i + 1]
        if b - a < SPAN:
            continue
        pos = minimizers(gram[a : b - GRAM + 1]) + a
        first = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]]))
        n = np.diff(np.append(first, len(pos)))
        lo, anchor = first + a, pos[first]
        body = tk.span_hash(prefix, lo, lo + n - 1 + SPAN)
        c_hash = tk.mix(body + tk.mix((anchor - lo).astype(np.uint64) * tk.U(1 << 20) + n.astype(np.uint64)))
        for col, v in zip(out, (np.full(len(first), i), gram[anchor].view(np.int64), c_hash.view(np.int64), first, n), strict=True):
            col.append(v)
    return tuple(np.concatenate(v) if v else none for v in out)


FRAGMENT = "doc_id long, k long, c long, lo int, n int"


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for c in tk.chunks(b.column(1)):
            row, k, h, lo, n = fragments(c)
            ids = b.column(0).slice(c.lo, c.hi - c.lo).take(pa.array(row.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(k), pa.array(h), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc_id", "k", "c", "lo", "n"])


def _words_at(text: np.ndarray) -> np.ndarray:
    """Big-endian 8-byte words at every place; the end is padded with zeros."""
    wide = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    n = len(text)
    out = np.zeros(n, np.uint64)
    for k in range(8):
        out = (out << tk.U(8)) | wide[k : n + k]
    return out


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor (the last one is not)."""
    n = len(text)
    differ = np.flatnonzero(text[1:] != text[:-1])
    nxt = np.searchsorted(differ, np.arange(n))
    out = np.zeros(n, bool)
    ok = nxt < len(differ)
    d = differ[nxt[ok]]
    out[ok] = text[d] < text[d + 1]
    return out


def _sort_directly(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Sort places by the ``depth`` bytes (a multiple of 8) that start there, eight at a time; only ties go on."""
    order = places.copy()
    todo = np.arange(len(order))
    group = np.zeros(len(order), np.int64)
    padded = np.concatenate([words, np.zeros(depth + 8, np.uint64)])
    for step in range(0, depth, 8):
        if not len(todo):
            break
        key = padded[order[todo] + step]
        by = np.lexsort((key, group))
        order[todo], key, group = order[todo][by], key[by], group[by]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
        ids = np.cumsum(new) - 1
        size = np.bincount(ids)
        keep = size[ids] > 1
        todo, group = todo[keep], ids[keep]
    return order


def suffix_array(text: np.ndarray, depth: int = SPAN + 4) -> np.ndarray:
    """Places of ``text`` (uint8) in suffix order, exact for the first ``depth`` bytes; ties beyond are in no set order."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    depth = -(-depth // 8) * 8
    small = smaller_than_next(text)
    direct = _sort_directly(np.flatnonzero(small), _words_at(text), depth)
    by_char = np.searchsorted(text[direct], np.arange(257))
    large = ~small
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1]))  # the empty suffix comes first of all and induces the last place
    out = []
    for ch in np.unique(text).tolist():
        run = np.concatenate(waiting[ch]) if waiting[ch] else np.zeros(0, np.int64)
        parts = [run]
        while len(run):  # places of this bucket that this bucket's own places induce
            before = run[run > 0] - 1
            run = before[large[before] & (text[before] == ch)]
            parts.append(run)
        scan = np.concatenate([*parts, direct[by_char[ch] : by_char[ch + 1]]])
        out.append(scan)
        before = scan[scan > 0] - 1
        before = before[large[before] & (text[before] > ch)]
        chars = text[before]
        order = np.argsort(chars, kind="stable")
        before, chars = before[order], chars[order]
        cuts = np.append(np.flatnonzero(np.diff(chars, prepend=chars[:1] ^ 1)), len(chars))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            waiting[chars[a]].append(before[a:b])
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int = SPAN) -> np.ndarray:
    """Bytes that each place of ``order`` shares with the one before it, at most ``most`` (a multiple of 4)."""
    words = np.concatenate([_words_at(text), np.zeros(most + 8, np.uint64)])
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for step in range(0, most, 8):
        diff = words[order[live] + step] ^ words[order[live - 1] + step]
        same = diff == 0
        stop = live[~same]
        # Leading equal bytes of the word that differs.
        out[stop] = step + ((63 - np.floor(np.log2(diff[~same].astype(np.float64)))).astype(np.int64) // 8)
        live = live[same]
    out[live] = most
    return np.minimum(out, most)


def earliest_windows(parts: list[bytes], docs: np.ndarray, starts: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """For each fragment, True at the windows that an earlier (document, start) of any fragment here equals."""
    text = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8)
    size = np.array([len(p) for p in parts])
    base = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    owner = np.full(len(text), -1)
    for i in range(len(parts)):
        owner[base[i] : base[i] + n[i]] = i
    order = suffix_array(text)
    order = order[owner[order] >= 0]
    group = np.cumsum(common_prefixes(text, order) < SPAN)
    who = owner[order]
    start = starts[who] + order - base[who]
    by = np.lexsort((start, docs[who], group))
    group, who, start, order = group[by], who[by], start[by], order[by]
    lead = np.concatenate([[True], group[1:] != group[:-1]])
    first = np.maximum.accumulate(np.where(lead, np.arange(len(group)), 0))
    later = (docs[who] != docs[who[first]]) | (start != start[first])
    flags = np.zeros(len(text), bool)
    flags[order] = later
    return [flags[base[i] : base[i] + n[i]] for i in range(len(parts))]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, want array<struct<k, lo, n>>) -> (k, doc_id, lo, n, body) of each wanted fragment."""
    for b in batches:
        rows: list[list] = [[], [], [], [], []]
        wants = b.column(2).to_pylist()
        for c in tk.chunks(b.column(1)):
            data = c.data.tobytes()
            for i in range(c.hi - c.lo):
                doc, base = b.column(0)[c.lo + i].as_py(), int(c.offs[i])
                for w in wants[c.lo + i]:
                    body = data[base + w["lo"] : base + w["lo"] + w["n"] - 1 + SPAN]
                    for col, v in zip(rows, (w["k"], doc, w["lo"], w["n"], body), strict=True):
                        col.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds, strict=True)], names=["k", "doc_id", "lo", "n", "body"])


def _cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, doc_id, lo, n, body) -> (k, w, doc_id, lo): every window of a fragment with a hash of its bytes."""
    for b in batches:
        for c in tk.chunks(b.column(4).cast(pa.large_binary()).view(pa.large_string())):
            n = b.column(3).to_numpy()[c.lo : c.hi].astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = c.offs[:-1][row] + j
            w = tk.mix(tk.span_hash(tk.prefix_hash(c.data, tk.CODES), at, at + SPAN))
            k, doc, lo = (b.column(x).to_numpy()[c.lo : c.hi] for x in (0, 1, 2))
            yield pa.RecordBatch.from_arrays([pa.array(k[row]), pa.array(w.view(np.int64)), pa.array(doc[row]), pa.array((lo[row] + j).astype(np.int32))], names=["k", "w", "doc_id", "lo"])


def _sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by k -> (doc_id, lo, hi): runs of windows that start earlier elsewhere. A k is never cut."""
    held: list[tuple] = []
    size = 0

    def done(rows: list[tuple]) -> pa.RecordBatch:
        docs, starts, n = (np.array([r[j] for r in rows], np.int64) for j in (1, 2, 3))
        ids, lo, hi = [], [], []
        if len(rows) > 1:
            for i, flags in enumerate(earliest_windows([r[4] for r in rows], docs, starts, n)):
                a, b = _runs(flags)
                ids += [rows[i][1]] * len(a)
                lo += (a + starts[i]).tolist()
                hi += (b + starts[i] - 1).tolist()
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["doc_id", "lo", "hi"])

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and size >= BLOCK and row[0] != held[-1][0]:
                yield done(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4]) + 1
    if held:
        yield done(held)


def removed_windows(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text), no two texts equal -> (doc_id, lo, hi): runs of windows that start earlier elsewhere."""
    spark = docs.sparkSession
    found = materialize(docs.mapInArrow(_emit, FRAGMENT), "fragments")
    again = found.groupBy("k").agg(F.count("*").alias("_m")).filter("_m > 1").select("k")
    found = materialize(found.join(again, "k"), "repeated")
    firsts = found.groupBy("k", "c", "n").agg(F.min(F.struct("doc_id", "lo")).alias("first"), F.max(F.struct("doc_id", "lo")).alias("last"))
    firsts = materialize(firsts, "firsts")
    copied = firsts.filter("first <> last").select("k", "c", "n", "first")
    copies = found.join(copied, ["k", "c", "n"]).filter(F.struct("doc_id", "lo") != F.col("first")).select("doc_id", "lo", (F.col("lo") + F.col("n") - 1).alias("hi"))

    kinds = materialize(firsts.groupBy("k").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "kinds")
    cold, hot = (_bodies(docs, firsts.join(kinds.filter(rule), "k")) for rule in (f"kinds <= {HOT}", f"kinds > {HOT}"))
    dealt = cold.repartition(shuffle_parts(spark), "k").sortWithinPartitions("k", "doc_id", "lo")
    out = copies.unionByName(dealt.mapInArrow(_sort_blocks, "doc_id long, lo int, hi int"))
    if not kinds.filter(f"kinds > {HOT}").isEmpty():
        windows = materialize(hot.mapInArrow(_cut_windows, "k long, w long, doc_id long, lo int").select("k", "w", F.struct("doc_id", "lo").alias("at")), "windows")
        later = with_group_min(windows, ["k", "w"], "at", "lead", by="at").filter("at <> lead")
        out = out.unionByName(later.select("at.doc_id", "at.lo", F.col("at.lo").alias("hi")))
    return out


def _bodies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of fragments (k, first, n), read from their documents."""
    want = wanted.groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("k", F.col("first.lo").alias("lo"), "n")).alias("want"))
    want = materialize(want, "want")
    return docs.join(want, "doc_id").select("doc_id", "text", "want").mapInArrow(_cut_texts, "k long, doc_id long, lo int, n int, body binary")


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _kept(n: int, runs: list | None, copy: bool) -> np.ndarray:
    """True at the bytes that stay."""
    if copy:
        return np.full(n, n < SPAN)
    mark = np.zeros(n + 1, np.int32)
    if runs:
        r = np.array([(x["lo"], x["hi"] + SPAN) for x in runs])
        np.add.at(mark, r[:, 0], 1)
        np.add.at(mark, r[:, 1], -1)
    return np.cumsum(mark[:-1]) == 0


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, tk.Chunk, int, np.ndarray]]:
    for b in batches:
        copy, runs = b.column(2).to_pylist(), b.column(3).to_pylist()
        for c in tk.chunks(b.column(1)):
            yield b, c, c.lo, [_kept(int(c.offs[i + 1] - c.offs[i]), runs[c.lo + i], bool(copy[c.lo + i])) for i in range(c.hi - c.lo)]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, c, _, keeps in _rows(batches):
        size, gone, spans, sha = [], [], [], []
        for i, keep in enumerate(keeps):
            data = c.data[c.offs[i] : c.offs[i + 1]]
            size.append(len(data))
            gone.append(int(len(keep) - keep.sum()))
            spans.append(len(_runs(~keep)[0]))
            sha.append(hashlib.sha256(data[keep].tobytes()).hexdigest())
        cols = [b.column(0).slice(c.lo, c.hi - c.lo), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, c, _, keeps in _rows(batches):
        kept = [c.data[c.offs[i] : c.offs[i + 1]][keep].tobytes() for i, keep in enumerate(keeps)]
        yield pa.RecordBatch.from_arrays([b.column(0).slice(c.lo, c.hi - c.lo), pa.array(kept, pa.binary())], names=["doc_id", "kept"])


def _decided(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _copy, _runs) of every document."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    named = plain.filter("doc_id is not null")
    keys = named.select("doc_id", F.unhex(F.md5("text")).alias("m"), F.octet_length("text").alias("size"))
    later = with_group_min(keys, ["m", "size"], "doc_id", "lead", by="doc_id").filter("doc_id <> lead")
    later = materialize(later.groupBy("doc_id").agg(F.collect_set("lead").alias("leads")), "copies")
    flagged = plain.join(later, "doc_id", "left").select("doc_id", "text", F.col("leads").isNotNull().alias("_copy"))
    runs = removed_windows(flagged.filter("doc_id is not null and not _copy").select("doc_id", "text"))
    runs = materialize(runs.groupBy("doc_id").agg(F.collect_set(F.struct("lo", "hi")).alias("_runs")), "runs")
    return flagged.join(runs, "doc_id", "left").select("doc_id", "text", "_copy", "_runs")


def suffix_dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of every document."""
    return _decided(docs).mapInArrow(_digest, DIGEST)


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, kept binary): what stays of every text; bytes, as a cut may fall inside a character."""
    return _decided(docs).mapInArrow(_texts, "doc_id long, kept binary")


SQL = r"""
WITH t AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM t WHERE n >= 100)),
f AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM f),
i AS (SELECT doc_id, p, sum(CASE WHEN gap <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM g),
r AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY doc_id, r),
k AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS from_ FROM r),
parts AS (SELECT k.doc_id, sum(b - a)::BIGINT AS gone, count(*) AS spans, max(b) AS last, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) AS head FROM k JOIN t USING (doc_id) GROUP BY k.doc_id)
SELECT t.doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN gone IS NULL THEN h ELSE coalesce(head, '') || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM t LEFT JOIN parts ON parts.doc_id = t.doc_id
"""
