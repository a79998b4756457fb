"""MinHash near-dedup: universal-hash minima, banding, signature verification, exact confirmation, components.

Semantics (operator 1). Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased. A document's set
holds its distinct ``SHINGLE``-word shingles; with fewer words the whole sequence is the one element; a text that is null,
empty or blank has the empty set and links with nothing (it is its own component). Two documents are linked when
100 * |intersection| >= threshold_pct * |union|. ``component_id`` is the smallest id reachable; ties cannot occur as ids
are compared. A null id is linked with nothing and kept, with a null component. Rows repeated with the same id count once for links and are returned once each. An empty table gives an
empty result. Extra columns are ignored, whatever their names.

How it scales. Documents of equal sets are collapsed to one representative first (by a salted group minimum). Every
repeated band bucket is compared with one pivot, the member that shares most buckets, so a bucket of n costs n rows and
not n squared. Buckets whose members are not all in one component after that are compared in blocks of bounded size,
members of the same component excepted, so that no link between different texts is lost to the choice of pivots. There a
bound on the difference of the sets comes first: their parity bits differ in at most as many places as the sets do, so a
pair that it rules out is no link, and near misses of a large group do not become candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import checked_broadcast, materialize, salt_of, shuffle_parts, with_group_min
from .components import connected_components

SHINGLE = 5
BANDS, ROWS = 26, 5
#: Minima kept for the estimate of a pair's similarity; the first BANDS * ROWS also make the bands.
HASHES = 320
#: Of pairs exactly at the threshold, the estimate leaves out at most this share.
MISSED = 3e-5
BLOCK = 256
#: Parity bits of a set: the power of two next above PARITY a shingle, within these bounds.
PARITY, PARITY_LEAST, PARITY_MOST = 4, 256, 1 << 15
#: Members that share one copy of a pivot's text when links are confirmed.
MEMBERS = 64

_RNG = np.random.default_rng(97)
_MUL = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)

SKETCH = "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, sig binary, parity binary"


def shingle_sets(c: tk.Chunk) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a chunk."""
    starts, ends, counts = tk.word_bounds(c)
    words = tk.word_hashes(c, starts, ends, lower=True)
    runs = tk.window_hashes(words, SHINGLE)
    first = np.concatenate([[0], np.cumsum(counts)])
    out = []
    for i, n in enumerate(counts):
        a = first[i]
        if n >= SHINGLE:
            out.append(np.unique(runs[a : a + n - SHINGLE + 1]))
        elif n:
            out.append(tk.mix(tk.window_hashes(words[a : a + n], n) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """HASHES x len(starts): for each universal hash, the minimum over each run of ``values``."""
    out = np.empty((HASHES, len(starts)), np.uint64)
    t = np.empty_like(values)
    for k in range(HASHES):
        np.multiply(values, _MUL[k], out=t)
        np.add(t, _ADD[k], out=t)
        out[k] = np.minimum.reduceat(t, starts)
    return out


def parity_bits(mixed: np.ndarray, n: np.ndarray) -> list[bytes]:
    """For runs of ``n`` hashes each: the parity of how many fall in each place; a set's places halve by xor of the halves."""
    wide = np.array([min(max(1 << (PARITY * int(k)).bit_length(), PARITY_LEAST), PARITY_MOST) for k in n], np.int64)
    ends = np.cumsum(wide)
    at = (mixed & np.repeat(wide - 1, n).astype(np.uint64)).astype(np.int64) + np.repeat(ends - wide, n)
    packed = np.packbits((np.bincount(at, minlength=ends[-1]) & 1).astype(np.uint8))
    return [packed[(e - w) // 8 : e // 8].tobytes() for e, w in zip(ends.tolist(), wide.tolist(), strict=True)]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary()), ("parity", pa.binary())]
    )
    for batch in batches:
        ids = batch.column(0)
        for c in tk.chunks(batch.column(1), 1 << 19):
            sets = shingle_sets(c)
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            bands, sigs, parity = [[]] * len(sets), [b""] * len(sets), [b""] * len(sets)
            fp = np.zeros((2, len(sets)), np.uint64)
            if len(full):
                values = np.concatenate([sets[i] for i in full])
                starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                low = minima(values, starts)
                keys = np.zeros((BANDS, len(full)), np.uint64)
                low >>= np.uint64(48)
                for b in range(BANDS):
                    for r in range(ROWS):
                        keys[b] = tk.mix(keys[b] + low[b * ROWS + r] + np.uint64(b + 1))
                short = low.astype("<u2").T.copy()
                for j, i in enumerate(full):
                    bands[i], sigs[i] = keys[:, j].view(np.int64), short[j].tobytes()
                mixed = tk.mix(values)
                for i, bits in zip(full, parity_bits(mixed, n[full]), strict=True):
                    parity[i] = bits
                fp[0, full] = np.add.reduceat(mixed, starts)
                fp[1, full] = np.add.reduceat(tk.mix(values ^ np.uint64(0x5851F42D4C957F2D)), starts)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(c.lo, c.hi - c.lo).cast(pa.int64()), pa.array(n), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary()), pa.array(parity, pa.binary())],
                schema=schema,
            )


def _agreeing(slack_from: float):
    """Keep the pairs of signatures whose estimated similarity reaches ``slack_from``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<u2").reshape(-1, HASHES) for k in (2, 3))
            yield b.select([0, 1]).filter(pa.array((left == right).mean(axis=1) >= slack_from))

    return run


def _confirm(pct: int):
    """Rows sorted by (pivot, part, is_member): test each member's set against its pivot's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base = None, None
        for b in batches:
            pivots, parts, member, ids = (b.column(k).to_pylist() for k in range(4))
            good_a, good_b = [], []
            for c in tk.chunks(b.column(4), 1 << 19):
                for i, s in zip(range(c.lo, c.hi), shingle_sets(c), strict=True):
                    if not member[i]:
                        key, base = (pivots[i], parts[i]), s
                    elif key == (pivots[i], parts[i]):
                        both = len(np.intersect1d(base, s, assume_unique=True))
                        if 100 * both >= pct * (len(base) + len(s) - both) and both:
                            good_a.append(pivots[i])
                            good_b.append(ids[i])
            yield pa.RecordBatch.from_arrays([pa.array(good_a, pa.int64()), pa.array(good_b, pa.int64())], names=["a", "b"])

    return run


def confirm_links(docs: DataFrame, pairs: DataFrame, pct: int) -> DataFrame:
    """Of ``pairs``(pivot, doc_id), those whose full shingle sets reach the threshold, as edges (a, b).

    A pivot's members are dealt over parts; each part streams past one copy of the pivot's set, so memory is bounded by two texts."""
    spark = docs.sparkSession
    dealt = pairs.withColumn("part", salt_of("doc_id", MEMBERS))
    roles = dealt.select("doc_id", "pivot", "part", F.lit(1).alias("member")).unionByName(
        dealt.select(F.col("pivot").alias("doc_id"), "pivot", "part", F.lit(0).alias("member")).distinct()
    )
    rows = docs.join(checked_broadcast(materialize(roles, "roles")), "doc_id").select("pivot", "part", "member", "doc_id", "text")
    rows = rows.repartition(shuffle_parts(spark), "pivot", "part").sortWithinPartitions("pivot", "part", "member")
    return rows.mapInArrow(_confirm(pct), "a long, b long")


def _folded(parity: list[bytes]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Each set's count of parity bytes, and by such a count a matrix of the sets that have it or more, folded to it."""
    wide = np.array([len(x) for x in parity])
    out = {}
    for w in np.unique(wide).tolist():
        out[w] = np.zeros((len(parity), w // 8), np.uint64)
        for i in np.flatnonzero(wide >= w):
            out[w][i] = np.bitwise_xor.reduce(np.frombuffer(parity[i], np.uint64).reshape(-1, w // 8), axis=0)
    return wide, out


def _block_pairs(floor: float, pct: int):
    """One group is a pair of blocks of a bucket: cross-component pairs whose sizes and parity bits allow a link and whose
    signatures agree.

    A pair that an earlier band brings together as well is left to that band's bucket, so it comes once."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy()
        comp = table.column("comp").to_numpy()
        side = table.column("side").to_numpy()
        n = table.column("n_shingles").to_numpy()
        nth = table.column("nth")[0].as_py()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(-1, HASHES)
        wide, folded = _folded(table.column("parity").to_pylist())
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        out_a, out_b = [], []
        for i in left:
            ok = right[(comp[right] != comp[i]) & ((ids[right] > ids[i]) | (side[i] == 0))]
            ok = ok[100 * np.minimum(n[ok], n[i]) >= pct * np.maximum(n[ok], n[i])]
            narrow = np.minimum(wide[ok], wide[i])
            apart = np.zeros(len(ok), np.int64)
            for w in np.unique(narrow).tolist():
                apart[narrow == w] = np.bitwise_count(folded[w][ok[narrow == w]] ^ folded[w][i]).sum(axis=1)
            ok = ok[(100 + pct) * apart <= (100 - pct) * (n[ok] + n[i])]
            if len(ok):
                same = sig[ok] == sig[i]
                before = same[:, : nth * ROWS].reshape(len(ok), nth, ROWS).all(axis=2).any(axis=1)
                ok = ok[(same.mean(axis=1) >= floor) & ~before]
                out_a += [ids[i]] * len(ok)
                out_b += ids[ok].tolist()
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def least_estimate(threshold_pct: int) -> float:
    """The lowest estimate that a pair at the threshold may have: the tail of the binomial below it is at most MISSED."""
    at, tail, k = threshold_pct / 100, 0.0, 0
    while k < HASHES and (tail := tail + math.comb(HASHES, k) * at**k * (1 - at) ** (HASHES - k)) <= MISSED:
        k += 1
    return k / HASHES


def minhash_components(docs: DataFrame, threshold_pct: int = 85) -> DataFrame:
    """``docs``(doc_id, text, ...) -> (doc_id, n_shingles, component_id, kept) as the module's text defines."""
    if not 80 <= threshold_pct <= 100:
        raise ValueError("threshold_pct must be in 80..100: the bands are chosen for such links")
    floor = least_estimate(threshold_pct)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = materialize(docs.mapInArrow(_sketch, SKETCH), "sketch")

    full = sketches.filter("n_shingles > 0 and doc_id is not null")
    classes = with_group_min(full.select("doc_id", "n_shingles", "fp1", "fp2"), ["n_shingles", "fp1", "fp2"], "doc_id", "rep", by="doc_id")
    classes = materialize(classes.select("doc_id", "n_shingles", "rep"), "classes")
    copies = materialize(classes.filter("doc_id <> rep").select("doc_id").distinct(), "copies")
    own = full.join(checked_broadcast(copies), "doc_id", "left_anti").select("doc_id", "n_shingles", "bands", "sig", "parity")

    flat = own.select("doc_id", F.posexplode("bands").alias("nth", "band"))
    sizes = flat.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    members = materialize(flat.join(sizes, "band"), "members")
    popularity = members.groupBy("doc_id").agg(F.sum("size").alias("shares"))
    ranked = members.join(popularity, "doc_id").select("band", "doc_id", "shares")
    pivots = ranked.groupBy("band").agg(F.max(F.struct("shares", (-F.col("doc_id")).alias("neg"))).alias("top")).select("band", (-F.col("top.neg")).alias("pivot"))
    # Each document is tried against the pivot that it shares most buckets with; ties go to the smaller id.
    pairs = members.join(pivots, "band").filter("doc_id <> pivot").groupBy("doc_id", "pivot").agg(F.count("*").alias("times"))
    best = pairs.groupBy("doc_id").agg(F.max(F.struct("times", (-F.col("pivot")).alias("neg"))).alias("top")).select("doc_id", (-F.col("top.neg")).alias("pivot"))
    sig = own.select("doc_id", "sig")
    signed = best.join(sig, "doc_id").join(sig.select(F.col("doc_id").alias("pivot"), F.col("sig").alias("psig")), "pivot")
    best = signed.select("doc_id", "pivot", "sig", "psig").mapInArrow(_agreeing(floor), "doc_id long, pivot long").distinct()
    best = materialize(best, "near")
    links = materialize(confirm_links(docs, best, threshold_pct), "links")
    labels = connected_components(links)

    # What one pivot a bucket cannot settle: buckets that still hold several components.
    labelled = members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("band", "nth", "doc_id", "size", F.coalesce("component", "doc_id").alias("comp"))
    mixed = labelled.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("band")
    rest = labelled.join(mixed, "band").join(own.drop("bands"), "doc_id")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rest = rest.withColumn("n", blocks).withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("n")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rest = rest.select(
        "band", "nth", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "doc_id", "comp", "n_shingles", "sig", "parity",
        F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    more = rest.groupBy("band", "i", "j").applyInArrow(_block_pairs(floor, threshold_pct), "a long, b long")
    more = more.select(F.least("a", "b").alias("pivot"), F.greatest("a", "b").alias("doc_id")).distinct()
    more = materialize(more.join(best.select("doc_id", "pivot"), ["doc_id", "pivot"], "left_anti").join(best.select(F.col("doc_id").alias("pivot"), F.col("pivot").alias("doc_id")), ["doc_id", "pivot"], "left_anti"), "more")
    if not more.isEmpty():
        found = confirm_links(docs, more, threshold_pct)
        labels = connected_components(links.unionByName(materialize(found, "links")))

    # Component ids are smallest ids: a representative is the smallest of its class.
    by_rep = labels.select(F.col("node").alias("rep"), "component")
    linked = with_component(classes, by_rep)
    empty = sketches.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = linked.unionByName(empty)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def with_component(classes: DataFrame, by_rep: DataFrame) -> DataFrame:
    """Join each document to its representative's component; a hot representative is dealt over salts."""
    salted = classes.withColumn("_s", salt_of("doc_id"))
    keys = salted.select("rep", "_s").distinct().join(by_rep, "rep")
    return salted.join(keys, ["rep", "_s"], "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def near_dedup(docs: DataFrame, threshold_pct: int = 85) -> DataFrame:
    """``docs`` without all but the first document of each component; columns as given. Null ids are kept."""
    kept = minhash_components(docs.filter(F.col("doc_id").isNotNull()), threshold_pct).filter("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.filter(F.col("doc_id").isNull()))
