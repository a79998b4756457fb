"""Best-fit packing of tokenised documents into fixed-length sequences (operator 4).

Semantics. A document's ids are its text's ids (null text: empty) followed by the end id. Documents of at most
``max_len`` ids are one piece; longer ones are cut into pieces of ``max_len``, of which the first may be shorter.
Pieces are never split further. Each piece gets a sequence and an offset; a sequence's pieces lie gapless from 0.
Repeated rows and ids are packed once per row, null ids too. An empty table gives an empty result. Texts of any length are
encoded whole. Extra columns are ignored here, whatever their names.

Method. Bounded-space online best fit: a task holds ``open_bins`` open bins, found through a bitset keyed by free space;
a piece goes to the bin with the least free space that fits; when there is no room for another open bin, the fullest
closes. What tasks leave open is packed again as whole units by fewer tasks, round by round, so the bins that stay
part-filled do not grow with the number of tasks. Only lengths move between tasks, never token ids unless asked for.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ByteBpe
from .common import materialize

MAX_LEN = 1024
END_ID = 2
OPEN_BINS = 1024
#: A task's pieces arrive in this many hashed windows, longest first within each.
WINDOWS = 20
PER_TASK = 40_000
FAN_IN = 16


class BestFit:
    """Online best fit over bins of one size; ``add`` returns (bin, offset)."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.most = size, open_bins
        self.at: list[list[list[int]]] = [[] for _ in range(size + 1)]
        self.bits, self.open, self.made = 0, 0, 0
        self.used: list[int] = []

    def _take(self, free: int) -> int:
        stack = self.at[free]
        found = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def add(self, need: int) -> tuple[int, int]:
        fits = self.bits >> need
        if fits:
            free = need + (fits & -fits).bit_length() - 1
            found = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            found, free = self.made, self.size
            self.made += 1
            self.used.append(0)
        offset = self.size - free
        self.used[found] += need
        if free > need:
            self.at[free - need].append(found)
            self.bits |= 1 << (free - need)
            self.open += 1
        return found, offset

    def left_open(self) -> set[int]:
        return {b for stack in self.at for b in stack}


def _pieces(path: str, max_len: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = ByteBpe.load(path), np.uint32(end_id).astype("<u4").tobytes()
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = bpe.encode(text.as_py() or "") + end
                n = len(ids) // 4
                cuts = [0, *range(n - max_len * (math.ceil(n / max_len) - 1), n, max_len), n]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    part = ids[4 * a : 4 * b]
                    for col, v in zip(cols, (doc, k, a, b - a, zlib.crc32(part), np.frombuffer(part, "<i4") if with_ids else None), strict=True):
                        col.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)][: len(names)], names=names)

    return run


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_pieces(tokenizer_path, max_len, end_id, with_ids), schema)


def _pack(size: int, open_bins: int, round_no: int):
    """Rows (unit, need, ...) -> (unit, bin, at, still_open); a bin's id names its round, task and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (round_no << 58) | (TaskContext.get().partitionId() << 36)
        fit, units, bins, offs = BestFit(size, open_bins), [], [], []
        for b in batches:
            units.append(b.column(0))
            for need in b.column(1).to_pylist():
                found, offset = fit.add(need)
                bins.append(found)
                offs.append(offset)
        if not bins:
            return
        is_open = np.zeros(fit.made, bool)
        is_open[list(fit.left_open())] = True
        own, used = np.array(bins, np.int64), np.array(fit.used, np.int64)
        units = pa.chunked_array(units).combine_chunks()
        yield pa.RecordBatch.from_arrays(
            [units, pa.array(own + base), pa.array(np.array(offs, np.int64)), pa.array(is_open[own]), pa.array(used[own])],
            names=["unit", "bin", "at", "still_open", "used"],
        )

    return run


def _round(units: DataFrame, kind: str, parts: int, size: int, open_bins: int, round_no: int) -> DataFrame:
    """units(unit, need): packed by ``parts`` tasks in an order that does not depend on how rows arrive."""
    dealt = units.withColumn("h", F.xxhash64("unit")).repartition(parts, "h")
    dealt = dealt.sortWithinPartitions(F.pmod(F.xxhash64("h"), F.lit(WINDOWS)), F.desc("need"), "unit").select("unit", "need")
    out = dealt.mapInArrow(_pack(size, open_bins, round_no), f"unit {kind}, bin long, at long, still_open boolean, used long")
    return materialize(out, f"pack{round_no}")


def pack_pieces(pieces: DataFrame, max_len: int = MAX_LEN, open_bins: int = OPEN_BINS, per_task: int = PER_TASK) -> DataFrame:
    """pieces(doc_id, piece, length, ...) -> the same with (sequence_id, offset); full pieces are sequences of their own.

    A hot source or document weighs nothing here: units are dealt by a hash of their own number."""
    pieces = pieces.withColumn("unit", F.monotonically_increasing_id())
    pieces = materialize(pieces, "pieces")
    short = pieces.filter(F.col("length") < max_len).select("unit", F.col("length").alias("need"))
    parts = max(1, math.ceil(short.count() / per_task))
    placed = _round(short, "long", parts, max_len, open_bins, 1)
    links = []
    level, round_no = placed, 1
    while parts > 1:
        parts, round_no = max(1, parts // FAN_IN), round_no + 1
        left = level.filter("still_open").select(F.col("bin").alias("unit"), F.col("used").alias("need")).distinct()
        level = _round(left, "long", parts, max_len, open_bins, round_no)
        links.append(level)
    out = placed.select("unit", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    for level in links:
        up = level.select(F.col("unit").alias("sequence_id"), F.col("bin").alias("_up"), F.col("at").alias("_at"))
        out = out.join(up, "sequence_id", "left").select("unit", F.coalesce("_up", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("_at", F.lit(0))).alias("offset"))
    own = F.col("unit") + F.lit(1 << 62)
    return pieces.join(out, "unit", "left").withColumn("offset", F.coalesce("offset", F.lit(0)).cast("long")).withColumn("sequence_id", F.coalesce("sequence_id", own)).drop("unit")


def best_fit_packing(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, open_bins: int = OPEN_BINS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset."""
    return pack_pieces(tokenize_pieces(docs, tokenizer_path, max_len, with_ids=with_ids), max_len, open_bins)
