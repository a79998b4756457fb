"""Media columns: AVI motion-JPEG written, parsed, decoded and cut into timed clips (operator 8).

Semantics. A text (null: empty) becomes UTF-8 bytes, padded with 255 to a positive multiple of 576: a payload of whole
frames of 24 x 24 grey pixels, nine blocks of 64. A frame stores its 576 bytes losslessly as the quantised coefficients of
a baseline JPEG (the format's unit): the only Huffman symbol is "run 0, size 8", whose eight extra bits are the byte, and a
restart marker after each block keeps the DC term unpredicted. Frames go into an AVI file with an ``idx1`` index.
Reading parses RIFF, follows the index, decodes the intra frames to coefficients and pixels, and detects shots: the
histogram difference of neighbouring frames must exceed the mean plus ``K`` deviations of the ``SPAN`` differences before
it in the same file, and ``FLOOR``. Equal texts give equal values. Every row gives one row, repeated rows equal rows; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk

SIDE, BLOCKS = 24, 9
FRAME = SIDE * SIDE
FPS = 25
BINS = 16
SPAN, K, FLOOR = 8, 2.0, 0.12


def _zigzag() -> np.ndarray:
    """Raster position of each zigzag place: diagonals alternate direction."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * y + x for y, x in cells])


ZIGZAG = _zigzag()


def _idct_matrix() -> np.ndarray:
    """64 x 64: zigzag coefficients to raster samples."""
    u = np.arange(8)
    basis = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16) / 2
    basis[:, 0] /= np.sqrt(2)
    return np.kron(basis, basis).T[ZIGZAG].astype(np.float32)


IDCT = _idct_matrix()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def jpeg_header() -> bytes:
    """All of a frame before its entropy-coded data."""
    one_symbol = bytes([1] + [0] * 15 + [8])
    return (
        b"\xff\xd8"
        + _segment(0xDB, b"\0" + b"\1" * 64)
        + _segment(0xC0, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + bytes([1, 0x11, 0]))
        + _segment(0xC4, b"\x00" + one_symbol + b"\x10" + one_symbol)
        + _segment(0xDD, struct.pack(">H", 1))
        + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    )


HEADER = jpeg_header()


def _nine_bits(payload: np.ndarray) -> np.ndarray:
    """(n, 8) bytes -> (n, 9): each byte behind a zero bit, the code of the only symbol."""
    out = np.empty((len(payload), 9), np.uint8)
    for k in range(8):
        out[:, k] = payload[:, k] >> (k + 1) if k < 7 else 0
        if k:
            out[:, k] |= (payload[:, k - 1] & ((1 << k) - 1)) << (8 - k)
    out[:, 8] = payload[:, 7]
    return out


def _eight_bits(coded: np.ndarray) -> np.ndarray:
    out = np.empty((len(coded), 8), np.uint8)
    for k in range(8):
        if np.any(coded[:, k] & (0x80 >> k)):
            raise ValueError("a code that the table does not have")
        out[:, k] = ((coded[:, k] & ((1 << (7 - k)) - 1)) << (k + 1)) | (coded[:, k + 1] >> (7 - k))
    return out


def encode_frames(payload: np.ndarray) -> list[bytes]:
    """payload (uint8, a multiple of 576) -> one JPEG file for each frame."""
    frames = len(payload) // FRAME
    scan = np.empty((frames, BLOCKS, 74), np.uint8)
    scan[:, :, :72] = _nine_bits(payload.reshape(-1, 8)).reshape(frames, BLOCKS, 72)
    scan[:, :, 72] = 0xFF
    scan[:, :, 73] = 0xD0 + np.arange(BLOCKS) % 8
    scan[:, -1, 73] = 0xD9
    stuffed = scan == 0xFF
    stuffed[:, :, 72] = False
    flat = np.insert(scan.reshape(-1), np.flatnonzero(stuffed) + 1, 0).tobytes()
    ends = np.cumsum(BLOCKS * 74 + stuffed.reshape(frames, -1).sum(axis=1)).tolist()
    return [HEADER + flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes]) -> bytes:
    sizes = np.array([len(f) for f in frames], np.int64)
    padded = sizes + (sizes & 1)
    index = np.zeros((len(frames), 4), "<u4")
    index[:, 0] = int.from_bytes(b"00dc", "little")
    index[:, 1] = 0x10  # a key frame
    index[:, 2] = 4 + np.concatenate([[0], np.cumsum(padded + 8)[:-1]])
    index[:, 3] = sizes
    main = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, len(frames), 0, 1, int(sizes.max()), SIDE, SIDE, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4h", 0, 0, 0, 0, 1, FPS, 0, len(frames), int(sizes.max()), 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    picture = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", picture)))
    movi = _chunk(b"LIST", b"movi" + b"".join([x for f in frames for x in (b"00dc", struct.pack("<I", len(f)), f, b"\0" * (len(f) & 1))]))
    return _chunk(b"RIFF", b"AVI " + head + movi + _chunk(b"idx1", index.tobytes()))


def read_avi(data: bytes) -> tuple[list[bytes], float]:
    """The frames that the index names, in order, and seconds per frame; damage raises ValueError."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    end, at = 8 + int.from_bytes(data[4:8], "little"), 12
    movi, index, step = None, None, 1 / FPS
    while at + 8 <= min(end, len(data)):
        tag, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        kind = data[at + 8 : at + 12]
        if tag == b"LIST" and kind == b"movi":
            movi = at + 8
        elif tag == b"LIST" and kind == b"hdrl" and data[at + 12 : at + 16] == b"avih":
            step = int.from_bytes(data[at + 20 : at + 24], "little") / 1e6
        elif tag == b"idx1":
            index = np.frombuffer(data, "<u4", size // 4, at + 8).reshape(-1, 4)
        at += 8 + size + (size & 1)
    if movi is None or index is None:
        raise ValueError("no movi list or no index")
    out = []
    for off, size in index[:, 2:].tolist():
        a = movi + off + 8
        if a + size > len(data) or data[a - 8 : a - 4] != b"00dc":
            raise ValueError("the index points outside the frames")
        out.append(data[a : a + size])
    return out, step


def _tables(frame: bytes) -> tuple[dict, int]:
    """Parsed segments of a JPEG file and where its entropy-coded data begins."""
    at, found = 2, {"huff": {}, "quant": {}, "restart": 0}
    while True:
        if frame[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker, size = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                found["quant"][body[0] & 15] = np.frombuffer(body[1:65], np.uint8).astype(np.float32)
                body = body[65:]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                found["huff"][body[0]] = (tuple(body[1:17]), tuple(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xC0:
            found["size"], found["parts"] = struct.unpack(">HH", body[1:5]), body[5]
            found["table"] = body[8]
        elif marker == 0xDD:
            found["restart"] = int.from_bytes(body, "big")
        elif marker == 0xDA:
            found["scan"] = (body[2] >> 4, 16 + (body[2] & 15))
            return found, at


def _scan_any(data: bytes, spec: dict) -> np.ndarray:
    """Coefficients (blocks, 64) of any one-component baseline scan, bit by bit; for files that others wrote."""
    if spec.get("parts") != 1:
        raise ValueError("only one-component frames")
    books = []
    for ref in spec["scan"]:
        counts, symbols = spec["huff"][ref]
        book, code, k = {}, 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                book[length, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        books.append(book)
    height, width = spec["size"]
    out = np.zeros((((height + 7) // 8) * ((width + 7) // 8), 64), np.int32)
    parts, at, i = [], 0, 0
    while i < len(data) - 1:  # cut at restart markers, drop stuffing
        if data[i] == 0xFF and data[i + 1] != 0:
            parts.append(data[at:i].replace(b"\xff\0", b"\xff"))
            at = i + 2
            i += 1
        i += 1
    if at < len(data):
        parts.append(data[at:].replace(b"\xff\0", b"\xff"))
    every, block = spec["restart"] or len(out), 0
    for part in parts:
        bits, pos, dc = int.from_bytes(part, "big"), len(part) * 8, 0

        def take(n: int) -> int:
            nonlocal pos
            pos -= n
            if pos < 0:
                raise ValueError("the scan ends early")
            return (bits >> pos) & ((1 << n) - 1)

        def symbol(book: dict) -> int:
            code = 0
            for length in range(1, 17):
                code = code << 1 | take(1)
                if (length, code) in book:
                    return book[length, code]
            raise ValueError("a code that the table does not have")

        def value(size: int) -> int:
            raw = take(size) if size else 0
            return raw if not size or raw >> (size - 1) else raw - (1 << size) + 1

        for _ in range(min(every, len(out) - block)):
            dc += value(symbol(books[0]))
            out[block, 0], k = dc, 1
            while k < 64:
                run, size = divmod(symbol(books[1]), 16)
                if not size and run < 15:
                    break
                k += run
                if k > 63:
                    raise ValueError("a run leaves the block")
                if size:
                    out[block, k] = value(size)
                k += 1
            block += 1
    return out


def decode_frames(frames: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, pixels) as (frames, 9, 64); pixels are 0..255. Frames with our header are decoded together."""
    ours = [f.startswith(HEADER) for f in frames]
    if all(ours):
        raw = np.frombuffer(b"".join([f[len(HEADER) :] for f in frames]), np.uint8)
        keep = np.ones(len(raw), bool)
        keep[1:] = ~((raw[:-1] == 0xFF) & (raw[1:] == 0))
        scan = raw[keep].reshape(len(frames), BLOCKS, 74)
        if np.any(scan[:, :, 72] != 0xFF) or np.any(scan[:, :-1, 73] != 0xD0 + np.arange(BLOCKS - 1) % 8):
            raise ValueError("a restart marker is missing")
        extra = _eight_bits(scan[:, :, :72].reshape(-1, 9)).reshape(len(frames), BLOCKS, 64).astype(np.int16)
        coef, scale = extra - 255 * (extra < 128), None
    else:
        parts, scales = [], []
        for f in frames:
            spec, at = _tables(f)
            if spec.get("size") != (SIDE, SIDE):
                raise ValueError(f"frames must be {SIDE} x {SIDE}")
            parts.append(_scan_any(f[at:], spec))
            scales.append(spec["quant"][spec["table"]])
        coef, scale = np.stack(parts), np.stack(scales)[:, None, :]
    level = coef.astype(np.float32) if scale is None else coef * scale
    pixels = np.clip(np.rint(level.reshape(-1, 64) @ IDCT) + 128, 0, 255).astype(np.uint8)
    return coef, pixels.reshape(coef.shape)


def payload_of(coef: np.ndarray) -> np.ndarray:
    """The bytes that ``encode_frames`` stored in these coefficients."""
    return np.where(coef < 0, coef + 255, coef).astype(np.uint8).reshape(len(coef), -1)


def shot_starts(pixels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True where a frame starts a shot. ``first``: True at each file's first frame."""
    n = len(pixels)
    if not n:
        return np.zeros(0, bool)
    binned = (pixels.reshape(n, -1) >> 4).astype(np.int64) + BINS * np.arange(n)[:, None]
    hist = np.bincount(binned.reshape(-1), minlength=n * BINS).reshape(n, BINS)
    diff = np.zeros(n)
    diff[1:] = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2 * FRAME)
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    at = np.arange(n)
    lo = np.maximum(begin + 1, at - SPAN)
    one, two = (np.concatenate([[0], np.cumsum(d)]) for d in (diff, diff**2))
    k = np.maximum(at - lo, 1)
    mean = (one[at] - one[np.minimum(lo, at)]) / k
    dev = np.sqrt(np.maximum((two[at] - two[np.minimum(lo, at)]) / k - mean**2, 0))
    cut = (at - lo >= 2) & (diff > np.maximum(FLOOR, mean + K * dev))
    return cut | first


def to_payload(text: bytes) -> bytes:
    return text + b"\xff" * (max(1, -(-len(text) // FRAME)) * FRAME - len(text))


def encode_texts(texts: list[bytes]) -> list[bytes]:
    """One AVI file for each text."""
    payloads = [to_payload(t) for t in texts]
    frames = encode_frames(np.frombuffer(b"".join(payloads), np.uint8))
    out, at = [], 0
    for p in payloads:
        n = len(p) // FRAME
        out.append(write_avi(frames[at : at + n]))
        at += n
    return out


def decode_files(files: list[bytes]) -> list[tuple[bytes, list[int], int, float]]:
    """For each file: the stored payload, the first frames of its shots, its frames, seconds per frame."""
    parsed = [read_avi(f) for f in files]
    counts = [len(frames) for frames, _ in parsed]
    coef, pixels = decode_frames([f for frames, _ in parsed for f in frames])
    begin = np.concatenate([[0], np.cumsum(counts)]).astype(int)
    first = np.zeros(begin[-1], bool)
    first[begin[:-1]] = True
    starts, data = shot_starts(pixels, first), payload_of(coef)
    return [(data[a:b].tobytes(), np.flatnonzero(starts[a:b]).tolist(), b - a, step) for a, b, (_, step) in zip(begin[:-1], begin[1:], parsed, strict=True)]


def _texts(c: tk.Chunk) -> list[bytes]:
    data = c.data.tobytes()
    return [data[a:b] for a, b in zip(c.offs[:-1].tolist(), c.offs[1:].tolist(), strict=True)]


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text stored as an AVI file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in tk.chunks(b.column(1)):
                media = encode_texts(_texts(c))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.lo, c.hi - c.lo), pa.array(np.diff(c.offs)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return _plain(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_clips(media: DataFrame) -> DataFrame:
    """(doc_id, media) -> timed clip rows: doc_id, clip, first_frame, frames, start_s, end_s, error.

    Null media give one row without a clip; so do damaged media, with what is wrong in ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if data is None:
                    rows.append((doc, *[None] * 6))
                    continue
                try:
                    _, starts, n, step = decode_files([data])[0]
                except (ValueError, IndexError, KeyError, struct.error) as wrong:
                    rows.append((doc, *[None] * 5, str(wrong) or type(wrong).__name__))
                    continue
                rows += [(doc, k, s, e - s, s * step, e * step, None) for k, (s, e) in enumerate(zip(starts, [*starts[1:], n], strict=True))]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "clip", "first_frame", "frames", "start_s", "end_s", "error"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, clip int, first_frame int, frames int, start_s double, end_s double, error string")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digest(docs: DataFrame) -> DataFrame:
    """Store every text as an AVI file, read the stored bytes back, and describe both; feature: frames, shots, cut frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in tk.chunks(b.column(1)):
                media = encode_texts(_texts(c))
                read = decode_files(media)
                hexed = lambda x: hashlib.sha256(x).hexdigest()
                rows = [
                    (len(p), hexed(p), zlib.crc32(p[-32:]), len(m), hexed(m), f"frames={n};shots={len(s)};cuts={zlib.crc32(np.array(s, '<u4').tobytes()):08x};length={n * step:.2f}")
                    for m, (p, s, n, step) in zip(media, read, strict=True)
                ]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                cols = [b.column(0).slice(c.lo, c.hi - c.lo), pa.array(np.diff(c.offs)), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))]
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in DIGEST.split(", ")])

    return _plain(docs).mapInArrow(run, DIGEST)
