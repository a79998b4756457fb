import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from helpers import frame, odd_rows, sentence, words
from pyspark.sql import functions as F

from skysift.llm import media, quality, toxicity
from skysift.llm import textkernel as tk


def labelled(n=240, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        bad = k % 4 == 0
        w = words(rng, rng.randint(5, 90))
        for _ in range(3 if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["vileword", "nastyterm", "vilething"]))
        rows.append((k, " ".join(w), "en", "src0", 1))
        labels.append((k, int(not bad), int(bad)))
    return rows, labels


def test_toxicity_learns_and_covers_odd_rows(spark):
    rows, labels = labelled()
    lab = spark.createDataFrame([*labels, (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    net = toxicity.train_toxicity(frame(spark, rows), lab)
    got = {r.doc_id: r for r in toxicity.score_toxicity(frame(spark, rows).withColumn("score", F.lit(1)), net).collect()}
    test = [k for k, r in got.items() if r.held_out]
    assert len(got) == len(rows) and all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in got.items())
    assert np.mean([got[k].predicted == (k % 4 == 0) for k in test]) > 0.9
    odd = toxicity.score_toxicity(frame(spark), net).collect()
    assert len(odd) == len(odd_rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in odd)
    kept = toxicity.drop_toxic(frame(spark, rows), net)
    assert kept.columns == frame(spark, rows).columns and kept.count() == sum(not r.predicted for r in got.values())
    assert toxicity.score_toxicity(frame(spark, []), net).count() == 0


def test_toxicity_without_labels_is_constant(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    net = toxicity.train_toxicity(frame(spark), none)
    assert {r.score for r in toxicity.score_toxicity(frame(spark), net).collect()} == {0.0}


def test_toxicity_learns_from_long_texts(spark):
    rng = random.Random(7)
    rows, labels = labelled()
    long = [" ".join([text, *words(rng, 900)]) if k % 4 == 0 else text for k, text, *_ in rows]
    rows = [(r[0], text, *r[2:]) for r, text in zip(rows, long, strict=True)]
    # Labels of no document do not use up the sample.
    lab = spark.createDataFrame(labels + [(k, 0, 1) for k in range(10_000, 10_400)], "doc_id long, quality int, toxic int")
    net = toxicity.train_toxicity(frame(spark, rows), lab, 100, 400)
    got = {r.doc_id: r for r in toxicity.score_toxicity(frame(spark, rows), net).collect()}
    assert net.constant is None and sum(got[k].predicted for k in got if k % 4 == 0) > 50


def test_toxicity_is_learnt_in_a_task(spark, monkeypatch):
    rows, labels = labelled(90)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")

    def refused(*_):
        raise AssertionError("the driver keeps what training takes")

    monkeypatch.setattr(toxicity, "fit", refused)
    assert toxicity.train_toxicity(frame(spark, rows), lab).constant is None


def test_gradients_match_differences():
    net = toxicity.BiGru(2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.mask_z, net.mask_n = net.mask_z.astype(float), net.mask_n.astype(float)
    c = next(tk.chunks(pa.array(["alpha beta gamma delta epsilon", "one two three"])))
    w = toxicity.read_words(c)
    _, first, length = toxicity.windows(w.counts)
    x = net.inputs(w).astype(float)
    loss = lambda: float(net.forward(x @ net.p["wx"] + net.p["bx"], w.inverse, first, length).sum())
    _, kept = net.forward(x @ net.p["wx"] + net.p["bx"], w.inverse, first, length, keep=True)
    g, _, _ = net.backward(kept, np.ones(2))
    for k in ("uz", "un", "att", "out"):
        at = tuple(np.argwhere(np.abs(g[k]) > 1e-4)[0])
        keep, net.p[k][at] = net.p[k][at], net.p[k][at] + 1e-3
        up = loss()
        net.p[k][at] = keep - 1e-3
        down = loss()
        net.p[k][at] = keep
        assert abs((up - down) / 2e-3 - g[k][at]) < 2e-3


def test_windows_cover_every_word():
    row, first, length = toxicity.windows(np.array([0, 1, 48, 49, 100]))
    base = np.concatenate([[0], np.cumsum([0, 1, 48, 49, 100])])
    for r, n in enumerate((0, 1, 48, 49, 100)):
        seen = {int(f) + k - int(base[r]) for f, m, q in zip(first, length, row, strict=True) if q == r for k in range(m)}
        assert seen == set(range(n))


def plain_stats(text):
    t = text or ""
    w = [m.group() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    rep = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(5)} if len(runs) < 2000 else set()
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep)


def test_quality_statistics_and_verdicts(spark):
    rng = random.Random(8)
    junk = "spam spam eggs *** " * 30
    rows = odd_rows()[:-1] + [(50, junk, None, None, 1), (51, "a\nb\n\na\n a\nb " + "x|y<z> #1 " * 2, None, None, 1)]
    rows += [(60 + k, " ".join(sentence(rng, 9) for _ in range(4)) if k % 2 else " ".join(f"{w}***" for w in words(rng, 40)), None, None, 1) for k in range(60)]
    lab = spark.createDataFrame([(60 + k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    forest = quality.fit_quality(frame(spark, rows), lab)
    got = {r.doc_id: r for r in quality.quality_rules(frame(spark, rows).withColumn("kept", F.lit("x")), forest, 0.5).collect()}
    assert len(got) == len(rows)
    for k, text, *_ in rows:
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_stats(text), k
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    assert np.mean([got[60 + k].kept == bool(k % 2) for k in range(60)]) > 0.95
    assert quality.quality_rules(frame(spark, []), forest).count() == 0


def test_forest_is_monotonic():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (800, len(quality.FEATURES)))
    y = (x[:, 2] + 0.5 * x[:, 0] + rng.normal(0, 0.3, 800) < 0.8).astype(float)
    forest = quality.fit_forest(x, y)
    base = np.repeat(x[:40], 20, axis=0)
    base[:, 2] = np.tile(np.linspace(0, 1, 20), 40)
    assert np.all(np.diff(forest.score(base).reshape(40, 20), axis=1) <= 1e-12)
    assert quality.fit_forest(x[:0], y[:0]).score(x).tolist() == [quality.fit_forest(x[:0], y[:0]).score(x)[0]] * 800


def test_media_round_trip(spark):
    rows = odd_rows()
    got = {r.doc_id: r for r in media.media_digest(frame(spark, rows).withColumn("media", F.lit(1))).collect()}
    for k, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert got[0].media_sha256 == got[5].media_sha256 and got[0].feature == got[5].feature
    clips = media.media_clips(media.text_to_media(frame(spark, rows))).collect()
    assert sum(c.frames for c in clips) == sum(r.payload_bytes // 576 for r in got.values())
    assert media.media_digest(frame(spark, [])).count() == 0


def test_other_jpeg_tables_decode_alike():
    data = np.random.default_rng(1).integers(0, 256, 576 * 3, dtype=np.uint8)
    frames = media.encode_frames(data)
    coef, pixels = media.decode_frames(frames)
    assert np.array_equal(media.payload_of(coef).ravel(), data)
    noted = [f[:2] + b"\xff\xfe\0\4ab" + f[2:] for f in frames]
    again, same = media.decode_frames(noted)
    assert np.array_equal(coef, again) and np.array_equal(pixels, same)


def test_a_shot_is_found():
    pixels = np.full((30, 9, 64), 40, np.uint8)
    pixels[12:] = 200
    first = np.zeros(30, bool)
    first[0] = True
    assert np.flatnonzero(media.shot_starts(pixels, first)).tolist() == [0, 12]


def test_null_and_damaged_media_give_rows(spark):
    good = media.text_to_media(frame(spark, [(1, "some text " * 200, None, None, 1)])).first().media
    rows = [(1, good), (2, None), (3, b""), (4, b"RIFF"), (5, bytes(good)[: len(good) // 2]), (None, good)]
    got = {}
    for r in media.media_clips(spark.createDataFrame(rows, "doc_id long, media binary")).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {1, 2, 3, 4, 5, None}
    assert got[1][0].clip == 0 and got[1][0].error is None and got[2][0].clip is None and got[2][0].error is None
    assert all(got[k][0].clip is None and got[k][0].error for k in (3, 4, 5))
