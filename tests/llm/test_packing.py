import json
import zlib

import numpy as np
import public_tokenizers
from helpers import frame, odd_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skysift.llm.bpe import ByteBpe
from skysift.llm.packing import BestFit, best_fit_packing, pack_pieces

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_equal_the_tokenizer():
    theirs, ours = Tokenizer.from_file(PATH), ByteBpe(PATH)
    for text in ["", " ", "a  b", "<|endoftext|>x <|endoftext|> y", "a \n\n b", "don't I'll\tx", "日本 語 é 12ab!!", "x\x1cy", *[r[1] for r in odd_rows() if r[1]]]:
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_very_long_texts_and_another_splitting(tmp_path):
    theirs, ours = Tokenizer.from_file(PATH), ByteBpe(PATH)
    for text in [" " * 1_000_000 + "x", "a" * 20_000, "\n" * 300_000, "word, " * 100_000]:
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids
    spec = json.loads(open(PATH, encoding="utf-8").read())
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(spec))
    other, text = ByteBpe(str(tmp_path / "other.json")), "first word, then more"
    assert np.frombuffer(other.encode(text), "<u4").tolist() == Tokenizer.from_file(str(tmp_path / "other.json")).encode(text, add_special_tokens=False).ids


def test_placement_and_content(spark):
    rows = odd_rows()
    out = best_fit_packing(frame(spark, rows).selectExpr("*", "1 as unit", "2 as bin"), PATH, max_len=64).collect()
    theirs = Tokenizer.from_file(PATH)
    ids = {r[0]: [*theirs.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows}
    places, seen = {}, {}
    for p in out:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == p.ids_crc32 and len(part) == p.length
        seen.setdefault(p.doc_id, []).append((p.piece, p.start, p.length))
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for doc, parts in seen.items():
        parts.sort()
        assert [q[0] for q in parts] == list(range(len(parts))) and sum(q[2] for q in parts) == len(ids[doc])
        assert all(q[2] == 64 for q in parts[1:])
    for own in places.values():
        own.sort()
        at = 0
        for offset, length in own:
            assert offset == at
            at += length
        assert at <= 64
    total = sum(map(len, ids.values()))
    assert len(places) <= -(-total // 64) + 3


def test_several_tasks_and_rounds(spark):
    rng = np.random.default_rng(1)
    need = rng.integers(1, 100, 4000)
    df = spark.createDataFrame([(k, 0, 0, int(n), 0) for k, n in enumerate(need)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = pack_pieces(df, 100, open_bins=32, per_task=100).groupBy("sequence_id").agg(F.sum("length"), F.max("offset")).collect()
    assert sum(r[1] for r in out) == need.sum() and max(r[1] for r in out) <= 100
    assert len(out) <= 1.10 * need.sum() / 100


def test_empty_table(spark):
    assert best_fit_packing(frame(spark, []), PATH).count() == 0


def test_fullest_closes_first():
    fit = BestFit(10, 2)
    assert [fit.add(n) for n in (6, 7, 3, 8, 4)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6)]
    one = BestFit(10, 1)
    assert [one.add(n) for n in (6, 7, 4)] == [(0, 0), (1, 0), (2, 0)]
