"""The corpus operators as registered queries, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linededup, media, minhash, mixing, packing, pii, quality, spandedup, suffixdedup, toxicity
from .common import read_table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_components(read_table(spark, sf_dir, "documents"), 85)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(read_table(spark, sf_dir, "documents"), TOKENIZER)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, read_table(spark, sf_dir, "labels")))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(read_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.quality_rules(docs, quality.fit_quality(docs, read_table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_minhash, op4_packing, op7_toxicity, op8_media, op9_quality)}

ORACLES: dict[str, str] = {
    "op1_minhash": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN ends l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, c.m AS component_id, c.m = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) c ON c.a = d.doc_id
""",
}


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(read_table(spark, sf_dir, "documents"))


QUERIES["op10_mixing"] = op10_mixing
ORACLES["op10_mixing"] = mixing.sql()


def op2_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(read_table(spark, sf_dir, "documents"), counts=True)
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


QUERIES["op2_linededup"] = op2_linededup
ORACLES["op2_linededup"] = linededup.SQL


def op3_spandedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spandedup.span_digest(read_table(spark, sf_dir, "documents"))


QUERIES["op3_spandedup"] = op3_spandedup


def op6_suffixarray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.suffix_dedup_digest(read_table(spark, sf_dir, "documents"))


QUERIES["op6_suffixarray"] = op6_suffixarray
ORACLES["op6_suffixarray"] = suffixdedup.SQL


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


QUERIES["op5_pii"] = op5_pii
