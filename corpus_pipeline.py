"""A corpus pipeline: five stages, each written and reread as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, wraps

from pyspark.sql import DataFrame, SparkSession

from skysift.llm.common import materialize, read_table, release_unused, release_workers
from skysift.llm.linededup import dedup_lines
from skysift.llm.minhash import near_dedup
from skysift.llm.mixing import mix_sources
from skysift.llm.packing import best_fit_packing
from skysift.llm.queries import TOKENIZER
from skysift.llm.toxicity import drop_toxic, train_toxicity


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def lean(stage: Stage, python: bool = True) -> Stage:
    """A stage that starts without what those before it have left in the memory of driver and executors. Where it is of DataFrame
    functions only (not ``python``), it runs no Python on the executors for that either, and their workers wait for the next stage."""

    @wraps(stage)
    def run_lean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if python:
            release_workers(spark)
        release_unused(spark)
        return stage(spark, docs, sf_dir)

    return run_lean


lean_native = partial(lean, python=False)


@lean
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model accepts; it is trained on the labelled rows of the tables in ``sf_dir``."""
    return drop_toxic(docs, train_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))


@lean_native
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines similar to earlier ones; n_chars follows the new text."""
    out = dedup_lines(docs)
    return out.selectExpr(*["cast(length(text) as bigint) as n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns])


@lean
def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup(docs, 80)


@lean_native
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled towards the target weights of source, language and topic."""
    return mix_sources(docs)


@lean
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: its document, token span, sequence and offset."""
    return best_fit_packing(docs, TOKENIZER)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("minhash", minhash_dedup), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs


#: The toxicity stage is a trained network: SQL cannot express it.
ORACLE_SQL = None
