"""Mixing sources to target weights: iterative proportional fitting over source, language and topic (operator 10).

DataFrame functions only. Semantics. A document's weight is its words (runs of characters other than space and
0x09-0x0D; null text: 0). Values of a dimension that have no target, nulls included, form the value ``other``. Topic is a
rule over the text (``TOPIC``). Token mass by (source, language, topic) cell is raked in turn to each dimension's targets,
renormalised over the values that occur. A cell's probability is min(1, k * raked mass / own mass), with k calibrated so
that ``budget`` of all tokens is expected; a cell without tokens keeps its documents. A document is sampled when a number
in [0, 1) drawn from the md5 of seed and id is below its cell's probability, so repeated rows go together, and the same
rows are sampled however the table is dealt. Null ids draw as the empty string. An empty table gives an empty result.

A dimension has a fixed number of values (its targets and ``other``), so the cells are few whatever the input: they are
aggregated with map-side partials, raked in one task of at most a few hundred rows, and broadcast under that bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of tokens by value; what is missing to 1 goes to ``other``.
TARGETS: dict[str, dict[str, float]] = {
    "source": {"src0": 0.20} | {f"src{k}": 0.04 for k in range(1, 15)},
    "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.10},
    "topic": {"prose": 0.70, "table": 0.08, "contact": 0.08, "license": 0.06},
}
#: (topic, SQL condition on ``text``), first match wins; no match or null: prose.
TOPIC = [("table", "text like '% | %'"), ("contact", "text like '%@%'"), ("license", "text like '%icense%'")]
BUDGET = 0.8
SEED = "mix-1"
ROUNDS = 8
CALIBRATIONS = 8
WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column) -> Column:
    out = None
    for name, rule in TOPIC:
        test = text.like(rule.split("'")[1])
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("prose")


def _value(col: Column, targets: dict[str, float]) -> Column:
    return F.when(col.isin(*targets), col).otherwise("other")


def _with_cells(docs: DataFrame, targets: dict[str, dict[str, float]]) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.withColumns(
        {
            "_s": _value(F.col("source").cast("string"), targets["source"]),
            "_l": _value(F.col("lang").cast("string"), targets["lang"]),
            "_t": _value(topic_of(text), targets["topic"]),
            "_n": F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"),
        }
    )


def _target(col: str, targets: dict[str, float]) -> Column:
    out = None
    for k, v in targets.items():
        out = F.when(F.col(col) == k, F.lit(v)) if out is None else out.when(F.col(col) == k, F.lit(v))
    return out.otherwise(F.lit(round(max(1e-9, 1 - sum(targets.values())), 9)))


def cell_probabilities(docs: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """(_s, _l, _t, _mass, _raked, _p) of every cell; at most the product of (targets + 1) rows."""
    dims = {"_s": targets["source"], "_l": targets["lang"], "_t": targets["topic"]}
    cells = _with_cells(docs.select("source", "lang", "text"), targets).groupBy(*dims).agg(F.sum("_n").cast("double").alias("_mass")).coalesce(1)
    everything = Window.partitionBy(F.lit(1))
    w = cells.withColumns({"_raked": F.col("_mass"), "_all": F.sum("_mass").over(everything)})
    w = w.withColumns({f"_g{d}": _target(d, t) for d, t in dims.items()})
    for d in dims:
        # Targets over the values that hold tokens: each value's target counts once.
        rank = F.row_number().over(Window.partitionBy(d).orderBy(F.desc("_mass"), *dims))
        w = w.withColumn("_once", F.when((rank == 1) & (F.col("_mass") > 0), F.col(f"_g{d}")).otherwise(0.0))
        w = w.withColumn(f"_g{d}", F.col(f"_g{d}") / F.greatest(F.sum("_once").over(everything), F.lit(1e-9)))
    for _ in range(rounds):
        for d in dims:
            total = F.sum("_raked").over(Window.partitionBy(d))
            w = w.withColumn("_raked", F.when(total > 0, F.col("_raked") * F.col(f"_g{d}") * F.col("_all") / total).otherwise(0.0))
    w = w.withColumns({"_r": F.when(F.col("_mass") > 0, F.col("_raked") / F.col("_mass")).otherwise(0.0), "_k": F.lit(float(budget))})
    for _ in range(CALIBRATIONS):
        got = F.sum(F.col("_mass") * F.least(F.lit(1.0), F.col("_k") * F.col("_r"))).over(everything)
        w = w.withColumn("_k", F.when(got > 0, F.col("_k") * budget * F.col("_all") / got).otherwise(F.col("_k")))
    p = F.when(F.col("_mass") > 0, F.least(F.lit(1.0), F.col("_k") * F.col("_r"))).otherwise(1.0)
    return w.select("_s", "_l", "_t", "_mass", "_raked", p.alias("_p"))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) with 48 bits, from the md5 of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long").cast("double") / F.lit(float(1 << 48))


def mixing_report(docs: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, budget: float = BUDGET) -> DataFrame:
    """Every document with its topic, tokens, probability (rounded to 6 places) and whether it is sampled."""
    cells = cell_probabilities(docs, targets, budget)
    rows = _with_cells(docs.select("doc_id", "source", "lang", "text"), targets).join(F.broadcast(cells), ["_s", "_l", "_t"])
    return rows.select("doc_id", F.col("_t").alias("topic"), F.col("_n").alias("n_tokens"), F.round("_p", 6).alias("probability"), (draw(F.col("doc_id")) < F.col("_p")).alias("sampled"))


def mix_sources(docs: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, budget: float = BUDGET) -> DataFrame:
    """The sampled documents, columns as given."""
    cells = cell_probabilities(docs, targets, budget).select("_s", "_l", "_t", "_p")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", "lang", "text")
    rows = _with_cells(rows, targets).drop("_n").join(F.broadcast(cells), ["_s", "_l", "_t"])
    return rows.filter(draw(F.col("doc_id")) < F.col("_p")).select("row.*")


def sql(targets: dict[str, dict[str, float]] = TARGETS, budget: float = BUDGET, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for ``mixing_report`` over documents."""
    quoted = lambda names: ", ".join(f"'{n}'" for n in names)
    case = lambda col, t: f"CASE {' '.join(f'WHEN {col} = {chr(39)}{k}{chr(39)} THEN {v!r}::DOUBLE' for k, v in t.items())} ELSE {round(max(1e-9, 1 - sum(t.values())), 9)!r}::DOUBLE END"
    topic = "CASE " + " ".join(f"WHEN {rule} THEN '{name}'" for name, rule in TOPIC) + " ELSE 'prose' END"
    dims = {"s": targets["source"], "l": targets["lang"], "t": targets["topic"]}
    parts = [
        f"docs AS (SELECT doc_id, CASE WHEN source IN ({quoted(dims['s'])}) THEN source ELSE 'other' END AS s, CASE WHEN lang IN ({quoted(dims['l'])}) THEN lang ELSE 'other' END AS l, "
        f"{topic} AS t, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS n FROM documents)",
        "cells AS (SELECT s, l, t, sum(n)::DOUBLE AS mass FROM docs GROUP BY s, l, t)",
        "w0 AS (SELECT *, mass AS raked, sum(mass) OVER () AS every, " + ", ".join(f"{case(d, t)} AS g{d}" for d, t in dims.items()) + " FROM cells)",
    ]
    last = "w0"
    for d in dims:
        parts.append(f"o{d} AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY {d} ORDER BY mass DESC, s, l, t) = 1 AND mass > 0 THEN g{d} ELSE 0.0 END AS once FROM {last})")
        parts.append(f"n{d} AS (SELECT * EXCLUDE (once) REPLACE (g{d} / greatest(sum(once) OVER (), 1e-9) AS g{d}) FROM o{d})")
        last = f"n{d}"
    for i in range(rounds):
        for d in dims:
            name = f"r{i}{d}"
            parts.append(f"{name} AS (SELECT * REPLACE (CASE WHEN sum(raked) OVER (PARTITION BY {d}) > 0 THEN raked * g{d} * every / sum(raked) OVER (PARTITION BY {d}) ELSE 0.0 END AS raked) FROM {last})")
            last = name
    parts.append(f"k0 AS (SELECT *, CASE WHEN mass > 0 THEN raked / mass ELSE 0.0 END AS r, {budget!r}::DOUBLE AS k FROM {last})")
    for i in range(CALIBRATIONS):
        got = "sum(mass * least(1.0, k * r)) OVER ()"
        parts.append(f"k{i + 1} AS (SELECT * REPLACE (CASE WHEN {got} > 0 THEN k * {budget!r} * every / ({got}) ELSE k END AS k) FROM k{i})")
    parts.append(f"probs AS (SELECT s, l, t, CASE WHEN mass > 0 THEN least(1.0, k * r) ELSE 1.0 END AS p FROM k{CALIBRATIONS})")
    u = f"(('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT)::DOUBLE / {float(1 << 48)!r}"
    return f"WITH {', '.join(parts)} SELECT doc_id, t AS topic, n AS n_tokens, round(p, 6) AS probability, {u} < p AS sampled FROM docs JOIN probs USING (s, l, t)"
