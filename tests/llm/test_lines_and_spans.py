import random

from helpers import frame, odd_rows, sentence, words
from pyspark.sql import functions as F

from skysift.llm import common, linededup, spandedup
from skysift.llm.linededup import dedup_lines


def brute_lines(rows):
    seen, gone = [], {}
    for doc, text in sorted((r[0], r[1]) for r in rows if r[1] is not None):
        for k, line in enumerate(text.split("\n")):
            tok = frozenset(w for w in line.lower().split() if w)
            if not tok:
                continue
            if any(10 * len(tok & o) >= 8 * len(tok | o) for o in seen):
                gone.setdefault(doc, set()).add(k)
            seen.append(tok)
    return {r[0]: None if r[1] is None else "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone.get(r[0], ())) for r in rows}


def line_rows():
    rng = random.Random(9)
    rows = odd_rows()[:12]
    base = sentence(rng, 14).split()
    for k in range(30):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(["red", "green", "blue", "x%d" % k])
        rows.append((100 + k, " ".join(w) + "\nof the a\n" + sentence(rng, 8) + "\nin of the a to", "en", "src0", 1))
    return rows


def test_lines_match_brute_force(spark):
    rows = line_rows()
    got = {r.doc_id: r.text for r in dedup_lines(frame(spark, rows)).collect()}
    assert got == brute_lines(rows)


def test_lines_with_many_variants_and_wide_ids(spark):
    rng = random.Random(4)
    rows, bases = [], [words(rng, 30) for _ in range(3)]
    for k in range(400):
        w = list(bases[k % 3])
        for _ in range(rng.choice([0, 1, 2, 4, 6])):
            w[rng.randrange(len(w))] = rng.choice(["of", "the", "new%d" % k, "edit%d" % (k % 5)])
        rows.append(((1 << 62) * rng.choice([-1, 1]) + k, " ".join(w) + "\n" + " ".join(["the", "of", "a", "in", "%d" % (k % 7)]), None, None, 1))
    got = {r.doc_id: r.text for r in dedup_lines(frame(spark, rows)).collect()}
    assert got == brute_lines(rows)


def test_lines_of_frequent_words_only(spark):
    """Every token is above the bound of frequent ones, so the index holds pairs only; sets of 4 to 40 tokens, some a word apart."""
    rng = random.Random(6)
    vocabulary, rows, bases = ["w%d" % k for k in range(60)], [], []
    for k in range(500):
        w = rng.sample(vocabulary, rng.choice([4, 5, 6, 9, 14, 25, 40]))
        if bases and rng.random() < 0.6:
            w = list(rng.choice(bases))
            for _ in range(rng.choice([1, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        bases.append(w)
        rows.append((k, " ".join(w), None, None, 1))
    got = {r.doc_id: r.text for r in dedup_lines(frame(spark, rows)).collect()}
    assert got == brute_lines(rows)
    assert 50 < sum(t == "" for t in got.values()) < 450


def test_lines_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rows = line_rows()
    got = {r.doc_id: r.text for r in dedup_lines(frame(spark, rows)).collect()}
    assert got == brute_lines(rows)


def test_pairs_of_a_large_group_meet_about_once(spark):
    rng = random.Random(12)
    base, rows = words(rng, 24), []
    for k in range(150):
        w = list(base)
        for e in range(rng.choice([1, 1, 2])):
            w[rng.randrange(len(w))] = "edit%dx%d" % (k, e)
        rows.append((k, " ".join(w[: rng.choice([22, 23, 24])]), "en", "src0", None))
    lines = linededup._lines(frame(spark, rows).select("doc_id", "text")).dropDuplicates(["h"]).withColumns({"id": F.col("doc_id"), "done": F.lit(0)})
    index = linededup._index_rows(lines, linededup._levels(lines)).localCheckpoint()
    pairs = [(r.id, r.other) for r in index.alias("a").join(index.alias("b"), linededup._meeting()).select(F.col("a.id").alias("id"), F.col("b.id").alias("other")).collect()]
    sets = {r.id: set(r.h) for r in lines.collect()}
    links = {(a, b) for a in sets for b in sets if b < a and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}
    assert len(links) > 3000 and links <= set(pairs)
    assert len(pairs) <= 1.2 * len(set(pairs))


def test_plans_stay_short(spark):
    """The driver keeps the text of every plan, several times over."""
    lines = spark.range(linededup.BUCKETS).selectExpr("id", "5 as n", "id as mask", "id as half", "0 as done", "array(id) as h")
    plan = linededup._index_rows(lines, linededup._levels(lines))._jdf.queryExecution().toString()
    assert len(plan) < 10 * linededup.BUCKETS


def test_index_rows_run_in_compiled_code(spark):
    """Twenty million rows a GB: neither lambdas beside the generator nor a sort of boxed numbers."""
    docs = frame(spark, [(k, "one two three w%d w%d" % (k, k + 1), None, None, 1) for k in range(9)]).select("doc_id", "text")
    lines = common.materialize(linededup._lines(docs), "lines").withColumns({"id": F.col("doc_id"), "done": F.lit(0)})
    index = linededup._index_rows(lines, linededup._levels(lines))
    plan = index._jdf.queryExecution().executedPlan().toString().splitlines()
    generators = [x.split("Generate")[0] for x in plan if "Generate" in x]
    assert generators and all("*(" in x for x in generators)
    places = [x for x in index._jdf.queryExecution().optimizedPlan().toString().splitlines() if "sort_array" in x]
    assert places and all("sort_array(transform(h" in x and "coalesce(" in x for x in places)


def test_levels_follow_counts(spark):
    """1 to 900 rows of a token: levels never fall, and that of the most frequent is the one of paired tokens."""
    tokens = [1, 2, 4, 9, 30, 900]
    lines = spark.createDataFrame([([k],) for k, c in enumerate(tokens) for _ in range(c)], "h array<bigint>")
    at = linededup._level_at(linededup._levels(lines), F.col("t"))
    got = [r.x >> 56 for r in spark.createDataFrame([(k,) for k in range(7)], "t bigint").coalesce(1).select(at.alias("x")).collect()]
    assert got[:6] == [4, 8, 12, 16, 23, linededup.HOT_LEVEL] and got[6] == 0


def test_lines_edges(spark):
    assert dedup_lines(frame(spark, [])).count() == 0
    extra = frame(spark, line_rows()[:3]).withColumns({"gone": F.lit(1), "gone_id": F.lit("k"), "id": F.lit(2), "line_no": F.lit(3), "h": F.lit(4)})
    assert dedup_lines(extra).columns == extra.columns
    twice = dedup_lines(frame(spark, [(1, "a b c\nx", None, None, 1), (1, "a b c\nx", None, None, 1), (None, "a b c", None, None, 1)])).collect()
    assert len(twice) == 3 and [r.text for r in twice if r.doc_id is None] == ["a b c"]


def test_spans_match_brute_force(spark):
    rng = random.Random(2)
    passage = " ".join(sentence(rng, rng.randint(5, 15)) for _ in range(6))
    rows = odd_rows() + [(200 + k, sentence(rng, 7) + " " + passage + " " + sentence(rng, 8) + (" " + passage) * (k % 2), None, None, 1) for k in range(8)]
    got = {r.doc_id: r.text for r in spandedup.dedup_spans(frame(spark, rows)).collect()}
    want = spandedup.brute_force([(r[0], r[1]) for r in rows])
    assert got == want
    assert passage in got[200] and all(passage not in got[k] for k in range(201, 208))


def test_spans_edges(spark):
    assert spandedup.dedup_spans(frame(spark, [])).count() == 0
    extra = frame(spark, odd_rows()).withColumns({c: F.lit("own " + c) for c in ("h", "s", "lead", "spans", "span_id", "_spans", "_span_id")})
    got = spandedup.dedup_spans(extra)
    assert got.columns == extra.columns and all(r.spans == "own spans" and r._spans == "own _spans" and r.span_id == "own span_id" for r in got.collect())
    assert spandedup.dedup_spans(frame(spark, [(None, "A b. C d.", None, None, 1)])).first().text == "A b. C d."


def test_a_repeated_run_goes_to_its_end(spark):
    rng = random.Random(6)
    passage = " ".join(sentence(rng, n) for n in (18, 5, 5))
    rows = [(1, passage + " " + sentence(rng, 12), None, None, 1), (2, passage + " " + sentence(rng, 12), None, None, 1)]
    lengths = [rng.choice([1, 2, 3, 5, 18, 25, 60]) for _ in range(60)]
    parts = [sentence(rng, n) for n in lengths]
    for k in range(40):
        a, n = rng.randrange(55), rng.randint(1, 6)
        rows.append((10 + k, " ".join([sentence(rng, 4), *parts[a : a + n], sentence(rng, rng.choice([2, 30]))]), None, None, 1))
    got = {r.doc_id: r.text for r in spandedup.dedup_spans(frame(spark, rows)).collect()}
    assert got == spandedup.brute_force([(r[0], r[1]) for r in rows])
    assert got[1] == rows[0][1] and got[2] == rows[1][1][len(passage) + 1 :]
