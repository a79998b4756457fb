"""Line dedup: an exact set-similarity join of lines with prefix, positional and length filters (operator 2).

DataFrame functions only. Semantics. Lines are the \\n-split parts of a text; a line's tokens are the distinct words
(lower-cased runs of characters other than space and 0x09-0x0D). Lines are ordered by (doc_id, line number). A line is
removed when an earlier line's token set has a Jaccard similarity of at least 0.8 with its own, judged on the input;
lines without tokens stay. The other lines, joined by \\n, are the new text: null stays null, an empty text stays empty, a
document that loses all lines keeps an empty text and its row. Rows repeated with one id are treated as one text
repeated: within equal ids the order is that of line numbers, and all such rows lose the lines that any of them loses.
Null ids come through unchanged. An empty table gives an empty result. Extra columns pass through, whatever their names;
with ``counts``, columns named n_lines and n_removed are replaced.

Method. Each line is parsed once: its sorted token hashes (63 bits and one for long words) are written, and all further steps read them. Lines of
equal sets are one class, kept by its first line; copies are found by a join with the sets that repeat. Tokens are ordered by rarity: by their count over all lines in 32,768
hashed buckets, on a scale of a quarter octave, then by hash; the table is of fixed size, and any total order is valid for
prefix filters. A class puts its first n - ceil(0.8 n) + 1 tokens (its prefix) into an index; tokens of very frequent buckets stand
last in it and go by pairs of two such tokens of the prefix that is one longer: similar sets share two tokens there, and if
the first of these is frequent, so is the second.

Rows of the index meet by key, a later with an earlier one, under the length and positional filters and a bound on the
sets' difference: 64 or 128 parity bits a set differ in at most as many places as the sets do. Before that, classes meet the
earliest class that shares a pair of neighbours among their first hashes (long words first), and then the leads of many; those that this resolves look no further, so
a large group of variants does not make all its pairs. What passes is verified on full sets.
"""

from __future__ import annotations

from functools import reduce
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, fresh, materialize

BUCKETS = 1 << 15
#: A token bucket with more than this share of all tokens is paired.
HOT_SHARE = 1 / 2000
#: The rarity level, in the high bits of a key, of a token that is paired.
HOT_LEVEL = 127
#: Sets of more tokens are compared by 128 parity bits instead of 64.
WIDE = 32
#: Words of so many characters count as long.
LONG = 7
#: Pairs of neighbouring token hashes, from the first on, that find a class its lead; classes have four tokens or more.
LEADS = 2
#: A lead of so many is also compared with all classes that share one of its first FEW token hashes.
MANY, FEW = 8, 8


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, n, s1, s2, mask, half, h) of each line: its distinct token hashes in order, two hashes of these, and
    for each of 64 places the parity of how many tokens fall there; ``half`` counts only the long words of a long line."""
    odd = reduce(lambda a, b: a | b, [F.col("text").contains(x) for x in "\t\r\x0b\x0c"])
    flat = docs.select("doc_id", F.lower(F.when(odd, F.translate("text", "\t\r\x0b\x0c", "    ")).otherwise(F.col("text"))).alias("text"))
    lines = flat.select("doc_id", F.posexplode_outer(F.split("text", "\n", -1)).alias("line_no", "line"))
    # Long words, which are rarer, get negative numbers, so that they stand first.
    token = lambda w: F.when(F.length(w) >= LONG, F.xxhash64(w).bitwiseOR(_long(-1 << 63))).otherwise(F.xxhash64(w).bitwiseAND(_long((1 << 63) - 1)))
    hashes = F.array_except(F.transform(F.split("line", " "), token), F.array(token(F.lit(""))))  # distinct ones
    lines = lines.select("doc_id", "line_no", F.sort_array(hashes).alias("h"))
    flip = lambda h: F.aggregate(h, _long(0), lambda m, t: m.bitwiseXOR(F.call_function("shiftleft", _long(1), t.bitwiseAND(_long(63)).cast("int"))))
    # The long words of a long line and its other words are gone through once each.
    lines = lines.withColumn("cut", F.when(F.size("h") > WIDE, F.size(F.filter("h", lambda t: t < 0))).otherwise(0))
    lines = lines.withColumn("half", F.when(F.col("cut") > 0, flip(F.slice("h", F.lit(1), F.col("cut")))).otherwise(_long(0)))
    rest = flip(F.when(F.col("cut") > 0, F.slice("h", F.col("cut") + 1, F.size("h"))).otherwise(F.col("h")))
    return lines.select("doc_id", "line_no", F.size("h").alias("n"), F.xxhash64("h").alias("s1"), F.hash("h").alias("s2"), rest.bitwiseXOR(F.col("half")).alias("mask"), "half", "h")


def _levels(lines: DataFrame) -> Column:
    """BUCKETS constant bytes: a bucket's level by its count over all lines, as the byte that ``_level_at`` reads as this level.
    As a constant it is part of every text of the plan that the driver keeps, so it has to be short."""
    bucket = F.col("t").bitwiseAND(_long(BUCKETS - 1)).cast("int")
    counts = dict(lines.select(F.explode_outer("h").alias("t")).groupBy(bucket.alias("b")).count().collect())  # BUCKETS rows at most
    hot = max(sum(counts.values()) * HOT_SHARE, 64)

    def level(c: int) -> int:
        return HOT_LEVEL if c > hot else min(HOT_LEVEL - 1, c.bit_length() * 4 + (c << 2 >> c.bit_length() - 1 & 3)) if c else 0

    # The first seven bits of the CRC of one byte take every value, each for two bytes.
    byte = {crc32(bytes([x])) >> 25: x for x in range(256)}
    return F.lit(bytes(byte[level(counts.get(b, 0))] for b in range(BUCKETS)))


def _level_at(levels: Column, t: Column) -> Column:
    """The level of a token, shifted to where keys carry it. A CRC is the cheapest number to be had from a byte."""
    byte = F.substring(levels, t.bitwiseAND(_long(BUCKETS - 1)).cast("int") + 1, F.lit(1))
    return F.shiftleft(F.crc32(byte), 31).bitwiseAND(_long(127 << 56))


class _Ids:
    """Lines as single ordered numbers: document and line number side by side in a long, or in a decimal if they need more."""

    def __init__(self, low: int | None, high: int | None, lines: int | None):
        self.low, self.shift = low or 0, max(1, (lines or 1).bit_length())
        self.wide = ((high or 0) - self.low + 1) << self.shift >= 1 << 62

    def pack(self) -> Column:
        doc, line = F.col("doc_id"), F.col("line_no")
        if self.wide:
            return (doc.cast("decimal(38,0)") * F.lit(1 << self.shift).cast("decimal(18,0)") + line).cast("decimal(38,0)")
        return F.shiftleft(doc - self.low, self.shift).bitwiseOR(line.cast("long"))

    def unpack(self) -> list[Column]:
        i = F.col("id")
        if self.wide:
            doc = F.floor(i / F.lit(1 << self.shift).cast("decimal(18,0)")).cast("long")
            return [doc.alias("doc_id"), (i - doc.cast("decimal(38,0)") * F.lit(1 << self.shift).cast("decimal(18,0)")).cast("int").alias("line_no")]
        return [(F.shiftright(i, self.shift) + self.low).alias("doc_id"), i.bitwiseAND(F.lit((1 << self.shift) - 1)).cast("int").alias("line_no")]


def _prefix(n: Column) -> Column:
    return n - F.ceil(n * F.lit(8) / F.lit(10)).cast("int") + 1


def _index_rows(classes: DataFrame, levels: Column) -> DataFrame:
    """(key, id, n_at, mask, half, prev) of classes(id, n, mask, half, done, h). ``n_at`` holds the size in its high half, below it
    the position in the prefix, for a pair the second's less one, and, in its lowest bit, whether the class has stopped looking.
    ``prev`` is the token before, for a pair the one before its second, or before its first if they are neighbours. Two classes
    that share it also meet under an earlier key: that token's own or its pair with the first."""
    hot, p = _long(HOT_LEVEL << 56), _prefix(F.col("n"))
    # Written arrays count as such that may hold nulls, which are sorted as objects; these hold none.
    keys = F.transform("h", lambda t: F.coalesce(_level_at(levels, t).bitwiseOR(t.bitwiseAND(_long((1 << 56) - 1))), _long(0)))
    heads = classes.select("id", "n", "mask", "half", "done", F.slice(F.sort_array(keys), F.lit(1), F.least(p + 1, F.col("n"))).alias("head"))
    # Frequent tokens are the greatest: they stand last in a prefix, and so do their pairs. A row's place is that of its token, for
    # a pair that of the second, with that of the first and one in the high half. Only places are made by lambdas, which are slow.
    plain = F.least(F.size(F.filter("head", lambda t: t < hot)), p)
    single = F.when(plain > 0, F.sequence(_long(0), plain.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
    seconds = F.sequence(plain.cast("long") + 1, F.size("head").cast("long") - 1)
    pairs = F.flatten(F.transform(seconds, lambda j: F.transform(F.sequence(plain.cast("long"), j - 1), lambda i: F.shiftleft(i + 1, 32).bitwiseOR(j))))
    paired = (F.get("head", p - 1) >= hot) & (F.size("head") > plain + 1)
    places = heads.withColumn("at", F.when(paired, F.concat(single, pairs)).otherwise(single))
    first, at = F.shiftright("at", 32).cast("int"), F.col("at").bitwiseAND(_long((1 << 32) - 1)).cast("int")
    rows = places.select("id", "n", "mask", "half", "done", "head", F.explode_outer("at").alias("at"))
    key = F.when(first == 0, F.get("head", at)).otherwise(F.xxhash64(F.get("head", first - 1), F.get("head", at)))
    pos = at - F.when(first == 0, 0).otherwise(1)
    prev = F.get("head", at - F.when(first == at, 2).otherwise(1))
    n_at = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR((pos * 2 + F.col("done")).cast("long"))
    known = lambda c: F.coalesce(c, _long(0)).alias(c)
    return rows.select(key.alias("key"), "id", F.coalesce(n_at, _long(0)).alias("n_at"), known("mask"), known("half"), prev.alias("prev"))


def _meeting() -> Column:
    """What joins index rows a, of the later class, and b: their key, unless the classes also meet under an earlier one."""
    stopped = lambda x: F.col(f"{x}.n_at").bitwiseAND(_long(1))
    # One exchange serves both sides: what tells them apart is in the condition, which names the same columns of both.
    later = (F.col("a.id") - F.col("b.id")) * (1 - stopped("a")) > F.shiftright(stopped("b"), 1)
    first = ~F.coalesce(F.col("a.prev") == F.col("b.prev"), F.lit(False))
    # Nearly all that share a key fail by their parity bits, half of them by their order: what is most foreseeable stands first.
    return (F.col("a.key") == F.col("b.key")) & _possible(True) & later & first


def _possible(positions: bool) -> Column:
    """Of rows a and b: length filter, difference of the sets by their parity bits and, with ``positions``, the positional
    filter: what a row stands for, one token or two, is taken as the first that the two share."""
    na, nb = (F.shiftright(F.col(f"{x}.n_at"), 32).cast("int") if positions else F.col(f"{x}.n") for x in "ab")
    # 10 x >= 8 (na + nb - x) means 9 x >= 4 (na + nb); then the sets differ in na + nb - 2 x places, at most a ninth of na + nb.
    all_, half = (F.col(f"a.{x}").bitwiseXOR(F.col(f"b.{x}")) for x in ("mask", "half"))
    apart = F.when((na > WIDE) & (nb > WIDE), F.bit_count(half) + F.bit_count(all_.bitwiseXOR(half))).otherwise(F.bit_count(all_))
    fits = (9 * F.bit_count(all_) <= na + nb) & (9 * apart <= na + nb) & (10 * na >= 8 * nb) & (10 * nb >= 8 * na)
    if not positions:
        return fits
    pa, pb = (F.shiftright(F.col(f"{x}.n_at").bitwiseAND(_long((1 << 32) - 1)).cast("int"), 1) for x in "ab")
    return fits & (9 * F.least(na - pa, nb - pb) >= 4 * (na + nb))


def _sets(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """The lines that a written table pairs(id, other) names."""
    need = materialize(pairs.select("id").unionByName(pairs.select(F.col("other").alias("id"))).distinct(), "need")
    return materialize(lines.select("id", "n", "mask", "half", "h").join(checked_broadcast(need), "id", "left_semi"), "sets")


def _verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs(id, other), those whose full sets reach the threshold."""
    sets = sets.select("id", "h")
    both = pairs.join(sets, "id").join(sets.select(F.col("id").alias("other"), F.col("h").alias("o")), "other")
    common = F.size(F.array_intersect("h", "o"))
    return both.filter(10 * common >= 8 * (F.size("h") + F.size("o") - common)).select("id", "other")


def _by_leads(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """Ids of classes found similar to a lead, the first class of a key; then to a lead that many were similar to."""
    same = (F.col("a.key") == F.col("b.key")) & (F.col("b.id") < F.col("a.id")) & _possible(False)
    ends = F.col("a.id").alias("id"), F.col("b.id").alias("other")
    pair = lambda k: F.xxhash64(F.get("h", F.lit(k)), F.get("h", F.lit(k + 1)))
    rows = classes.select("id", "n", "mask", "half", F.explode_outer(F.array(*[pair(k) for k in range(LEADS)])).alias("key"))
    leads = rows.groupBy("key").agg(F.min("id").alias("id"), F.min_by("n", "id").alias("n"), F.min_by("mask", "id").alias("mask"), F.min_by("half", "id").alias("half"), F.count("*").alias("rows")).filter("rows > 1")
    met = materialize(rows.alias("a").join(leads.alias("b"), same).select(*ends).distinct(), "led")
    sets = _sets(lines, met)
    led = materialize(_verified(sets, met), "near")
    near = led.select("id").distinct()

    many = materialize(led.groupBy(F.col("other").alias("id")).count().filter(F.col("count") >= MANY).select("id"), "many")
    tokens = F.explode_outer(F.slice("h", 1, FEW)).alias("key")
    big = materialize(sets.join(checked_broadcast(many), "id", "left_semi").select("id", "n", "mask", "half", tokens), "big")
    left = classes.join(checked_broadcast(materialize(near, "led")), "id", "left_anti").select("id", "n", "mask", "half", tokens)
    met = materialize(left.alias("a").join(checked_broadcast(big).alias("b"), same).select(*ends).distinct(), "met")
    return near.unionByName(_verified(_sets(lines, met), met).select("id").distinct())


def removed_lines(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, line_no) of the lines to remove."""
    random = {f"parquet.enable.dictionary#{c}": "false" for c in ("s1", "s2", "mask", "half")}
    lines = materialize(_lines(docs), "lines", **{"parquet.dictionary.page.size": 16 << 20}, **random)
    ids = _Ids(*lines.agg(F.min("doc_id"), F.max("doc_id"), F.max("line_no")).first())
    lines = lines.filter("n > 0").select(ids.pack().alias("id"), "n", "s1", "s2", "mask", "half", "h")
    groups = lines.groupBy("n", "s1", "s2").agg(F.min("id").alias("id"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    groups = checked_broadcast(materialize(groups, "groups"))
    # One long as the key makes a far smaller table to broadcast than three columns; the others are in the condition.
    equal = (F.col("a.s1") == F.col("b.s1")) & (F.col("a.s2").bitwiseXOR(F.col("b.s2")).bitwiseOR(F.col("a.n").bitwiseXOR(F.col("b.n"))) == 0)
    copies = lines.select("id", "n", "s1", "s2").alias("a").join(groups.alias("b"), equal & (F.col("a.id") > F.col("b.id")))
    copies = materialize(copies.select("a.id").distinct(), "copies")
    # Sets of up to three tokens are similar to equal sets only.
    classes = lines.filter("n >= 4").join(checked_broadcast(copies), "id", "left_anti")
    near = materialize(_by_leads(lines, classes).distinct(), "near")

    done = classes.join(checked_broadcast(near.withColumn("done", F.lit(1))), "id", "left").withColumn("done", F.coalesce("done", F.lit(0)))
    rows = _index_rows(done, _levels(lines))
    pairs = rows.alias("a").join(rows.alias("b"), _meeting()).select(F.col("a.id").alias("id"), F.col("b.id").alias("other"))
    pairs = materialize(pairs.distinct(), "pairs")
    near = near.unionByName(_verified(_sets(lines, pairs), pairs).select("id"))
    return copies.unionByName(near).distinct().select(*ids.unpack())


def dedup_lines(docs: DataFrame, text_out: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` with similar later lines removed from ``text``; with ``counts``, also n_lines and n_removed."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    of, list_ = fresh(docs.columns, "gone_id", "gone")
    gone = materialize(removed_lines(plain).groupBy(F.col("doc_id").alias(of)).agg(F.sort_array(F.collect_set("line_no")).alias(list_)), "gone")
    rows = docs.join(checked_broadcast(gone, list_), F.col("doc_id").cast("long") == F.col(of), "left")
    text = F.col("text").cast("string")
    kept = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(list_, i))
    new = {text_out: F.when(F.col(list_).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))}
    if counts:
        feeds = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
        new["n_lines"] = F.when(text.isNull(), 0).otherwise(feeds + 1).cast("long")
        new["n_removed"] = F.when(F.col(list_).isNull(), 0).otherwise(F.size(list_)).cast("long")
    return rows.withColumns(new).drop(of, list_)


SQL = r"""
WITH lines AS (
  SELECT doc_id, CAST(line_no AS INTEGER) - 1 AS line_no, list_distinct(list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS tok
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL)),
classes AS (SELECT *, list_sort(tok) AS s FROM lines WHERE len(tok) > 0),
firsts AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, line_no) AS k FROM classes),
reps AS (SELECT row_number() OVER (ORDER BY doc_id, line_no) AS id, s, len(s) AS n FROM firsts WHERE k = 1),
flat AS (SELECT id, n, unnest(s) AS w FROM reps),
freq AS (SELECT w, count(*) AS c FROM flat GROUP BY w),
ranked AS (SELECT f.id, f.n, f.w, row_number() OVER (PARTITION BY f.id ORDER BY q.c, f.w) AS pos FROM flat f JOIN freq q USING (w)),
heads AS (SELECT * FROM ranked WHERE pos <= n - CAST(ceil(n * 8 / 10.0) AS BIGINT) + 1),
pairs AS (SELECT DISTINCT a.id AS later, b.id AS earlier FROM heads a JOIN heads b ON a.w = b.w AND b.id < a.id AND 10 * a.n >= 8 * b.n AND 10 * b.n >= 8 * a.n),
near AS (
  SELECT DISTINCT p.later FROM pairs p JOIN reps a ON a.id = p.later JOIN reps b ON b.id = p.earlier
  WHERE 10 * len(list_intersect(a.s, b.s)) >= 8 * (a.n + b.n - len(list_intersect(a.s, b.s)))),
gone AS (
  SELECT doc_id, line_no FROM firsts WHERE k > 1
  UNION SELECT f.doc_id, f.line_no FROM firsts f JOIN reps r ON r.s = f.s JOIN near n ON n.later = r.id),
lists AS (SELECT doc_id, list(line_no) AS g FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS BIGINT) AS n_lines, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
  md5(CASE WHEN g IS NULL THEN text ELSE coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(g, CAST(i - 1 AS INTEGER))), chr(10)), '') END) AS kept_md5
FROM documents d LEFT JOIN lists ON lists.doc_id = d.doc_id
"""
