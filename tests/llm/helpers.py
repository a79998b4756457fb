"""Small corpora with the odd cases: nulls, empty and blank texts, copies, repeated rows, clashing columns, a long text."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(words(rng, n)).capitalize() + "."


def odd_rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    base = "\n".join(" ".join(sentence(rng, rng.randint(6, 14)) for _ in range(4)) for _ in range(6))
    swapped = base.replace(base.split()[40], "changed", 1)
    texts = [base, None, "", "  \n\t ", "One.", base, swapped, base.upper(), base + "\n" + sentence(rng, 12), "héllo wörld 日本語", "\n".join(["same line here now please"] * 4), "a b c d", "A  B\tC D", "x" * 5000]
    texts += [" ".join(sentence(rng, 9) for _ in range(3)) for _ in range(6)]
    texts.append("\n".join(sentence(rng, 10) for _ in range(1500)))
    rows = [(k, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src3", "zzz", None]), None if t is None else len(t)) for k, t in enumerate(texts)]
    return rows


def frame(spark, rows: list[tuple] | None = None, parts: int = 3):
    return spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA).repartition(parts)
