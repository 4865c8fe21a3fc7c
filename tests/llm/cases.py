"""Small tables with nulls, empty and very long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import random

LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(40_000))
SYLLABLES = "ta re mi lo ven sor kul ba ne dri fo gan pel tu".split()


def words(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]


def documents(spark, rows: list[tuple] | None = None, more: bool = True):
    """(doc_id, text, lang, source, n_chars) with columns whose names operators also use."""
    if rows is None:
        base = words(1, 300)
        near = [*base[:150], "changed", *base[151:]]
        half = [*base[:150], *words(2, 150)]
        rows = [
            (1, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (4, " ".join(half)), (5, None), (6, ""), (7, "  \n\t "), (8, "one two three"),
            (9, "ONE two three"), (10, "one  two\nthree"), (11, LONG), (12, LONG + " end"), (None, " ".join(base)), (13, "ß 漢字 🙂 \u0001\u001c x"), (2, " ".join(base)),
            (14, "a b c d e"), (15, "a b c d e f"), (16, "9 8 7 6 5 !!"),
        ]
    full = [(i, t, "en" if i is None or i % 2 else None, None if i is None else f"s{i % 2}", None if t is None else len(t)) for i, t in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    if more:
        for name in ("score", "n", "words", "cls", "id", "sig", "start", "piece", "length", "offset", "sequence_id", "spans", "kind", "held_out", "ids"):
            df = df.withColumn(name, df["n_chars"].cast("string"))
    return df
