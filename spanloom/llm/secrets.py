"""Secrets in texts, with DataFrame functions only.

Base spans come from three patterns.  The entropy method adds spans: in every
candidate string a window slides over the characters of one class, its symbol
counts are kept up to date by one removal and one addition a step, and the
string is reported when some window's Shannon entropy reaches the class's
threshold and no allow-list rule speaks against it.  Words between slashes are
left out of the windows; what stands between words is looked at on its own, so
neither a path nor its words hide a key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# The three base patterns and what each match must fulfil.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # AKIA and a run of 18 or more in all: longest runs are the same
HEX = r"[0-9a-f]{16,}"
ASSIGN_VALUE = 12
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_token", "entropy_lower", "entropy_upper")

#: Candidate strings of the entropy method: (kind, pattern, symbols, window, bits a symbol).
#: A hex string of any case needs 32 symbols; a token needs digits and both cases.
#: Letters of one case with digits, some beyond hex, need 25 symbols: the 128 bits of a hex string.
CLASSES = (
    ("entropy_hex", r"(?<![A-Za-z0-9])(?=[A-F]*[0-9])(?=[0-9]*[A-F])[0-9A-F]{32,}(?![A-Za-z0-9])", "0123456789ABCDEF", 32, 3.0),
    (
        "entropy_token",
        r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[A-Z0-9+/_=-]*[a-z])(?=[a-z0-9+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{24,}",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-",
        24,
        3.8,
    ),
    ("entropy_lower", r"(?<![A-Za-z0-9])(?=[a-z]*[0-9])(?=[a-f0-9]*[g-z])[a-z0-9]{25,}+(?![A-Z])", "abcdefghijklmnopqrstuvwxyz0123456789", 25, 3.6),
    ("entropy_upper", r"(?<![A-Za-z0-9])(?=[A-Z]*[0-9])(?=[A-F0-9]*[G-Z])[A-Z0-9]{25,}+(?![a-z])", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 25, 3.6),
)
#: A candidate that matches one of these is no secret: placeholders, rooted paths from word to word, repeats.
ALLOW = (
    r"(?i)example|placeholder|changeme|dummy|xxxx|redacted|your[-_]",
    r"^/[a-z]+/(.*/)?[a-z]+$",
    r"(.)\1{5,}",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^sha(1|256|384|512)[-_]",
)
#: A segment between slashes that is no part of a secret: a chain of words, or one word if there are other segments.
CHAIN = r"^(?:[A-Za-z]{2,}[-_])++[A-Za-z]{2,}[-_]?[0-9]{0,4}$"
WORD = r"^[A-Za-z]{2,}[-_]?[0-9]{0,4}$"


def _java(pattern: str) -> Column:
    return F.lit(pattern)


def _found(text: Column, pattern: str) -> Column:
    """Matches in order as ``(start, s)``: the pieces between matches tell the places.

    ``split`` and ``regexp_extract_all`` walk the same leftmost matches; texts
    without a match (nearly all) cost one search.
    """
    matches = F.regexp_extract_all(text, _java(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    step = F.aggregate(
        F.arrays_zip(F.transform(between, F.char_length).alias("b"), F.concat(matches, F.array(F.lit(""))).alias("s")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,s:string>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["b"] + F.char_length(x["s"])).cast("int").alias("at"),
            F.when(x["s"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct((acc["at"] + x["b"]).cast("int").alias("start"), x["s"].alias("s"))))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    nothing = F.array().cast("array<struct<start:int,s:string>>")
    return F.when(text.rlike(pattern), step).otherwise(nothing)


def _spans(found: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(
        found,
        lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (m["start"] + F.char_length(m["s"])).cast("int").alias("end")),
    )


def window_entropy(string: Column, symbols: str, window: int) -> Column:
    """Largest Shannon entropy in bits of any ``window`` consecutive characters of ``string``.

    The state is the count of every symbol and the sum of ``c * log2(c)``; a step
    takes out the character that leaves and puts in the one that enters.  A
    string shorter than the window gives null.
    """
    table = F.array(*[F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(window + 2)])
    codes = F.transform(F.split(string, ""), lambda c: F.instr(F.lit(symbols), c))  # 1-based
    gone = F.slice(F.concat(F.array_repeat(F.lit(0), window), codes), F.lit(1), F.greatest(F.size(codes), F.lit(0)))
    moves = F.zip_with(codes, gone, lambda enters, leaves: F.struct(enters.alias("enters"), leaves.alias("leaves")))
    bump = lambda counts, which, by: F.transform(counts, lambda c, i: F.when(i + 1 == which, c + by).otherwise(c))

    def step(acc: Column, move: Column) -> Column:
        enters, leaves = move["enters"], move["leaves"]
        had = F.when(leaves > 0, F.element_at(acc["n"], F.greatest(leaves, F.lit(1)))).otherwise(F.lit(0))
        less = F.when(leaves > 0, acc["sum"] - F.element_at(table, had + 1) + F.element_at(table, F.greatest(had, F.lit(1)))).otherwise(acc["sum"])
        counts = F.when(leaves > 0, bump(acc["n"], leaves, -1)).otherwise(acc["n"])
        total = less - F.element_at(table, F.element_at(counts, enters) + 1) + F.element_at(table, F.element_at(counts, enters) + 2)
        best = F.when(acc["at"] + 1 >= window, F.least(acc["low"], total)).otherwise(acc["low"])
        return F.struct((acc["at"] + 1).alias("at"), bump(counts, enters, 1).alias("n"), total.alias("sum"), best.alias("low"))

    start = F.struct(F.lit(0).alias("at"), F.array_repeat(F.lit(0), len(symbols)).alias("n"), F.lit(0.0).alias("sum"), F.lit(1e9).alias("low"))
    low = F.aggregate(moves, start, step, lambda acc: acc["low"])
    return F.when(F.char_length(string) >= window, F.lit(math.log2(window)) - low / window)


def _allowed(s: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOW:
        out = out | s.rlike(pattern)
    return out


def _between_words(s: Column) -> Column:
    """What stands between the word segments of a string, each with its own slashes."""
    word = lambda g: g.rlike(CHAIN) | (s.contains("/") & g.rlike(WORD))
    marked = F.array_join(F.transform(F.split(s, "/", -1), lambda g: F.when(word(g), F.lit(" ")).otherwise(g)), "/")
    return F.split(F.regexp_replace(marked, "/? /?", " "), " ", -1)


def _entropy(text: Column, pattern: str, symbols: str, window: int, bits: float) -> Column:
    reaches = lambda s: F.exists(
        _between_words(s), lambda p: F.when(F.char_length(p) >= window, F.round(window_entropy(p, symbols, window), 6) >= bits).otherwise(False)
    )
    return F.filter(_found(text, pattern), lambda m: ~_allowed(m["s"]) & reaches(m["s"]))


def _joined(spans: Column) -> Column:
    ordered = F.array_sort(spans)
    return F.concat_ws(",", F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``n_assign, n_access, n_hex, base_spans, all_spans`` to every row.

    The span columns are arrays of ``(start, rank, kind, end)`` in code points,
    end exclusive, by start and then kind.  A null or empty text has none.
    Columns of these names are replaced; one row in, one row out, no shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    value = lambda m: F.char_length(F.regexp_extract(m["s"], ASSIGN, 2)) >= ASSIGN_VALUE
    out = docs.withColumn("__op_assign", _spans(F.filter(_found(text, ASSIGN), value), "assign"))
    out = out.withColumn("__op_access", _spans(_found(text, ACCESS), "access")).withColumn("__op_hex", _spans(_found(text, HEX), "hex"))
    more = [_spans(_entropy(text, *rest), kind) for kind, *rest in CLASSES]
    base = F.concat("__op_assign", "__op_access", "__op_hex")
    return (
        out.withColumn("n_assign", F.size("__op_assign").cast("long"))
        .withColumn("n_access", F.size("__op_access").cast("long"))
        .withColumn("n_hex", F.size("__op_hex").cast("long"))
        .withColumn("base_spans", F.array_sort(base))
        .withColumn("all_spans", F.array_sort(F.concat(base, *more)))
        .drop("__op_assign", "__op_access", "__op_hex")
    )


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every span of ``scan`` in the text replaced by ``mask``.

    Overlapping spans become one mask.  Texts without spans, null ones too, stay
    as they are; other columns are not touched.
    """
    text = F.col(text_col)
    step = F.aggregate(
        F.col("all_spans"),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))),
    )
    found = scan(docs, text_col)
    return found.select(*[F.when(F.size("all_spans") > 0, step).otherwise(text).alias(text_col) if c == text_col else F.col(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """``scan`` with the spans as texts: ``base_sha256`` and ``spans``."""
    found = scan(docs)
    return found.withColumn("base_sha256", F.sha2(_joined(F.col("base_spans")), 256)).withColumn("spans", _joined(F.col("all_spans")))
