"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted trees are grown on the statistics of a bounded labelled sample; every
path of a tree is a conjunctive rule, the rules are weighted by a logistic
regression with an L1 penalty, and those with a weight become one Spark column
expression, so scoring is plain arithmetic inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
#: Characters that prose hardly has.
SYMBOLS = "!#$%&*+<=>@[]\\^_`{|}~"
STATISTICS = (
    "log_chars", "log_words", "word_length", "symbol_share", "pipe_share", "upper_share", "digit_share", "stop_share",
    "distinct_words", "repeated_words", "distinct_lines",
)


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns ``__op_<statistic>`` of each whole text; one pass, no shuffle.

    A null text counts as empty, and all statistics of an empty text are 0.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    size = F.char_length(t)
    without = lambda chars: (size - F.char_length(F.translate(t, chars, ""))).alias
    lines = F.split(t, "\n")
    counted = {
        "words": F.filter(F.split(F.translate(t, "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != ""),
        "chars": size, "lines": F.size(lines), "line_kinds": F.size(F.array_distinct(lines)),
    }
    shares = {"symbol_share": SYMBOLS, "pipe_share": "|", "upper_share": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit_share": "0123456789", "stop_share": "."}
    raw = docs.select("*", *[c.alias(f"__op_raw_{k}") for k, c in counted.items()], *[without(c)(f"__op_raw_{k}") for k, c in shares.items()])
    words, n = F.col("__op_raw_words"), F.col("__op_raw_chars")
    w = F.size(words)
    per_word = lambda x: F.coalesce(x / F.nullif(w, F.lit(0)), F.lit(0.0))
    following = F.zip_with(words, F.slice(words, 2, F.greatest(w, F.lit(1))), lambda a, b: (a == b).cast("int"))
    found = {
        "log_chars": F.log1p(n.cast("double")),
        "log_words": F.log1p(w.cast("double")),
        "word_length": per_word(F.aggregate(words, F.lit(0), lambda a, x: a + F.char_length(x))),
        "distinct_words": per_word(F.size(F.array_distinct(words))),
        "repeated_words": per_word(F.aggregate(following, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))),
        "distinct_lines": F.when(n > 0, F.col("__op_raw_line_kinds") / F.col("__op_raw_lines")).otherwise(0.0),
    } | {k: F.coalesce(F.col(f"__op_raw_{k}") / F.nullif(n, F.lit(0)), F.lit(0.0)) for k in shares}
    return raw.select(*[F.col(c) for c in docs.columns], *[found[k].alias(f"__op_{k}") for k in STATISTICS])


@dataclass
class Rule:
    """Bounds of a conjunction: statistic -> (low, high), low < value <= high."""

    bounds: dict[int, tuple[float, float]] = field(default_factory=dict)

    def narrowed(self, f: int, low: float, high: float) -> Rule:
        a, b = self.bounds.get(f, (-np.inf, np.inf))
        return Rule({**self.bounds, f: (max(a, low), min(b, high))})

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for f, (low, high) in self.bounds.items():
            out &= (x[:, f] > low) & (x[:, f] <= high)
        return out

    def column(self, names: tuple[str, ...]) -> Column:
        out = None
        for f, (low, high) in sorted(self.bounds.items()):
            for test in ([F.col(f"__op_{names[f]}") > low] if np.isfinite(low) else []) + ([F.col(f"__op_{names[f]}") <= high] if np.isfinite(high) else []):
                out = test if out is None else out & test
        return F.lit(True) if out is None else out


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Places between neighbouring values, halfway, near the quantiles: a value just beyond a seen one stays on its side."""
    values = np.unique(x)
    at = np.unique(np.searchsorted(values, np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]), side="left"))
    at = at[at + 1 < len(values)]
    return (values[at] + values[at + 1]) / 2


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 64, leaf: int = 20) -> list[Rule]:
    """All paths (to inner nodes and leaves) of boosted trees with logistic loss."""
    cuts = [_cuts(x[:, f], bins) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    raw, rules = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p) + 1e-9
        nodes = [(np.arange(len(y)), Rule())]
        for level in range(depth + 1):
            following = []
            for rows, rule in nodes:
                best = (1e-6, None)
                total_g, total_h = g[rows].sum(), h[rows].sum()
                for f, c in enumerate(cuts) if level < depth else ():
                    if not len(c):
                        continue
                    k = code[rows, f]
                    left_g, left_h = (np.cumsum(np.bincount(k, weights=v[rows], minlength=len(c) + 1))[:-1] for v in (g, h))
                    left_n = np.cumsum(np.bincount(k, minlength=len(c) + 1))[:-1]
                    gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                    gain[(left_n < leaf) | (len(rows) - left_n < leaf)] = -1
                    j = int(gain.argmax())
                    if gain[j] > best[0]:
                        best = (gain[j], (f, j))
                if best[1] is None:
                    raw[rows] += rate * total_g / (total_h + 1)
                    continue
                f, j = best[1]
                side = code[rows, f] <= j
                for part, low, high in ((rows[side], -np.inf, cuts[f][j]), (rows[~side], cuts[f][j], np.inf)):
                    child = rule.narrowed(f, low, high)
                    rules.append(child)
                    following.append((part, child))
            nodes = following
    return rules


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient steps; columns are scaled by their spread."""
    scale = np.maximum(a.std(axis=0), 1e-3)
    z = (a - a.mean(axis=0)) / scale
    n, m = z.shape
    probe = np.ones(m) / np.sqrt(m)
    for _ in range(20):  # largest eigenvalue by power iteration
        probe = z.T @ (z @ probe)
        top = np.linalg.norm(probe)
        probe /= max(top, 1e-12)
    size = 1 / (0.25 * (top / n + 1) + 1e-9)
    w, b = np.zeros(m), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(z @ v + c))) - y
        new_w = v - size * (z.T @ r) / n
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - size * penalty, 0)
        new_b = c - size * r.mean()
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    w = w / scale
    return float(b - a.mean(axis=0) @ w), w


@dataclass
class RuleEnsemble:
    intercept: float
    rules: list[Rule]
    weights: list[float]
    names: tuple[str, ...]

    def score(self) -> Column:
        """Probability of label 1 as a column over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total = total + F.when(rule.column(self.names), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = STATISTICS, penalty: float = 0.001) -> RuleEnsemble:
    """An ensemble from labelled statistics; without rows it scores 0.5, with one label it scores its smoothed share."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return RuleEnsemble(float(np.log(share / (1 - share))), [], [], names)
    rules, seen, columns = [], set(), []
    for rule in grow_rules(x, y):
        held = rule.holds(x)
        key = held.tobytes()
        if key in seen or held.all() or not held.any():
            continue
        seen.add(key)
        rules.append(rule)
        columns.append(held)
    if not columns:
        share = y.mean()
        return RuleEnsemble(float(np.log(share / (1 - share))), [], [], names)
    intercept, w = lasso_logistic(np.stack(columns, axis=1).astype(np.float64), y, penalty)
    chosen = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleEnsemble(intercept, [rules[i] for i in chosen], [float(w[i]) for i in chosen], names)


def _fold(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> RuleEnsemble:
    """An ensemble from about ``sample_rows`` labelled rows at most, chosen by a hash of the id.

    Only rows with ``crc32(id) mod 3`` other than 1 and a label are learned from;
    contradicting labels of one id all count.  The chosen ids (their number is
    bounded by ``sample_rows``) are broadcast to the texts, and only statistics
    come to the driver.
    """
    usable = labels.filter(f"quality is not null and {id_col} is not null").filter(_fold(id_col) != 1)
    usable = usable.select(F.col(id_col).alias(id_col), F.col("quality").alias("__op_label"))
    n = usable.count()
    if n > sample_rows:
        usable = usable.filter(F.pmod(F.xxhash64(id_col, F.lit(9)), F.lit(1 << 20)) < int((1 << 20) * sample_rows / n))
    chosen = with_statistics(docs.select(id_col, text_col).join(F.broadcast(usable), id_col), text_col)
    train = chosen.select(*[f"__op_{k}" for k in STATISTICS], "__op_label").toPandas()
    return fit(train[[f"__op_{k}" for k in STATISTICS]].to_numpy(np.float64), (train["__op_label"].to_numpy() == 1).astype(np.float64))


def scored(docs: DataFrame, model: RuleEnsemble, text_col: str = "text", score_col: str = "__op_score") -> DataFrame:
    """``docs`` with the probability of label 1; row by row, no shuffle."""
    return with_statistics(docs, text_col).select(*docs.columns, model.score().alias(score_col))


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id>, held_out, score, predicted)`` of every row; ``held_out`` rows are never learned from.

    Null and empty texts have statistics of 0 and get a score like any other.  A
    row with a null id is scored and never learned from (``held_out`` false).
    Repeated rows are scored alike.  An empty label table gives 0.5 throughout.
    """
    model = learn(docs, labels, sample_rows, id_col, text_col)
    out = scored(docs.select(id_col, text_col), model, text_col)
    return out.select(
        id_col, F.coalesce(_fold(id_col) == 1, F.lit(False)).alias("held_out"), F.col("__op_score").alias("score"), (F.col("__op_score") >= 0.5).cast("int").alias("predicted")
    )
