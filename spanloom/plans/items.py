"""Context item sets: building them from transcripts and comparing them in time.

An item set is stored sparsely: rows ``scope, item_id, sample, category,
tokens`` say that an item was present at a numbered sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanloom.functions.text import estimate_tokens
from spanloom.operators.blocks import Blocks, Run, running

# fixed values: role or instruction name to category, first match wins
ROLE_CATEGORIES = (
    (r"^system$", "system"),
    (r"^assistant$", "assistant"),
    (r"^(toolResult|tool)$", "results"),
    (r"(?i)compaction|summary", "summaries"),
    (r"^user$", "prompts"),
)
INSTRUCTION_CATEGORIES = (
    (r"(?i)rule|memory|claude.?md|agents.?md|instruction.?file", "rules"),
    (r"(?i)skill", "skills"),
    (r"(?i)environment|date|workspace|session.?info|project|email", "environment"),
    (r"(?i)reminder|wrapper", "overhead"),
    (r"(?i)tool|agent|command", "tools"),
)


def _first_match(column, rules, default: str):
    out = F.lit(default)
    for pattern, category in reversed(rules):
        out = F.when(column.rlike(pattern), category).otherwise(out)
    return out


def role_category(role):
    return _first_match(role, ROLE_CATEGORIES, "unattributed")


def instruction_category(name):
    return _first_match(name, INSTRUCTION_CATEGORIES, "system")


def transcript_items(messages: DataFrame) -> DataFrame:
    """Items of a transcript: one per message with text, and the final state of
    named sections and tools.

    ``messages``: ``scope, seq, role, text, sections map<string,string>,
    tools_added array<struct<name,description>>, tools_removed array<string>``.
    The last writer of a name wins; a null section or a removed tool deletes it.
    """
    texts = messages.filter("length(text) > 0").select(
        "scope", F.concat(F.lit("message:"), F.col("seq").cast("string")).alias("item_id"),
        role_category(F.col("role")).alias("category"), F.length("text").cast("bigint").alias("chars"),
        estimate_tokens(F.col("text")).alias("tokens"),
    )
    sections = messages.select("scope", "seq", F.explode("sections").alias("name", "text")).select(
        "scope", F.concat(F.lit("section:"), "name").alias("item_id"), F.struct("seq", F.lit(0).alias("step")).alias("at"),
        instruction_category(F.col("name")).alias("category"), F.length("text").cast("bigint").alias("chars"),
        estimate_tokens(F.col("text")).alias("tokens"),
    )
    added = messages.select("scope", "seq", F.explode("tools_added").alias("tool")).select(
        "scope", F.concat(F.lit("tool:"), "tool.name").alias("item_id"), F.struct("seq", F.lit(0).alias("step")).alias("at"),
        F.lit("tools").alias("category"), F.length(F.to_json("tool")).cast("bigint").alias("chars"),
        estimate_tokens(F.to_json("tool")).alias("tokens"),
    )
    removed = messages.select("scope", "seq", F.explode("tools_removed").alias("name")).select(
        "scope", F.concat(F.lit("tool:"), "name").alias("item_id"), F.struct("seq", F.lit(1).alias("step")).alias("at"),
        F.lit("tools").alias("category"), F.lit(None).cast("bigint").alias("chars"), F.lit(None).cast("bigint").alias("tokens"),
    )
    named = sections.unionByName(added).unionByName(removed)
    final = named.groupBy("scope", "item_id").agg(
        F.max_by(F.struct("category", "chars", "tokens"), "at").alias("v")
    ).filter("v.tokens is not null").select("scope", "item_id", "v.*")
    return texts.unionByName(final)


def context_diff(items: DataFrame, samples: DataFrame, *, blocks: Blocks | None = None) -> DataFrame:
    """Changes between consecutive samples of an item set.

    ``items``: ``scope, sample, item_id, category, tokens`` with samples
    numbered 0, 1, 2 ... per scope; ``samples``: ``scope, sample, model``.  The
    first sample and a change of model are baselines.  Each change is found at
    its item by looking at that item's previous and next sample, so the cost is
    one sort of the items and no set comparison.
    """
    numbered = running(
        samples, ["scope"], ["sample"], {"_was": Run("lag", F.struct("model")), "_next": Run("lead", F.col("sample"))}, blocks
    ).selectExpr("scope", "sample", "_next as next_sample", "not coalesce(struct(model) <=> _was, false) as baseline")
    rows = items.join(numbered, ["scope", "sample"])
    prior = running(
        rows, ["scope", "item_id"], ["sample"],
        {"_prev": Run("lag", F.struct("sample", "category", "tokens")), "_later": Run("lead", F.col("sample"))},
    )
    present = "coalesce(_prev.sample = sample - 1 and not baseline, false)"
    entered = prior.filter(
        f"not {present} or _prev.tokens != tokens or _prev.category != category"
    ).selectExpr(
        "scope", "sample", "item_id", "category", "tokens",
        f"case when baseline then 'baseline' when {present} then 'replaced' else 'added' end as change",
        f"if({present}, tokens - _prev.tokens, tokens) as delta_tokens",
    )
    # an item leaves at the next sample of its scope, unless that one is a baseline
    heads = numbered.selectExpr("scope", "sample as next_sample", "baseline as next_baseline")
    left = (
        prior.filter("next_sample is not null and coalesce(_later, -1) != next_sample")
        .join(heads, ["scope", "next_sample"]).filter("not next_baseline")
        .selectExpr(
            "scope", "next_sample as sample", "item_id", "category", "tokens", "'removed' as change", "-tokens as delta_tokens"
        )
    )
    return entered.unionByName(left)


def retained_changes(changes: DataFrame, *, limit: int | None = None, blocks: Blocks | None = None) -> DataFrame:
    """Changes of each snapshot, largest first (``position``).  With a ``limit``
    the rest is only counted by :func:`snapshot_totals`."""
    ordered = changes.withColumn("_size", -F.abs("delta_tokens"))
    ranked = running(ordered, ["scope", "sample"], ["_size", "item_id", "change"], {"position": Run("row_number")}, blocks)
    return (ranked if limit is None else ranked.filter(F.col("position") <= limit)).drop("_size")


def snapshot_totals(items: DataFrame, changes: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Per sample: estimate, and how many changes were kept and left out."""
    totals = items.groupBy("scope", "sample").agg(F.sum("tokens").alias("estimated_tokens"))
    counts = changes.groupBy("scope", "sample").agg(F.count(F.lit(1)).alias("n"))
    n = "coalesce(n, 0L)"
    kept = n if limit is None else f"least({n}, {limit}L)"
    return totals.join(counts, ["scope", "sample"], "full").selectExpr(
        "scope", "sample", "estimated_tokens", f"{kept} as changes", f"{n} - {kept} as omitted_changes"
    )


def encode_sparse_items(items: DataFrame, samples: DataFrame) -> DataFrame:
    """Item sets as changes against the previous sample of a scope:
    ``scope, sample, op, item_id, category, tokens`` with ``op`` in ``reset``
    (first sample), ``set`` and ``remove``."""
    diff = context_diff(items, samples.select("scope", "sample", F.lit("").alias("model")))
    steps = diff.selectExpr(
        "scope", "sample", "if(change = 'removed', 'remove', 'set') as op", "item_id",
        "if(change = 'removed', null, category) as category", "if(change = 'removed', null, tokens) as tokens",
    )
    resets = samples.groupBy("scope").agg(F.min("sample").alias("sample")).selectExpr(
        "scope", "sample", "'reset' as op", "cast(null as string) as item_id", "cast(null as string) as category",
        "cast(null as bigint) as tokens",
    )
    return steps.unionByName(resets)


def fold_sparse_items(changes: DataFrame, *, at: str | None = None, blocks: Blocks | None = None) -> DataFrame:
    """The items retained after all changes (or up to sample ``at``, an SQL
    expression): the last change of each item since the last reset, if it set it."""
    rows = changes if at is None else changes.filter(f"sample <= {at}")
    reset = rows.filter("op = 'reset'").groupBy("scope").agg(F.max("sample").alias("since"))
    live = rows.filter("op != 'reset'").join(reset, "scope", "left").filter("sample >= coalesce(since, sample)")
    last = live.groupBy("scope", "item_id").agg(F.max_by(F.struct("op", "category", "tokens"), F.struct("sample", "op")).alias("v"))
    return last.filter("v.op = 'set'").select("scope", "item_id", "v.category", "v.tokens")


def category_counters(snapshots: DataFrame, ends: DataFrame) -> DataFrame:
    """Counter series per category: ``scope, ts, categories map`` in.  Once seen
    a category reports in every later snapshot, as zero when it vanished; all
    close with zero at the scope's end (``scope, end_ts``)."""
    values = snapshots.select("scope", "ts", F.explode("categories").alias("category", "tokens"))
    first = values.groupBy("scope", "category").agg(F.min("ts").alias("first_ts"))
    # few categories exist, so the grid is as long as the snapshots times a dozen
    grid = snapshots.select("scope", "ts").join(first, "scope").filter("ts >= first_ts").drop("first_ts")
    series = grid.join(values, ["scope", "ts", "category"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    closing = first.join(ends, "scope").select("scope", F.col("end_ts").alias("ts"), "category", F.lit(0).cast("bigint").alias("tokens"))
    return series.select("scope", "ts", "category", "tokens").unionByName(closing)
