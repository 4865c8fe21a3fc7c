"""Context composition: snapshots, item changes, pressure and compactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanloom.operators.blocks import Run, running
from spanloom.plans.trace import AgentTrace, view

_SCALARS = (
    "stage", "basis", "coverage", "baseline", "model", "estimated_tokens", "reported_tokens", "window_tokens",
    "effective_window_tokens", "compact_threshold_tokens", "omitted_changes",
)


def _snapshots(t: AgentTrace) -> DataFrame:
    rows = t["slices"].filter("attrs.context.version = 1")
    return rows.selectExpr(
        "id as event_id", "capture_id", "session", "ts + coalesce(attrs.context.sample_offset_ns, 0L) as ts",
        *[f"attrs.context.{c} as {c}" for c in _SCALARS],
        "attrs.context.categories as category_tokens", "attrs.context.changes as changes",
        "attrs.context.item_stage as item_stage",
    )


@view()
def context_snapshots(t: AgentTrace) -> DataFrame:
    """Recorded snapshots; categories as JSON in name order."""
    return _snapshots(t).selectExpr(
        "event_id", "capture_id", "session", "ts", *_SCALARS,
        "to_json(map_from_entries(array_sort(map_entries(category_tokens)))) as categories",
    )


def _changes(t: AgentTrace) -> DataFrame:
    """Item changes with the previous estimate (only on the same basis and not
    over a new baseline) and the call an item came from."""
    ordered = running(
        _snapshots(t), ["capture_id"], ["ts", "event_id"],
        {"before_basis": Run("lag", F.col("basis")), "before_tokens": Run("lag", F.col("estimated_tokens"))},
        t.blocks("capture_id"), block_order=["ts", "event_id"],
    )
    items = ordered.selectExpr(
        "event_id as snapshot_id", "capture_id", "session", "ts", "coalesce(item_stage, stage) as stage", "basis", "baseline",
        "estimated_tokens", "reported_tokens",
        "if(baseline = 0 and basis = before_basis, before_tokens, null) as previous_estimated_tokens",
        "inline(changes)",
    ).withColumnsRenamed({"id": "item_id"})
    calls = t["tool_calls"].filter("call_id is not null and call_id != ''")
    latest = calls.groupBy("capture_id", F.col("call_id").alias("source_id")).agg(
        F.expr("max(struct(ts, id, name)) as call")
    )
    # items without a source have no partner, and null keys are never shuffled together
    return items.withColumn("source_key", F.expr("nullif(source_id, '')")).join(
        latest.withColumnRenamed("source_id", "source_key"), ["capture_id", "source_key"], "left"
    )


_CHANGE_COLUMNS = (
    "snapshot_id", "capture_id", "session", "ts", "stage", "basis", "baseline", "estimated_tokens", "reported_tokens",
    "previous_estimated_tokens", "item_id", "category", "change", "tokens", "delta_tokens", "chars", "source_id",
    "source_kind", "coalesce(call.id, snapshot_id) as event_id", "call.name as tool",
)


@view()
def context_changes(t: AgentTrace) -> DataFrame:
    """Additions, replacements and removals of context items, without labels."""
    return _changes(t).selectExpr(*_CHANGE_COLUMNS)


@view()
def context_change_details(t: AgentTrace) -> DataFrame:
    return _changes(t).selectExpr(*_CHANGE_COLUMNS, "label")


def _latest(t: AgentTrace) -> DataFrame:
    rows = t["context_snapshots"]
    payload = [c for c in rows.columns if c not in ("capture_id",)]
    return rows.groupBy("capture_id").agg(
        F.max_by(F.struct(*payload), F.struct("ts", "event_id")).alias("s")
    ).select("capture_id", "s.*")


def _with_root(t: AgentTrace, rows: DataFrame) -> DataFrame:
    return rows.join(t["capture_hierarchy"].select("capture_id", "root_capture_id"), "capture_id").join(
        t["capture_runs"].select("capture_id", "harness"), "capture_id"
    )


@view()
def context_latest(t: AgentTrace) -> DataFrame:
    """The last snapshot of each capture."""
    return _with_root(t, _latest(t))


@view()
def context_observations(t: AgentTrace) -> DataFrame:
    """All snapshots with root capture and harness."""
    return _with_root(t, t["context_snapshots"])


@view()
def context_summary(t: AgentTrace) -> DataFrame:
    """Context pressure per capture: peak, window, latest snapshot, counts."""
    counts = _snapshots(t).groupBy("capture_id").agg(
        F.expr("count(*) as snapshots"), F.expr("sum(coalesce(size(changes), 0)) as retained_changes")
    )
    latest = _latest(t).withColumnsRenamed(
        {"event_id": "latest_snapshot_id", "ts": "latest_snapshot_ts", "model": "snapshot_model"}
    ).drop("session", "baseline")
    return (
        t["capture_runs"].select("capture_id", "peak_context", "context_window_tokens", "context_share")
        .join(latest, "capture_id", "left").join(counts, "capture_id", "left")
        .na.fill(0, ["snapshots", "retained_changes"])
    )


@view()
def context_history(t: AgentTrace) -> DataFrame:
    """Context gauge samples before the end of their capture."""
    tracks = t["counter_tracks"].filter("name = 'llm.context.estimated_tokens'").selectExpr("id as track_id", "capture_id")
    runs = t["capture_runs"].selectExpr("capture_id", "session", "context_window_tokens as window_tokens", "end_ts")
    per_track = tracks.join(t["capture_hierarchy"].select("capture_id", "root_capture_id"), "capture_id").join(runs, "capture_id")
    # the small side is joined together first: samples are shuffled once
    return t.tables["counter"].join(per_track, "track_id").filter("ts < end_ts").selectExpr(
        "ts", "value as tokens", "capture_id", "root_capture_id", "session", "window_tokens"
    )


@view()
def compactions(t: AgentTrace) -> DataFrame:
    return t["slices"].filter("kind = 'compaction'").selectExpr(
        "id as event_id", "capture_id", "ts", "dur", "incomplete",
        "if(not incomplete and dur >= 0, dur / 1e6D, null) as duration_ms",
        "attrs.pre_tokens as before_tokens", "attrs.post_tokens as after_tokens",
    )


def top_context_changes(t: AgentTrace, limit: int = 50) -> DataFrame:
    """The largest item changes by absolute size."""
    return (
        t["context_changes"].orderBy(F.desc_nulls_last(F.abs("delta_tokens")), "ts", "snapshot_id", "item_id").limit(limit)
    )


@view()
def category_shares(t: AgentTrace) -> DataFrame:
    """Composition over all sessions' latest snapshots, as shares of each
    category; sessions without a composition are left out."""
    latest = _snapshots(t).groupBy("capture_id").agg(
        F.max_by("category_tokens", F.struct("ts", "event_id")).alias("category_tokens")
    )
    per_category = latest.select("capture_id", F.explode("category_tokens").alias("category", "tokens")).groupBy("category").agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("sessions")
    )
    total = per_category.agg(F.sum("tokens").alias("total"))
    return per_category.crossJoin(F.broadcast(total)).selectExpr(  # one row
        "category", "sessions", "tokens", "if(total > 0, tokens / total, null) as share"
    )
