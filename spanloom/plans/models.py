"""Model responses: latency, usage and throughput."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanloom.functions.attributes import total_sql
from spanloom.operators.ranks import median_and_rank
from spanloom.plans.trace import AgentTrace, view

#: Completed responses with a usable duration / usable for throughput.
MEASURED = "not incomplete and message_ns >= 0"
RATED = "not incomplete and message_ns > 0 and output_tokens is not null"


@view()
def messages(t: AgentTrace) -> DataFrame:
    """Assistant responses.  An instant with a recorded duration is placed so
    that it ends at its timestamp; without one its bounds stay unknown."""
    rows = t["slices"].filter("kind = 'assistant-message'")
    return rows.selectExpr(
        "id", "capture_id", "session", "ts", "dur", "name", "incomplete", "track_id",
        "attrs.provider as provider", "attrs.model as model",
        "coalesce(attrs.timing, 'recorded-span') as timing",
        "if(dur > 0, dur, attrs.duration_ns) as message_ns",
        "if(dur > 0, ts, ts - attrs.duration_ns) as message_start_ts",
        "attrs.first_content_ns as first_ns",
        *[f"attrs.{c} as {c}" for c in (
            "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "stop_reason",
        )],
    )


@view()
def provider_requests(t: AgentTrace) -> DataFrame:
    return t["slices"].filter("kind = 'provider-request'").selectExpr(
        "id", "capture_id", "session", "ts", "dur", "name",
        "if(not incomplete and dur >= 0, dur / 1e6D, null) as request_span_ms",
        "attrs.phase as phase", "incomplete", "attrs.timing as timing",
    )


@view()
def models_overview(t: AgentTrace) -> DataFrame:
    """Responses, latency and usage per provider and model."""
    return t["messages"].groupBy("provider", "model").agg(
        F.expr("count(*) as responses"),
        F.expr(f"{total_sql('first_ns')} / count(first_ns) / 1e6D as first_content_ms"),
        F.expr("count(first_ns) as latency_samples"),
        F.expr(f"{total_sql('message_ns')} / count(message_ns) / 1e6D as duration_ms"),
        F.expr("sum(input_tokens) as input_tokens"),
        F.expr("sum(output_tokens) as output_tokens"),
        F.expr("sum(cache_read_tokens) as cache_read_tokens"),
        F.expr("count(input_tokens) as input_samples"),
        F.expr("count(output_tokens) as output_samples"),
    )


@view()
def model_cohorts(t: AgentTrace) -> DataFrame:
    """Scorecard per capture, provider, model and timing semantics.

    The median is the mean of the two middle durations, p95 the nearest rank.
    """
    keys = ["capture_id", "provider", "model", "timing"]
    totals = t["messages"].groupBy(*keys).agg(
        F.expr("count(*) as responses"),
        F.expr("count_if(incomplete) as incomplete"),
        F.expr(f"count_if({MEASURED}) as duration_samples"),
        F.expr(f"{total_sql('message_ns', MEASURED)} / count_if({MEASURED}) / 1e6D as mean_ms"),
        F.expr(
            f"{total_sql('first_ns', 'not incomplete and first_ns >= 0')}"
            " / count_if(not incomplete and first_ns >= 0) / 1e6D as first_content_mean_ms"
        ),
        F.expr("count_if(not incomplete and first_ns >= 0) as first_content_samples"),
        F.expr("sum(input_tokens) as reported_input_tokens"),
        F.expr("count(input_tokens) as input_samples"),
        F.expr("sum(output_tokens) as reported_output_tokens"),
        F.expr("count(output_tokens) as output_samples"),
        F.expr("sum(cache_read_tokens) as reported_cache_read_tokens"),
        F.expr("count(cache_read_tokens) as cache_read_samples"),
        F.expr(
            f"sum(output_tokens) filter (where {RATED}) * 1e9D / {total_sql('message_ns', RATED)}"
            " as output_tokens_per_s"
        ),
        F.expr(f"count_if({RATED}) as throughput_samples"),
    )
    ranks = median_and_rank(
        t["messages"].filter(MEASURED), keys, "message_ns", 95, rows=t.slice_rows(), block_rows=t.block_rows
    )
    same = [totals[c].eqNullSafe(ranks[c]) for c in keys]
    return totals.join(ranks, same, "left").select(
        *[totals[c] for c in keys], "responses", "incomplete", "duration_samples", "mean_ms",
        F.expr("median / 1e6D as median_ms"), F.expr("ranked / 1e6D as p95_ms"), "first_content_mean_ms",
        "first_content_samples", "reported_input_tokens", "input_samples", "reported_output_tokens", "output_samples",
        "reported_cache_read_tokens", "cache_read_samples", "output_tokens_per_s", "throughput_samples",
    )
