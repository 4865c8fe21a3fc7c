"""Live ingest as Structured Streaming jobs.

Batch and live share their row logic; what differs is how long state waits.
State ends by a watermark or a timeout; a limit on it is off unless given.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanloom.sources.journals import parse_observations


def stream_journal(spark: SparkSession, path: str, *, max_files: int = 1000) -> DataFrame:
    """Observations of journals as their files arrive."""
    lines = (
        spark.readStream.option("maxFilesPerTrigger", max_files).option("lineSep", "\n").text(path)
        .select(
            F.regexp_extract("_metadata.file_path", r"^(.*)/[^/]*$", 1).alias("recording"),
            F.col("_metadata.file_path").alias("file"),
            F.col("value").alias("line"),
        )
    )
    return parse_observations(lines)


def stream_dedup(events: DataFrame, keys: list[str], *, event_time: str = "at", delay: str = "1 hour") -> DataFrame:
    """Drop rows that were sent again within the delay; late rows keep their own time."""
    return events.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def stream_pair_begin_end(events: DataFrame, *, timeout: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Operations from begin and end rows: ``scope, event, id, phase, at``.

    An operation is emitted when its end arrives.  One that stays open longer
    than ``timeout`` is emitted as incomplete, with the timeout as its end, once
    the watermark proves that no end can come.
    """
    begins = events.filter("phase = 'begin'").select("scope", "event", "id", F.col("at").alias("start_at")).withWatermark("start_at", delay)
    ends = (
        events.filter("phase = 'end'")
        .select(*[F.col(c).alias(f"e_{c}") for c in ("scope", "event", "id")], F.col("at").alias("end_at"))
        .withWatermark("end_at", delay)
    )
    same = F.expr(
        f"scope = e_scope and event = e_event and id = e_id and end_at >= start_at and end_at <= start_at + interval {timeout}"
    )
    return begins.join(ends, same, "left_outer").select(
        "scope", "event", "id", "start_at",
        F.coalesce("end_at", F.expr(f"start_at + interval {timeout}")).alias("end_at"),
        F.col("end_at").isNull().alias("incomplete"),
    )


def stream_token_totals(responses: DataFrame) -> DataFrame:
    """Running usage per session; update mode emits the sessions that changed."""
    return responses.groupBy("session").agg(
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.count("input_tokens").alias("input_samples"),
        F.count("output_tokens").alias("output_samples"),
        F.count(F.lit(1)).alias("responses"),
    )


def stream_prompt_clusters(prompts: DataFrame, *, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Groups of prompts with less than ``gap`` between them, per capture."""
    return (
        prompts.withWatermark("at", delay)
        .groupBy("capture_id", F.session_window("at", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("prompts"))
        .select("capture_id", F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), "prompts")
    )


def stream_activity_bins(events: DataFrame, *, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events per kind in fixed windows: the live form of activity profiles,
    whose equal bins need a finished recording."""
    return (
        events.withWatermark("at", delay).groupBy(F.window("at", width).alias("w"), "kind").agg(F.count(F.lit(1)).alias("events"))
        .select(F.col("w.start").alias("start_at"), "kind", "events")
    )


def stream_capture_health(parsed: DataFrame, *, name: str = "capture_health") -> DataFrame:
    """Valid and corrupt rows per journal so far; each micro-batch also reports
    its own numbers as the observed metrics ``name``."""
    watched = parsed.observe(name, F.count_if("valid").alias("rows"), F.count_if(~F.col("valid")).alias("corrupt"))
    return watched.groupBy("recording").agg(F.count_if("valid").alias("rows"), F.count_if(~F.col("valid")).alias("corrupt"))


def with_open_operations(found: DataFrame, events: DataFrame, *, timeout: str = "1 hour") -> DataFrame:
    """What a finished :func:`stream_pair_begin_end` wrote, and the operations it still held.

    A stream that ends (``availableNow``) leaves begins whose timeout the
    watermark never passed.  ``events`` are the same rows as a table; begins that
    are not in ``found`` are added as incomplete.
    """
    keys = ["scope", "event", "id"]
    begins = events.filter("phase = 'begin'").select(*keys, F.col("at").alias("start_at"))
    left = begins.join(found.select(*keys, "start_at"), [*keys, "start_at"], "left_anti")
    ended = left.select(*keys, "start_at", F.expr(f"start_at + interval {timeout}").alias("end_at"), F.lit(True).alias("incomplete"))
    return found.select(*ended.columns).unionByName(ended)


def with_open_windows(found: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """What a finished stream of windows wrote, and the windows it still held.

    A stream that ends (``availableNow``) leaves windows that the watermark never
    passed.  ``windows`` is the same aggregation over the same rows as a table;
    its windows whose ``keys`` are not in ``found`` are added.  No anti join:
    Spark would push it below the merging of session windows.
    """
    payload = [c for c in windows.columns if c not in keys]
    both = found.select(*windows.columns).withColumn("_written", F.lit(1)).unionByName(windows.withColumn("_written", F.lit(0)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*payload), "_written").alias("_w")).select(*keys, "_w.*")


# ------------------------------------------------------------ keyed state
_ROUTED = "trace_id string, id string, session string, state string"


def _route_trace(max_waiting: int | None, wait_ms: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """State: parent and session of the trace's spans, and which still wait."""
        trace = key[0]
        known = json.loads(state.get[0]) if state.exists else {"spans": {}, "waiting": [], "sessions": []}
        newest = state.getCurrentWatermarkMs()
        if state.hasTimedOut:
            state.remove()
            if known["waiting"]:
                yield pd.DataFrame(
                    {"trace_id": trace, "id": known["waiting"], "session": None, "state": "dropped"}
                )
            return
        for frame in frames:
            newest = max(newest, int(frame["at"].max().timestamp() * 1000))
            for row in frame.itertuples(index=False):
                session = row.session if isinstance(row.session, str) and row.session else None
                parent = row.parent_id if isinstance(row.parent_id, str) else None
                known["spans"][row.id] = [parent, session]
                known["waiting"].append(row.id)
                if session and session not in known["sessions"]:
                    known["sessions"].append(session)

        def owner(span: str) -> str | None:
            seen = set()
            while span is not None and span not in seen and span in known["spans"]:
                seen.add(span)
                parent, session = known["spans"][span]
                if session:
                    return session
                span = parent
            return known["sessions"][0] if len(known["sessions"]) == 1 else None

        owners = {s: owner(s) for s in known["waiting"]}
        routed = [(trace, s, o, "routed") for s, o in owners.items() if o]
        known["waiting"] = [s for s, o in owners.items() if not o]
        if max_waiting is not None and len(known["waiting"]) > max_waiting:
            routed += [(trace, s, None, "dropped") for s in known["waiting"]]
            known = {"spans": {}, "waiting": [], "sessions": []}
        state.update((json.dumps(known),))
        state.setTimeoutTimestamp(newest + wait_ms)
        yield pd.DataFrame(routed, columns=["trace_id", "id", "session", "state"])

    return step


def stream_route_telemetry(
    spans: DataFrame, *, max_waiting: int | None = None, wait_ms: int = 600_000, delay: str = "10 minutes"
) -> DataFrame:
    """Session of each span of a shared export: ``trace_id, id, parent_id, session, at``.

    A span waits in the state of its trace until it, an ancestor, or the whole
    trace names one session.  When the watermark passes the trace's last span by
    ``wait_ms``, or more wait than a given ``max_waiting``, they come out as
    ``dropped``.
    """
    return spans.withWatermark("at", delay).groupBy("trace_id").applyInPandasWithState(
        _route_trace(max_waiting, wait_ms), _ROUTED, "known string", "append", GroupStateTimeout.EventTimeTimeout
    )


_CHANGED = "scope string, sample bigint, item_id string, category string, tokens bigint, change string, delta_tokens bigint"


def _diff_scope(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: the item set and model of the scope's last sample."""
    scope = key[0]
    held = json.loads(state.get[0]) if state.exists else None
    out = []
    rows = pd.concat(list(frames)).sort_values("sample")
    for row in rows.itertuples(index=False):
        current = {i["item_id"]: (i["category"], int(i["tokens"])) for i in row.items}
        fresh = held is None or held["model"] != row.model or bool(row.reset)
        before = {} if fresh else {k: tuple(v) for k, v in held["items"].items()}
        changes = []
        for item, (category, tokens) in current.items():
            old = before.get(item)
            if old != (category, tokens):
                change = "baseline" if fresh else "added" if old is None else "replaced"
                changes.append((scope, row.sample, item, category, tokens, change, tokens - (old[1] if old else 0)))
        for item, (category, tokens) in before.items():
            if item not in current:
                changes.append((scope, row.sample, item, category, tokens, "removed", -tokens))
        changes.sort(key=lambda c: (-abs(c[6]), c[2], c[5]))
        out += changes
        held = {"model": row.model, "items": current}
    state.update((json.dumps(held),))
    yield pd.DataFrame(out, columns=["scope", "sample", "item_id", "category", "tokens", "change", "delta_tokens"])


def stream_context_diff(samples: DataFrame) -> DataFrame:
    """Item changes as samples arrive: ``scope, sample, model, reset, items
    array<struct<item_id, category, tokens>>``.

    The state of a scope is its last item set; a change of model or a reset
    (compaction) starts a new baseline.
    """
    return samples.groupBy("scope").applyInPandasWithState(
        _diff_scope, _CHANGED, "held string", "append", GroupStateTimeout.NoTimeout
    )


def run_available(stream: DataFrame, folder: str, *, mode: str = "append") -> DataFrame:
    """Run a stream over the data there is now and read what it wrote.

    Tasks write each micro-batch below ``folder``; ``batch`` tells them apart,
    so the newest row of a key is the one of the largest batch.
    """
    spark = stream.sparkSession
    out, state = f"{folder}/out", f"{folder}/state"

    def write(frame: DataFrame, batch: int) -> None:
        frame.withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(f"{out}/b={batch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    schema = stream.schema.add("batch", "long")
    return spark.read.schema(schema).option("basePath", out).parquet(f"{out}/b=*").drop("b")
