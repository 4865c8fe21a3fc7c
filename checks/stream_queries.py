"""Streaming queries over the given tables, run over the data there is now."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanloom.session import shared_folder
from spanloom.sources import journals
from spanloom.streaming import live

QUERIES: dict = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def events(spark: SparkSession, sf: str, streaming: bool = True) -> DataFrame:
    table = spark.read.parquet(f"{sf}/events.parquet")
    raw = table if not streaming else spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.selectExpr(
        "event_id as id", "user_id as u", "event_type as typ", "cast(get_json_object(props, '$.k') as bigint) as k",
        "cast(round(value * 100) as bigint) as cents", "cast(ts as timestamp) as at",
    )


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    return live.run_available(stream, f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}", mode=mode)


@query
def stream_dedup(spark, sf):
    """Every third event is sent twice."""
    sent = events(spark, sf).withColumn("copy", F.explode(F.expr("if(k % 3 = 0, array(1, 2), array(1))")))
    return run(live.stream_dedup(sent, ["id"])).select("id", "u", "typ", "k")


@query
def stream_token_totals(spark, sf):
    rows = events(spark, sf).filter("typ = 'view'").selectExpr(
        "concat('session-', u) as session", "if(k % 7 = 0, null, k * 100) as input_tokens", "if(k % 5 = 0, null, k * 10) as output_tokens"
    )
    out = run(live.stream_token_totals(rows), "update")
    payload = [c for c in out.columns if c not in ("session", "batch")]
    return out.groupBy("session").agg(F.max_by(F.struct(*payload), "batch").alias("p")).select("session", "p.*")


@query
def stream_capture_health(spark, sf):
    rows = events(spark, sf).selectExpr(
        "u as recording", "if(k % 4 = 0, '{broken', to_json(named_struct('source', typ, 'timestamp', cast(id as string), 'data', named_struct('k', k)))) as line"
    )
    out = run(live.stream_capture_health(journals.parse_observations(rows)), "update")
    return out.groupBy("recording").agg(F.max_by(F.struct("rows", "corrupt"), "batch").alias("p")).select("recording", "p.*")


@query
def stream_pair_begin_end(spark, sf):
    def steps(rows: DataFrame) -> DataFrame:
        return rows.selectExpr(
            "concat('s', u) as scope", "typ as event", "id",
            """inline(array_compact(array(named_struct('phase', 'begin', 'at', at),
                 if(k % 4 != 0, named_struct('phase', 'end', 'at', timestampadd(MICROSECOND, cents, at)), null))))""",
        )

    found = run(live.stream_pair_begin_end(steps(events(spark, sf))))
    return live.with_open_operations(found, steps(events(spark, sf, streaming=False))).selectExpr("scope", "event", "id", "unix_micros(start_at) as start_us", "unix_micros(end_at) as end_us", "incomplete")


@query
def stream_prompt_clusters(spark, sf):
    def prompts(streaming: bool) -> DataFrame:
        return live.stream_prompt_clusters(events(spark, sf, streaming).filter("typ = 'signup'").selectExpr("u as capture_id", "at"))

    return live.with_open_windows(run(prompts(True)), prompts(False), ["capture_id", "start_at"]).selectExpr(
        "capture_id", "unix_micros(start_at) as start_us", "unix_micros(end_at) as end_us", "prompts"
    )


@query
def stream_activity_bins(spark, sf):
    def bins(streaming: bool) -> DataFrame:
        return live.stream_activity_bins(events(spark, sf, streaming).selectExpr("typ as kind", "at"))

    return live.with_open_windows(run(bins(True)), bins(False), ["kind", "start_at"]).selectExpr("unix_micros(start_at) as start_us", "kind", "events")


@query
def stream_route_telemetry(spark, sf):
    rows = events(spark, sf).selectExpr(
        "concat('t', u) as trace_id", "cast(id as string) as id", "cast(null as string) as parent_id",
        "if(k % 6 = 0, concat('session-', u), null) as session", "at",
    )
    return run(live.stream_route_telemetry(rows)).select("trace_id", "id", "session", "state")


@query
def stream_context_diff(spark, sf):
    """One sample per response, holding two items that change with it."""
    rows = events(spark, sf).filter("typ = 'view'").selectExpr(
        "concat('s', u) as scope", "id as sample", "concat('m', k div 50) as model", "k % 17 = 0 as reset",
        "array(named_struct('item_id', 'a', 'category', 'prompts', 'tokens', k), named_struct('item_id', concat('b', k % 3), 'category', 'results', 'tokens', 5L)) as items",
    )
    return run(live.stream_context_diff(rows)).drop("batch")
