from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.plans import compare, ingest, items
from spanloom.sources import journals
from spanloom.sources.sinks import markdown_table, write_results
from spanloom.streaming import live
from tests.fixtures import rows


def line(source="hook", timestamp="5", data=None):
    return json.dumps({"source": source, "timestamp": timestamp, "data": {} if data is None else data})


def test_journal_keeps_valid_rows_and_counts_damage(spark, tmp_path):
    bad = ["{not json", line(source=""), line(timestamp="x"), line(timestamp=str(2**64)), line(data=[1]), json.dumps([1]), line(timestamp=7)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "events-1.jsonl").write_text("\n".join([line(data={"k": 1}), *bad, line(timestamp=str(2**64 - 1))]) + "\n")
    (tmp_path / "a" / "events-2.jsonl").write_text(line(data={"k": 2}) + "\n" + line(data={"secret": 3}))
    (tmp_path / "a" / "metadata.json").write_text(json.dumps([{"source": "process_start", "timestamp": "1", "data": {"pid": 7}}]))
    out = journals.read_chunked_journal(spark, str(tmp_path))
    got = sorted(((r.source, json.loads(r.data)) for r in out.collect() if r.source != "hook"), key=str)
    assert got == [
        ("process_start", {"pid": 7}), ("recovery", {"incomplete_chunk": "events-1.jsonl", "corrupt_records": 7}),
        ("recovery", {"incomplete_chunk": "events-2.jsonl", "corrupt_records": 1}),
    ]
    # an unterminated last line is not committed, and its text is not kept
    assert sorted(r.data for r in out.filter("source = 'hook'").collect()) == ['{"k":1}', '{"k":2}', "{}"]


def test_compressed_journals_keep_their_last_row_and_broken_ones_what_is_whole(spark, tmp_path):
    import bz2
    import gzip

    text = "".join(line(timestamp=str(i), data={"pad": hashlib.sha256(str(i).encode()).hexdigest()}) + "\n" for i in range(3000)).encode()
    for name, data in (("whole", gzip.compress(text)), ("open", gzip.compress(text + b'{"source"')), ("broken", gzip.compress(text)[:60_000])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "events-1.jsonl.gz").write_bytes(data)
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "events-7.jsonl.bz2").write_bytes(bz2.compress(text))
    (tmp_path / "other" / "events-8.jsonl").write_bytes(b"")
    (tmp_path / "other" / "notes.txt").write_bytes(text)
    got = {(r.recording, r.source): r.n for r in journals.read_journal(spark, str(tmp_path)).groupBy("recording", "source").agg(F.count("*").alias("n")).collect()}
    broken = got.pop(("broken", "hook"))
    assert 500 < broken < 3000
    assert got == {("whole", "hook"): 3000, ("open", "hook"): 3000, ("open", "recovery"): 1, ("broken", "recovery"): 1, ("other", "hook"): 3000}


def test_ranges_of_a_chunk_hold_each_line_once(spark, tmp_path):
    lines = ["", "a", "b" * 300, "", "é" * 40, *[str(i) for i in range(200)], "\r", "end"]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "events-0.jsonl").write_text("\n".join(lines) + "\n")
    for size in (1, 7, 64, 100_000):
        got = journals.journal_lines(spark, str(tmp_path), splitBytes=str(size)).orderBy("seq").collect()
        assert [r.line for r in got] == lines and all(r.committed for r in got)
    assert journals.journal_lines(spark, str(tmp_path / "nothing")).count() == 0


def test_small_chunks_share_a_task(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"r{i}").mkdir()
        (tmp_path / f"r{i}" / f"events-{i % 3}.jsonl").write_text(f"a{i}\nb{i}\n")
    (tmp_path / "r7" / "events-9.jsonl").write_text("open")
    got = journals.journal_lines(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() <= 3
    want = [(f"r{i}", i % 3, at, f"{x}{i}", True) for i in range(300) for x, at in (("a", 0), ("b", len(f"a{i}") + 1))]
    assert rows(got, "recording", "chunk", "seq", "line", "committed") == sorted([*want, ("r7", 9, 0, None, False)], key=lambda r: tuple((v is not None, v) for v in r))


def test_journal_files_are_read_once(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "events-1.jsonl").write_text(line(data={"k": 1}) + "\nbad\n")
    out = journals.read_journal(spark, str(tmp_path))
    # valid rows and recovery rows both come from the table of parsed lines
    assert "BatchScan journal" not in out._jdf.queryExecution().executedPlan().toString()
    assert rows(out, "chunk", "seq", "source") == [(1, 0, "hook"), (1, len(line(data={"k": 1})) + 2, "recovery")]


def test_heads_share_a_task_and_keep_their_text(spark, tmp_path):
    heads = {f"r{i}": f'[{{"source":"s","timestamp":"{i}","data":{{"pid": {i}}}}}]'.encode() for i in range(300)}
    odd = {
        "two words": b'{"source":"one","timestamp":7,"data":[1,  {"a": "]\\"}"}]}', "empty": b"", "blank": b" \n\t", "none": b"[]", "bad": b'[{"source":', "nulls": b'[{"source":"n","timestamp":"x","data":null},{"data":1.50}]',
        "wide": '[{"source":"\u00e9","timestamp":"1","data":"t"}]'.encode("utf-16"), "_hidden": b'[{"source":"h"}]', ".hidden": b'[{"source":"h"}]', "broken": b'[{"source":"\xff"}]',
    }
    for name, data in (heads | odd).items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "metadata.json").write_bytes(data)
    out = journals.read_chunked_journal(spark, str(tmp_path))
    assert journals.journal_lines(spark, str(tmp_path), heads="true").rdd.getNumPartitions() <= 2
    got = sorted(((r.recording, r.source, None if r.timestamp is None else int(r.timestamp), r.data) for r in out.collect()), key=str)
    want = [(f"r{i}", "s", i, f'{{"pid": {i}}}') for i in range(300)]
    want += [
        ("two%20words", "one", 7, '[1,  {"a": "]\\"}"}]'), ("bad", None, None, None), ("broken", None, None, None), ("nulls", "n", None, None), ("nulls", None, None, "1.50"), ("wide", "\u00e9", 1, "t"),
    ]
    assert got == sorted(want, key=str)
    assert out.select("chunk", "file").distinct().collect() == [(-1, "metadata.json")]
    assert out.select("seq").distinct().count() == len(want)


def test_the_driver_gets_no_list_of_written_files(spark, tmp_path):
    import pickle

    import pyarrow as pa

    from spanloom.sources import journal_source

    n = 2000
    batch = pa.RecordBatch.from_arrays([pa.array([f"r{i // 2}" for i in range(n)]), pa.array([i % 2 for i in range(n)]), pa.array([f"l{i}" for i in range(n)])], ["recording", "chunk", "line"])
    writer = journal_source.JournalWriter({"path": str(tmp_path / "j")}, False)
    first, second = writer.write(iter([batch.slice(0, 1001)])), writer.write(iter([batch.slice(1001)]))
    assert len(pickle.dumps([first, second])) < 1000
    assert not list((tmp_path / "j").rglob("*.jsonl"))
    writer.commit([first, None, second])
    assert {f"{p.parent.name}/{p.name}": p.read_text() for p in (tmp_path / "j").rglob("*") if p.is_file()} == {f"r{i // 2}/events-{i % 2}.jsonl": f"l{i}\n" for i in range(n)}
    # nor does it keep the names of all files that are read
    parts = journal_source.JournalReader({"path": str(tmp_path / "j")}).partitions()
    assert len(pickle.dumps(parts)) < 20 * n
    assert sorted((r.recording, r.chunk, r.start, r.end) for p in parts for r in p.each()) == sorted((f"r{i // 2}", i % 2, 0, len(f"l{i}\n")) for i in range(n))


def test_a_stream_of_a_growing_journal_reads_each_committed_line_once(spark, tmp_path):
    from spanloom.sources.journal_source import JournalSource

    spark.dataSource.register(JournalSource)
    folder = tmp_path / "in" / "r"
    folder.mkdir(parents=True)
    path = folder / "events-0.jsonl"

    def run():
        q = (
            spark.readStream.format("journal").option("splitBytes", "10").load(str(tmp_path / "in")).writeStream.format("parquet")
            .option("checkpointLocation", str(tmp_path / "check")).option("path", str(tmp_path / "out")).trigger(once=True).start()
        )
        q.awaitTermination()
        return sorted((r.chunk, r.at, r.line) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    path.write_text("one\ntwo\nthr")
    assert run() == [(0, 0, "one"), (0, 4, "two")]
    with path.open("a") as f:
        f.write("ee\nfour\n")
    (folder / "events-1.jsonl").write_text("five\nsi")
    assert run() == [(0, 0, "one"), (0, 4, "two"), (0, 8, "three"), (0, 14, "four"), (1, 0, "five")]


def test_two_tasks_cannot_write_one_chunk(spark, tmp_path):
    import pytest

    from spanloom.sources.journal_source import JournalSource, write_journals

    df = spark.range(8).selectExpr("'r' as recording", "0L as chunk", "id as seq", "cast(id as string) as line")
    write_journals(df, str(tmp_path / "good"))
    assert (tmp_path / "good" / "r" / "events-0.jsonl").read_text() == "".join(f"{i}\n" for i in range(8))
    spark.dataSource.register(JournalSource)
    with pytest.raises(Exception, match="several tasks"):
        df.drop("seq").repartition(4).write.format("journal").mode("append").save(str(tmp_path / "bad"))
    assert not list((tmp_path / "bad" / "r").iterdir())


def test_pairs_by_scope_and_closes_with_the_session(spark):
    e = spark.createDataFrame(
        [("s", "tool", "1", "begin", 5), ("s", "tool", "1", "end", 9), ("t", "tool", "1", "begin", 6), ("u", "tool", "2", "begin", 7), ("u", "prompt", "3", "begin", 8)],
        "scope string, event string, id string, phase string, ts long",
    )
    ends = spark.createDataFrame([("t", 20)], "scope string, end_ts long")
    assert rows(ingest.pair_begin_end(e, ends)) == [
        ("s", "tool", "1", 5, 9, False), ("t", "tool", "1", 6, 20, True), ("u", "prompt", "3", 8, 8, True), ("u", "tool", "2", 7, 8, True)
    ]


def test_interrupted_stream_is_closed_innermost_first(spark):
    e = spark.createDataFrame([(1, 1, "begin", 1), (1, 2, "begin", 2), (1, 3, "end", 3), (1, 4, "begin", 4)], "track_id long, id long, phase string, ts long")
    c = spark.createDataFrame([(9, 10, 5.0)], "track_id long, ts long, value double")
    assert rows(ingest.close_partial_recording(e, c), "track_id", "id", "type", "ts") == [(1, 1, "end", 11), (1, 4, "end", 11), (9, None, "zero", 11)]


def test_recordings_from_two_machines_fail(spark):
    s = spark.createDataFrame([(1, 1, None)], "recording long, local_id long, local_parent long")
    two = spark.createDataFrame([(1,), (2,)], "machine_id long")
    import pytest

    with pytest.raises(Exception, match="several machines"):
        ingest.union_recordings(s, two).collect()


def test_text_functions(spark):
    one = spark.range(1)

    def value(column):
        return one.select(column).first()[0]

    lit = F.lit
    assert value(text.privacy_findings(lit("a@example.com /home/user x"))) == []
    assert value(text.privacy_findings(lit("me@corp.io and /Users/jane/x ghp_" + "a" * 20))) == ["credential pattern", "email address", "personal home directory"]
    assert value(text.privacy_findings(lit("api_key = 'abcdefghijklmnop'"))) == ["credential assignment"]
    for code, lines in [("", 0), ("a", 1), ("a\r\nb", 2), ("a\nb\n", 2), ("\r\r", 2)]:
        assert value(text.line_count(lit(code))) == lines
    session = "ABCDEF00-0000-4000-8000-000000000001"
    want = int.from_bytes(hashlib.sha256(f"pi.delegation.first-prompt:{session.lower()}".encode()).digest()[:8], "little")
    assert value(text.delegation_flow_id(lit(session))) == f"{want:016x}"
    assert value(text.delegation_flow_id(lit("no uuid"))) is None
    assert value(text.exit_code(lit("shell"), lit('{"exit_code": -3}'))) == -3
    assert value(text.is_control_script(lit("tools.x__tracing_stop(); tools.tracing_start()")))
    assert not value(text.is_control_script(lit("tools.tracing_stop(); tools.read()")))
    assert value(text.model_label(lit("claude-x-20250101"))) == "claude-x"
    assert value(text.iso_to_ns(lit("1970-01-01T00:00:01.5Z"))) == 1_500_000_000
    assert value(text.iso_to_ns(lit("1970-01-01T00:00:01.123456789Z"))) == 1_123_456_789
    assert value(text.iso_to_ns(lit("1970-01-01T01:00:01+01:00"))) == 1_000_000_000
    assert value(text.iso_to_ns(lit("1969-12-31T23:59:59Z"))) is None and value(text.iso_to_ns(lit("soon"))) is None


def test_context_diff_goldens(spark):
    sets = [("a", 0, "p", "prompts", 1), ("a", 1, "p", "prompts", 1), ("a", 1, "r", "results", 10), ("a", 2, "p", "prompts", 1), ("a", 3, "p", "prompts", 1)]
    df = spark.createDataFrame(sets, "scope string, sample long, item_id string, category string, tokens long")
    samples = spark.createDataFrame([("a", i, "m2" if i == 3 else "m1") for i in range(4)], "scope string, sample long, model string")
    assert rows(items.context_diff(df, samples), "sample", "item_id", "change", "delta_tokens") == [
        (0, "p", "baseline", 1), (1, "r", "added", 10), (2, "r", "removed", -10), (3, "p", "baseline", 1)
    ]
    folded = items.fold_sparse_items(items.encode_sparse_items(df, samples), at="1")
    assert rows(folded, "item_id", "tokens") == [("p", 1), ("r", 10)]


def test_only_the_largest_changes_are_kept(spark):
    many = spark.range(100).selectExpr("'a' as scope", "0L as sample", "concat('i', id) as item_id", "'prompts' as category", "id + 1 as tokens")
    samples = spark.createDataFrame([("a", 0, "m")], "scope string, sample long, model string")
    changes = items.context_diff(many, samples)
    assert items.retained_changes(changes).count() == 100
    kept = items.retained_changes(changes, limit=64)
    assert kept.count() == 64 and kept.agg(F.min("tokens")).first()[0] == 37
    assert rows(items.snapshot_totals(many, changes, limit=64)) == [("a", 0, 5050, 64, 36)]
    assert rows(items.snapshot_totals(many, changes)) == [("a", 0, 5050, 100, 0)]


def test_sections_and_tools_can_be_deleted(spark):
    schema = "scope string, seq long, role string, text string, sections map<string,string>, tools_added array<struct<name:string,description:string>>, tools_removed array<string>"
    m = [
        ("a", 0, "system", "", {"project rules": "old rule", "skill": "x"}, [("read", "d"), ("edit", "d")], None),
        ("a", 1, "user", "hi", {"project rules": "abc", "skill": None}, None, ["read"]),
    ]
    out = rows(items.transcript_items(spark.createDataFrame(m, schema)), "item_id", "category", "tokens")
    assert [(i, c) for i, c, _ in out] == [("message:1", "prompts"), ("section:project rules", "rules"), ("tool:edit", "tools")]
    assert dict((i, n) for i, _, n in out)["section:project rules"] == 1


def test_baseline_delta_needs_both_sides(spark):
    df = spark.createDataFrame([(1, 150), (2, None), (3, 40)], "id long, v long")
    base = spark.createDataFrame([(100,)], "v long")
    assert rows(compare.baseline_delta(df, base, "v")) == [(1, 150, 50, 50.0), (2, None, None, None), (3, 40, -60, -60.0)]
    zero = spark.createDataFrame([(0,)], "v long")
    assert rows(compare.baseline_delta(df.filter("id = 1"), zero, "v")) == [(1, 150, 150, None)]


def test_results_are_written(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    for fmt in ("parquet", "json", "csv", "orc"):
        write_results(df, str(tmp_path / fmt), fmt=fmt)
        assert spark.read.format(fmt).option("header", True).load(str(tmp_path / fmt)).count() == 2
    assert "Unavailable" in markdown_table(df)


def test_stream_emits_open_operations_after_the_timeout(spark, tmp_path):
    (tmp_path / "in").mkdir()
    data = [("s", "tool", 1, "begin", "2024-01-01 00:00:00"), ("s", "tool", 1, "end", "2024-01-01 00:05:00"), ("s", "tool", 2, "begin", "2024-01-01 00:01:00"), ("s", "x", 3, "end", "2024-01-02 00:00:00"), ("s", "tool", 4, "begin", "2024-01-02 00:00:00")]
    df = spark.createDataFrame(data, "scope string, event string, id long, phase string, at string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in" / "p"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in" / "p"))
    out = live.run_available(live.stream_pair_begin_end(stream), str(tmp_path / "run"))
    assert rows(out, "id", "incomplete") == [(1, False), (2, True)]


def test_stream_routing_drops_beyond_its_bound(spark, tmp_path):
    df = spark.range(20).selectExpr("'t' as trace_id", "cast(id as string) as id", "cast(null as string) as parent_id", "cast(null as string) as session", "timestamp'2024-01-01' as at")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = live.run_available(live.stream_route_telemetry(stream, max_waiting=5), str(tmp_path / "run"))
    assert rows(out.select("state").distinct()) == [("dropped",)] and out.count() == 20
