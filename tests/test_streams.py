"""Streams over several micro-batches, restarts, failures and late rows."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerline.streaming import logs as ST


class Fail(Exception):
    pass


@pytest.fixture
def source(spark, tmp_path):
    """``put(rows)`` adds a file; ``stream()`` reads one file a micro-batch."""
    schema = "key string, model string, n long, recorded_at timestamp, input_tokens long, output_tokens long"
    path = f"file://{tmp_path}/in"

    def put(*rows):
        spark.createDataFrame(rows, "key string, model string, n long, at string").select("key", "model", "n", F.col("at").cast("timestamp").alias("recorded_at"), F.col("n").alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens")).coalesce(1).write.mode("append").parquet(path)

    return put, lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), lambda: spark.read.schema(schema).parquet(path), f"file://{tmp_path}/work"


def test_meter_over_days(source):
    """State falls once the watermark passes, late rows are found, results hold over restarts and folding."""
    put, stream, table, folder = source
    put(("a", "m", 5, "2026-01-01 08:00:00"), ("b", "x", 7, "2026-01-01 09:00:00"))
    put(("c", "m", 1, "2026-01-01 20:00:00"))
    sink = ST.run_meter(stream(), folder)
    assert {(r["model"], r["calls"], r["input_tokens"]) for r in sink.rows().collect()} == {("m", 2, 6), ("x", 1, 7)}
    assert len([p for p in sink.progress if p["numInputRows"]]) == 2
    before = max(p["stateOperators"][0]["numRowsTotal"] for p in sink.progress)
    put(("d", "m", 2, "2026-01-05 10:00:00"))
    put(("e", "m", 9, "2026-01-06 10:00:00"))
    sink = ST.run_meter(stream(), folder)
    after = sink.progress[-1]["stateOperators"][0]["numRowsTotal"]
    assert before == 2 and after == 1  # of two days ago nothing is held
    put(("late", "m", 100, "2026-01-01 10:00:00"), ("f", "m", 3, "2026-01-06 11:00:00"))
    sink = ST.run_meter(stream(), folder)
    want = {("2026-01-01", "m", 2, 6), ("2026-01-01", "x", 1, 7), ("2026-01-05", "m", 1, 2), ("2026-01-06", "m", 2, 12)}
    got = lambda: {(str(r["window_start"])[:10], r["model"], r["calls"], r["input_tokens"]) for r in sink.rows().collect()}
    assert got() == want
    assert [(str(r["window_start"])[:10], r["model"], r["missing"]) for r in ST.late_rows(table(), sink).collect()] == [("2026-01-01", "m", 1)]
    sink.compact()
    assert got() == want
    put(("g", "m", 4, "2026-01-06 12:00:00"))
    sink = ST.run_meter(stream(), folder)
    assert got() == want - {("2026-01-06", "m", 2, 12)} | {("2026-01-06", "m", 3, 16)}


def test_one_result_for_each_key(source):
    """Repeats within a batch, in the next one, days later and after a restart; a batch that fails once is run again."""
    put, stream, _, folder = source
    put(("a", "m", 1, "2026-01-01 08:00:00"), ("a", "m", 2, "2026-01-01 07:00:00"), ("b", "m", 3, "2026-01-01 09:00:00"))
    put(("a", "m", 4, "2026-01-03 08:00:00"), ("c", "m", 5, "2026-01-03 09:00:00"))
    sink = ST.run_once(stream(), "key", "recorded_at", folder)
    rows = lambda: sorted((r["key"], r["n"]) for r in sink.rows().collect())
    assert rows() == [("a", 2), ("b", 3), ("c", 5)]
    put(("b", "m", 6, "2026-02-01 08:00:00"), ("d", "m", 7, "2026-02-01 08:00:00"), (None, "m", 8, "2026-02-01 08:00:00"))

    def half(sink, batch, batch_id):
        """Writes the batch, then fails before the stream notes its end."""
        ST.OnceSink.put(sink, batch, batch_id)
        raise Fail

    with pytest.raises(Exception, match="Fail"):
        ST.run_once(stream(), "key", "recorded_at", folder, half)
    assert ("d", 7) in rows()
    put(("d", "m", 9, "2026-05-01 08:00:00"))
    sink = ST.run_once(stream(), "key", "recorded_at", folder)
    assert rows() == [("a", 2), ("b", 3), ("c", 5), ("d", 7)]
    put(("a", "m", 9, "2026-06-01 08:00:00"))
    sink = ST.run_once(stream(), "key", "recorded_at", folder)
    assert rows() == [("a", 2), ("b", 3), ("c", 5), ("d", 7)]


def test_audit_lines_once(source):
    put, stream, _, folder = source
    put(("a", "m", 1, "2026-01-01 08:00:00"))
    put(("a", "m", 1, "2026-01-01 08:00:00"), ("b", "m", 2, "2026-01-01 08:00:00"))
    done = []

    def half(sink, lines, batch_id):
        """The second batch is written and fails."""
        ST.AuditSink.put(sink, lines, batch_id)
        if batch_id == 1 and not done:
            done.append(1)
            raise Fail

    run = lambda each: ST.run_audit(stream(), "step", "me", "recorded_at", "key", "n", folder=folder, each=each)
    with pytest.raises(Exception, match="Fail"):
        run(half)
    sink = run(half)
    put(("c", "m", 3, "2026-01-02 08:00:00"))
    sink = run(ST.AuditSink.put)
    assert sorted(json.loads(json.loads(r["value"])["payload"])["key"] for r in sink.rows().collect()) == ["a", "a", "b", "c"]


def test_guard_over_batches(spark, tmp_path):
    """Runs go on over batches and restarts; a batch that fails after writing is run again; nothing is grouped in Python."""
    schema, path, folder = "run_id string, turn long, action_hash string, observation_hash string, progress boolean", f"file://{tmp_path}/in", f"file://{tmp_path}/work"
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    put(("a", 2, "y", "o", True), ("a", 1, "x", "o", True), ("b", 1, "x", "p", None), ("c", 1, "x", "q", True), ("c", 2, "x", "r", True), ("d", 1, None, "s", True), *[("long", i, f"x{i}", f"o{i}", True) for i in range(1, 9)])
    got = lambda sink: {r["run_id"]: (r["turn"], r["reason"]) for r in sink.rows().collect()}
    assert got(ST.run_guard(stream(), folder)) == {"c": (2, "same_action")}
    # a turn number below the last batch's still comes after it
    put(("a", 0, "z", "o", True), ("b", 2, "y", "t", False), ("c", 3, "x", "q", True), ("d", 2, None, "u", True), ("long", 9, "x9", "o9", True))

    def half(sink, batch, batch_id):
        ST.GuardSink.put(sink, batch, batch_id)
        raise Fail

    with pytest.raises(Exception, match="Fail"):
        ST.run_guard(stream(), folder, half)
    want = {"c": (2, "same_action"), "a": (0, "same_observation"), "d": (2, "same_action")}
    assert got(ST.run_guard(stream(), folder)) == want
    put(("b", 3, "x", "w", False), ("long", 10, "y", "n", True), ("long", 11, "z", "m", True), ("long", 12, "z", "m", True), ("e", 1, "x", "x", True))
    sink = ST.run_guard(stream(), folder)
    assert got(sink) == {**want, "b": (3, "no_progress"), "long": (11, "max_steps")} and sink.rows().count() == 5
    assert spark.read.parquet(f"{sink.folder}/open").where("run_id = 'e'").count() == 1
