"""Structured Streaming over event logs: metering, loop guard, dedup, audit.

Each function takes a streaming DataFrame; the ``run_*`` helpers start it with
``availableNow`` and a checkpoint in the shared folder.  Given the same folder
again they go on where the last run ended.  The sinks write each micro-batch
under its number, so a batch that is run again replaces what it had written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators import logs as L
from ledgerline.sources.io import audit_rows, shared_folder, written


_METER = ["window_start", "model"]


def _dated(usage: DataFrame, window: str) -> DataFrame:
    return usage.select(F.window("recorded_at", window)["start"].alias("window_start"), "model", "recorded_at", "input_tokens", "output_tokens")


def token_meter(usage: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Calls and tokens per window and model, for update mode.

    A window's state is dropped once the watermark, ``late`` behind the newest
    event, has passed its end; rows later than that don't reach it.
    """
    rows = usage.withWatermark("recorded_at", late).groupBy(F.window("recorded_at", window), "model")
    return rows.agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")).select(F.col("window.start").alias("window_start"), "model", "calls", "input_tokens", "output_tokens")


class MeterSink:
    """Where :func:`token_meter` is kept: one folder for each micro-batch, written over if the batch is run again.

    In update mode a batch holds the whole count so far of each window and
    model it touched, so the row of the last batch is the valid one: an upsert
    by key when reading.  :meth:`compact` folds what is there into one folder.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        #: Of the last run: what Spark tells of each micro-batch.
        self.progress: list = []

    def put(self, batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("calls", F.col("calls").cast("long")).write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")

    def rows(self) -> DataFrame:
        """(window_start, model, calls, input_tokens, output_tokens): the newest row of each window and model."""
        every = self.spark.read.parquet(self.folder)
        kept = [c for c in every.columns if c not in (*_METER, "batch")]
        newest = every.groupBy(*_METER).agg(F.max_by(F.struct(*kept), "batch").alias("x"))
        return newest.select(*_METER, *[F.col(f"x.{c}") for c in kept])

    def compact(self) -> None:
        """Folds all batches into the number of the last one, so later batches still come after it."""
        last = self.spark.read.parquet(self.folder).agg(F.max("batch")).first()[0]
        path = f"{self.folder}-folded-{uuid.uuid4().hex}"
        self.rows().write.parquet(path)
        self.spark.read.parquet(path).write.mode("overwrite").parquet(f"{self.folder}/batch={last}")
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in files.listStatus(hadoop):
            name = status.getPath().getName()
            if name.startswith("batch=") and int(name[6:]) < last:
                files.delete(status.getPath(), True)


def run_meter(usage: DataFrame, folder: str | None = None, window: str = "1 day", late: str = "1 hour") -> MeterSink:
    """Meters what is new in the stream ``usage`` since the last run on ``folder``, and returns the sink."""
    folder = folder or shared_folder(usage.sparkSession)
    sink = MeterSink(usage.sparkSession, f"{folder}/meter")
    run = token_meter(usage, window, late).writeStream.foreachBatch(sink.put).option("checkpointLocation", f"{folder}/checkpoint").outputMode("update").trigger(availableNow=True).start()
    run.awaitTermination()
    sink.progress = [p for p in run.recentProgress]
    return sink


def late_rows(usage: DataFrame, sink: MeterSink, window: str = "1 day") -> DataFrame:
    """(window_start, model, missing): rows of ``usage``, read as a table, that the meter didn't count, as they came too late."""
    seen = _dated(usage, window).groupBy(*_METER).agg(F.count("*").alias("n"))
    have = sink.rows().select(*_METER, "calls")
    both = seen.join(have.hint("shuffle_merge"), _METER, "left").withColumn("missing", F.col("n") - F.coalesce("calls", F.lit(0)))
    return both.where("missing > 0").select(*_METER, "missing")


_RESULT = "run_id string, turn long, reason string, batch long, bucket int"
_TURNS = "run_id string, turn long, action_hash string, observation_hash string, progress boolean, batch long, bucket int"


class GuardSink:
    """The first turn at which each run must stop, over any number of micro-batches.

    What a run still needs is its turns so far, at most ``max_steps`` of them, as
    it stops then.  Those of runs that go on, and the results of runs that have
    stopped, lie in folders by micro-batch and by a hash of the run
    (``bucket``).  A batch meets what earlier batches have stored in the buckets
    it touches, and all its runs are judged at once by
    :func:`ledgerline.operators.logs.loop_guard`, in order of batch and turn.
    Both folders of a batch are written over if it is run again.
    """

    def __init__(self, spark: SparkSession, folder: str, max_steps: int = 10, same_observation: int = 3, no_progress: int = 3, buckets: int = 64):
        self.spark, self.folder, self.buckets, self.max_steps = spark, folder, buckets, max_steps
        self.rules = {"max_steps": max_steps, "same_observation": same_observation, "no_progress": no_progress}

    def _stored(self, name: str, schema: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def put(self, log: DataFrame, batch_id: int) -> None:
        order = ("batch", "turn")
        bucket = F.pmod(F.xxhash64("run_id"), F.lit(self.buckets)).cast("int")
        # a turn without progress known is one without progress
        fresh = log.select("run_id", F.col("turn").cast("long").alias("turn"), "action_hash", "observation_hash", F.coalesce("progress", F.lit(False)).alias("progress"), F.lit(batch_id).cast("long").alias("batch"), bucket.alias("bucket"))
        nth = F.row_number().over(Window.partitionBy("run_id").orderBy("turn"))
        # a run stops after max_steps turns at the latest: no later one can matter
        fresh = fresh.withColumn("nth", nth).where(F.col("nth") <= self.max_steps + 1).drop("nth")
        stopped, going = self._stored("stopped", _RESULT), self._stored("open", _TURNS)
        earlier = [x for x in (stopped, going) if x is not None]
        if batch_id > 0 and earlier:
            touched = [r["bucket"] for r in log.select(bucket.alias("bucket")).distinct().collect()]  # at most ``buckets``
            of = lambda x: x.where((F.col("batch") < batch_id) & F.col("bucket").isin(touched))
            if stopped is not None:
                fresh = fresh.join(of(stopped).select("run_id", "bucket").hint("shuffle_merge"), ["bucket", "run_id"], "left_anti").select(*fresh.columns)
            fresh = written(fresh, "turns")
            runs = fresh.select("bucket", "run_id").distinct()
            every = fresh if going is None else fresh.unionByName(of(going).join(runs.hint("shuffle_merge"), ["bucket", "run_id"], "left_semi").select(*fresh.columns))
        else:
            every = fresh = written(fresh, "turns")
        found = L.loop_guard(every, **self.rules, order=order).withColumn("bucket", bucket)
        self._put(found, "stopped", batch_id)
        ended = self.spark.read.schema(_RESULT).parquet(f"{self.folder}/stopped").where(F.col("batch") == batch_id)
        self._put(fresh.drop("batch").join(ended.select("run_id", "bucket").hint("shuffle_merge"), ["bucket", "run_id"], "left_anti"), "open", batch_id)

    def _put(self, rows: DataFrame, name: str, batch_id: int) -> None:
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{name}/batch={batch_id}")

    def rows(self) -> DataFrame:
        """(run_id, turn, reason) of every run that has stopped."""
        stored = self._stored("stopped", _RESULT)
        return (self.spark.createDataFrame([], _RESULT) if stored is None else stored).drop("bucket", "batch")


def run_guard(log: DataFrame, folder: str | None = None, each: Callable[[GuardSink, DataFrame, int], None] = GuardSink.put, **rules) -> GuardSink:
    """Guards what is new in the stream ``log`` since the last run on ``folder``, and returns the sink."""
    folder = folder or shared_folder(log.sparkSession)
    sink = GuardSink(log.sparkSession, f"{folder}/guard", **rules)
    log.writeStream.foreachBatch(lambda batch, i: each(sink, batch, i)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sink


def dedup(events: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """One row per idempotency key within the watermark; :class:`OnceSink` keeps keys for good."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


class OnceSink:
    """One result for each idempotency key, however often and however late it comes again.

    Results and keys lie in folders by a hash of the key (``bucket``) and by
    micro-batch.  A batch is reduced to one row for each key and loses the keys
    that earlier batches have stored, of which it reads the buckets it touches.
    Its rows then replace whatever an earlier try of the same batch has left.
    Nothing is forgotten, and no state is held between batches but the files.
    """

    def __init__(self, stream: DataFrame, folder: str, key: str, order: str, buckets: int = 64):
        self.spark, self.folder, self.key, self.order, self.buckets = stream.sparkSession, folder, key, order, buckets
        self.schema = T.StructType([*stream.schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.LongType())])

    def _stored(self) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.schema(self.schema).parquet(self.folder)

    def put(self, batch: DataFrame, batch_id: int) -> None:
        names = batch.columns
        first = batch.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.min_by(F.struct(*names), F.struct(self.order, F.xxhash64(*names))).alias("x")).select("x.*")
        fresh = first.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        stored = self._stored()
        if stored is not None:
            touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]
            known = stored.where((F.col("batch") < batch_id) & F.col("bucket").isin(touched))
            fresh = fresh.join(known.select(self.key, "bucket").hint("shuffle_merge"), ["bucket", self.key], "left_anti")
        fresh = fresh.select(*names, "bucket")
        fresh.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/batch={batch_id}")

    def rows(self) -> DataFrame:
        stored = self._stored()
        return (self.spark.createDataFrame([], self.schema) if stored is None else stored).drop("bucket", "batch")


def run_once(stream: DataFrame, key: str, order: str, folder: str | None = None, each: Callable[[OnceSink, DataFrame, int], None] = OnceSink.put) -> OnceSink:
    """Takes in what is new in ``stream`` since the last run on ``folder``; ``each`` is what a micro-batch is given to."""
    folder = folder or shared_folder(stream.sparkSession)
    sink = OnceSink(stream, f"{folder}/once", key, order)
    stream.writeStream.foreachBatch(lambda batch, i: each(sink, batch, i)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sink


def run_to_parquet(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs over what is there and returns what was written."""
    spark = stream.sparkSession
    folder = shared_folder(spark)
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


class AuditSink:
    """JSON lines in a folder for each micro-batch, written over if the batch is run again: each event once.

    The folder of a batch is written by one Spark job, whose files appear when it
    commits; a batch that failed before that, or after it and before the stream
    noted its end, is run again with the same rows and replaces them.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def put(self, lines: DataFrame, batch_id: int) -> None:
        lines.select("value").write.mode("overwrite").text(f"{self.folder}/batch={batch_id}")

    def rows(self) -> DataFrame:
        return self.spark.read.text(self.folder).select("value")


def run_audit(stream: DataFrame, event_type: str, actor: str, time: str, *payload: str, folder: str | None = None, each: Callable[[AuditSink, DataFrame, int], None] = AuditSink.put) -> AuditSink:
    """Adds a JSON line for each event that is new in ``stream`` since the last run on ``folder``."""
    folder = folder or shared_folder(stream.sparkSession)
    sink = AuditSink(stream.sparkSession, f"{folder}/audit")

    def put(batch: DataFrame, batch_id: int) -> None:
        each(sink, audit_rows(batch, event_type, actor, F.col(time).cast("string"), *payload), batch_id)

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sink
