"""Streaming operators over spans and monitoring events (columns ts as timestamp, and identifiers)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import IntegerType, StructField, StructType

from evidentia.storage import new_folder

#: What is held of a breaker: its service, state, failures in a row, probes passed, when it opened; and of a request.
HELD = ("service", "state", "failures", "passed", "opened_us")
WAITING = ("service", "event_id", "at_us", "failed", "logged_before", "logged_after")
PACKED = "rows binary"
#: Buckets of services whose state is kept together.  A call to the state takes milliseconds, so there are few keys however
#: many services there are; a change of this number needs new progress folders.
BUCKETS = 256
TRANSITION_NAMES = ["service", "event_id", "at_us", "state_before", "state_after", "rejected", "violation"]
TRANSITIONS = "service long, event_id long, at_us long, state_before string, state_after string, rejected boolean, violation string"


def to_instant(ts: Column) -> Column:
    """A timestamp without zone as the instant it names in UTC, whatever the session's zone."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts))


def to_local(at: Column) -> Column:
    """The reverse of ``to_instant``."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(at), F.expr("timestamp_ntz'1970-01-01 00:00:00'"))


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A file, or a folder of files, of events as a stream, with ts as an instant.  (Only a pattern may name a single file.)"""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", to_instant(F.col("ts")))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for the files there are now, written exactly once and read back."""
    path = new_folder(stream.sparkSession)
    (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-progress").outputMode(mode)
     .trigger(availableNow=True).start().awaitTermination())
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def ingest_spans(spans: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each (trace_id, span_id) once; state is dropped when the watermark has passed."""
    return spans.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["trace_id", "span_id"])


def monitoring_windows(events: DataFrame, width: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Requests, errors and mean value of half-open windows, given out when the watermark has passed their end."""
    return (events.withWatermark("ts", delay).groupBy(F.window("ts", width, slide)).agg(
        F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"), F.avg("value").alias("mean_value"))
        .select(F.col("window.start").alias("started_at"), F.col("window.end").alias("ended_at"), "requests", "errors", "mean_value"))


def sessions(spans: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of each trace that the watermark has closed."""
    return (spans.withWatermark("ts", delay).groupBy("trace_id", F.session_window("ts", gap)).agg(F.count("*").alias("spans"))
            .select("trace_id", F.col("session_window.start").alias("started_at"), "spans"))


def route_late(events: DataFrame, window: str = "1 day") -> DataFrame:
    """Where each event goes: accepted, or rejected if it ends (ended_at) after the window it began in."""
    return events.withColumn("sink", F.when(F.col("ended_at") > F.window("ts", window)["end"], "rejected").otherwise("accepted"))


def parent_child(parents: DataFrame, children: DataFrame, within: str = "7 days", delay: str = "1 hour") -> DataFrame:
    """Stream-stream join of spans with their parents, which began at most ``within`` before."""
    p = parents.select(F.col("trace_id").alias("p_trace"), F.col("span_id").alias("p_span"), F.col("component").alias("source"), F.col("ts").alias("p_ts")).withWatermark("p_ts", delay)
    c = children.select("trace_id", "span_id", "parent_span_id", F.col("component").alias("target"), "ts").withWatermark("ts", delay)
    near = F.expr(f"ts >= p_ts AND ts <= p_ts + INTERVAL {within}")
    return c.join(p, (F.col("trace_id") == F.col("p_trace")) & (F.col("parent_span_id") == F.col("p_span")) & near).select("trace_id", "span_id", "parent_span_id", "source", "target")


def rolling_edges(edges: DataFrame, base: str | None = None, progress: str | None = None) -> DataFrame:
    """(source, target, channels, seen) after all batches: each batch is folded into a new version of the edge table.

    A version is a folder named by its batch, begun from the last one before it, so a repeated batch writes the same version
    again; with the ``base`` and ``progress`` folders of an earlier run the stream goes on where that ended."""
    spark = edges.sparkSession
    base, progress = base or new_folder(spark), progress or new_folder(spark)
    schema = "source string, target string, channels array<string>, seen long"

    def versions() -> list[int]:
        """The batches whose versions were written whole."""
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        return sorted(int(n) for n in names if n.isdigit() and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{n}/_SUCCESS")))

    def upsert(batch: DataFrame, number: int) -> None:
        new = batch.groupBy(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target")).agg(F.collect_set("channel").alias("channels"), F.count("*").alias("seen"))
        before = [n for n in versions() if n < number]
        if before:
            new = new.unionByName(spark.read.schema(schema).parquet(f"{base}/{before[-1]}"))
        (new.groupBy("source", "target").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("channels")))).alias("channels"), F.sum("seen").alias("seen"))
         .write.mode("overwrite").parquet(f"{base}/{number}"))

    edges.writeStream.foreachBatch(upsert).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    there = versions()
    return spark.read.schema(schema).parquet(f"{base}/{there[-1]}") if there else spark.createDataFrame([], schema)


class Breaker:
    """Closed until some failures in a row; open, rejecting all, until the cooldown is over; half-open until enough probes pass."""

    def __init__(self, threshold: int = 2, cooldown_us: int = 3_600_000_000, probes: int = 2, held: tuple | None = None) -> None:
        self.threshold, self.cooldown_us, self.probes = threshold, cooldown_us, probes
        self.state, self.failures, self.passed, self.opened_us = held or ("closed", 0, 0, 0)

    def held(self) -> tuple[str, int, int, int]:
        return self.state, self.failures, self.passed, self.opened_us

    def see(self, at_us: int, failed: bool) -> tuple[str, str, bool]:
        """State before and after a request, and whether it was rejected."""
        if self.state == "open" and at_us - self.opened_us >= self.cooldown_us:
            self.state, self.passed = "half_open", 0
        before = self.state
        if before == "open":
            return before, before, True
        if failed:
            self.failures += 1
            if before == "half_open" or self.failures >= self.threshold:
                self.state, self.opened_us, self.failures = "open", at_us, 0
        else:
            self.failures = 0
            self.passed += before == "half_open"
            if before == "half_open" and self.passed >= self.probes:
                self.state = "closed"
        return before, self.state, False


def violation(said: tuple[str, str, bool], before: str | None, after: str | None) -> str | None:
    """Which of the states that were logged, if any, the replay contradicts."""
    return "state_before" if before is not None and before != said[0] else "state_after" if after is not None and after != said[1] else None


def replay_breakers(requests: DataFrame, threshold: int = 2, cooldown_us: int = 3_600_000_000, probes: int = 2) -> DataFrame:
    """Replay of (service, event_id, at_us, failed, logged_before, logged_after): each service's rows come sorted to one task, which
    holds one breaker and no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = breaker = None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if breaker is None or r.service != service:
                    service, breaker = r.service, Breaker(threshold, cooldown_us, probes)
                said = breaker.see(r.at_us, r.failed)
                out.append((r.service, r.event_id, r.at_us, *said, violation(said, r.logged_before, r.logged_after)))
            yield pd.DataFrame(out, columns=TRANSITION_NAMES)

    ordered = requests.select("service", "event_id", "at_us", "failed", "logged_before", "logged_after").repartition("service").sortWithinPartitions("service", "at_us", "event_id")
    return ordered.mapInPandas(run, TRANSITIONS)


def _packed(rows: pa.Table) -> bytes:
    """Rows in Arrow's stream format."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as writer:
        writer.write_table(rows)
    return out.getvalue().to_pybytes()


def _unpacked(rows: bytes) -> list[tuple]:
    table = pa.ipc.open_stream(rows).read_all()
    return list(zip(*[c.to_pylist() for c in table.columns], strict=True))


class _Replay(StatefulProcessor):
    """Holds the requests of a bucket of services until the watermark has passed them, then replays them in order; state is a
    breaker for each service and what lies within the watermark's delay, both packed, so a call to the state moves many."""

    def __init__(self, threshold: int, cooldown_us: int, probes: int) -> None:
        self.policy = threshold, cooldown_us, probes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.breakers = handle.getValueState("breakers", PACKED)
        self.waiting = handle.getListState("waiting", PACKED)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        least = None
        for pdf in rows:
            self.waiting.appendValue((_packed(pa.Table.from_pandas(pdf[list(WAITING)], preserve_index=False)),))
            first = int(pdf["at_us"].min())
            least = first if least is None else min(least, first)
        if least is not None:
            self.handle.registerTimer(least // 1000)
        yield pd.DataFrame(columns=TRANSITION_NAMES)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        ready, later = [], []
        for (packed,) in self.waiting.get():
            for r in _unpacked(packed):
                (ready if r[2] // 1000 <= passed else later).append(r)
        if later:
            self.waiting.put([(_packed(pa.table(dict(zip(WAITING, map(list, zip(*later)), strict=True)))),)])
            self.handle.registerTimer(min(r[2] for r in later) // 1000)
        else:
            self.waiting.clear()
        if not ready:
            yield pd.DataFrame(columns=TRANSITION_NAMES)
            return
        held = {service: Breaker(*self.policy, held=b) for service, *b in _unpacked(self.breakers.get()[0])} if self.breakers.exists() else {}
        out = []
        for service, event_id, at_us, failed, before, after in sorted(ready, key=lambda r: (r[2], r[1])):
            breaker = held.get(service)
            if breaker is None:
                breaker = held[service] = Breaker(*self.policy)
            said = breaker.see(at_us, failed)
            out.append((None if service is None else int(service), event_id, at_us, *said, violation(said, before, after)))
        self.breakers.update((_packed(pa.table(dict(zip(HELD, map(list, zip(*[(service, *b.held()) for service, b in held.items()])), strict=True)))),))
        yield pd.DataFrame(out, columns=TRANSITION_NAMES)

    def close(self) -> None:
        pass


def replay_breakers_stream(requests: DataFrame, threshold: int = 2, cooldown_us: int = 3_600_000_000, probes: int = 2, delay: str = "1 hour") -> DataFrame:
    """The same over a stream of (service, event_id, at_us, failed, logged_before, logged_after), with ``violation``: which of the
    logged states the replay contradicts.

    Requests are replayed in order of time and number once the watermark, ``delay`` behind the newest, has passed them,
    however they are spread over files; what comes later than that is dropped and counted in the query's progress.  The
    session's state store must be RocksDB (``rocks``)."""
    # a service as text, which stays exact beside a null
    timed = requests.select(F.col("service").cast("string").alias("service"), *WAITING[1:], F.timestamp_micros("at_us").alias("at"),
                            F.pmod(F.xxhash64("service"), F.lit(BUCKETS)).alias("bucket")).withWatermark("at", delay)
    return timed.groupBy("bucket").transformWithStateInPandas(_Replay(threshold, cooldown_us, probes), TRANSITIONS, "Append", "EventTime")


def rocks(spark: SparkSession) -> None:
    """Keep the state of streams on disk, as stateful processors need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Rows of a slice of time that ``in_order`` writes as one file.
SLICE_ROWS = 1_000_000


def in_order(events: DataFrame, least_slices: int = 4) -> DataFrame:
    """The events (ts as instant) as a stream of files in order of time, one a micro-batch, so that a batch holds a slice of time.

    Streams take files by when they were written, so the slices, of about SLICE_ROWS rows each, are written one after the other,
    from a table that one pass over the events has dealt out by slice."""
    spark, path = events.sparkSession, new_folder(events.sparkSession)
    at = F.unix_micros("ts")
    slices = max(least_slices, -(-events.count() // SLICE_ROWS))
    cuts = sorted(set(events.agg(F.percentile_approx(at, [i / slices for i in range(1, slices)], 10_000).alias("q")).first()["q"] or []))
    # a row without a time is in no slice
    number = reduce(lambda a, b: a + b, [(at > cut).cast("int") for cut in cuts], F.lit(0))
    dealt, name = new_folder(spark), "slice_of_time"
    while name in events.columns:
        name += "_"
    events.withColumn(name, number).write.partitionBy(name).parquet(dealt)
    slices_of = spark.read.schema(StructType([*events.schema, StructField(name, IntegerType())])).parquet(dealt)
    for i in range(len(cuts) + 1):
        slices_of.where(F.col(name) == i).drop(name).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def two_sinks(events: DataFrame, accepted: str, rejected: str, progress: str, window: str = "1 day", delay: str = "1 hour") -> dict[str, int]:
    """Write each event (event_id, ts, ended_at) once, to the folder of the accepted or of the rejected (``route_late``), and tell how
    many rows came in, and were late: older than the watermark, so that Spark dropped them.

    Both folders get a batch in one commit of the stream, under the batch's number, so a batch that is repeated after a failure
    replaces what it had written.  With the progress folder of an earlier run the stream goes on where that ended."""
    once = route_late(events, window).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])

    def take(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for sink, path in (("accepted", accepted), ("rejected", rejected)):
                batch.where(F.col("sink") == sink).drop("sink").write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            batch.unpersist()

    query = once.writeStream.foreachBatch(take).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()
    told = query.recentProgress
    return {"input": sum(p.numInputRows for p in told), "late": sum(o.numRowsDroppedByWatermark for p in told for o in p.stateOperators)}
