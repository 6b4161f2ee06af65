"""Structured Streaming over event files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions import text as fn
from tidemark.operators import logs
from tidemark.storage import scratch_path


def event_stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """The table as a stream of files; event time is a timestamp, as watermarks ask for."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "30 days") -> DataFrame:
    """Counts by window and type; in append mode (``resumed``) rows later than the watermark are dropped once a window has closed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "30 days") -> DataFrame:
    """(user_id, started, n): a user's events that lie less than ``gap`` apart are a session."""
    kept = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return kept.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there, to a table in the shared folder that holds the last state of each row."""
    spark, out = stream.sparkSession, scratch_path(stream.sparkSession, name)

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(out)

    query = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", scratch_path(spark, name + "-offsets")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def resumed(stream: DataFrame, out: str, offsets: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is new since the last call with the same ``offsets`` folder, and give all rows so far.

    In append mode a window's state goes once the watermark has passed it, and later rows for it are dropped.
    A batch is written below its own number, so that a batch that is run again after a failure takes its own place.
    """
    spark = stream.sparkSession

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", offsets).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.option("basePath", out).schema(stream.schema).parquet(out)


def first_of_key(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Events without those that repeat a key inside the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def source(spark: SparkSession, kind: str, **options: str) -> DataFrame:
    """A stream by kind: ``tail`` follows text files of a folder, ``files`` Parquet files, ``rate`` makes rows, ``kafka`` needs its package."""
    if kind == "tail":
        return spark.readStream.format("text").load(options["path"])
    if kind == "files":
        return spark.readStream.schema(options["schema"]).parquet(options["path"])
    if kind in ("rate", "kafka"):
        return spark.readStream.format(kind).options(**options).load()
    raise ValueError(f"no such stream: {kind}")


RECORD = "file string, line long, ts_text string, level string, logger string, message string, stacktrace string"
_OPEN = "line long, ts_text string, level string, logger string, message string, stack string, last long"


def log_records(lines: DataFrame, patterns: tuple[str, ...] = (logs.LINE, logs.LOGBACK), idle_ms: int | None = None) -> DataFrame:
    """Records of a stream of (file, line, text) as ``logs.sessionize`` makes them of whole files, however the lines are cut into batches.

    The state of a file is its open record and the number of its last line. A record closes when the next one opens, when a row with a
    null text says that the file has ended, or, with ``idle_ms``, when nothing came for so long; a stream with such a timer goes on until it is stopped, as timers ask for batches without rows. Lines that are not behind the last one have
    been read before and are passed over; those before a file's first structured line belong to no record. Lines
    of one file must come in order from batch to batch; inside a batch they need not.
    """
    part = lambda k: logs.structured(F.col("text"), patterns, k)
    shaped = lines.select("file", F.col("line").cast("long").alias("line"), "text", *[part(k).alias(name) for k, name in ((1, "ts_text"), (2, "level"), (3, "logger"), (4, "message"))], F.coalesce(fn.is_stack_line(F.col("text")), F.lit(False)).alias("is_stack"))
    columns = [c.split()[0] for c in RECORD.split(", ")]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # The open record as it stands: its numbers and head, then the texts that joined it.
        line, ts_text, level, logger, message, stack, last = state.get if state.exists else (None, None, None, None, None, None, -1)
        done: list[tuple] = []

        def close() -> None:
            nonlocal line
            if line is not None:
                done.append((key[0], line, ts_text, level, logger, message, stack))
                line = None

        if state.hasTimedOut:
            close()
            state.remove() if last < 0 else state.update((None, None, None, None, None, None, last))
            yield pd.DataFrame(done, columns=columns)
            return
        rows = pd.concat(list(parts), ignore_index=True).sort_values("line", kind="stable")
        for row in rows.itertuples(index=False):
            if row.line <= last:
                continue
            last = int(row.line)
            if pd.isna(row.text):
                close()
            elif row.level:
                close()
                line, ts_text, level, logger, message, stack = last, row.ts_text, row.level, row.logger, row.message, None
            elif line is not None and row.is_stack:
                stack = row.text if stack is None else f"{stack}\n{row.text}"
            elif line is not None:
                message = f"{message}\n{row.text}"
        state.update((line, ts_text, level, logger, message, stack, last) if line is not None else (None, None, None, None, None, None, last))
        if line is not None and idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(done, columns=columns)

    return shaped.groupBy("file").applyInPandasWithState(step, RECORD, _OPEN, "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)
