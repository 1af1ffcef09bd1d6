"""Change events: debounced batches, bursts, latest states. Each works on a stream and on a table alike."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WRITE, CREATE, REMOVE, RENAME = 2, 1, 4, 8


def stamped(events: DataFrame, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """With an instant for a time column and, on a stream, a watermark."""
    out = events.withColumn(at, F.col(at).cast("timestamp"))
    return out.withWatermark(at, late) if events.isStreaming else out


def debounced(events: DataFrame, key: str, gap: str = "3 seconds", at: str = "ts") -> DataFrame:
    """One batch for each stretch of events without a gap; the timer starts again with each event."""
    out = stamped(events, at).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("events"))
    return out.select(key, F.col("w.start").alias("started"), "events")


def accumulated(events: DataFrame, keys: list[str], op: str = "op") -> DataFrame:
    """The operations on each path, and what to do: removal wins over writing."""
    out = events.groupBy(*keys).agg(F.bit_or(op).alias("ops"))
    gone = F.col("ops").bitwiseAND(F.lit(REMOVE | RENAME)) != 0
    return out.withColumn("action", F.when(gone, "delete").otherwise("index"))


def bursts(events: DataFrame, key: str, width: str = "60 seconds", least: int = 500, at: str = "ts") -> DataFrame:
    """Windows with so many events that everything is indexed again.

    The windows are aligned to the clock: a burst that a window's edge divides, with fewer than `least` events on either
    side, is lost. exact_bursts, over the sorted events of one key, finds it.
    """
    out = stamped(events, at).groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("events")).where(F.col("events") >= least)
    return out.select(key, F.col("w.start").alias("started"), "events")


def exact_bursts(events, width_s: float = 60.0, least: int = 500):
    """(start, count) of bursts in sorted event seconds; a window begins with the first event after the last one ended."""
    start, n, out = None, 0, []
    for t in events:
        if start is None or t - start > width_s:
            start, n = t, 0
        n += 1
        if n == least:
            out.append((start, n))
    return out


def session_batches(events: DataFrame, key: str, path: str = "path", op: str = "op", gap: str = "3 seconds", at: str = "ts") -> DataFrame:
    """Debounced batches of each key with what is to be done for each path in them: the operations are or-ed, removal wins."""
    out = stamped(events, at).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.collect_list(F.struct(path, op)).alias("each"))
    ops = F.aggregate("each", F.create_map().cast("map<string,int>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x[path]), F.create_map(x[path], F.coalesce(F.try_element_at(m, x[path]), F.lit(0)).bitwiseOR(x[op].cast("int")))))
    got = out.select(key, F.col("w.start").alias("started"), F.explode(ops).alias(path, "ops"))
    return got.withColumn("action", F.when(F.col("ops").bitwiseAND(F.lit(REMOVE | RENAME)) != 0, "delete").otherwise("index"))


def bursts_by_key(events: DataFrame, key: str, width_s: float = 60.0, least: int = 500, at: str = "ts") -> DataFrame:
    """exact_bursts of each key of a table: its sorted events pass through a state of two numbers.

    Null keys are no key. Events without a time come last and count towards the window that is open then, as in the SQL.
    """
    rows = events.select(F.col(key).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("t")).where("key IS NOT NULL")

    def run(batches):
        now, start, n = None, None, 0
        for batch in batches:
            keys, starts = [], []
            for k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != now or None not in (t, start) and t - start > width_s * 1e6:
                    now, start, n = k, t, 0
                n += 1
                if n == least:
                    keys.append(k)
                    starts.append(start)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.types[0]), pa.array(starts, pa.int64())], ["key", "t"])

    ordered = rows.repartition("key").sortWithinPartitions("key", F.asc_nulls_last("t"))
    return ordered.mapInArrow(run, rows.schema).select(F.col("key").alias(key), F.col("t").alias("started"))


STATES = ("requested", "started", "progress", "complete", "error")


def request_states(events: DataFrame, key: str = "request_id", at: str = "ts") -> DataFrame:
    """Of status events (key, node_id, codebase, status, at): each request's last state, its times and its node's state.

    A request first met by a later state is a row as well; complete and error end it.
    """
    when = lambda *s: F.min(F.when(F.col("status").isin(*s), F.col(at)))
    last = F.max(F.struct(at, "status", "node_id", "codebase"))
    got = events.where(F.col("status").isin(*STATES)).groupBy(key).agg(F.min(at).alias("started_at"), when("complete", "error").alias("completed_at"), last.alias("l"))
    state = F.when(F.col("l.status").isin("started", "progress"), "indexing").otherwise("idle")
    return got.select(key, "started_at", "completed_at", "l.status", "l.node_id", "l.codebase", state.alias("node_status"))


def registered(events: DataFrame, at: str = "ts") -> DataFrame:
    """The nodes (node_id, codebase) whose last event isn't deregister."""
    last = events.groupBy("node_id", "codebase").agg(F.max(F.struct(at, "event")).alias("l"))
    return last.where("l.event <> 'deregister'").select("node_id", "codebase", F.col(f"l.{at}").alias("last_seen"))


def buffered(stream: DataFrame, path: str, finalize, checkpoint: str, every: str = "2 seconds", once: bool = False):
    """Run a stream of raw edges (request_id, final, ...): they wait in a table at `path`; a final row flushes its request.

    finalize(edges, batch number) gets a request's edges, each once: a flushed request's number is written down beside them.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(f"{path}/edges/batch={number}")
        done = df.where("final").select("request_id").distinct()
        waiting = spark.read.option("basePath", f"{path}/edges").parquet(f"{path}/edges").drop("batch")
        flushed = f"{path}/flushed"
        done.write.mode("overwrite").parquet(f"{flushed}/batch={number}")
        before = spark.read.option("basePath", flushed).parquet(flushed).where(F.col("batch") < number).select("request_id").distinct()
        finalize(waiting.join(done, "request_id", "left_semi").join(before, "request_id", "left_anti"), number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**({"availableNow": True} if once else {"processingTime": every})).start()


def status(events: DataFrame, key: str = "request_id", at: str = "ts") -> DataFrame:
    """The last state of each request; a request first seen by a later state is a row as well."""
    return events.groupBy(key).agg(F.min(at).alias("first_seen"), F.max_by("status", at).alias("status"), F.max(at).alias("updated"))
