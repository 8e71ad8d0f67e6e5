"""Watching a corpus: changes from snapshots, batches between quiet gaps, hooks and incremental checks.

A file stream reports new paths only, so changes come from comparing listings: ``poll`` adds them to a
folder that a stream reads. The rest works on a stream or a table of changes (path, op, ts) alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmere.functions import columns as C
from quillmere.operators.reports import session_starts, sessions
from quillmere.session import listed, remove, stage, unstage
from quillmere.sources.corpus import read_tree

CHANGE = "path string, op string, ts timestamp"


def ignored(path, patterns: list[str]):
    """Whether a path or its file name matches a pattern."""
    return C.matches_any(path, patterns) | C.matches_any(C.base(path), patterns)


def snapshot_changes(before: DataFrame, after: DataFrame, ts: str, ignore: list[str] = ()) -> DataFrame:
    """``CHANGE`` rows between two listings (path, length, mtime_ns), without null paths."""
    b, a = before.select("path", F.col("length").alias("bl"), F.col("mtime_ns").alias("bm"), F.lit(True).alias("was")), after.select("path", F.col("length").alias("al"), F.col("mtime_ns").alias("am"), F.lit(True).alias("is"))
    same = F.col("bl").eqNullSafe(F.col("al")) & F.col("bm").eqNullSafe(F.col("am"))
    op = F.when(F.col("was").isNull(), "create").when(F.col("is").isNull(), "delete").when(~same, "modify")
    out = b.join(a, "path", "full").select("path", op.alias("op"), F.lit(ts).cast("timestamp").alias("ts")).where(F.col("op").isNotNull())
    return out.where(~ignored(F.col("path"), list(ignore))) if ignore else out


def batches(changes: DataFrame, quiet: str = "6 seconds") -> DataFrame:
    """``(batch_start, path, op)``: batches between quiet gaps, the last change of each path."""
    return sessions(changes, "path", "ts", "op", quiet)


def dispatch(changes: DataFrame, hooks: list[dict]) -> DataFrame:
    """``(path, op, action, scope)`` of the hooks that changes fire; nothing is run. Deletions fire none."""
    spark = changes.sparkSession
    table = spark.createDataFrame([(h["op"], h["action"], h.get("scope", ".")) for h in hooks], "op string, action string, scope string")
    inside = (F.col("scope").isin("", ".")) | (F.col("path") == F.col("scope")) | F.startswith("path", F.concat(F.regexp_replace("scope", "/+$", ""), F.lit("/")))
    return changes.where("op <> 'delete'").join(F.broadcast(table), "op").where(inside).select("path", "op", "action", "scope")  # a handful of hooks


def due(changes: DataFrame, runs: DataFrame) -> DataFrame:
    """Paths to run anew: once each, and not for changes stamped before their last run ended; ``runs``: (path, ended_at).

    Sidecars '<stem>.runs.md' are left out.
    """
    latest = changes.where("op <> 'delete'").where(~F.endswith("path", F.lit(".runs.md"))).groupBy("path").agg(F.max("ts").alias("ts"))
    ended = runs.groupBy("path").agg(F.max("ended_at").alias("ended_at"))
    return latest.join(ended, "path", "left").where(F.col("ended_at").isNull() | (F.col("ts") > F.col("ended_at"))).select("path", "ts")


def counters(changes: DataFrame, fired: DataFrame) -> DataFrame:
    """One row: changes processed, hooks fired, the last change."""
    seen = changes.agg(F.count(F.lit(1)).alias("processed"), F.max("ts").alias("last_at"))
    return seen.join(fired.agg(F.count(F.lit(1)).alias("fired")), F.lit(True))  # one row each


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length, mtime_ns)`` of the pages below a directory; contents aren't read."""
    return read_tree(spark, root).select("path", "length", "mtime_ns")


def poll(spark: SparkSession, root: str, folder: str, ts: str, ignore: list[str] = ()) -> int:
    """Compare the pages below ``root`` with those of the last poll and add the changes to ``folder``/changes; how many there were.

    ``changes`` is what a stream reads. The listing is kept for each poll, so that one that failed halfway
    is made again from the last whole one; the first poll finds all pages created.
    """
    kept = f"{folder.rstrip('/')}/listings"
    numbers = [n for n in _numbers(spark, kept) if "_SUCCESS" in listed(spark, f"{kept}/{n}")]
    last = max(numbers, default=-1)
    now = stage(listing(spark, root), "listing")
    before = spark.read.schema(now.schema).parquet(f"{kept}/{last}") if numbers else now.limit(0)
    changes = stage(snapshot_changes(before, now, ts, ignore), "changes")
    n = changes.count()
    if n:
        changes.write.mode("append").parquet(f"{folder.rstrip('/')}/changes")
    now.write.mode("overwrite").parquet(f"{kept}/{last + 1}")
    for old in numbers[:-1]:
        remove(spark, f"{kept}/{old}")
    unstage(now)
    unstage(changes)
    return n


def closed(pending: DataFrame, quiet: str = "6 seconds", late: str = "1 minute") -> tuple[DataFrame, DataFrame]:
    """The finished batches ``(batch_start, path, op)`` of pending changes, each path with its last, and the changes of open ones.

    A batch is finished when a change has come that is later than its last one by the gap and the lateness.
    """
    held = pending.where(F.col("ts").isNotNull())
    placed = session_starts(held.select("path", "op", "ts"), "ts", quiet)
    horizon = held.agg(F.max("ts").alias("horizon"))
    ends = placed.groupBy("batch_start").agg(F.max("ts").alias("end")).crossJoin(F.broadcast(horizon))  # one row
    done = ends.select("batch_start", (F.col("end") + F.expr(f"INTERVAL {quiet}") + F.expr(f"INTERVAL {late}") < F.col("horizon")).alias("done"))
    placed = placed.join(done, "batch_start")
    finished = placed.where("done").groupBy("batch_start", "path").agg(F.max_by("op", F.struct("ts", "op")).alias("op"))
    return finished, placed.where("NOT done").select("path", "op", "ts")


def start(changes: DataFrame, handle: Callable[[DataFrame], None], checkpoint: str, quiet: str = "6 seconds", late: str = "1 minute", once: bool = False) -> StreamingQuery:
    """Run ``handle`` on the changes (batch_start, path, op) of finished batches.

    The changes of open batches are a table beside the checkpoint, one for each micro-batch, so no task
    holds a whole batch as state. A micro-batch that is run again begins from the table before it and
    gives the same; ``handle`` should bear a repetition. Changes later than the lateness open a batch of their own.
    """
    folder = f"{checkpoint.rstrip('/')}/pending"

    def each(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        before = max((n for n in _numbers(spark, folder) if n < number), default=None)
        pending = rows.select("path", "op", "ts")
        if before is not None:
            pending = pending.unionByName(spark.read.schema(CHANGE).parquet(f"{folder}/{before}"))
        pending = stage(pending, "watch-pending")
        finished, left = closed(pending, quiet, late)
        finished = stage(finished, "watch")
        left.write.mode("overwrite").parquet(f"{folder}/{number}")
        if finished.head(1):
            handle(finished)
        unstage(pending)
        for old in _numbers(spark, folder):
            if old < number - 1:
                remove(spark, f"{folder}/{old}")

    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """The micro-batches that have a table."""
    return sorted(int(name) for name in listed(spark, folder) if name.isdigit())


def status(query: StreamingQuery) -> dict:
    """What a watch run is doing, from its own progress: the last micro-batch, rows so far in it, whether data waits, and the last error."""
    last = query.lastProgress
    failure = query.exception()
    return {
        "id": str(query.id), "active": query.isActive, "message": query.status["message"], "waiting": query.status["isDataAvailable"], "batch": last.batchId if last else None, "rows": last.numInputRows if last else 0, "rows_per_second": last.processedRowsPerSecond if last else 0.0, "error": str(failure) if failure else None,
    }
