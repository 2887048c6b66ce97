"""Jobs as events (job, status, ts, message): latest state, transitions, steps, queues, durations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The legal moves of each kind of job.
MOVES = {
    "sr": [("queued", "processing"), ("processing", "tiling"), ("tiling", "completed")],
    "wow": [("queued", "fetching"), ("fetching", "processing"), ("queued", "processing"), ("processing", "tiling"), ("tiling", "completed"), ("processing", "completed")],
    "vectors": [("queued", "processing"), ("processing", "completed")],
    "pipeline": [("queued", "fetching"), ("fetching", "tiling_original"), ("tiling_original", "processing_sr"), ("processing_sr", "tiling_sr"), ("tiling_sr", "completed")],
}
TERMINAL_GOOD = ("completed", "fulfilled", "delivered")
TERMINAL_BAD = ("failed", "cancelled", "error")


def latest(events: DataFrame, job: str = "job_id", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """(job, status, ts, n): the last event of each job."""
    return events.groupBy(job).agg(F.max_by("status", F.struct(ts, order)).alias("status"), F.max(ts).alias("ts"), F.count(F.lit(1)).alias("n"))


def transitions(events: DataFrame, moves: list[tuple[str, str]], job: str = "job_id", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """(before, after, n, legal) over all jobs; any status may fail."""
    steps = events.withColumn("before", F.lag("status").over(Window.partitionBy(job).orderBy(ts, order))).where(F.col("before").isNotNull())
    legal = F.concat_ws(">", "before", "status").isin([f"{a}>{b}" for a, b in moves]) | F.col("status").isin(*TERMINAL_BAD)
    return steps.groupBy("before", F.col("status").alias("after")).agg(F.count(F.lit(1)).alias("n"), F.first(legal).alias("legal"))


def steps_of(events: DataFrame, job: str = "job_id", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """(job, steps): each job's events as an ordered array of step structs."""
    step = F.struct(F.col(ts), F.col(order), F.col("status"))
    ordered = F.array_sort(F.collect_list(step))
    return events.groupBy(job).agg(F.transform(ordered, lambda s, i: F.struct((i + 1).alias("step"), s["status"].alias("name"))).alias("steps"))


def durations(events: DataFrame, job: str = "job_id", ts: str = "ts", done: tuple[str, ...] = TERMINAL_GOOD) -> DataFrame:
    """(job, seconds) from a job's first event to its last good end, 0 without an end."""
    return events.groupBy(job).agg((F.coalesce(F.unix_micros(F.max(F.when(F.col("status").isin(*done), F.col(ts))).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp")), F.lit(0)) / 1e6).alias("seconds"))


def queue_order(requests: DataFrame, slots: int, queue: str, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """First in, first out with so many places: each request's place in its queue, slot and turn."""
    place = F.row_number().over(Window.partitionBy(queue).orderBy(ts, order))
    return requests.withColumn("place", place).withColumn("slot", (F.col("place") - 1) % slots).withColumn("turn", F.floor((F.col("place") - 1) / slots).cast("bigint"))


def transitions_by_kind(events: DataFrame, kind: str, job: str = "job_id", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """(kind, before, after, n, legal) where each job's kind says which moves are legal; any status may fail."""
    steps = events.withColumn("before", F.lag("status").over(Window.partitionBy(job).orderBy(ts, order))).where(F.col("before").isNotNull())
    move = F.concat_ws(">", kind, "before", "status")
    legal = move.isin([f"{k}>{a}>{b}" for k, moves in MOVES.items() for a, b in moves]) | F.col("status").isin(*TERMINAL_BAD)
    return steps.groupBy(kind, "before", F.col("status").alias("after")).agg(F.count(F.lit(1)).alias("n"), F.first(legal).alias("legal"))


def polled(jobs: DataFrame, every: float, most: float, started: str = "started", ended: str = "ended", status: str = "status") -> DataFrame:
    """Jobs with what a client sees that asks every `every` seconds from the start on, `most` seconds long: polls, waited, seen.

    seen is the end's status at the first poll after it, or 'timeout'; jobs without an end time out.
    """
    seconds = (F.unix_micros(F.col(ended).cast("timestamp")) - F.unix_micros(F.col(started).cast("timestamp"))) / 1e6
    needed = F.when(seconds.isNotNull(), F.greatest(F.ceil(seconds / every), F.lit(0)).cast("bigint"))
    allowed = F.lit(int(most // every))
    in_time = F.coalesce(needed <= allowed, F.lit(False))
    return jobs.withColumn("polls", F.when(in_time, needed).otherwise(allowed) + 1).withColumn("waited", F.when(in_time, needed * every).otherwise(F.lit(float(most)))).withColumn("seen", F.when(in_time, F.col(status)).otherwise("timeout"))


def one_at_a_time(requests: DataFrame, queue: str, arrived: str = "arrived", seconds: str = "seconds", order: str = "event_id") -> DataFrame:
    """Requests of each queue in the order of their arrival, one running at a time: begins and ends, in the seconds of `arrived`.

    A request ends at the latest of all sums that begin with an earlier arrival and run on without a gap: total_i plus the running
    maximum of arrived_j less total_(j - 1).
    """
    before = Window.partitionBy(queue).orderBy(arrived, order).rowsBetween(Window.unboundedPreceding, 0)
    total = requests.withColumn("_total", F.sum(seconds).over(before))
    ends = total.withColumn("ends", F.col("_total") + F.max(F.col(arrived) - F.col("_total") + F.col(seconds)).over(before))
    return ends.withColumn("begins", F.col("ends") - F.col(seconds)).drop("_total")
