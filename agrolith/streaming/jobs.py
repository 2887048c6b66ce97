"""Job events as a stream: latest states, counts by event time, and a checked state machine."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from agrolith.operators.scratch import shared_dir

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def latest(events: DataFrame) -> DataFrame:
    """(job_id, status, n) so far; for update or complete mode."""
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.count(F.lit(1)).alias("n"))


def by_window(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, status, n) by windows of event time; events later than the watermark are dropped."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("w"), "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "status", "n")


def checked(events: DataFrame, moves: list[tuple[str, str]], bad_end: tuple[str, ...] = ("failed",)) -> DataFrame:
    """(job_id, status, events, illegal) of each job, counting moves that aren't legal; for update mode.

    State is one row a job, so it grows with the number of jobs only.
    """
    legal = frozenset(moves)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, n, illegal = state.get if state.exists else (None, 0, 0)
        for row in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            illegal += status is not None and row.status not in bad_end and (status, row.status) not in legal
            status, n = row.status, n + 1
        state.update((status, n, int(illegal)))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "events": [n], "illegal": [int(illegal)]})

    return events.groupBy("job_id").applyInPandasWithState(
        step, "job_id bigint, status string, events bigint, illegal bigint", "status string, n bigint, illegal bigint", "update", GroupStateTimeout.NoTimeout
    )


def run_available(stream: DataFrame, mode: str, key: str | None = None, provider: str | None = None) -> DataFrame:
    """Run a stream over what is there, and return its result table.

    Complete mode overwrites the table each time; update mode appends each batch, and the last row of each key counts. provider: the class
    of the state store, if not the session's; the session's setting is as before once the stream has started.
    """
    spark: SparkSession = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/out")

    before = spark.conf.get(PROVIDER, None)
    if provider:
        spark.conf.set(PROVIDER, provider)
    try:
        running = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").foreachBatch(keep).trigger(availableNow=True).start()
    finally:
        if provider:
            spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    running.awaitTermination()
    found = spark.read.parquet(f"{at}/out")
    if mode == "update" and key:
        names = [c for c in found.columns if c not in (key, "_batch")]
        found = found.groupBy(key).agg(F.max_by(F.struct(*names), "_batch").alias("s")).select(key, *(f"s.{c}" for c in names))
    return found.drop("_batch")
