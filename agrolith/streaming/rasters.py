"""Raster files as a stream: the newest file of each group, exact for files that come late or out of order, with expiry of idle groups."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Keeps state on disk and in checkpoints; timers need it.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Newest(StatefulProcessor):
    """State: a part's groups as one table, each with its newest (modified, path) and when its last file was seen.

    A group without files for `idle` milliseconds of event time expires; a part's timer is that of its first group to do so.
    """

    def __init__(self, group: str, idle: int) -> None:
        self.group, self.idle = group, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("newest", T.StructType([T.StructField("data", T.BinaryType())]))

    def _known(self) -> list[pd.DataFrame]:
        return [pa.ipc.open_stream(self.held.get()[0]).read_pandas()] if self.held.exists() else []

    def _keep(self, groups: pd.DataFrame) -> None:
        if groups.empty:
            self.held.clear()
            return
        table, out = pa.Table.from_pandas(groups, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema) as stream:
            stream.write_table(table)
        self.held.update((out.getvalue().to_pybytes(),))
        self.handle.registerTimer(int(groups["seen_ms"].min()) + self.idle)

    def _rows(self, groups: pd.DataFrame, expired: bool) -> pd.DataFrame:
        return groups[[self.group, "path", "modified"]].assign(expired=expired)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the interface's names
        new = pd.concat([b[[self.group, "path", "modified", "seen_ms"]] for b in rows], ignore_index=True)
        groups = newest_rows(pd.concat([*self._known(), new], ignore_index=True), self.group, "seen_ms")
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self._keep(groups)
        yield self._rows(groups[groups[self.group].isin(new[self.group])], False)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        (groups,) = self._known()
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        over = groups["seen_ms"] + self.idle <= now
        self._keep(groups[~over])
        yield self._rows(groups[over], True)

    def close(self) -> None:
        return


def newest_rows(rows: pd.DataFrame, group: str, seen: str) -> pd.DataFrame:
    """The newest row of each group, ties by path, with the last time that any of the group was seen."""
    return rows.assign(**{seen: rows.groupby(group)[seen].transform("max")}).sort_values(["modified", "path"]).drop_duplicates(group, keep="last")


def newest(files: DataFrame, group: str, late: str = "1 hour", idle: timedelta | None = None, parts: int = 1_024) -> DataFrame:
    """(group, path, modified, expired) of each group's newest file, ties by path, whenever it has files; for update mode and `ROCKS` state.

    files: (group, path, modified) with times of modification, and seen, when a file appeared, if groups are to expire: a group whose last
    file was seen more than `idle` before the watermark (`late` behind the latest time seen) gives its row once more as expired, and its state goes. Files
    are compared by modified only, so an old file that appears late changes nothing and a new one wins, in whatever order they come;
    without `idle` no file is ever too late. Rows without group, path or time are left out. Only the newest file of a group in a batch leaves a
    task, so a group that holds most files doesn't load the task that holds its state. State is a row a group; groups that can expire go by
    their hash into `parts`, whose state is read and written as one, since calls for each group would cost more than its files.
    """
    named = files.select(F.col(group), "path", F.col("modified").cast("timestamp").alias("modified"), F.col("modified" if idle is None else "seen").cast("timestamp").alias("seen"))
    named = named.where(F.col(group).isNotNull() & F.col("path").isNotNull() & F.col("modified").isNotNull() & F.col("seen").isNotNull())
    if idle is None:
        best = named.groupBy(group).agg(F.max(F.struct("modified", "path")).alias("b"))
        return best.select(group, "b.path", "b.modified", F.lit(False).alias("expired"))
    timed = named.withColumn("modified", F.unix_micros("modified"))

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield newest_rows(b, group, "seen")

    slim = timed.mapInPandas(combine, timed.schema).withWatermark("seen", late)
    slim = slim.withColumn("seen_ms", F.unix_millis("seen")).withColumn("_part", F.pmod(F.xxhash64(group), F.lit(parts)))
    out = T.StructType([timed.schema[c] for c in (group, "path", "modified")] + [T.StructField("expired", T.BooleanType())])
    found = slim.groupBy("_part").transformWithStateInPandas(Newest(group, idle // timedelta(milliseconds=1)), out, "update", "eventTime")
    return found.withColumn("modified", F.timestamp_micros("modified"))
