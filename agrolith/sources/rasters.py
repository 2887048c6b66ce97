"""Raw rasters as a Python data source, and chunk tables in Parquet.

A raw raster is a file of little-endian float32 values, row by row, of a given width. `register` names the source "raw_raster"; options are
path and width, and rows_per_part (rows of a partition).
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Rows(InputPartition):
    def __init__(self, first: int, end: int) -> None:
        self.first, self.end = first, end


class RawRasterReader(DataSourceReader):
    """Reads ranges of rows; each task opens the file at its own offset. The path must be visible to the executors."""

    def __init__(self, options: dict) -> None:
        self.path, self.width = options["path"], int(options["width"])
        self.step = int(options.get("rows_per_part", 1024))

    def partitions(self) -> list[Rows]:
        rows = os.path.getsize(self.path) // (4 * self.width)
        return [Rows(r, min(r + self.step, rows)) for r in range(0, rows, self.step)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        with open(self.path, "rb") as f:
            f.seek(partition.first * self.width * 4)
            values = np.frombuffer(f.read((partition.end - partition.first) * self.width * 4), "<f4").astype(float)
        rows = np.repeat(np.arange(partition.first, partition.end), self.width)
        cols = np.tile(np.arange(self.width), partition.end - partition.first)
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(cols.astype(np.int64)), pa.array(values)], ["row", "col", "v"])


class RawRaster(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_raster"

    def schema(self) -> str:
        return "row bigint, col bigint, v double"

    def reader(self, schema: object) -> RawRasterReader:
        return RawRasterReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RawRaster)


def write_chunks(grid: DataFrame, path: str, size: int = 256, value: str = "v") -> None:
    """Chunks of size x size pixels as arrays in Parquet, by rows of chunks, so that a window prunes files and columns."""
    chunk = grid.withColumn("cy", F.floor(F.col("row") / size)).withColumn("cx", F.floor(F.col("col") / size))
    cells = chunk.groupBy("cy", "cx").agg(F.array_sort(F.collect_list(F.struct("row", "col", F.col(value).alias("v")))).alias("cells"))
    cells.write.mode("overwrite").partitionBy("cy").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.inline("cells"))
