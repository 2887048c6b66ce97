"""Tables in the folder that driver and executors share, to end a lineage; and this package's way to the executors."""

from __future__ import annotations

import atexit
import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder under the warehouse only where a local session has none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may be over; the folder is scratch space
        return


def written(df: DataFrame) -> DataFrame:
    """The same rows, read back from a table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the table behind a written() frame that no later step reads."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/table-" in folder:
            _delete(df.sparkSession, folder)


def written_bytes(spark: SparkSession, name: str, data: bytes) -> str:
    """The path of a file in the shared folder with these bytes; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(data)
    out.close()
    atexit.register(_delete, spark, path)
    return path


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for an application, as an archive in the shared folder."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(written_bytes(spark, f"{root.name}-{context.applicationId}.zip", held.getvalue()))
    _SHIPPED.add(context.applicationId)
