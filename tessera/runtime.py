"""Session helpers: cutting lineage, size-checked broadcasts, table access."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers once a session, unless ``PYTHONPATH`` already gives it to them."""
    root, app = Path(__file__).resolve().parent.parent, spark.sparkContext.applicationId
    if app in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    folder = tempfile.mkdtemp(prefix="tessera-ship-")  # of the driver; Spark copies the file to the workers
    archive = Path(folder, "tessera.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "tessera").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by all executors: ``spark.checkpoint.dir`` of the session.

    Only where neither the setting nor a checkpoint folder exists (tests in local
    mode) is a temporary folder of this machine set.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        told = spark.conf.get("spark.checkpoint.dir", None)
        if told is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        spark.sparkContext.setCheckpointDir(told or tempfile.mkdtemp(prefix="tessera-"))
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder; later steps read from it the columns they need.

    The tables of a session are removed when it ends.
    """
    spark = df.sparkSession
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    root = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}")
    store = root.getFileSystem(jsc.hadoopConfiguration())
    store.mkdirs(root)
    store.deleteOnExit(root)
    path = f"{root.toString()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only if ``df`` is counted to hold ``max_rows`` rows or fewer.

    Beyond that the frame is returned as it is and the planner shuffles both sides.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def bounded_rows(df: DataFrame, max_rows: int, what: str) -> list:
    """Rows of a table that must be small; more than ``max_rows`` is an error, not a truncation."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows")
    return rows


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def digest(*cols: Column) -> Column:
    """128 bits of the given strings as one binary value, for keys that replace long texts."""
    return F.unhex(F.md5(F.concat_ws("\u0001", *cols)))
