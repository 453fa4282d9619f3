"""Readers and writers of the stored tables: Parquet with fixed schemas."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wayloom.sources.schemas import TABLES

#: Columns that rows are sorted by inside files, so that readers can skip row groups.
ORDER = {"edges": ("src", "dst"), "nodes": ("osm_id",), "places": ("id",), "addr_ranges": ("street_norm", "num_start"), "ranks": ("node",), "tiles": ("ty", "tx")}


def write(df: DataFrame, folder: str, table: str) -> int:
    """Writes a table of :data:`TABLES` under ``folder``, clustered by its key; the number of rows. Missing columns become null."""
    kinds = dict(x.rsplit(" ", 1) for x in TABLES[table].split(", "))
    rows = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
    if order := ORDER.get(table):
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/{table}")
    n = seen.get["n"]
    free(df.sparkSession)
    return n


def coordinates(spark: SparkSession, folder: str) -> DataFrame:
    """Only the positions of the stored nodes: lat, lon; no other column is read."""
    return read(spark, folder, "nodes").select("lat", "lon")


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """Reads a table; a file without the expected columns fails at once."""
    df = spark.read.parquet(f"{folder}/{table}")
    wanted = [x.rsplit(" ", 1)[0] for x in TABLES[table].split(", ")]
    if missing := [c for c in wanted if c not in df.columns]:
        raise ValueError(f"{folder}/{table} is no {table} table: it lacks {', '.join(missing)}")
    return df.select(*wanted)


_shipped: set[str] = set()
#: Rows in one batch to a Python worker: whole texts are long.
BATCH_ROWS = 2000


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each application, and keeps their batches small."""
    sc = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if sc.applicationId in _shipped:
        return
    import wayloom

    _shipped.add(sc.applicationId)
    root = Path(wayloom.__file__).parent
    at = tempfile.mkdtemp(prefix="wayloom-code-")  # on the driver, which serves it to the executors
    atexit.register(shutil.rmtree, at, True)
    with zipfile.ZipFile(f"{at}/wayloom.zip", "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"wayloom/{f.relative_to(root)}")
    sc.addPyFile(f"{at}/wayloom.zip")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where it is unset on a local master."""
    sc = spark.sparkContext
    if at := sc.getConf().get("spark.checkpoint.dir"):
        return at.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if (at := sc._jsc.sc().getCheckpointDir()).isDefined():
        return at.get().rstrip("/")
    at = "file://" + tempfile.mkdtemp(prefix="wayloom-")
    sc.setCheckpointDir(at)
    return at


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Deletes a folder when the application ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cuts lineage by writing to the shared folder, which outlives any executor.

    The table is deleted when the application ends, as results may still read it before.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/wayloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_at = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table of :func:`cut` that nothing reads any more."""
    at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.cut_at)
    at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    free(df.sparkSession)


def free(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles of finished jobs now: it does when the driver's JVM collects, which a small job may never make it do."""
    spark.sparkContext._jvm.System.gc()
