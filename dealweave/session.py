"""Session helpers: where shared files go and how lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

COLLECT_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local one is set only where a local session names none (tests). A cluster's session must name one."""
    sc = spark.sparkContext
    named = sc._jsc.sc().getCheckpointDir()
    if named.isDefined():
        return named.get()
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="dealweave-")
    sc.setCheckpointDir(at)
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives the loss of executors, prunes columns when read.

    The folder belongs to this application; the cluster's cleaning of spark.checkpoint.dir removes it. After a table of some size the driver collects
    its garbage, so the shuffle files that led to it go at once and not when its heap happens to fill.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    fs, folder = _folder(spark, path)
    if fs.getContentSummary(folder).getLength() > COLLECT_BYTES:
        collected(spark)
    return spark.read.schema(df.schema).parquet(path)


def collected(spark: SparkSession) -> None:
    """The driver collects its garbage, and so removes shuffle files of ended queries.

    Listeners hold the plan of the last query that they were told of, also while they wait for another: a query without files takes its place.
    """
    spark.range(1).collect()
    try:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    except Py4JJavaError:  # events come on and on
        pass
    spark.sparkContext._jvm.System.gc()


def dropped(df: DataFrame) -> None:
    """Removes the files of a table that written() gave, once nothing that is still to be computed reads it."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        fs, path = _folder(df.sparkSession, folder)
        fs.delete(path, True)


def _folder(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
