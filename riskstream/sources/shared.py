"""Tables in between: written to the folder that driver and executors share, and read again.

Their lineage is cut, and losing an executor loses none of them.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session that names none gets a temporary one; a cluster has to name it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not f"{spark.sparkContext.master}[".startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="riskstream-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame, what: str, by: str | None = None) -> DataFrame:
    """df as a table in the shared folder, in parts by the values of a column if one is named."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
            while "=" in folder.getName():  # a part of a table by some column
                folder = folder.getParent()
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
