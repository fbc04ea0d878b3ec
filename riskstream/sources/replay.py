"""A table played again as a stream: ordered files, one for each micro-batch, some of their rows late.

Rows are dealt to batches by their time, in equal steps from the first to the last.  Rows that `late` holds for come
`behind` batches after their own, the last batch at most.  There are `BATCHES` batches and one more for every `ROWS` rows, so a
file does not grow with the table.  Each file is one task's; their order is that of their times of change, which are set
one after another (so the file system has to keep them, as local ones and HDFS do).  Optional closing rows make a last
file: with a time far ahead they let everything that waits for a watermark come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskstream.functions import micros

BATCHES = 6
ROWS = 5_000_000
#: Rows late by so many batches.
BEHIND = 2


def dealt(table: DataFrame, ts: str, late: Column | None = None, behind: int = BEHIND) -> DataFrame:
    """table with the number of each row's batch."""
    us = micros(F.col(ts).cast("timestamp"))
    n, first, last = table.agg(F.count("*"), F.min(us), F.max(us)).first()
    if not n or first is None:
        return table.withColumn("batch", F.lit(0))
    batches = BATCHES + n // ROWS
    own = F.floor((us - first) * batches / (last - first + 1)).cast("int")
    if late is not None:
        own = F.when(late, F.least(own + behind, F.lit(batches - 1))).otherwise(own)
    return table.withColumn("batch", F.coalesce(own, F.lit(0)))


def play(rows: DataFrame, path: str, batches: tuple[int, int] | None = None, closing: DataFrame | None = None) -> None:
    """Writes rows(..., batch) as files of the folder, by batch; of all batches, or of those from batches[0] up to batches[1].

    Call it again with later batches to let a stream go on.
    """
    spark = rows.sparkSession
    if closing is not None:
        last = rows.agg(F.coalesce(F.max("batch"), F.lit(0))).first()[0]
        rows = rows.unionByName(closing.withColumn("batch", F.lit(last + 1)))
    if batches:
        rows = rows.where(F.col("batch").between(batches[0], batches[1]))
    rows.repartition("batch").write.mode("append").partitionBy("batch").parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    for folder in fs.listStatus(at):
        name = folder.getPath().getName()
        if name.startswith("batch="):
            for file in fs.listStatus(folder.getPath()):
                fs.setTimes(file.getPath(), 1_600_000_000_000 + 60_000 * int(name.split("=")[1]), -1)


def replayed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The files as a stream, one a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/batch=*")
