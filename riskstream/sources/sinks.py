"""Sinks: tables with versions, files for people, dead letters, and streams' outputs."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StringType, StructField, StructType

from riskstream.operators import parse

_WRITE = "__write"


class TableStore:
    """Parquet tables under a root that Spark can reach; a version is a list of files and the schema.

    Files are never changed.  A write adds files in a folder of its own and then a version that names
    them, by renaming a finished version file to a number that must not be there yet: a reader sees
    one version or the next, and of two writers one has to look again at what the other wrote.
    Appending writes the new rows only, merging rewrites just the files that hold a key of the
    source.  Writing a layer again replaces it instead of doubling its rows.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path("x").getFileSystem(self._conf)

    def history(self, name: str) -> list[int]:
        at = self._path(name, "_versions")
        if not self._fs().exists(at):
            return []
        found = [s.getPath().getName() for s in self._fs().listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in found if n.endswith(".json") and not n.startswith("."))

    def current(self, name: str) -> int | None:
        return max(self.history(name), default=None)

    def _version(self, name: str, version: int | None = None) -> tuple[list[str], StructType]:
        version = self.current(name) if version is None else version
        if version is None or version not in self.history(name):
            raise ValueError(f"there is no table {name}" if version is None else f"{name} has no version {version}")
        stream = self._fs().open(self._path(name, "_versions", f"{version:010}.json"))
        try:
            said = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return said["files"], StructType.fromJson(said["schema"])

    def _commit(self, name: str, version: int, files: list[str], schema: StructType) -> bool:
        """Whether this is now the version of that number."""
        part = self._path(name, "_versions", f".{uuid.uuid4().hex}")
        out = self._fs().create(part, False)
        out.write(bytearray(json.dumps({"files": sorted(files), "schema": schema.jsonValue()}).encode()))
        out.close()
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self._conf)
        try:
            context.rename(part, self._path(name, "_versions", f"{version:010}.json"), self.spark.sparkContext._gateway.new_array(kind, 0))
            return True
        except Exception as error:
            if "FileAlreadyExistsException" not in str(error):
                raise
            self._fs().delete(part, False)
            return False

    def _added(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> list[str]:
        """df's rows as files of the table that no version names yet."""
        folder = f"{_WRITE}={uuid.uuid4().hex}"
        writer = df.write
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{name}/{folder}")
        files = self._fs().listFiles(self._path(name, folder), True)
        found = []
        while files.hasNext():
            found.append(files.next().getPath().toString())
        return [f[f.index(folder) :] for f in found if f.endswith(".parquet")]

    def _changed(self, name: str, change: Callable[[int | None], tuple[list[str], StructType]]) -> int:
        """Commits what change makes of the current version; if another writer was first, of that one's."""
        while True:
            now = self.current(name)
            files, schema = change(now)
            version = -1 if now is None else now
            if self._commit(name, version + 1, files, schema):
                return version + 1

    def write(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> int:
        """df as the table's next version."""
        files = self._added(name, df, partition_by)
        return self._changed(name, lambda now: (files, df.schema))

    def append(self, name: str, df: DataFrame) -> int:
        """df's rows added to the current version, whose files stay as they are."""
        now = self.current(name)
        by = self._partitions(self._version(name, now)[0]) if now is not None else None
        files = self._added(name, df if now is None else df.select(self._version(name, now)[1].names), by)

        def change(now: int | None) -> tuple[list[str], StructType]:
            old, schema = self._version(name, now) if now is not None else ([], df.schema)
            return old + files, schema

        return self._changed(name, change)

    def upsert(self, name: str, source: DataFrame, key: str) -> int:
        """Rows of source replace those of the same key or are added; only files that hold such a key are written again."""

        def change(now: int | None) -> tuple[list[str], StructType]:
            old, schema = self._version(name, now)
            by = self._partitions(old)
            held = self._read(name, old, schema, file=True).join(source.select(key).distinct(), key, "left_semi").select("_file").distinct().collect()
            touched = {self._relative(r["_file"]) for r in held}
            rest = self._read(name, [f for f in old if unquote(f) in touched], schema).join(source.select(key), key, "left_anti")
            return [f for f in old if unquote(f) not in touched] + self._added(name, rest.unionByName(source.select(schema.names)), by), schema

        return self._changed(name, change)

    def restore(self, name: str, version: int) -> int:
        """An older version once more, as the next one."""
        files, schema = self._version(name, version)
        return self._changed(name, lambda now: (files, schema))

    @staticmethod
    def _relative(uri: str) -> str:
        return unquote(uri[uri.rindex(f"{_WRITE}=") :])

    @staticmethod
    def _partitions(files: list[str]) -> list[str]:
        return [part.partition("=")[0] for part in files[0].split("/")[1:-1]] if files else []

    def _read(self, name: str, files: list[str], schema: StructType, file: bool = False) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema)
        base = f"{self.root}/{name}"
        found = self.spark.read.option("basePath", base).schema(StructType([*schema.fields, StructField(_WRITE, StringType())])).parquet(*(f"{base}/{f}" for f in files))
        columns = [F.col(f"`{c}`") for c in schema.names]
        return found.select(*columns, F.input_file_name().alias("_file")) if file else found.select(*columns)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self._read(name, *self._version(name, version))

    def count(self, name: str) -> int:
        return self.read(name).count()

    def drop(self, name: str) -> None:
        self._fs().delete(self._path(name), True)

    def write_json(self, name: str, value: dict) -> None:
        out = self._fs().create(self._path(name), True)
        out.write(bytearray(json.dumps(value, indent=2, default=str).encode()))
        out.close()


def single_csv(spark: SparkSession, df: DataFrame, folder: str, name: str) -> int:
    """A presentation table as folder/name.csv, rows in df's order; returns their number.

    Rows are numbered where they are made and one task, which may spill, writes them in that order; the driver only renames the file.
    """
    part = f"{folder}/.{name}"
    seen = Observation()
    placed = df.observe(seen, F.count(F.lit(1)).alias("n")).withColumn("_at", F.monotonically_increasing_id())
    placed.repartition(1).sortWithinPartitions("_at").drop("_at").write.mode("overwrite").option("header", True).csv(part)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(part).getFileSystem(conf)
    at = path(f"{folder}/{name}.csv")
    fs.delete(at, False)
    files = [s.getPath() for s in fs.listStatus(path(part)) if s.getPath().getName().startswith("part-")]
    if files:
        fs.rename(files[0], at)
    else:
        # nothing to write, not even a header
        out = fs.create(at, True)
        out.write(bytearray((",".join(df.columns) + "\n").encode()))
        out.close()
    fs.delete(path(part), True)
    return int(seen.get["n"])


class DeliveryError(RuntimeError):
    """Records that did not arrive."""


def publish(df: DataFrame, path: str) -> int:
    """A keyed table (key, value) as Parquet files of a folder topic, key and all: the counterpart of a producer.

    Returns how many records were delivered; raises DeliveryError if they are not all there.
    """
    spark, seen, folder = df.sparkSession, Observation(), f"{path}/batch-{uuid.uuid4().hex}"
    try:
        df.selectExpr("cast(key as binary) as key", "cast(value as binary) as value").observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(folder)
    except Exception as error:
        raise DeliveryError(f"nothing was delivered to {path}: {error}") from error
    sent, there = int(seen.get["n"]), spark.read.schema("key binary, value binary").parquet(folder).count()
    if there != sent:
        raise DeliveryError(f"{sent - there} of {sent} records were not delivered to {path}")
    return sent


def to_broker(records: DataFrame, servers: str, topic: str) -> DataStreamWriter:
    return records.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)


def dead_letters(rejected: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Rejected records, key and value as they came, as a growing Parquet folder."""
    return rejected.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)


def console(df: DataFrame, mode: str = "append", rows: int = 20) -> DataStreamWriter:
    return df.writeStream.format("console").outputMode(mode).option("truncate", False).option("numRows", rows)


def memory(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataStreamWriter:
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode)
    return writer.option("checkpointLocation", checkpoint) if checkpoint else writer


def each_batch(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> DataStreamWriter:
    """write(batch, id) for each micro-batch; it should be idempotent in id, since a batch may come again after a restart."""
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode)


def batch_folders(path: str, stamp: str | None = None, run: int | None = None, order: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """A batch writer that is idempotent: each batch overwrites its own folder. stamp: a column for its id; run: a number of the run to keep with the rows.

    With an order, a batch's files follow one another in it, by their times of change too: a stream over the folders that takes
    any number of files at a time meets no row long after later ones.
    """

    def write(batch: DataFrame, n: int) -> None:
        more = ({stamp: F.lit(n).cast("long")} if stamp else {}) | ({"run": F.lit(run)} if run is not None else {})
        own, folder = batch.withColumns(more), f"{path}/batch={n}"
        if not order:
            own.write.mode("overwrite").parquet(folder)
            return
        own = own.persist()  # cutting ranges reads the rows first, and the state they come from is to move once
        try:
            own.repartitionByRange(*order).write.mode("overwrite").parquet(folder)
        finally:
            own.unpersist()
        _timed(batch.sparkSession, folder, FIRST_TIME + 60_000 * n)

    return write


#: Milliseconds since the epoch that times of change of ordered files start from.
FIRST_TIME = 1_600_000_000_000


def _timed(spark: SparkSession, folder: str, ms: int) -> None:
    """Gives the files of a folder, by name, times of change from ms on."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted((f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith("part-")), key=lambda part: part.getName())
    for i, part in enumerate(parts):
        fs.setTimes(part, ms + i, -1)


def sound_folders(path: str) -> Callable[[DataFrame, int], None]:
    """Writes judged records, sound and not, in one job to the batch's folder: it is there with both parts or, without its mark of success, not at all."""
    return lambda batch, n: batch.write.mode("overwrite").partitionBy("sound").parquet(f"{path}/batch={n}")


def sound_and_dead(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Events and dead letters, with their batch, of the batches that were written whole."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []
    whole = [f"{path}/{n}" for n in names if n.startswith("batch=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    schema = StructType([*schema.fields]).add("batch", "long")
    own = spark.read.schema(schema).option("basePath", path).parquet(*whole) if whole else spark.createDataFrame([], schema)
    return parse.events_of(own, "batch"), own.where("not sound").select("key", "value", "batch")


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
