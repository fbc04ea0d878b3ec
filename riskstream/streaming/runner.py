"""Running streams and reading what they report."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener


def drain(*writers: DataStreamWriter, seconds: float = 120) -> list[StreamingQuery]:
    """Runs streams over what there is now; raises if one fails, stops those that do not end in time and raises as well."""
    queries = [w.trigger(availableNow=True).start() for w in writers]
    try:
        for q in queries:
            if not q.awaitTermination(seconds):
                raise TimeoutError(f"{q.name or q.id} did not end within {seconds} s")
    finally:
        for q in queries:
            if q.isActive:
                q.stop()
    return queries


def run_for(writer: DataStreamWriter, seconds: float, every: str = "5 seconds") -> dict:
    """A live stream for some time: its rows, its batches, and its error if it had one."""
    q = writer.trigger(processingTime=every).start()
    try:
        q.awaitTermination(seconds)
    finally:
        q.stop()
    done = [normalized(p) for p in q.recentProgress]
    return {"rows": sum(p["num_input_rows"] for p in done), "batches": len(done), "error": str(q.exception()) if q.exception() else None}


def normalized(progress) -> dict:
    """The fields of a progress report that recovery checks compare; offsets as objects where they are JSON."""
    p = progress if isinstance(progress, dict) else json.loads(progress.json)
    first = (p.get("sources") or [{}])[0]

    def offset(value):
        try:
            return json.loads(value) if isinstance(value, str) else value
        except ValueError:
            return value

    return {
        "batch_id": p.get("batchId"), "num_input_rows": p.get("numInputRows") or 0, "input_rows_per_second": p.get("inputRowsPerSecond"),
        "watermark": (p.get("eventTime") or {}).get("watermark"), "source_start_offset": offset(first.get("startOffset")), "source_end_offset": offset(first.get("endOffset")),
        "source_latest_offset": offset(first.get("latestOffset")),
    }


def lag(progress) -> int | None:
    """Records between the end and the latest offsets, where both count by partition (as brokers' do); null where they are not known."""
    p = normalized(progress)
    end, latest = p["source_end_offset"], p["source_latest_offset"]
    if not isinstance(end, dict) or not isinstance(latest, dict):
        return None
    total = 0
    for topic, parts in latest.items():
        for part, n in parts.items():
            total += n - end.get(topic, {}).get(part, 0)
    return total


def partition_lag(latest: dict, committed: dict | None) -> list[dict]:
    """topic, partition, end, committed and lag of each partition of latest offsets; committed and lag are null where nothing was ever committed."""
    out = []
    for topic, parts in sorted(latest.items()):
        for part, end in sorted(parts.items(), key=lambda p: int(p[0])):
            at = ((committed or {}).get(topic) or {}).get(part)
            out.append({"topic": topic, "partition": int(part), "end": end, "committed": at, "lag": None if at is None else max(0, end - at)})
    return out


class BatchListener(StreamingQueryListener):
    """Calls on_batch(query id, progress) after each batch; add it with spark.streams.addListener."""

    def __init__(self, on_batch: Callable[[str, dict], None]):
        self.on_batch = on_batch

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.on_batch(str(event.progress.id), normalized(event.progress))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


PROGRESS = "query string, batch_id long, num_input_rows long, watermark timestamp"


class ProgressLog(StreamingQueryListener):
    """Writes each batch's normalized progress, a small file each, to a folder that may be read as a table; use it as a context."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.ended, self.changed = spark, path, set(), threading.Condition()

    def __enter__(self) -> ProgressLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *error) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = normalized(event.progress)
        row = {"query": str(event.progress.runId), "batch_id": p["batch_id"], "num_input_rows": p["num_input_rows"], "watermark": p["watermark"]}
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{uuid.uuid4().hex}.json")
        out = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(json.dumps(row).encode()))
        out.close()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.ended.add(str(event.runId))
            self.changed.notify_all()

    def wait(self, queries: Iterable[StreamingQuery], seconds: float = 60) -> None:
        """Until all that these queries reported is written: reports come after the batches, and a query's end after its last report."""
        runs = {str(q.runId) for q in queries}
        with self.changed:
            if not self.changed.wait_for(lambda: runs <= self.ended, seconds):
                raise TimeoutError("progress reports did not arrive")


def progress_table(spark: SparkSession, path: str) -> DataFrame:
    """The reports of a folder, one row a query and batch, with the rows and batches that its query took in after it."""
    own = spark.read.schema(PROGRESS).json(path).where("num_input_rows > 0").dropDuplicates(["query", "batch_id"])
    after = Window.partitionBy("query").orderBy("batch_id").rowsBetween(1, Window.unboundedFollowing)
    return own.withColumns({"rows_left": F.coalesce(F.sum("num_input_rows").over(after), F.lit(0)), "batches_left": F.count("*").over(after)})
