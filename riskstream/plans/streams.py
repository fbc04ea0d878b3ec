"""Streaming operators as queries: the events table played again in ordered batches, some rows late, and read to its end.

A twentieth of the rows come two batches after their time.  Queries whose watermark waits for them give what their
batch twins give, and so have the same SQL; for those with a short one SQL works out the watermark of each batch, and so which
rows must go.  A batch drops rows behind the watermark that the batch before ran with, and lets out what its own has passed.
Results are in the folder that `spark.checkpoint.dir` names; inputs and checkpoints are removed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskstream import ml
from riskstream.operators import detectors, parse, risk, windows
from riskstream.operators.tables import deduplicated_stream
from riskstream.plans import stand_ins as t
from riskstream.plans.queries import DAY, EV, SCALED, SQL, _features, malformed_records, out, query
from riskstream.sources import replay, sinks
from riskstream.sources.shared import shared_dir, written
from riskstream.streaming import runner, state
from riskstream.streaming.session import STATE_STORE

#: Longer than late rows are late: two of six batches after their own, at the end of it.
PATIENT = 20 * DAY
_LATE = "event_id % 20 = 7"
_KINDS = ("purchase", "error", "click", "signup", "view")
_WINDOW = ["window_start", "window_end"]


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings as long as a stream is made and runs; then as they were. State has no more partitions than there are cores, since every batch opens them all."""
    partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    names = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE, "spark.sql.shuffle.partitions": str(partitions)} | {k.replace("__", "."): v for k, v in conf.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


#: No batch without rows of its own, so that batches are the files.
_FILES_ONLY = {"spark__sql__streaming__noDataMicroBatches__enabled": "false"}


class Arrivals:
    """The events, or what is made of them, in the order they come in, and a folder of their own."""

    def __init__(self, spark: SparkSession, sf_dir: str, shape: Callable[[DataFrame], DataFrame] = lambda own: own, late: bool = True, closing: bool = False):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.home = spark, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
        own = shape(t.table(spark, sf_dir, "events"))
        self.buckets = state.buckets_for(own.count())
        self.rows = replay.dealt(own, "ts", F.expr(_LATE) if late else None)
        self.schema = own.schema
        self.closing = self._closing(own) if closing else None

    def _closing(self, own: DataFrame) -> DataFrame:
        """A row of each kind, of nobody, a year on."""
        made = own.agg(F.max("ts").alias("ts")).select(F.explode(F.array(*map(F.lit, _KINDS))).alias("event_type"), (F.col("ts") + F.expr("interval 365 days")).alias("ts"))
        given = made.withColumns({"event_id": F.lit(-1), "props": F.lit('{"k": 0}'), "value": F.lit(0.0)})
        return given.select(*((F.col(f.name) if f.name in given.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in own.schema))

    def played(self, first: int | None = None, last: int | None = None) -> Arrivals:
        replay.play(self.rows, f"{self.home}/in", None if first is None else (first, last), self.closing)
        return self

    def raw(self) -> DataFrame:
        return replay.replayed(self.spark, f"{self.home}/in", self.schema)

    def events(self) -> DataFrame:
        return t.shaped(self.raw())

    def run(self, df: DataFrame, mode: str, name: str = "rows", write=None) -> list:
        """Runs df on what has been played until now; called again, it goes on where it stood. What it emits is in its folder by batch."""
        write = write or sinks.batch_folders(f"{self.home}/{name}")
        return runner.drain(sinks.each_batch(df, write, f"{self.home}/checkpoint-{name}", mode), seconds=900)

    def found(self, df: DataFrame, keys: Sequence[str] = (), name: str = "rows") -> DataFrame:
        """What came out, with its batch. In update mode, of the rows that a key had one after another the last."""
        found = self.spark.read.schema(StructType([*df.schema.fields]).add("batch", "long")).parquet(f"{self.home}/{name}")
        if keys:
            place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
            found = found.withColumn("_place", place).where("_place = 1").drop("_place")
        return found

    def done(self, *names: str) -> None:
        for name in ("in", *(names or ("checkpoint-rows",))):
            sinks.remove(self.spark, f"{self.home}/{name}")


def _run(spark: SparkSession, sf_dir: str, make: Callable[[Arrivals], DataFrame], mode: str, keys: Sequence[str] = (), closing: bool = False) -> DataFrame:
    own = Arrivals(spark, sf_dir, closing=closing).played()
    with settings(spark):
        df = make(own)
        own.run(df, mode)
    own.done()
    return own.found(df, keys).drop("batch")


def _arrivals_sql(rows: str = "SELECT * FROM events", late: str = _LATE) -> str:
    """arr: the rows with the batch they come in."""
    return f"""raw AS (SELECT *, epoch_us(ts) AS us FROM ({rows})), lim AS (SELECT min(us) AS lo, max(us) AS hi, {replay.BATCHES} + count(*) // {replay.ROWS} AS n FROM raw),
    arr AS (SELECT raw.*, least((us - lo) * n // (hi - lo + 1) + CASE WHEN {late} THEN {replay.BEHIND} ELSE 0 END, n - 1) AS batch FROM raw, lim)"""


def _marks_sql(delay: int, where: str = "true", of: str = "arr") -> str:
    """marks: of each batch its number, the watermark it runs with (evict) and the one it drops rows by (late), in milliseconds; from events that where holds for."""
    ahead = lambda n: f"max(top) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND {n} PRECEDING) - {delay * 1000}"
    return f"""tops AS (SELECT batch, max(us // 1000) FILTER ({where}) AS top, count(*) AS rows_in FROM {of} GROUP BY batch),
    marks AS (SELECT batch, rows_in, row_number() OVER (ORDER BY batch) - 1 AS id, {ahead(1)} AS evict, {ahead(2)} AS late FROM tops)"""


def _windowed_sql(seconds: int, delay: int, where: str = "true") -> str:
    """kept: rows whose window is not behind the watermark when they come; us is their time and w their window's start."""
    width = seconds * 1_000_000
    return f"""{_arrivals_sql()}, {_marks_sql(delay, where)},
    kept AS (SELECT event_id, user_id AS customer_id, value AS amount, us, us // {width} * {width} AS w FROM arr JOIN marks USING (batch) WHERE ({where}) AND (late IS NULL OR us // {width} * {width} + {width} > late * 1000))"""


@query(SQL["window_tumbling"])
def stream_window_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(_run(spark, sf_dir, lambda own: windows.totals(own.events(), 3600, id_col="event_id"), "update", _WINDOW))


@query(SQL["window_sliding"])
def stream_window_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(_run(spark, sf_dir, lambda own: windows.totals(own.events(), DAY, DAY // 4, id_col="event_id"), "update", _WINDOW))


_BOUNDS = lambda width: f"make_timestamp(w) AS window_start, make_timestamp(w + {width}) AS window_end"


@query(
    f"""WITH {_windowed_sql(3600, 60)} SELECT {_BOUNDS(3600000000)}, count(*) AS tx_count, round(sum(amount), 9) AS amount_sum, round(avg(amount), 9) AS amount_avg
    FROM kept GROUP BY w HAVING w + 3600000000 <= (SELECT max(top) - 60000 FROM tops) * 1000"""
)
def stream_window_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows as they close: those that the watermark of a minute has passed, each once, without rows that came later, with no state kept of them."""
    return out(_run(spark, sf_dir, lambda own: windows.totals(own.events(), 3600, id_col="event_id", watermark=60), "append"))


def _burst_sql(where: str, name: str, over: int, rule) -> str:
    return f"""WITH {_windowed_sql(DAY, DAY, where)} SELECT customer_id, {_BOUNDS(DAY * 1_000_000)}, count(*) AS {name}, round(sum(amount), 9) AS amount_sum,
    '{rule.alert_type}' AS alert_type, {rule.points} AS risk_points FROM kept GROUP BY customer_id, w HAVING count(*) > {over}"""


@query(_burst_sql("true", "tx_count", SCALED.velocity_over, SCALED.velocity))
def stream_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each window once, when a watermark as long as the window has passed it."""
    return out(_run(spark, sf_dir, lambda own: detectors.velocity(own.events().withColumnRenamed("event_id", "transaction_id"), SCALED, watermark=DAY), "append", closing=True))


@query(_burst_sql("event_type = 'error'", "failure_count", SCALED.failures_over, SCALED.failures))
def stream_card_testing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As velocity; the watermark follows the failed payments."""
    return out(_run(spark, sf_dir, lambda own: detectors.card_testing(t.payments(own.events()), SCALED, watermark=DAY), "append", closing=True))


@query(f"WITH {_arrivals_sql()}, {_marks_sql(DAY)} SELECT event_id, late IS NULL OR us > late * 1000 AS kept FROM arr JOIN marks USING (batch)")
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows a watermark of a day keeps and which it drops, told by what an operator with state lets through."""
    kept = _run(spark, sf_dir, lambda own: deduplicated_stream(own.events(), "event_id", DAY).select("event_id"), "append")
    return t.events(spark, sf_dir).select("event_id").join(kept.withColumn("kept", F.lit(True)), "event_id", "left").fillna(False, ["kept"])


def _text_ids(df: DataFrame) -> DataFrame:
    return df.selectExpr("* except (transaction_id, customer_id)", "cast(transaction_id as string) as transaction_id", "cast(customer_id as string) as customer_id")


def _number_ids(df: DataFrame) -> DataFrame:
    return df.selectExpr("* except (transaction_id, customer_id)", "cast(transaction_id as bigint) as transaction_id", "cast(customer_id as bigint) as customer_id")


@query(SQL["impossible_travel"])
def stream_impossible_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows wait for the watermark and go on in order, so late ones make no false jumps."""
    return out(_number_ids(_run(spark, sf_dir, lambda own: state.travel_stream(_text_ids(t.transactions(own.events())), SCALED, watermark=PATIENT, buckets=own.buckets), "append", closing=True)))


def _high_value(own: Arrivals) -> DataFrame:
    return state.high_value_stream(_text_ids(own.events().withColumnRenamed("event_id", "transaction_id")), SCALED, watermark=PATIENT, buckets=own.buckets, peers=False)


@query(SQL["high_value"])
def stream_high_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(_number_ids(_run(spark, sf_dir, _high_value, "append", closing=True)))


def _pairs(own: Arrivals) -> DataFrame:
    return detectors.login_transactions(t.logins(own.events()), t.transactions(own.events()), SCALED, watermark=PATIENT)


@query(SQL["login_transactions"])
def stream_login_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(_run(spark, sf_dir, _pairs, "append"))


def _detectors(own: Arrivals) -> dict[str, tuple[DataFrame, str]]:
    """Alerts of all detectors in one shape, and the mode each runs in: windows tell of a burst as soon as they have it, and again as it grows."""
    tx, every = t.transactions(own.events()), own.events().withColumnRenamed("event_id", "transaction_id")
    window, one = ("window_start", "window_start"), ("transaction_id", "event_ts", "transaction_id")
    return {
        "velocity": (detectors.envelope(detectors.velocity(every, SCALED), *window), "update"),
        "card_testing": (detectors.envelope(detectors.card_testing(t.payments(own.events()), SCALED), *window), "update"),
        "travel": (detectors.envelope(state.travel_stream(_text_ids(tx), SCALED, watermark=PATIENT, buckets=own.buckets), *one), "append"),
        "high_value": (detectors.envelope(_high_value(own), *one), "append"),
        "login": (detectors.envelope(_pairs(own).withColumn("pair", F.concat_ws("+", "login_id", "transaction_id")), "pair", "tx_ts", "transaction_id"), "append"),
    }


def _alert_topic(own: Arrivals) -> DataFrame:
    """What the detectors emit, batch after batch, as a stream of versions of alerts; several files a batch."""
    for name, (df, mode) in _detectors(own).items():
        own.run(df, mode, f"alerts/detector={name}", sinks.batch_folders(f"{own.home}/alerts/detector={name}", "version"))
    schema = StructType([*df.schema.fields]).add("version", "long")
    return own.spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{own.home}/alerts/*/*")


@query(SQL["risk_engine"])
def stream_risk_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors as streams, their alerts in one folder topic, and the engine as a stream over that.

    Windows that grow are told of again, so a topic holds several versions of an alert: the engine keeps an alert's
    points by its id, and a new version takes the old one's place.
    """
    own = Arrivals(spark, sf_dir, closing=True).played()
    with settings(spark):
        df = state.risk_stream(_alert_topic(own), SCALED)
        own.run(df, "update")
    own.done("alerts", *(f"checkpoint-{n}" for n in ("rows", "alerts")))
    return out(own.found(df, ["customer_id", *_WINDOW]).where("alert_count > 0").drop("batch"))


#: Alert files that the engine takes at a time.
_TOPIC_FILES = 4
_DAY_US = DAY * 1_000_000
_RISK_APPEND = f"""WITH {_windowed_sql(DAY, DAY)}, alerts AS (SELECT customer_id, w FROM kept GROUP BY ALL HAVING count(*) > {SCALED.velocity_over})
    SELECT CAST(customer_id AS VARCHAR) AS customer_id, {_BOUNDS(_DAY_US)}, count(*) AS alert_count, '{SCALED.velocity.alert_type}' AS alert_types, CAST({SCALED.velocity.points} * count(*) AS BIGINT) AS total_points,
    'LOW' AS risk_level, make_timestamp(w) AS event_time FROM alerts WHERE w + {_DAY_US} <= (SELECT max(w) FROM alerts) - {_DAY_US} GROUP BY customer_id, w"""


@query(_RISK_APPEND)
def stream_risk_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts in append mode into a topic, and the engine behind a watermark over that: each window's risk once, when no more alerts can come."""
    own = Arrivals(spark, sf_dir, closing=True).played()
    with settings(spark):
        bursts = detectors.velocity(own.events().withColumnRenamed("event_id", "transaction_id"), SCALED, watermark=DAY)
        alerts = detectors.envelope(bursts, "window_start", "window_start")
        own.run(alerts, "append", "alerts", sinks.batch_folders(f"{own.home}/alerts", order=["event_ts", "customer_id"]))
        topic = spark.readStream.schema(alerts.schema).option("maxFilesPerTrigger", _TOPIC_FILES).parquet(f"{own.home}/alerts/*")
        df = risk.risk(topic, SCALED, watermark=DAY)
        own.run(df, "append")
    own.done("alerts", "checkpoint-rows", "checkpoint-alerts")
    return out(own.found(df).drop("batch"))


_SENT = "SELECT event_id, ts, user_id, value FROM events UNION ALL SELECT event_id, ts, user_id, value FROM events UNION ALL SELECT event_id, ts + INTERVAL 10 DAY, user_id, value FROM events WHERE event_id % 10 = 3"


def _sent(own: DataFrame) -> DataFrame:
    return own.unionByName(own).unionByName(own.where("event_id % 10 = 3").withColumn("ts", F.expr("ts + interval 10 days")))


@query(
    f"""WITH {_arrivals_sql(_SENT, "false")}, {_marks_sql(30)}, first AS (SELECT DISTINCT event_id, us, ts, user_id, value FROM arr QUALIFY us = min(us) OVER (PARTITION BY event_id)),
    again AS (SELECT a.* FROM arr a JOIN marks USING (batch) JOIN first f ON a.event_id = f.event_id WHERE a.us > f.us AND a.us > late * 1000 AND f.us + 30000000 <= late * 1000)
    SELECT event_id, user_id AS customer_id, ts AS event_ts, round(value, 9) AS amount FROM (SELECT event_id, user_id, ts, value FROM first UNION ALL SELECT event_id, user_id, ts, value FROM again)"""
)
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event twice at once, and a tenth of them once more ten days later: repeats within 30 seconds go, those after the state of the first has expired count again."""
    own = Arrivals(spark, sf_dir, _sent, late=False).played()
    with settings(spark):
        df = deduplicated_stream(own.events().select("event_id", "customer_id", "event_ts", "amount"), "event_id", 30)
        own.run(df, "append")
    own.done()
    return out(own.found(df).drop("batch"))


_WEEK = 7 * DAY
_RESENT = f"""{_arrivals_sql()}, {_marks_sql(_WEEK)}, kept AS (SELECT value AS amount, us // {_DAY_US} * {_DAY_US} AS w FROM arr JOIN marks USING (batch) WHERE late IS NULL OR us > late * 1000),
    closed AS (SELECT w, min(id) AS batch FROM (SELECT DISTINCT w FROM kept), marks WHERE w + {_DAY_US} <= evict * 1000 GROUP BY w)"""


@query(
    f"""WITH {_RESENT} SELECT CASE WHEN batch < 3 THEN 1 ELSE 2 END AS run, batch, {_BOUNDS(_DAY_US)}, count(*) AS tx_count, round(sum(amount), 9) AS amount_sum, round(avg(amount), 9) AS amount_avg
    FROM kept JOIN closed USING (w) GROUP BY batch, w"""
)
def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query stopped after three batches and started again from its checkpoint, on a stream in which every fifth row is sent again a batch later.

    Window and deduplication state, the watermark and batch ids go on: rows and the batches they come out in are those of an unbroken run.
    """
    own = Arrivals(spark, sf_dir)
    last = own.rows.agg(F.coalesce(F.max("batch"), F.lit(0))).first()[0]
    own.rows = own.rows.unionByName(own.rows.where("event_id % 5 = 0").withColumn("batch", F.least(F.col("batch") + 1, F.lit(last))))
    with settings(spark, **_FILES_ONLY):
        for n, part in enumerate(((0, 2), (3, last)), 1):
            own.played(*part)
            df = windows.totals(deduplicated_stream(own.events(), "event_id", _WEEK), DAY, id_col="event_id")
            own.run(df, "append", write=sinks.batch_folders(f"{own.home}/rows", run=n))
    own.done()
    found = spark.read.schema(StructType([*df.schema.fields]).add("run", "integer").add("batch", "long")).parquet(f"{own.home}/rows")
    return out(found)


def _money(own: Arrivals) -> DataFrame:
    """Transactions and payments as two streams, united."""

    def shaped(kinds: str, id_: str) -> DataFrame:
        k = F.col("k")
        made = own.events().where(f"kind in ({kinds})").withColumns({
            id_: F.col("event_id").cast("string"), "customer_id": F.col("customer_id").cast("string"), "event_ts": F.date_trunc("second", "event_ts"), "merchant_id": k.cast("string"),
            "payment_method": F.when(k % 2 == 0, "CARD").otherwise("UPI"), "device_id": F.concat(F.lit("D"), k % 7),
            "status": F.when(F.col("kind") == "purchase", "APPROVED").when(F.col("kind") == "error", "FAILED").otherwise("SUCCESS"),
        })
        return made.drop("event_id")

    return state.event_union(shaped("'purchase'", "transaction_id"), shaped("'error', 'click'", "payment_id"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.customers(spark, sf_dir).withColumn("customer_id", F.col("customer_id").cast("string"))


@query(SQL["model_features"])
def stream_model_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of every transaction and payment from state, over two united streams, with customers as a static table."""
    found = _run(spark, sf_dir, lambda own: state.with_own_features(state.feature_stream(_money(own), PATIENT, buckets=own.buckets), _customers(spark, sf_dir)), "append", closing=True)
    labels = t.labelled(spark, sf_dir).select(F.col("event_id").cast("string").alias("event_id"), F.lit(1).alias("label"))
    return out(found.drop("amount").join(labels, "event_id", "left").fillna(0, ["label"]))


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, true AS same FROM events WHERE event_type IN ('purchase', 'error', 'click')")
def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each event's score on the stream is that of the same model on the batch features."""
    table = written(_features(spark, sf_dir), "features")
    model = ml.train(table, ml.Params(trees=2, depth=2, rate=0.3))
    found = _run(spark, sf_dir, lambda own: state.scored_stream(model, _money(own), _customers(spark, sf_dir), watermark=PATIENT, buckets=own.buckets), "append", closing=True)
    batch = ml.score(model, table).select("event_id", F.col("fraud_probability").alias("expected"))
    return found.join(batch, "event_id", "left").select("event_id", F.coalesce(F.col("fraud_probability") == F.col("expected"), F.lit(False)).alias("same"))


@query(f"WITH {EV}, {_arrivals_sql()}, {_marks_sql(0)} SELECT event_id, k % 10 > 3 AS ok, id AS batch FROM ev JOIN (SELECT event_id, batch FROM arr) USING (event_id) JOIN marks USING (batch)")
def stream_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound events and dead letters of one stream, parsed once; those of a batch are one write."""
    own = Arrivals(spark, sf_dir).played()
    with settings(spark, **_FILES_ONLY):
        df = parse.judged(malformed_records(own.events()), "transactions")
        own.run(df, "append", write=sinks.sound_folders(f"{own.home}/rows"))
    own.done()
    good, rejected = sinks.sound_and_dead(spark, f"{own.home}/rows", df.schema)
    ids = good.select(F.col("transaction_id").cast("long").alias("event_id"), F.lit(True).alias("ok"), "batch")
    return ids.unionByName(rejected.select(F.col("key").cast("string").cast("long").alias("event_id"), F.lit(False).alias("ok"), "batch"))


@query(
    f"""WITH {_arrivals_sql()}, {_marks_sql(DAY)} SELECT id AS batch_id, rows_in AS num_input_rows, epoch_ms(greatest(coalesce(evict, 0), 0)) AS watermark,
    CAST(sum(rows_in) OVER () - sum(rows_in) OVER (ORDER BY id) AS BIGINT) AS rows_left, max(id) OVER () - id AS batches_left FROM marks"""
)
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listener wrote of each batch while it ran: rows, watermark, and how far it was from the end."""
    own = Arrivals(spark, sf_dir).played()
    log = runner.ProgressLog(spark, f"{own.home}/progress")
    with settings(spark, **_FILES_ONLY), log:
        queries = own.run(deduplicated_stream(own.events(), "event_id", DAY).select("event_id"), "append")
        log.wait(queries)
    own.done()
    return runner.progress_table(spark, f"{own.home}/progress").select("batch_id", "num_input_rows", F.col("watermark").cast("timestamp_ntz").alias("watermark"), "rows_left", "batches_left")
