"""What comes before a row, in an order of any number of rows of one key or of all: running sums and the row before.

A window over a key sends all of its rows to one task, and one without keys everything.  Here rows are dealt into
segments of about equal numbers, by a range partitioning on keys and order that is written down with the rows; windows run inside a
segment, and what came in the segments before is added from a table of what each segment holds of each key.  Only
keys that a segment's edge cuts have more than one row there.  For one order over all rows, the sums of segments are
themselves added up in rounds of `FAN`, so that no task sees more than that many of them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskstream.sources.shared import written

#: Rows of a key from which it is hot: a window over it would keep one task busy for long.
HOT = 50_000

#: Rows of a segment, about. Segments follow from the number of rows and nothing else does.
SEGMENT = 500_000
#: Sums of segments that are added up in one window.
FAN = 1024


def dealt(df: DataFrame, order: Sequence[Column], segment: int = SEGMENT) -> DataFrame:
    """df with _seg, its segment in the order, as a written table; segments are no fewer than the session's partitions."""
    n = max(-(-df.count() // segment), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return written(df.repartitionByRange(n, *order).withColumn("_seg", F.spark_partition_id()), "segments")


def _ahead(table: DataFrame, keys: Sequence[str], sums: Sequence[str], fan: int) -> DataFrame:
    """table(keys, _seg, sums) with b_<s>: the sum over earlier segments of the same keys."""
    if keys:
        # a key has a row in each segment that it reaches into
        before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
        return table.withColumns({f"b_{s}": F.coalesce(F.sum(s).over(before), F.lit(0)) for s in sums})
    most = table.agg(F.max("_seg")).first()[0]
    group = F.floor(F.col("_seg") / fan).cast("int")
    inside = Window.partitionBy("_group").orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    own = table.withColumn("_group", group)
    out = own.withColumns({f"b_{s}": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums})
    if most is None or most < fan:
        return out.drop("_group")
    groups = own.groupBy(F.col("_group").alias("_seg")).agg(*(F.sum(s).alias(s) for s in sums))
    above = _ahead(groups, (), sums, fan).select(F.col("_seg").alias("_group"), *(F.col(f"b_{s}").alias(f"a_{s}") for s in sums))
    return out.join(above, "_group").select(*table.columns, *((F.col(f"b_{s}") + F.col(f"a_{s}")).alias(f"b_{s}") for s in sums))


def scan(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], sums: Mapping[str, Column | str] | None = None, latest: Mapping[str, Column] | None = None,
    segment: int = SEGMENT, fan: int = FAN,
) -> DataFrame:
    """df with a column for each name of sums, its sum over all earlier rows of the same keys, and of latest, its last value there that is not null.

    Orders have to be total within a key for a defined result; nulls add nothing; an empty table gives none.
    """
    sums, latest = dict(sums or {}), dict(latest or {})
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    value = {name: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)) for name, c in sums.items()}
    # the place is one column, so that what is last of a segment can be told by a maximum
    own = df.withColumns({f"_v_{n}": c for n, c in value.items()} | {f"_l_{n}": c for n, c in latest.items()} | {f"_o_{i}": c for i, c in enumerate(columns)})
    places = [f"_o_{i}" for i in range(len(columns))]
    own = dealt(own, [*map(F.col, keys), *map(F.col, places)] or [F.lit(0)], segment)
    place = F.struct(*places)
    held = own.groupBy(*keys, "_seg").agg(
        *(F.sum(f"_v_{n}").alias(f"t_{n}") for n in sums), *(F.max_by(F.struct(f"_l_{n}"), F.when(F.col(f"_l_{n}").isNotNull(), place)).alias(f"t_{n}") for n in latest)
    )
    before = _ahead(held, keys, [f"t_{n}" for n in sums], fan)
    if latest:
        earlier = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
        before = before.withColumns({f"b_t_{n}": F.last(f"t_{n}", ignorenulls=True).over(earlier) for n in latest})
    before = before.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_seg").alias("_k_seg"), *(f"b_t_{n}" for n in [*sums, *latest]))
    inside = Window.partitionBy("_seg", *keys).orderBy(*places).rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumns({f"_s_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in sums} | {f"_s_{n}": F.last(f"_l_{n}", ignorenulls=True).over(inside) for n in latest})
    same = F.col("_seg") == F.col("_k_seg")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = own.join(before, same)
    done = {n: F.col(f"_s_{n}") + F.col(f"b_t_{n}") for n in sums} | {n: F.coalesce(f"_s_{n}", F.col(f"b_t_{n}")[f"_l_{n}"]) for n in latest}
    return out.select(*(f"`{c}`" for c in df.columns if c not in done), *(c.alias(n) for n, c in done.items()))


def running(df: DataFrame, bucket: Column, order: Sequence[Column | str], sums: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """df with before_<s> for each s of sums: the sum over all rows of the same keys that come earlier, by bucket and then order."""
    return scan(df, keys, [bucket, *order], {f"before_{s}": s for s in sums})


def trailing(df: DataFrame, keys: Sequence[str], us: str, ties: Sequence[str], frames: Mapping[str, tuple[Column, int]], latest: Mapping[str, Column] | None = None, segment: int = SEGMENT, peers: bool = True) -> DataFrame:
    """df with a column for each frame (value, seconds): the sum of value over rows of the same keys up to so many seconds before, both ends included, in the order of us and ties, the row itself excluded.

    Without `peers` no row of the same time counts.

    Each row puts a probe at the start of each of its frames; a frame is the running sum at the row less that at its probe.
    So work is the same however many rows a frame holds, and a key of any size is spread over all tasks.
    Give values as whole numbers or decimals: differences of large sums of doubles lose digits.
    """
    # without peers a frame ends at a probe at the row's own time
    spans = sorted({seconds for _, seconds in frames.values()} | (set() if peers else {0}))
    own = df.withColumn("_row", F.monotonically_increasing_id())
    values = {f"_w_{n}": F.coalesce(v, F.lit(0)) for n, (v, _) in frames.items()}
    own = own.select("_row", *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(us).alias("_us"), *(F.col(t).alias(f"_t{i}") for i, t in enumerate(ties)), *(v.alias(n) for n, v in values.items()), *((c.alias(f"_x_{n}") for n, c in (latest or {}).items())), F.struct(*df.columns).alias("_all"))
    own = written(own, "rows")
    kept = [c for c in own.columns if c not in ("_row", "_us", "_all")]
    held = [*values, *(f"_x_{n}" for n in latest or {})]
    event = F.struct(F.lit(-1).alias("_probe"), F.col("_us").alias("_at"), *kept)
    # probes come before all rows of their time, and hold nothing
    empty = {c: F.lit(None).cast(own.schema[c].dataType) for c in held}
    probe = [F.struct(F.lit(i).alias("_probe"), (F.col("_us") - s * 1_000_000).alias("_at"), *(empty[c].alias(c) if c in held else F.col(c) for c in kept)) for i, s in enumerate(spans)]
    every = own.select("_row", F.explode(F.array(event, *probe)).alias("e")).select("_row", "e.*")
    order = ["_at", (F.col("_probe") < 0).cast("int"), *(f"_t{i}" for i in range(len(ties))), "_probe", "_row"]
    summed = scan(every, [f"_k{i}" for i in range(len(keys))], order, {f"s_{n}": n for n in values}, {n: F.col(f"_x_{n}") for n in latest or {}}, segment)
    at = {s: i for i, s in enumerate(spans)}
    end = -1 if peers else at[0]
    here = lambda column, probe: F.max(F.when(F.col("_probe") == probe, F.col(column)))
    by_row = summed.groupBy("_row").agg(*((here(f"s__w_{n}", end) - here(f"s__w_{n}", at[s])).alias(n) for n, (_, s) in frames.items()), *(here(n, -1).alias(n) for n in latest or {}))
    return own.select("_row", "_all").join(by_row, "_row").select("_all.*", *frames, *(latest or {}))


def by_heat(df: DataFrame, key: str, few: Callable[[DataFrame], DataFrame], many: Callable[[DataFrame], DataFrame], hot: int = HOT, known: DataFrame | None = None) -> DataFrame:
    """few(rows of keys with up to `hot` rows) and many(rows of the other keys): the same rows from windows by key, and from scans that spread a key.

    Keys are counted first, a row each; without hot ones the plan is that of few alone. What is `known` of keys, a row each, is
    joined to both: to rows of hot keys, which are few, by sending theirs to all tasks, so that no task gets all rows of one.
    """
    told = lambda out, of: out if of is None else out.join(of, key, "left")
    own = written(df.groupBy(F.col(key).alias("_hot")).count().where(F.col("count") > hot).select("_hot"), "hot")
    if own.isEmpty():
        return told(few(df), known)
    same = F.col(key).eqNullSafe(F.col("_hot"))
    theirs = None if known is None else F.broadcast(known.join(own, F.col(key) == F.col("_hot"), "left_semi"))
    return told(few(df.join(own, same, "left_anti")), known).unionByName(told(many(df.join(own, same, "left_semi")), theirs))
