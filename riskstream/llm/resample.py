"""Target-distribution importance resampling: documents drawn as often as their words make them look like a target's.

Words are lower-cased (A-Z only) runs of letters and digits, in which everything beyond ASCII counts as a letter.
Features are all runs of one to `longest` words; each falls into one of `buckets` by the CRC-32 of its bytes.
A bucket's gain is the scaled logarithm of its smoothed share among the target's features over its share among
all documents'.  A document weighs the sum of its features' gains, gets Gumbel noise from a hash of its id, and the
highest are drawn: a sample without replacement in which chances go with the weights.

All of it is DataFrame functions.  Features are exploded and at once counted by bucket where they are read, so
that a shuffle moves at most `buckets` rows a task.  The gains are a table of at most `buckets` rows, which is what
makes it fit to be broadcast; features look them up and are summed by document, again where they are read, since
all rows of a document's features follow one another.  Ranks come from a range partitioning by score: the partition
number is stored with the rows, partitions are counted, and a rank is the place within
the partition plus the rows of the partitions before.  One row a partition goes through the driver.

Defined cases: null and empty texts have no features, weigh 0 and are not drawn; repeated rows of one id and text
are weighed once and ranked one after another; other rows of one id are documents of their own, tied by score and id in
the order of a hash of their text; a null id is hashed as an empty one and comes after all others of its score; with an
empty or null target all gains follow from counts of zero; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskstream.llm.common import written

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def features(words: Column, longest: int) -> Column:
    """All runs of 1 to longest consecutive words of an array, each joined by one space."""
    if longest == 1:
        return words

    def runs(n: int) -> Column:
        at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.concat(words, *(runs(n) for n in range(2, longest + 1)))


def bucketed(texts: DataFrame, keys: list[str], buckets: int, longest: int) -> DataFrame:
    """keys, n_words, place and bucket of every feature of texts(keys, text); a text without any has one row, whose bucket is null."""
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))
    own = texts.select(*keys, words.alias("_words"))
    own = own.select(*keys, F.size("_words").alias("n_words"), F.posexplode_outer(features(F.col("_words"), longest)).alias("place", "_feature"))
    return own.select(*keys, "n_words", "place", F.pmod(F.crc32(F.col("_feature").cast("binary")), F.lit(buckets)).cast("int").alias("bucket"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """bucket, gain (long) of every bucket that features of source(text) fall into."""
    count = lambda df, name: bucketed(df, [], buckets, longest).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias(name))
    counts = written(count(source, "s").join(count(target, "t"), "bucket", "full").fillna(0, ["s", "t"]), "buckets")
    all_s, all_t = counts.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    share = lambda c: (F.col(c) + 1).cast("double")
    ratio = share("t") * F.lit(float(all_s + buckets)) / (share("s") * F.lit(float(all_t + buckets)))
    return counts.select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain")).where(F.col("gain").isNotNull())


def weighed(documents: DataFrame, table: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """doc_id, text_hash, copies, n_words, n_features, weight of documents(doc_id, text), equal rows together."""
    keys = ["doc_id", "text_hash"]
    own = bucketed(documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), keys, buckets, longest)
    # a bucket has at most one row in the table, and there are no more buckets than the parameter says
    summed = own.join(F.broadcast(table), "bucket", "left").groupBy(*keys).agg(
        F.count_if(F.col("place").isNull() | (F.col("place") == 0)).alias("copies"), F.max("n_words").cast("long").alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight")
    )
    return summed.withColumns({c: F.expr(f"{c} div copies") for c in ("n_features", "weight")})


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise from a hash of the id, scaled as gains are."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296)))


def ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """scored(doc_id, text_hash, copies, n_words, score, ...) with rank, that of a row's first copy among documents of enough words, highest first, null for others, and drawn, how many are."""
    spark = scored.sparkSession
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "text_hash"]
    enough = F.col("n_words") >= least_words
    dealt = written(scored.where(enough).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    before, total = [], 0
    for part, n in sorted(map(tuple, dealt.groupBy("part").agg(F.sum("copies")).collect())):
        before.append((part, total))
        total += n
    starts = spark.createDataFrame(before, "part int, before long")
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # one row a partition
    placed = dealt.join(F.broadcast(starts), "part").withColumn("rank", F.col("before") + F.coalesce(F.sum("copies").over(inside), F.lit(0)) + 1)
    rest = scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return placed.select(rest.columns).unionByName(rest).withColumn("drawn", F.lit(percent * total // 100))


def resample(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of documents(doc_id, text) against target(text); rank is null where it is not drawn."""
    table = gains(documents.select("text"), target.select("text"), buckets, longest)
    scored = written(weighed(documents, table, buckets, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weights")
    out = ranked(scored, percent, least_words).withColumn("_copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
    rank = F.col("rank") + F.col("_copy")
    return out.select("doc_id", "n_features", "weight", "score", F.when(rank <= F.col("drawn"), rank).alias("rank"))
