"""Centroids, languages and resampling, against plain versions of their definitions and on held-out labels."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskstream.llm import centroids, languages, resample

TEST_DATA = "/root/testdata/sf0.01"


def plain_clusters(vectors, k, rounds, scale=256, seed=2):
    """Every vector against every centroid in whole numbers, ties to the smaller."""
    rows = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in vectors]
    at = [x for _, x in sorted(rows, key=lambda r: hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest())[:k]]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, x in rows:
            groups[nearest(x)[1]].append(x)
        at = [[sum(c) // len(groups[j]) for c in zip(*groups[j])] if groups[j] else c for j, c in enumerate(at)]
    return {i: nearest(x)[::-1] for i, x in rows}, at


@pytest.mark.parametrize("kind", ["grid", "clustered"])
def test_clusters_equal_plain_comparison(spark, kind):
    r = random.Random(5)
    # on a coarse grid there are many ties, in clusters bounds cut off most
    if kind == "grid":
        vectors = [(i, [r.randrange(3) / 256 for _ in range(4)]) for i in range(160)]
    else:
        middles = [[r.gauss(0, 4) for _ in range(4)] for _ in range(6)]
        vectors = [(i, [m + r.gauss(0, 0.2) for m in middles[i % 6]]) for i in range(240)]
    found = centroids.clusters(spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3), k=7, components=4, rounds=3).collect()
    expected, at = plain_clusters(vectors, 7, 3)
    assert {x.vec_id: (x.cluster, x.distance) for x in found} == expected
    total = collections.Counter()
    for j, d in expected.values():
        total[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    assert all((x.cluster_inertia, x.inertia, x.centroid_sha256) == (total[x.cluster], sum(total.values()), digest[x.cluster]) for x in found)


def test_bounds_save_comparisons_and_never_lie():
    rng = np.random.default_rng(3)
    middles = rng.normal(0, 2000, (20, 16))
    x = np.round(middles[rng.integers(0, 20, 4000)] + rng.normal(0, 50, (4000, 16))).astype(np.int64)
    c = centroids.Centroids.of(np.round(middles).astype(np.int64))
    own, upper, lower, first = centroids.assign(x, np.zeros(4000, np.int64), np.full(4000, np.inf), np.zeros((4000, 20)), c)
    again = centroids.Centroids.of(c.at + 1, c.at)
    own, upper, lower, second = centroids.assign(x, own, upper, centroids.read_lower(centroids.stored_lower(lower)), again)
    true = np.sqrt(np.stack([centroids.squared(x, a) for a in again.at], 1))
    assert (own == true.argmin(1)).all() and (lower <= true).all() and (upper >= true[np.arange(4000), own]).all()
    assert first < 0.6 * 4000 * 20 and second < 0.05 * 4000 * 20
    values = np.abs(rng.normal(size=1000)) * 10.0 ** rng.integers(-3, 9, 1000)
    kept = centroids.read_lower(centroids.stored_lower(values))
    assert (kept <= values).all() and (kept >= values * 0.99).all()


def test_clusters_odd_rows(spark):
    good = [0.5, -0.25]
    rows = [(1, good), (1, good), (2, [1.0]), (3, None), (4, [None, 1.0]), (5, [math.nan, 1.0]), (6, [math.inf, 1.0]), (None, good), (7, [1e12, 0.0]), (8, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit("x"), "distance": F.lit(1), "kind": F.lit(2)})
    found = sorted((x.vec_id or 0, x.cluster, x.distance, x.inertia) for x in centroids.clusters(table, k=5, components=2, rounds=2).collect())
    # three rows take part, two of them with an id and so first centroids, which are equal
    assert found == [(0, 0, 0, 0), (1, 0, 0, 0), (1, 0, 0, 0)]
    assert centroids.clusters(table.limit(0), components=2).count() == 0 and centroids.clusters(table.where("vec_id is null"), components=2).count() == 0
    wide = spark.createDataFrame([(i, [float(s * 5e5)] * 64) for i, s in enumerate((1, -1, 1, -1))], "vec_id long, embedding array<float>")
    assert {x.distance for x in centroids.clusters(wide, k=1, rounds=1).collect()} == {64 * (128 * 10**6) ** 2}


def plain_bundle(text, vectors):
    z = [0, *(ord(c.lower()) if c.isalpha() else 0 for c in text), 0]
    out = np.zeros(vectors.dimensions, np.int64)
    tables = {}
    for place in range(3):
        for c in set(z):
            own = np.random.Generator(np.random.Philox(key=[vectors.seed, c])).integers(0, 2, vectors.dimensions, np.int8).astype(np.int64) * 2 - 1
            for _ in range(place):
                own = own[vectors.turns[1]]
            tables[place, c] = own
    for i in range(1, len(z) - 1):
        if z[i]:
            out += tables[0, z[i - 1]] * tables[1, z[i]] * tables[2, z[i + 1]]
    return out


def test_bundles_equal_plain_sums(monkeypatch):
    vectors = languages.Vectors(64)
    texts = ["The cat, the dog", None, "", "12 3!", "Ünï x", "aaa" * 20, "日本語 text"]
    made, n = languages.bundles(texts, np.arange(len(texts)), len(texts), vectors)
    for text, row, letters in zip(texts, made, n):
        assert row.tolist() == plain_bundle(text or "", vectors).tolist()
        assert letters == sum(c.isalpha() for c in text or "")
    # slices of a long text, letters that no longer fit, and few triples at a time change nothing
    for name, value in (("SLICE", 5), ("TRIPLES", 3), ("_LETTERS", 12)):
        monkeypatch.setattr(languages, name, value)
        again, _ = languages.bundles(texts, np.arange(len(texts)), len(texts), languages.Vectors(64))
        assert (again == made).all()


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{TEST_DATA}/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    found = languages.predict(docs, languages.learn(docs.where(~held))).join(docs.select("doc_id", "lang"), "doc_id").where(held).collect()
    assert sum(x.lang == x.lang_pred for x in found) >= 0.97 * len(found) > 100
    assert all(0 <= x.score <= 1 for x in found)


def test_languages_odd_rows(spark):
    rows = [(1, "la casa roja", "es"), (2, "the red house", "en"), (3, None, "es"), (4, "12 34", "fr"), (5, "the house", None), (None, "the", "en"), (2, "the red house", "en")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"lang_pred": F.lit(1), "score": F.lit("x"), "total": F.lit(0)})
    model = languages.learn(table, 512)
    assert list(model) == ["en", "es"]
    assert (model["en"] == 2 * plain_bundle("the red house", languages.Vectors(512)) + plain_bundle("the", languages.Vectors(512))).all()
    found = sorted(((x.doc_id or 0), x.lang_pred) for x in languages.predict(table, model).collect())
    assert found == [(0, "en"), (1, "es"), (2, "en"), (2, "en"), (3, "und"), (4, "und"), (5, "en")]
    assert languages.learn(table.limit(0)) == {} and {(x.lang_pred, x.score) for x in languages.predict(table, {}).collect()} == {("und", 0.0)}
    assert languages.predict(table.limit(0), model).count() == 0


def plain_resample(docs, target, buckets, longest, percent, least, seed):
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    runs = lambda w: [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (collections.Counter(bucket(f) for x in texts for f in runs(words(x))) for texts in ([x for _, x in docs], target))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((n + 1) * (t.total() + buckets)))) for b, n in s.items()}
    out = []
    for i, x in docs:
        own = runs(words(x))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in own)
        out.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(x)) >= least))
    order = sorted((-x[3], x[0] is None, x[0] or 0, k) for k, x in enumerate(out) if x[4])
    rank = {k: place + 1 for place, (*_, k) in enumerate(order) if place < percent * len(order) // 100}
    return collections.Counter((*x[:4], rank.get(k)) for k, x in enumerate(out))


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_equals_plain_version(spark, longest):
    r = random.Random(9)
    prose = lambda n: " ".join(r.choice(["Ünï", "It's", "MIX_ed"]) if r.random() < 0.1 else f"w{int(60 * r.random() ** 2)}" for _ in range(n))
    docs = [(i, prose(r.randint(0, 40))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, " ?! "), (203, "one"), (5, docs[5][1]), (5, docs[5][1]), (None, prose(30)), (204, prose(20_000))]
    target = [prose(12) for _ in range(20)] + [None, ""]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"bucket": F.lit("x"), "weight": F.lit(0), "rank": F.lit(1), "copies": F.lit(3)}).repartition(5)
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    found = resample.resample(table, aims, buckets=97, longest=longest, percent=35, least_words=10)
    assert collections.Counter(map(tuple, found.collect())) == plain_resample(docs, target, 97, longest, 35, 10, 2024)
    assert resample.resample(table.limit(0), aims).count() == 0
    none = resample.resample(table, aims.limit(0), buckets=97, longest=longest, percent=35, least_words=10)
    assert collections.Counter(map(tuple, none.collect())) == plain_resample(docs, [], 97, longest, 35, 10, 2024)
