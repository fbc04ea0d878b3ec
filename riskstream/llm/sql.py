"""The corpus queries that SQL can express, in SQL over the same tables."""

from __future__ import annotations

from riskstream.llm import centroids, resample
from riskstream.llm.licenses import NOTICES

_SPLIT = r"'[^\x20\x09-\x0D]+'"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(coalesce(text, ''), {_SPLIT})"
_LOWERED = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_SPLIT})"

SUBSTRING = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
  tokens AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM d),
  starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS pos FROM d WHERE len(ws) >= 50),
  windows AS (SELECT doc_id, pos, array_to_string(ws[pos:pos + 49], ' ') AS words FROM starts),
  least AS (SELECT words, min(doc_id) AS first FROM windows GROUP BY words),
  hits AS (SELECT doc_id, pos AS hit FROM windows JOIN least USING (words) WHERE first < doc_id),
  marked AS (SELECT t.doc_id, word, pos, coalesce(max(hit) OVER (PARTITION BY t.doc_id ORDER BY pos) >= pos - 49, false) AS gone FROM tokens t LEFT JOIN hits h ON t.doc_id = h.doc_id AND t.pos = h.hit),
  summed AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN summed s ON d.doc_id = s.doc_id
"""

NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_LOWERED} AS ws FROM documents),
  grams AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS pos FROM d WHERE len(ws) >= 3),
  sets AS (SELECT DISTINCT doc_id, array_to_string(ws[pos:pos + 2], ' ') AS s FROM grams UNION SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) IN (1, 2)),
  sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
  common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
  links AS MATERIALIZED (SELECT c.a, c.b FROM common c JOIN sizes x ON c.a = x.doc_id JOIN sizes y ON c.b = y.doc_id WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
  reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
  least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT l.doc_id, coalesce(n, 0) AS n_shingles, component_id, l.doc_id = component_id AS kept FROM least l LEFT JOIN sizes s ON l.doc_id = s.doc_id
"""

LEAKS = f"""
WITH d AS (SELECT doc_id, {_LOWERED} AS ws FROM documents), i AS (SELECT item_id, {_LOWERED} AS ws FROM benchmark),
  dg AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS pos FROM d WHERE len(ws) >= 5), ig AS (SELECT item_id, ws, unnest(range(1, len(ws) - 3)) AS pos FROM i WHERE len(ws) >= 5),
  ds AS (SELECT DISTINCT doc_id, array_to_string(ws[pos:pos + 4], ' ') AS s FROM dg), its AS (SELECT DISTINCT item_id, array_to_string(ws[pos:pos + 4], ' ') AS s FROM ig),
  sizes AS (SELECT item_id, count(*) AS n FROM its GROUP BY item_id),
  shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN its USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n AS n_shingles, n_shared / n AS containment FROM shared JOIN sizes USING (item_id) WHERE n_shared >= 0.8 * n
"""

_NOTICES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(NOTICES.items()))
_RUNS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\p{{L}}\\p{{N}}]+')"

NOTICE = f"""
WITH t AS (SELECT license_id, {_RUNS} AS ws FROM (VALUES {_NOTICES}) v(license_id, text)), d AS (SELECT doc_id, {_RUNS} AS ws FROM documents),
  tg AS (SELECT license_id, ws, unnest(range(1, len(ws) - 3)) AS pos FROM t WHERE len(ws) >= 5),
  ts AS (SELECT DISTINCT license_id, array_to_string(ws[pos:pos + 4], ' ') AS s FROM tg),
  sizes AS (SELECT license_id, count(*) AS n, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS size FROM ts GROUP BY license_id),
  dg AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS pos FROM d WHERE len(ws) >= 5),
  hits AS (SELECT doc_id, license_id, pos - 1 AS place, n, size, s FROM (SELECT doc_id, pos, array_to_string(ws[pos:pos + 4], ' ') AS s FROM dg) JOIN ts USING (s) JOIN sizes USING (license_id)),
  placed AS (SELECT doc_id, license_id, n, s, (place // size - b) * size AS first_word FROM hits, (VALUES (0), (1)) o(b) WHERE place // size >= b),
  shares AS (SELECT doc_id, license_id, first_word, count(DISTINCT s) / any_value(n) AS containment FROM placed GROUP BY ALL)
SELECT doc_id, license_id, max(containment) AS containment, count(*) AS n_windows, min(first_word) AS first_word FROM shares WHERE containment >= 0.8 GROUP BY ALL
"""

_VECTORS = f"""v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({centroids.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings WHERE len(embedding) = {centroids.COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""


def _rounds() -> str:
    """Every vector against every centroid, once a round and once more."""
    gap = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    out = [_VECTORS, f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || vec_id)) - 1 AS cluster, x FROM v ORDER BY cluster LIMIT {centroids.CENTROIDS})"]
    for i in range(centroids.ROUNDS + 1):
        out.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, min(struct_pack(distance := d, cluster := cluster)) AS best
            FROM (SELECT vec_id, v.x, cluster, CAST({gap} AS BIGINT) AS d FROM v, c{i} c) GROUP BY vec_id)""")
        if i < centroids.ROUNDS:
            out.append(f"""n{i} AS (SELECT cluster, list(m ORDER BY place) AS x FROM (SELECT best.cluster AS cluster, place, CAST(floor(sum(x[place]) / count(*)) AS BIGINT) AS m
                FROM a{i}, range(1, {centroids.COMPONENTS + 1}) r(place) GROUP BY ALL) GROUP BY cluster)""")
            out.append(f"c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(n.x, c.x) AS x FROM c{i} c LEFT JOIN n{i} n ON c.cluster = n.cluster)")
    return ", ".join(out)


CENTROIDS = f"""
WITH {_rounds()},
  last AS (SELECT vec_id, best.cluster AS cluster, best.distance AS distance FROM a{centroids.ROUNDS})
SELECT vec_id, CAST(l.cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY l.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM last l JOIN c{centroids.ROUNDS} c ON l.cluster = c.cluster
"""

_TABLE = "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END))"
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(word))), lambda i: CAST(('0x' || substr(hex(encode(word)), CAST(2 * i + 1 AS INTEGER), 2)) AS BIGINT))),
    lambda c, b: xor(c // 256, crcs[CAST(xor(c % 256, b) + 1 AS INTEGER)])))"""
_RUN = f"unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{resample.WORD}'))"
_B = resample.BUCKETS

RESAMPLE = f"""
WITH tokens AS MATERIALIZED (SELECT doc_id, {_RUN} AS word FROM documents), aims AS MATERIALIZED (SELECT {_RUN} AS word FROM benchmark),
  k AS MATERIALIZED (SELECT {_TABLE} AS crcs), names AS (SELECT word FROM tokens UNION SELECT word FROM aims),
  hashed AS MATERIALIZED (SELECT word, {_CRC} % {_B} AS bucket FROM names, k),
  s AS (SELECT bucket, count(*) AS s FROM tokens JOIN hashed USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM aims JOIN hashed USING (word) GROUP BY bucket),
  gains AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + {_B})::DOUBLE / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + {_B})::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
  weights AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM tokens JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
  scored AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{resample.SEED}:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM documents d LEFT JOIN weights w ON d.doc_id = w.doc_id),
  placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= {resample.LEAST_WORDS})
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= {resample.PERCENT} * n // 100 THEN place END AS rank FROM scored s LEFT JOIN placed p ON s.doc_id = p.doc_id
"""

SQL = {"op2_substring_dedup": SUBSTRING, "op3_near_dedup": NEAR, "op6_licenses": NOTICE, "op10_decontaminate": LEAKS, "op11_centroids": CENTROIDS, "op13_resample": RESAMPLE}
