"""SQL for `vector_codes.compress`, with a common table for each round."""

from __future__ import annotations

_FLOOR_MEAN = "CAST((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"


def _nearest(k: int) -> str:
    return f"""a{k} AS (
    SELECT r, p, arg_min(j, d * 256 + j) AS j, min(d) AS d
    FROM (SELECT x.r, x.p, b.j, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
          FROM parts x JOIN b{k} b ON x.p = b.p)
    GROUP BY r, p
)"""


def _moved(k: int) -> str:
    return f"""m{k} AS (
    SELECT p, j, list(v ORDER BY i) AS v
    FROM (SELECT p, j, i, {_FLOOR_MEAN} AS v
          FROM (SELECT a.p, a.j, unnest(x.v) AS v, unnest(range(len(x.v))) AS i FROM a{k} a JOIN parts x ON a.r = x.r AND a.p = x.p)
          GROUP BY p, j, i)
    GROUP BY p, j
), b{k + 1} AS (
    SELECT b.p, b.j, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m ON b.p = m.p AND b.j = m.j
)"""


def compress_sql(rounds: int = 4) -> str:
    steps = [step for k in range(rounds) for step in (_nearest(k), _moved(k))] + [_nearest(rounds)]
    return f"""
WITH e AS (
    SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label,
           list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 1024) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), parts AS MATERIALIZED (
    SELECT r, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS v FROM (SELECT r, v, unnest(range(4)) AS p FROM e)
), b0 AS (
    SELECT p, r AS j, v FROM parts WHERE r < 256
), {", ".join(steps).replace(" AS (", " AS MATERIALIZED (")}
, coded AS (
    SELECT e.vec_id, e.label, string_agg(printf('%02x', a.j), '' ORDER BY a.p) AS code, CAST(sum(a.d) AS BIGINT) AS error
    FROM a{rounds} a JOIN e ON a.r = e.r GROUP BY e.r, e.vec_id, e.label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, j)) FROM b{rounds}) AS codebooks_sha256
FROM coded
"""
