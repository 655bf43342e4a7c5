"""DuckDB SQL for the blended similarity of names, for the oracles of queries that rest on it."""

from __future__ import annotations

from ..functions import similarity as S

CONFUSED = "[" + ", ".join(f"'{a}{b}'" for a, b in sorted(S.CONFUSED)) + "]"


def blend(source: str) -> str:
    """Recursive CTEs, the last of them ``z (a, b, s)``: the similarity of each pair ``(a, b)`` of lower-case, collapsed texts in ``source``."""
    return f"""zp AS (SELECT DISTINCT a, b, greatest(length(a), length(b)) AS n FROM {source}),
zr AS (
  SELECT a, b, n // 2 - 1 AS reach, 0 AS i, CAST([] AS INTEGER[]) AS lefts, CAST([] AS INTEGER[]) AS used FROM zp WHERE a <> '' AND b <> ''
  UNION ALL
  SELECT a, b, reach, i + 1, CASE WHEN hit IS NULL THEN lefts ELSE list_append(lefts, CAST(i + 1 AS INTEGER)) END,
    CASE WHEN hit IS NULL THEN used ELSE list_append(used, CAST(hit AS INTEGER)) END
  FROM (
    SELECT *, list_filter(range(greatest(1, i + 1 - reach), least(length(b), i + 1 + reach) + 1), lambda j: b[j] = a[i + 1] AND NOT list_contains(used, CAST(j AS INTEGER)))[1] AS hit
    FROM zr WHERE i < length(a))),
zm AS (
  SELECT a, b, len(used) AS m, len(list_filter(range(1, len(used) + 1), lambda k: a[lefts[k]] <> b[list_sort(used)[k]])) / 2 AS swapped FROM zr WHERE i = length(a)),
zj AS (
  SELECT a, b, CASE WHEN m = 0 THEN 0::DOUBLE ELSE (m / length(a) + m / length(b) + (m - swapped) / m) / 3 END AS jaro,
    CASE WHEN m = 0 THEN 0 WHEN a[1:4] = b[1:4] THEN least(4, length(a), length(b)) WHEN a[1:3] = b[1:3] THEN least(3, length(a), length(b))
      WHEN a[1:2] = b[1:2] THEN least(2, length(a), length(b)) WHEN a[1] = b[1] THEN 1 ELSE 0 END AS same FROM zm),
zo AS (
  SELECT a, b, sum(CASE WHEN x = y THEN 1.0::DOUBLE WHEN list_contains({CONFUSED}, x || y) THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END) / max(n) AS ocr
  FROM (SELECT a, b, n, rpad(a, CAST(n AS INTEGER), ' ')[k] AS x, rpad(b, CAST(n AS INTEGER), ' ')[k] AS y FROM zp, range(1, 400) r(k) WHERE k <= n) GROUP BY a, b),
zt AS (
  SELECT a, b, list_distinct(string_split(a, ' ')) AS u, list_distinct(string_split(b, ' ')) AS v, len(list_intersect(u, v)) AS c FROM zp),
z AS (
  SELECT a, b, CASE WHEN a = '' AND b = '' THEN 1.0::DOUBLE WHEN a = '' OR b = '' THEN 0.0::DOUBLE
    ELSE 0.4::DOUBLE * (jaro + 0.1::DOUBLE * same * (1 - jaro)) + 0.3::DOUBLE * ocr + 0.3::DOUBLE * c / (len(u) + len(v) - c) END AS s
  FROM zp LEFT JOIN zj USING (a, b) LEFT JOIN zo USING (a, b) JOIN zt USING (a, b))"""
