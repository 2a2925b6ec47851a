"""Queries by name, with the SQL that an independent engine runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The virtual images in SQL: 25 by 40 pixels from a thousand events each.
PX = "px AS (SELECT event_id // 1000 AS image_id, (event_id % 1000) // 40 AS r, event_id % 40 AS c, CAST(least(255, floor(value)) AS BIGINT) AS v FROM events)"
RGB = "rgb AS (SELECT event_id // 1000 AS image_id, (event_id % 1000) // 40 AS r, event_id % 40 AS c, CAST(least(255, floor(value)) AS BIGINT) AS red, event_id * 7 % 256 AS green, event_id * 13 % 256 AS blue FROM events)"
MASK = f"{PX}, mask AS (SELECT image_id, r, c, v > 110 AS v FROM px)"
HIST = f"{PX}, hist AS (SELECT i.image_id, b.bin, CAST(count(px.v) AS BIGINT) AS n FROM (SELECT DISTINCT image_id FROM px) i CROSS JOIN (SELECT range AS bin FROM range(0, 256)) b LEFT JOIN px ON px.image_id = i.image_id AND px.v = b.bin GROUP BY 1, 2)"
RUN = f"{HIST}, run AS (SELECT image_id, bin AS t, n, CAST(sum(n) OVER a AS DOUBLE) AS w, CAST(sum((bin + 1) * n) OVER a AS DOUBLE) AS m, CAST(sum(n) OVER p AS DOUBLE) AS total, CAST(sum((bin + 1) * n) OVER p AS DOUBLE) AS mass, CAST(sum((bin + 1) * (bin + 1) * n) OVER p AS DOUBLE) AS square FROM hist WINDOW a AS (PARTITION BY image_id ORDER BY bin ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY image_id))"
OTSU = f"{RUN}, scored AS (SELECT *, CASE WHEN w > 0 AND w < total THEN (mass * w - total * m) * (mass * w - total * m) / (w * (total - w)) END AS score FROM run), otsu AS (SELECT s.image_id, avg(s.t) AS threshold, max(s.score / (s.square * s.total - s.mass * s.mass)) AS effectiveness FROM scored s JOIN (SELECT image_id, max(score) AS best FROM scored GROUP BY 1) b ON b.image_id = s.image_id AND s.score = b.best GROUP BY 1)"


def least_rectangle_sql(points: str, keys: str) -> str:
    """SQL after a CTE ``points`` (keys, x, y): hull edges are the ordered pairs of points without a point to their
    right or beyond either end; ``box`` is the least box with a side along one, by its four corners' extents."""
    same = " AND ".join(f"q.{k} = a.{k}" for k in keys.split(", "))
    pair = same.replace("q.", "b.")
    own = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""hp AS (SELECT DISTINCT {keys}, x, y FROM {points}), edge AS (SELECT {own}, a.x, a.y, b.x AS u, b.y AS v FROM hp a JOIN hp b ON {pair} AND (a.x <> b.x OR a.y <> b.y) WHERE NOT EXISTS (SELECT 1 FROM hp q WHERE {same} AND ((b.x - a.x) * (q.y - a.y) - (b.y - a.y) * (q.x - a.x) < 0 OR ((b.x - a.x) * (q.y - a.y) - (b.y - a.y) * (q.x - a.x) = 0 AND (q.x - a.x) * (q.x - b.x) + (q.y - a.y) * (q.y - b.y) > 0)))),
turned AS (SELECT {own}, a.x, a.y, a.u, cos(atan2(a.v - a.y, a.u - a.x)) AS co, sin(atan2(a.v - a.y, a.u - a.x)) AS si, q.x AS px, q.y AS py FROM edge a JOIN hp q ON {same}),
sized AS (SELECT {keys}, x, y, u, co, si, min(px * co + py * si) AS l0, max(px * co + py * si) AS h0, min(py * co - px * si) AS l1, max(py * co - px * si) AS h1 FROM turned GROUP BY ALL),
box AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round((h0 - l0) * (h1 - l1), 9), CASE WHEN u > x THEN 0 ELSE 1 END, CASE WHEN u > x THEN x ELSE -x END) AS nth FROM sized) WHERE nth = 1)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, with nought for its negative."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def r6(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits) + F.lit(0.0)
