"""Frame series as batch and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog.numeric import kmeans_sql
from gridloom.catalog.objects import NEAR4, components
from gridloom.catalog.registry import MASK, OTSU, PX, query, rounded
from gridloom.plans import frames as P
from gridloom.sources import virtual as V
from gridloom.streaming import frames as S

_SERIES = f"WITH {OTSU}, l AS (SELECT image_id, threshold, {{used}} AS level_used FROM otsu) SELECT px.image_id AS frame_idx, threshold, level_used, CAST(count(*) FILTER (v >= level_used) AS BIGINT) AS n_object, round(count(*) FILTER (v >= level_used) / CAST(count(*) AS DOUBLE), 6) AS concentration FROM px JOIN l USING (image_id) GROUP BY 1, 2, 3"


@query("frame_concentration", _SERIES.format(used="threshold"))
def frame_concentration(spark, d):
    return rounded(P.concentration_series(V.frames(spark, d), highest=False), "concentration")


@query("frame_concentration_running", _SERIES.format(used="max(threshold) OVER (ORDER BY image_id ROWS UNBOUNDED PRECEDING)"))
def frame_concentration_running(spark, d):
    return rounded(P.concentration_series(V.frames(spark, d)), "concentration")


@query("frame_reverse_counts", f"SELECT frame_idx, n_object, CAST(sum(n_object) OVER (ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS later FROM ({_SERIES.format(used='threshold')})")
def frame_reverse_counts(spark, d):
    return P.reverse_running(P.concentration_series(V.frames(spark, d), highest=False)).select("frame_idx", "n_object", "later")


@query("frame_prepared", f"WITH {PX} SELECT image_id AS frame_idx, r, c, CASE WHEN r BETWEEN 10 AND 14 AND c BETWEEN 20 AND 29 THEN 0 ELSE v END AS v FROM px WHERE r BETWEEN 5 AND 20 AND c BETWEEN 10 AND 34")
def frame_prepared(spark, d):
    return P.prepared(V.frames(spark, d), (5, 20), (10, 34), (10, 14, 20, 29)).select("frame_idx", "r", "c", "v")


@query("frame_max_piece", f"{components(NEAR4, MASK.replace('> 110', '> 127'))}, s AS (SELECT image_id, label, count(*) AS n FROM num GROUP BY 1, 2 HAVING count(*) >= 2) SELECT f.image_id AS frame_idx, CAST(max(s.n) AS BIGINT) AS largest FROM (SELECT DISTINCT image_id FROM px) f LEFT JOIN s ON s.image_id = f.image_id GROUP BY 1")
def frame_max_piece(spark, d):
    return P.largest_piece(V.frames(spark, d))


@query("frame_clusters", f"{kmeans_sql(2)} SELECT image_id AS frame_idx, round(sum(CASE WHEN k = 1 THEN coverage ELSE 0 END), 6) AS concentration FROM km GROUP BY 1")
def frame_clusters(spark, d):
    return rounded(P.cluster_series(V.frames(spark, d)), "concentration")


@query("video_info", f"WITH {PX} SELECT CAST(count(DISTINCT image_id) AS BIGINT) AS n_frames, max(r) + 1 AS height, max(c) + 1 AS width FROM px")
def video_info(spark, d):
    return P.video_info(V.frames(spark, d))


@query("stream_window_counts", "SELECT time_bucket(INTERVAL 1 day, ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(floor(value)) AS BIGINT) AS total FROM events GROUP BY 1, 2")
def stream_window_counts(spark, d):
    return S.drained(S.window_counts(S.event_stream(spark, d)), "complete")


@query("stream_sliding_counts", "SELECT time_bucket(INTERVAL 12 hour, ts) - k.range * INTERVAL 12 hour AS start, event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(floor(value)) AS BIGINT) AS total FROM events CROSS JOIN range(0, 2) k GROUP BY 1, 2")
def stream_sliding_counts(spark, d):
    return S.drained(S.window_counts(S.event_stream(spark, d), "1 day", "12 hours"), "complete")


@query("stream_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 hour THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k")
def stream_sessions(spark, d):
    return S.drained(S.sessions(S.event_stream(spark, d)), "complete")


@query("stream_frame_counts", f"WITH {PX} SELECT image_id AS frame_idx, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (v > 110) AS BIGINT) AS above FROM px GROUP BY 1")
def stream_frame_counts(spark, d):
    return S.drained(S.frame_means(S.event_stream(spark, d)), "complete")


@query("stream_running_maximum", "SELECT user_id, event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS highest FROM events")
def stream_running_maximum(spark, d):
    return S.drained(S.running_maximum(S.event_stream(spark, d)))


@query("frame_event_times", "SELECT event_id // 1000 AS frame_idx, min(ts) AS first_ts, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def frame_event_times(spark, d):
    return V.frames(spark, d).groupBy("frame_idx").agg(F.min("ts").alias("first_ts"), F.count("*").alias("n"))


@query("generated_video_pieces")
def generated_video_pieces(spark, d):
    from gridloom.sources.generated import masks_video

    return P.largest_piece(masks_video(spark, blank=3), 20)
