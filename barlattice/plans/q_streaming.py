"""The streaming extension over a finished table; the same plan runs on a stream (see the tests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlattice.sources import panel as P
from barlattice.streaming import late

from .registry import query


@query(
    "ox_1_windowed_activity",
    "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT DISTINCT ON (event_id, ts) * FROM events) GROUP BY 1, 2",
)
def windowed_activity(spark, d):
    x = late.windowed_activity(P.read(spark, d, "events"))
    return x.select(F.to_date("start").alias("day"), "event_type", "n", "total")
