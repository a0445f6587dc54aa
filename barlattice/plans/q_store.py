"""Queries over the append-only store (o10.13): filled by several runs, then read and verified."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlattice.sources import files
from barlattice.sources import panel as P
from barlattice.sources.store import ALREADY, Store

from .registry import query

BASE = f"{P.BARS}, {P.NUMBERED}, {P.SIGNALS}"
PROTOCOL = {"name": "signal observation", "version": 1}
RUNS = ["signal_date < DATE '1998-01-01'", "signal_date >= DATE '1998-01-01' AND signal_date < DATE '2000-01-01'", "signal_date >= DATE '2000-01-01'"]


def filled(spark, d):
    """A store after three runs of sessions, the second also sent again, and one of outcomes."""
    panel = P.kept_bars(spark, d)
    signals = P.signals(panel)
    rows = P.kept(signals.select(
        "signal_id", F.substring("symbol", 3, 6).alias("code"), "signal_date", F.concat_ws(":", "symbol", F.floor(F.col("rn") / 15).cast("string")).alias("episode_id"),
        F.to_json(F.struct(F.round(F.col("trigger") * 10000).cast("long").alias("trigger"), F.round(F.col("stop") * 10000).cast("long").alias("stop"))).alias("payload"),
    ))
    root = files.scratch(spark, "store")
    for when in RUNS:
        Store(spark, root, PROTOCOL).record_sessions(rows.where(when))
    if Store(spark, root, PROTOCOL).record_sessions(rows.where(RUNS[1]))["status"] != ALREADY:
        raise AssertionError("stored sessions were stored again")
    store = Store(spark, root, PROTOCOL)
    next_bar = P.numbered(panel).select("symbol", (F.col("rn") - 1).alias("rn"), F.col("date").alias("observed_date"), F.round(F.col("close") * 10000).cast("long").alias("close"))
    found = signals.select("signal_id", "symbol", "rn").join(next_bar, ["symbol", "rn"]).select("signal_id", F.lit(1).alias("horizon"), "observed_date", F.to_json(F.struct("close")).alias("payload"))
    store.append_outcomes(found)
    return store


@query(
    "o10_13c_stored_observations",
    f"WITH {BASE}, e AS (SELECT signal_id, substr(symbol, 3, 6) AS code, signal_date, symbol || ':' || CAST(rn // 15 AS VARCHAR) AS episode_id, symbol, rn, CAST(round(trigger * 10000) AS BIGINT) AS trigger FROM sig) "
    "SELECT e.signal_id, signal_date, episode_id, row_number() OVER (PARTITION BY episode_id ORDER BY signal_date, code, e.signal_id) = 1 AS first_in_episode, e.trigger, b.date AS observed_date, CAST(round(b.close * 10000) AS BIGINT) AS close FROM e LEFT JOIN nb b ON b.symbol = e.symbol AND b.rn = e.rn + 1",
)
def stored_observations(spark, d):
    """Signals and outcomes as the store has them after all runs."""
    store = filled(spark, d)
    outcomes = store.read("outcomes").select("signal_id", "observed_date", F.get_json_object("payload", "$.close").cast("long").alias("close"))
    x = store.read("signals").join(outcomes, "signal_id", "left")
    return x.select("signal_id", "signal_date", "episode_id", "first_in_episode", F.get_json_object("payload", "$.trigger").cast("long").alias("trigger"), "observed_date", "close")


@query(
    "o10_13d_store_verification",
    f"WITH {BASE}, r AS (SELECT 'signals' AS kind, CASE WHEN year(signal_date) < 1998 THEN 1 WHEN year(signal_date) < 2000 THEN 2 ELSE 3 END AS run, count(*) AS n FROM sig GROUP BY 1, 2 UNION ALL SELECT 'outcomes', 1, count(*) FROM sig JOIN nb b ON b.symbol = sig.symbol AND b.rn = sig.rn + 1 HAVING count(*) > 0) SELECT kind, 'OK' AS status, n AS n_rows FROM r",
)
def store_verification(spark, d):
    """Each part's rows hashed again: the store is what its manifest says."""
    store = filled(spark, d)
    rows = {p["name"]: p["rows"] for p in store.head()["parts"]}
    sizes = spark.createDataFrame(list(rows.items()), "part string, n_rows long")
    return store.verify().join(F.broadcast(sizes), "part").select("kind", "status", "n_rows")
