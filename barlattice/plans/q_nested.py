"""Queries over nested documents (o5.4, o13.4), two runs of one computation (o13.7), backfills (o13.8) and full outcome metrics (o6.1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlattice.operators import identity as idn
from barlattice.operators import ledger as lg
from barlattice.operators import nested
from barlattice.operators import statistics as st
from barlattice.sources import panel as P

from .q_features import pullback_observation
from .q_statistics import determinism_sample
from .registry import ORACLE_SQL, query

BASE = f"{P.BARS}, {P.NUMBERED}, {P.SIGNALS}"


@query(
    "o5_4b_nested_search",
    f"WITH {BASE} SELECT signal_date, CASE WHEN rn % 4 = 1 THEN 'sh' ELSE '' END || substr(symbol, 3, 6) AS symbol, rn AS first_rank, rn + CASE WHEN rn % 6 = 0 THEN 1 ELSE 0 END AS last_rank FROM sig WHERE rn % 12 <> 1",
)
def nested_search(spark, d):
    """A document for each signal date with its symbols in lists of lists, under keys or deep below; each signal asks for its own."""
    s = P.kept(P.signals(P.bars(spark, d)).select("signal_date", F.substring("symbol", 3, 6).alias("code"), "rn"))
    rn = F.col("rn")
    listed = F.struct(F.concat(F.when(rn % 2 == 1, "sh").otherwise(""), "code").alias("symbol"), rn.alias("rank"))
    keyed = F.struct(F.concat(F.lit("SZ"), "code").alias("key"), F.struct(rn.alias("rank")).alias("value"))
    deep = F.struct(F.col("code"), (rn + F.when(rn % 6 == 0, 1).otherwise(0)).alias("rank"))
    docs = s.groupBy("signal_date").agg(
        F.count(F.lit(1)).alias("n"), F.collect_list(F.when(rn % 3 == 0, listed)).alias("listed"), F.map_from_entries(F.collect_list(F.when(rn % 3 == 1, keyed))).alias("keyed"), F.collect_list(F.when((rn % 3 == 2) | (rn % 6 == 0), deep)).alias("deep")
    )
    body = F.to_json(F.struct(F.struct("n", F.lit(None).cast("string").alias("symbol")).alias("head"), F.array(F.array(), F.col("listed")).alias("lists"), F.col("keyed").alias("map"), F.struct(F.struct(F.col("deep").alias("y")).alias("x")).alias("tail")))
    docs = P.kept(docs.select("signal_date", body.alias("body")))
    asked = s.select("signal_date", F.concat(F.when(rn % 4 == 1, "sh").otherwise(""), "code").alias("symbol"))
    first, last = (nested.search(docs, "signal_date", "body", asked, "symbol", turn).select("signal_date", "symbol", F.get_json_object("record", "$.rank").cast("long").alias(name)) for turn, name in ((False, "first_rank"), (True, "last_rank")))
    return first.join(last, ["signal_date", "symbol"])


@query(
    "o13_4b_document_conflicts",
    "WITH c AS (SELECT c_custkey AS key FROM customer), k AS (SELECT *, key % 10 = 0 AS no_right, key % 8 = 0 AS no_left FROM c), b AS (SELECT key FROM k WHERE NOT no_left AND NOT no_right) "
    "SELECT key, '' AS path, CASE WHEN no_right THEN 'ONLY_LEFT' ELSE 'ONLY_RIGHT' END AS status FROM k WHERE no_left <> no_right UNION ALL SELECT key, '/frozen/segment', 'DIFFERENT' FROM b WHERE key % 9 = 0 UNION ALL SELECT key, '/frozen/extra', 'ONLY_RIGHT' FROM b WHERE key % 7 = 0 "
    "UNION ALL SELECT key, '/frozen/nation', 'ONLY_LEFT' FROM b WHERE key % 11 = 0 UNION ALL SELECT key, '/semantic/state', 'DIFFERENT' FROM b WHERE key % 13 = 0",
)
def document_conflicts(spark, d):
    """A live and a persisted document of every customer: keys on one side, nulls that are missing, values that differ; heads may."""
    k = F.col("c_custkey")
    c = P.read(spark, d, "customer").select(k.alias("key"), "c_mktsegment", "c_nationkey", k)
    semantic = [F.lit("A").alias("state"), F.when(k % 17 == 0, 1).alias("mine")]
    # to_json leaves nulls out; a null that is there is written as such.
    frozen = F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.when(k % 11 != 0, F.col("c_nationkey")).alias("nation")), {"ignoreNullFields": "false"})
    left = F.concat(F.lit('{"head": "new", "frozen": '), frozen, F.lit(', "semantic": '), F.to_json(F.struct(*semantic)), F.lit("}"))
    other = F.to_json(F.struct(F.when(k % 13 == 0, "B").otherwise("A").alias("state"), F.when(k % 19 == 0, 1).alias("theirs")))
    stored = F.to_json(F.struct(F.when(k % 7 == 0, 1).alias("extra"), F.when(k % 11 != 0, F.col("c_nationkey").cast("double")).alias("nation"), F.when(k % 9 == 0, "OTHER").otherwise(F.col("c_mktsegment")).alias("segment")))
    right = F.concat(F.lit('{"semantic": '), other, F.lit(', "frozen": '), stored, F.lit(', "head": "old"}'))
    out = nested.differences(c.where(k % 8 != 0).select("key", left.alias("body")), c.where(k % 10 != 0).select("key", right.alias("body")), "key", "body", ["/head"], ["/semantic"])
    return out.select("key", "path", "status")


@query(
    "o13_7b_two_runs",
    f"WITH {P.BARS}, sa AS ({ORACLE_SQL['o8_3_determinism_sample']}) SELECT sa.symbol, part, count(*) AS n_rows, TRUE AS runs_agree, sa.symbol = (SELECT min(symbol) FROM sa) AS change_found FROM sa JOIN bars b ON b.symbol = sa.symbol GROUP BY 1, 2",
)
def two_runs(spark, d):
    """The sample's bars from two plans with other partitions have the same fingerprints; one changed line is found, in its symbol alone."""
    lines = P.read(spark, d, "lineitem")
    sample = P.kept(determinism_sample(spark, d))
    seeded = sample.agg(F.min("symbol")).first()[0]
    own = P.symbol_of(F.col("l_suppkey")) == seeded
    at = lines.where(own).agg(F.min(F.struct("l_orderkey", "l_linenumber"))).first()[0]
    hit = own & (F.col("l_orderkey") == at[0]) & (F.col("l_linenumber") == at[1])
    runs = {"a": lines, "b": lines.repartition(13, "l_quantity"), "c": lines.withColumn("l_extendedprice", F.when(hit, F.col("l_extendedprice") + 1).otherwise(F.col("l_extendedprice")))}
    out = sample
    for name, rows in runs.items():
        x = P.bars_of(rows).join(F.broadcast(sample.select("symbol")), "symbol")  # twelve symbols
        x = x.select("symbol", "date", *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close", "volume", "turnover")])
        x = idn.fingerprint(x, ["symbol"], x.columns).select("symbol", F.col("n_rows").alias(f"n_{name}"), F.col("fingerprint").alias(name))
        out = out.join(x, "symbol")
    return out.select("symbol", "part", F.col("n_a").alias("n_rows"), (F.col("a") == F.col("b")).alias("runs_agree"), (F.col("a") != F.col("c")).alias("change_found"))


METRICS = {
    "mean_return": "avg(ret)", "mean_positive": "avg(ret) FILTER (ret > 0)", "mean_non_positive": "avg(ret) FILTER (ret <= 0)", "mean_mfe": "avg(mfe)", "median_mfe": "median(mfe)", "mean_mae": "avg(mae)", "median_mae": "median(mae)", "min_return": "min(ret)", "max_return": "max(ret)",
}


@query(
    "o6_1b_outcome_metrics",
    f"WITH {BASE}, {P.OUTCOMES}, e AS (SELECT o.* FROM out o JOIN sig ON sig.symbol = o.symbol AND sig.signal_date = o.date), l AS ("
    + " UNION ALL ".join(f"SELECT {h} AS horizon, CAST(year(date) AS VARCHAR) AS y, ret{h} AS ret, mfe{h} AS mfe, mae{h} AS mae FROM e WHERE ret{h} IS NOT NULL" for h in (1, 3, 5, 10))
    + "), g AS (SELECT horizon, coalesce(y, 'ALL') AS period, count(*) AS n, count(*) FILTER (ret > 0) AS positive, " + ", ".join(f"{v} AS {k}" for k, v in METRICS.items()) + " FROM l GROUP BY GROUPING SETS ((horizon, y), (horizon))) "
    "SELECT horizon, period, n AS sample_count, positive AS positive_count, n - positive AS non_positive_count, round(positive / n, 6) AS positive_rate, round(coalesce(positive / n * mean_positive + (1 - positive / n) * mean_non_positive, mean_return), 6) AS expectancy, "
    + ", ".join(f"round({k}, 6) AS {k}" for k in METRICS) + " FROM g",
)
def outcome_metrics(spark, d):
    """Returns and excursions of the signals per horizon, by year and in all; a return of zero is no gain, and the expectancy weighs both means."""
    panel = P.kept_bars(spark, d)
    e = P.outcomes(panel).join(P.signals(panel).select("symbol", F.col("signal_date").alias("date")), ["symbol", "date"])
    rows = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"ret{h}").alias("ret"), F.col(f"mfe{h}").alias("mfe"), F.col(f"mae{h}").alias("mae")) for h in (1, 3, 5, 10)]))
    x = P.kept(e.select(F.year("date").cast("string").alias("period"), rows.alias("r")).select("period", "r.*").where("ret IS NOT NULL"))
    return st.outcome_metrics(x, "horizon", "period").select("horizon", "period", "sample_count", "positive_count", "non_positive_count", *[F.round(c, 6).alias(c) for c in ("positive_rate", "expectancy", *METRICS)])


BACKFILLED = {"down_volume_share": "share_reason", "up_down_volume_ratio": "ratio_reason", "decay_ratio": "decay_reason"}


@query(
    "o13_8b_observation_backfill",
    f"WITH {BASE}, ob AS ({ORACLE_SQL['o3_12_pullback_observation']}), x AS (SELECT sig.signal_id, sig.rn, ob.*, CASE WHEN sig.rn % 19 = 0 THEN 'BAR_MISSING' WHEN sig.rn % 17 = 0 THEN 'IDENTITY_MISMATCH' WHEN ob.symbol IS NULL THEN 'NO_OBSERVATION' WHEN share_reason IS NOT NULL OR ratio_reason IS NOT NULL OR decay_reason IS NOT NULL THEN 'PARTIAL' ELSE 'COMPLETE' END AS status FROM sig LEFT JOIN ob ON ob.symbol = sig.symbol AND ob.date = sig.signal_date) "
    "SELECT signal_id, status, " + ", ".join(f"CASE WHEN status IN ('PARTIAL', 'COMPLETE') THEN {c} END AS {c}" for pair in BACKFILLED.items() for c in pair) + " FROM x",
)
def observation_backfill(spark, d):
    """The locked signals get the volume observation of their bar; some were locked at another close, or at a date without a bar."""
    panel = P.kept_bars(spark, d)
    late = F.when(F.col("rn") % 19 == 0, F.date_add("signal_date", 100_000)).otherwise(F.col("signal_date"))
    locked = P.signals(panel).select("signal_id", "symbol", late.alias("date"), F.when(F.col("rn") % 17 == 0, F.col("close") + 1).otherwise(F.col("close")).alias("locked_close"))
    return lg.backfill(locked, panel, pullback_observation(spark, d).drop("window_days"), BACKFILLED)
