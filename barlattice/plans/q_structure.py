"""Queries for pullback structures (o5.10), their predicates and exits (o4.6, o4.7) and their simulation (o10.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlattice.operators import execution as ex
from barlattice.operators import features as fx
from barlattice.operators import structure as st
from barlattice.sources import panel as P

from .q_execution import own_path, replay_sql
from .q_features import GEOMETRY_SQL, RELVOL_SQL, r6
from .registry import query
from .sql import W, f, rounded

R = st.BALANCED
B = f"{P.BARS}, {P.NUMBERED}"

#: Tables of pivots, joined pair by pair; written apart from the array form in Spark.
STRUCTURE = f"""pv0 AS (SELECT *, count(low) {f(-R.radius, -1)} + count(low) {f(1, R.radius)} AS cnt, min(low) {f(-R.radius, -1)} AS a1, min(low) {f(1, R.radius)} AS a2, max(high) {f(-R.radius, -1)} AS b1, max(high) {f(1, R.radius)} AS b2 FROM nb),
lo AS (SELECT symbol, rn, low FROM pv0 WHERE cnt = {2 * R.radius} AND low <= a1 AND low <= a2), hi AS (SELECT symbol, rn, high FROM pv0 WHERE cnt = {2 * R.radius} AND high >= b1 AND high >= b2),
tt AS (SELECT symbol, date, rn, open, high, low, close, lag(close) {W} AS prev_close, avg(close) {f(-4)} AS ma5 FROM nb),
pp AS (SELECT t.symbol, t.rn AS t, s.rn AS rn2, s.low AS low2, a.rn AS rn1, a.low AS low1 FROM tt t JOIN lo s ON s.symbol = t.symbol AND s.rn BETWEEN t.rn - {R.reach} AND t.rn - 1 - {R.radius} JOIN lo a ON a.symbol = t.symbol AND a.rn BETWEEN t.rn - {R.reach} AND s.rn - {R.apart} AND s.low > a.low WHERE t.rn >= {max(R.slow, R.reach + 2)}),
pk AS (SELECT pp.symbol, t, rn1, rn2, max(h.rn) AS peak_rn, arg_max(h.high, h.rn) AS peak FROM pp JOIN hi h ON h.symbol = pp.symbol AND h.rn BETWEEN t - {R.reach} AND rn1 - 1 GROUP BY 1, 2, 3, 4),
rb AS (SELECT pp.symbol, t, rn1, rn2, max(h.rn) AS rebound_rn, arg_max(h.high, h.rn) AS rebound FROM pp JOIN hi h ON h.symbol = pp.symbol AND h.rn BETWEEN rn2 + 1 AND t - 1 - {R.radius} GROUP BY 1, 2, 3, 4),
dp AS (SELECT pk.symbol, t, rn1, rn2, min(b.low) AS floor_ FROM pk JOIN nb b ON b.symbol = pk.symbol AND b.rn BETWEEN peak_rn + 1 AND t - 1 GROUP BY 1, 2, 3, 4),
cc AS (SELECT pp.*, peak_rn, peak, rebound_rn, rebound, (peak - floor_) / peak AS depth, (rebound - low2) / low2 AS size FROM pp JOIN pk USING (symbol, t, rn1, rn2) JOIN rb USING (symbol, t, rn1, rn2) JOIN dp USING (symbol, t, rn1, rn2)),
ch AS (SELECT * FROM cc WHERE depth BETWEEN {R.depth[0]} AND {R.depth[1]} AND size BETWEEN {R.rebound[0]} AND {R.rebound[1]} QUALIFY row_number() OVER (PARTITION BY symbol, t ORDER BY rn2 DESC, rn1 DESC) = 1),
str0 AS (SELECT tt.*, ch.* EXCLUDE (symbol) FROM ch JOIN tt ON tt.symbol = ch.symbol AND tt.rn = ch.t),
sd AS (SELECT s.symbol, s.rn, bool_or(b.close < low1) AS destroyed, bool_or(b.low < low1 AND b.close >= low1) AS punctured FROM str0 s JOIN nb b ON b.symbol = s.symbol AND b.rn > s.peak_rn AND b.rn < s.rn GROUP BY 1, 2),
strc AS (SELECT str0.*, CASE WHEN close < low1 THEN 'T_CLOSE_BREAK' WHEN destroyed THEN 'PULLBACK_SUPPORT_DESTROYED' WHEN low < low1 THEN 'T_INTRADAY_PUNCTURE_RECOVERED' WHEN punctured THEN 'PULLBACK_INTRADAY_PUNCTURE_RECOVERED' ELSE 'INTACT' END AS support_state,
 (close > rebound AND close > prev_close AND close > open AND CASE WHEN high > low THEN (close - low) / (high - low) ELSE 1 END >= {R.close_location}) AS confirmed FROM str0 JOIN sd USING (symbol, rn))"""


def structures(spark, d):
    return st.pullback_structures(P.numbered(P.bars(spark, d)), R)


@query("o5_10_pullback_structures", f"WITH {B}, {STRUCTURE} SELECT symbol, date, rn - peak_rn AS peak_age, rn - rn1 AS first_age, rn - rn2 AS second_age, rn - rebound_rn AS rebound_age, {rounded('peak low1 low2 rebound depth size')} FROM strc")
def pullback_structures(spark, d):
    x = structures(spark, d)
    ages = [(F.col("rn") - F.col(c)).cast("long").alias(n) for c, n in (("peak_rn", "peak_age"), ("rn1", "first_age"), ("rn2", "second_age"), ("rebound_rn", "rebound_age"))]
    return r6(x.select("*", *ages), "peak low1 low2 rebound depth size", "symbol", "date", "peak_age", "first_age", "second_age", "rebound_age")


PATH = "pull_median reference_median first_half second_half up_median down_median ratio up_down_ratio"
VOLUME_SQL = """lc AS (SELECT symbol, rn, volume, close > lag(close) OVER (PARTITION BY symbol ORDER BY date) AS up, close < lag(close) OVER (PARTITION BY symbol ORDER BY date) AS down FROM nb),
vm AS (SELECT s.symbol, s.date, median(volume) FILTER (lc.rn > peak_rn) AS pull_median, median(volume) FILTER (lc.rn <= peak_rn) AS reference_median, median(volume) FILTER (lc.rn > peak_rn AND lc.rn - peak_rn <= (s.rn - peak_rn) // 2) AS first_half, median(volume) FILTER (lc.rn - peak_rn > (s.rn - peak_rn) // 2) AS second_half,
 median(volume) FILTER (lc.rn > peak_rn AND up) AS um, median(volume) FILTER (lc.rn > peak_rn AND down) AS dm, count(*) FILTER (lc.rn > peak_rn AND up) AS un, count(*) FILTER (lc.rn > peak_rn AND down) AS dn FROM strc s JOIN lc ON lc.symbol = s.symbol AND lc.rn BETWEEN peak_rn - 19 AND s.rn - 1 GROUP BY 1, 2),
vp AS (SELECT *, CASE WHEN un >= 2 AND dn >= 2 THEN um END AS up_median, CASE WHEN un >= 2 AND dn >= 2 THEN dm END AS down_median, pull_median / nullif(reference_median, 0) AS ratio, CASE WHEN un >= 2 AND dn >= 2 THEN um / nullif(dm, 0) END AS up_down_ratio FROM vm)"""


@query("o3_11_volume_path", f"WITH {B}, {STRUCTURE}, {VOLUME_SQL} SELECT symbol, date, {rounded(PATH)}, CASE WHEN ratio IS NULL THEN 'UNDETERMINED' WHEN ratio <= 0.80 THEN 'CONTRACTED_OBSERVABLE' WHEN ratio >= 1.20 THEN 'EXPANDED_OBSERVABLE' ELSE 'MIXED_OBSERVABLE' END AS label FROM vp")
def volume_path(spark, d):
    return r6(st.volume_path(structures(spark, d)), PATH, "symbol", "date", "label")


@query(
    "o4_6_structure_predicates",
    f"WITH {B}, {STRUCTURE}, {GEOMETRY_SQL}, {RELVOL_SQL} SELECT s.symbol, s.date, confirmed, support_state, coalesce(median_ratio >= 2.0 AND abs(body_return) <= 0.005 AND close_location <= 0.60, FALSE) AS stall, (s.high >= peak * 0.99 AND s.close < peak AND close_location <= 0.60) AS rejected, 'UNAVAILABLE' AS limit_up_status "
    "FROM strc s JOIN ge ON ge.symbol = s.symbol AND ge.date = s.date JOIN ra ON ra.symbol = s.symbol AND ra.date = s.date",
)
def structure_predicates(spark, d):
    panel = P.bars(spark, d)
    x = st.observations(structures(spark, d), R).drop("close_location")
    x = x.join(fx.geometry(panel).select("symbol", "date", "body_return", "close_location"), ["symbol", "date"]).join(fx.relative_volume(panel).select("symbol", "date", "median_ratio"), ["symbol", "date"])
    low_place = F.col("close_location") <= 0.60
    stall = st.stalled(F.col("median_ratio"), F.col("body_return"), F.col("close_location"))
    rejected = (F.col("high") >= F.col("peak") * (1 - R.tolerance)) & (F.col("close") < F.col("peak")) & low_place
    # The bars carry no limit price, and a daily bar alone cannot show a failed limit.
    return x.select("symbol", "date", "confirmed", "support_state", stall.alias("stall"), rejected.alias("rejected"), F.lit("UNAVAILABLE").alias("limit_up_status"))


@query(
    "o4_6b_failed_pushes",
    f"WITH {B}, {STRUCTURE}, w AS (SELECT s.symbol, s.rn AS t, b.rn, b.high >= peak * (1 - {R.tolerance}) AND b.close < peak AND CASE WHEN b.high > b.low THEN (b.close - b.low) / (b.high - b.low) ELSE 1 END <= 0.60 AS fail FROM strc s JOIN nb b ON b.symbol = s.symbol AND b.rn BETWEEN s.rn - 4 AND s.rn AND b.rn > peak_rn), "
    "g AS (SELECT symbol, t, count(*) FILTER (fail) AS n_failed_pushes, t - coalesce(max(rn) FILTER (NOT fail), min(rn) - 1) AS run_at_end FROM w GROUP BY 1, 2) "
    "SELECT s.symbol, s.date, n_failed_pushes, run_at_end, CASE WHEN s.rn % 2 = 0 THEN 'AVAILABLE_DAILY_PROXY' ELSE 'UNAVAILABLE' END AS limit_up_status, CASE WHEN s.rn % 2 = 0 THEN high >= prev_close * 1.02 - 0.005 END AS limit_up_touched, CASE WHEN s.rn % 2 = 0 THEN high >= prev_close * 1.02 - 0.005 AND close < prev_close * 1.02 - 0.005 END AS limit_up_failed FROM strc s JOIN g ON g.symbol = s.symbol AND g.t = s.rn",
)
def failed_pushes(spark, d):
    """Failed pushes at the peak and their run up to the bar; every second bar is given a limit price of 1.02 closes."""
    x = st.failed_pushes(structures(spark, d))
    limit = F.when(F.col("rn") % 2 == 0, F.col("prev_close") * 1.02)
    return x.select("symbol", "date", "n_failed_pushes", "run_at_end", *st.limit_up(limit, F.lit(0.01), F.col("high"), F.col("close")))


AFTER = """af AS (SELECT s.symbol, s.date, b.rn - s.rn AS step, peak, low1 AS floor_, b.open, b.high, b.low, b.close, first_value(b.open) OVER (PARTITION BY s.symbol, s.date ORDER BY b.rn) AS entry FROM strc s JOIN nb b ON b.symbol = s.symbol AND b.rn BETWEEN s.rn + 1 AND s.rn + 10 WHERE s.close > s.rebound),
ag AS (SELECT *, CAST(step > 1 AND high >= peak * (1 - 0.01) AND close < peak AND CASE WHEN high > low THEN (close - low) / (high - low) ELSE 1 END <= 0.60 AS INTEGER) AS push FROM af),
ah AS (SELECT *, CAST(sum(push) OVER (PARTITION BY symbol, date ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM ag)"""


@query(
    "o4_7_exit_states",
    f"WITH {B}, {STRUCTURE}, {AFTER} SELECT symbol, date, step, n AS failed_pushes, CASE WHEN close < floor_ THEN 'KEY_SUPPORT_BREAK' WHEN push = 1 AND n >= 2 AND close > entry THEN 'EARLY_PROFIT_TAKING_CANDIDATE' WHEN push = 1 AND n = 1 THEN 'FIRST_RESISTANCE_REJECTION_WARNING' WHEN push = 1 THEN 'REPEATED_RESISTANCE_REJECTION_RISK' ELSE 'HOLD_OR_REOBSERVE' END AS exit_state FROM ah WHERE step > 1",
)
def exit_states(spark, d):
    return st.with_exits(steps_after(P.numbered(P.bars_by_symbol(spark, d)))).select("symbol", "date", "step", F.col("n").alias("failed_pushes"), "exit_state")


def steps_after(numbered, *more):
    """The pushes in the ten bars after each structure that closes above its rebound, with ``more`` columns of the bars."""
    panel = st.with_next_bars(numbered, ["open", "high", "low", "close", *more])
    return st.pushes_after(st.pullback_structures(panel, R, ("after",)).where("close > rebound"), R)


VOLUME_STATE = "CASE WHEN close < floor_ THEN 'KEY_SUPPORT_BREAK' WHEN push = 1 AND n >= 2 AND close > entry AND {0} THEN 'EARLY_PROFIT_TAKING_CANDIDATE' WHEN push = 1 AND n = 1 THEN 'FIRST_RESISTANCE_REJECTION_WARNING' WHEN push = 1 THEN 'REPEATED_RESISTANCE_REJECTION_RISK' ELSE 'HOLD_OR_REOBSERVE' END"
CLASS = "CASE {0} WHEN 'KEY_SUPPORT_BREAK' THEN CASE WHEN close > entry THEN 'PROFIT_PROTECTION' ELSE 'ENTRY_RISK' END WHEN 'EARLY_PROFIT_TAKING_CANDIDATE' THEN 'PROFIT_EXIT' WHEN 'HOLD_OR_REOBSERVE' THEN 'NONE' ELSE 'WARNING_ONLY' END"


@query(
    "o4_7b_exit_states_by_volume",
    f"WITH {B}, {STRUCTURE}, {GEOMETRY_SQL}, {RELVOL_SQL}, {AFTER.replace('b.rn - s.rn AS step,', 'b.rn - s.rn AS step, b.date AS bdate,')}, ai AS (SELECT ah.*, coalesce(median_ratio >= 2.0 AND abs(body_return) <= 0.005 AND close_location <= 0.60, FALSE) AS stall FROM ah LEFT JOIN ge ON ge.symbol = ah.symbol AND ge.date = ah.bdate LEFT JOIN ra ON ra.symbol = ah.symbol AND ra.date = ah.bdate), "
    f"aj AS (SELECT *, {VOLUME_STATE.format('TRUE')} AS by_price, {VOLUME_STATE.format('stall')} AS by_volume FROM ai WHERE step > 1) "
    f"SELECT symbol, date, step, stall, by_price AS exit_state, {CLASS.format('by_price')} AS exit_class, by_volume AS exit_state_by_volume, {CLASS.format('by_volume')} AS exit_class_by_volume, CASE WHEN by_volume IN ('KEY_SUPPORT_BREAK', 'EARLY_PROFIT_TAKING_CANDIDATE') THEN 'NEXT_SESSION_REFERENCE_EXIT' ELSE 'NONE' END AS exit_action_by_volume FROM aj",
)
def exit_states_by_volume(spark, d):
    """Both defences side by side: profit taken early by price alone, and only where the push stalls on high volume."""
    x = fx.with_median_ratio(P.numbered(P.bars_by_symbol(spark, d))).withColumn("stall", st.stalled(F.col("median_ratio"), fx.body_return(), fx.close_location())).drop("past", "med")
    x = st.with_exits(st.with_exits(steps_after(x, "stall")), stall="stall", suffix="_by_volume")
    return x.select("symbol", "date", "step", "stall", "exit_state", "exit_class", "exit_state_by_volume", "exit_class_by_volume", "exit_action_by_volume")


LEVELS = "sig AS (SELECT symbol || ':' || CAST(date AS VARCHAR) AS signal_id, symbol, date AS signal_date, rn, close, trigger, stop, CASE WHEN peak > close * 1.03 THEN peak ELSE close + 2.5 * (close - stop) END AS target FROM (SELECT *, round(greatest(rebound, ma5), 2) AS trigger, round(low1 * 0.98, 2) AS stop FROM strc WHERE close > rebound AND support_state IN ('INTACT', 'T_INTRADAY_PUNCTURE_RECOVERED', 'PULLBACK_INTRADAY_PUNCTURE_RECOVERED')))"


@query("o10_10_structure_simulation", f"WITH {B}, {STRUCTURE}, {LEVELS}, {own_path(20)}, {replay_sql(20, False, False, 20)} SELECT rp.*, trigger, stop, round(target, 6) AS target FROM rp JOIN sig USING (signal_id)")
def structure_simulation(spark, d):
    x = st.observations(structures(spark, d), R).where(F.col("support_state").isin("INTACT", "T_INTRADAY_PUNCTURE_RECOVERED", "PULLBACK_INTRADAY_PUNCTURE_RECOVERED")).where("close > rebound")
    x = x.withColumn("trigger", F.round(F.greatest("rebound", "ma5"), 2)).withColumn("stop", F.round(F.col("low1") * 0.98, 2))
    x = x.withColumn("target", F.when(F.col("peak") > F.col("close") * 1.03, F.col("peak")).otherwise(F.col("close") + 2.5 * (F.col("close") - F.col("stop"))))
    s = P.kept(x.select(F.concat_ws(":", "symbol", F.col("date").cast("string")).alias("signal_id"), "symbol", F.col("date").alias("signal_date"), "rn", "close", "trigger", "stop", "target"))
    path = ex.own_clock_path(s, P.numbered(P.bars(spark, d)), 20)
    return ex.replay(path, horizon=20, gap_fills=False, time_exit=False).join(s.select("signal_id", "trigger", "stop", F.round("target", 6).alias("target")), "signal_id")


def pairs_sql(rule: st.Rule, name: str) -> str:
    """All pairs of rising lows for each symbol's last bar, as joins of pivot tables; ``name`` makes the table names."""
    r, k, m = rule, name, max(rule.trend, rule.slow)
    fails = " + ".join(f"CAST(NOT {n} AS INTEGER)" for n in (*st.TREND, *st.GATES, *st.CONFIRMATION, *st.SUPPORT))
    return f"""h_{k} AS (SELECT *, max(rn) OVER (PARTITION BY symbol) AS t FROM nb QUALIFY rn > t - 260),
v_{k} AS (SELECT *, lag(close) {W} AS prev_close, count(low) {f(-r.radius, -1)} + count(low) {f(1, r.radius)} AS cnt, min(low) {f(-r.radius, -1)} AS a1, min(low) {f(1, r.radius)} AS a2, max(high) {f(-r.radius, -1)} AS b1, max(high) {f(1, r.radius)} AS b2 FROM h_{k}),
l_{k} AS (SELECT symbol, rn, low FROM v_{k} WHERE cnt = {2 * r.radius} AND low <= a1 AND low <= a2 AND rn < t - {r.radius}), g_{k} AS (SELECT symbol, rn, high FROM v_{k} WHERE cnt = {2 * r.radius} AND high >= b1 AND high >= b2 AND rn < t - {r.radius}),
tr_{k} AS (SELECT symbol, rn, avg(close) {f(1 - r.fast)} AS sma_fast, avg(close) {f(1 - r.slow)} AS sma_slow, regr_slope(ln(close), CAST(rn AS DOUBLE)) {f(1 - r.trend)} AS log_slope, avg(rise) {f(2 - r.trend)} AS up_fraction FROM (SELECT *, CASE WHEN close > lag(close) {W} THEN 1.0 WHEN lag(close) {W} IS NOT NULL THEN 0.0 END AS rise FROM nb) QUALIFY rn >= {m}),
t_{k} AS (SELECT v.symbol, v.date, v.t, v.open, v.high, v.low, v.close, v.prev_close, sma_fast, sma_slow, log_slope, up_fraction FROM v_{k} v LEFT JOIN tr_{k} q ON q.symbol = v.symbol AND q.rn = v.rn WHERE v.rn = v.t),
p_{k} AS (SELECT t.*, a.rn AS rn1, a.low AS low1, b.rn AS rn2, b.low AS low2 FROM t_{k} t LEFT JOIN (l_{k} a JOIN l_{k} b ON a.symbol = b.symbol AND b.rn - a.rn >= {r.apart} AND b.low > a.low) ON a.symbol = t.symbol),
pk_{k} AS (SELECT l.symbol, l.rn AS rn1, max(g.rn) AS peak_rn, arg_max(g.high, g.rn) AS peak FROM l_{k} l JOIN g_{k} g ON g.symbol = l.symbol AND g.rn < l.rn GROUP BY 1, 2),
pm_{k} AS (SELECT pk.symbol, rn1, any_value(peak_rn) AS peak_rn, any_value(peak) AS peak, min(b.low) AS later_low, min(b.close) AS later_close FROM pk_{k} pk JOIN h_{k} b ON b.symbol = pk.symbol AND b.rn > peak_rn AND b.rn < b.t GROUP BY 1, 2),
rb_{k} AS (SELECT l.symbol, l.rn AS rn2, arg_max(g.high, g.rn) AS rebound FROM l_{k} l JOIN g_{k} g ON g.symbol = l.symbol AND g.rn > l.rn GROUP BY 1, 2),
q_{k} AS (SELECT p.*, peak_rn, peak, rebound, p.t - peak_rn AS age, (peak - later_low) / peak AS depth, (rebound - low2) / low2 AS size, CASE WHEN high > low THEN (close - low) / (high - low) ELSE 1 END AS place, CASE WHEN later_close < close THEN later_close ELSE close END AS least_close FROM p_{k} p LEFT JOIN pm_{k} pm ON pm.symbol = p.symbol AND pm.rn1 = p.rn1 LEFT JOIN rb_{k} rb ON rb.symbol = p.symbol AND rb.rn2 = p.rn2),
c0_{k} AS (SELECT *, close > sma_fast AS close_above_fast_average, sma_fast > sma_slow AS ma_order_ok, log_slope > 0 AS positive_slope, up_fraction >= {r.up_fraction} AS up_close_fraction_ok, CASE WHEN rn1 IS NOT NULL THEN peak IS NOT NULL END AS pre_pullback_peak_available, age <= {r.reach} AS peak_age_ok, depth BETWEEN {r.depth[0]} AND {r.depth[1]} AS depth_ok,
 CASE WHEN rn1 IS NOT NULL THEN rebound IS NOT NULL END AS rebound_high_available, size BETWEEN {r.rebound[0]} AND {r.rebound[1]} AS rebound_size_ok, close > rebound AS close_above_rebound_high, CASE WHEN rebound IS NOT NULL THEN close > prev_close END AS close_above_previous_close, CASE WHEN rebound IS NOT NULL THEN close > open END AS positive_body, CASE WHEN rebound IS NOT NULL THEN place >= {r.close_location} END AS close_location_ok, CASE WHEN peak IS NOT NULL THEN least_close >= low1 END AS entry_support_ok FROM q_{k}),
c1_{k} AS (SELECT *, CAST({fails} AS BIGINT) AS failed_count, coalesce({' AND '.join(st.GATES)}, FALSE) AS fits FROM c0_{k}), b_{k} AS (SELECT symbol, rn1, rn2 FROM c1_{k} WHERE fits QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY rn2 DESC, rn1 DESC) = 1),
{k} AS (SELECT c.*, c.rn1 IS NOT NULL AND (b.rn1 IS NULL OR (b.rn1 = c.rn1 AND b.rn2 = c.rn2)) AS near FROM c1_{k} c LEFT JOIN b_{k} b ON b.symbol = c.symbol WHERE b.rn1 IS NULL OR c.rn2 > b.rn2 OR (c.rn2 = b.rn2 AND c.rn1 >= b.rn1))"""


RULES = {"BALANCED": (st.BALANCED, "cb"), "CONSERVATIVE": (st.CONSERVATIVE, "cv")}


def diagnosis_sql(rule: st.Rule, name: str, label: str) -> str:
    enough = max(rule.slow, rule.reach + 2)
    met = " AND ".join((*st.TREND, "fits", *st.CONFIRMATION, *st.SUPPORT))
    return f"""SELECT symbol, date, '{label}' AS rule, CASE WHEN max(t) < {enough} THEN 'INSUFFICIENT_HISTORY' WHEN bool_or(fits) THEN 'OK' WHEN count(rn1) = 0 THEN 'NO_DISTINCT_HIGHER_LOW_PAIR' WHEN NOT bool_or(coalesce(pre_pullback_peak_available, FALSE)) THEN 'NO_PRE_PULLBACK_PEAK' WHEN NOT bool_or(coalesce(peak_age_ok AND depth_ok, FALSE)) THEN 'PULLBACK_DEPTH_OUTSIDE_CANDIDATE' ELSE 'NO_CONFIRMED_REBOUND_HIGH' END AS structure_status,
bool_or(coalesce({met}, FALSE)) AS matched, count(rn1) AS pairs, min(failed_count) FILTER (near) AS least_failed, {', '.join(f'count(*) FILTER (NOT {n}) AS n_{n}_failed' for n in st.GATES)} FROM {name} GROUP BY symbol, date"""


def near_sql(rule: st.Rule, name: str, label: str) -> str:
    def ends(v, bounds):
        return v, f"CASE WHEN {v} < {bounds[0]} THEN {bounds[0]} ELSE {bounds[1]} END", f"CASE WHEN {v} < {bounds[0]} THEN {v} - {bounds[0]} ELSE {bounds[1]} - {v} END"

    plain = {"close_above_fast_average": ("close", "sma_fast"), "ma_order_ok": ("sma_fast", "sma_slow"), "positive_slope": ("log_slope", "0.0"), "up_close_fraction_ok": ("up_fraction", str(rule.up_fraction)), "close_above_rebound_high": ("close", "rebound"), "close_above_previous_close": ("close", "prev_close"), "positive_body": ("close", "open"), "close_location_ok": ("place", str(rule.close_location)), "entry_support_ok": ("least_close", "low1")}
    facts = {**{n: (v, x, f"{v} - {x}") for n, (v, x) in plain.items()}, "depth_ok": ends("depth", rule.depth), "rebound_size_ok": ends("size", rule.rebound), "peak_age_ok": ("age", str(rule.reach), f"{rule.reach} - age")}
    cases = [" ".join(f"WHEN NOT {n} THEN {x}" for n, x in ((n, [f"'{st.NEAR_MISS[n]}'", f"'{n}'", *(f"CAST({z} AS DOUBLE)" for z in fs)][i]) for n, fs in facts.items())) for i in range(5)]
    columns = ", ".join(f"CASE {c} END AS {n}" for c, n in zip(cases, ("near_miss_class", "condition", "value", "threshold", "margin")))
    return f"SELECT symbol, date, '{label}' AS rule, near_miss_class, condition, round(value, 6) AS value, round(threshold, 6) AS threshold, round(margin, 6) AS margin FROM (SELECT symbol, date, rn1, rn2, {columns} FROM {name} WHERE near AND failed_count = 1) WHERE near_miss_class IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, near_miss_class ORDER BY round(abs(margin), 9), rn2 DESC, rn1 DESC) = 1"


def contexts_of(spark, d):
    """Contexts of both rules over one panel."""
    panel = P.kept_bars(spark, d)
    return [(st.pair_contexts(panel, rule), rule, label) for label, (rule, _) in RULES.items()]


ALL_PAIRS = f"WITH {B}, {', '.join(pairs_sql(*x) for x in RULES.values())} "


@query("o4_14b_pullback_diagnosis", ALL_PAIRS + " UNION ALL ".join(diagnosis_sql(*x, label) for label, x in RULES.items()))
def pullback_diagnosis(spark, d):
    balanced, conservative = (st.diagnosis(x, rule).withColumn("rule", F.lit(label)) for x, rule, label in contexts_of(spark, d))
    return balanced.unionByName(conservative)


@query("o4_14c_pullback_near_misses", ALL_PAIRS + " UNION ALL ".join(f"({near_sql(*x, label)})" for label, x in RULES.items()))
def pullback_near_misses(spark, d):
    balanced, conservative = (r6(st.near_misses(x, rule).withColumn("rule", F.lit(label)), "value threshold margin", "symbol", "date", "rule", "near_miss_class", "condition") for x, rule, label in contexts_of(spark, d))
    return balanced.unionByName(conservative)
