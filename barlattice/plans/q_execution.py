"""Queries for outcomes and execution replays (o10)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barlattice.operators import execution as ex
from barlattice.operators import features as fx
from barlattice.sources import panel as P

from .registry import query

B = P.BARS
BASE = f"{B}, {P.NUMBERED}, {P.SIGNALS}"


def own_path(steps: int) -> str:
    return f"pth AS (SELECT s.*, t.i AS step, b.date AS b_date, b.open AS b_open, b.high AS b_high, b.low AS b_low, b.close AS b_close FROM sig s CROSS JOIN range(1, {steps + 1}) AS t(i) LEFT JOIN nb b ON b.symbol = s.symbol AND b.rn = s.rn + t.i)"


def session_path(steps: int, source: str = "sig") -> str:
    return f"{P.SESSIONS}, pth AS (SELECT s.*, t.i AS step, c.pos AS s_pos, c2.pos IS NOT NULL AS visible, b.date AS b_date, b.open AS b_open, b.high AS b_high, b.low AS b_low, b.close AS b_close FROM {source} s JOIN sessions c ON c.date = s.signal_date CROSS JOIN range(1, {steps + 1}) AS t(i) LEFT JOIN sessions c2 ON c2.pos = c.pos + t.i LEFT JOIN bars b ON b.symbol = s.symbol AND b.date = c2.date)"


OUTCOME = """SELECT signal_id, horizon, status, CASE WHEN status = 'AVAILABLE' THEN round((xit / entry - 1) * 100, 6) END AS return_pct, CASE WHEN status = 'AVAILABLE' THEN round((hi / entry - 1) * 100, 6) END AS mfe_pct, CASE WHEN status = 'AVAILABLE' THEN round((lo / entry - 1) * 100, 6) END AS mae_pct, observed FROM (
SELECT *, CASE WHEN {2} THEN 'SYMBOL_NOT_IN_RAW_STORE' WHEN far > reach THEN 'INSUFFICIENT_FORWARD_COVERAGE' WHEN entry IS NULL THEN 'NO_T_PLUS_1_OPEN' WHEN observed < horizon THEN 'INCOMPLETE_STOCK_WINDOW' ELSE 'AVAILABLE' END AS status FROM (
SELECT signal_id, horizon, count(b_close) AS observed, max(CASE WHEN step = 1 THEN b_open END) AS entry, max(CASE WHEN step = horizon THEN b_close END) AS xit, max(b_high) AS hi, min(b_low) AS lo, max({0}) AS far, max(reach) AS reach, any_value(symbol) AS symbol
FROM pth CROSS JOIN (VALUES (1::BIGINT), (3), (5), (10)) AS h(horizon) {1} WHERE step <= horizon GROUP BY 1, 2))"""


#: Each fiftieth signal comes a second time, for a symbol that the panel does not have.
GHOSTS = "sg AS (SELECT * FROM sig UNION ALL SELECT 'X' || signal_id, 'X' || symbol, * EXCLUDE (signal_id, symbol) FROM sig WHERE rn % 50 = 0)"


def with_ghosts(s):
    ghosts = s.where("rn % 50 = 0").withColumn("signal_id", F.concat(F.lit("X"), "signal_id")).withColumn("symbol", F.concat(F.lit("X"), "symbol"))
    return s.unionByName(ghosts)


@query("o10_1_session_outcomes", f"WITH {BASE}, {GHOSTS}, {session_path(10, 'sg')} " + OUTCOME.format("s_pos + step", "CROSS JOIN (SELECT max(pos) AS reach FROM sessions)", "symbol NOT IN (SELECT symbol FROM bars)"))
def session_outcomes(spark, d):
    panel = P.kept_bars(spark, d)
    s = P.sessions(panel)
    path = ex.session_path(with_ghosts(P.signals(panel)), panel, s, 10).crossJoin(F.broadcast(s.agg(F.max("pos").alias("reach"))))  # one row
    known = panel.select(F.col("symbol").alias("known")).distinct()
    path = path.join(known, F.col("symbol") == F.col("known"), "left").withColumn("in_store", F.col("known").isNotNull())
    return ex.fixed_outcomes(path, F.col("pos"))


@query("o10_1b_own_clock_outcomes", f"WITH {BASE}, {own_path(10)} " + OUTCOME.format("step", "CROSS JOIN (SELECT CAST(NULL AS BIGINT) AS reach)", "FALSE"))
def own_clock_outcomes(spark, d):
    panel = P.kept_bars(spark, d)
    return ex.fixed_outcomes(ex.own_clock_path(P.signals(panel), P.numbered(panel), 10), None)


@query(
    "o10_2_bar_states",
    f"WITH {BASE}, {own_path(5)} SELECT signal_id, step, CASE WHEN b_close IS NULL THEN 'MISSING' WHEN b_high < trigger THEN 'PENDING' WHEN b_low <= stop AND b_high >= target THEN 'AMBIGUOUS' WHEN b_low <= stop THEN 'TRIGGERED_STOP_TOUCHED' WHEN b_high >= target THEN 'TRIGGERED_TARGET_TOUCHED' ELSE 'TRIGGERED' END AS state FROM pth",
)
def bar_states(spark, d):
    panel = P.kept_bars(spark, d)
    return ex.classify_bar(ex.own_clock_path(P.signals(panel), P.numbered(panel), 5)).select("signal_id", "step", "state")


FILL = "CASE WHEN b_open >= trigger THEN b_open WHEN b_high >= trigger THEN trigger END"
KIND = "CASE WHEN b_open <= stop THEN 'STOP_GAP' WHEN b_open >= target THEN 'TARGET_GAP' WHEN b_low <= stop AND b_high >= target THEN 'AMBIGUOUS' WHEN b_low <= stop THEN 'STOP' WHEN b_high >= target THEN 'TARGET' END"
PRICE = "CASE WHEN b_open <= stop THEN b_open WHEN b_open >= target THEN b_open WHEN b_low <= stop AND b_high >= target THEN NULL WHEN b_low <= stop THEN stop WHEN b_high >= target THEN target END"
RULE_FILL = "CASE WHEN b_high >= trigger THEN trigger END"
RULE_KIND = "CASE WHEN b_low <= stop AND b_high >= target THEN 'AMBIGUOUS' WHEN b_low <= stop THEN 'STOP' WHEN b_high >= target THEN 'TARGET' END"
RULE_PRICE = "CASE WHEN b_low <= stop AND b_high >= target THEN NULL WHEN b_low <= stop THEN stop WHEN b_high >= target THEN target END"


@query("o10_3_fills_and_decisions", f"WITH {BASE}, {own_path(5)} SELECT signal_id, step, round({FILL}, 6) AS fill_price, {KIND} AS exit_kind, round({PRICE}, 6) AS exit_price FROM pth")
def fills_and_decisions(spark, d):
    panel = P.kept_bars(spark, d)
    kind, price = ex.exit_decision()
    path = ex.own_clock_path(P.signals(panel), P.numbered(panel), 5)
    return path.select("signal_id", "step", F.round(ex.fill_price(), 6).alias("fill_price"), kind.alias("exit_kind"), F.round(price, 6).alias("exit_price"))


def replay_sql(steps: int, gap: bool, time_exit: bool, horizon: int = 10) -> str:
    """Step by step for each signal: a recursive walk over its path, written apart from the set form in Spark."""
    fill, kind, price = (FILL, KIND, PRICE) if gap else (RULE_FILL, RULE_KIND, RULE_PRICE)
    late = f"step <= {horizon}" if time_exit else "TRUE"
    return f"""d AS (SELECT *, {fill} AS fill, {kind} AS kind, {price} AS price FROM pth),
m AS (SELECT signal_id, coalesce(min(step) FILTER (b_close IS NULL), 999) AS m FROM d GROUP BY 1),
e AS (SELECT d.signal_id, d.step AS e, d.fill AS entry_price FROM d JOIN m USING (signal_id) WHERE fill IS NOT NULL AND step < m AND step <= {horizon} QUALIFY row_number() OVER (PARTITION BY d.signal_id ORDER BY step) = 1),
x AS (SELECT d.signal_id, d.step AS x, d.kind, d.price FROM d JOIN m USING (signal_id) JOIN e USING (signal_id) WHERE kind IS NOT NULL AND step > e AND step < m AND {late} QUALIFY row_number() OVER (PARTITION BY d.signal_id ORDER BY step) = 1),
z AS (SELECT m.signal_id, m, e, entry_price, x, kind, price, CASE WHEN e = {horizon} THEN {horizon} + 1 ELSE {horizon} END AS last FROM m LEFT JOIN e USING (signal_id) LEFT JOIN x USING (signal_id)),
r AS (SELECT z.*, CASE WHEN e = {horizon} THEN t.b_open ELSE t.b_close END AS t_price, ({'TRUE' if time_exit else 'FALSE'}) AS timed FROM z LEFT JOIN d t ON t.signal_id = z.signal_id AND t.step = z.last),
rp AS (SELECT signal_id, CASE WHEN e IS NULL AND m <= {horizon} THEN 'UNVERIFIED' WHEN e IS NULL THEN 'NOT_TRIGGERED' WHEN x IS NOT NULL THEN 'EXIT_' || kind WHEN timed AND m > last THEN 'EXIT_TIME' WHEN timed THEN 'UNVERIFIED' ELSE 'OPEN' END AS status,
 CAST(e AS BIGINT) AS entry_step, round(entry_price, 6) AS entry_price, CAST(CASE WHEN e IS NULL THEN NULL WHEN x IS NOT NULL THEN x WHEN timed AND m > last THEN last END AS BIGINT) AS exit_step,
 round(CASE WHEN e IS NULL THEN NULL WHEN x IS NOT NULL THEN price WHEN timed AND m > last THEN t_price END, 6) AS exit_price,
 round((CASE WHEN e IS NULL THEN NULL WHEN x IS NOT NULL THEN price WHEN timed AND m > last THEN t_price END / entry_price - 1) * 100, 6) AS return_pct FROM r)"""


PROSPECTIVE = f"{BASE}, {own_path(11)}, {replay_sql(11, True, True)}"
RULE = f"{BASE}, {own_path(30)}, {replay_sql(30, False, False, 30)}"


def kept_path(spark, d, steps):
    """The steps after every signal, made once for all models of a query; of the bars only what they read is kept."""
    panel = P.kept(P.bars(spark, d).select("symbol", "date", "open", "high", "low", "close"))
    path = ex.own_clock_path(P.signals(panel), P.numbered(panel), steps)
    return P.kept(path.select("signal_id", "trigger", "stop", "target", "step", "b_open", "b_high", "b_low", "b_close"))


def prospective(spark, d, path=None):
    return ex.replay(kept_path(spark, d, 11) if path is None else path)


def rule_model(spark, d, path=None):
    return ex.replay(kept_path(spark, d, 30) if path is None else path, horizon=30, gap_fills=False, time_exit=False)


def trades(spark, d):
    """The prospective model's rows with R multiple, holding, excursions from entry to exit, and the mark of those that stay open."""
    panel = P.kept_bars(spark, d)
    path = P.kept(ex.own_clock_path(P.signals(panel), P.numbered(panel), 11))
    steps = ex.replay(path).join(path.select("signal_id", "stop", "step", "b_high", "b_low", "b_close"), "signal_id")
    held = F.col("step").between(F.col("entry_step"), F.col("exit_step"))
    left = (F.col("status") == "UNVERIFIED") & (F.col("step") >= F.col("entry_step")) & F.col("b_close").isNotNull()

    def gain(x):
        return (F.col(x) / F.col("entry_price") - 1) * 100

    facts = ["status", "entry_step", "entry_price", "exit_step", "exit_price", "return_pct", "stop"]
    x = steps.groupBy("signal_id").agg(*[F.first(c).alias(c) for c in facts], F.max(F.when(held, gain("b_high"))).alias("hi"), F.min(F.when(held, gain("b_low"))).alias("lo"), F.max_by(gain("b_close"), F.when(left, F.col("step"))).alias("mtm"))
    risk = F.col("entry_price") - F.col("stop")
    x = x.withColumn("r", F.when(F.col("exit_price").isNotNull() & (risk > 0), (F.col("exit_price") - F.col("entry_price")) / risk)).withColumn("holding", F.col("exit_step") - F.col("entry_step"))
    return x.withColumn("mfe", F.when(F.col("hi").isNotNull(), F.greatest(F.lit(0.0), "hi"))).withColumn("mae", F.when(F.col("lo").isNotNull(), F.least(F.lit(0.0), "lo")))


query("o10_4_prospective_replay", f"WITH {PROSPECTIVE} SELECT * FROM rp")(prospective)
query("o10_5_rule_replay", f"WITH {RULE} SELECT * FROM rp")(rule_model)


@query("o10_4b_session_replay", f"WITH {BASE}, {session_path(11)}, {replay_sql(11, True, True)} SELECT * FROM rp")
def session_replay(spark, d):
    panel = P.kept_bars(spark, d)
    return ex.replay(ex.session_path(P.signals(panel), panel, P.sessions(panel), 11))


RECOVERY = (3, 5, 10)
FAR = f"{BASE}, {own_path(21)}, {replay_sql(21, True, True)}"


def recovery_sql(k: int) -> str:
    stopped, after = "status LIKE 'EXIT_STOP%'", f"step BETWEEN exit_step + 1 AND exit_step + {k}"
    whole = f"{stopped} AND count(b_high) FILTER ({after}) = {k}"
    return (
        f"CASE WHEN NOT {stopped} THEN NULL WHEN {whole} THEN 'COMPLETE' ELSE 'PENDING' END AS recovery_status{k}, round(CASE WHEN {whole} THEN (max(b_high) FILTER ({after}) / exit_price - 1) * 100 END, 6) AS recovery{k}_pct, "
        f"CASE WHEN {whole} THEN max(b_high) FILTER ({after}) >= entry_price END AS recovered_to_entry{k}, CASE WHEN {whole} THEN max(b_high) FILTER ({after}) >= target END AS reached_target{k}"
    )


@query(
    "o10_6_shadow_outcomes",
    f"WITH {FAR}, a AS (SELECT rp.*, d.step, d.b_high, d.target FROM rp JOIN d USING (signal_id)) SELECT signal_id, status, status LIKE 'EXIT_STOP%' AND exit_step - entry_step <= 2 AS fast_stop, {', '.join(map(recovery_sql, RECOVERY))} FROM a GROUP BY signal_id, status, entry_step, exit_step, entry_price, exit_price, target",
)
def shadow_outcomes(spark, d):
    """Outcome, fast stop, and after a stop how high the next 3, 5 and 10 bars come: whole windows only."""
    panel = P.kept_bars(spark, d)
    path = P.kept(ex.own_clock_path(P.signals(panel), P.numbered(panel), 21))
    after = ex.replay(path).join(path.select("signal_id", "target", "step", "b_high"), "signal_id")
    stopped = F.col("status").startswith("EXIT_STOP")
    windows = []
    for k in RECOVERY:
        high = F.when((F.col("step") > F.col("exit_step")) & (F.col("step") <= F.col("exit_step") + k), F.col("b_high"))
        windows += [F.count(high).alias(f"seen{k}"), F.max(high).alias(f"high{k}")]
    x = after.groupBy("signal_id", "status", "entry_step", "exit_step", "entry_price", "exit_price", "target").agg(*windows)
    out = []
    for k in RECOVERY:
        whole = stopped & (F.col(f"seen{k}") == k)
        out += [
            F.when(~stopped, F.lit(None)).when(whole, "COMPLETE").otherwise("PENDING").alias(f"recovery_status{k}"), F.round(F.when(whole, (F.col(f"high{k}") / F.col("exit_price") - 1) * 100), 6).alias(f"recovery{k}_pct"),
            F.when(whole, F.col(f"high{k}") >= F.col("entry_price")).alias(f"recovered_to_entry{k}"), F.when(whole, F.col(f"high{k}") >= F.col("target")).alias(f"reached_target{k}"),
        ]
    fast = stopped & (F.col("exit_step") - F.col("entry_step") <= 2)
    return x.select("signal_id", "status", F.coalesce(fast, F.when(~stopped, F.lit(False))).alias("fast_stop"), *out)


DELAY = "dl AS (SELECT signal_id, min(step) FILTER (b_high >= trigger) AS delay, min(step) FILTER (b_close IS NULL) AS m FROM pth GROUP BY 1), cl AS (SELECT signal_id, CASE WHEN delay IS NOT NULL AND (m IS NULL OR delay < m) THEN 'KNOWN' WHEN m IS NOT NULL THEN 'CENSORED' ELSE 'UNTRIGGERED' END AS status, CASE WHEN m IS NULL OR delay < m THEN delay END AS delay FROM dl)"
COHORT = "CASE WHEN delay = 1 THEN 'T+1' WHEN delay = 2 THEN 'T+2' WHEN delay = 3 THEN 'T+3' WHEN delay <= 5 THEN 'T+4-5' WHEN delay <= 10 THEN 'T+6-10' END"


def cohort_of(delay):
    return F.when(delay == 1, "T+1").when(delay == 2, "T+2").when(delay == 3, "T+3").when(delay <= 5, "T+4-5").when(delay <= 10, "T+6-10")


def first_triggers(spark, d, path=None):
    path = kept_path(spark, d, 10) if path is None else path
    x = path.groupBy("signal_id").agg(F.min(F.when(F.col("b_high") >= F.col("trigger"), F.col("step"))).alias("delay"), F.min(F.when(F.col("b_close").isNull(), F.col("step"))).alias("m"))
    known = F.col("m").isNull() | (F.col("delay") < F.col("m"))
    status = F.when(F.col("delay").isNotNull() & known, "KNOWN").when(F.col("m").isNotNull(), "CENSORED").otherwise("UNTRIGGERED")
    x = x.select("signal_id", status.alias("status"), F.when(known, F.col("delay")).alias("delay"))
    return x.withColumn("cohort", cohort_of(F.col("delay")))


query("o10_7_first_trigger", f"WITH {BASE}, {own_path(10)}, {DELAY} SELECT signal_id, status, delay, {COHORT} AS cohort FROM cl")(first_triggers)

@query(
    "o10_7b_session_trigger",
    f"WITH {BASE}, sc AS (SELECT * REPLACE (CASE WHEN rn % 41 = 0 THEN NULL ELSE trigger END AS trigger) FROM sig), {session_path(10, 'sc')}, w AS (SELECT signal_id, any_value(trigger) AS trigger, min(step) FILTER (b_high >= trigger) AS raw, min(step) FILTER (visible AND b_close IS NULL) AS gap, count(*) FILTER (visible) AS seen FROM pth GROUP BY 1), "
    "y AS (SELECT *, CASE WHEN trigger IS NULL THEN 'DATA_CONFLICT' WHEN raw IS NOT NULL AND (gap IS NULL OR gap > raw) THEN 'KNOWN' WHEN raw IS NOT NULL OR gap IS NOT NULL THEN 'INCOMPLETE' WHEN seen = 10 THEN 'UNTRIGGERED' ELSE 'CENSORED' END AS status FROM w), "
    f"z AS (SELECT signal_id, status, CASE WHEN status <> 'DATA_CONFLICT' THEN raw END AS raw_delay, CASE WHEN status = 'KNOWN' THEN raw END AS delay FROM y) SELECT *, CASE WHEN status = 'KNOWN' THEN {COHORT} WHEN status = 'UNTRIGGERED' THEN status ELSE 'CENSORED_OR_INCOMPLETE' END AS cohort FROM z",
)
def session_trigger(spark, d):
    """First trigger on the calendar: sessions without a bar before it leave it incomplete, sessions yet to come censored."""
    panel = P.kept_bars(spark, d)
    s = P.sessions(panel)
    x = P.signals(panel).withColumn("trigger", F.when(F.col("rn") % 41 != 0, F.col("trigger")))
    path = ex.session_path(x, panel, s, 10).crossJoin(F.broadcast(s.agg(F.max("pos").alias("reach"))))  # one row
    visible = F.col("pos") <= F.col("reach")
    w = path.groupBy("signal_id").agg(F.first("trigger").alias("trigger"), F.min(F.when(F.col("b_high") >= F.col("trigger"), F.col("step"))).alias("raw"), F.min(F.when(visible & F.col("b_close").isNull(), F.col("step"))).alias("gap"), F.count_if(visible).alias("seen"))
    raw, gap = F.col("raw"), F.col("gap")
    status = (
        F.when(F.col("trigger").isNull(), "DATA_CONFLICT").when(raw.isNotNull() & (gap.isNull() | (gap > raw)), "KNOWN").when(raw.isNotNull() | gap.isNotNull(), "INCOMPLETE")
        .when(F.col("seen") == 10, "UNTRIGGERED").otherwise("CENSORED")
    )
    y = w.withColumn("status", status).select("signal_id", "status", F.when(F.col("status") != "DATA_CONFLICT", raw).alias("raw_delay"), F.when(F.col("status") == "KNOWN", raw).alias("delay"))
    return y.withColumn("cohort", F.when(F.col("status") == "KNOWN", cohort_of(F.col("delay"))).when(F.col("status") == "UNTRIGGERED", "UNTRIGGERED").otherwise("CENSORED_OR_INCOMPLETE"))


AFTER_ENTRY = f"{PROSPECTIVE}, ae AS (SELECT rp.signal_id, h.k, CASE WHEN entry_step IS NULL THEN 'NO_ENTRY' WHEN exit_step IS NOT NULL AND exit_step <= entry_step + k THEN 'TERMINAL' WHEN q.b_close IS NULL THEN 'CENSORED' ELSE 'MARKED' END AS status, CASE WHEN exit_step <= entry_step + k THEN exit_price ELSE q.b_close END AS price, entry_price FROM rp CROSS JOIN (VALUES (1::BIGINT), (3), (5)) AS h(k) LEFT JOIN d q ON q.signal_id = rp.signal_id AND q.step = rp.entry_step + h.k)"


@query("o10_8_horizons_after_entry", f"WITH {AFTER_ENTRY} SELECT signal_id, k AS horizon, status, CASE WHEN status IN ('TERMINAL', 'MARKED') THEN round((price / entry_price - 1) * 100, 6) END AS return_pct FROM ae")
def horizons_after_entry(spark, d, rounded=True, path=None):
    path = kept_path(spark, d, 11) if path is None else path
    r = ex.replay(path).withColumn("horizon", F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 3, 5)])))
    marks = path.select(F.col("signal_id").alias("sid"), F.col("step").alias("at"), "b_close")
    x = r.join(marks, (F.col("signal_id") == F.col("sid")) & (F.col("at") == F.col("entry_step") + F.col("horizon")), "left")
    ended = F.col("exit_step") <= F.col("entry_step") + F.col("horizon")
    status = F.when(F.col("entry_step").isNull(), "NO_ENTRY").when(ended, "TERMINAL").when(F.col("b_close").isNull(), "CENSORED").otherwise("MARKED")
    price = F.when(ended, F.col("exit_price")).otherwise(F.col("b_close"))
    x = x.withColumn("status", status)
    gain = (price / F.col("entry_price") - 1) * 100
    return x.select("signal_id", "horizon", "status", F.when(F.col("status").isin("TERMINAL", "MARKED"), F.round(gain, 6) if rounded else gain).alias("return_pct"))


@query(
    "o10_9_review_points",
    f"WITH {BASE}, {P.SESSIONS}, x AS (SELECT s.signal_id, s.symbol, h.k AS horizon, c2.date AS due FROM sig s JOIN sessions c ON c.date = s.signal_date CROSS JOIN (VALUES (3::BIGINT), (5), (10)) AS h(k) LEFT JOIN sessions c2 ON c2.pos = c.pos + h.k) "
    "SELECT signal_id, horizon, due AS due_date, CASE WHEN due IS NULL THEN 'NOT_DUE' WHEN b.close IS NULL THEN 'MISSED' ELSE 'CAPTURED' END AS status, round(b.close, 6) AS price FROM x LEFT JOIN bars b ON b.symbol = x.symbol AND b.date = x.due",
)
def review_points(spark, d):
    panel = P.kept_bars(spark, d)
    s = P.sessions(panel)
    x = P.signals(panel).join(F.broadcast(s.select(F.col("date").alias("signal_date"), "pos")), "signal_date").withColumn("horizon", F.explode(F.array(*[F.lit(k).cast("long") for k in (3, 5, 10)])))
    x = x.join(F.broadcast(s.select(F.col("pos").alias("due_pos"), F.col("date").alias("due_date"))), F.col("pos") + F.col("horizon") == F.col("due_pos"), "left").select("signal_id", "symbol", "horizon", "due_date")
    x = x.join(panel.select("symbol", F.col("date").alias("due_date"), F.col("close").alias("price")), ["symbol", "due_date"], "left")
    status = F.when(F.col("due_date").isNull(), "NOT_DUE").when(F.col("price").isNull(), "MISSED").otherwise("CAPTURED")
    return x.select("signal_id", "horizon", "due_date", status.alias("status"), F.round("price", 6).alias("price"))


@query(
    "o10_13_event_log",
    f"WITH {BASE}, l AS (SELECT symbol, sha256(signal_id || '|' || CAST(CAST(round(trigger * 10000) AS BIGINT) AS VARCHAR)) AS event_hash, signal_date FROM sig UNION ALL SELECT symbol, sha256(signal_id || '|' || CAST(CAST(round(trigger * 10000) AS BIGINT) AS VARCHAR)), signal_date FROM sig WHERE close > 10.9) "
    "SELECT event_hash, any_value(symbol) AS symbol, min(signal_date) AS signal_date, count(*) AS appended FROM l GROUP BY 1",
)
def event_log(spark, d):
    s = P.signals(P.bars(spark, d))
    key = F.sha2(F.concat_ws("|", "signal_id", F.round(F.col("trigger") * 10000).cast("long").cast("string")), 256)
    log = s.select("symbol", key.alias("event_hash"), "signal_date", "close")
    again = log.unionByName(log.where("close > 10.9"))  # appended a second time: the same event
    return again.groupBy("event_hash").agg(F.first("symbol").alias("symbol"), F.min("signal_date").alias("signal_date"), F.count(F.lit(1)).alias("appended"))


@query(
    "o10_14_exact_date_recovery",
    f"WITH {BASE}, {P.SESSIONS}, x AS (SELECT s.signal_id, s.symbol, c2.date AS due FROM sig s JOIN sessions c ON c.date = s.signal_date JOIN sessions c2 ON c2.pos = c.pos + 3), m AS (SELECT x.* FROM x LEFT JOIN bars b ON b.symbol = x.symbol AND b.date = x.due WHERE b.close IS NULL) "
    "SELECT signal_id, due AS due_date, CASE WHEN i.close IS NOT NULL THEN 'RECOVERABLE_FROM_INDEX' ELSE 'UNRECOVERABLE' END AS status FROM m LEFT JOIN (SELECT date, avg(close) AS close FROM bars WHERE symbol LIKE '60%' GROUP BY 1) i ON i.date = m.due",
)
def exact_date_recovery(spark, d):
    panel = P.kept_bars(spark, d)
    missed = review_points(spark, d).where("horizon = 3 AND status = 'MISSED'").select("signal_id", "due_date")
    evidence = panel.where("symbol LIKE '60%'").groupBy(F.col("date").alias("due_date")).agg(F.avg("close").alias("seen"))
    x = missed.join(evidence, "due_date", "left")
    return x.select("signal_id", "due_date", F.when(F.col("seen").isNotNull(), "RECOVERABLE_FROM_INDEX").otherwise("UNRECOVERABLE").alias("status"))
