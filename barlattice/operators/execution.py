"""Forward outcomes and execution replays, as set operations over the bars after each signal.

A path is one row per (signal, step) with the bar of that step or nulls where it is missing. Entry and
exit are the smallest steps that meet their conditions, so a replay is a window and a grouped aggregate over the
steps of a signal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HORIZONS = (1, 3, 5, 10)


def own_clock_path(signals: DataFrame, numbered: DataFrame, steps: int) -> DataFrame:
    """Steps on each symbol's own bars; a step past the end of its history is missing."""
    b = numbered.select("symbol", "rn", *[F.col(c).alias(f"b_{c}") for c in ("date", "open", "high", "low", "close")])
    s = signals.withColumnRenamed("rn", "s_rn").withColumn("rn", F.explode(F.sequence(F.col("s_rn") + 1, F.col("s_rn") + steps)))
    return s.join(b, ["symbol", "rn"], "left").withColumn("step", (F.col("rn") - F.col("s_rn")).cast("long"))


def session_path(signals: DataFrame, panel: DataFrame, sessions: DataFrame, steps: int) -> DataFrame:
    """Steps on the calendar: the bar of each of the next sessions, where the symbol traded then.

    ``sessions`` has one row per session, a small dimension; the bars join by (symbol, pos).
    """
    s = signals.join(sessions.select(F.col("date").alias("signal_date"), F.col("pos").alias("s_pos")), "signal_date")
    s = s.withColumn("pos", F.explode(F.sequence(F.col("s_pos") + 1, F.col("s_pos") + steps)))
    b = panel.join(sessions, "date").select("symbol", "pos", *[F.col(c).alias(f"b_{c}") for c in ("date", "open", "high", "low", "close")])
    return s.join(b, ["symbol", "pos"], "left").withColumn("step", (F.col("pos") - F.col("s_pos")).cast("long"))


def fixed_outcomes(path: DataFrame, last_pos: Column | None, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """signal_id, horizon, status, return_pct, mfe_pct, mae_pct, observed: one row per signal and horizon.

    Statuses: SYMBOL_NOT_IN_RAW_STORE (where the path has a false ``in_store``), NO_T_PLUS_1_OPEN, INSUFFICIENT_FORWARD_COVERAGE, INCOMPLETE_STOCK_WINDOW, AVAILABLE.
    """
    x = path.withColumn("horizon", F.explode(F.array(*[F.lit(h).cast("long") for h in horizons]))).where("step <= horizon")
    grouped = x.groupBy("signal_id", "horizon").agg(
        F.count("b_close").alias("observed"), F.max(F.when(F.col("step") == 1, F.col("b_open"))).alias("entry"), F.max(F.when(F.col("step") == F.col("horizon"), F.col("b_close"))).alias("exit"),
        F.max("b_high").alias("hi"), F.min("b_low").alias("lo"), F.max(F.col("step") if last_pos is None else last_pos).alias("far"), F.max("reach").alias("reach") if "reach" in x.columns else F.lit(None).cast("long").alias("reach"),
        F.max("in_store").alias("in_store") if "in_store" in x.columns else F.lit(True).alias("in_store"),
    )
    status = (
        F.when(~F.col("in_store"), "SYMBOL_NOT_IN_RAW_STORE").when(F.col("reach").isNotNull() & (F.col("far") > F.col("reach")), "INSUFFICIENT_FORWARD_COVERAGE").when(F.col("entry").isNull(), "NO_T_PLUS_1_OPEN").when(F.col("observed") < F.col("horizon"), "INCOMPLETE_STOCK_WINDOW").otherwise("AVAILABLE")
    )
    out = grouped.withColumn("status", status)

    def part(x: str) -> Column:
        return F.round(F.when(F.col("status") == "AVAILABLE", (F.col(x) / F.col("entry") - 1) * 100), 6)

    return out.select("signal_id", "horizon", "status", part("exit").alias("return_pct"), part("hi").alias("mfe_pct"), part("lo").alias("mae_pct"), "observed")


def classify_bar(path: DataFrame) -> DataFrame:
    """What one bar alone does to a waiting signal; both stop and target in one bar is ambiguous."""
    hit_t, hit_s, hit_e = F.col("b_high") >= F.col("trigger"), F.col("b_low") <= F.col("stop"), F.col("b_high") >= F.col("target")
    state = F.when(F.col("b_close").isNull(), "MISSING").when(~hit_t, "PENDING").when(hit_s & hit_e, "AMBIGUOUS").when(hit_s, "TRIGGERED_STOP_TOUCHED").when(hit_e, "TRIGGERED_TARGET_TOUCHED").otherwise("TRIGGERED")
    return path.withColumn("state", state)


def fill_price() -> Column:
    """At the open where the bar gaps over the trigger, at the trigger where it trades through, else none."""
    return F.when(F.col("b_open") >= F.col("trigger"), F.col("b_open")).when(F.col("b_high") >= F.col("trigger"), F.col("trigger"))


def exit_decision() -> tuple[Column, Column]:
    """(kind, price) on a bar where the position may be sold: gaps at the open come first; both touched is ambiguous."""
    o, h, l = F.col("b_open"), F.col("b_high"), F.col("b_low")
    stop, target = F.col("stop"), F.col("target")
    kind = F.when(o <= stop, "STOP_GAP").when(o >= target, "TARGET_GAP").when((l <= stop) & (h >= target), "AMBIGUOUS").when(l <= stop, "STOP").when(h >= target, "TARGET")
    price = F.when(o <= stop, o).when(o >= target, o).when((l <= stop) & (h >= target), F.lit(None)).when(l <= stop, stop).when(h >= target, target)
    return kind, price


def replay(path: DataFrame, horizon: int = 10, gap_fills: bool = True, time_exit: bool = True) -> DataFrame:
    """The prospective next-session-sale model over ``path`` with ``horizon`` + 1 steps.

    m is the first missing step, e the first fill before it, x the first exit decision after e and
    before m. Without x by the horizon the position is closed: at the horizon's close, or at the next
    open if it was entered on the horizon. A missing step before the end leaves the signal UNVERIFIED.
    With ``gap_fills`` false fills and exits are at the rule's prices exactly.
    """
    kind, price = exit_decision()
    if not gap_fills:
        l, h = F.col("b_low") <= F.col("stop"), F.col("b_high") >= F.col("target")
        kind = F.when(l & h, "AMBIGUOUS").when(l, "STOP").when(h, "TARGET")
        price = F.when(l & h, F.lit(None)).when(l, F.col("stop")).when(h, F.col("target"))
    fill = fill_price() if gap_fills else F.when(F.col("b_high") >= F.col("trigger"), F.col("trigger"))
    p = path.withColumn("fill", fill).withColumn("kind", kind).withColumn("price", price)
    # Windows over the signal instead of groups joined back: its steps are made and exchanged once.
    w = Window.partitionBy("signal_id")
    filled = F.when(F.col("fill").isNotNull() & (F.col("step") <= horizon), F.col("step"))
    q = p.select("*", F.min(F.when(F.col("b_close").isNull(), F.col("step"))).over(w).alias("m"), F.min(filled).over(w).alias("e0"), F.min_by("fill", filled).over(w).alias("fill0")).drop("fill")
    q = q.withColumn("e", F.when(F.col("m").isNull() | (F.col("e0") < F.col("m")), F.col("e0"))).withColumn("entry_price", F.when(F.col("e").isNotNull(), F.col("fill0")))
    alive = (F.col("step") > F.col("e")) & (F.col("m").isNull() | (F.col("step") < F.col("m")))
    decided = F.when(alive & F.col("kind").isNotNull() & (F.col("step") <= (horizon if time_exit else 10**9)), F.col("step"))
    last = F.when(F.col("e") == horizon, horizon + 1).otherwise(horizon)
    timed = F.when(F.col("step") == last, F.when(F.col("e") == horizon, F.col("b_open")).otherwise(F.col("b_close")))
    out = q.groupBy("signal_id", "m", "e", "entry_price").agg(F.min(decided).alias("x"), F.min_by("kind", decided).alias("x_kind"), F.min_by("price", decided).alias("x_price"), F.max(timed).alias("t_price"))
    seen_all = F.col("m").isNull() | (F.col("m") > F.when(F.col("e") == horizon, horizon + 1).otherwise(horizon))
    status = (
        F.when(F.col("e").isNull() & F.col("m").isNotNull() & (F.col("m") <= horizon), "UNVERIFIED").when(F.col("e").isNull(), "NOT_TRIGGERED").when(F.col("x").isNotNull(), F.concat(F.lit("EXIT_"), F.col("x_kind")))
        .when(F.lit(time_exit) & seen_all, "EXIT_TIME").when(F.lit(time_exit), "UNVERIFIED").otherwise("OPEN")
    )
    exit_price = F.when(F.col("x").isNotNull(), F.col("x_price")).when(F.lit(time_exit) & seen_all, F.col("t_price"))
    out = out.withColumn("status", status).withColumn("exit_price", F.when(F.col("e").isNotNull(), exit_price))
    exit_step = F.when(F.col("x").isNotNull(), F.col("x")).when(F.col("status") == "EXIT_TIME", F.when(F.col("e") == horizon, F.lit(horizon + 1)).otherwise(F.lit(horizon)))
    return out.select("signal_id", "status", F.col("e").alias("entry_step"), F.round("entry_price", 6).alias("entry_price"), exit_step.cast("long").alias("exit_step"), F.round("exit_price", 6).alias("exit_price"), F.round((F.col("exit_price") / F.col("entry_price") - 1) * 100, 6).alias("return_pct"))
