"""Price adjustment for corporate actions, as known on an anchor date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")


def with_events(panel: DataFrame, events: DataFrame) -> DataFrame:
    """Adds ``events``: the symbol's corporate actions, ascending by ex-date, as one short array."""
    listed = events.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("ex_date", "dividend", "bonus", "allotment", "allotment_price"))).alias("events"))
    empty = F.array().cast(listed.schema["events"].dataType)
    return panel.join(listed, "symbol", "left").withColumn("events", F.coalesce("events", empty))


def adjusted(price: Column, date: Column, anchor: Column, events: Column) -> Column:
    """``price`` of a bar of ``date`` with every action after it and up to ``anchor`` applied in order."""
    due = F.filter(events, lambda e: (e["ex_date"] > date) & (e["ex_date"] <= anchor))
    return F.aggregate(due, price, lambda p, e: (p - e["dividend"] + e["allotment_price"] * e["allotment"]) / (1 + e["bonus"] + e["allotment"]))


def anchor_adjusted(panel: DataFrame, events: DataFrame, anchor: Column) -> DataFrame:
    """The panel up to ``anchor`` with prices as seen on it; volume stays as it was."""
    base = with_events(panel.where(F.col("date") <= anchor), events)
    return base.select("symbol", "date", *[adjusted(F.col(p), F.col("date"), anchor, F.col("events")).alias(p) for p in PRICES], "volume")


def event_states(events: DataFrame) -> DataFrame:
    """symbol, k, from_date, to_date: between two ex-dates the adjusted history does not change."""
    w = Window.partitionBy("symbol").orderBy("ex_date")
    first = events.select("symbol").distinct().select("symbol", F.lit(0).cast("long").alias("k"), F.lit("1900-01-01").cast("date").alias("from_date"))
    later = events.select("symbol", F.row_number().over(w).cast("long").alias("k"), F.col("ex_date").alias("from_date"))
    return first.union(later).withColumn("to_date", F.lead("from_date").over(Window.partitionBy("symbol").orderBy("k")))


def state_history(panel: DataFrame, events: DataFrame, lookback: int = 260) -> DataFrame:
    """Adjusted bars per (symbol, state k) that signals of the state can see: its own and ``lookback`` before it.

    Windows over (symbol, k) then serve every signal date of a state at once.
    """
    states = event_states(events)
    rn = Window.partitionBy("symbol").orderBy("date")
    base = with_events(panel.withColumn("rn", F.row_number().over(rn)), events)
    starts = base.join(states, "symbol").where((F.col("date") >= F.col("from_date")) & (F.col("to_date").isNull() | (F.col("date") < F.col("to_date"))))
    bounds = starts.groupBy("symbol", "k").agg(F.min("rn").alias("from_rn"), F.max("rn").alias("to_rn"), F.max("from_date").alias("anchor"))
    seen = base.join(bounds, "symbol").where((F.col("rn") > F.col("from_rn") - lookback) & (F.col("rn") <= F.col("to_rn")))
    return seen.select("symbol", "k", "date", "rn", (F.col("rn") >= F.col("from_rn")).alias("is_signal"), *[adjusted(F.col(p), F.col("date"), F.col("anchor"), F.col("events")).alias(p) for p in PRICES], "volume")
