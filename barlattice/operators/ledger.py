"""Append-only records, closed-world documents and point-in-time evidence: outcomes as columns, nothing raised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

APPENDED, IDEMPOTENT, CONFLICT, SAME_EPISODE = "APPENDED", "IDEMPOTENT", "CONFLICT", "DUPLICATE_EPISODE"

# The keys that a watchlist document and a candidate may and must have.
TOP_KEYS = ["date", "mode", "strategy_version", "universe_policy", "market_env", "sectors", "input_coverage", "candidates"]
TOP_REQUIRED = ["date", "mode", "market_env", "sectors", "candidates"]
CANDIDATE_REQUIRED = ["code", "name", "buy_type", "score", "price", "trigger", "stop", "target", "rr"]
CANDIDATE_KEYS = [*CANDIDATE_REQUIRED, "sector", "chg", "support", "stop_dist", "vol_ratio", "turnover", "float_mv", "target_type", "risk", "setup", "strategy_version", "signal_id"]
ADJUSTMENTS = ["RAW_UNADJUSTED", "HISTORICAL_ADJUSTED_AS_OF", "HISTORICAL_QFQ_AS_OF"]


def append(store: DataFrame, incoming: DataFrame, key: str, episode: str, digest: str) -> DataFrame:
    """What becomes of each incoming event: (key, digest, outcome).

    A known key with the same digest changes nothing, with another it is a conflict; a new key whose
    episode is in the store under another key is a duplicate. ``store`` has each key once. Rows of the
    incoming batch with one key are taken once if equal, else all are conflicts.
    """
    batch = incoming.groupBy(key).agg(F.min(digest).alias("__low"), F.max(digest).alias("__high"), F.min(episode).alias("__episode"))
    known = store.select(F.col(key).alias("__key"), F.col(digest).alias("__known"))
    episodes = store.select(F.col(episode).alias("__e")).distinct()
    x = batch.join(known, F.col(key) == F.col("__key"), "left").join(episodes, F.col("__episode") == F.col("__e"), "left")
    outcome = (
        F.when(F.col("__low") != F.col("__high"), CONFLICT).when(F.col("__known") == F.col("__low"), IDEMPOTENT).when(F.col("__known").isNotNull(), CONFLICT)
        .when(F.col("__e").isNotNull(), SAME_EPISODE).otherwise(APPENDED)
    )
    return x.select(key, F.col("__low").alias(digest), outcome.alias("outcome"))


def keys_of(json: Column) -> Column:
    """The names of a JSON object's fields."""
    return F.json_object_keys(json)


def closed_world(docs: DataFrame) -> DataFrame:
    """(date, status) of documents (date, payload): unknown, missing and legacy keys, bad candidates, coverage that does not add up.

    The first failing check names the status.
    """
    x = docs.withColumn("keys", keys_of(F.col("payload"))).withColumn("items", F.from_json(F.get_json_object("payload", "$.candidates"), "array<string>"))
    coverage = F.from_json(F.get_json_object("payload", "$.input_coverage"), "expected_symbol_count long, evaluated_symbol_count long, excluded_symbol_count long, target_date string")
    x = x.withColumn("cover", coverage).withColumn("ids", F.transform("items", lambda c: F.get_json_object(c, "$.signal_id")))

    def lacks(c):
        return F.size(F.array_except(F.array(*map(F.lit, CANDIDATE_REQUIRED)), keys_of(c))) > 0

    def positive(c):
        return F.forall(F.array(*[F.get_json_object(c, f"$.{n}").try_cast("double") for n in ("price", "trigger", "stop", "target", "rr")]), lambda v: F.coalesce(v > 0, F.lit(False)))

    checks = [
        ("LEGACY_ITEMS", F.array_contains("keys", "items")),
        ("UNKNOWN_TOP_LEVEL_KEY", F.size(F.array_except("keys", F.array(*map(F.lit, TOP_KEYS)))) > 0),
        ("MISSING_TOP_LEVEL_KEY", F.size(F.array_except(F.array(*map(F.lit, TOP_REQUIRED)), F.col("keys"))) > 0),
        ("COVERAGE_DATE_MISMATCH", F.col("cover.target_date") != F.get_json_object("payload", "$.date")),
        ("COVERAGE_NOT_RECONCILED", F.col("cover.evaluated_symbol_count") + F.col("cover.excluded_symbol_count") != F.col("cover.expected_symbol_count")),
        ("LEGACY_TRIG", F.exists("items", lambda c: F.array_contains(keys_of(c), "trig"))),
        ("CANDIDATE_MISSING_KEY", F.exists("items", lacks)),
        ("CANDIDATE_UNKNOWN_KEY", F.exists("items", lambda c: F.size(F.array_except(keys_of(c), F.array(*map(F.lit, CANDIDATE_KEYS)))) > 0)),
        ("CANDIDATE_BAD_CODE", F.exists("items", lambda c: ~F.coalesce(F.get_json_object(c, "$.code").rlike(r"^\d{6}$"), F.lit(False)))),
        ("CANDIDATE_NOT_POSITIVE", F.exists("items", lambda c: ~positive(c))),
        ("DUPLICATE_SIGNAL_ID", F.size(F.array_distinct("ids")) < F.size("ids")),
    ]
    status = F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in checks], F.lit("VALID"))
    return x.select("date", F.size("items").cast("long").alias("n_candidates"), status.alias("status"))


def evidence_status(evidence: DataFrame, key: str, on: str) -> DataFrame:
    """(key, status): a signal needs evidence of its universe, sector and bars that was known by its date.

    ``evidence`` has the signal's date in ``on`` and, per kind, as_of, known_at, source_version, sha256,
    and for bars the adjustment and whether separate evidence of the factors is there. The worst of a
    signal's problems, in the order of the checks, is its status.
    """
    bars, kind = F.col("kind") == "ohlcv", F.col("kind")
    problems = [
        ("MISSING_POINT_IN_TIME_EVIDENCE", F.col("source_version").isNull() | F.col("as_of").isNull() | F.col("known_at").isNull() | ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))),
        ("AS_OF_DATE_MISMATCH", F.col("as_of") != F.col(on)), ("KNOWN_AFTER_SIGNAL_DATE", F.col("known_at") > F.col(on)),
        ("UNSUPPORTED_ADJUSTMENT_SEMANTICS", bars & ~F.coalesce(F.col("adjustment").isin(*ADJUSTMENTS), F.lit(False))),
        ("MISSING_ADJUSTMENT_EVIDENCE", bars & (F.col("adjustment") != "RAW_UNADJUSTED") & ~F.col("factors")),
    ]
    place = F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(i)) for i, (_, bad) in enumerate(problems)], F.lit(len(problems)))
    g = evidence.groupBy(key).agg(F.min(place).alias("__worst"), F.count_distinct(kind).alias("__kinds"))
    names = F.array(*[F.lit(n) for n, _ in problems], F.lit("POINT_IN_TIME_OK"))
    return g.select(key, F.when(F.col("__kinds") < 3, problems[0][0]).otherwise(F.element_at(names, F.col("__worst") + 1)).alias("status"))


def recover(missed: DataFrame, evidence: DataFrame) -> DataFrame:
    """(signal_id, due_date, status, price): a missed review is filled only by intact evidence of just that date.

    ``evidence`` (symbol, captured date, price, sha256 and the digest that its bytes have) may hold other
    dates; ``missed`` has symbol, due_date and the price basis known from the signal. A price more than
    ``basis`` away from what was known is of another basis and not used.
    """
    e = evidence.select(F.col("symbol").alias("__s"), "captured", F.col("price").alias("__p"), (F.col("sha256") == F.col("digest")).alias("__intact"), F.col("named").alias("__named"))
    x = missed.join(e, (F.col("symbol") == F.col("__s")) & (F.col("due_date") == F.col("__named")), "left")
    far = F.abs(F.col("__p") / F.col("known") - 1) > F.col("basis")
    status = (
        F.when(F.col("__s").isNull(), "NO_EVIDENCE").when(~F.col("__intact"), "EVIDENCE_INTEGRITY_FAILED").when(F.col("captured") != F.col("due_date"), "NOT_CAPTURED_ON_DATE")
        .when(far, "PRICE_BASIS_INCOMPATIBLE").otherwise("RECOVERED")
    )
    return x.withColumn("status", status).select("signal_id", "due_date", "status", F.when(F.col("status") == "RECOVERED", F.round("__p", 6)).alias("price"))


def backfill(locked: DataFrame, panel: DataFrame, observed: DataFrame, values: dict[str, str], tolerance: float = 1e-9) -> DataFrame:
    """Every locked row (signal_id, symbol, date, locked_close) with its observation, or why it has none; no row is lost or added.

    ``observed`` has symbol, date and, for each value, the value and its reason (``values``: name -> reason's name). A row
    whose bar is missing, or has another close than was locked, gets no values, whatever was observed; a single value that
    cannot be told keeps its own reason and leaves the others.
    """
    bar = panel.select("symbol", "date", F.col("close").alias("__close"))
    x = locked.join(bar, ["symbol", "date"], "left").join(observed.withColumn("__seen", F.lit(True)), ["symbol", "date"], "left")
    same = F.abs(F.col("__close") - F.col("locked_close")) <= tolerance
    status = F.when(F.col("__close").isNull(), "BAR_MISSING").when(~F.coalesce(same, F.lit(False)), "IDENTITY_MISMATCH").when(F.col("__seen").isNull(), "NO_OBSERVATION")
    reasons = F.lit(False)
    for reason in values.values():
        reasons = reasons | F.col(reason).isNotNull()
    x = x.withColumn("status", F.coalesce(status, F.when(reasons, "PARTIAL").otherwise("COMPLETE")))
    usable = F.col("status").isin("PARTIAL", "COMPLETE")
    return x.select("signal_id", "status", *[F.when(usable, F.col(c)).alias(c) for pair in values.items() for c in pair])
