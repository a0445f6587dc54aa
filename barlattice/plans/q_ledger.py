"""Queries for sinks that are read again (o1), the event store (o10.13), recovery (o10.14) and evidence (o13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlattice.operators import ledger as lg
from barlattice.sources import files
from barlattice.sources import panel as P

from .q_execution import OUTCOME, own_path
from .q_statistics import signal_levels
from .q_patterns import LEVELS_WITH
from .registry import query

B = P.BARS
BASE = f"{B}, {P.NUMBERED}, {P.SIGNALS}"

# Sinks and their re-read ---------------------------------------------------------------------------

TABLES = ("customer", "lineitem", "orders", "supplier")


@query("o1_6b_resolved_tables", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows FROM {t}" for t in TABLES))
def resolved_tables(spark, d):
    """Each table found through the resolver and read; another root in the environment would take precedence."""
    paths = files.TablePaths.resolve({}, d)
    parts = [spark.read.parquet(paths.table(t)).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("name"), "n_rows") for t in TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "o1_7b_jsonl_round_trip",
    f"WITH {B}, l AS (SELECT symbol, symbol || '|' || CAST(date AS VARCHAR) || '|' || CAST(CAST(round(close * 10000) AS BIGINT) AS VARCHAR) AS line FROM bars) SELECT symbol, count(*) AS n_lines, sha256(string_agg(line, chr(10) ORDER BY line)) AS content_sha256 FROM l GROUP BY 1",
)
def jsonl_round_trip(spark, d):
    """Compressed JSON lines written, read again and hashed: what comes back has the hash of what went in."""
    rows = P.bars(spark, d).select("symbol", F.col("date").cast("string").alias("date"), F.round(F.col("close") * 10000).cast("long").alias("close"))
    path = files.scratch(spark, "jsonl")
    files.write_lines(rows, path)
    back = spark.read.schema("symbol string, date string, close long").json(path)
    return files.content_hash(back.select("symbol", F.concat_ws("|", "symbol", "date", F.col("close").cast("string")).alias("line")), ["symbol"])


@query(
    "o1_8b_canonical_parquet",
    "WITH k AS (SELECT l_orderkey, l_linenumber, min((l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS a, count(DISTINCT (l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS n FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, l_linenumber, a[1] AS l_partkey, a[2] AS l_suppkey, a[3] AS l_quantity, a[4] AS l_extendedprice FROM k WHERE n = 1",
)
def canonical_parquet(spark, d):
    """Payload rows without repeats and conflicts, as sorted zstd parquet, read again."""
    values = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    g = P.read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct(*values)).alias("a"), F.max(F.struct(*values)).alias("z"))
    path = files.scratch(spark, "canonical")
    files.write_canonical(g.where("a = z").select("l_orderkey", "l_linenumber", "a.*"), path, ["l_orderkey", "l_linenumber"])
    return spark.read.parquet(path)


@query(
    "o1_11b_merged_parts",
    f"WITH {B}, {P.NUMBERED} SELECT year(date) AS y, count(*) AS n_rows, count(*) FILTER (rn >= 120) AS n_evaluable, min(date) AS first_date, max(date) AS last_date FROM nb GROUP BY 1",
)
def merged_parts(spark, d):
    """Results written in two parts by date, merged, and summarised from what is read again."""
    n = P.kept(P.numbered(P.bars(spark, d)).select("symbol", "date", "rn", F.year("date").alias("y")))
    parts = [files.scratch(spark, f"part{i}") for i in (0, 1)]
    for i, path in enumerate(parts):
        files.write_by_date(n.where(F.col("y") % 2 == i), path, "y")
    merged = files.scratch(spark, "merged")
    files.merge_parts(spark, parts, merged, ["symbol", "date"], "y")
    back = spark.read.parquet(merged)
    return back.groupBy(F.col("y").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("rn") >= 120).alias("n_evaluable"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("o1_12b_csv_round_trip", f"WITH {BASE} SELECT signal_id, symbol, signal_date, CAST(round(trigger * 10000) AS BIGINT) AS trigger FROM sig")
def csv_round_trip(spark, d):
    """A CSV with a header and a fixed field list, read again by that header."""
    fields = ["signal_id", "symbol", "signal_date", "trigger"]
    s = P.signals(P.bars(spark, d)).withColumn("trigger", F.round(F.col("trigger") * 10000).cast("long"))
    path = files.scratch(spark, "csv")
    files.write_csv(s, path, fields)
    return spark.read.option("header", True).option("enforceSchema", False).schema("signal_id string, symbol string, signal_date date, trigger long").csv(path)


# The event store and recovery ----------------------------------------------------------------------

EVENT = "SELECT signal_id, symbol || ':' || CAST(rn // 15 AS VARCHAR) AS episode, sha256(signal_id || '|' || CAST(CAST(round({0} * 10000) AS BIGINT) AS VARCHAR)) AS digest FROM sig"


def events_of(s, trigger=None):
    digest = F.sha2(F.concat_ws("|", "signal_id", F.round((F.col("trigger") if trigger is None else trigger) * 10000).cast("long").cast("string")), 256)
    return s.select("signal_id", F.concat_ws(":", "symbol", F.floor(F.col("rn") / 15).cast("string")).alias("episode"), digest.alias("digest"))


@query(
    "o10_13b_append_outcomes",
    f"WITH {BASE}, st AS ({EVENT.format('trigger')} WHERE rn % 3 = 0), inc AS ({EVENT.format('(trigger + CASE WHEN rn % 7 = 0 THEN 1 ELSE 0 END)')} UNION ALL {EVENT.format('trigger')} WHERE rn % 5 = 0), g AS (SELECT signal_id, min(digest) AS lo, max(digest) AS hi, min(episode) AS episode FROM inc GROUP BY 1) "
    "SELECT g.signal_id, lo AS digest, CASE WHEN lo <> hi THEN 'CONFLICT' WHEN st.digest = lo THEN 'IDEMPOTENT' WHEN st.digest IS NOT NULL THEN 'CONFLICT' WHEN g.episode IN (SELECT episode FROM st) THEN 'DUPLICATE_EPISODE' ELSE 'APPENDED' END AS outcome FROM g LEFT JOIN st USING (signal_id)",
)
def append_outcomes(spark, d):
    """A third of the signals is stored; all come again, some changed, some twice."""
    s = P.kept(P.signals(P.bars(spark, d)).select("signal_id", "symbol", "rn", "trigger"))
    changed = events_of(s, F.col("trigger") + F.when(F.col("rn") % 7 == 0, 1).otherwise(0))
    return lg.append(events_of(s.where("rn % 3 = 0")), changed.unionByName(events_of(s.where("rn % 5 = 0"))), "signal_id", "episode", "digest")


DUE = "du AS (SELECT s.signal_id, s.symbol, s.close AS known, c2.date AS due, c2.pos AS pos, s.rn FROM sig s JOIN sessions c ON c.date = s.signal_date JOIN sessions c2 ON c2.pos = c.pos + 3)"


@query(
    "o10_14b_evidence_recovery",
    f"WITH {BASE}, {P.SESSIONS}, {DUE}, e AS (SELECT symbol, date AS named, date + CAST(CASE WHEN rn % 13 = 0 THEN 1 ELSE 0 END AS INTEGER) AS captured, close * CASE WHEN rn % 17 = 0 THEN 2 ELSE 1 END AS price, rn % 11 <> 0 AS intact FROM nb WHERE rn % 4 <> 0), x AS (SELECT du.*, e.*  EXCLUDE (symbol) FROM du LEFT JOIN e ON e.symbol = du.symbol AND e.named = du.due WHERE du.rn % 2 = 0), "
    "y AS (SELECT *, CASE WHEN named IS NULL THEN 'NO_EVIDENCE' WHEN NOT intact THEN 'EVIDENCE_INTEGRITY_FAILED' WHEN captured <> due THEN 'NOT_CAPTURED_ON_DATE' WHEN abs(price / known - 1) > 0.3 THEN 'PRICE_BASIS_INCOMPATIBLE' ELSE 'RECOVERED' END AS status FROM x) SELECT signal_id, due AS due_date, status, CASE WHEN status = 'RECOVERED' THEN round(price, 6) END AS price FROM y",
)
def evidence_recovery(spark, d):
    """Half of the reviews after three sessions were missed; the evidence of a date may be absent, damaged, late or of another price basis."""
    panel = P.kept_bars(spark, d)
    s, n = P.sessions(panel), P.numbered(panel)
    due = P.signals(panel).where("rn % 2 = 0").join(s.select(F.col("date").alias("signal_date"), "pos"), "signal_date")
    due = due.join(s.select((F.col("pos") - 3).alias("pos"), F.col("date").alias("due_date")), "pos")
    missed = due.select("signal_id", "symbol", "due_date", F.col("close").alias("known"), F.lit(0.3).alias("basis"))
    price = F.col("close") * F.when(F.col("rn") % 17 == 0, 2).otherwise(1)
    digest = F.sha2(F.concat_ws("|", "symbol", F.col("date").cast("string"), price.cast("string")), 256)
    evidence = n.where("rn % 4 <> 0").select(
        "symbol", F.col("date").alias("named"), F.date_add("date", F.when(F.col("rn") % 13 == 0, 1).otherwise(0)).alias("captured"), price.alias("price"),
        digest.alias("digest"), F.when(F.col("rn") % 11 == 0, F.sha2(digest, 256)).otherwise(digest).alias("sha256"),
    )
    return lg.recover(missed, evidence)


# Integrity -----------------------------------------------------------------------------------------


@query(
    "o13_1b_closed_world",
    f"WITH {BASE}, g AS (SELECT signal_date AS date, dayofyear(signal_date) AS k, count(*) AS n FROM sig GROUP BY 1) SELECT date, n AS n_candidates, CASE WHEN k % 7 = 0 THEN 'LEGACY_ITEMS' WHEN k % 11 = 0 THEN 'UNKNOWN_TOP_LEVEL_KEY' WHEN k % 13 = 0 THEN 'MISSING_TOP_LEVEL_KEY' WHEN k % 17 = 0 THEN 'COVERAGE_DATE_MISMATCH' WHEN k % 19 = 0 THEN 'COVERAGE_NOT_RECONCILED' WHEN k % 5 = 1 THEN 'LEGACY_TRIG' WHEN k % 5 = 2 THEN 'CANDIDATE_MISSING_KEY' WHEN k % 23 = 0 THEN 'CANDIDATE_UNKNOWN_KEY' WHEN k % 29 = 0 THEN 'CANDIDATE_BAD_CODE' WHEN k % 31 = 0 THEN 'CANDIDATE_NOT_POSITIVE' WHEN k % 5 = 3 AND n > 1 THEN 'DUPLICATE_SIGNAL_ID' ELSE 'VALID' END AS status FROM g",
)
def closed_world(spark, d):
    """One document per signal date, written with the faults that its day of the year gives it; the reader must find them."""
    k = F.dayofyear("signal_date")
    s = P.signals(P.bars(spark, d)).withColumn("k", k)
    fields = {
        "code": F.when(F.col("k") % 29 == 0, "12").otherwise(F.substring("symbol", 3, 6)), "name": F.col("symbol"), "score": F.lit(60), "float_mv": F.when(F.col("k") % 3 == 0, 1e9), "buy_type": F.when(F.col("k") % 5 != 2, "A"), "price": F.col("close"), "trigger": F.col("trigger"),
        "stop": F.when(F.col("k") % 31 == 0, -1.0).otherwise(F.col("stop")), "target": F.col("target"), "rr": F.lit(2.0), "signal_id": F.when(F.col("k") % 5 == 3, F.col("signal_date").cast("string")).otherwise(F.col("signal_id")),
        "trig": F.when(F.col("k") % 5 == 1, 1), "mood": F.when(F.col("k") % 23 == 0, "x"),
    }  # null fields are not written
    docs = s.groupBy("signal_date", "k").agg(F.collect_list(F.struct(*[e.alias(n) for n, e in fields.items()])).alias("candidates"), F.count(F.lit(1)).alias("n"))
    cover = F.struct(F.lit(100).alias("expected_symbol_count"), F.col("n").alias("evaluated_symbol_count"), (100 - F.col("n") + F.when(F.col("k") % 19 == 0, 1).otherwise(0)).alias("excluded_symbol_count"), F.when(F.col("k") % 17 == 0, "1970-01-01").otherwise(F.col("signal_date").cast("string")).alias("target_date"))
    top = {
        "date": F.col("signal_date").cast("string"), "mode": F.when(F.col("k") % 13 != 0, "close"), "market_env": F.struct(F.lit("A").alias("grade")), "sectors": F.array(F.lit("x")), "input_coverage": cover, "candidates": F.col("candidates"),
        "items": F.when(F.col("k") % 7 == 0, 1), "extra": F.when(F.col("k") % 11 == 0, 1),
    }
    return lg.closed_world(docs.select(F.col("signal_date").alias("date"), F.to_json(F.struct(*[e.alias(n) for n, e in top.items()])).alias("payload")))


@query(
    "o13_3b_evidence_contract",
    f"WITH {BASE} SELECT signal_id, CASE WHEN rn % 7 = 0 OR rn % 11 = 0 OR rn % 13 = 0 THEN 'MISSING_POINT_IN_TIME_EVIDENCE' WHEN rn % 17 = 0 THEN 'AS_OF_DATE_MISMATCH' WHEN rn % 19 = 0 THEN 'KNOWN_AFTER_SIGNAL_DATE' WHEN rn % 5 = 1 THEN 'UNSUPPORTED_ADJUSTMENT_SEMANTICS' WHEN rn % 5 = 2 AND rn % 2 = 1 THEN 'MISSING_ADJUSTMENT_EVIDENCE' ELSE 'POINT_IN_TIME_OK' END AS status FROM sig",
)
def evidence_contract(spark, d):
    """Three kinds of evidence for each signal, with faults by its place: a later adjusted snapshot is never history."""
    s, rn = P.signals(P.bars(spark, d)), F.col("rn")
    kinds = F.explode(F.when(rn % 7 == 0, F.array(F.lit("universe"), F.lit("ohlcv"))).otherwise(F.array(F.lit("universe"), F.lit("sector"), F.lit("ohlcv"))))
    e = s.select("signal_id", "signal_date", "rn", kinds.alias("kind"))
    at = F.col("signal_date")
    e = e.select(
        "signal_id", "signal_date", "kind", F.when(rn % 11 != 0, "v1").alias("source_version"), F.when((rn % 17 == 0) & (F.col("kind") == "sector"), F.date_add(at, -1)).otherwise(at).alias("as_of"),
        F.when((rn % 19 == 0) & (F.col("kind") == "universe"), F.date_add(at, 1)).otherwise(at).alias("known_at"), F.when(rn % 13 == 0, "damaged").otherwise(F.sha2("signal_id", 256)).alias("sha256"),
        F.when(F.col("kind") == "ohlcv", F.when(rn % 5 == 1, "PROVIDER_QFQ_SNAPSHOT").when(rn % 5 == 2, "HISTORICAL_QFQ_AS_OF").otherwise("RAW_UNADJUSTED")).alias("adjustment"), (rn % 2 == 0).alias("factors"),
    )
    return lg.evidence_status(e, "signal_id", "signal_date")


@query(
    "o7_14b_shortlist",
    f"{LEVELS_WITH}, c AS (SELECT signal_id, date, rr, round(rr, 12) AS h, round(risk, 12) AS l FROM lv WHERE rr IS NOT NULL AND risk IS NOT NULL), f1 AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.date = c.date AND o.h >= c.h AND o.l <= c.l AND (o.h > c.h OR o.l < c.l))), r1 AS (SELECT * FROM c ANTI JOIN f1 USING (signal_id)), f2 AS (SELECT r1.* FROM r1 WHERE NOT EXISTS (SELECT 1 FROM r1 o WHERE o.date = r1.date AND o.h >= r1.h AND o.l <= r1.l AND (o.h > r1.h OR o.l < r1.l))), r2 AS (SELECT * FROM r1 ANTI JOIN f2 USING (signal_id)), f3 AS (SELECT r2.* FROM r2 WHERE NOT EXISTS (SELECT 1 FROM r2 o WHERE o.date = r2.date AND o.h >= r2.h AND o.l <= r2.l AND (o.h > r2.h OR o.l < r2.l))), "
    "u AS (SELECT *, 1 AS front FROM f1 UNION ALL SELECT *, 2 FROM f2 UNION ALL SELECT *, 3 FROM f3), o AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY front, h DESC, l, signal_id) AS place FROM u) SELECT date, CAST(place AS BIGINT) AS place, signal_id, front, place <= 2 AS in_two FROM o WHERE place <= 3",
)
def shortlist(spark, d):
    """Per date the first three by front, then reward ratio, then risk, then name; three fronts hold three rows if there are as many."""
    from pyspark.sql import Window

    from barlattice.operators import ranks as rk

    x = P.kept(signal_levels(spark, d).where("rr IS NOT NULL AND risk IS NOT NULL").select("signal_id", "date", "rr", "risk"))  # every front reads it
    x = rk.pareto_fronts(x, "date", "rr", "risk", "signal_id", fronts=3).where("front IS NOT NULL")
    order = Window.partitionBy("date").orderBy("front", F.round("rr", 12).desc(), F.round("risk", 12), "signal_id")
    return x.withColumn("place", F.row_number().over(order).cast("long")).where("place <= 3").select("date", "place", "signal_id", "front", (F.col("place") <= 2).alias("in_two"))
