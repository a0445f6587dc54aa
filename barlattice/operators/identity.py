"""Identity of line streams: a tree of hashes over the sorted lines, checked against a declared manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlattice.sources.panel import kept

from .statistics import group_places

#: Lines of a leaf, and nodes under each node above; no task holds more of a stream at once.
LEAF = 4096
SAME, MISSING, EXTRA, SWAPPED, CHANGED = "SAME", "ROWS_MISSING", "ROWS_ADDED", "ROWS_SWAPPED", "ROWS_CHANGED"
ABSENT, UNDECLARED = "STREAM_MISSING", "STREAM_UNDECLARED"


def line_number(line: Column) -> Column:
    """60 bits of a line's MD5, as a number to be summed."""
    return F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("decimal(38,0)")


def fingerprint(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, n_rows and fingerprint of the rows as a multiset: neither their order nor their partitioning matters.

    The four parts of each row's SHA-256 are summed exactly, before the exchange and after; the fingerprint is the
    hash of the number and the sums. Rows are equal by the JSON of ``columns``, nulls included.
    """
    row = df.select(*keys, F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias("__hash"))
    parts = [F.sum(F.conv(F.substring("__hash", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")).alias(f"__{i}") for i in range(4)]
    g = row.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *parts)
    return g.select(*keys, "n_rows", F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), *[F.col(f"__{i}").cast("string") for i in range(4)]), 256).alias("fingerprint"))


def leaves(lines: DataFrame, stream: str, order: list[str], line: str, size: int = LEAF) -> DataFrame:
    """stream, node (from 0), n_rows, n_bytes (with line ends), multiset and sha256 of every ``size`` lines in the order.

    ``multiset`` sums a number of each line, so it does not depend on the order; sha256 does. The order must be total: rows
    that tie in it must have equal lines. A null line is an empty one.
    """
    x = group_places(lines.select(stream, *[F.col(c) for c in dict.fromkeys([*order, line]) if c != stream]), stream, [F.col(c) for c in order], "__at")
    return placed_leaves(x, stream, "__at", line, size)


def placed_leaves(lines: DataFrame, stream: str, place: str, line: str, size: int = LEAF) -> DataFrame:
    """The ``leaves`` of lines that have their place in the stream, from 0 and without gaps: they are exchanged once, by leaf."""
    x = lines.select(stream, F.col(place).alias("__at"), F.coalesce(F.col(line), F.lit("")).alias("__line"))
    x = x.select(stream, F.floor(F.col("__at") / size).alias("node"), F.struct("__at", "__line").alias("row"), "__line")
    g = x.groupBy(stream, "node").agg(F.sort_array(F.collect_list("row")).alias("rows"), F.count(F.lit(1)).alias("n_rows"), F.sum(F.octet_length("__line") + 1).alias("n_bytes"), F.sum(line_number(F.col("__line"))).alias("multiset"))
    return g.select(stream, "node", "n_rows", "n_bytes", "multiset", F.sha2(F.array_join(F.transform("rows", lambda r: r["__line"]), "\n"), 256).alias("sha256"))


def roots(nodes: DataFrame, stream: str, size: int = LEAF) -> DataFrame:
    """stream, n_rows, n_bytes, multiset and content_sha256: the hash of the hashes of ``size`` nodes, until the stream has one.

    A stream's root depends on its own lines alone, however many levels other streams take.
    """
    wide = nodes.groupBy(F.col(stream).alias("__stream")).agg(F.count(F.lit(1)).alias("wide"))
    x = nodes.join(wide, F.col(stream).eqNullSafe(F.col("__stream"))).drop("__stream")
    out = None
    while True:
        x = x.withColumn("__up", F.floor(F.col("node") / size))
        g = x.groupBy(stream, "__up").agg(
            F.sort_array(F.collect_list(F.struct("node", "sha256"))).alias("under"), F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"),
            F.sum("multiset").cast("decimal(38,0)").alias("multiset"), F.ceil(F.max("wide") / size).alias("wide"),
        )
        x = kept(g.select(stream, F.col("__up").alias("node"), "n_rows", "n_bytes", "multiset", "wide", F.sha2(F.array_join(F.transform("under", lambda r: r["sha256"]), ""), 256).alias("sha256")))
        done = x.where("wide = 1").select(stream, "n_rows", "n_bytes", "multiset", F.col("sha256").alias("content_sha256"))
        out = done if out is None else out.unionByName(done)
        x = x.where("wide > 1")
        if x.isEmpty():
            return out


def verify(actual: DataFrame, declared: DataFrame, stream: str, size: int = LEAF) -> DataFrame:
    """stream, status, n_rows, declared_rows, bad_leaves and first_bad_leaf of the leaves found against those declared.

    Rows are missing or added by number; with equal numbers and another content they are swapped if the multiset is the
    same, else changed. A stream on one side only is missing or undeclared; its rows are no zero on the other side but null.
    """
    actual, declared = kept(actual), kept(declared)  # for the roots and for the leaves that differ
    a, b = roots(actual, stream, size), roots(declared, stream, size)
    found = a.select(F.col(stream), "n_rows", "multiset", F.col("content_sha256"))
    said = b.select(F.col(stream).alias("__stream"), F.col("n_rows").alias("declared_rows"), F.col("multiset").alias("__multiset"), F.col("content_sha256").alias("__sha256"))
    x = found.join(said, F.col(stream).eqNullSafe(F.col("__stream")), "full")
    status = (
        F.when(F.col("n_rows").isNull(), ABSENT).when(F.col("declared_rows").isNull(), UNDECLARED).when(F.col("n_rows") < F.col("declared_rows"), MISSING).when(F.col("n_rows") > F.col("declared_rows"), EXTRA)
        .when(F.col("content_sha256") == F.col("__sha256"), SAME).when(F.col("multiset") == F.col("__multiset"), SWAPPED).otherwise(CHANGED)
    )
    x = x.select(F.coalesce(stream, "__stream").alias(stream), status.alias("status"), "n_rows", "declared_rows")
    one = actual.select(F.col(stream).alias("__a"), F.col("node").alias("__n"), F.col("sha256").alias("__x"))
    two = declared.select(F.col(stream).alias("__b"), F.col("node").alias("__m"), F.col("sha256").alias("__y"))
    leaf = one.join(two, F.col("__a").eqNullSafe(F.col("__b")) & (F.col("__n") == F.col("__m")), "full").where(~F.col("__x").eqNullSafe(F.col("__y")))
    bad = leaf.groupBy(F.coalesce("__a", "__b").alias("__s")).agg(F.count(F.lit(1)).alias("bad_leaves"), F.min(F.coalesce("__n", "__m")).alias("first_bad_leaf"))
    x = x.join(bad, F.col(stream).eqNullSafe(F.col("__s")), "left")
    return x.select(stream, "status", "n_rows", "declared_rows", F.coalesce("bad_leaves", F.lit(0)).alias("bad_leaves"), "first_bad_leaf")


#: The fields that identify a row, and those whose presence anywhere in a row needs a review.
IDENTITY = ["symbol", "signal_date", "setup_id"]
SCORES = ["score", "score_total", "score_85", "score_breakdown", "sector_rank", "sector_chg"]


def scanned(lines: DataFrame, line: str = "value") -> DataFrame:
    """problem, has_score and the identity fields of each JSON line, found in its text alone: nothing is decoded.

    A field that is not there just once, at whatever depth, makes the row's identity ambiguous; then all fields are null.
    """
    found = {f: F.regexp_extract_all(F.col(line), F.lit(f'"{f}"\\s*:\\s*"([^"\\\\]+)"'), F.lit(1)) for f in IDENTITY}
    x = lines.select("*", *[v.alias(f"__{f}") for f, v in found.items()])
    clear = F.lit(True)
    for f in IDENTITY:
        clear = clear & (F.size(f"__{f}") == 1)
    score = F.col(line).rlike('"(?:' + "|".join(SCORES) + r')"\s*:')
    return x.select(*lines.columns, F.when(~clear, "AMBIGUOUS_OR_MISSING_IDENTITY").alias("problem"), score.alias("has_score"), *[F.when(clear, F.get(f"__{f}", F.lit(0))).alias(f) for f in IDENTITY])


def scan(lines: DataFrame, stream: str, line: str = "value") -> DataFrame:
    """stream, n_rows, n_bytes, score_rows, ambiguous_rows and duplicate_rows (rows beyond the first of their identity)."""
    x = scanned(lines, line)
    per = x.groupBy(stream, *IDENTITY).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(line) + 1).alias("b"), F.count_if("has_score").alias("s"), F.count_if(F.col("problem").isNotNull()).alias("p"))
    return per.groupBy(stream).agg(F.sum("n").alias("n_rows"), F.sum("b").alias("n_bytes"), F.sum("s").alias("score_rows"), F.sum("p").alias("ambiguous_rows"), F.sum(F.when(F.col("symbol").isNotNull(), F.col("n") - 1).otherwise(0)).alias("duplicate_rows"))
