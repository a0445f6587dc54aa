"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

#: Words in a block, at most: what one seat of the apportionment is worth. Where the smallest target is under FINE blocks, blocks are smaller.
BLOCK, FINE = 64, 16
#: Words and rows that a shard of a source holds at most, about; a hot source has as many shards as it needs.
SHARD, SHARD_ROWS = 1_000_000, 100_000
#: Shards, about, at most; of more words than SHARD times this, shards grow.
SHARDS = 100_000
#: Times a document, and so a source, may be used.
REPEATS = 3


def seats(parties: DataFrame, group: list[str], votes: str, total: str) -> DataFrame:
    """Sainte-Lague: the column ``total`` of seats (the same in a group) by the highest of votes / (2 s + 1).

    A party's seats differ from its exact share q by at most (parties * share + 1) / 2, so only the
    quotients in that range are listed and ranked; together they number about four times the parties.
    Ties go to the smaller ``party``. Adds the column ``seats``.
    """
    w = Window.partitionBy(*group)
    exact = F.col(total) * F.col("__part")
    ranged = (
        parties.withColumn("__sum", F.sum(votes).over(w))
        .withColumn("__n", F.count(F.lit(1)).over(w))
        .withColumn("__part", F.when(F.col("__sum") > 0, F.col(votes) / F.col("__sum")).otherwise(0.0))
        .withColumn("__reach", F.col("__n") * F.col("__part") / 2 + 1)
        .withColumn("__sure", F.greatest(F.lit(0), F.floor(exact - F.col("__reach"))).cast("long"))
        .withColumn("__most", F.ceil(exact + F.col("__reach")).cast("long"))
        .withColumn("__open", F.col(total) - F.sum("__sure").over(w))
    )
    listed = ranged.where(F.col(votes) > 0).withColumn("__seat", F.explode(F.sequence("__sure", "__most")))
    best = Window.partitionBy(*group).orderBy((F.col(votes) / (2 * F.col("__seat") + 1)).desc(), "party", "__seat")
    won = listed.withColumn("__rank", F.row_number().over(best)).where(F.col("__rank") <= F.col("__open"))
    won = won.groupBy(*[F.col(g).alias(f"__{g}") for g in group], F.col("party").alias("__party")).agg(F.count(F.lit(1)).alias("__won"))
    same = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group] + [F.col("party") == F.col("__party")]
    out = ranged.join(won, same, "left")
    return out.select(*parties.columns, (F.col("__sure") + F.coalesce("__won", F.lit(0))).alias("seats"))


def default_weight(rank: Column) -> Column:
    """1, 2, 3, 1, 2, 3, ... in the order of the sources."""
    return (F.pmod(rank - 1, F.lit(3)) + 1).cast("double")


def targets(sources: DataFrame, weights: DataFrame | None = None, repeats: int = REPEATS) -> DataFrame:
    """Words that each of ``sources(source, source_size)`` shall give, as column ``target``.

    All sizes together are shared by weight; no target passes ``repeats`` times its source's size,
    and the excess is shared anew by weight among the others until none is above. Those that meet
    the limit are the first in the order of limit / weight, so one pass over the sorted sources
    finds them. There is one row per source here, not per document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("party", F.row_number().over(order))
    if weights is None:
        ranked = ranked.withColumn("weight", default_weight(F.col("party")))
    else:
        given = weights.select(F.col("source").alias("__source"), F.col("weight").cast("double"))
        ranked = ranked.join(given, ranked["source"].eqNullSafe(given["__source"]), "left").drop("__source")
        ranked = ranked.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    ranked = ranked.withColumn("__cap", F.lit(float(repeats)) * F.col("source_size"))
    ratio = F.when(F.col("weight") > 0, F.col("__cap") / F.col("weight")).otherwise(F.lit(float("inf")))
    ranked = ranked.withColumn("__ratio", ratio)
    every, up = Window.partitionBy(), Window.orderBy("__ratio", "party")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = ranked.withColumn("__left", F.sum("source_size").over(every) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))).withColumn("__rest", F.sum("weight").over(after))
    levels = levels.withColumn("__level", F.when(F.col("__rest") > 0, F.col("__left") / F.col("__rest")))
    levels = levels.withColumn("__fits", (F.col("__level") * F.col("weight") <= F.col("__cap")) & (F.col("weight") > 0))
    levels = levels.withColumn("__final", F.min_by("__level", F.when(F.col("__fits"), F.struct("__ratio", "party"))).over(every))
    target = F.least(F.coalesce(F.col("__final") * F.col("weight"), F.col("__cap")), F.col("__cap"))
    return levels.select("party", "source", "source_size", F.when(F.col("weight") > 0, target).otherwise(0.0).alias("target"))


def mix(docs: DataFrame, weights: DataFrame | None = None, seed: int = 6, block: int = BLOCK, shard: int = SHARD, repeats: int = REPEATS, with_rows: bool = False) -> DataFrame:
    """Take words of every document so that the sources reach their targets.

    Each source is dealt into shards of about ``shard`` words by a seeded hash of doc_id; a shard's
    documents, in seeded order, form one stream of blocks of ``block`` words, or of fewer where a
    source's target is under 16 blocks. Seats worth one block are apportioned to the sources by their
    targets, then each source's seats to its shards by their words. A shard's quota takes blocks in
    the seeded order, round after round, up to ``repeats`` rounds; so the words taken of a document
    lie together.

    Returns doc_id, source, size, source_size, target, taken; one row per input row; with
    ``with_rows`` also ``row``, a struct of the row's columns c0, c1, ... in their order. A null text
    has size 0; a null source is a source of its own, the last. Rows without words take nothing. A
    null doc_id is dealt out as an empty one. Repeated rows are told apart by nothing but their place
    in the seeded order, which is then arbitrary among equals, with the same sum. An empty table gives
    an empty result.
    """
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    narrow = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"))
    sized = cut(narrow)
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__rows"))
    every = Window.partitionBy()
    small = F.floor(F.min(F.when(F.col("target") > 0, F.col("target"))).over(every) / FINE)
    aimed = targets(sources.drop("__rows"), weights, repeats).withColumn("__block", F.greatest(F.lit(1), F.least(F.lit(block), small)).cast("long"))
    aimed = aimed.withColumn("__blocks", F.round(F.sum("target").over(every) / F.col("__block")).cast("long"))
    held = sources.select(F.col("source").alias("__s"), "__rows")
    aimed = aimed.join(held, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    by_source = seats(aimed.withColumn("__all", F.lit(0)), ["__all"], "target", "__blocks")
    wide = F.greatest(F.lit(shard), F.ceil(F.sum("source_size").over(every) / SHARDS))
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / wide), F.ceil(F.col("__rows") / SHARD_ROWS)).cast("int")
    by_source = cut(by_source.select("source", "source_size", "target", "__block", F.col("seats").alias("__quota"), shards.alias("__shards")))

    def deal(rows: DataFrame, *more: str) -> DataFrame:
        """One row per source meets its documents, of which a hot source may hold a third."""
        a, b = rows.alias("a"), by_source.alias("b")
        out = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.doc_id", "a.source", "a.size", *[f"a.{m}" for m in more], "b.source_size", "b.target", "b.__block", "b.__quota", "b.__shards")
        # A hash that other engines have too: its first eight digits deal out the shards, the whole orders them.
        out = out.withColumn("__key", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
        out = out.withColumn("__shard", F.pmod(F.conv(F.substring("__key", 1, 8), 16, 10).cast("long"), F.col("__shards")).cast("int"))
        return out.withColumn("__group", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")))

    held = deal(sized).groupBy("__group", F.col("__shard").alias("party")).agg(F.sum("size").cast("double").alias("__words"), F.first("__quota").alias("__quota"), F.first("__block").alias("__unit"))
    quotas = seats(held, ["__group"], "__words", "__quota").select(F.col("__group").alias("__g"), F.col("party").alias("__p"), "__words", (F.col("seats") * F.col("__unit")).alias("__take"))
    rows = ["__row"] if with_rows else []
    if with_rows:
        carried = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"), F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("__row"))
    dealt = deal(carried, *rows) if with_rows else deal(sized)
    placed = dealt.join(quotas, (F.col("__group") == F.col("__g")) & (F.col("__shard") == F.col("__p")))
    stream = Window.partitionBy("__group", "__shard").orderBy("__key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("__end", F.sum("size").over(stream))
    whole = F.col("__words").cast("long")
    take = F.least(F.col("__take"), F.lit(repeats) * whole)
    rounds = F.when(whole > 0, F.floor(take / whole)).otherwise(0)
    rest = take - rounds * whole
    part = F.least(F.greatest(rest - (F.col("__end") - F.col("size")), F.lit(0)), F.col("size"))
    return placed.select("doc_id", "source", "size", "source_size", "target", (rounds * F.col("size") + part).cast("long").alias("taken"), *[F.col(r).alias("row") for r in rows])
