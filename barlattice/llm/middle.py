"""Fill-in-middle transformation and its inverse, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit is a word with the white space before it, or the white space at the end of the text.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_ANY = f"{PREFIX}|{SUFFIX}|{MIDDLE}"


def _draw(digest: Column, nth: int) -> Column:
    """The ``nth`` group (from 0) of eight hexadecimal digits as a long."""
    return F.conv(F.substring(digest, 8 * nth + 1, 8), 16, 10).cast("long")


def _units(units: Column, start: Column, count: Column) -> Column:
    """The text of ``count`` units from place ``start`` (from 1)."""
    return F.array_join(F.slice(units, start, count), "")


def transform(docs: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """Cut every whole text into prefix, middle and suffix and put the middle last.

    Adds to the columns of ``docs``: n (units), form (``plain``, ``psm`` or ``spm``), prefix_chars and middle_chars
    (code points; null if plain) and output. The cuts and the form come from the SHA-256 of ``seed:doc_id`` alone,
    so any run, on any partitioning, gives the same. ``fim_percent`` of the texts are rearranged,
    ``spm_percent`` of those with the suffix first. A text that is null (taken as empty), empty, or holds a sentinel
    is plain. A null doc_id draws from ``seed:`` alone; repeated rows are rearranged alike. Columns of ``docs`` with
    a name of an added column are replaced; those that begin with two underscores are dropped.
    """
    added = ("n", "form", "prefix_chars", "middle_chars", "output")
    kept = [c for c in docs.columns if c not in added and not c.startswith("__")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select(*kept, text.alias("__text"), F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)).alias("__units"), digest.alias("__digest"))
    rows = rows.withColumn("n", F.size("__units").cast("long"))
    h1, h2, h3, h4 = (_draw(F.col("__digest"), i) for i in range(4))
    rows = rows.select("*", (F.least(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1))).cast("int").alias("__a"), (F.greatest(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1))).cast("int").alias("__b"))
    text = F.col("__text")
    plain = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (h3 % 100 >= fim_percent)
    rows = rows.withColumn("form", F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm"))
    cut = F.col("form") != "plain"
    units, a, b = F.col("__units"), F.col("__a"), F.col("__b")
    rows = rows.select(
        "*",
        F.when(cut, _units(units, F.lit(1), a)).alias("__prefix"),
        F.when(cut, _units(units, a + 1, b - a)).alias("__middle"),
        F.when(cut, _units(units, b + 1, F.size(units) - b)).alias("__suffix"),
    )
    parts = {"psm": (PREFIX, "__prefix", SUFFIX, "__suffix"), "spm": (SUFFIX, "__suffix", PREFIX, "__prefix")}
    output = F.when(~cut, text)
    for form, (one, first, two, second) in parts.items():
        output = output.when(F.col("form") == form, F.concat(F.lit(one), F.col(first), F.lit(two), F.col(second), F.lit(MIDDLE), F.col("__middle")))
    return rows.select(*kept, "n", "form", F.length("__prefix").cast("long").alias("prefix_chars"), F.length("__middle").cast("long").alias("middle_chars"), output.alias("output"))


def restore(rows: DataFrame) -> DataFrame:
    """Add ``restored``: the text that ``output`` was made of, from output and form alone.

    A rearranged output must hold the sentinels of its form, each once and in order, the first of them at its start;
    of any other output, an unknown form or a null the restored text is null. A plain output is the text itself.
    """
    output = F.col("output")
    marks = F.array_join(F.regexp_extract_all(output, F.lit(_ANY), F.lit(0)), "")
    rows = rows.drop("restored").select("*", F.split(output, _ANY).alias("__parts"), marks.alias("__marks"))
    sound = output.startswith("<") & (F.col("__parts")[0] == "") & (F.size("__parts") == 4)

    def put(prefix: int, suffix: int, order: str) -> Column:
        return F.when(sound & (F.col("__marks") == order), F.concat(F.col("__parts")[prefix], F.col("__parts")[3], F.col("__parts")[suffix]))

    restored = F.when(F.col("form") == "plain", output).when(F.col("form") == "psm", put(1, 2, PREFIX + SUFFIX + MIDDLE)).when(F.col("form") == "spm", put(2, 1, SUFFIX + PREFIX + MIDDLE))
    return rows.select("*", restored.alias("restored")).drop("__parts", "__marks")


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the SHA-256 of output and restored text of every document."""
    made = transform(docs.select(F.col("doc_id").cast("long"), "text"))
    back = restore(made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output"))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


#: DuckDB SQL of ``round_trip``.
ORACLE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS c2, CAST('0x' || h[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS h4 FROM d),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 50 THEN 'plain' WHEN h4 < 80 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m, array_to_string(u[greatest(c1, c2) + 1:], '') AS s FROM r)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM f"""
