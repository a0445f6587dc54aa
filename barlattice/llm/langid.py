"""Language identification: nearest of several centroids per language, over TF-IDF of hashed n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import runs, text_buffer, tidy

#: Buckets of hashed n-grams (of 1, 2 and 3 bytes of lower-cased letters).
DIMS = 8192
#: Bound on the labelled rows that the model is fitted on: so many per language, and in all.
PER_LANGUAGE, IN_ALL = 512, 4096
CLUSTERS = 4
#: A cluster of fewer than this share of its language's rows is no centroid of its own.
LEAST_CLUSTER = 0.02
#: A text is rejected if its cosine is under this share of what training texts of its length reach but for one in a hundred.
REJECT_SHARE = 0.5
#: Bytes of the pieces of training texts that tell the cosine for each length; between them it is interpolated.
LENGTHS = (2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096)
UNKNOWN = "und"

#: ASCII bytes other than letters become spaces; bytes of longer characters stay.
FOLD = np.array([b if b >= 0x80 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)
MIX = np.uint32(0x9E3779B1)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one unit row per centroid
    of: np.ndarray  # the language's index
    floor: np.ndarray  # lowest accepted cosine of texts of each of LENGTHS bytes


def grams(text: np.ndarray, dims: int = DIMS, chunk: int = 1 << 20) -> np.ndarray:
    """Counts of the hashed n-grams of one lower-cased text, whatever its length."""
    counts = np.zeros(dims, np.int64)
    shift = np.uint32(32 - int(dims).bit_length() + 1)
    for at in range(0, len(text), chunk):
        part = FOLD[text[at : at + chunk + 2]].astype(np.uint32)
        for n in (1, 2, 3):
            m = min(len(part) - n + 1, chunk)
            if m <= 0:
                continue
            code = part[:m].copy()
            for k in range(1, n):
                code = code * np.uint32(257) + part[k : k + m]
            code = (code + np.uint32(n * 0x51ED27)) * MIX
            counts += np.bincount(code >> shift, minlength=dims)
    return counts


def vectors(texts: pa.Array, dims: int = DIMS):
    """(first, last, matrix of log-scaled counts) for runs of the batch's texts."""
    data, offsets = text_buffer(pc.utf8_lower(texts.cast(pa.large_string())))
    for i, j in runs(offsets):
        for a in range(i, j, 256):
            b = min(a + 256, j)
            yield a, b, np.log1p(np.stack([grams(data[offsets[k] : offsets[k + 1]], dims) for k in range(a, b)])).astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1)


def clusters(rows: np.ndarray, k: int, rounds: int = 12, least: float = LEAST_CLUSTER) -> np.ndarray:
    """Spherical k-means; the same rows give the same centroids.

    It starts from a bisection: the largest cluster is halved along the direction in which its rows vary
    most, until there are ``k``. So no odd row becomes a centroid; clusters of less than a share ``least``
    of the rows are dissolved.
    """
    own = np.zeros(len(rows), int)
    for c in range(1, min(k, len(rows) // 2)):
        big = np.flatnonzero(own == np.bincount(own).argmax())
        apart = rows[big] - rows[big].mean(axis=0)
        along = np.linalg.eigh((apart @ apart.T).astype(np.float64))[1][:, -1]
        own[big[along > np.median(along)]] = c
    centres = np.stack([unit(rows[own == c].mean(axis=0, keepdims=True))[0] for c in np.unique(own)])
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(axis=1)
        held = [c for c in range(len(centres)) if (own == c).sum() >= max(1, least * len(rows))]
        centres = np.stack([unit(rows[own == c].mean(axis=0, keepdims=True))[0] for c in held]) if held else centres[:1]
    return centres


def floors(pieces: list[bytes], langs: np.ndarray, idf: np.ndarray, centroids: np.ndarray, of: np.ndarray, languages: list[str]) -> np.ndarray:
    """For each of LENGTHS, REJECT_SHARE of the cosine that all but one in a hundred training pieces have with their own language."""
    out = []
    for length in LENGTHS:
        near = []
        for i, lang in enumerate(languages):
            cut = [np.frombuffer(p[:length], np.uint8) for p, n in zip(pieces, langs) if n == lang and len(p) >= length]
            for a in range(0, len(cut), 256):
                rows = unit(np.log1p(np.stack([grams(c, len(idf)) for c in cut[a : a + 256]])).astype(np.float32) * idf)
                near.append((rows @ centroids[of == i].T).max(axis=1))
        # A length that too few training texts have is judged as the length before.
        known = np.concatenate(near) if near else np.zeros(0)
        out.append(REJECT_SHARE * float(np.quantile(known, 0.01)) if len(known) >= 50 else (out[-1] if out else 0.0))
    return np.array(out)


def held_out() -> Column:
    """Rows that the model never learns from: crc32 of doc_id as text, mod 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, dims: int = DIMS, per_language: int = PER_LANGUAGE, in_all: int = IN_ALL, k: int = CLUSTERS) -> Model:
    """Learn from ``text`` and non-null ``lang`` of the rows that are not held out.

    The sample holds at most ``per_language`` rows of a language and ``in_all`` rows together: one of
    each slot of a seeded hash of doc_id, the smallest. Languages take turns, so that each has up to
    ``in_all`` / languages rows before any has more. Only their vectors and a piece of each text come to
    the driver (2 bytes * dims and the largest of LENGTHS for each row); of repeated rows of a doc_id,
    one. The pieces, cut to each of LENGTHS, tell how near texts of that length come.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    key = F.xxhash64(F.lit(7), F.col("doc_id"))
    slots = labelled.select("doc_id", "lang", key.alias("__key")).groupBy("lang", F.pmod("__key", F.lit(per_language)).alias("__slot"))
    least = slots.agg(F.min(F.struct("__key", "doc_id")).alias("__least"))
    turns = least.withColumn("__turn", F.row_number().over(Window.partitionBy("lang").orderBy("__least")))
    some = turns.orderBy("__turn", "__least").limit(in_all).select(F.col("__least.doc_id").alias("__id"))

    @tidy
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            fresh = [k not in seen and not seen.add(k) for k in batch.column(2).to_pylist()]
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            lowered = pc.utf8_lower(batch.column(1).cast(pa.large_string()))
            for a, b, rows in vectors(batch.column(1), dims):
                blobs = pa.array([r.astype(np.float16).tobytes() for r in rows], pa.binary())
                middles = [x.as_buffer() for x in lowered.slice(a, b - a)]
                middles = [bytes(x[max(0, (len(x) - LENGTHS[-1]) // 2) :][: LENGTHS[-1]]) for x in map(memoryview, middles)]
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(a, b - a), batch.column(0).slice(a, b - a), blobs, pa.array(middles, pa.binary())], names=["__id", "lang", "vector", "piece"])

    texts = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    chosen = texts.join(F.broadcast(some), texts["doc_id"] == some["__id"]).where("lang IS NOT NULL AND text IS NOT NULL")
    vectored = chosen.select("lang", "text", F.col("__id").cast("long").alias("__id")).mapInArrow(run, "__id long, lang string, vector binary, piece binary")
    found = vectored.groupBy("__id").agg(F.min(F.struct("lang", "vector", "piece")).alias("row")).select("row.*").collect()
    if not found:
        return Model([], np.ones(dims, np.float32), np.zeros((0, dims), np.float32), np.zeros(0, int), np.zeros(0))
    found.sort()
    langs = np.array([r.lang for r in found])
    rows = np.stack([np.frombuffer(r.vector, np.float16) for r in found]).astype(np.float32)
    idf = np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))).astype(np.float32) + 1
    rows = unit(rows * idf)
    languages, centroids, of = sorted(set(langs.tolist())), [], []
    for i, lang in enumerate(languages):
        centres = clusters(rows[langs == lang], k)
        centroids.append(centres)
        of += [i] * len(centres)
    centroids, of = np.concatenate(centroids).astype(np.float32), np.array(of)
    return Model(languages, idf, centroids, of, floors([bytes(r.piece) for r in found], langs, idf, centroids, of, languages))


def judge(texts: pa.Array, letters: np.ndarray, model: Model):
    """(first, last, languages, scores, rejected) for runs of a batch's texts."""
    for a, b, rows in vectors(texts, len(model.idf)):
        known = letters[a:b] & bool(model.languages)
        if not model.languages:
            yield a, b, [UNKNOWN] * (b - a), np.zeros(b - a), np.ones(b - a, bool)
            continue
        near = unit(rows * model.idf) @ model.centroids.T
        best = near.argmax(axis=1)
        score = np.where(known, np.clip(near[np.arange(len(best)), best], 0, 1), 0.0)
        # Three n-grams to a byte, but for the ends of the text.
        far = score < np.interp(np.log2(np.maximum(np.expm1(rows).sum(axis=1) / 3, 1)), np.log2(LENGTHS), model.floor)
        yield a, b, [model.languages[model.of[c]] if ok else UNKNOWN for c, ok in zip(best, known)], score.astype(float), ~known | far


def with_letters(docs: DataFrame, *more: Column) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(*more, text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row; only the text is looked at.

    lang_pred is the language of the nearest centroid and score its cosine (0 to 1). A text that is
    null, empty or without a letter has lang_pred ``und``, score 0 and is rejected; so has every text
    if nothing could be learned. ``rejected`` is also true where the cosine is under the floor for
    texts of its length. Ties go to the first language in code point order.
    """

    @tidy
    def run(batches):
        for batch in batches:
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for a, b, names, score, rejected in judge(batch.column(1), letters, model):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return with_letters(docs, F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the rows of ``docs`` that are not held out, then predict all rows."""
    return predict(docs, fit(docs)).withColumn("held_out", held_out())


def known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is recognised, with all their columns; one scan, no shuffle of texts."""
    model = fit(docs)
    rest = [c for c in docs.columns if c != "text"]
    inputs = with_letters(docs, F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)]).alias("row"))

    @tidy
    def run(batches):
        for batch in batches:
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            kept = np.concatenate([~x[4] for x in judge(batch.column(1), letters, model)] or [np.zeros(0, bool)])
            yield batch.select([0, 1]).filter(pa.array(kept))

    out = inputs.mapInArrow(run, StructType([inputs.schema["row"], inputs.schema["text"]]))
    return out.select(*[F.col("text") if c == "text" else F.col("row")[f"c{rest.index(c)}"].alias(c) for c in docs.columns])
