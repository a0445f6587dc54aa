"""Centroid clustering in whole numbers, with Hamerly's two bounds per vector."""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tidy
from .vectors import matrix

SCALE = 1024
#: Components are held within this bound, about 4e12 before scaling.
FAR = 1 << 52
#: Rounds after which the state goes to the checkpoint folder; in between, lost parts are computed again from there.
CUT_EVERY = 16
LONGEST = np.iinfo(np.int64).max
#: The bounds are doubles and give way by this much; clusters and distances rest on whole numbers alone.
SLACK = 1e-9

STATE = "vec_id long, steps binary, cluster int, before int, upper double, lower double, scans int"


def whole(vectors: DataFrame, dim: int) -> DataFrame:
    """vec_id and steps, the floors of 1024 x as little-endian integers of 4 bytes, or of 8 if a vector needs them.

    Kept are vectors with exactly ``dim`` components, none null, NaN or infinite; zero vectors are kept.
    """
    vector = F.col("embedding")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.where(vector.isNotNull() & (F.size(vector) == dim) & finite).select(F.col("vec_id").cast("long"), vector.cast("array<double>").alias("embedding"))
    limit = narrow(dim)

    @tidy
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                steps = np.clip(np.floor(matrix(batch.column(1)) * SCALE), -FAR, FAR).astype("<i8")
                small = steps.astype("<i4")
                packed = [(steps if wide else small)[i].tobytes() for i, wide in enumerate((np.abs(steps).max(axis=1) >= limit).tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["vec_id", "steps"])

    return kept.mapInArrow(run, "vec_id long, steps binary")


def narrow(dim: int) -> int:
    """Components below this give squared distances that fit 63 bits."""
    return 1 << ((62 - max(dim - 1, 1).bit_length()) // 2 - 1)


def unpacked(packed: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(packed, "<i4" if len(packed) == 4 * dim else "<i8").astype(np.int64)


def first_centroids(points: DataFrame, dim: int, k: int, seed: int) -> list[list[int]]:
    """The vectors with the ``k`` smallest SHA-256 of ``seed:vec_id``, in that order; fewer if there are fewer."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [unpacked(r.steps, dim).tolist() for r in points.select("steps", digest.alias("digest")).orderBy("digest", F.hex("steps")).limit(k).collect()]


def squared(steps: np.ndarray, centroid: list[int], limit: int) -> np.ndarray:
    """Exact squared distances of rows to one centroid; Python's integers where 63 bits might not do."""
    if steps.dtype == object or max(map(abs, centroid)) >= limit:
        apart = steps.astype(object) - np.array(centroid, object)
    else:
        apart = steps - np.array(centroid, np.int64)
    return (apart * apart).sum(axis=1)


def length(distance) -> np.ndarray:
    """The root of exact squared distances, as doubles."""
    return np.sqrt(np.asarray(distance).astype(np.float64))


class Round:
    """One assignment: where the centroids are, how far each has come, and how near its next one is."""

    def __init__(self, centroids: list[list[int]], earlier: list[list[int]] | None, dim: int):
        self.centroids, self.dim, self.limit = centroids, dim, narrow(dim)
        k = len(centroids)
        self.fresh = earlier is None
        wide = np.array(centroids, object)
        between = np.array([length(((wide - wide[j]) ** 2).sum(axis=1)) for j in range(k)])
        np.fill_diagonal(between, np.inf)
        self.half = between.min(axis=1) / 2 * (1 - SLACK)
        drift = np.zeros(k) if self.fresh else length(((wide - np.array(earlier, object)) ** 2).sum(axis=1)) * (1 + SLACK)
        self.drift = drift
        self.others = np.array([max((drift[i] for i in range(k) if i != j), default=0.0) for j in range(k)])

    def scan(self, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cluster (the smaller number of equals), upper and lower bound by exact distances to all centroids."""
        found = np.stack([squared(steps, c, self.limit) for c in self.centroids], axis=1)
        cluster = found.argmin(axis=1)
        ordered = np.sort(found, axis=1)
        second = length(ordered[:, 1]) if found.shape[1] > 1 else np.full(len(steps), np.inf)
        return cluster, length(ordered[:, 0]) * (1 + SLACK), second * (1 - SLACK)

    def assign(self, steps: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, scans: np.ndarray) -> None:
        """Bring cluster, bounds and scans (all in place) up to date."""
        if self.fresh:
            cluster[:], upper[:], lower[:] = self.scan(steps)
            scans += 1
            return
        upper[:] = (upper + self.drift[cluster]) * (1 + SLACK)
        loss = self.others[cluster]
        lower[:] = np.where(np.isinf(lower), lower, lower - loss - SLACK * (np.abs(lower) + loss))
        for centroid in range(len(self.centroids)):  # first against the bounds, then with the distance to the own centroid
            at = np.flatnonzero((cluster == centroid) & (upper >= np.maximum(self.half[cluster], lower)))
            if len(at):
                upper[at] = length(squared(steps[at], self.centroids[centroid], self.limit)) * (1 + SLACK)
        at = np.flatnonzero(upper >= np.maximum(self.half[cluster], lower))
        if len(at):
            cluster[at], upper[at], lower[at] = self.scan(steps[at])
            scans[at] += 1


def groups(packed: pa.Array, dim: int):
    """(places, rows of steps) of the narrow vectors, then of the wide ones as Python's integers."""
    sizes = np.fromiter((len(x.as_buffer()) if x.is_valid else 0 for x in packed), np.int64, len(packed))
    for width, kind in ((4, np.int64), (8, object)):
        at = np.flatnonzero(sizes == width * dim)
        if len(at):
            data = b"".join(packed[int(i)].as_buffer() for i in at)
            yield at, np.frombuffer(data, f"<i{width}").reshape(len(at), dim).astype(np.int64).astype(kind)


def assigned(state: DataFrame, now: Round) -> DataFrame:
    """The state after one more assignment; ``before`` is the cluster it had."""

    @tidy
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            before = batch.column(2).to_numpy()
            cluster, upper, lower, scans = (np.array(batch.column(i).to_numpy()) for i in (2, 4, 5, 6))
            for at, steps in groups(batch.column(1), now.dim):
                own = [x[at] for x in (cluster, upper, lower, scans)]
                now.assign(steps, *own)
                for whole_column, part in zip((cluster, upper, lower, scans), own):
                    whole_column[at] = part
            columns = [batch.column(0), batch.column(1), *map(pa.array, (cluster, before, upper, lower, scans))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "steps", "cluster", "before", "upper", "lower", "scans"])

    return state.mapInArrow(run, STATE)


def changes(state: DataFrame, k: int, dim: int) -> list:
    """What the vectors that changed their cluster add to each cluster's sums; component -1 is their number.

    Each task sends at most k x (dim + 1) rows, and the driver gets as many.
    """

    @tidy
    def run(batches):
        narrow_sum, wide_sum = np.zeros((k, dim + 1), np.int64), np.zeros((k, dim + 1), object)
        touched = False
        for batch in batches:
            cluster, before = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            touched = touched or batch.num_rows > 0
            for at, steps in groups(batch.column(0), dim):
                total = narrow_sum if steps.dtype != object else wide_sum
                for j in range(k):
                    came, went = cluster[at] == j, before[at] == j
                    total[j, :dim] += steps[came].sum(axis=0) - steps[went].sum(axis=0)
                    total[j, dim] += int(came.sum()) - int(went.sum())
            if np.abs(narrow_sum).max(initial=0) > 1 << 60:
                wide_sum += narrow_sum.astype(object)
                narrow_sum[:] = 0
        if touched:
            total = (wide_sum + narrow_sum.astype(object)).reshape(-1)
            cell = np.flatnonzero(total != 0)
            values = pa.array([Decimal(int(total[i])) for i in cell], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array((cell // (dim + 1)).astype(np.int32)), pa.array((cell % (dim + 1)).astype(np.int32)), values], names=["cluster", "component", "total"])

    moved = state.where("cluster <> before").select("steps", "cluster", "before")
    return moved.mapInArrow(run, "cluster int, component int, total decimal(38,0)").groupBy("cluster", "component").agg(F.sum("total").alias("total")).collect()


def measured(state: DataFrame, centroids: list[list[int]], dim: int) -> DataFrame:
    """vec_id, cluster, exact squared distance to its centroid (the largest long, if it is larger) and scans."""
    limit = narrow(dim)

    @tidy
    def run(batches):
        for batch in batches:
            cluster, out = batch.column(2).to_numpy(), np.zeros(batch.num_rows, np.int64)
            for at, steps in groups(batch.column(1), dim):
                for j in np.unique(cluster[at]):
                    mine = np.flatnonzero(cluster[at] == j)
                    out[at[mine]] = np.minimum(squared(steps[mine], centroids[j], limit), LONGEST).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out), batch.column(6)], names=["vec_id", "cluster", "distance", "scans"])

    return state.mapInArrow(run, "vec_id long, cluster int, distance long, scans int")


def fit(points: DataFrame, dim: int, k: int = 8, rounds: int = 10, seed: int = 3) -> tuple[DataFrame, list[list[int]]]:
    """Clusters of the vectors of ``whole`` after ``rounds`` rounds and one more assignment, and the final centroids.

    The state (vector, cluster, two bounds) is kept by Spark between rounds; a lost part is computed again from the
    last written one, by the rounds since. Sums are carried on by the vectors that changed their cluster.
    """
    centroids = first_centroids(points, dim, k, seed)
    k = len(centroids)
    minus = F.lit(-1).cast("int")
    state = points.select("vec_id", "steps", minus.alias("cluster"), minus.alias("before"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"), F.lit(0).cast("int").alias("scans"))
    if not k:
        return measured(state, [], dim), []
    sums, earlier, held = np.zeros((k, dim + 1), object), None, []
    for turn in range(rounds):
        state = assigned(state, Round(centroids, earlier, dim))
        if turn % CUT_EVERY == CUT_EVERY - 1:
            state = cut(state)
        else:
            state = state.persist(StorageLevel.MEMORY_AND_DISK)
            held.append(state)
        for r in changes(state, k, dim):
            sums[r.cluster, r.component] += int(r.total)
        while len(held) > 1:
            held.pop(0).unpersist()
        earlier = centroids
        centroids = [[int(total // sums[j, dim]) for total in sums[j, :dim]] if sums[j, dim] else earlier[j] for j in range(k)]
    found = cut(measured(assigned(state, Round(centroids, earlier, dim)), centroids, dim))
    for state in held:
        state.unpersist()
    return found, centroids


def cluster(vectors: DataFrame, dim: int = 64, k: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """Cluster vectors around ``k`` centroids in whole steps of 1/1024; exact, whatever the partitioning.

    Returns for each vector with exactly ``dim`` components, none null or non-finite: vec_id, cluster, distance
    (squared, in steps), cluster_inertia, inertia, centroid_sha256 and scans (how often its distances to all
    centroids were computed). Ties go to the centroid of smaller number; an empty cluster keeps its centroid. Fewer
    vectors than ``k`` make as many centroids. Repeated rows are vectors of their own, and a null vec_id stays null.
    Components beyond 2^52 steps count as 2^52; distances and sums beyond the largest long are that long. An empty
    table gives an empty one; other columns are left out.
    """
    points = cut(whole(vectors, dim))
    found, centroids = fit(points, dim, k, rounds, seed)
    if not centroids:
        return found.select("vec_id", "cluster", "distance", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"), "scans")
    total = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    everything = min(sum(total.values()), LONGEST)
    rows = [(j, min(total.get(j, 0), LONGEST), everything, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    names = F.broadcast(vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return found.join(names, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans")


def oracle(dim: int = 64, k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """DuckDB SQL of ``cluster`` without scans, a round after the other, every distance computed."""
    steps = [
        f"""p AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e, sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, e) - 1 AS c, e AS m FROM p ORDER BY h, e LIMIT {k})",
    ]
    for t in range(rounds + 1):
        steps.append(f"a{t} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(e) AS e, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT p.*, c, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(e, m)]) AS d FROM p, c{t}) GROUP BY r)")
        if t < rounds:
            steps.append(f"s{t} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM (SELECT c, i, sum(e[i]) AS s, count(*) AS n FROM a{t}, range(1, {dim + 1}) AS u(i) GROUP BY c, i) GROUP BY c)")
            steps.append(f"c{t + 1} AS MATERIALIZED (SELECT c{t}.c, CASE WHEN s{t}.m IS NULL THEN c{t}.m ELSE CAST(s{t}.m AS BIGINT[]) END AS m FROM c{t} LEFT JOIN s{t} ON s{t}.c = c{t}.c)")
    last = f"a{rounds}"
    return f"""WITH {", ".join(steps)} SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string([CAST(x AS VARCHAR) FOR x IN m], ',')) AS centroid_sha256 FROM {last} JOIN c{rounds} USING (c)"""
