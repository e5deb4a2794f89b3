"""Centroid clustering of vectors by Walsh-Hadamard progressive search.

A vector's components become integers (``floor(256 * x)``). Centroids start as
the ``k`` vectors whose ids have the smallest SHA-256; each of ``rounds`` rounds
assigns every vector to the nearest centroid (squared Euclidean distance, ties
to the smaller number) and moves each centroid to the floor of its vectors'
mean; centroids without vectors stay. Then vectors are assigned once more.

The search works on exact integer Walsh-Hadamard transforms, rows ordered from
coarse to fine (by sign changes). The transform multiplies squared distances by
the number of components, so the squared differences of the first coefficients,
added up, are a bound from below. For each vector the centroid with the least
sum over the coarse coefficients is finished first; its distance is the mark
to beat. All other centroids go on block by block, and those whose sum is above
the mark are eliminated; equal ones stay. What is left at the end has all
coefficients, and the least distance, then the smaller number, decides.

Each round is one scan: a task sends the sums of its vectors by centroid, Spark
sums these rows, and the driver gets ``k`` rows.

Defined results: vectors that are null, have another number of components than
``dims`` or hold null or non-finite components are dropped; rows without an id
are assigned but are the last to become centroids; repeated rows count one by
one; equal ids go by components; with fewer vectors than ``k`` there are fewer
centroids; an empty table gives an empty result; sums that leave 64 bits are
null; components of 65,536 or more are an error. Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import stage
from quarry.llm.vectors import floors, integer_groups, selected, usable

K, ROUNDS, DIMS, SEED = 40, 5, 64, 2
#: Vectors that are searched side by side.
SLICE = 4096
#: Coefficients over which all centroids are compared first.
COARSE = 4


def transform(x: np.ndarray) -> np.ndarray:
    """The exact Walsh-Hadamard transform of integer rows, whose length is a
    power of two, with coefficients from coarse to fine."""
    n = x.shape[1]
    out = x.copy()
    h = 1
    while h < n:
        pairs = out.reshape(len(x), n // (2 * h), 2, h)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return out[:, sequency(n)]


def sequency(n: int) -> np.ndarray:
    """Rows of the Hadamard matrix of order ``n`` by their number of sign changes."""
    bits = n.bit_length() - 1
    gray = np.arange(n) ^ (np.arange(n) >> 1)
    order = np.zeros(n, np.int64)
    for b in range(bits):
        order |= (gray >> b & 1) << (bits - 1 - b)
    return order


class Progressive:
    """Exact nearest-centroid search (centroids by components, integers)."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.coefficients = transform(centroids)
        dims = centroids.shape[1]
        edges = [min(COARSE, dims)]
        while edges[-1] < dims:
            edges.append(min(dims, 2 * edges[-1]))
        self.edges = edges

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row, the first of several, and its squared distance."""
        found = [self._nearest(transform(x[i : i + SLICE])) for i in range(0, len(x), SLICE)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _added(self, t: np.ndarray, rows: np.ndarray, at: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return ((t[rows, lo:hi] - self.coefficients[at, lo:hi]) ** 2).sum(1)

    def _nearest(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, dims = t.shape
        first = self.edges[0]
        coarse = ((t[:, None, :first] - self.coefficients[None, :, :first]) ** 2).sum(-1)
        rows = np.arange(n)
        lead = coarse.argmin(1)
        mark = coarse[rows, lead] + self._added(t, rows, lead, first, dims)
        rows, at = np.nonzero(coarse <= mark[:, None])  # by row, then centroid
        sums = coarse[rows, at]
        for lo, hi in zip(self.edges, self.edges[1:], strict=False):
            sums = sums + self._added(t, rows, at, lo, hi)
            left = sums <= mark[rows]
            rows, at, sums = rows[left], at[left], sums[left]
        starts = np.searchsorted(rows, np.arange(n))
        least = np.minimum.reduceat(sums, starts)
        best = np.flatnonzero(sums == least[rows])
        best = best[np.unique(rows[best], return_index=True)[1]]
        return at[best], sums[best] // dims


SUMS = "cluster int, n long, sums array<long>"
PLACED = "vec_id long, cluster int, distance long"


def _sums(centroids, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Progressive(centroids.value)
        k = len(search.centroids)
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for _, x in [g for d, g in integer_groups(batch.column(0)).items() if d == dims]:
                at, _ = search.nearest(x)
                n += np.bincount(at, minlength=k)
                np.add.at(sums, at, x)
        some = np.flatnonzero(n)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * dims), pa.array(sums[some].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), lists], ["cluster", "n", "sums"])

    return run


def learn(rows: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, seed: int = SEED) -> np.ndarray:
    """Centroids, by number and component. rows: ``vec_id`` and ``v``."""
    if dims < 1 or dims & (dims - 1):
        raise ValueError("the number of components must be a power of two")
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    kept = rows.select("vec_id", "v").filter(usable() & (F.size("v") == dims)).withColumn("rank", rank)
    first = kept.orderBy(F.asc_nulls_last("rank"), "v").limit(k).collect()
    centroids = floors(np.array([r["v"] for r in first], np.float64).reshape(-1, dims))
    for _ in range(rounds if len(centroids) else 0):
        sent = rows.sparkSession.sparkContext.broadcast(centroids)
        sums = rows.select("v").mapInArrow(_sums(sent, dims), SUMS).groupBy("cluster")
        total = sums.agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(dims))).collect()
        centroids = centroids.copy()
        for r in total:  # a row for each centroid
            centroids[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
        sent.destroy()
    return centroids


def assign(rows: DataFrame, centroids: np.ndarray, dims: int = DIMS) -> DataFrame:
    """``vec_id``, ``cluster`` and ``distance`` (squared) of every vector of ``dims`` components."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Progressive(sent.value)
        for batch in batches:
            for rows_, x in [g for d, g in integer_groups(batch.column(1)).items() if d == dims]:
                at, far = search.nearest(x)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows_)), pa.array(at, pa.int32()), pa.array(far)], ["vec_id", "cluster", "distance"])

    return rows.select("vec_id", "v").mapInArrow(run, PLACED)


def cluster_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    rounds: int = ROUNDS,
    dims: int = DIMS,
    seed: int = SEED,
) -> DataFrame:
    """One row per vector: ``vec_id``, ``cluster``, ``distance``,
    ``cluster_inertia`` and ``inertia`` (distances summed over its cluster and
    over all) and ``centroid_sha256`` of its final centroid."""
    rows = selected(vectors, id_col, vector_col)
    spark = rows.sparkSession
    centroids = learn(rows, k, rounds, dims, seed)
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], out)
    placed = stage(assign(rows, centroids, dims), "clusters")
    whole = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # k rows
    within = {r["cluster"]: int(r["d"]) for r in whole}
    long = lambda n: n if n < 1 << 63 else None
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = [(c, long(d), long(sum(within.values())), hashes[c]) for c, d in within.items()]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(about), "cluster").select(*(c.split()[0] for c in out.split(", ")))


def _oracle() -> str:
    near = (
        "a{r} AS (SELECT rid, e, d FROM (SELECT x.rid, c.e, sum((x.x - c.x) * (x.x - c.x)) AS d FROM x JOIN c{r} c ON x.pos = c.pos GROUP BY ALL) "
        "QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, e) = 1)"
    )
    move = (
        "m{r} AS (SELECT a.e, x.pos, sum(x.x) AS s, count(*) AS n FROM x JOIN a{r} a ON x.rid = a.rid GROUP BY ALL), "
        "c{q} AS (SELECT c.e, c.pos, CASE WHEN m.n IS NULL THEN c.x ELSE CAST((m.s - ((m.s % m.n) + m.n) % m.n) // m.n AS BIGINT) END AS x "
        "FROM c{r} c LEFT JOIN m{r} m ON c.e = m.e AND c.pos = m.pos)"
    )
    rounds = ", ".join(f"{near.format(r=r)}, {move.format(r=r, q=r + 1)}" for r in range(ROUNDS))
    return f"""
WITH k AS (
  SELECT *, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS rid FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda y: isfinite(y))) = {DIMS}),
x AS (SELECT rid, unnest(range({DIMS})) AS pos, CAST(floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM k),
c0 AS (SELECT rid AS e, pos, x FROM x WHERE rid < {K}), {rounds}, {near.format(r=ROUNDS)},
h AS (SELECT e, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos)) AS h FROM c{ROUNDS} GROUP BY e)
SELECT k.vec_id, CAST(a.e AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
  CAST(sum(a.d) OVER (PARTITION BY a.e) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.h AS centroid_sha256
FROM a{ROUNDS} a JOIN k USING (rid) JOIN h ON a.e = h.e"""


ORACLE_SQL = _oracle()
