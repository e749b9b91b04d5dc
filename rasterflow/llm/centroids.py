"""Centroid clustering: Lloyd rounds in exact integers, screened by block norms.

A vector is compressed to the norms of its segments. By Cauchy and Schwarz the product of two segments is at most that of
their norms, so |x|^2 + |c|^2 - 2 sum(|x_b| |c_b|) is a lower bound of the squared distance of x and c, from eight numbers
a side instead of 64. The centroid of least bound is measured first; of the others, only those whose bound, less what
rounding can add, does not exceed the best distance so far are measured, in exact integers.

A round reads the vectors and shuffles one row for each task, used centroid and component. Centroids are of fixed number,
so the driver holds them and they travel with the next round's tasks.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterflow.llm.common import staged, table
from rasterflow.llm.vectors import cell_sums, decimal_text, first_vectors, integer_rows, means, squared


@dataclass(frozen=True)
class Clusters:
    """count of centroids, dim components in segments of ``width``, rounds, scale of the integers, salt of the first draw."""

    count: int = 40
    dim: int = 64
    width: int = 8
    rounds: int = 5
    scale: int = 256
    salt: str = "2:"

    def __post_init__(self):
        if self.dim % self.width:
            raise ValueError("segments must divide the vector")


def block_norms(x: np.ndarray, width: int) -> np.ndarray:
    """The norm of each segment of each row."""
    cut = x.reshape(len(x), -1, width).astype(np.float64)
    return np.sqrt(np.einsum("ijk,ijk->ij", cut, cut))


def nearest_centroids(x: np.ndarray, centroids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid of each row, squared distance, distances measured); ties go to the smaller number."""
    rows_b, centres_b = block_norms(x, width), block_norms(centroids, width)
    both = squared(rows_b)[:, None] + squared(centres_b)[None]
    bound = both - 2 * rows_b @ centres_b.T - (1e-9 * both + 1e-3)
    seed = bound.argmin(axis=1)
    found, best, measured = seed.copy(), squared(x - centroids[seed]), len(x)
    for c in range(len(centroids)):
        rows = np.flatnonzero((bound[:, c] <= best) & (seed != c))
        measured += len(rows)
        d = squared(x[rows] - centroids[c])
        better = (d < best[rows]) | ((d == best[rows]) & (c < found[rows]))
        found[rows[better]], best[rows[better]] = c, d[better]
    return found, best, measured


def fit_centroids(vectors: DataFrame, to: Clusters = Clusters(), id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray:
    """Centroids as an integer matrix. They start as the vectors whose salted id has the smallest SHA-256 (of repeated ids
    each row counts, by components; null ids never start one); fewer vectors give fewer centroids, empty ones stay. A round
    that changes nothing is the last one, as all later ones would repeat it."""
    key = F.sha2(F.concat(F.lit(to.salt), F.col(id_col).cast("string")), 256)
    centroids = first_vectors(vectors, key, vector_col, to.count, to.dim, to.scale)
    for _ in range(to.rounds if len(centroids) else 0):

        def cells(x, centroids=centroids):
            return [(nearest_centroids(x, centroids, to.width)[0], x)]

        after = means(centroids, *cell_sums(vectors, vector_col, cells, centroids.shape, to.dim, to.scale))
        if (after == centroids).all():
            break
        centroids = after
    return centroids


def assign_clusters(vectors: DataFrame, centroids: np.ndarray, to: Clusters = Clusters(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, cluster, distance) of all usable vectors; null ids and repeated rows keep their rows. Nothing is shuffled."""

    def run(batches):
        for batch in batches:
            at, x = integer_rows(batch.column(1), to.dim, to.scale)
            if len(at) and len(centroids):
                found, best, _ = nearest_centroids(x, centroids, to.width)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(found, pa.int32()), pa.array(best, pa.int64())], ["vec_id", "cluster", "distance"])

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vec")).mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, to: Clusters = Clusters(), id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(rows of assign_clusters, as a written table, and the centroids).

    Dropped are vectors that are null, of another length than ``dim`` (empty ones too), or hold a null, a non-finite
    component, or one beyond 2 ** 27 once scaled. An empty table, or one without a usable vector, gives no rows and no
    centroids. Equal vectors share a cluster; other columns are not read.
    """
    centroids = fit_centroids(vectors, to, id_col, vector_col)
    return staged(assign_clusters(vectors, centroids, to, id_col, vector_col), "clusters"), centroids


def op12(spark, sf_dir):
    """Clusters of all embeddings, with distances summed over the cluster and over all (null where beyond a long), and the
    digest of the cluster's centroid. The table of clusters has a row for each centroid, 40 at most, and is broadcast."""
    rows, centroids = cluster_vectors(table(spark, sf_dir, "embeddings"))
    inside = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    facts = [(c, fits(n), fits(sum(inside.values())), hashlib.sha256(decimal_text(centroids[c]).encode()).hexdigest()) for c, n in sorted(inside.items())]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(to: Clusters) -> str:
    """The rounds as one common table expression each."""
    ctes = [
        f"""k AS MATERIALIZED (SELECT vec_id, [CAST(floor({to.scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] v FROM embeddings
  WHERE len(embedding) = {to.dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{to.salt}' || vec_id), v) - 1 AS INTEGER) c, v FROM k QUALIFY c < {to.count})",
    ]
    for r in range(to.rounds + 1):
        ctes.append(
            f"""a{r} AS MATERIALIZED (SELECT k.vec_id, k.v, c.c, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(k.v, c.v)])::BIGINT d
  FROM k, c{r} c QUALIFY row_number() OVER (PARTITION BY k.vec_id ORDER BY d, c.c) = 1)"""
        )
        if r < to.rounds:
            ctes.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) v FROM c{r} c LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) v FROM
  (SELECT c, i, CAST(sum(v[i]) AS BIGINT) s, count(*) n FROM a{r}, (SELECT unnest(range(1, {to.dim + 1})) i) GROUP BY ALL) GROUP BY c) m USING (c))"""
            )
    last = to.rounds
    return f"""WITH {", ".join(ctes)}
SELECT a.vec_id, a.c AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{last} a JOIN c{last} c USING (c)"""


OP12_SQL = _sql(Clusters())
