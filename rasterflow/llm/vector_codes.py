"""Vector code compression: product codes by annular norm pruning.

Vectors become integers and are cut into equal parts; each part position has a codebook of its own, fitted by rounds of
nearest-entry assignment and exact means. To find a part's nearest entry, entries stand sorted by norm. The entry whose
norm is nearest gives a first distance d; by the triangle inequality an entry at distance d or less has a norm within
sqrt(d) of the part's norm, so that interval is found by binary search and only entries inside it, ends included, are
measured, in exact integers. Each better distance narrows the interval by another search. Ends are widened by more than
rounding can take, so a tie at an end is measured too.

A round reads the vectors, shuffles one row for each task, entry and component, and leaves the driver a codebook of fixed
size, which travels with the next round's tasks.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterflow.llm.common import staged, table
from rasterflow.llm.vectors import cell_sums, decimal_text, first_vectors, integer_rows, means, small_side, squared, sum_long


@dataclass(frozen=True)
class Codec:
    """dim components, cut into parts; entries of a codebook (256 at most); rounds of fitting; scale of the integers."""

    dim: int = 64
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096

    def __post_init__(self):
        if self.dim % self.parts or not 0 < self.entries <= 256:
            raise ValueError("parts must divide dim, and a codebook has 1 to 256 entries")

    @property
    def width(self) -> int:
        return self.dim // self.parts


def annulus(norms: np.ndarray, own: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end place, in sorted norms, of the entries that a distance of ``best`` or less allows."""
    reach = np.sqrt(best)
    reach = reach + 1e-9 * (own + reach) + 1e-6
    return np.searchsorted(norms, own - reach, "left"), np.searchsorted(norms, own + reach, "right")


def nearest_entries(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest entry of each row, squared distance, distances measured); ties go to the lower index."""
    lengths = np.sqrt(squared(entries.astype(np.float64)))
    order = np.argsort(lengths, kind="stable")
    norms, own = lengths[order], np.sqrt(squared(x.astype(np.float64)))
    above = np.minimum(np.searchsorted(norms, own), len(norms) - 1)
    below = np.maximum(above - 1, 0)
    seed = np.where(own - norms[below] <= norms[above] - own, below, above)
    found, best, measured = order[seed], squared(x - entries[order[seed]]), len(x)
    low, high = annulus(norms, own, best)
    for place, entry in enumerate(order):
        rows = np.flatnonzero((low <= place) & (place < high) & (seed != place))
        measured += len(rows)
        d = squared(x[rows] - entries[entry])
        better = (d < best[rows]) | ((d == best[rows]) & (entry < found[rows]))
        hit = rows[better]
        found[hit], best[hit] = entry, d[better]
        low[hit], high[hit] = annulus(norms, own[hit], best[hit])
    return found, best, measured


def by_part(x: np.ndarray, books: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each part position: nearest entries, squared distances and the parts themselves."""
    cut = x.reshape(len(x), len(books), -1)
    return [(*nearest_entries(cut[:, p], books[p])[:2], cut[:, p]) for p in range(len(books))]


def fit_codebooks(vectors: DataFrame, codec: Codec = Codec(), id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray:
    """Codebooks as an integer array (part, entry, component).

    They start as the parts of the vectors of smallest id (of repeated ids each row counts, by components; null ids come
    never); fewer vectors give fewer entries. Entries that no part is nearest to stay. A round that changes nothing is
    the last one, as all later ones would repeat it.
    """
    seeds = first_vectors(vectors, F.col(id_col).cast("long"), vector_col, codec.entries, codec.dim, codec.scale)
    books = seeds.reshape(-1, codec.parts, codec.width).transpose(1, 0, 2)
    entries = books.shape[1]
    for _ in range(codec.rounds if entries else 0):

        def cells(x, books=books):
            return [(p * entries + found, rows) for p, (found, _, rows) in enumerate(by_part(x, books))]

        flat = books.reshape(-1, codec.width)
        after = means(flat, *cell_sums(vectors, vector_col, cells, flat.shape, codec.dim, codec.scale)).reshape(books.shape)
        if (after == books).all():
            break
        books = after
    return books


def encode_vectors(vectors: DataFrame, books: np.ndarray, codec: Codec = Codec(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows (vec_id, label, code, error): a byte a part, and the squared distances summed. Unusable vectors give no row; null
    ids, null labels and repeated rows keep theirs. Nothing is shuffled."""
    seen = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vec"))
    label = seen.schema["label"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at, x = integer_rows(batch.column(2), codec.dim, codec.scale)
            if len(at) and books.shape[1]:
                found = by_part(x, books)
                codes = np.stack([f for f, _, _ in found], axis=1).astype(np.uint8)
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(sum(d for _, d, _ in found), pa.int64())],
                    ["vec_id", "label", "code", "error"],
                )

    return seen.mapInArrow(run, f"vec_id long, label {label}, code binary, error long")


def decode_codes(codes: DataFrame, books: np.ndarray, scale: int = 4096) -> DataFrame:
    """codes with a column ``vec``: the components of the entries, as doubles, scaled back."""

    def run(batches):
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, len(books))
            rows = np.concatenate([books[p][raw[:, p]] for p in range(len(books))], axis=1) / scale
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(rows), pa.list_(pa.float64()))], names=[*batch.schema.names, "vec"])

    kept = codes.drop("vec")
    return kept.mapInArrow(run, kept.schema.simpleString()[len("struct<") : -1] + ",vec:array<double>")


def compress_vectors(vectors: DataFrame, codec: Codec = Codec(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(rows of encode_vectors, as a written table, and the codebooks).

    Dropped are vectors that are null, of another length than ``dim`` (empty ones too), or hold a null, a non-finite
    component, or one beyond 2 ** 27 once scaled. An empty table, or one without a usable vector, gives no rows and
    empty codebooks. Equal vectors get equal codes; other columns are not read.
    """
    books = fit_codebooks(vectors, codec, id_col, vector_col)
    return staged(encode_vectors(vectors, books, codec, id_col, vector_col, label_col), "vector-codes"), books


def op11(spark, sf_dir):
    """Codes of all embeddings with their errors, and errors summed by label, nulls together. A label's sum is null where it
    is beyond a long. Labels are summed before they are shuffled, and joined by broadcast only where they measure little."""
    rows, books = compress_vectors(table(spark, sf_dir, "embeddings"))
    sums = staged(rows.groupBy(F.col("label").alias("_label")).agg(sum_long(F.col("error")).alias("label_error")), "label-errors")
    digest = hashlib.sha256(decimal_text(books).encode()).hexdigest()
    joined = rows.join(small_side(sums), F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql(codec: Codec) -> str:
    """The rounds as one common table expression each."""
    width = codec.width
    floor_div = "(s - ((s % n) + n) % n) // n"
    ctes = [
        f"""k AS MATERIALIZED (SELECT vec_id, label, [CAST(floor({codec.scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] v FROM embeddings
  WHERE len(embedding) = {codec.dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS MATERIALIZED (SELECT vec_id, label, q, v[{width} * q + 1 : {width} * q + {width}] w FROM k, (SELECT unnest(range({codec.parts})) q))",
        f"b0 AS MATERIALIZED (SELECT q, CAST(row_number() OVER (PARTITION BY q ORDER BY vec_id, w) - 1 AS BIGINT) e, w FROM p QUALIFY e < {codec.entries})",
    ]
    for r in range(codec.rounds + 1):
        ctes.append(
            f"""a{r} AS MATERIALIZED (SELECT p.vec_id, p.label, p.q, p.w, b.e, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(p.w, b.w)])::BIGINT d
  FROM p JOIN b{r} b USING (q) QUALIFY row_number() OVER (PARTITION BY p.vec_id, p.q ORDER BY d, b.e) = 1)"""
        )
        if r < codec.rounds:
            ctes.append(
                f"""b{r + 1} AS MATERIALIZED (SELECT b.q, b.e, coalesce(m.w, b.w) w FROM b{r} b LEFT JOIN (SELECT q, e, list({floor_div} ORDER BY i) w FROM
  (SELECT q, e, i, CAST(sum(w[i]) AS BIGINT) s, count(*) n FROM a{r}, (SELECT unnest(range(1, {width + 1})) i) GROUP BY ALL) GROUP BY q, e) m USING (q, e))"""
            )
    last = codec.rounds
    return f"""WITH {", ".join(ctes)},
h AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY q, e)) codebooks_sha256 FROM b{last}),
c AS (SELECT vec_id, any_value(label) label, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY q) code, CAST(sum(d) AS BIGINT) error FROM a{last} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, h"""


OP11_SQL = _sql(Codec())
