"""Integer vectors out of float ones, the first few by a key, and sums by cell: what the vector operators share.

Sums and seeds are reduced inside each task before they leave it, so a task sends a row for each cell and component, or a
few vectors, however many rows it has read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest magnitude of an integer component: squared distances of up to 128 components stay below 2 ** 63.
LIMIT = 1 << 27


def integer_rows(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the usable vectors in the column, their components floor(scale * x) as an integer matrix).

    Usable: of ``dim`` components, none null or non-finite, and none beyond ``LIMIT`` once scaled, as exact distances
    would leave 64 bits there.
    """
    at = np.flatnonzero(pc.equal(pc.list_value_length(column), dim).fill_null(False).to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        x = np.floor(flat * scale).reshape(-1, dim)
    good = (np.abs(x) <= LIMIT).all(axis=1)
    return at[good], x[good].astype(np.int64)


def squared(difference: np.ndarray) -> np.ndarray:
    """Sums of squares of the rows, exact."""
    return np.einsum("ij,ij->i", difference, difference)


def first_vectors(vectors: DataFrame, key: Column, vector_col: str, count: int, dim: int, scale: int) -> np.ndarray:
    """The ``count`` usable vectors of smallest key, ties by components, as rows of an integer matrix. Rows of null key are
    passed over. At most ``count`` rows leave a task, and reach the driver."""

    def run(batches):
        least: list = []
        for batch in batches:
            at, x = integer_rows(batch.column(1), dim, scale)
            keys = batch.column(0).take(pa.array(at)).to_pylist()
            last = least[-1][0] if len(least) == count else None
            fresh = ((k, x[i].tolist()) for i, k in enumerate(keys) if k is not None and (last is None or k <= last))
            least = heapq.nsmallest(count, [*least, *fresh])
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in least], kind), pa.array([v for _, v in least], pa.list_(pa.int64()))], ["key", "vec"])

    keyed = vectors.select(key.alias("key"), F.col(vector_col).alias("vec"))
    sql_kind = keyed.schema["key"].dataType.simpleString()
    kind = {"bigint": pa.int64(), "string": pa.string()}[sql_kind]
    rows = keyed.mapInArrow(run, f"key {sql_kind}, vec array<bigint>").orderBy("key", "vec").limit(count).collect()
    return np.array([r["vec"] for r in rows], np.int64).reshape(-1, dim)


def cell_sums(vectors: DataFrame, vector_col: str, cells: Callable[[np.ndarray], list], shape: tuple[int, int], dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sums) of shape (cells,) and (cells, width), in exact Python integers.

    cells: maps a matrix of usable vectors to pairs (cell of each row, rows to add). One row for each used cell and
    component leaves a task; Spark adds them up, and the driver gets one for each cell and component in all.
    """
    most, width = shape

    def run(batches):
        n, total = np.zeros(most, np.int64), np.zeros(shape, np.int64)
        for batch in batches:
            _, x = integer_rows(batch.column(0), dim, scale)
            for cell, rows in cells(x) if len(x) else ():
                order = np.argsort(cell, kind="stable")
                starts = np.flatnonzero(np.diff(cell[order], prepend=-1))
                n += np.bincount(cell, minlength=most)
                total[cell[order][starts]] += np.add.reduceat(rows[order], starts, axis=0)
        used = np.flatnonzero(n)
        columns = np.repeat(used, width), np.tile(np.arange(width), len(used)), np.repeat(n[used], width), total[used].ravel()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["cell", "pos", "n", "total"])

    parts = vectors.select(vector_col).mapInArrow(run, "cell long, pos long, n long, total long")
    found = parts.groupBy("cell", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    n, total = np.zeros(most, object), np.zeros(shape, object)
    for r in found:
        n[r["cell"]], total[r["cell"], r["pos"]] = r["n"], int(r["total"])
    return n, total


def means(old: np.ndarray, n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """floor(sum / count) by component; a cell without rows keeps its old components."""
    return np.array([[int(t) // int(c) for t in row] if c else list(was) for was, c, row in zip(old, n, total)], np.int64).reshape(old.shape)


def decimal_text(rows: np.ndarray) -> str:
    """The components as decimal integers, joined by commas."""
    return ",".join(map(str, rows.ravel().tolist()))


def sum_long(c: Column) -> Column:
    """The sum of longs as a long; null where it is beyond one."""
    return F.sum(c.cast("decimal(38,0)")).try_cast("bigint")


def small_side(df: DataFrame, most: int = 8 << 20) -> DataFrame:
    """df, marked for broadcast if its rows measure at most ``most`` bytes; else it is left to a sorted join, whose large
    partitions Spark splits. df is read once for this."""
    size = F.lit(16 * len(df.columns))
    for name, kind in df.dtypes:
        if kind == "string":
            size = size + F.coalesce(F.octet_length(name), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= most else df
