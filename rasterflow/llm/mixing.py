"""Mixing sources to target weights: systematic sampling.

Weights share out a budget over the sources, none above a multiple of its own size. A source's rate, target over size, is
the expected number of copies of each of its documents. Documents of a source stand in order of size, largest first;
expected copies are summed along that order from one random offset, and a document is emitted once for each integer
that the sum crosses in it. As sizes fall along the order, what a source takes is off its target by less than one
document, its largest, whatever the offset; and a document is taken floor(rate) or ceil(rate) times.

Numbering. Rows are sorted by range over all tasks, each row keeps its task and its place there, and the tasks' counts,
one number for each task, put the ranges end to end. A source of a third of all rows is many ranges, equal keys included,
as the row's own number is the last key.

Budget. The share of a source is min(most * size, level * weight) for the level at which shares meet the budget, found by
rounds that fix the sources which the level puts above their limit; each round is one sum over the table of sources.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterflow.llm.common import staged, table, unstage
from rasterflow.llm.vectors import small_side

#: Expected copies are counted in units of 2 ** -UNIT_BITS, so that sums are exact for 2 ** 39 documents a source.
UNIT_BITS = 22


@dataclass(frozen=True)
class Mix:
    """weights repeat over the sources in order; share of all sizes that the mix takes; most copies of a source; seed."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most: int = 2
    seed: str = "mix"

    def __post_init__(self):
        if not self.weights or min(self.weights) <= 0 or not 0 <= self.share <= self.most:
            raise ValueError("weights are positive, and the share at most the limit")


def word_count(text: Column) -> Column:
    """Number of runs of [^\\x20\\x09-\\x0D] in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def in_order(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """df, as a written table, with ``place``: its number from 0 in the order of keys, over all rows."""
    own = F.monotonically_increasing_id()  # task and place in the task, of the sorted rows
    sorted_rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = staged(sorted_rows.select("*", F.shiftright(own, 33).alias("_task"), own.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), name)
    before, starts = 0, []
    for r in placed.groupBy("_task").count().orderBy("_task").collect():  # one row for each task
        starts.append((r["_task"], before))
        before += r["count"]
    starts = df.sparkSession.createDataFrame(starts, "_task long, _start long")
    return placed.join(F.broadcast(starts), "_task").withColumn("place", F.col("_start") + F.col("_at")).drop("_task", "_at", "_start")


def targets(sources: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """sources (source_size, place and more) with ``target``.

    A source's weight is that of its place, repeating. Sources without words, and all of them where there are no words,
    have target 0.
    """
    weights = F.array(*map(F.lit, mix.weights))
    rows = sources.withColumn("_weight", F.get(weights, F.pmod("place", F.lit(len(mix.weights))).cast("int")))
    limit = mix.most * F.col("source_size")
    total = rows.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    level = 0.0
    while True:
        over = level * F.col("_weight") > limit
        free, fixed = rows.agg(F.sum(F.when(~over, F.col("_weight"))), F.sum(F.when(over, limit))).first()
        after = (mix.share * total - (fixed or 0)) / free if free else level
        if after <= level:
            break
        level = after
    return rows.withColumn("target", F.least(limit.cast("double"), F.lit(level) * F.col("_weight"))).drop("_weight")


def mix_sources(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", sizes: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target and copies.

    A null or blank text has size 0 and is taken like any other document of its source. Null sources are one source, the
    last one; null ids come last in their source; repeated rows are documents of their own, and which of equal rows gets
    a copy more cannot be told. No rows in, no rows out. Other columns are not read. The offset of a source is a hash of
    the seed and its name, so the same rows give the same mix, however they are dealt. sizes: a column of sizes of the
    caller's own, in place of words.
    """
    size = F.coalesce(sizes.cast("long"), F.lit(0)) if sizes is not None else word_count(F.col(text_col))
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.monotonically_increasing_id().alias("_row"))
    order = [F.col("source").asc_nulls_last(), F.col("size").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row")]
    unsorted = staged(sized, "sizes")
    rows = in_order(unsorted, order, "sized")
    unstage(unsorted)
    sums = staged(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("place").alias("_first")), "sources")
    found = targets(in_order(sums, [F.col("source").asc_nulls_last()], "sources"), mix)
    # a unit more than the rate would let a document pass its limit; the rate is rounded down
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * (1 << UNIT_BITS))).otherwise(0)
    offset = F.conv(F.substring(F.sha2(F.concat(F.lit(mix.seed), F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), "source"))), 256), 1, 5), 16, 10).cast("long")
    facts = staged(found.select(F.col("source").alias("_source"), "source_size", "target", "_first", rate.cast("long").alias("_rate"), F.shiftleft(offset, UNIT_BITS - 20).alias("_offset")), "targets")
    joined = rows.join(small_side(facts), F.col("source").eqNullSafe(F.col("_source")))
    crossed = lambda n: F.shiftright(F.col("_offset") + n * F.col("_rate"), UNIT_BITS)
    before = F.col("place") - F.col("_first")
    return joined.select("doc_id", "source", "size", "source_size", "target", (crossed(before + 1) - crossed(before)).alias("copies"))


def mixed_documents(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", **columns) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, with ``copy`` from 1. For ids that tell rows apart."""
    taken = mix_sources(docs, mix, id_col, **columns).where("copies > 0").select(F.col("doc_id").alias("_id"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return docs.drop("copy").join(taken, F.col(id_col) == F.col("_id")).drop("_id")


def op13(spark, sf_dir):
    """The mix of all documents: what each is taken for, with its source's size and target."""
    found = mix_sources(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] w FROM d GROUP BY source),
o AS (SELECT *, source_size / w AS bend, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) k FROM s),
f AS (SELECT *, 1.5e0 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
      sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM o),
l AS (SELECT CAST(rest AS DOUBLE) / CAST(free AS DOUBLE) AS level FROM f WHERE rest / free <= 2 * bend ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, least(2e0 * source_size, level * w) AS target,
      CAST(concat('0x', substr(sha256('mix' || CASE WHEN source IS NULL THEN '' ELSE ':' || source END), 1, 5)) AS BIGINT) * 4 AS offs FROM s, l),
n AS (SELECT d.*, t.source_size, t.target, t.offs, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size * 4194304) AS BIGINT) ELSE 0 END rate,
      row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.doc_id NULLS LAST) i FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (((offs + i * rate) >> 22) - ((offs + (i - 1) * rate) >> 22)) AS BIGINT) AS taken FROM n
"""
