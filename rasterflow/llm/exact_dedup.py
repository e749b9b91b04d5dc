"""Exact dedup [native]: tree-merge of sorted digest runs.

Every input partition is one run: its distinct digests, sorted, each with the row that would stay and a count. Runs are
exchanged in binomial rounds: ``FAN`` partners, whose places differ in one group of bits, each send a partner that part of
their run whose digests have the partner's bits there, and every place merges the ``FAN`` sorted parts that it receives into
one run. The entry of the smallest rank stays at each merge. After the last round a place holds all entries of its digests.
A digest of a third of all rows has at most ``FAN`` entries in any merge, and a place is dealt over several tasks by further
bits of its digests. The outcome travels back down the same tree, so rows never meet their winner by digest alone.

Texts are not shuffled for this. To verify that equal digests are equal texts, each task takes the least and the greatest
normalised text of every digest that repeats, and the least and greatest of these are compared: a class passes only if all
its texts are one. Where digests clash, the merge runs again with the clashing digests followed by their texts, so that each
text is a class of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterflow.llm.common import SPACE_CLASS, pinned, staged, unstage, whole_text

KEY = ("digest", "check", "size")
#: Bits of a place that one round exchanges, and how many tasks share a place.
BITS, SLICES = 4, 8
FAN = 1 << BITS
#: Bits of the prefilter of texts to verify: one megabyte, whatever the corpus.
FILTER_BITS = 1 << 23


def strong(bare: Column) -> tuple[Column, Column]:
    """SHA-256 and a second hash of a normalised text."""
    return F.unhex(F.sha2(bare, 256)), F.xxhash64(bare)


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, hashes: Callable = strong, *carried: str) -> DataFrame:
    """One row per document: run (its input partition), a row number (row_col, or a new one), id, code points, and the digest key.

    The key is the SHA-256 of the normalised text, a second hash and its length: entries merge only when all three agree.
    """
    text = whole_text(text_col)
    bare = F.regexp_replace(text, SPACE_CLASS + "+", "")
    digest, check = hashes(bare)
    return docs.select(
        F.spark_partition_id().alias("run"),
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"),
        F.col(id_col).cast("long").alias("id"),
        F.length(text).alias("points"),
        digest.alias("digest"),
        check.alias("check"),
        F.octet_length(bare).alias("size"),
        *carried,
    )


def rows_apart(docs: DataFrame, clashes: DataFrame, id_col: str, text_col: str, row_col: str | None, hashes: Callable) -> DataFrame:
    """digest_rows, the digests of ``clashes`` (digest, check, size) followed by the text itself."""
    bare = F.regexp_replace(whole_text(text_col), SPACE_CLASS + "+", "")
    rows = digest_rows(docs.withColumn("_bare", bare), id_col, text_col, row_col, hashes, "_bare")
    marked = rows.join(clashes.select(*KEY, F.lit(True).alias("clash")), [*KEY], "left")
    return marked.withColumn("digest", F.when(F.col("clash"), F.concat("digest", F.encode("_bare", "utf-8"))).otherwise(F.col("digest"))).drop("clash", "_bare")


def place_at(level: int) -> Column:
    """The place of an entry after ``level`` rounds: its run, the lower bits put as its digest's."""
    low = BITS * level
    if low == 0:
        return F.col("run").cast("long")
    return F.shiftleft(F.shiftright(F.col("run").cast("long"), low), low) + F.pmod("check", F.lit(1 << low))


def exchanged(entries: DataFrame, level: int) -> DataFrame:
    """One round: entries go to their places after ``level`` rounds, where the sorted parts that meet are merged."""
    at = entries.withColumn("place", place_at(level)).withColumn("slice", F.pmod(F.shiftright("check", 40), F.lit(SLICES)))
    runs = at.repartition("place", "slice").sortWithinPartitions("place", "slice", *KEY)
    return runs.groupBy("place", "slice", *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"), F.min("run").alias("run"))


def clashing(docs: DataFrame, text_col: str, repeated: DataFrame, hashes: Callable = strong) -> DataFrame:
    """The keys (digest, check, size) whose texts differ, of those with a ``check`` among the repeated ones. Only the least and
    greatest text of a key leave a task; a bitmap of fixed size spares most other texts the join."""
    byte = 1 << 15
    bit = lambda c: F.pmod(c, F.lit(FILTER_BITS))
    bitmap = repeated.select(bit("check").alias("h")).groupBy(F.expr(f"h DIV {byte}").alias("part")).agg(F.bitmap_construct_agg(F.pmod("h", F.lit(byte))).alias("bits"))
    bare = docs.select(pinned(F.regexp_replace(whole_text(text_col), SPACE_CLASS + "+", "")).alias("bare"))
    digest, check = hashes(F.col("bare"))
    marked = bare.withColumn("check", check).withColumn("h", bit(F.col("check"))).join(F.broadcast(bitmap), F.expr(f"h DIV {byte}") == F.col("part"))
    hit = F.conv(F.hex(F.expr(f"substring(bits, CAST(pmod(h, {byte}) DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    near = marked.where(hit.bitwiseAND(F.expr("shiftleft(1, CAST(pmod(h, 8) AS INT))")) != 0)
    keyed = near.select(digest.alias("digest"), "check", F.octet_length("bare").alias("size"), "bare")
    ends = keyed.groupBy(*KEY).agg(F.min("bare").alias("least"), F.max("bare").alias("most"))
    return ends.where("least <> most").select(*KEY)


def verify(docs: DataFrame, text_col: str, repeated: DataFrame) -> None:
    """End with an error if texts of one repeated key differ."""
    if not clashing(docs, text_col, repeated).isEmpty():
        raise ValueError("texts of equal digests differ")


def merged(rows: DataFrame) -> tuple[list[DataFrame], int]:
    """The runs after each round, and the number of rounds."""
    first = rows.select("run", *KEY, F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("z"), "id", "row").alias("best"), F.lit(1).cast("long").alias("n"))
    levels = [staged(exchanged(first, 0), "runs")]
    runs = 1 + (levels[0].agg(F.max("run")).first()[0] or 0)
    rounds = -(-(runs - 1).bit_length() // BITS)
    for level in range(1, rounds + 1):
        levels.append(staged(exchanged(levels[-1], level), "runs"))
    return levels, rounds


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, hashes: Callable = strong) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, and row (the input row's own number).

    Texts are equal when identical after deleting every character of [\\x20\\x09-\\x0D]. The row with the most code
    points stays, then the smallest id (a null id comes last), then the first row. Null texts count as empty, so they
    form one group with texts of white space alone. ``hashes`` makes the digest, whose first 32 bytes are shown, and the second
    hash; texts that share both and their length are told apart. Repeated rows, ids too, are told apart by ``row``: one is kept.
    No rows in, no rows out. Other columns of ``docs`` are not read. The result is a written table.
    """
    rows = staged(digest_rows(docs, id_col, text_col, row_col, hashes), "digests")
    levels, rounds = merged(rows)
    clashes = staged(clashing(docs, text_col, levels[-1].where("n > 1").select("check"), hashes), "clashes")
    if not clashes.isEmpty():
        unstage(rows, *levels)
        rows = staged(rows_apart(docs, clashes, id_col, text_col, row_col, hashes), "digests")
        levels, rounds = merged(rows)
    unstage(clashes)
    found = levels[-1].select("place", *KEY, "best", "n")
    for level in range(rounds, 0, -1):
        child = levels[level - 1].select(F.col("place").alias("below"), place_at(level).alias("place"), *KEY)
        found = child.join(found, ["place", *KEY]).select(F.col("below").alias("place"), *KEY, "best", "n")
    out = rows.withColumn("place", F.col("run").cast("long")).join(found, ["place", *KEY]).select(
        F.col("id"),
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex(F.substring("digest", 1, 32))).alias("text_sha256"),
        "row",
    )
    out = staged(out, "classes")
    unstage(rows, *levels)
    return out


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops; all columns stay.

    Where ids tell rows apart, the ids that go are taken out of docs. Where an id repeats or is null, rows are numbered
    and staged first, so that repeated rows, ids too, leave exactly one.
    """
    if not docs.groupBy(F.col(id_col).alias("_id")).count().where("count > 1 OR _id IS NULL").isEmpty():
        numbered = staged(docs.withColumn("_row_number", F.monotonically_increasing_id()), "numbered")
        kept = exact_dedup(numbered, id_col, text_col, row_col="_row_number").where("kept").select(F.col("row").alias("_row_number"))
        return numbered.join(kept, "_row_number", "left_semi").select(*docs.columns)
    gone = exact_dedup(docs, id_col, text_col).where("NOT kept").select(F.col("id").alias("_gone"))
    return docs.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")


def op6(spark, sf_dir):
    """Every row of documents: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).withColumnRenamed("id", "doc_id").drop("row")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) p, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY p DESC, doc_id)
"""
