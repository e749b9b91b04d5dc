"""Symbol statistics, probabilities and code tables as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def symbol_counts(symbols: DataFrame) -> DataFrame:
    """(slot, bit) -> zeros and ones of each slot."""
    return symbols.groupBy("slot").agg(F.count_if(F.col("bit") == 0).alias("n0"), F.count_if(F.col("bit") == 1).alias("n1"))


def adapted(counts: DataFrame, old: Column, update: Column, margin: float = 8.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """counts with p and the bits it saves; p stays ``old`` below 16 symbols, or unless the saving beats the flag's own cost
    (update: the odds, of 256, that the flag is clear) and ``margin``. keep: further columns of counts."""
    n0, n1 = F.col("n0"), F.col("n1")
    p = F.least(F.greatest(F.round(256 * n0 / (n0 + n1)), F.lit(8)), F.lit(247)).cast("int")
    bits = lambda q: -(n0 * F.log2(q / 256) + n1 * F.log2(1 - q / 256))
    save = F.round(bits(old) - bits(p), 6)
    flag = -F.log2(1 - update / 256) + 8 + F.log2(update / 256)
    take = (n0 + n1 >= 16) & (save > flag + margin)
    return counts.select(*keep, "slot", "n0", "n1", F.when(take, p).otherwise(old).cast("int").alias("p"), F.when(take, save).otherwise(F.lit(0.0)).alias("saved"))


def skip_probability(blocks: DataFrame, has: Column) -> DataFrame:
    """Per image: the share of blocks with coefficients in 256ths, 1 to 255."""
    return blocks.groupBy("image_id").agg(F.least(F.greatest(F.round(256 * F.count_if(has) / F.count("*")), F.lit(1)), F.lit(255)).cast("int").alias("skip_prob"))


def canonical_codes(lengths: DataFrame) -> DataFrame:
    """(symbol, length), lengths 1 to 15 of a complete or sparse code -> code, and its bits in reverse as a string.

    The alphabet is small by nature (at most a few hundred symbols), so one window over it is no bottleneck.
    """
    counts = lengths.groupBy("length").agg(F.count("*").alias("k"))
    other = counts.select(F.col("length").alias("shorter"), "k")
    first = counts.select("length").join(F.broadcast(other), F.col("shorter") < F.col("length"), "left")
    first = first.groupBy("length").agg(F.coalesce(F.sum(F.expr("k * shiftleft(1L, length - shorter)")), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("length").orderBy("symbol")) - 1
    coded = lengths.join(F.broadcast(first), "length").withColumn("code", F.col("first") + rank)
    return coded.select("symbol", "length", "code", F.expr("reverse(lpad(bin(code), length, '0'))").alias("reversed"))


def runs(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Gaps and islands: (key, run, value, length) of equal values that follow each other."""
    w = Window.partitionBy(key).orderBy(order)
    marked = rows.withColumn("_new", F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1))
    return marked.withColumn("run", F.sum("_new").over(w)).groupBy(key, "run", value).agg(F.count("*").alias("length"))


def prefix_codes(values: DataFrame, value: str = "value") -> DataFrame:
    """Rows with prefix code, number of extra bits, extra bits, and status: a range join to 40 segments.

    The format codes 1 to 1,048,576; other values and nulls are rows with null codes and status 'error'.
    """
    segments = [(p, 0, p + 1, p + 1) for p in range(4)] + [(p, (p - 2) >> 1, o + 1, o + (1 << ((p - 2) >> 1))) for p in range(4, 40) for o in [(2 + (p & 1)) << ((p - 2) >> 1)]]
    table = F.broadcast(values.sparkSession.createDataFrame(segments, "prefix int, extra_bits int, low long, high long"))
    v = F.col(value)
    found = values.join(table, (v >= F.col("low")) & (v <= F.col("high")), "left")
    return found.select(*values.columns, "prefix", "extra_bits", (v - F.col("low")).alias("extra"), F.when(F.col("prefix").isNull(), "error").otherwise("ok").alias("status"))


def code_length_tokens(runs: DataFrame) -> DataFrame:
    """Runs (key, run, value, length) of code lengths as tokens (key, run, k, token, extra, bits) of their wire form.

    Zeros: 18 for 11 to 138 of them, 17 for 3 to 10, else one by one. Others: the length itself, then 16 for 3 to 6 more,
    else one by one. Each run is split by arithmetic and exploded; nothing walks the rows.
    """
    n = F.col("length")
    long_n = F.floor(F.when(n >= 11, (n - 11) / 138 + 1).otherwise(0))
    # 138 at a time while 11 or more are left, then 10 at a time while 3 or more are left
    rest = F.when(n >= 11, F.greatest(n - 138 * long_n, F.lit(0))).otherwise(n)
    mid_n = F.when(rest >= 3, F.lit(1)).otherwise(F.lit(0))
    singles = F.when(mid_n == 1, F.greatest(rest - 10, F.lit(0))).otherwise(rest)
    token = lambda t, e, b: F.struct(t.cast("int").alias("token"), e.cast("int").alias("extra"), F.lit(b).alias("bits"))
    many = lambda count, f: F.when(count > 0, F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), f)).otherwise(F.array().cast("array<struct<token:int,extra:int,bits:int>>"))
    zeros = F.concat(
        many(long_n, lambda i: token(F.lit(18), F.least(n - 138 * i, F.lit(138)) - 11, 7)),
        many(mid_n, lambda i: token(F.lit(17), F.least(rest, F.lit(10)) - 3, 3)),
        many(singles, lambda i: token(F.lit(0), F.lit(0), 0)),
    )
    more = n - 1
    again_n = F.floor(F.when(more >= 3, (more - 3) / 6 + 1).otherwise(0))
    left = F.greatest(more - 6 * again_n, F.lit(0))
    others = F.concat(
        many(F.lit(1), lambda i: token(F.col("value"), F.lit(0), 0)),
        many(again_n, lambda i: token(F.lit(16), F.least(more - 6 * i, F.lit(6)) - 3, 2)),
        many(left, lambda i: token(F.col("value"), F.lit(0), 0)),
    )
    return runs.select("key", "run", F.posexplode(F.when(F.col("value") == 0, zeros).otherwise(others)).alias("k", "t")).select("key", "run", "k", "t.token", "t.extra", "t.bits")


def probability_updates(adapted_: DataFrame, old: Column) -> DataFrame:
    """One row: how many slots changed their probability, and the bits that they save together."""
    return adapted_.agg(F.count_if(F.col("p") != old).alias("updates"), F.round(F.sum("saved"), 4).alias("saved"))
