"""Band-wise statistics over arriving image rows: the resumable first pass, with state kept by Structured Streaming or
exported as rows, and the second pass that prices each band under what the first has learned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterflow.operators.blocks import macroblock_stats
from rasterflow.operators.transforms import bit_cost


def running_block_stats(pixels: DataFrame) -> DataFrame:
    """Macroblock statistics of a stream of pixels, in update mode; a restart goes on from the query's checkpoint."""
    return macroblock_stats(pixels)


def band_state(symbols: DataFrame) -> DataFrame:
    """State of each image after some bands: rows (image_id, slot, n0, n1, bands) from symbols (image_id, band, slot, bit), bands
    being the set of bands in which the slot occurs. A stream or a batch. Symbols count as they come; where bands may come
    twice, ``band_states`` tells them."""
    return symbols.groupBy("image_id", "slot").agg(F.count_if(F.col("bit") == 0).alias("n0"), F.count_if(F.col("bit") == 1).alias("n1"), F.sort_array(F.collect_set("band")).alias("bands"))


def resumed(state: DataFrame, more: DataFrame) -> DataFrame:
    """Exported state with that of further bands: the same as one pass over all of them, whatever the cut."""
    both = state.unionByName(more)
    return both.groupBy("image_id", "slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("bands")))).alias("bands"))


def learned(state: DataFrame) -> DataFrame:
    """Rows (image_id, slot, p): the probability of a zero in 256ths, 1 to 255."""
    p = F.round(256.0 * F.col("n0") / (F.col("n0") + F.col("n1"))).cast("int")
    return state.select("image_id", "slot", F.least(F.greatest(p, F.lit(1)), F.lit(255)).alias("p"))


def band_costs(symbols: DataFrame, state: DataFrame) -> DataFrame:
    """The second pass: cost of each band in 1/256 bits under the whole image's probabilities (image_id, band, cost)."""
    priced = symbols.join(learned(state), ["image_id", "slot"]).withColumn("cost", bit_cost(F.col("p"), F.col("bit")))
    return priced.groupBy("image_id", "band").agg(F.sum("cost").alias("cost"))
