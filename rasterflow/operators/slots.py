"""Coefficient probabilities on their own dimension: 1056 slots of plane, band, context and tree node, adapted image by image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterflow.operators.entropy import adapted

#: Planes, bands, contexts and nodes of the dimension.
SHAPE = (4, 8, 3, 11)
SLOTS = 4 * 8 * 3 * 11


def slot_of(plane: Column, band: Column, context: Column, node: Column) -> Column:
    """The number of a slot; null outside the dimension."""
    inside = F.lit(True)
    for c, n in zip((plane, band, context, node), SHAPE):
        inside = inside & c.between(0, n - 1)
    return F.when(inside, ((plane * SHAPE[1] + band) * SHAPE[2] + context) * SHAPE[3] + node).cast("int")


def image_slot_counts(symbols: DataFrame) -> DataFrame:
    """(image_id, slot, n0, n1) of symbols (image_id, plane, band, context, node, bit); those outside the dimension do not count."""
    slotted = symbols.select("image_id", slot_of(*map(F.col, ("plane", "band", "context", "node"))).alias("slot"), "bit").where("slot IS NOT NULL")
    return slotted.groupBy("image_id", "slot").agg(F.count_if(F.col("bit") == 0).alias("n0"), F.count_if(F.col("bit") == 1).alias("n1"))


def slot_updates(counts: DataFrame, dimension: DataFrame, margin: float = 8.0) -> DataFrame:
    """Changed slots of each image (image_id, slot, old, p, saved) from counts and the dimension (slot, old, odds): the default
    probability of each slot and the odds, of 256, that its update flag is clear. The dimension has 1056 rows, which are
    broadcast; rows of other slots are passed over."""
    known = F.broadcast(dimension.where(F.col("slot").between(0, SLOTS - 1)).dropDuplicates(["slot"]))
    priced = counts.join(known, "slot")
    out = adapted(priced, F.col("old"), F.col("odds"), margin, keep=("image_id", "old"))
    return out.where("p <> old").select("image_id", "slot", "old", "p", "saved")


def image_tables(images: DataFrame, updates: DataFrame, dimension: DataFrame) -> DataFrame:
    """One row an image (image_id, probabilities, updates, saved): its whole table, 1056 numbers in the order of slots, defaults
    where nothing changed. images: (image_id), those without updates included."""
    defaults = dimension.where(F.col("slot").between(0, SLOTS - 1)).groupBy().agg(F.sort_array(F.collect_list(F.struct("slot", "old"))).alias("d"))  # one row
    own = updates.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "p"))).alias("m"), F.count("*").alias("updates"), F.round(F.sum("saved"), 4).alias("saved"))
    rows = images.select("image_id").join(own, "image_id", "left").crossJoin(F.broadcast(defaults))
    changed = lambda e: F.coalesce(F.try_element_at("m", e["slot"]), e["old"])
    return rows.select("image_id", F.transform("d", changed).alias("probabilities"), F.coalesce("updates", F.lit(0)).alias("updates"), F.coalesce("saved", F.lit(0.0)).alias("saved"))
