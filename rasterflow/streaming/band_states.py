"""Counts of arriving bands with state by image: each band counts once, whenever it arrives and however often.

A band is one row: its image, its number and its symbol counts by slot. State of an image is a map of the bands seen, a map
of counts by slot, and totals, so bands of any number are told apart, a repeat changes nothing but the number of repeats,
and a band that comes after a later one is counted and told as late. State lives in Spark's state store: a stream goes on
from its checkpoint, a batch from exported rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of an image's state: one for each slot; of an image without any symbol, one of null slot.
STATES = "image_id long, slot int, n0 long, n1 long, bands long, repeated long, late long"


def band_records(symbols: DataFrame) -> DataFrame:
    """One row a band (image_id, band, slots, n0, n1) of symbols (image_id, band, slot, bit), its counts as arrays by slot.
    Counts are reduced before they are shuffled; a band has at most as many entries as there are slots. Null bands go."""
    counts = symbols.where("band IS NOT NULL AND image_id IS NOT NULL").groupBy("image_id", "band", "slot").agg(F.count_if(F.col("bit") == 0).alias("n0"), F.count_if(F.col("bit") == 1).alias("n1"))
    lists = counts.groupBy("image_id", "band").agg(F.sort_array(F.collect_list(F.struct("slot", "n0", "n1"))).alias("s"))
    return lists.select(F.col("image_id").cast("long").alias("image_id"), F.col("band").cast("long").alias("band"), F.col("s.slot").alias("slots"), F.col("s.n0").alias("n0"), F.col("s.n1").alias("n1"))


class BandCounter(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "band long", "times long")
        self.counts = handle.getMapState("counts", "slot int", "n0 long, n1 long")
        self.totals = handle.getValueState("totals", "bands long, repeated long, late long, highest long")

    def handleInitialState(self, key, initial: pd.DataFrame, timers) -> None:
        """Exported rows: counts by slot and the bands seen, which every row repeats."""
        for row in initial.itertuples():
            if row.slot is not None and not pd.isna(row.slot):
                self.counts.updateValue((int(row.slot),), (int(row.n0), int(row.n1)))
        first = initial.iloc[0]
        for band in first.seen:
            self.seen.updateValue((int(band),), (1,))
        self.totals.update((len(first.seen), int(first.repeated), int(first.late), int(max(first.seen, default=-1))))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        bands, repeated, late, highest = map(int, self.totals.get() or (0, 0, 0, -1))
        fresh: dict = {}
        for frame in rows:
            for band, slots, zeros, ones in frame.sort_values("band")[["band", "slots", "n0", "n1"]].itertuples(index=False):
                if self.seen.containsKey((int(band),)):
                    repeated += 1
                    continue
                self.seen.updateValue((int(band),), (1,))
                bands, late, highest = bands + 1, late + (band < highest), max(highest, int(band))
                for slot, n0, n1 in zip(slots, zeros, ones):
                    had = fresh.get(slot, (0, 0))
                    fresh[slot] = (had[0] + int(n0), had[1] + int(n1))
        self.totals.update((bands, repeated, late, highest))
        for slot, (n0, n1) in fresh.items():
            had = self.counts.getValue((int(slot),)) or (0, 0)
            self.counts.updateValue((int(slot),), (int(had[0]) + n0, int(had[1]) + n1))
        out = [(key[0], k[0], v[0], v[1], bands, repeated, late) for k, v in self.counts.iterator()] or [(key[0], None, 0, 0, bands, repeated, late)]
        yield pd.DataFrame(out, columns=["image_id", "slot", "n0", "n1", "bands", "repeated", "late"]).astype({"slot": "Int32"})

    def close(self) -> None:
        pass


def band_states(records: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """State of each image that gets bands (image_id, slot, n0, n1, bands, repeated, late), after each batch, from rows of
    ``band_records``; of a stream, in update mode.

    before: rows of ``exported`` to go on from; images without new bands keep theirs there. A null slot means an image
    without symbols. No rows in, no rows out. The state store that maps need is set for the session.
    """
    spark = records.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.streams.active  # noqa: B018  starts the coordinator of state stores, which a batch needs too
    initial = None if before is None else before.groupBy("image_id")
    return records.groupBy("image_id").transformWithStateInPandas(BandCounter(), STATES, "Update", "None", initial)


def exported(spark: SparkSession, checkpoint: str) -> DataFrame:
    """State of a stopped stream as rows (image_id, slot, n0, n1, seen, repeated, late), read from its checkpoint."""
    read = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    image = F.col("key.image_id").alias("image_id")
    seen = read("seen").select(image, F.col("user_map_key.band").alias("band")).groupBy("image_id").agg(F.sort_array(F.collect_list("band")).alias("seen"))
    counts = read("counts").select(image, F.col("user_map_key.slot").alias("slot"), "user_map_value.n0", "user_map_value.n1")
    totals = read("totals").select(image, "value.repeated", "value.late")
    return totals.join(seen, "image_id").join(counts, "image_id", "left").select("image_id", "slot", "n0", "n1", "seen", "repeated", "late")
