"""State by image: many bands, repeats, late bands, restarts and exported state give the counts of one pass."""

import random

import pytest

from rasterflow.streaming.band_states import band_records, band_states, exported

SYMBOLS = "image_id long, band long, slot int, bit int"


def made(seed=1, bands=150):
    r = random.Random(seed)
    return [(i, b, r.randrange(6), r.randrange(2)) for i in range(3) for b in range(bands) for _ in range(r.randint(1, 4))]


def plain(rows):
    out = {}
    for i, _, s, bit in rows:
        n = out.setdefault((i, s), [0, 0])
        n[bit] += 1
    return {k: tuple(v) for k, v in out.items()}


def counts(rows):
    return {(r.image_id, r.slot): (r.n0, r.n1) for r in rows}


def test_bands_beyond_64_and_repeats_in_one_batch(spark):
    rows = made()
    records = band_records(spark.createDataFrame([*rows, (1, None, 0, 0), (None, 3, 0, 0)], SYMBOLS))
    got = band_states(records.union(records.where("band % 3 = 0"))).collect()
    assert counts(got) == plain(rows)
    assert {(r.bands, r.repeated, r.late) for r in got} == {(150, 50, 0)}


def test_stream_restarts_and_exports(spark, tmp_path):
    """Bands arrive in files, some twice, some late; the query stops and starts between them; the rest is a batch from the export."""
    rows = made(2, 80)
    records = band_records(spark.createDataFrame(rows, SYMBOLS)).cache()
    source, check = f"file://{tmp_path}/in", f"file://{tmp_path}/check"
    latest = {}

    def keep(batch, _):
        for r in batch.collect():
            latest[(r.image_id, r.slot)] = r

    for where in ("band BETWEEN 30 AND 50", "band < 40", "band BETWEEN 45 AND 69"):
        records.where(where).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(records.schema).parquet(source)
        query = band_states(stream).writeStream.outputMode("update").option("checkpointLocation", check).foreachBatch(keep).start()
        query.processAllAvailable()
        query.stop()
    assert {k: (r.n0, r.n1) for k, r in latest.items()} == plain([x for x in rows if x[1] < 70])
    assert {(r.bands, r.repeated, r.late) for r in latest.values()} == {(70, 10 + 6, 30)}
    state = exported(spark, check)
    assert counts(state.collect()) == plain([x for x in rows if x[1] < 70]) and {tuple(r.seen) for r in state.collect()} == {tuple(range(70))}
    saved = f"file://{tmp_path}/state"
    state.write.parquet(saved)
    rest = band_states(records.where("band > 65"), spark.read.parquet(saved)).collect()
    assert counts(rest) == plain(rows) and {(r.bands, r.repeated, r.late) for r in rest} == {(80, 20, 30)}


@pytest.mark.parametrize("rows", [[], [(1, 70, 5, 1)]])
def test_few_rows(spark, rows):
    got = band_states(band_records(spark.createDataFrame(rows, SYMBOLS))).collect()
    assert [tuple(r) for r in got] == [(1, 5, 0, 1, 1, 0, 0)][: len(rows)]
