import os
import zlib

import pytest
from pyspark.sql import functions as F

from rasterflow.operators.options import Options
from rasterflow.sources import sinks
from rasterflow.streaming import bands


def test_files_and_manifest(spark, tmp_path):
    rows = [(f"f{k}.webp", bytes([k]) * k) for k in range(1, 30)] + [("none", None), ("../out", b"x"), (None, b"x"), (".hidden", b"x")]
    made = spark.createDataFrame(rows, "name string, content binary").repartition(3)
    for _ in range(2):  # a second run puts the same files in place
        listed = {r.name: r for r in sinks.write_files(made, f"file://{tmp_path}/files", f"file://{tmp_path}/manifest").collect()}
    good = {n: c for n, c in rows if n and n.startswith("f")}
    assert {n for n, r in listed.items() if r.status == "ok"} == set(good) == set(os.listdir(f"{tmp_path}/files"))
    for n, c in good.items():
        assert (tmp_path / "files" / n).read_bytes() == c and (listed[n].bytes, listed[n].crc32) == (len(c), zlib.crc32(c))
    empty = sinks.write_files(made.limit(0), f"file://{tmp_path}/files", f"file://{tmp_path}/none")
    assert empty.count() == 0


def test_options_are_checked():
    assert Options.of({"quality": 90}).quality == 90
    for wrong in ({"quality": 101}, {"alpha": "drop"}, {"skip_probability": 0}, {"speed": 1}):
        with pytest.raises(ValueError):
            Options.of(wrong)


def test_state_resumes_at_any_band(spark, tmp_path):
    rows = [(i, b, s, (i * b + s * k) % 3 % 2) for i in range(3) for b in range(6) for s in range(4) for k in range(5)]
    symbols = spark.createDataFrame(rows, "image_id long, band long, slot long, bit int")
    whole = sorted(map(tuple, bands.band_state(symbols).collect()))
    for cut in (0, 1, 3, 6):
        parts = [bands.band_state(symbols.where(F.col("band") < cut)), bands.band_state(symbols.where(F.col("band") >= cut))]
        parts[0].write.mode("overwrite").parquet(f"file://{tmp_path}/state{cut}")  # exported, then imported
        saved = spark.read.schema(parts[0].schema).parquet(f"file://{tmp_path}/state{cut}")
        assert sorted(map(tuple, bands.resumed(saved, parts[1]).collect())) == whole
    # the same by a stream that stops and goes on from its checkpoint
    for b in range(6):
        symbols.where(F.col("band") == b).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(symbols.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        query = bands.band_state(stream).writeStream.outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/check").foreachBatch(
            lambda df, _: df.write.mode("overwrite").parquet(f"file://{tmp_path}/out")
        ).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/out").collect())) == whole
