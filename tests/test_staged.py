"""Padded planes against a plain walk, staged sets read by bands, the two-phase file sink."""

import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from rasterflow.operators.planes import padded_planes
from rasterflow.sources import file_sink, staged

SCHEMA = "image_id long, y long, x long, r long, g long, b long, a long"
SIZES = {1: (1, 1), 2: (16, 16), 3: (17, 33), 4: (15, 2), 5: (5, 34), 6: (32, 31)}


def images():
    rng = random.Random(5)
    return {i: [[tuple(rng.choice((0, 255, rng.randrange(256))) for _ in range(3)) + ((255,) if i % 2 else (rng.randrange(256),)) for _ in range(w)] for _ in range(h)] for i, (w, h) in SIZES.items()}


def walked(image):
    """Planes of one image, a sample at a time."""
    h, w = len(image), len(image[0])
    hp, wp = -(-h // 16) * 16, -(-w // 16) * 16
    at = lambda y, x: image[min(y, h - 1)][min(x, w - 1)]
    out = {("y", y): bytes((16839 * p[0] + 33059 * p[1] + 6420 * p[2] + 1081344) >> 16 for p in (at(y, x) for x in range(wp))) for y in range(hp)}
    for name, k in (("u", (-9719, -19081, 28800)), ("v", (28800, -24116, -4684))):
        for y in range(hp // 2):
            line = []
            for x in range(wp // 2):
                x = min(x, (w - 1) // 2)
                total = sum(sum(f * c for f, c in zip(k, at(2 * y + dy, 2 * x + dx))) for dy in (0, 1) for dx in (0, 1))
                line.append(min(max((((total + 2) >> 2) + (128 << 16) + 32768) >> 16, 0), 255))
            out[name, y] = bytes(line)
    if any(p[3] < 255 for row in image for p in row):
        out |= {("a", y): bytes(p[3] for p in row) for y, row in enumerate(image)}
    return out


@pytest.fixture(scope="module")
def px(spark):
    rows = [(i, y, x, *p) for i, image in images().items() for y, row in enumerate(image) for x, p in enumerate(row)]
    rows += [(7, 0, 0, 1, 2, 3, 255), (7, 0, 2, 1, 2, 3, 255)]  # a pixel is missing
    rows += [(8, 0, 0, 1, None, 3, 255), (9, 0, 0, 1, 2, 3, 255), (9, 0, 0, 1, 2, 3, 255)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "x")


def test_padded_planes(spark, px):
    rows, facts = padded_planes(px)
    got = {i: {} for i in SIZES}
    for r in rows.collect():
        assert (r.plane, r.row) not in got[r.image_id]
        got[r.image_id][r.plane, r.row] = bytes(r.samples)
    assert got == {i: walked(image) for i, image in images().items()}
    told = {r.image_id: r for r in facts.collect()}
    assert {i: (r.w, r.h) for i, r in told.items() if r.status == "ok"} == SIZES and all(told[i].status == "gaps" for i in (7, 8, 9))
    empty, none = padded_planes(px.limit(0))
    assert empty.count() == none.count() == 0


def test_staged_bands_meet_their_facts_without_a_shuffle(spark, px, tmp_path):
    profiles = spark.createDataFrame([(2, b"icc"), (3, None), (4, b"")], "image_id long, profile binary")
    for _ in range(2):  # a second run replaces the set
        staged.stage_images(px, "set_of_a_test", f"file://{tmp_path}/sets", 3, profiles)
    band = staged.staged_band(spark, "set_of_a_test", 1, 1)
    plan = band._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "row,16" in re.sub(r"\s", "", plan) and "PushedFilters" in band._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    made = {i: walked(image) for i, image in images().items()}
    got = {}
    for r in band.collect():
        got.setdefault((r.image_id, r.status), []).append((r.plane, r.row, r.samples and bytes(r.samples)))
    for i, (_, h) in SIZES.items():
        if h <= 16:
            assert got[i, "short"] == [(None, None, None)]
            continue
        wanted = [(p, y, d) for (p, y), d in made[i].items() if (p == "y" and 16 <= y < 32) or (p in "uv" and 8 <= y < 16)]
        assert sorted(got[i, "ok"]) == sorted(wanted)
    assert all(got[i, "gaps"] == [(None, None, None)] for i in (7, 8, 9))
    extras = staged.staged_extras(spark, "set_of_a_test")
    assert "Exchange" not in extras._jdf.queryExecution().executedPlan().toString()
    told = {r.image_id: (r.profile and bytes(r.profile), r.alpha_rows) for r in extras.collect()}
    assert told == {i: (b"icc" if i == 2 else None, SIZES[i][1] if i in SIZES and ("a", 0) in made[i] else 0) for i in [*SIZES, 7, 8, 9]}


def sink_rows(spark):
    rows = [(f"f{k % 20}", bytes([k]) * k) for k in range(40)] + [("none", None), ("../out", b"x"), (None, b"x"), (".hidden", b"x"), ("_x", b"x"), ("", b"x"), ("n" * 201, b"x")]
    return rows, spark.createDataFrame(rows, "name string, content binary").withColumn("path", F.lit("clash")).repartition(3)


def test_files_are_listed_counted_and_read_back(spark, tmp_path):
    rows, made = sink_rows(spark)
    files, manifest = f"file://{tmp_path}/files", f"file://{tmp_path}/manifest"
    outcome = file_sink.store_files(made, files, manifest)
    good = [(n, c) for n, c in rows if c is not None and n and n.startswith("f")]
    assert outcome == file_sink.Outcome(len(good), len(rows) - len(good), sum(len(c) for _, c in good)) and outcome.exit_code == 1
    listed = file_sink.listed_files(spark, manifest)
    told = {r.path: r for r in listed.where("status = 'ok'").collect()}
    assert len(told) == len(good) and listed.where("status = 'error'").count() == outcome.error  # rows of one name have paths of their own
    got = {r.path: bytes(r.content) for r in file_sink.stored_contents(listed).collect()}
    assert sorted((told[p].name, c) for p, c in got.items()) == sorted(good)
    assert all(told[p].bytes == len(c) and told[p].crc32 == zlib.crc32(c) for p, c in got.items())
    assert file_sink.store_files(made, files, manifest).ok == len(good) and listed_count(spark, manifest) == 2 * len(rows)
    only = file_sink.store_files(made.where("name = 'f1'"), files, manifest, "overwrite")
    assert only == file_sink.Outcome(2, 0, 22) and only.exit_code == 0 and listed_count(spark, manifest) == 2
    assert sum(len(f) for _, _, f in os.walk(tmp_path / "files")) == 2
    assert file_sink.store_files(made.limit(0), files, manifest, "overwrite") == file_sink.Outcome(0, 0, 0) and listed_count(spark, manifest) == 0


def listed_count(spark, manifest):
    return file_sink.listed_files(spark, manifest).count()


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    _, made = sink_rows(spark)
    files, manifest = f"file://{tmp_path}/files", f"file://{tmp_path}/manifest"
    file_sink.store_files(made, files, manifest)
    before = listed_count(spark, manifest)
    n = sum(len(f) for _, _, f in os.walk(tmp_path))
    broken = made.withColumn("content", F.when(F.col("name") == "f7", F.raise_error("stop").cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="stop"):
        file_sink.store_files(broken, files, manifest)
    assert listed_count(spark, manifest) == before and sum(len(f) for _, _, f in os.walk(tmp_path)) == n
    assert not [d for base in ("files", "manifest") for d in os.listdir(tmp_path / base) if d.startswith("_")]


def test_the_commit_drops_attempts_that_did_not_end(tmp_path):
    writer = file_sink.FileWriter(f"file://{tmp_path}/files", f"file://{tmp_path}/manifest", False)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"name": ["a"], "content": [b"x"], "status": ["ok"]})
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch]))  # the same task twice, one told
    writer.commit([kept, None])
    assert os.listdir(tmp_path / "files" / f"job={writer.job}") == [kept.name] and lost.name != kept.name
    assert os.listdir(tmp_path / "manifest" / f"job={writer.job}") == [f"{kept.name}.parquet"]
