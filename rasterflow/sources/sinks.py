"""A sink of one file a row, and the manifest that says which files count."""

from __future__ import annotations

import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MANIFEST = "name string, bytes bigint, crc32 bigint, status string"


def write_files(rows: DataFrame, folder: str, manifest: str) -> DataFrame:
    """Write ``content`` of each row (name, content) as ``folder``/name and return the manifest (name, bytes, crc32, status),
    which Spark's committer writes to ``manifest`` once all tasks are done: a file counts only if it is listed there.

    ``folder`` is any location that pyarrow's file systems know, reached from every executor. A file is written under another
    name and moved, so a reader never sees half of one and a repeated task puts the same bytes in its place. Rows without a
    content or a plain name are rows with status 'error' and leave no file; of rows with one name the manifest has all, the
    file the last written: give names that differ.
    """

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            out = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if content is None or not name or "/" in name or name.startswith("."):
                    out.append((name, None, None, "error"))
                    continue
                part = f"{base}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write(content)
                store.move(part, f"{base}/{name}")
                out.append((name, len(content), zlib.crc32(content), "ok"))
            types = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["name", "bytes", "crc32", "status"])

    rows.select("name", "content").mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(manifest)
    return rows.sparkSession.read.schema(MANIFEST).parquet(manifest)


def reports(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows with ``report``: the named columns as one JSON object, nulls left out."""
    return rows.withColumn("report", F.to_json(F.struct(*columns)))
