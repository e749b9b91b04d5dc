"""A data source that writes one file a row in two phases: tasks write into a folder that readers ignore, the job's commit
renames it as a whole. A failed job lists nothing and leaves no file; a task that ran twice counts once."""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

MANIFEST = "name string, path string, bytes bigint, crc32 bigint, status string"
COLUMNS = [pa.field("name", pa.string()), pa.field("path", pa.string()), pa.field("bytes", pa.int64()), pa.field("crc32", pa.int64()), pa.field("status", pa.string())]
#: Manifest rows that a task holds before it writes them out.
ROWS_HELD = 4096


@dataclass(frozen=True)
class Task(WriterCommitMessage):
    """A finished task, by the name of its folder."""

    name: str


@dataclass(frozen=True)
class Outcome:
    """Counts of one write, gathered in the pass that writes. Exit codes as a command's: 0 if every row became a file."""

    ok: int
    error: int
    bytes: int

    @property
    def exit_code(self) -> int:
        return 1 if self.error else 0


class FileWriter(DataSourceArrowWriter):
    """Tasks write ``folder``/_job-<id>/<task>/<name> and their part of ``manifest``/_job-<id>; the commit drops what
    unfinished attempts left and renames both folders to job=<id>, the manifest last. Work of the driver grows with the
    tasks, not with the files."""

    def __init__(self, folder: str, manifest: str, overwrite: bool):
        self.folder, self.manifest, self.overwrite = folder.rstrip("/"), manifest.rstrip("/"), overwrite
        self.job = uuid.uuid4().hex

    def _places(self):
        from pyarrow import fs

        store, files = fs.FileSystem.from_uri(self.folder)
        return store, files, fs.FileSystem.from_uri(self.manifest)[1]

    def write(self, iterator) -> Task:
        store, files, lists = self._places()
        task = uuid.uuid4().hex
        own = f"{files}/_job-{self.job}/{task}"
        store.create_dir(own, recursive=True)
        store.create_dir(f"{lists}/_job-{self.job}", recursive=True)
        seen: dict[str, int] = {}
        held: list[tuple] = []
        schema = pa.schema(COLUMNS)
        with store.open_output_stream(f"{lists}/_job-{self.job}/{task}.parquet") as out, pq.ParquetWriter(out, schema) as listed:

            def flush():
                listed.write_table(pa.table([pa.array([r[k] for r in held], f.type) for k, f in enumerate(schema)], schema))
                held.clear()

            for batch in iterator:
                names, contents, states = (batch.column(batch.schema.get_field_index(c)) for c in ("name", "content", "status"))
                for k in range(batch.num_rows):
                    name, status = names[k].as_py(), states[k].as_py()
                    if status == "ok":
                        again = seen[name] = seen.get(name, -1) + 1
                        place = f"{again}/{name}" if again else name  # a name that comes again gets a folder of its own
                        if again:
                            store.create_dir(f"{own}/{again}", recursive=True)
                        content = contents[k].as_py()
                        with store.open_output_stream(f"{own}/{place}") as f:
                            f.write(content)
                        held.append((name, f"{self.folder}/job={self.job}/{task}/{place}", len(content), zlib.crc32(content), status))
                    else:
                        held.append((name, None, None, None, status))
                    if len(held) == ROWS_HELD:
                        flush()
            flush()
        return Task(task)

    def commit(self, messages) -> None:
        from pyarrow import fs

        store, files, lists = self._places()
        done = {m.name for m in messages if m is not None}
        for base in (files, lists):
            store.create_dir(f"{base}/_job-{self.job}", recursive=True)
            for found in store.get_file_info(fs.FileSelector(f"{base}/_job-{self.job}")):
                if found.base_name.removesuffix(".parquet") not in done:
                    (store.delete_dir if found.type == fs.FileType.Directory else store.delete_file)(found.path)
        older = []
        if self.overwrite:
            older = [i.path for base in (lists, files) for i in store.get_file_info(fs.FileSelector(base)) if i.base_name.startswith("job=")]
        for base in (files, lists):
            store.move(f"{base}/_job-{self.job}", f"{base}/job={self.job}")
        for path in older:
            store.delete_dir(path)

    def abort(self, messages) -> None:
        from pyarrow import fs

        store, files, lists = self._places()
        for path in (f"{files}/_job-{self.job}", f"{lists}/_job-{self.job}"):
            if store.get_file_info(path).type == fs.FileType.Directory:
                store.delete_dir(path)


class FileSink(DataSource):
    """Format ``one_file_a_row``: rows (name, content, status), options ``folder`` and ``manifest``, both URIs that every
    executor reaches, on one file system."""

    @classmethod
    def name(cls) -> str:
        return "one_file_a_row"

    def schema(self) -> str:
        return "name string, content binary, status string"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["folder"], self.options["manifest"], overwrite)


def sink_status(name: Column, content: Column) -> Column:
    """ok, or error where there is no content or no plain name: a slash, a dot or underscore in front, over 200 bytes."""
    plain = (F.octet_length(name) > 0) & (F.octet_length(name) <= 200) & ~name.contains("/") & ~name.startswith(".") & ~name.startswith("_")
    return F.when(content.isNotNull() & F.coalesce(plain, F.lit(False)), "ok").otherwise("error")


def store_files(rows: DataFrame, folder: str, manifest: str, mode: str = "append") -> Outcome:
    """Write ``content`` of each row (name, content) as a file and list all rows in ``manifest``; the counts come from the same
    pass. With mode 'overwrite' the files and lists of earlier jobs go once the new ones are there.

    Rows without a content or a plain name are listed with status 'error' and leave no file. Rows of one name all get a file,
    at different paths. No rows give a manifest without rows. Other columns are not read.
    """
    rows.sparkSession.dataSource.register(FileSink)
    told = rows.select("name", "content", sink_status(F.col("name"), F.col("content")).alias("status"))
    ok = F.col("status") == "ok"
    seen = Observation()
    size = F.when(ok, F.octet_length("content").cast("long"))
    told = told.observe(seen, F.count_if(ok).alias("ok"), F.count_if(~ok).alias("error"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
    told.write.format("one_file_a_row").option("folder", folder).option("manifest", manifest).mode(mode).save()
    return Outcome(**seen.get)


def listed_files(spark: SparkSession, manifest: str) -> DataFrame:
    """(name, path, bytes, crc32, status, job) of all committed jobs."""
    return spark.read.schema(MANIFEST + ", job string").parquet(manifest)


def stored_contents(listed: DataFrame) -> DataFrame:
    """(path, content) of listed files with status ok, opened by their tasks; no folder is listed on the driver."""

    def run(batches):
        from pyarrow import fs

        stores: dict = {}
        for batch in batches:
            for path in batch.column(0).to_pylist():
                base = path.rsplit("/", 2)[0]
                if base not in stores:
                    stores[base] = fs.FileSystem.from_uri(base)
                store, inner = stores[base]
                with store.open_input_stream(inner + path[len(base) :]) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f.read()], pa.binary())], ["path", "content"])

    return listed.where("status = 'ok'").select("path").mapInArrow(run, "path string, content binary")
