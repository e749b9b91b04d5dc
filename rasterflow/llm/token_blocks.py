"""Token-ID / binary output: fixed-width bit packing in blocks.

Ids are stored in the least number of bits that the vocabulary needs, least significant bit first, one after another:
the id at place p of a block begins at bit p * bits, so any range is found by arithmetic and unpacked with numpy.

A file set is a folder of block rows, in ascending order of ids: (shard, block, first, n_ids, doc_ids, doc_starts,
payload). A shard is one range of document ids, written by one task; a block holds whole documents and closes at
``BLOCK_IDS`` ids or more; first counts the shard's ids before the block; doc_starts are places in the block. Spark's
writer commits the files, so a lost task leaves none behind, and any store that Spark reads will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterflow.llm.common import staged, table, whole_text
from rasterflow.llm.words import byte_bpe, encode_texts, slices

MAGIC = b"RFB1"
BLOCK_IDS = 1 << 16
#: Most text bytes of a shard on average: one task sorts and writes it.
SHARD_BYTES = 128 << 20
BLOCK_SCHEMA = "shard int, block int, first long, n_ids int, doc_ids array<bigint>, doc_starts array<int>, payload binary"


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Header (magic, bits as one byte) and the packed ids."""
    if bits in (8, 16, 32):
        body = ids.astype(f"<u{bits // 8}").tobytes()
    else:
        spread = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        body = np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()
    return MAGIC + bytes([bits]) + body


def unpack(payload: bytes, start: int, count: int) -> np.ndarray:
    """``count`` ids from place ``start`` of a block, reading only their bytes."""
    if payload[:4] != MAGIC:
        raise ValueError("not a block of packed ids")
    bits = payload[4]
    body = memoryview(payload)[5:]
    if bits in (8, 16, 32):
        return np.frombuffer(body, f"<u{bits // 8}", count, start * bits // 8).astype(np.uint32)
    low, high = start * bits, (start + count) * bits
    got = np.unpackbits(np.frombuffer(body[low // 8 : -(-high // 8)], np.uint8), bitorder="little")
    got = got[low % 8 : low % 8 + high - low].reshape(count, bits)
    return (got.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


def token_blocks(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Block rows of the ids of all texts in ascending id order, ``end_id`` after each text.

    Null ids come first. Null and empty texts give the end id alone. Rows of equal id follow each other, by text. No
    documents, no blocks. Only the two columns are read.
    """
    spark = docs.sparkSession
    bits = bits_for(vocabulary)
    if parts is None:
        total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner, first, whole = byte_bpe(tokenizer, True)
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        names: list = []
        held: list[np.ndarray] = []
        sizes: list[int] = []
        filled = 0

        def close():
            nonlocal block, before, names, held, sizes, filled
            ids = np.concatenate(held)
            starts = np.cumsum(sizes) - sizes
            row = {"shard": [shard], "block": [block], "first": [before], "n_ids": [len(ids)], "doc_ids": [names], "doc_starts": [starts.tolist()], "payload": [pack(ids, bits)]}
            block, before, names, held, sizes, filled = block + 1, before + len(ids), [], [], [], 0
            return pa.RecordBatch.from_pydict(row, schema=ARROW_BLOCKS)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at, texts in slices(batch.column(1)):
                ids, size = encode_texts(texts, inner, first, whole, " \n")
                ends = np.cumsum(size)
                for k, e in enumerate(ends):
                    names.append(keys[at + k])
                    held += [ids[e - size[k] : e], np.array([end_id], np.int32)]
                    sizes.append(int(size[k]) + 1)
                    filled += sizes[-1]
                    if filled >= BLOCK_IDS:
                        yield close()
        if sizes:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    return rows.repartitionByRange(parts, "id").sortWithinPartitions("id", "text").mapInArrow(write, BLOCK_SCHEMA)


ARROW_BLOCKS = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int32())), ("payload", pa.binary())]
)


def read_blocks(blocks: DataFrame) -> DataFrame:
    """One row per document from block rows: doc_id, start (ids of all documents before it), ids (little-endian 32-bit)."""
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # a row for each shard
    base = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    rows = blocks.join(F.broadcast(base), "shard").select((F.col("base") + F.col("first")).alias("at"), "n_ids", "doc_ids", "doc_starts", "payload")

    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack(r["payload"], 0, r["n_ids"]).astype("<u4")
                starts = np.array([*r["doc_starts"], r["n_ids"]], np.int64)
                docs = [ids[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(r["at"] + starts[:-1], pa.int64()), pa.array(docs, pa.binary())], ["doc_id", "start", "ids"])

    return rows.mapInArrow(read, "doc_id long, start long, ids binary")


def op1(spark, sf_dir):
    import public_tokenizers

    blocks = staged(token_blocks(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, vocabulary=50257), "token-blocks")
    return read_blocks(blocks).select("doc_id", "start", F.expr("CAST(length(ids) DIV 4 AS BIGINT)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
