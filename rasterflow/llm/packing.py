"""Best-fit packing by sum of squares.

A document of length s goes where the sum of squared counts of open bins per residual gap becomes smallest: into an open
bin of some gap g >= s, or into a new one (the tightest gap among equals). Documents are cut into pieces of at most
``size`` ids; pieces are dealt by a hash of document and piece into groups of bounded bytes, each packed on its own, so
nothing about one source or one copied text gathers in one task, and the waste is a few sequences for each group of
thousands. Inside a group pieces come longest first; what is left in badly filled sequences is packed once more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterflow.llm.common import table, whole_text
from rasterflow.llm.words import byte_bpe, encode_texts, slices

#: Text bytes whose pieces make one group: it bounds a task's memory, at about a byte of ids for two of text.
GROUP_BYTES = 96 << 20


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, in the given order; lengths from 1 to size."""
    count = np.zeros(size + 1, np.int64)  # open bins by gap; closed ones aren't counted
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    bins, offsets, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    never = np.int64(1) << 60
    for k, s in enumerate(lengths.tolist()):
        gap, fresh = 0, 2 * count[size - s] + 1 if s < size else 0
        if s < size:
            # placing into gap g changes the sum by 2 * (count[g - s] - count[g]) + 2, into a fitting one by 1 less twice
            cost = np.where(count[s:size] > 0, 2 * (count[: size - s] - count[s:size]) + 2, never)
            cost[0] -= 1
            best = int(cost.argmin())
            if cost[best] <= fresh:
                gap = s + best
        if gap:
            b = stacks[gap].pop()
            count[gap] -= 1
        else:
            gap, b, made = size, made, made + 1
        bins[k], offsets[k], left = b, size - gap, gap - s
        if left:
            stacks[left].append(b)
            count[left] += 1
    return bins, offsets


def pack_group(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of squares over pieces longest first, then once more over those in sequences filled below nine tenths."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    bins[order], offsets[order] = sum_of_squares(lengths[order], size)
    fill = np.bincount(bins, lengths) if len(lengths) else np.zeros(0)
    loose = np.flatnonzero(fill[bins] < 0.9 * size)
    if len(loose):
        # best fit, longest first: only if it needs fewer sequences
        free: dict[int, list[int]] = {}
        again, at, made = np.zeros(len(loose), np.int64), np.zeros(len(loose), np.int64), 0
        gaps = np.zeros(size + 1, np.int64)
        loose = loose[np.argsort(-lengths[loose], kind="stable")]
        for k, s in enumerate(lengths[loose].tolist()):
            fits = np.flatnonzero(gaps[s:])
            gap = s + int(fits[0]) if len(fits) else size
            b = free[gap].pop() if len(fits) else made
            made += not len(fits)
            gaps[gap] -= len(fits) > 0
            again[k], at[k] = b, size - gap
            if gap > s:
                free.setdefault(gap - s, []).append(b)
                gaps[gap - s] += 1
        old = np.unique(bins[loose])
        if made < len(old):
            bins[loose], offsets[loose] = old[again], at
    return bins, offsets


PIECES = "doc_id long, piece int, start long, length long, ids binary"
PACKED = PIECES + ", sequence_id long, offset long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, id_col: str = "doc_id", text_col: str = "text", width: int = 2) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids) of all texts; ids as little-endian integers of ``width`` bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner, first, whole = byte_bpe(tokenizer, False)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False) if not batch.column(0).null_count else np.array(batch.column(0).to_pylist(), object)
            for at, texts in slices(batch.column(1)):
                ids, n = encode_texts(texts, inner, first, whole, " ")
                n1 = n + 1  # with the end id
                ends = np.cumsum(n1)
                full = np.full(int(n1.sum()), end_id, f"<u{width}")
                keep = np.ones(len(full), bool)
                keep[ends - 1] = False
                full[keep] = ids
                many = -(-n1 // size)
                doc = np.repeat(np.arange(len(n1)), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * size
                length = np.minimum(size, n1[doc] - start)
                place = (np.concatenate([[0], np.cumsum(length)]) * width).astype(np.int32)
                held = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(place), pa.py_buffer(full)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[at : at + len(n1)][doc], pa.int64()), pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)), held],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text")).mapInArrow(cut, PIECES)


def packed(found: DataFrame, groups: int, size: int, width: int = 2) -> DataFrame:
    """Pieces with sequence_id and offset, and ids widened to little-endian 32-bit."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches), schema=ARROW_PIECES)
        if not len(whole):
            return
        # one order whatever the order of arrival, so that a task run again gives the same sequences
        whole = whole.append_column("tie", pa.array([hashlib.md5(x).hexdigest() for x in whole["ids"].to_pylist()] if pc.count_distinct(whole["doc_id"]).as_py() < len(whole) else [""] * len(whole)))
        whole = whole.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("tie", "ascending")]).drop_columns(["tie"])
        bins, offsets = pack_group(whole["length"].to_numpy(), size)
        whole = whole.append_column("sequence_id", pa.array((TaskContext.get().partitionId() << 40) + bins)).append_column("offset", pa.array(offsets))
        for b in whole.to_batches(max_chunksize=2000):
            ids = [np.frombuffer(x, f"<u{width}").astype("<u4").tobytes() for x in b["ids"].to_pylist()]
            yield b.set_column(4, "ids", pa.array(ids, pa.binary()))

    return found.repartition(groups, F.xxhash64("doc_id", "piece")).mapInArrow(place, PACKED)


ARROW_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])


def best_fit_packing(docs: DataFrame, tokenizer: str, end_id: int, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian 32-bit), sequence_id, offset.

    The texts are read twice: once for their bytes, which set the number of groups. A null or empty text is one piece
    with the end id alone. Repeated rows, and null ids, give their own pieces. No documents, no rows.
    """
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return packed(pieces(docs, tokenizer, end_id, size, id_col, text_col, width), max(1, -(-total // group_bytes)), size, width)


def op2(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    out = best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0)
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
