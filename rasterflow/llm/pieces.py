"""SentencePiece encoding and decoding by a distinct-chunk table.

No piece of the model may hold a word marker after another character (checked when the model is loaded), so a text is
segmented word by word: each distinct marked word is encoded once by the library and its ids are joined back by position.
Texts with runs of spaces, or with the marker character itself at the edge of a word, go to the library whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterflow.llm.common import table, whole_text
from rasterflow.llm.words import WordTable, encode_texts, slices

MARK = "▁"
_MODELS: dict = {}


def model(path: str):
    """(processor, table of words), one for each worker process."""
    if path not in _MODELS:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        crossing = any(re.search(f"[^{MARK}]{MARK}", sp.id_to_piece(i)) for i in range(sp.vocab_size()))

        def encode(words: list[str]) -> list:
            alone = [bool(w) and w[0] != MARK and w[-1] != MARK and not crossing for w in words]
            ids = iter(sp.encode([w for w, ok in zip(words, alone) if ok], num_threads=1))
            return [next(ids) if ok else None for ok in alone]

        _MODELS[path] = sp, WordTable(encode)
    return _MODELS[path]


def piece_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids, decoded) of all texts: ids as the library gives them, decoded by its decode(ids).

    Null and empty texts have no ids and decode to ''. Null ids and repeated rows keep their own rows. Only the two
    columns are read; nothing is shuffled.
    """

    def run(batches):
        sp, words = model(path)
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                flat, size = encode_texts(texts, words, words, lambda t: sp.encode(t), None)
                offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                ids = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))
                decoded = sp.decode(ids.to_pylist(), num_threads=1) if len(texts) else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), ids, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def op8(spark, sf_dir):
    import public_tokenizers

    out = piece_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
