"""Spans of a text, as (kind, start, end) in code points: schema, digests and replacement. Used by PII and secrets."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterflow.llm.common import whole_text

Span = tuple[str, int, int]
SPANS = "array<struct<kind:string,start:int,end:int>>"
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def ordered(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    place = {k: i for i, k in enumerate(kinds)}
    return sorted(spans, key=lambda s: (s[1], place[s[0]], s[2]))


def span_rows(docs: DataFrame, find: Callable[[str], list[Span]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, spans): ``find`` is applied to every whole text, null as empty. Nothing is shuffled."""

    def run(batches):
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s)) for s in find(t)] if t else [] for t in map(str, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, ARROW_SPANS)], ["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, f"doc_id long, spans {SPANS}")


def replaced(docs: DataFrame, find: Callable[[str], list[Span]], text_col: str = "text", mark: str = "[{kind}]", size_col: str = "n_chars") -> DataFrame:
    """docs with every span of the text put as ``mark``; overlapping spans become one, named by the first. Where a text
    changes, ``size_col``, if there, becomes its new length. Null texts stay null; all columns stay."""
    names = docs.columns

    def run(batches):
        for batch in batches:
            texts = batch.column(names.index(text_col)).to_pylist()
            sizes = batch.column(names.index(size_col)).to_pylist() if size_col in names else None
            for k, t in enumerate(texts):
                if t and (spans := find(t)):
                    out, at, until = [], 0, -1
                    for kind, start, end in spans:
                        if start >= until:
                            out += [t[max(at, 0) : start], mark.format(kind=kind.upper())]
                            until = at = end
                        else:
                            until = at = max(until, end)
                    texts[k] = "".join([*out, t[at:]])
                    if sizes:
                        sizes[k] = len(texts[k])
            cols = list(batch.columns)
            cols[names.index(text_col)] = pa.array(texts, batch.schema.field(text_col).type)
            if sizes:
                cols[names.index(size_col)] = pa.array(sizes, batch.schema.field(size_col).type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, docs.schema)


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
