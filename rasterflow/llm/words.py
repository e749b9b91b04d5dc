"""Ids of whole texts by a table of distinct words, for tokenizers whose tokens never cross a space.

A batch of texts is split at spaces in Arrow, each word that the worker has not met is encoded once by the library, and
the ids are joined back by position with numpy. The table is a cache with a bound: when full it starts anew.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are split at a time.
SLICE_BYTES = 8 << 20


class WordTable:
    """Distinct words and their ids. encode: list of words -> list of id lists; None marks a word that must not be joined."""

    def __init__(self, encode: Callable[[list[str]], list], cap: int = 600_000):
        self.encode, self.cap = encode, cap
        self.clear()

    def clear(self) -> None:
        self.words = pa.array([], pa.string())
        self.start, self.size, self.flat, self.joins = (np.zeros(0, t) for t in (np.int64, np.int64, np.int32, bool))

    def add(self, words: pa.Array) -> None:
        ids = self.encode(words.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter((len(x or ()) for x in ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids if x for i in x), np.int32, int(size.sum()))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])
        self.joins = np.concatenate([self.joins, np.fromiter((x is not None for x in ids), bool, len(ids))])
        self.words = pa.concat_arrays([self.words, words])

    def rows(self, words: pa.Array) -> np.ndarray:
        """Places of the words in the table; new ones are added."""
        at = pc.index_in(words, value_set=self.words)
        missing = at.is_null()
        out = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if at.null_count:
            lost = words.filter(missing)
            new = pc.unique(lost)
            if len(self.words) + len(new) > self.cap and len(self.words):
                self.clear()
                return self.rows(words)
            base = len(self.words)
            self.add(new)
            out[missing.to_numpy(zero_copy_only=False)] = base + pc.index_in(lost, value_set=new).to_numpy(zero_copy_only=False)
        return out

    def ids(self, rows: np.ndarray) -> np.ndarray:
        size = self.size[rows]
        shift = np.repeat(self.start[rows] - (np.cumsum(size) - size), size)
        return self.flat[shift + np.arange(len(shift))]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) with about ``most`` bytes each, one text at least; nulls become empty."""
    column = column.fill_null("")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield at, column.slice(at, to - at)
        at = to


def encode_texts(texts: pa.Array, inner: WordTable, first: WordTable, whole: Callable[[str], list[int]], line_breaks: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, number of ids of each text).

    inner: table for words after a space; first: for the word that begins a text; whole: encodes a text with words that
    must not be joined. line_breaks: put for '\\n' before splitting, where that changes no ids.
    """
    cut = texts if line_breaks is None else pc.replace_substring(texts, "\n", line_breaks)
    lists = pc.split_pattern(cut, " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.flatten()
    offsets = offsets - offsets[0]
    rows = inner.rows(words)
    ids, size, joins = inner.ids(rows), inner.size[rows], inner.joins[rows]
    total = np.concatenate([[0], np.cumsum(size)])
    if first is inner:
        good = np.logical_and.reduceat(joins, offsets[:-1]) if len(joins) else np.zeros(0, bool)
        if good.all():
            return ids, total[offsets[1:]] - total[offsets[:-1]]
        firsts = None
    else:
        starts = first.rows(words.take(pa.array(offsets[:-1])))
        firsts = [first.ids(starts), np.concatenate([[0], np.cumsum(first.size[starts])])]
        joins = joins.copy()
        joins[offsets[:-1]] = first.joins[starts]
        good = np.logical_and.reduceat(joins, offsets[:-1])
    parts = []
    for k, ok in enumerate(good):
        if not ok:
            text = texts[k].as_py()
            parts.append(np.asarray(whole(text) if text else [], np.int32))
        elif firsts is None:
            parts.append(ids[total[offsets[k]] : total[offsets[k + 1]]])
        else:
            parts.append(firsts[0][firsts[1][k] : firsts[1][k + 1]])
            parts.append(ids[total[offsets[k] + 1] : total[offsets[k + 1]]])
            parts[-2:] = [np.concatenate(parts[-2:])]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.fromiter(map(len, parts), np.int64, len(parts))


# --- byte-level BPE files of the tokenizers library ---

#: The bytes that byte-level BPE shows as themselves; the others follow from U+0100 on, in order.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in SHOWN)}
#: Latin-1 letters (categories Lu, Ll, Lo: superscripts and fractions are numbers), then punctuation that always ends a run
#: of letters (no apostrophe).
PLAIN_WORD = re.compile(r"(\n?)([A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-^`{-~]*)")
#: Words whose edges cannot merge with white space.
EDGES = re.compile(r"\n?[\w!-~](?:.*[\w!-~])?", re.S)
_ENCODERS: dict = {}


def byte_bpe(path: str, spaced: bool) -> tuple[WordTable, WordTable, Callable[[str], list[int]]]:
    """(inner, first, whole) for a tokenizers file of byte-level BPE, one set for each worker process.

    spaced=True: a token holds the space before it, and line breaks are tokens (put ' \\n' for '\\n' before splitting).
    spaced=False: the file lower-cases, drops white space and splits words at it.
    Words of Latin letters go straight to the file's model, the others through the whole tokenizer. A text that holds the
    string of an added token goes to the library whole, which gives that token's id.
    """
    if (path, spaced) in _ENCODERS:
        return _ENCODERS[path, spaced]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    model = tok.model
    added = [t.content for t in tok.get_added_tokens_decoder().values()]
    if any(" " in t for t in added):
        raise ValueError("an added token with a space cannot be told from single words")
    special = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.I)
    ends: dict[str, list[int]] = {}
    whole = lambda text: tok.encode(text, add_special_tokens=False).ids

    def letters(word: str, lead: str = "") -> list[int]:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(BYTE_CHARS)
        return [t.id for t in model.tokenize(lead + word)]

    def encode(words: list[str], lead: str) -> list:
        out: list = [None] * len(words)
        rest = []
        for k, w in enumerate(words):
            m = PLAIN_WORD.fullmatch(w)
            if m and (w.isascii() or max(m[2]) <= "\xff"):
                if spaced:
                    ids = letters(m[2], "" if m[1] else lead)
                    out[k] = ends.setdefault("\n", whole("\n")) + ids if m[1] else ids
                else:
                    out[k] = letters(m[2].lower())
                if m[3]:
                    if m[3] not in ends:
                        ends[m[3]] = whole(m[3])
                    out[k] = out[k] + ends[m[3]]
            elif special.search(w) is None and (not spaced or EDGES.fullmatch(w)):
                rest.append(k)
        full = [" " + words[k] if lead and words[k][:1] != "\n" else words[k] for k in rest]
        for k, e in zip(rest, tok.encode_batch_fast(full, add_special_tokens=False)):
            out[k] = e.ids
        return out

    inner = WordTable(lambda ws: encode(ws, BYTE_CHARS[32] if spaced else ""))
    first = WordTable(lambda ws: encode(ws, ""), 100_000) if spaced else inner
    _ENCODERS[path, spaced] = inner, first, whole
    return _ENCODERS[path, spaced]
