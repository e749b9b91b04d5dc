"""Run-length streams of 8 and 4 bits, read in parallel: a finite-state scan by composed maps, then runs by prefix sums.

Where a command begins depends on all commands before it, so a stream looks serial. It is cut into chunks of two-byte words.
The state between two words is a small number: pixels of a literal run still to come, an operand awaited, or the end. Each
chunk is turned, by pointer doubling, into the map from the state before it to the state after it; composing the maps of an
image in order, which is a lookup a chunk, tells every chunk its own state, and so the role of every word. Positions follow
the same way: a chunk moves the pen by its own sums, which are added up along the chunks. Only maps and sums of chunks meet
in one place, never an image's bytes or pixels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a chunk.
WORDS = 4096
#: States beside the 0 to 255 pixels of a literal run that are still to come (0: a command comes next).
OPERAND, END = 256, 257
#: Bytes of chunks and their maps that a task works on at a time: a batch has up to 10,000 rows, and each run of a chunk is an
#: object in Python.
HELD = 1 << 20
RUNS = "array<struct<x:bigint,y:bigint,anew:boolean,length:int,pattern:binary>>"


def chunks(streams: DataFrame, words: int = WORDS) -> DataFrame:
    """Rows (image_id, chunk, nibbles, data) of streams (image_id, data, nibbles); a byte after the last word is left out. A null
    or empty stream is one empty chunk."""
    size = F.floor(F.octet_length("data") / 2).cast("int") * 2
    last = F.greatest(F.floor((F.coalesce(size, F.lit(0)) - 1) / (2 * words)).cast("int"), F.lit(0))
    cut = lambda c: F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(c, i * 2 * words + 1, F.greatest(F.least(F.lit(2 * words), size - i * 2 * words), F.lit(0))))
    whole = F.get(F.transform(F.array(F.coalesce("data", F.lit(b""))), cut), F.lit(0))
    return streams.select("image_id", "nibbles", F.posexplode(whole).alias("chunk", "data")).select("image_id", F.col("chunk").cast("long").alias("chunk"), "nibbles", F.coalesce("data", F.lit(b"")).alias("data"))


class Words:
    """The words of a chunk and, for each, where the next command would be if it were one."""

    def __init__(self, data: bytes, nibbles: bool):
        pairs = np.frombuffer(data, np.uint8, len(data) // 2 * 2).reshape(-1, 2).astype(np.int64)
        self.a, self.b, self.n, self.per = pairs[:, 0], pairs[:, 1], len(pairs), 4 if nibbles else 2
        escape = self.a == 0
        self.literal, self.operand, self.end = escape & (self.b > 2), escape & (self.b == 2), escape & (self.b == 1)
        self.line = escape & (self.b == 0)
        self.skip = np.where(self.literal, -(-self.b // self.per), self.operand)
        self.next = np.arange(self.n) + 1 + self.skip
        self.last = self.end | (self.next >= self.n)

    def first(self, state: int) -> int:
        """Words that belong to what came before the chunk."""
        return 1 if state == OPERAND else -(-state // self.per)

    def after(self) -> np.ndarray:
        """The state after the chunk for every state before it."""
        to = np.where(self.last, np.arange(self.n), self.next)
        for _ in range(self.n.bit_length()):
            to = to[to]
        left = np.where(self.literal, self.b - self.per * (self.n - 1 - np.arange(self.n)), OPERAND)
        leave = np.where(self.end, END, np.where(self.next <= self.n, 0, left))
        out = np.arange(END + 1)
        for state in range(END):
            at = self.first(state)
            if at < self.n:
                out[state] = leave[to[at]]
            elif self.n:
                out[state] = 0 if at == self.n else state - self.per * self.n
        return out

    def commands(self, start: int) -> np.ndarray:
        """Places of the commands from the one at ``start`` on: iterates of ``next`` by doubling."""
        hop, hops = np.append(np.where(self.last, self.n, self.next), self.n), []
        for _ in range(self.n.bit_length()):
            hops.append(hop)
            hop = hop[hop]
        found = np.array([min(start, self.n)])
        for hop in reversed(hops):
            found = np.concatenate([found, hop[found]])
        return np.unique(found[found < self.n])

    def moves(self, state: int) -> tuple:
        """(run lengths, x moves, line moves, whether x starts anew) of each word, given the state before the chunk."""
        n = self.n
        length, dx, dy, anew = (np.zeros(n, np.int64) for _ in range(4))
        if state == END or n == 0:
            return length, dx, dy, anew
        start = self.first(state)
        at = self.commands(start)
        # pixels that are left of a literal run before each word of its data
        of, words = at[self.literal[at]], self.skip[at[self.literal[at]]]
        place = np.arange(words.sum()) - np.repeat(np.cumsum(words) - words, words)
        data, left = np.repeat(of, words) + 1 + place, np.repeat(self.b[of], words) - self.per * place
        if 0 < state <= 255:
            data, left = np.append(data, np.arange(start)), np.append(left, state - self.per * np.arange(start))
        left, data = left[data < n], data[data < n]
        length[data] = np.minimum(left, self.per)
        length[at] = self.a[at]
        dx[:] = length
        operands = at[self.operand[at]] + 1
        if state == OPERAND:
            operands = np.append(operands, 0)
        operands = operands[operands < n]
        dx[operands], dy[operands] = self.a[operands], self.b[operands]
        lines = at[self.line[at]]
        dy[lines], anew[lines] = 1, 1
        self.data = np.zeros(n, bool)
        self.data[data] = True
        return length, dx, dy, anew

    def patterns(self, at: np.ndarray) -> list[bytes]:
        """The samples that a run repeats: its value, or its two halves; of literal words all they hold."""
        both = np.stack([self.a[at], self.b[at]], 1)
        out = []
        for literal, (a, b) in zip(self.data[at].tolist(), both.tolist()):
            held = (a, b) if literal else (b,)
            out.append(bytes(h for v in held for h in (v >> 4, v & 15)) if self.per == 4 else bytes(held))
        return out


def _slices(batches):
    """The batches, chunks in column 3, cut into slices of about HELD bytes or one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(3)).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes + 8 * (END + 1)) // HELD
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def _maps(batches):
    for batch in _slices(batches):
        maps = [Words(d, n).after() for d, n in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.list_(pa.int64()))], ["image_id", "chunk", "map"])


def _kind(parts: DataFrame) -> str:
    return parts.schema["image_id"].dataType.simpleString()


def entry_states(parts: DataFrame) -> DataFrame:
    """Rows (image_id, chunk, state, final): the state before each chunk, and the image's last one. A list of an image has a map
    of 258 numbers for each chunk of 8 KB."""
    maps = parts.mapInArrow(_maps, f"image_id {_kind(parts)}, chunk long, map array<bigint>")
    lists = maps.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "map"))).alias("m"))
    start = F.struct(F.lit(0).cast("bigint").alias("state"), F.array().cast("array<bigint>").alias("seen"))
    walk = F.aggregate("m", start, lambda s, m: F.struct(F.get(m["map"], s["state"].cast("int")).alias("state"), F.array_append(s["seen"], s["state"]).alias("seen")))
    walked = lists.select("image_id", F.col("m.chunk").alias("chunks"), walk.alias("w"))
    return walked.select("image_id", F.inline(F.arrays_zip(F.col("chunks").alias("chunk"), F.col("w.seen").alias("state"))), F.col("w.state").alias("final"))


def _chunk_runs(batches):
    for batch in _slices(batches):
        rows, sums, offsets = [], [], [0]
        for nibbles, data, state in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
            w = Words(data, nibbles)
            length, dx, dy, anew = w.moves(state)
            before = np.cumsum(dx) - dx
            line = np.maximum.accumulate(np.where(anew > 0, np.arange(w.n), -1)) if w.n else np.zeros(0, np.int64)
            own = np.append(before, dx.sum() if w.n else 0)  # a line begins behind its word, where the pen has moved by before
            x = before - np.where(line >= 0, own[np.maximum(line, 0)], 0)
            at = np.flatnonzero(length)
            rows.append((x[at], (np.cumsum(dy) - dy)[at], line[at] >= 0, length[at], w.patterns(at) if len(at) else []))
            reset = bool(anew.any())
            sums.append((int(dx.sum() - (own[line[-1]] if reset else 0)), int(dy.sum()), reset))
            offsets.append(offsets[-1] + len(at))
        flat = [np.concatenate([r[k] for r in rows]) for k in range(4)] if rows else [np.zeros(0, np.int64)] * 4
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int32())
        runs = pa.StructArray.from_arrays([*(pa.array(f, k) for f, k in zip(flat, kinds)), pa.array([p for r in rows for p in r[4]], pa.binary())], ["x", "y", "anew", "length", "pattern"])
        tail, down, reset = (pa.array([s[k] for s in sums], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_())))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tail, down, reset, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs)], ["image_id", "chunk", "tail", "down", "reset", "runs"])


def rle_runs(streams: DataFrame, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(runs, verdicts) of streams (image_id, data, nibbles), nibbles telling samples of 4 bits.

    runs: (image_id, y, x, length, pattern) in stored rows; sample i of a run is pattern[i mod its length]. verdicts:
    (image_id, status): ok, or truncated where no end command is reached, an empty or null stream included; the runs before
    the cut are there. Ids tell images apart. What follows the end command is ignored.
    """
    parts = chunks(streams, words)
    states = entry_states(parts)
    known = parts.join(states, ["image_id", "chunk"]).select("image_id", "chunk", "nibbles", "data", "state")
    found = known.mapInArrow(_chunk_runs, f"image_id {_kind(parts)}, chunk long, tail long, down long, reset boolean, runs {RUNS}")
    lists = found.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "tail", "down", "reset"))).alias("m"))
    pen = lambda x, y, seen: F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), seen.cast("array<struct<x0:bigint,y0:bigint>>").alias("seen"))
    moved = lambda s, m: pen(F.when(m["reset"], m["tail"]).otherwise(s["x"] + m["tail"]), s["y"] + m["down"], F.array_append(s["seen"], F.struct(s["x"].alias("x0"), s["y"].alias("y0"))))
    walked = lists.select("image_id", F.col("m.chunk").alias("chunks"), F.aggregate("m", pen(F.lit(0), F.lit(0), F.array()), moved)["seen"].alias("seen"))
    pens = walked.select("image_id", F.inline(F.arrays_zip(F.col("chunks").alias("chunk"), F.col("seen").alias("p")))).select("image_id", "chunk", "p.x0", "p.y0")
    each = found.select("image_id", "chunk", F.inline("runs")).join(pens, ["image_id", "chunk"])
    runs = each.select("image_id", (F.col("y0") + F.col("y")).alias("y"), (F.col("x") + F.when(F.col("anew"), 0).otherwise(F.col("x0"))).alias("x"), "length", "pattern")
    verdicts = states.where("chunk = 0").select("image_id", F.when(F.col("final") == END, "ok").otherwise("truncated").alias("status"))
    return runs, verdicts


def rle_pixels(runs: DataFrame, dims: DataFrame) -> DataFrame:
    """Written pixels (image_id, y, x, level) of runs, in rows from the top, inside dims (image_id, w, h, top_down); the others
    are of level 0."""
    inside = runs.join(dims, "image_id").where("x < w AND y < h").withColumn("n", F.least(F.col("length"), F.col("w") - F.col("x")).cast("int"))
    level = lambda i: F.conv(F.hex(F.substring("pattern", (i % F.octet_length("pattern")).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    shown: Column = F.when(F.col("top_down"), F.col("y")).otherwise(F.col("h") - 1 - F.col("y"))
    each = inside.select("image_id", shown.alias("y"), "x", "pattern", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return each.select("image_id", "y", (F.col("x") + F.col("i")).alias("x"), level(F.col("i")).alias("level"))
