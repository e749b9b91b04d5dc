"""N-gram Jaccard join: universe-partition pigeonhole.

A document is the set of its distinct word n-grams. For a size band (l, u] two sets with Jaccard similarity t, the larger
one in the band, differ in at most (1 - t) / (1 + t) * (|A| + |B|) elements. The universe is dealt by a hash into more
segments than the largest of these differences, so some segments of such a pair are equal; a segment's subset is an index
key.

Cost-based allocation. Small subsets are shared by chance most often, the empty one by every sparse set. A set of size s
that differs from its partners in at most H(s) elements needs H(s) + 1 of its subsets: those first in one order of all
subsets, larger ones before smaller ones, so that the first equal subset of a pair is kept by both. The empty subset is
never indexed. A set with too few others spends on one-deletion neighbourhoods: it indexes every subset and each subset
less one element, which finds a pair unless all its subsets differ by two or more; as that budget (2 a subset, 1 for a
single element) exceeds H, none is lost. A set whose budget is too small indexes every element. Sets of equal content are
one node throughout.

Keys travel as arrays, one chunk for each task and bucket, and only those that two nodes share become rows. Each task
sends one of its nodes of a key, so a bucket receives one entry of a key per task at most. A key's nodes are compared with
its most shared one, a star: the star's set is sent once to each group of its followers, which pass it by one after the
other; sketches (counts of elements per hash slot) bound the difference from below before whole sets move. What stars
leave open is settled exactly by ``settled_links``: no link between different texts is lost.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterflow.llm.common import MOST_PARTITIONS, staged, table, unstage, whole_text
from rasterflow.llm.components import components
from rasterflow.llm.planes import from_planes, gathered, planes, spread
from rasterflow.llm.words import WordTable, slices

#: Nodes of the largest bucket whose pairs become rows.
BLOCK = 64
#: Elements of the sets in one block of a larger bucket.
BLOCK_ELEMENTS = 500_000
#: Sets that are compared with one block or one star's centre in a task.
FOLLOWERS = 1024
BAND = 0.6  # lower end of a size band as a share of its upper end
#: Text bytes whose keys make one bucket, and keys that a task holds at most: they bound the memory of tasks.
BUCKET_BYTES = 8 << 20
HELD_KEYS = 1_000_000


@dataclass(frozen=True)
class Similarity:
    """Link when per * |A & B| >= part * |A | B|, over n-grams of ``words`` words."""

    words: int = 5
    part: int = 80
    per: int = 100

    def apart(self, both):
        """Most elements in which two linked sets of ``both`` elements together differ."""
        return (self.per - self.part) * both // (self.per + self.part)

    def largest(self, size):
        """Most elements of a set that links with one of ``size``."""
        return size * self.per // self.part


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(WordTable):
    """64-bit hashes of distinct words."""

    def __init__(self):
        super().__init__(lambda ws: [()] * len(ws))

    def clear(self):
        super().clear()
        self.hash = np.zeros(0, np.uint64)

    def add(self, words):
        new = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_numpy(zero_copy_only=False)), np.uint64, len(words))
        self.hash = np.concatenate([self.hash, new])
        self.words = pa.concat_arrays([self.words, words])

    def of(self, words: pa.Array) -> np.ndarray:
        rows = self.rows(words)  # may grow the table
        return self.hash[rows]


_HASHES: list[WordHashes] = []
_P = [np.uint64(p) for p in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's n-grams; of all its words where they are fewer than n."""
    if not _HASHES:
        _HASHES.append(WordHashes())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    if not real.all():  # white space at the ends of a text splits off empty words
        before = np.concatenate([[0], np.cumsum(real)])
        words, offsets = words.filter(pa.array(real)), before[offsets]
    h = _HASHES[0].of(words)
    out = []
    full = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for j in range(n):
        full = full + h[j : j + len(full)] * _P[j % 8] * np.uint64(2 * j + 1)
    full = mixed(full)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(full[a : b - n + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes(), seed=b - a)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def bands(most: int) -> list[int]:
    """Upper ends of size bands: (previous end, end]."""
    ends = [4]
    while ends[-1] < most:
        ends.append(max(ends[-1] + 1, int(ends[-1] / BAND)))
    return ends


_BANDS = np.array(bands(1 << 40))


def _all_keys(value: np.ndarray, first: np.ndarray, total: np.ndarray, label: np.ndarray, most: int, band: int) -> np.ndarray:
    """Keys of a set with too few subsets: all of them, each less one element, and the elements if that is not enough."""
    count = np.diff(np.append(first, len(value)))
    each = np.repeat(np.arange(len(first)), count)
    less = (total[each] - value)[count[each] > 1]
    found = [mixed(total + label), mixed(less + label[each[count[each] > 1]])]
    if np.minimum(count, 2).sum() <= most:
        found.append(mixed(value + np.uint64((band + 1) * int(_P[3]) % 2**64)))
    return np.concatenate(found)


def keys_of(sets: list[np.ndarray], how: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """(keys, place of their set in ``sets``), for each set's own band and those above whose sets may be similar to it."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    band = np.searchsorted(_BANDS, size)
    sets_ = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    begin = np.cumsum(size) - size
    keys, owners, step = [], [], 0
    take = np.flatnonzero(size > 0)
    while len(take):
        k = band[take]
        n, upper = size[take], _BANDS[k]
        most = how.apart(2 * upper)
        m = most + 2 + most // 8
        most = how.apart(n + np.minimum(upper, how.largest(n)))  # of this set
        each = np.repeat(np.arange(len(take)), n)
        s = sets_[np.repeat(begin[take] - (np.cumsum(n) - n), n) + np.arange(len(each))]
        segment = (mixed(s + k.astype(np.uint64)[each]) % m.astype(np.uint64)[each]).astype(np.int64)
        order = np.argsort((each << 40) + segment, kind="stable")
        segment, value = segment[order], mixed(s[order] ^ np.uint64(0x5851F42D4C957F2D))
        first = np.flatnonzero((np.diff(segment, prepend=-1) != 0) | (np.diff(each, prepend=-1) != 0))
        total, count, of = np.add.reduceat(value, first), np.diff(np.append(first, len(value))), each[first]
        label = mixed((segment[first].astype(np.uint64) << np.uint64(16)) + k[of].astype(np.uint64) + np.uint64(1))
        key = mixed(total + label)
        filled = np.bincount(of, minlength=len(take))
        enough = filled > most
        by = np.lexsort((key, -count, of))
        rank = np.arange(len(by)) - np.repeat(np.cumsum(filled) - filled, filled)
        by = by[enough[of[by]] & (rank <= most[of[by]])]
        keys.append(key[by])
        owners.append(take[of[by]])
        edge = np.append(np.cumsum(filled) - filled, len(first))
        for x in np.flatnonzero(~enough).tolist():
            a, b = edge[x], edge[x + 1]
            low, high = first[a], first[b] if b < len(first) else len(value)
            keys.append(_all_keys(value[low:high], first[a:b] - low, total[a:b], label[a:b], int(most[x]), int(k[x])))
            owners.append(np.full(len(keys[-1]), take[x], np.int64))
        step += 1
        take = take[_BANDS[k] + 1 <= how.largest(n)]
        band = band + 1
    return (np.concatenate(keys), np.concatenate(owners)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


#: kind 0: a document (id, n, hi, lo: 128 bits of its set's digest); 1: a chunk of keys; 2: a node id of a key hi that
#: another node of the task has.
INDEX = "kind int, id long, n long, hi long, lo long, bucket int, keys binary, nodes binary"
ARROW_INDEX = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("nodes", pa.binary())])


def index_rows(docs: DataFrame, how: Similarity, buckets: int) -> DataFrame:
    """Rows of all three kinds; a task makes the keys of each content once."""

    def rows(kind: int, **cols) -> pa.RecordBatch:
        n = len(next(iter(cols.values())))
        cols["kind"] = np.full(n, kind, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in ARROW_INDEX], schema=ARROW_INDEX)

    def run(batches):
        seen: set[bytes] = set()
        held: list[tuple] = []
        many = 0

        def close():
            key, node = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            shared = ~first
            shared[:-1] |= ~first[1:]
            if shared.any():
                yield rows(2, id=node[shared], hi=key[shared].view(np.int64))
            key, node = key[first], node[first]
            # buckets are ranges of keys: the high 64 bits of key * buckets, in 32-bit halves; only those that get keys are walked
            half, low = np.uint64(32), key & np.uint64(0xFFFFFFFF)
            bucket = ((key >> half) * np.uint64(buckets) + (low * np.uint64(buckets) >> half)) >> half
            start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            full = bucket[start].astype(np.int32)
            press = lambda x: pa.compress(x, "zstd", asbytes=True)
            ends = list(zip(start.tolist(), [*start[1:].tolist(), len(key)]))
            yield rows(1, n=[e - a for a, e in ends], bucket=full, keys=[press(spread(key[a:e])) for a, e in ends], nodes=[press(planes(node[a:e])) for a, e in ends])

        for batch in batches:
            for at, texts in slices(batch.column(1)):
                ids = batch.column(0).slice(at, len(texts))
                sets = shingle_sets(texts, how.words)
                d = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
                yield rows(0, id=ids, n=[len(s) for s in sets], hi=[x >> 65 for x in d], lo=[x & (2**63 - 1) for x in d])
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                fresh = []
                for k, s in enumerate(sets):
                    if len(s) and known[k] and d[k] not in seen:  # copies hang on the same node
                        seen.add(d[k])
                        fresh.append(k)
                key, owner = keys_of([sets[k] for k in fresh], how)
                held.append((key, ids.fill_null(0).to_numpy()[np.array(fresh, np.int64)][owner]))
                many += len(key)
                if many > HELD_KEYS:
                    yield from close()
                    many = 0
        if many:
            yield from close()

    return docs.mapInArrow(run, INDEX)


def met(chunks: DataFrame, buckets: int) -> DataFrame:
    """Rows (key, node) of the keys that two chunks hold."""

    def close(parts: list) -> pa.RecordBatch:
        open_ = lambda x, n: pa.decompress(x, 8 * n, "zstd", asbytes=True)
        key = np.concatenate([gathered(open_(k, n)) for n, k, _ in parts])
        node = np.concatenate([from_planes(open_(v, n), np.int64) for n, _, v in parts])
        order = np.argsort(key, kind="stable")
        key, node = key[order], node[order]
        same = key[1:] == key[:-1]
        shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        return pa.RecordBatch.from_arrays([pa.array(key[shared].view(np.int64)), pa.array(node[shared])], ["key", "node"])

    def run(batches):
        now, parts = None, []
        for batch in batches:
            for bucket, *part in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now and parts:
                    yield close(parts)
                    parts = []
                now = bucket
                parts.append(part)
        if parts:
            yield close(parts)

    return chunks.select("bucket", "n", "keys", "nodes").repartition(min(buckets, MOST_PARTITIONS), "bucket").sortWithinPartitions("bucket").mapInArrow(run, "key long, node long")


def stars_of(members: DataFrame) -> DataFrame:
    """(key, u, v): the other nodes v of a key and its centre u, the node whose keys are shared most (least id among
    equals): an original rather than one of its edited copies, so that one star links most of a group."""
    often = members.groupBy("key").agg(F.count("*").alias("often")).where("often > 1")
    members = members.join(often, "key")
    shared = members.groupBy("node").agg(F.sum("often").alias("weight"))
    weighed = members.select("key", "node").join(shared, "node")
    centre = weighed.groupBy("key").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("u"))
    return members.select("key", F.col("node").alias("v")).join(centre, "key").where("u <> v").select("key", "u", "v")


#: Bits of the prefilter below: one megabyte, whatever the corpus.
FILTER_BITS = 1 << 23


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, text) of the wanted nodes. A bitmap of their hashes, of fixed size, is broadcast to spare the join most other
    texts; where it is full, the join does all the work."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    byte = 1 << 15  # bits of one row of the bitmap
    bitmap = nodes.select(bit("id").alias("h")).groupBy(F.expr(f"h DIV {byte}").alias("part")).agg(F.bitmap_construct_agg(F.pmod("h", F.lit(byte))).alias("bits"))
    marked = docs.withColumn("h", bit("id")).join(F.broadcast(bitmap), F.expr(f"h DIV {byte}") == F.col("part"))
    hit = F.conv(F.hex(F.expr(f"substring(bits, CAST(pmod(h, {byte}) DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    return marked.where(hit.bitwiseAND(F.expr("shiftleft(1, CAST(pmod(h, 8) AS INT))")) != 0).select("id", "text").join(nodes, "id")


def sketch(s: np.ndarray) -> bytes:
    """Elements per slot, slots a power of two near half the size; slots are low bits, so that sketches fold."""
    slots = 1 << max(4, int(len(s) // 3).bit_length())
    return np.minimum(np.bincount((s & np.uint64(slots - 1)).astype(np.int64), minlength=slots), 255).astype(np.uint8).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    n = min(len(x), len(y))
    return int(np.abs(x.reshape(-1, n).sum(0) - y.reshape(-1, n).sum(0)).sum())


def set_values(wanted: DataFrame, n: int) -> DataFrame:
    """Rows (node, n, sketch, set) from (id, text): the set as sorted hashes in bytes."""

    def run(batches):
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                sets = shingle_sets(texts, n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["node", "n", "sketch", "set"],
                )

    return wanted.mapInArrow(run, "node long, n long, sketch binary, set binary")


def compared(pairs: DataFrame, values: DataFrame, column: str, test) -> DataFrame:
    """The rows (u, v) of pairs for which test(n of u, value of u, n of v, value of v) holds. The value of u is sent once to
    each group of about ``FOLLOWERS`` of its partners; a task holds one such value while the group's rows pass by."""

    def run(batches):
        now = lead = None
        for batch in batches:
            us, vs, ns, xs = (batch.column(i) for i in (0, 2, 3, 4))
            ok = np.zeros(len(us), bool)
            for k, (u, part, v) in enumerate(zip(us.to_pylist(), batch.column(1).to_pylist(), vs.to_pylist())):
                value = ns[k].as_py(), xs[k].as_buffer()
                if v is None:
                    now, lead = (u, part), value
                elif now == (u, part):
                    ok[k] = test(*lead, *value)
            mask = pa.array(ok)
            yield pa.RecordBatch.from_arrays([us.filter(mask), vs.filter(mask)], ["u", "v"])

    many = pairs.groupBy("u").agg(F.ceil(F.count("*") / FOLLOWERS).alias("parts"))
    dealt = pairs.select("u", "v").join(many, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("parts")).alias("part"))
    value = values.select("node", "n", F.col(column).alias("value"))
    leads = dealt.select("u", "part").distinct().join(value, F.col("u") == F.col("node")).select("u", "part", F.lit(None).cast("long").alias("v"), "n", "value")
    follow = dealt.join(value, F.col("v") == F.col("node")).select("u", "part", "v", "n", "value")
    rows = leads.unionByName(follow).repartition("u", "part").sortWithinPartitions("u", "part", F.asc_nulls_first("v"))
    return rows.mapInArrow(run, "u long, v long").distinct()


def verified(pairs: DataFrame, values: DataFrame, how: Similarity) -> DataFrame:
    """The rows (u, v) of pairs that link: sizes and sketches rule most others out, whole sets decide."""

    def may(a, x, b, y):
        return max(abs(a - b), least_difference(x, y)) <= how.apart(a + b)

    def do(a, x, b, y):
        k = np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True).size
        return how.per * k >= how.part * (a + b - k)

    left = staged(compared(pairs, values, "sketch", may), "possible")
    links = staged(compared(left, values, "set", do), "links")
    unstage(left)
    return links


def element_rows(values: DataFrame) -> DataFrame:
    """Rows (element, node, label, n) of sets."""

    def run(batches):
        for batch in batches:
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(3)]
            size = list(map(len, sets))
            cols = [np.repeat(batch.column(i).to_numpy(), size) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)), *map(pa.array, cols)], ["element", "node", "label", "n"])

    return values.select("node", "label", "n", "set").mapInArrow(run, "element long, node long, label long, n long")


def labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs with cu, cv: the components of u and v, themselves where they have none."""
    for c in ("u", "v"):
        pairs = pairs.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"c{c}")), c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
    return pairs


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after further links: components of the components that they join."""
    edges = staged(labelled(links, labels).where("cu <> cv").select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct(), "edges")
    if edges.isEmpty():
        return labels
    more = staged(components(edges), "labels").select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    moved = labels.join(more, labels["label"] == more["_n"], "left").select("node", F.coalesce("_l", "label").alias("label"))
    fresh = more.join(labels, labels["node"] == more["_n"], "left_anti").select(F.col("_n").alias("node"), F.col("_l").alias("label"))
    return staged(moved.unionByName(fresh), "labels")


def useful_elements(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """Rows (element, node, label, n, often) of the nodes (node, label), without the elements that nodes of one label alone
    have; often: how many nodes have the element."""
    elements = element_rows(values.join(nodes, "node"))
    shared = elements.groupBy("element").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("often")).where("a <> b")
    return elements.join(shared.select("element", "often"), "element")


def blocks_compared(told: DataFrame, values: DataFrame, how: Similarity) -> DataFrame:
    """Links (u, v) between labels in large buckets; told: rows (key, node, c, outer), outer ones meet all others.

    A bucket's outer nodes are dealt into blocks of about ``BLOCK_ELEMENTS`` elements, all its nodes into parts of
    ``FOLLOWERS``; a task holds one block as postings and lets one part's sets pass by. Of the links found there only
    those go on that join labels which no earlier one has joined.
    """
    sized = told.join(values.select("node", "n"), "node")
    dealt = sized.groupBy("key").agg(F.ceil(F.sum(F.when(F.col("outer"), F.col("n"))) / BLOCK_ELEMENTS).alias("blocks"), F.ceil(F.count("*") / FOLLOWERS).alias("parts"))
    rows = told.join(dealt, "key")
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    leads = rows.where("outer").select("key", own("blocks").alias("block"), to("parts").alias("part"), F.lit(True).alias("lead"), "node", "c")
    others = rows.select("key", to("blocks").alias("block"), own("parts").alias("part"), F.lit(False).alias("lead"), "node", "c")

    def run(batches):
        now, held, ready, root = None, [], None, {}

        def top(c):
            while root.get(c, c) != c:
                c = root[c]
            return c

        def built():
            sets = [np.frombuffer(x, np.uint64) for _, _, x in held]
            element, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), list(map(len, sets)))
            order = np.argsort(element, kind="stable")
            names, start, count = np.unique(element[order], return_index=True, return_counts=True)
            return names, start, count, owner[order], np.fromiter(map(len, sets), np.int64, len(sets)), [h[0] for h in held], np.array([h[1] for h in held])

        def links(node, c, x):
            names, start, count, owner, size, ids, labels = ready
            s = np.frombuffer(x, np.uint64)
            at = np.minimum(np.searchsorted(names, s), len(names) - 1)
            at = at[names[at] == s]
            n = count[at]
            both = np.bincount(owner[np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(size))
            for k in np.flatnonzero((how.per * both >= how.part * (len(s) + size - both)) & (labels != c)).tolist():
                a, b = top(int(labels[k])), top(c)
                if a != b:
                    root[a] = b
                    yield ids[k], node

        for batch in batches:
            out = []
            *group, lead, node, c, x = (batch.column(i) for i in range(7))
            for g, first, *row in zip(zip(*(i.to_pylist() for i in group)), lead.to_pylist(), node.to_pylist(), c.to_pylist(), (v.as_buffer() for v in x)):
                if g != now:
                    now, held, ready, root = g, [], None, {}
                if first:
                    held.append((*row[:2], bytes(row[2])))
                    continue
                if held and ready is None:
                    ready = built()
                if ready is not None:
                    out += links(*row)
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([j for _, j in out], pa.int64())], ["u", "v"])

    met_ = leads.unionByName(others).join(values.select("node", "set"), "node").select("key", "block", "part", "lead", "node", "c", "set")
    return met_.repartition("key", "block", "part").sortWithinPartitions("key", "block", "part", F.desc("lead")).mapInArrow(run, "u long, v long").distinct()


def settled_links(open_nodes: DataFrame, labels: DataFrame, values: DataFrame, how: Similarity) -> DataFrame:
    """labels after all links between open nodes (node) of different labels.

    An element that only nodes of one label have is of no use to a link with another label. A set that lacks too many
    others links with none, and goes; this is repeated while it removes a tenth of the nodes. The rest meet by exact
    prefixes: with useless elements first and the others by rising frequency, linked sets share an element among their
    first n - t * n + 1. In each of these buckets the nodes outside its largest label meet all nodes of other labels: as
    pairs where a bucket has at most ``BLOCK`` nodes, in blocks where it has more.
    """
    nodes = staged(labelled(open_nodes.select(F.col("node").alias("u"), F.col("node").alias("v")), labels).select(F.col("u").alias("node"), F.col("cu").alias("label")), "open")
    many, before = nodes.count(), math.inf
    while many and many < 0.9 * before:
        enough = useful_elements(nodes, values).groupBy("node", "label", "n").count().where(F.col("count") * how.per >= F.col("n") * how.part)
        left = staged(enough.select("node", "label"), "open")
        unstage(nodes)
        nodes, many, before = left, left.count(), many
    if not many:
        unstage(nodes)
        return labels
    own = Window.partitionBy("node")
    rows = useful_elements(nodes, values).withColumn("shared", F.count("*").over(own)).withColumn("place", F.row_number().over(own.orderBy("often", "element")))
    # private elements take the first n - shared places of a prefix
    most = F.expr(f"n - (n * {how.part} + {how.per} - 1) DIV {how.per} + 1 - (n - shared)")
    marked = staged(rows.where(F.col("place") <= most).select(F.col("element").alias("key"), "node", F.col("label").alias("c")), "marked")
    sizes = marked.groupBy("key", "c").count().groupBy("key").agg(F.max_by("c", F.struct("count", "c")).alias("most"), F.count("*").alias("parts"), F.sum("count").alias("size"))
    told = staged(marked.join(sizes.where("parts > 1"), "key").select("key", "node", "c", (F.col("c") != F.col("most")).alias("outer"), (F.col("size") > BLOCK).alias("large")), "told")
    small = told.where("NOT large")
    outer = small.where("outer").select("key", F.col("node").alias("u"), F.col("c").alias("cu"))
    pairs = staged(small.join(outer, "key").where("c <> cu AND (NOT outer OR node > u)").select("u", F.col("node").alias("v")).distinct(), "pairs")
    links = [verified(pairs, values, how), staged(blocks_compared(told.where("large").drop("large"), values, how), "links")]
    grown = merged(labels, links[0].unionByName(links[1]))
    unstage(nodes, marked, told, pairs, *links)
    return grown


#: Most classes that are sent to all tasks; they are those of more than a share of 1 / HOT_CLASSES of all rows.
HOT_CLASSES = 10_000


def on_classes(rows: DataFrame, classes: DataFrame, total: int, least: int = 1000) -> DataFrame:
    """The rows (hi, lo, ...) of the classes (hi, lo, rep, many), with rep. Classes of more than ``least`` rows and of more
    than a share of 1 / HOT_CLASSES of all ``total`` ones, of which there are at most HOT_CLASSES, are broadcast, so that no
    key of the shuffle has more rows than that."""
    hot = F.col("many") > max(least, total // HOT_CLASSES)
    few = F.broadcast(classes.where(hot).select("hi", "lo", "rep"))
    rest = rows.join(few, ["hi", "lo"], "left_anti").join(classes.where(~hot).select("hi", "lo", "rep"), ["hi", "lo"])
    return rows.join(few, ["hi", "lo"]).unionByName(rest)


def ngram_join(docs: DataFrame, how: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the least id reachable by links, its own included).

    Words are runs of other than [\\x20\\x09-\\x0D], A-Z lower-cased. A text with fewer words than an n-gram has the whole
    sequence as its one element; one without words, or null, has none and links with nothing. Rows of equal id are one
    node. A null id links with nothing and has a null component. Elements are 64-bit hashes; comparisons of whole sets
    use them all. No rows in, no rows out.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    named = texts.where("id IS NOT NULL")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    index = staged(index_rows(texts, how, buckets), "index")
    sizes = index.where("kind = 0").select("id", "n", "hi", "lo")
    made: list[DataFrame] = []

    def held(df: DataFrame, name: str) -> DataFrame:
        made.append(staged(df, name))
        return made[-1]

    # equal sets: every document hangs on the least id of its class
    real = sizes.where("id IS NOT NULL AND n > 0")
    classes = held(real.groupBy("hi", "lo").agg(F.min("id").alias("rep"), F.count("*").alias("many")).where("many > 1"), "classes")
    copies = held(on_classes(real, classes, index.where("kind = 0").count()).where("id <> rep").select(F.col("rep").alias("u"), F.col("id").alias("v")).distinct(), "copies")

    found = index.where("kind = 2").select(F.col("hi").alias("key"), F.col("id").alias("node")).unionByName(met(index.where("kind = 1"), buckets))
    found = found.join(copies.select(F.col("v").alias("node"), F.col("u").alias("rep")), "node", "left")
    members = held(found.select("key", F.coalesce("rep", "node").alias("node")).distinct(), "members")
    stars = held(stars_of(members), "stars")
    sizes = staged(sizes.select("id", "n"), "sizes")  # the index has been used
    unstage(index)

    star_pairs = held(stars.groupBy("u", "v").agg(F.count("*").alias("n")), "pairs")
    nodes = star_pairs.select(F.col("u").alias("id")).unionByName(star_pairs.select(F.col("v").alias("id"))).distinct()
    values = held(set_values(texts_of(named, nodes).select("id", "text"), how.words), "set-values")
    # the star that shares most keys with a node first, the others only where that leaves them apart
    best = held(star_pairs.groupBy("v").agg(F.max_by("u", F.struct("n", -F.col("u"))).alias("u")).select("u", "v"), "best")
    links = verified(best, values, how)
    labels = staged(components(links), "labels")
    rest = held(labelled(star_pairs.join(best, ["u", "v"], "left_anti"), labels).where("cu <> cv").select("u", "v"), "rest")
    if not rest.isEmpty():
        labels = merged(labels, verified(rest, values, how))
    open_keys = labelled(stars, labels).where("cu <> cv").select("key").distinct()
    open_nodes = members.join(open_keys, "key", "left_semi").select("node").distinct()
    labels = settled_links(open_nodes, labels, values, how)
    labels = merged(labels, copies)
    unstage(*made)
    return sizes.join(labels.select(F.col("node").alias("id"), "label"), "id", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("label", "id").alias("component_id"))


def op9(spark, sf_dir):
    return ngram_join(table(spark, sf_dir, "documents"), Similarity(words=4, part=85)).withColumnRenamed("id", "doc_id")


#: Documents d(doc_id, text); the links are found by all pairs that share an n-gram.
def oracle(words: int, part: int) -> str:
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+{words - 1}], ' ') g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {words - 1}, 1) + 1)) i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id u, b.doc_id v FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= {part} * (na.n + nb.n - count(*))),
r AS (SELECT doc_id u, doc_id v FROM w UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(v) FROM r WHERE r.u = w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id)
"""


OP9_SQL = oracle(4, 85)
