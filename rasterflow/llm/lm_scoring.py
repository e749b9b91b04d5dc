"""LM scoring: a weighted backoff automaton over n-grams of up to ``Model.order`` words.

States are the n-grams that the training texts have as contexts, the empty one (the root) included; a text begins in the
state of its end symbol. From state h an arc w carries log10 P(w | h) and leads to the longest suffix of h w that is a state;
where h has no arc w, its failure arc leads to h without its first word and carries log10 of h's backoff mass. Counts are
smoothed towards the shorter context (Dirichlet): P(w | h) = (c(hw) + m P(w | h')) / (c(h) + m), and the failure arc of h
weighs m / (c(h) + m), so arcs and failure arc of a state share out all probability. The root has an arc for every word, one
for all unknown words included.

The automaton of a corpus outgrows any task, so texts are cut into blocks and each block gets the part that it traverses:

1. a block's texts become tokens once, with its vocabulary;
2. order by order, blocks deal their distinct n-grams with training counts by hash into buckets; a bucket adds them up and
   answers each block in the order of what it sent. An n-gram is sent only if both n-grams one word shorter occur in other
   blocks too: else its counts are the block's own;
3. a block's tokens meet the answers, its states and arcs are built, and its texts traverse them from left to right.

What a block sends to a bucket travels as arrays, so a frequent n-gram costs one entry a block, and a block's work follows
its own n-grams, whatever the number of buckets. Nothing is pruned; what is gathered grows with the corpus. Counts are keyed
by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterflow.llm.common import MOST_PARTITIONS, staged, table, unstage, whole_text
from rasterflow.llm.ngram_join import _P, WordHashes, mixed
from rasterflow.llm.planes import from_planes, gathered, planes, spread
from rasterflow.llm.words import slices

#: Text bytes of a block and tokens whose n-grams make one bucket; they bound a task's memory.
BLOCK_BYTES = 10 << 20
BUCKET_TOKENS = 1 << 20
END = np.uint64(0x5D588B656C078965)
_WORDS: list[WordHashes] = []


@dataclass(frozen=True)
class Model:
    """mass: the weight of the shorter context against the counts of contexts of 0, 1, 2, ... words; at the root, what each
    distinct word gets. Its length is the order."""

    mass: tuple[float, ...] = (1.0, 400.0, 2.0)

    @property
    def order(self) -> int:
        return len(self.mass)


def press(x: np.ndarray) -> bytes:
    return pa.compress(planes(x), "zstd", asbytes=True)


def opened(b: bytes, n: int, kind) -> np.ndarray:
    return from_planes(pa.decompress(b, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


def token_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all tokens, an end after each text; number of tokens of each text)."""
    if not _WORDS:
        _WORDS.append(WordHashes())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    if not real.all():
        before = np.concatenate([[0], np.cumsum(real)])
        words, offsets = words.filter(pa.array(real)), before[offsets]
    n = np.diff(offsets) + 1
    keys = np.full(int(n.sum()), END, np.uint64)
    inner = np.ones(len(keys), bool)
    inner[np.cumsum(n) - 1] = False
    keys[inner] = _WORDS[0].of(words)
    return keys, n


BLOCK = "block long, ids array<bigint>, held array<boolean>, n array<bigint>, words int, tokens int, vocabulary binary, text binary"
ARROW_BLOCK = pa.schema(
    [("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("n", pa.list_(pa.int64())), ("words", pa.int32()), ("tokens", pa.int32()), ("vocabulary", pa.binary()), ("text", pa.binary())]
)


def block_rows(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Blocks of about block_bytes of one input partition's texts each, as tokens: places in the block's sorted vocabulary."""

    def run(batches):
        from pyspark import TaskContext

        block, filled, held = TaskContext.get().partitionId() << 32, 0, []

        def close():
            ids, flags, keys, n = (x for x in zip(*held))
            held.clear()
            keys, n = np.concatenate(keys), np.concatenate(n)
            vocabulary, tokens = np.unique(keys, return_inverse=True)
            row = [block, sum(ids, []), sum(flags, []), n.tolist(), len(vocabulary), len(keys), pa.compress(spread(vocabulary), "zstd", asbytes=True), press(tokens.astype(np.uint32))]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, ARROW_BLOCK)], schema=ARROW_BLOCK)

        for batch in batches:
            for at, texts in slices(batch.column(2), block_bytes):
                more = pc.sum(pc.binary_length(texts)).as_py()
                if filled and filled + more > block_bytes:
                    yield close()
                    block, filled = block + 1, 0
                filled += more
                held.append((batch.column(0).slice(at, len(texts)).to_pylist(), batch.column(1).slice(at, len(texts)).to_pylist(), *token_keys(texts)))
        if held:
            yield close()

    return docs.mapInArrow(run, BLOCK)


@dataclass
class Grams:
    """The distinct n-grams of one order in a block: at (of each token; -1 where a text's start cuts it off), key, own and total
    training counts, whether other blocks have it, and the places of those that are sent, by key."""

    at: np.ndarray
    key: np.ndarray
    own: np.ndarray
    total: np.ndarray
    abroad: np.ndarray
    asked: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


class Block:
    """Tokens of one block and its n-grams, order by order; ``answer`` puts the corpus counts in."""

    def __init__(self, row: dict, buckets: int):
        self.row, self.buckets = row, buckets
        self.vocabulary = gathered(pa.decompress(row["vocabulary"], 8 * row["words"], "zstd", asbytes=True))
        self.tokens = opened(row["text"], row["tokens"], np.uint32).astype(np.int32)
        self.n = np.asarray(row["n"], np.int64)
        self.start = np.cumsum(self.n) - self.n
        self.train = np.repeat(~np.asarray(row["held"], bool), self.n)
        self.end = int(np.searchsorted(self.vocabulary, END))  # every text ends with it
        self.orders: list[Grams] = []

    def add_order(self) -> Grams:
        """The n-grams one longer than before; ``asked`` are those whose counts other blocks may add to."""
        size = len(self.vocabulary)
        if not self.orders:
            at, key = self.tokens, self.vocabulary
            where = np.arange(size)
        else:
            short = self.orders[-1]
            head = np.empty_like(short.at)
            head[1:] = short.at[:-1]
            head[self.start] = self.end if len(self.orders) == 1 else -1  # a text begins in the state of its end symbol
            good = np.flatnonzero(head >= 0)
            found, place, one = ranked(head[good].astype(np.int64) * size + self.tokens[good])
            del head
            at = np.full(len(short.at), -1, np.int32)
            at[good] = place
            parent = found // size
            key = short.key[parent] * _P[len(self.orders) % 8]
            key += mixed(self.vocabulary)[found - parent * size]
            key = mixed(key)
            # the n-gram without its first word ends at the same token, at any place where it stands
            where = np.flatnonzero(short.abroad[parent] & short.abroad[short.at[good[one]]])
            del good, found, place, one, parent
        own = np.bincount(at[self.train & (at >= 0)], minlength=len(key))
        grams = Grams(at, key, own, own, np.zeros(len(key), bool))
        grams.asked = where[np.argsort(key[where])]
        self.orders.append(grams)
        return grams

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, places) of what the last order sends; only buckets that get something. Buckets are ranges of keys."""
        g = self.orders[-1]
        bucket = ((g.key[g.asked] >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)
        cut = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
        for a, b in zip(cut, [*cut[1:], len(bucket)]):
            yield int(bucket[a]), g.asked[a:b]

    def answer(self, answers: dict[int, bytes]) -> None:
        g = self.orders[-1]
        g.total = g.own.copy()
        for bucket, where in self.parts():
            got = opened(answers.pop(bucket), len(where), np.int64)
            g.total[where], g.abroad[where] = got >> 1, (got & 1) == 1
        g.asked = g.own = np.zeros(0, np.int64)  # they have done their work


def ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values ascending, rank of each element's value, place of one element of each value)."""
    bits = max(1, len(x).bit_length())
    if not len(x) or int(x.max()).bit_length() + bits > 63:
        found, one, place = np.unique(x, return_index=True, return_inverse=True)
        return found, place, one
    # value and place in one integer: a single sort in place
    both = x << bits
    both |= np.arange(len(x))
    both.sort()
    place = both & ((1 << bits) - 1)
    both >>= bits
    first = np.concatenate([[True], both[1:] != both[:-1]])
    rank = np.empty(len(x), np.int32)
    rank[place] = np.cumsum(first, dtype=np.int32) - np.int32(1)
    return both[first], rank, place[first]


CHUNK = "block long, level int, bucket int, n int, keys binary, counts binary"
ARROW_CHUNK = pa.schema([("block", pa.int64()), ("level", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def with_answers(batches, buckets: int, levels: int) -> Iterator[Block]:
    """Blocks with the orders that have been answered: rows of a block follow each other, answers first."""
    _WORDS.clear()  # tokens have been made
    now, answers = None, {}
    for batch in batches:
        for k in range(len(batch)):
            (r,) = batch.slice(k, 1).to_pylist()
            if r["block"] != now:
                now, answers = r["block"], {}
            if r["tokens"] is None:
                answers.setdefault(r["level"], {})[r["bucket"]] = r["counts"]
            else:
                block = Block(r, buckets)
                for level in range(1, levels + 1):
                    block.add_order()
                    block.answer(answers.pop(level, {}))
                yield block


def meeting(blocks: DataFrame, answers: list[DataFrame], parts: int) -> DataFrame:
    """Rows of blocks and of the answers to them, a block's together, answers first."""
    if not answers:
        return blocks.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("level", "int"), ("bucket", "int"), ("counts", "binary"))))
    rows = blocks
    for a in answers:
        rows = rows.unionByName(a.where("level > 0").select("block", "level", "bucket", "counts"), allowMissingColumns=True)
    return rows.repartition(min(parts, MOST_PARTITIONS), "block").sortWithinPartitions("block", F.col("tokens").isNotNull())


def sent(rows: DataFrame, level: int, buckets: int) -> DataFrame:
    """The chunks of n-grams of one order, by bucket."""

    def run(batches):
        for block in with_answers(batches, buckets, level - 1):
            g = block.add_order()
            out = [(block.row["block"], level, b, len(w), pa.compress(spread(g.key[w]), "zstd", asbytes=True), press(g.own[w])) for b, w in block.parts()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ARROW_CHUNK)], schema=ARROW_CHUNK)

    return rows.mapInArrow(run, CHUNK)


def added_up(chunks: DataFrame, buckets: int) -> DataFrame:
    """Per bucket an answer to each chunk: for each key twice its total count, and one more if two blocks have sent it, for
    texts to learn from or held out. A row of level 0 has the bucket's number of keys
    that training texts have (n) and their tokens (block)."""

    def close(bucket: int, rows: list[dict]) -> pa.RecordBatch:
        keys = [gathered(pa.decompress(r["keys"], 8 * r["n"], "zstd", asbytes=True)) for r in rows]
        counts = np.concatenate([opened(r["counts"], r["n"], np.int64) for r in rows])
        found, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(which, counts, len(found)).astype(np.int64)
        each = 2 * total[which] + (np.bincount(which) > 1)[which]
        ends = np.cumsum([r["n"] for r in rows]).tolist()
        out = [(r["block"], r["level"], bucket, r["n"], None, press(each[e - r["n"] : e])) for r, e in zip(rows, ends)]
        out.append((int(total.sum()), 0, bucket, int((total > 0).sum()), None, None))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ARROW_CHUNK)], schema=ARROW_CHUNK)

    def run(batches):
        now, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if rows and r["bucket"] != now:
                    yield close(now, rows)
                    rows = []
                now = r["bucket"]
                rows.append(r)
        if rows:
            yield close(now, rows)

    return chunks.repartition(min(buckets, MOST_PARTITIONS), "bucket").sortWithinPartitions("bucket", "block").mapInArrow(run, CHUNK)


@dataclass(frozen=True)
class Automaton:
    """Probabilities of a model with corpus totals: training tokens and distinct words among them."""

    model: Model
    tokens: int
    distinct: int

    def root(self, count: np.ndarray) -> np.ndarray:
        m = self.model.mass[0]
        return (count + m) / (self.tokens + m * (self.distinct + 1))

    def arc(self, level: int, count: np.ndarray, context: np.ndarray, below: np.ndarray) -> np.ndarray:
        """P(w | h) of arcs from contexts of ``level`` words: counts of hw and of h, and P(w | h')."""
        m = self.model.mass[level]
        return (count + m * below) / (context + m)

    def failure(self, level: int, context: np.ndarray) -> np.ndarray:
        """log10 weight of the failure arcs of contexts of ``level`` words."""
        m = self.model.mass[level]
        return np.log10(m / (context + m))


#: Tokens that move through the automaton at once.
STEP = 1 << 18


def traversed(block: Block, a: Automaton) -> np.ndarray:
    """log10 weights that the block's tokens take on their way through the automaton.

    Before a token the traversal stands in the state of the longest context that the training texts have. It takes the
    token's arc there, or failure arcs down to the first state that has one; the state after it is the longest suffix of
    what has been read that is a state. Tokens move ``STEP`` at once, and carry the state between steps.
    """
    out = np.empty(len(block.tokens))
    starts = np.zeros(len(block.tokens), bool)
    starts[block.start] = True
    totals = [np.append(g.total, 0) for g in block.orders]  # place -1 has no count
    carried = [-1] * len(block.orders)  # the n-grams of each order that end at the last token of the step before
    for low in range(0, len(out), STEP):
        now = slice(low, low + STEP)
        probability = a.root(totals[0][block.orders[0].at[now]].astype(float))
        walked = np.log10(probability)  # from the root, which has all arcs
        for level in range(1, len(block.orders)):
            state = np.concatenate([[carried[level - 1]], block.orders[level - 1].at[now][:-1]])
            state[starts[now]] = block.end if level == 1 else -1
            context = totals[level - 1][state]
            known = context > 0  # others are no states: the traversal already stands lower
            count = np.where(known, totals[level][block.orders[level].at[now]], 0)
            probability = np.where(known, a.arc(level, count, context, probability), probability)
            walked = np.where(count > 0, np.log10(probability), walked + np.where(known, a.failure(level, context), 0.0))
        carried = [int(g.at[now][-1]) for g in block.orders]
        out[now] = walked
    return out


def lm_scores(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, model: Model = Model()) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    held_out: boolean column; those rows are scored, not learned from; null counts as false. Words are runs of other than
    [\\x20\\x09-\\x0D], A-Z lower-cased, and each text ends with one end token. Null and empty texts are the end alone.
    Repeated rows count as often as they are there, null ids keep their rows. Without training texts every word has
    probability 1. All unknown words share the probability of one word that was never seen. No rows in, no rows out.
    """
    wanted = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), whole_text(text_col).alias("text"))
    blocks = staged(block_rows(wanted, block_bytes), "lm-blocks")
    total = blocks.agg(F.sum("tokens"), F.count("*")).first()
    buckets, parts = max(1, -(-(total[0] or 0) // BUCKET_TOKENS)), max(1, total[1])
    answers: list[DataFrame] = []
    for level in range(1, model.order + 1):
        answers.append(staged(added_up(sent(meeting(blocks, answers, parts), level, buckets), buckets), "lm-answers"))
    sums = answers[0].where("level = 0").agg(F.sum("block"), F.sum("n")).first()
    automaton = Automaton(model, int(sums[0] or 0), int(sums[1] or 0))

    def run(batches):
        for block in with_answers(batches, buckets, model.order):
            words = block.orders[0]
            price = np.log10((words.total + 1) / (automaton.tokens + automaton.distinct + 1))
            add = lambda x: np.add.reduceat(x, block.start)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block.row["ids"], pa.int64()), pa.array(block.row["held"], pa.bool_()), pa.array(block.n), pa.array(add((words.total > 0).astype(np.int64)[words.at])),
                    pa.array(np.full(len(block.n), automaton.tokens)), pa.array(add(price[words.at])), pa.array(add(traversed(block, automaton))),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    out = staged(meeting(blocks, answers, parts).mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "lm-scores")
    unstage(blocks, *answers)
    return out


def op10(spark, sf_dir):
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    return lm_scores(table(spark, sf_dir, "documents"), held)
