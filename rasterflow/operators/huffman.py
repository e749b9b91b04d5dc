"""Decode tables of JPEG files: table segments to codes by sums over lengths, and to prefix tables by exploding short codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterflow.operators.walks import let, number

TABLE = "struct<at:bigint,found:array<struct<class:bigint,id:bigint,counts:array<bigint>,symbols:binary,status:string>>>"


def _tables(data: Column) -> Column:
    """The tables of one segment, one step each: a head of 17 bytes and as many symbols as its counts add up to."""
    size = F.octet_length(data).cast("bigint")

    def step(s: Column) -> Column:
        spec = number(data, s["at"], 1)
        counts = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: F.coalesce(number(data, s["at"] + k, 1), F.lit(0).cast("bigint")))

        def taken(h: Column) -> Column:
            total = F.aggregate(h["counts"], F.lit(0).cast("bigint"), lambda a, c: a + c)
            # a code of a length may take no more places than longer ones leave
            kraft = F.aggregate(F.transform(h["counts"], lambda c, k: c * F.pow(F.lit(2.0), F.lit(15) - k)), F.lit(0.0), lambda a, c: a + c)
            status = F.when(s["at"] + 17 + total > size, "truncated").when(kraft > 65536, "overfull").otherwise("ok")
            item = F.struct(
                F.shiftright(h["spec"], 4).alias("class"), h["spec"].bitwiseAND(F.lit(15)).alias("id"), h["counts"].alias("counts"),
                F.substring(data, (s["at"] + 18).cast("int"), total.cast("int")).alias("symbols"), status.alias("status"),
            )
            return F.struct((s["at"] + 17 + total).alias("at"), F.array_append(s["found"], item).alias("found")).cast(TABLE)

        return F.when(s["at"] >= size, s).otherwise(let(F.struct(spec.alias("spec"), counts.alias("counts")), taken))

    steps = F.sequence(F.lit(1), F.greatest(F.ceil(size / 17), F.lit(1)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).cast("bigint").alias("at"), F.array().alias("found")).cast(TABLE), lambda s, _: step(s))["found"]


def table_definitions(segments: DataFrame, key: str = "path") -> DataFrame:
    """Rows (key, class, id, counts, symbols, status) of table segments (key, place, data), as ``walks.segments`` gives them under
    the name C4: of definitions of one class and number the last stays. status: ok, truncated (counts or symbols are cut
    short), overfull (more codes than their lengths allow)."""
    each = segments.select(key, "place", F.posexplode(let(F.coalesce("data", F.lit(b"")), _tables)).alias("i", "t")).select(key, "place", "i", "t.*")
    last = each.groupBy(key, "class", "id").agg(F.max_by(F.struct("counts", "symbols", "status"), F.struct("place", "i")).alias("t"))
    return last.select(key, "class", "id", "t.counts", "t.symbols", "t.status")


def code_list(counts: Column, symbols: Column) -> Column:
    """Array of (length, code, symbol) of a sound table in order of codes, in the row itself.

    The first code of a length is the sum of the shorter ones' counts, each shifted by the difference of lengths; a symbol's
    place is the sum of the shorter counts and its own number.
    """
    zero = F.lit(0).cast("bigint")

    def codes(n: Column, k: Column) -> Column:
        first = lambda s: F.aggregate(s, zero, lambda a, c: (a + c) * 2)
        before = lambda s: F.aggregate(s, zero, lambda a, c: a + c)
        code = lambda h, i: F.struct((k + 1).alias("length"), (h["first"] + i).alias("code"), number(symbols, h["before"] + i, 1).alias("symbol"))
        each = lambda h: F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: code(h, i))
        own = let(F.slice(counts, F.lit(1), k), lambda s: let(F.struct(first(s).alias("first"), before(s).alias("before")), each))
        return F.when(n > 0, own).otherwise(F.array().cast("array<struct<length:int,code:bigint,symbol:bigint>>"))

    return F.flatten(F.transform(counts, codes))


def prefix_list(codes: Column, bits: int = 8) -> Column:
    """Array of (prefix, length, symbol) in order of prefixes, from a ``code_list``, as ``prefix_table`` has it in rows."""
    room = lambda c: F.pow(F.lit(2), F.lit(bits) - c["length"]).cast("bigint")
    span = lambda c, r: F.transform(F.sequence(c["code"] * r, (c["code"] + 1) * r - 1), lambda p: F.struct(p.alias("prefix"), c["length"].alias("length"), c["symbol"].alias("symbol")))
    return F.flatten(F.transform(F.filter(codes, lambda c: c["length"] <= bits), lambda c: let(room(c), lambda r: span(c, r))))


def table_codes(definitions: DataFrame, key: str = "path") -> DataFrame:
    """Rows (key, class, id, length, code, symbol) of the sound definitions."""
    return definitions.where("status = 'ok'").select(key, "class", "id", F.inline(code_list(F.col("counts"), F.col("symbols"))))


def prefix_table(codes: DataFrame, key: str = "path", bits: int = 8) -> DataFrame:
    """Rows (key, class, id, prefix, length, symbol): for every value of the next ``bits`` bits that a code of at most so many
    begins, that code's length and symbol; 256 rows a table at most."""
    short = codes.where(F.col("length") <= bits)
    room = F.pow(F.lit(2), bits - F.col("length")).cast("bigint")
    return short.select(key, "class", "id", F.explode(F.sequence(F.col("code") * room, (F.col("code") + 1) * room - 1)).alias("prefix"), "length", "symbol")


def long_codes(codes: DataFrame, key: str = "path", bits: int = 8) -> DataFrame:
    """Rows (key, class, id, length, low, high) of the lengths over ``bits``: the least and the greatest code."""
    return codes.where(F.col("length") > bits).groupBy(key, "class", "id", "length").agg(F.min("code").alias("low"), F.max("code").alias("high"))
