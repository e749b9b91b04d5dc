"""Walks over files of variable-length parts as recursive queries: PNG chunks, JPEG segments, RIFF chunks; BMP headers by offset.

A round takes every file that is not finished ``STRIDE`` segments further and gives one row a file; the next round reads
only the files still open, and only their bytes travel with them. Nearly all files end in the first round, so a table is
read once, and a file of very many segments costs rounds, not one endless task. A step reads a segment's head and jumps by
its length; payloads are cut out by offset, and only those that are asked for. Every input is a row with a status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterflow.functions.integers import be_uint, le_uint
from rasterflow.operators.container import BMP_HEADS, HEAD_BYTES

PNG_MAGIC = "89504E470D0A1A0A"
#: Segments of a file that one round walks.
STRIDE = 64
#: Bytes that are searched for the next marker at a time.
WINDOW = 1 << 14
PARTS = "array<struct<name:string,at:bigint,length:bigint,data:binary,intact:boolean>>"
STATE = f"struct<at:bigint,parts:{PARTS},status:string,head:boolean,full:boolean>"
#: Largest transparency chunk and profile chunk that a head walk takes.
HEAD_LIMITS = {"tRNS": 1024, "iCCP": 1 << 24}


def number(content: Column, at: Column, size: int, little: bool = False) -> Column:
    """Unsigned integer of ``size`` bytes at a computed offset (from 0)."""
    h = F.hex(F.substring(content, (at + 1).cast("int"), F.lit(size)))
    if little:
        h = F.concat(*(F.substring(h, 2 * k + 1, 2) for k in reversed(range(size))))
    return F.conv(h, 16, 10).cast("bigint")


def part(content: Column, at: Column, size: Column) -> Column:
    return F.substring(content, (at + 1).cast("int"), size.cast("int"))


def _bytes(at: str, size: str) -> str:
    return f"substring(c, CAST({at} AS INT) + 1, CAST({size} AS INT))"


def _uint(at: str, size: int, little: bool = False) -> str:
    h = f"hex({_bytes(at, str(size))})"
    if little:
        h = f"transform(array({h}), x -> concat({', '.join(f'substring(x, {2 * k + 1}, 2)' for k in reversed(range(size)))}))[0]"
    return f"CAST(conv({h}, 16, 10) AS BIGINT)"


def _state(at: str, parts: str = "s.parts", status: str = "NULL", head: str = "s.head", full: str = "s.full") -> str:
    return f"CAST(named_struct('at', {at}, 'parts', {parts}, 'status', {status}, 'head', {head}, 'full', {full}) AS {STATE})"


def _grown(name: str, length: str, data: str, intact: str) -> str:
    return f"array_append(s.parts, named_struct('name', {name}, 'at', s.at, 'length', {length}, 'data', {data}, 'intact', {intact}))"


def _with(fields: dict[str, str], body: str) -> str:
    """body, with h as a record of the fields, each computed once."""
    named = ", ".join(f"'{k}', {v}" for k, v in fields.items())
    return f"transform(array(named_struct({named})), h -> {body})[0]"


def _png_step(names: tuple[str, ...] = ("IHDR", "PLTE", "tRNS", "iCCP")) -> str:
    name, crc = f"decode({_bytes('s.at + 4', '4')}, 'ISO-8859-1')", f"crc32({_bytes('s.at + 4', 'h.n + 4')}) = {_uint('s.at + 8 + h.n', 4)}"
    kept = f"CASE WHEN h.name IN ({', '.join(map(repr, names))}) THEN {_bytes('s.at + 8', 'h.n')} END"
    status = """CASE WHEN NOT k.intact THEN 'bad_checksum' WHEN h.name = 'IHDR' AND (s.head OR h.n <> 13) THEN 'bad_header'
      WHEN h.name = 'IEND' THEN CASE WHEN NOT s.head THEN 'bad_header' WHEN NOT s.full THEN 'no_data' ELSE 'ok' END END"""
    moved = _state("s.at + 12 + h.n", _grown("h.name", "h.n", kept, "k.intact"), status, "s.head OR h.name = 'IHDR'", "s.full OR (h.name = 'IDAT' AND h.n > 0)")
    return f"""CASE WHEN s.at + 12 > z THEN {_state("s.at", status="CASE WHEN s.head THEN 'truncated' ELSE 'bad_header' END")}
    ELSE {_with({"n": _uint("s.at", 4), "name": name}, f"CASE WHEN h.n > z - s.at - 12 THEN {_state('s.at', status=repr('truncated'))} ELSE transform(array(named_struct('intact', {crc})), k -> {moved})[0] END")} END"""


def _png_head_step() -> str:
    limits = " ".join(f"WHEN h.name = '{k}' AND h.n <= {v} THEN {_bytes('s.at + 8', 'h.n')}" for k, v in HEAD_LIMITS.items())
    kept = f"CASE WHEN h.name = 'IHDR' AND h.n = 13 THEN {_bytes('s.at + 8', '13')} {limits} END"
    over = _state("s.at", status="CASE WHEN s.full THEN 'ok' ELSE 'bad_header' END")
    moved = _state("s.at + 12 + h.n", _grown("h.name", "h.n", kept, "s.at + 12 + h.n <= z"), head="TRUE", full="s.full OR (h.name = 'IHDR' AND h.n = 13)")
    stops = "h.name IN ('IDAT', 'IEND') OR (NOT s.head AND h.name <> 'IHDR') OR (h.name = 'IHDR' AND h.n = 13 AND s.at + 21 > z)"
    name = f"decode({_bytes('s.at + 4', '4')}, 'ISO-8859-1')"
    return f"CASE WHEN s.at + 8 > z THEN {over} ELSE {_with({'n': _uint('s.at', 4), 'name': name}, f'CASE WHEN {stops} THEN {over} ELSE {moved} END')} END"


def _jpeg_step() -> str:
    """At a marker with a length: one segment. Elsewhere: on to the next such marker, over filler, restart and other bytes."""
    found = r"regexp_instr(decode(" + _bytes("s.at", str(WINDOW)) + r", 'ISO-8859-1'), r'(?<=\xFF)[^\xFF\x01\xD0-\xD9]')"
    searched = _with({"p": found}, f"CASE WHEN h.p > 0 THEN {_state('s.at + h.p - 2')} WHEN s.at + {WINDOW} >= z THEN {_state('z', status=repr('truncated'))} ELSE {_state(f's.at + {WINDOW - 1}')} END")
    kept = f"CASE WHEN h.m LIKE 'C%' OR h.m = 'E2' THEN {_bytes('s.at + 4', 'h.n')} END"
    held = f"""CASE WHEN h.m = 'DA' THEN {_state("s.at", status=repr("ok"))} WHEN s.at + 4 > z OR h.n < 0 THEN {_state("s.at", status=repr("truncated"))}
      ELSE {_state("s.at + 4 + h.n", _grown("h.m", "h.n", kept, "s.at + 4 + h.n <= z"))} END"""
    at_marker = _with({"m": f"hex({_bytes('s.at + 1', '1')})", "n": f"{_uint('s.at + 2', 2)} - 2"}, held)
    return f"CASE WHEN s.at + 2 > z THEN {_state('s.at', status=repr('truncated'))} WHEN hex({_bytes('s.at', '2')}) RLIKE '^FF(?!FF|01|D[0-9])' THEN {at_marker} ELSE {searched} END"


def _riff_step() -> str:
    fits = "s.at + 8 + h.n <= z"
    moved = _state("s.at + 8 + h.n + h.n % 2", _grown(f"decode({_bytes('s.at', '4')}, 'ISO-8859-1')", "h.n", "NULL", fits), f"CASE WHEN NOT ({fits}) THEN 'truncated' END")
    return f"CASE WHEN s.at + 8 > z THEN {_state('s.at', status=repr('ok'))} ELSE {_with({'n': _uint('s.at + 4', 4, little=True)}, moved)} END"


#: For each kind of walk: where it begins, whether the file is of its kind (else the status), and the step.
WALKS = {
    "png": (8, f"hex({_bytes('0', '8')}) = '{PNG_MAGIC}'", "not_png", _png_step()),
    "png_data": (8, f"hex({_bytes('0', '8')}) = '{PNG_MAGIC}'", "not_png", _png_step(("IHDR", "PLTE", "tRNS", "IDAT"))),
    "png_head": (8, f"hex({_bytes('0', '8')}) = '{PNG_MAGIC}'", "not_png", _png_head_step()),
    "jpeg": (2, f"hex({_bytes('0', '2')}) = 'FFD8'", "not_jpeg", _jpeg_step()),
    "riff": (12, f"hex({_bytes('0', '4')}) = '52494646' AND {_uint('4', 4, little=True)} + 8 = z", "not_riff", _riff_step()),
}


def walked(files: DataFrame, kinds: tuple[str, ...], key: str = "path", content: str = "content", kind: Column | None = None) -> DataFrame:
    """Rows (key, turn, at, parts, status) of the files: one a round, the last of each file with its status.

    kinds: the walks that may occur; kind: names the one of each row, where there are several. Files of null content are
    walked as empty ones. Keys tell files apart. Statuses: ok; not_png, not_jpeg, not_riff; truncated (a segment, or the end or
    scan, is missing); of PNG also bad_checksum, bad_header (none, two, or not of 13 bytes) and no_data.
    """
    named = files.select(F.col(key).alias("key"), F.coalesce(content, F.lit(b"")).alias("content"), (F.lit(kinds[0]) if kind is None else kind).alias("kind"))
    pick = lambda of: "CASE kind " + " ".join(f"WHEN '{k}' THEN {of(*WALKS[k])}" for k in kinds) + " END"
    start = f"CAST(named_struct('at', {pick(lambda at, *_: at)}, 'parts', array(), 'status', CASE WHEN NOT coalesce({pick(lambda _, good, *__: good)}, FALSE) THEN {pick(lambda _, __, status, ___: repr(status))} END, 'head', FALSE, 'full', FALSE) AS {STATE})"
    onwards = f"CAST(named_struct('at', w.at, 'parts', array(), 'status', NULL, 'head', w.head, 'full', w.full) AS {STATE})"
    # the file's bytes and their number as lambda variables: they are fetched from the row once, not once a step
    fold = lambda begin: f"transform(array(content), c -> transform(array(CAST(octet_length(c) AS BIGINT)), z -> aggregate(sequence(1, {STRIDE}), {begin}, (s, i) -> CASE WHEN s.status IS NOT NULL THEN s ELSE {pick(lambda *x: x[3])} END))[0])[0]"
    carried = "key, kind, turn, w, CASE WHEN w.status IS NULL THEN content END AS content"
    rounds = files.sparkSession.sql(
        f"""WITH RECURSIVE walk MAX RECURSION LEVEL 1000000000 AS (
          SELECT {carried} FROM (SELECT key, kind, content, 0 AS turn, {fold(start)} AS w FROM {{named}})
          UNION ALL
          SELECT {carried} FROM (SELECT key, kind, content, turn + 1 AS turn, {fold(onwards)} AS w FROM walk WHERE w.status IS NULL))
        SELECT key, turn, w.at, w.parts, w.status FROM walk LIMIT ALL""",
        named=named,
    )
    return rounds.withColumnRenamed("key", key)


def segments(walk: DataFrame, key: str = "path") -> DataFrame:
    """Rows (key, place, name, at, length, data, intact): the parts of all rounds; place orders those of a file."""
    each = walk.select(key, "turn", F.posexplode("parts").alias("i", "p"))
    return each.select(key, (F.col("turn") * STRIDE + F.col("i")).cast("long").alias("place"), "p.name", "p.at", "p.length", "p.data", "p.intact")


def last_data(parts: Column, name: str) -> Column:
    """The data of the last part of a name: later ones override; null without any."""
    own = F.filter(parts, lambda p: (p["name"] == name) & p["data"].isNotNull())
    return F.get(own, F.size(own) - 1)["data"]


def first_frame(parts: Column) -> Column:
    """The first frame segment: a record of marker and data; null without one."""
    own = F.filter(parts, lambda p: p["name"].isin(*FRAMES))
    return F.when(F.size(own) > 0, F.struct(F.get(own, F.lit(0))["name"].alias("marker"), F.get(own, F.lit(0))["data"].alias("data")))


def file_facts(walk: DataFrame, key: str = "path", last: tuple[str, ...] = ()) -> DataFrame:
    """One row a file: status, at (where the walk ended), n_parts, frame (the first one), and the last data of each name in
    ``last``. Only what rounds found is shuffled, never a file's bytes."""
    datas = [F.max_by(last_data(F.col("parts"), n), F.when(last_data(F.col("parts"), n).isNotNull(), F.col("turn"))).alias(n) for n in last]
    frame = first_frame(F.col("parts"))
    return walk.groupBy(key).agg(F.max("status").alias("status"), F.max("at").alias("at"), F.sum(F.size("parts")).cast("int").alias("n_parts"), F.min_by(frame, F.when(frame.isNotNull(), F.col("turn"))).alias("frame"), *datas)


#: Fixed value: longest profile segment.
MOST_APP2 = 65533 - 14
#: Start-of-frame markers.
FRAMES = [f"{m:02X}" for m in range(0xC0, 0xD0) if m not in (0xC4, 0xC8, 0xCC)]


def frame_size(frame: Column) -> Column:
    """Struct (marker, precision, height, width) of a frame; null fields without one."""
    data = frame["data"]
    return F.struct(frame["marker"].alias("marker"), be_uint(data, 0, 1).alias("precision"), be_uint(data, 1, 2).alias("height"), be_uint(data, 3, 2).alias("width"))


def profile_parts(walk: DataFrame, key: str = "path") -> DataFrame:
    """Rows (key, place, seq, total, payload) of the profile segments, for ``assembled_profiles``."""
    mark = "4943435F50524F46494C4500"
    own = segments(walk, key).where((F.col("name") == "E2") & F.col("length").between(14, MOST_APP2) & (F.hex(F.substring("data", 1, 12)) == mark))
    return own.select(key, "place", be_uint(F.col("data"), 12, 1).alias("seq"), be_uint(F.col("data"), 13, 1).alias("total"), F.expr("substring(data, 15)").alias("payload"))


#: BMP depths, greatest side, most pixels and longest profile.
BMP_DEPTHS, BMP_SIDE, BMP_PIXELS, BMP_PROFILE = (1, 4, 8, 16, 24, 32), 16384, 40_000_000, 1 << 24
#: Channel masks of uncompressed samples by depth, red, green, blue, alpha.
BMP_MASKS = {16: (0x7C00, 0x03E0, 0x001F, 0), 24: (0xFF0000, 0x00FF00, 0x0000FF, 0), 32: (0xFF0000, 0x00FF00, 0x0000FF, 0)}


def let(value: Column, body) -> Column:
    """body of value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bmp_header(content: Column, length: Column | None = None) -> Column:
    """Struct (width, height, top_down, depth, compression, stride, offset, palette_colors, palette_at, palette_entry, masks,
    alpha, profiles, status).

    content: the file, or its first 160 bytes with ``length``, the file's. The core header, of 12 bytes, has 16-bit sizes;
    others have 40, 52, 56, 108 or 124 bytes. offset: where pixels begin, no earlier than the header and its masks end, which
    is where a palette begins, of entries of palette_entry bytes;
    masks: of the samples, in the header or behind it; alpha: whether a mask of alpha lies inside the sample; profiles:
    (at, length) where an embedded profile may lie, absolute offsets after relative ones. status: ok, not_bmp, bad_header
    (its length, or cut short), bad_size (a side of none or over 16,384, or over 40 million pixels), bad_depth (unknown, or
    not that of its run lengths), bad_masks (cut short), bad_offset (behind the end), bad_compression, truncated (rows do
    not fit).
    """
    if length is None:  # the file is fetched from its row once, not once a field
        return let(F.struct(F.substring(content, 1, HEAD_BYTES).alias("head"), F.octet_length(content).alias("n")), lambda v: bmp_header(v["head"], v["n"]))
    size = length.cast("bigint")
    signed = lambda c: F.when(c >= 2**31, c - 2**32).otherwise(c)
    head = le_uint(content, 14, 4)
    core = head == 12
    old = lambda a, b: F.when(core, a).otherwise(b)
    first = F.struct(
        head.alias("head"), core.alias("core"), old(le_uint(content, 18, 2), signed(le_uint(content, 18, 4))).alias("w"), old(le_uint(content, 20, 2), signed(le_uint(content, 22, 4))).alias("h"),
        old(le_uint(content, 24, 2), le_uint(content, 28, 2)).alias("bits"), old(F.lit(0), le_uint(content, 30, 4)).alias("packing"), old(F.lit(0), le_uint(content, 46, 4)).alias("used"), le_uint(content, 10, 4).alias("given"),
        F.array(*(F.when(head >= most, le_uint(content, 54 + 4 * i, 4)).otherwise(F.lit(0)) for i, most in enumerate((52, 52, 52, 56)))).alias("masks"),
    )

    old_entry = lambda f: F.when(f["core"], 3).otherwise(4).cast("bigint")

    def second(f: Column) -> Column:
        fielded = f["packing"].isin(3, 6)
        behind = fielded & ~F.exists(f["masks"], lambda m: m != 0)
        count = F.when(behind, F.when(f["packing"] == 6, 4).otherwise(3)).otherwise(0)
        start = 14 + f["head"]
        at = [F.when(count > i, number(content, start + 4 * i, 4, little=True)) for i in range(4)]
        masks = F.when(behind, F.array(*(F.coalesce(m, F.lit(0).cast("bigint")) for m in at))).otherwise(f["masks"])
        fixed = F.lit(None)
        for bits, values in BMP_MASKS.items():
            fixed = F.when(f["bits"] == bits, F.array(*(F.lit(v).cast("bigint") for v in values))).otherwise(fixed)
        fixed = F.coalesce(fixed.cast("array<bigint>"), F.array(*[F.lit(0).cast("bigint")] * 4))
        masks = F.when((f["packing"] == 0) | (f["bits"] == 24), fixed).otherwise(masks)
        rows, payload = F.abs(f["h"]), start + 4 * count
        stride = F.when(fielded | (f["packing"] == 0), F.floor((f["w"] * f["bits"] + 31) / 32).cast("bigint") * 4).otherwise(F.lit(0))
        offset = F.greatest(f["given"], payload)
        status = (
            F.when(~f["core"] & ~f["head"].isin(*BMP_HEADS), "bad_header").when(size < start, "bad_header")
            .when((f["w"] < 1) | (rows < 1) | (f["w"] > BMP_SIDE) | (rows > BMP_SIDE) | (f["w"] * rows > BMP_PIXELS), "bad_size")
            .when(~f["bits"].isin(*BMP_DEPTHS), "bad_depth").when(size < payload, "bad_masks").when(offset > size, "bad_offset")
            .when(((f["packing"] == 1) & (f["bits"] != 8)) | ((f["packing"] == 2) & (f["bits"] != 4)), "bad_depth").when(~f["packing"].isin(0, 1, 2, 3, 6), "bad_compression")
            .when((stride > 0) & (size - offset < stride * rows), "truncated").otherwise("ok")
        )
        last = F.get(masks, F.lit(3))
        alpha = f["bits"].isin(16, 32) & (last != 0) & (last < F.when(f["bits"] == 16, F.lit(2**16)).otherwise(F.lit(2**32)))
        field, long = le_uint(content, 126, 4), le_uint(content, 130, 4)
        tagged = (f["head"] == 124) & F.hex(F.substring(content, 71, 4)).isin("4445424D", "4D424544") & long.between(132, BMP_PROFILE)
        places = F.filter(F.array(14 + field, field), lambda at: (at > 0) & (at + long <= size))
        colors = F.when(f["bits"] > 8, 0).when(f["used"] > 0, f["used"]).otherwise(F.expr("1L").cast("bigint") * F.pow(F.lit(2), f["bits"]).cast("bigint"))
        return F.struct(
            f["w"].alias("width"), rows.alias("height"), (f["h"] < 0).alias("top_down"), f["bits"].alias("depth"), f["packing"].alias("compression"), stride.alias("stride"), offset.alias("offset"),
            colors.cast("bigint").alias("palette_colors"), payload.cast("bigint").alias("palette_at"), old_entry(f).alias("palette_entry"), masks.alias("masks"), F.coalesce(alpha, F.lit(False)).alias("alpha"),
            F.when(tagged, F.transform(places, lambda at: F.struct(at.alias("at"), long.alias("length")))).otherwise(F.array().cast("array<struct<at:bigint,length:bigint>>")).alias("profiles"),
            F.coalesce(status, F.lit("bad_header")).alias("status"),
        )

    good = (F.hex(F.substring(content, 1, 2)) == "424D") & (F.octet_length(content) >= 26)
    out = let(first, second)
    return F.when(good, out).otherwise(F.struct(*(F.lit(None).cast(t).alias(n) for n, t in BMP_FIELDS), F.lit("not_bmp").alias("status")))


#: The fields of ``bmp_header`` before its status.
BMP_FIELDS = (
    ("width", "bigint"), ("height", "bigint"), ("top_down", "boolean"), ("depth", "bigint"), ("compression", "bigint"), ("stride", "bigint"), ("offset", "bigint"), ("palette_colors", "bigint"),
    ("palette_at", "bigint"), ("palette_entry", "bigint"),
    ("masks", "array<bigint>"), ("alpha", "boolean"), ("profiles", "array<struct<at:bigint,length:bigint>>"),
)


def sound_profile(data: Column) -> Column:
    """The colour profile without what follows its declared length; null unless it has 132 bytes, its signature, and room."""
    declared = be_uint(data, 0, 4)
    good = (F.octet_length(data) >= 132) & (declared >= 132) & (declared <= F.octet_length(data)) & (F.hex(F.substring(data, 37, 4)) == "61637370")
    return F.when(good, part(data, F.lit(0), declared))


def chosen_profile(given: Column, source: Column, drop: bool = False) -> Column:
    """The profile to store: one that is given, else the source's unless ``drop``."""
    return given if drop else F.coalesce(given, source)
