"""RIFF containers assembled, and file heads probed, with binary expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterflow.functions.integers import be_uint, le32, le_uint

PNG_MAGIC = "89504E470D0A1A0A"
#: Bytes of a file that its head facts need: the longest BMP header, and masks behind it.
HEAD_BYTES = 160
#: Lengths of BMP headers that can hold or precede channel masks.
BMP_HEADS = (40, 52, 56, 108, 124)
ALPHA_POLICIES = {"keep": "kept", "flatten": "flattened", "fail": "failed"}


def riff_chunk(name: str, payload: Column) -> Column:
    """Four letters, little-endian length, payload, and a zero byte after an odd length."""
    pad = F.when(F.octet_length(payload) % 2 == 1, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("")))
    return F.concat(F.lit(name.encode()), le32(F.octet_length(payload)), payload, pad)


def webp(payload: Column, width: Column, height: Column, alpha: Column, profile: Column) -> Column:
    """A WebP file: the picture chunk alone, or after VP8X and the chunks of a profile and alpha where either is not null."""
    le24 = lambda n: F.substring(le32(n), 1, 3)
    flags = F.when(profile.isNotNull(), 32).otherwise(0) + F.when(alpha.isNotNull(), 16).otherwise(0)
    head = riff_chunk("VP8X", F.concat(le32(flags), le24(width - 1), le24(height - 1)))
    none = F.unhex(F.lit(""))
    extended = F.concat(head, F.coalesce(riff_chunk("ICCP", profile), none), F.coalesce(riff_chunk("ALPH", alpha), none))
    chunks = F.concat(F.when(flags > 0, extended).otherwise(none), riff_chunk("VP8 ", payload))
    return F.concat(F.lit(b"RIFF"), le32(F.octet_length(chunks) + 4), F.lit(b"WEBP"), chunks)


def frame_tag(first_partition: Column) -> Column:
    """Three bytes before a key frame: shown, profile 0, size of the first partition; null where it exceeds 19 bits."""
    return F.when(first_partition < (1 << 19), F.substring(le32(first_partition * 32 + 16), 1, 3))


def file_type(content: Column) -> Column:
    """webp, bmp, png or jpeg by content, never by name; null for others."""
    begins = lambda h: F.hex(F.substring(content, 1, len(h) // 2)) == h
    return (
        F.when(begins("52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250"), "webp")
        .when(begins("424D"), "bmp").when(begins(PNG_MAGIC), "png").when(begins("FFD8FF"), "jpeg")
    )


def bmp_has_alpha(content: Column) -> Column:
    """Whether a BMP of 16 or 32 bits declares an alpha mask that its pixels have room for, in or behind its header."""
    size, bits, packing = le_uint(content, 14, 4), le_uint(content, 28, 2), le_uint(content, 30, 4)
    masks = [F.when(size >= most, le_uint(content, 54 + 4 * i, 4)).otherwise(0) for i, most in enumerate((52, 52, 52, 56))]
    behind = F.coalesce(*(F.when(size == n, le_uint(content, 14 + n + 12, 4)) for n in BMP_HEADS))
    none = (masks[0] == 0) & (masks[1] == 0) & (masks[2] == 0) & (masks[3] == 0)
    mask = F.when(none & (packing == 6), behind).otherwise(masks[3])
    room = ((bits == 16) & (mask < 2**16)) | ((bits == 32) & (mask < 2**32))
    return F.coalesce(size.isin(*BMP_HEADS) & (packing != 0) & (mask != 0) & room, F.lit(False))


def webp_size(content: Column) -> Column:
    """Struct (width, height) from the head of a WebP file, by the kind of its first chunk."""
    chunk, less = F.substring(content, 13, 4).cast("string"), le_uint(content, 21, 4)
    side = lambda x, lossy, lossless: F.when(chunk == "VP8X", x).when(chunk == "VP8 ", lossy).when(chunk == "VP8L", lossless)
    low14 = lambda c: c.bitwiseAND(F.lit(0x3FFF))
    width = side(1 + le_uint(content, 24, 3), low14(le_uint(content, 26, 2)), 1 + low14(less))
    return F.struct(width.alias("width"), side(1 + le_uint(content, 27, 3), low14(le_uint(content, 28, 2)), 1 + low14(F.shiftright(less, 14))).alias("height"))


def head_facts(content: Column, alpha_policy: str = "keep") -> Column:
    """Struct (type, width, height, depth, color_type, may_have_alpha, status, alpha_status) from the first HEAD_BYTES of a file.

    Width and height are null where the head does not hold them (JPEG sizes lie behind a walk of markers). An unreadable
    file is a row with status 'error', a WebP source one with 'skipped_webp'. The policy (keep, flatten, fail) applies to the
    others: alpha_status is kept, flattened or failed where the format may have alpha, none where not.
    """
    kind = file_type(content)
    webp = webp_size(content)
    pick = lambda png, bmp, webp: F.when(kind == "png", png).when(kind == "bmp", bmp).when(kind == "webp", webp)
    signed = lambda c: F.abs(F.when(c >= 2**31, c - 2**32).otherwise(c))
    width = pick(be_uint(content, 16, 4), signed(le_uint(content, 18, 4)), webp["width"])
    height = pick(be_uint(content, 20, 4), signed(le_uint(content, 22, 4)), webp["height"])
    depth = F.when(kind == "png", be_uint(content, 24, 1)).when(kind == "bmp", le_uint(content, 28, 2))
    color = F.when(kind == "png", be_uint(content, 25, 1))
    alpha = F.when(kind == "webp", F.lit(True)).when(kind == "png", color.isin(4, 6)).when(kind == "bmp", bmp_has_alpha(content)).otherwise(F.lit(False))
    status = F.when(kind == "webp", "skipped_webp").when(kind.isNull() | ((kind != "jpeg") & width.isNull()), "error").otherwise("ok")
    policy = F.when(status == "ok", F.when(alpha, ALPHA_POLICIES[alpha_policy]).otherwise("none"))
    return F.struct(
        kind.alias("type"), width.alias("width"), height.alias("height"), depth.alias("depth"), color.alias("color_type"), alpha.alias("may_have_alpha"), status.alias("status"),
        policy.alias("alpha_status"),
    )
