import struct

import pytest

from rasterflow.sources import files


def bmp(size, bits, packing, masks):
    """A header of ``size`` bytes with masks in it or behind it, and no pixels."""
    head = struct.pack("<IiiHHIIiiII", size, 1, 1, 1, bits, packing, 0, 0, 0, 0, 0)
    return b"BM" + struct.pack("<IHHI", 0, 0, 0, 0) + (head + struct.pack("<4I", *masks)).ljust(size, b"\0") + b"\0" * 8


RGBA = (0xFF0000, 0xFF00, 0xFF, 0xFF000000)


def test_bmp_alpha_masks_and_policies(spark, tmp_path):
    png = lambda color: b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBBI", 13, b"IHDR", 1, 1, 8, color, 0, 0, 0, 0)
    made = {
        "v4": (bmp(108, 32, 3, RGBA), True), "v3": (bmp(56, 16, 3, (31, 992, 0, 0x8000)), True), "behind": (bmp(40, 32, 6, RGBA), True),
        "far": (bmp(124, 32, 6, (0, 0, 0, 0))[:138] + struct.pack("<4I", *RGBA), True), "rgb": (bmp(108, 32, 0, RGBA), False),
        "three": (bmp(40, 32, 3, RGBA), False), "24": (bmp(108, 24, 3, RGBA), False), "no room": (bmp(108, 16, 3, RGBA), False),
        "none": (bmp(108, 32, 3, (*RGBA[:3], 0)), False), "png": (png(6), True), "grey": (png(0), False), "jpeg": (b"\xff\xd8\xff\xe0", False),
    }
    for name, (data, _) in made.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "bad").write_bytes(b"plain")
    for policy, said in (("keep", "kept"), ("flatten", "flattened"), ("fail", "failed")):
        got = {r.path.rsplit("/", 1)[1].replace("%20", " "): r["head"] for r in files.heads(spark, f"file://{tmp_path}", alpha_policy=policy).collect()}
        assert (got["bad"].status, got.pop("bad").alpha_status) == ("error", None)
        assert {k: (v.may_have_alpha, v.alpha_status) for k, v in got.items()} == {k: (has, said if has else "none") for k, (_, has) in made.items()}
    with pytest.raises(KeyError):
        files.heads(spark, f"file://{tmp_path}", alpha_policy="drop")
