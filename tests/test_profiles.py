from rasterflow.operators import metadata


def test_profiles_are_bounded_before_payloads_are_collected(spark):
    rows = [("most", i, 255, bytes([i])) for i in range(255, 0, -1)] + [("beyond", i, 256, b"x") for i in range(1, 257)]
    rows += [("gap", 1, 3, b"a"), ("gap", 3, 3, b"c"), ("twice", 1, 2, b"a"), ("twice", 1, 2, b"ab"), ("twice", 2, 2, b"c")]
    rows += [("none", 0, 1, b"a"), ("none", None, None, b"b"), ("late", 1, 1, b"a"), ("late", 2, 300, b"b")]
    out = metadata.assembled_profiles(spark.createDataFrame(rows, "path string, seq int, total int, payload binary")).collect()
    got = {r.path: (bytes(r.profile) if r.profile is not None else None, r.status) for r in out}
    bad = (None, "error")
    assert len(out) == 6 and got == {"most": (bytes(range(1, 256)), "ok"), "twice": (b"abc", "ok"), "beyond": bad, "gap": bad, "none": bad, "late": bad}
    free = {r.path: r.profile for r in metadata.assembled_profiles(spark.createDataFrame(rows, "path string, seq int, total int, payload binary"), most=None).collect()}
    assert bytes(free["beyond"]) == b"x" * 256 and free["gap"] is free["late"] is free["none"] is None
