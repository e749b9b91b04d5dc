from rasterflow.operators import entropy


def test_values_outside_the_format_stay_rows(spark):
    ends = [None, -(2**63), -1, 0, 1, 4, 5, 6, 7, 1_048_575, 1_048_576, 1_048_577, 2**63 - 1]
    out = entropy.prefix_codes(spark.createDataFrame([(i, v) for i, v in enumerate(ends)], "k int, value long")).collect()
    got = {r.value: (r.prefix, r.extra_bits, r.extra, r.status) for r in out}
    assert len(out) == len(ends) and set(got) == set(ends)
    for v in (None, -(2**63), -1, 0, 1_048_577, 2**63 - 1):
        assert got[v] == (None, None, None, "error"), v
    assert got[1] == (0, 0, 0, "ok") and got[4] == (3, 0, 0, "ok")
    assert got[5] == (4, 1, 0, "ok") and got[6] == (4, 1, 1, "ok") and got[7] == (5, 1, 0, "ok")
    assert got[1_048_576] == (39, 18, (1 << 18) - 1, "ok") and got[1_048_575] == (39, 18, (1 << 18) - 2, "ok")
