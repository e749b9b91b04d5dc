from rasterflow.operators import blocks


def scored(s, w, h, size):
    """Modes of each block, walked one by one."""
    out = {}
    for by in range(0, h, size):
        for bx in range(0, w, size):
            above = [s[by - 1][bx + i] for i in range(size)] if by else []
            left = [s[by + i][bx - 1] for i in range(size)] if bx else []
            n = len(above) + len(left)
            dc = (sum(above) + sum(left) + n // 2) // n if n else 128
            a, l = above or [127] * size, left or [129] * size
            c = (s[by - 1][bx - 1] if bx else 129) if by else 127
            guess = (lambda i, j: dc, lambda i, j: a[j], lambda i, j: l[i], lambda i, j: min(max(l[i] + a[j] - c, 0), 255))
            out[by // size, bx // size] = [sum(abs(s[by + i][bx + j] - g(i, j)) for i in range(size) for j in range(size)) for g in guess]
    return out


def test_modes_include_the_mean_of_the_edges(spark):
    import random

    r = random.Random(1)
    w, h, size = 48, 32, 16
    s = [[r.randint(90, 130) if x < 32 else 255 * ((x + y) % 2) for x in range(w)] for y in range(h)]
    px = spark.createDataFrame([(1, y, x, s[y][x]) for y in range(h) for x in range(w)], "image_id int, y int, x int, r int")
    want = scored(s, w, h, size)
    scores = blocks.mode_scores(px).cache()
    got = {(m.mby, m.mbx, m.mode): m.sad for m in scores.collect()}
    assert got == {(*k, m): v for k, vs in want.items() for m, v in enumerate(vs)}
    best = {(m.mby, m.mbx): m.mode for m in blocks.best_mode(scores).collect()}
    assert best == {k: vs.index(min(vs)) for k, vs in want.items()} and 0 in best.values()
    kept = {(m.mby, m.mbx, m.mode) for m in blocks.pruned_modes(scores, 2).collect()}
    assert kept == {(*k, m) for k, vs in want.items() for m in sorted(range(4), key=lambda m: (vs[m], m))[:2]}


def test_first_mode_wins_ties(spark):
    flat = spark.createDataFrame([(1, y, x, 7) for y in range(32) for x in range(32)], "image_id int, y int, x int, r int")
    best = {(m.mby, m.mbx): (m.mode, m.sad) for m in blocks.best_mode(blocks.mode_scores(flat)).collect()}
    assert best[1, 1] == (0, 0)
