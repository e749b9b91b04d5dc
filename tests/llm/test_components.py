import random

from rasterflow.llm.components import components


def test_labels_are_least_nodes(spark):
    r = random.Random(6)
    links = [(i, i + 1) for i in range(100, 160)] + [(900 + i, 5) for i in range(30)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(7, 7), (161, 100)]
    root = {n: n for e in links for n in e if e[0] != e[1]}
    for _ in root:
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {x.node: x.label for x in got} == root and len(got) == len(root)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
