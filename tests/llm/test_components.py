import random

from tidemark.llm.components import components


def test_paths_stars_and_noise(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(1000, 1200)] + [(5, i) for i in range(2000, 2100)] + [(9999, i) for i in range(3000, 3050)]
    links += [(rng.randrange(50), rng.randrange(50)) for _ in range(40)] + [(7, 7), (None, 3), (3, None)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = sorted((v, find(v)) for v in list(root))
    got = components(spark.createDataFrame(links, "p long, q long"), "p", "q").collect()
    assert sorted(map(tuple, got)) == want


def test_no_links(spark):
    assert components(spark.createDataFrame([], "p long, q long"), "p", "q").collect() == []
