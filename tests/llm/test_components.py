import random

from cellgrain.llm.components import components


def brute(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for n, g in pairs:
        a, b = find(("g", g)), find(("n", n))
        parent[a] = b
    least = {}
    for n, _ in pairs:
        r = find(("n", n))
        least[r] = min(least.get(r, n), n)
    return {n: least[find(("n", n))] for n, _ in pairs}


def test_components(spark):
    draw = random.Random(2)
    pairs = [(draw.randrange(300), draw.randrange(260)) for _ in range(330)]
    pairs += [(1000 + i, 5000 + j) for i in range(60) for j in (i, i + 1)]  # a chain
    pairs += [(2000 + i, 9999) for i in range(200)] + [(2000, 1), (2000, 1)]  # one hot group
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(pairs, "node long, `group` long")).collect()}
    assert got == brute(pairs)
    assert components(spark.createDataFrame([], "node long, `group` long")).count() == 0
