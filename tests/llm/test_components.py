import random

from tablesync.llm.components import connected


def groups(spark, edges):
    df = spark.createDataFrame(edges, "u long, v long")
    return {r["node"]: r["label"] for r in connected(df).collect()}


def test_chain_star_and_random(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1000, i) for i in range(1001, 1060)]
    mixed = [(rng.randrange(2000, 2080), rng.randrange(2000, 2080)) for _ in range(50)]
    edges = chain + star + mixed + [(5, 5), (-7, 3)]
    rng.shuffle(edges)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        parent[max(root(u), root(v))] = min(root(u), root(v))
    wanted = {x: root(x) for u, v in edges if u != v for x in (u, v)}
    assert groups(spark, edges) == wanted


def test_no_links(spark):
    assert groups(spark, []) == {} and groups(spark, [(1, 1)]) == {}
