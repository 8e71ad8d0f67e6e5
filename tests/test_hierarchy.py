import random

import pytest
from pyspark.sql import functions as F

from quillmere.operators.hierarchy import descendants, hierarchy

EDGES = "child long, parent long"


def brute(edges):
    parent = {}
    for c, p in edges:
        if c is not None and p is not None:
            parent[c] = min(p, parent.get(c, p))
    out = {}
    for node in {*parent, *parent.values()}:
        chain = [node]
        while chain[-1] in parent and parent[chain[-1]] not in chain:
            chain.append(parent[chain[-1]])
        if chain[-1] in parent:
            out[node] = (None, None, "cycle" if parent[chain[-1]] == node or node in chain[chain.index(parent[chain[-1]]) :] else "below_cycle", None)
        else:
            out[node] = (chain[-1], len(chain) - 1, "tree", tuple(reversed(chain)))
    return out


def solved(df):
    return {r.node: (r.root, r.depth, r.state, tuple(r.path) if r.path is not None else None) for r in df.collect()}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "star of chains", "ring", "mixed"])
@pytest.mark.parametrize("fragment", [7, 1000])
def test_equals_walk(spark, kind, fragment):
    rng = random.Random(3)
    if kind == "random":
        edges = [(i, rng.randrange(i)) for i in range(1, 120)]
    elif kind == "chain":
        edges = [(i, i + 1) for i in range(90)]
    elif kind == "star":
        edges = [(i, 0) for i in range(1, 90)]
    elif kind == "star of chains":
        edges = [(i, 0) for i in range(1, 60)] + [(100 + i, i) for i in range(1, 60)] + [(200 + i, 100 + i) for i in range(1, 60)]
    elif kind == "ring":
        edges = [(i, (i + 1) % 40) for i in range(40)] + [(100 + i, i) for i in range(20)] + [(200, 100), (300, 300), (301, 300)]
    else:
        edges = [(i, rng.randrange(80)) for i in range(80) if i % 9]
    df = hierarchy(spark.createDataFrame(edges, EDGES), with_paths=True, fragment_nodes=fragment)
    assert solved(df) == brute(edges)


def test_nulls_repeats_and_several_parents(spark):
    edges = [(1, None), (None, 2), (3, 4), (3, 4), (3, 9), (5, 5)]
    df = hierarchy(spark.createDataFrame([(c, p, "x") for c, p in edges], EDGES + ", node string"), with_paths=True)
    assert solved(df) == {3: (4, 1, "tree", (4, 3)), 4: (4, 0, "tree", (4,)), 5: (None, None, "cycle", None)}


def test_empty(spark):
    assert hierarchy(spark.createDataFrame([], EDGES)).collect() == []


def test_descendants(spark):
    df = hierarchy(spark.createDataFrame([(2, 1), (3, 2), (4, 2), (9, 9)], EDGES), with_paths=True)
    assert {tuple(r) for r in descendants(df).collect()} == {(1, 2, 1), (1, 3, 2), (1, 4, 2), (2, 3, 1), (2, 4, 1)}


def test_no_fragment_takes_all_children_of_a_hub(spark):
    from quillmere.operators import hierarchy as module

    rows = [(0, None), *((i, 0) for i in range(1, 40_001))]
    df = spark.createDataFrame(rows, "node long, parent long")
    for level in (0, 1, 2):
        sizes = module._fragments(df, level, 40, 1_000).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert sizes < 2_500
