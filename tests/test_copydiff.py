import random
from datetime import datetime as D

import pytest

from quillmere.operators.copydiff import diff, latest, multiset_diff

SCHEMA = "path string, rule string, line int, severity string, message string, extra int, kind string"
KEYS, FIELDS = ["path", "rule", "line"], ["severity", "message"]


def frame(spark, rows):
    return spark.createDataFrame([(*k, *v, 1, "x") for k, v in rows.items()], SCHEMA)


def brute(a, b):
    out = set()
    for k in {*a, *b}:
        if k not in b or k not in a:
            out.add((*k, "only_in_a" if k in a else "only_in_b", "row"))
        else:
            out |= {(*k, "differs", f) for f, x, y in zip(FIELDS, a[k], b[k]) if x != y}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice([None, "", "a", "b", "é" * 300])
    a = {(word(), word(), rng.choice([None, *range(40)])): (word(), word()) for _ in range(900)}
    b = dict(a)
    for k in rng.sample(list(b), 20):
        del b[k]
    for k in rng.sample(list(b), 20):
        b[k] = (word(), word())
    b |= {(f"new{i}", None, i): (None, None) for i in range(10)}
    found = diff(frame(spark, a), frame(spark, b), KEYS, FIELDS, ("a", "b"))
    assert found.columns == [*KEYS, "kind", "field"]
    assert {tuple(r) for r in found.collect()} == brute(a, b)
    assert found.count() == len(brute(a, b))


def test_empty(spark):
    none, some = frame(spark, {}), frame(spark, {("p", None, 1): (None, "m")})
    assert diff(none, none, KEYS, FIELDS).collect() == []
    assert [tuple(r) for r in diff(none, some, KEYS, FIELDS).collect()] == [("p", None, 1, "only_in_right", "row")]
    assert diff(some, some, KEYS, FIELDS).collect() == []


def test_latest(spark):
    rows = [("k", 1, D(2025, 1, 1), "old"), ("k", 1, D(2025, 1, 2), "b"), ("k", 1, D(2025, 1, 2), "a"), ("k", 1, None, "z"), (None, 1, None, "n"), (None, 1, None, None)]
    df = spark.createDataFrame(rows, "path string, line int, at timestamp, message string")
    assert {tuple(r) for r in latest(df, ["path", "line"], ["message"], "at").collect()} == {("k", 1, "b"), (None, 1, "n")}


def test_only_unmatched_chunks_are_compared(spark):
    a = {(f"p{i:05}", "r", i): ("info", "m") for i in range(4000)}
    b = a | {("p02000", "r", 2000): ("warn", "m")}
    found = diff(frame(spark, a), frame(spark, b), KEYS, FIELDS)
    assert [tuple(r) for r in found.collect()] == [("p02000", "r", 2000, "differs", "severity")]


def test_multiset(spark):
    make = lambda rows: spark.createDataFrame(rows, "a string, b int")
    left, right = make([("x", 1), ("x", 1), (None, 2)]), make([("x", 1), (None, 2), ("y", None)])
    assert {tuple(r) for r in multiset_diff(left, right).collect()} == {("x", 1, "only_in_left", 1), ("y", None, "only_in_right", 1)}
