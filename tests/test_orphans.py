import random
from datetime import datetime as D
from datetime import timedelta

from quillmere.operators.orphans import STATE, apply_deltas, current_orphans, orphan_references

REFS = "ref_table string, ref_id long, target string, seen_at timestamp_ntz, page_id int"
PAGES = "page_id long, path string, created_at timestamp_ntz, deleted_at timestamp_ntz, scanned_at timestamp_ntz, target string"


def orphans(spark, refs, pages, permanent=None):
    r = spark.createDataFrame([("t", *x, 0) for x in refs], REFS)
    p = spark.createDataFrame([(*x, "") for x in pages], PAGES)
    k = spark.createDataFrame([(x,) for x in permanent], "path string") if permanent is not None else None
    return sorted(((x.ref_id, x.period, x.reason) for x in orphan_references(r, p, k).collect()), key=str)


DAY = [D(2025, 1, d) for d in range(1, 29)]


def test_reasons_and_times(spark):
    pages = [
        (1, "wiki/a/One.md", DAY[5], DAY[10], DAY[20]),
        (1, "wiki/a/One.md", DAY[5], DAY[10], DAY[21]),
        (2, "wiki/b/one.md", DAY[15], None, DAY[20]),
        (3, "wiki/never.md", None, None, DAY[1]),
        (4, "wiki/dead.md", DAY[5], DAY[5], DAY[1]),
        (5, None, DAY[1], None, DAY[1]),
    ]
    refs = [
        (1, "one", DAY[4]), (2, "./ONE.md ", DAY[5]), (3, "one", DAY[10]), (4, "one", DAY[15]), (5, "a/one", DAY[20]), (6, "ne", DAY[6]), (7, None, DAY[6]), (8, "", DAY[6]),
        (9, "pic.png", DAY[6]), (10, "never", DAY[6]), (11, "dead", DAY[7]), (12, "dead", DAY[2]), (13, "b/one", None), (14, "one", DAY[4]), (14, "one", DAY[4]), (15, "repo", None), (16, "git/repo", DAY[0]),
    ]
    assert orphans(spark, refs, pages, ["git/repo.md"]) == sorted(
        [
            (1, "2025-01", "late"), (3, "2025-01", "late"), (5, "2025-01", "deleted"), (6, "2025-01", "missing"), (10, "2025-01", "deleted"), (11, "2025-01", "deleted"),
            (12, "2025-01", "late"), (13, None, "deleted"), (14, "2025-01", "late"),
        ], key=str,
    )


def test_empty_tables(spark):
    assert orphans(spark, [], []) == []
    assert orphans(spark, [(1, "x", DAY[0])], []) == [(1, "2025-01", "missing")]


def test_hot_key(spark):
    refs = [(i, "one", DAY[i % 28]) for i in range(3000)]
    found = orphans(spark, refs, [(1, "one.md", DAY[7], DAY[20], DAY[0])])
    assert len(found) == sum(i % 28 < 7 or i % 28 >= 20 for i in range(3000))


def test_changes_within_an_hour(spark):
    rng = random.Random(5)
    at = lambda: D(2025, 1, 1) + timedelta(minutes=rng.randrange(240)) if rng.random() < 0.95 else None
    pages = [(i, f"wiki/{rng.choice('abc')}/{rng.choice('xyz')}.md", at(), at() if rng.random() < 0.7 else None, DAY[0]) for i in range(40)]
    refs = [(i, rng.choice(["x", "y", "a/z", "b/x", "none", "wiki/c/y"]), at()) for i in range(600)]
    want = set()
    for i, key, seen in refs:
        named = [p for p in pages if ("/" + p[1][:-3]).endswith("/" + key)]
        made = [p[2] for p in named if p[2]]
        if seen is not None and any(p[2] and p[2] <= seen and (p[3] is None or p[3] > seen) for p in named):
            continue
        reason = "missing" if not named else "late" if seen is not None and any(m > seen for m in made) else "deleted"
        want.add((i, seen and "2025-01", reason))
    assert set(orphans(spark, refs, pages)) == want


def test_deltas(spark):
    make = lambda rows: spark.createDataFrame(rows, STATE)
    state = apply_deltas(make([]), make([("a", 1, 1), ("b", 2, 0), (None, 1, 0)]))
    state = apply_deltas(state, make([("a", 0, -1), ("b", -2, 0), ("c", 1, 1)]))
    assert {tuple(r) for r in state.collect()} == {("a", 1, 0), ("c", 1, 1)}
    assert [tuple(r) for r in current_orphans(state).collect()] == [("a", 1)]
