import random
from collections import defaultdict
from datetime import datetime as D

import pytest

from quillmere.llm.terms import count_terms, found, marked_terms

PAGES = "page_id long, tags array<string>, scanned_at timestamp, term string"
COUNTS = "scan_id long, wiki string, prefix string, value string, cnt long, scanned_at timestamp, field string"
T0, T1 = D(2025, 1, 1), D(2025, 1, 2)


@pytest.mark.parametrize("limits", [{}, {"range_ids": 2, "block_rows": 40, "broadcast_bytes": 0}])
def test_counts_equal_brute_force(spark, limits):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(9)]), rng.choice(["a", "b", None]), rng.choice(["x", "y", "", None, "hot", "z" * 5000]), rng.choice([None, 1, 5])) for _ in range(3000)]
    occurrences, records = defaultdict(int), defaultdict(set)
    for record, field, term, weight in rows:
        if field is not None and term is not None:
            occurrences[field, term] += weight or 0
            records[field, term].add(record)
    df = spark.createDataFrame([(*r, 1) for r in rows], "record long, field string, term string, weight long, records int")
    got = count_terms(df, **limits).collect()
    assert {(r.field, r.term): (r.occurrences, r.records) for r in got} == {k: (n, len(records[k])) for k, n in occurrences.items()}
    assert [r.term_id for r in sorted(got, key=lambda r: (r.field, r.term))] == list(range(len(got)))


def test_a_hot_term_is_salted(spark):
    rows = [(i, "f", "hot" if i % 3 else f"t{i}", 1) for i in range(6000)]
    got = count_terms(spark.createDataFrame(rows, "record long, field string, term string, weight long"), broadcast_bytes=0).where("term = 'hot'").collect()
    assert [(r.occurrences, r.records) for r in got] == [(4000, 4000)]


def test_marks(spark):
    pages = [(i, ["Common", "common ", f"#t{i % 12}"], T0, "") for i in range(40)] + [(0, ["#Common"], T1, ""), (50, None, None, ""), (51, [None, "", " # ", " #Solo\t"], T0, "")]
    counts = [(s, "w", " Type", "A ", 2, T0, "") for s in range(4)] + [(0, "w", "type", "a", 1, T0, ""), (0, "w", "type", "a", 1, T0, ""), (9, "w", "x", "y", 1, T0, ""), (9, "w", None, "y", 1, T0, ""), (9, "w", "", "y", None, T0, "")]
    p, c = spark.createDataFrame(pages, PAGES), spark.createDataFrame(counts, COUNTS)
    rows = {(r.field, r.term): r for r in marked_terms(p, c).collect()}
    assert (rows["tags", "common"].occurrences, rows["tags", "common"].records) == (79, 40)
    assert (rows["counts", "type/a"].occurrences, rows["counts", "type/a"].records) == (9, 4)
    marks = {tuple(r) for r in found(p, c).collect()}
    assert ("tags", "common", "common") in marks and ("tags", "solo", "rare") in marks and ("counts", "type/a", "common") in marks and ("counts", "x/y", "rare") in marks
    assert all(term for _, term, _ in marks)


def test_empty(spark):
    assert found(spark.createDataFrame([], PAGES), spark.createDataFrame([], COUNTS)).collect() == []
