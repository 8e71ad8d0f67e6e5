import random
from collections import defaultdict

import numpy as np
import pytest

from quillmere.llm import neardup


def brute(sets, threshold):
    out = set()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-12:
                    out.add((a, b))
    return out


def run(spark, rows, threshold, limits=neardup.Limits()):
    df = spark.createDataFrame([(i, t, None, 1) for i, t in rows], "id long, payload array<long>, version long, class_id int")
    return neardup.similar(df, neardup.listed, threshold, limits=limits)


@pytest.mark.parametrize("size,threshold", [(6, 0.5), (40, 0.5), (40, 0.8)])
def test_finds_all_pairs(spark, size, threshold):
    rng = random.Random(size)
    rows = []
    for i in range(90):
        if rows and rng.random() < 0.6:
            tokens = list(rng.choice(rows)[1])
            for _ in range(rng.randrange(1 + size // 2)):
                tokens[rng.randrange(len(tokens))] = rng.randrange(60 if size > 10 else 12)
        else:
            tokens = [rng.randrange(400 if size > 10 else 12) for _ in range(rng.randrange(1, size))]
        rows.append((i, tokens))
    members, pairs = run(spark, rows, threshold)
    got = {tuple(r) for r in neardup.expanded(members, pairs).collect()}
    assert got == brute({i: set(t) for i, t in rows}, threshold)


SMALL = neardup.Limits(hot_list=7, flush_pairs=50, bucket_postings=60, part_postings=9, bucket_matches=80, part_matches=11)


def test_hot_tokens_are_spread(spark):
    rows = [(i, [1, 2, i % 5 + 10]) for i in range(60)]
    members, pairs = run(spark, rows, 0.5, SMALL)
    assert {tuple(r) for r in neardup.expanded(members, pairs).collect()} == brute({i: set(t) for i, t in rows}, 0.5)


def test_small_buckets_and_parts(spark):
    rng = random.Random(9)
    base = [[rng.randrange(300) for _ in range(45)] for _ in range(6)]
    rows = [(i, [t if rng.random() < 0.8 else rng.randrange(300) for t in base[i % 6]] + [7]) for i in range(70)]
    members, pairs = run(spark, rows, 0.5, SMALL)
    assert {tuple(r) for r in neardup.expanded(members, pairs).collect()} == brute({i: set(t) for i, t in rows}, 0.5)


def test_chance_in_the_sketch_makes_no_token_hot():
    counts = np.random.default_rng(1).poisson(4_000, 1 << 12)
    counts[5] += 50_000
    blocks = neardup._blocks(neardup.expected(counts), 5_000)
    assert blocks[5] >= 9 and (np.delete(blocks, 5) == 1).all()


def test_bodies(spark):
    text = "The quick brown fox jumps over the lazy dog and then it sleeps for a very long while"
    rows = [
        (1, text, 1), (1, text + " x", 0), (2, text.upper().replace(" ", ",\n"), 1), (3, text + " indeed", 1), (4, "only a few words here", 1), (5, None, 1), (6, "", 1), (7, None, 2), (7, text, 1), (None, text, 1), (8, text + " " + "y " * 9000, None), (2, text, 0),
    ]
    df = spark.createDataFrame(rows, "id long, payload string, version long")
    members, pairs = neardup.similar(df, neardup.shingles, 0.5)
    got = neardup.expanded(members, pairs).collect()
    assert sorted(tuple(r) for r in got) == [(1, 2), (1, 3), (1, 8), (2, 3), (2, 8), (3, 8)]
    assert {r.id: r.class_id for r in members.collect()}[2] == 1


def test_shingles_are_runs_of_three_words():
    import pyarrow as pa

    a, b = neardup.shingles(pa.array(["a b c d e f g h i j k l", "x_y-z"]))
    assert len(a) == 10 and len(b) == 0
    again = neardup.shingles(pa.array(["A  B;c d e f g h i j k l"]))[0]
    assert np.array_equal(a, again)


def test_empty(spark):
    members, pairs = run(spark, [], 0.5)
    assert members.collect() == [] and pairs.collect() == []
    members, pairs = run(spark, [(1, []), (2, None)], 0.5)
    assert neardup.expanded(members, pairs).collect() == []


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    nodes = {x for e in edges for x in e} | {500}
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = neardup.components(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.group_id for r in got.collect()} == {n: root(n) for n in nodes}


def test_texts_longer_than_a_chunk(monkeypatch):
    import pyarrow as pa

    text = "Some words, and É more of them. " * 40
    whole = neardup.shingles(pa.array([text, "", None, text + "end"]))
    monkeypatch.setattr(neardup, "CHUNK", 256)
    neardup._powers.cache_clear()
    cut = neardup.shingles(pa.array([text, "", None, text + "end"]))
    neardup._powers.cache_clear()
    assert [len(s) for s in whole] == [len(s) for s in cut] and all(np.array_equal(a, b) for a, b in zip(whole, cut)) and len(whole[1]) == len(whole[2]) == 0


BY_TWO = SMALL._replace(hot_list=2, bucket_postings=600, part_postings=90, bucket_matches=800, part_matches=110, pair_tokens=0, pair_gain=0, pair_bucket_postings=9_000, pair_part_postings=900)


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_lists_by_two_tokens_find_all_pairs(spark, threshold):
    rng = random.Random(11)
    base = [[rng.randrange(3000) for _ in range(size)] for size in (8, 36, 50, 60, 70, 110, 150)]
    rows = []
    for i in range(110):
        own, keep = base[i % 7], rng.choice([0.8, 0.9, 0.97])
        kept = own[: rng.randrange(len(own) // 2, len(own))] if i % 3 else own
        rows.append((i, [t if rng.random() < keep else rng.randrange(3000) for t in kept] + [7]))
    members, pairs = run(spark, rows, threshold, BY_TWO)
    expect = brute({i: set(t) for i, t in rows}, threshold)
    sizes = {i: len(set(t)) for i, t in rows}
    assert any(sizes[a] < neardup._pair_set(threshold) <= sizes[b] for a, b in expect) and any(sizes[a] > 90 < sizes[b] for a, b in expect)
    assert {tuple(r) for r in neardup.expanded(members, pairs).collect()} == expect


def test_phrases_shared_by_chance_make_few_matches():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    # 400 records of 40 of 2,000 phrases, each of 3 tokens: many pairs share a phrase, none but the last are similar
    sets = [(np.sort(rng.choice(2_000, 40, replace=False))[:, None] * 3 + np.arange(3)).ravel() for _ in range(400)]
    copy = sets[0].copy()
    copy[:30] = np.arange(30) + 90_000
    sets.append(copy)
    tokens = [np.unique(neardup._mix(s.astype(np.uint64))) for s in sets]
    n = np.array([len(t) for t in tokens])

    def matches(by_two):
        length = neardup._prefix_length(n, 0.5, by_two)
        prefixes = [(t[:k] >> np.uint64(32)).astype(np.uint32).tobytes() for t, k in zip(tokens, length)]
        batch = pa.record_batch([pa.array(range(len(n)), pa.int64()), pa.array(n), pa.array(prefixes, pa.binary())], names=["id", "n", "prefix"])

        class lengths:
            value = np.ones(1 << 12, np.int32)

        packed = list(neardup._postings(lengths, 5_000, 0.5, by_two, 1, 1, iter([batch])))
        return [p for part in neardup._parts(iter(packed), neardup._POSTING) for a, b, _ in neardup._list_pairs(0.5, by_two, *part) for p in zip(a.tolist(), b.tolist())]

    one, two = matches(False), matches(True)
    assert one.count((0, 400)) >= neardup.LARGE_L and two.count((0, 400)) >= neardup.LARGE_L
    assert len(set(two)) < len(set(one)) / 3, (len(set(two)), len(set(one)))
