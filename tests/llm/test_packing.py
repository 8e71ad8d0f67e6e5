import random
from collections import Counter, defaultdict

import pytest

from quillmere.llm import packing


@pytest.mark.parametrize("seed", range(8))
def test_plans_are_whole_and_near_the_bound(seed):
    rng = random.Random(seed)
    counts = Counter(rng.randint(1, 100) for _ in range(rng.choice([0, 1, 7, 60, 3000])))
    plan = packing.plan(counts, 100)
    whole(plan, counts, 100)
    # not every set of items can reach the bound
    assert plan.bound <= plan.containers <= plan.bound * 1.005 + 1


def whole(plan, counts, capacity):
    used = Counter()
    for filling, times in plan.fillings:
        assert sum(filling) <= capacity
        for size in filling:
            used[size] += times
    assert used == counts and plan.containers == sum(times for _, times in plan.fillings)


def one_by_one(items, capacity):
    rooms = []
    for size in sorted(items, reverse=True):
        fitting = [i for i, room in enumerate(rooms) if room >= size]
        if fitting:
            rooms[min(fitting, key=lambda i: rooms[i])] -= size
        else:
            rooms.append(capacity - size)
    return len(rooms)


@pytest.mark.parametrize("low,high,n,capacity", [(500, 1000, 5000, 2048), (100, 1500, 5000, 2048), (1, 2047, 3000, 2048), (300, 1200, 4000, 2048), (683, 1024, 2000, 2048), (1, 40, 800, 100), (30, 60, 500, 100)])
def test_never_worse_than_best_fit(low, high, n, capacity):
    rng = random.Random(2)
    items = [rng.randint(low, high) for _ in range(n)]
    plan = packing.plan(Counter(items), capacity)
    whole(plan, Counter(items), capacity)
    assert plan.bound <= plan.containers <= one_by_one(items, capacity)
    assert not plan.proven or plan.containers == plan.bound
    assert sum(times for _, times in packing.best_fit(Counter(items), capacity)) == one_by_one(items, capacity)


def test_search_beats_best_fit():
    items = [44, 6, 24, 6, 8, 40, 48, 12, 12, 8, 6, 12, 24, 20, 32, 8, 10, 24, 40, 16, 30, 50, 50, 20]
    assert packing.plan(Counter(items), 100).containers == packing.lower_bound(Counter(items), 100) <= one_by_one(items, 100)
    for seed in range(60):
        rng = random.Random(seed)
        items = [rng.randint(15, 60) for _ in range(30)]
        if packing.plan(Counter(items), 100).containers < one_by_one(items, 100):
            return
    raise AssertionError("the search never found a better packing")


def test_small_instances_are_optimal():
    rng = random.Random(5)

    def optimum(items):
        best = len(items)

        def place(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(items):
                best = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[i] <= 20:
                    bins[k] += items[i]
                    place(i + 1, bins)
                    bins[k] -= items[i]
            place(i + 1, [*bins, items[i]])

        place(0, [])
        return best

    for _ in range(25):
        items = sorted((rng.randint(1, 20) for _ in range(8)), reverse=True)
        plan = packing.plan(Counter(items), 20, search_steps=None, fill_steps=None)
        assert plan.containers == optimum(items) and plan.proven


def check(rows, items, capacity):
    bins = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.id].append((r.token_start, r.token_end))
        if r.container is not None:
            bins[r.container].append((r.container_start, r.token_end - r.token_start))
    for places in bins.values():
        at = 0
        for start, n in sorted(places):
            assert start == at and n > 0
            at += n
        assert at <= capacity
    assert sorted(bins) == list(range(len(bins)))
    for i, n in items:
        n = max(n or 0, 0)
        assert sorted(pieces[i])[0][0] == 0 and sorted(pieces[i])[-1][1] == n
        assert all(a[1] == b[0] for a, b in zip(sorted(pieces[i]), sorted(pieces[i])[1:]))
        assert len(pieces[i]) == max(1, -(-n // capacity))


def test_pack(spark):
    rng = random.Random(3)
    items = [(i, rng.choice([None, 0, 1, 7, 7, 7, 50, 99, 100, 101, 250, rng.randint(1, 130)])) for i in range(500)] + [(1000, 12345), (1001, -3)]
    df = spark.createDataFrame([(i, n, 0) for i, n in items], "doc_id long, n_tokens long, piece int").repartition(3)
    check(packing.pack(df, "doc_id", "n_tokens", 100).collect(), items, 100)


def test_one_size_and_empty(spark):
    same = [(i, 30) for i in range(400)]
    rows = packing.pack(spark.createDataFrame(same, "doc_id long, n_tokens long").repartition(4), "doc_id", "n_tokens", 100).collect()
    check(rows, same, 100)
    assert len({r.container for r in rows}) == 134
    assert packing.summary(spark.createDataFrame([*same, (None, 205), (None, None)], "doc_id long, n_tokens long"), "n_tokens", 100).collect() == [(136, 136, 0, True)]
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long"), "doc_id", "n_tokens", 100).collect() == []
    assert packing.pack(spark.createDataFrame([(None, 200), (None, 200)], "doc_id long, n_tokens long"), "doc_id", "n_tokens", 100).count() == 4


def test_many_of_the_smallest_sizes():
    assert packing.plan({1: 50_000}, 2048).containers == 25
    counts = {1: 30_001, 2: 30_000, 3: 5, 2000: 40}
    whole(packing.plan(counts, 2048), counts, 2048)


def test_fillings_with_a_long_chain_of_sizes_left_out():
    sizes = list(range(683, 2047))
    found = list(packing.fillings(2047, sizes, dict.fromkeys(sizes, 1), 2047, [4_000]))
    assert found[0] == (1, (2046,)) and len(found) > 1


def test_pack_many_of_one_token(spark):
    ones = [(i, 1) for i in range(50_000)] + [(50_000 + i, 2) for i in range(3)]
    rows = packing.pack(spark.createDataFrame(ones, "doc_id long, n_tokens long").repartition(4), "doc_id", "n_tokens", 2048).collect()
    check(rows, ones, 2048)
    assert len({r.container for r in rows}) == 25
