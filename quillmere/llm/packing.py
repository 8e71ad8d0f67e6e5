"""Filling containers of fixed capacity with whole items, by bin completion.

Items of equal size are interchangeable, so the packing is worked out on the histogram of sizes, which
has at most as many entries as the capacity, however many items there are. A filling of a container is
a set of sizes around the largest item left. ``plan`` takes best-fit decreasing over the whole
histogram as the first incumbent and then branches over the undominated fillings around the largest
item left, least waste first, each as often as the counts allow and then once. A branch ends where the
waste so far leaves no better packing than the incumbent. The search ends with a proof, at the bound
below which no packing can go or when nothing is left to try, or when its steps are used up; the plan
tells which. It is never worse than best-fit. The result is a list of (filling, repeats), as short as
the histogram.

Items find their container by their rank among the items of their size, without a shuffle of more
than one row per item.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmere.session import stage

#: Steps that the search for fillings may take in all, and for the fillings around one item; None for no limit, which makes the plan exact.
SEARCH_STEPS, FILL_STEPS = 1_000_000, 500


class Plan(NamedTuple):
    """Fillings with their repeats, how many containers these are, the least number any packing needs, and whether the plan is known to be best."""

    fillings: list[tuple[tuple[int, ...], int]]
    containers: int
    bound: int
    proven: bool


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Containers any packing needs: the volume bound, Martello and Toth's for items over half the capacity, and those of rounded sizes."""
    sizes = np.array(sorted(counts), np.int64)
    n = np.array([counts[s] for s in sizes.tolist()], np.int64)
    volume = sizes * n
    best = -(-int(volume.sum()) // capacity)
    smalls = int(np.searchsorted(sizes, capacity // 2, "right"))
    heads, volumes = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(volume)])
    for at, limit in enumerate([0, *sizes[:smalls].tolist()]):
        first = max(0, at - 1)  # the smallest size that counts
        middle = max(smalls, int(np.searchsorted(sizes, capacity - limit, "right")))  # larger ones are alone
        bins = int(heads[-1] - heads[smalls])
        room = int(heads[middle] - heads[smalls]) * capacity - int(volumes[middle] - volumes[smalls])
        best = max(best, bins + max(0, -(-(int(volumes[smalls] - volumes[first]) - room) // capacity)))
    for k in range(1, 60):  # a size counts as a k-th part of how many (k+1)-th parts of the capacity it fills
        scaled = (k + 1) * sizes
        parts = np.where(scaled % capacity, (scaled // capacity) * capacity, sizes * k)
        best = max(best, -(-int((parts * n).sum()) // (k * capacity)))
    return best


def fillings(room: int, sizes: list[int], counts: dict[int, int], most_waste: int, steps: list[float]) -> Iterator[tuple[int, tuple[int, ...]]]:
    """Undominated fillings of ``room`` with a waste of at most ``most_waste``, as (waste, sizes in falling order).

    ``sizes`` ascend; ``steps`` has what is left of them, and less than 0 after the last: then fillings
    may be missing. A filling is dominated if an item left outside could take the place of one inside
    that is smaller, or fit beside; so each branch takes the largest size that fits, as often as it
    fits or less often and then leaves it out for good, and a filling with room for a size it left out and that is still there is none.
    """
    # a node: room, sizes still allowed, sizes taken as a chain of (chain before, size, how often), smallest size left out
    todo: list[tuple] = [(room, len(sizes), None, 1 << 60)]
    # nodes whose size can be taken less often: the node, its size, how often next
    less: list[tuple] = []
    while todo or less:
        if not todo:
            (room, top, taken, left_out), size, times = less.pop()
            if times:
                less.append(((room, top, taken, left_out), size, times - 1))
            room -= times * size
            if room - size <= 0:
                continue
            # with one less of this size the rest must fill more than it would: what is taken instead is smaller
            todo.append((room, top - 1, (taken, size, times) if times else taken, min(left_out, size)))
        room, top, taken, left_out = todo.pop()
        steps[0] -= 1
        if steps[0] < 0:
            return
        top = bisect_right(sizes, room, 0, top)
        while top and not counts[sizes[top - 1]]:
            top -= 1
        if not top:
            # the smallest size that was left out must not fit, nor replace a smaller one taken after it
            if room <= most_waste and room < left_out:
                yield room, _unchained(taken)
            continue
        size = sizes[top - 1]
        times = min(counts[size], room // size)
        if top > 1:
            less.append(((room, top, taken, left_out), size, times - 1))
        todo.append((room - times * size, top - 1, (taken, size, times), left_out))


def _unchained(taken: tuple | None) -> tuple[int, ...]:
    parts: list[tuple[int, ...]] = []
    while taken:
        taken, size, times = taken
        parts.append((size,) * times)
    return tuple(size for part in reversed(parts) for size in part)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing as fillings with repeats: equal containers are filled together.

    The item goes where least room is left. A container that took one and has room for another is
    then the fullest that has, so it takes as many as fit before the next.
    """
    bins: dict[int, list[tuple[tuple | None, int]]] = {}
    rooms: list[int] = []
    for size in sorted(counts, reverse=True):
        left, moved = counts[size], []

        def fill(room: int, taken: tuple | None, n: int) -> int:
            """Put items into up to ``n`` equal containers; how many stay as they are."""
            nonlocal left
            each = room // size
            whole = min(n, left // each)
            if whole:
                moved.append((room - each * size, (taken, size, each), whole))
                left -= whole * each
            if whole < n and left:
                moved.append((room - left * size, (taken, size, left), 1))
                left, whole = 0, whole + 1
            return n - whole

        while left and (at := bisect_left(rooms, size)) < len(rooms):
            room = rooms[at]
            taken, n = bins[room].pop()
            if n := fill(room, taken, n):
                bins[room].append((taken, n))
            if not bins[room]:
                del bins[room], rooms[at]
        if left:
            fill(capacity, None, -(-left // (capacity // size)))
        for room, taken, n in moved:
            if room not in bins:
                bins[room] = []
                insort(rooms, room)
            bins[room].append((taken, n))
    return [(_unchained(taken), n) for same in bins.values() for taken, n in same]


class _Node:
    """Fillings around the largest size left, in the order in which they are tried."""

    def __init__(self, size: int, tries: list[tuple[int, tuple[int, ...], int]], whole: bool) -> None:
        self.size, self.tries, self.whole = size, tries, whole
        self.taken: tuple[tuple[int, ...], int, int] | None = None
        self.known = {t[1:] for t in tries}


def plan(histogram: dict[int, int], capacity: int, search_steps: int | None = SEARCH_STEPS, fill_steps: int | None = FILL_STEPS) -> Plan:
    """A plan that takes every item of ``histogram`` (size -> number, sizes 1 to capacity) once.

    Without limits of steps the search ends with the best plan there is, whatever time that takes.
    """
    counts = {s: n for s, n in histogram.items() if n > 0}
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("sizes must lie between 1 and the capacity")
    sizes, total = sorted(counts), sum(s * n for s, n in counts.items())
    best = best_fit(counts, capacity)
    fewest, bound = sum(n for _, n in best), lower_bound(counts, capacity) if counts else 0
    left = float("inf") if search_steps is None else search_steps
    bins = wasted = 0
    cut = False

    def change(filling: tuple[int, ...], times: int, sign: int) -> None:
        for size, n in Counter(filling).items():
            before = counts.get(size, 0)
            counts[size] = before + sign * n * times
            if not before:
                insort(sizes, size)
            elif not counts[size]:
                del counts[size], sizes[bisect_left(sizes, size)]

    def node(first: bool, known: set) -> tuple[list[tuple[int, tuple[int, ...], int]], bool]:
        """Fillings not known yet that can lead to a better packing, and whether these are all; at first up to one without waste."""
        nonlocal left, cut
        size = sizes[-1]
        steps = [min(left, float("inf") if fill_steps is None else fill_steps)]
        given, found, whole = steps[0], [], True
        counts[size] -= 1
        for waste, taken in fillings(capacity - size, sizes, counts, (fewest - 1) * capacity - total - wasted, steps):
            found.append((waste, (size, *taken)))
            if first and waste == 0:
                whole = False
                break
        counts[size] += 1
        left -= given - max(0, steps[0]) if given != float("inf") else 0
        cut = cut or steps[0] < 0
        found.sort(key=lambda f: f[0])
        most = [min(counts[s] // n for s, n in Counter(f).items()) for _, f in found]
        tries = [(w, f, m) for (w, f), m in zip(found, most)] + [(w, f, 1) for (w, f), m in zip(found, most) if m > 1]
        return [t for t in tries if t[1:] not in known], whole

    path: list[_Node] = []
    forward = True
    while fewest > bound and left > 0 and (path or forward):
        if forward:
            if not sizes:
                best, fewest = [n.taken[:2] for n in path], bins
            elif (fewest - 1) * capacity - total - wasted >= 0:
                tries, whole = node(True, set())
                path.append(_Node(sizes[-1], tries, whole))
                forward = False
                continue
            forward = False
            if not path:
                break
            continue
        top = path[-1]
        if top.taken:
            filling, times, waste = top.taken
            change(filling, times, 1)
            bins, wasted, top.taken = bins - times, wasted - waste * times, None
        if not top.tries and not top.whole:
            top.tries, top.whole = node(False, top.known)
            top.known |= {t[1:] for t in top.tries}
        while top.tries:
            waste, filling, times = top.tries.pop(0)
            if waste * times <= (fewest - 1) * capacity - total - wasted:
                change(filling, times, -1)
                bins, wasted, top.taken = bins + times, wasted + waste * times, (filling, times, waste)
                forward = True
                break
        if not forward and top.whole:
            path.pop()
    return Plan(best, fewest, bound, fewest == bound or (left > 0 and not cut))


def _placed(items: DataFrame) -> DataFrame:
    """``items`` as written once, each row with its partition and its place there."""
    return stage(items.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "packing")


def _before(placed: DataFrame, by: list[str], amount: Column) -> DataFrame:
    """``placed`` with the sum of ``amount`` over all rows before it, within equal ``by``.

    Sums are taken inside a partition, and over the partitions' totals, one row for each partition and
    value of ``by``; so no group is gathered, however large.
    """
    totals = placed.groupBy(*by, "__part").agg(F.sum(amount).alias("__total"))
    parts = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    ahead = totals.select(*by, "__part", F.coalesce(F.sum("__total").over(parts), F.lit(0)).alias("__ahead"))
    inside = W.partitionBy(*by, "__part").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    return placed.withColumn("__inside", F.coalesce(F.sum(amount).over(inside), F.lit(0))).join(ahead, [*by, "__part"]).withColumn("before", F.col("__ahead") + F.col("__inside"))


class _Runs(NamedTuple):
    """The slots of each size in order of its items' ranks, as runs, one for each filling with it, sorted by size and first rank."""

    rest: np.ndarray
    first: np.ndarray
    times: np.ndarray
    container: np.ndarray
    start: np.ndarray


def _runs(fillings_: list[tuple[tuple[int, ...], int]]) -> _Runs:
    """A size that a filling has more than once goes through the filling's containers again."""
    slots: list[tuple[int, int, int, int, int]] = []
    used: Counter = Counter()
    container = 0
    for filling, times in fillings_:
        start = 0
        for size, n_size in Counter(filling).items():
            slots.append((size, used[size], times, container, start))
            used[size] += n_size * times
            start += n_size * size
        container += times
    return _Runs(*np.array(sorted(slots), np.int64).reshape(-1, 5).T)


def _seat(held, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n, rest, rank) to (id, n, rest, container, container_start), by a search in the sorted runs."""
    runs: _Runs = held.value
    firsts = np.searchsorted(runs.rest, np.arange(int(runs.rest.max(initial=0)) + 2))
    for batch in batches:
        rest, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
        low, high = firsts[rest].copy(), firsts[rest + 1].copy()
        while (open_ := high - low > 1).any():  # the last run of the size that begins at or before the rank
            middle = (low + high) // 2
            up = open_ & (runs.first[np.minimum(middle, len(runs.first) - 1)] <= rank)
            low, high = np.where(up, middle, low), np.where(open_ & ~up, middle, high)
        at = rank - runs.first[low]
        container, start = runs.container[low] + at % runs.times[low], runs.start[low] + at // runs.times[low] * rest
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(container), pa.array(start)], names=["id", "n", "rest", "container", "container_start"])


def _histogram(placed: DataFrame) -> dict[int, int]:
    """How many items of each size below the capacity: at most as many rows as that."""
    return {r["rest"]: r["count"] for r in placed.where("rest > 0").groupBy("rest").count().collect()}


def summary(sizes: DataFrame, size_col: str, capacity: int, search_steps: int | None = SEARCH_STEPS, fill_steps: int | None = FILL_STEPS) -> DataFrame:
    """``(containers, bound, gap, proven)`` of the packing that ``pack`` makes: one row."""
    n = F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0))
    items = sizes.select(n.alias("n")).select(F.pmod("n", F.lit(capacity)).alias("rest"), F.floor(F.col("n") / capacity).alias("full"))
    rows = items.groupBy("rest").agg(F.count(F.lit(1)).alias("count"), F.sum("full").alias("full")).collect()  # a row for each size below the capacity
    made = plan({r["rest"]: r["count"] for r in rows if r["rest"]}, capacity, search_steps, fill_steps)
    full = sum(r["full"] for r in rows)
    out = (made.containers + full, made.bound + full, made.containers - made.bound, made.proven)
    return sizes.sparkSession.createDataFrame([out], "containers long, bound long, gap long, proven boolean")


def pack(sizes: DataFrame, id_col: str, size_col: str, capacity: int, search_steps: int | None = SEARCH_STEPS, fill_steps: int | None = FILL_STEPS) -> DataFrame:
    """``(id, piece, container, container_start, token_start, token_end)`` for every piece of every item.

    An item of more than ``capacity`` is cut into full pieces, each a container of its own, and a rest;
    all others stay whole. Containers are numbered from 0 without gaps; pieces lie in them one after
    the other from ``container_start``. Items without a size, null, 0 or less, need no room: they have
    one piece with a null container and an empty range. Repeated rows are items of their own; a null
    id is kept. An empty table gives no rows. Steps are those of ``plan``.
    """
    spark = sizes.sparkSession
    n, zero = F.col("n"), F.lit(0).cast("long")
    items = sizes.select(F.col(id_col).alias("id"), F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    placed = _placed(items.withColumn("rest", F.pmod("n", F.lit(capacity))))
    made = plan(_histogram(placed), capacity, search_steps, fill_steps)
    # as long as the plan, which the capacity bounds
    held = spark.sparkContext.broadcast(_runs(made.fillings))
    container = made.containers
    ranked = _before(placed.where("rest > 0"), ["rest"], F.lit(1)).select("id", "n", "rest", F.col("before").cast("long"))
    kind = dict(placed.dtypes)["id"]
    seated = ranked.mapInArrow(partial(_seat, held), f"id {kind}, n long, rest long, container long, container_start long")
    tails = seated.select("id", F.floor(n / capacity).alias("piece"), "container", "container_start", (n - F.col("rest")).alias("token_start"), n.alias("token_end"))
    full = _before(placed.where(n >= capacity).withColumn("k", F.floor(n / capacity)).withColumn("all", F.lit(0)), ["all"], F.col("k"))
    start = F.col("piece") * capacity
    full = full.select("id", "before", F.explode(F.sequence(zero, F.col("k") - 1)).alias("piece")).select(
        "id", "piece", (F.lit(container) + F.col("before") + F.col("piece")).alias("container"), zero.alias("container_start"), start.alias("token_start"), (start + capacity).alias("token_end")
    )
    none = placed.where("n = 0").select("id", zero.alias("piece"), F.lit(None).cast("long").alias("container"), zero.alias("container_start"), zero.alias("token_start"), zero.alias("token_end"))
    return tails.unionByName(full).unionByName(none)
