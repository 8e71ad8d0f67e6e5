"""Pairs of records whose token sets are similar, by a grouped prefix join that loses none.

Two sets with a similarity of t or more share at least need = t / (1 + t) * (their sizes together)
tokens. With the tokens of every set in one common order, rare ones first, such sets share L tokens
among the first n - need + L of each, for whatever L. L is 1 for small sets and LARGE_L for large
ones, where one shared token says little but several by chance are rare.

1. A sketch of fixed size, counts by the token's leading bits summed over all records, gives the
   order; ties go by the token. It is an order for whatever the sketch holds, so it decides about
   work only.
2. Each record gives its size, a fingerprint of its set and its prefix. Records with equal sets are
   one class; classes with equal prefix and size are one group, and only groups go on.
3. The groups' prefixes are sent as packed arrays by token ranges. Within a token's list, sorted by
   size, pairs pass if sizes and positions still allow ``need``. A token that very many prefixes have,
   by a sketch of these, is spread over blocks of records, a task for each pair of blocks.
   Lists of single tokens grow with the table, and the pairs by chance in them with its square. Where these
   would outnumber the work, large sets are listed by two tokens at once: tokens are in PAIR_GROUPS groups by
   hash, and sets that share L = PAIR_GROUPS + LARGE_L tokens share LARGE_L pairs of tokens of one group, as
   g shared tokens of a group make g - 1 pairs or more.
4. Matches are added up per pair, again in packed arrays, and pairs with L matches, of tokens or of pairs, remain.
5. Groups are expanded to classes, and these verified by their whole sets.

Postings and matches go to buckets, a task each, and within a bucket to parts. Spark sorts a bucket's
packed rows by part, on disk if need be, and the task holds one part at a time. The numbers of both
follow from the lengths of the lists as sketched; memory is bounded by a part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.operators.graph import connected
from quillmere.session import stage, unstage

SKETCH_BITS = 20
SKETCH_RANGES = 16
LARGE_SET, LARGE_L = 24, 4
#: Groups of tokens for lists by two tokens, and the shared tokens of a prefix that make LARGE_L shared pairs certain.
PAIR_GROUPS = 24
PAIR_L = PAIR_GROUPS + LARGE_L
#: Larger sets stay with single tokens, as pairs of tokens grow with the square of a set.
PAIR_MOST = 4_000


class Limits(NamedTuple):
    """Sizes of work; no result depends on them."""

    #: A token in more prefixes than this, by the sketch, is spread over blocks of about so many.
    hot_list: int = 5_000
    #: Matches are packed and sent on at this many, so a task's memory doesn't grow with its lists.
    flush_pairs: int = 400_000
    #: Postings and matches of a bucket, a task's whole work, and of a part, what it holds at once; about.
    bucket_postings: int = 2_000_000
    part_postings: int = 100_000
    bucket_matches: int = 8_000_000
    part_matches: int = 400_000
    #: Lists by two tokens are thought of from so many tokens on, and made if all the pairs of records in the lists of
    #: single tokens are more than so many times the pairs of tokens (of these, one in 23 passed by size and position).
    pair_tokens: int = 50_000_000
    pair_gain: float = 60
    #: As above, of these lists: more in a part, so that what a task sends to each isn't too small.
    pair_bucket_postings: int = 8_000_000
    pair_part_postings: int = 800_000


MOST_BUCKETS, MOST_PARTS = 100_000, 256
#: The most ids that are broadcast, of 8 bytes each; more are joined.
BROADCAST_IDS = 1 << 20
#: Bytes of payloads, and prefix tokens, that are worked on at once.
SLICE_BYTES, SLICE_POSTINGS = 4 << 20, 200_000

_U = np.uint64
_K = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9))
_CODEC = "zstd"

Tokens = Callable[[pa.Array], list[np.ndarray]]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _K[0]
    x = (x ^ (x >> _U(29))) * _K[1]
    return x ^ (x >> _U(32))


# Token sources: from a column of payloads to sorted arrays of distinct 64-bit tokens; an empty one doesn't count.


#: Characters that are worked on at once.
CHUNK = 1 << 20
_BASE = _U(0x100000001B3 * 2 + 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


@lru_cache(maxsize=1)
def _alphabet() -> np.ndarray:
    """Whether a code point is a letter or digit."""
    return np.fromiter((chr(c).isalnum() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = CHUNK + 1
    up, down = np.full(n, _BASE, _U), np.full(n, _INVERSE, _U)
    up[0] = down[0] = _U(1)
    return np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)


def _word_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a text in lower case.

    The hash is that of the word's characters as digits of a number modulo 2**64, taken as the
    difference of two running sums over the text, divided by the power of the word's place.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(points) + 2, np.int8)
    inside[1:-1] = _alphabet()[points]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = _powers()
    if len(points) > CHUNK:  # a text longer than the tables of powers
        up, down = (np.cumprod(np.concatenate([[_U(1)], np.full(len(points), x, _U)]), dtype=_U) for x in (_BASE, _INVERSE))
    sums = np.zeros(len(points) + 1, _U)
    np.cumsum((points + np.uint32(1)) * up[: len(points)], dtype=_U, out=sums[1:])
    return starts, _mix((sums[ends] - sums[starts]) * down[starts])


def shingles(texts: pa.Array, width: int = 3, least_words: int = 12) -> list[np.ndarray]:
    """Runs of ``width`` words, a word being a maximal run of letters and digits in lower case; none below ``least_words``."""
    out: list[np.ndarray] = []
    held: list[str] = []
    size = 0
    for text in texts.to_pylist():
        text = (text or "").lower()
        if size and size + len(text) >= CHUNK:
            out += _shingle_chunk(held, width, least_words)
            held, size = [], 0
        held.append(text)
        size += len(text) + 1
    return out + _shingle_chunk(held, width, least_words)


def _shingle_chunk(texts: list[str], width: int, least_words: int) -> list[np.ndarray]:
    if not texts:
        return []
    starts, words = _word_hashes("\0".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    cuts = np.concatenate([[0], np.searchsorted(starts, ends)])
    n = max(0, len(words) - width + 1)
    run = words[:n].copy()
    for i in range(1, width):
        run = run * _K[2] + words[i : n + i]
    run = _mix(run)
    none = np.zeros(0, _U)
    return [np.unique(run[a : b - width + 1]) if b - a >= max(least_words, width) else none for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def listed(lists: pa.Array) -> list[np.ndarray]:
    """Payloads that are lists of longs already."""
    return [np.unique(_mix(np.array([v for v in values if v is not None], np.int64).view(_U))) if values else np.zeros(0, _U) for values in lists.to_pylist()]


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about SLICE_BYTES of a column."""
    for batch in batches:
        rows = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.column(column).nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()  # the worker lives on


# 1. The order.


def _sketch(tokens: Tokens, bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << bits, np.int32)
    for batch in _slices(batches, 1):
        held = tokens(batch.column(1))
        if held:
            counts += np.bincount((np.concatenate(held) >> _U(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.int32)
    if counts.any():
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SKETCH_RANGES), pa.int32()), pa.array([part.tobytes() for part in np.split(counts, SKETCH_RANGES)], pa.binary())], names=["range", "counts"]
        )


def _sum_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for number, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(counts, np.int32)
            sums[number] = sums[number] + part if number in sums else part.astype(np.int64)
    for number, part in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([np.minimum(part, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())], names=["range", "counts"])


def sketch(sets: DataFrame, tokens: Tokens, bits: int = SKETCH_BITS) -> np.ndarray:
    """Counts of all records' tokens by their leading ``bits``: 2**bits integers for whatever input."""
    schema = "range int, counts binary"
    rows = sets.mapInArrow(partial(_sketch, tokens, bits), schema).repartitionById(SKETCH_RANGES, "range").mapInArrow(_sum_sketch, schema).collect()
    counts = np.zeros(1 << bits, np.int32)
    for row in rows:
        counts[row["range"] * (len(counts) // SKETCH_RANGES) :][: len(counts) // SKETCH_RANGES] = np.frombuffer(row["counts"], np.int32)
    return counts


def expected(counts: np.ndarray) -> np.ndarray:
    """About how many records have a token of each cell, the most common one.

    Most tokens are rare, so the median cell tells what other tokens add to a cell by chance; a cell
    counts as far as it stands out from that by more than their spread.
    """
    chance = float(np.median(counts))
    return np.maximum(counts - chance - 4 * chance**0.5, 1)


# 2. Records, classes and groups.


def _matches_wanted(n: np.ndarray) -> np.ndarray:
    return np.where(n >= LARGE_SET, LARGE_L, 1)


def _pair_set(threshold: float) -> int:
    """The size from which on sets that are similar share PAIR_L tokens."""
    return int(_up(PAIR_L / threshold))


def _by_two(n: np.ndarray, threshold: float) -> np.ndarray:
    """Sets that are listed by two tokens."""
    return (n >= _pair_set(threshold)) & (n <= PAIR_MOST)


def _prefix_length(n: np.ndarray, threshold: float, pairs: bool) -> np.ndarray:
    wanted = np.where(_by_two(n, threshold), PAIR_L, _matches_wanted(n)) if pairs else _matches_wanted(n)
    return np.minimum(n, n - _up(threshold * n) + wanted)


def _up(x: np.ndarray | float) -> np.ndarray:
    return np.ceil(np.asarray(x) - 1e-9).astype(np.int64)


def _records(tokens: Tokens, order, threshold: float, pairs: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, payload, version) to (id, version, n, s1, s2, prefix_hash, prefix)."""
    counts = order.value
    shift = _U(64 - (len(counts).bit_length() - 1))
    for batch in _slices(batches, 1):
        sets = tokens(batch.column(1))
        at = np.flatnonzero([len(own) for own in sets])
        if not len(at):
            continue
        sets = [sets[i] for i in at.tolist()]
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        first = np.cumsum(n) - n
        flat = np.concatenate(sets)
        rank = counts[(flat >> shift).astype(np.int64)]
        s1, s2 = np.add.reduceat(_mix(flat), first), np.add.reduceat(_mix(flat ^ _K[2]), first)
        length = _prefix_length(n, threshold, pairs)
        prefixes, prints = [], []
        for own, start, size, cut in zip(sets, first.tolist(), n.tolist(), length.tolist()):
            prefix = own[np.argsort(rank[start : start + size], kind="stable")[:cut]]
            prints.append(xxhash.xxh3_64_intdigest(prefix.tobytes()))
            prefixes.append((prefix >> _U(32)).astype(np.uint32).tobytes())
        at = pa.array(at)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(2).take(at), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(np.array(prints, _U).view(np.int64)), pa.array(prefixes, pa.binary())],
            names=["id", "version", "n", "s1", "s2", "prefix_hash", "prefix"],
        )


_RECORD = "id long, version long, n long, s1 long, s2 long, prefix_hash long, prefix binary"


# 3. Postings and the pairs of a token's list.


def _pack(arrays: list[np.ndarray]) -> bytes:
    body = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(body).to_bytes(8, "little") + pa.compress(body, codec=_CODEC, asbytes=True)


def _unpack(blob: bytes, types: list) -> list[np.ndarray]:
    body = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec=_CODEC, asbytes=True)
    n = len(body) // sum(np.dtype(t).itemsize for t in types)
    arrays, at = [], 0
    for t in types:
        arrays.append(np.frombuffer(body, t, n, at))
        at += arrays[-1].nbytes
    return arrays


_POSTING = [np.uint32, np.int64, np.int32, np.int32, np.int32, np.int32]  # key, id, size, position; of a hot token the task's pair of blocks and the own block, else -1
_MOST_BLOCKS = 46_000  # so that a pair of blocks fits an int32
_PACKED = "bucket int, part int, blob binary"


def _blocks(lists: np.ndarray, hot_list: int) -> np.ndarray:
    """Blocks over which tokens in so many records are spread."""
    return np.minimum(np.ceil(lists / hot_list), _MOST_BLOCKS).astype(np.int64)


def _cut(columns: list[np.ndarray], where: np.ndarray, buckets: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows of arrays to packed rows by bucket and part, as their hash ``where`` says.

    Rows rise by the first column, and parts keep the order; it is packed as differences.
    """
    slot = (where % _U(buckets * parts)).astype(np.int64)
    by = np.argsort(slot, kind="stable")
    slots, first = np.unique(slot[by], return_index=True)
    rising, *others = (c[by] for c in columns)
    blobs = [_pack([np.diff(rising[a:b], prepend=rising.dtype.type(0)), *(c[a:b] for c in others)]) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(by)])]
    yield pa.RecordBatch.from_arrays([pa.array(slots // parts, pa.int32()), pa.array(slots % parts, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "part", "blob"])


def _parts(batches: Iterator[pa.RecordBatch], types: list) -> Iterator[list[np.ndarray]]:
    """Packed rows in order of bucket and part to the arrays of one part after the other."""
    now, held = None, []
    for batch in batches:
        for at in range(batch.num_rows):
            place = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
            if place != now and held:
                yield [np.concatenate(c) for c in zip(*held)]
                held = []
            now = place
            rising, *others = _unpack(batch.column(2)[at].as_buffer(), types)
            held.append([np.cumsum(rising, dtype=rising.dtype), *others])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]
    pa.default_memory_pool().release_unused()  # the worker lives on


def _prefix_tokens(prefixes: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(p, np.uint32).astype(_U) << _U(32) for p in prefixes.to_pylist()]


#: A list of two tokens is taken to be so much shorter than that of the rarer one; of pairs of records that met by one token, one in 11 did by two.
_PAIR_SHARE = 8


def _postings(lengths, hot_list: int, threshold: float, pairs: bool, buckets: int, parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups (id, n, prefix) to packed postings; ``lengths``: how many prefixes have the tokens of each cell."""
    lists = expected(lengths.value)
    blocks, pair_blocks = (_blocks(lists, hot).astype(np.int32) for hot in (hot_list, hot_list * _PAIR_SHARE))
    for batch in batches:
        length = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False) // 4
        cuts = np.searchsorted(np.cumsum(length), np.arange(SLICE_POSTINGS, int(length.sum()) + SLICE_POSTINGS, SLICE_POSTINGS)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if part := batch.slice(a, max(0, b - a)):
                ids, sizes, own, position, key = _flat(part)
                if not pairs:
                    at = position < _prefix_length(sizes, threshold, False)[own]
                    yield from _posted(key[at], key[at].astype(_U), ids[own[at]], sizes[own[at]], position[at], _times(key[at], blocks), buckets, parts)
                    continue
                # a set that may have a partner that isn't listed by two is listed by single tokens too; keys of two tokens are odd
                some = ~_by_two(sizes, threshold) | (threshold * sizes < _pair_set(threshold)) | (sizes > threshold * PAIR_MOST)
                at = np.flatnonzero((position < _prefix_length(sizes, threshold, False)[own]) & some[own])
                single = key[at] & np.uint32(0xFFFFFFFE)
                held = (single, single.astype(_U), at, _times(key[at], blocks))
                for x, y in _pairs_of_tokens(np.flatnonzero(_by_two(sizes, threshold)[own]), own, key):
                    whole = _mix(np.minimum(key[x], key[y]).astype(_U) << _U(32) | np.maximum(key[x], key[y]))
                    times = np.minimum(_times(key[x], pair_blocks), _times(key[y], pair_blocks))
                    two = ((whole >> _U(32)).astype(np.uint32) | np.uint32(1), whole, y, times)
                    found, whole, at, times = (np.concatenate(c) for c in zip(held, two))
                    yield from _posted(found, whole, ids[own[at]], sizes[own[at]], position[at], times, buckets, parts)
                    held = tuple(c[:0] for c in held)
                found, whole, at, times = held
                yield from _posted(found, whole, ids[own[at]], sizes[own[at]], position[at], times, buckets, parts)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and sizes of records, and of each prefix token the record's place, the position and the token."""
    ids, sizes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    prefixes = [np.frombuffer(p, np.uint32) for p in batch.column(2).to_pylist()]
    length = np.fromiter(map(len, prefixes), np.int64, len(prefixes))
    own = np.repeat(np.arange(len(length)), length)
    return ids, sizes, own, np.arange(len(own)) - np.repeat(np.cumsum(length) - length, length), np.concatenate(prefixes)


def _times(key: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    return blocks[key >> np.uint32(32 - (len(blocks).bit_length() - 1))].astype(np.int64)


def _pairs_of_tokens(at: np.ndarray, own: np.ndarray, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places x, y of two tokens of a record and a group, y after x in the prefix, for the tokens at ``at``; some SLICE_POSTINGS at a time."""
    slot = own[at] * PAIR_GROUPS + (_mix(key[at].astype(_U)) % _U(PAIR_GROUPS)).astype(np.int64)
    by = np.argsort(slot, kind="stable")
    at, slot = at[by], slot[by]
    end = np.searchsorted(slot, slot, side="right")
    active, step, held, n_held = np.flatnonzero(np.arange(len(at)) + 1 < end), 1, [], 0
    while len(active):
        held.append((at[active], at[active + step]))
        n_held += len(active)
        step += 1
        active = active[active + step < end[active]]
        if n_held >= 5 * SLICE_POSTINGS or not len(active):
            yield tuple(np.concatenate(c) for c in zip(*held))
            held, n_held = [], 0


def _posted(key, whole, ids, sizes, position, times, buckets: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Postings of keys, ``whole`` being what they are the hash of, each spread over ``times`` blocks."""
    rest, hot = np.flatnonzero(times <= 1), np.flatnonzero(times > 1)
    if len(hot):
        # a record of block b meets every block c in the task of (min, max) of b and c; slices of hot postings, as each is repeated
        for mine in np.array_split(hot, max(1, -(-int(times[hot].sum()) // SLICE_POSTINGS))):
            n = times[mine]
            again = np.repeat(mine, n)
            at_home = (_mix(ids[again].view(_U)) % times[again].astype(_U)).astype(np.int64)
            other = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
            pair = np.minimum(at_home, other) * _MOST_BLOCKS + np.maximum(at_home, other)
            yield from _sent(key[again], whole[again], ids[again], sizes[again], position[again], pair, at_home, buckets, parts)
    if len(rest):
        none = np.full(len(rest), -1, np.int64)
        yield from _sent(key[rest], whole[rest], ids[rest], sizes[rest], position[rest], none, none, buckets, parts)


def _sent(key, whole, ids, size, position, block, home, buckets: int, parts: int) -> Iterator[pa.RecordBatch]:
    by = np.argsort(key, kind="stable")
    block = block[by]
    columns = [key[by], ids[by], size[by].astype(np.int32), position[by].astype(np.int32), block.astype(np.int32), home[by].astype(np.int32)]
    yield from _cut(columns, _mix(whole[by] + _K[2] * (block + 1).astype(_U)), buckets, parts)


_MATCH = [np.int64, np.int64, np.int8, np.int8]  # a, b, how often (LARGE_L at most), whether one match is enough


def _lists(threshold: float, pairs: bool, flush_pairs: int, buckets: int, parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's postings to packed matches by pair."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n_held = 0
    for postings in _parts(batches, _POSTING):
        for found in _list_pairs(threshold, pairs, *postings):
            held.append(found)
            n_held += len(found[0])
            if n_held >= flush_pairs:
                yield from _flush(held, buckets, parts)
                held, n_held = [], 0
    if n_held:
        yield from _flush(held, buckets, parts)


def _list_pairs(threshold: float, pairs: bool, key, ids, size, position, block, home) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (a, b, matches wanted), a < b, of a part's lists; ``pairs``: odd keys are of two tokens, even ones are for pairs with a set too small or large for that."""
    # equal keys meet: sorted by key, then size, as one number; tokens of one record are left out
    by = np.argsort((key.astype(_U) << _U(32)) | size.astype(_U))
    sorted_key = key[by]
    alone = np.ones(len(by), bool)
    alone[:-1] &= sorted_key[1:] != sorted_key[:-1]
    alone[1:] &= sorted_key[1:] != sorted_key[:-1]
    by = by[~alone]
    if (block[by] >= 0).any():
        by = by[np.lexsort((size[by], block[by], key[by]))]
    key, ids, size, position, block, home = key[by], ids[by], size[by].astype(np.int64), position[by].astype(np.int64), block[by], home[by]
    if not len(key):
        return
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])]))
    end = np.repeat(np.append(first[1:], len(key)), np.diff(np.append(first, len(key))))
    # a pair needs (rest of a) + L - 1 >= share * (both sizes), and so for b: room is what a posting has for it, cost what it asks
    share = threshold / (1 + threshold)
    wanted = _matches_wanted(size)
    two = (key & np.uint32(1)).astype(bool) & pairs
    wanted[two] = PAIR_L
    room, cost = size - position - share * size + 1e-9, share * size
    spread = (block >= 0).any()
    across = (block >= 0) & (block // _MOST_BLOCKS != block % _MOST_BLOCKS)
    most = room + wanted - 1
    meets = np.arange(len(key)) + 1 < end
    if pairs:
        small, large = size < _pair_set(threshold), size > PAIR_MOST
        meets &= two | small | (size > threshold * PAIR_MOST - 1)
    active, step = np.flatnonzero(meets), 1
    while len(active):
        other = active + step
        # sizes rise along a list: who is too small or short of room for this partner is so for all that follow
        fits = (size[active] >= threshold * size[other] - 1e-9) & (most[active] >= cost[other])
        active, other = active[fits], other[fits]
        want = np.minimum(wanted[active], wanted[other])
        ok = (room[other] + want - 1 >= cost[active]) & (room[active] + want - 1 >= cost[other]) & (ids[active] != ids[other])
        if pairs:
            ok &= two[active] | small[active] | large[other]
        if spread:
            ok &= ~across[active] | (home[active] != home[other])  # pairs of one block have a task of their own
        a, b = ids[active[ok]], ids[other[ok]]
        yield np.minimum(a, b), np.maximum(a, b), want[ok].astype(np.int8)
        step += 1
        active = active[active + step < end[active]]


def _summed(a: np.ndarray, b: np.ndarray, times: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Matches in order of their pair, each pair once with its number of matches."""
    by = np.argsort((a << 32) | b) if 0 <= int(a.min()) and int(b.max()) < 1 << 31 else np.lexsort((b, a))
    a, b = a[by], b[by]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[first], b[first], np.add.reduceat(times[by].astype(np.int64), first), one[by][first]


def _flush(held: list, buckets: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Matches to packed rows by pair, so that no record's partners have to fit a task."""
    a, b, want = (np.concatenate(c) for c in zip(*held))
    a, b, times, one = _summed(a, b, np.ones(len(a), np.int8), (want == 1).astype(np.int8))
    # LARGE_L matches are as good as more
    columns = [a, b, np.minimum(times, LARGE_L).astype(np.int8), one]
    yield from _cut(columns, _mix(_mix(a.view(_U)) + b.view(_U)), buckets, parts)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's matches to pairs with as many as wanted."""
    for part in _parts(batches, _MATCH):
        a, b, times, one = _summed(*part)
        ok = (times >= LARGE_L) | (one == 1)
        yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])


# 5. Verification.


def _whole_sets(tokens: Tokens, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches, 1):
        sets = tokens(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "tokens"])


def _verify(threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches, 2):
        left, right = ([np.frombuffer(x, _U) for x in batch.column(i).to_pylist()] for i in (2, 3))
        similarity = np.zeros(batch.num_rows)
        for i, (x, y) in enumerate(zip(left, right)):
            shared = len(np.intersect1d(x, y, assume_unique=True))
            similarity[i] = shared / (len(x) + len(y) - shared)
        ok = pa.array(similarity >= threshold - 1e-12)
        kept = [batch.column(i).filter(ok) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(similarity).filter(ok)], names=["a", "b", "similarity"])


def _layout(rows: int, tasks: int, bucket_rows: int, part_rows: int) -> tuple[int, int]:
    """Buckets and parts of each for so many rows."""
    buckets = min(MOST_BUCKETS, max(tasks, -(-rows // bucket_rows)))
    return buckets, min(MOST_PARTS, max(1, -(-rows // (buckets * part_rows))))


def similar(sets: DataFrame, tokens: Tokens, threshold: float, name: str = "sets", limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """Membership ``(id, class_id)`` and pairs of classes ``(a, b, similarity)``, a < b, from ``threshold`` on.

    ``sets``: (id long, payload, version long); of several rows of an id the one with the highest
    version holds, null being the lowest. A class is all ids with one set, named by its smallest id.
    Null ids and records without tokens don't count. Empty tables give empty results.
    """
    spark = sets.sparkSession
    sets = sets.where(F.col("id").isNotNull()).select("id", "payload", "version")
    counts = sketch(sets.select("id", "payload"), tokens)
    large = int(counts.sum(dtype=np.int64)) >= limits.pair_tokens
    order = spark.sparkContext.broadcast(counts)
    records = stage(sets.mapInArrow(partial(_records, tokens, order, threshold, large), _RECORD).withColumn("row", F.monotonically_increasing_id()), f"{name}-records")
    # a version without tokens has no record and may be the last, so versions are compared before
    last = sets.groupBy("id").agg(F.max(F.coalesce("version", F.lit(-(1 << 62)))).alias("version"))
    oldest = F.lit(-(1 << 62))
    held = (
        records.select("id", F.coalesce("version", oldest).alias("version"), F.struct("n", "s1", "s2", "prefix_hash", "row").alias("r"))
        .groupBy("id", "version")
        .agg(F.max("r").alias("r"))
        .join(last, ["id", "version"])
        .select("id", "r.*")
    )
    held = stage(held, f"{name}-held")
    classes = held.groupBy("n", "s1", "s2", "prefix_hash").agg(F.min("id").alias("class_id"))
    members = held.join(classes, ["n", "s1", "s2", "prefix_hash"]).select("id", "class_id")
    groups = classes.groupBy("n", "prefix_hash").agg(F.min("class_id").alias("group_id"))
    grouped = stage(classes.join(groups, ["n", "prefix_hash"]).select("class_id", "group_id"), f"{name}-groups")
    heads = grouped.where(F.col("class_id") == F.col("group_id")).select(F.col("class_id").alias("id"))
    picked = held.join(heads, "id", "left_semi").select("row")
    # most records go on, so those that don't are few and no prefix has to be moved for them
    others = stage(records.select("row").join(picked, "row", "left_anti"), f"{name}-others")
    rows = records.select("row", "id", "n", "prefix")
    kept = rows.join(F.broadcast(others), "row", "left_anti") if others.count() <= BROADCAST_IDS else rows.join(picked, "row", "left_semi")
    prefixes = kept.select("id", "n", "prefix")
    counts = sketch(records.select("id", "prefix"), _prefix_tokens)
    lists, lengths = expected(counts), spark.sparkContext.broadcast(counts)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_postings, n_matches = int((counts * _blocks(lists, limits.hot_list)).sum()), int((lists * (lists - 1) / 2).sum())
    by_two = False
    if large:
        length = F.length("prefix") / 4
        n_two = prefixes.where(F.col("n").between(_pair_set(threshold), PAIR_MOST)).agg(F.sum(length * (length - 1)).alias("s")).first()["s"] or 0
        n_two = int(n_two / (2 * PAIR_GROUPS))
        if by_two := n_matches > limits.pair_gain * n_two:
            n_postings, n_matches = n_postings + n_two, n_matches // PAIR_GROUPS
    sizes = (limits.pair_bucket_postings, limits.pair_part_postings) if by_two else (limits.bucket_postings, limits.part_postings)
    posted, summed = _layout(n_postings, tasks, *sizes), _layout(n_matches, tasks, limits.bucket_matches, limits.part_matches)
    postings = prefixes.mapInArrow(partial(_postings, lengths, limits.hot_list, threshold, by_two, *posted), _PACKED).repartitionById(posted[0], "bucket").sortWithinPartitions("bucket", "part")
    matches = postings.mapInArrow(partial(_lists, threshold, by_two, limits.flush_pairs, *summed), _PACKED).repartitionById(summed[0], "bucket").sortWithinPartitions("bucket", "part")
    pairs = matches.mapInArrow(_candidates, "a long, b long")
    pairs = stage(pairs, f"{name}-pairs")
    unstage(records)  # held has what is still needed of them
    return members, _verified(sets, tokens, threshold, pairs, grouped, name)


def _verified(sets: DataFrame, tokens: Tokens, threshold: float, pairs: DataFrame, grouped: DataFrame, name: str) -> DataFrame:
    side = lambda c, g: grouped.select(F.col("class_id").alias(c), F.col("group_id").alias(g))
    across = pairs.withColumnsRenamed({"a": "ga", "b": "gb"}).join(side("x", "ga"), "ga").join(side("y", "gb"), "gb").select("x", "y")
    within = side("x", "g").join(side("y", "g"), "g").where(F.col("x") < F.col("y")).select("x", "y")
    both = across.unionByName(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    both = stage(both, f"{name}-candidates")
    unstage(pairs)
    wanted = stage(both.select(F.col("a").alias("id")).unionByName(both.select(F.col("b").alias("id"))).distinct(), f"{name}-wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    newest = F.max_by("payload", F.coalesce("version", F.lit(-(1 << 62)))).alias("payload")
    whole = sets.join(wanted, "id", "left_semi").groupBy("id").agg(newest).mapInArrow(partial(_whole_sets, tokens), "id long, tokens binary")
    whole = stage(whole, f"{name}-whole")
    joined = both.join(whole.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a").join(whole.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    return joined.select("a", "b", "ta", "tb").mapInArrow(partial(_verify, threshold), "a long, b long, similarity double")


def expanded(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(id_a, id_b)``, id_a < id_b: the pairs of classes and of each class, by member."""
    of = lambda i, c: members.select(F.col("id").alias(i), F.col("class_id").alias(c))
    across = pairs.join(of("x", "a"), "a").join(of("y", "b"), "b").select("x", "y")
    copies = members.groupBy("class_id").count().where("count > 1").select("class_id")
    twice = members.join(copies, "class_id")
    own = twice.select("class_id", F.col("id").alias("x")).join(twice.select("class_id", F.col("id").alias("y")), "class_id").where("x < y").select("x", "y")
    return across.unionByName(own).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def components(nodes: DataFrame, pairs: DataFrame, name: str = "groups") -> DataFrame:
    """``(id, group_id)``: the smallest id that each node is linked to, over whatever many links; its own without links."""
    parts = connected(pairs.select("a", "b"), name)
    return nodes.select("id").distinct().join(parts.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("part", "id").alias("group_id"))
