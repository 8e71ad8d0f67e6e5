"""Differences between two copies of a table by content-defined chunks.

Both copies are laid out by one range partitioning of their keys and sorted. A rolling hash over the
last rows' digests decides where a chunk ends, so the ends depend on the rows around them alone: a row
added, lost or changed moves the cuts near it and leaves all others. Chunks are compared by their
fingerprints, an anti-join of a few bytes per chunk. Fields are compared only for the rows of chunks
that the other copy has not.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.session import stage

#: Rows in the rolling window, and the mask a hash must miss for its row to end a chunk: 1 of 8. A fingerprint costs a
#: few bytes and spares a chunk's rows, so that chunks pay that hold no change even where one row of ten has changed.
WINDOW = 4
MASK = np.uint64(7)
#: The most fingerprints that are broadcast, of 16 bytes each; more are joined.
BROADCAST_PRINTS = 1 << 20

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _mix(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX[k]
    x = (x ^ (x >> np.uint64(32))) * _MIX[(k + 1) % 3]
    return x ^ (x >> np.uint64(31))


class _Chunker:
    """Cuts one side's rows into chunks, batch by batch; rows of the open chunk are held back."""

    def __init__(self) -> None:
        self.recent = np.zeros(WINDOW - 1, np.uint64)
        self.held: list[tuple[pa.RecordBatch, np.ndarray]] = []

    def add(self, batch: pa.RecordBatch, digest: np.ndarray) -> Iterator[pa.RecordBatch]:
        run = np.concatenate([self.recent, digest])
        rolling = np.zeros(len(digest), np.uint64)
        for i in range(WINDOW):
            rolling = rolling * _MIX[0] + run[i : i + len(digest)]
        ends = np.flatnonzero((_mix(rolling, 1) & MASK) == 0) + 1
        self.recent = run[len(run) - (WINDOW - 1) :]
        last = int(ends[-1]) if len(ends) else 0
        if last:
            before = sum(len(d) for _, d in self.held)
            self.held.append((batch.slice(0, last), digest[:last]))
            yield from self.close(before + ends[:-1])
        if last < batch.num_rows:
            self.held.append((batch.slice(last), digest[last:]))

    def close(self, cuts: np.ndarray = np.zeros(0, np.int64)) -> Iterator[pa.RecordBatch]:
        """The held rows with the fingerprints of their chunks, which end at ``cuts`` and the last row."""
        if not self.held:
            return
        digest = np.concatenate([d for _, d in self.held])
        starts = np.concatenate([[0], cuts]).astype(np.int64)
        sizes = np.diff(np.append(starts, len(digest)))
        low, high = (np.repeat(np.add.reduceat(_mix(digest, k), starts), sizes).view(np.int64) for k in (0, 2))
        at = 0
        for batch, own in self.held:
            marks = [pa.array(x[at : at + len(own)]) for x in (low, high)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *marks], names=[*batch.schema.names, "__low", "__high"])
            at += len(own)
        self.held = []


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (side, digest, ...) sorted by side and key, with their chunk's fingerprint."""
    chunker, side = _Chunker(), None
    for batch in batches:
        if not batch.num_rows:
            continue
        sides = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(sides)) + 1).tolist(), len(sides)]
        for a, b in zip(cuts, cuts[1:]):
            if sides[a] != side:
                yield from chunker.close()
                chunker, side = _Chunker(), sides[a]
            part = batch.slice(a, b - a)
            yield from chunker.add(part, part.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
    yield from chunker.close()


def latest(rows: DataFrame, keys: list[str], fields: list[str], version: str) -> DataFrame:
    """One row per key, null parts being values of their own: the latest by ``version``.

    A null version is the oldest; of rows with one version the largest (fields in order, nulls first)
    holds. Rows of a key are combined before the shuffle.
    """
    packed = F.max(F.struct(F.col(version).alias("__v"), *fields)).alias("__row")
    return rows.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"__row.{f}").alias(f) for f in fields])


def diff(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """``(*keys, kind, field)``: rows that one copy only has, and fields that differ.

    Both sides have one row per key. kind 'only_in_<name>' with field 'row', or 'differs' with the
    field's name, one row for each field. Nulls equal nulls in keys and fields and differ from all
    else. Two empty tables give no rows, one empty table gives all rows of the other.
    """
    columns = [*keys, *fields]
    digest = F.xxhash64(*[F.concat(F.lit("="), F.col(c).cast("string")) if c in fields else F.col(c) for c in columns], F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in columns]))
    both = left.select(F.lit(0).alias("__side"), digest.alias("__digest"), *columns).unionByName(right.select(F.lit(1).alias("__side"), digest.alias("__digest"), *columns))
    laid = both.repartitionByRange(*keys).sortWithinPartitions("__side", *keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in laid.schema.fields)
    rows = stage(laid.mapInArrow(_chunks, f"{schema}, __low bigint, __high bigint"), "chunks")
    prints = rows.groupBy("__low", "__high").agg(F.max("__side").alias("last"), F.min("__side").alias("first"))
    unmatched = stage(prints.where(F.col("last") == F.col("first")).select("__low", "__high"), "unmatched")
    unmatched = F.broadcast(unmatched) if unmatched.count() <= BROADCAST_PRINTS else unmatched.hint("merge")
    left_rows, right_rows = (rows.where(F.col("__side") == s).join(unmatched, ["__low", "__high"], "left_semi") for s in (0, 1))
    pair = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    joined = left_rows.alias("a").join(right_rows.alias("b"), pair, "full")
    in_left, in_right = F.col("a.__side").isNotNull(), F.col("b.__side").isNotNull()

    def case(condition: Column, kind: str, field: str) -> Column:
        return F.when(condition, F.struct(F.lit(kind).alias("kind"), F.lit(field).alias("field")))

    cases = [case(~in_right, f"only_in_{names[0]}", "row"), case(~in_left, f"only_in_{names[1]}", "row")]
    cases += [case(in_left & in_right & ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), "differs", f) for f in fields]
    key_columns = [F.when(in_left, F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in keys]
    return joined.select(*key_columns, F.inline(F.array_compact(F.array(*cases))))


def multiset_diff(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Rows that one bag has more often than the other, with ``kind`` and how many more, ``n``.

    Equal rows are counted on both sides before the shuffle; nulls equal nulls.
    """
    columns = left.columns
    signed = left.select(*columns, F.lit(1).alias("__n")).unionByName(right.select(*columns, F.lit(-1).alias("__n")))
    surplus = signed.groupBy(*columns).agg(F.sum("__n").alias("__n")).where("__n <> 0")
    return surplus.select(*columns, F.when(F.col("__n") > 0, f"only_in_{names[0]}").otherwise(f"only_in_{names[1]}").alias("kind"), F.abs("__n").alias("n"))
