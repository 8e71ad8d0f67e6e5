"""How often every distinct term occurs, and in how many records.

1. The global dictionary gives every distinct (field, term) its rank in order of both as its id. It is
   sorted by ranges on the executors and numbered within each; only the ranges' sizes meet on the
   driver.
2. Rows, one per record and term with its weight added up, are encoded to ids: by a broadcast of the
   dictionary as long as its measured size allows that, else by a join in which hot terms are salted.
   From here on no term travels.
3. Each block of encoded rows is counted into arrays of occurrences and of records by id, and sends
   for every range of ids those that are not zero.
4. The task of a range adds the blocks' arrays into its own. A term that every record has arrives once
   from each block.
5. The ids are decoded.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.operators.skew import hot_keys, salted
from quillmere.session import stage

#: Ids of a range, the arrays that a task sums at once.
RANGE_IDS = 1 << 13
#: Encoded rows that a block counts at once.
BLOCK_ROWS = 1 << 19
#: The largest dictionary that is broadcast, in bytes of its terms and entries.
BROADCAST_BYTES = 16 << 20
_ENTRY_BYTES = 64
#: Positions in a partition, of Spark's increasing ids.
_PLACE = (1 << 33) - 1
_ARRAYS = "range int, offsets binary, occurrences binary, records binary"
_SUMS = "term_id long, occurrences long, records long"


def dictionary(terms: DataFrame) -> tuple[DataFrame, int, int]:
    """``(field, term, term_id)``, how many these are, and their bytes: ids are ranks from 0 in order of field and term."""
    spark = terms.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = terms.select("field", "term").distinct().repartitionByRange(parts, "field", "term").sortWithinPartitions("field", "term")
    placed = stage(ranges.withColumn("place", F.monotonically_increasing_id()).select("field", "term", F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND(F.lit(_PLACE)).alias("at")), "dictionary")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("term")).alias("bytes")).orderBy("part").collect()  # a row for each range
    ahead = np.cumsum([0, *(r["n"] for r in sizes)]).tolist()
    firsts = spark.createDataFrame([(r["part"], first) for r, first in zip(sizes, ahead)], "part long, first long")
    numbered = placed.join(F.broadcast(firsts), "part").select("field", "term", (F.col("first") + F.col("at")).alias("term_id"))
    return numbered, ahead[-1], sum(r["bytes"] for r in sizes) + _ENTRY_BYTES * ahead[-1]


def encode(rows: DataFrame, numbered: DataFrame, size: int, broadcast_bytes: int) -> DataFrame:
    """Rows ``(field, term, weight)`` as ``(term_id, weight)``."""
    if size <= broadcast_bytes:
        joined = rows.join(F.broadcast(numbered), ["field", "term"])
    else:
        left, right = salted(rows, numbered, "term", "record", hot_keys(rows, "term"))
        joined = left.join(right, ["field", "term", "__salt"])
    return joined.select("term_id", "weight")


def _block(range_ids: int, block_rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Encoded rows, one per record and term, to count arrays by range of ids."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n_held = 0
    for batch in batches:
        held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
        n_held += batch.num_rows
        if n_held >= block_rows:
            yield _counted(range_ids, held)
            held, n_held = [], 0
    if n_held:
        yield _counted(range_ids, held)


def _counted(range_ids: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    ids, weights = (np.concatenate(c) for c in zip(*held))
    by = np.argsort(ids, kind="stable")
    ids, first, records = np.unique(ids[by], return_index=True, return_counts=True)
    occurrences = np.add.reduceat(weights[by], first)
    ranges, cuts = np.unique(ids // range_ids, return_index=True)
    cuts = [*cuts.tolist(), len(ids)]
    cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), cut((ids % range_ids).astype(np.int32)), cut(occurrences), cut(records)], names=["range", "offsets", "occurrences", "records"])


def _summed(range_ids: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks' arrays in order of their range to the ranges' sums."""
    now, sums = None, np.zeros((2, range_ids), np.int64)
    for batch in batches:
        for number, offsets, *counts in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if number != now:
                yield from _sums(range_ids, now, sums)
                now = number
                sums[:] = 0
            at = np.frombuffer(offsets, np.int32)
            for total, own in zip(sums, counts):
                total[at] += np.frombuffer(own, np.int64)
    yield from _sums(range_ids, now, sums)


def _sums(range_ids: int, number: int | None, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    if number is not None:
        at = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(number * range_ids + at), pa.array(sums[0][at]), pa.array(sums[1][at])], names=["term_id", "occurrences", "records"])


def count_terms(rows: DataFrame, range_ids: int = RANGE_IDS, block_rows: int = BLOCK_ROWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(field, term, term_id, occurrences, records)`` for rows ``(record, field, term, weight)``.

    A record may repeat a term: it then occurs as often as the weights say, in one record. Rows with a
    null field or term don't count; null records together are one record, a null weight is 0. An empty
    table gives no rows, other columns are not read. Ids are the ranks of the terms from 0, by field
    and term; the other parameters change no result.
    """
    combined = (
        rows.where(F.col("field").isNotNull() & F.col("term").isNotNull())
        .groupBy("record", "field", "term")
        .agg(F.coalesce(F.sum("weight"), F.lit(0)).cast("long").alias("weight"))
    )
    combined = stage(combined, "terms")
    numbered, n, size = dictionary(combined)
    tasks = min(max(1, -(-n // range_ids)), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    arrays = encode(combined, numbered, size, broadcast_bytes).mapInArrow(partial(_block, range_ids, block_rows), _ARRAYS)
    sums = arrays.repartitionById(tasks, F.col("range") % tasks).sortWithinPartitions("range").mapInArrow(partial(_summed, range_ids), _SUMS)
    return sums.join(numbered, "term_id").select("field", "term", "term_id", "occurrences", "records")


def clean_tag(tag: Column) -> Column:
    """A tag without spaces, tabs and non-breaking spaces at both ends, then without one leading '#', in lower case."""
    bare = F.trim(tag, F.lit(" \t\u00a0"))
    return F.lower(F.when(F.startswith(bare, F.lit("#")), F.substring(bare, 2, 1 << 30)).otherwise(bare))


def tag_rows(pages: DataFrame) -> DataFrame:
    """Rows for ``count_terms`` from pages ``(page_id, tags, scanned_at)``; of a page's deliveries the last counts.

    Null pages, tag lists and tags and empty tags give no rows.
    """
    last = pages.groupBy("page_id").agg(F.max_by("tags", F.coalesce("scanned_at", F.lit(0).cast("timestamp"))).alias("tags"))
    return (
        last.select(F.col("page_id").alias("record"), F.explode("tags").alias("tag"))
        .select("record", F.lit("tags").alias("field"), clean_tag(F.col("tag")).alias("term"), F.lit(1).alias("weight"))
        .where(F.col("term") != "")
    )


def counts_rows(counts: DataFrame) -> DataFrame:
    """Rows for ``count_terms`` from snapshots ``(scan_id, wiki, prefix, value, cnt, scanned_at)``.

    Rows equal in all these columns count once; a null or empty prefix or value gives none.
    """
    part = [F.lower(F.trim(F.col(c), F.lit(" \t\u00a0"))) for c in ("prefix", "value")]
    return (
        counts.select("scan_id", "wiki", "prefix", "value", "cnt", "scanned_at")
        .distinct()
        .where((part[0] != "") & (part[1] != ""))
        .select(F.col("scan_id").alias("record"), F.lit("counts").alias("field"), F.concat(part[0], F.lit("/"), part[1]).alias("term"), F.col("cnt").alias("weight"))
    )


def marked_terms(pages: DataFrame, counts: DataFrame, rare: int = 2, common_tags: float = 1 / 20, common_counts: float = 1 / 2) -> DataFrame:
    """All terms with ``is_rare`` and ``is_common``.

    'tags': rare in at most ``rare`` pages, common in at least ``common_tags`` of all distinct pages.
    'counts': rare if the counts add up to at most ``rare``, common in at least ``common_counts`` of all
    distinct snapshots. In small tables a term can be both. Without records there are no terms.
    """
    terms = count_terms(tag_rows(pages).unionByName(counts_rows(counts)))
    totals = (
        pages.agg(F.countDistinct("page_id").alias("total")).select(F.lit("tags").alias("field"), "total", F.lit(common_tags).alias("share"))
        .unionByName(counts.agg(F.countDistinct("scan_id").alias("total")).select(F.lit("counts").alias("field"), "total", F.lit(common_counts).alias("share")))
    )
    scarce = F.when(F.col("field") == "tags", F.col("records")).otherwise(F.col("occurrences"))
    return terms.join(F.broadcast(totals), "field").select(  # two rows
        "field", "term", "term_id", "occurrences", "records", (scarce <= rare).alias("is_rare"), (F.col("records") >= F.col("total") * F.col("share")).alias("is_common")
    )


def found(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """``(field, term, mark)``, a row for each mark a term has."""
    marks = F.array_compact(F.array(F.when(F.col("is_rare"), F.lit("rare")), F.when(F.col("is_common"), F.lit("common"))))
    return marked_terms(pages, counts).select("field", "term", F.explode(marks).alias("mark"))
