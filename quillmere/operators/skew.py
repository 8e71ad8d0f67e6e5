"""Joins whose larger side may have hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows, so there are at most 1/HOT_SHARE of them.
HOT_SHARE = 1 / 200
#: Rows of a hot key that one task shall get, about; and how many parts a hot key is cut into at least and at most.
ROWS_PER_PART, MIN_PARTS, MAX_PARTS = 250_000, 8, 4096


def hot_keys(rows: DataFrame, key: str) -> dict[str, int]:
    """The hot keys of ``rows`` with their number of rows: at most 200, counted with a combine before the shuffle."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), key).limit(int(1 / HOT_SHARE)).collect()  # a top-k of fixed length
    total = rows.where(F.col(key).isNotNull()).count() if top else 0
    return {r[key]: r["n"] for r in top if r["n"] >= max(1000, total * HOT_SHARE)}


def salted(big: DataFrame, small: DataFrame, key: str, by: str, hot: dict[str, int], salt: str = "__salt") -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``salt``; joining on ``[key, salt]`` equals joining on ``key``.

    Rows of ``big`` with a hot key are cut into parts by the column ``by``, as many as that key's rows
    ask for; rows of ``small`` with such a key are repeated once per part. Other rows have salt 0.
    """
    if not hot:
        return big.withColumn(salt, F.lit(0)), small.withColumn(salt, F.lit(0))
    entries = [F.lit(x) for k, n in hot.items() for x in (k, min(MAX_PARTS, max(MIN_PARTS, -(-n // ROWS_PER_PART))))]
    parts = F.coalesce(F.try_element_at(F.create_map(*entries), F.col(key)), F.lit(1))
    left = big.withColumn(salt, F.pmod(F.hash(by), parts).cast("int"))
    return left, small.withColumn(salt, F.explode(F.sequence(F.lit(0), parts - 1)))
