"""How link targets name pages: by path or by any suffix of whole segments, without regard to case or '.md'."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLANKS = " \t\r\n\u00a0"


def target_key(target: Column) -> Column:
    """The key a target names pages by; null for null and empty targets and for attachments.

    An attachment's last segment has an extension other than '.md'.
    """
    bare = F.lower(F.trim(target, F.lit(_BLANKS)))
    bare = F.when(F.startswith(bare, F.lit("./")), F.substring(bare, 3, 1 << 30)).otherwise(bare)
    key = F.regexp_replace(bare, r"\.md$", "")
    attached = ~F.endswith(bare, F.lit(".md")) & bare.rlike(r"\.[^./\s]+$")
    return F.when((key != "") & ~attached, key)


def path_key(path: Column) -> Column:
    return F.regexp_replace(F.lower(path), r"\.md$", "")


def suffix_keys(path: Column) -> Column:
    """All keys that name the page at ``path``: its own and those after each '/'."""
    parts = F.split(path_key(path), "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "/"))


def last_delivery(rows: DataFrame, key: str, columns: list[str], arrived: str) -> DataFrame:
    """One row ``(key, *columns)`` for each key: of several deliveries the last. Hot keys are combined before the shuffle."""
    early = F.lit("0001-01-01").cast("timestamp")
    value = F.max_by(F.struct(*columns), F.struct(F.coalesce(F.col(arrived).cast("timestamp"), early), F.xxhash64(*columns)))
    return rows.groupBy(key).agg(value.alias("__v")).select(key, *[F.col(f"__v.{c}").alias(c) for c in columns])


def page_keys(pages: DataFrame) -> DataFrame:
    """``(key, page_id, created_at, deleted_at)`` for every key that names a page."""
    last = last_delivery(pages, "page_id", ["path", "created_at", "deleted_at"], "scanned_at")
    return last.where(F.col("path").isNotNull()).select("page_id", "created_at", "deleted_at", F.explode(suffix_keys(F.col("path"))).alias("key"))
