"""The fact cache: facts of unchanged pages are taken from a table, the rest is extracted anew."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions import columns as C
from quillmere.functions.markdown import MAX_LINE
from quillmere.operators.copydiff import multiset_diff
from quillmere.operators.facts import extract

VERSION = "facts-v1"


def location(root: str, version: str = VERSION) -> str:
    """A folder of its own for each version, so that an old cache is never read."""
    return f"{root.rstrip('/')}/{version}"


def save(spark: SparkSession, facts: DataFrame, documents: DataFrame, root: str) -> None:
    """Facts with what tells whether they still hold, in 256 shards by path; only shards written are replaced."""
    state = documents.select("path", "length", "mtime_ns", F.sha2("content", 256).alias("content_sha"))
    rows = facts.join(state, "path").withColumn("written_ns", F.unix_micros(F.current_timestamp()) * 1000).withColumn("shard", C.shard(F.col("path")))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(location(root))


def valid(cached: DataFrame, documents: DataFrame) -> DataFrame:
    """Cached rows whose page is unchanged: by size and time if older than the cache's writing, else by content."""
    d = documents.select("path", F.col("length").alias("d_length"), F.col("mtime_ns").alias("d_mtime"), F.sha2("content", 256).alias("d_sha"))
    same_stat = (F.col("length") == F.col("d_length")) & (F.col("mtime_ns") == F.col("d_mtime")) & (F.col("mtime_ns") < F.col("written_ns"))
    return cached.join(d, "path").where(same_stat | (F.col("content_sha") == F.col("d_sha"))).drop("d_length", "d_mtime", "d_sha")


def read(spark: SparkSession, root: str) -> DataFrame | None:
    """The cached rows below ``root``, if there are any."""
    try:
        return spark.read.parquet(location(root))
    except AnalysisException:
        return None


def facts_with(cached: DataFrame, documents: DataFrame, max_line: int = MAX_LINE) -> DataFrame:
    """Facts of all documents, extracted only where the cache has none that hold; pages that are gone drop out."""
    kept = valid(cached, documents)
    fresh = extract(documents.join(kept.select("path"), "path", "left_anti"), max_line)
    return kept.select(*fresh.columns).unionByName(fresh)


def facts_with_cache(spark: SparkSession, documents: DataFrame, root: str) -> DataFrame:
    return facts_with(spark.read.parquet(location(root)), documents)


def pruned(cached: DataFrame, documents: DataFrame) -> DataFrame:
    """Cached rows of pages that are still there."""
    return cached.join(documents.select("path"), "path", "left_semi")


def stats(cached: DataFrame, documents: DataFrame) -> DataFrame:
    """``(documents, hits, misses, hit_rate)`` of a run: one row, the rate null without documents."""
    held = valid(cached, documents).select("path", F.lit(1).alias("hit"))
    n, hits = F.count(F.lit(1)), F.count("hit")
    return documents.select("path").join(held, "path", "left").agg(n.alias("documents"), hits.alias("hits"), (n - hits).alias("misses"), F.round(F.try_divide(hits, n), 9).alias("hit_rate"))


def inventory(cached: DataFrame) -> DataFrame:
    return cached.groupBy("shard").agg(F.count(F.lit(1)).alias("entries"), F.sum("length").alias("bytes"))


#: The order of differences between findings of two runs: by file, rule, line, column, message and kind.
DIVERGENCE_ORDER = ["file_path", "rule_id", "line", "column", "message", "kind"]


def divergent_findings(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """Findings that a run with the cache and one without have more often than the other, in order of all six keys."""
    columns = [c for c in fresh.columns if c != "seq"]
    return multiset_diff(cached.select(*columns), fresh.select(*columns), ("cache", "fresh")).orderBy(*DIVERGENCE_ORDER)


def divergence(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """``(path, field)`` where stored and fresh facts differ; a page on one side only differs in 'path'."""
    fields = [c for c in fresh.columns if c != "path"]
    a, b = stored.select("path", *[F.to_json(F.struct(c)).alias(f"a_{c}") for c in fields], F.lit(True).alias("in_a")), fresh.select("path", *[F.to_json(F.struct(c)).alias(f"b_{c}") for c in fields], F.lit(True).alias("in_b"))
    both = F.col("in_a") & F.col("in_b")
    diffs = F.array_compact(F.array(F.when(F.coalesce(both, F.lit(False)), F.lit(None)).otherwise("path"), *[F.when(both & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in fields]))
    return a.join(b, "path", "full").select("path", F.explode(diffs).alias("field"))
