"""References to records that do not exist, by signed counts per key.

Every change is a delta: a reference seen adds one to its key's references, a record created adds one
to the existence of each key that names it, a record deleted takes one away. Keys with references and
no existence are orphans. ``apply_deltas`` keeps such counts up to date from batches of changes and
``current_orphans`` reports from them.

``orphan_references`` judges each reference as of the moment it was seen, by the same counts, kept for
each key and hour: summed over a key's hours they say what exists as an hour begins. An hour in which
a key's existence does not change is decided by its counts alone, and references are touched only
where a count says that they are orphans; where existence changes within the hour, its changes and
references are put in order. So no task sorts all references of a key, and a reference meets one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmere.operators.names import page_keys, suffix_keys, target_key
from quillmere.operators.skew import HOT_SHARE, salted
from quillmere.session import stage

_ALWAYS = "0001-01-01"
STATE = "key string, refs long, existing long"


def summed(deltas: DataFrame, by: list[str]) -> DataFrame:
    """Signed changes ``(*by, refs, existing)`` added up; null keys don't count."""
    return deltas.where(F.col(by[0]).isNotNull()).groupBy(*by).agg(F.sum("refs").alias("refs"), F.sum("existing").alias("existing"), F.sum(F.abs("existing")).alias("changes"))


def apply_deltas(state: DataFrame, deltas: DataFrame) -> DataFrame:
    """The state ``(key, refs, existing)`` after signed changes of the same columns; keys back at zero are left out."""
    both = summed(state.select("key", "refs", "existing").unionByName(deltas.select("key", "refs", "existing")), ["key"])
    return both.where((F.col("refs") != 0) | (F.col("existing") != 0)).drop("changes")


def current_orphans(state: DataFrame) -> DataFrame:
    """Keys that are referred to and do not exist."""
    return state.where((F.col("refs") > 0) & (F.col("existing") <= 0)).select("key", "refs")


def keyed_references(refs: DataFrame) -> DataFrame:
    """``(ref_table, ref_id, key, at, hour)`` of references ``(ref_table, ref_id, target, seen_at)`` that name pages."""
    keyed = refs.select("ref_table", "ref_id", target_key(F.col("target")).alias("key"), F.col("seen_at").cast("timestamp_ntz").alias("at"))
    return keyed.where(F.col("key").isNotNull()).withColumn("hour", _hour(F.col("at")))


def _hour(at: Column) -> Column:
    return F.datediff(F.to_date(at), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour(at)


def named_pages(pages: DataFrame, permanent: DataFrame | None = None) -> DataFrame:
    """``(key, created_at, deleted_at)`` of all pages that a key names."""
    stamp = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    named = page_keys(pages).select("key", stamp("created_at"), stamp("deleted_at"))
    if permanent is None:
        return named
    always = permanent.where(F.col("path").isNotNull()).select(F.explode(suffix_keys(F.col("path"))).alias("key"))
    return named.unionByName(always.select("key", F.lit(_ALWAYS).cast("timestamp_ntz").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("deleted_at")))


def existence_deltas(named: DataFrame) -> DataFrame:
    """``(key, at, existing, created_at)``: one more from created_at, one less from deleted_at, and 0 for pages that never exist."""
    created, deleted = F.col("created_at"), F.col("deleted_at")
    lives = created.isNotNull() & (deleted.isNull() | (deleted > created))
    change = lambda at, by, made: F.struct(at.alias("at"), F.when(lives, by).otherwise(0).cast("long").alias("existing"), made.alias("made"))
    changes = F.array(change(created, 1, created), change(deleted, -1, F.lit(None).cast("timestamp_ntz")))
    rows = named.select("key", F.posexplode(changes).alias("n", "c")).select("key", "n", "c.*")
    return rows.where((F.col("n") == 0) | ((F.col("existing") != 0) & F.col("at").isNotNull())).select("key", "at", "existing", F.col("made").alias("created_at"))


def orphan_references(refs: DataFrame, pages: DataFrame, permanent: DataFrame | None = None) -> DataFrame:
    """``(ref_table, ref_id, period, reason)`` of the references that no existing page answered when seen.

    ``refs``: (ref_table, ref_id, target, seen_at); ``pages``: (page_id, path, created_at, deleted_at,
    scanned_at), of whose deliveries the last holds; ``permanent``: (path) of pages that always exist.
    Null and empty targets and attachments are no references. A page without created_at never exists,
    but is named; a reference without seen_at is met only by permanent pages, its period is null.
    Repeated references give one row. An empty table of pages makes all references 'missing'.
    """
    keyed = stage(keyed_references(refs), "references")
    changes = stage(existence_deltas(named_pages(pages, permanent)).withColumn("hour", _hour(F.col("at"))), "existence")

    # the counts of each key and hour, and what is known of the key by then
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    deltas = keyed.select("key", "hour", one.alias("refs"), none.alias("existing")).unionByName(changes.select("key", "hour", none.alias("refs"), "existing"))
    keys = changes.groupBy("key").agg(F.max("created_at").alias("last_created"), (F.min("created_at") == F.lit(_ALWAYS).cast("timestamp_ntz")).alias("always"), F.lit(True).alias("named"))
    hours = W.partitionBy("key").orderBy("hour").rowsBetween(W.unboundedPreceding, -1)
    counts = summed(deltas, ["key", "hour"]).withColumn("open", F.coalesce(F.sum("existing").over(hours), none)).join(keys, "key", "left")
    timeless = F.col("hour").isNull()
    orphaned = F.when(timeless, ~F.coalesce("always", F.lit(False))).otherwise((F.col("open") == 0) | (F.col("changes") > 0))
    # a null hour is told by its own number, so that it joins
    suspects = stage(counts.where((F.col("refs") > 0) & orphaned).select("key", _told("hour"), "refs", "open", (~timeless & (F.col("changes") > 0)).alias("mixed"), "last_created", "named"), "suspects")

    total = suspects.agg(F.coalesce(F.sum("refs"), F.lit(0))).first()[0]
    heavy = suspects.where(F.col("refs") >= max(1000, total * HOT_SHARE)).groupBy("key").agg(F.max("refs").alias("n"))  # at most 1 / HOT_SHARE rows
    hot = {r["key"]: r["n"] for r in heavy.collect()}
    left, right = salted(keyed.withColumn("hour", _told("hour")), suspects.drop("refs"), "key", "ref_id", hot)
    met = left.join(right, ["key", "hour", "__salt"]).drop("__salt")
    at_once = met.where(~F.col("mixed"))

    # hours with changes: all in order of time, a change counting for references of its own moment
    columns = ["key", "hour", "at", "existing", "ref_table", "ref_id", "open", "last_created", "named"]
    within = changes.where("existing <> 0").join(suspects.where("mixed").select("key", "hour", "open", "last_created", "named"), ["key", "hour"])
    seen = met.where("mixed").withColumn("existing", none).select(columns)
    both = within.select("key", "hour", "at", "existing", F.lit(None).cast("string").alias("ref_table"), F.lit(None).cast(dict(keyed.dtypes)["ref_id"]).alias("ref_id"), "open", "last_created", "named").unionByName(seen)
    by_then = W.partitionBy("key", "hour").orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow)
    judged = both.withColumn("now", F.col("open") + F.sum("existing").over(by_then)).where(F.col("ref_table").isNotNull() & (F.col("now") == 0))

    reason = F.when(F.col("named").isNull(), "missing").when(F.col("last_created") > F.col("at"), "late").otherwise("deleted")
    out = [F.col("ref_table"), F.col("ref_id"), F.date_format("at", "yyyy-MM").alias("period"), reason.alias("reason")]
    return at_once.select(out).unionByName(judged.select(out)).distinct()


def _told(hour: str) -> Column:
    return F.coalesce(F.col(hour), F.lit(-(1 << 62))).alias(hour)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """The number of orphan references per table, period and reason."""
    return orphans.groupBy("ref_table", "period", "reason").agg(F.count(F.lit(1)).alias("n"))


def references(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """One table of references from several: name -> (rows, id column)."""
    parts = [df.select(F.lit(name).alias("ref_table"), F.col(key).alias("ref_id"), "target", "seen_at") for name, (df, key) in tables.items()]
    return reduce(DataFrame.unionByName, parts)
