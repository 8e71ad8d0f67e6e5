"""Resolving link targets against a universe of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions import columns as C


def universe(paths: DataFrame, globs: list[str] | None = None) -> DataFrame:
    """The paths that a glob list admits, entries with '!' excluding; no including glob admits nothing."""
    if globs is None:
        return paths.select("path").where(F.col("path").isNotNull())
    wanted, banned = [g for g in globs if not g.startswith("!")], [g[1:] for g in globs if g.startswith("!")]
    path = F.col("path")
    return paths.select("path").where(path.isNotNull() & C.matches_any(path, wanted) & ~C.matches_any(path, banned))


def glob_index(paths: DataFrame, globs: list[str] | None = None, index_pages: bool = True) -> DataFrame:
    """``(key)`` of full keys, for exact links: the path without '.md' and, for an INDEX page, its directory."""
    path = F.col("path")
    keys = [F.lower(C.no_ext(path))]
    if index_pages:
        keys.append(F.when((F.lower(C.stem(path)) == "index") & F.contains(path, F.lit("/")), F.lower(C.directory(path))))
    return universe(paths, globs).select(F.explode(F.array_compact(F.array(*keys))).alias("key")).distinct()


def broken(links: DataFrame, paths: DataFrame, roots: list[str] | None = None, scope: list[str] | None = None, skip_prefixes: list[str] = ()) -> DataFrame:
    """Links whose target is nowhere, ``type`` 'BROKEN', or only outside ``scope``, 'ESCAPE'.

    ``links`` have a ``target``; a target is there if its whole key or its last segment is a key or a
    stem of the universe. Empty targets and targets with a prefix to skip are left out. Targets are
    looked up once each, so a target that many links share costs one row.
    """
    target = F.lower(F.col("target"))
    kept = links.where((F.col("target").isNotNull()) & (F.col("target") != ""))
    for p in skip_prefixes:
        kept = kept.where(~F.startswith(target, F.lit(p.lower())))

    def known(globs: list[str] | None) -> DataFrame:
        full = glob_index(paths, globs)
        stems = universe(paths, globs).select(F.lower(C.stem(F.col("path"))).alias("key"))
        return full.select(F.lit("full").alias("how"), "key").unionByName(stems.select(F.lit("stem").alias("how"), "key")).distinct()

    wanted = kept.select(target.alias("t")).distinct()
    tries = wanted.select("t", F.explode(F.array(F.struct(F.lit("full").alias("how"), F.col("t").alias("key")), F.struct(F.lit("stem").alias("how"), C.base(F.col("t")).alias("key")))).alias("k")).select("t", "k.*")
    found = tries.join(known(roots), ["how", "key"]).select("t").distinct()
    verdict = wanted.join(found.withColumn("found", F.lit(True)), "t", "left")
    if scope is not None:
        inside = tries.join(known(scope), ["how", "key"]).select("t").distinct().withColumn("inside", F.lit(True))
        verdict = verdict.join(inside, "t", "left")
        kind = F.when(F.col("inside"), F.lit(None)).when(F.col("found"), "ESCAPE").otherwise("BROKEN")
    else:
        kind = F.when(F.col("found").isNull(), "BROKEN")
    verdict = verdict.select("t", kind.alias("type")).where(F.col("type").isNotNull())
    return kept.withColumn("t", target).join(verdict, "t").drop("t")


def stem_paths(paths: DataFrame, globs: list[str] | None = None) -> DataFrame:
    """``(stem, paths, n)``: the paths, distinct and sorted, that a stem names."""
    u = universe(paths, globs).distinct()
    return u.groupBy(F.lower(C.stem(F.col("path"))).alias("stem")).agg(F.array_sort(F.collect_set("path")).alias("paths")).withColumn("n", F.size("paths"))


def ambiguous(links: DataFrame, paths: DataFrame, roots: list[str] | None = None, skip_prefixes: list[str] = ()) -> DataFrame:
    """Links by a bare stem that several paths share, with ``n`` and ``paths``."""
    target = F.col("target")
    bare = links.where((target != "") & ~F.contains(target, F.lit("/")))
    for p in skip_prefixes:
        bare = bare.where(~F.startswith(F.lower(target), F.lit(p.lower())))
    return bare.withColumn("stem", F.lower(target)).join(stem_paths(paths, roots).where("n > 1"), "stem").drop("stem")


def resolve(targets: DataFrame, paths: DataFrame) -> DataFrame:
    """``targets`` with ``resolved``, by whole path, else by the only path of its stem, else by the only one it is a suffix of.

    ``ambiguous`` is set where none of these decides between several paths of the stem.
    """
    u = paths.select("path").where(F.col("path").isNotNull()).distinct().select("path", F.lower(C.no_ext(F.col("path"))).alias("key"))
    wanted = targets.select("target").where(F.col("target") != "").distinct()
    wanted = wanted.withColumn("t", F.lower(F.regexp_replace(F.regexp_replace(F.col("target"), "/+$", ""), r"\\+$", "")))
    exact = u.groupBy("key").agg(F.max("path").alias("exact"))
    stems = u.groupBy(C.base(F.col("key")).alias("stem")).agg(F.count(F.lit(1)).alias("n_stem"), F.min("path").alias("only"))
    ends = u.select("path", F.explode(C.suffixes(F.col("key"))).alias("suffix")).groupBy("suffix").agg(F.count(F.lit(1)).alias("n_suffix"), F.min("path").alias("suffix_path"))
    found = (
        wanted.join(exact, wanted.t == exact.key, "left")
        .withColumn("stem", C.base(F.col("t")))
        .join(stems, "stem", "left")
        .join(ends, F.col("t") == F.col("suffix"), "left")
    )
    by_stem = F.when(F.col("n_stem") == 1, F.col("only"))
    by_suffix = F.when(F.contains("t", F.lit("/")) & (F.col("n_suffix") == 1), F.col("suffix_path"))
    resolved = F.coalesce("exact", by_stem, by_suffix)
    found = found.select("target", resolved.alias("resolved"), (resolved.isNull() & (F.coalesce("n_stem", F.lit(0)) > 1)).alias("ambiguous"))
    return targets.join(found, "target", "left")


def shortest_unique(paths: DataFrame) -> DataFrame:
    """``(path, canonical)``: the shortest suffix that no other path has, without regard to case; else the whole path."""
    u = paths.select("path").where(F.col("path").isNotNull()).distinct()
    tails = u.select("path", F.posexplode(C.suffixes(C.no_ext(F.col("path")))).alias("depth", "suffix"))
    counts = tails.groupBy(F.lower("suffix").alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("k")
    short = tails.withColumn("k", F.lower("suffix")).join(counts, "k").groupBy("path").agg(F.min_by("suffix", "depth").alias("canonical"))
    return u.join(short, "path", "left").select("path", F.coalesce("canonical", C.no_ext(F.col("path"))).alias("canonical"))


def noncanonical(links: DataFrame, paths: DataFrame) -> DataFrame:
    """Links that resolve but are not written as their page's shortest unique suffix, with ``canonical``."""
    found = resolve(links, paths).where(F.col("resolved").isNotNull())
    short = shortest_unique(paths).withColumnRenamed("path", "resolved")
    return found.join(short, "resolved").where(~F.col("canonical").eqNullSafe(F.col("target")))


def resolve_excluding(targets: DataFrame, paths: DataFrame, excluded: DataFrame) -> DataFrame:
    """``targets`` with the only path of their stem that is not in ``excluded``."""
    left = paths.select("path").distinct().join(excluded.select("path"), "path", "left_anti")
    stems = left.groupBy(F.lower(C.stem(F.col("path"))).alias("stem")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("resolved")).where("n = 1")
    return targets.withColumn("stem", F.lower(C.stem(F.col("target")))).join(stems.select("stem", "resolved"), "stem", "left").drop("stem")


def resolve_note(targets: DataFrame, paths: DataFrame) -> DataFrame:
    """``(target, path)`` of every page a note reference names: whole path or suffix, case counting, hidden directories left out."""
    u = paths.select("path").where(~F.exists(F.split("path", "/", -1), lambda p: F.startswith(p, F.lit("."))))
    keys = u.select("path", F.explode(C.suffixes(C.no_ext(F.col("path")))).alias("key"))
    return targets.select("target").distinct().withColumn("key", C.no_ext(F.col("target"))).join(keys, "key").select("target", "path")


def moved(target: Column, old: Column, new: Column) -> Column:
    """The target after a move, at the depth it had; null if it doesn't name the old path."""
    t, o = F.lower(target), F.lower(old)
    depth, parts = F.size(F.split(target, "/", -1)), F.split(new, "/", -1)
    tail = F.when(depth > F.size(parts), new).otherwise(F.array_join(F.slice(parts, F.size(parts) - F.least(depth, F.size(parts)) + 1, F.least(depth, F.size(parts))), "/"))
    return F.when(t == o, new).when(F.endswith(o, F.concat(F.lit("/"), t)), tail)
