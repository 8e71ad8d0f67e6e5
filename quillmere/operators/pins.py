"""External-version pins against injected object tables.

``pins``: (path, repo, branch, commit, locations, checksums, has_fm_commit, has_inputs, has_receipt_key,
receipt_null, receipt_ref, receipt_block). The outside world comes as tables:
``objects`` (repo, name, oid, type), where ``name`` is a commit, a ref 'origin/<branch>' or
'<commit or ref>:<location>'; ``ancestry`` (repo, commit, ref) for commits that a ref contains;
``branches`` (repo, branch) of catalog pages; ``present`` (repo, owned, batch_failed); ``worktree``
(repo, path). Nothing here runs version control.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a ref and a repository may be written with.
REF = r"^[A-Za-z0-9._/-]+$"
CONTROL = r"[\x00-\x1f\x7f]"


def shape(has_commit: Column, has_inputs: Column) -> Column:
    """'transitional', 'legacy', 'receipt' or 'none'."""
    return F.when(has_commit & has_inputs, "transitional").when(has_commit, "legacy").when(has_inputs, "receipt").otherwise("none")


@dataclass
class World:
    objects: DataFrame
    ancestry: DataFrame
    branches: DataFrame
    present: DataFrame
    worktree: DataFrame | None = None


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def _unsafe(c: str) -> Column:
    value = F.coalesce(F.col(c), F.lit(""))
    return F.when(value.rlike(CONTROL), F.concat(F.lit(c), F.lit(" contains control characters"))).when(F.startswith(value, F.lit("-")), F.concat(F.lit(c), F.lit(" has a leading '-'")))


def problem() -> Column:
    """Why a pin can't be used: what it lacks, or a field that isn't safe; null if it is well."""
    receipt = F.col("shape") == "receipt"
    empty = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) == 0
    missing = F.array_compact(F.array(F.when(_blank("repo"), F.lit("repo")), F.when(~receipt & _blank("branch"), F.lit("branch")), F.when(empty("locations"), F.lit("location")), F.when(empty("checksums"), F.lit("checksum"))))
    counts = F.concat(F.lit("pin has "), F.size("locations").cast("string"), F.lit(" location(s) but "), F.size("checksums").cast("string"), F.lit(" checksum(s)"))
    lacks = F.when(receipt & _blank("commit"), F.lit(None)).when(F.size(missing) > 0, F.concat(F.lit("incomplete pin: missing "), F.array_join(missing, ", "))).when(F.size("locations") != F.size("checksums"), counts)
    named = lambda c, what: F.when(~_blank(c) & (~F.col(c).rlike(REF) | F.contains(F.col(c), F.lit(".."))), F.concat(F.lit(what), F.lit(" is not a valid name")))
    listed = lambda c, test: F.exists(F.coalesce(F.col(c), F.array().cast("array<string>")), test)
    bad_location = F.when(listed("locations", lambda v: v.rlike(CONTROL) | F.startswith(v, F.lit("-"))), F.lit("location is not safe"))
    bad_sum = F.when(listed("checksums", lambda v: v.rlike(CONTROL)), F.lit("checksum contains control characters"))
    return F.coalesce(lacks, _unsafe("repo"), _unsafe("branch"), _unsafe("commit"), bad_location, bad_sum, named("branch", "branch"), named("repo", "repo"))


def checked(pins: DataFrame, world: World, owned_repo: str = "") -> DataFrame:
    """Pins with shape, branch (of the catalog page where a receipt has none), ``problem``, ``here`` and ``owned``."""
    p = pins.withColumn("shape", shape(F.col("has_fm_commit"), F.col("has_inputs"))).where("shape <> 'none'")
    b = world.branches.groupBy("repo").agg(F.min("branch").alias("__branch"))
    p = p.join(b, "repo", "left").withColumn("branch", F.when(_blank("branch") & (F.col("shape") == "receipt"), F.coalesce("__branch", F.lit(""))).otherwise(F.coalesce("branch", F.lit("")))).drop("__branch")
    here = world.present.groupBy("repo").agg(F.max(F.coalesce("owned", F.lit(False))).alias("__owned"), F.max(F.coalesce("batch_failed", F.lit(False))).alias("batch_failed"))
    p = p.join(here.withColumn("here", F.lit(True)), "repo", "left").withColumn("here", F.coalesce("here", F.lit(False)))
    owned = (F.col("repo") == owned_repo) if owned_repo else F.coalesce("__owned", F.lit(False))
    return p.withColumn("owned", owned).withColumn("problem", problem()).drop("__owned")


def _finding(reason: Column) -> list[Column]:
    return [F.col("path"), F.lit(1).alias("line"), F.create_map(F.lit("Slug"), F.coalesce("repo", F.lit("")), F.lit("Branch"), F.col("branch"), F.lit("Commit"), F.coalesce("commit", F.lit("")), F.lit("Reason"), reason).alias("data")]


def _object(rows: DataFrame, objects: DataFrame, name: Column, alias: str) -> DataFrame:
    o = objects.select(F.col("repo").alias(f"__r{alias}"), F.col("name").alias(f"__n{alias}"), F.col("oid").alias(alias), F.col("type").alias(f"{alias}_type"))
    return rows.withColumn(f"__k{alias}", name).join(o, (F.col("repo") == F.col(f"__r{alias}")) & (F.col(f"__k{alias}") == F.col(f"__n{alias}")), "left").drop(f"__r{alias}", f"__n{alias}", f"__k{alias}")


def _usable(pins: DataFrame, world: World, owned_repo: str) -> DataFrame:
    p = checked(pins, world, owned_repo).where(F.col("problem").isNull() & F.col("here") & (F.col("owned") | ~_blank("commit")))
    return _object(p, world.objects, F.col("commit"), "commit_oid")


def _absent(pins: DataFrame, world: World, owned_repo: str, report: bool) -> DataFrame:
    gone = checked(pins, world, owned_repo).where(F.col("problem").isNull() & ~F.col("here") & F.lit(report))
    return gone.select(*_finding(F.concat(F.lit("repo "), F.col("repo"), F.lit(" is not present"))))


def resolves(pins: DataFrame, world: World, owned_repo: str = "", report_absent: bool = False) -> DataFrame:
    """Malformed pins, and commits that are none in their repository."""
    bad = checked(pins, world, owned_repo).where(F.col("problem").isNotNull()).select(*_finding(F.col("problem")))
    u = _usable(pins, world, owned_repo).where(~_blank("commit") & ~F.col("batch_failed") & ~F.col("commit_oid_type").eqNullSafe("commit"))
    detail = F.coalesce(F.concat(F.lit("object type "), F.col("commit_oid_type")), F.lit("missing"))
    lost = u.select(*_finding(F.concat(F.lit("commit "), F.col("commit"), F.lit(" does not resolve in "), F.col("repo"), F.lit(" ("), detail, F.lit(")"))))
    return bad.unionByName(lost).unionByName(_absent(pins, world, owned_repo, report_absent))


def on_origin(pins: DataFrame, world: World, owned_repo: str = "", report_absent: bool = False) -> DataFrame:
    """Commits that the origin's branch doesn't contain; for owned repositories, locations that are gone."""
    u = _usable(pins, world, owned_repo)
    out = u.where(~F.col("owned") & (F.col("commit_oid_type") == "commit")).withColumn("ref", F.concat(F.lit("origin/"), F.col("branch")))
    out = _object(out, world.objects, F.col("ref"), "origin")
    inside = world.ancestry.select("repo", "commit", "ref").distinct().withColumn("contained", F.lit(True))
    out = out.join(inside, ["repo", "commit", "ref"], "left")
    lost = out.where(_blank("branch") | F.col("origin").isNull() | ((F.col("origin") != F.col("commit")) & F.col("contained").isNull()))
    reason = F.when(_blank("branch"), F.concat(F.lit("branch unresolvable for repo "), F.col("repo"))).otherwise(F.concat(F.lit("commit "), F.col("commit"), F.lit(" is not on "), F.col("ref")))
    found = lost.select(*_finding(reason))
    if world.worktree is not None:
        own = u.where("owned").select("*", F.explode("locations").alias("location")).withColumn("location", F.regexp_replace("location", "/$", ""))
        there = world.worktree.select(F.col("repo"), F.col("path").alias("location")).distinct()
        escapes = F.col("location").rlike(r"^(?:\.\.(?:/|$)|/)")
        gone = own.join(there, ["repo", "location"], "left_anti")
        found = found.unionByName(gone.select(*_finding(F.concat(F.lit("owned location "), F.col("location"), F.when(escapes, " escapes the repo root").otherwise(" is missing from the working tree")))))
    return found.unionByName(_absent(pins, world, owned_repo, report_absent))


def _located(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.explode(F.arrays_zip("locations", "checksums")).alias("z")).select("*", F.regexp_replace(F.col("z.locations"), "/$", "").alias("location"), F.col("z.checksums").alias("want"))


def checksum_reproduces(pins: DataFrame, world: World, owned_repo: str = "", report_absent: bool = False) -> DataFrame:
    """Locations that a pinned commit hasn't, or has with another object."""
    u = _located(_usable(pins, world, owned_repo).where(F.col("commit_oid_type") == "commit"))
    u = _object(u, world.objects, F.concat_ws(":", "commit", "location"), "got").where(F.col("got").isNull() | (F.col("got") != F.col("want")))
    reason = F.when(F.col("got").isNull(), F.concat(F.lit("location "), F.col("location"), F.lit(" does not exist at "), F.col("commit"))).otherwise(
        F.concat(F.lit("checksum mismatch at "), F.col("location"), F.lit(": pin "), F.col("want"), F.lit(", object "), F.col("got"))
    )
    return u.select(*_finding(reason)).unionByName(_absent(pins, world, owned_repo, report_absent))


def stale(pins: DataFrame, world: World, owned_repo: str = "", report_absent: bool = False) -> DataFrame:
    """Pins behind their origin where a location has another object by now."""
    u = _usable(pins, world, owned_repo).where((F.col("commit_oid_type") == "commit") & ~_blank("branch")).withColumn("ref", F.concat(F.lit("origin/"), F.col("branch")))
    u = _object(u, world.objects, F.col("ref"), "origin").where(F.col("origin") != F.col("commit"))
    u = _located(u.join(world.ancestry.select("repo", "commit", "ref").distinct(), ["repo", "commit", "ref"], "left_semi"))
    u = _object(u, world.objects, F.concat_ws(":", "ref", "location"), "got").where(F.col("got") != F.col("want"))
    reason = F.concat(F.col("ref"), F.lit(" advanced past pin "), F.col("commit"), F.lit(" and "), F.col("location"), F.lit(" drifted (pin "), F.col("want"), F.lit(", origin "), F.col("got"), F.lit(")"))
    return u.select(*_finding(reason)).unionByName(_absent(pins, world, owned_repo, report_absent))


def unpinned(effects: DataFrame, owned_repo: str = "") -> DataFrame:
    """Effect pages without a full pin, by state; ``effects``: the pins' columns of every effect page and its ``status``.

    Retired and pending pages and legacy pins are well.
    """
    e = effects.where(~F.coalesce("status", F.lit("")).isin("retired", "pending")).withColumn("shape", shape(F.col("has_fm_commit"), F.col("has_inputs")))
    owned = (F.col("repo") == owned_repo) if owned_repo else F.lit(False)
    pinned = F.col("receipt_block") & ~_blank("commit") & (F.size(F.coalesce("checksums", F.array().cast("array<string>"))) > 0)
    reason = (
        F.when(F.col("shape") == "none", "no-pin")
        .when(F.col("shape") == "transitional", "mid-migration")
        .when(F.col("shape") == "legacy", F.lit(None))
        .when(owned, F.when(F.col("has_receipt_key"), "owned-with-receipt"))
        .when(~F.col("has_receipt_key"), "receipt-absent")
        .when(F.col("receipt_null"), "born-invalid")
        .when(~pinned, "receipt-dangling")
    )
    return e.select("path", F.lit(1).alias("line"), reason.alias("reason")).where(F.col("reason").isNotNull()).select("path", "line", F.create_map(F.lit("Reason"), F.col("reason")).alias("data"))


__all__ = ["World", "shape", "problem", "checked", "resolves", "on_origin", "checksum_reproduces", "stale", "unpinned"]
