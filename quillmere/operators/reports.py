"""Aggregates, orders and differences over findings, tags, caches and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmere.functions import columns as C

# Tags.


def tag_counts(tags: DataFrame) -> DataFrame:
    """``(prefix, value, cnt)`` for rows of one ``tag``, by occurrence; tags without a '/' inside don't count."""
    tag = F.col("tag")
    return (
        tags.where(F.instr(tag, "/") > 1)
        .select(F.substring_index(tag, "/", 1).alias("prefix"), F.regexp_replace(tag, "^[^/]*/", "").alias("value"))
        .groupBy("prefix", "value")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def domains_tree(counts: DataFrame) -> DataFrame:
    """A row per prefix: how many values it has and their total."""
    return counts.groupBy("prefix").agg(F.count(F.lit(1)).alias("n_values"), F.sum("cnt").alias("total"))


def domains_show(counts: DataFrame, prefix: str) -> DataFrame:
    """The values of a prefix by falling count, then name."""
    return counts.where(F.col("prefix") == prefix).select("value", "cnt").orderBy(F.desc("cnt"), "value")


def bad_tags(tags: DataFrame, prefixes: list[str]) -> DataFrame:
    """Rows whose ``tag`` has no prefix, '(none)', or one that is not listed."""
    tag = F.col("tag")
    prefix = F.when(F.instr(tag, "/") <= 1, "(none)").otherwise(F.substring_index(tag, "/", 1))
    return tags.withColumn("prefix", prefix).where((F.col("prefix") == "(none)") | ~F.col("prefix").isin(prefixes))


# Findings.


def finding_counts(findings: DataFrame) -> DataFrame:
    """Counts by rule, by severity and in all, in one pass: ``(rule_id, severity, n)`` with nulls for 'all'."""
    flagged = findings.groupingSets([[F.col("rule_id")], [F.col("severity")], []], "rule_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    return flagged.select(F.element_at(F.array(F.lit(""), F.lit("rule"), F.lit("severity"), F.lit("all")), F.col("level").cast("int") + 1).alias("by"), "rule_id", "severity", "n")


def ordered(findings: DataFrame) -> DataFrame:
    """By file, rule and line; ties as they were emitted, by ``seq``."""
    return findings.orderBy("file_path", "rule_id", "line", "seq")


def exit_code(findings: DataFrame, strict: bool = False) -> DataFrame:
    """One row with 1 if there is an error, or, if ``strict``, a warning; else 0."""
    bad = (F.col("severity") == "error") | (F.lit(strict) & (F.col("severity") == "warn"))
    return findings.agg(F.coalesce(F.max(F.when(bad, 1).otherwise(0)), F.lit(0)).alias("exit_code"))


def suppressed(findings: DataFrame, ignores: DataFrame) -> DataFrame:
    """Findings of files that ignore their rule or '*'; ``ignores``: (file_path, rule_id)."""
    exact = F.trim(F.col("i.rule_id"))
    return findings.alias("f").join(ignores.alias("i"), (F.col("f.file_path") == F.col("i.file_path")) & ((exact == F.col("f.rule_id")) | (exact == "*")), "left_semi")


def unsuppressed(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Findings but those whose line switches off their rule or '*'; ``lines``: (file_path, line, rule_id)."""
    same = (F.col("f.file_path") == F.col("l.file_path")) & (F.col("f.line") == F.col("l.line"))
    return findings.alias("f").join(lines.alias("l"), same & ((F.col("l.rule_id") == "*") | (F.col("l.rule_id") == F.col("f.rule_id"))), "left_anti")


# Windows.


def heading_jumps(headings: DataFrame, key: str = "path", order: str = "line", multiple_h1: bool = False) -> DataFrame:
    """Headings that are a second H1, or deeper than one below the deepest so far, with ``issue`` and ``expected``."""
    before = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    seen = headings.withColumn("deepest", F.max("level").over(before)).withColumn("h1", F.sum(F.when(F.col("level") == 1, 1).otherwise(0)).over(before))
    again = (F.col("level") == 1) & (F.col("h1") > 0) & F.lit(not multiple_h1)
    jump = F.col("level") > F.col("deepest") + 1
    issues = F.array_compact(F.array(F.when(again, F.lit("multiple H1")), F.when(jump, F.lit("skipped level"))))
    return seen.select(key, order, "level", (F.col("deepest") + 1).alias("expected"), F.explode(issues).alias("issue"))


def islands(rows: DataFrame, key: str, at: str, flag: Column, least: int = 2) -> DataFrame:
    """Runs of neighbouring rows with ``flag``, by dense place ``at``: first, last and size, of ``least`` rows or more."""
    own = W.partitionBy(key).orderBy(at)
    marked = rows.withColumn("__place", F.row_number().over(own)).where(flag)
    grouped = marked.withColumn("__run", F.col("__place") - F.row_number().over(own))
    return grouped.groupBy(key, "__run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("size")).where(F.col("size") >= least).drop("__run")


def nearest_ancestor(pages: DataFrame, holders: DataFrame) -> DataFrame:
    """``(path, holder)``: of the directories above a page that hold something, the nearest; ``holders``: (dir)."""
    up = pages.select("path", F.posexplode(C.ancestors(F.col("path"))).alias("depth", "dir"))
    return up.join(holders.select("dir").distinct(), "dir").groupBy("path").agg(F.max_by("dir", "depth").alias("holder"))


def session_starts(events: DataFrame, ts: str, gap: str = "6 seconds") -> DataFrame:
    """``events`` with ``batch_start``, the first time of the batch between quiet gaps that each is in; null times have none.

    The gap is global: any change prolongs the batch. Changes are combined per second; seconds are put
    in order within each day, and the days, one row each, carry the last change and the open batch over
    to the next. So no task orders more than a day's seconds or all days.
    """
    second = F.date_trunc("second", F.col(ts))
    seconds = events.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day"), second.alias("sec")).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    within, days = W.partitionBy("day").orderBy("sec"), W.orderBy("day")
    ended = seconds.groupBy("day").agg(F.max("hi").alias("last_hi"))
    ended = ended.select("day", F.lag("last_hi").over(days).alias("before"))
    previous = F.coalesce(F.lag("hi").over(within), F.col("before"))
    quiet = previous.isNull() | (F.col("lo") > previous + F.expr(f"INTERVAL {gap}"))
    opened = seconds.join(ended, "day").withColumn("opened", F.when(quiet, F.col("lo")))
    running = opened.withColumn("start", F.last("opened", ignorenulls=True).over(within.rowsBetween(W.unboundedPreceding, 0)))
    carried = opened.groupBy("day").agg(F.max("opened").alias("last_opened"))
    carried = carried.select("day", F.last("last_opened", ignorenulls=True).over(days.rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    starts = running.join(carried, "day").select("day", "sec", F.coalesce("start", "carried").alias("batch_start"))
    return events.withColumns({"day": F.to_date(ts), "sec": second}).join(starts, ["day", "sec"]).drop("day", "sec")


def sessions(events: DataFrame, key: str, ts: str, op: str, gap: str = "6 seconds") -> DataFrame:
    """Batches of changes between quiet gaps, each key with its last change: ``(batch_start, key, op)``."""
    return session_starts(events, ts, gap).groupBy("batch_start", key).agg(F.max_by(op, F.struct(F.col(ts), F.col(op))).alias(op))


# Debt, repositories, rules.


def debt(pages: DataFrame, prefix: str, tag: str) -> DataFrame:
    """Pages below ``prefix`` with ``tag``, newest first: by created (missing last), time of change, path."""
    kept = pages.where(F.startswith("path", F.lit(prefix)) & F.array_contains("tags", tag))
    order = [F.expr("nullif(created, '')").desc_nulls_last(), F.desc("mtime_ns"), F.col("path")]
    return kept.select("path", "mtime_ns", F.coalesce("created", F.lit("")).alias("created")).orderBy(*order).select(F.col("path").alias("source"), C.directory(F.col("path")).alias("where"), "created")


def repo_states(catalog: DataFrame, probes: DataFrame) -> DataFrame:
    """A state per catalogued repository from what was found at its place.

    ``probes``: (slug, found, symlink, symlink_broken, has_git, remotes array, head); a repository
    without a probe is absent. Any remote that is the catalogued one, however written, will do.
    """
    joined = catalog.join(probes, "slug", "left")
    fits = F.exists("remotes", lambda r: C.git_url(r) == C.git_url(F.col("remote")))
    state = (
        F.when(F.coalesce("symlink_broken", F.lit(False)), "broken-symlink")
        .when(~F.coalesce("found", F.lit(False)), "absent")
        .when(~F.coalesce("has_git", F.lit(False)), "not-a-repo")
        .when((F.coalesce("remote", F.lit("")) != "") & (F.size(F.coalesce("remotes", F.array().cast("array<string>"))) > 0) & ~fits, "remote-mismatch")
        .when(F.coalesce("symlink", F.lit(False)), "symlinked")
        .otherwise("present")
    )
    commit, head = F.coalesce("commit", F.lit("")), F.coalesce("head", F.lit(""))
    drifted = state.isin("present", "symlinked") & (commit != "") & (head != "") & ~F.startswith(head, commit) & ~F.startswith(commit, head)
    return joined.select("slug", state.alias("state"), drifted.alias("drifted"))


def uncataloged(uses: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows whose ``repo`` has no catalog page."""
    return uses.where((F.col("repo").isNotNull()) & (F.col("repo") != "")).join(catalog.groupBy("repo").agg(F.min("path").alias("page")).select("repo"), "repo", "left_anti")


def overlaps(rules: DataFrame) -> DataFrame:
    """Pairs of a pack's rules that one page could meet, by ``pos``: ``(rule_a, rule_b)``; ``rules``: (pos, id, glob, tags).

    As many rows as there are pairs, so for packs as people write them; ``overlap_classes`` takes any number.

    Globs with different literal first directories can't meet; tags always can. Rules of one first
    directory are joined by it, those without one with all others.
    """
    top = F.regexp_extract("glob", r"^([^/*?\[{]+)/", 1)
    r = rules.select("pos", "id", F.when(F.coalesce("glob", F.lit("")) == "", "").otherwise(top).alias("top"))
    a, b = r.alias("a"), r.alias("b")
    later = F.col("a.pos") < F.col("b.pos")
    pair = [F.col("a.id").alias("rule_a"), F.col("b.id").alias("rule_b")]
    same = a.where("top <> ''").join(b.where("top <> ''"), (F.col("a.top") == F.col("b.top")) & later).select(*pair)
    wide = a.where("top = ''").join(b, later).select(*pair)
    rest = a.where("top <> ''").join(b.where("top = ''"), later).select(*pair)
    return same.unionByName(wide).unionByName(rest)


def overlap_classes(rules: DataFrame) -> DataFrame:
    """``overlaps`` without its pairs, a row per rule: ``(id, top, wide, n_meets)``; ``rules``: (id, glob).

    A rule's class is its literal first directory, '' for wide ones. Two rules can meet if they are of
    one class or either is wide; ``n_meets`` counts the others that a rule can meet.
    """
    top = F.regexp_extract("glob", r"^([^/*?\[{]+)/", 1)
    r = rules.select("id", F.when(F.coalesce("glob", F.lit("")) == "", "").otherwise(top).alias("top"))
    sizes = r.groupBy("top").agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.agg(F.sum("n").alias("n_all"), F.coalesce(F.sum(F.when(F.col("top") == "", F.col("n"))), F.lit(0)).alias("n_wide"))
    wide = F.col("top") == ""
    meets = F.when(wide, F.col("n_all") - 1).otherwise(F.col("n") - 1 + F.col("n_wide"))
    return r.join(sizes.crossJoin(F.broadcast(whole)), "top").select("id", "top", wide.alias("wide"), meets.alias("n_meets"))  # whole: one row


def conflicts(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """Overlapping rules that ask for different things: patterns on one target with other expressions.

    ``pairs``: (rule_a, rule_b); ``rules``: (id, check, severity, target, match). Rules that are off, other
    checks and equal expressions are no conflict.
    """
    side = lambda x: rules.select(F.col("id").alias(f"rule_{x}"), F.col("check").alias(f"check_{x}"), F.col("severity").alias(f"severity_{x}"), F.col("target").alias(f"target_{x}"), F.col("match").alias(f"match_{x}"))
    both = pairs.join(side("a"), "rule_a").join(side("b"), "rule_b").where("severity_a <> 'off' AND severity_b <> 'off' AND check_a = 'pattern' AND check_b = 'pattern'")
    found = both.where(F.col("target_a").eqNullSafe(F.col("target_b")) & ~F.col("match_a").eqNullSafe(F.col("match_b")))
    return found.select("rule_a", "rule_b", F.col("target_a").alias("target"), F.lit("warn").alias("severity"))


def nearest_key(keys: DataFrame, known: list[str], most: int = 3) -> DataFrame:
    """``keys`` with the known key of least edit distance, at most ``most``; ties go to the earlier one."""
    options = F.array_compact(F.array(*[F.when(F.levenshtein("key", F.lit(k), most) >= 0, F.struct(F.levenshtein("key", F.lit(k), most).alias("d"), F.lit(i).alias("i"), F.lit(k).alias("k"))) for i, k in enumerate(known)]))
    return keys.withColumn("nearest", F.array_min(options)["k"])

