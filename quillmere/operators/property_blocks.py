"""Typed frontmatter fields: text, date, tag and link values, one finding stream per block."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions import columns as C
from quillmere.functions.globs import glob_regex, java_regex
from quillmere.functions.templates import column

# Parts of the date layouts rules are written in, longest first, and Spark's letters for them.
LAYOUT = [("2006", "yyyy"), ("January", "MMMM"), ("Jan", "MMM"), ("01", "MM"), ("02", "dd"), ("15", "HH"), ("04", "mm"), ("05", "ss"), ("Z07:00", "XXX"), ("T", "'T'")]


def spark_layout(layout: str) -> str:
    out, i = [], 0
    while i < len(layout):
        for token, letters in LAYOUT:
            if layout.startswith(token, i):
                out.append(letters)
                i += len(token)
                break
        else:
            out.append(layout[i])
            i += 1
    return "".join(out)


def values(documents: DataFrame, keys: list[str]) -> DataFrame:
    """``(path, key, pos, value, kind)``: a field's value, list items one by one."""
    rows = documents.where(~F.col("is_foreign")).select("path", F.col("fm"), "fm_kinds", F.explode(F.array(*map(F.lit, keys))).alias("key"))
    rows = rows.where(F.map_contains_key("fm_kinds", F.col("key"))).withColumn("kind", F.try_element_at("fm_kinds", F.col("key")))
    raw = F.try_element_at(F.from_json("fm", "map<string,string>"), F.col("key"))
    listed = F.from_json(raw, "array<string>")
    items = F.when(F.col("kind") == "list", listed).otherwise(F.array(raw))
    return rows.select("path", "key", "kind", F.posexplode(items).alias("pos", "value"))


def missing(documents: DataFrame, keys: list[str]) -> DataFrame:
    """Required fields that a page has not."""
    keyless = documents.where(~F.col("is_foreign")).select("path", F.posexplode(F.array_except(F.array(*map(F.lit, keys)), F.coalesce("fm_keys", F.array().cast("array<string>")))).alias("pos", "key"))
    return keyless.select("path", F.col("pos").alias("seq"), F.lit(1).alias("line"), _data(Key=F.col("key"), Reason=F.lit("missing required field"), Message=F.concat("key", F.lit(": missing required field"))))


def _data(**kv: Column) -> Column:
    return F.map_filter(F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull()).alias("data")


def _stream(rows: DataFrame, line: int, reason: Column, **more: Column) -> DataFrame:
    message = F.concat("key", F.lit(": "), F.concat(more["Target"], F.lit(" — ")) if "Target" in more else F.lit(""), F.col("reason"))
    found = rows.withColumn("reason", reason).where(F.col("reason").isNotNull())
    return found.select("path", F.col("pos").alias("seq"), F.lit(line).alias("line"), _data(Key=F.col("key"), Value=F.col("value"), Reason=F.col("reason"), Message=message, **more))


def text(rows: DataFrame, block: dict) -> DataFrame:
    """Values that don't match, and values that aren't listed; a value can be both."""
    out = []
    if block.get("match"):
        out.append(_stream(rows, 0, F.when(~F.col("value").rlike(java_regex(block["match"])), F.lit(f"does not match pattern \"{block['match']}\""))))
    if block.get("in") is not None:
        out.append(_stream(rows, 0, F.when(~F.col("value").isin([str(v) for v in block["in"]]), F.lit(f"not in allowed values [{' '.join(map(str, block['in']))}]"))))
    return reduce(DataFrame.unionByName, out) if out else rows.limit(0).select("path", F.col("pos").alias("seq"), F.lit(0).alias("line"), _data(Key=F.col("key")))


def date(rows: DataFrame, block: dict | bool) -> DataFrame:
    """Values that are no date by the layout; a bare YAML date is one always."""
    layout = block.get("format", "2006-01-02") if isinstance(block, dict) else "2006-01-02"
    string = F.col("kind").isin("string", "list")
    bad = F.try_to_timestamp("value", F.lit(spark_layout(layout))).isNull()
    reason = F.when(F.col("kind") == "date", F.lit(None)).when(~string, F.concat(F.lit("expected string, got "), "kind")).when(bad, F.concat(F.lit("not a date by "), F.lit(layout)))
    return _stream(rows, 0, reason, Date=F.when(string, F.col("value")))


def tag(rows: DataFrame, block: dict) -> DataFrame:
    """Tags without '/', and prefixes and values that aren't listed or, if listed, don't match."""
    rows = rows.withColumn("p", F.substring_index("value", "/", 1)).withColumn("v", F.regexp_replace("value", "^[^/]*/", ""))
    split = F.contains("value", F.lit("/"))
    out = [_stream(rows, 0, F.when(~split, F.lit("tag missing prefix/value separator")))]
    for name, part in (("prefix", F.col("p")), ("value", F.col("v"))):
        rule = block.get(name) or {}
        unknown = ~part.isin([str(x) for x in rule["in"]]) if rule.get("in") is not None else F.lit(False)
        odd = ~part.rlike(java_regex(rule["match"])) if rule.get("match") else F.lit(False)
        reason = F.when(split & unknown, F.concat(F.lit(f'unknown {name} "'), part, F.lit('"'))).when(split & odd, F.lit(f"{name} does not match pattern \"{rule.get('match')}\""))
        out.append(_stream(rows, 0, reason, Prefix=F.col("p"), TagValue=F.col("v")))
    return reduce(DataFrame.unionByName, out)


#: Type blocks of property rules by name: from rows of values, the block and the check's context to findings.
REGISTRY: dict[str, Callable[[DataFrame, dict, object], DataFrame]] = {}


def block(name: str) -> Callable:
    """Register a type block; rules may use it by its name from then on."""

    def add(f: Callable) -> Callable:
        REGISTRY[name] = f
        return f

    return add


block("text")(lambda rows, given, ctx: text(rows, given))
block("date")(lambda rows, given, ctx: date(rows, given))
block("tag")(lambda rows, given, ctx: tag(rows, given))
block("wikilink")(lambda rows, given, ctx: wikilink(rows, given if isinstance(given, dict) else {}, ctx.paths, ctx.worktree, ctx.times))


def resolve_index(paths: DataFrame, mode: str) -> DataFrame:
    """``(key)`` a link may name: files by stem and path, folders by name and path, direct parents, or both of the first."""
    p = paths.where(~F.startswith("path", F.lit("/"))).select("path")
    path = F.lower("path")
    files = F.array(C.stem(path), C.no_ext(path))
    folders = C.ancestors(path)
    folders = F.concat(folders, F.transform(folders, C.base))
    parent = F.when(F.contains("path", F.lit("/")), F.array(C.directory(path), C.base(C.directory(path)))).otherwise(F.array().cast("array<string>"))
    keys = {"file_exists": files, "folder_exists": folders, "parent_exists": parent, "file_or_folder_exists": F.concat(files, folders)}[mode]
    return p.select(F.explode(keys).alias("k")).distinct()


def wikilink(rows: DataFrame, block: dict, paths: DataFrame, worktree: DataFrame | None = None, times: DataFrame | None = None) -> DataFrame:
    """Targets that aren't there, targets newer than the page, and displays other than the first fitting template's.

    Text without brackets is a target itself. ``worktree``: (path) of files outside the corpus;
    ``times``: (path, ts) of last commits.
    """
    tokens = F.regexp_extract_all("value", F.lit(r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]"), F.lit(0))
    whole = F.array(F.struct(F.trim("value").alias("target"), F.lit(None).cast("string").alias("display")))
    parsed = F.transform(tokens, lambda t: F.struct(F.regexp_extract(t, r"\[\[([^\]|]+)", 1).alias("target"), F.regexp_extract(t, r"\|([^\]]+)\]\]", 1).alias("display")))
    links = rows.where(F.col("value").isNotNull()).select("path", "key", "pos", "value", F.explode(F.when(F.size(tokens) > 0, parsed).otherwise(whole)).alias("l")).select("path", "key", "pos", "value", "l.*").where("target <> ''")
    out = []
    mode = block.get("resolve")
    if mode:
        lookup = F.lower(F.when(F.contains("target", F.lit("/")), C.directory(F.col("target"))).otherwise("")) if mode == "parent_exists" else F.lower("target")
        lost = links.withColumn("k", lookup)
        if mode == "parent_exists":
            lost = lost.where("k <> ''")
        lost = lost.join(resolve_index(paths, mode), "k", "left_anti")
        if worktree is not None:
            bare = F.regexp_replace(F.substring_index("target", "#", 1), r"\.md$", "")
            lost = lost.withColumn("w", F.lower(bare)).join(worktree.select(F.lower(C.no_ext(F.col("path"))).alias("w")).distinct(), "w", "left_anti")
        out.append(_stream(lost, 1, F.lit(f"{mode}: target not found"), Target=F.col("target")))
    if block.get("fresh") == "git" and times is not None:
        t = times.groupBy("path").agg(F.max("ts").alias("ts"))
        named = links.withColumn("tp", F.concat(C.no_ext(F.substring_index("target", "#", 1)), F.lit(".md")))
        aged = named.join(t.select("path", F.col("ts").alias("own")), "path").join(t.select(F.col("path").alias("tp"), F.col("ts").alias("theirs")), "tp").where("theirs > own AND own <> 0 AND theirs <> 0")
        out.append(_stream(aged, 1, F.lit("target is newer than the page"), Target=F.col("target")))
    templates = (block.get("link_display") or {}).get("templates") or []
    if templates:
        expected = F.lit(None).cast("string")
        for t in reversed(templates):
            expected = F.when(F.col("target").rlike(glob_regex(t["when"])), column(t["format"], F.create_map(F.lit("Target"), F.col("target")))).otherwise(expected)
        shown = links.withColumn("expected", expected).withColumn("display", F.coalesce("display", F.lit("")))
        shown = shown.where(F.col("expected").isNotNull() & (F.col("expected") != F.col("display")))
        message = F.when(F.col("display") != "", F.concat("key", F.lit(": [["), "target", F.lit("|"), "display", F.lit("]] display should be "), "expected")).otherwise(F.concat("key", F.lit(": [["), "target", F.lit("]] should have display "), "expected"))
        out.append(shown.select("path", F.col("pos").alias("seq"), F.lit(1).alias("line"), _data(Key=F.col("key"), Target=F.col("target"), Display=F.col("display"), Expected=F.col("expected"), Message=message)))
    return reduce(DataFrame.unionByName, out) if out else links.limit(0).select("path", F.col("pos").alias("seq"), F.lit(0).alias("line"), _data(Key=F.col("key")))
