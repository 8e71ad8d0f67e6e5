"""The checks: each a plan from documents and facts to rows (path, seq, line, data).

A check is registered by name with its phase: 1 reads the document alone, 2 other documents or the
outside world, which comes as tables in the context.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions import columns as C
from quillmere.functions import markdown as M
from quillmere.functions.globs import java_regex
from quillmere.operators import graph, links, pins, property_blocks, reports
from quillmere.operators.facts import Facts

#: Fixed value: bytes of an output that a finding keeps.
MESSAGE_TAIL = 4 << 10
RAW = "path string, seq int, line int, data map<string,string>"


@dataclass
class Context:
    """What checks may look at: a corpus and, as tables, the world outside it."""

    documents: DataFrame
    facts: Facts
    paths: DataFrame
    world: pins.World | None = None
    worktree: DataFrame | None = None
    times: DataFrame | None = None
    probe_results: DataFrame | None = None
    run_records: DataFrame | None = None
    warnings: list[tuple[str, str]] = field(default_factory=list)


Check = Callable[[DataFrame, dict, Context], DataFrame]
CHECKS: dict[str, tuple[Check, int]] = {}


def check(name: str, phase: int = 1) -> Callable[[Check], Check]:
    def add(f: Check) -> Check:
        CHECKS[name] = (f, phase)
        return f

    return add


def _rows(df: DataFrame, line: Column, seq: Column | None = None, **data: Column) -> DataFrame:
    seq = F.lit(0) if seq is None else seq
    pairs = [x for k, v in data.items() for x in (F.lit(k), v.cast("string"))]
    return df.select("path", seq.cast("int").alias("seq"), line.cast("int").alias("line"), F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("data"))


def _list(value: object) -> list[str]:
    """A parameter that may be one string or a list of them."""
    return [value] if isinstance(value, str) else [v for v in value if isinstance(v, str)] if isinstance(value, list) else []


def _own(table: DataFrame, docs: DataFrame) -> DataFrame:
    return table.join(docs.select("path"), "path", "left_semi")


def _scan(docs: DataFrame, columns: list[str], find: Callable[..., list[dict]]) -> DataFrame:
    """Findings of a grammar that isn't relational: ``find`` gives a page's (line, data) in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(row[0], i, f.pop("line"), {k: str(v) for k, v in f.items()}) for row in frame.itertuples(index=False) for i, f in enumerate(find(*[x if x is not None else "" for x in row[1:]]))]
            yield pd.DataFrame(out, columns=["path", "seq", "line", "data"])

    return docs.select("path", *columns).mapInPandas(run, RAW)


@check("field-exists")
def field_exists(docs, params, ctx):
    required = _list(params.get("frontmatter"))
    absent = docs.select("path", F.posexplode(F.array_except(F.array(*map(F.lit, required)).cast("array<string>"), F.coalesce("fm_keys", F.array().cast("array<string>")))).alias("pos", "field"))
    return _rows(absent, F.lit(1), F.col("pos"), Field=F.col("field"))


@check("tag-format")
def tag_format(docs, params, ctx):
    tags = docs.select("path", F.posexplode("tags").alias("pos", "tag"))
    return _rows(reports.bad_tags(tags, _list(params.get("prefixes"))), F.lit(1), F.col("pos"), Tag=F.col("tag"), Prefix=F.col("prefix"))


@check("pattern")
def pattern(docs, params, ctx):
    name = C.base(F.col("path"))
    try:
        regex = java_regex(str(params.get("match", "")))
    except ValueError as e:
        return _rows(docs, F.lit(0), Filename=name, Match=F.lit(f"invalid regex: {e}"))
    if params.get("target") == "filename":
        return _rows(docs.where(~name.rlike(regex)), F.lit(0), Filename=name)
    found = docs.select("path", F.posexplode(F.split("content", "\n", -1)).alias("at", "text")).where(F.col("text").rlike(regex))
    return _rows(found, F.col("at") + 1, F.col("at"), Filename=name, Match=C.mask(F.regexp_extract("text", regex, 0)))


@check("backticked-wikilink")
def backticked_wikilink(docs, params, ctx):
    return _scan(docs.where(F.contains("body", F.lit("`")) & F.contains("body", F.lit("[["))), ["body", "body_offset"], lambda b, o: [{"line": f["line"], "Match": f["match"], "Line": f["text"]} for f in M.quoted_links(b, o)])


@check("link-resolve", phase=2)
def link_resolve(docs, params, ctx):
    rows = property_blocks.values(docs, _list(params.get("frontmatter")))
    found = rows.select("path", "key", "pos", F.explode(F.regexp_extract_all("value", F.lit(r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"), F.lit(1))).alias("target")).withColumn("target", F.trim("target")).withColumn("k", F.lower("target"))
    roots = _list(params.get("roots")) or None
    lost = found.join(links.glob_index(ctx.paths, roots).withColumnRenamed("key", "k"), "k", "left_anti")
    return _rows(lost, F.lit(1), F.col("pos"), Field=F.col("key"), Target=F.col("target"))


@check("heading-structure")
def heading_structure(docs, params, ctx):
    found = reports.heading_jumps(_own(ctx.facts.headings, docs), "path", "line", bool(params.get("allow_multiple_h1", False)))
    skipped = F.col("issue") == "skipped level"
    issue = F.when(skipped, F.concat(F.lit("skipped level: expected H"), F.col("expected").cast("string"), F.lit(", got H"), F.col("level").cast("string"))).otherwise(F.col("issue"))
    return _rows(found, F.col("line"), skipped.cast("int"), Level=F.col("level"), Issue=issue, Expected=F.when(skipped, F.col("expected")))


def _dated(docs: DataFrame, name: str) -> DataFrame:
    kind, value = C.path_date(F.col("path"))
    raw = F.try_element_at(F.from_json("fm", "map<string,string>"), F.lit(name))
    readable = F.try_element_at("fm_kinds", F.lit(name)).isin("string", "date")
    return docs.select("path", kind.alias("kind"), value.alias("path_date"), F.when(readable, C.parse_date(raw)).alias("ts")).where(F.col("kind").isNotNull())


@check("partition-date-consistency")
def partition_date_consistency(docs, params, ctx):
    name = params.get("date_field", "created")
    rows = _dated(docs, name).withColumn("field_date", C.date_at(F.col("ts"), F.col("kind"))).where(F.col("ts").isNull() | (F.col("path_date") != F.col("field_date")))
    absent = F.col("ts").isNull()
    what = F.when(F.col("kind") == "daily", "date").when(F.col("kind") == "weekly", "week").otherwise("month")
    return _rows(rows, F.lit(1), Missing=F.when(absent, F.lit(name)), Reason=F.when(absent, F.lit(f'frontmatter field "{name}" not found')), Mismatch=F.when(~absent, what), PathDate=F.when(~absent, F.col("path_date")), FmDate=F.when(~absent, F.col("field_date")))


@check("partition-rollup")
def partition_rollup(docs, params, ctx):
    """Without ``reference_time`` the present is asked once, when the plan is made."""
    import datetime

    now = str(params.get("reference_time") or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S"))
    daily, weekly = int(params.get("daily_max_days", 7)), int(params.get("weekly_max_days", 30))
    age = C.age_days(C.parse_date(F.lit(now)), F.col("ts"))
    rows = _dated(docs, params.get("date_field", "created")).where(F.col("ts").isNotNull()).withColumn("age", age)
    rows = rows.where(((F.col("kind") == "daily") & (F.col("age") > daily)) | ((F.col("kind") == "weekly") & (F.col("age") > weekly)))
    suggested = F.when((F.col("kind") == "weekly") | (F.col("age") > weekly), "monthly").otherwise("weekly or monthly")
    return _rows(rows, F.lit(0), Age=F.concat(F.col("age").cast("string"), F.lit(" days")), Current=F.col("kind"), Suggested=suggested)


@check("property", phase=2)
def property_check(docs, params, ctx):
    keys = params["property"]
    out = [property_blocks.missing(docs, keys).select("path", F.col("seq").cast("int").alias("seq"), "line", "data")] if params.get("required") else []
    values = property_blocks.values(docs, keys)
    out += [find(values, params[name], ctx) for name, find in property_blocks.REGISTRY.items() if params.get(name)]
    return reduce(DataFrame.unionByName, [o.select("path", F.col("seq").cast("int").alias("seq"), F.col("line").cast("int").alias("line"), "data") for o in out]) if out else _rows(docs.limit(0), F.lit(0), Key=F.lit(""))


def _links(docs: DataFrame, ctx: Context) -> DataFrame:
    return _own(ctx.facts.links, docs)


@check("broken-wikilink", phase=2)
def broken_wikilink(docs, params, ctx):
    scope = _list(params["scope"]) if params.get("scope") else None
    found = links.broken(_links(docs, ctx), ctx.paths, _list(params.get("roots")) or None, scope, _list(params.get("skip-prefixes")))
    return _rows(found, F.col("line"), F.col("pos"), Target=F.col("target"), Type=F.col("type"))


@check("ambiguous-wikilink", phase=2)
def ambiguous_wikilink(docs, params, ctx):
    found = links.ambiguous(_links(docs, ctx), ctx.paths, _list(params.get("roots")) or None, _list(params.get("skip-prefixes")))
    return _rows(found, F.col("line"), F.col("pos"), Target=F.col("target"), Count=F.col("n"), Paths=F.array_join("paths", ", "))


@check("wikilink-canonicalize", phase=2)
def wikilink_canonicalize(docs, params, ctx):
    roots = params.get("roots")
    universe = links.universe(ctx.paths, roots if isinstance(roots, list) else [] if roots else None)
    kept = _links(docs, ctx)
    for p in _list(params.get("skip-prefixes")):
        kept = kept.where(~F.startswith(F.lower("target"), F.lit(p.lower())))
    return _rows(links.noncanonical(kept, universe), F.col("line"), F.col("pos"), Target=F.col("target"), Canonical=F.col("canonical"))


@check("table-wikilink-pipe")
def table_wikilink_pipe(docs, params, ctx):
    found = lambda b, o: [{"line": f["line"], "Expected": f["expected"], "Actual": f["actual"], "Wikilinks": f["links"]} for f in M.table_pipes(b, o)]
    return _scan(docs.where(F.contains("body", F.lit("|")) & F.contains("body", F.lit("[["))), ["body", "body_offset"], found)


def _pins(docs: DataFrame, ctx: Context) -> DataFrame:
    return _own(ctx.facts.pins, docs)


def _pin_check(find: Callable) -> Check:
    def run(docs, params, ctx):
        if ctx.world is None:
            return _rows(docs.limit(0), F.lit(1), Reason=F.lit(""))
        found = find(_pins(docs, ctx), ctx.world, str(params.get("owned-repo") or ""), params.get("absent-repo") == "report")
        return found.select("path", F.lit(0).alias("seq"), "line", "data")

    return run


for _name, _find in (("effect-pin-resolves", pins.resolves), ("effect-pin-on-origin", pins.on_origin), ("effect-checksum-reproduces", pins.checksum_reproduces), ("effect-pin-stale", pins.stale)):
    check(_name, phase=2)(_pin_check(_find))


def _effects(docs: DataFrame) -> DataFrame:
    status = F.coalesce(F.try_element_at(F.from_json("fm", "map<string,string>"), F.lit("status")), F.lit(""))
    return docs.where(F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), "type/effect") & ~status.isin("retired", "pending"))


@check("effect-unpinned")
def effect_unpinned(docs, params, ctx):
    effects = _effects(docs).select("path").join(ctx.facts.pins.drop("tags"), "path", "left").withColumn("status", F.lit(""))
    for flag in ("has_fm_commit", "has_inputs", "has_receipt_key", "receipt_null", "receipt_block"):
        effects = effects.withColumn(flag, F.coalesce(flag, F.lit(False)))
    return pins.unpinned(effects, str(params.get("owned-repo") or "")).select("path", F.lit(0).alias("seq"), "line", "data")


@check("effect-rootless")
def effect_rootless(docs, params, ctx):
    """Effect pages whose 'inputs' is no pointer to a block of their own with an item."""
    raw = F.try_element_at(F.from_json("fm", "map<string,string>"), F.lit("inputs"))
    kind = F.try_element_at("fm_kinds", F.lit("inputs"))
    pages = _effects(docs).select("path", raw.alias("raw"), kind.alias("kind"), F.regexp_extract(F.trim(raw), r"^\[\[#\^([A-Za-z0-9-]+)(?:\|[^\]]*)?\]\]$", 1).alias("id"))
    body = F.when(F.col("fence"), F.col("code")).otherwise(F.col("text"))
    blocks = ctx.facts.blocks.where("n_declared = 1").select("path", "id", F.size(F.filter(F.split(body, "\n", -1), lambda t: t.rlike(r"^-(\s|$)"))).alias("items"))
    reason = F.when(F.col("kind").isNull(), "no-inputs").when(F.col("kind") != "string", "inputs-not-a-pointer").when(F.col("id") == "", "inputs-not-a-block-ref").when(F.col("items").isNull(), "inputs-dangling").when(F.col("items") == 0, "inputs-empty")
    found = pages.join(blocks, ["path", "id"], "left").withColumn("reason", reason).where(F.col("reason").isNotNull())
    return _rows(found, F.lit(1), Reason=F.col("reason"))


@check("body-value-echo")
def body_value_echo(docs, params, ctx):
    fields = _list(params.get("fields", ["commit", "checksum"]))
    if not fields:
        return _rows(docs, F.lit(1), Reason=F.lit("misconfigured rule: `fields` must be a non-empty list of frontmatter field names"))
    needles = property_blocks.values(docs, fields).select("path", F.lower(F.trim("value")).alias("v")).where(F.col("v").rlike("^[0-9a-f]{7,}$")).groupBy("path").agg(F.collect_set("v").alias("vs"))
    lines = docs.select("path", "body_offset", F.posexplode(F.split("body", "\n", -1)).alias("at", "text")).join(needles, "path")
    hexed = r"(?<![0-9A-Za-z_])[0-9a-fA-F]{7,}(?![0-9A-Za-z_])"
    tokens = lines.select("path", "vs", (F.col("body_offset") + F.col("at")).alias("line"), F.posexplode(F.regexp_extract_all("text", F.lit(hexed), F.lit(0))).alias("pos", "t"))
    found = tokens.where(F.exists("vs", lambda v: C.hex_echoes(v, F.lower("t"))))
    return _rows(found, F.col("line"), F.col("pos"), Reason=F.concat(F.lit('body echoes pin value "'), "t", F.lit('"')))


@check("repo-cataloged", phase=2)
def repo_cataloged(docs, params, ctx):
    owned = str(params.get("owned-repo") or "")
    uses = _pins(_effects(docs), ctx).select("path", "repo").where(F.col("repo") != owned)
    catalog = ctx.facts.wide.where(F.col("is_repo") & (F.col("repo_name") != "")).select(F.col("repo_name").alias("repo"), "path")
    return _rows(reports.uncataloged(uses, catalog), F.lit(1), Repo=F.col("repo"), Reason=F.concat(F.lit("repo "), "repo", F.lit(" has no catalog page")))


@check("chain-fresh", phase=2)
def chain_fresh(docs, params, ctx):
    effects = docs.where(F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), "type/effect")).select("path")
    if params.get("class") == "acyclic":
        found = graph.chain_cycles(ctx.facts, ctx.paths).join(effects, "path", "left_semi")
        return _rows(found, F.col("line"), Cause=F.lit("cycle"), Ref=F.col("cycle"), Reason=F.concat(F.lit("effect chain cycle: "), "cycle"))
    found = graph.chain_states(ctx.facts, ctx.paths, str(params.get("owned-repo") or "")).join(effects, "path", "left_semi")
    return _rows(found, F.greatest("line", F.lit(1)), F.col("pos"), Cause=F.col("cause"), Ref=F.col("ref"), Reason=F.concat("cause", F.lit(": "), "ref", F.lit(" — "), "detail"))


@check("probe", phase=2)
def probe(docs, params, ctx):
    """Failed probes, from a table of results (path, probe, exit, timed_out, detail); code in pages is never run."""
    if ctx.probe_results is None:
        return _rows(docs.limit(0), F.lit(0), Probe=F.lit(""))
    failed = _own(ctx.probe_results, docs).where(F.coalesce("timed_out", F.lit(False)) | (F.coalesce("exit", F.lit(1)) != 0))
    return _rows(failed, F.lit(0), Probe=F.col("probe"), Detail=C.tail(F.coalesce("detail", F.lit("")), MESSAGE_TAIL))


@check("stale-run-record")
def stale_run_record(docs, params, ctx):
    """Tasks whose record is missing or of other code; records: (path, task, block_sha) of the page they belong to."""
    if ctx.run_records is None:
        return _rows(docs.limit(0), F.lit(0), Task=F.lit(""))
    task = r"^md-(?!.*-(?:args|env|params)$)(.+)$"
    tasks = docs.select("path", F.explode("fm_keys").alias("key"), F.col("fm")).where(F.col("key").rlike(task))
    value = F.try_element_at(F.from_json("fm", "map<string,string>"), F.col("key"))
    tasks = tasks.select("path", F.regexp_extract("key", task, 1).alias("task"), F.regexp_extract(value, r"#\^([A-Za-z0-9-]+)", 1).alias("id")).where("id <> ''")
    code = ctx.facts.blocks.where("fence AND n_declared = 1").select("path", "id", C.blob_sha(F.col("code")).alias("sha"))
    records = ctx.run_records.select("path", "task", "block_sha")
    joined = tasks.join(records.select("path").distinct(), "path", "left_semi").join(code, ["path", "id"], "left").join(records, ["path", "task"], "left")
    issue = F.when(F.col("block_sha").isNull(), "no record").when(~F.col("block_sha").eqNullSafe(F.col("sha")), "stale record")
    found = joined.withColumn("issue", issue).where(F.col("issue").isNotNull())
    return _rows(found, F.lit(0), Task=F.col("task"), Issue=F.col("issue"))


@check("tier-downgrade")
def tier_downgrade(docs, params, ctx):
    """Pages of a lower tier than what they draw from; unknown tiers of the config on every page, of a page on it."""
    config = {k.lower(): str(v).strip().lower() for k, v in (params.get("wiki-tiers") or {}).items() if isinstance(v, str)}
    known = {k: v for k, v in config.items() if v in C.TIERS}
    names = ", ".join(C.TIERS)
    out = [_rows(docs, F.lit(0), F.lit(i), PageTier=F.lit("(config)"), SourceTier=F.lit(v), Source=F.lit(k), Field=F.lit(f'wiki-tiers: "{k}" has unrecognized tier "{v}" ({names})')) for i, (k, v) in enumerate(config.items()) if v not in C.TIERS]
    fm = F.from_json("fm", "map<string,string>")
    stated = F.when(F.try_element_at("fm_kinds", F.lit("confidential")) == "string", F.try_element_at(fm, F.lit("confidential")))
    pages = docs.select("path", F.when(stated != "", stated).alias("stated"), F.try_element_at("fm_kinds", F.lit("foreign-touched")).alias("kind"), F.try_element_at(fm, F.lit("foreign-touched")).alias("raw"))
    odd = pages.where(F.col("stated").isNotNull() & (C.tier_level(F.col("stated")) < 0))
    out.append(_rows(odd, F.lit(1), F.lit(100), PageTier=F.lit("(unrecognized)"), SourceTier=F.col("stated"), Source=F.lit("field confidential"), Field=F.concat(F.lit('"'), "stated", F.lit(f'" is not a recognized tier ({names})'))))
    if known:
        touched = F.when(F.col("kind") == "list", F.from_json("raw", "array<string>")).when(F.col("kind") == "string", F.array("raw"))
        tiers = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.lit(v))])
        own = F.when(C.tier_level(F.col("stated")) >= 0, F.lower(F.trim("stated"))).otherwise(F.lit(str(params.get("target-tier") or "").strip().lower()))
        rows = pages.select("path", own.alias("own"), F.posexplode(touched).alias("pos", "source")).withColumn("source", F.trim("source")).withColumn("tier", F.try_element_at(tiers, F.lower("source"))).where(F.col("tier").isNotNull())
        best = rows.groupBy("path", "own").agg(F.max_by(F.struct("source", "tier"), F.struct(C.tier_level(F.col("tier")), -F.col("pos"))).alias("b")).select("path", "own", "b.*")
        low = best.where((C.tier_level(F.col("own")) >= 0) & (C.tier_level(F.col("tier")) > C.tier_level(F.col("own"))))
        out.append(_rows(low, F.lit(1), F.lit(200), PageTier=F.col("own"), SourceTier=F.col("tier"), Source=F.col("source"), Field=F.lit("foreign-touched")))
    return reduce(DataFrame.unionByName, out)


@check("wiki-navlink")
def wiki_navlink(docs, params, ctx):
    mapped = set((params.get("mapping") or {}).keys())
    return _scan(docs.where(F.contains("body", F.lit("wiki://"))), ["body", "body_offset"], lambda b, o: [{"line": f["line"], "URI": f["uri"], "Kind": f["kind"]} for f in M.bare_uris(b, o, mapped)])
