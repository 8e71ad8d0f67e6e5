"""Operators fed with worlds that the test tables don't hold, derived from those they do; SQL states the same.

Pins, caches, run records, hooks and fact tables are made by arithmetic on keys, then handed to the
operator of the library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions import columns as C
from quillmere.operators import cache, graph, pins, reports, rewrites
from quillmere.operators.checks import CHECKS, Context
from quillmere.operators.facts import Facts, extract
from quillmere.plans.relational import _BASE, _PAGES, _PATHS, corpus_of, page_paths, pages, query
from quillmere.sources import corpus
from quillmere.session import table
from quillmere.streaming import watch


def _run(name: str, docs: DataFrame, params: dict, facts: Facts | None = None, paths: DataFrame | None = None, **outside) -> DataFrame:
    """Rows (path, seq, line, data) of a check."""
    return CHECKS[name][0](docs, params, Context(docs, facts, paths, **outside))


def _text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# Checks.


@query(f"WITH {_PAGES} SELECT path, f AS field FROM pages, unnest(['title', 'tags', 'body', 'lint_ignore']) AS u(f) WHERE path IS NOT NULL AND CASE f WHEN 'title' THEN title IS NULL WHEN 'tags' THEN tags IS NULL WHEN 'body' THEN body IS NULL ELSE lint_ignore IS NULL END")
def field_exists_missing(spark, d):
    """Required fields that a page lacks."""
    required = ["title", "tags", "body", "lint_ignore"]
    docs = pages(spark, d).where("path IS NOT NULL").select("path", F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in required])).alias("fm_keys"))
    return _run("field-exists", docs, {"frontmatter": required}).select("path", F.col("data")["Field"].alias("field"))


@query(f"WITH {_PAGES} SELECT path, {_BASE.format('path')} AS filename FROM pages WHERE NOT regexp_matches({_BASE.format('path')}, '^[a-z0-9-]+\\.md$')")
def pattern_filename(spark, d):
    """File names that don't match a pattern."""
    docs = pages(spark, d).where("path IS NOT NULL").select("path", F.col("body").alias("content"))
    return _run("pattern", docs, {"target": "filename", "match": r"^[a-z0-9-]+\.md$"}).select("path", F.col("data")["Filename"].alias("filename"))


@query("SELECT CAST(doc_id AS VARCHAR) AS path, CAST(line AS INTEGER) AS line, CASE WHEN strlen(m) > 8 THEN left(m, 8) || '…' ELSE m END AS found FROM (SELECT doc_id, i AS line, regexp_extract(l[i], '[0-9a-f]{10,}') AS m FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(generate_series(1, len(l))) AS s(i)) WHERE m <> ''")
def pattern_content_masked(spark, d):
    """Lines that match a content pattern, with the match masked."""
    docs = table(spark, d, "documents").select(_text("doc_id").alias("path"), F.col("text").alias("content"))
    return _run("pattern", docs, {"target": "content", "match": "[0-9a-f]{10,}"}).select("path", "line", F.col("data")["Match"].alias("found"))


_TIER = "CASE {0} % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'confidential' ELSE 'secret' END"


@query(
    f"""WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS path, CASE WHEN c_custkey % 9 = 0 THEN 'hidden' ELSE {_TIER.format('c_nationkey')} END AS stated, CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE c_nationkey % 4 END AS own, c_custkey, c_nationkey FROM customer),
touched AS (SELECT path, own, pos, (c_nationkey * (pos + 3) + c_custkey) % 25 AS src FROM c, unnest([0, 1, 2]) AS u(pos)),
best AS (SELECT path, own, src, src % 4 AS level FROM touched WHERE src < 24 QUALIFY row_number() OVER (PARTITION BY path ORDER BY src % 4 DESC, pos) = 1)
SELECT path, '(config)' AS page_tier, 'odd' AS source_tier, 'w24' AS source FROM c
UNION ALL SELECT path, '(unrecognized)', 'hidden', 'field confidential' FROM c WHERE stated = 'hidden'
UNION ALL SELECT path, {_TIER.format('own')}, {_TIER.format('src')}, 'w' || src FROM best WHERE level > own"""
)
def tier_downgrade(spark, d):
    """Pages of a tier below the highest they draw from; of equal ones the first counts; unknown tiers."""
    tier = lambda k: F.element_at(F.array(*map(F.lit, C.TIERS)), (k % 4 + 1).cast("int"))
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    sources = F.array(*[F.concat(F.lit("w"), _text((nation * (pos + 3) + key) % 25)) for pos in (0, 1, 2)])
    fm = F.to_json(F.struct(F.when(key % 9 == 0, "hidden").otherwise(tier(nation)).alias("confidential"), sources.alias("foreign-touched")))
    kinds = F.create_map(F.lit("confidential"), F.lit("string"), F.lit("foreign-touched"), F.lit("list"))
    docs = table(spark, d, "customer").select(_text(key).alias("path"), fm.alias("fm"), kinds.alias("fm_kinds"))
    config = {f"w{i}": C.TIERS[i % 4] for i in range(24)} | {"w24": "odd"}
    found = _run("tier-downgrade", docs, {"wiki-tiers": config, "target-tier": "public"})
    return found.select("path", F.col("data")["PageTier"].alias("page_tier"), F.col("data")["SourceTier"].alias("source_tier"), F.col("data")["Source"].alias("source"))


@query(
    """WITH n AS (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY l_orderkey),
t AS (SELECT o_orderkey, u.task, coalesce(lines, 0) AS lines FROM orders LEFT JOIN n ON l_orderkey = o_orderkey, unnest(['build', 'test']) AS u(task))
SELECT CAST(o_orderkey AS VARCHAR) AS path, task, CASE WHEN task = 'test' AND lines <= 4 THEN 'no record' ELSE 'stale record' END AS issue FROM t
WHERE lines > 2 AND (task = 'test' AND lines <= 4 OR lines <> o_orderkey % 7)"""
)
def stale_records(spark, d):
    """Tasks whose run record is missing or of other code."""
    fm = F.lit('{"md-build": "[[#^run]]", "md-test": "[[#^run]]", "md-build-args": "a"}')
    key = F.col("o_orderkey")
    code = lambda n: F.concat(F.lit("echo "), _text(n))
    block = F.struct(F.lit("run").alias("id"), F.lit(True).alias("fence"), F.lit("sh").alias("lang"), code(key % 7).alias("code"), F.lit("").alias("text"), F.lit(1).alias("n_declared"))
    docs = table(spark, d, "orders").select(_text(key).alias("path"), fm.alias("fm"), F.array(F.lit("md-build"), F.lit("md-test"), F.lit("md-build-args")).alias("fm_keys"), F.array(block).alias("blocks"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    tasks = F.array_compact(F.array(F.when(F.col("n") > 2, F.lit("build")), F.when(F.col("n") > 4, F.lit("test"))))
    records = lines.select(_text("l_orderkey").alias("path"), F.explode(tasks).alias("task"), C.blob_sha(code(F.col("n"))).alias("block_sha"))
    found = _run("stale-run-record", docs, {}, Facts(docs), run_records=records)
    return found.select("path", F.col("data")["Task"].alias("task"), F.col("data")["Issue"].alias("issue"))


# Pins.

_PIN_SQL = """
pinned AS (SELECT o_orderkey AS o, 'p' || o_orderkey AS path, 'r' || (o_orderkey % 4) AS repo, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 'main' END AS stated, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'c' || (o_orderkey % 5) END AS commit, o_orderkey % 3 = 0 AS has_inputs FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
shaped AS (SELECT *, CASE WHEN commit <> '' AND has_inputs THEN 'transitional' WHEN commit <> '' THEN 'legacy' WHEN has_inputs THEN 'receipt' ELSE 'none' END AS shape FROM pinned),
pins AS (SELECT *, CASE WHEN stated = '' AND shape = 'receipt' AND repo IN ('r0', 'r1') THEN 'main' ELSE stated END AS branch, repo = 'r2' AS owned FROM shaped WHERE shape <> 'none'),
usable AS (SELECT * FROM pins WHERE NOT (shape <> 'receipt' AND branch = '') AND repo <> 'r3' AND (owned OR commit <> '')),
places AS (SELECT u.*, l_partkey AS part, 's' || (l_partkey % 40) AS want FROM usable u JOIN lineitem ON l_orderkey = o)
"""


def _world(spark, d) -> tuple[DataFrame, pins.World]:
    """A pin for each order with its lines as locations, and objects in four repositories: r2 owned, r3 absent; c3 is a tag, c4 missing."""
    o = F.col("o_orderkey")
    parts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    commit = F.when(o % 17 == 0, "").otherwise(F.concat(F.lit("c"), _text(o % 5)))
    false = F.lit(False)
    rows = table(spark, d, "orders").select("o_orderkey").join(parts, "o_orderkey").select(
        F.concat(F.lit("p"), _text(o)).alias("path"), F.concat(F.lit("r"), _text(o % 4)).alias("repo"), F.when(o % 10 == 0, "").otherwise("main").alias("branch"), commit.alias("commit"),
        F.transform("l", lambda x: x["l_partkey"].cast("string")).alias("locations"), F.transform("l", lambda x: F.concat(F.lit("s"), (x["l_partkey"] % 40).cast("string"))).alias("checksums"),
        (commit != "").alias("has_fm_commit"), (o % 3 == 0).alias("has_inputs"), false.alias("has_receipt_key"), false.alias("receipt_null"), F.lit("").alias("receipt_ref"), false.alias("receipt_block"),
    )
    repo = F.explode(F.array(*map(F.lit, ("r0", "r1", "r2")))).alias("repo")
    p = table(spark, d, "part").select("p_partkey", "p_size", repo)
    k, named = F.col("p_partkey"), lambda at: F.concat(at, F.lit(":"), _text("p_partkey"))
    at_commits = p.where(k % 50 != 0).select("repo", "p_partkey", "p_size", F.explode(F.array(*map(F.lit, ("c0", "c1", "c2")))).alias("c")).select("repo", named(F.col("c")).alias("name"), F.concat(F.lit("s"), _text("p_size")).alias("oid"), F.lit("blob").alias("type"))
    at_origin = p.where(k % 40 != 0).select("repo", named(F.lit("origin/main")).alias("name"), F.concat(F.lit("s"), _text(F.col("p_size") + k % 2)).alias("oid"), F.lit("blob").alias("type"))
    heads = [(r, n, oid, kind) for r in ("r0", "r1", "r2") for n, oid, kind in (("c0", "c0", "commit"), ("c1", "c1", "commit"), ("c2", "c2", "commit"), ("c3", "t3", "tag"), ("origin/main", "c1", "commit"))]
    objects = spark.createDataFrame(heads, "repo string, name string, oid string, type string").unionByName(at_commits).unionByName(at_origin)
    ancestry = spark.createDataFrame([(r, c, "origin/main") for r in ("r0", "r1", "r2") for c in ("c0", "c1")], "repo string, commit string, ref string")
    branches = spark.createDataFrame([("r0", "main"), ("r1", "main")], "repo string, branch string")
    present = spark.createDataFrame([("r0", False, False), ("r1", False, False), ("r2", True, False)], "repo string, owned boolean, batch_failed boolean")
    worktree = table(spark, d, "part").where(k % 30 != 0).select(F.lit("r2").alias("repo"), _text(k).alias("path"))
    return rows, pins.World(objects, ancestry, branches, present, worktree)


def _reasons(found: DataFrame) -> DataFrame:
    return found.select("path", F.col("data")["Reason"].alias("reason"))


@query(
    f"""WITH {_PIN_SQL} SELECT path, 'incomplete pin: missing branch' AS reason FROM pins WHERE shape <> 'receipt' AND branch = ''
UNION ALL SELECT path, 'commit ' || commit || ' does not resolve in ' || repo || CASE commit WHEN 'c3' THEN ' (object type tag)' ELSE ' (missing)' END FROM usable WHERE commit IN ('c3', 'c4')"""
)
def pin_unresolved(spark, d):
    """Malformed pins and commits that are none."""
    return _reasons(pins.resolves(*_world(spark, d)))


@query(
    f"""WITH {_PIN_SQL} SELECT path, CASE WHEN branch = '' THEN 'branch unresolvable for repo ' || repo ELSE 'commit c2 is not on origin/main' END AS reason FROM usable WHERE NOT owned AND commit IN ('c0', 'c1', 'c2') AND (branch = '' OR commit = 'c2')
UNION ALL SELECT path, 'owned location ' || part || ' is missing from the working tree' FROM places WHERE owned AND part % 30 = 0"""
)
def pin_off_origin(spark, d):
    """Commits that the origin's branch doesn't contain, and owned locations that are gone."""
    return _reasons(pins.on_origin(*_world(spark, d)))


@query(
    f"""WITH {_PIN_SQL} SELECT path, CASE WHEN part % 50 = 0 OR p_partkey IS NULL THEN 'location ' || part || ' does not exist at ' || commit ELSE 'checksum mismatch at ' || part || ': pin ' || want || ', object s' || p_size END AS reason
FROM places LEFT JOIN part ON p_partkey = part WHERE commit IN ('c0', 'c1', 'c2') AND (part % 50 = 0 OR p_partkey IS NULL OR want <> 's' || p_size)"""
)
def pin_checksum_mismatch(spark, d):
    """Locations that a pinned commit hasn't, or has with another object."""
    return _reasons(pins.checksum_reproduces(*_world(spark, d)))


@query(
    f"""WITH {_PIN_SQL} SELECT path, 'origin/main advanced past pin c0 and ' || part || ' drifted (pin ' || want || ', origin s' || (p_size + p_partkey % 2) || ')' AS reason
FROM places JOIN part ON p_partkey = part WHERE commit = 'c0' AND branch <> '' AND part % 40 <> 0 AND want <> 's' || (p_size + p_partkey % 2)"""
)
def pin_stale(spark, d):
    """Pins that their origin has passed with other content."""
    return _reasons(pins.stale(*_world(spark, d)))


@query(
    """WITH e AS (SELECT CAST(c_custkey AS VARCHAR) AS path, c_custkey AS k, CASE WHEN c_acctbal < 0 AND c_nationkey % 2 = 0 THEN 'transitional' WHEN c_acctbal < 0 THEN 'legacy' WHEN c_nationkey % 2 = 0 THEN 'receipt' ELSE 'none' END AS shape FROM customer WHERE c_custkey % 10 <> 0),
r AS (SELECT path, CASE WHEN shape = 'none' THEN 'no-pin' WHEN shape = 'transitional' THEN 'mid-migration' WHEN shape = 'legacy' THEN NULL WHEN k % 13 = 0 THEN CASE WHEN k % 3 = 0 THEN 'owned-with-receipt' END
  WHEN k % 3 <> 0 THEN 'receipt-absent' WHEN k % 5 = 0 THEN 'born-invalid' WHEN k % 7 = 0 OR k % 4 = 0 OR k % 11 = 0 THEN 'receipt-dangling' END AS reason FROM e) SELECT path, reason FROM r WHERE reason IS NOT NULL"""
)
def unpinned_state(spark, d):
    """Pages without a full pin, by the state they are in."""
    k = F.col("c_custkey")
    effects = table(spark, d, "customer").select(
        _text(k).alias("path"), F.when(k % 10 == 0, "retired").otherwise("live").alias("status"), F.when(k % 13 == 0, "own").otherwise("r").alias("repo"), (F.col("c_acctbal") < 0).alias("has_fm_commit"), (F.col("c_nationkey") % 2 == 0).alias("has_inputs"),
        (k % 3 == 0).alias("has_receipt_key"), (k % 5 == 0).alias("receipt_null"), (k % 7 != 0).alias("receipt_block"), F.when(k % 4 != 0, "c").otherwise("").alias("commit"), F.when(k % 11 != 0, F.array(F.lit("s"))).otherwise(F.array().cast("array<string>")).alias("checksums"),
    )
    return _reasons(pins.unpinned(effects, "own"))


# Facts and graphs.


def _page_facts(spark, d) -> Facts:
    """Fact tables of links, embeds and slices as one wide table."""
    embed = F.struct(F.lit("").alias("original"), F.coalesce("target", F.lit("")).alias("target"), F.coalesce("child_anchor", F.lit("")).alias("fragment"), F.lit(True).alias("is_embed"), F.col("line_no").alias("line"), F.lit(1).alias("col"))
    link = F.struct(F.coalesce("original", F.lit("")).alias("original"), F.coalesce("target", F.lit("")).alias("target"), F.lit("").alias("fragment"), F.lit(False).alias("is_embed"), F.col("line_no").alias("line"), F.lit(1).alias("col"))
    e = table(spark, d, "page_embeds").where("anchor = '' AND line_no IS NOT NULL").select("embed_id", "page_path", "target", "child_anchor", "line_no").distinct().select("page_path", embed.alias("x"))
    n = table(spark, d, "page_links").where("line_no IS NOT NULL").select("link_id", "page_path", "original", "target", "line_no").distinct().select("page_path", link.alias("x"))
    found = e.unionByName(n).groupBy("page_path").agg(F.collect_list("x").alias("links"))
    cut = F.struct("anchor", "kind", "start_line", "end_line", "slice_hash")
    s = table(spark, d, "page_slices").select("page_path", cut.alias("s")).distinct().groupBy("page_path").agg(F.collect_list("s").alias("slices"))
    return Facts(found.join(s, "page_path").withColumnRenamed("page_path", "path"))


_SLICES = "slices AS (SELECT DISTINCT page_path AS path, anchor, kind, start_line, end_line, slice_hash FROM page_slices)"


@query(f"WITH {_SLICES}, embeds AS (SELECT DISTINCT embed_id, page_path AS path, target, child_anchor, line_no FROM page_embeds WHERE anchor = '' AND line_no IS NOT NULL) SELECT path, anchor, count(*) AS n_embeds FROM embeds JOIN slices USING (path) WHERE line_no >= start_line AND line_no < end_line GROUP BY path, anchor")
def embed_buckets(spark, d):
    """Embeds by the slices they stand in."""
    return _page_facts(spark, d).embeds.groupBy("path", "anchor").agg(F.count(F.lit(1)).alias("n_embeds"))


@query(
    f"""WITH {_SLICES}, l AS (SELECT page_path AS path, coalesce(target, '') AS target, line_no FROM page_links WHERE line_no IS NOT NULL UNION ALL SELECT page_path, coalesce(target, ''), line_no FROM page_embeds WHERE anchor = '' AND line_no IS NOT NULL)
SELECT path, anchor, count(DISTINCT target) AS n_targets FROM l JOIN slices USING (path) WHERE target <> '' AND line_no >= start_line AND line_no < end_line GROUP BY path, anchor"""
)
def slice_outlinks(spark, d):
    """Distinct link targets of each slice."""
    return _page_facts(spark, d).outlinks.groupBy("path", "anchor").agg(F.count(F.lit(1)).alias("n_targets"))


@query(
    f"""WITH {_PAGES} SELECT path, coalesce(trim(title, ' ' || chr(9) || chr(160)), '') AS title, list_contains(list_transform(coalesce(tags, []), lambda t: trim(t, ' ' || chr(9) || chr(160))), 'type/repo') AS is_repo,
CAST(len(list_filter(coalesce(tags, []), lambda t: trim(t, ' ' || chr(9) || chr(160)) <> '')) AS INTEGER) AS n_tags FROM pages WHERE path IS NOT NULL"""
)
def title_and_repo(spark, d):
    """Titles, tags and repository facts from the frontmatter of pages."""
    front = F.to_json(F.struct("title", "tags"))
    content = F.concat(F.lit("---\n"), front, F.lit("\n---\n"), F.coalesce("body", F.lit("")))
    raw = pages(spark, d).where("path IS NOT NULL").select("path", F.octet_length(content).cast("long").alias("length"), F.lit(0).cast("long").alias("mtime_ns"), content.alias("content"))
    return Facts(extract(corpus.scan(raw))).wide.select("path", "title", "is_repo", F.size("tags").alias("n_tags"))


@query(
    """WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey // 12 * 12 + (p_partkey + 1) % 12 AS b FROM part WHERE p_partkey % 37 <> 0 AND p_partkey % 41 <> 0),
n AS (SELECT a, b FROM e WHERE b IN (SELECT p_partkey FROM part WHERE p_partkey % 41 <> 0)),
r AS (SELECT a AS start, b AS here, 'wiki/p' || a || '.md → wiki/p' || b || '.md' AS way, 1 AS k FROM n UNION ALL SELECT r.start, n.b, way || ' → wiki/p' || n.b || '.md', k + 1 FROM r JOIN n ON n.a = r.here WHERE r.here <> r.start AND k < 12)
SELECT 'wiki/p' || start || '.md' AS path, CAST(start % 9 AS INTEGER) AS line, way AS cycle FROM r WHERE start = here"""
)
def effect_cycles(spark, d):
    """Effect pages on a cycle of declared inputs, with the cycle as text."""
    k = F.col("p_partkey")
    target = F.concat(F.lit("p"), _text(F.floor(k / 12) * 12 + (k + 1) % 12))
    item = F.struct(target.alias("ref"), target.alias("target"), F.lit("").alias("anchor"), F.lit("").alias("hash"), (k % 9).cast("int").alias("line"))
    none = F.array().cast("array<struct<ref:string,target:string,anchor:string,hash:string,line:int>>")
    tags = F.when(k % 41 != 0, F.array(F.lit("type/effect"))).otherwise(F.array(F.lit("type/page")))
    wide = table(spark, d, "part").select(F.concat(F.lit("wiki/p"), _text(k), F.lit(".md")).alias("path"), tags.alias("tags"), F.lit("").alias("hash_algo"), F.when(k % 37 != 0, F.array(item)).otherwise(none).alias("chain"))
    return graph.chain_cycles(Facts(wide), wide.select("path"))


# Reports, cache and watch.


@query("SELECT 'rule' AS by, rule_id, NULL AS severity, count(*) AS n FROM findings_fresh GROUP BY rule_id UNION ALL SELECT 'severity', NULL, severity, count(*) FROM findings_fresh GROUP BY severity UNION ALL SELECT 'all', NULL, NULL, count(*) FROM findings_fresh")
def finding_counts(spark, d):
    """Counts by rule, by severity and in all."""
    return reports.finding_counts(table(spark, d, "findings_fresh").select("rule_id", "severity"))


@query(f"WITH {_PAGES}, t AS (SELECT page_id, path, unnest(tags) AS tag, 'd' || (page_id % 3) AS domain FROM pages WHERE path IS NOT NULL) SELECT path, tag, domain FROM t WHERE starts_with(tag, 'domain/') AND tag <> 'domain/' || domain")
def tag_mismatch(spark, d):
    """Domain tags that don't fit where pages are moved."""
    p = pages(spark, d).where("path IS NOT NULL")
    moves = p.select("path", F.concat(F.lit("wiki/d"), _text(F.col("page_id") % 3), F.lit("/"), C.base(F.col("path"))).alias("new_path"))
    return rewrites.tag_mismatch(p.select("path", "tags"), moves)


_MOVED = f"""{_PAGES}, links AS (SELECT DISTINCT link_id, page_path, target FROM page_links WHERE target IS NOT NULL),
moves AS (SELECT path, regexp_replace(path, '\\.md$', '') AS old, regexp_replace(regexp_replace(path, '^wiki/', 'wiki/archive/'), '\\.md$', '') AS new FROM pages WHERE path IS NOT NULL AND page_id % 3 = 0),
tails AS (SELECT old, new, lower(array_to_string(list_slice(p, n, len(p)), '/')) AS key FROM (SELECT old, new, string_split(old, '/') AS p FROM moves WHERE lower(old) <> lower(new)), unnest(generate_series(1, len(p))) AS s(n)),
first AS (SELECT key, min(old) AS old, arg_min(new, old) AS new FROM tails GROUP BY key),
hits AS (SELECT link_id, target, CASE WHEN lower(target) = lower(old) THEN new ELSE array_to_string(list_slice(string_split(new, '/'), len(string_split(new, '/')) - len(string_split(target, '/')) + 1, len(string_split(new, '/'))), '/') END AS place FROM links JOIN first ON key = lower(target) WHERE target <> '')"""


@query(f"WITH {_MOVED} SELECT link_id, target, place FROM hits")
def move_targets(spark, d):
    """Links that name moved pages, with the target they get, for a third of all pages moved."""
    p = pages(spark, d).where("path IS NOT NULL AND page_id % 3 = 0")
    moves = p.select("path", F.regexp_replace("path", "^wiki/", "wiki/archive/").alias("new_path"))
    found = table(spark, d, "page_links").select("link_id", "page_path", "target").where("target IS NOT NULL").distinct()
    return rewrites.moved_targets(found, moves).select("link_id", "target", "place")


_SHADOWED = ["git", "sessions", "sources", "inbox", "talks", "archive", "notes", "topics"]


@query(
    f"""WITH {_PATHS}, dirs AS (SELECT DISTINCT array_to_string(list_slice(p, 1, k), '/') AS dir, p[k] AS name, k FROM (SELECT string_split(regexp_replace(path, '^wiki/', ''), '/') AS p FROM paths), unnest(generate_series(1, len(p) - 1)) AS s(k)), n AS (
SELECT name, CAST(count(*) FILTER (k > 1) AS INTEGER) AS n, list_sort(list(dir) FILTER (k > 1)) AS l, count(*) FILTER (k = 1) AS top FROM dirs WHERE name IN ({', '.join(f"'{x}'" for x in _SHADOWED)}) GROUP BY name)
SELECT name, array_to_string(list_slice(l, 1, 3), ', ') || CASE WHEN n > 3 THEN ', +' || (n - 3) || ' more' ELSE '' END AS examples, n FROM n WHERE top > 0 AND n > 0"""
)
def skip_shadow(spark, d):
    """Bare skip entries that hide directories deeper down."""
    return corpus.skip_shadows(page_paths(spark, d).select(F.regexp_replace("path", "^wiki/", "").alias("path")), _SHADOWED)


_CACHED = f"{_PAGES}, docs AS (SELECT page_id, path, octet_length(encode(coalesce(body, ''))) AS length, coalesce(mtime_ns, 0) AS mtime_ns FROM pages WHERE path IS NOT NULL), held AS (SELECT *, page_id % 11 <> 0 AND mtime_ns < 1760000000000000000 OR page_id % 2 = 1 AS holds FROM docs WHERE page_id % 13 <> 0)"


def _cached(spark, d) -> tuple[DataFrame, DataFrame]:
    """A cache that lacks pages, has other sizes and other hashes, and the documents."""
    docs = corpus_of(pages(spark, d), "page_id")
    k = F.col("page_id")
    sha = F.when(k % 2 == 1, F.sha2("content", 256)).otherwise("other")
    held = docs.where(k % 13 != 0).select("path", F.when(k % 11 == 0, F.col("length") + 1).otherwise(F.col("length")).alias("length"), "mtime_ns", sha.alias("content_sha"), F.lit(1760000000000000000).alias("written_ns"))
    return held, docs


@query(f"WITH {_CACHED} SELECT path FROM held WHERE holds")
def cache_hits(spark, d):
    """Cached pages that still hold: size and time alike and older than the cache's writing, or of equal content."""
    return cache.valid(*_cached(spark, d)).select("path")


@query(f"WITH {_CACHED} SELECT count(*) AS documents, count(*) FILTER (path IN (SELECT path FROM held WHERE holds)) AS hits, count(*) FILTER (path NOT IN (SELECT path FROM held WHERE holds)) AS misses, round(count(*) FILTER (path IN (SELECT path FROM held WHERE holds)) / count(*), 9) AS hit_rate FROM docs")
def cache_stats(spark, d):
    """Hits, misses and their share in a run."""
    return cache.stats(*_cached(spark, d))


@query(
    """WITH f AS (SELECT page_path AS path, count(DISTINCT anchor) AS n, max(slice_hash) AS h FROM page_slices GROUP BY page_path),
s AS (SELECT path, CASE WHEN n % 4 = 0 THEN n + 1 ELSE n END AS n, CASE WHEN n % 3 = 0 THEN NULL ELSE h END AS h FROM f WHERE strlen(path) % 19 <> 0 UNION ALL SELECT 'gone/' || path, n, h FROM f WHERE n = 2),
j AS (SELECT coalesce(f.path, s.path) AS path, f.path IS NOT NULL AND s.path IS NOT NULL AS shared, f.n AS fn, s.n AS sn, f.h AS fh, s.h AS sh FROM f FULL JOIN s USING (path))
SELECT path, 'path' AS field FROM j WHERE NOT shared UNION ALL SELECT path, 'n' FROM j WHERE shared AND fn <> sn UNION ALL SELECT path, 'h' FROM j WHERE shared AND fh IS DISTINCT FROM sh"""
)
def fact_divergence(spark, d):
    """Stored against fresh facts, field by field."""
    fresh = table(spark, d, "page_slices").groupBy(F.col("page_path").alias("path")).agg(F.countDistinct("anchor").alias("n"), F.max("slice_hash").alias("h"))
    n = F.col("n")
    stored = fresh.where(F.octet_length("path") % 19 != 0).select("path", F.when(n % 4 == 0, n + 1).otherwise(n).alias("n"), F.when(n % 3 != 0, F.col("h")).alias("h"))
    return cache.divergence(stored.unionByName(fresh.where("n = 2").withColumn("path", F.concat(F.lit("gone/"), "path"))), fresh)


@query("SELECT page_path AS path, count(DISTINCT anchor) AS n FROM page_slices WHERE page_path IN (SELECT path FROM wiki_pages WHERE deleted_at IS NULL) GROUP BY page_path")
def cache_prune(spark, d):
    """Cached entries of pages that still exist."""
    held = table(spark, d, "page_slices").groupBy(F.col("page_path").alias("path")).agg(F.countDistinct("anchor").alias("n"))
    return cache.pruned(held, table(spark, d, "wiki_pages").where("deleted_at IS NULL"))


_CHANGES = "changes AS (SELECT 'w' || (user_id % 5) || '/p' || event_id || CASE WHEN event_id % 7 = 0 THEN '.runs.md' ELSE '.md' END AS path, CASE event_type WHEN 'click' THEN 'modify' WHEN 'view' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'modify' END AS op, ts FROM events)"
_HOOKS = [{"op": "modify", "action": "rebuild"}, {"op": "create", "action": "index", "scope": "w1"}, {"op": "modify", "action": "notify", "scope": "w2/"}, {"op": "delete", "action": "never"}]
_FIRED = f"{_CHANGES}, fired AS (SELECT path, op, action, scope FROM changes JOIN (VALUES ('modify', 'rebuild', '.', ''), ('create', 'index', 'w1', 'w1/'), ('modify', 'notify', 'w2/', 'w2/')) AS h(hop, action, scope, inside) ON hop = op AND starts_with(path, inside))"


def _changes(spark, d) -> DataFrame:
    k, kind = F.col("event_id"), F.col("event_type")
    path = F.concat(F.lit("w"), _text(F.col("user_id") % 5), F.lit("/p"), _text(k), F.when(k % 7 == 0, ".runs.md").otherwise(".md"))
    op = F.when(kind == "click", "modify").when(kind == "view", "create").when(kind == "error", "delete").otherwise("modify")
    return table(spark, d, "events").select(path.alias("path"), op.alias("op"), "ts")


@query(f"WITH {_FIRED} SELECT path, op, action, scope FROM fired")
def hook_dispatch(spark, d):
    """Changes with the hooks that they fire."""
    return watch.dispatch(_changes(spark, d), _HOOKS)


@query(f"WITH {_FIRED} SELECT (SELECT count(*) FROM changes) AS processed, (SELECT max(ts) FROM changes) AS last_at, (SELECT count(*) FROM fired) AS fired")
def event_counters(spark, d):
    """Counters of a watch run."""
    changes = _changes(spark, d)
    return watch.counters(changes, watch.dispatch(changes, _HOOKS))


@query(
    f"""WITH {_CHANGES}, runs AS (SELECT path, ts + INTERVAL 1 HOUR * (CASE WHEN strlen(path) % 2 = 0 THEN 1 ELSE -1 END) AS ended_at FROM changes WHERE op = 'modify')
SELECT c.path, max(c.ts) AS ts FROM changes c LEFT JOIN runs r ON r.path = c.path WHERE op <> 'delete' AND NOT ends_with(c.path, '.runs.md') AND (ended_at IS NULL OR c.ts > ended_at) GROUP BY c.path"""
)
def runs_due(spark, d):
    """Pages whose tasks are to run anew: changed after their last run ended."""
    changes = _changes(spark, d)
    ended = F.col("ts") + F.when(F.octet_length("path") % 2 == 0, F.expr("INTERVAL 1 HOUR")).otherwise(F.expr("INTERVAL -1 HOUR"))
    return watch.due(changes, changes.where("op = 'modify'").select("path", ended.alias("ended_at")))
