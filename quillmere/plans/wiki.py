"""The core operators on the wiki's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.operators import hierarchy as trees
from quillmere.operators.names import last_delivery, page_keys, target_key
from quillmere.operators import copydiff, orphans
from quillmere.operators.orphans import orphan_references, orphan_report, references
from quillmere.operators.skew import hot_keys, salted
from quillmere.session import stage, table

EMBEDS, CHAIN = "embeds", "chain"


FINDING_KEY = ["file_path", "rule_id", "line_no", "col_no"]
FINDING_FIELDS = ["severity", "message"]


def findings_copy(findings: DataFrame) -> DataFrame:
    """The findings that hold in a copy: paths with '/' and without './', the latest state of each, messages without blanks at the ends."""
    path = F.regexp_replace(F.replace("file_path", F.lit("\\"), F.lit("/")), r"^\./", "")
    message = F.trim(F.col("message"), F.lit(" \t\r\n"))
    rows = findings.select(path.alias("file_path"), "rule_id", "line_no", "col_no", "severity", message.alias("message"), "recorded_at")
    return copydiff.latest(rows, FINDING_KEY, FINDING_FIELDS, "recorded_at")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    cache, fresh = (findings_copy(table(spark, d, f"findings_{name}")) for name in ("cache", "fresh"))
    return copydiff.diff(cache, fresh, FINDING_KEY, FINDING_FIELDS, ("cache", "fresh"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    refs = references({"page_links": (table(spark, d, "page_links"), "link_id"), "page_embeds": (table(spark, d, "page_embeds"), "embed_id")})
    return orphan_references(refs, table(spark, d, "wiki_pages"), table(spark, d, "repo_pages"))


def p4_current(spark: SparkSession, d: str) -> DataFrame:
    """Keys that are referred to and no page answers by now, with their references: counts kept up over batches of changes."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    tables = {"page_links": (table(spark, d, "page_links"), "link_id"), "page_embeds": (table(spark, d, "page_embeds"), "embed_id")}
    batches = [orphans.keyed_references(references({name: rows})).select("ref_table", "ref_id", "key").distinct().select("key", one.alias("refs"), zero.alias("existing")) for name, rows in tables.items()]
    named = orphans.named_pages(table(spark, d, "wiki_pages"), table(spark, d, "repo_pages"))
    state = spark.createDataFrame([], orphans.STATE)
    for deltas in [*batches, orphans.existence_deltas(named).select("key", zero.alias("refs"), "existing")]:
        state = orphans.apply_deltas(state, deltas)
    return orphans.current_orphans(state)


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(p4_found(spark, d))


def page_edges(spark: SparkSession, d: str) -> DataFrame:
    """``(hierarchy, child, parent)`` as page ids: an embedding page is parent, a chain's target is parent."""
    pages = table(spark, d, "wiki_pages")
    ids = last_delivery(pages, "page_id", ["path"], "scanned_at")
    uses = table(spark, d, "page_embeds").select(F.lit(EMBEDS).alias("hierarchy"), "page_path", target_key(F.col("target")).alias("key")).unionByName(
        table(spark, d, "chain_edges").select(F.lit(CHAIN).alias("hierarchy"), "page_path", target_key(F.col("target")).alias("key"))
    )
    uses = uses.where(F.col("key").isNotNull() & F.col("page_path").isNotNull()).distinct()
    left, right = salted(uses, page_keys(pages).select("key", F.col("page_id").alias("named")), "key", "page_path", hot_keys(uses, "key"))
    named = left.join(right, ["key", "__salt"]).select("hierarchy", "page_path", "named")
    both = named.join(ids.select(F.col("path").alias("page_path"), F.col("page_id").alias("declaring")), "page_path")
    embeds = F.col("hierarchy") == EMBEDS
    return both.select("hierarchy", F.when(embeds, F.col("named")).otherwise(F.col("declaring")).alias("child"), F.when(embeds, F.col("declaring")).otherwise(F.col("named")).alias("parent"))


def solved_pages(spark: SparkSession, d: str, with_paths: bool = False, fragment_nodes: int = trees.FRAGMENT_NODES) -> DataFrame:
    """Both hierarchies at once; a node is twice the page id, plus one in the chains."""
    code = F.when(F.col("hierarchy") == CHAIN, 1).otherwise(0)
    edges = page_edges(spark, d).select((F.col("child") * 2 + code).alias("child"), (F.col("parent") * 2 + code).alias("parent"))
    return trees.hierarchy(edges, with_paths, fragment_nodes)


def _hierarchy_of(node: str) -> F.Column:
    return F.when(F.pmod(F.col(node), F.lit(2)) == 1, CHAIN).otherwise(EMBEDS)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    solved = stage(solved_pages(spark, d), "solved")
    paths = last_delivery(table(spark, d, "wiki_pages"), "page_id", ["path"], "scanned_at")
    named = solved.select(_hierarchy_of("node").alias("hierarchy"), F.shiftright("node", 1).alias("page_id"), F.shiftright("root", 1).alias("root_id"), "depth", "state")
    named = named.join(paths.withColumnRenamed("path", "node").hint("merge"), "page_id")
    left, right = salted(named, paths.select(F.col("page_id").alias("root_id"), F.col("path").alias("root_node")), "root_id", "page_id", hot_keys(named, "root_id"))
    named = left.join(right.hint("merge"), ["root_id", "__salt"], "left")
    return named.select("hierarchy", "node", F.coalesce("root_node", F.lit("")).alias("root_node"), F.coalesce("depth", F.lit(-1)).cast("int").alias("depth"), "state")


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """Each page's path of page ids from the root, and how many descendants it has."""
    solved = stage(solved_pages(spark, d, with_paths=True), "paths")
    below = trees.descendants(solved).groupBy("node").agg(F.count(F.lit(1)).alias("n_descendants"))
    ids = F.transform("path", lambda x: F.shiftright(x, 1))
    return solved.join(below, "node", "left").select(
        _hierarchy_of("node").alias("hierarchy"), F.shiftright("node", 1).alias("page_id"), F.shiftright("root", 1).alias("root_id"), "depth", "state", F.array_join(ids.cast("array<string>"), "/").alias("path"), F.coalesce("n_descendants", F.lit(0)).alias("n_descendants")
    )


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    below = trees.descendants(solved_pages(spark, d, with_paths=True))
    return below.select(_hierarchy_of("node").alias("hierarchy"), F.shiftright("node", 1).alias("page_id"), F.shiftright("descendant", 1).alias("descendant_id"), "distance")


QUERIES = {"p3_found": p3_found, "p4_found": p4_found, "p4_report": p4_report, "p4_current": p4_current, "p5_found": p5_found, "p5_paths": p5_paths, "p5_descendants": p5_descendants}

_KEYS = """
pages AS (SELECT page_id, arg_max(path, scanned_at) AS path, arg_max(created_at, scanned_at) AS created_at, max(deleted_at) AS deleted_at FROM wiki_pages GROUP BY page_id),
split AS (SELECT *, string_split(regexp_replace(lower(path), '\\.md$', ''), '/') AS parts FROM (
  SELECT page_id, path, created_at, deleted_at FROM pages UNION ALL SELECT NULL, path, TIMESTAMP '0001-01-01', NULL FROM repo_pages)),
keys AS (SELECT page_id, path, created_at, deleted_at, array_to_string(list_slice(parts, n, len(parts)), '/') AS key FROM split, unnest(generate_series(1, len(parts))) AS s(n))
"""

_TARGET = """
CASE WHEN regexp_matches(bare, '\\.[^./\\s]+$') AND NOT ends_with(bare, '.md') THEN NULL ELSE nullif(regexp_replace(bare, '\\.md$', ''), '') END AS key
"""

_BARE = "regexp_replace(lower(trim(target, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), '^\\./', '') AS bare"

_P4 = f"""
WITH {_KEYS},
refs AS (SELECT ref_table, ref_id, seen_at, {_TARGET} FROM (
  SELECT DISTINCT 'page_links' AS ref_table, link_id AS ref_id, seen_at, {_BARE} FROM page_links
  UNION ALL SELECT DISTINCT 'page_embeds', embed_id, seen_at, {_BARE} FROM page_embeds)),
judged AS (
  SELECT ref_table, ref_id, seen_at, count(k.key) AS named,
    count(*) FILTER (k.created_at <= seen_at AND (k.deleted_at IS NULL OR k.deleted_at > seen_at)) AS existing,
    count(*) FILTER (k.created_at > seen_at) AS later
  FROM refs r LEFT JOIN keys k ON k.key = r.key WHERE r.key IS NOT NULL GROUP BY ref_table, ref_id, seen_at),
orphans AS (SELECT ref_table, ref_id, strftime(seen_at, '%Y-%m') AS period,
    CASE WHEN named = 0 THEN 'missing' WHEN later > 0 THEN 'late' ELSE 'deleted' END AS reason FROM judged WHERE existing = 0)
"""

_P5 = f"""
WITH RECURSIVE {_KEYS},
uses AS (SELECT DISTINCT hierarchy, page_path, {_TARGET} FROM (
  SELECT 'embeds' AS hierarchy, page_path, {_BARE} FROM page_embeds UNION ALL SELECT 'chain', page_path, {_BARE} FROM chain_edges)),
edges AS (SELECT DISTINCT hierarchy, CASE hierarchy WHEN 'embeds' THEN k.path ELSE page_path END AS child, CASE hierarchy WHEN 'embeds' THEN page_path ELSE k.path END AS parent
  FROM uses u JOIN keys k ON k.key = u.key AND k.page_id IS NOT NULL),
nodes AS (SELECT hierarchy, child AS node FROM edges UNION SELECT hierarchy, parent FROM edges),
tree AS (
  SELECT n.hierarchy, n.node, n.node AS root_node, 0 AS depth FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.hierarchy = n.hierarchy AND e.child = n.node)
  UNION ALL SELECT e.hierarchy, e.child, t.root_node, t.depth + 1 FROM tree t JOIN edges e ON e.hierarchy = t.hierarchy AND e.parent = t.node),
stuck AS (SELECT e.* FROM edges e WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.hierarchy = e.hierarchy AND t.node = e.child)),
reach AS (SELECT hierarchy, child AS start, parent AS at FROM stuck UNION SELECT r.hierarchy, r.start, s.parent FROM reach r JOIN stuck s ON s.hierarchy = r.hierarchy AND s.child = r.at)
SELECT hierarchy, node, root_node, depth, 'tree' AS state FROM tree
UNION ALL SELECT s.hierarchy, s.child, '', -1, CASE WHEN EXISTS (SELECT 1 FROM reach r WHERE r.hierarchy = s.hierarchy AND r.start = s.child AND r.at = s.child) THEN 'cycle' ELSE 'below_cycle' END FROM stuck s
"""

_P5_IDS = f"""
WITH RECURSIVE {_KEYS},
uses AS (SELECT DISTINCT hierarchy, page_path, {_TARGET} FROM (
  SELECT 'embeds' AS hierarchy, page_path, {_BARE} FROM page_embeds UNION ALL SELECT 'chain', page_path, {_BARE} FROM chain_edges)),
edges AS (SELECT DISTINCT hierarchy, CASE hierarchy WHEN 'embeds' THEN k.page_id ELSE p.page_id END AS child, CASE hierarchy WHEN 'embeds' THEN p.page_id ELSE k.page_id END AS parent
  FROM uses u JOIN keys k ON k.key = u.key AND k.page_id IS NOT NULL JOIN pages p ON p.path = u.page_path),
nodes AS (SELECT hierarchy, child AS node FROM edges UNION SELECT hierarchy, parent FROM edges),
tree AS (
  SELECT n.hierarchy, n.node, n.node AS root_id, 0 AS depth, [n.node] AS path FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.hierarchy = n.hierarchy AND e.child = n.node)
  UNION ALL SELECT e.hierarchy, e.child, t.root_id, t.depth + 1, list_append(t.path, e.child) FROM tree t JOIN edges e ON e.hierarchy = t.hierarchy AND e.parent = t.node),
below AS (SELECT hierarchy, path[i] AS page_id, node AS descendant_id, CAST(depth + 1 - i AS BIGINT) AS distance FROM tree, unnest(generate_series(1, depth)) AS s(i)),
stuck AS (SELECT e.* FROM edges e WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.hierarchy = e.hierarchy AND t.node = e.child)),
reach AS (SELECT hierarchy, child AS start, parent AS at FROM stuck UNION SELECT r.hierarchy, r.start, s.parent FROM reach r JOIN stuck s ON s.hierarchy = r.hierarchy AND s.child = r.at)
"""

_P3 = """
WITH copies AS (
  SELECT 'cache' AS side, * FROM findings_cache UNION ALL SELECT 'fresh', * FROM findings_fresh),
rows AS (SELECT side, regexp_replace(replace(file_path, chr(92), '/'), '^\\./', '') AS file_path, rule_id, line_no, col_no, severity,
  trim(message, ' ' || chr(9) || chr(10) || chr(13)) AS message, recorded_at FROM copies),
latest AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY side, file_path, rule_id, line_no, col_no
  ORDER BY recorded_at DESC NULLS LAST, severity DESC NULLS LAST, message DESC NULLS LAST) = 1),
joined AS (SELECT coalesce(a.file_path, b.file_path) AS file_path, coalesce(a.rule_id, b.rule_id) AS rule_id, coalesce(a.line_no, b.line_no) AS line_no, coalesce(a.col_no, b.col_no) AS col_no,
  a.side AS in_cache, b.side AS in_fresh, a.severity AS s1, b.severity AS s2, a.message AS m1, b.message AS m2
  FROM (SELECT * FROM latest WHERE side = 'cache') a FULL JOIN (SELECT * FROM latest WHERE side = 'fresh') b
  ON a.file_path IS NOT DISTINCT FROM b.file_path AND a.rule_id IS NOT DISTINCT FROM b.rule_id AND a.line_no IS NOT DISTINCT FROM b.line_no AND a.col_no IS NOT DISTINCT FROM b.col_no)
SELECT file_path, rule_id, line_no, col_no, CASE WHEN in_fresh IS NULL THEN 'only_in_cache' ELSE 'only_in_fresh' END AS kind, 'row' AS field FROM joined WHERE in_cache IS NULL OR in_fresh IS NULL
UNION ALL SELECT file_path, rule_id, line_no, col_no, 'differs', 'severity' FROM joined WHERE in_cache IS NOT NULL AND in_fresh IS NOT NULL AND s1 IS DISTINCT FROM s2
UNION ALL SELECT file_path, rule_id, line_no, col_no, 'differs', 'message' FROM joined WHERE in_cache IS NOT NULL AND in_fresh IS NOT NULL AND m1 IS DISTINCT FROM m2
"""

SQL = {
    "p3_found": _P3,
    "p4_found": _P4 + "SELECT * FROM orphans",
    "p4_report": _P4 + "SELECT ref_table, period, reason, count(*) AS n FROM orphans GROUP BY ref_table, period, reason",
    "p4_current": _P4 + """SELECT key, count(*) AS refs FROM (SELECT DISTINCT ref_table, ref_id, key FROM refs WHERE key IS NOT NULL) r
WHERE NOT EXISTS (SELECT 1 FROM keys k WHERE k.key = r.key AND k.created_at IS NOT NULL AND k.deleted_at IS NULL) GROUP BY key""",
    "p5_found": _P5,
    "p5_paths": _P5_IDS + """SELECT t.hierarchy, t.node AS page_id, root_id, CAST(t.depth AS BIGINT) AS depth, 'tree' AS state, array_to_string(path, '/') AS path, coalesce(n, 0) AS n_descendants
FROM tree t LEFT JOIN (SELECT hierarchy, page_id, count(*) AS n FROM below GROUP BY ALL) b ON b.hierarchy = t.hierarchy AND b.page_id = t.node
UNION ALL SELECT s.hierarchy, s.child, NULL, NULL, CASE WHEN EXISTS (SELECT 1 FROM reach r WHERE r.hierarchy = s.hierarchy AND r.start = s.child AND r.at = s.child) THEN 'cycle' ELSE 'below_cycle' END, NULL, 0 FROM stuck s""",
    "p5_descendants": _P5_IDS + "SELECT hierarchy, page_id, descendant_id, distance FROM below",
}
