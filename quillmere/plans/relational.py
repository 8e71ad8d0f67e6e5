"""The relational cores of the engine as queries over the test tables, each with its SQL.

Where the tables hold what an operator works on, they are used as they are; inputs that they lack
(pins, repositories, moves) are derived by arithmetic that SQL states alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmere.functions import columns as C
from quillmere.functions import markdown as M
from quillmere.operators import links as L
from quillmere.operators import reports as R
from quillmere.operators.copydiff import multiset_diff
from quillmere.operators.names import last_delivery
from quillmere.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def pages(spark: SparkSession, d: str) -> DataFrame:
    """The wiki's pages, one row each."""
    return last_delivery(table(spark, d, "wiki_pages"), "page_id", ["path", "title", "tags", "body", "lint_ignore", "size_bytes", "mtime_ns", "created_at"], "scanned_at")


def page_paths(spark: SparkSession, d: str) -> DataFrame:
    """The universe of link targets: pages of the wiki and of the catalog."""
    return table(spark, d, "wiki_pages").select("path").unionByName(table(spark, d, "repo_pages").select("path")).distinct()


def page_tags(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", "path", F.explode("tags").alias("tag")).where(F.col("tag").isNotNull())


def links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_links").select("link_id", "page_path", "target").where(F.col("target").isNotNull()).distinct()


_PAGES = "pages AS (SELECT page_id, arg_max(path, scanned_at) AS path, max(title) AS title, max(tags) AS tags, max(body) AS body, max(lint_ignore) AS lint_ignore, max(size_bytes) AS size_bytes, max(mtime_ns) AS mtime_ns, max(created_at) AS created_at FROM wiki_pages GROUP BY page_id)"
_PATHS = "paths AS (SELECT path FROM wiki_pages UNION SELECT path FROM repo_pages)"
_LINKS = "links AS (SELECT DISTINCT link_id, page_path, target FROM page_links WHERE target IS NOT NULL)"
_NOEXT = "regexp_replace({0}, '\\.md$', '')"
_BASE = "regexp_extract({0}, '[^/]*$')"
_STEM = "lower(" + _BASE.format(_NOEXT.format("path")) + ")"
_KEY = "lower(" + _NOEXT.format("path") + ")"


@query(f"WITH {_PATHS} SELECT path FROM paths WHERE NOT list_has_any(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1), ['git', 'talks']) AND NOT starts_with(path, 'wiki/domains/')")
def scan_paths(spark, d):
    """Path scan with pruned directories."""
    return page_paths(spark, d).where(~C.skipped(F.col("path"), ["git", "talks", "wiki/domains"]))


@query(f"WITH {_PAGES} SELECT page_id FROM pages WHERE (starts_with(path, 'wiki/sessions/') OR regexp_matches(path, '^wiki/inbox/[^/]*/[^/]*\\.md$')) AND list_contains(coalesce(tags, []), 'type/session') AND NOT regexp_matches(path, '^(?:[^/]+/)*w2[^/]*/.*$') AND NOT list_contains(coalesce(tags, []), 'status/open')")
def selector_match(spark, d):
    """A rule's selector over paths and tags."""
    on = ["wiki/sessions/**", "wiki/inbox/*/*.md", "#type/session", "!**/w2*/**", "!#status/open"]
    return pages(spark, d).where(C.selector(F.col("path"), F.col("tags"), on)).select("page_id")


@query(f"WITH {_PAGES} SELECT page_id, tag, prefix FROM (SELECT page_id, tag, CASE WHEN instr(tag, '/') <= 1 THEN '(none)' ELSE split_part(tag, '/', 1) END AS prefix FROM (SELECT page_id, unnest(tags) AS tag FROM pages) WHERE tag IS NOT NULL) WHERE prefix = '(none)' OR prefix NOT IN ('type', 'status', 'domain', 'project')")
def tag_format_bad(spark, d):
    return R.bad_tags(page_tags(spark, d), ["type", "status", "domain", "project"]).select("page_id", "tag", "prefix")


def _headings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [(i, h["line"], h["level"]) for i, body in frame[["page_id", "body"]].itertuples(index=False) for h in M.body_facts(body, 1)[1]]
        yield pd.DataFrame(rows, columns=["page_id", "line", "level"])


_ORDER_DATES = "SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS field, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY * (CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) AS moment FROM orders"


def _order_dates(spark, d):
    o = table(spark, d, "orders")
    field = F.col("o_orderdate").cast("timestamp")
    return o.select("o_orderkey", field.alias("field"), F.when(F.col("o_orderkey") % 3 == 0, field + F.expr("INTERVAL 1 DAY")).otherwise(field).alias("at"))


@query(
    f"""SELECT o_orderkey, kind, a AS path_date, b AS field_date FROM (
  SELECT o_orderkey, 'daily' AS kind, strftime(moment, '%Y-%m-%d') AS a, strftime(field, '%Y-%m-%d') AS b FROM ({_ORDER_DATES})
  UNION ALL SELECT o_orderkey, 'monthly', strftime(moment, '%Y-%m'), strftime(field, '%Y-%m') FROM ({_ORDER_DATES})
  UNION ALL SELECT o_orderkey, 'weekly', strftime(moment, '%G-W%V'), strftime(field, '%G-W%V') FROM ({_ORDER_DATES})) WHERE a <> b"""
)
def partition_date_mismatch(spark, d):
    """Dates in a path against a date field, at each grain."""
    at = F.col("at")
    paths = F.array(F.date_format(at, "'x/'yyyy/MM/dd'/p.md'"), F.date_format(at, "'x/'yyyy/MM'/p.md'"), F.concat(F.lit("x/"), C.iso_week(at), F.lit("/p.md")))
    rows = _order_dates(spark, d).select("o_orderkey", "field", F.explode(paths).alias("path"))
    kind, value = C.path_date(F.col("path"))
    rows = rows.select("o_orderkey", kind.alias("kind"), value.alias("path_date"), C.date_at(F.col("field"), kind).alias("field_date"))
    return rows.where(F.col("path_date") != F.col("field_date"))


@query("SELECT o_orderkey, age, CASE WHEN age > 800 THEN 'monthly' ELSE 'weekly or monthly' END AS suggested FROM (SELECT o_orderkey, datediff('second', CAST(o_orderdate AS TIMESTAMP), TIMESTAMP '1998-12-01 12:00:00') // 86400 AS age FROM orders) WHERE age > 400")
def partition_rollup_age(spark, d):
    """Pages older than their folder's grain allows, against a stated time."""
    age = C.age_days(F.lit("1998-12-01 12:00:00").cast("timestamp"), F.col("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", age.alias("age")).where("age > 400").withColumn("suggested", F.when(F.col("age") > 800, "monthly").otherwise("weekly or monthly"))


_KNOWN = f"(SELECT {_KEY} AS k FROM paths UNION SELECT {_STEM} FROM paths UNION SELECT lower(regexp_replace(path, '/[^/]*$', '')) FROM paths WHERE {_STEM} = 'index')"
_BROKEN = f"lower(target) NOT IN (SELECT k FROM full_keys) AND {_BASE.format('lower(target)')} NOT IN (SELECT k FROM stems)"
_FULL_KEYS = f"full_keys AS (SELECT {_KEY} AS k FROM paths UNION SELECT lower(regexp_replace(path, '/[^/]*$', '')) FROM paths WHERE {_STEM} = 'index' AND contains(path, '/'))"
_INDEX = f"{_FULL_KEYS}, stems AS (SELECT DISTINCT {_STEM} AS k FROM paths)"


@query(f"WITH {_PATHS}, {_LINKS}, {_INDEX} SELECT link_id, target, 'BROKEN' AS type FROM links WHERE target <> '' AND NOT starts_with(lower(target), 'sources/') AND {_BROKEN}")
def broken_links(spark, d):
    return L.broken(links(spark, d), page_paths(spark, d), skip_prefixes=["sources/"]).select("link_id", "target", "type")


@query(
    f"""WITH {_PATHS}, {_LINKS}, {_INDEX}, inner_paths AS (SELECT path FROM paths WHERE starts_with(path, 'wiki/sessions/') OR starts_with(path, 'wiki/inbox/')),
inner_full AS (SELECT {_KEY} AS k FROM inner_paths), inner_stems AS (SELECT {_STEM} AS k FROM inner_paths)
SELECT link_id, target, CASE WHEN {_BROKEN} THEN 'BROKEN' ELSE 'ESCAPE' END AS type FROM links WHERE target <> ''
AND lower(target) NOT IN (SELECT k FROM inner_full) AND {_BASE.format('lower(target)')} NOT IN (SELECT k FROM inner_stems)"""
)
def broken_links_scoped(spark, d):
    return L.broken(links(spark, d), page_paths(spark, d), scope=["wiki/sessions/**", "wiki/inbox/**"]).select("link_id", "target", "type")


@query(f"WITH {_PATHS}, {_LINKS}, stems AS (SELECT {_STEM} AS k, list_sort(list(path)) AS p FROM paths GROUP BY 1) SELECT link_id, target, len(p) AS n, array_to_string(p, ', ') AS paths FROM links JOIN stems ON k = lower(target) WHERE target <> '' AND NOT contains(target, '/') AND len(p) > 1")
def ambiguous_links(spark, d):
    return L.ambiguous(links(spark, d), page_paths(spark, d)).select("link_id", "target", "n", F.array_join("paths", ", ").alias("paths"))


_RESOLVE = f"""wanted AS (SELECT DISTINCT target, lower(regexp_replace(regexp_replace(target, '/+$', ''), '\\\\+$', '')) AS t FROM links WHERE target <> ''),
exact AS (SELECT {_KEY} AS k, max(path) AS p FROM paths GROUP BY 1),
stems AS (SELECT {_STEM} AS k, count(*) AS n, min(path) AS p FROM paths GROUP BY 1),
ends AS (SELECT array_to_string(list_slice(string_split(k, '/'), i, len(string_split(k, '/'))), '/') AS k, count(*) AS n, min(path) AS p FROM (SELECT path, {_KEY} AS k FROM paths), unnest(generate_series(1, len(string_split(k, '/')))) AS s(i) GROUP BY 1),
found AS (SELECT target, coalesce(e.p, CASE WHEN s.n = 1 THEN s.p END, CASE WHEN contains(t, '/') AND x.n = 1 THEN x.p END) AS resolved, coalesce(s.n, 0) AS n
  FROM wanted LEFT JOIN exact e ON e.k = t LEFT JOIN stems s ON s.k = {_BASE.format('t')} LEFT JOIN ends x ON x.k = t)"""
_SHORT = f"""tails AS (SELECT path, i, array_to_string(list_slice(p, len(p) - i + 1, len(p)), '/') AS suffix FROM (SELECT path, string_split({_NOEXT.format('path')}, '/') AS p FROM paths), unnest(generate_series(1, len(p))) AS s(i)),
short AS (SELECT path, coalesce((SELECT arg_min(suffix, i) FROM tails t WHERE t.path = u.path AND lower(suffix) IN (SELECT lower(suffix) FROM tails GROUP BY 1 HAVING count(*) = 1)), {_NOEXT.format('path')}) AS canonical FROM paths u)"""


@query(f"WITH {_PATHS}, {_LINKS}, {_RESOLVE} SELECT link_id, target, resolved, resolved IS NULL AND n > 1 AS ambiguous FROM links JOIN found USING (target)")
def resolve_links(spark, d):
    return L.resolve(links(spark, d).where("target <> ''"), page_paths(spark, d)).select("link_id", "target", "resolved", "ambiguous")


@query(f"WITH {_PATHS}, {_SHORT} SELECT path, canonical FROM short")
def shortest_unique_suffix(spark, d):
    return L.shortest_unique(page_paths(spark, d))


@query(f"WITH {_PATHS}, {_LINKS}, {_RESOLVE}, {_SHORT} SELECT link_id, target, canonical FROM links JOIN found USING (target) JOIN short ON path = resolved WHERE canonical <> target")
def noncanonical_links(spark, d):
    return L.noncanonical(links(spark, d), page_paths(spark, d)).select("link_id", "target", "canonical")


@query(f"WITH {_PATHS}, {_LINKS} SELECT DISTINCT target, path FROM links JOIN paths ON {_NOEXT.format('path')} = {_NOEXT.format('target')} OR ends_with({_NOEXT.format('path')}, '/' || {_NOEXT.format('target')}) WHERE target <> ''")
def resolve_notes(spark, d):
    return L.resolve_note(links(spark, d).where("target <> ''"), page_paths(spark, d))


@query("SELECT link_id, regexp_replace(split_part(trim(i), '#', 1), '/+$', '') AS target, CASE WHEN contains(i, '#') THEN trim(regexp_replace(i, '^[^#]*#', '')) ELSE '' END AS fragment FROM (SELECT DISTINCT link_id, regexp_extract(original, '\\[\\[([^\\]|]+)(?:\\|[^\\]]+)?\\]\\]', 1) AS i FROM page_links WHERE original IS NOT NULL)")
def link_parts(spark, d):
    """Target and fragment of link tokens."""
    inner = C.link_inner(F.col("original"))
    return table(spark, d, "page_links").where(F.col("original").isNotNull()).select("link_id", C.link_target(inner).alias("target"), C.link_fragment(inner).alias("fragment")).distinct()


@query(f"WITH {_LINKS} SELECT link_id, target, CASE WHEN lower(target) = 'wiki/sources/git/harbor-atlas' THEN 'wiki/archive/git/harbor-map' WHEN contains(target, '/') THEN array_to_string(list_slice(['wiki', 'archive', 'git', 'harbor-map'], 5 - len(string_split(target, '/')), 4), '/') ELSE 'harbor-map' END AS moved FROM links WHERE lower(target) = 'wiki/sources/git/harbor-atlas' OR (target <> '' AND ends_with('wiki/sources/git/harbor-atlas', '/' || lower(target)))")
def link_rewrite_move(spark, d):
    """Links to a moved page, rewritten at their depth."""
    old, new = F.lit("wiki/sources/git/harbor-atlas"), F.lit("wiki/archive/git/harbor-map")
    return links(spark, d).where("target <> ''").withColumn("moved", L.moved(F.col("target"), old, new)).where(F.col("moved").isNotNull()).select("link_id", "target", "moved")


@query("SELECT s_suppkey, repo FROM (SELECT s_suppkey, 'NATION_' || (s_nationkey + s_suppkey % 3) AS repo FROM supplier) WHERE repo NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 4 <> 0)")
def repo_uncataloged(spark, d):
    """Uses of repositories that have no catalog page."""
    uses = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("NATION_"), (F.col("s_nationkey") + F.col("s_suppkey") % 3).cast("string")).alias("repo"))
    return R.uncataloged(uses, table(spark, d, "nation").where("n_nationkey % 4 <> 0").select(F.col("n_name").alias("repo"), F.col("n_name").alias("path"))).select("s_suppkey", "repo")


@query("SELECT DISTINCT doc_id, t AS token FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9a-f]{7,}')) AS t, substr(sha1(CAST(doc_id AS VARCHAR)), 1, 40) AS v FROM documents) WHERE starts_with(v, t) OR starts_with(t, left(v, 1)) OR (strlen(t) >= 12 AND contains(v, t))")
def hex_echo(spark, d):
    """Hex tokens of a text that echo a value."""
    v = F.sha1(F.col("doc_id").cast("string"))
    tokens = table(spark, d, "documents").select("doc_id", v.alias("v"), F.explode(F.regexp_extract_all("text", F.lit("[0-9a-f]{7,}"), F.lit(0))).alias("t"))
    return tokens.where(F.exists(F.array(F.col("v"), F.substring("v", 1, 1)), lambda n: C.hex_echoes(n, F.col("t")))).select("doc_id", F.col("t").alias("token")).distinct()


@query("SELECT doc_id, sha1(encode('blob ' || octet_length(encode(text))) || chr(0)::BLOB || encode(text)) AS sha FROM documents WHERE text IS NOT NULL")
def blob_sha(spark, d):
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", C.blob_sha(F.col("text")).alias("sha"))


@query(f"WITH {_PATHS} SELECT CAST('0x' || left(sha256(path), 2) AS INTEGER) AS shard, count(*) AS n FROM paths GROUP BY 1")
def shard_histogram(spark, d):
    return page_paths(spark, d).groupBy(C.shard(F.col("path")).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\n{2,}', chr(10)), '\\n+$', '') || chr(10)) AS sha FROM documents WHERE text IS NOT NULL")
def slice_norm_hash(spark, d):
    """Hashes of texts in normal form."""
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.sha2(C.norm_v1(F.col("text")), 256).alias("sha"))


@query("SELECT edge_id, bool_or(coalesce((lower(trim(hash)) = s.h) OR (regexp_matches(regexp_replace(lower(trim(hash)), '^.*:', ''), '^[0-9a-f]{8,}$') AND starts_with(s.h, regexp_replace(lower(trim(hash)), '^.*:', ''))), false)) AS matches FROM (SELECT DISTINCT edge_id, page_path, hash FROM chain_edges WHERE hash IS NOT NULL) c JOIN (SELECT DISTINCT page_path, slice_hash AS h FROM page_slices WHERE kind = 'body') s USING (page_path) GROUP BY edge_id")
def recorded_hash_match(spark, d):
    """Recorded hashes against those of the declaring page's body."""
    body = table(spark, d, "page_slices").where("kind = 'body'").select("page_path", "slice_hash").distinct()
    edges = table(spark, d, "chain_edges").where(F.col("hash").isNotNull()).select("edge_id", "page_path", "hash").distinct()
    return edges.join(body, "page_path").groupBy("edge_id").agg(F.bool_or(C.recorded_matches(F.col("hash"), F.col("slice_hash"))).alias("matches"))


@query(f"WITH {_PATHS}, holders AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir FROM paths WHERE strlen({_STEM}) % 7 = 0), up AS (SELECT path, k, array_to_string(list_slice(p, 1, k), '/') AS dir FROM (SELECT path, string_split(path, '/') AS p FROM paths), unnest(generate_series(1, len(p) - 1)) AS s(k)) SELECT path, arg_max(dir, k) AS holder FROM up JOIN holders USING (dir) GROUP BY path")
def nearest_ancestor(spark, d):
    """The nearest directory above each page that holds a page of a kind."""
    p = page_paths(spark, d)
    holders = p.where(F.octet_length(F.lower(C.stem(F.col("path")))) % 7 == 0).select(C.directory(F.col("path")).alias("dir"))
    return R.nearest_ancestor(p, holders)


_TAGS = f"WITH {_PAGES}, c AS (SELECT split_part(tag, '/', 1) AS prefix, regexp_replace(tag, '^[^/]*/', '') AS value, count(*) AS cnt FROM (SELECT unnest(tags) AS tag FROM pages) WHERE instr(tag, '/') > 1 GROUP BY 1, 2)"


@query(_TAGS + " SELECT prefix, count(*) AS n_values, CAST(sum(cnt) AS BIGINT) AS total FROM c GROUP BY prefix")
def domains_tree(spark, d):
    return R.domains_tree(R.tag_counts(page_tags(spark, d)))


@query(_TAGS + " SELECT value, cnt FROM c WHERE prefix = 'type'")
def domains_show(spark, d):
    return R.domains_show(R.tag_counts(page_tags(spark, d)), "type")


@query(f"WITH {_PAGES} SELECT path AS source, regexp_replace(path, '/?[^/]*$', '') AS where, coalesce(created, '') AS created FROM (SELECT path, mtime_ns, tags, CASE WHEN page_id % 5 <> 0 THEN strftime(created_at, '%Y-%m-%d') END AS created FROM pages) WHERE starts_with(path, 'wiki/sources') AND list_contains(tags, 'type/source')".replace("AS where", 'AS "where"'))
def debt_list(spark, d):
    p = pages(spark, d).withColumn("created", F.when(F.col("page_id") % 5 != 0, F.date_format("created_at", "yyyy-MM-dd")))
    return R.debt(p, "wiki/sources", "type/source")


_F = "rule_id, severity, file_path, line_no, col_no, message"


@query(f"SELECT {_F}, CASE WHEN s > 0 THEN 'only_in_cache' ELSE 'only_in_fresh' END AS kind, CAST(abs(s) AS BIGINT) AS n FROM (SELECT {_F}, sum(k) AS s FROM (SELECT {_F}, 1 AS k FROM findings_cache UNION ALL SELECT {_F}, -1 FROM findings_fresh) GROUP BY ALL) WHERE s <> 0")
def findings_diff(spark, d):
    """The bag difference of two runs' findings."""
    cols = _F.split(", ")
    return multiset_diff(table(spark, d, "findings_cache").select(*cols), table(spark, d, "findings_fresh").select(*cols), ("cache", "fresh"))


@query("SELECT max(CASE WHEN severity IN ('error', 'warn') THEN 1 ELSE 0 END) AS exit_code FROM findings_fresh")
def exit_code_strict(spark, d):
    return R.exit_code(table(spark, d, "findings_fresh").select("severity"), strict=True)


@query(f"WITH {_PAGES}, i AS (SELECT DISTINCT path, trim(unnest(lint_ignore)) AS r FROM pages) SELECT f.rule_id, f.file_path, f.line_no FROM findings_fresh f WHERE EXISTS (SELECT 1 FROM i WHERE i.path = f.file_path AND (r = f.rule_id OR r = '*'))")
def suppressed_findings(spark, d):
    """Findings that their page ignores."""
    ignores = pages(spark, d).select(F.col("path").alias("file_path"), F.explode("lint_ignore").alias("rule_id")).where(F.col("rule_id").isNotNull())
    return R.suppressed(table(spark, d, "findings_fresh").select("rule_id", "file_path", "line_no"), ignores)


_GLOBS = "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '**/*.md' WHEN 1 THEN '*/x.md' ELSE 'dir' || (p_partkey % 41) || '/**' END AS pattern, regexp_extract(pattern, '^([^/*?\\[{]+)/', 1) AS top FROM part"


@query(f"WITH r AS ({_GLOBS}), n AS (SELECT top, count(*) AS n FROM r GROUP BY top) SELECT id, top, top = '' AS wide, CASE WHEN top = '' THEN (SELECT count(*) FROM r) - 1 ELSE n - 1 + (SELECT count(*) FROM r WHERE top = '') END AS n_meets FROM r JOIN n USING (top)")
def rule_overlap_classes(spark, d):
    """The overlaps of all rules, as classes with their members: two rules can meet if they share a class or either is wide."""
    k = F.col("p_partkey")
    glob = F.when(k % 5 == 0, "**/*.md").when(k % 5 == 1, "*/x.md").otherwise(F.concat(F.lit("dir"), (k % 41).cast("string"), F.lit("/**")))
    return R.overlap_classes(table(spark, d, "part").select(k.alias("id"), glob.alias("glob")))


_NEAR = ["type", "status", "domain", "project", "topic"]


# DuckDB's levenshtein counts bytes; no known key has a '~', so it may stand for any character that isn't ASCII.
@query(f"WITH {_PAGES}, k AS (SELECT DISTINCT split_part(trim(tag, ' ' || chr(9)), '/', 1) AS key FROM (SELECT unnest(tags) AS tag FROM pages) WHERE tag IS NOT NULL), n AS (SELECT key, name, i, levenshtein(regexp_replace(key, '[^ -~]', '~', 'g'), name) AS d FROM k, (VALUES {', '.join(f'({i}, {chr(39)}{n}{chr(39)})' for i, n in enumerate(_NEAR))}) AS v(i, name)) SELECT k.key, (SELECT arg_min(name, d * 10 + i) FROM n WHERE n.key = k.key AND d <= 2) AS nearest FROM k")
def nearest_param(spark, d):
    """The nearest known key of each key of all tags, in any script."""
    keys = page_tags(spark, d).select(F.substring_index(F.trim("tag", F.lit(" \t")), "/", 1).alias("key")).distinct()
    return R.nearest_key(keys, _NEAR, 2)


@query(
    """WITH s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > INTERVAL 300 SECOND THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id) AS batch FROM (SELECT ts, event_id, user_id, event_type, ts - lag(ts) OVER (ORDER BY ts, event_id) AS gap FROM events WHERE ts IS NOT NULL))
SELECT (SELECT min(ts) FROM s x WHERE x.batch = s.batch) AS batch_start, user_id, arg_max(event_type, (ts, event_type)) AS event_type FROM s GROUP BY batch, user_id"""
)
def session_debounce(spark, d):
    """Batches of changes between quiet gaps, the last change per key."""
    return R.sessions(table(spark, d, "events").select("ts", "user_id", "event_type"), "user_id", "ts", "event_type", "300 seconds")


@query(f"WITH {_PATHS}, d AS (SELECT path, regexp_extract(path, '/(\\d{{4}})/w(\\d{{2}})/', ['y', 'w']) AS m FROM paths) SELECT m['y'] || '-W' || m['w'] AS week, count(*) AS n FROM d WHERE m['y'] <> '' GROUP BY 1")
def path_weeks(spark, d):
    """Pages by the week in their path."""
    path = F.regexp_replace("path", r"/(\d{4})/w(\d{2})/", "/$1-W$2/")
    kind, value = C.path_date(path)
    return page_paths(spark, d).select(kind.alias("kind"), value.alias("week")).where("kind = 'weekly'").groupBy("week").agg(F.count(F.lit(1)).alias("n"))


_REMOTES = "SELECT n_nationkey AS k, lower(n_name) AS slug, CASE n_nationkey % 3 WHEN 0 THEN 'git@Git.Example:org/' || lower(n_name) || '.git' WHEN 1 THEN 'https://user@git.example:443/org/' || lower(n_name) || '/' ELSE 'git.example/org/' || lower(n_name) END AS remote FROM nation"


@query(f"SELECT CASE WHEN k % 7 = 0 THEN 'absent' WHEN k % 5 = 0 THEN 'not-a-repo' WHEN k % 6 = 5 THEN 'remote-mismatch' ELSE 'present' END AS state, count(*) AS n FROM ({_REMOTES}) GROUP BY 1")
def repo_states(spark, d):
    """States of catalogued repositories."""
    k, name = F.col("n_nationkey"), F.lower("n_name")
    remote = F.when(k % 3 == 0, F.concat(F.lit("git@Git.Example:org/"), name, F.lit(".git"))).when(k % 3 == 1, F.concat(F.lit("https://user@git.example:443/org/"), name, F.lit("/"))).otherwise(F.concat(F.lit("git.example/org/"), name))
    n = table(spark, d, "nation")
    catalog = n.select(name.alias("slug"), remote.alias("remote"), F.lit("").alias("commit"))
    found = F.when(k % 6 == 5, F.lit("git.example/other/x")).otherwise(F.concat(F.lit("ssh://git@git.example/org/"), name, F.lit(".git")))
    probes = n.where("n_nationkey % 7 <> 0").select(name.alias("slug"), F.lit(True).alias("found"), F.lit(False).alias("symlink"), F.lit(False).alias("symlink_broken"), (k % 5 != 0).alias("has_git"), F.array(F.lit("git.example/fork/y"), found).alias("remotes"), F.lit("").alias("head"))
    return R.repo_states(catalog, probes).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT file_path) AS files, count(DISTINCT rule_id) AS rules, count(*) FILTER (contains(lower(coalesce(message, '')), 'heading')) AS about_headings FROM findings_fresh")
def run_stats(spark, d):
    f = table(spark, d, "findings_fresh")
    return f.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_path").alias("files"), F.countDistinct("rule_id").alias("rules"), F.count(F.when(F.contains(F.lower(F.coalesce("message", F.lit(""))), F.lit("heading")), 1)).alias("about_headings"))


@query("SELECT rule_id, file_path, line_no, row_number() OVER (PARTITION BY file_path, rule_id ORDER BY line_no, col_no, message NULLS FIRST, severity NULLS FIRST, recorded_at) AS seq FROM findings_fresh")
def findings_order(spark, d):
    """Findings with their place within file and rule."""
    w = W.partitionBy("file_path", "rule_id").orderBy("line_no", "col_no", "message", "severity", "recorded_at")
    return table(spark, d, "findings_fresh").select("rule_id", "file_path", "line_no", F.row_number().over(w).alias("seq"))


@query("SELECT wiki, prefix, count(DISTINCT scan_id) AS n_scans, CAST(sum(cnt) AS BIGINT) AS total FROM (SELECT DISTINCT * FROM domain_counts) WHERE prefix IS NOT NULL GROUP BY wiki, prefix")
def satellite_domains(spark, d):
    """Tag namespaces of satellite wikis over their snapshots."""
    return table(spark, d, "domain_counts").distinct().where(F.col("prefix").isNotNull()).groupBy("wiki", "prefix").agg(F.countDistinct("scan_id").alias("n_scans"), F.sum("cnt").alias("total"))


def _corpus(spark, d):
    """The wiki's pages as a corpus of files: body and place."""
    return corpus_of(pages(spark, d))


def corpus_of(rows: DataFrame, *more: str) -> DataFrame:
    """Pages as files: (path, length, mtime_ns, content) and what else is named."""
    return rows.where(F.col("path").isNotNull()).select("path", F.octet_length(F.coalesce("body", F.lit(""))).cast("long").alias("length"), F.coalesce("mtime_ns", F.lit(0)).alias("mtime_ns"), F.coalesce("body", F.lit("")).alias("content"), *more)


def _documents(spark, d):
    from quillmere.sources.corpus import scan

    return scan(_corpus(spark, d))


def _outside_fences(source: str, key: str = "path") -> str:
    """CTEs from ``src`` (key, body): ``plain`` has the lines outside fences.

    Only lines that begin with a fence change the state, so a recursion goes from one to the next: the
    first opens, one of the same sign that begins with the opening run closes; all are no text.
    """
    return f"""src AS ({source}), lines AS (SELECT {key}, i AS line, l[i] AS text FROM (SELECT {key}, string_split(body, chr(10)) AS l FROM src WHERE body IS NOT NULL), unnest(generate_series(1, len(l))) AS s(i)),
marks AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY line) AS k, regexp_extract(text, '^\\s*(`{{3,}}|~{{3,}})', 1) AS run, ltrim(text) AS t FROM lines WHERE regexp_matches(text, '^\\s*(```|~~~)')),
states AS (SELECT DISTINCT {key}, CAST(0 AS BIGINT) AS k, '' AS open FROM marks UNION ALL SELECT s.{key}, m.k, CASE WHEN open = '' THEN run WHEN starts_with(t, open) THEN '' ELSE open END FROM states s JOIN marks m ON m.{key} = s.{key} AND m.k = s.k + 1),
counted AS (SELECT *, count(*) FILTER (regexp_matches(text, '^\\s*(```|~~~)')) OVER (PARTITION BY {key} ORDER BY line) AS k FROM lines),
plain AS (SELECT c.{key}, c.line, c.text, trim(c.text, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS t FROM counted c LEFT JOIN states s ON s.{key} = c.{key} AND s.k = c.k WHERE NOT regexp_matches(c.text, '^\\s*(```|~~~)') AND coalesce(open, '') = '')"""


_BODIES = "SELECT path, body FROM pages WHERE path IS NOT NULL"
_HEADS = "heads AS (SELECT *, CAST(strlen(regexp_extract(t, '^#+')) AS INTEGER) AS level FROM plain WHERE regexp_matches(t, '^#{1,6}( |$)'))"


@query(f"WITH RECURSIVE {_PAGES}, {_outside_fences(_BODIES)}, l AS (SELECT path, unnest(regexp_extract_all(regexp_replace(text, '`[^`]+`', '', 'g'), '\\[\\[([^\\]|]+)(?:\\|[^\\]]+)?\\]\\]', 1)) AS raw FROM plain) SELECT path, regexp_replace(regexp_replace(split_part(trim(raw), '#', 1), '\\\\+$', ''), '/+$', '') AS target, count(*) AS n FROM l GROUP BY ALL")
def fact_links(spark, d):
    """Links extracted from the bodies of all pages, outside fences and code spans."""
    from quillmere.operators.facts import Facts, extract

    return Facts(extract(_documents(spark, d))).links.groupBy("path", "target").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH RECURSIVE {_PAGES}, {_outside_fences(_BODIES)}, {_HEADS} SELECT path, CAST(line AS INTEGER) AS line, level, trim(regexp_replace(t, '^#+', ''), ' ' || chr(9)) AS text FROM heads")
def fact_headings(spark, d):
    """Headings extracted from the bodies of all pages, outside fences."""
    from quillmere.operators.facts import Facts, extract

    return Facts(extract(_documents(spark, d))).headings.select("path", "line", "level", "text")


def _headings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [(i, h["line"], h["level"]) for i, body in frame[["path", "body"]].itertuples(index=False) for h in M.body_facts(body, 1)[1]]
        yield pd.DataFrame(rows, columns=["path", "line", "level"])


_LEVELS = {3: "#### ", 5: "# "}  # what texts whose id it divides have for '## '
_BENT = "CASE WHEN {0} % 3 = 0 THEN replace({1}, chr(10) || '## ', chr(10) || '#### ') WHEN {0} % 5 = 0 THEN replace({1}, chr(10) || '## ', chr(10) || '# ') ELSE {1} END"
_TEXTS = f"SELECT 'p' || page_id AS path, {_BENT.format('page_id', 'body')} AS body FROM pages UNION ALL SELECT 'd' || doc_id, {_BENT.format('doc_id', 'text')} FROM documents"


@query(
    f"""WITH RECURSIVE {_PAGES}, {_outside_fences(_TEXTS)}, {_HEADS},
seen AS (SELECT *, max(level) OVER w AS deepest, count(*) FILTER (level = 1) OVER w AS h1 FROM heads WINDOW w AS (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT path, CAST(line AS INTEGER) AS line, level, deepest + 1 AS expected, 'multiple H1' AS issue FROM seen WHERE level = 1 AND h1 > 0
UNION ALL SELECT path, CAST(line AS INTEGER), level, deepest + 1, 'skipped level' FROM seen WHERE level > deepest + 1"""
)
def heading_jumps(spark, d):
    """Second top headings and skipped levels of all pages and documents, with levels changed in some; lines in fences are no headings."""

    def bent(rows: DataFrame, sign: str, key: str, body: str) -> DataFrame:
        out = F.col(body)
        for by, level in reversed(_LEVELS.items()):
            out = F.when(F.col(key) % by == 0, F.replace(F.col(body), F.lit("\n## "), F.lit(f"\n{level}"))).otherwise(out)
        return rows.select(F.concat(F.lit(sign), F.col(key).cast("string")).alias("path"), out.alias("body")).where("body IS NOT NULL")

    texts = bent(pages(spark, d), "p", "page_id", "body").unionByName(bent(table(spark, d, "documents"), "d", "doc_id", "text"))
    return R.heading_jumps(texts.mapInPandas(_headings, "path string, line int, level int"), "path", "line")


@query(
    f"""WITH {_PAGES}, lines AS (SELECT page_id, i AS line, l[i] AS text FROM (SELECT page_id, string_split(body, chr(10)) AS l FROM pages WHERE body IS NOT NULL), unnest(generate_series(1, len(l))) AS s(i)), rows AS (SELECT page_id, line, line - row_number() OVER (PARTITION BY page_id ORDER BY line) AS run FROM lines WHERE starts_with(trim(text, ' ' || chr(9)), '|'))
SELECT page_id, min(line) AS first, max(line) AS last, count(*) AS size FROM rows GROUP BY page_id, run HAVING count(*) >= 2"""
)
def table_islands(spark, d):
    """Tables of all pages; a fence is no exception, as in the check of links in tables."""
    lines = pages(spark, d).where(F.col("body").isNotNull()).select("page_id", F.posexplode(F.split("body", "\n", -1)).alias("at", "text")).withColumn("line", F.col("at") + 1)
    return R.islands(lines, "page_id", "line", F.startswith(F.trim("text", F.lit(" \t")), F.lit("|")))



@query(f"WITH {_PAGES} SELECT path, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(body, ''), '\\r\\n?', chr(10), 'g'), '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n{{2,}}', chr(10)), '\\n+$', '') || chr(10)) AS slice_hash FROM pages")
def fact_body_hash(spark, d):
    """Hashes of whole bodies by the slice grammar."""
    from quillmere.operators.facts import Facts, extract

    return Facts(extract(_documents(spark, d))).slices.where("anchor = ''").select("path", "slice_hash")


_NORMAL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\\r\\n?', chr(10), 'g'), '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n{{2,}}', chr(10)), '\\n+$', '') || chr(10)"


@query(
    f"""WITH RECURSIVE {_PAGES}, lines AS (SELECT path, i AS line, regexp_replace(l[i], '\\r$', '') AS t FROM (SELECT path, string_split(coalesce(body, ''), chr(10)) AS l FROM pages WHERE path IS NOT NULL), unnest(generate_series(1, len(l))) AS s(i)),
marks AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY line) AS k, regexp_extract(t, '^(`{{3,}}|~{{3,}})', 1) AS run, trim(regexp_extract(t, '^(?:`{{3,}}|~{{3,}})(.*)$', 1), ' ' || chr(9)) AS rest FROM lines WHERE regexp_matches(t, '^(```|~~~)')),
states AS (SELECT DISTINCT path, CAST(0 AS BIGINT) AS k, '' AS open FROM marks UNION ALL SELECT s.path, m.k, CASE WHEN open = '' THEN run WHEN left(run, 1) = left(open, 1) AND strlen(run) >= strlen(open) AND rest = '' THEN '' ELSE open END FROM states s JOIN marks m ON m.path = s.path AND m.k = s.k + 1),
counted AS (SELECT *, count(*) FILTER (regexp_matches(t, '^(```|~~~)')) OVER (PARTITION BY path ORDER BY line) AS k FROM lines),
heads AS (SELECT c.path, c.line, strlen(regexp_extract(c.t, '^#+')) AS level, regexp_extract(c.t, '^#{{1,6}}\\s+(.*?)\\s*$', 1) AS anchor FROM counted c LEFT JOIN states s ON s.path = c.path AND s.k = c.k WHERE coalesce(open, '') = '' AND regexp_matches(c.t, '^#{{1,6}}\\s+')),
ends AS (SELECT h.path, h.anchor, h.line, coalesce((SELECT min(o.line) FROM heads o WHERE o.path = h.path AND o.line > h.line AND o.level <= h.level), (SELECT max(x.line) + 1 FROM lines x WHERE x.path = h.path)) AS until FROM heads h QUALIFY row_number() OVER (PARTITION BY h.path, h.anchor ORDER BY h.line) = 1),
texts AS (SELECT e.path, e.anchor, e.line, e.until, string_agg(x.t, chr(10) ORDER BY x.line) || chr(10) AS body FROM ends e JOIN lines x ON x.path = e.path AND x.line >= e.line AND x.line < e.until GROUP BY ALL)
SELECT path, anchor, CAST(line AS INTEGER) AS start_line, CAST(until AS INTEGER) AS end_line, sha256({_NORMAL.format('body')}) AS slice_hash FROM texts"""
)
def fact_sections(spark, d):
    """Sections of all pages by the slice grammar: the first of equal headings, its lines and the hash of its text in normal form."""
    from quillmere.operators.facts import Facts, extract

    return Facts(extract(_documents(spark, d))).slices.where("kind = 'section'").select("path", "anchor", "start_line", "end_line", "slice_hash")


RULES = [
    ("backticked-wikilink", {}), ("table-wikilink-pipe", {}), ("heading-structure", {}), ("wiki-navlink", {}), ("broken-wikilink", {"skip-prefixes": ["http", "sources/"]}), ("ambiguous-wikilink", {}), ("wikilink-canonicalize", {}), ("pattern", {"target": "filename", "match": "^[a-z0-9-]+\\.md$"}),
]


_LINKED = "SELECT path, coalesce(body, '') || coalesce(chr(10) || (SELECT string_agg(original, chr(10) ORDER BY link_id) FROM (SELECT DISTINCT link_id, page_path, original FROM page_links WHERE original IS NOT NULL) l WHERE l.page_path = p.path), '') AS body FROM pages p WHERE path IS NOT NULL"
_NONE = "'<no value>'"
_LINK = "'\\[\\[([^\\]|]+)(?:\\|[^\\]]+)?\\]\\]'"


@query(
    f"""WITH RECURSIVE {_PAGES}, {_PATHS}, {_outside_fences(_LINKED)}, {_HEADS},
found_links AS (SELECT path, line, unnest(m) AS raw, unnest(generate_series(1, len(m))) AS k FROM (SELECT path, line, regexp_extract_all(regexp_replace(text, '`[^`]+`', '', 'g'), {_LINK}, 1) AS m FROM plain)),
links AS (SELECT path AS page, line, row_number() OVER (PARTITION BY path ORDER BY line, k) - 1 AS pos, regexp_replace(regexp_replace(split_part(trim(raw), '#', 1), '\\\\+$', ''), '/+$', '') AS target FROM found_links),
{_FULL_KEYS}, {_RESOLVE}, {_SHORT},
quoted AS (SELECT path, line, unnest(m) AS match, unnest(generate_series(1, len(m))) AS k FROM (SELECT path, line, flatten(list_transform(regexp_extract_all(text, '`[^`]+`'), lambda c: regexp_extract_all(c, {_LINK}))) AS m FROM plain)),
trows AS (SELECT *, line - row_number() OVER (PARTITION BY path ORDER BY line) AS run FROM lines WHERE starts_with(trim(text, ' ' || chr(9) || chr(13)), '|')),
tables AS (SELECT *, count(*) OVER (PARTITION BY path, run) AS size FROM trows),
piped AS (SELECT path, line, array_to_string(regexp_extract_all(text, '\\[\\[[^\\]\\\\]+\\|[^\\]]+\\]\\]'), ', ') AS found FROM tables WHERE size >= 2 AND NOT regexp_matches(text, '^\\s*\\|[\\s:]*-{{3,}}[\\s:]*\\|')),
seen AS (SELECT *, max(level) OVER w AS deepest, count(*) FILTER (level = 1) OVER w AS h1 FROM heads WINDOW w AS (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
out AS (
  SELECT 'broken-wikilink' AS rule_id, page AS path, line, target || {_NONE} || {_NONE} || {_NONE} AS message, pos AS seq FROM links WHERE target <> '' AND NOT starts_with(lower(target), 'sources/') AND NOT starts_with(lower(target), 'http') AND {_BROKEN}
  UNION ALL SELECT 'ambiguous-wikilink', page, line, target || {_NONE} || {_NONE} || {_NONE}, pos FROM links JOIN (SELECT {_STEM} AS k FROM paths GROUP BY 1 HAVING count(*) > 1) ON k = lower(target) WHERE target <> '' AND NOT contains(target, '/')
  UNION ALL SELECT 'wikilink-canonicalize', page, line, target || {_NONE} || {_NONE} || {_NONE}, pos FROM links JOIN found USING (target) JOIN short ON path = resolved WHERE canonical <> target
  UNION ALL SELECT 'backticked-wikilink', path, line, {_NONE} || match || {_NONE} || {_NONE}, row_number() OVER (PARTITION BY path ORDER BY line, k) - 1 FROM quoted
  UNION ALL SELECT 'table-wikilink-pipe', path, line, {_NONE} || {_NONE} || {_NONE} || found, row_number() OVER (PARTITION BY path ORDER BY line) - 1 FROM piped WHERE found <> ''
  UNION ALL SELECT 'heading-structure', path, line, {_NONE} || {_NONE} || 'multiple H1' || {_NONE}, 0 FROM seen WHERE level = 1 AND h1 > 0
  UNION ALL SELECT 'heading-structure', path, line, {_NONE} || {_NONE} || 'skipped level: expected H' || (deepest + 1) || ', got H' || level || {_NONE}, 1 FROM seen WHERE level > deepest + 1
  UNION ALL SELECT 'pattern', path, 0, {_NONE} || {_NONE} || {_NONE} || {_NONE}, 0 FROM src WHERE NOT regexp_matches({_BASE.format('path')}, '^[a-z0-9-]+\\.md$'))
SELECT rule_id, 'warn' AS severity, path AS file_path, CAST(line AS INTEGER) AS line, message, CAST(seq AS INTEGER) AS seq FROM out"""
)
def engine_check(spark, d):
    """A pack of rules over the wiki's pages as a corpus, end to end; the pages' links from the fact table stand below their bodies."""
    from quillmere.plans.engine import Engine
    from quillmere.sources.rules import Rule

    given = table(spark, d, "page_links").where("original IS NOT NULL").select("link_id", F.col("page_path").alias("path"), "original").distinct()
    below = given.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("link_id", "original"))), lambda x: x["original"]), "\n").alias("below"))
    rows = pages(spark, d).join(below, "path", "left").withColumn("body", F.concat(F.coalesce("body", F.lit("")), F.coalesce(F.concat(F.lit("\n"), "below"), F.lit(""))))
    engine = Engine(spark, corpus_of(rows), extra_paths=table(spark, d, "repo_pages").select("path"))
    rules = [Rule(name, name, "warn", ["**"], params, "{{.Target}}{{.Match}}{{.Issue}}{{.Wikilinks}}") for name, params in RULES]
    return engine.check(rules).drop("column")


def _heap_hashes(levels: int) -> str:
    """SQL for hashes of a heap's nodes from the deepest level on; node n has the children 2n and 2n + 1."""
    steps = [f"h{levels} AS (SELECT node, leaf, '' AS hash FROM leaves WHERE false)"]
    for k in reversed(range(levels)):
        kids = "coalesce((SELECT hash FROM h{0} c WHERE c.node = 2 * l.node), '') || coalesce((SELECT hash FROM h{0} c WHERE c.node = 2 * l.node + 1), '')".format(k + 1)
        steps.append(f"h{k} AS (SELECT node, leaf, sha256(unhex(leaf || {kids})) AS hash FROM leaves l WHERE node >= {1 << k} AND node < {1 << (k + 1)})")
    return ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT node, hash FROM h{k}" for k in range(levels))


@query(f"WITH leaves AS (SELECT p_partkey AS node, sha256(CAST(p_partkey AS VARCHAR)) AS leaf FROM part WHERE p_partkey > 0), {_heap_hashes(22)}")
def merkle_tree_hash(spark, d):
    """Hashes of all nodes of a heap-shaped tree, each over its children's."""
    from quillmere.operators.graph import compose_levels

    part = table(spark, d, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("node"))
    leaves = part.select("node", F.sha2(F.col("node").cast("string"), 256).alias("leaf"))
    tree = part.where("node > 1").select(F.floor(F.col("node") / 2).alias("node"), F.col("node").alias("pos"), F.col("node").alias("child"))
    return compose_levels(leaves, tree)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Broken and ambiguous links."""
    b = broken_links(spark, d).select("link_id", "target", F.lit("broken-wikilink").alias("rule_id"))
    return b.unionByName(ambiguous_links(spark, d).select("link_id", "target", F.lit("ambiguous-wikilink").alias("rule_id")))


SQL["flagship"] = f"WITH {_PATHS}, {_LINKS}, {_INDEX} SELECT link_id, target, 'broken-wikilink' AS rule_id FROM links WHERE target <> '' AND NOT starts_with(lower(target), 'sources/') AND {_BROKEN} UNION ALL SELECT link_id, target, 'ambiguous-wikilink' FROM links JOIN (SELECT {_STEM} AS k FROM paths GROUP BY 1 HAVING count(*) > 1) ON k = lower(target) WHERE NOT contains(target, '/')"
QUERIES["flagship"] = flagship
