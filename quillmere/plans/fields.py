"""Checks of frontmatter fields and bodies, walks, tasks and listings over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.functions import columns as C
from quillmere.functions.templates import column
from quillmere.operators import attest, cache, graph, reports, tasks
from quillmere.operators.facts import Facts
from quillmere.plans.relational import _KEY, _LINKS, _PAGES, _PATHS, _RESOLVE, _STEM, links, page_paths, pages, query
from quillmere.plans.worlds import _CACHED, _cached, _run, _text
from quillmere.session import table
from quillmere.streaming import watch


def _fields(rows: DataFrame, key: str, path, value, kind) -> DataFrame:
    """Documents with one frontmatter field, absent where the value is null."""
    docs = rows.select(path.alias("path"), value.alias(key), kind.alias("__kind")).where(F.col(key).isNotNull() & F.col("path").isNotNull())
    return docs.select("path", F.to_json(F.struct(key)).alias("fm"), F.create_map(F.lit(key), F.col("__kind")).alias("fm_kinds"), F.array(F.lit(key)).alias("fm_keys"), F.lit(False).alias("is_foreign"))


def _reason(found: DataFrame) -> DataFrame:
    return found.select("path", F.col("data")["Value"].alias("value"), F.col("data")["Reason"].alias("reason"))


@query(
    f"""WITH {_PAGES}, t AS (SELECT path, title AS value FROM pages WHERE title IS NOT NULL AND path IS NOT NULL)
SELECT path, value, 'does not match pattern "^[A-Z][a-z]+ [a-z]+"' AS reason FROM t WHERE NOT regexp_matches(value, '^[A-Z][a-z]+ [a-z]+') UNION ALL SELECT path, value, 'not in allowed values [Home Index]' FROM t WHERE value NOT IN ('Home', 'Index')"""
)
def property_text(spark, d):
    """Titles that don't match a pattern, and that aren't listed."""
    docs = _fields(pages(spark, d), "title", F.col("path"), F.col("title"), F.lit("string"))
    return _reason(_run("property", docs, {"property": ["title"], "text": {"match": "^[A-Z][a-z]+ [a-z]+", "in": ["Home", "Index"]}}))


@query(
    f"""WITH {_PAGES}, t AS (SELECT path, tag AS value, split_part(tag, '/', 1) AS p, regexp_replace(tag, '^[^/]*/', '') AS v FROM (SELECT path, unnest(tags) AS tag FROM pages WHERE path IS NOT NULL) WHERE tag IS NOT NULL)
SELECT path, value, 'tag missing prefix/value separator' AS reason FROM t WHERE NOT contains(value, '/')
UNION ALL SELECT path, value, 'unknown prefix "' || p || '"' FROM t WHERE contains(value, '/') AND p NOT IN ('type', 'status', 'domain')
UNION ALL SELECT path, value, 'value does not match pattern "^[a-z0-9-]+$"' FROM t WHERE contains(value, '/') AND NOT regexp_matches(v, '^[a-z0-9-]+$')"""
)
def property_tag(spark, d):
    """Tags without a prefix, with an unknown one, and with an odd value."""
    docs = _fields(pages(spark, d), "tags", F.col("path"), F.col("tags"), F.lit("list"))
    return _reason(_run("property", docs, {"property": ["tags"], "tag": {"prefix": {"in": ["type", "status", "domain"]}, "value": {"match": "^[a-z0-9-]+$"}}}))


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE o_orderkey % 6 WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 2 THEN 'soon' WHEN 3 THEN strftime(o_orderdate, '%Y-13-%d') ELSE '7' END AS value,
CASE WHEN o_orderkey % 6 = 5 THEN 'expected string, got int' ELSE 'not a date by 2006-01-02' END AS reason FROM orders WHERE o_orderkey % 6 IN (1, 2, 3, 5)"""
)
def property_date(spark, d):
    """Fields that are no dates by a layout; a bare date is one always."""
    k, at = F.col("o_orderkey") % 6, F.col("o_orderdate")
    day = lambda layout: F.date_format(at, layout)
    value = F.when(k == 1, day("yyyy/MM/dd")).when(k == 2, "soon").when(k == 3, day("yyyy-'13'-dd")).when(k == 5, "7").otherwise(day("yyyy-MM-dd"))
    kind = F.when(k == 5, "int").when(k == 4, "date").otherwise("string")
    docs = _fields(table(spark, d, "orders"), "due", _text("o_orderkey"), value, kind)
    return _reason(_run("property", docs, {"property": ["due"], "date": True}))


_TOKEN = "'\\[\\[([^\\]|]+)(?:\\|([^\\]]+))?\\]\\]'"


@query(
    f"""WITH {_PATHS}, {_LINKS}, v AS (SELECT CAST(link_id AS VARCHAR) AS path, '[[' || target || ']]' AS value FROM links),
t AS (SELECT path, unnest(CASE WHEN len(regexp_extract_all(value, {_TOKEN})) > 0 THEN regexp_extract_all(value, {_TOKEN}, 1) ELSE [trim(value)] END) AS target FROM v)
SELECT path, target FROM t WHERE target <> '' AND lower(target) NOT IN (SELECT {_KEY} FROM paths UNION SELECT {_STEM} FROM paths)"""
)
def property_wikilink(spark, d):
    """Link fields whose target is no file."""
    docs = _fields(links(spark, d), "source", _text("link_id"), F.concat(F.lit("[["), "target", F.lit("]]")), F.lit("string"))
    found = _run("property", docs, {"property": ["source"], "wikilink": {"resolve": "file_exists"}}, paths=page_paths(spark, d))
    return found.select("path", F.col("data")["Target"].alias("target"))


@query(f"WITH {_PAGES} SELECT path, f AS field FROM pages, unnest(['created', 'title']) AS u(f) WHERE path IS NOT NULL AND title IS NOT NULL AND f = 'created'")
def property_required(spark, d):
    """Required fields that pages with a title lack."""
    docs = _fields(pages(spark, d), "title", F.col("path"), F.col("title"), F.lit("string"))
    return _run("property", docs, {"property": ["created", "title"], "required": True}).select("path", F.col("data")["Key"].alias("field"))


@query(
    f"""WITH {_PAGES}, src AS (SELECT path, replace(body, chr(10) || '- ', chr(10) || '| [[a|b]] ') AS body FROM pages WHERE body IS NOT NULL AND path IS NOT NULL),
lines AS (SELECT path, i AS line, l[i] AS text, trim(l[i], ' ' || chr(9) || chr(13)) AS t FROM (SELECT path, string_split(body, chr(10)) AS l FROM src), unnest(generate_series(1, len(l))) AS s(i)),
rows AS (SELECT *, line - row_number() OVER (PARTITION BY path ORDER BY line) AS run FROM lines WHERE starts_with(t, '|')),
cut AS (SELECT *, regexp_replace(regexp_replace(t, '^\\|', ''), '\\|$', '') AS inside FROM rows),
sized AS (SELECT *, CASE WHEN inside = '' THEN 0 ELSE len(string_split(inside, '|')) END AS n FROM cut),
tables AS (SELECT *, count(*) OVER (PARTITION BY path, run) AS size, first_value(n) OVER (PARTITION BY path, run ORDER BY line) AS head FROM sized)
SELECT path, CAST(line AS INTEGER) AS line, CAST(head AS VARCHAR) AS expected, CAST(n AS VARCHAR) AS actual FROM tables WHERE size >= 2 AND regexp_matches(text, '\\[\\[[^\\]\\\\]+\\|[^\\]]+\\]\\]') AND NOT regexp_matches(text, '^\\s*\\|[\\s:]*-{{3,}}[\\s:]*\\|')"""
)
def table_pipes(spark, d):
    """Table rows with an unescaped pipe inside a link, list items of all pages being made table rows."""
    body = F.replace("body", F.lit("\n- "), F.lit("\n| [[a|b]] "))
    docs = pages(spark, d).where("body IS NOT NULL AND path IS NOT NULL").select("path", body.alias("body"), F.lit(1).alias("body_offset"))
    found = _run("table-wikilink-pipe", docs, {})
    return found.select("path", "line", F.col("data")["Expected"].alias("expected"), F.col("data")["Actual"].alias("actual"))


@query(
    """WITH v AS (SELECT CAST(doc_id AS VARCHAR) AS path, text, regexp_extract(text, '[0-9a-f]{10,}') AS v FROM documents WHERE text IS NOT NULL),
lines AS (SELECT path, v, i AS line, l[i] AS t FROM (SELECT path, v, string_split(text, chr(10)) AS l FROM v WHERE v <> ''), unnest(generate_series(1, len(l))) AS s(i)),
tokens AS (SELECT path, v, line, lower(unnest(regexp_extract_all(t, '[0-9A-Za-z_]+'))) AS t FROM lines)
SELECT path, CAST(line AS INTEGER) AS line, count(*) AS n FROM tokens WHERE regexp_matches(t, '^[0-9a-f]{7,}$') AND (starts_with(v, t) OR starts_with(t, v) OR (strlen(t) >= 12 AND contains(v, t)) OR (strlen(v) >= 12 AND contains(t, v))) GROUP BY path, line"""
)
def body_echoes(spark, d):
    """Lines of a body that echo a hash from the frontmatter."""
    value = F.nullif(F.regexp_extract("text", "[0-9a-f]{10,}", 0), F.lit(""))
    rows = table(spark, d, "documents").withColumn("v", value)
    docs = _fields(rows, "commit", _text("doc_id"), F.col("v"), F.lit("string")).join(rows.select(_text("doc_id").alias("path"), F.col("text").alias("body"), F.lit(1).alias("body_offset")), "path")
    return _run("body-value-echo", docs, {"fields": ["commit"]}).groupBy("path", "line").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_PATHS}, {_LINKS}, {_RESOLVE}, {_PAGES}, steps AS (SELECT DISTINCT page_path AS via, resolved AS path FROM links JOIN found USING (target) WHERE resolved IS NOT NULL),
roots AS (SELECT path AS root FROM pages WHERE page_id % 40 = 0 AND path IS NOT NULL),
one AS (SELECT DISTINCT root, s.path FROM roots JOIN steps s ON s.via = root), two AS (SELECT DISTINCT root, s.path FROM one o JOIN steps s ON s.via = o.path WHERE o.path <> root)
SELECT root, path, min(depth) AS depth FROM (SELECT root, root AS path, 0 AS depth FROM roots UNION ALL SELECT root, path, 1 FROM one UNION ALL SELECT root, path, 2 FROM two) GROUP BY root, path"""
)
def link_walk(spark, d):
    """Pages within two links of some roots, with the fewest steps to each."""
    item = F.struct(F.lit("").alias("original"), F.coalesce("target", F.lit("")).alias("target"), F.lit("").alias("fragment"), F.lit(False).alias("is_embed"), F.lit(1).alias("line"), F.lit(1).alias("col"))
    wide = links(spark, d).groupBy(F.col("page_path").alias("path")).agg(F.collect_list(item).alias("links"))
    roots = pages(spark, d).where("page_id % 40 = 0 AND path IS NOT NULL").select("path")
    return graph.walk(roots, Facts(wide), page_paths(spark, d), depth=2, max_nodes=1 << 40).groupBy("root", "path").agg(F.min("depth").alias("depth"))


@query(
    """WITH t AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, o_orderkey AS k FROM orders)
SELECT path, 'build' AS name, '[[#^b]]' AS ref, '' AS parts, CASE WHEN k % 4 = 0 THEN 'a,b' ELSE '' END AS args FROM t UNION ALL SELECT path, 'all', NULL, 'build,test' || (k % 3), '' FROM t WHERE k % 2 = 0"""
)
def task_table(spark, d):
    """Tasks that pages declare, with their parts and arguments."""
    k = F.col("o_orderkey")
    fields = [F.lit("[[#^b]]").alias("md-build"), F.when(k % 4 == 0, " a, b ,").alias("md-build-args"), F.when(k % 2 == 0, F.concat(F.lit("build, test"), _text(k % 3))).alias("md-all")]
    keys = F.array_compact(F.array(F.lit("md-build"), F.when(k % 4 == 0, F.lit("md-build-args")), F.when(k % 2 == 0, F.lit("md-all"))))
    docs = table(spark, d, "orders").select(_text(k).alias("path"), F.to_json(F.struct(*fields)).alias("fm"), keys.alias("fm_keys"), F.lit(False).alias("is_foreign"))
    joined = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return tasks.tasks(docs).select("path", "name", "ref", joined("parts").alias("parts"), joined("args").alias("args"))


@query(
    """WITH s AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, o_orderkey AS k FROM orders),
c AS (SELECT path, k % 2 = 0 AS pointed, CASE WHEN k % 3 = 0 THEN 'a' ELSE 'x' END <> 'a' AS moved, k % 4 <> 0 AS has_receipt, k % 5 = 0 AS tree, k % 7 = 0 AS proc FROM s)
SELECT path, CASE WHEN NOT pointed THEN 'inputs-only' WHEN NOT has_receipt THEN 'first' WHEN tree THEN 'tree' WHEN proc THEN 'procedure' ELSE 'inputs-only' END AS "case",
CASE WHEN pointed AND NOT has_receipt THEN '0,1' WHEN moved THEN '0' ELSE '' END AS written FROM c WHERE moved OR pointed AND (NOT has_receipt OR tree OR proc)"""
)
def attest_cases(spark, d):
    """What attesting pages would write, by the case they are."""
    k = F.col("o_orderkey")
    states = table(spark, d, "orders").select(
        _text(k).alias("path"), (k % 2 == 0).alias("pointed"), (k % 4 != 0).alias("has_receipt"), F.array(F.when(k % 3 == 0, "a").otherwise("x"), F.lit("b")).alias("recorded"), F.array(F.lit("a"), F.lit("b")).alias("computed"),
        F.when(k % 7 == 0, "q").otherwise("p").alias("recorded_procedure"), F.lit("p").alias("computed_procedure"), F.array(F.when(k % 5 == 0, "s").otherwise("t")).alias("recorded_sums"), F.array(F.lit("t")).alias("computed_sums"),
    )
    return attest.classify(states).select("path", "case", F.array_join(F.col("write").cast("array<string>"), ",").alias("written"))


@query("SELECT rule_id || ' at ' || file_path || ':' || coalesce(message, '') || '!' AS message, count(*) AS n FROM findings_fresh GROUP BY ALL")
def messages(spark, d):
    """Messages from templates."""
    data = F.create_map(F.lit("Rule"), F.col("rule_id"), F.lit("Path"), F.col("file_path"), F.lit("Text"), F.coalesce("message", F.lit("")))
    return table(spark, d, "findings_fresh").select(column("{{.Rule}} at {{.Path}}:{{.Text}}!", data).alias("message")).groupBy("message").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_CACHED} SELECT CAST('0x' || left(sha256(path), 2) AS INTEGER) AS shard, count(*) AS entries, CAST(sum(CASE WHEN page_id % 11 = 0 THEN length + 1 ELSE length END) AS BIGINT) AS bytes FROM held GROUP BY 1")
def cache_inventory(spark, d):
    """Entries and bytes of each shard of the cache."""
    return cache.inventory(_cached(spark, d)[0].withColumn("shard", C.shard(F.col("path"))))


@query(
    """WITH r AS (SELECT n_name AS id, CASE n_nationkey % 3 WHEN 0 THEN 'pattern' WHEN 1 THEN 'pattern' ELSE 'probe' END AS chk, CASE WHEN n_nationkey % 8 = 0 THEN 'off' ELSE 'warn' END AS sev, n_regionkey % 2 AS t, n_nationkey % 4 AS m, n_nationkey AS k FROM nation)
SELECT a.id AS rule_a, b.id AS rule_b, 'target' || a.t AS target, 'warn' AS severity FROM r a JOIN r b ON a.k < b.k AND a.t = b.t AND a.m <> b.m AND a.chk = 'pattern' AND b.chk = 'pattern' AND a.sev <> 'off' AND b.sev <> 'off'"""
)
def rule_conflicts(spark, d):
    """Rules that one page could meet and that ask for different things."""
    k = F.col("n_nationkey")
    rules = table(spark, d, "nation").select(
        k.alias("pos"), F.col("n_name").alias("id"), F.lit("**").alias("glob"), F.when(k % 3 == 2, "probe").otherwise("pattern").alias("check"), F.when(k % 8 == 0, "off").otherwise("warn").alias("severity"), F.concat(F.lit("target"), _text(F.col("n_regionkey") % 2)).alias("target"), _text(k % 4).alias("match"),
    )
    return reports.conflicts(reports.overlaps(rules), rules)


@query(
    f"""WITH {_PAGES}, a AS (SELECT path, coalesce(size_bytes, 0) AS l, coalesce(mtime_ns, 0) AS m, page_id AS k FROM pages WHERE path IS NOT NULL),
b AS (SELECT path, CASE WHEN k % 5 = 0 THEN l + 1 ELSE l END AS l, CASE WHEN k % 7 = 0 THEN m - 1 ELSE m END AS m FROM a WHERE k % 11 <> 0 UNION ALL SELECT 'old/' || path, l, m FROM a WHERE k % 13 = 0)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'create' WHEN a.path IS NULL THEN 'delete' ELSE 'modify' END AS op FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.l <> b.l OR a.m <> b.m"""
)
def listing_changes(spark, d):
    """Changes between two listings of a corpus."""
    k = F.col("page_id")
    after = pages(spark, d).where("path IS NOT NULL").select("path", F.coalesce("size_bytes", F.lit(0)).alias("length"), F.coalesce("mtime_ns", F.lit(0)).alias("mtime_ns"), "page_id")
    length, mtime = F.when(k % 5 == 0, F.col("length") + 1).otherwise(F.col("length")), F.when(k % 7 == 0, F.col("mtime_ns") - 1).otherwise(F.col("mtime_ns"))
    before = after.where(k % 11 != 0).select("path", length.alias("length"), mtime.alias("mtime_ns")).unionByName(after.where(k % 13 == 0).select(F.concat(F.lit("old/"), "path").alias("path"), "length", "mtime_ns"))
    return watch.snapshot_changes(before, after, "2025-01-01").select("path", "op")
