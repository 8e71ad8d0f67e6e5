"""Queries of this subpackage over the test tables, and their SQL where SQL can state them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm import bpe, neardup, packing, pii, terms
from quillmere.session import stage


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.found(_t(spark, d, "wiki_pages"), _t(spark, d, "domain_counts"))


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked_terms(_t(spark, d, "wiki_pages"), _t(spark, d, "domain_counts"))


#: Similarity of page bodies, by runs of three words, and of page slices.
P2_THRESHOLD = 0.5


def _similar_pages(spark: SparkSession, d: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    pages = _t(spark, d, "wiki_pages").select(F.col("page_id").alias("id"), F.col("body").alias("payload"), F.unix_micros(F.col("scanned_at").cast("timestamp")).alias("version"))
    slices = _t(spark, d, "page_slices").where("kind <> 'body' AND slice_hash IS NOT NULL").select(F.col("page_id").alias("id"), F.xxhash64("slice_hash").alias("h")).distinct()
    slices = slices.groupBy("id").agg(F.collect_list("h").alias("payload")).withColumn("version", F.lit(0).cast("long"))
    slices = stage(slices, "slices")
    return {"body": neardup.similar(pages, neardup.shingles, P2_THRESHOLD, "body"), "slices": neardup.similar(slices, neardup.listed, P2_THRESHOLD, "slices")}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        neardup.expanded(members, pairs).select(F.lit(facet).alias("facet"), F.col("id_a").alias("page_id_a"), F.col("id_b").alias("page_id_b"))
        for facet, (members, pairs) in _similar_pages(spark, d).items()
    ]
    return reduce(DataFrame.unionByName, parts)


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each page's class of equal sets, its links to other classes, and the group it is linked to."""
    parts = []
    for facet, (members, pairs) in _similar_pages(spark, d).items():
        ends = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
        nodes = members.select(F.col("class_id").alias("id")).distinct()
        groups = neardup.components(nodes, pairs, facet).withColumnRenamed("id", "class_id")
        joined = members.join(ends, "class_id", "left").join(groups, "class_id")
        parts.append(joined.select(F.lit(facet).alias("facet"), F.col("id").alias("page_id"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "group_id"))
    return reduce(DataFrame.unionByName, parts)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_column(_t(spark, d, "documents"))


#: Tokens a container holds.
P7_CAPACITY = 2048


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = bpe.count_column(_t(spark, d, "documents"))
    return packing.pack(sizes, "doc_id", "n_tokens", P7_CAPACITY).withColumnRenamed("id", "doc_id")


def p7_plan(spark: SparkSession, d: str) -> DataFrame:
    """Containers, the bound below which no packing can go, and whether the packing is known to be best."""
    return packing.summary(bpe.count_column(_t(spark, d, "documents")), "n_tokens", P7_CAPACITY)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    documents = _t(spark, d, "documents")
    return pii.found(documents, pii.fit_model(documents, _t(spark, d, "known_names")))


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    documents = _t(spark, d, "documents")
    return pii.redacted(documents, pii.fit_model(documents, _t(spark, d, "known_names")))


QUERIES = {"p1_found": p1_found, "p1_terms": p1_terms, "p2_found": p2_found, "p2_groups": p2_groups, "p6_ids": p6_ids, "p7_packed": p7_packed, "p7_plan": p7_plan, "p8_found": p8_found, "p8_redacted": p8_redacted}

_P1 = """
WITH rows AS (
  SELECT 'tags' AS field, page_id AS record, lower(CASE WHEN starts_with(b, '#') THEN substr(b, 2) ELSE b END) AS term, 1 AS weight
  FROM (SELECT page_id, trim(unnest(tags), ' ' || chr(9) || chr(160)) AS b
        FROM (SELECT page_id, arg_max(tags, scanned_at) AS tags FROM wiki_pages WHERE tags IS NOT NULL GROUP BY page_id))
  UNION ALL
  SELECT 'counts', scan_id, lower(trim(prefix, ' ' || chr(9) || chr(160))) || '/' || lower(trim(value, ' ' || chr(9) || chr(160))), cnt
  FROM (SELECT DISTINCT * FROM domain_counts)
  WHERE trim(prefix, ' ' || chr(9) || chr(160)) <> '' AND trim(value, ' ' || chr(9) || chr(160)) <> ''
), terms AS (
  SELECT field, term, row_number() OVER (ORDER BY field, term) - 1 AS term_id, CAST(sum(weight) AS BIGINT) AS occurrences, count(DISTINCT record) AS records FROM rows WHERE term <> '' GROUP BY field, term
), marked AS (
  SELECT field, term, term_id, occurrences, records,
    CASE field WHEN 'tags' THEN records ELSE occurrences END <= 2 AS is_rare,
    CASE field WHEN 'tags' THEN records * 20 >= (SELECT count(DISTINCT page_id) FROM wiki_pages)
               ELSE records * 2 >= (SELECT count(DISTINCT scan_id) FROM domain_counts) END AS is_common
  FROM terms
)
"""

_P2 = """
WITH bodies AS (SELECT page_id, arg_max(body, scanned_at) AS body FROM wiki_pages WHERE body IS NOT NULL GROUP BY page_id),
words AS (SELECT page_id, regexp_extract_all(lower(body), '[\\p{L}\\p{N}]+') AS w FROM bodies),
sets AS (
  SELECT DISTINCT 'body' AS facet, page_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS token FROM words, unnest(generate_series(1, len(w) - 2)) AS s(i) WHERE len(w) >= 12
  UNION ALL SELECT DISTINCT 'slices', page_id, slice_hash FROM page_slices WHERE kind <> 'body' AND slice_hash IS NOT NULL),
sizes AS (SELECT facet, page_id, count(*) AS n FROM sets GROUP BY facet, page_id),
shared AS (SELECT a.facet, a.page_id AS page_id_a, b.page_id AS page_id_b, count(*) AS common FROM sets a JOIN sets b ON a.facet = b.facet AND a.token = b.token AND a.page_id < b.page_id GROUP BY ALL)
"""

_P2_PAIRS = """SELECT s.facet, page_id_a, page_id_b FROM shared s JOIN sizes x ON x.facet = s.facet AND x.page_id = page_id_a JOIN sizes y ON y.facet = s.facet AND y.page_id = page_id_b
WHERE 2 * common >= x.n + y.n - common
"""

_P2_GROUPS = f""", pairs AS ({_P2_PAIRS}),
prints AS (SELECT facet, page_id, md5(string_agg(token, chr(1) ORDER BY token)) AS print FROM sets GROUP BY facet, page_id),
members AS (SELECT facet, page_id, min(page_id) OVER (PARTITION BY facet, print) AS class_id FROM prints),
classes AS (SELECT facet, page_id AS id FROM members WHERE page_id = class_id),
links AS (SELECT facet, page_id_a AS a, page_id_b AS b FROM pairs UNION ALL SELECT facet, page_id_b, page_id_a FROM pairs),
ends AS (SELECT l.* FROM links l JOIN classes x ON x.facet = l.facet AND x.id = a JOIN classes y ON y.facet = l.facet AND y.id = b),
reach AS (SELECT facet, id AS start, id AS here FROM classes UNION SELECT r.facet, r.start, e.b FROM reach r JOIN ends e ON e.facet = r.facet AND e.a = r.here),
tops AS (SELECT facet, start, min(here) AS group_id FROM reach GROUP BY facet, start), counts AS (SELECT facet, a, count(*) AS n FROM ends GROUP BY facet, a)
SELECT m.facet, m.page_id, m.class_id, coalesce(n, 0) AS n_links, group_id FROM members m JOIN tops t ON t.facet = m.facet AND t.start = m.class_id LEFT JOIN counts c ON c.facet = m.facet AND c.a = m.class_id
"""

SQL = {
    "p2_found": _P2 + _P2_PAIRS,
    "p2_groups": _P2.replace("WITH ", "WITH RECURSIVE ", 1) + _P2_GROUPS,
    "p1_found": _P1 + "SELECT field, term, 'rare' AS mark FROM marked WHERE is_rare UNION ALL SELECT field, term, 'common' FROM marked WHERE is_common",
    "p1_terms": _P1 + "SELECT * FROM marked",
}
