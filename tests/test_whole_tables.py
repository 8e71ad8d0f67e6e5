"""Queries over whole tables, on small tables with fences, code spans and any script."""

from collections import Counter

import pytest

from quillmere import catalogue
from quillmere.operators import reports as R

FENCED = """# One

```
# not a heading [[in-fence]]
| a |
| b |
```

### Deep [[kept]] and `[[in-code]]` and [[kept#part|shown]]

~~~~
~~~
# still inside [[in-tildes]]
~~~~

| x | [[cell]] |
|---|---|
# Two"""
SPANS = """# Top
A `span` and [[after-span]].
## Next"""
BODIES = {1: FENCED, 2: SPANS, 3: "# Plain\n[[plain]]\n### Jump\n| a |\n| b |", 4: None}


@pytest.fixture(scope="module")
def wiki(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, f"wiki/{i}.md", f"t{i}", [], body, [], len(body or ""), i, "2024-01-01", i) for i, body in BODIES.items()]
    columns = "page_id long, path string, title string, tags array<string>, body string, lint_ignore array<string>, size_bytes long, mtime_ns long, created_at string, scanned_at long"
    spark.createDataFrame(rows, columns).write.parquet(f"{d}/wiki_pages.parquet")
    return d


def rows(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_links_of_pages_with_code(spark, wiki):
    got = rows(catalogue.QUERIES["fact_links"](spark, wiki), "path", "target", "n")
    assert got == Counter([("wiki/1.md", "kept", 2), ("wiki/1.md", "cell", 1), ("wiki/2.md", "after-span", 1), ("wiki/3.md", "plain", 1)])


def test_headings_of_pages_with_fences(spark, wiki):
    got = rows(catalogue.QUERIES["fact_headings"](spark, wiki), "path", "line", "level")
    assert got == Counter([("wiki/1.md", 1, 1), ("wiki/1.md", 9, 3), ("wiki/1.md", 18, 1), ("wiki/2.md", 1, 1), ("wiki/2.md", 3, 2), ("wiki/3.md", 1, 1), ("wiki/3.md", 3, 3)])


def test_jumps_of_pages_with_fences(spark, wiki):
    spark.createDataFrame([(1, "# a\n```\n# b\n```\n### c"), (2, None)], "doc_id long, text string").write.mode("overwrite").parquet(f"{wiki}/documents.parquet")
    got = rows(catalogue.QUERIES["heading_jumps"](spark, wiki), "path", "line", "issue")
    assert got == Counter([("p1", 9, "skipped level"), ("p1", 18, "multiple H1"), ("p3", 3, "skipped level"), ("d1", 5, "skipped level")])


def test_tables_of_pages_with_fences(spark, wiki):
    got = rows(catalogue.QUERIES["table_islands"](spark, wiki), "page_id", "first", "last", "size")
    assert got == Counter([(1, 5, 6, 2), (1, 16, 17, 2), (3, 4, 5, 2)])


def test_overlap_classes_stand_for_all_pairs(spark):
    globs = ["a/**", "a/b/*.md", "b/*", "**/*.md", "*/x.md", "", None, "b/c", "c/**"]
    rules = spark.createDataFrame([(i, i, g) for i, g in enumerate(globs)], "pos long, id long, glob string")
    classes = R.overlap_classes(rules).collect()
    pairs = {(a.id, b.id) for a in classes for b in classes if a.id < b.id and (a.wide or b.wide or a.top == b.top)}
    assert pairs == {tuple(r) for r in R.overlaps(rules).collect()}
    assert {c.id: c.n_meets for c in classes} == {i: sum(i in p for p in pairs) for i in range(len(globs))}


def test_rules_of_the_whole_table(spark, sf):
    assert catalogue.QUERIES["rule_overlap_classes"](spark, sf).count() == spark.read.parquet(f"{sf}/part.parquet").count()


def test_nearest_of_tags_in_any_script(spark, tmp_path):
    tags = ["t\u00fdpe/a", "st\u00e4t\u00fcs/b", "\u00e9\u00e9\u00e9\u00e9/c", "topics/d", None]
    columns = "page_id long, path string, title string, tags array<string>, body string, lint_ignore array<string>, size_bytes long, mtime_ns long, created_at string, scanned_at long"
    spark.createDataFrame([(1, "wiki/1.md", "t", tags, "", [], 0, 0, "", 1)], columns).write.parquet(f"{tmp_path}/wiki_pages.parquet")
    got = {r.key: r.nearest for r in catalogue.QUERIES["nearest_param"](spark, str(tmp_path)).collect()}
    assert got == {"t\u00fdpe": "type", "st\u00e4t\u00fcs": "status", "\u00e9\u00e9\u00e9\u00e9": None, "topics": "topic"}
