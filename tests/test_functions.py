import re

import pytest
from pyspark.sql import functions as F

from quillmere.functions import columns as C
from quillmere.functions import templates, uris
from quillmere.functions.globs import check_glob, glob_regex, java_regex


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "glob,path,hit",
    [
        ("**", "a/b.md", True), ("*.md", "a/b.md", False), ("**/*.md", "b.md", True), ("a/**/c.md", "a/c.md", True), ("a/**/c.md", "a/x/y/c.md", True), ("a/?.md", "a/b.md", True),
        ("{a,b}/*", "b/x", True), ("[ab]/x", "c/x", False), ("[!ab]/x", "c/x", True), ("a.b", "axb", False), ("wiki/**", "wiki/", True),
    ],
)
def test_globs(glob, path, hit):
    assert bool(re.match(glob_regex(glob), path)) == hit


def test_bad_patterns():
    with pytest.raises(ValueError):
        java_regex("(?=x)")
    with pytest.raises(ValueError):
        check_glob("[b-a]x/**")
    assert re.search(java_regex(r"\bcafe\b"), "x cafe y")


def test_paths_and_links(spark):
    assert one(spark, C.ancestors(F.col("p")), p="a/b/c.md") == ["a", "a/b"] and one(spark, C.ancestors(F.col("p")), p="c.md") == []
    assert one(spark, C.suffixes(F.col("p")), p="a/b") == ["b", "a/b"]
    assert one(spark, C.link_target(F.col("p")), p=" a/b\\#x ") == "a/b" and one(spark, C.link_fragment(F.col("p")), p="a# x ") == "x"
    for path, skip, hit in (("a/.git/x.md", [".git"], True), ("b/c/x.md", ["c/"], False), ("c/d/x.md", ["c/d"], True), ("c/de/x.md", ["c/d"], False)):
        assert one(spark, C.skipped(F.col("p"), skip), p=path) == hit
    assert one(spark, C.in_scope(F.col("p"), "a/b"), p="a/b.md") and not one(spark, C.in_scope(F.col("p"), "a/b"), p="a/bc.md")


def test_selector(spark):
    df = spark.createDataFrame([("a/x.md", ["t", None]), ("a/y.md", [None]), ("a/z.md", None), ("b/x.md", ["t"])], "p string, tags array<string>")
    hit = lambda *on: sorted(r.p for r in df.where(C.selector(F.col("p"), F.col("tags"), list(on))).collect())
    assert hit("a/**") == ["a/x.md", "a/y.md", "a/z.md"] and hit("#t") == ["a/x.md", "b/x.md"] and hit("!#t") == ["a/y.md", "a/z.md"]
    assert hit("a/**", "b/**", "#t", "!b/x.md") == ["a/x.md"] and hit() == ["a/x.md", "a/y.md", "a/z.md", "b/x.md"]


def test_dates(spark):
    for path, kind, value in (("x/2024/02/30/a.md", None, None), ("x/2024/12/30/a.md", "daily", "2024-12-30"), ("2025-W01/a.md", "weekly", "2025-W01"), ("2025-W54/a.md", None, None), ("x/2024/02/a.md", "monthly", "2024-02"), ("year=2024/month=02/a.md", None, None)):
        k, v = C.path_date(F.col("p"))
        assert (one(spark, k, p=path), one(spark, v, p=path)) == (kind, value)
    assert one(spark, C.iso_week(C.parse_date(F.col("p"))), p="2024-12-30") == "2025-W01"
    assert one(spark, C.parse_date(F.col("p")), p="2024-02-30") is None and one(spark, C.parse_date(F.col("p")), p="2024-02-03T04:05:06Z") is not None
    assert one(spark, C.age_days(C.parse_date(F.lit("2024-01-10T12:00:00")), C.parse_date(F.lit("2024-01-03")))) == 7


def test_hashes_and_comparisons(spark):
    assert one(spark, C.blob_sha(F.col("p")), p="hello\n") == "ce013625030ba8dba906f756967f9e9ca394464a"
    for r, c, hit in (("sha256:AB12cd34", "sha256:ab12cd34ff", True), ("ab12cd3", "sha256:ab12cd3f", False), ("", "x", False), ("zz12cd34", "zz12cd34ff", False)):
        assert one(spark, C.recorded_matches(F.col("r"), F.col("c")), r=r, c=c) == hit
    assert one(spark, C.mask(F.col("p")), p="0123456789") == "01234567…" and one(spark, C.mask(F.col("p")), p="01234567") == "01234567"
    assert [one(spark, C.tier_level(F.col("p")), p=x) for x in (" Secret ", "public", "odd")] == [3, 0, -1]
    for url in ("git@Host.X:o/r.git", "https://u@host.x:8443/o/r/", "host.x/o/r#frag", "ssh://git@HOST.x/o/r.git"):
        assert one(spark, C.git_url(F.col("p")), p=url) == "host.x/o/r"


def test_templates(spark):
    data = F.create_map(F.lit("A"), F.lit("x/pre-name.md"))
    for template, out in (("v {{.A}}!", "v x/pre-name.md!"), ("{{.A | base | trimSuffix \".md\"}}", "pre-name"), ("{{ .A | dir }}", "x"), ("{{.B}}", "<no value>"), ("plain", "plain"), ("{{base .A}}", "pre-name.md")):
        assert templates.render(template, {"A": "x/pre-name.md"}) == out
        assert one(spark, templates.column(template, data)) == out
    with pytest.raises(ValueError):
        templates.parse("{{if .A}}x{{end}}")


def test_uris():
    ref = uris.Ref("my wiki", "a/b#c.md", "^blk")
    assert uris.uri(ref) == "obsidian://advanced-uri?vault=my%20wiki&filepath=a/b%23c.md&block=blk"
    assert uris.parse(uris.uri(ref)) == (ref, [])
    assert uris.parse("wiki://s/p@abc") == (uris.Ref("s", "p", "", "abc"), [])
    assert uris.parse("obsidian://open?vault=s&file=a+b")[1] == ["uri-encoding"]
    assert uris.parse("[wiki://s/q](obsidian://open?vault=s&file=p)")[1] == ["display-drift"]
    assert uris.nav_link(uris.Ref("s", "p"), "a]b") == "[a\\]b](obsidian://open?vault=s&file=p)"
    for bad in ("x", "wiki://s", "obsidian://open", "obsidian://x?vault=a&file=b"):
        with pytest.raises(uris.UriError):
            uris.parse(bad)
