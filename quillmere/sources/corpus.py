"""Reading a tree of pages: files, the documents parsed from them, and the universe of paths."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmere.functions import columns as C
from quillmere.functions import markdown as M

#: Directories that are never read, unless others are named.
SKIP = [".git", ".obsidian", "node_modules"]
RAW = "path string, length long, mtime_ns long, content string"
DOCUMENT = (
    "path string, length long, mtime_ns long, content string, has_fm boolean, fm_error boolean, fm string, fm_keys array<string>, fm_kinds map<string,string>, tags array<string>, body string, body_offset int,"
    " lint_ignore array<string>, inline_suppress array<struct<line:int,rule_id:string>>, is_foreign boolean, long_line boolean"
)


def read_tree(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """``(path, length, mtime_ns, content)`` of a directory's pages, paths relative to it; or of the listed ones only.

    A scope on length or path reaches the file listing; content is read for the rest alone.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md")
    base = root.rstrip("/")
    df = files.load([f"{base}/{p}" for p in paths] if paths else base)
    relative = F.regexp_replace(F.col("path"), f"^(?:file:)?/*{'/' if base.startswith('/') else ''}{_quoted(base.lstrip('/'))}/", "")
    return df.select(relative.alias("path"), "length", (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.decode("content", "UTF-8").alias("content"))


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\.+*?()[]{}^$|" else c for c in text)


def from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A corpus in memory from (path, content) or (path, content, mtime_ns)."""
    data = [(r[0], len(r[1].encode()), r[2] if len(r) > 2 else 0, r[1]) for r in rows]
    return spark.createDataFrame(data, RAW)


def paths(spark: SparkSession, root: str, skip: list[str] = SKIP) -> DataFrame:
    """``(path)`` of all link targets, '.md' and '.base', by listing alone."""
    base = root.rstrip("/")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    relative = F.regexp_replace(F.col("path"), f"^(?:file:)?/*{'/' if base.startswith('/') else ''}{_quoted(base.lstrip('/'))}/", "")
    return df.select(relative.alias("path")).where((F.endswith("path", F.lit(".md")) | F.endswith("path", F.lit(".base"))) & ~C.skipped(F.col("path"), skip))


def scan(raw: DataFrame, skip: list[str] = SKIP, max_size: int = 0, foreign_roots: list[str] = (), scope: str = ".", max_line: int = M.MAX_LINE) -> DataFrame:
    """Documents: one row per page, parsed once.

    Pruned directories, pages over ``max_size`` and pages outside ``scope`` are left out before content
    is touched. Pages below a foreign root are kept and marked. Frontmatter values are JSON, with the
    kind of each in ``fm_kinds``, so that null, missing and dated values differ. A page with a line of
    more than ``max_line`` characters (0: no limit) is kept without body and fields, and ``long_line`` tells.
    """
    path = F.col("path")
    kept = raw.where(F.endswith(path, F.lit(".md")) & ~C.skipped(path, skip) & C.in_scope(path, scope))
    if max_size:
        kept = kept.where(F.col("length") <= max_size)
    parsed = kept.mapInPandas(partial(_parse, max_line), DOCUMENT)
    foreign = F.lit(False)
    for root in foreign_roots:
        foreign = foreign | F.startswith(path, F.lit(root.rstrip("/") + "/"))
    return parsed.withColumn("is_foreign", foreign)


def _parse(max_line: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for path, length, mtime_ns, content in frame[["path", "length", "mtime_ns", "content"]].itertuples(index=False):
            content = content or ""
            fm = M.parse_frontmatter(content, max_line)
            lines, whole = M.suppressions(fm.body, fm.body_offset)
            ignored = M.string_list(fm.values.get("lint-ignore")) + whole
            tags = M.string_list(fm.values["tags"], scalar=False) if isinstance(fm.values.get("tags"), list) else None
            rows.append(
                (
                    path, length, mtime_ns, content, fm.present, fm.error, M.to_json(fm.values), list(fm.values), {k: M.yaml_kind(v) for k, v in fm.values.items()}, tags, fm.body, fm.body_offset, ignored,
                    [{"line": n, "rule_id": r} for n, found in sorted(lines.items()) for r in sorted(found)], False, fm.long_line,
                )
            )
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in ["path", "length", "mtime_ns", "content", "has_fm", "fm_error", "fm", "fm_keys", "fm_kinds", "tags", "body", "body_offset", "lint_ignore", "inline_suppress", "is_foreign", "long_line"]])


def skip_shadows(universe: DataFrame, skip: list[str]) -> DataFrame:
    """Bare skip entries that hide directories of the same name deeper down: ``(name, examples, n)``, three examples at most."""
    names = [s for s in skip if "/" not in s]
    dirs = universe.select(F.explode(C.ancestors(F.col("path"))).alias("dir")).distinct().withColumn("name", C.base(F.col("dir"))).where(F.col("name").isin(names) if names else F.lit(False))
    deep = F.contains("dir", F.lit("/"))
    counts = dirs.groupBy("name").agg(F.max(~deep).alias("top"), F.count(F.when(deep, 1)).cast("int").alias("n")).where("top AND n > 0")
    # at most three rows of a name are kept, before the shuffle too
    first = dirs.where(deep).withColumn("rank", F.row_number().over(W.partitionBy("name").orderBy("dir"))).where("rank <= 3").groupBy("name").agg(F.array_sort(F.collect_list("dir")).alias("shown"))
    more = F.when(F.col("n") > 3, F.concat(F.lit(", +"), (F.col("n") - 3).cast("string"), F.lit(" more"))).otherwise("")
    return counts.join(first, "name").select("name", F.concat(F.array_join("shown", ", "), more).alias("examples"), "n")
