"""Tasks that pages declare: the table of them, their contracts, compositions and inheritance. Nothing is run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.operators.graph import blurbs

# The prefix of task keys, what contract keys end in, and how far a composition may fan out.
PREFIX = "md-"
CONTRACTS = "args|env|params"
MAX_LEAVES = 256


def declared(documents: DataFrame) -> DataFrame:
    """``(path, name, contract, ref, parts)`` of every task key; a contract key has its kind and its base's name.

    A value in brackets is a reference to a block, any other a list of names by commas.
    """
    fm = F.from_json("fm", "map<string,string>")
    keys = documents.where(~F.col("is_foreign")).select("path", F.col("fm"), F.explode("fm_keys").alias("key")).where(F.startswith("key", F.lit(PREFIX)) & (F.length("key") > len(PREFIX)))
    value = F.trim(F.try_element_at(fm, F.col("key")))
    named = F.regexp_replace("key", f"^{PREFIX}", "")
    kind = F.regexp_extract(named, rf"^.+-({CONTRACTS})$", 1)
    parts = F.filter(F.transform(F.split("value", ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = keys.select("path", value.alias("value"), F.when(kind != "", F.regexp_replace(named, rf"-(?:{CONTRACTS})$", "")).otherwise(named).alias("name"), F.when(kind != "", kind).alias("contract"))
    is_ref = F.startswith("value", F.lit("[["))
    return rows.select("path", "name", "contract", F.when(is_ref, F.col("value")).alias("ref"), F.when(~is_ref, parts).alias("parts"))


def tasks(documents: DataFrame) -> DataFrame:
    """``(path, name, ref, parts, args, env, params)``: tasks with the contracts on their names."""
    rows = declared(documents)
    pick = lambda kind: F.max(F.when(F.col("contract") == kind, F.col("parts"))).alias(kind)
    contracts = rows.where("contract IS NOT NULL").groupBy("path", "name").agg(pick("args"), pick("env"), pick("params"))
    return rows.where("contract IS NULL").select("path", "name", "ref", "parts").join(contracts, ["path", "name"], "left")


def contract_errors(documents: DataFrame) -> DataFrame:
    """``(path, name, error)``: contracts without a task or on a composition, and empty values."""
    rows = declared(documents)
    base = rows.where("contract IS NULL").select("path", "name", F.col("ref").alias("base_ref"), F.lit(True).alias("there"))
    joined = rows.where("contract IS NOT NULL").join(base, ["path", "name"], "left")
    error = F.when(F.col("there").isNull(), "contract without a task").when(F.col("base_ref").isNull(), "contract on a composition").when(F.size("parts") == 0, "empty contract")
    bad = joined.select("path", "name", error.alias("error"))
    empty = rows.where("contract IS NULL AND ref IS NULL AND size(parts) = 0").select("path", "name", F.lit("empty task").alias("error"))
    return bad.unionByName(empty).where("error IS NOT NULL")


def expand(table: dict[str, list[str] | None], names: list[str]) -> list[str]:
    """Leaves of the named tasks of one page in order; ``table`` has None for a leaf. Cycles, unknown names and too many leaves raise ValueError."""
    out: list[str] = []

    def add(name: str, above: tuple[str, ...]) -> None:
        if name not in table:
            raise ValueError(f"unknown task {name!r}, available: {', '.join(sorted(table))}")
        parts = table[name]
        if parts is None:
            if len(out) >= MAX_LEAVES:
                raise ValueError(f"more than {MAX_LEAVES} leaves")
            out.append(name)
        elif name in above:
            raise ValueError(f"composition cycle through task {name!r}")
        else:
            for part in parts:
                add(part, (*above, name))

    for name in names:
        add(name, ())
    return out


def inherited(pages: DataFrame, table: DataFrame) -> DataFrame:
    """``(path, name, holder)``: each task a page can run and the page that gives it, its own or the nearest blurb."""
    tries = pages.select("path", F.posexplode(F.concat(F.array("path"), blurbs(F.col("path")))).alias("rank", "holder"))
    return tries.join(table.select(F.col("path").alias("holder"), "name"), "holder").groupBy("path", "name").agg(F.min_by("holder", "rank").alias("holder"))


def repo_catalog(documents: DataFrame) -> DataFrame:
    """``(slug, path, remote, commit, branch)`` of catalogued repositories: in each folder below sources/git the page of type repo, '<SLUG>.md' first."""
    fm = F.from_json("fm", "map<string,string>")
    value = lambda k: F.coalesce(F.trim(F.try_element_at(fm, F.lit(k))), F.lit(""))
    slug = F.regexp_extract("path", r"(?:^|/)sources/git/([^/]+)/[^/]+\.md$", 1)
    rows = documents.select("path", slug.alias("slug"), value("type").alias("type"), value("remote").alias("remote"), value("commit").alias("commit"), value("branch").alias("branch")).where("slug <> '' AND type = 'repo'")
    first = F.struct(~F.endswith("path", F.concat(F.lit("/"), F.upper("slug"), F.lit(".md"))), "path")
    return rows.groupBy("slug").agg(F.min_by(F.struct("path", "remote", "commit", "branch"), first).alias("r")).select("slug", "r.*")
