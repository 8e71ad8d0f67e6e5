"""Attestation as tables: page states, gates, hashes, origins and cases give a report, and that a plan of pages to write.

Results of checks, the objects of repositories and their history come as tables; nothing is run and
nothing is written here.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions import columns as C
from quillmere.functions import markdown as M
from quillmere.operators import graph, property_blocks
from quillmere.operators.facts import Facts
from quillmere.operators.pins import World
from quillmere.operators.rewrites import PLAN
from quillmere.session import stage

EFFECT = "type/effect"
# The keys of a receipt, in the order in which they are written, and its frontmatter pointer.
RECEIPT_KEYS = ["commit", "checksum", "applied_at", "verdict", "procedure-hash"]
RECEIPT_POINTER = "receipt: '[[#^receipt]]'"


@dataclass
class Corpus:
    """What attestation looks at: documents, their facts, the universe of paths, the repositories, and which repository is the corpus's own."""

    documents: DataFrame
    facts: Facts
    paths: DataFrame
    world: World
    owned_repo: str = ""


def page_states(c: Corpus, scope: str = ".") -> DataFrame:
    """A row for each effect page in scope: what its pin and its inputs say, and ``skip`` or ``problem`` where it can't be attested."""
    effects = c.documents.where(~F.col("is_foreign") & C.in_scope(F.col("path"), scope) & F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), EFFECT)).select("path", "fm_error")
    recorded = c.facts.wide.select("path", F.size("chain").alias("n_inputs"), F.col("procedure_hash").alias("recorded_procedure"))
    s = effects.join(c.facts.pins.drop("tags"), "path", "left").join(recorded, "path")
    for flag in ("has_fm_commit", "has_inputs", "has_receipt_key", "receipt_null", "receipt_block"):
        s = s.withColumn(flag, F.coalesce(flag, F.lit(False)))
    skip = F.when(F.col("has_fm_commit"), F.when(F.col("has_inputs"), "transitional shape").otherwise("legacy shape"))
    problem = (
        F.when(F.col("fm_error"), "frontmatter can't be read")
        .when(~F.col("has_inputs"), "no inputs")
        .when(F.col("n_inputs") == 0, "inputs are empty")
        .when(F.col("has_receipt_key") & ~F.col("receipt_null") & ~F.col("receipt_block"), "receipt has no block")
    )
    none = F.array().cast("array<string>")
    return s.select(
        "path", skip.alias("skip"), F.when(skip.isNull(), problem).alias("problem"), F.col("has_receipt_key").alias("pointed"), F.col("receipt_block").alias("has_receipt"), F.coalesce("repo", F.lit("")).alias("repo"),
        F.coalesce("branch", F.lit("")).alias("branch"), F.coalesce("locations", none).alias("locations"), F.coalesce("commit", F.lit("")).alias("recorded_commit"), F.coalesce("checksums", none).alias("recorded_sums"), "recorded_procedure",
    )


def inputs(c: Corpus, states: DataFrame) -> DataFrame:
    """``(path, recorded, computed, sources, input_problem)``: the hashes of each page's inputs in order, and the first that can't be had."""
    chain = c.facts.chain.join(states.select("path"), "path", "left_semi").withColumnRenamed("hash", "recorded")
    e = graph.input_hashes(chain, c.facts, c.paths, c.owned_repo)
    bad = F.when(F.col("problem").isNotNull(), F.concat(F.lit("input "), (F.col("pos") + 1).cast("string"), F.lit(" "), "ref", F.lit(": "), "problem"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "recorded", "computed", "node", bad.alias("bad"))))
    pick = lambda name: F.transform("l", lambda x: x[name])
    first = F.element_at(F.concat(F.filter(pick("bad"), lambda x: x.isNotNull()), F.array(F.lit(None).cast("string"))), 1)
    return e.groupBy("path").agg(listed.alias("l")).select("path", pick("recorded").alias("recorded"), pick("computed").alias("computed"), pick("node").alias("sources"), first.alias("input_problem"))


def origins(c: Corpus, states: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """``(path, target, computed_sums, origin_problem)`` of pointed pages: the origin's tip or the commit asked for, and the objects there.

    ``commits``: (path, commit) that shall be attested instead of the tip; the origin must contain them.
    """
    world = c.world
    branches = world.branches.groupBy("repo").agg(F.min("branch").alias("of_repo"))
    s = states.where("pointed").join(branches, "repo", "left").withColumn("branch", F.when(F.col("branch") == "", F.coalesce("of_repo", F.lit(""))).otherwise(F.col("branch"))).drop("of_repo")
    s = s.join(world.present.select("repo").distinct().withColumn("here", F.lit(True)), "repo", "left").withColumn("ref", F.concat(F.lit("origin/"), "branch"))
    asked = commits.select("path", F.col("commit").alias("asked")) if commits is not None else states.select("path", F.lit(None).cast("string").alias("asked")).limit(0)
    named = lambda out, kind: world.objects.select("repo", F.col("name").alias("ref" if out == "tip" else "asked"), F.col("oid").alias(out), F.col("type").alias(kind))
    s = s.join(asked, "path", "left").join(named("tip", "tip_type"), ["repo", "ref"], "left").join(named("asked_oid", "asked_type"), ["repo", "asked"], "left")
    inside = world.ancestry.select("repo", F.col("commit").alias("asked"), "ref").distinct().withColumn("inside", F.lit(True))
    s = s.join(inside, ["repo", "asked", "ref"], "left").withColumn("target", F.coalesce("asked", "tip"))
    at = s.select("path", "repo", "target", F.posexplode("locations").alias("pos", "location")).withColumn("name", F.concat("target", F.lit(":"), F.regexp_replace("location", "/$", "")))
    at = at.join(world.objects.select("repo", "name", "oid"), ["repo", "name"], "left")
    sums = at.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "oid"))), lambda x: x["oid"]).alias("computed_sums"), F.min_by("location", "pos").alias("__first"), F.min(F.when(F.col("oid").isNull(), F.col("location"))).alias("absent"))
    problem = (
        F.when(F.col("repo") == "", "no repo")
        .when(F.col("branch") == "", F.concat(F.lit("no branch for repo "), "repo"))
        .when(F.size("locations") == 0, "no location")
        .when(F.col("here").isNull(), F.concat(F.lit("repo "), "repo", F.lit(" is not present")))
        .when(~F.col("tip_type").eqNullSafe("commit"), F.concat("ref", F.lit(" does not resolve in "), "repo"))
        .when(F.col("asked").isNotNull() & ~F.col("asked_type").eqNullSafe("commit"), F.concat(F.lit("commit "), "asked", F.lit(" does not resolve in "), "repo"))
        .when(F.col("asked").isNotNull() & (F.col("asked") != F.col("tip")) & F.col("inside").isNull(), F.concat(F.lit("commit "), "asked", F.lit(" is not on "), "ref"))
        .when(F.col("absent").isNotNull(), F.concat(F.lit("location "), "absent", F.lit(" does not exist at "), "target"))
    )
    return s.join(sums, "path", "left").select("path", "target", F.coalesce("computed_sums", F.array().cast("array<string>")).alias("computed_sums"), problem.alias("origin_problem"))


REPORT = ["path", "status", "case", "reason", "target", "computed", "computed_sums", "computed_procedure", "write"]


def attest(c: Corpus, gate: DataFrame, scope: str = ".", commits: DataFrame | None = None) -> DataFrame:
    """``REPORT`` rows, one for each effect page: status skipped, failed, unchanged, refused or attested.

    ``gate``: (path, exit, detail), the results of the pages' checks; a page without one, or with
    another exit than 0, fails. Each step gates the next: state, check, inputs, origin, case, ancestry.
    A write that moves the commit is refused where the ancestry of the recorded commit to the new one
    isn't known.
    """
    states = stage(page_states(c, scope), "attest-states")
    going = states.where("skip IS NULL AND problem IS NULL")
    passed = gate.groupBy("path").agg(F.max_by("exit", F.abs("exit")).alias("exit"), F.max_by("detail", F.abs("exit")).alias("detail"))
    procedures = graph.procedure_hashes(c.facts, going).withColumnRenamed("computed", "computed_procedure")
    s = states.join(passed, "path", "left").join(inputs(c, going), "path", "left").join(origins(c, going, commits), "path", "left").join(procedures, "path", "left")
    if c.world.worktree is not None:
        there = c.world.worktree.where(F.col("repo") == c.owned_repo).select(F.col("path").alias("location")).distinct()
        places = going.where("NOT pointed").select("path", F.explode("locations").alias("location")).withColumn("location", F.regexp_replace("location", "/$", ""))
        s = s.join(places.join(there, "location", "left_anti").groupBy("path").agg(F.min("location").alias("gone")), "path", "left")
    else:
        s = s.withColumn("gone", F.lit(None).cast("string"))
    failure = F.coalesce(
        "problem",
        F.concat(F.lit("owned location "), "gone", F.lit(" is missing from the working tree")),
        F.when(F.col("exit").isNull(), "no result of ^check").when(F.col("exit") != 0, F.concat(F.lit("^check failed (exit "), F.col("exit").cast("string"), F.lit(")"), F.coalesce(F.concat(F.lit(": "), F.expr("nullif(detail, '')")), F.lit("")))),
        "input_problem",
        "origin_problem",
    )
    s = stage(s.withColumn("reason", F.coalesce("skip", failure)), "attest-gated")
    cases = classify(s.where("reason IS NULL").select("path", "pointed", "has_receipt", "recorded", "computed", "recorded_procedure", "computed_procedure", "recorded_sums", "computed_sums"))
    s = s.join(cases, "path", "left")
    known = c.world.ancestry.select("repo", F.col("commit").alias("recorded_commit"), F.col("ref").alias("target")).distinct().withColumn("ahead", F.lit(True))
    s = s.join(known, ["repo", "recorded_commit", "target"], "left")
    refused = F.coalesce("moves_commit", F.lit(False)) & (F.col("recorded_commit") != "") & (F.col("recorded_commit") != F.col("target")) & F.col("ahead").isNull()
    status = F.when(F.col("skip").isNotNull(), "skipped").when(F.col("reason").isNotNull(), "failed").when(F.col("case").isNull(), "unchanged").when(refused, "refused").otherwise("attested")
    reason = F.when(refused, F.concat(F.lit("recorded commit "), "recorded_commit", F.lit(" is not known to be an ancestor of "), "target")).otherwise(F.col("reason"))
    return s.withColumn("status", status).withColumn("reason", reason).select(*REPORT)


def unexplained(history: DataFrame, ancestry: DataFrame, commits: list[str], dirty: DataFrame | None = None) -> DataFrame:
    """``(path)`` of pages with changes that the declared commits don't explain.

    ``history``: (path, commit) of all changes; ``ancestry``: (commit, ref), the commits that a commit
    contains; ``dirty``: (path) of changes in no commit. Without commits nothing is explained.
    """
    declared = F.col("ref").isin(commits) if commits else F.lit(False)
    covered = ancestry.where(declared).select("commit").union(history.where(F.col("commit").isin(commits) if commits else F.lit(False)).select("commit")).distinct()
    out = history.join(covered, "commit", "left_anti").select("path")
    return (out.union(dirty.select("path")) if dirty is not None else out).distinct()


def reattest(c: Corpus, open_changes: DataFrame, scope: str = ".") -> DataFrame:
    """``REPORT`` rows of a sweep that renews input hashes only: status skipped, failed, unchanged, needs_realise or reattested.

    ``open_changes``: (path) of ``unexplained``. A page whose procedure moved, that was never attested, or
    with a changed input of which a change isn't explained, needs more than a sweep.
    """
    states = stage(page_states(c, scope), "reattest-states")
    going = states.where("skip IS NULL AND problem IS NULL")
    procedures = graph.procedure_hashes(c.facts, going).withColumnRenamed("computed", "computed_procedure")
    s = states.join(inputs(c, going), "path", "left").join(procedures, "path", "left")
    s = stage(s.withColumn("write", _changed()).withColumn("reason", F.coalesce("skip", "problem", "input_problem")), "reattest")
    sources = s.where("reason IS NULL").select("path", F.explode("write").alias("pos"), "sources").select("path", F.coalesce(F.element_at("sources", F.col("pos") + 1), F.col("path")).alias("source"))
    loose = sources.join(open_changes.select(F.col("path").alias("source")).distinct(), "source", "left_semi").groupBy("path").agg(F.min("source").alias("source"))
    s = s.join(loose, "path", "left")
    realise = (
        F.when(F.col("pointed") & ~F.col("has_receipt"), "never attested")
        .when(F.col("pointed") & ~F.col("recorded_procedure").eqNullSafe(F.col("computed_procedure")), "the procedure moved")
        .when(F.col("source").isNotNull(), F.concat(F.lit("input "), "source", F.lit(" has changes outside the declared commits")))
    )
    status = F.when(F.col("skip").isNotNull(), "skipped").when(F.col("reason").isNotNull(), "failed").when(F.size("write") == 0, "unchanged").when(realise.isNotNull(), "needs_realise").otherwise("reattested")
    none = F.lit(None).cast("string")
    return s.withColumn("status", status).select(
        "path", "status", F.when(F.col("status") == "reattested", "inputs-only").alias("case"), F.coalesce("reason", F.when(F.col("status") == "needs_realise", realise)).alias("reason"), none.alias("target"), "computed", F.array().cast("array<string>").alias("computed_sums"), "computed_procedure", "write",
    )


def write_plan(documents: DataFrame, report: DataFrame, applied_at: str, verdict: str = "") -> DataFrame:
    """``PLAN`` rows of the pages that a report attests."""
    wanted = report.where(F.col("status").isin("attested", "reattested"))
    rows = documents.select("path", "content").join(wanted, "path")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                text = write_hashes(r.content, {int(i): r.computed[i] for i in r.write})
                values = receipt_values(r.case, r.status, r.target, list(r.computed_sums) if r.computed_sums is not None else [], r.computed_procedure, applied_at, verdict)
                text = write_receipt(text, values, r.case == "first") if r.target or r.status == "reattested" else text
                if text != r.content:
                    out.append((r.path, r.content, text, [f"{r.status}: {r.case}"]))
            yield pd.DataFrame(out, columns=["path", "before", "after", "actions"])

    return rows.select("path", "content", "status", "case", "target", "computed", "computed_sums", "computed_procedure", "write").mapInPandas(run, PLAN)


def receipt_values(case: str, status: str, target: str, sums: list[str], procedure: str, applied_at: str, verdict: str) -> dict[str, str]:
    """What a case writes into the receipt, as YAML: a first one and a moved tree all, a procedure its hash, inputs alone no more than a verdict."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    if status == "reattested":
        return {"applied_at": applied_at}
    out = {"verdict": quoted(verdict)} if verdict else {}
    if case in ("first", "tree"):
        out |= {"commit": target, "checksum": sums[0] if len(sums) == 1 else "[" + ", ".join(sums) + "]"}
    if case in ("first", "tree", "procedure"):
        out |= {"applied_at": applied_at, "procedure-hash": quoted(procedure)}
    return out


def write_receipt(content: str, values: dict[str, str], first: bool = False) -> str:
    """A page with receipt keys set; all other bytes stay. ``first`` appends the block and points the frontmatter to it.

    A key is replaced with its continuation lines, and put at the block's end if it isn't there. Without
    a block nothing is set, as pages of the corpus itself have none.
    """
    ordered = [f"{k}: {values[k]}" for k in RECEIPT_KEYS if k in values]
    lines = content.split("\n")
    if first:
        at = next(i for i, line in enumerate(lines) if line.startswith("receipt:"))
        lines[at] = RECEIPT_POINTER
        while lines and not lines[-1].strip():
            lines.pop()
        return "\n".join([*lines, "", "## Receipt", "", "```yaml", *ordered, "```", "^receipt", ""])
    block = next((s for s in M.slices(content) if s.anchor == "^receipt" and s.fence), None)
    if block is None:
        return content
    start, end = block.start, block.end - 2  # the lines inside the fence
    for line in ordered:
        key = line.partition(":")[0]
        at = next((i for i in range(start, end) if lines[i].startswith(f"{key}:")), None)
        if at is None:
            lines.insert(end, line)
            end += 1
            continue
        after = at + 1
        while after < end and lines[after].startswith((" ", "-", "\t")):
            after += 1
        lines[at:after] = [line]
        end -= after - at - 1
    return "\n".join(lines)


def draws(c: Corpus, scope: str = ".") -> DataFrame:
    """``(path, pos, ref, target, anchor, computed, problem)`` of the provenance that effect pages state in 'draws-from'."""
    effects = c.documents.where(C.in_scope(F.col("path"), scope) & F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), EFFECT))
    rows = property_blocks.values(effects, ["draws-from"]).select("path", "pos", F.trim("value").alias("ref"))
    inner = F.nullif(F.regexp_extract("ref", r"^\[\[([^\]|]+)(?:\|[^\]]*)?\]\]$", 1), F.lit(""))
    rows = rows.withColumn("inner", inner).withColumn("target", C.link_target(F.col("inner"))).withColumn("anchor", C.link_fragment(F.col("inner")))
    odd = rows.where("inner IS NULL").select("path", "pos", "ref", F.lit(None).cast("string").alias("computed"), F.lit("no link").alias("problem"))
    hashed = graph.input_hashes(rows.where("inner IS NOT NULL").drop("inner"), c.facts, c.paths, c.owned_repo)
    return hashed.select("path", "pos", "ref", "computed", "problem").unionByName(odd)


def promotions(c: Corpus, scope: str = ".") -> DataFrame:
    """``(path, block, skip)`` of effect pages with 'draws-from': the inputs block to paste, and why it can't be written for them."""
    d = draws(c, scope)
    blocks = promote(d.where("problem IS NULL").withColumn("node", F.xxhash64("path", "pos")), d.where("problem IS NULL").select(F.xxhash64("path", "pos").alias("node"), F.col("computed").alias("hash")))
    held = c.facts.wide.select("path", (F.size("chain") > 0).alias("has_chain"), F.coalesce(F.col("pin.has_inputs"), F.lit(False)).alias("has_inputs"))
    skip = F.when(F.col("has_chain") | F.col("has_inputs"), "the page has inputs").when(F.col("block").isNull(), "nothing to draw from resolves")
    return d.select("path").distinct().join(blocks, "path", "left").join(held, "path").select("path", "block", skip.alias("skip"))


def _changed() -> Column:
    places = F.when(F.size("computed") > 0, F.sequence(F.lit(0), F.size("computed") - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: ~F.try_element_at("recorded", i + 1).eqNullSafe(F.try_element_at("computed", i + 1)))


def classify(states: DataFrame) -> DataFrame:
    """``(path, case, moves_commit, write)`` of pages that need writing.

    ``states``: (path, pointed, has_receipt, recorded array, computed array, recorded_procedure,
    computed_procedure, recorded_sums array, computed_sums array). 'first' writes all inputs, 'tree'
    and 'procedure' changes count before inputs; an owned page, not pointed, has inputs only.
    ``write`` holds the places of the inputs to write; unchanged pages are left out.
    """
    places = F.sequence(F.lit(0), F.size("computed") - 1)
    everything = F.when(F.size("computed") > 0, places).otherwise(F.array().cast("array<int>"))
    changed = F.filter(everything, lambda i: ~F.try_element_at("recorded", i + 1).eqNullSafe(F.try_element_at("computed", i + 1)))
    case = (
        F.when(~F.col("pointed"), F.when(F.size(changed) > 0, "inputs-only"))
        .when(~F.col("has_receipt"), "first")
        .when(~F.col("recorded_sums").eqNullSafe(F.col("computed_sums")), "tree")
        .when(~F.col("recorded_procedure").eqNullSafe(F.col("computed_procedure")), "procedure")
        .when(F.size(changed) > 0, "inputs-only")
    )
    out = states.select("path", case.alias("case"), F.when(case == "first", everything).otherwise(changed).alias("write"))
    return out.where(F.col("case").isNotNull()).withColumn("moves_commit", F.col("case").isin("first", "tree"))


def promote(draws: DataFrame, hashes: DataFrame) -> DataFrame:
    """A scaffold of declared inputs per page: ``draws`` (path, pos, ref, node), ``hashes`` (node, hash); unhashed inputs are null."""
    item = F.concat(F.lit("- ref: '"), "ref", F.lit("'\n  hash: "), F.coalesce("hash", F.lit("null")))
    rows = draws.join(hashes, "node", "left").select("path", "pos", item.alias("item"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]), "\n")
    return rows.groupBy("path").agg(F.concat(listed, F.lit("\nhash-algo: v1\n")).alias("block"))


def write_hashes(content: str, hashes: dict[int, str]) -> str:
    """A page with the hashes of its declared inputs set, by place in the block; all other bytes stay.

    An input without a hash line gets one below its ref. Raises ValueError if the page has no such input.
    """
    block = next((s for s in M.slices(content) if s.anchor == "^inputs" and s.fence), None)
    items = M.chain_block(block)[0] if block else []
    lines = content.split("\n")
    for pos in sorted(hashes, reverse=True):
        if pos >= len(items):
            raise ValueError(f"no declared input at place {pos}")
        item = items[pos]
        at = (item.hash_line or item.line) - 1
        end = "\r" if lines[at].endswith("\r") else ""
        if item.hash_line:
            lines[at] = f"{lines[at][: lines[at].index('hash:')]}hash: {hashes[pos]}{end}"
        else:
            lines.insert(at + 1, " " * item.column + f"hash: {hashes[pos]}{end}")
    return "\n".join(lines)
