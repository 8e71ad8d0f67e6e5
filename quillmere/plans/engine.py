"""The engine: a corpus and rules to findings, and the reports and plans around them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions import columns as C
from quillmere.functions.markdown import MAX_LINE
from quillmere.functions.templates import column
from quillmere.operators import cache, graph, reports, rewrites
from quillmere.operators import links as link_operators
from quillmere.operators import tasks as task_operators
from quillmere.operators.checks import CHECKS, Context
from quillmere.operators.facts import Facts
from quillmere.sources import corpus
from quillmere.session import stage
from quillmere.sources.rules import Rule

FINDINGS = "rule_id string, severity string, file_path string, line int, column int, message string, seq int"


class FatalRule(RuntimeError):
    """A rule that must run has no check."""


@dataclass
class Move:
    """A move as plans: the renames, the pages whose links change, tags that no longer fit, and findings at the new places."""

    renames: DataFrame
    plan: DataFrame
    tags: DataFrame
    findings: DataFrame | None


@dataclass
class Engine:
    """A corpus, scanned once, with its facts.

    ``raw``: (path, length, mtime_ns, content) as ``sources.corpus`` gives it; ``outside`` holds the
    tables of the world beyond the corpus by the names of ``Context``.
    """

    spark: SparkSession
    raw: DataFrame
    skip: list[str] = field(default_factory=lambda: list(corpus.SKIP))
    max_size: int = 0
    foreign_roots: list[str] = field(default_factory=list)
    outside: dict = field(default_factory=dict)
    extra_paths: DataFrame | None = None
    warnings: list[tuple[str, str]] = field(default_factory=list)
    cache_root: str | None = None
    max_line: int = MAX_LINE

    def __post_init__(self) -> None:
        self.documents = stage(corpus.scan(self.raw, self.skip, self.max_size, self.foreign_roots, max_line=self.max_line), "documents")
        # the universe has no size limit and keeps foreign pages: they can be linked to
        universe = self.raw.select("path").where(~C.skipped(F.col("path"), self.skip))
        self.paths = universe.unionByName(self.extra_paths.select("path")).distinct() if self.extra_paths is not None else universe
        self.cached = cache.read(self.spark, self.cache_root) if self.cache_root else None
        self.facts = Facts.of(self.documents, self.max_line) if self.cached is None else Facts(stage(cache.facts_with(self.cached, self.documents, self.max_line), "facts"))

    def save_cache(self) -> None:
        """Keep the facts for the next run; pages that are gone drop out."""
        cache.save(self.spark, self.facts.wide, self.documents, self.cache_root)

    def stats(self, rules: list[Rule], findings: DataFrame) -> DataFrame:
        """One row on a run: documents, cache hits, misses and rate, rules applied, findings."""
        empty = self.documents.select("path", "length", "mtime_ns", F.lit("").alias("content_sha"), F.lit(0).cast("long").alias("written_ns")).limit(0)
        run = cache.stats(self.cached if self.cached is not None else empty, self.documents)
        applied = sum(r.severity != "off" and r.check in CHECKS for r in rules)
        return run.crossJoin(findings.agg(F.count(F.lit(1)).alias("findings"))).withColumn("rules", F.lit(applied))  # one row each

    def context(self) -> Context:
        return Context(self.documents, self.facts, self.paths, warnings=self.warnings, **self.outside)

    def check(self, rules: list[Rule], scope: str = ".", strict: bool = False, phase: int | None = None, only: DataFrame | None = None) -> DataFrame:
        """The findings of ``rules`` in order, of all pages or ``only`` of some ``(path)``.

        Rules that are off or have no check are left out, the latter with a warning.
        """
        ctx, parts = self.context(), []
        for rule in rules:
            if rule.severity == "off":
                continue
            if rule.check not in CHECKS:
                warning = ("CHECK_NOT_REGISTERED", f"rule {rule.id}: check {rule.check} is not registered")
                if warning not in self.warnings:
                    self.warnings.append(warning)
                if rule.required:
                    raise FatalRule(f"required rule {rule.id} needs check {rule.check}")
                continue
            run, of_phase = CHECKS[rule.check]
            if phase is not None and of_phase != phase:
                continue
            docs = self.subjects(rule, scope)
            if only is not None:
                docs = docs.join(only.select("path").distinct(), "path", "left_semi")
            parts.append(self._findings(run(docs, rule.params, ctx), rule))
        if not parts:
            return self.spark.createDataFrame([], FINDINGS)
        found = reduce(DataFrame.unionByName, parts)
        lines = self.documents.select(F.col("path").alias("file_path"), F.explode("inline_suppress").alias("s")).select("file_path", "s.line", "s.rule_id")
        # written once: a global order samples its input first, which would run all checks twice
        return reports.ordered(stage(reports.unsuppressed(found, lines), "findings"))

    def subjects(self, rule: Rule, scope: str = ".") -> DataFrame:
        """The documents a rule looks at: not foreign, in scope, selected, and not ignoring it."""
        ignored = F.exists(F.coalesce("lint_ignore", F.array().cast("array<string>")), lambda x: F.trim(x).isin(rule.id, "*"))
        return self.documents.where(~F.col("is_foreign") & C.in_scope(F.col("path"), scope) & C.selector(F.col("path"), F.col("tags"), rule.on) & ~ignored)

    def _findings(self, raw: DataFrame, rule: Rule) -> DataFrame:
        message = column(rule.message or "{{.Message}}", F.col("data"))
        return raw.select(F.lit(rule.id).alias("rule_id"), F.lit(rule.severity).alias("severity"), F.col("path").alias("file_path"), "line", F.lit(0).alias("column"), message.alias("message"), "seq")

    def check_paths(self, rules: list[Rule], changed: DataFrame) -> DataFrame:
        """The findings of changed pages ``(path)`` alone: each rule looks at no other page, but at the facts of the whole corpus."""
        return self.check(rules, only=changed)

    def skip_warnings(self) -> DataFrame:
        return corpus.skip_shadows(self.raw.select("path"), self.skip)

    def unread(self) -> DataFrame:
        """``(path, reason)`` of pages whose body and fields the checks don't see."""
        reason = F.when(F.col("long_line"), F.lit(f"a line has more than {self.max_line} characters")).when(F.col("fm_error"), "frontmatter can't be read")
        return self.documents.where("fm_error AND has_fm OR long_line").select("path", reason.alias("reason"))

    def domains(self) -> DataFrame:
        return reports.tag_counts(self.documents.select(F.explode("tags").alias("tag")))

    def debt(self, prefix: str = "wiki/sources", tag: str = "do/incorporate") -> DataFrame:
        created = F.coalesce(F.substring(F.try_element_at(F.from_json("fm", "map<string,string>"), F.lit("created")), 1, 10), F.lit(""))
        return reports.debt(self.documents.withColumn("created", created), prefix, tag)

    def fix_plan(self, rules: list[Rule], today: str, scope: str = ".", new_files: DataFrame | None = None, chosen: DataFrame | None = None) -> DataFrame:
        """What fixers would change for the findings of ``rules``; see ``rewrites.fix_plan``. Write it with ``sinks.apply_plan``."""
        canonical = rewrites.canonical_targets(self.facts.links.where("target <> ''"), self.paths, new_files, chosen)
        return rewrites.fix_plan(self.documents, self.check(rules, scope), rules, today, canonical)

    def move_plan(self, source: str, dest: str) -> DataFrame:
        return rewrites.move_plan(self.documents, self.facts.links, rewrites.moves_below(self.documents, source, dest))

    def move(self, moves: DataFrame, rules: list[Rule] = ()) -> Move:
        """All that moving pages ``(path, new_path)`` means, as plans; nothing is written. Raises ValueError if the moves can't be made.

        The pages are checked as they will be: at their new place, with links rewritten.
        """
        wanted = stage(moves.select("path", "new_path").distinct(), "moves")
        lost = wanted.join(self.documents.select("path"), "path", "left_anti").select("path", F.lit("there is no such page").alias("why"))
        kept = self.paths.join(wanted.select("path"), "path", "left_anti").select(F.col("path").alias("new_path"))
        taken = wanted.join(kept, "new_path", "left_semi").select(F.col("new_path").alias("path"), F.lit("the place is taken").alias("why"))
        twice = wanted.groupBy("new_path").count().where("count > 1").select(F.col("new_path").alias("path"), F.lit("two pages would go there").alias("why"))
        if bad := lost.unionByName(taken).unionByName(twice).orderBy("path").limit(5).collect():
            raise ValueError("; ".join(f"{r['path']}: {r['why']}" for r in bad))
        plan = stage(rewrites.move_plan(self.documents, self.facts.links, wanted), "move-plan")
        tags = rewrites.tag_mismatch(self.documents, wanted).join(wanted, "path").select(F.col("new_path").alias("path"), F.col("tag").alias("old_tag"), F.concat(F.lit("domain/"), "domain").alias("new_tag"))
        after = self.raw.join(wanted, "path", "left").join(plan.select("path", "after"), "path", "left")
        content = F.coalesce("after", "content")
        raw = after.select(F.coalesce("new_path", "path").alias("path"), F.octet_length(content).cast("long").alias("length"), "mtime_ns", content.alias("content"))
        findings = None
        if rules:
            later = Engine(self.spark, raw, self.skip, self.max_size, self.foreign_roots, self.outside, self.extra_paths)
            findings = later.check(list(rules), only=wanted.select(F.col("new_path").alias("path")))
        return Move(wanted, plan, tags, findings)

    def resolve(self, links: list[str] | None = None, page: str | None = None, depth: int = 1, max_nodes: int = graph.MAX_NODES) -> DataFrame:
        """The pages that links or a page's links lead to, ``depth`` further, with their hashes; exactly one of both is given."""
        if (links is None) == (page is None):
            raise ValueError("either links or page")
        if page is not None:
            targets = self.facts.links.where(F.col("path") == page).select("target").where("target <> ''")
        else:
            targets = self.spark.createDataFrame([(x.strip("[]").split("|")[0].split("#")[0],) for x in links], "target string")
        found = link_operators.resolve(targets.distinct(), self.paths).where("resolved IS NOT NULL").select(F.col("resolved").alias("path")).distinct()
        walked = graph.walk(found, self.facts, self.paths, depth, max_nodes)
        roots = walked.select("path", F.lit("").alias("anchor")).distinct()
        hashes = graph.compose(roots, self.facts, self.paths, max_nodes).select(F.col("root_path").alias("path"), "hash", "cause")
        return walked.join(hashes, "path", "left")

    def read(self, target: str, embeds: bool = False, strict: bool = False) -> str:
        """The text of one page, section or block on the driver, with its embeds if asked; ValueError if it isn't one."""
        from quillmere.functions import markdown as M

        def fetch(name: str, anchor: str) -> tuple[tuple[str, str], str] | None:
            wanted = self.spark.createDataFrame([(name,)], "target string")
            places = [r["path"] for r in link_operators.resolve_note(wanted, self.paths).limit(2).collect()]
            if len(places) != 1:
                return None
            content = self.documents.where(F.col("path") == places[0]).select("content").first()["content"]
            found = [s for s in M.slices(content) if s.anchor == anchor] or [s for s in M.slices(content) if s.kind == "section" and s.anchor.casefold() == anchor.casefold()]
            return ((places[0], anchor), found[0].text) if found else None

        inner = target.strip().removeprefix("[[").removesuffix("]]").split("|")[0]
        got = fetch(M.link_target(inner), M.link_fragment(inner))
        if got is None:
            raise ValueError(f"{target} names no single page or part")
        return graph.expand(got[1], fetch, (got[0],), strict) if embeds else got[1]

    def tasks(self) -> DataFrame:
        return task_operators.tasks(self.documents)

    def response(self, findings: DataFrame, strict: bool = False) -> str:
        """The result as JSON: findings, counts by rule, exit code. For results that fit the driver."""
        counts = findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule_id").collect()
        code = reports.exit_code(findings, strict).first()["exit_code"]
        rows = [{k: v for k, v in r.asDict().items() if k != "seq"} for r in reports.ordered(findings).toLocalIterator()]
        return json.dumps({"findings": rows, "counts": {r["rule_id"]: r["n"] for r in counts}, "exit_code": code, "warnings": self.warnings}, ensure_ascii=False)
