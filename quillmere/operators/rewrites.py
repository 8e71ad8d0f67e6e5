"""Rewrites as plans: what a fix or a move would change, file by file; nothing is written here.

A fixer is a function of a page's text and its parameters. The fixers of a page run one after the
other by rule id, each on what the one before left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.functions import columns as C
from quillmere.functions import markdown as M
from quillmere.functions import uris
from quillmere.functions.templates import render
from quillmere.operators import links
from quillmere.sources.rules import Rule

Fixer = Callable[[str, dict], tuple[str, list[str]]]
FIXERS: dict[str, Fixer] = {}
#: Parameters each fixer takes; others are refused.
PARAMS: dict[str, set[str]] = {}
PLAN = "path string, before string, after string, actions array<string>"


def fixer(name: str, *params: str) -> Callable[[Fixer], Fixer]:
    def add(f: Fixer) -> Fixer:
        FIXERS[name], PARAMS[name] = f, {*params}
        return f

    return add


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def validate(rules: list[Rule]) -> None:
    """Raise ValueError for a parameter a fixer doesn't know, with the nearest it does."""
    for rule in rules:
        known = PARAMS.get(rule.check)
        for key in rule.params if known is not None else ():
            if key not in known:
                near = min(known, key=lambda k: (edit_distance(key, k), k), default="")
                raise ValueError(f"rule {rule.id}: unknown parameter {key!r}" + (f", did you mean {near!r}?" if near and edit_distance(key, near) <= 3 else ""))


def _default(field: str, today: str) -> str:
    return {"tags": "[]", "created": today}.get(field, '""')


def add_fields(text: str, fields: list[str], today: str) -> tuple[str, list[str]]:
    """Missing frontmatter fields with default values; a page without frontmatter gets one."""
    fm = M.parse_frontmatter(text)
    missing = [f for f in fields if f not in fm.values]
    if fm.error or not missing:
        return text, []
    new = [f"{f}: {_default(f, today)}" for f in missing]
    actions = [f"added field '{f}' with default value" for f in missing]
    if not fm.present:
        return "\n".join(["---", *new, "---", text]), actions
    lines = text.split("\n")
    close = fm.body_offset - 2
    return "\n".join([*lines[:close], *new, *lines[close:]]), actions


@fixer("field-exists", "frontmatter", "today")
def fix_field_exists(text, params):
    fields = params.get("frontmatter") or []
    return add_fields(text, [fields] if isinstance(fields, str) else fields, params["today"])


@fixer("property", "property", "required", "wikilink", "text", "date", "tag", "today")
def fix_property(text, params):
    """Required fields, and displays of frontmatter links by the first fitting template."""
    import re

    from quillmere.functions.globs import glob_regex

    actions = []
    if params.get("required"):
        text, actions = add_fields(text, params["property"], params["today"])
    templates = ((params.get("wikilink") or {}).get("link_display") or {}).get("templates") if isinstance(params.get("wikilink"), dict) else None
    fm = M.parse_frontmatter(text)
    if not templates or not fm.present or fm.error:
        return text, actions
    lines = text.split("\n")
    key = ""
    for i in range(1, fm.body_offset - 2):
        named = re.match(r"([^\s:#-][^:]*):", lines[i])
        key = named.group(1) if named else key
        if key not in params["property"]:
            continue

        def shown(m: re.Match) -> str:
            fit = next((t for t in templates if re.match(glob_regex(t["when"]), m.group(1))), None)
            if fit is None:
                return m.group()
            new = f"[[{m.group(1)}|{render(fit['format'], {'Target': m.group(1)})}]]"
            if new != m.group():
                actions.append(f"{m.group()} -> {new}")
            return new

        lines[i] = M.WIKILINK_DISPLAY.sub(shown, lines[i])
    return "\n".join(lines), actions


@fixer("table-wikilink-pipe")
def fix_table_pipe(text, params):
    lines, actions, at = text.split("\n"), [], 0
    while at < len(lines):
        end = at
        while end < len(lines) and lines[end].strip().startswith("|"):
            end += 1
        if end - at >= 2:
            for row in range(at, end):
                if not M.TABLE_SEPARATOR.match(lines[row]):
                    found = M.TABLE_PIPE_LINK.findall(lines[row])
                    actions += [f"escaped wikilink pipe in table: {m}" for m in found]
                    lines[row] = M.TABLE_PIPE_LINK.sub(lambda m: m.group().replace("|", "\\|", 1), lines[row])
        at = max(end, at + 1)
    return "\n".join(lines), actions


@fixer("wiki-navlink", "mapping")
def fix_navlink(text, params):
    """Mapped links and bare URIs to markdown links, outside fences and code."""
    mapping = {}
    for target, place in (params.get("mapping") or {}).items():
        slug, _, path = str(place).partition("/")
        if slug and path:
            mapping[target] = uris.Ref(slug, path)
    actions: list[str] = []

    def segment(s: str) -> str:
        def repoint(m):
            inner, _, display = m.group()[2:-2].partition("|")
            target, _, fragment = inner.strip().partition("#")
            if target not in mapping:
                return m.group()
            ref = mapping[target]._replace(fragment=fragment)
            actions.append(f"repointed [[{target}]] -> {uris.uri(ref)}")
            return uris.nav_link(ref, display or target.rsplit("/", 1)[-1])

        def cite(m):
            if m.start() and s[m.start() - 1] in "([":
                return m.group()
            try:
                ref, _ = uris.parse(m.group())
            except uris.UriError:
                return m.group()
            actions.append(f"linked bare {m.group()}")
            return uris.citation(ref)

        s = M.WIKILINK.sub(repoint, s) if mapping else s
        return M.BARE_URI.sub(cite, s)

    out = []
    for line in M.walk(text, "toggle"):
        parts = line.text.split("`")
        out.append(line.text if line.fenced or line.delimiter else "`".join(segment(p) if i % 2 == 0 else p for i, p in enumerate(parts)))
    return "\n".join(out), actions


def _outside_code(line: str, start: int) -> bool:
    return not any(a <= start < b for a, b in M.code_spans(line))


@fixer("wikilink-canonicalize", "roots", "skip-prefixes", "canonical")
def fix_canonicalize(text, params):
    """Links to their canonical form; ``canonical`` maps this page's targets, '' marking ambiguous ones."""
    canonical, skip = params.get("canonical") or {}, params.get("skip-prefixes") or []
    actions, out = [], []
    for line in M.walk(text, "facts"):
        if line.fenced or line.delimiter or "[[" not in line.text:
            out.append(line.text)
            continue

        def rewrite(m):
            inner = m.group(1)
            body, pipe, alias = inner.partition("|")
            target, sign, fragment = body.partition("#")
            target = target.strip()
            if not target or not _outside_code(line.text, m.start()) or any(target.lower().startswith(p.lower()) for p in skip) or target not in canonical:
                return m.group()
            if canonical[target] == "":
                actions.append(f"AMBIGUOUS: [[{target}]] — cannot resolve, needs manual disambiguation")
                return m.group()
            if canonical[target] == target:
                return m.group()
            new = f"[[{canonical[target]}{sign}{fragment}{pipe}{alias}]]"
            actions.append(f"canonicalized {m.group()} -> {new}")
            return new

        out.append(M.WIKILINK_INNER.sub(rewrite, line.text))
    return "\n".join(out), actions


def canonical_targets(page_links: DataFrame, paths: DataFrame, new_files: DataFrame | None = None, chosen: DataFrame | None = None) -> DataFrame:
    """``(path, canonical)``: for each page a map from its targets to canonical ones, '' where it can't be told.

    Ambiguous targets are resolved without ``new_files``, then by the paths ``chosen``, if one is left.
    """
    found = links.resolve(page_links.select("target").distinct(), paths)
    hard = found.where("ambiguous").select("target")
    settled = found.where("resolved IS NOT NULL").select("target", "resolved")
    for keep in (new_files, chosen):
        if keep is not None:
            if keep is new_files:
                more = links.resolve_excluding(hard, paths, keep)
            else:
                more = links.resolve_excluding(hard, paths, paths.join(keep.select("path"), "path", "left_anti"))
            more = more.where("resolved IS NOT NULL").select("target", "resolved")
            settled = settled.unionByName(more)
            hard = hard.join(more.select("target"), "target", "left_anti")
    short = links.shortest_unique(paths).withColumnRenamed("path", "resolved")
    both = settled.join(short, "resolved").select("target", "canonical").unionByName(hard.select("target", F.lit("").alias("canonical")))
    return page_links.select("path", "target").distinct().join(both, "target").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("target", "canonical"))).alias("canonical"))


def check_universe(chosen: DataFrame, paths: DataFrame) -> None:
    """Raise ValueError if paths were chosen for another universe: some are given and none is there."""
    given = chosen.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    if given and not chosen.join(paths.select("path"), "path", "left_semi").head(1):
        raise ValueError(f"none of the {given} chosen paths is in the corpus")


def fix_plan(documents: DataFrame, findings: DataFrame, rules: list[Rule], today: str, canonical: DataFrame | None = None) -> DataFrame:
    """``PLAN`` rows of the pages with findings that fixers change; pages of rules without a fixer stay."""
    validate(rules)
    ordered = sorted((r for r in rules if r.check in FIXERS), key=lambda r: r.id)
    wanted = findings.where(F.col("rule_id").isin([r.id for r in ordered])).groupBy(F.col("file_path").alias("path")).agg(F.collect_set("rule_id").alias("ids"))
    pages = documents.select("path", "content").join(wanted, "path")
    pages = pages.join(canonical, "path", "left") if canonical is not None else pages.withColumn("canonical", F.lit(None).cast("map<string,string>"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content, ids, known in frame[["path", "content", "ids", "canonical"]].itertuples(index=False):
                text, actions = content, []
                for rule in ordered:
                    if rule.id in set(ids):
                        text, done = FIXERS[rule.check](text, rule.params | {"today": today, "canonical": dict(known or {})})
                        actions += done
                if text != content:
                    rows.append((path, content, text, actions))
            yield pd.DataFrame(rows, columns=["path", "before", "after", "actions"])

    return pages.select("path", "content", "ids", "canonical").mapInPandas(run, PLAN)


def move_text(text: str, places: dict[str, str]) -> tuple[str, int]:
    """A page's links to moved pages, rewritten; ``places`` has the new target for the old one in lower case. Fragment and display stay."""
    count = 0
    out = []

    def rewrite(m):
        nonlocal count
        target, sign, fragment = m.group(1).partition("#")
        place = places.get(target.lower())
        if place is None or place.lower() == target.lower():
            return m.group()
        count += 1
        return f"[[{place}{sign}{fragment}{'|' + m.group(2) if m.group(2) else ''}]]"

    for line in M.walk(text, "move"):
        out.append(line.text if line.fenced or line.delimiter else M.WIKILINK_DISPLAY.sub(rewrite, line.text))
    return "\n".join(out), count


def moves_below(paths: DataFrame, source: str, dest: str) -> DataFrame:
    """``(path, new_path)`` of a page, or of all pages of a directory, that go from ``source`` to ``dest``."""
    source, dest, path = source.rstrip("/"), dest.rstrip("/"), F.col("path")
    new = F.when(path == source, F.lit(dest)).when(F.startswith(path, F.lit(f"{source}/")), F.concat(F.lit(dest), F.substring(path, len(source) + 1, 1 << 30)))
    return paths.select("path", new.alias("new_path")).where(F.col("new_path").isNotNull() & (F.col("new_path") != path)).distinct()


def moved_targets(targets: DataFrame, moves: DataFrame) -> DataFrame:
    """``targets`` (…, target) that name moved pages ``(path, new_path)``, with ``place``, the new target at the depth the old one had.

    A target names a page by its whole path or a suffix of it, without regard to case. Of several moved
    pages that a target names the one whose path is first holds.
    """
    old, new = C.no_ext(F.col("path")), C.no_ext(F.col("new_path"))
    named = moves.where(F.lower(old) != F.lower(new)).select(old.alias("old"), new.alias("new"), F.explode(C.suffixes(F.lower(old))).alias("key"))
    first = named.groupBy("key").agg(F.min(F.struct("old", "new")).alias("m"))
    found = targets.where("target <> ''").withColumn("key", F.lower("target")).join(first, "key")
    return found.withColumn("place", links.moved(F.col("target"), F.col("m.old"), F.col("m.new"))).where(F.col("place").isNotNull()).drop("key", "m")


def move_plan(documents: DataFrame, page_links: DataFrame, moves: DataFrame) -> DataFrame:
    """``PLAN`` rows of the pages whose links the moves ``(path, new_path)`` change; ``page_links``: (path, target).

    Which targets change is a join of the distinct targets; only pages with such links are opened, once each.
    """
    hit = moved_targets(page_links.select("target").distinct(), moves)
    known = page_links.select("path", "target").distinct().join(hit, "target").groupBy("path").agg(F.collect_set(F.struct(F.lower("target").alias("old"), "place")).alias("places"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content, places in frame[["path", "content", "places"]].itertuples(index=False):
                text, count = move_text(content, {p["old"]: p["place"] for p in places})
                if count:
                    rows.append((path, content, text, [f"updated {count} link(s)"]))
            yield pd.DataFrame(rows, columns=["path", "before", "after", "actions"])

    return documents.select("path", "content").join(known, "path").mapInPandas(run, PLAN)


def tag_mismatch(documents: DataFrame, moves: DataFrame) -> DataFrame:
    """Domain tags that don't fit where pages ``(path, new_path)`` go: ``(path, tag, domain)``."""
    domain = C.top_domain(F.col("new_path"))
    tags = documents.join(moves, "path").select("path", F.explode("tags").alias("tag"), domain.alias("domain"))
    return tags.where(F.startswith("tag", F.lit("domain/")) & (F.col("domain") != "") & (F.col("tag") != F.concat(F.lit("domain/"), "domain")))
