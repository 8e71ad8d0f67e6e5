"""Graphs between pages: Merkle hashes over embeds, declared chains, cycles, walks and expansion."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions import columns as C
from quillmere.operators import links
from quillmere.operators.facts import Facts
from quillmere.session import stage, unstage

# The node cap, the prefix of composed hashes, what stands for a page that is being hashed already.
MAX_NODES = 512
MERKLE = "merkle-v1"
CYCLE = hashlib.sha256(b"cycle").digest()
EXPAND_DEPTH = 32


def edges(facts: Facts, paths: DataFrame) -> DataFrame:
    """``(path, anchor, pos, child_path, child_anchor, error)`` of all embeds, targets resolved; '' is the page itself."""
    e = facts.embeds.withColumn("target", F.col("child_target"))
    found = links.resolve(e.where("target <> ''").select("target").distinct(), paths)
    joined = e.join(found, "target", "left")
    same = F.col("target") == ""
    error = F.when(same, F.lit(None)).when(F.col("ambiguous"), "ambiguous").when(F.col("resolved").isNull(), "unresolved")
    return joined.select("path", "anchor", "pos", F.when(same, F.col("path")).otherwise(F.col("resolved")).alias("child_path"), "child_anchor", error.alias("error"))


def _hash_root(frame: pd.DataFrame, max_nodes: int) -> pd.DataFrame:
    """One root's closure to its hash; the first error met in order fails it."""
    root = (frame.root_path.iloc[0], frame.root_anchor.iloc[0])
    leaves, children = {}, {}
    for row in frame.itertuples(index=False):
        node = (row.path, row.anchor)
        leaves[node] = row.leaf
        if row.child_anchor is not None or row.error is not None:
            children.setdefault(node, {})[row.pos] = ((row.child_path, row.child_anchor), row.error)
    memo: dict[tuple, bytes] = {}
    open_: set[tuple] = set()
    entered = 0

    class Fail(Exception):
        pass

    def digest(node: tuple) -> bytes:
        nonlocal entered
        if node in memo:
            return memo[node]
        if node in open_:
            return CYCLE
        entered += 1
        if entered > max_nodes:
            raise Fail("truncated")
        leaf = leaves.get(node)
        if leaf is None:
            raise Fail("dangling-anchor")
        try:
            raw = bytes.fromhex(leaf.rsplit(":", 1)[-1])
        except ValueError:
            raw = b""
        if len(raw) != 32:
            raise Fail("bad-digest")
        open_.add(node)
        h = hashlib.sha256(raw)
        for _, (child, error) in sorted(children.get(node, {}).items()):
            if error:
                raise Fail(error)
            h.update(digest(child))
        open_.discard(node)
        memo[node] = h.digest()
        return memo[node]

    try:
        out, cause = f"{MERKLE}:{digest(root).hex()}", None
    except Fail as f:
        out, cause = None, str(f)
    return pd.DataFrame({"root_path": [root[0]], "root_anchor": [root[1]], "hash": [out], "cause": [cause]})


def compose(roots: DataFrame, facts: Facts, paths: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """``(root_path, root_anchor, hash, cause)`` of the roots ``(path, anchor)``.

    A root's closure is gathered by a frontier that grows for all roots at once and stops for a root
    whose closure passes the cap, so what one task hashes has at most about ``max_nodes`` nodes and
    their embeds. A page met again while it is being hashed counts as the cycle sign, which depends on the
    root; hence each root is hashed by itself.
    """
    all_edges = stage(edges(facts, paths), "embed-edges")
    nodes = stage(roots.select(F.col("path").alias("root_path"), F.col("anchor").alias("root_anchor"), "path", "anchor").distinct(), "closure-0")
    frontier, level = nodes, 0
    while frontier.head(1):
        level += 1
        kids = frontier.join(all_edges.where("error IS NULL"), ["path", "anchor"]).select("root_path", "root_anchor", F.col("child_path").alias("path"), F.col("child_anchor").alias("anchor")).distinct()
        full = nodes.groupBy("root_path", "root_anchor").count().where(F.col("count") > max_nodes)
        fresh = kids.join(nodes, ["root_path", "root_anchor", "path", "anchor"], "left_anti").join(full, ["root_path", "root_anchor"], "left_anti")
        frontier = stage(fresh, f"closure-{level}")
        nodes = nodes.unionByName(frontier)
    leaves = facts.slices.select("path", "anchor", F.col("slice_hash").alias("leaf"))
    rows = nodes.join(leaves, ["path", "anchor"], "left").join(all_edges, ["path", "anchor"], "left")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return _hash_root(frame.astype(object).where(frame.notna(), None), max_nodes)

    return rows.groupBy("root_path", "root_anchor").applyInPandas(run, "root_path string, root_anchor string, hash string, cause string")


#: Levels that an acyclic graph of pages may have.
MOST_LEVELS = 10_000


def compose_levels(leaves: DataFrame, tree: DataFrame) -> DataFrame:
    """``(node, hash)`` of all nodes of an acyclic graph, each hashed once: leaves first, then what holds only hashed ones.

    ``leaves``: (node, leaf) with hex digests; ``tree``: (node, pos, child). As many rounds as the graph
    is deep, each over the edges whose child had no hash before it and over those of nodes that wait for
    others; an edge whose child has one isn't joined again. Nodes on or above a cycle get none.
    """
    degrees = stage(tree.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "merkle-degrees")
    new = stage(leaves.join(degrees, "node", "left_anti").select("node", F.sha2(F.unhex("leaf"), 256).alias("hash")), "merkle-0")
    done, held, pending = new, stage(tree.select("node", "pos", "child", F.lit(None).cast("string").alias("hash")), "merkle-edges"), None
    for level in range(1, MOST_LEVELS):
        joined = stage(held.where("hash IS NULL").drop("hash").join(new.withColumnRenamed("node", "child"), "child", "left"), f"merkle-edges-{level}")
        unstage(held)
        held, got = joined, joined.where("hash IS NOT NULL").select("node", "pos", "hash")
        pending = got if pending is None else pending.unionByName(got)
        whole = pending.groupBy("node").agg(F.count(F.lit(1)).alias("got"), F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias("kids")).join(degrees, "node").where("got = n").join(leaves, "node")
        new = stage(whole.select("node", F.sha2(F.unhex(F.concat("leaf", F.array_join(F.transform("kids", lambda k: k["hash"]), ""))), 256).alias("hash")), f"merkle-{level}")
        if not new.head(1):
            return done
        done = done.unionByName(new)
        pending = stage(pending.join(new.select("node"), "node", "left_anti"), f"merkle-pending-{level}")
    raise RuntimeError("the graph is deeper than it may be")


def blurbs(path: Column) -> Column:
    """The pages that may speak for a page, nearest directory first: '<dir>/<DIR>.md', then the one at the top."""
    dirs = F.reverse(C.ancestors(path))
    return F.concat(F.transform(dirs, lambda d: F.concat(d, F.lit("/"), F.upper(C.base(d)), F.lit(".md"))), F.array(F.lit("LLM_WIKI.md")))


def procedure_hashes(facts: Facts, pages: DataFrame | None = None) -> DataFrame:
    """``(path, computed)`` of ``pages``, else of those with a recorded procedure: their own ^check and ^apply, else the nearest blurb's."""
    pages = (facts.wide.where("procedure_hash <> ''") if pages is None else pages).select("path")
    tries = pages.select("path", F.posexplode(F.concat(F.array("path"), blurbs(F.col("path")))).alias("rank", "holder"))
    verbs = facts.slices.where(F.col("anchor").isin("^check", "^apply")).select(F.col("path").alias("holder"), "anchor", "slice_hash")
    best = tries.join(verbs, "holder").groupBy("path", "anchor").agg(F.min_by("slice_hash", "rank").alias("h"))
    pick = lambda a: F.max(F.when(F.col("anchor") == a, F.concat(F.lit("sha256:"), "h")))
    both = pages.join(best.groupBy("path").agg(pick("^check").alias("c"), pick("^apply").alias("a")), "path", "left")
    return both.select("path", C.procedure_hash(F.col("c"), F.col("a")).alias("computed"))


def input_hashes(references: DataFrame, facts: Facts, paths: DataFrame, owned_repo: str = "") -> DataFrame:
    """References ``(path, target, anchor, …)`` with ``node``, the page they lead to, ``computed``, its hash, and ``problem`` if there is none."""
    found = links.resolve(references.where("target <> ''").select("target").distinct(), paths)
    e = references.join(found, "target", "left").withColumn("node", F.when(F.col("target") == "", F.col("path")).otherwise(F.col("resolved")))
    pointed = facts.pins.where((F.lit(owned_repo) != "") & (F.coalesce("commit", F.lit("")) != "") & (F.size("checksums") > 0) & (F.col("repo") != owned_repo)).select(F.col("path").alias("node"), F.element_at("checksums", 1).alias("pointed"))
    e = e.join(pointed, "node", "left").withColumn("pointed", F.when(F.col("target") != "", F.col("pointed")))
    roots = e.where(F.col("node").isNotNull() & F.col("pointed").isNull()).select(F.col("node").alias("path"), "anchor").distinct()
    composed = compose(roots, facts, paths).select(F.col("root_path").alias("node"), F.col("root_anchor").alias("anchor"), F.col("hash").alias("composed"), F.col("cause").alias("why"))
    e = e.join(composed, ["node", "anchor"], "left").withColumn("computed", F.coalesce("pointed", "composed"))
    problem = F.when((F.col("target") != "") & F.col("ambiguous"), "ambiguous").when(F.col("node").isNull(), "unresolved").when(F.col("pointed").isNull(), F.col("why"))
    return e.withColumn("problem", problem).drop("resolved", "ambiguous", "pointed", "composed", "why")


def chain_states(facts: Facts, paths: DataFrame, owned_repo: str = "") -> DataFrame:
    """``(path, pos, line, cause, ref, detail)`` of declared inputs that are stale or can't be hashed, and changed procedures."""
    e = input_hashes(facts.chain.withColumnRenamed("hash", "recorded"), facts, paths, owned_repo)
    comparable = F.col("hash_algo").isin("", "v1") & (F.coalesce("recorded", F.lit("")) != "")
    cause = F.coalesce("problem", F.when(comparable & ~C.recorded_matches(F.col("recorded"), F.col("computed")), "stale"))
    detail = F.when(F.col("cause") == "stale", F.concat(F.lit("recorded "), "recorded", F.lit(" ≠ resolved "), "computed")).otherwise(F.col("target"))
    out = e.withColumn("cause", cause).where(F.col("cause").isNotNull()).select("path", "pos", "line", "cause", "ref", detail.alias("detail"))
    procedures = facts.wide.where("procedure_hash <> ''").select("path", "procedure_hash").join(procedure_hashes(facts), "path").where(~C.recorded_matches(F.col("procedure_hash"), F.col("computed")))
    changed = procedures.select("path", F.lit(1 << 20).alias("pos"), F.lit(1).alias("line"), F.lit("procedure").alias("cause"), F.lit("^check+^apply").alias("ref"), F.concat(F.lit("recorded "), "procedure_hash", F.lit(" ≠ resolved "), "computed").alias("detail"))
    return out.unionByName(changed)


def first_cycle(start: str, following: dict[str, list[str]]) -> list[str] | None:
    """The first way from a node back to it, depth first over sorted neighbours."""
    visited: set[str] = set()
    path, todo = [start], [iter(following.get(start, []))]
    while todo:
        step = next(todo[-1], None)
        if step is None:
            todo.pop()
            path.pop()
        elif step == start:
            return [*path, start]
        elif step not in visited:
            visited.add(step)
            path.append(step)
            todo.append(iter(following.get(step, [])))
    return None


def chain_edges(facts: Facts, paths: DataFrame) -> DataFrame:
    """``(path, next)`` between effect pages, without loops to themselves."""
    effects = facts.wide.where(F.array_contains("tags", "type/effect")).select("path")
    found = links.resolve(facts.chain.where("target <> ''").select("target").distinct(), paths).where("resolved IS NOT NULL")
    e = facts.chain.where("target <> ''").join(effects, "path", "left_semi").join(found, "target").select("path", F.col("resolved").alias("next")).where("path <> next").distinct()
    return e.join(effects.withColumnRenamed("path", "next"), "next", "left_semi").select("path", "next")


#: Rounds after which a fixed point must be reached; they grow with the logarithm of a part's size, or are four steps of a way each.
ROUNDS = 200


def connected(edges: DataFrame, name: str = "parts") -> DataFrame:
    """``(node, part)`` of all nodes on edges ``(a, b)``: the smallest node that each is linked to, over whatever many links.

    Stars alternate: every node links its larger neighbours to the smallest one, then its smaller ones,
    so a part is one star after about as many rounds as the logarithm of its size. Loops and nulls don't count.
    """
    links = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a IS NOT NULL AND b IS NOT NULL AND u <> v").distinct(), f"{name}-0")
    before = None
    for i in range(1, ROUNDS + 1):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = stage(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), f"{name}-{i}")
        unstage(links)
        links = following
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"the parts are not settled after {ROUNDS} rounds")
    return links.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("part")), F.struct(F.col("v").alias("node"), F.col("v").alias("part")))).alias("x")).select("x.*").groupBy("node").agg(F.min("part").alias("part"))


def strong_parts(following: dict[str, list[str]]) -> dict[str, int]:
    """A number for each node on a cycle, the same for nodes that reach each other; in time in proportion to the edges."""
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    open_: list[str] = []
    part: dict[str, int] = {}
    done: set[str] = set()
    for start in following:
        if start in number:
            continue
        number[start] = low[start] = len(number)
        open_.append(start)
        todo = [(start, iter(following.get(start, ())))]
        while todo:
            node, rest = todo[-1]
            step = next(rest, None)
            if step is None:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[node])
                if low[node] == number[node]:
                    group = [open_.pop()]
                    while group[-1] != node:
                        group.append(open_.pop())
                    done.update(group)
                    if len(group) > 1:
                        part.update(dict.fromkeys(group, number[node]))
            elif step not in number:
                number[step] = low[step] = len(number)
                open_.append(step)
                todo.append((step, iter(following.get(step, ()))))
            elif step not in done:
                low[node] = min(low[node], number[step])
    return part


def chain_cycles(facts: Facts, paths: DataFrame) -> DataFrame:
    """``(path, line, cycle)`` of effect pages on a cycle, the cycle as text from the page on.

    Pages without a way in or a way out are peeled off, four times before each writing, until none is
    left; what remains is cycles and the ways between them. Of each connected part of that, a task
    keeps the edges between pages that reach each other and looks for the first way back on these.
    """
    core = stage(chain_edges(facts, paths), "chain-edges")
    n = core.count()
    for _ in range(ROUNDS * 50):
        kept = core
        for _ in range(4):
            kept = kept.join(kept.select(F.col("next").alias("path")).distinct(), "path", "left_semi").join(kept.select(F.col("path").alias("next")).distinct(), "next", "left_semi").select("path", "next")
        before, core = core, stage(kept, "chain-core")
        unstage(before)
        left = core.count()
        if left in (0, n):
            break
        n = left
    else:
        raise RuntimeError("the chains are longer than any that pages can have")
    part = connected(core.select(F.col("path").alias("a"), F.col("next").alias("b")), "chain-parts")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        following = {p: sorted(g) for p, g in frame.groupby("path")["next"]}
        strong = strong_parts(following)
        inside = {p: [q for q in following[p] if strong.get(q) == strong[p]] for p in strong}
        rows = [(p, " → ".join(c)) for p in inside if (c := first_cycle(p, inside))]
        return pd.DataFrame(rows, columns=["path", "cycle"])

    cycles = core.join(part.withColumnRenamed("node", "path"), "path").groupBy("part").applyInPandas(run, "path string, cycle string")
    first = facts.chain.groupBy("path").agg(F.min_by("line", "pos").alias("line"))
    return cycles.join(first, "path").select("path", "line", "cycle")


def walk(roots: DataFrame, facts: Facts, paths: DataFrame, depth: int = 1, max_nodes: int = MAX_NODES) -> DataFrame:
    """``(root, depth, path, via, seen)`` of the pages within ``depth`` links of the roots ``(path)``.

    ``via`` is the page that links; ``seen`` marks a page met before from the same root, which isn't
    followed again. A root that passes the cap isn't followed further; ``capped`` tells.
    """
    found = links.resolve(facts.links.where("target <> ''").select("target").distinct(), paths)
    steps = stage(facts.links.where("target <> ''").join(found.where("resolved IS NOT NULL"), "target").select(F.col("path").alias("via"), F.col("resolved").alias("path")).distinct(), "walk-steps")
    out = stage(roots.select(F.col("path").alias("root"), F.lit(0).alias("depth"), "path", F.lit(None).cast("string").alias("via"), F.lit(False).alias("seen")).distinct(), "walk-0")
    frontier = out
    for level in range(1, depth + 1):
        full = out.groupBy("root").agg(F.countDistinct("path").alias("n")).where(F.col("n") > max_nodes).select("root")
        kids = frontier.where("NOT seen").join(full, "root", "left_anti").select("root", F.col("path").alias("via")).join(steps, "via")
        known = out.select("root", "path").distinct().withColumn("known", F.lit(True))
        ranked = kids.groupBy("root", "path").agg(F.min("via").alias("first"), F.collect_set("via").alias("vias")).join(known, ["root", "path"], "left")
        rows = ranked.select("root", F.lit(level).alias("depth"), "path", F.explode("vias").alias("via"), "first", "known")
        frontier = stage(rows.select("root", "depth", "path", "via", (F.coalesce("known", F.lit(False)) | (F.col("via") != F.col("first"))).alias("seen")), f"walk-{level}")
        out = out.unionByName(frontier)
    full = out.groupBy("root").agg(F.countDistinct("path").alias("n"))
    return out.join(full, "root").withColumn("capped", F.col("n") > max_nodes).drop("n")


def expand(text: str, fetch: Callable[[str, str], tuple[tuple[str, str], str] | None], on_path: tuple = (), strict: bool = False, depth: int = 0) -> str:
    """A text with its embeds replaced by what they embed, for one page on the driver.

    ``fetch`` gives the node and text of (target, anchor). A cycle or what can't be fetched stays as it
    is written, or raises ValueError if ``strict``; so does more depth than the cap.
    """
    from quillmere.functions.markdown import WIKILINK, link_fragment, link_target

    if depth > EXPAND_DEPTH:
        raise ValueError("embeds nested too deep")
    out, at = [], 0
    for m in WIKILINK.finditer(text):
        if m.start() and text[m.start() - 1] == "!":
            found = fetch(link_target(m.group(1)), link_fragment(m.group(1)))
            if found is None or found[0] in on_path:
                if strict:
                    raise ValueError(f"cannot expand {m.group()}" + (": cycle" if found else ""))
                continue
            out += [text[at : m.start() - 1], expand(found[1], fetch, (*on_path, found[0]), strict, depth + 1)]
            at = m.end()
    return "".join([*out, text[at:]])
