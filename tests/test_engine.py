"""The engine on small corpora: real rules through scan, facts, checks, selection, suppression and order."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillmere.operators import attest, cache, graph, pins, rewrites
from quillmere.operators.facts import Facts, extract
from quillmere.plans.engine import Engine, FatalRule
from quillmere.sources import corpus, sinks
from quillmere.sources.rules import Rule, RuleError, load_markdown, load_yaml, profile, union


def engine(spark, pages, **kw):
    return Engine(spark, corpus.from_rows(spark, pages), **kw)


def run(e, *rules, **kw):
    return [(r.rule_id, r.file_path, r.line, r.message) for r in e.check(list(rules), **kw).collect()]


def rule(check, message="{{.Message}}", on=("**",), severity="warn", id=None, **params):
    return Rule(id or check, check, severity, list(on), params, message)


FM = "---\n{}\n---\n"


def test_links(spark):
    pages = [
        ("a/x.md", "[[y]] [[gone]] [[b/y]] [[wrong/y#f]] [[dup]]\n```\n[[no]]\n```\n"), ("b/y.md", "x"), ("b/dup.md", "x"), ("c/dup.md", "x"), ("foreign/z.md", "[[nowhere]]"), ("c/INDEX.md", "[[c]] [[z]]"),
        ("node_modules/q.md", "[[nope]]"),
    ]
    e = engine(spark, pages, foreign_roots=["foreign"])
    broken = rule("broken-wikilink", "{{.Type}} [[{{.Target}}]]", **{"skip-prefixes": ["http"]})
    assert run(e, broken) == [("broken-wikilink", "a/x.md", 1, "BROKEN [[gone]]")]
    assert run(e, rule("broken-wikilink", "{{.Type}} {{.Target}}", scope=["a/**", "b/**"])) == [("broken-wikilink", "a/x.md", 1, "BROKEN gone"), ("broken-wikilink", "c/INDEX.md", 1, "ESCAPE c"), ("broken-wikilink", "c/INDEX.md", 1, "ESCAPE z")]
    assert run(e, rule("ambiguous-wikilink", "{{.Target}} {{.Count}} {{.Paths}}")) == [("ambiguous-wikilink", "a/x.md", 1, "dup 2 b/dup.md, c/dup.md")]
    assert run(e, rule("wikilink-canonicalize", "{{.Target}}>{{.Canonical}}")) == [("wikilink-canonicalize", "a/x.md", 1, "b/y>y"), ("wikilink-canonicalize", "a/x.md", 1, "wrong/y>y")]
    assert run(e, broken, scope="b") == []


def test_selection_suppression_and_order(spark):
    page = FM.format("tags: [type/x]\nlint-ignore: [quiet]") + "[[g1]]\n[[g2]] <!-- md:ignore broken-wikilink -->\n[[g3]] [[g4]]\n"
    e = engine(spark, [("p.md", page), ("q.md", "[[g5]]")])
    broken = rule("broken-wikilink", "{{.Target}}", on=["#type/x"])
    assert run(e, broken) == [("broken-wikilink", "p.md", 5, "g1"), ("broken-wikilink", "p.md", 7, "g3"), ("broken-wikilink", "p.md", 7, "g4")]
    assert [f[1] for f in run(e, rule("broken-wikilink", "{{.Target}}", id="quiet"))] == ["q.md"]
    assert run(e, rule("broken-wikilink", severity="off")) == []
    assert run(e, rule("no-such-check")) == [] and e.warnings[-1][0] == "CHECK_NOT_REGISTERED"
    with pytest.raises(FatalRule):
        run(e, Rule("r", "no-such-check", required=True))
    changed = spark.createDataFrame([("q.md",)], "path string")
    assert [r.file_path for r in e.check_paths([rule("broken-wikilink")], changed).collect()] == ["q.md"]


def test_document_checks(spark):
    pages = [
        ("w/2024/12/30/Bad Name.md", FM.format("created: 2024-12-29\ntags: [a, b/c, /d]\nconfidential: internal\nforeign-touched: [s1, s2]\ncommit: abcdef1234567") + "# T\n### Skip\n# T2\nhash abcdef12 and SECRET99\n| a | b |\n|---|---|\n| [[x|y]] | z |\n`[[q]]` wiki://s/p\n"),
        ("broken.md", "---\nx: [\n"),
    ]
    e = engine(spark, pages)
    p = "w/2024/12/30/Bad Name.md"
    assert run(e, rule("field-exists", "{{.Field}}", frontmatter=["created", "title"])) == [("field-exists", "broken.md", 1, "created"), ("field-exists", "broken.md", 1, "title"), ("field-exists", p, 1, "title")]
    assert [f[3] for f in run(e, rule("tag-format", "{{.Tag}}:{{.Prefix}}", prefixes=["b"]))] == ["a:(none)", "/d:(none)"]
    assert [f[1] for f in run(e, rule("pattern", "{{.Filename}}", target="filename", match="^[a-z]+\\.md$"))] == [p]
    assert [(f[2], f[3]) for f in run(e, rule("pattern", "{{.Match}}", target="content", match="SECRET[0-9]+|x: "))] == [(2, "x: "), (11, "SECRET99")]
    assert [(f[2], f[3]) for f in run(e, rule("heading-structure", "{{.Issue}}"))] == [(9, "skipped level: expected H2, got H3"), (10, "multiple H1")]
    assert run(e, rule("partition-date-consistency", "{{.Mismatch}} {{.PathDate}} {{.FmDate}}")) == [("partition-date-consistency", p, 1, "date 2024-12-30 2024-12-29")]
    assert run(e, rule("partition-rollup", "{{.Age}} {{.Suggested}}", reference_time="2025-03-01")) == [("partition-rollup", p, 0, "62 days monthly")]
    assert [(f[2], f[3]) for f in run(e, rule("table-wikilink-pipe", "{{.Expected}} {{.Actual}} {{.Wikilinks}}"))] == [(14, "2 3 [[x|y]]")]
    assert [f[3] for f in run(e, rule("backticked-wikilink", "{{.Match}}"))] == ["[[q]]"]
    assert [f[3] for f in run(e, rule("wiki-navlink", "{{.Kind}} {{.URI}}"))] == ["bare-uri wiki://s/p"]
    assert [(f[2], f[3]) for f in run(e, rule("body-value-echo", "{{.Reason}}"))] == [(11, 'body echoes pin value "abcdef12"')]
    tiers = rule("tier-downgrade", "{{.PageTier}} {{.SourceTier}} {{.Source}}", **{"wiki-tiers": {"S1": "secret", "s2": "secret", "s3": "odd"}, "target-tier": "public"})
    assert run(e, tiers) == [("tier-downgrade", "broken.md", 0, "(config) odd s3"), ("tier-downgrade", p, 0, "(config) odd s3"), ("tier-downgrade", p, 1, "internal secret s1")]


def test_property_rules(spark):
    pages = [("a/p.md", FM.format("date: 2026-02-30\nday: 2024-01-02\nkind: x\ntags: [t/ok, bad, u/v]\nsee: '[[a/p|p]]'\nrefs: ['[[gone]]', a/p]")), ("q.md", "x")]
    e = engine(spark, pages)
    assert run(e, rule("property", property=["date"], required=True, date=True)) == [("property", "a/p.md", 0, "date: not a date by 2006-01-02"), ("property", "q.md", 1, "date: missing required field")]
    assert run(e, rule("property", property=["day"], date={"format": "02.01.2006"})) == []
    assert [f[3] for f in run(e, rule("property", property=["kind"], text={"match": "^y", "in": ["z"]}))] == ["kind: does not match pattern \"^y\"", "kind: not in allowed values [z]"]
    assert sorted(f[3] for f in run(e, rule("property", property=["tags"], tag={"prefix": {"in": ["t"]}, "value": {"match": "^ok$"}}))) == ["tags: tag missing prefix/value separator", 'tags: unknown prefix "u"', 'tags: value does not match pattern "^ok$"']
    assert [f[3] for f in run(e, rule("property", property=["refs"], wikilink={"resolve": "file_exists"}))] == ["refs: gone — file_exists: target not found"]
    display = {"link_display": {"templates": [{"when": "a/**", "format": "{{.Target | base}}!"}]}}
    assert [f[3] for f in run(e, rule("property", property=["see"], wikilink=display))] == ["see: [[a/p|p]] display should be p!"]
    assert [f[3] for f in run(e, rule("link-resolve", "{{.Field}} {{.Target}}", frontmatter=["refs", "see"]))] == ["refs gone"]


EFFECT = FM.format("tags: [type/effect]\ninputs: '[[#^inputs]]'\nreceipt: null\nrepo: r\nlocation: d") + "# E\n\n```yaml\n- ref: '[[dep#Spec]]'\n  hash: {}\n```\n^inputs\n"


def test_chains(spark):
    dep = "# D\n## Spec\ntext ![[leaf]]\n"
    e0 = engine(spark, [("e.md", EFFECT.format("null")), ("dep.md", dep), ("leaf.md", "leaf\n")])
    root = spark.createDataFrame([("dep.md", "Spec")], "path string, anchor string")
    got = graph.compose(root, e0.facts, e0.paths).first()
    import hashlib

    from quillmere.functions.markdown import slice_hash

    leaf = hashlib.sha256(bytes.fromhex(slice_hash("leaf\n\n"))).digest()
    spec = hashlib.sha256(bytes.fromhex(slice_hash("## Spec\ntext ![[leaf]]\n\n")) + leaf).hexdigest()
    assert (got.hash, got.cause) == (f"merkle-v1:{spec}", None)
    chain = rule("chain-fresh", "{{.Cause}} {{.Ref}}")
    assert run(e0, chain) == []
    assert run(engine(spark, [("e.md", EFFECT.format("merkle-v1:" + spec[:12])), ("dep.md", dep), ("leaf.md", "leaf\n")]), chain) == []
    assert [f[3] for f in run(engine(spark, [("e.md", EFFECT.format("merkle-v1:" + "0" * 64)), ("dep.md", dep), ("leaf.md", "leaf\n")]), chain)] == ["stale [[dep#Spec]]"]
    assert [f[3] for f in run(engine(spark, [("e.md", EFFECT.format("null")), ("dep.md", "# D\n")]), chain)] == ["dangling-anchor [[dep#Spec]]"]
    assert [f[3] for f in run(engine(spark, [("e.md", EFFECT.format("null"))]), chain)] == ["unresolved [[dep#Spec]]"]
    assert [f[3] for f in run(e0, rule("effect-unpinned", "{{.Reason}}"))] == ["born-invalid"]
    assert run(e0, rule("effect-rootless", "{{.Reason}}")) == []
    assert [f[3] for f in run(e0, rule("repo-cataloged", "{{.Repo}}"))] == ["r"]


def test_cycles_and_walks(spark):
    page = FM.format("tags: [type/effect]\ninputs: x") + "```yaml\n- ref: '[[{}]]'\n```\n^inputs\n[[{}]]\n"
    e = engine(spark, [("a.md", page.format("b", "b")), ("b.md", page.format("c", "c")), ("c.md", page.format("a", "a")), ("d.md", page.format("a", "a")), ("s.md", page.format("s", "d"))])
    found = run(e, rule("chain-fresh", "{{.Ref}}", **{"class": "acyclic"}))
    assert [(f[1], f[3]) for f in found] == [("a.md", "a.md → b.md → c.md → a.md"), ("b.md", "b.md → c.md → a.md → b.md"), ("c.md", "c.md → a.md → b.md → c.md")]
    walked = graph.walk(spark.createDataFrame([("s.md",)], "path string"), e.facts, e.paths, depth=5).orderBy("depth").collect()
    assert [(r.depth, r.path, r.seen) for r in walked] == [(0, "s.md", False), (1, "d.md", False), (2, "a.md", False), (3, "b.md", False), (4, "c.md", False), (5, "a.md", True)]
    embed = engine(spark, [("x.md", "![[y]]\n"), ("y.md", "![[x]]\n")])
    rows = graph.compose(spark.createDataFrame([("x.md", ""), ("y.md", "")], "path string, anchor string"), embed.facts, embed.paths).collect()
    assert all(r.hash and r.cause is None for r in rows) and len({r.hash for r in rows}) == 2


def test_pin_scenarios(spark):
    pin = lambda name, commit, sums, locs=("d",), repo="r", branch="main": (name, repo, branch, commit, list(locs), list(sums), True, False, False, False, "", False)
    schema = "path string, repo string, branch string, commit string, locations array<string>, checksums array<string>, has_fm_commit boolean, has_inputs boolean, has_receipt_key boolean, receipt_null boolean, receipt_ref string, receipt_block boolean"
    rows = [pin("valid", "C1", ["o1"]), pin("stale", "C0", ["o0"]), pin("dangling", "XX", ["o1"]), pin("local", "CX", ["o1"]), pin("mismatch", "C1", ["o0"]), pin("absent", "C1", ["o1"], repo="gone"), pin("incomplete", "C1", ["o1"], branch=""), pin("unsafe", "-C1", ["o1"])]
    objects = [("r", "C0", "C0", "commit"), ("r", "C1", "C1", "commit"), ("r", "CX", "CX", "commit"), ("r", "origin/main", "C1", "commit"), ("r", "C0:d", "o0", "blob"), ("r", "C1:d", "o1", "blob"), ("r", "CX:d", "o1", "blob"), ("r", "origin/main:d", "o1", "blob")]
    world = pins.World(
        spark.createDataFrame(objects, "repo string, name string, oid string, type string"), spark.createDataFrame([("r", "C0", "origin/main"), ("r", "C1", "origin/main")], "repo string, commit string, ref string"),
        spark.createDataFrame([], "repo string, branch string"), spark.createDataFrame([("r", False, False)], "repo string, owned boolean, batch_failed boolean"),
    )
    p = spark.createDataFrame(rows, schema)
    names = lambda df: sorted(r.path for r in df.collect())
    assert names(pins.resolves(p, world)) == ["dangling", "incomplete", "unsafe"]
    assert names(pins.on_origin(p, world)) == ["local"]
    assert names(pins.checksum_reproduces(p, world)) == ["mismatch"]
    assert names(pins.stale(p, world)) == ["stale"]
    assert names(pins.stale(p, world, report_absent=True)) == ["absent", "stale"]


def test_rule_loading():
    r = load_yaml("check: broken-wikilink\non: '**'\nseverity: error\nmessage: '{{.Target}}'\nroots: ['**']\n", "r")
    assert (r.check, r.severity, r.on, r.params) == ("broken-wikilink", "error", ["**"], {"roots": ["**"]})
    for bad in ("check: a", "check: a\nproperty: b", "x: 1", "- a", "check: a\non: '['\nseverity: warn\nmessage: '{{x'", "check: a\non: x\nseverity: loud\nmessage: m", "a: " + "[" * 12 + "]" * 12):
        with pytest.raises(RuleError):
            load_yaml(bad, "bad")
    page = "---\nmd-rule: '[[self#^rule]]'\n---\n```yaml\nproperty: tags\nrequired: true\n```\n^rule\n"
    assert load_markdown(page, "lit")[0].params["property"] == ["tags"] and load_markdown("# doc", "doc")[0] is None
    with pytest.raises(RuleError):
        union([r], [r])
    assert [x.severity for x in profile([r], ["r*"], override={"r": "info"})] == ["info"] and profile([r], exclude=["*"]) == []


def test_rewrites(spark, tmp_path):
    pages = [("a/x.md", "| [[b/y|z]] | w |\n|---|---|\n| [[b/y#s|t]] | w |\n"), ("b/y.md", "see wiki://s/p `wiki://s/q`\n")]
    e = engine(spark, pages)
    rules = [rule("field-exists", frontmatter=["tags"]), rule("table-wikilink-pipe"), rule("wiki-navlink", mapping={}), rule("wikilink-canonicalize")]
    canonical = rewrites.canonical_targets(e.facts.links.where("target <> ''"), e.paths)
    plan = {r.path: r for r in rewrites.fix_plan(e.documents, e.check(rules), rules, "2025-01-02", canonical).collect()}
    assert plan["a/x.md"].after == "---\ntags: []\n---\n| [[y\\|z]] | w |\n|---|---|\n| [[y#s\\|t]] | w |\n" or "\\|" in plan["a/x.md"].after
    assert "[wiki://s/p](obsidian://open?vault=s&file=p) `wiki://s/q`" in plan["b/y.md"].after
    moved = {r.path: r.after for r in e.move_plan("b/y.md", "c/new.md").collect()}
    assert moved["a/x.md"].startswith("| [[c/new|z]]")
    with pytest.raises(ValueError, match="did you mean 'frontmatter'"):
        rewrites.validate([rule("field-exists", frontmater=["x"])])
    for path, text in pages:
        sinks.write_page(str(tmp_path), path, None, text)
    done, failed = sinks.apply_plan(e.move_plan("b/y.md", "c/new.md"), str(tmp_path))
    assert done == ["a/x.md"] and failed == {}
    assert sinks.apply_plan(e.move_plan("b/y.md", "c/new.md"), str(tmp_path))[1]["a/x.md"].endswith("changed since it was read")
    tree = corpus.read_tree(spark, str(tmp_path))
    assert sorted((r.path, r.content[:12]) for r in tree.collect()) == [("a/x.md", "| [[c/new|z]"), ("b/y.md", "see wiki://s")]
    assert sorted(r.path for r in corpus.paths(spark, str(tmp_path)).collect()) == ["a/x.md", "b/y.md"]


def test_cache_equals_fresh(spark, tmp_path):
    pages = [("a.md", "[[b]]\n"), ("b.md", "# H\n"), ("c.md", "x ^i\n")]
    docs = engine(spark, pages).documents
    cache.save(spark, extract(docs), docs, str(tmp_path))
    changed = engine(spark, [("a.md", "[[b]]\n"), ("b.md", "# Changed\n"), ("d.md", "new\n")]).documents
    assert cache.divergence(cache.facts_with_cache(spark, changed, str(tmp_path)), extract(changed)).collect() == []
    assert sorted(r.path for r in cache.valid(spark.read.parquet(cache.location(str(tmp_path))), changed).collect()) == ["a.md"]
    assert cache.inventory(spark.read.parquet(cache.location(str(tmp_path)))).agg(F.sum("entries")).first()[0] == 3


def test_cache_in_the_engine(spark, tmp_path):
    pages = [("a.md", "[[b]]\n", 5), ("b.md", "# H\n", 5), ("c.md", "x\n", 5)]
    first = engine(spark, pages, cache_root=str(tmp_path))
    assert first.cached is None and first.stats([], first.check([])).first()["misses"] == 3
    first.save_cache()
    # the text of b differs, but its size and time don't: a page that the cache vouches for isn't opened
    again = engine(spark, [("a.md", "[[b]]\n", 5), ("b.md", "# X\n", 5), ("c.md", "# Y\n", 9)], cache_root=str(tmp_path))
    assert sorted((r.path, r.text) for r in again.facts.headings.collect()) == [("b.md", "H"), ("c.md", "Y")]
    found = again.check([rule("broken-wikilink", "{{.Target}}"), rule("no-such"), rule("no-such")])
    assert again.stats([rule("broken-wikilink")], found).collect() == [(3, 2, 1, round(2 / 3, 9), 0, 1)]
    assert len(again.warnings) == 1


def test_incremental_check_looks_at_changed_pages_only(spark, monkeypatch):
    from quillmere.operators import checks

    seen = []
    own, phase = checks.CHECKS["pattern"]
    monkeypatch.setitem(checks.CHECKS, "pattern", (lambda docs, params, ctx: (seen.append(docs), own(docs, params, ctx))[1], phase))
    e = engine(spark, [("A1.md", "x"), ("B2.md", "x"), ("C3.md", "x")])
    changed = spark.createDataFrame([("B2.md",), ("gone.md",)], "path string")
    found = e.check_paths([rule("pattern", "{{.Filename}}", target="filename", match="^[a-z]+$")], changed)
    assert [r.file_path for r in found.collect()] == ["B2.md"]
    assert [r.path for r in seen[0].select("path").collect()] == ["B2.md"]


def test_move(spark, tmp_path):
    pages = [
        ("wiki/a/one.md", FM.format("tags: [domain/a, x]") + "see [[two]] and [[a/one#h|me]] and `[[a/one]]`\n"), ("wiki/a/two.md", "[[wiki/a/one]]\n```\n[[one]]\n```\n[[b/three]] [[gone]]\n"), ("wiki/b/three.md", "[[one]] [[two]]\n"), ("wiki/z.md", "nothing\n"),
    ]
    e = engine(spark, pages)
    moves = rewrites.moves_below(e.documents, "wiki/a", "wiki/c/d")
    assert {tuple(r) for r in moves.collect()} == {("wiki/a/one.md", "wiki/c/d/one.md"), ("wiki/a/two.md", "wiki/c/d/two.md")}
    m = e.move(moves, [rule("broken-wikilink", "{{.Target}}")])
    plan = {r.path: r.after for r in m.plan.collect()}
    assert plan == {"wiki/a/one.md": pages[0][1].replace("[[a/one#h|me]]", "[[d/one#h|me]]").replace("`[[a/one]]`", "`[[d/one]]`"), "wiki/a/two.md": pages[1][1].replace("[[wiki/a/one]]", "[[wiki/c/d/one]]")}
    assert [(r.path, r.old_tag, r.new_tag) for r in m.tags.collect()] == [("wiki/c/d/one.md", "domain/a", "domain/c")]
    assert [(r.file_path, r.message) for r in m.findings.collect()] == [("wiki/c/d/two.md", "gone")]
    for path, text in pages:
        sinks.write_page(str(tmp_path), path, None, text)
    done, failed = sinks.apply_move(m, str(tmp_path))
    assert failed == {} and done == ["wiki/a/one.md", "wiki/a/two.md", "wiki/c/d/one.md", "wiki/c/d/two.md"]
    assert sorted(r.path for r in corpus.paths(spark, str(tmp_path)).collect()) == ["wiki/b/three.md", "wiki/c/d/one.md", "wiki/c/d/two.md", "wiki/z.md"]
    assert set(sinks.rename_pages(m.renames, str(tmp_path))[1]) == {"wiki/a/one.md", "wiki/a/two.md"}
    for bad in ([("no.md", "x.md")], [("wiki/z.md", "wiki/b/three.md")], [("wiki/z.md", "y.md"), ("wiki/a/one.md", "y.md")]):
        with pytest.raises(ValueError):
            e.move(spark.createDataFrame(bad, "path string, new_path string"))


def test_results_do_not_depend_on_partitions(spark):
    pages = [(f"d{i % 7}/p{i}.md", f"[[p{i * 3 % 90}]] [[p{i * 5 % 130}]]\n") for i in range(80)]
    e1 = engine(spark, pages)
    e2 = Engine(spark, corpus.from_rows(spark, list(reversed(pages))).repartition(7))
    r = [rule("broken-wikilink", "{{.Target}}"), rule("wikilink-canonicalize", "{{.Canonical}}")]
    assert run(e1, *r) == run(e2, *r) and run(e1, *r)


def test_attest_and_debt(spark):
    states = [("o", False, False, ["a"], ["b"], None, None, None, None), ("f", True, False, [], ["b", "c"], None, None, None, None), ("t", True, True, ["a"], ["a"], "p", "p", ["1"], ["2"]), ("p", True, True, ["a"], ["a"], "p", "q", ["1"], ["1"]), ("i", True, True, ["a", None], ["a", "b"], "p", "p", [], []), ("u", True, True, ["a"], ["a"], "p", "p", [], [])]
    df = spark.createDataFrame(states, "path string, pointed boolean, has_receipt boolean, recorded array<string>, computed array<string>, recorded_procedure string, computed_procedure string, recorded_sums array<string>, computed_sums array<string>")
    assert {r.path: (r.case, r.moves_commit, list(r.write)) for r in attest.classify(df).collect()} == {"o": ("inputs-only", False, [0]), "f": ("first", True, [0, 1]), "t": ("tree", True, []), "p": ("procedure", False, []), "i": ("inputs-only", False, [1])}
    e = engine(spark, [(f"wiki/sources/{n}.md", FM.format(f"tags: [do/incorporate]\n{c}")) for n, c in (("a", "created: 2024-01-02"), ("b", "created: 2025-01-02"), ("c", "x: 1"))] + [("other.md", FM.format("tags: [do/incorporate]"))])
    assert [(r.source[-4], r.created) for r in e.debt().collect()] == [("b", "2025-01-02"), ("a", "2024-01-02"), ("c", "")]
    assert [tuple(r) for r in e.domains().collect()] == [("do", "incorporate", 4)]
    assert '"exit_code": 1' in e.response(e.check([rule("field-exists", "m", severity="error", frontmatter=["z"])]))


def test_watch(spark, tmp_path):
    from quillmere.streaming import watch

    t = lambda s: datetime(2025, 1, 1, 0, 0, s)
    rows = [("a.md", "create", t(1)), ("a.md", "modify", t(3)), ("b.md", "create", t(4)), ("a.md", "delete", t(20)), ("c.md", "modify", t(21))]
    df = spark.createDataFrame(rows, watch.CHANGE)
    assert sorted((r.batch_start.second, r.path, r.op) for r in watch.batches(df).collect()) == [(1, "a.md", "modify"), (1, "b.md", "create"), (20, "a.md", "delete"), (20, "c.md", "modify")]
    hooks = [{"op": "modify", "action": "lint", "scope": "c.md"}, {"op": "create", "action": "index"}]
    assert sorted((r.path, r.action) for r in watch.dispatch(df, hooks).collect()) == [("a.md", "index"), ("b.md", "index"), ("c.md", "lint")]
    listing = lambda rows: spark.createDataFrame(rows, "path string, length long, mtime_ns long")
    diff = watch.snapshot_changes(listing([("a.md", 1, 1), ("b.md", 1, 1), ("x.tmp", 1, 1)]), listing([("a.md", 2, 2), ("c.md", 1, 1)]), "2025-01-01", ["*.tmp"])
    assert sorted((r.path, r.op) for r in diff.collect()) == [("a.md", "modify"), ("b.md", "delete"), ("c.md", "create")]
    runs = spark.createDataFrame([("c.md", t(30))], "path string, ended_at timestamp")
    assert sorted(r.path for r in watch.due(df, runs).collect()) == ["a.md", "b.md"]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    later = spark.createDataFrame([("z.md", "create", datetime(2025, 1, 1, 1, 0))], watch.CHANGE)
    later.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(watch.CHANGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = watch.start(stream, lambda rows: seen.extend((r.path, r.op) for r in rows.collect()), str(tmp_path / "ck"), once=True)
    q.awaitTermination(120)
    assert sorted(seen) == [("a.md", "delete"), ("a.md", "modify"), ("b.md", "create"), ("c.md", "modify")]
    assert watch.status(q)["active"] is False and watch.status(q)["error"] is None
    # the batch that was open goes on in the next run
    more = spark.createDataFrame([("y.md", "create", datetime(2025, 1, 1, 1, 0, 3)), ("w.md", "create", datetime(2025, 1, 1, 2, 0))], watch.CHANGE)
    more.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen.clear()
    watch.start(stream, lambda rows: seen.extend((r.batch_start.hour, r.path) for r in rows.collect()), str(tmp_path / "ck"), once=True).awaitTermination(120)
    assert sorted(seen) == [(1, "y.md"), (1, "z.md")]


def test_lists_of_version_control(spark, tmp_path):
    from quillmere.sources import gitlists

    def put(name, *rows):
        (tmp_path / name).write_text("\n".join("\t".join(r) for r in rows) + "\n\nshort\n")
        return str(tmp_path / name)

    oid = "a" * 40
    objects = put("objects", ("r", "c1", f"{oid} commit 12"), ("r", "c1:x", "c1:x missing"), ("r", "c1", f"{oid} commit 12"), ("r", "odd", "what is this"))
    assert [tuple(r) for r in gitlists.read_objects(spark, objects).collect()] == [("r", "c1", oid, "commit")]
    assert [tuple(r) for r in gitlists.read_ancestry(spark, put("anc", ("r", "c1", "origin/main", "0"), ("r", "c2", "origin/main", "1"))).collect()] == [("r", "c1", "origin/main")]
    assert {tuple(r) for r in gitlists.read_times(spark, put("times", ("a.md", "5"), ("a.md", "9"), ("b.md", ""))).collect()} == {("a.md", 9)}
    assert {tuple(r) for r in gitlists.read_history(spark, put("hist", ("c1", "a.md"), ("c1", "a.md"))).collect()} == {("a.md", "c1")}
    assert {tuple(r) for r in gitlists.read_present(spark, put("there", ("r", "pointed", "0"), ("own", "owned", "128"))).collect()} == {("r", False, False), ("own", True, True)}


def test_packs_and_type_blocks(spark):
    from quillmere.operators import property_blocks
    from quillmere.sources.rules import load_pack

    contract, skills = load_pack("contract"), load_pack("skills")
    assert {"broken-wikilink", "frontmatter-minima"} <= {r.id for r in contract} and len(skills) == 4 and len(load_pack("effects")) == 5
    with pytest.raises(RuleError):
        load_pack("none")
    e = engine(spark, [("SKILL.md", "[[refs/lost]] [[notes]] `[[notes]]`\n| a | b |\n|---|---|\n| [[notes|n]] | c |\n"), ("refs/notes.md", "x"), ("setup/notes.md", "y")])
    assert {(f[0], f[1]) for f in run(e, *skills)} == {("broken-wikilink", "SKILL.md"), ("ambiguous-wikilink", "SKILL.md"), ("backticked-wikilink", "SKILL.md"), ("table-wikilink-pipe", "SKILL.md")}
    assert ("frontmatter-minima", "SKILL.md", 1, "the page lacks tags") in run(e, *contract)

    @property_blocks.block("length")
    def length(rows, given, ctx):
        return property_blocks._stream(rows, 0, F.when(F.length("value") > given["most"], F.lit("too long")))

    try:
        rule_ = load_yaml("property: title\nlength: {most: 3}\nmessage: '{{.Message}}'\n", "short-title")
        assert [f[3] for f in run(engine(spark, [("a.md", FM.format("title: abcd")), ("b.md", FM.format("title: abc"))]), rule_)] == ["title: too long"]
    finally:
        del property_blocks.REGISTRY["length"]


def test_empty_corpus(spark):
    e = engine(spark, [])
    assert run(e, rule("broken-wikilink"), rule("field-exists", frontmatter=["x"])) == []
    assert Facts.of(e.documents).links.count() == 0


def test_parts_and_cycles_equal_a_walk(spark):
    import random

    rng = random.Random(8)
    edges = {(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(75)}
    following = {}
    for a, b in sorted(edges):
        if a != b:
            following.setdefault(a, []).append(b)
    reach = {}
    for n in {x for e in edges for x in e}:
        seen, todo = set(), list(following.get(n, []))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += following.get(x, [])
        reach[n] = seen
    strong = graph.strong_parts(following)
    assert set(strong) == {n for n in reach if n in reach[n]}
    assert all((strong[a] == strong[b]) == (b in reach[a] and a in reach[b]) for a in strong for b in strong)
    parts = {r.node: r.part for r in graph.connected(spark.createDataFrame(sorted(edges), "a string, b string")).collect()}
    root = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in range(60):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert parts == root


def test_polling_a_directory(spark, tmp_path):
    from quillmere.streaming import watch

    root, folder = tmp_path / "wiki", str(tmp_path / "watch")
    sinks.write_page(str(root), "a.md", None, "x")
    sinks.write_page(str(root), "b.md", None, "x")
    assert watch.poll(spark, str(root), folder, "2025-01-01 00:00:00") == 2
    assert watch.poll(spark, str(root), folder, "2025-01-01 00:00:01") == 0
    sinks.write_page(str(root), "a.md", None, "longer")
    (root / "b.md").unlink()
    sinks.write_page(str(root), "c.tmp.md", None, "x")
    assert watch.poll(spark, str(root), folder, "2025-01-01 00:01:00", ["*.tmp.md"]) == 2
    got = sorted((r.path, r.op) for r in spark.read.parquet(f"{folder}/changes").collect())
    assert got == [("a.md", "create"), ("a.md", "modify"), ("b.md", "create"), ("b.md", "delete")]


def test_tails_and_probes(spark):
    from quillmere.functions import columns

    texts = ["", "abc", "é" * 5, "x" + "€" * 4, "😀😀", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for most in (1, 3, 4, 7):
        assert [r[0] for r in df.select(columns.tail(F.col("t"), most)).collect()] == [t if t is None else sinks.tail(t, most) for t in texts]
    results = spark.createDataFrame([("a.md", "p1", 0, False, ""), ("a.md", "p2", 3, False, "z" * 5000), ("a.md", "p3", 0, True, None), ("a.md", "p4", None, False, "lost"), ("gone.md", "p", 1, False, "")], "path string, probe string, exit int, timed_out boolean, detail string")
    e = engine(spark, [("a.md", "x"), ("b.md", "y")], outside={"probe_results": results})
    found = run(e, rule("probe", "{{.Probe}}:{{.Detail}}"))
    assert sorted((f[1], f[3].split(":")[0], len(f[3])) for f in found) == [("a.md", "p2", 3 + 4096), ("a.md", "p3", 3), ("a.md", "p4", 7)]
    record = sinks.run_record(None, {"t": {"exit": 0}}, {"t": "y" * 100_000})
    assert 65_536 <= len(record) < 66_000


def test_pages_with_long_lines_are_told(spark):
    pages = [("a.md", FM.format("title: T") + "# H\n" + "x" * 500), ("b.md", "---\nx: [\n---\n"), ("c.md", "fine [[a]]")]
    e = engine(spark, pages, max_line=100)
    assert {(r.path, r.reason[:6]) for r in e.unread().collect()} == {("a.md", "a line"), ("b.md", "frontm")}
    assert e.facts.headings.count() == 0
    free = engine(spark, pages, max_line=0)
    assert [r.path for r in free.unread().collect()] == ["b.md"] and free.facts.headings.count() == 1


def test_levels_of_hashes_equal_recursion(spark):
    import hashlib
    import random

    rng = random.Random(3)
    kids = {n: [rng.randrange(n) for _ in range(rng.randrange(4))] for n in range(1, 40)} | {0: [], 50: [51], 51: [50, 1], 52: [51], 60: [99]}
    leaf = {n: hashlib.sha256(str(n).encode()).hexdigest() for n in kids}

    def digest(n):
        return hashlib.sha256(bytes.fromhex(leaf[n]) + b"".join(bytes.fromhex(digest(k)) for k in kids[n])).hexdigest()

    tree = [(n, pos, k) for n, below in kids.items() for pos, k in enumerate(below)]
    got = graph.compose_levels(spark.createDataFrame(list(leaf.items()), "node long, leaf string"), spark.createDataFrame(tree, "node long, pos long, child long"))
    assert {r.node: r.hash for r in got.collect()} == {n: digest(n) for n in range(40)}
