import pytest

from quillmere.operators import reports, rewrites, tasks
from quillmere.plans.engine import Engine
from quillmere.sources import config, corpus, sinks


def engine(spark, pages):
    return Engine(spark, corpus.from_rows(spark, pages))


def test_tasks_and_contracts(spark):
    page = "---\nmd-a: '[[#^a]]'\nmd-a-args: x, y\nmd-all: a, b\nmd-all-env: Z\nmd-c-params: p\nmd-e: ''\n---\n"
    e = engine(spark, [("w/p.md", page), ("w/W.md", "---\nmd-b: '[[#^b]]'\nmd-a: '[[#^z]]'\n---\n"), ("LLM_WIKI.md", "---\nmd-top: '[[#^t]]'\n---\n")])
    rows = {(r.path, r.name): r for r in e.tasks().collect()}
    assert list(rows["w/p.md", "a"].args) == ["x", "y"] and list(rows["w/p.md", "all"].parts) == ["a", "b"] and rows["w/p.md", "a"].ref == "[[#^a]]"
    assert sorted((r.name, r.error) for r in tasks.contract_errors(e.documents).collect()) == [("all", "contract on a composition"), ("c", "contract without a task"), ("e", "empty task")]
    got = {(r.name, r.holder) for r in tasks.inherited(spark.createDataFrame([("w/p.md",)], "path string"), e.tasks()).collect()}
    assert got == {("a", "w/p.md"), ("all", "w/p.md"), ("e", "w/p.md"), ("b", "w/W.md"), ("top", "LLM_WIKI.md")}


def test_expansion():
    assert tasks.expand({"a": None, "b": None, "c": ["a", "d"], "d": ["b", "a"]}, ["c", "b"]) == ["a", "b", "a", "b"]
    for table in ({"a": ["b"], "b": ["a"]}, {"a": ["x"]}, {"a": ["b"] * 300, "b": None}):
        with pytest.raises(ValueError):
            tasks.expand(table, ["a"])


def test_catalog_and_states(spark):
    repo = "---\ntype: repo\nremote: git@h.x:o/r.git\ncommit: abc\n---\n"
    e = engine(spark, [("wiki/sources/git/r/notes.md", repo), ("wiki/sources/git/r/R.md", repo), ("wiki/sources/git/q/x.md", "---\ntype: note\n---\n")])
    catalog = tasks.repo_catalog(e.documents)
    assert [(r.slug, r.path) for r in catalog.collect()] == [("r", "wiki/sources/git/r/R.md")]
    probe = spark.createDataFrame([("r", True, True, False, True, ["https://h.x/o/r"], "abd")], "slug string, found boolean, symlink boolean, symlink_broken boolean, has_git boolean, remotes array<string>, head string")
    assert [(r.state, r.drifted) for r in reports.repo_states(catalog, probe).collect()] == [("symlinked", True)]


def test_conflicts(spark):
    rules = spark.createDataFrame([("a", "pattern", "warn", "filename", "x"), ("b", "pattern", "warn", "filename", "y"), ("c", "pattern", "off", "filename", "z"), ("d", "pattern", "warn", "content", "w"), ("e", "tag-format", "warn", None, None)], "id string, check string, severity string, target string, match string")
    pairs = spark.createDataFrame([(x, y) for x in "abcde" for y in "abcde" if x < y], "rule_a string, rule_b string")
    assert [(r.rule_a, r.rule_b) for r in reports.conflicts(pairs, rules).collect()] == [("a", "b")]


def test_resolve_and_read(spark):
    e = engine(spark, [("d/a.md", "# A\n![[b#Part]] tail\n## Sub\ntext\n"), ("d/b.md", "# B\n## Part\ninner [[a]]\n"), ("x/b2.md", "![[b2]]\n")])
    rows = {r.path: r for r in e.resolve(links=["[[a]]"], depth=1).collect()}
    assert rows["d/a.md"].depth == 0 and rows["d/a.md"].hash.startswith("merkle-v1:") and rows["d/b.md"].depth == 1
    assert e.resolve(page="d/b.md", depth=0).select("path").collect()[0]["path"] == "d/a.md"
    assert e.read("a#sub").startswith("## Sub\ntext") and e.read("[[d/a]]", embeds=True).startswith("# A\n## Part\ninner [[a]]\n")
    assert "![[b2]]" in e.read("b2", embeds=True)
    for bad in (lambda: e.read("nope"), lambda: e.read("b2", embeds=True, strict=True), lambda: e.resolve()):
        with pytest.raises(ValueError):
            bad()


def test_universe_guard(spark):
    paths = spark.createDataFrame([("a.md",)], "path string")
    rewrites.check_universe(paths, paths)
    with pytest.raises(ValueError):
        rewrites.check_universe(spark.createDataFrame([("z.md",)], "path string"), paths)


def test_config(tmp_path, monkeypatch):
    c = config.parse("scan:\n  skip: [x]\nwatch:\n  hooks:\n    modify: {action: lint}\nstrict: true\n")
    assert c.skip == ["x"] and c.hooks == [{"op": "modify", "action": "lint", "scope": "."}] and c.strict and c.debounce_ms == 6000
    for bad in ("nope: 1", "role: king", "watch:\n  hooks:\n    delete: {action: x}\n"):
        with pytest.raises(ValueError):
            config.parse(bad)
    (tmp_path / config.FILE).write_text("")
    (tmp_path / "a" / "b").mkdir(parents=True)
    monkeypatch.delenv(config.ENVIRONMENT, raising=False)
    assert config.discover(str(tmp_path / "a" / "b")) == str(tmp_path / config.FILE)
    assert config.effective_schema({"a": 1, "b": {"c": 1}}, {"b": 2}) == {"a": 1, "b": 2} and config.role("", "team") == "team"
    with pytest.raises(ValueError):
        config.role("team", "public")


def test_run_records(spark):
    page = sinks.run_record(None, {"t": {"exit": 0, "block_sha": "s1"}}, {"t": "out ``` put"})
    page = sinks.run_record(page, {"u": {"exit": 1, "block_sha": "s2"}}, {"u": "two"})
    e = engine(spark, [("d/p.runs.md", page)])
    assert sorted((r.path, r.task, r.block_sha, r.exit) for r in sinks.read_run_records(e.documents).collect()) == [("d/p.md", "t", "s1", 0), ("d/p.md", "u", "s2", 1)]
    assert "out ``` put" in page and page.index("^t") < page.index("^u")


def test_hashes_are_written_in_place():
    from quillmere.operators.attest import write_hashes

    page = "---\nx: 1\n---\ntext  \n```yaml\n- ref: '[[a]]'\n  hash: null\n- claim: |\n    - hash: no\n  ref: '[[b]]'\nhash-algo: v1\n```\n^inputs\nend"
    out = write_hashes(page, {0: "m:1", 1: "m:2"})
    assert out == page.replace("hash: null", "hash: m:1").replace("  ref: '[[b]]'\n", "  ref: '[[b]]'\n  hash: m:2\n")
    assert write_hashes(out, {1: "m:3"}) == out.replace("m:2", "m:3")
    with pytest.raises(ValueError):
        write_hashes(page, {2: "x"})
