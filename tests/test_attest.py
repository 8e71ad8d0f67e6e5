"""Attestation end to end: states, gates, origins, cases, the plan and a second run on what it writes."""

import pytest

from quillmere.operators import attest
from quillmere.operators.pins import World
from quillmere.plans.engine import Engine
from quillmere.sources import corpus

HEAD = "---\ntags: [type/effect]\n{}\n---\nText.\n"
INPUTS = "\n```yaml\n{}hash-algo: v1\n```\n^inputs\n"
ITEM = "- ref: '[[{}]]'\n"
POINTED = "inputs: '[[#^inputs]]'\nreceipt:{}\nrepo: r\nbranch: main\nlocation: {}"
GATE = "path string, exit int, detail string"


def engine(spark, pages):
    return Engine(spark, corpus.from_rows(spark, pages))


def of(spark, e, tip="c2", files=("a.txt",), ancestry=(("c1", "c2"), ("c1", "origin/main"))):
    objects = [("r", "origin/main", tip, "commit"), ("r", "c1", "c1", "commit"), ("r", "c9", "c9", "commit"), *(("r", f"{c}:{f}", f"{f}@{c}", "blob") for c in (tip, "c1", "c9") for f in files)]
    world = World(
        spark.createDataFrame(objects, "repo string, name string, oid string, type string"),
        spark.createDataFrame([("r", *a) for a in ancestry], "repo string, commit string, ref string"),
        spark.createDataFrame([("r", "main")], "repo string, branch string"),
        spark.createDataFrame([("r", False, False)], "repo string, owned boolean, batch_failed boolean"),
        spark.createDataFrame([("own", "dir")], "repo string, path string"),
    )
    return attest.Corpus(e.documents, e.facts, e.paths, world, "own")


def report(df):
    return {r.path: r for r in df.collect()}


@pytest.fixture(scope="module")
def pages():
    item = ITEM.format("src")
    return [
        ("src.md", "# Source\nwords\n"),
        ("e/first.md", HEAD.format(POINTED.format("", "a.txt")) + INPUTS.format(item)),
        ("e/owned.md", HEAD.format("inputs: '[[#^inputs]]'\nrepo: own\nlocation: dir/") + INPUTS.format(item + "  hash: 'old'\n")),
        ("e/nowhere.md", HEAD.format("inputs: '[[#^inputs]]'\nrepo: own\nlocation: lost") + INPUTS.format(item)),
        ("e/legacy.md", HEAD.format("commit: abc\nrepo: r")),
        ("e/bare.md", HEAD.format("repo: r")),
        ("e/lost.md", HEAD.format(POINTED.format("", "no.txt")) + INPUTS.format(item)),
        ("e/dead.md", HEAD.format(POINTED.format("", "a.txt")) + INPUTS.format(ITEM.format("gone"))),
        ("e/red.md", HEAD.format(POINTED.format("", "a.txt")) + INPUTS.format(item)),
        ("e/unchecked.md", HEAD.format(POINTED.format("", "a.txt")) + INPUTS.format(item)),
        ("other.md", "[[src]]\n"),
    ]


def gate(spark, pages):
    rows = [(p, 1 if "red" in p else 0, "boom" if "red" in p else "") for p, _ in pages if "unchecked" not in p]
    return spark.createDataFrame(rows, GATE)


def test_pipeline(spark, pages):
    c = of(spark, e := engine(spark, pages))
    first = attest.attest(c, gate(spark, pages))
    got = {p.split("/")[-1][:-3]: (r.status, r.case, r.reason) for p, r in report(first).items()}
    assert got == {
        "first": ("attested", "first", None), "owned": ("attested", "inputs-only", None), "nowhere": ("failed", None, "owned location lost is missing from the working tree"), "legacy": ("skipped", None, "legacy shape"),
        "bare": ("failed", None, "no inputs"), "lost": ("failed", None, "location no.txt does not exist at c2"), "dead": ("failed", None, "input 1 [[gone]]: unresolved"), "red": ("failed", None, "^check failed (exit 1): boom"), "unchecked": ("failed", None, "no result of ^check"),
    }
    plan = {r.path: r.after for r in attest.write_plan(e.documents, first, "2025-01-01T00:00:00Z", "fine").collect()}
    assert set(plan) == {"e/first.md", "e/owned.md"}
    assert "receipt: '[[#^receipt]]'" in plan["e/first.md"] and "commit: c2\nchecksum: a.txt@c2\napplied_at: 2025-01-01T00:00:00Z\nverdict: 'fine'\nprocedure-hash: 'proc-v1:" in plan["e/first.md"]
    assert "receipt" not in plan["e/owned.md"] and "hash: old" not in plan["e/owned.md"] and "merkle-v1:" in plan["e/owned.md"]

    # what was written is unchanged; a moved tree, a moved input and a commit behind are told apart
    later = [(p, plan.get(p, text)) for p, text in pages]
    again = report(attest.attest(of(spark, e2 := engine(spark, later)), gate(spark, later)))
    assert {again[p].status for p in plan} == {"unchanged"}
    moved = report(attest.attest(of(spark, e2, tip="c3", ancestry=(("c2", "c3"),)), gate(spark, later)))
    assert (moved["e/first.md"].status, moved["e/first.md"].case, moved["e/first.md"].target) == ("attested", "tree", "c3")
    behind = spark.createDataFrame([("e/first.md", "c1")], "path string, commit string")
    assert report(attest.attest(of(spark, e2), gate(spark, later), commits=behind))["e/first.md"].status == "refused"
    stray = spark.createDataFrame([("e/first.md", "c9")], "path string, commit string")
    assert report(attest.attest(of(spark, e2), gate(spark, later), commits=stray))["e/first.md"].reason == "commit c9 is not on origin/main"

    edited = [(p, "# Source\nother words\n" if p == "src.md" else text) for p, text in later]
    c3 = of(spark, e3 := engine(spark, edited))
    history = spark.createDataFrame([("src.md", "k1"), ("src.md", "k2"), ("x.md", "k3")], "path string, commit string")
    ancestry = spark.createDataFrame([("k1", "k2")], "commit string, ref string")
    assert [r.path for r in attest.unexplained(history, ancestry, ["k2"]).collect()] == ["x.md"]
    assert {r.path for r in attest.unexplained(history, ancestry, []).collect()} == {"src.md", "x.md"}
    dirty = spark.createDataFrame([("src.md",)], "path string")
    swept = attest.reattest(c3, attest.unexplained(history, ancestry, ["k2"]))
    assert {p.split("/")[-1]: r.status for p, r in report(swept).items()} == {
        "first.md": "reattested", "owned.md": "reattested", "legacy.md": "skipped", "bare.md": "failed", "dead.md": "failed", "lost.md": "needs_realise", "nowhere.md": "reattested", "red.md": "needs_realise", "unchecked.md": "needs_realise",
    }
    renewed = {r.path: r.after for r in attest.write_plan(e3.documents, swept, "2026-01-01T00:00:00Z").collect()}["e/first.md"]
    assert "applied_at: 2026-01-01T00:00:00Z" in renewed and "commit: c2" in renewed and renewed.count("hash: merkle-v1:") == 1
    guarded = report(attest.reattest(c3, attest.unexplained(history, ancestry, ["k2"], dirty)))
    assert guarded["e/first.md"].status == "needs_realise" and "src.md" in guarded["e/first.md"].reason


def test_receipt_lines():
    text = "---\nreceipt: '[[#^receipt]]'\n---\n```yaml\ncommit: a\nchecksum:\n  - x\n  - y\nnote: stays\n```\n^receipt\n"
    out = attest.write_receipt(text, {"checksum": "[p, q]", "verdict": "'ok'"})
    assert out == "---\nreceipt: '[[#^receipt]]'\n---\n```yaml\ncommit: a\nchecksum: [p, q]\nnote: stays\nverdict: 'ok'\n```\n^receipt\n"


def test_promotions(spark):
    pages = [
        ("src.md", "# S\n"), ("e/a.md", HEAD.format("draws-from: ['[[src]]', '[[gone]]', plain]")), ("e/b.md", HEAD.format("draws-from: '[[src#S|shown]]'\ninputs: '[[#^inputs]]'") + INPUTS.format(ITEM.format("src"))),
        ("e/c.md", HEAD.format("draws-from: ['[[gone]]']")), ("plain.md", "---\ndraws-from: ['[[src]]']\n---\n"),
    ]
    c = of(spark, engine(spark, pages))
    assert {(r.path, r.pos): r.problem for r in attest.draws(c).collect()} == {("e/a.md", 0): None, ("e/a.md", 1): "unresolved", ("e/a.md", 2): "no link", ("e/b.md", 0): None, ("e/c.md", 0): "unresolved"}
    got = {r.path: (r.block, r.skip) for r in attest.promotions(c).collect()}
    assert got["e/a.md"][1] is None and got["e/a.md"][0].startswith("- ref: '[[src]]'\n  hash: merkle-v1:") and "gone" not in got["e/a.md"][0]
    assert got["e/b.md"][1] == "the page has inputs" and got["e/c.md"] == (None, "nothing to draw from resolves") and len(got) == 3
