import random
import re

import pytest

from quillmere.functions import markdown as M

PAGE = """---
tags: [type/effect]
title: ' A page '
---
# Top
See [[wiki/a#Sec|x]] and `[[code]]` and ![[emb#^b1]].

```yaml
[[fenced]]
# no heading
```
^blk

## Sub
para one ^inl
more
## Sub
# Top
"""


def test_frontmatter_cases():
    fm = M.parse_frontmatter(PAGE)
    assert fm.present and not fm.error and fm.values["tags"] == ["type/effect"] and fm.body_offset == 5 and fm.body.startswith("# Top")
    assert M.parse_frontmatter("no front") == M.Frontmatter(False, False, {}, "no front", 1)
    for bad in ("---\na: 1\n", "---\n: [\n---\nx", "---\n- a\n---\n"):
        fm = M.parse_frontmatter(bad)
        assert fm.error and fm.body == "" and fm.body_offset == 0
    assert M.parse_frontmatter("﻿--- \n---\nx").body == "x"
    assert M.parse_frontmatter("").body == ""
    values = M.parse_frontmatter("---\non: yes\nd: 2026-02-30\ne: 2026-02-03\nt: 1:30\nn: 012\nz: ~\n---\n").values
    assert (values["on"], values["d"], values["t"], values["n"], values["z"]) == ("yes", "2026-02-30", "1:30", 10, None) and M.yaml_kind(values["e"]) == "date"


def test_body_facts():
    fm = M.parse_frontmatter(PAGE)
    links, headings = M.body_facts(fm.body, fm.body_offset)
    assert [(x["target"], x["fragment"], x["is_embed"], x["line"], x["col"]) for x in links] == [("wiki/a", "Sec", False, 6, 5), ("emb", "^b1", True, 6, 42)]
    assert [(h["level"], h["text"], h["line"]) for h in headings] == [(1, "Top", 5), (2, "Sub", 14), (2, "Sub", 17), (1, "Top", 18)]


def test_code_inside_a_link_is_removed_and_columns_stay():
    links, _ = M.body_facts("é [[a`x`b]] [[c\\]] [[d/]] [[#only]]", 1)
    assert [(x["target"], x["original"], x["col"]) for x in links] == [("ab", "[[a`x`b]]", 4), ("c", "[[c\\]]", 14), ("d", "[[d/]]", 21), ("", "[[#only]]", 28)]


@pytest.mark.parametrize(
    "mode,text,fenced",
    [
        ("facts", "````\n```\nx\n`````\ny", [1, 1, 1, 1, 0]),
        ("facts", "  ~~~ lang\nx\n~~~ tail\ny", [1, 1, 1, 0]),
        ("slices", "  ```\nx", [0, 0]),
        ("slices", "```\nx\n``` tail\ny\n```\nz", [1, 1, 1, 1, 1, 0]),
        ("move", "````\nx\n```\ny", [1, 1, 1, 0]),
        ("toggle", "```\nx\n~~~\ny", [1, 1, 1, 0]),
    ],
)
def test_fences(mode, text, fenced):
    assert [int(line.fenced or line.delimiter) for line in M.walk(text, mode)] == fenced


def test_slices_and_blocks():
    s = {x.anchor: x for x in M.slices(PAGE)}
    assert set(s) == {"", "Top", "Sub", "^blk", "^inl"}
    assert (s["Sub"].start, s["Sub"].end) == (14, 17) and s["^blk"].fence and s["^blk"].lang == "yaml" and s["^blk"].code == "[[fenced]]\n# no heading\n"
    assert (s["^blk"].start, s["^blk"].end) == (8, 12) and s["^inl"].text == "## Sub\npara one\nmore\n## Sub\n# Top\n" and (s["^inl"].start, s["^inl"].end) == (14, 19)
    assert M.section(PAGE, "sub").startswith("## Sub\npara")
    twice = M.slices("x ^a\n\ny ^a\n")
    assert [x.anchor for x in twice] == [""]


def test_norm_v1_is_idempotent():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("a \t\r\n") for _ in range(rng.randrange(20)))
        once = M.norm_v1(text)
        assert M.norm_v1(once) == once and once.endswith("\n") and not re.search(r"[ \t]\n|\n\n\n", once.strip("\n") + "\n")


def test_code_spans():
    assert M.code_spans("`a` [[x]] `b`") == [(0, 3), (10, 13)]
    assert M.code_spans("``a`b`` c`") == [(0, 7)]
    assert [f["match"] for f in M.quoted_links("`a` [[x]] `b [[y]]`\n```\n`[[z]]`\n```", 1)] == ["[[y]]"]


def test_suppressions():
    body = "<!-- md-disable-next-line a, b -->\nx\nx <!-- md:ignore c -->\n%% md:ignore %%\ny\n<!-- md:ignore-file d -->\n%% md:ignore-file %%"
    lines, whole = M.suppressions(body, 10)
    assert lines == {11: {"a", "b"}, 12: {"c"}, 14: {"*"}} and whole == ["d", "*"]


def test_chain_block():
    page = "x\n\n```yaml\n- ref: '[[a#S]]'\n  hash: merkle-v1:aa\n- claim: |\n    - ref: no\n  ref: '[[b]]'\n  hash: null\nhash-algo: v2 # c\n```\n^inputs\n"
    block = next(s for s in M.slices(page) if s.anchor == "^inputs")
    items, algo = M.chain_block(block)
    assert [(i.ref, i.hash, i.line) for i in items] == [("[[a#S]]", "merkle-v1:aa", 4), ("[[b]]", "", 8)] and algo == "v2"


def test_tables_and_uris():
    body = "| a | b |\n|---|---|\n| [[x|y]] | z |\n\n| [[lone|row]] |\n"
    assert M.table_pipes(body, 1) == [{"line": 3, "expected": 2, "actual": 3, "links": "[[x|y]]"}]
    found = M.bare_uris("see wiki://s/p and [x](wiki://s/q) `wiki://s/r`\n~~~\nwiki://s/t\n```\n[[m#f]]", 1, {"m"})
    assert [(f["line"], f["uri"], f["kind"]) for f in found] == [(1, "wiki://s/p", "bare-uri"), (5, "[[m]]", "cutover-repoint")]


def test_random_bodies_agree_with_a_plain_reader():
    """Links by a plain line reader of the first fence grammar."""
    tokens = ["[[a]]", "![[b#c]]", "`[[d]]`", "[[e|f]]", "```", "~~~", "````", " ", "x", "`", "[[", "]]", "# h"]
    rng = random.Random(7)
    for _ in range(1500):
        body = "\n".join("".join(rng.choice(tokens) for _ in range(rng.randrange(4))) for _ in range(rng.randrange(6)))
        expected, fence = [], ""
        for n, line in enumerate(body.split("\n"), 1):
            m = re.match(r"\s*(`{3,}|~{3,})", line)
            if m:
                if not fence:
                    fence = m.group(1)
                elif line.strip().startswith(fence):
                    fence = ""
                continue
            if not fence:
                expected += [(n, t.split("#")[0].strip()) for t in re.findall(r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]", re.sub("`[^`]+`", "", line))]
        assert [(x["line"], x["target"]) for x in M.body_facts(body, 1)[0]] == expected


def test_slices_take_time_in_proportion():
    import time

    text = "".join(f"{'#' * (1 + i % 6)} h{i}\n\nx ^b{i}\n\n" for i in range(20_000))
    began = time.process_time()
    found = M.slices(text)
    assert time.process_time() - began < 10 and len(found) == 40_001


def test_section_ends_equal_a_walk():
    import random

    rng = random.Random(6)
    for _ in range(40):
        levels = [rng.randrange(1, 5) for _ in range(rng.randrange(12))]
        lines = [x for i, n in enumerate(levels) for x in ("#" * n + f" t{i}", "words")]
        want = [(f"t{i}", 2 * i + 1, next((2 * j + 1 for j in range(i + 1, len(levels)) if levels[j] <= n), 2 * len(levels) + 1)) for i, n in enumerate(levels)]
        assert [(s.anchor, s.start, s.end) for s in M.slices("\n".join(lines)) if s.kind == "section"] == want
