"""Facts of documents: what a page's own bytes say, extracted once and kept as narrow tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pandas as pd
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.functions import markdown as M
from quillmere.session import stage

_LINK = "array<struct<original:string,target:string,fragment:string,is_embed:boolean,line:int,col:int>>"
_SLICE = "array<struct<anchor:string,kind:string,start_line:int,end_line:int,slice_hash:string>>"
_BLOCK = "array<struct<id:string,fence:boolean,lang:string,code:string,text:string,n_declared:int>>"
_PIN = (
    "struct<repo:string,branch:string,commit:string,locations:array<string>,checksums:array<string>,has_fm_commit:boolean,has_inputs:boolean,has_receipt_key:boolean,receipt_null:boolean,"
    "receipt_ref:string,receipt_block:boolean>"
)
FACTS = (
    f"path string, links {_LINK}, headings array<struct<level:int,text:string,line:int>>, slices {_SLICE}, blocks {_BLOCK}, chain array<struct<ref:string,target:string,anchor:string,hash:string,line:int>>,"
    f" hash_algo string, procedure_hash string, pin {_PIN}, title string, repo_name string, is_repo boolean, tags array<string>"
)


def _pin(values: dict, content: str) -> dict | None:
    text = lambda m, k: m[k].strip() if isinstance(m.get(k), str) else ""
    commit, has_inputs = text(values, "commit"), "inputs" in values
    if not commit and not has_inputs:
        return None
    ref = values.get("receipt")
    pin = {
        "repo": text(values, "repo"), "branch": text(values, "branch"), "commit": commit, "locations": M.string_list(values.get("location")), "checksums": M.string_list(values.get("checksum")),
        "has_fm_commit": bool(commit), "has_inputs": has_inputs, "has_receipt_key": "receipt" in values, "receipt_null": "receipt" in values and ref is None,
        "receipt_ref": ref.strip() if isinstance(ref, str) else "", "receipt_block": False,
    }
    if has_inputs and not commit and pin["receipt_ref"]:
        lines = M.file_lines(content)
        marks = [m for m in M.block_ids(lines) if m[0] == "receipt"]
        block = M.find_block(lines, marks[0][1], marks[0][2], "receipt") if len(marks) == 1 else None
        if block and block.fence:
            try:
                inner = yaml.load(block.code, Loader=M.Loader)
            except yaml.YAMLError:
                inner = None
            if isinstance(inner, dict):
                pin |= {"receipt_block": True, "commit": text(inner, "commit"), "checksums": M.string_list(inner.get("checksum"))}
    return pin


def page_facts(path: str, content: str, is_foreign: bool, max_line: int = M.MAX_LINE) -> dict:
    """One page's facts. Foreign pages have none."""
    empty = {"path": path, "links": [], "headings": [], "slices": [], "blocks": [], "chain": [], "hash_algo": "", "procedure_hash": "", "pin": None, "title": "", "repo_name": "", "is_repo": False, "tags": []}
    if is_foreign:
        return empty
    fm = M.parse_frontmatter(content, max_line)
    links, headings = M.body_facts(fm.body, fm.body_offset)
    slices = M.slices(content) if not fm.error else []
    lines = M.file_lines(content) if not fm.error else []
    marks = M.block_ids(lines)
    names = Counter(m[0] for m in marks)
    blocks, chain, algo, procedure = [], [], "", ""
    for name, at, inline in marks:
        block = M.find_block(lines, at, inline, name)
        if block is None:
            continue
        blocks.append({"id": name, "fence": block.fence, "lang": block.lang, "code": block.code, "text": block.text, "n_declared": names[name]})
        if names[name] == 1 and name == "inputs" and block.fence:
            items, algo = M.chain_block(block)
            for item in items:
                inner = M.bare_ref(item.ref)
                chain.append({"ref": item.ref, "target": M.link_target(inner), "anchor": M.link_fragment(inner), "hash": item.hash, "line": item.line})
        if names[name] == 1 and name == "receipt":
            for line in (block.code or block.text).split("\n"):
                if line.startswith("procedure-hash:"):
                    value = line.split(":", 1)[1].strip()
                    procedure = (value if value[:1] in "'\"" else value.split(" #", 1)[0].strip()).strip("'\"")
    tags = M.string_list(fm.values["tags"], scalar=False) if isinstance(fm.values.get("tags"), list) else []
    text = lambda k: fm.values[k].strip() if isinstance(fm.values.get(k), str) else ""
    return empty | {
        "links": links, "headings": headings, "slices": [{"anchor": s.anchor, "kind": s.kind, "start_line": s.start, "end_line": s.end, "slice_hash": M.slice_hash(s.text)} for s in slices], "blocks": blocks, "chain": chain,
        "hash_algo": algo, "procedure_hash": procedure, "pin": _pin(fm.values, content), "title": text("title"), "repo_name": text("name"), "is_repo": text("type") == "repo" or "type/repo" in tags, "tags": tags,
    }


def _extract(max_line: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [page_facts(p, c or "", bool(f), max_line) for p, c, f in frame[["path", "content", "is_foreign"]].itertuples(index=False)]
        yield pd.DataFrame(rows, columns=["path", "links", "headings", "slices", "blocks", "chain", "hash_algo", "procedure_hash", "pin", "title", "repo_name", "is_repo", "tags"])


def extract(documents: DataFrame, max_line: int = M.MAX_LINE) -> DataFrame:
    """``FACTS`` of every document, in one pass over the content."""
    return documents.select("path", "content", "is_foreign").mapInPandas(partial(_extract, max_line), FACTS)


@dataclass
class Facts:
    """The fact tables of a corpus over one staged extraction; a table reads only the columns it needs."""

    wide: DataFrame

    @classmethod
    def of(cls, documents: DataFrame, max_line: int = M.MAX_LINE) -> Facts:
        return cls(stage(extract(documents, max_line), "facts"))

    def _rows(self, column: str, pos: str = "pos") -> DataFrame:
        return self.wide.select("path", F.posexplode(column).alias(pos, "x")).select("path", pos, "x.*")

    @property
    def links(self) -> DataFrame:
        return self._rows("links")

    @property
    def headings(self) -> DataFrame:
        return self._rows("headings")

    @property
    def slices(self) -> DataFrame:
        return self._rows("slices").drop("pos")

    @property
    def blocks(self) -> DataFrame:
        return self._rows("blocks").drop("pos")

    @property
    def chain(self) -> DataFrame:
        return self.wide.select("path", "tags", "hash_algo", F.posexplode("chain").alias("pos", "x")).select("path", "tags", "hash_algo", "pos", "x.*")

    @property
    def pins(self) -> DataFrame:
        return self.wide.where(F.col("pin").isNotNull()).select("path", "tags", "pin.*")

    @property
    def embeds(self) -> DataFrame:
        """Embeds by every slice they stand in: a range join inside each page. ``pos`` is the order in the page."""
        e = self.links.where("is_embed").select("path", "pos", F.col("target").alias("child_target"), F.col("fragment").alias("child_anchor"), "line")
        s = self.slices.select("path", "anchor", "start_line", "end_line")
        return e.join(s, "path").where((F.col("line") >= F.col("start_line")) & (F.col("line") < F.col("end_line"))).select("path", "anchor", "pos", "child_target", "child_anchor", "line")

    @property
    def outlinks(self) -> DataFrame:
        """``(path, anchor, target)``: the distinct targets of each slice, a range join inside each page."""
        found = self.links.where("target <> ''").select("path", "target", "line").distinct()
        s = self.slices.select("path", "anchor", "start_line", "end_line")
        return found.join(s, "path").where((F.col("line") >= F.col("start_line")) & (F.col("line") < F.col("end_line"))).select("path", "anchor", "target").distinct()
