"""Sinks of the driver: plans to files, findings to text, run records; executors never write pages."""

from __future__ import annotations

import os
import tempfile

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.functions import markdown as M


def write_page(root: str, path: str, before: str | None, after: str) -> None:
    """Replace a page at once if it still holds ``before``; raises RuntimeError if it was changed meanwhile."""
    full = os.path.join(root, path)
    if os.path.relpath(full, root).startswith(".."):
        raise ValueError(f"{path} is outside {root}")
    if before is not None:
        with open(full, encoding="utf-8", newline="") as f:
            if f.read() != before:
                raise RuntimeError(f"{path} was changed since it was read")
    os.makedirs(os.path.dirname(full) or ".", exist_ok=True)
    fd, temporary = tempfile.mkstemp(dir=os.path.dirname(full) or ".")
    with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
        f.write(after)
    os.replace(temporary, full)


def apply_plan(plan: DataFrame, root: str) -> tuple[list[str], dict[str, str]]:
    """Write a plan's pages in order of path; returns those written and, for others, why not."""
    done, failed = [], {}
    for row in plan.orderBy("path").toLocalIterator():
        try:
            write_page(root, row["path"], row["before"], row["after"])
            done.append(row["path"])
        except (OSError, RuntimeError, ValueError) as e:
            failed[row["path"]] = str(e)
    return done, failed


def rename_pages(renames: DataFrame, root: str) -> tuple[list[str], dict[str, str]]:
    """Move files ``(path, new_path)`` in order of path; returns the new places and, for others, why not. Nothing is overwritten."""
    done, failed = [], {}
    for row in renames.orderBy("path").toLocalIterator():
        old, new = (os.path.join(root, row[c]) for c in ("path", "new_path"))
        try:
            for full in (old, new):
                if os.path.relpath(full, root).startswith(".."):
                    raise ValueError(f"{full} is outside {root}")
            os.makedirs(os.path.dirname(new) or ".", exist_ok=True)
            os.link(old, new)  # fails if the place is taken
            os.unlink(old)
            done.append(row["new_path"])
        except (OSError, ValueError) as e:
            failed[row["path"]] = str(e)
    return done, failed


def apply_move(move, root: str) -> tuple[list[str], dict[str, str]]:
    """Rewrite links, then rename; what could not be written or moved is told by path."""
    written, failed = apply_plan(move.plan, root)
    moved, stuck = rename_pages(move.renames, root)
    return [*written, *moved], failed | stuck


def write_findings(findings: DataFrame, folder: str) -> None:
    """Findings as JSON lines, written by the executors: for results of any size."""
    findings.drop("seq").write.mode("overwrite").json(folder)


def findings_text(findings: DataFrame) -> str:
    """Findings with their severities in one column, then counts by rule, most first."""
    lines = [f"{r['severity']:<5} {r['file_path']}:{r['line']} {r['rule_id']}: {r['message']}" for r in findings.orderBy("file_path", "rule_id", "line", "seq").toLocalIterator()]
    counts = findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule_id").collect()
    return "\n".join([*lines, "", *(f"{r['n']:>6} {r['rule_id']}" for r in counts)])


#: Bytes of an output that a message and a record keep.
MESSAGE_TAIL, RECORD_TAIL = 4 << 10, 64 << 10


def tail(text: str, most: int) -> str:
    """The last ``most`` bytes of a text, from a whole character on."""
    data = text.encode()
    return text if len(data) <= most else data[-most:].decode(errors="ignore")


def run_record(existing: str | None, results: dict[str, dict], outputs: dict[str, str]) -> str:
    """A run-record page: results merged by task over those that were there, sorted, one fenced block each with the end of its output."""
    old = M.parse_frontmatter(existing or "")
    runs = {**(old.values.get("runs") or {}), **results}
    kept = {b[0]: b for b in _blocks(existing or "")} if existing else {}
    body = []
    for task in sorted(runs):
        text = tail(outputs.get(task, kept.get(task, (task, ""))[1]), RECORD_TAIL)
        fence = "`" * max(3, 1 + max((len(t) - len(t.lstrip("`")) for t in text.split("\n")), default=0))
        body.append(f"{fence}\n{text.rstrip(chr(10))}\n{fence}\n^{task}\n")
    front = yaml.safe_dump({"runs": {k: runs[k] for k in sorted(runs)}}, sort_keys=True, allow_unicode=True)
    return f"---\n{front}---\n\n" + "\n".join(body)


def _blocks(content: str) -> list[tuple[str, str]]:
    lines = M.file_lines(content)
    return [(name, block.code) for name, at, inline in M.block_ids(lines) if (block := M.find_block(lines, at, inline, name)) and block.fence]


def read_run_records(documents: DataFrame) -> DataFrame:
    """``(path, task, block_sha, exit)`` of sidecars '<stem>.runs.md', by the page they belong to."""
    runs = F.from_json(F.try_element_at(F.from_json("fm", "map<string,string>"), F.lit("runs")), "map<string,struct<block_sha:string,exit:int,timed_out:boolean>>")
    return documents.where(F.endswith("path", F.lit(".runs.md"))).select(F.regexp_replace("path", r"\.runs\.md$", ".md").alias("path"), F.explode(runs).alias("task", "r")).select("path", "task", "r.block_sha", "r.exit", "r.timed_out")
