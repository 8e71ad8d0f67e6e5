"""Message templates: literal text and ``{{.Key}}`` with the pipes trimPrefix, trimSuffix, base and dir."""

from __future__ import annotations

import posixpath
import re
import shlex

from pyspark.sql import Column
from pyspark.sql import functions as F

_ACTION = re.compile(r"\{\{-?\s*(.*?)\s*-?\}\}")
PIPES = {"trimPrefix": 1, "trimSuffix": 1, "base": 0, "dir": 0}


def parse(template: str) -> list[tuple[str, str, list[tuple[str, list[str]]]]]:
    """Parts ('text', text, []) and ('key', key, pipes). Raises ValueError for anything else."""
    parts, at = [], 0
    for m in _ACTION.finditer(template):
        parts.append(("text", template[at : m.start()], []))
        at = m.end()
        first, *rest = [p.strip() for p in m.group(1).split("|")]
        pipes = []
        words = shlex.split(first)
        if words and words[0] in PIPES:
            pipes.append((words[0], words[1 : 1 + PIPES[words[0]]]))
            words = words[1 + PIPES[words[0]] :]
        key = {"target": "Target"}.get(words[0], words[0][1:] if words[0].startswith(".") else None) if len(words) == 1 else None
        if not key:
            raise ValueError(f"template action not supported: {m.group()}")
        for p in rest:
            name, *args = shlex.split(p)
            if PIPES.get(name, -1) != len(args):
                raise ValueError(f"template pipe not supported: {p}")
            pipes.append((name, args))
        parts.append(("key", key, pipes))
    tail = template[at:]
    if "{{" in tail or "}}" in tail:
        raise ValueError("unclosed template action")
    return [p for p in [*parts, ("text", tail, [])] if p[0] == "key" or p[1]]


def _base(path: str) -> str:
    return posixpath.basename(path.rstrip("/")) or ("/" if path else ".")


def render(template: str, data: dict[str, str]) -> str:
    out = []
    for kind, value, pipes in parse(template):
        if kind == "key":
            value = data.get(value, "<no value>")
            for name, args in pipes:
                value = {"trimPrefix": lambda v: v.removeprefix(args[0]), "trimSuffix": lambda v: v.removesuffix(args[0]), "base": _base, "dir": lambda v: posixpath.dirname(v) or "."}[name](value)
        out.append(value)
    return "".join(out)


def column(template: str, data: Column) -> Column:
    """The rendered message; a template that can't be read renders as its error."""
    try:
        parts = parse(template)
    except ValueError as e:
        return F.lit(str(e))
    out = []
    for kind, value, pipes in parts:
        if kind == "text":
            out.append(F.lit(value))
            continue
        c = F.coalesce(F.try_element_at(data, F.lit(value)), F.lit("<no value>"))
        for name, args in pipes:
            if name == "trimPrefix":
                c = F.when(F.startswith(c, F.lit(args[0])), F.substring(c, len(args[0]) + 1, 1 << 30)).otherwise(c)
            elif name == "trimSuffix":
                c = F.when(F.endswith(c, F.lit(args[0])), F.left(c, F.length(c) - len(args[0]))).otherwise(c)
            elif name == "base":
                c = F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/", -1), -1)
            else:
                c = F.when(F.contains(c, F.lit("/")), F.regexp_replace(c, "/[^/]*$", "")).otherwise(".")
        out.append(c)
    return F.concat(*out) if out else F.lit("")
