"""Rules: packs of YAML and literate markdown, strictly checked when loaded. All on the driver; packs are small."""

from __future__ import annotations

import fnmatch
import os
from collections import Counter
from dataclasses import dataclass, field, replace
from importlib import resources
from typing import Any

import yaml

from quillmere.functions import markdown as M
from quillmere.functions.columns import SEVERITIES
from quillmere.functions.globs import check_glob
from quillmere.functions.templates import parse

# The fields of a rule that are not parameters, and the limits of a rule's YAML.
META = {"check", "message", "severity", "on", "required"}
PROPERTY_META = {"property", "severity", "on", "message", "required"}
MAX_DEPTH, MAX_ALIASES = 10, 100


class RuleError(ValueError):
    pass


@dataclass
class Rule:
    id: str
    check: str
    severity: str = "warn"
    on: list[str] = field(default_factory=list)
    params: dict[str, Any] = field(default_factory=dict)
    message: str = ""
    required: bool = False


def _depth(node: yaml.Node, level: int = 1) -> int:
    children = [c for pair in node.value for c in pair] if isinstance(node, yaml.MappingNode) else node.value if isinstance(node, yaml.SequenceNode) else []
    if level > MAX_DEPTH + 1:
        return level
    return max([level, *(_depth(c, level + 1) for c in children)])


def load_yaml(text: str, rule_id: str) -> Rule:
    """One rule. Raises RuleError for anything that isn't as it must be."""
    try:
        if sum(isinstance(e, yaml.AliasEvent) for e in yaml.parse(text, Loader=M.Loader)) > MAX_ALIASES:
            raise RuleError(f"{rule_id}: too many YAML aliases")
        node = yaml.compose(text, Loader=M.Loader)
        if node is not None and _depth(node) > MAX_DEPTH:
            raise RuleError(f"{rule_id}: YAML nesting too deep")
        raw = yaml.load(text, Loader=M.Loader)
    except yaml.YAMLError as e:
        raise RuleError(f"{rule_id}: {e}") from None
    if not isinstance(raw, dict):
        raise RuleError(f"{rule_id}: a rule is a mapping")
    if ("check" in raw) == ("property" in raw):
        raise RuleError(f"{rule_id}: a rule has either 'check' or 'property'")
    return _check_rule(raw, rule_id) if "check" in raw else _property_rule(raw, rule_id)


def _on(value: Any, rule_id: str) -> list[str]:
    on = [value] if isinstance(value, str) else value
    if not isinstance(on, list) or not all(isinstance(s, str) for s in on):
        raise RuleError(f"{rule_id}: 'on' is a string or a list of strings")
    for s in on:
        bare = s.removeprefix("!")
        if not bare.startswith("#"):
            try:
                check_glob(bare)
            except ValueError as e:
                raise RuleError(f"{rule_id}: {e}") from None
    return on


def _severity(value: Any, rule_id: str) -> str:
    if value not in SEVERITIES:
        raise RuleError(f"{rule_id}: unknown severity {value!r}")
    return value


def _check_rule(raw: dict, rule_id: str) -> Rule:
    for name in ("check", "message", "severity", "on"):
        if name not in raw:
            raise RuleError(f"{rule_id}: missing required field {name!r}")
    for name in ("check", "message", "severity"):
        if not isinstance(raw[name], str):
            raise RuleError(f"{rule_id}: {name} must be a string")
    try:
        parse(raw["message"])
    except ValueError as e:
        raise RuleError(f"{rule_id}: invalid message: {e}") from None
    if not isinstance(raw.get("required", False), bool):
        raise RuleError(f"{rule_id}: required must be a bool")
    params = {k: v for k, v in raw.items() if k not in META}
    return Rule(rule_id, raw["check"], _severity(raw["severity"], rule_id), _on(raw["on"], rule_id), params, raw["message"], raw.get("required", False))


def _property_rule(raw: dict, rule_id: str) -> Rule:
    keys = [raw["property"]] if isinstance(raw["property"], str) else raw["property"]
    if not isinstance(keys, list) or not keys or not all(isinstance(k, str) for k in keys):
        raise RuleError(f"{rule_id}: property is a field name or a list of them")
    from quillmere.operators.property_blocks import REGISTRY

    blocks = [b for b in REGISTRY if b in raw]
    if len(blocks) > 1:
        raise RuleError(f"{rule_id}: more than one type block: {', '.join(blocks)}")
    params = {k: v for k, v in raw.items() if k not in PROPERTY_META} | {"property": keys, "required": bool(raw.get("required", False))}
    message = raw.get("message", "{{.Message}}")
    return Rule(rule_id, "property", _severity(raw.get("severity", "warn"), rule_id), _on(raw.get("on", []), rule_id), params, message, False)


def load_markdown(content: str, name: str) -> tuple[Rule | None, list[str]]:
    """A literate rule: frontmatter ``md-rule: '[[page#^id]]'`` names the fenced block that holds the YAML."""
    fm = M.parse_frontmatter(content)
    pointer = fm.values.get("md-rule")
    if not isinstance(pointer, str):
        return None, [f"{name}: no md-rule key, taken as documentation"]
    m = M.WIKILINK.fullmatch(pointer.strip())
    fragment = M.link_fragment(m.group(1)) if m else ""
    if not fragment.startswith("^"):
        raise RuleError(f"{name}: md-rule must point to a block")
    lines = M.file_lines(content)
    marks = [x for x in M.block_ids(lines) if x[0] == fragment[1:]]
    block = M.find_block(lines, marks[0][1], marks[0][2], marks[0][0]) if len(marks) == 1 else None
    if block is None or not block.fence:
        raise RuleError(f"{name}: {fragment} is not one fenced block")
    return load_yaml(block.code, name), []


def load_dir(path: str) -> tuple[list[Rule], list[str]]:
    """All rules of a directory, '.yaml', '.yml' and '.md', by name."""
    rules, warnings = [], []
    for name in sorted(os.listdir(path)):
        stem, ext = os.path.splitext(name)
        full = os.path.join(path, name)
        if ext in (".yaml", ".yml"):
            with open(full, encoding="utf-8") as f:
                rules.append(load_yaml(f.read(), stem))
        elif ext == ".md":
            with open(full, encoding="utf-8") as f:
                rule, notes = load_markdown(f.read(), stem)
            warnings += notes
            rules += [rule] if rule else []
    return union(rules), warnings


def load_pack(name: str) -> list[Rule]:
    """The rules of a pack that comes with the library: 'contract', 'effects', or 'skills' for trees of skills."""
    folder = resources.files("quillmere.packs") / name
    if not folder.is_dir():
        raise RuleError(f"there is no pack {name!r}")
    files = sorted((f for f in folder.iterdir() if f.name.endswith((".yaml", ".yml"))), key=lambda f: f.name)
    return union([load_yaml(f.read_text(encoding="utf-8"), f.name.rsplit(".", 1)[0]) for f in files])


def union(*packs: list[Rule]) -> list[Rule]:
    """Packs together; a repeated id is an error."""
    rules = [r for pack in packs for r in pack]
    repeated = sorted(i for i, n in Counter(r.id for r in rules).items() if n > 1)
    if repeated:
        raise RuleError(f"duplicate rule ids: {', '.join(repeated)}")
    return rules


def with_params(rules: list[Rule], by_check: dict[str, dict]) -> list[Rule]:
    """Rules with configured parameters laid over their own, by check or id."""
    return [replace(r, params=r.params | by_check.get(r.check, {}) | by_check.get(r.id, {})) for r in rules]


def profile(rules: list[Rule], include: list[str] = ("*",), exclude: list[str] = (), override: dict[str, str] | None = None) -> list[Rule]:
    """The rules a profile keeps, by globs that don't cross '/', with severities overridden."""
    hit = lambda i, globs: any(fnmatch.fnmatchcase(i, g) for g in globs)
    kept = [r for r in rules if hit(r.id, include) and not hit(r.id, exclude)]
    return [replace(r, severity=_severity(override[r.id], r.id)) if override and r.id in override else r for r in kept]


def search(rules: list[Rule], text: str) -> list[Rule]:
    return sorted((r for r in rules if text.lower() in r.id.lower() or text.lower() in r.check.lower()), key=lambda r: r.id)
