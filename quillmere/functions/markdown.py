"""The markdown grammars, on single texts: frontmatter, fences, headings, links, blocks, slices, directives.

Fences come in four variants, chosen by ``mode``:

- ``facts``: any indentation; closed by a line that starts with as many markers or more, text after it allowed.
- ``slices``: column 0 only; closed by as many markers or more and nothing after them; the delimiters are inside.
- ``move``: any line that starts with three of the open character closes, however many.
- ``toggle``: every line that starts with three backticks or tildes switches.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import re
from collections import Counter
from dataclasses import dataclass, field
from typing import Any, NamedTuple

import yaml

# The patterns of the page format.
FENCE = re.compile(r"^\s*(`{3,}|~{3,})")
FENCE_AT_0 = re.compile(r"^(`{3,}|~{3,})(.*)$")
INLINE_CODE = re.compile(r"`[^`]+`")
WIKILINK = re.compile(r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]")
WIKILINK_INNER = re.compile(r"\[\[([^\[\]]+)\]\]")
WIKILINK_DISPLAY = re.compile(r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]")
HEADING_AT_0 = re.compile(r"^(#{1,6})\s+(.*?)\s*$")
BLOCK_ID_LINE = re.compile(r"^\^([A-Za-z0-9-]+)\s*$")
BLOCK_ID_INLINE = re.compile(r"\s\^([A-Za-z0-9-]+)\s*$")
DISABLE_NEXT = [re.compile(p) for p in (r"<!--\s*md-disable-next-line\s+([^>]+?)\s*-->", r"%%\s*md-disable-next-line\s+([^%]+?)\s*%%")]
IGNORE = [re.compile(p) for p in (r"<!--\s*md:ignore(?:\s+([^>]+?))?\s*-->", r"%%\s*md:ignore(?:\s+([^%]+?))?\s*%%")]
IGNORE_FILE = [re.compile(p) for p in (r"<!--\s*md:ignore-file(?:\s+([^>]+?))?\s*-->", r"%%\s*md:ignore-file(?:\s+([^%]+?))?\s*%%")]
TABLE_SEPARATOR = re.compile(r"^\s*\|[\s:]*-{3,}[\s:]*\|")
TABLE_PIPE_LINK = re.compile(r"\[\[[^\]\\]+\|[^\]]+\]\]")
BARE_URI = re.compile(r"wiki://[^\s)\]>\"']+")
BODY_HEX = re.compile(r"(?<![0-9A-Za-z_])[0-9a-fA-F]{7,}(?![0-9A-Za-z_])")
MAX_LINE = 1 << 20


class Line(NamedTuple):
    """A line of a file: text, 1-based number, whether it is inside a fence or delimits one."""

    text: str
    number: int
    fenced: bool
    delimiter: bool


@dataclass
class Frontmatter:
    present: bool = False
    error: bool = False
    values: dict[str, Any] = field(default_factory=dict)
    body: str = ""
    body_offset: int = 1
    long_line: bool = False


class Loader(yaml.SafeLoader):
    """Safe YAML whose plain words are text but for true, false and null; numbers have no base 60, impossible dates are text."""


Loader.yaml_implicit_resolvers = {c: [(tag, r) for tag, r in found if not tag.endswith((":bool", ":int", ":float"))] for c, found in yaml.SafeLoader.yaml_implicit_resolvers.items()}
Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile("^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
Loader.add_implicit_resolver("tag:yaml.org,2002:int", re.compile("^(?:[-+]?0b[01_]+|[-+]?0o?[0-7_]+|[-+]?0x[0-9a-fA-F_]+|[-+]?(?:0|[1-9][0-9_]*))$"), list("-+0123456789"))
Loader.add_implicit_resolver("tag:yaml.org,2002:float", re.compile(r"^(?:[-+]?(?:[0-9][0-9_]*)(?:\.[0-9_]*)?(?:[eE][-+]?[0-9]+)?|[-+]?\.[0-9][0-9_]*(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$"), list("-+0123456789."))


def _timestamp(loader: Loader, node: yaml.ScalarNode) -> Any:
    try:
        return yaml.SafeLoader.construct_yaml_timestamp(loader, node)
    except ValueError:
        return node.value


def _integer(loader: Loader, node: yaml.ScalarNode) -> int:
    digits = node.value.replace("_", "")
    return int(digits, 8) if re.match("[-+]?0[0-7]+$", digits) else int(digits, 0)


Loader.add_constructor("tag:yaml.org,2002:timestamp", _timestamp)
Loader.add_constructor("tag:yaml.org,2002:int", _integer)


def parse_frontmatter(content: str, max_line: int = MAX_LINE) -> Frontmatter:
    """Split a file. Unclosed or invalid frontmatter is an error with an empty body and offset 0.

    So is a line longer than ``max_line``, by default as long as a line scanner reads; with 0 none is.
    """
    lines = content.split("\n")
    if max_line and any(len(line) > max_line for line in lines):
        return Frontmatter(True, True, {}, "", 0, True)
    first = lines[0].removeprefix("\ufeff").strip()
    if first != "---":
        return Frontmatter(False, False, {}, content, 1)
    close = next((i for i in range(1, len(lines)) if lines[i].strip() == "---"), None)
    if close is None:
        return Frontmatter(True, True, {}, "", 0)
    try:
        values = yaml.load("\n".join(lines[1:close]), Loader=Loader)
    except (yaml.YAMLError, ValueError, TypeError):
        return Frontmatter(True, True, {}, "", 0)
    if values is not None and not isinstance(values, dict):
        return Frontmatter(True, True, {}, "", 0)
    return Frontmatter(True, False, {str(k): v for k, v in (values or {}).items()}, "\n".join(lines[close + 1 :]), close + 2)


def to_json(value: Any) -> str:
    """JSON of a YAML value; dates as ISO text."""
    return json.dumps(value, default=lambda x: x.isoformat() if isinstance(x, (datetime.date, datetime.datetime)) else str(x), ensure_ascii=False)


def yaml_kind(value: Any) -> str:
    if value is None:
        return "null"
    for kind, types in (("bool", bool), ("int", int), ("float", float), ("string", str), ("date", (datetime.datetime, datetime.date)), ("list", list), ("map", dict)):
        if isinstance(value, types):
            return kind
    return "other"


def string_list(value: Any, scalar: bool = True) -> list[str]:
    """A list of trimmed strings; a scalar string counts as one if ``scalar``."""
    if isinstance(value, str):
        return [value.strip()] if scalar and value.strip() else []
    if isinstance(value, list):
        return [v.strip() for v in value if isinstance(v, str) and v.strip()]
    return []


def walk(text: str, mode: str = "facts", first: int = 1) -> list[Line]:
    """The lines of ``text`` with their fence state by one of the four variants; numbers begin at ``first``."""
    lines, open_ = [], ""
    for i, raw in enumerate(text.split("\n")):
        line = raw.removesuffix("\r") if mode == "slices" else raw
        found = (FENCE_AT_0 if mode == "slices" else FENCE).match(line)
        delimiter = False
        if mode == "toggle":
            delimiter = line.strip().startswith(("```", "~~~"))
            if delimiter:
                open_ = "" if open_ else "`"
        elif found and not open_:
            open_, delimiter = found.group(1), True
        elif found and open_:
            same = found.group(1)[0] == open_[0]
            long = len(found.group(1)) >= len(open_)
            if mode == "facts":
                delimiter = True  # a fence line inside another is neither text nor an end
                if same and line.strip().startswith(open_):
                    open_ = ""
            elif same and (mode == "move" or (long and not found.group(2).strip())):
                open_, delimiter = "", True
        lines.append(Line(line, first + i, bool(open_) or delimiter, delimiter))
    return lines


def strip_inline_code(line: str) -> tuple[str, list[int]]:
    """The line without single-backtick code, and where each character stood, with the end's place last."""
    places = list(range(len(line)))
    for m in reversed(list(INLINE_CODE.finditer(line))):
        del places[m.start() : m.end()]
    return "".join(line[i] for i in places), [*places, len(line)]


def code_spans(line: str) -> list[tuple[int, int]]:
    """Inline code by equal runs of backticks, delimiters included."""
    runs = [(m.start(), m.end()) for m in re.finditer(r"`+", line)]
    spans, i = [], 0
    while i < len(runs):
        width = runs[i][1] - runs[i][0]
        j = next((k for k in range(i + 1, len(runs)) if runs[k][1] - runs[k][0] == width), None)
        if j is None:
            i += 1
        else:
            spans.append((runs[i][0], runs[j][1]))
            i = j + 1
    return spans


def link_target(raw: str) -> str:
    """What a link points to, without fragment and trailing '\\' and '/'."""
    return raw.strip().split("#", 1)[0].rstrip("\\").rstrip("/") if raw.strip() else ""


def link_fragment(raw: str) -> str:
    head, sign, tail = raw.strip().partition("#")
    return tail.strip() if sign else ""


def heading(trimmed: str) -> tuple[int, str] | None:
    """Level and text of an ATX heading on a trimmed line."""
    level = len(trimmed) - len(trimmed.lstrip("#"))
    if not 1 <= level <= 6 or (len(trimmed) > level and trimmed[level] != " "):
        return None
    return level, trimmed[level:].strip()


def body_facts(body: str, offset: int) -> tuple[list[dict], list[dict]]:
    """Links and headings outside fences, in order. Columns count bytes from 1."""
    links, headings = [], []
    for line in walk(body, "facts", offset):
        if line.fenced or line.delimiter:
            continue
        trimmed = line.text.strip()
        if trimmed.startswith("#") and (found := heading(trimmed)):
            headings.append({"level": found[0], "text": found[1], "line": line.number})
        if "[" not in line.text:
            continue
        text, places = strip_inline_code(line.text)
        for m in WIKILINK.finditer(text):
            start, end = places[m.start()], places[m.end() - 1] + 1
            raw = m.group(1)
            links.append(
                {
                    "original": line.text[start:end], "target": link_target(raw), "fragment": link_fragment(raw), "is_embed": start > 0 and line.text[start - 1] == "!",
                    "line": line.number, "col": len(line.text[:start].encode()) + 1,
                }
            )
    return links, headings


def norm_v1(text: str) -> str:
    """Line ends to LF, no blanks at line ends, runs of blank lines to one, one newline at the end."""
    lines = [line.rstrip(" \t") for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    kept = [line for i, line in enumerate(lines) if line or not i or lines[i - 1]]
    return "\n".join(kept).rstrip("\n") + "\n"


def slice_hash(text: str) -> str:
    return hashlib.sha256(norm_v1(text).encode()).hexdigest()


class Slice(NamedTuple):
    anchor: str
    kind: str
    start: int
    end: int
    text: str
    fence: bool = False
    lang: str = ""
    code: str = ""


def file_lines(content: str) -> list[Line]:
    """The lines of a file after its frontmatter, with file numbers, by the slice grammar."""
    lines = content.split("\n")
    skip = 0
    if lines and lines[0].removeprefix("\ufeff").strip() == "---":
        close = next((i for i in range(1, len(lines)) if lines[i].strip() == "---"), None)
        skip = close + 1 if close is not None else 0
    return walk("\n".join(lines[skip:]), "slices", skip + 1) if len(lines) > skip else []


def block_ids(lines: list[Line]) -> list[tuple[str, int, bool]]:
    """(id, index, inline) of every block marker outside fences."""
    out = []
    for i, line in enumerate(lines):
        if not line.fenced:
            if m := BLOCK_ID_LINE.match(line.text):
                out.append((m.group(1), i, False))
            elif m := BLOCK_ID_INLINE.search(line.text):
                out.append((m.group(1), i, True))
    return out


def _paragraph(lines: list[Line], at: int, bound: int) -> tuple[int, int]:
    start, end = at, at + 1
    plain = lambda i: bool(lines[i].text.strip()) and not lines[i].fenced
    while start > 0 and plain(start - 1):
        start -= 1
    while end < bound and plain(end):
        end += 1
    return start, end


def find_block(lines: list[Line], at: int, inline: bool, name: str) -> Slice | None:
    """The block that the marker at index ``at`` addresses."""
    if inline:
        start, end = _paragraph(lines, at, len(lines))
    else:
        j = next((k for k in range(at - 1, -1, -1) if lines[k].text.strip()), None)
        if j is None:
            return None
        if lines[j].fenced:
            start = next(k for k in range(j - 1, -1, -1) if lines[k].delimiter) if lines[j].delimiter and j and lines[j - 1].fenced else j
            opener = FENCE_AT_0.match(lines[start].text)
            info = (opener.group(2).split() if opener else []) or [""]
            inside = [line.text + "\n" for line in lines[start + 1 : j]]
            return Slice("^" + name, "block", lines[start].number, lines[j].number + 1, "".join(line.text + "\n" for line in lines[start : j + 1]), True, info[0], "".join(inside))
        start, end = _paragraph(lines, j, at)
    text = "".join(BLOCK_ID_INLINE.sub("", line.text) + "\n" for line in lines[start:end] if not BLOCK_ID_LINE.match(line.text))
    return Slice("^" + name, "block", lines[start].number, lines[end - 1].number + 1, text)


def slices(content: str) -> list[Slice]:
    """All that an anchor can address: the body, sections (the first of equal headings), blocks declared once."""
    lines = file_lines(content)
    if not lines:
        return []
    last = lines[-1].number + 1
    out = [Slice("", "body", lines[0].number, last, "".join(line.text + "\n" for line in lines))]
    heads = [(i, len(m.group(1)), m.group(2)) for i, line in enumerate(lines) if not line.fenced and (m := HEADING_AT_0.match(line.text))]
    ends, later = {}, []  # headings that follow, each of a higher level than those after it
    for i, level, _ in reversed(heads):
        while later and later[-1][1] > level:
            later.pop()
        ends[i] = later[-1][0] if later else len(lines)
        later.append((i, level))
    seen = set()
    for i, _, text in heads:
        if text not in seen:
            seen.add(text)
            end = ends[i]
            out.append(Slice(text, "section", lines[i].number, lines[end].number if end < len(lines) else last, "".join(line.text + "\n" for line in lines[i:end])))
    marks = block_ids(lines)
    names = Counter(m[0] for m in marks)
    for name, at, inline in marks:
        if names[name] == 1 and (block := find_block(lines, at, inline, name)):
            out.append(block)
    return out


def section(content: str, title: str) -> str | None:
    """A heading's section: exact match first, then without regard to case."""
    found = [s for s in slices(content) if s.kind == "section"]
    for same in (lambda s: s.anchor == title, lambda s: s.anchor.casefold() == title.casefold()):
        for s in found:
            if same(s):
                return s.text
    return None


def suppressions(body: str, offset: int) -> tuple[dict[int, set[str]], list[str]]:
    """Rules switched off by directives: by file line, and for the whole file ('*' for all)."""
    lines: dict[int, set[str]] = {}
    whole: list[str] = []
    split = lambda text: [r.strip() for r in (text or "").split(",") if r.strip()]
    for i, line in enumerate(body.split("\n")):
        if "<" not in line and "%" not in line:
            continue
        for m in (m for p in DISABLE_NEXT for m in p.finditer(line)):
            lines.setdefault(offset + i + 1, set()).update(split(m.group(1)))
        for m in (m for p in IGNORE_FILE for m in p.finditer(line)):
            whole += split(m.group(1)) or ["*"]
        found = [m for p in IGNORE for m in p.finditer(line)]
        if found:
            rest = line
            for p in IGNORE:
                rest = p.sub("", rest)
            at = offset + i + (not rest.strip())
            for m in found:
                lines.setdefault(at, set()).update(split(m.group(1)) or {"*"})
    return lines, whole


class ChainItem(NamedTuple):
    """A declared input: its ref and hash, the file lines of both keys (0 for no hash), the column of the ref key."""

    ref: str
    hash: str
    line: int
    hash_line: int = 0
    column: int = 0


def chain_block(block: Slice) -> tuple[list[ChainItem], str]:
    """Entries of a declared-inputs block with the file lines of their refs, and its hash-algo.

    Read by YAML nodes, so that dashes inside a block scalar are text. Trailing scalars after the
    sequence belong to the block. Entries without a ref are none.
    """
    code = block.code.rstrip("\n").split("\n")
    cut = next((i for i in range(len(code)) if code[i] and not code[i].startswith((" ", "-", "#", "\t"))), len(code))
    algo = ""
    for line in code[cut:]:
        if line.startswith("hash-algo:"):
            algo = line.split(":", 1)[1].split(" #")[0].strip().strip("'\"")
    try:
        node = yaml.compose("\n".join(code[:cut]), Loader=Loader)
    except yaml.YAMLError:
        return [], algo
    items = []
    for entry in node.value if isinstance(node, yaml.SequenceNode) else []:
        if isinstance(entry, yaml.MappingNode):
            found = {k.value: (v, k) for k, v in entry.value if isinstance(k, yaml.ScalarNode)}
            ref, key = found.get("ref", (None, None))
            value, hash_key = found.get("hash", (None, None))
            text = ref.value if isinstance(ref, yaml.ScalarNode) else ""
            if not text and isinstance(ref, yaml.SequenceNode):  # an unquoted [[link]] is a list in a list for YAML
                inner = ref.value[0] if ref.value and isinstance(ref.value[0], yaml.SequenceNode) else None
                text = f"[[{inner.value[0].value}]]" if inner and inner.value else ""
            if text:
                null = value is None or value.tag.endswith(":null")
                first = block.start + 1
                items.append(ChainItem(text, "" if null else value.value, first + key.start_mark.line, first + hash_key.start_mark.line if hash_key else 0, key.start_mark.column))
    return items, algo


def bare_ref(ref: str) -> str:
    """A reference without brackets and alias."""
    return ref.strip().removeprefix("[[").removesuffix("]]").split("|", 1)[0]


def table_columns(line: str) -> int:
    inner = line.strip().removeprefix("|").removesuffix("|")
    return len(inner.split("|")) if inner else 0


def table_pipes(body: str, offset: int) -> list[dict]:
    """Rows of tables of two rows or more with an unescaped pipe inside a link."""
    lines, out, at = body.split("\n"), [], 0
    while at < len(lines):
        end = at
        while end < len(lines) and lines[end].strip().startswith("|"):
            end += 1
        if end - at >= 2:
            for row in range(at, end):
                found = TABLE_PIPE_LINK.findall(lines[row])
                if found and not TABLE_SEPARATOR.match(lines[row]):
                    out.append({"line": offset + row, "expected": table_columns(lines[at]), "actual": table_columns(lines[row]), "links": ", ".join(found)})
        at = max(end, at + 1)
    return out


def quoted_links(body: str, offset: int) -> list[dict]:
    """Links that stand wholly inside inline code, outside fences."""
    out = []
    for line in walk(body, "facts", offset):
        if line.fenced or line.delimiter or "`" not in line.text or "[[" not in line.text:
            continue
        spans = code_spans(line.text)
        out += [{"line": line.number, "match": m.group(), "text": line.text} for m in WIKILINK.finditer(line.text) if any(a <= m.start() and m.end() <= b for a, b in spans)]
    return out


def bare_uris(body: str, offset: int, mapped: set[str]) -> list[dict]:
    """Wiki URIs outside markdown links, and links to mapped targets, outside toggled fences."""
    out = []
    for line in walk(body, "toggle", offset):
        if line.fenced or line.delimiter:
            continue
        text = INLINE_CODE.sub("", line.text)
        out += [{"line": line.number, "uri": m.group(), "kind": "bare-uri"} for m in BARE_URI.finditer(text) if not m.start() or text[m.start() - 1] not in "(["]
        for m in WIKILINK.finditer(text):
            target = m.group(1).strip().split("#", 1)[0]
            if target in mapped:
                out.append({"line": line.number, "uri": f"[[{target}]]", "kind": "cutover-repoint"})
    return out


def hex_echoes(needle: str, token: str) -> bool:
    return needle.startswith(token) or token.startswith(needle) or (len(token) >= 12 and token in needle) or (len(needle) >= 12 and needle in token)
