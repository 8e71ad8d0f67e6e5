"""Globs and file-name patterns as regular expressions that Java, Python and RE2 read alike."""

from __future__ import annotations

import re


def _special(c: str) -> str:
    return "\\" + c if c in r"\.+^$|()[]{}*?" else c


def glob_regex(pattern: str, cross: bool = True) -> str:
    """An anchored regex for ``**``, ``*``, ``?``, ``[…]`` and ``{a,b}``; without ``cross`` '**' is no more than '*'."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            stars = len(pattern[i:]) - len(pattern[i:].lstrip("*"))
            if cross and stars >= 2 and pattern[i + stars : i + stars + 1] == "/" and (i == 0 or pattern[i - 1] == "/"):
                out.append("(?:[^/]+/)*")
                i += stars + 1
            else:
                out.append(".*" if cross and stars >= 2 else "[^/]*")
                i += stars
            continue
        if c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            inner = pattern[i + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]")
            i = end
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(pattern):
            out.append(_special(pattern[i + 1]))
            i += 1
        else:
            out.append(_special(c))
        i += 1
    return "^" + "".join(out) + (")" * depth) + "$"


def check_glob(pattern: str) -> None:
    """Raise ValueError for a pattern that can't be read."""
    try:
        re.compile(glob_regex(pattern))
    except re.error as e:
        raise ValueError(f"bad glob {pattern!r}: {e}") from None


def java_regex(pattern: str) -> str:
    """A rule's regex (RE2) for Java: ASCII word limits; what RE2 lacks is refused."""
    if re.search(r"\(\?<?[=!]", pattern) or re.search(r"(?<!\\)\\[1-9]", pattern):
        raise ValueError(f"look-around and back-references are not supported: {pattern!r}")
    word = "0-9A-Za-z_"
    return re.sub(r"(?<!\\)((?:\\\\)*)\\b", rf"\1(?:(?<![{word}])(?=[{word}])|(?<=[{word}])(?![{word}]))", pattern)


def literal_top(pattern: str) -> str:
    """The first directory of a glob if it is literal, else ''."""
    top = pattern.split("/", 1)[0]
    return "" if "/" not in pattern or re.search(r"[*?\[{]", top) else top
