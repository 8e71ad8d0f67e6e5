"""References to pages of other wikis: building and reading 'wiki://', 'obsidian://' and markdown links."""

from __future__ import annotations

from typing import NamedTuple
from urllib.parse import unquote_to_bytes

# What is percent-encoded besides controls and all beyond ASCII.
ENCODED = " #?&%+="


class Ref(NamedTuple):
    slug: str
    path: str
    fragment: str = ""
    commit: str = ""


class UriError(ValueError):
    pass


def encode(text: str) -> str:
    return "".join(f"%{b:02X}" if chr(b) in ENCODED or b < 0x20 or b >= 0x7F else chr(b) for b in text.encode())


def decode(text: str) -> tuple[str, bool]:
    """The decoded value, and whether the text is how ``encode`` writes it."""
    out = unquote_to_bytes(text.replace("+", " ")).decode("utf-8", "surrogateescape")
    return out.encode("utf-8", "surrogateescape").decode("utf-8", "replace"), "".join(f"%{b:02X}" if chr(b) in ENCODED or b < 0x20 or b >= 0x7F else chr(b) for b in out.encode("utf-8", "surrogateescape")) == text


def uri(ref: Ref) -> str:
    if not ref.fragment:
        return f"obsidian://open?vault={encode(ref.slug)}&file={encode(ref.path)}"
    kind, value = ("block", ref.fragment[1:]) if ref.fragment.startswith("^") else ("heading", ref.fragment)
    return f"obsidian://advanced-uri?vault={encode(ref.slug)}&filepath={encode(ref.path)}&{kind}={encode(value)}"


def nav_link(ref: Ref, display: str) -> str:
    shown = display.replace("\n", " ").replace("\r", " ").replace("]", "\\]")
    return f"[{shown}]({uri(ref)})"


def citation(ref: Ref) -> str:
    return f"[wiki://{ref.slug}/{ref.path}{'@' + ref.commit if ref.commit else ''}]({uri(ref)})"


def parse(text: str) -> tuple[Ref, list[str]]:
    """A reference and what is odd about it: 'uri-encoding', 'display-drift'. Raises UriError if it is none."""
    text = text.strip()
    link = _markdown_link(text)
    if link is None:
        return _parse_uri(text)
    display, href = link
    ref, flags = _parse_uri(href)
    if display.startswith("wiki://"):
        try:
            shown = _parse_wiki(display)
        except UriError:
            return ref, flags
        if (shown.slug, shown.path) != (ref.slug, ref.path):
            flags = [*flags, "display-drift"]
        ref = ref._replace(commit=shown.commit)
    return ref, flags


def _markdown_link(text: str) -> tuple[str, str] | None:
    if not (text.startswith("[") and text.endswith(")")):
        return None
    i = 1
    while i < len(text) - 1:
        if text[i] == "\\":
            i += 1
        elif text[i : i + 2] == "](":
            return text[1:i].replace("\\]", "]"), text[i + 2 : -1]
        i += 1
    return None


def _parse_uri(text: str) -> tuple[Ref, list[str]]:
    if text.startswith("wiki://"):
        return _parse_wiki(text), []
    if not text.startswith("obsidian://"):
        raise UriError(f"not a wiki:// or obsidian:// reference: {text!r}")
    action, sign, query = text.removeprefix("obsidian://").partition("?")
    if not sign:
        raise UriError(f"no query: {text!r}")
    values, flags = {}, []
    for part in query.split("&"):
        key, _, raw = part.partition("=")
        values[key], canonical = decode(raw)
        flags += [] if canonical else ["uri-encoding"]
    if action not in ("open", "advanced-uri"):
        raise UriError(f"unknown action {action!r}")
    path = values.get("file" if action == "open" else "filepath", "")
    fragment = "" if action == "open" else "^" + values["block"] if values.get("block") else values.get("heading", "")
    if not values.get("vault") or not path:
        raise UriError(f"no vault or file: {text!r}")
    return Ref(values["vault"], path, fragment), flags


def _parse_wiki(text: str) -> Ref:
    slug, _, path = text.removeprefix("wiki://").partition("/")
    if not slug or not path:
        raise UriError(f"needs wiki://<slug>/<path>: {text!r}")
    head, at, commit = path.rpartition("@")
    return Ref(slug, head, "", commit) if at and commit and "/" not in commit else Ref(slug, path)
