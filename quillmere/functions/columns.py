"""Builders of columns: paths, links, dates, hashes and comparisons, all in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmere.functions.globs import glob_regex

#: Confidentiality tiers in rising order, severities in rising order.
TIERS = ["public", "internal", "confidential", "secret"]
SEVERITIES = ["off", "info", "warn", "error"]


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Paths.


def base(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def no_ext(path: Column) -> Column:
    return F.regexp_replace(path, r"\.md$", "")


def stem(path: Column) -> Column:
    return no_ext(base(path))


def top_domain(path: Column) -> Column:
    """The domain of 'wiki/<domain>/…', else ''."""
    return F.regexp_extract(path, "^wiki/([^/]+)/", 1)


def ancestors(path: Column) -> Column:
    """Every proper directory prefix, shortest first."""
    parts = F.split(path, "/", -1)
    n = F.size(parts) - 1
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/")))


def suffixes(path: Column) -> Column:
    """Suffixes of whole segments, shortest first."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, -k, k), "/"))


def skipped(path: Column, skip: list[str]) -> Column:
    """Whether a skip entry prunes the path: a bare name at any depth, one with '/' from the root."""
    names = [s for s in skip if "/" not in s]
    roots = [s.strip("/") for s in skip if "/" in s]
    dirs = F.split(directory(path), "/", -1)
    hit = F.lit(False)
    if names:
        hit = hit | F.exists(dirs, lambda d: d.isin(names))
    for root in roots:
        hit = hit | F.startswith(path, F.lit(root + "/"))
    return hit


def matches_any(path: Column, globs: list[str]) -> Column:
    hit = F.lit(False)
    for g in globs:
        hit = hit | path.rlike(glob_regex(g))
    return hit


def selector(path: Column, tags: Column, on: list[str]) -> Column:
    """A rule's selector: excludes (any) first, then any path glob, then all tags."""
    excluded = [s[1:] for s in on if s.startswith("!")]
    globs = [s for s in on if not s.startswith(("!", "#"))]
    tags = F.array_compact(F.coalesce(tags, F.array().cast("array<string>")))  # a null among them would make a miss unknown
    out = F.lit(True)
    for e in excluded:
        out = out & ~(F.array_contains(tags, e[1:]) if e.startswith("#") else path.rlike(glob_regex(e)))
    if globs:
        out = out & matches_any(path, globs)
    for tag in (s[1:] for s in on if s.startswith("#")):
        out = out & F.array_contains(tags, tag)
    return out


def in_scope(path: Column, scope: str) -> Column:
    """Exactly the path, the path without '.md', or a directory; '.' is all."""
    s = scope.rstrip("/")
    return F.lit(True) if s in ("", ".") else (path == s) | (path == s + ".md") | F.startswith(path, F.lit(s + "/"))


# Links.


def link_target(raw: Column) -> Column:
    """What a link's inside points to, without fragment and trailing '\\' and '/'."""
    return F.regexp_replace(F.regexp_replace(F.substring_index(F.trim(raw), "#", 1), r"\\+$", ""), "/+$", "")


def link_fragment(raw: Column) -> Column:
    return F.trim(F.regexp_extract(F.trim(raw), r"(?s)^[^#]*#(.*)$", 1))


def link_inner(original: Column) -> Column:
    """The part of '[[inner|display]]' before the pipe."""
    return F.regexp_extract(original, r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]", 1)


# Text.


def norm_v1(text: Column) -> Column:
    """Line ends to LF, no blanks at line ends, runs of blank lines to one, one newline at the end."""
    lf = F.regexp_replace(text, "\r\n?", "\n")
    bare = F.regexp_replace(lf, "[ \t]+(?=\n|\\z)", "")
    few = F.regexp_replace(bare, "\n{3,}", "\n\n")
    few = F.regexp_replace(few, "\\A\n{2,}", "\n")
    return F.concat(F.regexp_replace(few, "\n+\\z", ""), F.lit("\n"))


def mask(value: Column, keep: int = 8) -> Column:
    """The first ``keep`` bytes and '…' of a longer value; a cut character becomes U+FFFD."""
    b = F.encode(value, "UTF-8")
    return F.when(F.octet_length(value) > keep, F.concat(F.decode(F.substring(b, 1, keep), "UTF-8"), F.lit("…"))).otherwise(value)


def tail(value: Column, most: int) -> Column:
    """The last ``most`` bytes of a text, from a whole character on."""
    b = F.encode(value, "UTF-8")
    cut = F.substring(b, -most, most)
    # bytes 128 to 191 go on with a character that is cut; there are three at most
    starts = [F.conv(F.hex(F.substring(cut, i, 1)), 16, 10).cast("int") for i in (1, 2, 3)]
    inner = [s.between(128, 191) for s in starts]
    skip = F.when(inner[0] & inner[1] & inner[2], 3).when(inner[0] & inner[1], 2).when(inner[0], 1).otherwise(0)
    return F.when(F.octet_length(value) > most, F.decode(F.substring(cut, skip + 1, F.lit(most)), "UTF-8")).otherwise(value)


# Hashes.


def blob_sha(code: Column) -> Column:
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(code).cast("string")), "UTF-8"), F.unhex(F.lit("00")), F.encode(code, "UTF-8")))


def procedure_hash(check: Column, apply: Column) -> Column:
    return F.concat(F.lit("proc-v1:"), F.sha2(F.concat(F.encode(F.coalesce(check, F.lit("")), "UTF-8"), F.unhex(F.lit("00")), F.encode(F.coalesce(apply, F.lit("")), "UTF-8")), 256))


def shard(path: Column) -> Column:
    return F.conv(F.substring(F.sha2(path, 256), 1, 2), 16, 10).cast("int")


def digest_bytes(digest: Column) -> Column:
    """The 32 bytes of a tagged digest, or null."""
    hexed = F.element_at(F.split(digest, ":", -1), -1)
    return F.when(hexed.rlike("^[0-9a-fA-F]{64}$"), F.unhex(hexed))


def recorded_matches(recorded: Column, computed: Column) -> Column:
    """Equal, or a recorded hex prefix of eight digits or more; kinds before ':' don't count for prefixes."""
    r, c = F.lower(F.trim(recorded)), F.lower(computed)
    rh, ch = F.element_at(F.split(r, ":", -1), -1), F.element_at(F.split(c, ":", -1), -1)
    return F.coalesce((r != "") & (c != "") & ((r == c) | (rh.rlike("^[0-9a-f]{8,}$") & F.startswith(ch, rh))), F.lit(False))


def hex_echoes(needle: Column, token: Column) -> Column:
    return F.startswith(needle, token) | F.startswith(token, needle) | ((F.length(token) >= 12) & F.contains(needle, token)) | ((F.length(needle) >= 12) & F.contains(token, needle))


# Dates.


def parse_date(text: Column) -> Column:
    """A date, an RFC 3339 time or a local time; null for all else."""
    t = F.trim(text)
    day = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(t, F.lit("yyyy-MM-dd")))
    local = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"), F.try_to_timestamp(t))
    return F.coalesce(day, local)


def iso_week(ts: Column) -> Column:
    """'yyyy-Www' by ISO weeks."""
    return F.concat(F.lpad(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), 4, "0"), F.lit("-W"), F.lpad(F.extract(F.lit("WEEK"), ts).cast("string"), 2, "0"))


def path_date(path: Column) -> tuple[Column, Column]:
    """Kind ('daily', 'weekly', 'monthly' or null) and value ('yyyy-MM-dd', 'yyyy-Www', 'yyyy-MM') of a dated path.

    Daily is tried before weekly before monthly; an impossible daily or weekly date ends the search.
    """
    daily, weekly, monthly = r"(?:^|/)(\d{4})/(\d{2})/(\d{2})/", r"(?:^|/)(\d{4})-W(\d{2})/", r"(?:^|/)(\d{4})/(\d{2})/[^/]*$"
    part = lambda p, k: F.regexp_extract(path, p, k)
    day = F.concat_ws("-", part(daily, 1), part(daily, 2), part(daily, 3))
    good_day = F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).isNotNull()
    good_week = part(weekly, 2).cast("int").between(1, 53)
    good_month = part(monthly, 2).cast("int").between(1, 12)
    kind = F.when(path.rlike(daily), F.when(good_day, "daily")).when(path.rlike(weekly), F.when(good_week, "weekly")).when(path.rlike(monthly) & good_month, "monthly")
    value = F.when(kind == "daily", day).when(kind == "weekly", F.concat(part(weekly, 1), F.lit("-W"), part(weekly, 2))).when(kind == "monthly", F.concat_ws("-", part(monthly, 1), part(monthly, 2)))
    return kind, value


def date_at(ts: Column, kind: Column) -> Column:
    """A time at a dated path's grain."""
    return F.when(kind == "daily", F.date_format(ts, "yyyy-MM-dd")).when(kind == "weekly", iso_week(ts)).when(kind == "monthly", F.date_format(ts, "yyyy-MM"))


def age_days(reference: Column, ts: Column) -> Column:
    """Whole days from ``ts`` to ``reference``, cut toward zero."""
    seconds = F.unix_micros(reference.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    return F.when(seconds < 0, F.ceil(seconds / 86_400_000_000)).otherwise(F.floor(seconds / 86_400_000_000)).cast("long")


# Ranks.


def tier_level(tier: Column) -> Column:
    t = F.lower(F.trim(tier))
    out = F.when(t == TIERS[0], 0)
    for i, name in enumerate(TIERS[1:], 1):
        out = out.when(t == name, i)
    return out.otherwise(-1)


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity) - 1


def git_url(url: Column) -> Column:
    """'host/path' with the host in lower case, from any way to write a remote: a URL, user@host:path, or host/path."""
    u = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "/$", ""), r"\.git$", "")
    rest = F.regexp_replace(F.regexp_replace(u, "^.*?://", ""), "^[^@]*@", "")
    joined = lambda host, path: F.concat(F.lower(host), F.lit("/"), F.trim(path, F.lit("/")))
    as_url = F.when(F.contains(rest, F.lit("/")), joined(F.regexp_extract(rest, "^([^/:]*)", 1), F.regexp_extract(rest, "^[^/]*/(.*)$", 1))).otherwise(F.lower(rest))
    as_scp = joined(F.regexp_extract(u, "@([^:]*):", 1), F.regexp_extract(u, "@[^:]*:(.*)$", 1))
    as_bare = F.when(F.contains(u, F.lit("/")), F.concat(F.lower(F.substring_index(u, "/", 1)), F.regexp_replace(u, "^[^/]*", ""))).otherwise(F.lower(u))
    return F.when(F.contains(u, F.lit("://")), as_url).when(u.rlike("@[^:]*:"), as_scp).otherwise(as_bare)
