"""Personal information in free text: generators propose spans, boosted trees judge them.

Generators are made for recall and overlap: addresses with '@' or written around it, runs of grouped
digits, house numbers beside capitalised words, runs of capitalised words in every order a name can
have. One model per kind judges a span by its format and by what stands around it. Of overlapping
spans the most probable holds. A model is fitted on a bounded sample of texts whose spans get labels
from strict formats, labels in the text and a list of known names, and on phrases made here; the name
features come from letters, not from the list, so that names outside it are found. What words are
common is counted over all documents. Judging takes no sample: every text is searched whole.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.boosting import Boosted, fit

KINDS = ("email", "phone", "id_number", "address", "person_name")
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}

#: Texts in the sample a model is fitted on, and the most characters one of them may have to be in it.
SAMPLE_TEXTS, SAMPLE_CHARS = 4_000, 20_000
#: Known names and common words a model keeps.
MOST_NAMES, MOST_WORDS = 20_000, 20_000
#: A word is common if it stands in lower case so often in the documents, for each COMMON_TEXTS of them.
COMMON_FROM, COMMON_TEXTS = 3, 4_000
#: Characters around a span that its features see.
AROUND = 40

# Words around numbers, of streets and before and inside names.
PHONE_WORDS = "phone tel tél telephone téléphone telefon teléfono call mobile cell handy fax reach desk rückruf móvil".split()
ID_WORDS = "ssn nir social security passport passeport pasaporte reisepass ausweis identity national registry register registre registro dni nie licence license insurance steuer tax personal".split()
OTHER_WORDS = "ticket invoice build run digest host version order commit issue bytes probes hash at pages pinned port".split()
STREET_WORDS = (
    "street st road rd avenue ave lane ln drive dr court ct close terrace boulevard blvd way place pl square sq crescent row walk hill park gardens parkway highway "
    "rue chemin allée impasse quai route cours calle avenida plaza paseo camino carrera via viale piazza corso rua"
).split()
STREET_ENDS = ("straße", "strasse", "str.", "weg", "gasse", "allee", "platz", "damm", "ufer", "ring", "steig", "straat", "laan", "gade", "gatan", "vej")
PARTICLES = "van von de der den del della di du da dos das la le zu zur ten ter af al el bin ibn".split()
TITLES = "mr mrs ms miss dr prof herr frau mme mlle sr sra srta sir madame monsieur doctor professor".split()



def _letters_where(holds) -> str:
    """The letters of scripts with capitals for which ``holds``, as ranges of a character class."""
    out, first = [], None
    for c in range(0x41, 0x2000):
        if chr(c).isalpha() and holds(chr(c)):
            first = c if first is None else first
        elif first is not None:
            out.append(chr(first) if first == c - 1 else f"{chr(first)}-{chr(c - 1)}")
            first = None
    return "".join(out)


_UP = _letters_where(str.isupper)
_LET = _letters_where(lambda c: c.lower() != c.upper()) + "\u0300-\u036f"
_GAP = "[    ]"
_T = rf"[{_UP}](?:[{_LET}]|['’](?=[{_UP}]))*(?:[-‐‑][{_UP}][{_LET}]*)*"
_P = "(?:" + "|".join(p for q in PARTICLES for p in (q, q.upper())) + rf")(?![{_LET}])"
_I = rf"[{_UP}]\."

_sign = re.compile("[@＠]")
_disguise = re.compile(r"[\[({] ?[aA][tT] ?[\])}]| [aA][tT] (?=[\w-]+(?: [dD][oO][tT] |\.[\w-]))")
_mail_cue = re.compile(r"(?:\b(?:e-?mail|mail|contact|write|wrote|reach|ask|cc|message|send|sent)\b)[^.\n]*$")
_local = re.compile(r"[\w.%+\-�]+ ?$")
#: Characters before a sign that are searched for the local part at first; more while it goes on.
LOCAL_WINDOW = 90
_domain = re.compile(r" ?[\w�-]+(?:(?:\.| ?[\[({] ?dot ?[\])}] ?| dot )[\w�-]+)+", re.I)
_number = re.compile(r"(?<![\w.-])(?:[A-Z]{1,3}[ -]?)?[+(]?[0-9]+(?:(?:[ .\-/ ‑]|(?= ?\()) ?\(?[0-9]+\)?|\)[ .\-/]?[0-9]+)*(?:-[A-Z](?![\w])|[A-Z](?!\w))?(?![\w-])")
_digits = re.compile(r"[0-9](?:[ .\-/()\u00a0\u2011]{0,2}[0-9]){6,}")
_more_digits = re.compile(r"[ .\-/\u00a0\u2011]\(?[0-9]")  # of a word that begins with digits, so that where the number ends is open
#: Digits, with those dialled to leave the country, and groups that a phone number may have.
PHONE_DIGITS, PHONE_GROUPS = 18, 15
#: Words that a street may have.
STREET_PARTS = 12
_house_first = re.compile(rf"[0-9](?<![\w.,:/-].)[0-9]{{0,3}}[a-zA-Z]?,? (?:(?:[{_UP}][{_LET}'’-]*\.?|{'|'.join(w for w in STREET_WORDS if w.islower())}|de|du|des|la|le|les|del|los|las)(?![\w]) ?){{1,{STREET_PARTS}}}")
_house_last = re.compile(rf"[{_UP}](?<![\w-].)(?<![{_UP}]['’].)(?:[{_LET}'’-]|\.(?![{_UP}]))*(?: (?:[{_UP}](?:[{_LET}'’-]|\.(?![{_UP}]))*|de|du|des|la|le|les|del|los|las|der|dem|den|am|an|zum|zur)){{0,{STREET_PARTS - 1}}},? [0-9]{{1,4}}[a-zA-Z]?(?![\w.:/-]*[0-9])(?!\w)")
_unit = rf"(?:{_I}|{_P}|{_T}(?!\.?[\w@]))"
_names = re.compile(rf"[{_UP}](?<![{_LET}0-9@.+_/\-].)(?<![{_UP}]['’].)(?:\.|(?:[{_LET}]|['’](?=[{_UP}]))*(?:[-‐‑][{_UP}][{_LET}]*)*(?!\.?[\w@]))(?:,?{_GAP}{_unit}(?![{_LET}]))+")
_units = re.compile(_unit)
_particles_before = re.compile(rf"(?<![{_LET}])(?:{_P}{_GAP})+$")
_words_before = re.compile(rf"[{_LET}]+")


@dataclass
class Span:
    kind: str
    start: int
    end: int
    features: list[float]
    strict: int | None = None  # the label that format and surroundings give: 1, 0 or unknown
    probability: float = 0.0
    words: tuple = ()  # of names, for fitting: the words before and after, the own ones, and whether one of these is common
    alone: bool = True  # of names, for fitting: no other capitalised words beside it


# Generators. Each yields spans with features; ``strict`` is used in fitting only.


def _local_part(text: str, end: int) -> re.Match | None:
    """The local part that ends at ``end``, from its first character on however long it is."""
    window = LOCAL_WINDOW
    while True:
        first = max(0, end - window)
        found = _local.search(text, first, end)
        if not found or found.start() > first or not first:
            return found
        window *= 2


def emails(text: str) -> Iterator[Span]:
    separators = list(_sign.finditer(text)) if "@" in text or "＠" in text else []
    separators += _disguise.finditer(text)
    for m in separators:
        left = _local_part(text, m.start())
        right = _domain.match(text, m.end())
        if not left or not right:
            continue
        start, end = left.start(), right.end()
        local = text[start : m.start()].rstrip()
        start += len(local) - len(local.lstrip(".-+"))
        local = local.lstrip(".-+")
        value = text[start:end].rstrip(".-")
        end = start + len(value)
        if not local:
            continue
        host = right.group().strip()
        after, before = text[end : end + 1], text[max(0, start - 1) : start]
        ending = re.split(r"[.\s\])}]+", value)[-1]
        plain = m.group() in "@＠"
        # 'name at mail.example' is also how a place is told, so what stands before decides
        bare = m.group().lower() == " at " and not re.search(r"\bdot\b", host, re.I)
        cue = bare and bool(_mail_cue.search(text[_line_start(text, start) : start].lower()))
        good = len(ending) >= 2 and (cue or not bare)
        yield Span(
            "email", start, end,
            [
                plain, local.lower() == "git", after == ":" and text[end + 1 : end + 2].isalnum(), ending.isdigit(), any(c.isdigit() for c in ending), len(ending), host.count("."), len(local), before == "<", after == ">",
                bool(re.search(r"dot", host, re.I)) and not plain, "." in local, host[:1].isdigit(), before == ":", before == "/", after == "/", m.group() == " at ", bare, cue,
            ],
            0 if (after == ":" and text[end + 1 : end + 2].isalnum()) or ending.isdigit() or any(c.isdigit() for c in ending) else 1 if good else 0 if bare else None,
        )


def _near(words: list[str], context: str) -> float:
    """How close a listed word stands before the span: 1 beside it, 0 if there is none."""
    best = 0.0
    found = _words_before.findall(context)
    for i, word in enumerate(reversed(found)):
        if any(word == w or (len(w) > 4 and word.startswith(w)) for w in words):
            best = max(best, 1 / (1 + i))
    return best


def _line_start(text: str, at: int) -> int:
    """Where the line begins, or AROUND characters before."""
    first = max(0, at - AROUND)
    return max(first, text.rfind("\n", first, at) + 1)


_GROUPS = re.compile(r"[0-9]+")


def numbers(text: str) -> Iterator[Span]:
    for m in (m for zone in _digits.finditer(text) for m in _number.finditer(text, max(0, zone.start() - 6), min(len(text), zone.end() + 4))):
        value = m.group()
        if len(value) < 7 or _more_digits.match(text, m.end()):
            continue
        groups = _GROUPS.findall(value)
        digits = sum(map(len, groups))
        if digits < 7 or (len(groups) == 3 and len(groups[0]) == 4 and digits == 8 and value[4:5] == "-"):
            continue
        spans = [(m.start(), m.end())]
        tail = re.search(r" \(?[0-9]+\)?$", value)
        if tail and len(groups) > 2 and digits > 10:
            spans.append((m.start(), m.start() + tail.start()))
        if value[0] == "(" and value.find(")") in (-1, len(value) - 1):  # brackets around the whole, not around an area code
            spans = [(a + 1, b) for a, b in spans]
        for start, end in spans:
            own = text[start:end].rstrip(")") if text[start:end].count(")") > text[start:end].count("(") else text[start:end]
            label = re.match(r"([A-Z]{2,3})[ -]?\(?(?=[0-9])", own)
            if label and label.group(1).lower() in ID_WORDS:  # the label isn't part of the number
                start, own = start + label.end(), own[label.end() :]
                own = own.rstrip(")") if own.count(")") > own.count("(") else own
            yield from _number_spans(text, start, start + len(own), own, end < m.end(), digits <= PHONE_DIGITS and len(groups) <= PHONE_GROUPS)


def _number_spans(text: str, start: int, end: int, value: str, cut: bool, short: bool) -> Iterator[Span]:
    """A phone number has no more digits than numbering plans allow; a longer number can be one of a person if a label says so."""
    groups = _GROUPS.findall(value)
    sizes = list(map(len, groups))
    digits = sum(sizes)
    letters = [c for c in value if c.isalpha()]
    line = _line_start(text, start)
    before, after = text[line:start].lower(), text[end : end + 8]
    prev, next_ = text[start - 1 : start], after[:1]
    phone, id_, other = (_near(w, before.rpartition("|")[2]) for w in (PHONE_WORDS, ID_WORDS, OTHER_WORDS))
    lead = value.lstrip("(")
    plus, double, single = lead.startswith("+"), lead.startswith("00"), lead.startswith("0")
    separators = [value.count(c) for c in " .-/"]
    year = bool(re.match(r"(?:19|20)\d\d[-/. ]", value))
    features = [
        digits, len(groups), sizes[0], sizes[-1], max(sizes), min(sizes), plus, double, single, "(" in value, len(letters), value[0].isalpha(), value[-1].isalpha(), *separators, phone, id_, other, prev == "(", prev == "[", prev in "\n", prev == ",",
        prev == ":", prev in "#=/", next_ in "\n", next_ == ")", next_ == ",", next_ == ":", next_ in ".;", next_ == "%", after.lower().startswith(", ext") or " ext" in after.lower(), year, sizes == [3, 3, 4], sizes == [3, 2, 4], sizes == [4, 4], len(set(sizes)) == 1, cut, sizes[1] if len(sizes) > 1 else 0,
        before.strip() == "" and len(before) < 4, bool(re.match(r" [0-9]", after)), sum(c.isdigit() for c in before), prev == " ",
    ]
    dialled = not letters and ((plus and 8 <= digits <= 15) or (double and 10 <= digits <= 16) or (single and len(groups) > 1 and 9 <= digits <= 12 and not year) or sizes == [3, 3, 4])
    labelled = id_ >= 0.2
    if not short and (not labelled or cut):
        return
    good_phone = 1 if dialled and not labelled and not cut else 0 if not dialled or labelled or cut else None
    if short:
        yield Span("phone", start, end, features, good_phone)
    yield Span("id_number", start, end, features, 1 if labelled and not plus and not cut and (phone < id_) else 0)


def addresses(text: str) -> Iterator[Span]:
    for pattern, first in ((_house_first, True), (_house_last, False)):
        for m in pattern.finditer(text):
            value = m.group().rstrip()
            if first:
                if value.endswith(".") and len(re.split(r"[ .]", value[:-1])[-1]) > 4:
                    value = value[:-1]
                parts = value.split(" ")
                ends = [k for k in range(2, len(parts) + 1) if k == len(parts) or parts[k - 1].lower().strip(".") in STREET_WORDS]
                options = [(m.start(), m.start() + len(" ".join(parts[:k]))) for k in ends]
            else:
                parts = value.split(" ")
                options = [(m.start() + len(" ".join(parts[:k])) + (k > 0), m.start() + len(value)) for k in range(len(parts) - 1) if parts[k][:1].isupper() and (k == 0 or parts[k].lower() in STREET_WORDS or parts[k].lower().endswith(STREET_ENDS))]
            for start, end in options:
                yield _address(text, start, end, first)


def _address(text: str, start: int, end: int, first: bool) -> Span:
    value = text[start:end]
    words = [w for w in value.split(" ") if w and not w[0].isdigit()]
    plain = [w.lower().strip(".,") for w in words]
    streets = [i for i, w in enumerate(plain) if w in STREET_WORDS]
    suffix = any(w.lower().endswith(STREET_ENDS) and len(w) > 4 for w in words)
    line = _line_start(text, start)
    before, after = text[line:start].lower(), text[end : end + 12]
    number = re.findall(r"[0-9]+", value)
    at_edge = bool(streets) and (streets[0] == 0 or streets[-1] == len(words) - 1)
    cue = bool(re.search(r"(address|adresse|anschrift|dirección|office|parcels?|sent to|go to|lives? at|wohnhaft|deliver)[^.]*$", before))
    features = [
        first, len(words), len(streets), streets[0] == 0 if streets else 0, streets[-1] == len(words) - 1 if streets else 0, suffix, cue, len(number[0]) if number else 0, after.startswith(","), after[:1] == "\n" or not after, bool(re.match(r",[^\n]*[0-9]{5}", after)), "apt" in after.lower(),
        sum(w[:1].isupper() for w in words), before.strip() == "", value.endswith("."), bool(re.match(r" [a-z]", after)), _near(OTHER_WORDS, before), bool(re.search(r"[0-9]$", value)), text[start - 1 : start] == "[",
    ]
    good = (suffix and not first and len(words) == 1) or (first and len(words) > 1 and at_edge and (streets[-1] == len(words) - 1 or streets[0] == 0)) or (not first and streets[:1] == [0] and len(words) > 1)
    return Span("address", start, end, features, 1 if good and cue else 0 if not (streets or suffix) else None if good else 0)


@dataclass
class Names:
    """Letters and surroundings of names, learned from known ones; no list of names."""

    given: list[dict[str, float]] = field(default_factory=list)
    family: list[dict[str, float]] = field(default_factory=list)
    common: dict[str, float] = field(default_factory=dict)
    before: dict[str, float] = field(default_factory=dict)
    after: dict[str, float] = field(default_factory=dict)
    beside: dict[str, tuple[int, int]] = field(default_factory=dict)  # capitalised words: spans with a common word, and others
    floors: dict[str, float] = field(default_factory=dict)  # letter odds that known family names, and all but a few pairs of known names, exceed
    scores: dict[tuple[str, str], float] = field(default_factory=dict)  # of tokens seen, kept for speed
    halves: dict[str, int] = field(default_factory=dict)  # known names: which half of the list they are in

    def letters(self, kind: str, token: str) -> float:
        """Mean log odds of the letter triples; a known name is judged by the half that it isn't in."""
        score = self.scores.get((kind, token))
        if score is None:
            if len(self.scores) > 200_000:
                self.scores.clear()
            score = self.scores[kind, token] = self._letters(self.given if kind == "given" else self.family, token)
        return score

    def _letters(self, models: list[dict[str, float]], token: str) -> float:
        worst = 1e9
        for part in re.split(r"[-‐‑]", token.lower()):
            half = self.halves.get(part)
            triples = _triples(part)
            scores = [sum(m.get(t, -1.0 if len(t) < 5 else 0.0) for t in triples) / len(triples) for k, m in enumerate(models) if k != half] or [0.0]
            worst = min(worst, sum(scores) / len(scores))
        return worst


def _triples(word: str) -> list[str]:
    """Runs of three letters, and the first and last four, which tell more where an end is a common one."""
    padded = f"^{word}$"
    return [*(padded[i : i + 3] for i in range(max(1, len(padded) - 2))), padded[:5], padded[-5:]]


def letter_odds(names: Iterable[str], others: dict[str, int]) -> dict[str, float]:
    """Log odds of triples in names against those of common words."""
    ours, theirs = Counter(), Counter()
    for name in names:
        ours.update(_triples(name.lower()))
    for word in others:
        theirs.update(_triples(word))
    a, b = sum(ours.values()) + 2000, sum(theirs.values()) + 2000
    return {t: math.log((ours[t] + 0.5) / a) - math.log((theirs[t] + 0.5) / b) for t in {*ours, *theirs}}


#: Parts of the longest form a name can have below: given name, two initials, another name, two particles, family name.
LONGEST_NAME = 7


def people(text: str, model: Names, known: dict[str, set[str]] | None = None) -> Iterator[Span]:
    for m in _names.finditer(text):
        units = [u.span() for u in _units.finditer(text, m.start(), m.end())]
        before = _particles_before.search(text, max(0, m.start() - 16), m.start())
        if before and "," in m.group():
            units = [u.span() for u in _units.finditer(text, before.start(), m.start())] + units
        kinds = []
        for a, b in units:
            word = text[a:b]
            kinds.append("i" if word.endswith(".") else "p" if word.lower() in PARTICLES else "x" if word.lower() in TITLES else "t")
        for i in range(len(units)):
            for j in range(i + 2, min(i + LONGEST_NAME, len(units)) + 1):
                shape = "".join(kinds[i:j])
                commas = [k for k in range(i, j - 1) if text[units[k][1] : units[k][1] + 1] == ","]
                if not commas and re.fullmatch(r"[ti]i{0,2}t?p{0,2}t", shape):
                    family, given = units[j - 1], units[i]
                elif len(commas) == 1 and re.fullmatch(r"p{0,2}t[ti]i?", shape) and kinds[commas[0]] == "t" and commas[0] - i == len(re.match("p*", shape).group()):
                    family, given = units[commas[0]], units[commas[0] + 1]
                else:
                    continue
                ahead = 0  # units of the run before the span that no comma or title separates from it, 8 at most
                while ahead < min(i, 8) and kinds[i - ahead - 1] != "x" and text[units[i - ahead - 1][1]] != ",":
                    ahead += 1
                behind = 0
                while behind < 8 and j + behind < len(units) and text[units[j + behind - 1][1]] != ",":
                    behind += 1
                yield _person(text, units[i][0], units[j - 1][1], given, family, shape, bool(commas), ahead, behind, model, known)


def _person(text: str, start: int, end: int, given: tuple[int, int], family: tuple[int, int], shape: str, comma: bool, ahead: int, behind: int, model: Names, known) -> Span:
    first, last = text[given[0] : given[1]], text[family[0] : family[1]]
    initial = first.endswith(".")
    g = 0.0 if initial else model.letters("given", first)
    f = model.letters("family", last)
    usual = max(model.common.get(p.lower(), 0.0) for w in (first, last) for p in re.split(r"[-‐‑]", w))
    line = _line_start(text, start)
    before, after = text[line:start], text[end : end + 16]
    word = _words_before.findall(before)
    previous = word[-1].lower() if word and before.rstrip(" .:\"<")[-1:] == word[-1][-1] else "^"
    previous = "<title>" if previous in TITLES else previous
    following = re.match(r"[ ]?([^\W\d_]+|\S)?", after)
    next_ = (following.group(1) or "$").lower()
    features = [
        comma, len(shape), initial, "p" in shape, "i" in shape[1:], first.isupper() and len(first) > 2, last.isupper(), "-" in last or "-" in first, g, f, min(g, f) if not initial else f, usual, ahead, behind, model.before.get(previous, 0.0), model.after.get(next_, 0.0),
        previous == "<title>", after.lstrip(" ").startswith("<"), after[:2] in ("'s", "’s"), after[:1] in "\n", before.strip() == "", before.lstrip().startswith("#"), len(first), len(last), after[:1] == ",", before[-1:] == '"', model.letters("family", first) if not initial else f, model.letters("given", last),
    ]
    pair = [w.lower() for w in (first, last) if not w.endswith(".")]
    strict = None
    if known is not None:
        last_parts = [p.lower() for p in re.split(r"[-‐‑]", last)]
        is_family, is_given = any(p in known["family"] for p in last_parts), first.lower() in known["given"]
        extra = re.fullmatch(r"t{3,}", shape)
        swapped = any(p.lower() in known["family"] for p in re.split(r"[-‐‑]", first)) or any(p in known["given"] for p in last_parts)
        if extra or swapped:
            strict = 0
        elif is_family and (is_given or initial):
            strict = 1
        elif usual > 0:
            strict = 0
        elif not is_family and not is_given and (f < model.floors.get("family", -1e9) if initial else g + f < model.floors.get("both", -1e9)):
            strict = 0
    counted = usual > 0 and not comma
    odds = []
    for w in pair:
        with_common, others = model.beside.get(w, (0, 0))
        if known is not None:  # without the span that is judged
            with_common, others = max(0, with_common - counted), max(0, others - (not counted))
        odds.append(math.log((with_common + 0.5) / (others + 1.5)))
    span = Span("person_name", start, end, [*features, max(odds), min(odds)], strict)
    span.words, span.alone = (previous, next_, pair, counted), not ahead and not behind
    return span


# Fitting.

_BLOCKS = "Questions about the form: {e}. cc {e}, please.|Phone: {p}\ntel. {p}, ext. 12|{e} or {p} (mornings)|SSN: {i}\nThe form shows {w} {i} in clear.|{w}: {i}|pasted a {w} ({i}) here|Address: {a}\nTown|sent to {a} yesterday.|Parcels go to {a}, Town 12345.|New office from Monday: {a}, Apt 7.|Address: {a}, Apt 12"


def phrases(n: int = 400, seed: int = 7) -> list[str]:
    """Texts made here that hold every kind but names, so that a small sample has examples too."""
    rng = random.Random(seed)
    digit = lambda pattern: "".join(str(rng.randrange(10)) if c == "9" else rng.choice("ABCDEFGH") if c == "X" else c for c in pattern)
    word = lambda: "".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(rng.randrange(2, 4)))
    phones = ["+1 999 555 9999", "+49 30 99999 999", "(999) 555-9999", "999-555-9999", "+44 20 9999 9999", "+33 1 99 99 99 99", "01 99 99 99 99", "030/99999-999", "+19995559999", "0049 30 99999 99", "01.99.99.99.99", "+44 (0)99 9999-9999", "+1.999.555.9999"]
    ids = ["999-99-9999", "XX99999999", "XX 99999999", "XX-9999-9999-X", "9 99 99 99 999 999 99", "99999999X", "X9999999"]
    labels = ["SSN", "passport", "national ID", "identity card", "passport no.", "registry number", "Ausweis-Nr.", "DNI", "social security number", "tax ID"]
    out = []
    for _ in range(n):
        street = rng.choice([digit("99 ") + word().title() + " " + rng.choice(["Street", "Lane", "Rd.", "Avenue", "Court", "Blvd"]), word().title() + rng.choice(["straße", "weg", "gasse"]) + digit(" 99"), digit("99 rue de la ") + word().title(), "Calle del " + word().title() + digit(" 99")])
        mail = rng.choice(["{0}.{1}@{2}.example", "{0}@{2}.example.org", "{0} [at] {2} [dot] example", "{0}(at){2}.example", "{0} at {2} dot example"]).format(word(), word(), word())
        out.append(rng.choice(_BLOCKS.split("|")).format(e=mail, p=digit(rng.choice(phones)), i=digit(rng.choice(ids)), a=street, w=rng.choice(labels)))
        out.append(digit(rng.choice(["Ticket OPS-999999 and build 2024.99.999.", "Host 192.0.2.99 answered 99 of 999 probes.", "Fetched git@git.example:a/b.git at 99ab.", f"Pinned {word()}@9.99.9 for now.", f"Pinned{word()}-{word()}@9.99.9fornow.", f"Fetchedgit@git.example:{word()}/{word()}.git", "At 2024-11-12T10:99:99Z it stopped.", "Invoice 999999 covers 99 Main items.", "[99:99:99] done 99999 9999ms", "Run 99999999-9999-9999 took 999,999 bytes.", "Fetched git@git.example:a/b.git at 999999999999.", "[99:99:99] moved a-b 9999999999 9999ms"])))
    for _ in range(n // 8):
        end = rng.choice(["example", "example.org", "example.com"])
        out.append(rng.choice(["mail", "write to", "please contact", "ask", "E-mail:", "cc"]) + f" {word()} at {word()}.{end} " + rng.choice(["", "please", "today", "about it"]))
        out.append(rng.choice(["The desk answers", "It was hosted", "We looked", "Read more", "The page moved"]) + f" at {word()}.{end} " + rng.choice(["", "now", "today", "last week"]))
    return out


@dataclass
class Model:
    kinds: dict[str, Boosted]
    names: Names


_lower_word = re.compile(r"(?<![\w@.+-])[a-zà-öø-ÿ]{2,}(?![\w@.+-])")
_hidden_address = r"[\[({] ?[aA][tT] ?[\])}]| [aA][tT] [\pL\pN_-]+( [dD][oO][tT] |\.[\pL\pN_-])"


def lower_words(text: str) -> list[str]:
    """Words in lower case that stand by themselves; those inside addresses, which may be names, are none."""
    at = 0
    parts = []
    for s in sorted(emails(text), key=lambda s: s.start):
        parts.append(text[at : s.start])
        at = max(at, s.end)
    return _lower_word.findall(" ".join([*parts, text[at:]]))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to counts of their ``lower_words``; texts without written-out addresses are cut into words as columns."""
    counts: Counter = Counter()
    for batch in batches:
        rows = max(1, batch.num_rows * (4 << 20) // max(1, batch.column(0).nbytes))
        for at in range(0, batch.num_rows, rows):
            texts = batch.column(0).slice(at, rows).drop_null()
            odd = pc.match_substring_regex(texts, _hidden_address)
            for text in texts.filter(odd).to_pylist():
                counts.update(lower_words(text))
            words = pc.split_pattern_regex(texts.filter(pc.invert(odd)), r"[^\pL\pN_@.+-]+").flatten()
            words = words.filter(pc.match_substring_regex(words, "^[a-zà-öø-ÿ]{2,}$")).value_counts()
            for word, n in zip(words.field(0).to_pylist(), words.field(1).to_pylist()):
                counts[word] += n
            if len(counts) > 500_000:
                yield _counted_words(counts)
                counts = Counter()
    if counts:
        yield _counted_words(counts)


def _counted_words(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def common_words(documents: DataFrame, n: int, text_col: str = "text") -> dict[str, float]:
    """The most common words of all ``n`` documents with how often they stand in COMMON_TEXTS of them: MOST_WORDS at most, which a model keeps."""
    counted = documents.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    share = COMMON_TEXTS / max(n, COMMON_TEXTS)
    rows = counted.where(F.col("n") * share >= COMMON_FROM).orderBy(F.desc("n"), "word").limit(MOST_WORDS).collect()
    return {r["word"]: r["n"] * share for r in rows}


def train(texts: list[str], known_names: list[tuple[str, str]], words: dict[str, float] | None = None) -> Model:
    """Models of all kinds from sample texts, (name, kind) of known names, and ``common_words``, those of the sample if not given; any may be empty."""
    known = {k: {n.lower() for n, kind in known_names[:MOST_NAMES] if kind == k and n} for k in ("given", "family")}
    if words is None:
        words = dict(Counter(w for text in texts for w in lower_words(text)).most_common(MOST_WORDS))
    listed = known["given"] | known["family"]
    common = {w: math.log1p(c) for w, c in words.items() if c >= COMMON_FROM and w not in listed}
    names = Names(common=common)
    for kind in ("given", "family"):
        ordered = sorted(known[kind])
        names.halves |= {n: i % 2 for i, n in enumerate(ordered)}
        others = {w: 1 for w in common}
        getattr(names, kind).extend(letter_odds(ordered[h::2] or ordered, others) for h in (0, 1))
    scores = {kind: np.array([names.letters(kind, n) for n in sorted(known[kind])]) for kind in ("given", "family")}
    if len(scores["given"]) and len(scores["family"]):
        pairs = scores["given"][:, None] + scores["family"][None, :]
        names.floors = {"family": float(scores["family"].min()) - 0.3, "both": float(np.quantile(pairs, 0.002))}
    proposed = [list(people(text, names, known)) for text in texts]
    first = [s for found in proposed for s in found]
    common_pairs, other_pairs = (Counter(w for s in first if s.words[3] == flag for w in s.words[2]) for flag in (True, False))
    names.beside = {w: (n, other_pairs[w]) for w, n in common_pairs.most_common(MOST_WORDS)}
    for side, at in ((names.before, 0), (names.after, 1)):
        seen = {label: Counter(s.words[at] for s in first if s.strict == label) for label in (0, 1)}
        totals = {label: sum(c.values()) + 20 for label, c in seen.items()}
        for w in {*seen[0], *seen[1]}:
            if seen[0][w] + seen[1][w] >= 3:
                side[w] = math.log((seen[1][w] + 1) / totals[1]) - math.log((seen[0][w] + 1) / totals[0])
    spans: dict[str, list[Span]] = {k: [] for k in KINDS}
    for text, start, end in _renamed(texts, proposed, known_names[:MOST_NAMES]):
        for span in _longest(list(people(text, names, known))):
            if (span.start, span.end) == (start, end):
                span.strict = 1
            elif span.start < end and start < span.end:
                span.strict = 0
            else:
                continue
            spans["person_name"].append(span)
    for text in [*texts, *phrases()]:
        for span in _longest(propose(text, names, known)):
            if span.strict is not None:
                spans[span.kind].append(span)
    kinds = {}
    for kind, found in spans.items():
        x = np.array([s.features for s in found], float) if found else np.zeros((0, 1))
        kinds[kind] = fit(x, np.array([s.strict for s in found], float))
    names.scores = {}
    return Model(kinds, names)


def _longest(spans: list[Span]) -> list[Span]:
    """Parts of a span with a positive label have a negative one."""
    good = sorted((s for s in spans if s.strict == 1), key=lambda s: (s.start, -s.end))
    for a, b in zip(good, good[1:]):
        if a.strict == 1 and a.kind == b.kind and b.end <= a.end and (a.start, a.end) != (b.start, b.end):
            b.strict = 0
    return spans


def _renamed(texts: list[str], proposed: list[list[Span]], listed: list[tuple[str, str]], most: int = 3_000, seed: int = 11) -> Iterator[tuple[str, int, int]]:
    """Known names in every form a name can have, put where sure names stand, and as many where other capitalised words do.

    The latter keep the models from taking surroundings in which the sample has no known name as a sign against one.
    """
    rng = random.Random(seed)
    givens, families = ([n for n, kind in listed if kind == k and n] for k in ("given", "family"))
    if not givens or not families:
        return
    places: dict[int, list[tuple[str, str]]] = {0: [], 1: []}
    for text, found in zip(texts, proposed):
        for s in _longest(found):
            if s.strict == 1 or (s.strict == 0 and s.alone):
                places[s.strict].append((text[max(0, s.start - 60) : s.start], text[s.end : s.end + 40]))
    drawn = [p for label in (0, 1) for p in rng.sample(places[label], min(most // 2, len(places[label])))]
    for left, right in drawn:
        g, f = rng.choice(givens), rng.choice(families)
        f = f"{f}-{rng.choice(families)}" if rng.random() < 0.2 else f"{rng.choice(PARTICLES[:8])} {f}" if rng.random() < 0.15 else f
        letter = f"{rng.choice(givens)[0].upper()}."
        name = rng.choice([f"{g} {f}", f"{g} {f}", f"{f}, {g}", f"{g} {letter} {f}", f"{letter} {f}"])
        name = name.upper() if rng.random() < 0.15 else name
        name = name[0].upper() + name[1:] if name[0].isupper() or not name.startswith(tuple(PARTICLES)) else f"{g} {f}"
        yield left + name + right, len(left), len(left) + len(name)


def propose(text: str, names: Names, known=None) -> list[Span]:
    spans = list(people(text, names, known))
    spans += emails(text)
    spans += numbers(text)
    spans += addresses(text)
    return spans


def _outermost(spans: list[Span]) -> list[Span]:
    """Without spans inside another of their kind."""
    kept: dict[str, Span] = {}
    out = []
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        around = kept.get(s.kind)
        if around is None or s.end > around.end:
            kept[s.kind] = s
            out.append(s)
    return out


def find(texts: list[str | None], model: Model) -> list[list[Span]]:
    """The spans of each text, in order, none overlapping another."""
    proposed = [propose(t, model.names) if t else [] for t in texts]
    for kind in KINDS:
        mine = [s for spans in proposed for s in spans if s.kind == kind]
        if mine:
            for span, p in zip(mine, model.kinds[kind].probability(np.array([s.features for s in mine], float))):
                span.probability = p
    out = []
    for spans in proposed:
        kept: list[tuple[int, int, Span]] = []
        good = _outermost([s for s in spans if s.probability >= model.kinds[s.kind].threshold])
        for span in sorted(good, key=lambda s: (-round(s.probability, 3), s.start - s.end, s.start)):
            at = bisect_left(kept, (span.end, 0), key=lambda k: k[:2])
            if not at or kept[at - 1][1] <= span.start:
                kept.insert(at, (span.start, span.end, span))
        out.append([k[2] for k in kept])
    return out


def redact(text: str, spans: list[Span]) -> str:
    parts, at = [], 0
    for s in spans:
        parts += [text[at : s.start], PLACEHOLDERS[s.kind]]
        at = s.end
    return "".join([*parts, text[at:]])


def fit_model(documents: DataFrame, known_names: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """``train`` on about SAMPLE_TEXTS texts of at most SAMPLE_CHARS characters and MOST_NAMES names, both drawn by their hash."""
    n = documents.count()
    share = min(1.0, SAMPLE_TEXTS / max(n, 1))
    bound = int(share * (1 << 62))
    h = F.xxhash64(id_col, text_col).bitwiseAND((1 << 62) - 1)
    texts = documents.select(F.col(text_col).cast("string").alias("text"), h.alias("h")).where((F.length("text") > 0) & (F.length("text") <= SAMPLE_CHARS))
    rows = texts.where(F.col("h") < bound).orderBy("h", "text").limit(2 * SAMPLE_TEXTS).collect()  # about SAMPLE_TEXTS, by their share of all
    rows = sorted(rows, key=lambda r: (r["h"], r["text"]))
    names = known_names.select("name", "kind").where("name IS NOT NULL").distinct().orderBy(F.xxhash64("name", "kind"), "name", "kind").limit(MOST_NAMES).collect()
    return train([r["text"] for r in rows], sorted((r["name"], r["kind"]) for r in names), common_words(documents, n, text_col))


def found(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, kind, value)`` as the value stands in the text, once per document.

    Null and empty texts have none; rows with one id are taken together; null ids are kept.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [(i, k, v) for i, (t, spans) in enumerate(zip(texts, find(texts, shipped.value))) for k, v in dict.fromkeys((s.kind, t[s.start : s.end]) for s in spans)]
            if rows:
                at, kinds, values = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(kinds), pa.array(values)], names=["id", "kind", "value"])

    id_type = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {id_type}, kind string, value string")
    return rows.distinct().withColumnRenamed("id", id_col)


def redacted(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text)`` with typed placeholders for what ``found`` finds and all else unchanged, a row for each row; null stays null."""
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = [t if t is None else redact(t, spans) for t, spans in zip(texts, find(texts, shipped.value))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["id", "text"])

    id_type = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {id_type}, text string")
    return rows.withColumnRenamed("id", id_col)
