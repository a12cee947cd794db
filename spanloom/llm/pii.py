"""Personal information in free text: found, and replaced by placeholders.

Generators propose overlapping spans of each kind, more than are right: every address-like run around an @, every series of digit groups,
every street word near a number, every series of names. Boosted trees judge each by its format and its context; their thresholds are
calibrated on held-out examples. Of overlapping spans the most probable stands. The trees are fitted on made-up texts with
known spans (see pii_examples), drawn from a fixed seed, so a run needs no labelled rows and always has the same model.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.boosting import BoostedTrees
from spanloom.util import lookup_rows, spread

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

# ---- fixed values: words that stand before numbers, and street words ----
PHONE_WORDS = r"(?i)(?:tel|tél|phone|fon\b|fax|call|dial|ring|mobi|cell|ruf|handy|gsm|\bbel\b|bellen|chiama|appel|portable|erreich|durchwahl|recapito|number is)"
ID_WORDS = r"(?i)(?:\bbsn\b|burgerservice|sofi|steuer|\btax\b|ausweis|\bperso|kenn|passp|paspoort|reisepass|\bid\b|id-|idnr|identi|ssn|\bni\b|insurance|versicherung|social|sozial|sécu|\bnir\b|\bc\.\s?f\.|fisc|tessera|matricule|document)"
SHELF_WORDS = r"(?i)(?:\binv\b|inv\.|réf|ref\.|rif\.|art\.|artik|isbn|shelf|mark|sign|cote\b|segn|plaats|preis|price|prix|prezzo|prijs|order|bestel|\bpp?\.|blz|\bs\.)"
BEFORE_STREETS = "Via|via|V.le|Viale|viale|Piazza|piazza|P.za|P.zza|Corso|corso|C.so|Vicolo|vicolo|Largo|largo|Salita|Strada|VIA|PIAZZA|VICOLO"
SUFFIX_STREETS = "straße|strasse|str.|gasse|weg|platz|allee|ufer|damm|steig|ring|straat|gracht|kade|steeg|laan|plein|singel|dijk|STRASSE|GASSE|WEG|PLATZ|STRAAT|GRACHT|KADE|STEEG"
FRENCH_STREETS = "rue|r.|avenue|av.|impasse|quai|place|pl.|bd|boulevard|boul.|chemin|ch.|ruelle|cours|allée|passage|Rue|Avenue|Impasse|Quai|Place|RUE|QUAI"
ENGLISH_STREETS = "Street|St|Lane|Ln|Row|Close|Road|Rd|Hill|Court|Yard|Alley|Square|Sq|Way|Terrace|Wharf|Place|Avenue|Ave|STREET|LANE|ROW|CLOSE|ROAD"
TITLES = frozenset("frau herr herrn mevrouw mevr dhr de heer meneer mme mlle madame monsieur mr mrs ms miss dr prof signora signor sig sig.ra sir lady signed signé gez get firmato villa volgens secondo selon nach according wonende via viale piazza vicolo corso largo salita strada rue avenue impasse quai place v.le r av".split())
#: Titles, and phrases of signing and telling, after which two unlisted words can be a name.
CUES = r"frau|herrn?|mevrouw|mevr|dhr|(?:de )?heer|meneer|mme|mlle|madame|monsieur|mrs?|ms|miss|dr|prof|dott|signora|signor|sig(?:\.ra)?|sir|lady|signed|sgd|signé|soussigné|gez|gezeichnet|unterschrift|get|w\.g|firmato|f\.to|according to|written by|laut|selon|d'après|secondo|volgens|author|auteur|autore|dear|caro|cher|beste|attn|t\.a\.v"
MORE_PARTICLES = ("van den", "van de", "von der", "von dem", "de la", "del", "degli", "dalla", "dal", "des", "ten", "te", "zum", "zur", "den", "der", "d'", "le", "la", "op")
# ---- end of fixed values ----


def _words(listed: str) -> str:
    return "|".join(re.escape(w) for w in sorted(listed.split("|"), key=len, reverse=True))


BLANK = r"[ \t\u00a0\u2007\u2009\u200a\u202f]"
AT = re.compile(r"@|＠|[\[({]\s?[Aa][Tt]\s?[\])}]|(?<=\s)(?:AT|at)(?=\s+[\w-]+\s+(?:DOT|dot)\s)")
#: Read backwards from the sign.
LOCAL = re.compile(r"\s{0,2}[\w+%-]+(?:(?:\.|\s?[\])]tod[\[(]\s?|\sTOD\s)[\w+%-]+)*")
DOMAIN = re.compile(r"\s{0,2}[^\W_](?:[\w-]*[^\W_])?(?:(?:\.|\s?[\[({]\s?(?i:dot)\s?[\])}]\s?|\s(?:DOT|dot)\s)[^\W_](?:[\w-]*[^\W_])?)+")
RUN = re.compile(r"[+(]{0,2}\d(?:[\d.\-/() \u00a0\u2007\u2009\u200a\u202f\u2010-\u2015\t]{0,2}\d)*")
SEPARATORS = " -./"
#: A phone number has 15 digits at most, behind the sign for abroad (00) and a bracketed 0; no identity code of the five countries is longer than 20.
MOST_DIGITS, MOST_CODE = 18, 20
GROUP = re.compile(r"\d+")
CAPTION = re.compile(r"(?:BSN|NIR|SSN|NI|ID|CF|NR|NO|TEL|FAX)[ -]?\d")
CODE_WORD = re.compile(r"[A-Z0-9]+")
CODE = re.compile(rf"(?<![\w.@-])[A-Z]{{1,6}}[A-Z0-9]*(?:{BLANK}[A-Z0-9]*\d[A-Z0-9]*)*(?:{BLANK}[A-Z])?(?![\w@])")
HOUSE_AFTER = r"\d{1,4}(?!\d)(?:(?:\s?/\s?(?:bis|ter|\d{1,3}|[A-Za-z])|-[IVX]+|-\d{1,3}|\s?[a-zA-Z])(?!\w))?"
SUFFIX_STREET = re.compile(rf"(?:{BLANK}?(?:{_words(SUFFIX_STREETS)})),?{BLANK}+(?:(?:nr|Nr|n|no)\.?{BLANK}*)?$")
BEFORE_STREET = re.compile(rf"(?<![\w.])(?:{_words(BEFORE_STREETS)}){BLANK}+(?:(?:d(?:ei|elle|ella|el|egli|i|a)|dell')\s?)?(?:[^\W\d_][\w'’-]*{BLANK}+){{0,6}}[^\W\d_][\w'’-]*,?{BLANK}+(?:(?:n|N|nr|num)[.°º]*{BLANK}*)?$")
STREET_END = re.compile(rf"(?:{_words(SUFFIX_STREETS)}),?{BLANK}{{1,3}}(?:[nN][ro]?[.°]?{BLANK}*)?$")
STREET_HEAD = re.compile(r"(?:[Vv]i[ac]|V\.l|[Pp]iazz|P\.z|[Cc]ors|C\.so|[Ll]argo|[Ss]trada|[Ss]alita|VI|PIAZ)")
FRENCH_STREET = re.compile(rf"(?:{BLANK}(?:bis|ter|quater|[A-D]))?,?{BLANK}+(?:{_words(FRENCH_STREETS)}){BLANK}*(?:(?:de la|des|du|de|d'|aux|la|le|les){BLANK}*)?[A-ZÀ-Þ][\w'’]*(?:-[\w'’]+)*")
ENGLISH_STREET = re.compile(rf"(?:{BLANK}?-{BLANK}?\d{{1,4}})?(?:{BLANK}?[A-Za-z])?,?{BLANK}+(?:[A-Z][\w'’-]*{BLANK}+){{1,6}}?(?:{_words(ENGLISH_STREETS)})(?![\w'])")
HOUSE = re.compile(r"(?<![\w.,/+@-])\d{1,4}(?![\d])|(?<=\d-)\d{1,4}(?!\d)")
AFTER_NUMBER = re.compile(HOUSE_AFTER)
CAPITAL = re.compile(r"(?<![\w@.+-])[A-ZÀ-ÖØ-Þ](?:[\w'’]+(?:-[\w'’]+)*|\.(?:[ -]?[A-ZÀ-ÖØ-Þ]\.)*)")
CUE = re.compile(rf"(?i)(?<!\w)(?:{CUES.replace(' ', BLANK + '+')})\.?{BLANK}*:?{BLANK}*$")
AGENT = re.compile(r"(?i)(?<!\w)(?:nach|laut|von|bei|by|from|par|selon|chez|da|secondo|presso|door|bij|volgens)\s$")
INITIALS = re.compile(r"[A-ZÀ-ÖØ-Þ]\.(?:[ -]?[A-ZÀ-ÖØ-Þ]\.)*$")

#: Shapes of numbers, 9 for any digit, A for any capital, blanks and hyphens made plain.
FORMATS = [
    re.compile(x + r"\Z")
    for x in (
        r"\+\d{1,3} ?\(0\) ?\d{1,3}([ .-]\d{2,5}){1,5}",
        r"\+\d{1,3}[ .-]?\d{1,4}([ .-]\d{2,8}){1,5}",
        r"00\d{1,3}[ .-]?\d{1,4}([ .-]?\d{2,8}){1,5}",
        r"00\d{2}[ .-]?\d{10}",
        r"\(0?\d{2,5}\) ?\d{3,6}([ -]\d{3,4})?",
        r"0\d{1,4}[/.-]\d{3,8}([ -]\d{3,4})?",
        r"0\d{1,4} \d{3,8}( \d{3,4})?",
        r"0\d([ .-]\d\d){4}",
        r"0\d{9}",
        r"\d{3}-\d{4}",
        r"\d\d \d{3} \d{3} \d{3}",
        r"\d{11}",
        r"00\d\d[ .]\d\d[ .]\d{3}",
        r"\d{9}",
        r"[12][ .]?\d\d[ .]?\d\d[ .]?\d\d[ .]?\d{3}[ .]?\d{3}[ .]?\d\d",
        r"\d{3}-\d\d-\d{4}",
        r"[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-Z]",
        r"[A-Z]{2}\d{7}",
        r"[A-Z]{2}\d{5}[A-Z]{2}",
        r"[A-Z]\d[A-Z]\d\d[A-Z]{2}\d\d",
            r"[A-Z0-9]{9,10}",
            r"[A-Z]{6} ?\d\d[A-Z]\d\d ?[A-Z]\d{3}[A-Z]",
        r"\d{4}-\d{3}",
        r"\d{4} \d{3} \d{2,3}",
        r"\d\d[./-]\d\d[./-]\d{4}",
        r"\d{2,3}[,.]\d{3}",
    )
]
#: So many of FORMATS, from the first, are of phone and identity numbers; the rest are of others.
PERSONAL = len(FORMATS) - 4


def _side(c: str) -> int:
    """What a neighbouring character is: nothing, line end, blank, letter, digit, opening, closing, full stop, others."""
    if not c:
        return 0
    if c in "\r\n":
        return 1
    if c.isspace():
        return 2
    if c.isalpha() or c == "_":
        return 3
    if c.isdigit():
        return 4
    if c in "([<{«":
        return 5
    if c in ")]>}»":
        return 6
    return 7 if c == "." else 8 if c in ",;:" else 9


def _blank(c: str) -> str:
    return " " if c.isspace() else "-" if "\u2010" <= c <= "\u2015" else c


class Lexicon:
    """Name parts in lower case by kind, and the ends that surnames share."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.parts = {k: {p.lower() for p, kind in rows if kind == k} for k in ("given", "surname", "particle")}
        ends: dict[str, int] = {}
        for s in self.parts["surname"]:
            for n in (3, 4, 5, 6):
                if len(s) > n + 1:
                    ends[s[-n:]] = ends.get(s[-n:], 0) + 1
        self.ends = {e for e, n in ends.items() if n >= max(4, len(self.parts["surname"]) // 60)}
        particles = sorted(self.parts["particle"] | set(MORE_PARTICLES), key=len, reverse=True)
        self._particles = frozenset(particles)
        self._kinds: dict[str, str] = {}
        self.reach = 2 * max(map(len, particles)) + 8
        one = "|".join(re.escape(p).replace(r"\ ", BLANK + "+") for p in particles)
        self.particle_before = re.compile(rf"(?:^|(?<={BLANK})|(?<=\n))(?i:{one}){BLANK}+$")

    def end_score(self, word: str) -> int:
        """Letters of the longest known end of ``word``."""
        w = word.lower()
        return max((n for n in (3, 4, 5, 6) if w[-n:] in self.ends and len(w) > n), default=0)

    def is_particle(self, words: str) -> bool:
        """Whether ``words`` are a particle, in any case and with any blanks."""
        return " ".join(words.lower().split()) in self._particles

    def kind(self, word: str) -> str:
        """g given, s surname, b both, I initials, T title, U unknown."""
        kind = self._kinds.get(word)
        if kind is None:
            if len(self._kinds) > 100_000:
                self._kinds.clear()
            kind = self._kinds[word] = self._kind(word)
        return kind

    def _kind(self, word: str) -> str:
        if INITIALS.match(word):
            return "I"
        w = word.lower()
        pieces = [w, *w.split("-")] if "-" in w else [w]
        given = any(p in self.parts["given"] for p in pieces)
        surname = any(p in self.parts["surname"] for p in pieces)
        if given or surname:
            return "b" if given and surname else "g" if given else "s"
        return "T" if w.rstrip(".") in TITLES else "U"


Candidate = tuple[int, int, str, list[float]]


def _local_start(text: str, end: int) -> int:
    """Where the local part before ``end`` starts, or ``end`` if there is none; the window grows until the part ends inside it."""
    width = 90
    while True:
        back = text[max(0, end - width) : end][::-1]
        m = LOCAL.match(back)
        if not m:
            return end
        if width >= end or m.end() < len(back) - 12:
            return end - m.end()
        width *= 2


def email_candidates(text: str) -> Iterator[Candidate]:
    """Spans around each @ or its disguises, and their shorter forms."""
    for m in AT.finditer(text):
        first = _local_start(text, m.start())
        domain = DOMAIN.match(text, m.end())
        if not domain or first == m.start():
            continue
        local = text[first : m.start()]
        sign, dots = m.group(), len(re.findall(r"\.|dot|DOT", domain.group()))
        start = first
        while text[start] in "-_%":
            start += 1
        ends = {domain.end()}
        last = max(domain.group().rfind(x) for x in (".", "[", "(", " "))
        if dots > 1 and last > 0:
            ends.add(m.end() + last)
        starts = {start}
        if "." in local:
            starts.add(start + local[start - first :].rfind(".") + 1)
        for s in starts:
            for e in ends:
                if s < m.start() and e > m.end():
                    yield s, e, "email", [len(sign), sign == "@", sign.isalpha(), text[m.start() - 1].isspace(), dots, e == domain.end(), s == start, _side(text[s - 1 : s]), _side(text[e : e + 1]), text[s:m.start()].strip().isdigit(), m.start() - s, e - m.end()]


def _number(text: str, s: int, e: int, maximal: bool) -> list[float]:
    span = "".join(map(_blank, text[s:e]))
    before, after = text[max(0, s - 30) : s], text[e : e + 12]
    groups = GROUP.findall(span)
    hits = [bool(f.match(span)) for f in FORMATS]
    digits = sum(map(len, groups))
    joints = [x for x in re.split(r"\d+", span)[1:-1] if ")" not in x and "(" not in x]
    return [
        *hits,
        len(set(joints)),
        SEPARATORS.find(joints[0][-1:]) if joints else -1,
        SEPARATORS.find(joints[-1][-1:]) if joints else -1,
        max(map(len, joints), default=0),
        digits,
        sum(c.isalpha() for c in span),
        len(groups),
        span.count(" "),
        span.count("."),
        span.count("-"),
        span.count("/"),
        span.count("(") - span.count(")"),
        span[0] == "+",
        span[0] == "0",
        span[:2] == "00",
        span[0] in "12",
        len(groups[0]) if groups else 0,
        len(groups[-1]) if groups else 0,
        maximal,
        _side(before[-1:]),
        _side(after[:1]),
        before[-1:] in "+(" and before != "",
        bool(re.search(PHONE_WORDS, before)),
        bool(re.search(ID_WORDS, before)),
        bool(re.search(SHELF_WORDS, before[-14:])),
        bool(CAPTION.match(span)),
    ]


def _nested(found: list[Candidate]) -> Iterator[Candidate]:
    """``found`` with whether another of them, around it, has one of the formats of phone and identity numbers."""
    shaped = [(s, e) for s, e, _, features in found if any(features[:PERSONAL])]
    for s, e, kind, features in found:
        yield s, e, kind, [*features, any(a <= s and e <= b and b - a > e - s for a, b in shaped)]


def number_candidates(text: str) -> Iterator[Candidate]:
    """Series of digit groups, however many, with seven digits or more and no more than a number can have, and codes of capitals and digits."""
    for m in RUN.finditer(text):
        if m.end() - m.start() < 7:
            continue
        groups = [(g.start(), g.end()) for g in GROUP.finditer(text, m.start(), m.end())]
        sizes = [b - a for a, b in groups]
        if sum(sizes) < 7:
            continue
        found: list[Candidate] = []
        for i in range(len(groups)):
            digits = 0
            for j in range(i, len(groups)):
                digits += sizes[j]
                if digits > MOST_DIGITS:
                    break
                if digits < 7:
                    continue
                s, e = groups[i][0], groups[j][1]
                if text[s - 1 : s] == "+":
                    s -= 1
                elif text[s - 1 : s] == "(" and ")" in text[s:e]:
                    s -= 1
                    if text[s - 1 : s] == "+":
                        s -= 1
                found.append((s, e, "number", _number(text, s, e, (i == 0 or text[groups[i][0] - 2 : groups[i][0]] == " (") and (j == len(groups) - 1 or (text[e] == ")" and "(" not in text[s + 1 : e])))))
        yield from _nested(found)
    for m in CODE.finditer(text):
        found = []
        words = [(w.start(), w.end()) for w in CODE_WORD.finditer(text, m.start(), m.end())]
        for i in range(len(words)):
            size = 0
            for j in range(i, len(words)):
                size += words[j][1] - words[j][0]
                if size > MOST_CODE:
                    break
                s, e = words[i][0], words[j][1]
                if e - s >= 7 and text[s].isalpha() and sum(c.isdigit() for c in text[s:e]) >= 4:
                    found.append((s, e, "number", _number(text, s, e, i == 0 and j == len(words) - 1)))
        yield from _nested(found)


def _address(text: str, s: int, e: int, style: int, number: str, longest: bool, more: tuple) -> list[float]:
    span = text[s:e]
    return [style, len(number), 1500 <= int(number) <= 2100, e - s, span.count(" "), "," in span, "/" in span, "-" in span, span[0].isupper(), longest, _side(text[s - 1 : s]), _side(text[e : e + 1]), text[e : e + 1] == " " and text[e + 1 : e + 2].isupper(), *more]


def _before(text: str, s: int, blanks: int = 10) -> str:
    """What stands before ``s``, from the line's begin or far enough for the longest name of a street, however long its words are."""
    width = 96
    while True:
        before = text[max(0, s - width) : s]
        if width >= s or "\n" in before[:-1] or sum(map(str.isspace, before)) >= blanks:
            return before
        width *= 2


def address_candidates(text: str) -> Iterator[Candidate]:
    """Street words before or after a number of one to four digits, with and without its suffix."""
    for m in HOUSE.finditer(text):
        s, e, number = m.start(), m.end(), m.group()
        before = _before(text, s)
        start, style = -1, 0
        if before[-1:].isspace() or before[-1:] in ".°":
            if STREET_END.search(before) and (hit := SUFFIX_STREET.search(before)):
                at = hit.start()
                while at > 0 and (before[at - 1].isalnum() or before[at - 1] in "-'’"):
                    at -= 1
                if hit.end() - at > 4 and not before[at : hit.start()].isspace():
                    start, style = s - len(before) + at, 1
            if start < 0 and STREET_HEAD.search(before) and (hit := BEFORE_STREET.search(before)):
                start, style = s - len(before) + hit.start(), 2
        if start >= 0:
            full = AFTER_NUMBER.match(text, s).end()
            for end in {e, full}:
                suffix = text[e:end]
                yield start, end, "address", _address(text, start, end, style, number, end == full, (len(suffix), suffix[:1].isspace(), suffix[-1:].isupper(), suffix[-1:].islower(), len(text[start:s].split()), 0))
            continue
        after = text[e : e + 3]
        if after[:1].isspace() or after[:1] in "-,ABCDabcdefgh":
            if hit := ENGLISH_STREET.match(text, e):
                yield s, hit.end(), "address", _address(text, s, hit.end(), 3, number, True, (0, 0, 0, 0, len(hit.group().split()), text[s - 1 : s] == "-"))
            elif hit := FRENCH_STREET.match(text, e):
                full = hit.end()
                yield s, full, "address", _address(text, s, full, 4, number, True, (0, 0, 0, 0, len(hit.group().split()), 0))
                if "-" in (name := hit.group().rsplit(" ", 1)[-1]):
                    cut = full - len(name) + name.index("-")
                    yield s, cut, "address", _address(text, s, cut, 4, number, False, (0, 0, 0, 0, len(hit.group().split()), 0))


NAME = re.compile(r"[gbUI]+P?[sbU]\Z|P?[sbU],[gbUI]+P?\Z")
#: Chain tokens up to which all parts of a chain are proposed.
SHORT = 7


def _parts(kinds: str) -> Iterator[tuple[int, int]]:
    """First and last token of the parts of a chain: all short ones, and of any length those that start or end where a series of name words does."""
    n = len(kinds)
    for i in range(n):
        for j in range(i + 1, min(i + SHORT, n)):
            yield i, j
    if n <= SHORT:
        return
    edge = [True, *(k in "PT," for k in kinds), True]
    for i in range(n):
        if edge[i] or kinds[i] == "P":
            signs = 0
            for j in range(i, n):
                signs += kinds[j] in "P,"
                if kinds[j] == "T" or signs > 3:
                    break
                if j >= i + SHORT:
                    yield i, j
    for j in range(n):
        if edge[j + 2] or kinds[j] == "P":
            signs = 0
            for i in range(j, -1, -1):
                signs += kinds[i] in "P,"
                if kinds[i] == "T" or signs > 3:
                    break
                if i <= j - SHORT and not (edge[i] or kinds[i] == "P"):
                    yield i, j


def name_candidates(text: str, lexicon: Lexicon, taken: list[tuple[int, int]] = ()) -> Iterator[Candidate]:
    """Series of capitalised words, initials and particles around a known name part or initials, or after a title or a phrase of signing, outside ``taken`` spans."""
    tokens: list[tuple[int, int, str]] = []
    chains: list[list[tuple[int, int, str]]] = []
    at = -1
    for m in CAPITAL.finditer(text):
        s, e, word = m.start(), m.end(), m.group()
        if any(a < e and s < b for a, b in taken):
            continue
        kind = lexicon.kind(word)
        joint = text[at:s] if tokens else None
        links: list[tuple[int, int, str]] | None = None
        if joint is not None and len(joint) <= lexicon.reach:
            core = joint.strip()
            if "\n" in joint or "\r" in joint:
                links = None
            elif core == "" and joint:
                links = []
            elif core == "," and joint[0] == ",":
                links = [(at, at + 1, ",")]
            elif lexicon.is_particle(core):
                a = at + joint.index(core)
                links = [(a, a + len(core), "P")]
        if word.isupper() and lexicon.is_particle(word):
            kind = "P"
        if links is None:
            if len(tokens) > 1:
                chains.append(tokens)
            tokens = []
            if p := lexicon.particle_before.search(text, max(0, s - lexicon.reach), s):
                tokens.append((p.start(), p.start() + len(p.group().rstrip()), "P"))
        else:
            tokens.extend(links)
        if kind == "P" and tokens and tokens[-1][2] == "P":
            tokens[-1] = (tokens[-1][0], e, "P")
        else:
            tokens.append((s, e, kind))
        at = e
    if len(tokens) > 1:
        chains.append(tokens)
    for chain in chains:
        kinds = "".join(t[2] for t in chain)
        cued = [bool(CUE.search(text, max(0, t[0] - 48), t[0])) for t in chain]
        if not re.search("[gsbI]", kinds) and not any(cued):
            continue
        for i, j in _parts(kinds):
            shape = kinds[i : j + 1]
            if NAME.match(shape) and (cued[i] or re.search("[gsbI]", shape)):
                s, e = chain[i][0], chain[j][1]
                turned = "," in shape
                sur = shape.index(",") - 1 + i if turned else j
                surname = text[chain[sur][0] : chain[sur][1]]
                first = chain[sur + 2] if turned else chain[i]
                before = text[max(0, s - 14) : s]
                yield s, e, "name", [
                    turned,
                    shape.count("g") + shape.count("b"),
                    shape.count("I"),
                    shape.count("U"),
                    "P" in shape,
                    "sbU".index(kinds[sur]),
                    "gbUI".index(first[2]),
                    lexicon.end_score(surname),
                    lexicon.end_score(text[chain[sur - 1][0] : chain[sur - 1][1]]) if sur > i else 0,
                    len(surname),
                    len(shape),
                    text[s:e].isupper(),
                    surname.isupper(),
                    i > 0 and kinds[i - 1] == "T",
                    "TUgsbIP,".index(kinds[i - 1]) if i > 0 else -1,
                    "TUgsbIP,".index(kinds[j + 1]) if j + 1 < len(chain) else -1,
                    "TUgsbIP,".index(kinds[j + 2]) if j + 2 < len(chain) else -1,
                    _side(text[s - 1 : s]),
                    _side(text[e : e + 1]),
                    text[s:e].startswith("M."),
                    bool(AGENT.search(before)),
                    first[1] - first[0],
                    text[e : e + 2] in ("'s", "’s"),
                    cued[i],
                ]


class Finder:
    """The fitted model of each kind, and what it finds in a text."""

    def __init__(self, rows: list[tuple[str, str]], examples: list[tuple[str, set[tuple[int, int, str]]]], held: list[tuple[str, set[tuple[int, int, str]]]], known: list[tuple[str, str]] | None = None):
        seen = Lexicon(known if known is not None else rows)
        self.models: dict[str, BoostedTrees] = {}
        fit, test = self._table(examples, seen), self._table(held, seen)
        for kind in KINDS:
            self.models[kind] = BoostedTrees().fit(*fit[kind]).calibrate(*test[kind])
        self.lexicon = Lexicon(rows)

    @staticmethod
    def propose(text: str, lexicon: Lexicon) -> list[Candidate]:
        """All candidates of ``text``."""
        found = list(email_candidates(text))
        taken = [(s, e) for s, e, _, _ in found]
        found += [c for c in number_candidates(text) if not any(a < c[1] and c[0] < b for a, b in taken)]
        streets = [c for c in address_candidates(text) if not any(a < c[1] and c[0] < b for a, b in taken)]
        return found + streets + list(name_candidates(text, lexicon, taken))

    def _table(self, examples: list, lexicon: Lexicon) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        x: dict[str, list] = {k: [] for k in KINDS}
        y: dict[str, list] = {k: [] for k in KINDS}
        for text, spans in examples:
            for s, e, group, features in self.propose(text, lexicon):
                for kind in ("phone", "id_number") if group == "number" else (group,):
                    x[kind].append(features)
                    y[kind].append((s, e, kind) in spans)
        return {k: (np.array(x[k], np.float64), np.array(y[k], np.float64)) for k in KINDS}

    def find_all(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """The spans (start, end, kind) of each text, in order, none overlapping."""
        rows: dict[str, list] = {k: [] for k in KINDS}
        spans: dict[str, list] = {k: [] for k in KINDS}
        for i, text in enumerate(texts):
            if text:
                for s, e, group, features in self.propose(text, self.lexicon):
                    for kind in ("phone", "id_number") if group == "number" else (group,):
                        rows[kind].append(features)
                        spans[kind].append((i, s, e))
        chosen: dict[int, list] = {}
        for kind in KINDS:
            if rows[kind]:
                p = self.models[kind].probability(np.array(rows[kind], np.float64))
                for k in np.flatnonzero(p >= self.models[kind].threshold):
                    i, s, e = spans[kind][k]
                    chosen.setdefault(i, []).append((float(p[k]), e - s, s, e, kind))
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        for i, found in chosen.items():
            kept: list[tuple[int, int, str]] = []
            for _, _, s, e, kind in sorted(found, key=lambda c: (-round(c[0], 3), -c[1], c[2], c[4])):
                if all(e <= a or b <= s for a, b, _ in kept):
                    kept.append((s, e, kind))
            out[i] = sorted(kept)
        return out


@lru_cache(4)
def finder(rows: tuple[tuple[str, str, str], ...], size: int, seed: int = 17) -> Finder:
    """The finder for a lexicon's rows (name_part, kind, lang), fitted on ``size`` made-up texts; once per process."""
    from spanloom.llm.pii_examples import examples

    made, known = examples(rows, size + size // 4, seed)
    return Finder([r[:2] for r in rows], made[:size], made[size:], known)


#: Made-up texts that the trees are fitted on; a quarter as many more calibrate the thresholds.
EXAMPLES = 4000


def _finder(name_lexicon: DataFrame, size: int) -> Finder:
    rows = lookup_rows(name_lexicon.select("name_part", "kind", "lang").where("name_part is not null and kind is not null").distinct().orderBy("name_part", "kind", "lang"))
    return finder(tuple((r.name_part, r.kind, r.lang or "") for r in rows), size)


def find_personal(documents: DataFrame, name_lexicon: DataFrame, key: str = "doc_id", text: str = "text", size: int = EXAMPLES) -> DataFrame:
    """(key, start, kind, found): each piece of personal information, by its offset in code points.

    Null and empty texts have none; repeated rows give theirs again; other columns are not carried over. The lexicon is a fixed table of
    name parts. One pass, no shuffle.
    """
    model = documents.sparkSession.sparkContext.broadcast(_finder(name_lexicon, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [(i, s, kind, texts[i][s:e]) for i, spans in enumerate(model.value.find_all(texts)) for s, e, kind in spans]
            i, start, kind, piece = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i, pa.int64())), pa.array(start, pa.int32()), pa.array(kind, pa.string()), pa.array(piece, pa.string())], names=["__key", "start", "kind", "found"])

    type_ = documents.schema[key].dataType.simpleString()
    return spread(documents.select(F.col(key), F.col(text))).mapInArrow(run, f"__key {type_}, start int, kind string, found string").withColumnRenamed("__key", key)


def redact(documents: DataFrame, name_lexicon: DataFrame, key: str = "doc_id", text: str = "text", size: int = EXAMPLES) -> DataFrame:
    """(key, text, replaced): each text with its personal information replaced by the placeholder of its kind, and how many were; null stays null."""
    model = documents.sparkSession.sparkContext.broadcast(_finder(name_lexicon, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out, n = [], []
            for t, spans in zip(texts, model.value.find_all(texts)):
                at, pieces = 0, []
                for s, e, kind in spans:
                    pieces += [t[at:s], PLACEHOLDERS[kind]]
                    at = e
                out.append(t if t is None else "".join([*pieces, t[at:]]))
                n.append(len(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(n, pa.int32())], names=["__key", "text", "replaced"])

    type_ = documents.schema[key].dataType.simpleString()
    return spread(documents.select(F.col(key), F.col(text))).mapInArrow(run, f"__key {type_}, text string, replaced int").withColumnRenamed("__key", key)
