"""Personal data: detection on the text as it is, and on an offset-preserving deobfuscated view.

Base spans come from the plain patterns. Then transducers rewrite disguises and keep, for every
character that they emit, the piece of source that it stands for:

1. characters: homoglyphs, full-width and other compatibility forms become ASCII, foreign decimal
   digits become 0-9, invisible characters go; entities and percent codes of @ and . become those;
2. letters for digits (O, o, l, I) within numbers that are mostly digits become 0 and 1;
3. spelled digits (English, French, German, Spanish; in English also oh, double, triple and numbers up to 99),
   three or more in a row or between numerals, become digits; at an end of numerals they do where the run is
   as long as a card and has no plus before it; four spelled or written numbers with spelled dots become an address;
4. at and dot disguises - bracketed, spelled, joined or spaced out - become `@` and `.`; a plain ` at ` before a
   dotted domain only where the name or the domain is disguised as well; a name in single letters before an @
   is drawn together.

The same detectors run on the rewritten text; a span that holds a rewritten character and isn't within
a base span of its kind is mapped back to the source and added, so one whose end only is disguised is
found whole, besides the piece of it that is a base span. Base spans always stay. A text in which no
transducer applies is rewritten to itself, so it is not scanned again.

Defined results: null and empty texts have no spans. Offsets are code points, the end exclusive.
Repeated rows each get a row. Kinds are searched independently, so spans of two kinds may overlap. Texts of
any length are searched whole, in time linear in their length. An empty table gives no rows; columns that aren't
named are left alone, whatever they are named.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assurelake.llm.common import batches, small_batches, table

#: Texts searched together up to about this many bytes.
TOGETHER = 4_000_000
KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# from the first digit of a run: a later start in it would fail alike
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Letters of other scripts that look like ASCII letters, and marks that stand for . - @
HOMOGLYPHS = dict(
    zip(
        "АВЕКМНОРСТХУЅІЈаеорсухіѕјһԁԛԝқΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυκτҮүɡıⅼӏᴏ․。｡‐‑‒–—−",
        "ABEKMHOPCTXYSIJaeopcyxisjhdqwkABEZHIKMNOPTYXaivopuktYygillo...------",
        strict=True,
    )
)
# Characters that are not seen
INVISIBLE = "­​‌‍⁠﻿"
# The words for the digits 0 to 9
DIGIT_WORDS = {
    "en": "zero one two three four five six seven eight nine",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
DIGIT_OF = {w: str(n) for words in DIGIT_WORDS.values() for n, w in enumerate(words.split())}
# Words that stand for @ and .
AT_WORDS, DOT_WORDS = ("at", "arroba", "arobase", "klammeraffe"), ("dot", "punto", "point", "punkt")

# Further English words of numbers, and how often the digit after a word is read
NUMBERS = "ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
TENS = "twenty thirty forty fifty sixty seventy eighty ninety"
REPEATS = {"double": 2, "triple": 3}
# Entities and percent codes
CODES = {"&#64;": "@", "&#x40;": "@", "&commat;": "@", "%40": "@", "&#46;": ".", "&#x2e;": ".", "&period;": ".", "%2e": "."}
LETTER_DIGITS = {"O": "0", "o": "0", "l": "1", "I": "1"}

DIGIT_OF |= {"oh": "0"} | {w: str(n) for n, w in enumerate(NUMBERS.split(), 10)}
DIGIT_OF |= {w: str(10 * n) for n, w in enumerate(TENS.split(), 2)}
DIGIT_OF |= {f"{t}-{u}": str(10 * n + k) for n, t in enumerate(TENS.split(), 2) for k, u in enumerate(DIGIT_WORDS["en"].split()) if k}
DIGIT_OF |= {f"{r} {w}": d * n for r, n in REPEATS.items() for w, d in [*zip(DIGIT_WORDS["en"].split(), "0123456789", strict=True), ("oh", "0")]}

_WORD = re.compile(r"[^\W\d_]+")
#: words that tell that there may be numbers in words
_NUMBER_WORDS = frozenset(w for key in DIGIT_OF for w in re.split("[ -]", key)) - REPEATS.keys()
_ONE = "|".join(re.escape(w).replace("\\ ", r"\s").replace("\\-", r"[\s-]") for w in sorted(DIGIT_OF, key=len, reverse=True))


def _searched(pattern: str):
    """Matches of a pattern of lower-case words in a text, whatever the case there."""
    plain, any_case = re.compile(pattern), re.compile(pattern, re.IGNORECASE)

    def run(text: str) -> Iterator[re.Match]:
        low = text.lower()  # much faster, but some letters get longer
        return plain.finditer(low) if len(low) == len(text) else any_case.finditer(text)

    return run


_SPELLED = _searched(rf"(?<!\w)(?:(?:{_ONE})(?!\w)[\s,.;-]{{1,3}}){{2,}}(?:{_ONE})(?!\w)")
_SPELLED_PART = re.compile(rf"({_ONE})|([\s,.;-]+)", re.IGNORECASE)
#: numerals and digit words in a row
_MEMBER = rf"(?:[0-9]++|(?:{_ONE})(?![^\W\d_]))"
_MIXED = _searched(rf"(?<![^\W_]){_MEMBER}(?:[\s,.;()-]{{0,3}}+{_MEMBER})+")
_MIXED_PART = re.compile(rf"([0-9]+)|({_ONE})|([\s,.;()-]+)", re.IGNORECASE)
_DOTS = frozenset(DOT_WORDS)
_AT, _DOT = "|".join(AT_WORDS), "|".join(DOT_WORDS)
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_BRACKETED = re.compile(rf"(?<!\s)\s*+{_OPEN}\s*(?:(@|(?:{_AT})(?!\w))|(\.|(?:{_DOT})(?!\w)))\s*{_CLOSE}\s*", re.IGNORECASE)
_SPACED_DOT = rf"(?:\s+(?:{_DOT}|\.)\s+|[_-](?:{_DOT})[_-]|\.)"
_NAME = r"[A-Za-z0-9_%+-]"
# a chain of names and dots is read from its first name only: what fails there fails from any later name
_CHAINED = "".join(rf"(?<!{_NAME}\s{{{a}}}dot\s{{{b}}})" for a in (1, 2, 3) for b in (1, 2, 3))
_LOCAL_PART = rf"(?<![A-Za-z0-9._%+-]){_CHAINED}(?P<local>(?:{_NAME}++(?:\s{{1,3}}+dot\s{{1,3}}+|[_-]dot[_-]))*+[A-Za-z0-9._%+-]++(?<={_NAME}))"
_LAST = r"[A-Za-z]{2,}+(?![\w-])"
#: name at host dot name: a spelled at counts only with a spelled dot of its own language after it
_SPELLED_MAIL = re.compile(
    rf"{_LOCAL_PART}(?P<at>\s++at\s++)[A-Za-z0-9-]+(?P<rest>(?:(?:\s++dot\s++|\.)[A-Za-z0-9-]+)*(?:\s++dot\s++){_LAST})", re.IGNORECASE
)
#: name at host.name: counts only where a part is disguised
_PLAIN_MAIL = re.compile(rf"{_LOCAL_PART}(?P<at>\s++at\s++)(?P<rest>[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.{_LAST})", re.IGNORECASE)
_JOINED_MAIL = re.compile(r"(?<![A-Za-z0-9_-])(?P<local>[A-Za-z0-9]++)(?P<at>[_-](?:AT)[_-])[A-Za-z0-9]++(?P<rest>(?:[_-](?:DOT)[_-][A-Za-z0-9]++(?=[_-]))*[_-](?:DOT)[_-][A-Za-z]{2,})(?![A-Za-z0-9_-])".replace("AT", _AT).replace("DOT", _DOT), re.IGNORECASE)
_SPACED_MAIL = re.compile(
    rf"{_LOCAL_PART}(?P<at>\s++(?:{'|'.join(AT_WORDS[1:])})\s++|\s++@\s*+|@\s++)[A-Za-z0-9-]+(?P<rest>(?:{_SPACED_DOT}[A-Za-z0-9-]+)*{_SPACED_DOT}{_LAST})", re.IGNORECASE
)
_LOOSE_AT = re.compile(r"\s@|@\s")
_SPACED_DOTS = re.compile(rf"\s+(?:{_DOT}|\.)\s+|[_-](?:{_DOT})[_-]", re.IGNORECASE)
_MAIL_DOTS = re.compile(rf"(?<=[A-Za-z0-9])(?:\s+(?:{_DOT})\s+|[_-](?:{_DOT})[_-]|\s+\.\s+)(?=[A-Za-z0-9])", re.IGNORECASE)
_IP_DOTS = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:\s+(?:{_DOT})\s+|\s+\.\s+|\.)[0-9]{{1,3}}){{3}}(?![0-9])", re.IGNORECASE)
_CODE = re.compile("|".join(map(re.escape, CODES)), re.IGNORECASE)
# numbers with letters in them: in groups, or four with dots
_LETTERED = re.compile(r"(?<![A-Za-z0-9])[0-9](?:[ -]?[0-9OolI]){8,}(?![A-Za-z0-9])")
_LETTERED_IP = re.compile(r"(?<![A-Za-z0-9.])[0-9OolI]{1,3}(?:\.[0-9OolI]{1,3}){3}(?![A-Za-z0-9])")
_LETTER_DIGIT = re.compile("[OolI]")
_GROUP = rf"(?:[0-9]{{1,3}}|(?:{_ONE})(?!\w)(?:[\s-]{{1,2}}(?:{_ONE})(?!\w)){{0,2}})"
_SPELLED_IP = _searched(rf"(?<!\w){_GROUP}(?:(?:\s{{1,3}}(?:{_DOT})\s{{1,3}}|\.){_GROUP}){{3}}(?!\w)")
_SPELLED_IP_PART = re.compile(rf"(\s+(?:{_DOT})\s+|\.)|({_ONE})(?!\w)|[0-9]+|([\s-]+)", re.IGNORECASE)
_PLUS = re.compile(r"(?<!\w)plus\s+(?=[0-9])", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping addresses; each holds one @, so they are found from those."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def detect(text: str) -> dict[str, list[Span]]:
    """Spans of every kind by the plain patterns."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = emails(text)
    if not _DIGIT.search(text):
        return found
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found["phone"].append(m.span())
    return found


class View:
    """A text with, for each of its characters, the source span it stands for and whether it was rewritten."""

    def __init__(self, text: str):
        self.text = text
        self.start = list(range(len(text)))
        self.end = list(range(1, len(text) + 1))
        self.new = bytearray(len(text))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace [a, b) by a string, for ascending, disjoint edits."""
        if not edits:
            return
        text, start, end, new, at = [], [], [], bytearray(), 0
        for a, b, s in [*edits, (len(self.text), len(self.text), "")]:
            text += [self.text[at:a], s]
            start += self.start[at:a] + [self.start[a]] * len(s) if s else self.start[at:a]
            end += self.end[at:a] + [self.end[b - 1]] * len(s) if s else self.end[at:a]
            new += self.new[at:a] + b"\1" * len(s)
            at = b
        self.text, self.start, self.end, self.new = "".join(text), start, end, new

    def source(self, span: Span) -> Span:
        return self.start[span[0]], self.end[span[1] - 1]


_plain: dict[str, str | None] = {}


def plain_character(c: str) -> str | None:
    """What a non-ASCII character stands for: an ASCII string, nothing, or None for itself."""
    if c not in _plain:
        if c in INVISIBLE:
            s = ""
        elif c in HOMOGLYPHS:
            s = HOMOGLYPHS[c]
        elif (n := unicodedata.decimal(c, None)) is not None:
            s = str(n)
        else:
            s = unicodedata.normalize("NFKC", c)
            s = s if len(s) == 1 and s.isascii() else None
        _plain[c] = s
    return _plain[c]


def _characters(text: str) -> list[tuple[int, int, str]]:
    odd = {c for c in set(text) if not c.isascii() and plain_character(c) is not None}
    if not odd:
        return []
    return [(m.start(), m.end(), plain_character(m[0])) for m in re.finditer("[" + re.escape("".join(sorted(odd))) + "]", text)]


def _spelled(text: str, words: list[str]) -> list[tuple[int, int, str]]:
    number = [w in _NUMBER_WORDS or w in REPEATS for w in words]
    if not any(a and b and c for a, b, c in zip(number, number[1:], number[2:], strict=False)):
        return []
    out = []
    for run in _SPELLED(text):
        for m in _SPELLED_PART.finditer(text, run.start(), run.end()):
            if m[1]:
                out.append((*m.span(), _digit(m[1])))
            else:
                mark = m[2].strip()
                out.append((*m.span(), mark[0] if mark in ("-", ".") else ""))
    return out


def _coded(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), CODES[m[0].lower()]) for m in _CODE.finditer(text)]


def _lettered(text: str) -> list[tuple[int, int, str]]:
    """Letters that stand for digits, in numbers that have twice as many digits (as many in an address)."""
    out = {}
    for pattern, least in ((_LETTERED, 2), (_LETTERED_IP, 1)):
        for run in pattern.finditer(text):
            letters = list(_LETTER_DIGIT.finditer(text, *run.span()))
            if letters and sum(map(str.isdigit, run[0])) >= least * len(letters):
                out.update((m.span(), LETTER_DIGITS[m[0]]) for m in letters)
    return [(*span, s) for span, s in sorted(out.items())]


def _spelled_ips(text: str) -> list[tuple[int, int, str]]:
    out = []
    for run in _SPELLED_IP(text):
        for m in _SPELLED_IP_PART.finditer(text, *run.span()):
            if m[1] and m[1] != ".":
                out.append((*m.span(), "."))
            elif m[2]:
                out.append((*m.span(), _digit(m[2])))
            elif m[3]:
                out.append((*m.span(), ""))
    return out


def _drawn_together(text: str) -> list[tuple[int, int, str]]:
    """The blanks of a name in single letters before each @, three letters at least."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        i = at - 1
        while i >= done and text[i] == " ":
            i -= 1
        blanks = []
        while i - 1 > done and text[i] in _LOCAL and text[i - 1] == " " and text[i - 2] in _LOCAL and (i - 3 < 0 or text[i - 3] not in _LOCAL):
            blanks.append(i - 1)
            i -= 2
        if len(blanks) >= 2:
            out += [(b, b + 1, "") for b in reversed(blanks)]
        done = at + 1
        at = text.find("@", done)
    return out


def _digit(word: str) -> str:
    """The digit of a word that a pattern found: i with a dot above counts as i there."""
    word = word.lower().replace("\u0307", "")
    if word not in DIGIT_OF:
        first, rest = re.split(r"[\s-]", word)
        word = f"{first} {rest}" if first in REPEATS else f"{first}-{rest}"
    return DIGIT_OF[word]


def _mixed(text: str) -> list[tuple[int, int, str]]:
    """Digit words among numerals. What parts them from those is kept if it can be in a number."""
    if not _DIGIT.search(text):
        return []
    out = []
    for run in _MIXED(text):
        parts = list(_MIXED_PART.finditer(text, run.start(), run.end()))
        numerals = [i for i, m in enumerate(parts) if m[1]]
        if not numerals or len(numerals) == len(parts):
            continue
        size = sum(len(m[1] or (_digit(m[2]) if m[2] else "")) for m in parts)
        first, last = numerals[0], numerals[-1]
        if 12 <= size <= 19 and text[run.start() - 1 : run.start()] != "+":
            first, last = 0, len(parts) - 1
        words = {i for i, m in enumerate(parts) if m[2] and first <= i <= last}
        for i, m in enumerate(parts):
            if i in words:
                out.append((*m.span(), _digit(m[2])))
            elif m[3] and (i - 1 in words or i + 1 in words) and first < i < last and m[3] not in (" ", "-", "."):
                mark = m[3].strip()
                if not mark.strip(",;-."):
                    out.append((*m.span(), mark if mark in ("-", ".") else " "))
    return out


def _bracketed(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), "@" if m[1] else ".") for m in _BRACKETED.finditer(text)]


def _spaced(text: str, low: str, new: bytes) -> list[tuple[int, int, str]]:
    """new: for each character whether it was rewritten before, or nothing."""
    edits = {}
    patterns = [_SPELLED_MAIL] if "dot" in low else []
    if any(w in low for w in DOT_WORDS):
        patterns.append(_JOINED_MAIL)
    if _LOOSE_AT.search(text) or any(w in low for w in AT_WORDS[1:]):
        patterns.append(_SPACED_MAIL)
    plain = []
    if "at" in low and ("dot" in low or 1 in new):
        plain = [m for m in _PLAIN_MAIL.finditer(text) if _MAIL_DOTS.search(text, *m.span("local")) or any(new[i] and (text[i].isalnum() or text[i] == ".") for i in range(*m.span()) if new)]
    for m in (*(m for p in patterns for m in p.finditer(text)), *plain):
        edits[m.span("at")] = "@"
        edits.update((d.span(), ".") for d in _SPACED_DOTS.finditer(text, *m.span("rest")))
        edits.update((d.span(), ".") for d in _MAIL_DOTS.finditer(text, *m.span("local")))
    for m in _IP_DOTS.finditer(text):
        edits.update((d.span(), ".") for d in _SPACED_DOTS.finditer(text, *m.span()))
    for m in _PLUS.finditer(text):
        edits[m.span()] = "+"
    out, at = [], 0
    for (a, b), s in sorted(edits.items()):
        if a >= at:
            out.append((a, b, s))
            at = b
    return out


def deobfuscate(text: str) -> View | None:
    """The rewritten view; None if no transducer applies."""
    view = None

    def apply(edits: list[tuple[int, int, str]]) -> None:
        nonlocal view, text
        if edits:
            view = view or View(text)
            view.rewrite(edits)
            text = view.text

    if not text.isascii():
        apply(_characters(text))
    low = text.lower().replace("\u0307", "")  # of an I with a dot above
    words = _WORD.findall(low)
    if "&" in text or "%" in text:
        apply(_coded(text))
    if sum(map(text.count, "0123456789")) >= 3:
        apply(_lettered(text))
    if not _NUMBER_WORDS.isdisjoint(words):
        if any((a in _DOTS and b in _NUMBER_WORDS) or (b in _DOTS and a in _NUMBER_WORDS) for a, b in zip(words, words[1:], strict=False)):
            apply(_spelled_ips(text))
        apply(_spelled(text, words))
        apply(_mixed(text))
    if "[" in text or "(" in text or "{" in text or "<" in text:
        apply(_bracketed(text))
    if " @" in text or "@" in text and view:
        apply(_drawn_together(text))
    if "@" in text or any(w in low for w in DOT_WORDS) or " . " in text or "plus" in low or (view and "at" in low):
        apply(_spaced(text, text.lower(), view.new if view else b""))
    return view


def find(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(base spans, added spans) by kind."""
    base = detect(text) if text else {k: [] for k in KINDS}
    added: dict[str, list[Span]] = {k: [] for k in KINDS}
    view = deobfuscate(text) if text else None
    if view is None:
        return base, added
    for kind, spans in detect(view.text).items():
        starts = [x for x, _ in base[kind]]
        for span in spans:
            a, b = view.source(span)
            rewritten = 1 in view.new[span[0] : span[1]] or b - a != span[1] - span[0]
            # base spans of a kind are disjoint and ascending: only the last that starts in time can hold it
            at = bisect_right(starts, a)
            if rewritten and not (at and b <= base[kind][at - 1][1]):
                added[kind].append((a, b))
    return base, added


def listed(found: dict[str, list[Span]]) -> str:
    """kind:start:end of all spans, by start and then kind as listed."""
    rows = sorted((a, n, b) for n, k in enumerate(KINDS) for a, b in found[k])
    return ",".join(f"{KINDS[n]}:{a}:{b}" for a, n, b in rows)


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    if not text:
        return text
    base, added = find(text)
    spans = sorted((a, -b, n) for n, k in enumerate(KINDS) for a, b in base[k] + added[k])
    out, at, done = [], 0, 0
    for a, b, n in spans:
        if a >= done:
            out += [text[at:a], f"[{KINDS[n].upper()}]"]
        done = at = max(done, -b)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", redacted: bool = False) -> DataFrame:
    """Per row: the key, counts of base spans by kind, n_added, the digest of the base spans, and all
    spans; with `redacted` the redacted text as well."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key_col), F.col(text_col).alias("_text"))
    key = rows.schema[0]
    names = [key.name, *(f"n_{k}" for k in KINDS), "n_added", "base_sha256", "spans"] + ["redacted"] * redacted
    schema = f"`{key.name}` {key.dataType.simpleString()}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", n_added long, base_sha256 string, spans string" + ", redacted string" * redacted

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for part in batches(frame, TOGETHER):
                rows = []
                for text in part.column(1).to_pylist():
                    base, added = find(text)
                    row = [*(len(base[k]) for k in KINDS), sum(map(len, added.values())), hashlib.sha256(listed(base).encode()).hexdigest(), listed({k: base[k] + added[k] for k in KINDS})]
                    rows.append(row + [redact(text)] * redacted)
                types = [pa.int64()] * 5 + [pa.string()] * (2 + redacted)
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=names)

    return rows.mapInArrow(run, schema)


def redact_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the texts redacted; every other column as it is."""
    small_batches(docs.sparkSession)
    at, schema = docs.columns.index(text_col), docs.schema

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for part in batches(frame, TOGETHER, at):
                texts = pa.array([redact(t.as_py()) for t in part.column(at)], pa.string())
                yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(part.columns)], names=schema.names)

    return docs.mapInArrow(run, schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return find_pii(table(spark, sf_dir, "documents"))
