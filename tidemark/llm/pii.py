"""Personal data with offsets, also where it is disguised.

Plain identifiers are found in the text as it stands.  Two transducers then rewrite disguises while
they keep track of where every character came from: a character map (homoglyphs, full-width forms,
digits of other scripts; one for one, so offsets stay) and a token transducer (zero-width characters,
bracketed or spelled ``at``/``dot``, runs of spelled digits).  Identifiers found in the rewritten text are
mapped back to the source characters they cover.  A span is added only if it holds a rewritten
character and is not part of a plain one of its kind.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

from pyspark.sql import DataFrame

from . import common

KINDS = ("email", "ip", "card", "phone")

# The plain identifiers.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never ends inside a run of digits, so no start inside one can match where its first digit can't.
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Words for digits in the languages of the corpus, for signs, and signs that look alike.
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "oh": "0",
}
AT_WORDS = ("at", "arroba", "arobase", "klammeraffe")
DOT_WORDS = ("dot", "period", "punkt", "punto", "point")
DASH_WORDS = ("dash", "hyphen", "minus")
LOOK_ALIKE = {
    "a": "аɑα", "b": "Ь", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іıι", "j": "ј", "k": "κ", "l": "ӏ", "n": "ո", "o": "оοօ", "p": "рρ",
    "q": "ԛ", "s": "ѕ", "u": "υս", "v": "ѵν", "w": "ԝ", "x": "хχ", "y": "уү", "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ",
    "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "УΥ", "Z": "Ζ",
    ".": "․。｡·‧∙", "-": "‐‑‒–—−", "@": "﹫", "+": "﹢", " ": "      　",
}
HIDDEN = "­​‌‍‎‏⁠﻿"


@lru_cache(maxsize=1)
def look_alikes() -> dict[int, str]:
    """The character map: listed look-alikes, and single characters whose compatibility form is one ASCII character."""
    table = {ord(c): k for k, cs in LOOK_ALIKE.items() for c in cs}
    ranges = ((0x660, 0x66A), (0x6F0, 0x6FA), (0x966, 0x970), (0x2070, 0x209D), (0x2460, 0x24EA), (0xFE52, 0xFE6C), (0xFF01, 0xFF5F), (0x1D400, 0x1D800))
    for lo, hi in ranges:
        for k in range(lo, hi):
            flat = unicodedata.normalize("NFKC", chr(k))
            digit = unicodedata.digit(chr(k), None)
            if digit is not None:
                table[k] = str(digit)
            elif len(flat) == 1 and " " < flat < "\x7f":
                table[k] = flat
    return table


_words = lambda ws: "|".join(sorted(ws, key=len, reverse=True))
_DIGIT = rf"(?:{_words(DIGIT_WORDS)})"
_SIGN = {w: "@" for w in AT_WORDS} | {w: "." for w in DOT_WORDS} | {w: "-" for w in DASH_WORDS} | {"@": "@", ".": ".", "-": "-", "underscore": "_"}
#: The inputs of the token transducer, strongest first.
BRACKETED = re.compile(rf"\s{{0,3}}[\[({{<]\s{{0,3}}(at|@|dot|\.|-|arroba|arobase|punkt|punto|point|dash|hyphen|underscore)\s{{0,3}}[\])}}>]\s{{0,3}}", re.I)
SPELLED = re.compile(rf"(?<!\w)(?:(?:double|triple)[ ]+)?{_DIGIT}(?:[ ,-]{{1,2}}(?:(?:double|triple)[ ]+)?{_DIGIT})*(?!\w)", re.I)
SPELLED_PART = re.compile(rf"(?:(double|triple)[ ]+)?({_DIGIT})(?!\w)", re.I)
SIGN_WORD = re.compile(rf"(?<=[\w)]) +({_words([*AT_WORDS, *DOT_WORDS, *DASH_WORDS, 'underscore'])}) +(?=[\w(])", re.I)
BEFORE_LONE = re.compile(rf"(?:[0-9]|(?<!\w){_DIGIT}) *(?:[\[({{<] ?)?(?:\.|{_words(DOT_WORDS)})(?: ?[\])}}>])? *$", re.I)
AFTER_LONE = re.compile(rf" *(?:[\[({{<] ?)?(?:\.|{_words(DOT_WORDS)})(?: ?[\])}}>])? *(?:[0-9]|{_DIGIT}(?!\w))", re.I)
PLUS = re.compile(r"(?<!\w)plus +(?=[0-9(])", re.I)
HIDDEN_RUN = re.compile(f"[{HIDDEN}]+")
SPLIT_DIGITS = re.compile(r"(?<=[0-9]) (?=[0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """Plain identifiers: leftmost, non-overlapping for each kind, as code-point spans."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            done = m.end()
            found["email"].append((start, done))
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p := g.lstrip("0")) < 4 and int(p or 0) <= 255 for g in m.groups()):
            found["ip"].append(m.span())
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                found["phone"].append(m.span())
    return found


class Rewritten:
    """A text that grew from another by edits, with the way back.  ``edits``: (start, end, new text), in order."""

    def __init__(self, source: str, edits: list[tuple[int, int, list[tuple[str, int, int]]]]) -> None:
        out, at = [], 0
        self.new_at: list[int] = []  # where a run begins in the new text
        self.old_at: list[tuple[int, int, bool]] = []  # start and end in the source; whether its characters stand as they stood
        size = 0

        def add(s: str, a: int, b: int, same: bool) -> None:
            nonlocal size
            if s:
                self.new_at.append(size)
                self.old_at.append((a, b, same))
                out.append(s)
                size += len(s)

        for start, end, parts in edits:
            if start < at:
                continue
            add(source[at:start], at, start, True)
            for s, a, b in parts:
                add(s, a, b, False)
            at = end
        add(source[at:], at, len(source), True)
        self.text = "".join(out)

    def back(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.new_at, start) - 1, bisect_right(self.new_at, end - 1) - 1
        a, _, same = self.old_at[i]
        lo = a + (start - self.new_at[i]) if same else a
        a, b, same = self.old_at[j]
        return lo, a + (end - self.new_at[j]) if same else b

    def touched(self, start: int, end: int) -> bool:
        """Whether a rewritten or dropped run lies in the span."""
        lo, hi = self.back(start, end)
        i, j = bisect_right(self.new_at, start) - 1, bisect_right(self.new_at, end - 1) - 1
        return hi - lo != end - start or any(not self.old_at[k][2] for k in range(i, j + 1))


def _spelled(m: re.Match) -> list[tuple[str, int, int]]:
    parts = []
    for p in SPELLED_PART.finditer(m.string, m.start(), m.end()):
        times = {"double": 2, "triple": 3}.get((p.group(1) or "").lower(), 1)
        parts.append((DIGIT_WORDS[p.group(2).lower()] * times, p.start(), p.end()))
    return parts


def rewrite(flat: str) -> Rewritten | None:
    """The token transducer over a text of mapped characters; None if nothing in it is disguised."""
    edits: dict[int, tuple[int, int, list[tuple[str, int, int]]]] = {}

    def edit(start: int, end: int, parts: list[tuple[str, int, int]]) -> None:
        edits.setdefault(start, (start, end, parts))

    for m in BRACKETED.finditer(flat):
        edit(m.start(), m.end(), [(_SIGN[m.group(1).lower()], m.start(), m.end())])
    for m in SPELLED.finditer(flat):
        # A lone "un" or "oh" is a word; in a disguise digits come in runs or next to a spelled dot.
        if len(_spelled(m)) > 1 or BEFORE_LONE.search(flat, max(0, m.start() - 12), m.start()) or AFTER_LONE.match(flat, m.end()):
            edit(m.start(), m.end(), _spelled(m))
    if not flat.isascii():
        for m in HIDDEN_RUN.finditer(flat):
            edit(m.start(), m.end(), [])
    if not edits and not SIGN_WORD.search(flat) and not PLUS.search(flat):
        return None
    for m in SIGN_WORD.finditer(flat):
        edit(m.start(), m.end(), [(_SIGN[m.group(1).lower()], m.start(), m.end())])
    for m in re.finditer(rf"(?<!\w)plus +(?=[0-9(]|{_DIGIT})", flat, re.I):
        edit(m.start(), m.end(), [("+", m.start(), m.end())])
    return Rewritten(flat, [edits[k] for k in sorted(edits)])


def _credible(kind: str, source: str, new: str) -> bool:
    """Whether a rewritten match is a disguise rather than words that happen to stand like one."""
    if kind == "email":
        bare = re.search(rf" (?:{_words(AT_WORDS)}) ", source, re.I)
        local, domain = new.split("@", 1)
        if not domain.rsplit(".", 1)[1].isalpha() or len(domain.rsplit(".", 1)[1]) < 2:
            return False
        spelled_dot = re.search(rf"[\[({{<]|(?<=[\w)]) +(?:{_words(DOT_WORDS)}) ", source, re.I)
        return not bare or bool(spelled_dot) or any(c in "0123456789._%+-" for c in local)
    return True


def disguised(text: str, plain: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    """Spans that only the transducers bring to light."""
    flat = text if text.isascii() else text.translate(look_alikes())
    new = rewrite(flat)
    added: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if new is None and flat == text:
        return added
    new = new or Rewritten(flat, [])
    for kind, spans in find(new.text).items():
        for a, b in spans:
            lo, hi = new.back(a, b)
            if not new.touched(a, b) and flat[lo:hi] == text[lo:hi]:
                continue
            if any(x <= lo and hi <= y for x, y in plain[kind]) or not _credible(kind, flat[lo:hi], new.text[a:b]):
                continue
            added[kind].append((lo, hi))
    return added


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(set(spans[k])))


def scan_text(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Plain spans, and all spans."""
    plain = find(text)
    more = disguised(text, plain)
    return plain, {k: sorted({*plain[k], *more[k]}) for k in KINDS}


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of every whole text: ``n_<kind>`` (all spans), ``base_sha256`` and ``spans``.

    Null texts count as empty and have no spans.  Repeated rows give repeated results; an empty table
    gives an empty result; other columns are not read.  Offsets are code points, ends exclusive.
    """

    def fn(cols: list[list]) -> dict:
        out: dict = {id_col: cols[0], **{f"n_{k}": [] for k in KINDS}, "base_sha256": [], "spans": []}
        for text in cols[1]:
            plain, spans = scan_text(text or "")
            for k in KINDS:
                out[f"n_{k}"].append(len(spans[k]))
            out["base_sha256"].append(hashlib.sha256(joined(plain).encode()).hexdigest())
            out["spans"].append(joined(spans))
        return out

    kind = df.schema[id_col].dataType.simpleString()
    return common.map_rows(df, [id_col, text_col], fn, f"{id_col} {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")
