"""Text segmentation by the Unicode annexes 29 (words, sentences) and 14 (line breaks), on Python strings.

Properties come from the ``regex`` module, so its Unicode version counts. Every function returns parts that tile the text.
"""

from __future__ import annotations

import functools
import unicodedata

import regex

SENTENCE_CLASSES = ("CR", "LF", "Sep", "Extend", "Format", "Sp", "Lower", "Upper", "OLetter", "Numeric", "ATerm", "SContinue", "STerm", "Close")
LINE_CLASSES = (
    "BK", "CM", "CR", "GL", "LF", "NL", "SP", "WJ", "ZW", "ZWJ", "AI", "AL", "B2", "BA", "BB", "CB", "CJ", "CL", "CP", "EB", "EM", "EX", "H2", "H3", "HL", "HY", "ID", "IN", "IS", "JL", "JT", "JV", "NS", "NU", "OP", "PO", "PR", "QU", "RI", "SA", "SG", "SY", "XX", "AK", "AP", "AS", "VF", "VI",
)
WORD_CLASSES = ("CR", "LF", "Newline", "Extend", "ZWJ", "Format", "Katakana", "Hebrew_Letter", "ALetter", "Single_Quote", "Double_Quote", "MidNumLet", "MidLetter", "MidNum", "Numeric", "ExtendNumLet", "WSegSpace", "Regional_Indicator")


def _tester(prop: str, names) -> list:
    out = []
    for name in names:
        try:
            out.append((name, regex.compile(rf"\p{{{prop}={name}}}")))
        except regex.error:
            pass  # a class of a later Unicode version
    return out


@functools.cache
def _testers(prop: str):
    return _tester(prop, {"SB": SENTENCE_CLASSES, "LB": LINE_CLASSES, "WB": WORD_CLASSES}[prop])


@functools.lru_cache(1 << 16)
def class_of(prop: str, char: str) -> str:
    """The character's class by SB, LB or WB; Other (XX for lines) if it has none."""
    for name, test in _testers(prop):
        if test.match(char):
            return name
    return "XX" if prop == "LB" else "Other"


def is_word_char(char: str) -> bool:
    """Whether words hold the character: letters, digits, and what joins them."""
    return class_of("WB", char) in ("ALetter", "Hebrew_Letter", "Numeric", "Katakana", "ExtendNumLet")


_WORD = regex.compile(r"(?V1w)\b")
_GRAPHEME = regex.compile(r"\X")


def graphemes(text: str) -> list[str]:
    return _GRAPHEME.findall(text)


def words(text: str) -> list[str]:
    """All segments between word boundaries, white space and punctuation included."""
    return [x for x in _WORD.split(text) if x]


def _cut(text: str, breaks: list[int]) -> list[str]:
    edges = [0, *breaks, len(text)]
    return [text[a:b] for a, b in zip(edges, edges[1:], strict=False) if a < b]


def sentences(text: str) -> list[str]:
    para, term = {"CR", "LF", "Sep"}, {"ATerm", "STerm"}
    units: list[tuple[str, int]] = []
    for i, c in enumerate(text):
        kind = class_of("SB", c)
        if kind in ("Extend", "Format") and units and units[-1][0] not in para:
            continue  # belongs to the unit before
        units.append((kind, i))
    kinds = [k for k, _ in units]
    breaks = []
    ended = None  # the terminator that the text up to here ends with, but for closing marks and spaces
    phase = ""
    for i, kind in enumerate(kinds[:-1]):
        following = kinds[i + 1]
        if kind in term:
            ended, phase = kind, "term"
        elif ended and kind == "Close" and phase in ("term", "close"):
            phase = "close"
        elif ended and kind == "Sp" and phase in ("term", "close", "space"):
            phase = "space"
        elif ended and kind in para and phase != "para":
            phase = "para"
        else:
            ended, phase = None, ""
        if kind == "CR" and following == "LF":
            continue
        if kind in para:
            breaks.append(units[i + 1][1])
            ended, phase = None, ""
            continue
        if not ended:
            continue
        if kind == "ATerm" and (following == "Numeric" or following == "Upper" and i and kinds[i - 1] in ("Upper", "Lower")):
            continue
        if ended == "ATerm":
            j = i + 1
            while j < len(kinds) and kinds[j] not in ("OLetter", "Upper", "Lower", "CR", "LF", "Sep", "ATerm", "STerm"):
                j += 1
            if j < len(kinds) and kinds[j] == "Lower":
                continue
        if following in ("SContinue", "ATerm", "STerm"):
            continue
        if phase in ("term", "close") and (following in ("Close", "Sp") or following in para):
            continue
        if phase == "space" and (following == "Sp" or following in para):
            continue
        breaks.append(units[i + 1][1])
    return _cut(text, breaks)


def _line_class(c: str) -> str:
    kind = class_of("LB", c)
    if kind in ("AI", "SG", "XX"):
        return "AL"
    if kind == "SA":
        return "CM" if unicodedata.category(c) in ("Mn", "Mc") else "AL"
    return "NS" if kind == "CJ" else kind


def _wide(c: str) -> bool:
    return unicodedata.east_asian_width(c) in "FWH"


def line_breaks(text: str) -> list[str]:
    """Segments between all break opportunities, mandatory and optional."""
    hard = {"BK", "CR", "LF", "NL"}
    units: list[tuple[str, int, int]] = []  # class, first and last character
    for i, c in enumerate(text):
        kind = _line_class(c)
        if kind in ("CM", "ZWJ"):
            if units and units[-1][0] not in hard | {"SP", "ZW"}:
                units[-1] = (units[-1][0], units[-1][1], i)
                continue
            kind = "AL" if kind == "CM" else "ZWJ"
        units.append((kind, i, i))
    kinds = ["AL" if k == "ZWJ" else k for k, _, _ in units]
    breaks = []
    for i in range(len(units) - 1):
        if _breaks(text, units, kinds, i, hard):
            breaks.append(units[i + 1][1])
    return _cut(text, breaks)


def _breaks(text: str, units, kinds, i: int, hard) -> bool:
    """Whether a line can end after unit i."""
    a, b = kinds[i], kinds[i + 1]
    first, second = text[units[i][1]], text[units[i + 1][1]]
    if a in hard:
        return not (a == "CR" and b == "LF")
    if b in hard or b in ("SP", "ZW"):
        return False
    j = i
    while j >= 0 and kinds[j] == "SP":
        j -= 1
    base = kinds[j] if j >= 0 else "sot"  # what stands before any spaces
    opener = text[units[j][1]] if j >= 0 else ""
    spaced = j < i
    if base == "ZW":
        return True
    if text[units[i][2]] == "‍":
        return False
    if "WJ" in (a, b) or a == "GL":
        return False
    if b == "GL" and a not in ("SP", "BA", "HY"):
        return False
    if b in ("CL", "CP", "EX", "SY") or base == "OP":
        return False
    before = kinds[j - 1] if j > 0 else "sot"
    if base == "QU" and unicodedata.category(opener) == "Pi" and before in hard | {"sot", "OP", "QU", "GL", "SP", "ZW"}:
        return False
    if b == "QU" and unicodedata.category(second) == "Pf":
        after = kinds[i + 2] if i + 2 < len(kinds) else "eot"
        if after in hard | {"SP", "GL", "WJ", "CL", "QU", "CP", "EX", "IS", "SY", "ZW", "eot"}:
            return False
    if b == "IS":
        return a == "SP" and i + 2 < len(kinds) and kinds[i + 2] == "NU"
    if base in ("CL", "CP") and b == "NS" or base == "B2" and b == "B2":
        return False
    if spaced:
        return True
    if "QU" in (a, b):
        return False
    if "CB" in (a, b):
        return True
    earlier = kinds[i - 1] if i else "sot"
    if (a == "HY" or first == "‐") and b == "AL" and earlier in hard | {"sot", "SP", "ZW", "CB", "GL"}:
        return False
    if b in ("BA", "HY", "NS") or a == "BB":
        return False
    if earlier == "HL" and a in ("HY", "BA") and b != "HL":
        return False
    if a == "SY" and b == "HL" or b == "IN":
        return False
    letter, ideo, korean = ("AL", "HL"), ("ID", "EB", "EM"), ("JL", "JV", "JT", "H2", "H3")
    if a in letter and b == "NU" or a == "NU" and b in letter:
        return False
    if a == "PR" and b in ideo or a in ideo and b == "PO":
        return False
    if a in ("PR", "PO") and b in letter or a in letter and b in ("PR", "PO"):
        return False
    if (a, b) in {("CL", "PO"), ("CP", "PO"), ("CL", "PR"), ("CP", "PR"), ("NU", "PO"), ("NU", "PR"), ("PO", "OP"), ("PO", "NU"), ("PR", "OP"), ("PR", "NU"), ("HY", "NU"), ("IS", "NU"), ("NU", "NU"), ("SY", "NU")}:
        return False
    if a == "JL" and b in ("JL", "JV", "H2", "H3") or a in ("JV", "H2") and b in ("JV", "JT") or a in ("JT", "H3") and b == "JT":
        return False
    if a in korean and b == "PO" or a == "PR" and b in korean:
        return False
    if a in letter and b in letter:
        return False
    if a == "AP" and (b in ("AK", "AS") or second == "◌") or (a in ("AK", "AS") or first == "◌") and b in ("VF", "VI"):
        return False
    if a == "IS" and b in letter:
        return False
    if a in (*letter, "NU") and b == "OP" and not _wide(second) or a == "CP" and b in (*letter, "NU") and not _wide(first):
        return False
    if a == b == "RI":
        n = 0
        while i - n >= 0 and kinds[i - n] == "RI":
            n += 1
        return n % 2 == 0
    return not (a == "EB" and b == "EM")
