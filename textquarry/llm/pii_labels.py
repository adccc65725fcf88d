"""Labelled spans for training the tagger of personal data.

Silver labels: narrow patterns over a bounded sample of texts, with the name list to
recognise names.  Nothing here runs when a corpus is screened; the trained tagger does.
"""

from __future__ import annotations

import random
import re
import unicodedata

KINDS = ("email", "phone", "id_number", "street_address", "person_name")

_USER = r"[A-Za-z0-9](?:[A-Za-z0-9._%+\-]*[A-Za-z0-9])?"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
#: The at sign where it is escaped, as in HTML or an address of the web.
_ESCAPED_AT = r"(?:&#0*64;|&#[xX]0*40;|&commat;|%40)"
#: An at sign in any form; the word alone counts only between blanks.
AT_SIGN = re.compile(rf"[@＠]|{_ESCAPED_AT}|\b(?i:at)\b")
_DOT = r"(?:\.| ?[\[(](?i:dot)[\])] ?)"
_EMAIL = re.compile(
    rf"{_USER}(?:(?:[@＠]|{_ESCAPED_AT}){_LABEL}(?:\.{_LABEL})*\.[A-Za-z]{{2,}}"
    rf"| (?:[@＠]|{_ESCAPED_AT}|\((?i:at)\)|\[(?i:at)\]) {_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}}"
    rf"| (?:at {_LABEL}(?: dot {_LABEL})* dot|AT {_LABEL}(?: DOT {_LABEL})* DOT) [A-Za-z]{{2,}})"
)
_PHONE = re.compile(
    r"(?<![0-9A-Za-z.+\-/])(?:\+\d{1,3}[ \-]?\d{1,3}[ \-]?\d{3,4}[ \-]?\d{4}|\+66\d{8,9}|0066 ?\d{1,2} ?\d{7}|\(0\d{1,2}\) ?\d{3}[ \-]?\d{4}|\(\d{3}\) \d{3}-\d{4}"
    r"|0\d{1,2}([\-. ])\d{3}\1\d{4}|\d{3}-\d{3}-\d{4}|0\d{9})(?![\d])(?!-\d)(?: ?(?:x|ext\.?|ต่อ) ?\d{1,5})?"
)
_THAI_ID = re.compile(r"(?<![\d\-])(?:\d-\d{4}-\d{5}-\d{2}-\d|\d \d{4} \d{5} \d{2} \d|\d{13})(?![\d\-])")
_NO_ID = re.compile(r"(?:Barcode|Timestamp|Segment|Root|ISBN) $")
_OTHER_ID = re.compile(
    r"(?<![A-Za-z0-9])([A-Z]{1,2}\d{7})(?![\dA-Za-z])"
    r"|(?<![\d\-])(\d{3}-\d{2}-\d{4}|\d{3}-\d{3}-\d{3}-\d)(?![\d\-])|(?:SSN:? |social security number:? )(\d{3} \d{2} \d{4}|\d{9})(?!\d)"
)
_STREET = r"(?:Street|St\.|Road|Rd\.?|Avenue|Ave\.?|Crescent|Lane|Ln\.?|Blvd\.?|Boulevard|Drive|Way|Court|Close|Square|Terrace)"
_CAP = r"[A-Z][a-zé-ÿ]+"
_ADDRESS = re.compile(
    rf"(?:(?:Flat|Apt\.?|Unit|Room|No\.) ?\w+, )?(?<![\d.,/])\d{{1,4}}(?:/\d{{1,4}})?[a-z]?,? (?:{_CAP} ){{1,3}}{_STREET}(?:,? ?\n?{_CAP}(?: {_CAP})?(?:,? \d{{4,5}}(?!\d))?)?"
    rf"|(?<![\d.,/])\d{{1,4}}(?:/\d{{1,4}})? (?:Moo \d+,? |Soi {_CAP}(?: \d+)?)[^\n|;]{{0,60}}?(?:\d{{5}}|(?=[|;/\n])|$)"
    r"|(?:บ้าน)?เลขที่ ?\d{1,4}(?:/\d{1,4})?,? (?:หมู่|ม\.|ถ\.|ถนน|ซอย|ซ\.)[^\n|;A-Za-z]{0,70}?(?: \d{5}|(?=[|;/\n])|(?: จ\.[ก-๎]+)|(?: อ\.[ก-๎]+)|(?=[A-Z])|$)"
    r"|(?<![\d.,/])\d{1,4}(?:/\d{1,4})? ?(?:หมู่ ?\d|ซอย)[^\n|;A-Za-z]{0,70}?(?: \d{5}|(?=[|;/\n])|(?=[A-Z])|$)"
)
_LATIN_TITLE = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Khun)\.?"
_THAI_TITLE = r"(?:นางสาว|น\.ส\.|นาง|นาย|คุณ|อาจารย์|ดร\.|ผศ\.|รศ\.|ศ\.)"
_WORD = r"(?:[A-Z][a-z'’]+(?:-[A-Z][a-z]+)?|[A-Z]{3,})"
_SEQUENCE = re.compile(rf"(?:{_LATIN_TITLE} )?(?:{_WORD}|[A-Z]\.)(?:,? (?:{_WORD}|[A-Z]\.))+|{_LATIN_TITLE} ?{_WORD}")
_NOT_NAME = re.compile(r"(?:Institute|Road|Street|Lane|Avenue|River|Museum|Bridge|School|Hospital|University|Library|Press|Company|Foundation|Park|Hall|Station|District|Soi|Ltd|Inc|Square|Bay|Lake|Valley|Mountain|Canal|Society|Group|Systems)$")
#: Share of the listed names of a kind that must have an ending before it counts as an ending of names.
ENDING_SHARE = 0.02


def common_words(texts: list[str]) -> frozenset[str]:
    """Words that the texts also write in lower case, or begin many sentences with: capitals don't make them names."""
    small: set[str] = set()
    first: dict[str, int] = {}
    for t in texts:
        small.update(re.findall(r"(?<![A-Za-z@.])[a-z]{2,}(?![A-Za-z@])", t))
        for w in re.findall(r"(?:^|[.:!?\n] ?)([A-Z][a-z]+)(?= )", t):
            first[w] = first.get(w, 0) + 1
    often = {w.lower() for w, n in first.items() if n >= max(5, len(texts) // 400)}
    return frozenset(small | often)


def endings(names: set[str], longest: int = 8) -> re.Pattern | None:
    """Endings of two letters or more that at least ENDING_SHARE of the names have."""
    seen: dict[str, int] = {}
    for n in names:
        for k in range(2, min(longest, len(n) - 2) + 1):
            seen[n[-k:]] = seen.get(n[-k:], 0) + 1
    kept = sorted(e for e, n in seen.items() if n >= max(3, ENDING_SHARE * len(names)))
    return re.compile("(?:" + "|".join(map(re.escape, kept)) + ")$") if kept else None


def ascii_digits(text: str) -> str:
    """Every decimal digit in ASCII, character by character."""
    return "".join(str(unicodedata.digit(c)) if c.isdecimal() and not c.isascii() else c for c in text)


def thai_id_valid(digits: str) -> bool:
    """Whether the last of 13 digits is right for the first twelve."""
    return len(digits) == 13 and (11 - sum(int(d) * (13 - i) for i, d in enumerate(digits[:12])) % 11) % 10 == int(digits[12])


class Names:
    """Given and family names of a list, in lower case for Latin script, and the endings that names of the list have.

    ``common``: words that are no names however they are written, see :func:`common_words`.
    """

    def __init__(self, rows: list[tuple[str, str, str]], common: frozenset[str] = frozenset()):
        self.common = common
        self.given = {n.lower() for n, k, s in rows if k == "given" and s == "latin"}
        self.family = {n.lower() for n, k, s in rows if k == "family" and s == "latin"}
        self.given_end, self.family_end = endings(self.given, 4), endings(self.family, 4)
        thai = [sorted((n for n, k, s in rows if k == kind and s == "thai"), key=len, reverse=True) for kind in ("given", "family")]
        g, f = (f"(?:{'|'.join(map(re.escape, t))})" for t in thai)
        # a name that isn't listed is known by an ending that listed ones have
        ends = [e.pattern[:-1] if (e := endings(set(t))) else "(?!)" for t in thai]
        self.thai = re.compile(
            rf"(?:{_THAI_TITLE} ?|(?<![ก-๎]))(?:{g} (?:{f}|[ก-ฮ]\.)|(?:{g}|[ก-ฮ]\.|[ก-๎]{{2,9}}{ends[0]}) (?:{f}|[ก-๎]{{2,9}}{ends[1]}))(?![ก-๎])"
        ) if thai[0] and thai[1] else None

    def is_family(self, w: str) -> bool:
        return w.lower() in self.family or bool(self.family_end and self.family_end.search(w.lower()) and len(w) > 4)

    def is_given(self, w: str) -> bool:
        return w.lower() in self.given or bool(self.given_end and self.given_end.search(w.lower()) and len(w) > 3)

    def latin(self, text: str):
        for m in _SEQUENCE.finditer(text):
            words = [(w.group(), m.start() + w.start(), m.start() + w.end()) for w in re.finditer(rf"{_WORD}|[A-Z]\.|{_LATIN_TITLE}", m.group())]
            i = 0
            while i < len(words) - 1:
                w = words[i][0]
                if re.fullmatch(_LATIN_TITLE, w) or w.lower() in self.common and w.lower() not in self.given:
                    i += 1
                    continue
                initial = len(w) == 2 and w[1] == "."
                j = i + 1
                gap = text[words[i][2] : words[j][1]]
                if not initial and j + 1 < len(words) and len(words[j][0]) == 2 and "," not in gap:
                    j += 1
                last = words[j][0]
                short = len(last) == 2 and last[1] == "."
                turned = gap == ", "
                after = _NOT_NAME.search(words[j + 1][0]) if j + 1 < len(words) else None
                known = w.lower() in self.given or last.lower() in self.family or any(re.fullmatch(_LATIN_TITLE, x[0]) for x in words[:i])
                ok = not _NOT_NAME.search(last) and not after
                if turned:
                    ok &= not initial and not short and self.is_family(w) and self.is_given(last) and (w.lower() in self.family or last.lower() in self.given)
                elif initial:
                    ok &= self.is_family(last) or known
                elif short:
                    ok &= w.lower() in self.given or known
                else:
                    ok &= (self.is_given(w) or known) and (self.is_family(last) or known)
                if ok and (i == 0 or known or words[i - 1][0].lower() not in self.common):
                    yield words[i][1], words[j][2]
                    i = j + 1
                else:
                    i += 1


def label(text: str, names: Names, checked: bool = True) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of one text, without overlaps, in order.

    Without ``checked``, as for training, a card number counts whatever its check digit,
    which no tagger can learn and an exact test sees to.
    """
    plain = ascii_digits(text)
    found: list[tuple[int, int, str]] = []

    def add(a: int, b: int, kind: str) -> None:
        if all(b <= x or a >= y for x, y, _ in found):
            found.append((a, b, kind))

    for m in _EMAIL.finditer(plain):
        add(m.start(), m.end(), "email")
    for m in _OTHER_ID.finditer(plain):
        k = m.lastindex
        add(m.start(k), m.end(k), "id_number")
    for m in _THAI_ID.finditer(plain):
        if (not checked or thai_id_valid(re.sub(r"\D", "", m.group()))) and not _NO_ID.search(plain[: m.start()]):
            add(m.start(), m.end(), "id_number")
    for m in _ADDRESS.finditer(plain):
        add(m.start(), m.end(), "street_address")
    for m in _PHONE.finditer(plain):
        add(m.start(), m.end(), "phone")
    if names.thai:
        for m in names.thai.finditer(text):
            if not text[max(0, m.start() - 3) : m.start()].endswith("ถนน"):
                add(m.start(), m.end(), "person_name")
    for a, b in names.latin(text):
        add(a, b, "person_name")
    return sorted(found)


def look_alikes(text: str, spans: list[tuple[int, int, str]], rng: random.Random) -> str | None:
    """The text with the digits of its spans drawn anew (same shape), for more variety; None if nothing changes."""
    out, changed = list(text), False
    for a, b, kind in spans:
        if kind in ("phone", "street_address", "email"):
            lead = 1 if kind == "phone" else 0
            seen = 0
            for i in range(a, b):
                if out[i].isdecimal():
                    seen += 1
                    if seen > 2 * lead and out[i].isascii():
                        out[i] = rng.choice("0123456789")
                        changed = True
    return "".join(out) if changed else None


#: Forms of the at sign that real texts have too seldom to be learnt from them alone.
_RARE_AT = ("&#64;", "&#64;", "&#64;", "&#064;", "&#x40;", "&#X40;", "&commat;", "%40", " (AT) ", " [AT] ")


def hidden_again(text: str, spans: list[tuple[int, int, str]], rng: random.Random) -> str | None:
    """The text with the at sign of its plain addresses in a rarer form; None if it has no plain address."""
    out, end = [], 0
    for a, b, kind in spans:
        at = text.find("@", a, b)
        if kind == "email" and at > 0 and text[at - 1] != " ":
            out += [text[end:at], rng.choice(_RARE_AT)]
            end = at + 1
    return "".join([*out, text[end:]]) if out else None
