"""Made-up lines with known personal data, for training the tagger.

Every piece is drawn from wide rules: names are listed ones, recombined from halves of
listed ones, common ones of several countries or made of random syllables; addresses,
numbers and mailboxes likewise.  Lines of things that only resemble personal data are
made as well.  The labels are known by construction.
"""

from __future__ import annotations

import random

_GIVEN = "John Mary Anna Peter Somchai Malee Arthit Kanya Niran Wei Li Hiroshi Yuki Carlos Maria Ahmed Fatima Olga Ivan Pierre Claire Hans Greta Luca Sofia Priya Arjun Tom Emma Noah Julia Omar Leila Kofi Ama".split()
_FAMILY = "Smith Johnson Brown Garcia Müller Rossi Dubois Novak Kowalski Ivanov Tanaka Suzuki Wang Chen Nguyen Patel Singh Khan Jaidee Saetang Wongsakul Srisuk Okafor Mensah Silva Santos O'Brien McDonald Larsen Virtanen".split()
_THAI_GIVEN = "สมชาย สมหญิง มาลี กานดา ประเสริฐ วิชัย สุดา อนันต์ พรทิพย์ ธนา ณัฐพล ปิยะ อรุณ จันทร์เพ็ญ ศิริพร".split()
_THAI_FAMILY = "ใจดี แสงทอง ศรีสุข วงศ์สกุล ทองดี บุญมา พงษ์ไพบูลย์ รักไทย จันทร์แก้ว สุวรรณ มณีรัตน์ แก้วมณี".split()
_TLD = "com org net io edu info co.th ac.th go.th or.th in.th th de fr co.uk example example.org example.com example.net test".split()
_USERS = "info sales support admin office contact team hello press desk jobs news data lab".split()
_STREETS = "Street St. Road Rd Avenue Ave Crescent Lane Ln Boulevard Blvd Drive Way Court Close Square Terrace".split()
_LATIN_TITLES = "Mr. Mrs. Ms. Miss Dr. Prof. Khun Mr Mrs Dr Prof".split()
_THAI_TITLES = "นาย นาง นางสาว น.ส. คุณ ดร. อาจารย์ ผศ. รศ.".split()
_CUES = {
    "email": ["Contact: {}", "write to {}", "mail {}", "E-mail {}", "Questions go to {}.", "({})", "<{}>", "Send it to {} by Friday.", "อีเมล {}", "ติดต่อ {}", "ส่งเอกสารไปที่ {} ภายในวันศุกร์", "{}", "reply to {}, please", "user={}", "cc {}; thanks"],
    "phone": ["Tel. {}", "call {}", "Phone: {}", "Mobile {}", "โทร. {}", "โทรศัพท์ {}", "มือถือ: {}", "Call {} after nine.", "The office line is {}.", "fax {}", "{}", "({})", "เบอร์ {} ครับ", "WhatsApp {}"],
    "id_number": ["ID {}", "passport {}", "SSN {}", "เลขบัตรประชาชน {}", "Holder of {} may collect it.", "national id: {}", "หนังสือเดินทาง {}", "taxpayer {}", "{}", "Identity card {} was shown.", "เลขประจำตัวผู้เสียภาษี {}"],
    "street_address": ["Address: {}", "lives at {}", "Parcels go to {}.", "ที่อยู่ {}", "Send it to {}", "บ้าน {}", "{}", "Visit us at {}.", "ส่งของไปที่ {}", "from {} on Monday"],
    "person_name": ["Contributor: {}", "by {}", "Contact: {}", "{} wrote this.", "Thanks to {}.", "{} and others met.", "ผู้เขียน {}", "ติดต่อ {}", "{} กล่าวว่า", "signed, {}", "author = {}", "{}", "Ask {} about it.", "according to {}, yes", "As {} said, it rained."],
}
_COUNTER = [
    "Order {d5}-{d5} shipped.", "version {d2}.{d2}.{d2}", "{d2} @ {d2}.50 each", "@{w}.cache(maxsize={d2})", "@{w} liked it", "ISBN 978-{d}-{d4}-{d4}-{d}", "2024-0{d}-1{d} 0{d}:{d2}", "10.0.{d}.{d2}", "{C} Road is closed.",
    "The {C} Institute", "{C} River rose", "{C} Museum opens at {d}", "Release {C} ships after release {C}.", "Barcode {d13}", "timestamp 17{d4}{d4}{d3}", "page {d} of {d2}", "{d2},{d3},{d3} บาท", "พ.ศ. 25{d2}", "รายการที่ {d4}/25{d2}",
    "ถนน{t}ปิด", "โรงเรียน{t}", "Mr. {C} came.", "Dear {C},", "meet at noon at {C}", "look at {w} dot by dot", "{w}@{d2}", "https://{w}.example/{w}?q={d3}", "{w}.{w}({w}=@{w})", "Segment 7205{d4}{d4}", "{d2}°{d2}'N", "{d3}-{d2} to {d2}", "x{d3}y{d3}",
    "{C} {C} Ltd.", "between {C} and {C}", "Lake {C}", "{C} Station, platform {d}", "{d} {w}s, {d2} {w}s", "room {d3}", "item no. {d4}-{d2}", "SKU {C}-{d5}", "{d4} {d4} {d4} {d4}", "0x{d5}", "#{d5}", "{d3}.{d2} km", "call {w}() twice", "{d2}/{d2}/20{d2}",
]
_SYLLABLES = "ba ko ri ten sa mor vel dan lu fi gar tho min pre sto wen cla dru hal jo nim que rax sol tri ulm vor wex yan zed bro plim".split()
_THAI_SYLLABLES = "กา ดี มา สุข ทอง พร ชัย นา วัง รัก ศรี บุญ เพ็ญ ลา ภู ริน เดช กุล วิ ปัญ ญา สิน ธร ไพ".split()


class Maker:
    """Draws lines; the same seed and lists give the same lines."""

    def __init__(self, names: list[tuple[str, str, str]], words: list[str], seed: int):
        self.rng = random.Random(seed)
        self.words = words or ["word"]
        self.listed = {(k, s): sorted({n for n, kind, script in names if kind == k and script == s}) for k in ("given", "family") for s in ("latin", "thai")}

    # -- parts --------------------------------------------------------------------------

    def digits(self, n: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(n))

    def _made(self, n: int) -> str:
        return "".join(self.rng.choice(_SYLLABLES) for _ in range(n))

    def _place(self) -> str:
        return self._made(self.rng.choice([2, 2, 3])).capitalize()

    def _thai(self, n: int) -> str:
        return "".join(self.rng.choice(_THAI_SYLLABLES) for _ in range(n))

    def _name(self, kind: str, script: str) -> str:
        rng, listed = self.rng, self.listed[(kind, script)]
        how = rng.random()
        if listed and how < 0.45:
            return rng.choice(listed)
        if len(listed) > 1 and how < 0.75:
            a, b = rng.choice(listed), rng.choice(listed)
            return a[: rng.randrange(1, max(2, len(a) - 1))] + b[len(b) // 2 :].lower()
        if script == "thai":
            return rng.choice(_THAI_GIVEN if kind == "given" else _THAI_FAMILY) if how < 0.9 else self._thai(rng.choice([2, 3]))
        return rng.choice(_GIVEN if kind == "given" else _FAMILY) if how < 0.92 else self._made(rng.choice([2, 3])).capitalize()

    def person(self) -> str:
        rng = self.rng
        if rng.random() < 0.35:
            given, family = self._name("given", "thai"), self._name("family", "thai")
            title = rng.choice(_THAI_TITLES) + rng.choice(["", "", " "]) if rng.random() < 0.4 else ""
            return title + rng.choice([f"{given} {family}"] * 8 + [f"{given[0]}. {family}" if "ก" <= given[0] <= "ฮ" else f"{given} {family}", f"{given} {family[0]}." if "ก" <= family[0] <= "ฮ" else f"{given} {family}"])
        given, family = self._name("given", "latin"), self._name("family", "latin")
        middle = rng.choice("ABCDEFGHJKLMNPRSTW")
        body = rng.choice([f"{given} {family}"] * 8 + [f"{given[0]}. {family}"] * 2 + [f"{family}, {given}", f"{given} {family[0]}.", f"{given} {middle}. {family}", f"{given.upper()} {family.upper()}"])
        return (rng.choice(_LATIN_TITLES) + " " if rng.random() < 0.25 and ", " not in body else "") + body

    def email(self) -> str:
        rng = self.rng
        word = lambda: rng.choice([self._made(2), rng.choice(self.words).lower(), rng.choice(_USERS), self._name("given", "latin").lower().replace("'", ""), self._name("family", "latin").lower().replace("'", "")])
        user = rng.choice(["{a}", "{a}.{b}", "{a}{n}", "{a}_{b}", "{a}-{b}", "{a}+{b}", "{a}.{b}{n}", "{i}.{b}", "{i}{b}"]).format(a=word(), b=word(), n=self.digits(rng.choice([1, 2, 3])), i=rng.choice("abcdefghjkmprst"))
        labels = [rng.choice([self._made(rng.choice([1, 2, 3])), rng.choice(self.words).lower(), self._made(2) + rng.choice(["mail", "post", "lab", "corp", "-" + self._made(1)])]) for _ in range(rng.choice([1, 1, 1, 2]))]
        user = "".join(c for c in user if c.isascii() and (c.isalnum() or c in "._+-")).strip("._+-") or "info"
        labels = ["".join(c for c in x if c.isascii() and (c.isalnum() or c == "-")).strip("-") or "mail" for x in labels] + rng.choice(_TLD).split(".")
        host = ".".join(labels)
        how = rng.random()
        if how < 0.62:
            mail = f"{user}@{host}"
            return mail.upper() if rng.random() < 0.04 else mail.title() if rng.random() < 0.02 else mail
        if how < 0.7:
            return f"{user}{rng.choice(['&#64;', '&#064;', '&#x40;', '&#X40;', '&commat;', '%40', '＠'])}{host}"
        if how < 0.76:
            return f"{user} @ {host}"
        at = rng.choice(["[at]", "(at)", "(AT)", "[AT]"])
        if how < 0.88:
            dot = rng.choice([" [dot] ", " (dot) ", "[dot]", "(dot)", "."])
            return f"{user} {at} {dot.join(labels)}"
        return f"{user} AT {' DOT '.join(labels)}" if rng.random() < 0.2 else f"{user} at {' dot '.join(labels)}"

    def phone(self) -> str:
        rng, d = self.rng, self.digits
        sep = rng.choice("-- ..")
        mobile = rng.choice("689")
        form = rng.choice([
            f"0{mobile}{d(1)}{sep}{d(3)}{sep}{d(4)}", f"0{mobile}{d(1)}{sep}{d(3)}{sep}{d(4)}", f"0{mobile}{d(8)}", f"0{d(1)}-{d(3)}-{d(4)}", f"0{d(1)}{sep}{d(3)}{sep}{d(4)}", f"0{d(2)}-{d(6)}", f"+66 {mobile}{d(1)} {d(3)} {d(4)}", f"+66{mobile}{d(8)}", f"+66-{mobile}{d(1)}-{d(3)}-{d(4)}", f"(0{d(1)}) {d(3)} {d(4)}", f"(0{d(2)}) {d(3)}-{d(4)}",
            f"(0{d(1)}) {d(3)}{d(4)}", f"({rng.choice('23456789')}{d(2)}) {d(3)}-{d(4)}", f"{rng.choice('23456789')}{d(2)}-{d(3)}-{d(4)}", f"+1 {d(3)} {d(3)} {d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"+44 {d(2)} {d(4)} {d(4)}", f"+49 {d(2)} {d(3)} {d(4)}", f"0066 {d(1)} {d(7)}",
        ])
        if rng.random() < 0.15:
            form += rng.choice([" x", " ext. ", " ext ", " ต่อ ", "x"]) + d(rng.choice([1, 2, 3, 4]))
        return self._thai_digits(form) if rng.random() < 0.12 else form

    def _thai_digits(self, text: str) -> str:
        return text.translate({ord(str(k)): chr(0xE50 + k) for k in range(10)})

    def id_number(self) -> str:
        rng, d = self.rng, self.digits
        if rng.random() < 0.5:
            # the check digit is tested after the tagger, which only has to know the form
            whole = rng.choice("00123456789") + d(12)
            sep = rng.choice(["-", " ", "", ""])
            form = sep.join([whole[0], whole[1:5], whole[5:10], whole[10:12], whole[12]])
            return self._thai_digits(form) if rng.random() < 0.15 else form
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        form = rng.choice([f"{rng.choice(letters)}{rng.choice(letters)}{d(7)}", f"{rng.choice(letters)}{d(7)}", f"{d(3)}-{d(2)}-{d(4)}", f"{rng.choice(['0', d(1)])}{d(2)}-{d(3)}-{d(3)}-{d(1)}", f"{d(3)} {d(2)} {d(4)}"])
        return self._thai_digits(form) if form[0].isdecimal() and rng.random() < 0.06 else form

    def street_address(self) -> str:
        rng, d = self.rng, self.digits
        number = str(rng.randrange(1, 2000)) + (f"/{rng.randrange(1, 99)}" if rng.random() < 0.3 else "")
        if rng.random() < 0.45:
            road = " ".join(self._place() for _ in range(rng.choice([1, 1, 1, 2]))) + " " + rng.choice(_STREETS)
            town = rng.choice(["", f", {self._place()}", f", {self._place()} {d(5)}", f", {self._place()}, {d(5)}", f" {self._place()} {d(5)}"])
            lead = rng.choice([""] * 5 + [f"Flat {rng.randrange(1, 40)}, ", f"Apt. {rng.randrange(1, 90)}, ", f"Unit {d(1)}B, ", "No. "])
            return f"{lead}{number} {road}{town}"
        if rng.random() < 0.35:
            return f"{number} " + rng.choice([f"Moo {d(1)}, Soi {self._place()}", f"Moo {d(1)} {self._place()} Road", f"Soi {self._place()} {d(1)}", f"Moo {d(1)}"]) + rng.choice(["", f", {self._place()}", f", {self._place()} {d(5)}"])
        road = rng.choice([f"ถ.{self._thai(3)}", f"ถนน{self._thai(3)}", f"ซ.{self._thai(2)}", f"ซอย{self._thai(2)} {d(1)}", f"หมู่ {d(1)}", f"ม.{d(1)}"])
        if rng.random() < 0.5:
            road = rng.choice([
                f"ซอย{self._thai(2)} {rng.randrange(1, 60)} ถนน{self._thai(3)}", f"ซ.{self._thai(2)} {rng.randrange(1, 60)} ถ.{self._thai(3)}", f"หมู่ {d(1)} ซอย{self._thai(2)}", f"หมู่ {d(1)} ถนน{self._thai(2)}", f"ม.{d(1)} ซ.{self._thai(2)} ถ.{self._thai(3)}",
            ])
        rest = rng.choice(["", f" ต.{self._thai(2)}", f" ต.{self._thai(2)} อ.{self._thai(2)}", f" ต.{self._thai(2)} อ.{self._thai(2)} จ.{self._thai(2)}", f" แขวง{self._thai(2)} เขต{self._thai(2)}"]) + (f" {d(5)}" if rng.random() < 0.4 else "")
        form = rng.choice(["เลขที่ ", "เลขที่ ", "บ้านเลขที่ ", "บ้านเลขที่", "", "", ""]) + f"{number} {road}{rest}"
        return self._thai_digits(form) if rng.random() < 0.1 else form

    def counter(self) -> str:
        """Something that only resembles personal data."""
        out = self.rng.choice(_COUNTER)
        while "{" in out:
            a, b = out.index("{"), out.index("}")
            k = out[a + 1 : b]
            value = self.rng.choice(self.words) if k == "w" else self._place() if k == "C" else self._thai(3) if k == "t" else self.digits(int(k[1:] or 1))
            out = out[:a] + value + out[b + 1 :]
        return out

    # -- lines --------------------------------------------------------------------------

    def line(self, carriers: list[str]) -> tuple[str, list[tuple[int, int, str]]]:
        """A text of fragments with personal data, look-alikes and plain sentences, and its spans."""
        rng = self.rng
        out, spans = "", []
        kinds = list(_CUES)
        joint = rng.choice([" ", " ", " ", "\n", "; ", " / ", " | "])
        for _ in range(rng.choice([1, 2, 2, 3, 4])):
            if out:
                out += joint
            how = rng.random()
            if how < 0.6:
                kind = rng.choice(kinds)
                body = getattr(self, {"person_name": "person"}.get(kind, kind))()
                cue = rng.choice(_CUES[kind])
                if kind == "id_number" and body[3:4] == " ":  # three groups of digits are one only where it is said
                    cue = rng.choice(["SSN {}", "SSN: {}", "social security number {}", "social security number: {}"])
                elif kind == "id_number" and rng.random() < 0.04:
                    body, cue = self.digits(9), rng.choice(["SSN {}", "SSN: {}", "social security number {}"])
                at = len(out) + cue.index("{}")
                out += cue.replace("{}", body, 1)
                spans.append((at, at + len(body), kind))
            elif how < 0.8 or not carriers:
                out += self.counter()
            else:
                text = rng.choice(carriers)
                a = rng.randrange(max(1, len(text) - 60))
                a = text.rfind(" ", 0, a) + 1
                out += text[a : a + rng.randrange(20, 90)].rsplit(" ", 1)[0]
        return out, spans
