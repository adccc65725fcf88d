"""Quality screening of text: findings in a fixed order and a disposition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textquarry.functions.binding import bind
from textquarry.functions.keys import WHITESPACE_CLASS
from textquarry.functions.text import DIGIT_CLASS, WORD_CLASS, characters, line_count, utf8_bytes

#: Thresholds (all exclusive), pattern texts and the length of suspicious runs.
MIN_CHARACTERS, MAX_CHARACTERS = 1, 2_000_000
CONTROL_RATIO, REPLACEMENT_RATIO, RUN_RATIO = 0.01, 0.005, 0.10
RUN_LENGTH = 12
EMAIL = rf"(?iu)(?<![{WORD_CLASS}.+\-])[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{{2,}}(?![{WORD_CLASS}.\-])"
_OCTET = rf"(?:25[0-5]|2[0-4]{DIGIT_CLASS}|1?{DIGIT_CLASS}?{DIGIT_CLASS})"
IPV4 = rf"(?<!{DIGIT_CLASS})(?:{_OCTET}\.){{3}}{_OCTET}(?!{DIGIT_CLASS})"
CARD = rf"(?<!{DIGIT_CLASS})(?:{DIGIT_CLASS}[ \-]?){{13,19}}(?!{DIGIT_CLASS})"
#: Every card match holds this: thirteen digits, at most one separator between two of them.
CARD_NEEDED = rf"{DIGIT_CLASS}(?:[ \-]?{DIGIT_CLASS}){{12}}"
SECRET = (
    r"(?i)(?:-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"
    rf"|(?:api[_\-]?key|access[_\-]?token|secret[_\-]?key)[{WHITESPACE_CLASS}]*[:=][{WHITESPACE_CLASS}]*['\"]?[A-Za-z0-9_\-/.+=]{{16,}})"
)
#: The phone finding never fires unless asked for: the rule it stands for matches no text.
PHONE = rf"(?<![{WORD_CLASS}])(?:\+{DIGIT_CLASS}[{DIGIT_CLASS}(). \-]{{7,}}{DIGIT_CLASS}|{DIGIT_CLASS}{{2,4}}[\- ]{DIGIT_CLASS}[{DIGIT_CLASS} \-]{{5,}}{DIGIT_CLASS})(?![{WORD_CLASS}])"
#: Thai, Arabic, Devanagari and full-width digits, which count like ASCII ones.
_OTHER_DIGITS = "".join(chr(zero + i) for zero in (0xE50, 0x660, 0x966, 0xFF10) for i in range(10))
#: Status of a record by disposition.
STATUS = {"accept": "accept", "review": "quarantine", "reject": "reject"}


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def card_numbers(text: Column) -> Column:
    """Number of 13 to 19 digit runs with a right Luhn digit."""
    found = F.regexp_extract_all(text, F.lit(CARD), F.lit(0))
    digits = F.transform(found, lambda x: F.regexp_replace(F.translate(x, _OTHER_DIGITS, "0123456789" * 4), "[ \\-]", ""))
    return F.size(F.filter(digits, lambda d: F.length(d).between(13, 19) & F.call_function("luhn_check", d)))


def run_characters(text: Column, least: int = RUN_LENGTH) -> Column:
    """Characters in runs of at least ``least`` equal characters that are no white space."""
    runs = F.regexp_extract_all(text, F.lit(rf"(?s)([^{WHITESPACE_CLASS}])\1{{{least - 1},}}"), F.lit(0))
    return F.aggregate(runs, F.lit(0), lambda a, r: a + F.char_length(r))


def screen(
    text: Column | str,
    *,
    min_characters: int = MIN_CHARACTERS,
    max_characters: int = MAX_CHARACTERS,
    control_ratio: float = CONTROL_RATIO,
    replacement_ratio: float = REPLACEMENT_RATIO,
    run_ratio: float = RUN_RATIO,
    phones: bool = False,
) -> Column:
    """struct<disposition, characters, utf8_bytes, line_count, three ratios, findings array<struct<code, severity, count>>>.

    One expression over the text; every pattern is tried once.  A null text gives a null
    struct; an empty one has ratios 0 and the findings too_short and blank_or_whitespace.
    """
    if min_characters < 0 or max_characters < min_characters:
        raise ValueError("0 <= min_characters <= max_characters is required")
    text = F.col(text) if isinstance(text, str) else text
    counts = {
        "n": characters(text),
        "bytes": utf8_bytes(text),
        "lines": line_count(text),
        "controls": _matches(text, r"[\p{Cc}\p{Cf}&&[^\n\r\t]]"),
        "broken": F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit(""))),
        "runs": F.when(text.rlike(rf"(?s)([^{WHITESPACE_CLASS}])\1{{{RUN_LENGTH - 1}}}"), run_characters(text)).otherwise(0),
        "blank": text.rlike(rf"^[{WHITESPACE_CLASS}]*\z").cast("int"),
        "nul": F.length(text) - F.length(F.replace(text, F.lit("\0"), F.lit(""))),
        # what every match holds spares most texts the patterns
        "emails": F.when(F.contains(text, F.lit("@")), _matches(text, EMAIL)).otherwise(0),
        "addresses": F.when(text.rlike(rf"{DIGIT_CLASS}\.{DIGIT_CLASS}"), _matches(text, IPV4)).otherwise(0),
        "phones": _matches(text, PHONE) if phones else F.lit(0),
        "cards": F.when(text.rlike(CARD_NEEDED), card_numbers(text)).otherwise(0),
        "secrets": F.when(text.rlike("(?i)-----BEGIN|_?-?key|token"), _matches(text, SECRET)).otherwise(0),
    }

    def judge(c: Column) -> Column:
        n = c["n"]
        ratio = lambda k: F.when(n > 0, c[k] / n).otherwise(0.0)
        over = lambda k, most: F.when(ratio(k) > most, 1).otherwise(0)
        findings = [
            ("too_short", "reject", (n < min_characters).cast("int")),
            ("too_long", "reject", (n > max_characters).cast("int")),
            ("blank_or_whitespace", "reject", c["blank"]),
            ("nul_byte", "reject", c["nul"]),
            ("excess_control_characters", "reject", over("controls", control_ratio)),
            ("excess_unicode_replacement", "reject", over("broken", replacement_ratio)),
            ("suspicious_repeated_character_runs", "review", over("runs", run_ratio)),
            ("possible_email", "review", c["emails"]),
            ("possible_ipv4", "review", c["addresses"]),
            ("possible_phone", "review", c["phones"]),
            ("possible_payment_card", "reject", c["cards"]),
            ("possible_secret", "reject", c["secrets"]),
        ]
        listed = F.filter(F.array(*[F.struct(F.lit(a).alias("code"), F.lit(s).alias("severity"), k.alias("count")) for a, s, k in findings]), lambda x: x["count"] > 0)
        return bind(
            listed,
            lambda found: F.struct(
                F.when(F.exists(found, lambda x: x["severity"] == "reject"), "reject").when(F.size(found) > 0, "review").otherwise("accept").alias("disposition"),
                n.alias("characters"), c["bytes"].alias("utf8_bytes"), c["lines"].alias("line_count"), ratio("controls").alias("control_ratio"),
                ratio("broken").alias("replacement_ratio"), ratio("runs").alias("repeated_run_ratio"), found.alias("findings"),
            ),
        )

    return F.when(text.isNotNull(), bind(F.struct(*[v.alias(k) for k, v in counts.items()]), judge))


def status(disposition: Column | str) -> Column:
    """accept, quarantine or reject of a disposition."""
    d = F.col(disposition) if isinstance(disposition, str) else disposition
    return F.when(d == "review", "quarantine").otherwise(d)
