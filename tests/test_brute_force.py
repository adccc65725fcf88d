"""Screening and classification against Python over whole tables."""

import os
import re
import unicodedata

import pytest
import regex

from textquarry.functions.keys import WHITESPACE_CLASS
from textquarry.operators import screening as S
from textquarry.operators import technical as C

SF = "/root/testdata/sf0.001"
EXTRA = [
    "def f():\n  return 5 km\n$ ls -l\n>>> x\nPS C:> dir", "at a.b.C(D.java:12)\nException in thread main", "arXiv: 1234.56789 and 6.02e23, \\frac{1}{2} $x + y = z$ $5 and $9", "ﬁ K 12 µm 5 nm. 7km x9e5",
    "api-key: 'abcdefghijklmnop' SECRET_KEY=QWERTYUIOPASDFGHJKL", "a@b.com a@b.com- x@y.co.th) ก1@b.com", "1.2.3.4 256.1.1.1 01.02.03.04.05 ๑.๒.๓.๔", "4111-1111-1111-1111 5500000000000004 378282246310005", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 and 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "4- 111 11", "\ufeff\u200b\u00ad" * 3 + "z", "=" * 40,
    "\u2028def x\u2028class", "from\u00a0x\n\u3000import y", "neural networks and the gradient of a tensor, a protein and quantum circuits", "โปรตีน เคมี ฟิสิกส์ สถิติ จีโนม {};{};{};=>::",
]


def _python(pattern: str):
    """The same pattern for Python: class escapes spelled out, the flag for LF lines dropped."""
    p = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", pattern)
    p = re.sub(r"^\(\?([a-z]+)\)", lambda m: "(?" + "".join(c for c in m[1] if c in "imsu") + ")" if set(m[1]) & set("imsu") else "", p)
    return regex.compile(p.replace("(?u)", ""))


def _texts(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("text").unionByName(spark.read.parquet(f"{SF}/audit_row.parquet").select("text")).where("text is not null").collect()
    return [r["text"] for r in rows] + EXTRA


def test_screening(spark):
    texts = _texts(spark)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: r["s"] for r in df.select("i", S.screen("text").alias("s")).collect()}
    email, ipv4, secret, card = (_python(p) for p in (S.EMAIL, S.IPV4, S.SECRET, S.CARD))
    spaces = set(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), WHITESPACE_CLASS))

    def luhn(digits):
        n = [int(d) for d in digits[::-1]]
        return 13 <= len(n) <= 19 and sum(n[0::2] + [sum(divmod(2 * d, 10)) for d in n[1::2]]) % 10 == 0

    for i, t in enumerate(texts):
        n = len(t)
        runs = sum(len(m[0]) for m in re.finditer(r"(?s)(.)\1{11,}", t) if not m[1].isspace())
        controls = sum(unicodedata.category(c) in ("Cc", "Cf") and c not in "\n\r\t" for c in t)
        want = {
            "too_short": n < 1, "blank_or_whitespace": not t.strip(), "nul_byte": t.count("\0"), "excess_control_characters": n and controls / n > 0.01,
            "excess_unicode_replacement": n and t.count("\ufffd") / n > 0.005, "suspicious_repeated_character_runs": n and runs / n > 0.1,
            "possible_email": len(email.findall(t)), "possible_ipv4": len(ipv4.findall(t)),
            "possible_payment_card": sum(luhn([c for c in m[0] if c.isdecimal()]) for m in card.finditer(t)), "possible_secret": len(secret.findall(t)),
        }
        assert {f["code"]: f["count"] for f in got[i]["findings"]} == {k: int(v) for k, v in want.items() if v}, t[:200]
        assert got[i]["characters"] == n and got[i]["utf8_bytes"] == len(t.encode())
    assert " " in spaces


def test_classification(spark):
    texts = _texts(spark)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: r["c"] for r in df.select("i", C.classify("text").alias("c")).collect()}
    patterns = {k: _python(v) for k, v in {**C.CODE_SIGNALS, **C.SCIENCE_SIGNALS}.items()}
    for i, t in enumerate(texts):
        score, signals = 0, set()

        def add(points, name):
            nonlocal score
            score += points
            if points:
                signals.add(name)

        for k, p in patterns.items():
            n = len(p.findall(t))
            add(min(4, 2 * n) if k in C.CODE_SIGNALS else min(3, n), k)
        words = re.findall(r"[a-z][a-z0-9_+-]*", t.lower())
        hits = sum(w in C.TERMS for w in words)
        add(min(5, hits // 2) if hits >= 4 else 0, "technical_terms")
        add(2 if hits >= 3 and hits / len(words) >= 0.03 else 0, "technical_term_density")
        strong, support, generic = (sum(x in t for x in terms) for terms in (C.THAI_STRONG, C.THAI_SUPPORT, C.THAI_GENERIC))
        add(min(6, 2 + strong) if strong else 0, "thai_strong_technical_terms")
        add(min(5, support + 1) if support >= 3 else support, "thai_support_technical_term" + "s" * (support != 1))
        add(min(2, generic) if strong or support else 0, "thai_generic_technical_support")
        symbols = sum(t.count(s) for s in C.SYMBOLS)
        add(min(4, symbols // 8), "code_symbol_density")
        assert (got[i]["score"], got[i]["signals"]) == (score, sorted(signals)), t[:200]
        assert (got[i]["category"] == C.TECHNICAL) == (score >= 4)


def _examples(pattern: str, count: int) -> list[str]:
    """Texts that mostly match a pattern, drawn from the pattern itself without its look-arounds."""
    from hypothesis import HealthCheck, Phase, given, settings
    from hypothesis import strategies as st

    p = re.sub(r"^\(\?[a-z]+\)", "(?i)" if "i" in pattern[:6] else "", pattern)
    p = p.replace(C._END, "").replace(S.WORD_CLASS, r"\w").replace(S.DIGIT_CLASS, r"\d").replace(WHITESPACE_CLASS, r"\s")
    p = re.sub(r"\(\?<?[!=]\[?[^\])]*\]?\)", "", p)
    out: list[str] = []

    @settings(max_examples=count, database=None, derandomize=True, phases=[Phase.generate], suppress_health_check=list(HealthCheck))
    @given(st.from_regex(re.compile(p), fullmatch=True))
    def draw(text):
        out.append(text.encode("utf-8", "ignore").decode())

    draw()
    return out


def test_conditions_hold_for_every_match(spark):
    """What a text must contain before a pattern is tried is contained in whatever matches."""
    from pyspark.sql import functions as F

    signs = {**C.CODE_SIGNALS, **C.SCIENCE_SIGNALS}
    gates = {**{k: (signs[k], v) for k, v in C._NEEDED.items()}, "card": (S.CARD, S.CARD_NEEDED)}
    rows = [(name, t) for name, (pattern, _) in gates.items() for t in _examples(pattern, 80)]
    df = spark.createDataFrame(rows, "name string, text string").cache()
    for name, (pattern, gate) in gates.items():
        own = df.where(F.col("name") == name).where(F.regexp_count("text", F.lit(pattern)) > 0)
        assert own.count() > 10, name
        assert [r["text"] for r in own.where(~F.col("text").rlike(gate)).collect()] == [], name
