"""Technical or scientific text: a score of weighted signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textquarry.functions.binding import bind
from textquarry.functions.keys import WHITESPACE_CLASS
from textquarry.functions.text import DIGIT_CLASS, WORD_CLASS

THRESHOLD = 4
_W, _S, _D = WORD_CLASS, WHITESPACE_CLASS, DIGIT_CLASS
_END = rf"(?:(?<=[{_W}])(?![{_W}])|(?<![{_W}])(?=[{_W}]))"

# Signal patterns and word lists.
CODE_SIGNALS = {
    "code_keywords": rf"(?imud)^[{_S}]*(?:def|class|import|from|function|const|let|var|SELECT|CREATE TABLE|public static|#include|package){_END}",
    "stack_trace": rf"(?iu)(?:Traceback \(most recent call last\)|Exception in thread|at [{_W}.$]+\([{_W}.]+:{_D}+\))",
    "shell_prompt": rf"(?md)^[{_S}]*(?:\$|>>>|PS [^>]+>)[{_S}]+[^{_S}]",
}
SCIENCE_SIGNALS = {
    "doi": rf"(?iu){_END}doi[{_S}]*:?[{_S}]*10\.{_D}{{4,9}}/[^{_S}]+",
    "arxiv": rf"(?iu){_END}arxiv[{_S}]*:?[{_S}]*{_D}{{4}}\.{_D}{{4,5}}{_END}",
    "scientific_notation": rf"(?<![{_W}])[+\-]?{_D}+(?:\.{_D}+)?[eE][+\-]?{_D}+",
    "equation": rf"(?:\$[^$]{{3,}}\$|\\frac\{{|\\sum{_END}|\\int{_END})",
    "units": rf"(?iu)(?<![{_W}]){_D}+(?:\.{_D}+)?[{_S}]*(?:nm|um|mm|cm|km|ms|us|ns|hz|khz|mhz|ghz|mv|ma|kg|mg|ug|mol|mmol|kpa|mpa){_END}",
}
THAI_STRONG = ("อัลกอริทึม", "โครงข่ายประสาท", "ทรานส์ฟอร์เมอร์", "เกรเดียนต์", "เมทริกซ์", "แคลคูลัส", "อินทิกรัล", "ทรานสคริปโตม", "จีโนม", "ไซแนปส์", "ประสาทวิทยา", "วงจรประสาท", "กล้องจุลทรรศน์", "การหาลำดับ")
THAI_SUPPORT = ("แบบจำลอง", "พารามิเตอร์", "ชุดข้อมูล", "โมเลกุล", "โปรตีน", "ตัวรับ", "สมการ", "การจำลอง", "ฟิสิกส์", "เคมี", "ชีววิทยา", "การถดถอย", "เกณฑ์มาตรฐาน")
THAI_GENERIC = ("ฐานข้อมูล", "การฝึก", "สถิติ", "การทดลอง", "ความน่าจะเป็น")
TERMS = tuple(
    """
    algorithm algorithms api architecture array arrays compiler database databases
    distributed encryption endpoint endpoints framework frameworks function functions
    kernel latency memory network neural neuron neurons optimization parameter parameters
    protocol protocols query queries runtime schema schemas server servers software
    tensor tensors theorem theorems training transformer transformers variable variables
    vector vectors inference gradient gradients matrix matrices probability statistical
    statistics regression dataset datasets benchmark benchmarks experiment experiments
    molecular molecule molecules protein proteins receptor receptors genome genomic
    chromosome chromosomes physics chemistry biology neuroscience circuit circuits
    synapse synapses electron electrons quantum equation equations calculus derivative
    derivatives integral integrals differential simulation simulations model models
    microscopy sequencing transcriptome transcriptomics
    """.split()
)
CATEGORY_BY_LANGUAGE = {"th": "general_thai", "en": "general_english"}
TECHNICAL, DOMAIN = "technical_scientific_code", "flywire_domain"
SYMBOLS = ("{", "}", ";", "=>", "::")


#: What every match of a pattern holds, where that is cheaper to see; the flags are the pattern's.
_NEEDED = {
    "stack_trace": rf"(?iu)traceback|exception|:{_D}+\)", "doi": "(?iu)doi", "arxiv": "(?iu)arxiv", "scientific_notation": rf"{_D}[eE][+\-]?{_D}",
    "equation": r"[$\\]", "shell_prompt": r"[$>]", "units": rf"(?iu){_D}[{_S}]*[numckhg]",
}


def _gated(text: Column, name: str, pattern: str) -> Column:
    counted = F.regexp_count(text, F.lit(pattern))
    return F.when(text.rlike(_NEEDED[name]), counted).otherwise(0) if name in _NEEDED else counted


def _present(text: Column, terms: tuple[str, ...]) -> Column:
    total = F.lit(0)
    for t in terms:
        total += F.contains(text, F.lit(t)).cast("int")
    return total


def classify(text: Column | str, threshold: int = THRESHOLD) -> Column:
    """struct<category, score, signals>: technical from ``threshold`` points on; null for a null text.

    English words are found in the lower-cased text; characters that only case folding
    turns into ASCII letters are not.
    """
    if threshold < 1:
        raise ValueError("the threshold must be at least 1")
    text = F.col(text) if isinstance(text, str) else text
    signs = {**CODE_SIGNALS, **SCIENCE_SIGNALS}
    counts = {name: _gated(text, name, pattern) for name, pattern in signs.items()}
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9_+\\-]*"), F.lit(0))
    counts |= {"words": bind(words, lambda w: F.struct(F.size(w).alias("all"), F.size(F.filter(w, lambda x: x.isin(*TERMS))).alias("hits")))}
    counts |= {"strong": _present(text, THAI_STRONG), "support": _present(text, THAI_SUPPORT), "generic": _present(text, THAI_GENERIC)}
    symbols = F.lit(0)
    for s in SYMBOLS:
        symbols += F.floor((F.length(text) - F.length(F.replace(text, F.lit(s), F.lit("")))) / len(s)).cast("int")
    counts["symbols"] = symbols

    def judge(c: Column) -> Column:
        parts: list[tuple[Column, Column]] = []
        for name in signs:
            points = F.least(F.lit(4), 2 * c[name]) if name in CODE_SIGNALS else F.least(F.lit(3), c[name])
            parts.append((points, F.when(c[name] > 0, name)))
        hits, total = c["words"]["hits"], c["words"]["all"]
        parts.append((F.when(hits >= 4, F.least(F.lit(5), F.floor(hits / 2).cast("int"))).otherwise(0), F.when(hits >= 4, "technical_terms")))
        dense = (hits >= 3) & (hits / F.greatest(total, F.lit(1)) >= 0.03)
        parts.append((F.when(dense, 2).otherwise(0), F.when(dense, "technical_term_density")))
        strong, support, generic = c["strong"], c["support"], c["generic"]
        parts.append((F.when(strong > 0, F.least(F.lit(6), 2 + strong)).otherwise(0), F.when(strong > 0, "thai_strong_technical_terms")))
        parts.append((F.when(support >= 3, F.least(F.lit(5), support + 1)).otherwise(support), F.when(support >= 2, "thai_support_technical_terms").when(support == 1, "thai_support_technical_term")))
        beside = (generic > 0) & ((strong > 0) | (support > 0))
        parts.append((F.when(beside, F.least(F.lit(2), generic)).otherwise(0), F.when(beside, "thai_generic_technical_support")))
        symbols = c["symbols"]
        parts.append((F.when(symbols >= 8, F.least(F.lit(4), F.floor(symbols / 8).cast("int"))).otherwise(0), F.when(symbols >= 8, "code_symbol_density")))
        total_points = F.lit(0)
        for points, _ in parts:
            total_points += points
        signals = F.array_sort(F.array_compact(F.array(*[name for _, name in parts])))
        return bind(total_points, lambda score: F.struct(F.when(score >= threshold, TECHNICAL).otherwise("general").alias("category"), score.alias("score"), signals.alias("signals")))

    return F.when(text.isNotNull(), bind(F.struct(*[v.alias(k) for k, v in counts.items()]), judge))


def primary_category(technical: Column, language: Column | str, domain: Column | None = None) -> Column:
    """Declared domain, else technical, else the general category of the language; null for another language."""
    language = F.col(language) if isinstance(language, str) else language
    general = F.lit(None).cast("string")
    for code, name in CATEGORY_BY_LANGUAGE.items():
        general = F.when(language == code, name).otherwise(general)
    chosen = F.when(technical, TECHNICAL).otherwise(general)
    return chosen if domain is None else F.when(domain, DOMAIN).otherwise(chosen)
