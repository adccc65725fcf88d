"""SQL for DuckDB that gives the results of the queries."""

from __future__ import annotations

from textquarry.operators.technical import CODE_SIGNALS, SCIENCE_SIGNALS, SYMBOLS, TERMS, THAI_GENERIC, THAI_STRONG, THAI_SUPPORT

_WS = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _key(column: str) -> str:
    return rf"lower(regexp_replace({column}, '^[{_WS}]+|[{_WS}]+$', '', 'g'))"


def _hash(text: str, modulus: int) -> str:
    return f"('0x' || substr(sha256({text}), 1, 16))::UBIGINT % {modulus}"


def _bytes(column: str) -> str:
    return f"octet_length(encode({column}))"


_FP = f"sha256(nfc_normalize(trim(regexp_replace(text, '[{_WS}]+', ' ', 'g'), ' ')))"
_SIM = "('0x' || trim(simhash64_hex))::UBIGINT"
_SEED = "textquarry-sample"
_SPLIT = "textquarry-split-v1"

_DOCS = f"docs AS (SELECT doc_id, text, lower(lang) AS language, {_key('source')} AS source_id, primary_category, fetched_at FROM documents)"
_PARTITION = "CASE WHEN source_id <> '' AND g <> '' THEN CASE WHEN h < 9900 THEN 'train' WHEN h < 9950 THEN 'validation' ELSE 'holdout' END END"


def _ids(table: str, name: str) -> str:
    return f"""h AS (SELECT {name}, hex(encode(text)) AS x FROM {table} WHERE text IS NOT NULL),
b AS (SELECT {name}, list_concat(list_concat([1], list_transform(regexp_extract_all(x, '..'), lambda d: ('0x' || d)::INTEGER + 4)), [2]) AS ids FROM h)"""


_IDS = _ids("audit_row", "audit_id")


def _near(most: int) -> str:
    return f"""
WITH s AS (SELECT DISTINCT {_SIM} AS v FROM global_candidate WHERE regexp_full_match(trim(simhash64_hex), '[0-9a-fA-F]{{1,16}}'))
SELECT least(format('{{:016x}}', a.v), format('{{:016x}}', b.v)) AS a, greatest(format('{{:016x}}', a.v), format('{{:016x}}', b.v)) AS b,
  bit_count(xor(a.v, b.v)) AS distance
FROM s a JOIN s b ON a.v < b.v AND bit_count(xor(a.v, b.v)) <= {most}"""


def _selected(before: str, target: str) -> str:
    return f"SELECT doc_id, language FROM ({before}) WHERE before < {target}"


_CAPACITY = """
lanes(target_lane, rights_lane) AS (VALUES ('release_safe', 'release_safe'), ('research_only', 'release_safe'), ('research_only', 'research_only')),
cats(category) AS (VALUES ('general_thai'), ('general_english'), ('technical_scientific_code'), ('flywire_domain')),
revised AS (
  SELECT DISTINCT derived_id, rights_lane, primary_category, train_tokens FROM derived_corpus d
  WHERE revision = (SELECT max(revision) FROM derived_corpus e WHERE e.derived_id = d.derived_id)
), cap AS (
  SELECT t.target_lane, c.category, CAST(coalesce(sum(greatest(coalesce(d.train_tokens, 0), 0)) FILTER (d.derived_id IS NOT NULL), 0) AS BIGINT) AS tokens
  FROM (SELECT DISTINCT target_lane FROM lanes) t CROSS JOIN cats c
  LEFT JOIN lanes l USING (target_lane)
  LEFT JOIN revised d ON d.rights_lane = l.rights_lane AND d.primary_category = c.category
  GROUP BY ALL)"""

_W = r"\p{L}\p{N}_"
_D = r"\p{Nd}"


def _found(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def _screened(rows: str) -> str:
    """CTEs that screen ``rows`` (id, text): m has the measures, f a row (id, place, code, severity, count) for each finding, d the disposition.

    DuckDB's patterns know no look-around.  Addresses are told apart by writing what lies
    between them twice; numbers by marking each group of digits; cards by taking whole
    runs of digits; runs of equal characters by numbering the characters.
    """
    octet = rf"(?:25[0-5]|2[0-4]{_D}|1?{_D}?{_D})"
    other = "".join(chr(zero + i) for zero in (0xE50, 0x660, 0x966, 0xFF10) for i in range(10))
    twice = rf"regexp_replace(text, '([^{_W}.+%@\-])', '\1\1', 'g')"
    email = rf"(?i)(?:^|[^{_W}.+\-])[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{{2,}}(?:[^{_W}.\-]|$)"
    luhn = "list_sum(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN i % 2 = 1 THEN x[len(x) - i + 1]::INTEGER ELSE (2 * x[len(x) - i + 1]::INTEGER) // 10 + (2 * x[len(x) - i + 1]::INTEGER) % 10 END)) % 10 = 0"
    return rf"""t AS MATERIALIZED ({rows}),
chars AS (SELECT id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM t WHERE text <> ''),
islands AS (SELECT id, c, count(*) AS n FROM (SELECT id, c, i, i - row_number() OVER (PARTITION BY id, c ORDER BY i) AS g FROM chars) GROUP BY id, c, g HAVING count(*) >= 12),
runs AS (SELECT id, sum(n) AS run FROM islands WHERE NOT regexp_full_match(c, '[{_WS}]') GROUP BY id),
cards AS (SELECT id, count(*) AS card FROM (SELECT id, translate(regexp_replace(r, '[ \-]', '', 'g'), '{other}', '{"0123456789" * 4}') AS x FROM (SELECT id, unnest(regexp_extract_all(text, '{_D}(?:[ \-]?{_D})*')) AS r FROM t))
  WHERE len(x) BETWEEN 13 AND 19 AND {luhn} GROUP BY id),
m AS (SELECT id, text, length(text) AS n, octet_length(encode(text)) AS b,
  length(text) - length(regexp_replace(text, '[\x{{0}}-\x{{8}}\x{{b}}\x{{c}}\x{{e}}-\x{{1f}}\x{{7f}}-\x{{9f}}\p{{Cf}}]', '', 'g')) AS c, length(text) - length(replace(text, chr(65533), '')) AS r, coalesce(run, 0) AS run,
  {_found(twice, email)} AS email, {_found(rf"regexp_replace(text, '({_D}+)', '<\1>', 'g')", rf"(?:<{octet}>\.){{3}}<{octet}>")} AS ipv4, coalesce(card, 0) AS card,
  {_found("text", rf"(?i)(?:-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----|(?:api[_-]?key|access[_-]?token|secret[_-]?key)[{_WS}]*[:=][{_WS}]*[''\"]?[A-Za-z0-9_\-/.+=]{{16,}})")} AS secret
  FROM t LEFT JOIN runs USING (id) LEFT JOIN cards USING (id) WHERE text IS NOT NULL),
f AS (SELECT id, u.code, u.severity, u.count FROM (SELECT id, unnest([
  {{'code': 'too_short', 'severity': 'reject', 'count': (n < 1)::INTEGER}}, {{'code': 'too_long', 'severity': 'reject', 'count': (n > 2000000)::INTEGER}},
  {{'code': 'blank_or_whitespace', 'severity': 'reject', 'count': regexp_full_match(text, '[{_WS}]*')::INTEGER}}, {{'code': 'nul_byte', 'severity': 'reject', 'count': n - length(replace(text, chr(0), ''))}},
  {{'code': 'excess_control_characters', 'severity': 'reject', 'count': (n > 0 AND c / n > 0.01)::INTEGER}}, {{'code': 'excess_unicode_replacement', 'severity': 'reject', 'count': (n > 0 AND r / n > 0.005)::INTEGER}},
  {{'code': 'suspicious_repeated_character_runs', 'severity': 'review', 'count': (n > 0 AND run / n > 0.10)::INTEGER}}, {{'code': 'possible_email', 'severity': 'review', 'count': email}},
  {{'code': 'possible_ipv4', 'severity': 'review', 'count': ipv4}}, {{'code': 'possible_payment_card', 'severity': 'reject', 'count': card}}, {{'code': 'possible_secret', 'severity': 'reject', 'count': secret}}]) AS u FROM m) WHERE u.count > 0),
d AS (SELECT m.id, n AS characters, b AS utf8_bytes, run / greatest(n, 1) AS run_ratio, CASE WHEN bool_or(severity = 'reject') THEN 'reject' WHEN count(severity) > 0 THEN 'review' ELSE 'accept' END AS disposition,
  CASE WHEN bool_or(severity = 'reject') THEN 'reject' WHEN count(severity) > 0 THEN 'quarantine' ELSE 'accept' END AS status FROM m LEFT JOIN f USING (id) GROUP BY ALL)"""


def _classified(table: str = "documents", name: str = "doc_id") -> str:
    """CTEs that classify the texts of a table: k has its id, text, category, score and signals; patterns as in :func:`_screened`."""
    start, end = f"(?:^|[^{_W}])", f"(?:[^{_W}]|$)"
    apart = rf"regexp_replace(text, '([^{_W}.:/+\-])', '\1\1', 'g')"
    wide = rf"regexp_replace(text, '([^{_W}.])', '\1\1', 'g')"
    mark = lambda t: rf"regexp_replace({t}, '(\\(?:sum|int))([^{_W}\x{{1}}]|$)', '\1' || chr(1) || '\2', 'g')"
    units = "nm|um|mm|cm|km|ms|us|ns|hz|khz|mhz|ghz|mv|ma|kg|mg|ug|mol|mmol|kpa|mpa"
    counts = {
        "code_keywords": _found("text", rf"(?im)^[{_WS}]*(?:def|class|import|from|function|const|let|var|SELECT|CREATE TABLE|public static|#include|package){end}"),
        "stack_trace": _found("text", rf"(?i)(?:Traceback \(most recent call last\)|Exception in thread|at [{_W}.$]+\([{_W}.]+:{_D}+\))"),
        "shell_prompt": _found("text", rf"(?m)^[{_WS}]*(?:\$|>>>|PS [^>]+>)[{_WS}]+[^{_WS}]"),
        "doi": _found("text", rf"(?i){start}doi[{_WS}]*:?[{_WS}]*10\.{_D}{{4,9}}/[^{_WS}]+"),
        "arxiv": _found(apart, rf"(?i){start}arxiv[{_WS}]*:?[{_WS}]*{_D}{{4}}\.{_D}{{4,5}}{end}"),
        "scientific_notation": _found("text", rf"{start}[+\-]?{_D}+(?:\.{_D}+)?[eE][+\-]?{_D}+"),
        "equation": _found(mark(mark("text")), r"(?:\$[^$]{3,}\$|\\frac\{|\\sum\x{1}|\\int\x{1})"),
        "units": _found(wide, rf"(?i){start}{_D}+(?:\.{_D}+)?[{_WS}]*(?:{units}){end}"),
    }
    present = lambda terms: " + ".join(f"contains(text, '{t}')::INTEGER" for t in terms)
    symbols = " + ".join(f"(length(text) - length(replace(text, '{x}', ''))) // {len(x)}" for x in SYMBOLS)
    points = [f"least(4, 2 * {k})" for k in CODE_SIGNALS] + [f"least(3, {k})" for k in SCIENCE_SIGNALS] + [
        "CASE WHEN hits >= 4 THEN least(5, hits // 2) ELSE 0 END", "CASE WHEN dense THEN 2 ELSE 0 END", "CASE WHEN strong > 0 THEN least(6, 2 + strong) ELSE 0 END",
        "CASE WHEN support >= 3 THEN least(5, support + 1) ELSE support END", "CASE WHEN generic > 0 AND strong + support > 0 THEN least(2, generic) ELSE 0 END", "CASE WHEN symbols >= 8 THEN least(4, symbols // 8) ELSE 0 END",
    ]
    signs = [f"CASE WHEN {k} > 0 THEN '{k}' END" for k in counts] + [
        "CASE WHEN hits >= 4 THEN 'technical_terms' END", "CASE WHEN dense THEN 'technical_term_density' END", "CASE WHEN strong > 0 THEN 'thai_strong_technical_terms' END",
        "CASE WHEN support >= 2 THEN 'thai_support_technical_terms' WHEN support = 1 THEN 'thai_support_technical_term' END", "CASE WHEN generic > 0 AND strong + support > 0 THEN 'thai_generic_technical_support' END",
        "CASE WHEN symbols >= 8 THEN 'code_symbol_density' END",
    ]
    listed = ", ".join(f"'{t}'" for t in TERMS)
    return rf"""kc AS MATERIALIZED (SELECT *, len(list_filter(words, lambda w: list_contains([{listed}], w))) AS hits FROM (
  SELECT {name}, text, regexp_extract_all(lower(text), '[a-z][a-z0-9_+\-]*') AS words, {", ".join(f"{v} AS {k}" for k, v in counts.items())},
    {present(THAI_STRONG)} AS strong, {present(THAI_SUPPORT)} AS support, {present(THAI_GENERIC)} AS generic, {symbols} AS symbols FROM {table} WHERE text IS NOT NULL)),
ke AS (SELECT *, hits >= 3 AND hits / greatest(len(words), 1) >= 0.03 AS dense FROM kc),
kg AS (SELECT {name}, text, {" + ".join(points)} AS score, list_sort(list_filter([{", ".join(signs)}], lambda x: x IS NOT NULL)) AS signals FROM ke),
k AS (SELECT {name}, text, CASE WHEN score >= 4 THEN 'technical_scientific_code' ELSE 'general' END AS category, score, signals FROM kg)"""


_MANIFEST = f"""
WITH RECURSIVE c AS (
  SELECT candidate_id AS id, canonical_id AS name, {_key("source_id")} AS source_id, artifact_id, language, partition, rights_lane, lower(dedup_fingerprint) AS f,
    CASE WHEN regexp_full_match(trim(simhash64_hex), '[0-9a-fA-F]{{1,16}}') THEN {_SIM} END AS h FROM global_candidate
  WHERE partition IN ('holdout', 'validation', 'train') AND rights_lane IN ('release_safe', 'research_only') AND dedup_fingerprint IS NOT NULL
), o AS (SELECT *, row_number() OVER (ORDER BY CASE partition WHEN 'holdout' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END, CASE rights_lane WHEN 'release_safe' THEN 0 ELSE 1 END, source_id, artifact_id, id) AS n FROM c),
near AS (
  SELECT x.n, y.name AS other, CASE WHEN x.f = y.f THEN 0 ELSE 1 END AS kind, CASE WHEN x.f = y.f THEN 0 ELSE bit_count(xor(x.h, y.h)) END AS d
  FROM o x JOIN o y ON y.n < x.n AND (x.f = y.f OR bit_count(xor(x.h, y.h)) <= 3)
), s AS (SELECT *, (kind, d, other) AS score FROM near), r(n, accepted, id, other, kind, d) AS (
  SELECT 0::BIGINT, []::VARCHAR[], NULL::BIGINT, NULL::VARCHAR, NULL::INTEGER, NULL::INTEGER
  UNION ALL
  SELECT t.n, CASE WHEN t.other IS NULL THEN list_append(t.accepted, t.name) ELSE t.accepted END, t.id, t.other, t.kind, t.d FROM (
    SELECT o.n, any_value(r.accepted) AS accepted, any_value(o.id) AS id, any_value(o.name) AS name, arg_min(s.other, s.score) FILTER (list_contains(r.accepted, s.other)) AS other,
      arg_min(s.kind, s.score) FILTER (list_contains(r.accepted, s.other)) AS kind, arg_min(s.d, s.score) FILTER (list_contains(r.accepted, s.other)) AS d
    FROM r JOIN o ON o.n = r.n + 1 LEFT JOIN s ON s.n = o.n GROUP BY o.n) t
), {_classified("global_candidate", "candidate_id")}, v AS (
  SELECT r.id AS candidate_id, CASE WHEN r.other IS NULL THEN 'accept' ELSE 'exclude' END AS status,
    CASE WHEN r.other IS NULL THEN NULL WHEN r.kind = 0 THEN 'cross_source_exact_duplicate' ELSE 'cross_source_near_duplicate' END AS reason, r.other AS duplicate_of, r.d AS hamming_distance,
    CASE WHEN r.other IS NULL THEN CASE WHEN y.main_category = 'flywire_domain' THEN y.main_category WHEN k.category = 'technical_scientific_code' THEN k.category
      WHEN o.language = 'th' THEN 'general_thai' WHEN o.language = 'en' THEN 'general_english' END END AS primary_category,
    CASE WHEN r.other IS NULL THEN {_bytes("k.text")} ELSE 0 END AS token_count, o.partition, o.rights_lane, o.language
  FROM r JOIN o ON o.id = r.id LEFT JOIN k ON k.candidate_id = r.id LEFT JOIN source_registry y ON y.source_id = o.source_id WHERE r.id IS NOT NULL)"""
_SCREEN_DOCS = _screened("SELECT doc_id AS id, text FROM documents")
_RECORDS = f"""rec AS (SELECT canonical_id AS record_id, text, language, {_key("source_id")} AS source_id, partition FROM global_candidate
  WHERE {" AND ".join(f"coalesce({_key(c)}, '') <> ''" for c in ("canonical_id", "text", "language", "source_id", "partition"))}
    AND partition IN ('train', 'validation', 'holdout') AND language IN ('th', 'en', 'mixed', 'other'))"""
_SCREEN_AUDIT = _screened("SELECT audit_id AS id, text FROM audit_row")

SQL = {
    "content_hash": "SELECT doc_id, sha256(text) AS content_sha256 FROM documents",
    "dedup_fingerprint": f"SELECT doc_id, {_FP} AS fingerprint FROM documents",
    "clean_text": rf"SELECT doc_id, sha256(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^[{_WS}]+|[{_WS}]+$', '', 'g')) AS cleaned_sha256 FROM documents",
    "text_sizes": f"SELECT doc_id, {_bytes('text')} AS utf8_bytes, length(text) AS characters, length(text) - length(replace(text, chr(10), '')) + 1 AS line_count FROM documents",
    "source_group_id": rf"""SELECT DISTINCT row_id, sha256(CASE WHEN u <> '' THEN 'url:' || u ELSE 'id:' || record_id END) AS group_id
FROM (SELECT *, regexp_replace(source_url, '^[{_WS}]+|[{_WS}]+$', '', 'g') AS u FROM source_row)""",
    "rank_hash": f"WITH {_DOCS} SELECT doc_id, sha256(concat_ws(chr(0), source_id, doc_id)) AS rank, sha256(CAST(doc_id AS VARCHAR)) AS pilot_rank FROM docs",
    "canonical_order": """SELECT candidate_id, source_id || '::' || artifact_id || '::' || record_id AS canonical_id,
  CASE partition WHEN 'holdout' THEN 0 WHEN 'validation' THEN 1 WHEN 'train' THEN 2 END AS partition_rank,
  CASE rights_lane WHEN 'release_safe' THEN 0 WHEN 'research_only' THEN 1 END AS lane_rank,
  regexp_full_match(content_sha256, '[0-9a-f]{64}') AS sha_valid FROM global_candidate""",
    "lsh_bands": f"""WITH s AS (SELECT candidate_id, {_SIM} AS v FROM global_candidate WHERE regexp_full_match(trim(simhash64_hex), '[0-9a-fA-F]{{1,16}}'))
SELECT candidate_id, format('{{:016x}}', v) AS fingerprint, b || ':' || format('{{:04x}}', (v >> (16 * b)::UBIGINT) & 65535::UBIGINT) AS band_key FROM s, (SELECT unnest([0, 1, 2, 3]) AS b)""",
    "hamming_log": """SELECT m.query_canonical_id, m.record_id, bit_count(xor(('0x' || trim(m.simhash64_hex))::UBIGINT, ('0x' || trim(c.simhash64_hex))::UBIGINT)) AS distance,
  bit_count(xor(('0x' || trim(m.simhash64_hex))::UBIGINT, ('0x' || trim(c.simhash64_hex))::UBIGINT)) <= 3 AS near
FROM (SELECT DISTINCT query_canonical_id, record_id, lower(simhash64_hex) AS simhash64_hex FROM near_duplicate_match) m JOIN global_candidate c ON c.canonical_id = m.query_canonical_id""",
    "shingles": f"""WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '[^{_WS}]+')) AS n FROM documents)
SELECT doc_id, CASE WHEN n > 0 THEN greatest(1, n - 4) ELSE n END AS shingles FROM w""",
    "byte_tokens": f"""WITH {_IDS}
SELECT audit_id, len(ids) AS tokens, sha256(array_to_string(ids, ',')) AS ids_sha256 FROM b UNION ALL SELECT audit_id, NULL, NULL FROM audit_row WHERE text IS NULL""",
    "byte_tokens_documents": f"""WITH {_ids("documents", "doc_id")}
SELECT doc_id, len(ids) AS tokens, sha256(array_to_string(ids, ',')) AS ids_sha256 FROM b UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE text IS NULL""",
    "byte_round_trip_documents": "SELECT doc_id, true AS same FROM documents WHERE text IS NOT NULL",
    "token_pairs_whole": f"""WITH {_IDS} SELECT audit_id, array_to_string(ids[1:len(ids) - 1], ',') AS input, array_to_string(ids[2:], ',') AS target FROM b""",
    "simhash_candidates": "SELECT candidate_id, lower(trim(simhash64_hex)) AS simhash64 FROM global_candidate WHERE text IS NOT NULL AND simhash64_hex IS NOT NULL",
    "candidate_integrity": "\nUNION ALL ".join(
        [f"SELECT 'missing' AS rule, CAST(candidate_id AS VARCHAR) AS id, '{c}' AS detail FROM global_candidate WHERE coalesce({c}, '') = ''" for c in (
            "record_id", "text", "language", "source_id", "artifact_id", "source_group_id", "partition", "rights_lane", "content_sha256", "dedup_fingerprint", "simhash64_hex")]
        + [f"SELECT 'unknown_value', CAST(candidate_id AS VARCHAR), '{c}=' || {c} FROM global_candidate WHERE {c} NOT IN ({v})" for c, v in (
            ("partition", "'train', 'validation', 'holdout'"), ("rights_lane", "'release_safe', 'research_only', 'blocked'"), ("language", "'th', 'en', 'mixed'"))]
        + ["SELECT 'content_sha256', CAST(candidate_id AS VARCHAR), '' FROM global_candidate WHERE text IS NOT NULL AND content_sha256 <> sha256(text)",
           f"SELECT 'dedup_fingerprint', CAST(candidate_id AS VARCHAR), '' FROM global_candidate WHERE text IS NOT NULL AND lower(dedup_fingerprint) <> {_FP}"]
    ),
    "token_pairs": f"""WITH {_IDS}
SELECT audit_id, array_to_string(ids[1:least(len(ids), 17) - 1], ',') AS input, array_to_string(ids[2:least(len(ids), 17)], ',') AS target FROM b""",
    "byte_round_trip": "SELECT audit_id, true AS same FROM audit_row WHERE text IS NOT NULL",
    "screen_measures": r"""SELECT doc_id, n AS characters, octet_length(encode(text)) AS utf8_bytes, n - length(replace(text, chr(10), '')) + 1 AS line_count,
  round(CASE WHEN n > 0 THEN (n - length(regexp_replace(text, '[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}-\x{9f}\p{Cf}]', '', 'g'))) / n ELSE 0 END, 9) AS control_ratio,
  round(CASE WHEN n > 0 THEN (n - length(replace(text, chr(65533), ''))) / n ELSE 0 END, 9) AS replacement_ratio
FROM (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL)""",
    "screen_hard_rejects": rf"""WITH m AS (
  SELECT doc_id, text, length(text) AS n, length(text) - length(regexp_replace(text, '[\x{{0}}-\x{{8}}\x{{b}}\x{{c}}\x{{e}}-\x{{1f}}\x{{7f}}-\x{{9f}}\p{{Cf}}]', '', 'g')) AS c,
    length(text) - length(replace(text, chr(65533), '')) AS r FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 'too_short' AS code FROM m WHERE n < 1
UNION ALL SELECT doc_id, 'too_long' FROM m WHERE n > 2000000
UNION ALL SELECT doc_id, 'blank_or_whitespace' FROM m WHERE regexp_full_match(text, '[{_WS}]*')
UNION ALL SELECT doc_id, 'nul_byte' FROM m WHERE contains(text, chr(0))
UNION ALL SELECT doc_id, 'excess_control_characters' FROM m WHERE n > 0 AND c / n > 0.01
UNION ALL SELECT doc_id, 'excess_unicode_replacement' FROM m WHERE n > 0 AND r / n > 0.005
UNION ALL SELECT doc_id, 'possible_secret' FROM m WHERE regexp_matches(text, '(?i)(?:-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----|(?:api[_-]?key|access[_-]?token|secret[_-]?key)[{_WS}]*[:=][{_WS}]*[''"]?[A-Za-z0-9_\-/.+=]{{16,}})')""",
    "screen_disposition": f"WITH {_SCREEN_DOCS} SELECT id AS doc_id, disposition, status FROM d",
    "screen_findings": f"WITH {_SCREEN_DOCS} SELECT id AS doc_id, code, severity, count FROM f",
    "screen_runs": f"WITH {_SCREEN_DOCS} SELECT id AS doc_id, round(run_ratio, 9) AS repeated_run_ratio FROM d WHERE run_ratio > 0",
    "audit_findings": f"WITH {_SCREEN_AUDIT} SELECT language, code AS finding, count(*) AS records FROM f JOIN audit_row ON audit_id = id GROUP BY ALL",
    "quality_audit": f"""WITH {_SCREEN_AUDIT}, a AS (SELECT rights_lane, {_key("source_id")} AS source_id, language, partition, d.* FROM d JOIN audit_row ON audit_id = id)
SELECT rights_lane, source_id, language, partition, CASE WHEN s = '' THEN 'overall' ELSE s END AS grouping, * EXCLUDE (rights_lane, source_id, language, partition, s),
  CASE WHEN tokens > 0 THEN round(accept_tokens / tokens, 9) ELSE 0 END AS accepted_token_share FROM (
  SELECT rights_lane, source_id, language, partition,
    concat_ws('+', CASE WHEN grouping(rights_lane) = 0 THEN 'rights_lane' END, CASE WHEN grouping(source_id) = 0 THEN 'source_id' END, CASE WHEN grouping(language) = 0 THEN 'language' END, CASE WHEN grouping(partition) = 0 THEN 'partition' END) AS s,
    count(*) AS records, CAST(sum(characters) AS BIGINT) AS characters, CAST(sum(utf8_bytes) AS BIGINT) AS utf8_bytes, CAST(sum(utf8_bytes) AS BIGINT) AS tokens,
    {", ".join(f"count(*) FILTER (status = '{x}') AS {x}_records, CAST(coalesce(sum(utf8_bytes) FILTER (status = '{x}'), 0) AS BIGINT) AS {x}_tokens" for x in ("accept", "quarantine", "reject"))}
  FROM a GROUP BY GROUPING SETS ((), (rights_lane), (source_id), (language), (partition), (rights_lane, partition, language)))""",
    "baseline_counters": f"""WITH {_SCREEN_DOCS}, {_DOCS}, g AS (SELECT doc_id, source_id, sha256('id:' || doc_id) AS g FROM docs),
h AS (SELECT *, {_hash(f"'{_SPLIT}' || chr(0) || source_id || chr(0) || g", 10000)} AS h FROM g), p AS (SELECT d.*, {_PARTITION} AS partition FROM d JOIN h ON doc_id = id)
SELECT 'input_records' AS counter, '' AS key, count(*) AS value FROM p UNION ALL SELECT status || '_records', '', count(*) FROM p GROUP BY ALL
UNION ALL SELECT 'tokens', partition, CAST(sum(utf8_bytes) AS BIGINT) FROM p WHERE status = 'accept' GROUP BY ALL
UNION ALL SELECT 'utf8_bytes', partition, CAST(sum(utf8_bytes) AS BIGINT) FROM p WHERE status = 'accept' GROUP BY ALL
UNION ALL SELECT 'findings', code, count(*) FROM f GROUP BY ALL""",
    "technical": f"WITH {_classified()} SELECT doc_id, category, score, signals FROM k",
    "technical_categories": f"""WITH {_classified()}, {_DOCS} SELECT doc_id, CASE WHEN r.main_category = 'flywire_domain' THEN r.main_category WHEN k.category = 'technical_scientific_code' THEN k.category
  WHEN d.language = 'th' THEN 'general_thai' WHEN d.language = 'en' THEN 'general_english' END AS category FROM k JOIN docs d USING (doc_id) LEFT JOIN source_registry r ON r.source_id = d.source_id""",
    "technical_calibration": f"""WITH {_classified()} SELECT category, score, count(*) AS records, CAST(sum({_bytes("text")}) AS BIGINT) AS tokens FROM k
WHERE {_hash(chr(39) + _SEED + chr(39) + ' || chr(0) || doc_id', 1000000)} < 200000 GROUP BY ALL""",
    "signal_counts": f"WITH {_classified()} SELECT signal, count(*) AS documents FROM (SELECT unnest(signals) AS signal FROM k) GROUP BY signal",
    "exact_dedup_min_id": f"""WITH {_DOCS}, f AS (SELECT *, {_FP} AS fingerprint FROM docs WHERE text IS NOT NULL)
SELECT min(doc_id) AS doc_id, source_id, fingerprint FROM f GROUP BY source_id, fingerprint""",
    "exact_dedup_first": f"""WITH f AS (SELECT doc_id, fetched_at, {_FP} AS fingerprint FROM documents WHERE text IS NOT NULL)
SELECT doc_id, fingerprint FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY fetched_at NULLS FIRST, doc_id) AS n FROM f) WHERE n = 1""",
    "duplicate_counts": f"""WITH {_DOCS}, f AS (SELECT source_id, {_FP} AS fingerprint FROM docs WHERE text IS NOT NULL)
SELECT source_id, count(*) AS records, count(DISTINCT fingerprint) AS kept, count(*) - count(DISTINCT fingerprint) AS dropped FROM f GROUP BY source_id""",
    "near_pairs": _near(3),
    "near_pairs_wide": _near(7),
    "near_search": f"""WITH s AS (SELECT candidate_id, {_SIM} AS v FROM global_candidate WHERE regexp_full_match(trim(simhash64_hex), '[0-9a-fA-F]{{1,16}}'))
SELECT a.candidate_id AS query_id, b.candidate_id AS match_id, bit_count(xor(a.v, b.v)) AS distance
FROM s a JOIN s b ON a.candidate_id % 20 = 0 AND a.candidate_id <> b.candidate_id AND bit_count(xor(a.v, b.v)) <= 3""",
    "index_size": "SELECT count(*) AS records, 4 * count(*) AS bands FROM global_candidate WHERE regexp_full_match(trim(simhash64_hex), '[0-9a-fA-F]{1,16}')",
    "greedy_by_fields": f"""
WITH RECURSIVE c AS (
  SELECT candidate_id AS id, lower(dedup_fingerprint) AS f, {_SIM} AS h, row_number() OVER (ORDER BY
    CASE partition WHEN 'holdout' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END, CASE rights_lane WHEN 'release_safe' THEN 0 ELSE 1 END, candidate_id) AS n
  FROM global_candidate WHERE partition IN ('holdout', 'validation', 'train') AND rights_lane IN ('release_safe', 'research_only')
    AND dedup_fingerprint IS NOT NULL AND regexp_full_match(trim(simhash64_hex), '[0-9a-fA-F]{{1,16}}')
), near AS (
  SELECT n, other, kind, d, (kind, d, other) AS score FROM (
    SELECT x.n, y.id AS other, CASE WHEN x.f = y.f THEN 0 ELSE 1 END AS kind, CASE WHEN x.f = y.f THEN 0 ELSE bit_count(xor(x.h, y.h)) END AS d
    FROM c x JOIN c y ON y.n < x.n AND (x.f = y.f OR bit_count(xor(x.h, y.h)) <= 3))
), r(n, accepted, id, other, kind, d) AS (
  SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT, NULL::INTEGER, NULL::INTEGER
  UNION ALL
  SELECT s.n, CASE WHEN s.other IS NULL THEN list_append(s.accepted, s.id) ELSE s.accepted END, s.id, s.other, s.kind, s.d FROM (
    SELECT c.n, any_value(r.accepted) AS accepted, any_value(c.id) AS id, arg_min(near.other, near.score) FILTER (list_contains(r.accepted, near.other)) AS other,
      arg_min(near.kind, near.score) FILTER (list_contains(r.accepted, near.other)) AS kind, arg_min(near.d, near.score) FILTER (list_contains(r.accepted, near.other)) AS d
    FROM r JOIN c ON c.n = r.n + 1 LEFT JOIN near ON near.n = c.n GROUP BY c.n) s
)
SELECT id AS candidate_id, CASE WHEN other IS NULL THEN 'accept' ELSE 'exclude' END AS status,
  CASE WHEN other IS NULL THEN NULL WHEN kind = 0 THEN 'cross_source_exact_duplicate' ELSE 'cross_source_near_duplicate' END AS reason,
  other AS duplicate_of, d AS hamming_distance FROM r WHERE id IS NOT NULL""",
    "manifest_by_fields": f"{_MANIFEST} SELECT candidate_id, status, reason, duplicate_of, hamming_distance, primary_category, token_count FROM v",
    "decision_tokens_by_fields": f"{_MANIFEST} SELECT partition, rights_lane, language, primary_category, count(*) AS records, CAST(sum(token_count) AS BIGINT) AS tokens FROM v WHERE status = 'accept' GROUP BY ALL",
    "manifest_undecidable": """SELECT 'no_text' AS rule, CAST(candidate_id AS VARCHAR) AS id, '' AS detail FROM global_candidate WHERE text IS NULL
UNION ALL SELECT 'partition', CAST(candidate_id AS VARCHAR), coalesce(partition, 'null') FROM global_candidate WHERE coalesce(partition NOT IN ('train', 'validation', 'holdout'), true)
UNION ALL SELECT 'rights_lane', CAST(candidate_id AS VARCHAR), coalesce(rights_lane, 'null') FROM global_candidate WHERE coalesce(rights_lane NOT IN ('release_safe', 'research_only'), true)""",
    "ingestion_refused": f"""
WITH i AS (SELECT *, {_key("source_id")} AS src FROM ingestion_candidate), j AS (SELECT i.*, r.rights_lane AS lane FROM i LEFT JOIN source_registry r ON r.source_id = i.src),
a AS (SELECT DISTINCT artifact_id || '|' || {_key("source_id")} AS owned FROM global_candidate WHERE artifact_id IS NOT NULL AND source_id IS NOT NULL)
SELECT problem, count(*) AS records FROM (SELECT CASE
  {" ".join(f"WHEN coalesce({_key(c)}, '') = '' THEN 'blank {c}'" for c in ("record_id", "text", "language", "category", "j.source_id", "artifact_id", "source_group_id", "partition")).replace("blank j.", "blank ")}
  WHEN lane IS NULL THEN 'unknown source' WHEN lane NOT IN ('release_safe', 'research_only') THEN 'lane not visible'
  WHEN partition NOT IN ('train', 'validation', 'holdout') THEN 'unknown partition' WHEN artifact_id || '|' || src NOT IN (SELECT owned FROM a) THEN 'artifact of another source' END AS problem FROM j)
WHERE problem IS NOT NULL GROUP BY problem""",
    "ppm_sampled": f"SELECT doc_id FROM documents WHERE {_hash(chr(39) + _SEED + chr(39) + ' || chr(0) || doc_id', 1000000)} < 50000",
    "assign_partition": f"""WITH {_DOCS}, g AS (SELECT doc_id, source_id, sha256('id:' || doc_id) AS g FROM docs),
h AS (SELECT *, {_hash(f"'{_SPLIT}' || chr(0) || source_id || chr(0) || g", 10000)} AS h FROM g)
SELECT doc_id, {_PARTITION} AS partition FROM h""",
    "partition_matrix": f"""WITH r AS (SELECT DISTINCT row_id, language, {_key('partition')} AS p FROM source_row)
SELECT language, count(*) FILTER (p = 'train') AS train, count(*) FILTER (p = 'validation') AS validation, count(*) FILTER (p = 'holdout') AS holdout FROM r GROUP BY language""",
    "bytes_selected": f"WITH {_DOCS} "
    + _selected(
        f"""SELECT doc_id, language, coalesce(sum({_bytes('text')}) OVER (PARTITION BY language ORDER BY sha256(concat_ws(chr(0), source_id, doc_id)) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
FROM docs WHERE text IS NOT NULL AND language IS NOT NULL""",
        "50000",
    ),
    "bytes_selected_full": f"WITH {_DOCS} "
    + _selected(
        f"""SELECT doc_id, language, coalesce(sum({_bytes('text')}) OVER (PARTITION BY language ORDER BY sha256(concat_ws(chr(0), source_id, doc_id)) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
FROM docs WHERE text IS NOT NULL AND language IS NOT NULL""",
        "52428800",
    ),
    "bytes_balanced": f"WITH {_DOCS}, d AS (SELECT doc_id, language, {_bytes('text')} AS size FROM docs WHERE text IS NOT NULL AND language IN ('th', 'en')) "
    + _selected(
        "SELECT doc_id, language, coalesce(sum(size) OVER (PARTITION BY language ORDER BY sha256(CAST(doc_id AS VARCHAR)) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d",
        "(SELECT min(t) FROM (SELECT sum(size) AS t FROM d GROUP BY language))",
    ),
    "tokenizer_corpus": f"""WITH {_DOCS}, f AS (SELECT doc_id, source_id, language, {_bytes('text')} AS size, {_FP} AS g FROM docs WHERE text IS NOT NULL AND language IS NOT NULL),
k AS (SELECT *, {_hash(f"'{_SPLIT}' || chr(0) || source_id || chr(0) || g", 10000)} AS h FROM (SELECT *, row_number() OVER (PARTITION BY source_id, g ORDER BY doc_id) AS n FROM f) WHERE n = 1),
p AS (SELECT doc_id, language, source_id, size, {_PARTITION} AS partition FROM k),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY language, partition ORDER BY sha256(concat_ws(chr(0), source_id, doc_id)) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT doc_id, language, partition FROM b WHERE partition = 'train' AND before < 200000 OR partition = 'validation' AND before < 50000""",
    "rights_join": f"WITH {_DOCS} SELECT rights_lane, count(*) AS records, count(DISTINCT source_id) AS sources FROM docs JOIN source_registry USING (source_id) GROUP BY rights_lane",
    "lane_violations": f"""WITH a AS (SELECT audit_id, {_key('a.source_id')} AS source, a.rights_lane AS lane, r.rights_lane AS policy
  FROM audit_row a JOIN source_registry r ON r.source_id = {_key('a.source_id')})
SELECT 'lane_mismatch' AS rule, CAST(audit_id AS VARCHAR) AS id, concat_ws('/', lane, policy) AS detail FROM a WHERE lane IS DISTINCT FROM policy
UNION ALL SELECT 'blocked_source', CAST(audit_id AS VARCHAR), source FROM a WHERE policy = 'blocked'""",
    "missing_sources": f"WITH {_DOCS} SELECT 'unknown_source' AS rule, CAST(doc_id AS VARCHAR) AS id, source_id AS detail FROM docs WHERE source_id IS NOT NULL AND source_id NOT IN (SELECT source_id FROM source_registry)",
    "registry_difference": f"""WITH {_DOCS} SELECT source_id, 'left' AS side FROM (SELECT DISTINCT source_id FROM source_registry EXCEPT SELECT source_id FROM docs)
UNION ALL SELECT source_id, 'right' FROM (SELECT DISTINCT source_id FROM docs WHERE source_id IS NOT NULL EXCEPT SELECT source_id FROM source_registry)""",
    "selected_sources": f"""WITH {_DOCS} SELECT CASE WHEN r.rights_lane IS NULL THEN 'unknown' ELSE 'lane_not_visible' END AS rule, d.source_id AS id, coalesce(r.rights_lane, '') AS detail
FROM (SELECT DISTINCT source_id FROM docs WHERE source_id IS NOT NULL) d LEFT JOIN source_registry r USING (source_id) WHERE coalesce(r.rights_lane NOT IN ('release_safe', 'research_only'), true)""",
    "derived_lanes": f"""WITH d AS (SELECT DISTINCT derived_id, {_key('source_id')} AS source, rights_lane AS lane FROM derived_corpus),
j AS (SELECT d.*, r.rights_lane AS policy FROM d JOIN source_registry r ON r.source_id = d.source)
SELECT 'lane_mismatch' AS rule, derived_id AS id, concat_ws('/', lane, policy) AS detail FROM j WHERE lane IS DISTINCT FROM policy
UNION ALL SELECT 'blocked_source', derived_id, source FROM j WHERE policy = 'blocked'""",
    "required_fields": "\nUNION ALL ".join(
        f"SELECT '{c}' AS detail, count(*) AS records FROM ingestion_candidate WHERE {_key(f"coalesce({c}, '')")} = '' HAVING count(*) > 0" for c in ("record_id", "text", "language", "source_id", "partition")
    ),
    "repeated_records": "SELECT 'repeated_id' AS rule, record_id AS id, CAST(count(*) AS VARCHAR) AS detail FROM ingestion_candidate WHERE record_id IS NOT NULL GROUP BY record_id HAVING count(*) > 1",
    "unknown_values": "SELECT 'lang=' || coalesce(lang, 'null') AS detail, count(*) AS records FROM documents WHERE coalesce(lang NOT IN ('th', 'en', 'mixed'), true) GROUP BY ALL",
    "eligible_sources": "SELECT source_id, CASE rights_lane WHEN 'research_only' THEN 'conditional' ELSE 'approved' END AS audit_status FROM source_registry WHERE rights_lane <> 'blocked'",
    "never_train": f"SELECT doc_id FROM documents WHERE text IS NOT NULL AND {_FP} NOT IN (SELECT dedup_fingerprint FROM global_candidate WHERE dedup_fingerprint IS NOT NULL)",
    "promotions": """SELECT a.rights_lane AS from_lane, b.to_lane, a.rights_lane <> 'blocked' AND (a.rights_lane = b.to_lane OR a.rights_lane = 'release_safe' AND b.to_lane = 'research_only') AS allowed
FROM (SELECT DISTINCT rights_lane FROM source_registry) a, (VALUES ('release_safe'), ('research_only'), ('blocked')) b(to_lane)""",
    "union_sources": "SELECT origin, source_id, count(*) AS records, CAST(sum(size) AS BIGINT) AS utf8_bytes FROM ("
    + " UNION ALL ".join(
        f"SELECT '{t}' AS origin, {_key(c)} AS source_id, {_bytes('text')} AS size FROM {t}"
        for t, c in (("global_candidate", "source_id"), ("ingestion_candidate", "source_id"), ("audit_row", "source_id"), ("documents", "source"))
    )
    + ") GROUP BY ALL",
    "token_rollup": f"""WITH {_DOCS}, d AS (SELECT language, source_id, length(text) AS c, {_bytes('text')} AS b FROM docs WHERE text IS NOT NULL)
SELECT language, source_id, CASE WHEN grouping(language) = 1 AND grouping(source_id) = 1 THEN 'overall' ELSE concat_ws('+', CASE WHEN grouping(language) = 0 THEN 'language' END, CASE WHEN grouping(source_id) = 0 THEN 'source_id' END) END AS grouping,
  count(*) AS records, CAST(sum(c) AS BIGINT) AS characters, CAST(sum(b) AS BIGINT) AS utf8_bytes, CAST(sum(b) AS BIGINT) AS tokens
FROM d GROUP BY GROUPING SETS ((), (language), (source_id), (language, source_id))""",
    "language_counts": "SELECT coalesce(lang, '<NULL>') AS lang, count(*) AS records FROM documents GROUP BY ALL",
    "null_report": "SELECT count(*) AS records, count(*) - count(text) AS text_nulls, count(*) - count(lang) AS lang_nulls, count(*) - count(primary_category) AS primary_category_nulls FROM documents",
    "length_quantiles": "SELECT min(length(text)) AS least, "
    + ", ".join(f"round(quantile_cont(length(text), {q}), 6) AS {a}" for a, q in (("p01", 0.01), ("p05", 0.05), ("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))
    + ", max(length(text)) AS most, round(avg(length(text)), 6) AS mean FROM documents",
    "density": f"""WITH {_DOCS}, d AS (SELECT language, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS characters, CAST(coalesce(sum({_bytes('text')}), 0) AS BIGINT) AS utf8_bytes FROM docs GROUP BY language)
SELECT *, CASE WHEN utf8_bytes > 0 THEN round(characters / utf8_bytes, 9) ELSE 0 END AS characters_per_byte FROM d""",
    "decision_status": "SELECT status, reason, count(*) AS decisions, count(DISTINCT canonical_id) AS records, CAST(sum(greatest(token_count, 0)) AS BIGINT) AS tokens FROM global_decision GROUP BY status, reason",
    "train_capacity": f"WITH {_CAPACITY} SELECT * FROM cap",
    "mixture_readiness": f"""WITH {_CAPACITY}, w AS (
  SELECT target_lane, CAST(sum(tokens) FILTER (category = 'general_thai') AS BIGINT) AS thai, CAST(sum(tokens) FILTER (category = 'general_english') AS BIGINT) AS english,
    CAST(sum(tokens) FILTER (category = 'technical_scientific_code') AS BIGINT) AS technical, CAST(sum(tokens) FILTER (category = 'flywire_domain') AS BIGINT) AS domain FROM cap GROUP BY target_lane),
u AS (SELECT *, least(domain, 50000000) AS domain_used, 100000000 - least(domain, 50000000) AS technical_required FROM w),
g AS (SELECT *, greatest(0, 200000000 - thai) AS thai_gap, greatest(0, 200000000 - english) AS english_gap, greatest(0, technical_required - technical) AS technical_gap,
  greatest(0, 500000000 - (thai + english + technical + domain)) AS total_gap FROM u)
SELECT *, thai_gap + english_gap + technical_gap + total_gap = 0 AS ready FROM g""",
    "budget_gap": f"""WITH {_CAPACITY}, t AS (SELECT target_lane, CAST(sum(tokens) AS BIGINT) AS tokens FROM cap GROUP BY target_lane)
SELECT *, greatest(0, 500000000 - tokens) AS gap, tokens >= 500000000 AS ready FROM t""",
    "fit_text": f"""WITH {_DOCS}, g AS (SELECT doc_id, text, source_id, sha256('id:' || doc_id) AS g FROM docs WHERE text IS NOT NULL),
h AS (SELECT *, {_hash(f"'{_SPLIT}' || chr(0) || source_id || chr(0) || g", 10000)} AS h FROM g)
SELECT doc_id, sha256(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10), chr(8232))) AS line_sha256 FROM h WHERE {_PARTITION} = 'train'""",
    "inventory_tokens": f"""WITH {_DOCS}, g AS (SELECT language, source_id, {_bytes("text")} AS b, sha256('id:' || doc_id) AS g FROM docs WHERE text IS NOT NULL),
h AS (SELECT *, {_hash(f"'{_SPLIT}' || chr(0) || source_id || chr(0) || g", 10000)} AS h FROM g), p AS (SELECT *, {_PARTITION} AS partition FROM h)
SELECT language, partition, CASE WHEN grouping(language) = 1 AND grouping(partition) = 1 THEN 'overall' ELSE concat_ws('+', CASE WHEN grouping(language) = 0 THEN 'language' END, CASE WHEN grouping(partition) = 0 THEN 'partition' END) END AS grouping,
  count(*) AS records, CAST(sum(b) AS BIGINT) AS utf8_bytes, CAST(sum(b) AS BIGINT) AS tokens, round(sum(b) / 500000000, 12) AS fraction, greatest(0, 500000000 - CAST(sum(b) AS BIGINT)) AS gap
FROM p WHERE partition IS NOT NULL GROUP BY GROUPING SETS ((), (language), (partition), (partition, language))""",
    "ordered_documents": "SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS row_number FROM documents",
    "planning_capacity": """WITH lanes(target_lane, rights_lane) AS (VALUES ('release_safe', 'release_safe'), ('research_only', 'release_safe'), ('research_only', 'research_only')),
cats(category) AS (VALUES ('general_thai'), ('general_english'), ('technical_scientific_code'), ('flywire_domain')),
last AS (SELECT * FROM (SELECT DISTINCT canonical_id, decided_at, status, rights_lane, primary_category, partition, token_count FROM global_decision) QUALIFY row_number() OVER (PARTITION BY canonical_id
  ORDER BY decided_at DESC NULLS LAST, status DESC, rights_lane DESC NULLS LAST, primary_category DESC NULLS LAST, partition DESC NULLS LAST, token_count DESC NULLS LAST) = 1),
have AS (
  SELECT rights_lane, primary_category AS category, greatest(coalesce(token_count, 0), 0) AS tokens FROM last WHERE status = 'accept' AND partition = 'train'
  UNION ALL SELECT rights_lane, primary_category, greatest(coalesce(train_tokens, 0), 0) FROM (
    SELECT DISTINCT derived_id, rights_lane, primary_category, train_tokens FROM derived_corpus d WHERE revision = (SELECT max(revision) FROM derived_corpus e WHERE e.derived_id = d.derived_id)))
SELECT target_lane, category, CAST(coalesce(sum(h.tokens), 0) AS BIGINT) AS tokens, true AS planning_only
FROM lanes CROSS JOIN cats LEFT JOIN have h USING (rights_lane, category) GROUP BY target_lane, category""",
    "stateful_manifest": f"""
WITH RECURSIVE c AS (
  SELECT candidate_id AS id, lower(trim(dedup_fingerprint)) AS f, CASE WHEN regexp_full_match(trim(simhash64_hex), '[0-9a-fA-F]{{1,16}}') THEN {_SIM} END AS h,
    row_number() OVER (ORDER BY coalesce(batch_no, 0), candidate_id) AS n FROM global_candidate
), near AS (
  SELECT x.n, y.id AS other, CASE WHEN coalesce(x.f = y.f, false) THEN 0 ELSE 1 END AS kind, CASE WHEN coalesce(x.f = y.f, false) THEN 0 ELSE bit_count(xor(x.h, y.h)) END AS d
  FROM c x JOIN c y ON y.n < x.n AND (x.f = y.f OR bit_count(xor(x.h, y.h)) <= 3)
), s AS (SELECT n, other, kind, d, (kind, d, other) AS score FROM near), r(n, accepted, id, other, kind, d) AS (
  SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT, NULL::INTEGER, NULL::INTEGER
  UNION ALL
  SELECT t.n, CASE WHEN t.other IS NULL THEN list_append(t.accepted, t.id) ELSE t.accepted END, t.id, t.other, t.kind, t.d FROM (
    SELECT c.n, any_value(r.accepted) AS accepted, any_value(c.id) AS id, arg_min(s.other, s.score) FILTER (list_contains(r.accepted, s.other)) AS other,
      arg_min(s.kind, s.score) FILTER (list_contains(r.accepted, s.other)) AS kind, arg_min(s.d, s.score) FILTER (list_contains(r.accepted, s.other)) AS d
    FROM r JOIN c ON c.n = r.n + 1 LEFT JOIN s ON s.n = c.n GROUP BY c.n) t
)
SELECT id AS candidate_id, CASE WHEN other IS NULL THEN 'accept' ELSE 'exclude' END AS status,
  CASE WHEN other IS NULL THEN NULL WHEN kind = 0 THEN 'cross_source_exact_duplicate' ELSE 'cross_source_near_duplicate' END AS reason,
  other AS duplicate_of, d AS hamming_distance FROM r WHERE id IS NOT NULL""",
    "ledger_violations": f"""WITH d AS (SELECT DISTINCT derived_id AS id, {_key("source_id")} AS source, rights_lane AS lane, accepted_records AS bytes, coalesce(pretraining_authorized, false) AS authorised FROM derived_corpus x
  WHERE revision = (SELECT max(revision) FROM derived_corpus e WHERE e.derived_id = x.derived_id)), j AS (SELECT d.*, r.source_id AS known, r.rights_lane AS policy FROM d LEFT JOIN source_registry r ON r.source_id = d.source)
SELECT 'missing' AS rule, id, 'source_id' AS detail FROM d WHERE coalesce(source, '') = '' UNION ALL SELECT 'missing', id, 'rights_lane' FROM d WHERE coalesce(lane, '') = ''
UNION ALL SELECT 'unknown_source', id, coalesce(source, 'null') FROM j WHERE known IS NULL
UNION ALL SELECT 'lane_mismatch', id, concat_ws('/', lane, policy) FROM j WHERE known IS NOT NULL AND lane IS DISTINCT FROM policy
UNION ALL SELECT 'blocked_terms', id, CASE WHEN lane = 'blocked' THEN 'internal_only' ELSE 'attribution' END FROM j WHERE policy = 'blocked' AND lane IS DISTINCT FROM 'blocked'
UNION ALL SELECT 'not_immutable', id, '' FROM d WHERE authorised UNION ALL SELECT 'not_positive', id, 'bytes' FROM d WHERE coalesce(bytes <= 0, true)""",
    "selected_artifacts": f"""WITH a AS (SELECT DISTINCT artifact_id, {_key("source_id")} AS source FROM global_candidate WHERE artifact_id IS NOT NULL),
k AS (SELECT DISTINCT artifact_id, rights_lane FROM a JOIN source_registry r ON r.source_id = a.source)
SELECT CASE WHEN rights_lane IS NULL THEN 'unknown' ELSE 'lane_not_visible' END AS rule, artifact_id AS id, coalesce(rights_lane, '') AS detail
FROM (SELECT DISTINCT artifact_id FROM ingestion_candidate WHERE artifact_id IS NOT NULL) LEFT JOIN k USING (artifact_id) WHERE coalesce(rights_lane <> 'release_safe', true)""",
    "rows_of_inputs": f"""WITH c AS (SELECT candidate_id, artifact_id, {_key("source_id")} AS s, language AS l, rights_lane AS r FROM global_candidate),
n AS (SELECT artifact_id, s, l, r, count(*) AS n FROM c WHERE artifact_id IS NOT NULL GROUP BY ALL),
t AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY n DESC, s DESC NULLS LAST, l DESC NULLS LAST, r DESC NULLS LAST) = 1)
SELECT 'row_of_another_input' AS rule, CAST(candidate_id AS VARCHAR) AS id, coalesce(c.artifact_id, 'null') AS detail FROM c LEFT JOIN t USING (artifact_id)
WHERE NOT coalesce(c.s = t.s AND c.l = t.l AND (c.r IS NULL OR c.r = t.r), false)""",
    "json_round_trip": f"WITH {_RECORDS} SELECT record_id, language, source_id, partition, sha256(text) AS text_sha256 FROM rec",
    "json_report": f"WITH {_RECORDS} SELECT count(*) AS rows, CAST(sum({_bytes('text')}) AS BIGINT) AS text_bytes FROM rec",
    "pilot_partitions": f"WITH {_RECORDS} SELECT partition, count(*) AS records FROM rec WHERE partition <> 'holdout' GROUP BY partition",
    "split_rows": f"""WITH {_SCREEN_DOCS} SELECT id AS doc_id, status, CASE WHEN status = 'accept' THEN 'accepted' ELSE 'excluded' END AS sink, CASE WHEN status = 'accept' THEN utf8_bytes END AS text_bytes FROM d""",
    "stream_screened": f"WITH {_SCREEN_AUDIT} SELECT id AS audit_id, status FROM d",
    "step_plan": """WITH s AS (SELECT source_id, language, primary_category, needed_tokens, CAST(ceil(needed_tokens / 65536) AS BIGINT) AS steps FROM token_budget WHERE needed_tokens > 0)
SELECT *, greatest(1, CAST(ceil(steps * 0.02) AS BIGINT)) AS warmup_steps, steps * 65536 AS scheduled_tokens, steps * 65536 - needed_tokens AS overshoot FROM s""",
}
SQL["tokenizer_corpus_full"] = SQL["tokenizer_corpus"].replace("before < 200000", "before < 52428800").replace("before < 50000", "before < 524288")
