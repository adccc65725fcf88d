"""Queries over the tables of TESTDATA.md, one or more for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.functions.keys import key, strip
from textquarry.functions.sampling import partition_of, ppm_selected
from textquarry.functions.state import cut, fresh_path, is_directory, remove_path
from textquarry.operators import accounting as A
from textquarry.operators import contracts as K
from textquarry.operators import registry as R
from textquarry.operators.dedup import greedy, keep_first, keep_latest, near_matches, near_values, priority, verdicts
from textquarry.operators.freeze import tokenizer_gate
from textquarry.operators.index import FingerprintIndex
from textquarry.operators.screening import screen, status
from textquarry.operators.selection import balance_bytes, ppm_sample, select_bytes
from textquarry.operators.technical import DOMAIN, TECHNICAL, classify, primary_category
from textquarry.operators.tokens import byte_count, byte_ids, byte_text, fit_lines, next_token_pairs, piece_counter, piece_facts, piece_model
from textquarry.plans.pipelines import calibrate, decide, ingest, materialise, refused, tokenizer_benchmark, undecidable
from textquarry.sources.files import CORPUS_LANGUAGES, corpus, null_counts, numbered
from textquarry.sources.sinks import json_lines, split_sink, without_holdout
from textquarry.sources.tables import table
from textquarry.streaming.screening import screened

SEED = "textquarry-sample"
FIT_BYTES = 50_000
#: The project's own budgets by language, for the queries named _full.
FULL_FIT_BYTES, FULL_VALIDATION_BYTES = 50 * 1024 * 1024, 512 * 1024
#: Token targets of the mixture, in tokens.
MIXTURE = A.Mixture(thai=200_000_000, english=200_000_000, technical=50_000_000, domain=50_000_000, domain_cap=50_000_000)


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", F.lower("lang").alias("language"), key("source").alias("source_id"), "primary_category", "title", "fetched_at")


def _lanes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_registry").select("source_id", "rights_lane")


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    """The known artifacts: those of the global candidates, each with its source."""
    return table(spark, sf, "global_candidate").select("artifact_id", key("source_id").alias("source_id")).where("artifact_id is not null").distinct()


# -- scalar functions ------------------------------------------------------------------


def content_hash(spark, sf):
    return _docs(spark, sf).select("doc_id", T.content_sha256("text").alias("content_sha256"))


def dedup_fingerprint(spark, sf):
    return _docs(spark, sf).select("doc_id", T.dedup_fingerprint("text").alias("fingerprint"))


def clean_text(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha2(T.clean_text("text"), 256).alias("cleaned_sha256"))


def text_sizes(spark, sf):
    return _docs(spark, sf).select("doc_id", T.utf8_bytes("text").alias("utf8_bytes"), T.characters("text").alias("characters"), T.line_count("text").alias("line_count"))


def source_group_id(spark, sf):
    return table(spark, sf, "source_row").select("row_id", T.source_group_id("source_url", "record_id").alias("group_id")).distinct()


def rank_hash(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", T.rank_hash("source_id", F.col("doc_id").cast("string")).alias("rank"), T.rank_hash(F.col("doc_id").cast("string")).alias("pilot_rank"))


def canonical_order(spark, sf):
    p, lane = priority("partition", "rights_lane")
    c = table(spark, sf, "global_candidate")
    return c.select("candidate_id", T.canonical_id("source_id", "artifact_id", "record_id").alias("canonical_id"), p.alias("partition_rank"), lane.alias("lane_rank"), T.sha256_valid("content_sha256").alias("sha_valid"))


def simhash(spark, sf):
    return _docs(spark, sf).select("doc_id", T.to_hex(T.simhash64("text")).alias("simhash64"))


def simhash_candidates(spark, sf):
    """Simhash of the candidates whose table gives one, computed again from the text."""
    c = table(spark, sf, "global_candidate").where("text is not null and simhash64_hex is not null")
    return c.select("candidate_id", T.to_hex(T.simhash64("text")).alias("simhash64"))


def shingles(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(T.word_shingles("text")).alias("shingles"))


def lsh_bands(spark, sf):
    c = table(spark, sf, "global_candidate").select("candidate_id", T.from_hex("simhash64_hex").alias("s"))
    return c.where("s is not null").select("candidate_id", T.to_hex("s").alias("fingerprint"), F.explode(T.band_keys("s")).alias("band_key"))


def hamming_log(spark, sf):
    """Distances of logged matches, computed again."""
    log = table(spark, sf, "near_duplicate_match").select("query_canonical_id", "record_id", T.from_hex("simhash64_hex").alias("m")).distinct()
    c = table(spark, sf, "global_candidate").select(F.col("canonical_id").alias("query_canonical_id"), T.from_hex("simhash64_hex").alias("q"))
    return log.join(c, "query_canonical_id").select("query_canonical_id", "record_id", T.hamming("q", "m").alias("distance"), T.likely_near("q", "m").alias("near"))


def _byte_tokens(d, id_col):
    return d.select(id_col, byte_count("text", True, True).alias("tokens"), F.sha2(F.array_join(byte_ids("text", True, True), ","), 256).alias("ids_sha256"))


def byte_tokens(spark, sf):
    return _byte_tokens(table(spark, sf, "audit_row"), "audit_id")


def byte_tokens_documents(spark, sf):
    return _byte_tokens(table(spark, sf, "documents"), "doc_id")


def _byte_round_trip(d, id_col):
    return d.where("text is not null").select(id_col, (byte_text(byte_ids("text")) == F.col("text")).alias("same"))


def byte_round_trip(spark, sf):
    return _byte_round_trip(table(spark, sf, "audit_row"), "audit_id")


def byte_round_trip_documents(spark, sf):
    return _byte_round_trip(table(spark, sf, "documents"), "doc_id")


def token_pairs(spark, sf):
    """Pairs of the first 16 steps of a text only; the whole text's are in token_pairs_whole."""
    d = table(spark, sf, "audit_row").select("audit_id", F.inline(F.array(next_token_pairs(byte_ids("text", True, True), 16))))
    return d.where("input is not null").select("audit_id", F.array_join("input", ",").alias("input"), F.array_join("target", ",").alias("target"))


def token_pairs_whole(spark, sf):
    d = table(spark, sf, "audit_row").select("audit_id", F.inline(F.array(next_token_pairs(byte_ids("text", True, True)))))
    return d.where("input is not null").select("audit_id", F.array_join("input", ",").alias("input"), F.array_join("target", ",").alias("target"))


# -- screening and classification ------------------------------------------------------


def _screened(spark, sf):
    return _docs(spark, sf).select("doc_id", "language", "source_id", screen("text").alias("q"))


def screen_disposition(spark, sf):
    return _screened(spark, sf).where("q is not null").select("doc_id", "q.disposition", status("q.disposition").alias("status"))


def screen_findings(spark, sf):
    return _screened(spark, sf).select("doc_id", F.inline("q.findings"))


def screen_measures(spark, sf):
    return _screened(spark, sf).where("q is not null").select("doc_id", "q.characters", "q.utf8_bytes", "q.line_count", F.round("q.control_ratio", 9).alias("control_ratio"), F.round("q.replacement_ratio", 9).alias("replacement_ratio"))


def screen_hard_rejects(spark, sf):
    codes = ["too_short", "too_long", "blank_or_whitespace", "nul_byte", "excess_control_characters", "excess_unicode_replacement", "possible_secret"]
    f = _screened(spark, sf).select("doc_id", F.inline("q.findings"))
    return f.where(F.col("code").isin(*codes)).select("doc_id", "code")


def screen_runs(spark, sf):
    return _screened(spark, sf).where("q.repeated_run_ratio > 0").select("doc_id", F.round("q.repeated_run_ratio", 9).alias("repeated_run_ratio"))


def technical(spark, sf):
    return _docs(spark, sf).where("text is not null").select("doc_id", F.inline(F.array(classify("text"))))


def technical_categories(spark, sf):
    """Category route of every document: domain, technical, or by language."""
    declared = table(spark, sf, "source_registry").where(F.col("main_category") == DOMAIN).select("source_id", F.lit(True).alias("declared"))
    d = _docs(spark, sf).where("text is not null").join(declared, "source_id", "left")
    return d.select("doc_id", primary_category(classify("text")["category"] == TECHNICAL, "language", F.coalesce("declared", F.lit(False))).alias("category"))


def technical_calibration(spark, sf):
    """Records, tokens, score histogram of a sample, by category."""
    d = ppm_sample(_docs(spark, sf).where("text is not null"), "doc_id", SEED, 200_000)
    return d.select(classify("text").alias("c"), byte_count("text").alias("tokens")).groupBy("c.category", "c.score").agg(F.count(F.lit(1)).alias("records"), F.sum("tokens").alias("tokens"))


def signal_counts(spark, sf):
    """Signals by frequency; equal counts in order of name."""
    d = _docs(spark, sf).where("text is not null").select(F.explode(classify("text")["signals"]).alias("signal"))
    return d.groupBy("signal").agg(F.count(F.lit(1)).alias("documents")).orderBy(F.desc("documents"), "signal")


# -- deduplication ---------------------------------------------------------------------


def _fingerprinted(spark, sf):
    return _docs(spark, sf).where("text is not null").select("doc_id", "source_id", "language", T.dedup_fingerprint("text").alias("fingerprint"), byte_count("text").alias("tokens"))


def exact_dedup_min_id(spark, sf):
    return keep_first(_fingerprinted(spark, sf), ["source_id", "fingerprint"], ["doc_id"]).select("doc_id", "source_id", "fingerprint")


def exact_dedup_first(spark, sf):
    d = _docs(spark, sf).where("text is not null").select("doc_id", "fetched_at", T.dedup_fingerprint("text").alias("fingerprint"))
    return keep_first(d, ["fingerprint"], ["fetched_at", "doc_id"]).select("doc_id", "fingerprint")


def duplicate_counts(spark, sf):
    f = _fingerprinted(spark, sf)
    return f.groupBy("source_id").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("fingerprint").alias("kept")).withColumn("dropped", F.col("records") - F.col("kept"))


def _simhashes(spark, sf):
    return table(spark, sf, "global_candidate").select("candidate_id", T.from_hex("simhash64_hex").alias("s")).where("s is not null")


def near_pairs(spark, sf):
    """Distinct fingerprints within three bits."""
    return near_values(_simhashes(spark, sf), "s").select(F.least(T.to_hex("a"), T.to_hex("b")).alias("a"), F.greatest(T.to_hex("a"), T.to_hex("b")).alias("b"), "distance")


def near_pairs_wide(spark, sf):
    """Distinct fingerprints within seven bits."""
    return near_values(_simhashes(spark, sf), "s", 7).select(F.least(T.to_hex("a"), T.to_hex("b")).alias("a"), F.greatest(T.to_hex("a"), T.to_hex("b")).alias("b"), "distance")


def near_search(spark, sf):
    """Index look-up of every candidate whose id is divisible by 20."""
    s = _simhashes(spark, sf)
    return near_matches(s.where("candidate_id % 20 = 0"), s, "candidate_id", "s")


def index_size(spark, sf):
    s = _simhashes(spark, sf)
    return s.agg(F.count(F.lit(1)).alias("records")).withColumn("bands", F.col("records") * 4)


def _candidates(spark, sf):
    """Global candidates and whether the registry declares their source as one of the domain."""
    declared = table(spark, sf, "source_registry").where(F.col("main_category") == DOMAIN).select("source_id", F.lit(True).alias("declared"))
    return table(spark, sf, "global_candidate").withColumn("source_id", key("source_id")).join(declared, "source_id", "left")


def _decisions(spark, sf):
    declared = F.coalesce("declared", F.lit(False))
    return decide(_candidates(spark, sf), "candidate_id", F.octet_length("text"), T.dedup_fingerprint("text"), T.simhash64("text"), declared, "canonical_id")


def _decisions_by_fields(spark, sf):
    declared = F.coalesce("declared", F.lit(False))
    return decide(_candidates(spark, sf), "candidate_id", F.octet_length("text"), F.lower("dedup_fingerprint"), T.from_hex("simhash64_hex"), declared, "canonical_id")


def manifest_by_fields(spark, sf):
    """Decision of every global candidate by the fingerprints that the table gives."""
    return _decisions_by_fields(spark, sf).select("candidate_id", "status", "reason", "duplicate_of", "hamming_distance", "primary_category", "token_count")


def decision_tokens_by_fields(spark, sf):
    """Accepted tokens of that manifest by partition, lane, language and category."""
    d = _decisions_by_fields(spark, sf).where("status = 'accept'")
    return d.groupBy("partition", "rights_lane", "language", "primary_category").agg(F.count(F.lit(1)).alias("records"), F.sum("token_count").alias("tokens"))


def manifest_undecidable(spark, sf):
    """Candidates that the manifest can't take, with the reason."""
    return undecidable(table(spark, sf, "global_candidate"), "candidate_id")


def global_manifest(spark, sf):
    """Decision of every global candidate."""
    return _decisions(spark, sf).select("candidate_id", "status", "reason", "duplicate_of", "hamming_distance", "primary_category", "token_count")


def greedy_by_fields(spark, sf):
    """Greedy decisions by the fingerprints that the table gives."""
    p, lane = priority("partition", "rights_lane")
    c = table(spark, sf, "global_candidate").select("candidate_id", p.alias("p"), lane.alias("l"), F.lower("dedup_fingerprint").alias("f"), T.from_hex("simhash64_hex").alias("s"))
    return greedy(c.where("p is not null and l is not null and f is not null and s is not null"), "candidate_id", ["p", "l", "candidate_id"], "f", "s")


def shard_materialise(spark, sf):
    return materialise(_docs(spark, sf), "doc_id", F.col("source_id"), SEED, 550_000)


def shard_calibration(spark, sf):
    return calibrate(_docs(spark, sf), "doc_id")


def ingestion_entries(spark, sf):
    """Manifest entry of every ingestion candidate that a research checkpoint may use."""
    return ingest(table(spark, sf, "ingestion_candidate"), _lanes(spark, sf), _ledger(spark, sf), "research_only")


def ingestion_refused(spark, sf):
    return refused(table(spark, sf, "ingestion_candidate"), _lanes(spark, sf), _ledger(spark, sf), "research_only")


def piece_tokens(spark, sf):
    """Tokens of every audit row under the SentencePiece vocabulary."""
    return table(spark, sf, "audit_row").select("audit_id", piece_counter(piece_model())("text").alias("tokens"))


def piece_tokens_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", piece_counter(piece_model())("text").alias("tokens"))


def benchmark(spark, sf):
    """The SentencePiece vocabulary against bytes, by language."""
    return tokenizer_benchmark(table(spark, sf, "audit_row"), piece_facts(piece_model())("text"), "language")


def benchmark_documents(spark, sf):
    return tokenizer_benchmark(_docs(spark, sf), piece_facts(piece_model())("text"), "language")


# -- sampling, splits, budgets ---------------------------------------------------------


def ppm_sampled(spark, sf):
    return ppm_sample(_docs(spark, sf), "doc_id", SEED, 50_000).select("doc_id")


def assign_partition(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", partition_of("source_id", T.source_group_id(F.lit(""), F.col("doc_id").cast("string"))).alias("partition"))


def partition_matrix(spark, sf):
    r = table(spark, sf, "source_row").select("row_id", "language", key("partition").alias("partition")).distinct()
    return r.groupBy("language").pivot("partition", ["train", "validation", "holdout"]).agg(F.count(F.lit(1))).na.fill(0)


def bytes_selected(spark, sf, fit_bytes=FIT_BYTES):
    d = _docs(spark, sf).where("text is not null and language is not null")
    rank = T.rank_hash("source_id", F.col("doc_id").cast("string"))
    return select_bytes(d.select("doc_id", "language", "source_id", F.octet_length("text").alias("size")), ["language"], rank, F.col("size"), fit_bytes).select("doc_id", "language")


def bytes_selected_full(spark, sf):
    return bytes_selected(spark, sf, FULL_FIT_BYTES)


def bytes_balanced(spark, sf):
    d = _docs(spark, sf).where("text is not null and language in ('th', 'en')").select("doc_id", "language", F.octet_length("text").alias("size"))
    return balance_bytes(d, "language", T.rank_hash(F.col("doc_id").cast("string")), F.col("size")).select("doc_id", "language")


def tokenizer_corpus(spark, sf, fit_bytes=4 * FIT_BYTES, validation_bytes=FIT_BYTES):
    """Per source and text once, split, train part cut to a byte budget by language."""
    d = keep_first(_fingerprinted(spark, sf).where("language is not null"), ["source_id", "fingerprint"], ["doc_id"])
    split = d.withColumn("partition", partition_of("source_id", "fingerprint"))
    rank = T.rank_hash("source_id", F.col("doc_id").cast("string"))
    train = select_bytes(split.where("partition = 'train'"), ["language"], rank, F.col("tokens"), fit_bytes)
    return train.unionByName(select_bytes(split.where("partition = 'validation'"), ["language"], rank, F.col("tokens"), validation_bytes)).select("doc_id", "language", "partition")


def tokenizer_corpus_full(spark, sf):
    return tokenizer_corpus(spark, sf, FULL_FIT_BYTES, FULL_VALIDATION_BYTES)


# -- registries ------------------------------------------------------------------------


def rights_join(spark, sf):
    d = _docs(spark, sf)
    return d.join(_lanes(spark, sf), "source_id").groupBy("rights_lane").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("source_id").alias("sources"))


def lane_violations(spark, sf):
    a = table(spark, sf, "audit_row").withColumn("source", key("source_id"))
    return R.lane_mismatches(a, "audit_id", "source", "rights_lane", _lanes(spark, sf))


def missing_sources(spark, sf):
    return R.unknown_sources(_docs(spark, sf).where("source_id is not null"), "doc_id", "source_id", _lanes(spark, sf))


def registry_difference(spark, sf):
    have = _docs(spark, sf).where("source_id is not null").select("source_id")
    return R.set_difference(_lanes(spark, sf), have, "source_id")


def selected_sources(spark, sf):
    """What keeps the documents' sources out of a research checkpoint."""
    chosen = _docs(spark, sf).where("source_id is not null").select("source_id").distinct()
    return K.selection(chosen, "source_id", _lanes(spark, sf), "research_only")


def derived_lanes(spark, sf):
    """Derived corpora whose lane isn't that of their source, or whose source is blocked."""
    d = table(spark, sf, "derived_corpus").select("derived_id", key("source_id").alias("source_id"), "rights_lane").distinct()
    return R.lane_mismatches(d, "derived_id", "source_id", "rights_lane", _lanes(spark, sf))


def candidate_integrity(spark, sf):
    return R.candidate_integrity(table(spark, sf, "global_candidate"), "candidate_id")


def required_fields(spark, sf):
    i = table(spark, sf, "ingestion_candidate")
    i = i.withColumn("at", F.concat_ws("#", F.coalesce("record_id", F.lit("?")), F.col("delivery_no").cast("string")))
    return R.required(i, "at", ["record_id", "text", "language", "source_id", "partition"]).groupBy("detail").agg(F.count(F.lit(1)).alias("records"))


def repeated_records(spark, sf):
    return R.unique(table(spark, sf, "ingestion_candidate").where("record_id is not null"), "record_id")


def unknown_values(spark, sf):
    return R.one_of(table(spark, sf, "documents"), "doc_id", "lang", R.LANGUAGES).groupBy("detail").agg(F.count(F.lit(1)).alias("records"))


def eligible_sources(spark, sf):
    r = table(spark, sf, "source_registry").withColumn("audit_status", F.when(F.col("rights_lane") == "blocked", "blocked").when(F.col("rights_lane") == "research_only", "conditional").otherwise("approved"))
    return R.eligible(r, conditional=True).select("source_id", "audit_status")


def never_train(spark, sf):
    """Documents whose text is no global candidate's."""
    known = table(spark, sf, "global_candidate").select("dedup_fingerprint")
    return R.exclude_benchmarks(_fingerprinted(spark, sf), "fingerprint", known, "dedup_fingerprint").select("doc_id")


def promotions(spark, sf):
    lane = table(spark, sf, "source_registry").select("rights_lane").distinct()
    pairs = lane.select(F.col("rights_lane").alias("from_lane"), F.explode(F.array(*[F.lit(x) for x in R.LANES])).alias("to_lane"))
    return pairs.select("from_lane", "to_lane", R.promotable("from_lane", "to_lane").alias("allowed"))


def union_sources(spark, sf):
    """Texts of four tables in one frame, counted."""
    parts = [
        table(spark, sf, t).select(F.lit(t).alias("origin"), key("source_id").alias("source_id"), F.octet_length("text").alias("size"))
        for t in ("global_candidate", "ingestion_candidate", "audit_row")
    ] + [_docs(spark, sf).select(F.lit("documents").alias("origin"), "source_id", F.octet_length("text").alias("size"))]
    return R.reduce(DataFrame.unionByName, parts).groupBy("origin", "source_id").agg(F.count(F.lit(1)).alias("records"), F.sum("size").alias("utf8_bytes"))


# -- accounting ------------------------------------------------------------------------


def quality_audit(spark, sf):
    """Screening of the audit rows by lane, source, language, partition and their combination."""
    a = table(spark, sf, "audit_row").where("text is not null")
    facts = a.select("rights_lane", key("source_id").alias("source_id"), "language", "partition", screen("text").alias("q"), byte_count("text").alias("tokens"))
    facts = facts.select("*", "q.characters", "q.utf8_bytes", status("q.disposition").alias("status"))
    sets = [[], ["rights_lane"], ["source_id"], ["language"], ["partition"], ["rights_lane", "partition", "language"]]
    out = A.grouping_sets(facts, sets, A.audit_aggregates())
    return out.withColumn("accepted_token_share", F.round(A.share(F.col("accept_tokens"), F.col("tokens")), 9))


def audit_findings(spark, sf):
    """Audit rows with each finding, by language."""
    a = table(spark, sf, "audit_row").where("text is not null").select("language", F.explode(screen("text")["findings"]).alias("f"))
    return a.groupBy("language", F.col("f.code").alias("finding")).agg(F.count(F.lit(1)).alias("records"))


def token_rollup(spark, sf):
    """Records, characters, bytes and tokens: total, by language, by source, by both."""
    d = _docs(spark, sf).where("text is not null").select("language", "source_id", F.char_length("text").alias("c"), F.octet_length("text").alias("b"))
    sets = [[], ["language"], ["source_id"], ["language", "source_id"]]
    return A.grouping_sets(d, sets, [F.count(F.lit(1)).alias("records"), F.sum("c").alias("characters"), F.sum("b").alias("utf8_bytes"), F.sum("b").alias("tokens")])


def language_counts(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy(F.coalesce("lang", F.lit("<NULL>")).alias("lang")).agg(F.count(F.lit(1)).alias("records")).orderBy(F.desc("records"), "lang")


def null_report(spark, sf):
    return null_counts(table(spark, sf, "documents"), "text", "lang", "primary_category")


def length_quantiles(spark, sf):
    n = F.char_length("text")
    q = F.percentile(n, F.array(*[F.lit(x) for x in (0.01, 0.05, 0.5, 0.95, 0.99)]))
    return _docs(spark, sf).agg(F.min(n).alias("least"), *[F.round(q[i], 6).alias(a) for i, a in enumerate(("p01", "p05", "p50", "p95", "p99"))], F.max(n).alias("most"), F.round(F.avg(n), 6).alias("mean"))


def density(spark, sf):
    """Characters and bytes, and their ratio, by language; 0 where there is nothing."""
    d = _docs(spark, sf).groupBy("language").agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("characters"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("utf8_bytes"))
    return d.withColumn("characters_per_byte", F.round(A.share(F.col("characters"), F.col("utf8_bytes")), 9))


def decision_tokens(spark, sf):
    """Accepted tokens of the manifest by partition, lane, language and category."""
    d = _decisions(spark, sf).where("status = 'accept'")
    return d.groupBy("partition", "rights_lane", "language", "primary_category").agg(F.count(F.lit(1)).alias("records"), F.sum("token_count").alias("tokens"))


def decision_status(spark, sf):
    """Logged decisions by status and reason."""
    d = table(spark, sf, "global_decision")
    return d.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("decisions"), F.countDistinct("canonical_id").alias("records"), F.sum(F.greatest("token_count", F.lit(0))).alias("tokens"))


def _train(spark, sf):
    """Train tokens of the last revision of every derived corpus, each once."""
    rows = table(spark, sf, "derived_corpus").select("derived_id", "revision", "rights_lane", "primary_category", "train_tokens")
    last = keep_latest(rows, "derived_id", "revision").where("rights_lane <> 'blocked' and primary_category is not null")
    return last.select("rights_lane", "primary_category", F.greatest(F.coalesce("train_tokens", F.lit(0)), F.lit(0)).alias("tokens"))


def train_capacity(spark, sf):
    return A.capacity(_train(spark, sf), "rights_lane", "primary_category", "tokens")


def mixture_readiness(spark, sf):
    return A.readiness(train_capacity(spark, sf), MIXTURE)


def budget_gap(spark, sf):
    """Tokens each lane lacks to the whole target."""
    total = train_capacity(spark, sf).groupBy("target_lane").agg(F.sum("tokens").alias("tokens"))
    return total.select("target_lane", "tokens", A.token_gap(F.col("tokens"), F.lit(MIXTURE.total)).alias("gap"), (F.col("tokens") >= MIXTURE.total).alias("ready"))


def step_plan(spark, sf):
    b = table(spark, sf, "token_budget").where("needed_tokens > 0").select("source_id", "language", "primary_category", "needed_tokens")
    return A.budget_plan(b, F.col("needed_tokens"), 65_536, 0.02)

# -- composed pipelines ------------------------------------------------------------------


def _split_documents(spark, sf):
    """Documents with the partition of their source and id."""
    d = _docs(spark, sf).where("text is not null")
    return d.withColumn("partition", partition_of("source_id", T.source_group_id(F.lit(""), F.col("doc_id").cast("string"))))


def fit_text(spark, sf):
    """Lines a tokenizer may be fitted on: train documents, each on one line."""
    return fit_lines(_split_documents(spark, sf), id_col="doc_id").select("doc_id", F.sha2("line", 256).alias("line_sha256"))


def inventory_tokens(spark, sf):
    """Byte tokens by language and partition against the whole target."""
    d = _split_documents(spark, sf).where("partition is not null")
    return A.inventory(d.select("language", "partition", F.octet_length("text").alias("utf8_bytes"), byte_count("text").alias("tokens")), "tokens", MIXTURE.total)


def ordered_documents(spark, sf):
    """Documents with their number in order of id."""
    return numbered(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")


def storage_density(spark, sf):
    """Tokens of the documents for each byte they take on disk."""
    raw = table(spark, sf, "documents").select(F.octet_length("text").alias("utf8_bytes"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    each = raw.groupBy("file", "size").agg(F.coalesce(F.sum("utf8_bytes"), F.lit(0)).alias("utf8_bytes"))
    whole = each.agg(F.sum("size").alias("stored"), F.sum("utf8_bytes").alias("utf8_bytes"))
    return A.densities(whole, "utf8_bytes", F.col("stored"))


def shard_counters(spark, sf):
    """Counters of the materialised shard of documents."""
    d = _docs(spark, sf)
    rows = d.withColumn("selected", ppm_selected(SEED, F.trim(F.col("doc_id").cast("string")), 550_000))
    return A.shard_counters(rows, cut(materialise(d, "doc_id", F.col("source_id"), SEED, 550_000)), "doc_id")


def baseline_counters(spark, sf):
    """Counters of the documents as they are, screened and split but not deduplicated."""
    d = _split_documents(spark, sf).select("partition", screen("text").alias("q"), byte_count("text").cast("bigint").alias("tokens"))
    return A.baseline_counters(cut(d.select("partition", "tokens", "q.utf8_bytes", status("q.disposition").alias("status"), F.col("q.findings.code").alias("findings"))))


def planning_capacity(spark, sf):
    """Accepted tokens of the log and train tokens of derived corpora by lane and category, not deduplicated against each other."""
    log = keep_latest(table(spark, sf, "global_decision").select("canonical_id", "decided_at", "status", "rights_lane", "primary_category", "partition", "token_count"), "canonical_id", "decided_at")
    train = log.where("status = 'accept' and partition = 'train' and rights_lane <> 'blocked' and primary_category is not null")
    base = train.select(F.col("rights_lane").alias("lane"), F.col("primary_category").alias("category"), F.greatest(F.coalesce("token_count", F.lit(0)), F.lit(0)).alias("tokens"))
    return A.planning_capacity(base, _train(spark, sf).select(F.col("rights_lane").alias("lane"), F.col("primary_category").alias("category"), "tokens"), False)


def stateful_manifest(spark, sf):
    """Candidates decided in two batches through a persistent index, by the fingerprints of the table."""
    c = table(spark, sf, "global_candidate").select("candidate_id", F.coalesce("batch_no", F.lit(0)).alias("batch"), F.lower(F.trim("dedup_fingerprint")).alias("f"), T.from_hex("simhash64_hex").alias("s"))
    index = FingerprintIndex(spark, fresh_path(spark, "manifest"), "bigint", int(spark.conf.get("spark.sql.shuffle.partitions")))
    first = index.consider(c.where("batch <= 6"), "candidate_id", ["batch", "candidate_id"], "f", "s", "first")
    then = index.consider(c.where("batch > 6"), "candidate_id", ["batch", "candidate_id"], "f", "s", "then")
    remove_path(spark, index.path)
    return verdicts(first.unionByName(then).withColumnRenamed("candidate_id", "id"), "candidate_id")


def ledger_violations(spark, sf):
    """Derived corpora as a ledger of artifacts, against the rights of their sources."""
    d = table(spark, sf, "derived_corpus").select("derived_id", "revision", "source_id", "rights_lane", "accepted_records", "pretraining_authorized")
    a = keep_latest(d, "derived_id", "revision").select(
        F.col("derived_id").alias("artifact_id"), key("source_id").alias("source_id"), "rights_lane", F.when(F.col("rights_lane") == "blocked", "internal_only").otherwise("attribution").alias("redistribution"),
        (~F.coalesce("pretraining_authorized", F.lit(False))).alias("immutable"), F.col("accepted_records").alias("bytes"), F.sha2("derived_id", 256).alias("sha256"),
    )
    return K.ledger(a, _lanes(spark, sf))


def selected_artifacts(spark, sf):
    """What keeps the ingestion candidates' artifacts out of a release-safe checkpoint."""
    known = _ledger(spark, sf).join(_lanes(spark, sf), "source_id")
    chosen = table(spark, sf, "ingestion_candidate").where("artifact_id is not null").select("artifact_id").distinct()
    return K.selection(chosen, "artifact_id", known, "release_safe")


def rows_of_inputs(spark, sf):
    """Global candidates that don't agree with the source, language and lane most often declared for their artifact."""
    c = table(spark, sf, "global_candidate").select("candidate_id", F.col("artifact_id").alias("input_id"), key("source_id").alias("source_id"), "artifact_id", "language", "rights_lane")
    n = c.where("artifact_id is not null").groupBy("input_id", "source_id", "artifact_id", "language", "rights_lane").agg(F.count(F.lit(1)).alias("n"))
    parts = ["source_id", "artifact_id", "language", "rights_lane"]
    top = n.groupBy("input_id").agg(F.max(F.struct("n", *parts)).alias("top")).select("input_id", *[F.col(f"top.{p}").alias(p) for p in parts])
    return K.rows_of_inputs(c, top, "candidate_id")[1]


def gate(spark, sf):
    """What keeps the SentencePiece vocabulary from use, measured on the audit rows."""
    import sentencepiece

    size = sentencepiece.SentencePieceProcessor(model_file=piece_model()).vocab_size()
    return tokenizer_gate(tokenizer_benchmark(table(spark, sf, "audit_row"), piece_facts(piece_model())("text"), "language"), size, 32_000)

# -- sources, sinks, streams -------------------------------------------------------------


def _records(spark, sf):
    """Global candidates as corpus records; those that a strict reader would refuse are left out."""
    c = table(spark, sf, "global_candidate").select(F.col("canonical_id").alias("record_id"), "text", "language", key("source_id").alias("source_id"), F.lit("cc0-1.0").alias("license"), "partition")
    filled = [F.coalesce(F.length(strip(x)), F.lit(0)) > 0 for x in ("record_id", "text", "language", "source_id", "partition")]
    return c.where(R.reduce(lambda x, y: x & y, filled)).where(F.col("partition").isin(*R.PARTITIONS) & F.col("language").isin(*CORPUS_LANGUAGES))


def json_round_trip(spark, sf):
    """Records written as ordered JSON Lines and read again by the strict reader."""
    path = fresh_path(spark, "records")
    json_lines(_records(spark, sf), path, "record_id", sorted_keys=True)
    back = cut(corpus(spark, path).select("record_id", "language", "source_id", "partition", F.sha2("text", 256).alias("text_sha256")))
    remove_path(spark, path)
    return back


def json_report(spark, sf):
    """What the JSON Lines writer reports of the records: rows and bytes of text."""
    path = fresh_path(spark, "records")
    told = json_lines(_records(spark, sf), path, "record_id")
    remove_path(spark, path)
    return spark.createDataFrame([(told["rows"], told["text_bytes"])], "rows bigint, text_bytes bigint")


def split_rows(spark, sf):
    """Screened documents in the two sinks of accepted texts and excluded metadata."""
    path = fresh_path(spark, "split")
    rows = _docs(spark, sf).where("text is not null").select("doc_id", "text", screen("text").alias("q")).select("doc_id", "text", status("q.disposition").alias("status"))
    split_sink(cut(rows), f"{path}/accepted", f"{path}/excluded")
    kept, rest = spark.read.parquet(f"{path}/accepted"), spark.read.parquet(f"{path}/excluded")
    both = cut(kept.select("doc_id", "status", F.lit("accepted").alias("sink"), F.octet_length("text").alias("text_bytes")).unionByName(rest.select("doc_id", "status", F.lit("excluded").alias("sink"), F.lit(None).cast("int").alias("text_bytes"))))
    remove_path(spark, path)
    return both


def pilot_partitions(spark, sf):
    """Records by the partitions of a pilot corpus, which never holds the holdout."""
    path = fresh_path(spark, "pilot")
    without_holdout(_records(spark, sf), path)
    counted = cut(spark.read.parquet(path).groupBy("partition").agg(F.count(F.lit(1)).alias("records")))
    remove_path(spark, path)
    return counted


def _stream(spark, sf, name):
    """A table as a stream of its files."""
    path = f"{sf}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    return reader.parquet(path) if is_directory(spark, path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def stream_screened(spark, sf):
    """Audit rows screened as a stream, up to what is there now."""
    path = fresh_path(spark, "stream")
    rows = screened(_stream(spark, sf, "audit_row").where("text is not null").select("audit_id", "text")).select("audit_id", "status")
    run = rows.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    out = cut(spark.read.schema("audit_id bigint, status string").parquet(f"{path}/rows"))
    remove_path(spark, path)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        content_hash, dedup_fingerprint, clean_text, text_sizes, source_group_id, rank_hash, canonical_order, simhash, simhash_candidates, shingles, lsh_bands, hamming_log,
        byte_tokens, byte_tokens_documents, byte_round_trip, byte_round_trip_documents, token_pairs, token_pairs_whole, screen_disposition, screen_findings, screen_measures, screen_hard_rejects, screen_runs, technical,
        technical_categories, technical_calibration, signal_counts, exact_dedup_min_id, exact_dedup_first, duplicate_counts, near_pairs, near_pairs_wide,
        near_search, index_size, global_manifest, manifest_by_fields, decision_tokens_by_fields, manifest_undecidable, greedy_by_fields, shard_materialise, shard_calibration, ingestion_entries, ingestion_refused, piece_tokens, piece_tokens_documents, benchmark, benchmark_documents, ppm_sampled, assign_partition, partition_matrix,
        bytes_selected, bytes_selected_full, bytes_balanced, tokenizer_corpus, tokenizer_corpus_full, rights_join, lane_violations, missing_sources, registry_difference, selected_sources, derived_lanes, candidate_integrity,
        required_fields, repeated_records, unknown_values, eligible_sources, never_train, promotions, union_sources, quality_audit, audit_findings,
        token_rollup, language_counts, null_report, length_quantiles, density, decision_tokens, decision_status, train_capacity, mixture_readiness,
        budget_gap, step_plan, fit_text, inventory_tokens, ordered_documents, storage_density, shard_counters, baseline_counters, planning_capacity, stateful_manifest,
        ledger_violations, selected_artifacts, rows_of_inputs, gate, json_round_trip, json_report, split_rows, pilot_partitions, stream_screened,
    )
}
