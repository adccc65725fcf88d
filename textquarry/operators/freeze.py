"""Contracts of configuration objects and reports, and the freeze that pins them.

A check takes plain objects, as read from JSON, and returns its problems as (rule, where,
detail); an empty list means that the contract holds.  What a contract fixes is a
parameter, so that a project states its numbers once.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.operators.accounting import Mixture
from textquarry.operators.registry import CATEGORIES, VISIBLE, ContractError
from textquarry.sources.sinks import file_digest

Problem = tuple[str, str, str]
#: Fields and enumerations of an inventory's sources, and the greatest share of the domain.
SOURCE_FIELDS = (
    "source_id", "name", "categories", "languages", "dataset_url", "license_name", "license_url", "license_audit_status", "acquisition_status", "source_grouping_key",
    "content_rights_notes", "pii_risk", "intended_role",
)
AUDIT_STATUS = ("approved", "conditional", "blocked")
DOMAIN_SHARE = 0.10
#: What a release may be called by its lane, and the gaps that must be closed.
ELIGIBILITY = {"release_safe": "preserved_pending_final_release_audit", "research_only": "not_qualified"}
GAPS = ("thai_gap", "english_gap", "technical_gap", "total_gap")
MISSING = object()


def at(payload: Any, path: str) -> Any:
    """The value under a dotted path, or MISSING."""
    for part in path.split(".") if path else []:
        if not isinstance(payload, Mapping) or part not in payload:
            return MISSING
        payload = payload[part]
    return payload


def pinned(payload: Any, values: Mapping[str, Any], rule: str = "pinned") -> list[Problem]:
    """Paths whose value is another than the one pinned; true is not 1, and a float may be off by 1e-12."""
    out = []
    for path, want in values.items():
        have = at(payload, path)
        close = isinstance(want, float) and isinstance(have, (int, float)) and not isinstance(have, bool) and abs(have - want) <= 1e-12
        if not close and (type(have) is not type(want) or have != want):
            out.append((rule, path, "missing" if have is MISSING else f"{have!r}, not {want!r}"))
    return out


def require_none(problems: Iterable[Problem], what: str) -> None:
    listed = list(problems)
    if listed:
        raise ContractError(f"{what}: " + "; ".join(" ".join(p).strip() for p in listed[:5]))


def sha256_text(value: Any) -> bool:
    return isinstance(value, str) and len(value) == 64 and set(value) <= set("0123456789abcdef")


def mixture_contract(payload: Any, goal: Mixture) -> list[Problem]:
    """A mixture: its categories, targets, fallback and authorisation must be those of ``goal``."""
    categories = at(payload, "categories")
    out = [] if isinstance(categories, Mapping) and set(categories) == set(CATEGORIES) else [("categories", "categories", "another set")]
    thai, english, technical, domain = CATEGORIES
    return out + pinned(payload, {
        "schema_version": 1, "primary_target_tokens": goal.total,
        f"categories.{thai}.target_tokens": goal.thai, f"categories.{thai}.minimum_tokens": goal.thai,
        f"categories.{english}.target_tokens": goal.english, f"categories.{english}.minimum_tokens": goal.english,
        f"categories.{technical}.base_target_tokens": goal.technical, f"categories.{domain}.target_tokens": goal.domain, f"categories.{domain}.maximum_tokens": goal.domain_cap,
        "fallback_policy.general_language_overage_cannot_substitute_other_categories": True, "fallback_policy.category_assignment_must_be_single_primary_category": True,
        "authorization.total_target_must_be_met": True, "authorization.thai_minimum_must_be_met": True, "authorization.english_minimum_must_be_met": True,
    })


def inventory_contract(payload: Any, budgets: Mapping[str, int], split: Mapping[str, float], acquisition: Iterable[str]) -> list[Problem]:
    """An inventory of sources: budgets, mix, split, and every source's fields."""
    out = pinned(payload, {"schema_version": 1, **{f"token_budgets.{k}": v for k, v in budgets.items()}, **{f"split.{k}": v for k, v in split.items()}})
    mix = at(payload, "target_mix")
    if not isinstance(mix, Mapping) or set(mix) != set(CATEGORIES):
        out.append(("mix", "target_mix", "another set of categories"))
    else:
        if not math.isclose(sum(map(float, mix.values())), 1.0, abs_tol=1e-12, rel_tol=0):
            out.append(("mix", "target_mix", "doesn't sum to 1"))
        if float(mix[CATEGORIES[3]]) > DOMAIN_SHARE:
            out.append(("mix", f"target_mix.{CATEGORIES[3]}", f"over {DOMAIN_SHARE}"))
    sources = at(payload, "sources")
    if not isinstance(sources, list) or not sources:
        return [*out, ("sources", "sources", "none")]
    seen: set[str] = set()
    for k, s in enumerate(sources):
        where = str(s.get("source_id", k)).strip() if isinstance(s, Mapping) else str(k)
        missing = [f for f in SOURCE_FIELDS if not isinstance(s, Mapping) or f not in s]
        if missing:
            out.append(("missing", where, ", ".join(missing)))
            continue
        blank = [f for f in SOURCE_FIELDS if (not str(s[f]).strip() if not isinstance(s[f], list) else not s[f])]
        if blank:
            out.append(("blank", where, ", ".join(blank)))
        if where in seen:
            out.append(("repeated_id", where, ""))
        seen.add(where)
        for f, known in (("license_audit_status", AUDIT_STATUS), ("acquisition_status", tuple(acquisition))):
            if s[f] not in known:
                out.append(("unknown_value", where, f"{f}={s[f]}"))
        if not set(s["categories"]) <= set(CATEGORIES):
            out.append(("unknown_value", where, "categories"))
    return out


def rights_contract(payload: Any, lanes: Mapping[str, str], pins: Mapping[str, Any]) -> list[Problem]:
    """A rights policy: the lane of every source, each source once, promotion only upwards, and pinned totals and hashes."""
    out = pinned(payload, {"schema_version": 1, **pins})
    sources = at(payload, "sources")
    have: dict[str, str] = {}
    for s in sources if isinstance(sources, list) else []:
        if s.get("source_id") in have:
            out.append(("repeated_id", str(s.get("source_id")), ""))
        have[s.get("source_id")] = s.get("rights_lane")
    out += [("lane", k, f"{have.get(k)}, not {v}") for k, v in lanes.items() if have.get(k) != v]
    out += [("unknown_source", str(k), "") for k in have if k not in lanes]
    promotions = at(payload, "promotion")
    if promotions is not MISSING:
        allowed = {(a, b) for b, visible in VISIBLE.items() for a in visible}
        out += [("promotion", f"{a}>{b}", "not allowed") for a, b in map(tuple, promotions) if (a, b) not in allowed]
    return out


def location(uri: str, namespace: str) -> str:
    """An address in external storage; anything else may not be recorded."""
    prefix = f"external://{namespace}/"
    if not isinstance(uri, str) or not uri.startswith(prefix) or uri == prefix or any(p in ("", ".", "..") for p in uri[len(prefix) :].rstrip("/").split("/")):
        raise ContractError(f"not an address in {namespace}: {uri}")
    return uri


def seal_report(report: Mapping[str, Any], registry: str, registry_path: str, storage: str, namespace: str, tokenizer: Mapping[str, str], mixture: Mapping[str, Any]) -> dict:
    """A manifest's report with its storage, the digest of its registry, tokenizer and mixture; it authorises nothing."""
    place = location(storage, namespace).rstrip("/")
    if not registry_path:
        raise ContractError("the registry needs a path to be shown under")
    return {
        **report, "decisions": {**report["decisions"], "storage": f"{place}/{report['decisions']['path']}"}, "input_registry": {"path": registry_path, "sha256": file_digest(registry)[1]},
        "tokenizer_model": dict(tokenizer), "global_cross_source_dedup_applied": True, "mixture": dict(mixture), "summary_storage": f"{place}/summary.json", "pretraining_authorized": False,
    }


def verify_files(files: Iterable[tuple[str, int | None, str]]) -> list[Problem]:
    """(path, bytes or None, sha256) of files that are missing or other than pinned, each read again."""
    out = []
    for path, size, sha in files:
        try:
            file_digest(path, size, sha)
        except FileNotFoundError:
            out.append(("missing_file", path, ""))
        except ValueError:
            out.append(("changed_file", path, ""))
    return out


def _pin(root: str, path: str) -> dict:
    """Path and digest of a file of the repository."""
    whole = os.path.realpath(os.path.join(root, path))
    if os.path.isabs(path) or os.path.commonpath([whole, os.path.realpath(root)]) != os.path.realpath(root):
        raise ContractError(f"{path} isn't a path within the repository")
    return {"path": path, "sha256": file_digest(whole)[1]}


def build_freeze(root: str, registry: str, report: str, lane: str) -> dict:
    """What may be trained on: pins of registry, report, decisions and tokenizer; only for a lane whose mixture is ready."""
    with open(os.path.join(root, report), encoding="utf-8") as f:
        body = json.load(f)
    if lane not in VISIBLE or at(body, f"mixture.{lane}.ready") is not True:
        raise ContractError(f"the mixture of {lane} isn't ready")
    return {
        "schema_version": 1, "checkpoint_lane": lane, "optimizer_steps_completed": 0, "checkpoint_lane_immutable_after_first_optimizer_step": True,
        "source_manifest": _pin(root, registry), "global_manifest_report": _pin(root, report), "tokenizer": dict(body["tokenizer_model"]),
        "evaluation_manifest": {
            "frozen": True, "validation_partition": "validation", "final_holdout_partition": "holdout", "pretraining_fit_partitions": ["train"],
            "tokenizer_fit_must_exclude_holdout": True, "model_fit_must_exclude_holdout": True, "decisions_sha256": body["decisions"]["sha256"],
        },
        "automatic_export_allowed": False, "public_release_eligibility": ELIGIBILITY[lane], "pretraining_authorized": True,
    }


def check_freeze(freeze: Any, root: str, namespace: str, distance: int = 3) -> list[Problem]:
    """Everything in a freeze that doesn't hold, or that its registry and report don't agree with."""
    lane = at(freeze, "checkpoint_lane")
    out = [] if lane in VISIBLE else [("lane", "checkpoint_lane", str(lane))]
    out += pinned(freeze, {
        "schema_version": 1, "optimizer_steps_completed": 0, "checkpoint_lane_immutable_after_first_optimizer_step": True, "evaluation_manifest.frozen": True,
        "evaluation_manifest.validation_partition": "validation", "evaluation_manifest.final_holdout_partition": "holdout", "evaluation_manifest.pretraining_fit_partitions": ["train"],
        "evaluation_manifest.tokenizer_fit_must_exclude_holdout": True, "evaluation_manifest.model_fit_must_exclude_holdout": True, "automatic_export_allowed": False,
        "public_release_eligibility": ELIGIBILITY.get(lane, ""), "pretraining_authorized": True,
    }, "freeze")
    files: dict[str, Any] = {}
    for name in ("source_manifest", "global_manifest_report"):
        try:
            have = _pin(root, str(at(freeze, f"{name}.path")))
            if have["sha256"] != at(freeze, f"{name}.sha256"):
                out.append(("changed_file", name, have["path"]))
            with open(os.path.join(root, have["path"]), encoding="utf-8") as f:
                files[name] = json.load(f)
        except (ContractError, FileNotFoundError, ValueError) as e:
            out.append(("missing_file", name, str(e)))
    if len(files) < 2:
        return out
    registry, report = files["source_manifest"], files["global_manifest_report"]
    out += pinned(registry, {"schema_version": 1, "near_duplicate_hamming_distance": distance, "pretraining_authorized": False}, "registry")
    lanes = {row.get("rights_lane") for row in at(registry, "inputs") or [] if isinstance(row, Mapping)} if isinstance(at(registry, "inputs"), list) else set()
    if not lanes or lane not in VISIBLE or not lanes <= set(VISIBLE[lane]):
        out.append(("lane", "inputs", ", ".join(sorted(map(str, lanes)))))
    decisions = at(freeze, "evaluation_manifest.decisions_sha256")
    out += pinned(report, {
        "schema_version": 1, "global_cross_source_dedup_applied": True, "pretraining_authorized": False, "input_registry.path": at(freeze, "source_manifest.path"),
        "input_registry.sha256": at(freeze, "source_manifest.sha256"), "tokenizer_model": at(freeze, "tokenizer"), "decisions.contains_raw_text": False, "decisions.sha256": decisions,
        f"mixture.{lane}.ready": True, **{f"mixture.{lane}.{g}": 0 for g in GAPS},
    }, "report")
    if not sha256_text(decisions):
        out.append(("bad_sha256", "evaluation_manifest.decisions_sha256", str(decisions)))
    if not str(at(report, "decisions.storage")).startswith(f"external://{namespace}/"):
        out.append(("storage", "decisions.storage", str(at(report, "decisions.storage"))))
    return out


def tokenizer_gate(benchmark: DataFrame, size: Column | int, expected: int) -> DataFrame:
    """(rule, id, detail) of what keeps a tokenizer from use: another vocabulary size, texts it doesn't give back, unknown tokens.

    ``benchmark``: candidate_tokens, roundtrip_failures and unk_tokens of one or more groups.
    """
    total = benchmark.agg(F.coalesce(F.sum("roundtrip_failures"), F.lit(0)).alias("failures"), F.coalesce(F.sum("unk_tokens"), F.lit(0)).alias("unknown"))
    size = F.lit(size) if isinstance(size, int) else size
    rules = F.array(
        F.struct(F.lit("vocabulary_size").alias("rule"), size.cast("bigint").alias("have"), F.lit(expected).cast("bigint").alias("want")),
        F.struct(F.lit("round_trip").alias("rule"), F.col("failures").cast("bigint").alias("have"), F.lit(0).cast("bigint").alias("want")),
        F.struct(F.lit("unknown_tokens").alias("rule"), F.col("unknown").cast("bigint").alias("have"), F.lit(0).cast("bigint").alias("want")),
    )
    return total.select(F.inline(rules)).where("have <> want").select("rule", F.lit("tokenizer").alias("id"), F.col("have").cast("string").alias("detail"))
