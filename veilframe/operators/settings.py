"""Scan settings from files: overrides (JSON), policies (TOML), profiles, and a registry for one's own functions."""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from veilframe.catalog.patterns import Pattern, catalogue
from veilframe.operators.protect import resolve_categories
from veilframe.operators.scan import ScanConfig

OVERRIDES_VERSION = 1
MOST_FILE_BYTES = 10 * 1024 * 1024
ACTIONS = ("block", "redact", "mask", "flag", "tokenize", "obfuscate", "reject", "report")


@dataclass(frozen=True)
class Overrides:
    disabled: frozenset[tuple[str, str]] = frozenset()
    fields: dict[tuple[str, str], dict] = field(default_factory=dict)
    custom: tuple[Pattern, ...] = ()
    lists: tuple[tuple[str, str, tuple[str, ...]], ...] = ()
    bindings: tuple[tuple[str, str], ...] = ()
    unique_limits: dict[str, int] = field(default_factory=dict)


def wire_key(text: str) -> tuple[str, str]:
    category, _, sub = text.partition("/")
    return category, sub


def read_overrides(raw: str) -> Overrides:
    """Overrides of a JSON document; a newer version than ours is refused."""
    data = json.loads(raw)
    if data.get("version", 1) > OVERRIDES_VERSION:
        raise ValueError(f"overrides of version {data['version']} are newer than {OVERRIDES_VERSION}")
    custom, n = [], 1_000_000
    for group in data.get("custom_categories", []):
        for p in group.get("patterns", []):
            custom.append(Pattern(n, group["name"], p["name"], p["regex"], p.get("specificity", 0.5), True, p.get("context_required", False), tuple(p.get("keywords", [])), p.get("proximity_chars", 50)))
            n += 1
    return Overrides(
        frozenset((d["category"], d["sub_category"]) for d in data.get("disabled_patterns", [])),
        {wire_key(k): v for k, v in data.get("pattern_overrides", {}).items()},
        tuple(custom),
        tuple((x["id"], x.get("kind", "other"), tuple(x.get("entries", []))) for x in data.get("lists", [])),
        tuple((b["list_id"], b["action"]) for b in data.get("active_list_bindings", [])),
        {k: int(v) for k, v in data.get("max_unique_per_subcategory", {}).items()},
    )


def apply_overrides(config: ScanConfig, overrides: Overrides) -> ScanConfig:
    """The configuration with changed regexes, specificities and gates, and with disabled patterns."""
    changed = []
    for p in config.patterns or catalogue():
        o = overrides.fields.get((p.category, p.sub_category), {})
        changed.append(replace(p, regex=o.get("regex", p.regex), specificity=o.get("specificity", p.specificity), context_required=o.get("context_required", p.context_required)))
    return replace(config, patterns=tuple(changed), disabled=config.disabled | overrides.disabled, unique_limits=tuple(sorted({**dict(config.unique_limits), **overrides.unique_limits}.items())))


@dataclass(frozen=True)
class Policy:
    name: str
    config: ScanConfig
    action: str
    rules: tuple[tuple, ...]
    warnings: tuple[str, ...]

    def rules_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(list(self.rules), "rule string, rule_no int, priority int, action string, categories array<string>, sub_categories array<string>, min_confidence double")


def read_policy(raw: str) -> Policy:
    """A policy of a TOML document; unknown actions become redact and are told in the warnings."""
    if len(raw.encode()) > MOST_FILE_BYTES:
        raise ValueError("policy is too large")
    data = tomllib.loads(raw)
    scan = data.get("scan", {})
    warnings = []

    def action(value: str) -> str:
        if value not in ACTIONS:
            warnings.append(f"unknown action {value}")
            return "redact"
        return value

    rules = tuple(
        (r.get("name", f"rule-{n}"), n, int(r.get("priority", 0)), action(r.get("action", "redact")), list(r.get("match_categories", [])), list(r["match_sub_categories"]) if r.get("match_sub_categories") else None, float(r.get("min_confidence", 0)))
        for n, r in enumerate(data.get("rules", []), 1)
    )
    config = ScanConfig(categories=resolve_categories(scan.get("presets", []), scan.get("categories", [])), require_context=bool(scan.get("require_context", False)), min_confidence=float(scan.get("min_confidence", 0)))
    return Policy(data.get("name", "policy"), config, action(scan.get("action", "redact")), rules, tuple(warnings))


def read_policies(folder: str) -> dict[str, Policy]:
    out = {}
    for name in sorted(os.listdir(folder)):
        if name.endswith(".toml"):
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                p = read_policy(f.read())
            out[p.name] = p
    return out


#: Masking profiles as presets, action and least confidence.
PROFILES = {
    "PCI_PRODUCTION": (("pci_dss",), "redact", 0.5), "PCI_DEVELOPMENT": (("pci_dss",), "flag", 0.5), "HIPAA_STRICT": (("healthcare", "pii", "ssn_sin"), "redact", 0.3), "HIPAA_REDACT": (("healthcare",), "redact", 0.5), "GDPR_COMPLIANCE": (("pii", "contact_info"), "redact", 0.4),
    "SOC2_SECRETS": (("credentials",), "reject", 0.5), "FULL_SCAN": ((), "flag", 0.0), "DEVELOPMENT": (("credentials",), "flag", 0.7), "CI_PIPELINE": (("credentials", "pci_dss"), "reject", 0.6),
}


def profile(name: str) -> tuple[ScanConfig, str]:
    presets, action, least = PROFILES[name]
    return ScanConfig(categories=resolve_categories(list(presets)), min_confidence=least), action


#: What each role may do.
ROLES = {"viewer": {"read"}, "analyst": {"read", "scan", "export"}, "operator": {"read", "scan", "export", "configure", "retain"}, "admin": {"read", "scan", "export", "configure", "retain", "audit", "administer"}}


def may(role: str, permission: str) -> bool:
    return permission in ROLES.get(role.lower(), set())


class Plugins:
    """Post-processors of findings, applied in order; one that fails is left out and reported."""

    def __init__(self) -> None:
        self.processors: list[Callable[[DataFrame], DataFrame]] = []
        self.failures: list[str] = []

    def register(self, processor: Callable[[DataFrame], DataFrame]) -> None:
        self.processors.append(processor)

    def apply(self, findings: DataFrame) -> DataFrame:
        for p in self.processors:
            try:
                findings = p(findings)
            except Exception as e:  # a plugin must not stop a scan
                self.failures.append(f"{getattr(p, '__name__', 'processor')}: {e}"[:200])
        return findings


def config_from_environment(environ: dict[str, str] | None = None, prefix: str = "VEILFRAME_") -> dict[str, str]:
    """Settings named by environment variables with the prefix, in lower case."""
    env = os.environ if environ is None else environ
    return {k.removeprefix(prefix).lower(): v for k, v in sorted(env.items()) if k.startswith(prefix)}
