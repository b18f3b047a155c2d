"""Rule sets: a small driver-side document that is turned into column expressions."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .defaults import DEFAULT_RULES


def _valid(pattern: str) -> bool:
    try:
        re.compile(pattern)
        return True
    except re.error:
        return False


@dataclass(frozen=True)
class RuleField:
    id: str
    label: str
    legal_ref: str
    severity: str
    patterns: tuple[str, ...]
    address_patterns: tuple[str, ...] = ()
    address_guards: tuple[str | None, ...] = ()
    description: str = ""

    def guarded_addresses(self) -> list[tuple[str | None, str]]:
        """(guard, pattern) pairs; a guard is a cheaper pattern that must also match."""
        guards = self.address_guards or (None,) * len(self.address_patterns)
        return list(zip(guards, self.address_patterns))

    def value_group(self, i: int) -> int:
        """1 if pattern ``i`` (0-based) has a capture group, else the whole match."""
        return 1 if re.compile(self.patterns[i]).groups else 0


@dataclass(frozen=True)
class RuleSet:
    rule_version: str
    fields: tuple[RuleField, ...] = field(default_factory=tuple)

    @classmethod
    def from_document(cls, doc: dict) -> RuleSet:
        """Build from the JSON layout; patterns that do not compile are left out."""
        def kept(f: dict) -> list[tuple[str, str | None]]:
            patterns = f.get("address_patterns", ())
            guards = f.get("address_guards") or [None] * len(patterns)
            return [(p, g) for p, g in zip(patterns, guards) if _valid(p)]

        return cls(
            doc["rule_version"],
            tuple(
                RuleField(
                    id=f["id"],
                    label=f["label"],
                    legal_ref=f["legal_ref"],
                    severity=f["severity"],
                    patterns=tuple(p for p in f.get("patterns", ()) if _valid(p)),
                    address_patterns=tuple(p for p, _ in kept(f)),
                    address_guards=tuple(g for _, g in kept(f)),
                    description=f.get("description", ""),
                )
                for f in doc["fields"]
            ),
        )

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """One row per (field, kind, position) with the pattern text."""
        rows = [
            (self.rule_version, f.id, f.label, f.legal_ref, f.severity, kind, ord_, pattern)
            for f in self.fields
            for kind, patterns in (("value", f.patterns), ("address", f.address_patterns))
            for ord_, pattern in enumerate(patterns, start=1)
        ]
        return spark.createDataFrame(
            rows,
            "rule_version string, field_id string, field_label string, legal_reference string, "
            "severity string, kind string, ord int, pattern string",
        )


def default_rules() -> RuleSet:
    return RuleSet.from_document(DEFAULT_RULES)


def load_rules(spark: SparkSession, path: str) -> RuleSet:
    """Read a rule document from any path Spark can reach; call once per batch to pick up edits."""
    return RuleSet.from_document(json.loads(spark.read.text(path, wholetext=True).first()[0]))
