"""Rule documents over time, so that a scan can be repeated with the rules of its day."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from .ruleset import RuleSet

SCHEMA = "rule_version string, valid_from timestamp, valid_to timestamp"


@dataclass(frozen=True)
class RuleHistory:
    """Rule sets with the time from which each is in force, in order; the first also holds for earlier records."""

    versions: tuple[tuple[datetime, RuleSet], ...]

    @classmethod
    def of(cls, *versions: tuple[datetime, RuleSet]) -> RuleHistory:
        found = tuple(sorted(versions, key=lambda v: v[0]))
        if not found or len({v[0] for v in found}) < len(found) or len({v[1].rule_version for v in found}) < len(found):
            raise ValueError("a history needs versions of different names and times")
        return cls(found)

    def spans(self) -> list[tuple[datetime | None, datetime | None, RuleSet]]:
        """(from, to, rules); the first has no start, the last no end."""
        ends = [v[0] for v in self.versions[1:]] + [None]
        starts = [None, *ends[:-1]]
        return [(a, b, v[1]) for a, b, v in zip(starts, ends, self.versions, strict=True)]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """One row per version."""
        ends = [v[0] for v in self.versions[1:]] + [None]
        return spark.createDataFrame([(v.rule_version, at, end) for (at, v), end in zip(self.versions, ends, strict=True)], SCHEMA)


def load_history(spark: SparkSession, path: str) -> RuleHistory:
    """Read the rule documents of a folder; each states ``valid_from`` (ISO time) beside its rules."""
    docs = [json.loads(r[0]) for r in spark.read.text(path, wholetext=True).collect()]  # rule documents only
    return RuleHistory.of(*[(datetime.fromisoformat(d["valid_from"]), RuleSet.from_document(d)) for d in docs])
