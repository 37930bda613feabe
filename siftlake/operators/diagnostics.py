"""What a scan read, lost and gave up: counted in one pass over its lines and one over its hits, put together on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ScanConfig
from .tokenize import json_outcome, wants_json

#: Files with an error that a report names, at most.
FILES_NAMED = 50


@dataclass(frozen=True)
class Diagnostics:
    lines: int = 0
    blank: int = 0
    oversized: int = 0
    replaced: int = 0  # characters that could not be decoded
    undecodable_files: int = 0
    json_candidates: int = 0
    json_parsed: int = 0
    json_failed: int = 0
    rejected: dict[str, int] = field(default_factory=dict)
    timeouts: dict[str, int] = field(default_factory=dict)
    dropped: dict[str, int] = field(default_factory=dict)  # values beyond the cap, by pattern
    file_errors: tuple[tuple[str, str], ...] = ()
    limit: str = ""  # the first limit that was met

    def merged(self, other: Diagnostics) -> Diagnostics:
        """Of two scans: counts are added, errors listed one after the other, and the first limit is kept."""
        out = {}
        for name in self.__dataclass_fields__:
            a, b = getattr(self, name), getattr(other, name)
            if isinstance(a, dict):
                out[name] = {k: a.get(k, 0) + b.get(k, 0) for k in sorted({*a, *b})}
            else:
                out[name] = a or b if isinstance(a, str) else a + b
        return Diagnostics(**out)

    @property
    def lossy(self) -> bool:
        """Whether something that was to be scanned was not."""
        return bool(self.file_errors or self.timeouts or self.undecodable_files or self.limit)

    def report(self) -> list[str]:
        """Lines of a report; nothing of what went well."""
        out = [f"{name}: {n}" for name, n in (("Ueberlange Zeilen", self.oversized), ("Nicht dekodierbare Zeichen", self.replaced)) if n]
        if self.json_candidates:
            out.append(f"JSON-Zeilen: {self.json_candidates} ({self.json_parsed} gelesen, {self.json_failed} fehlerhaft)")
        for name, counts in (("Verworfene Kandidaten", self.rejected), ("Zeitueberschreitungen", self.timeouts), ("Werte ueber der Grenze", self.dropped)):
            out += [f"{name}: {k}: {n}" for k, n in sorted(counts.items())]
        out += [f"Datei: {f}: {reason}" for f, reason in sorted(self.file_errors)[:FILES_NAMED]]
        if len(self.file_errors) > FILES_NAMED:
            out.append(f"... und {len(self.file_errors) - FILES_NAMED} weitere Dateien")
        return out + ([f"Grenze erreicht: {self.limit}"] if self.limit else [])


def line_counts(lines: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """One row of counts over lines (file, line, and oversized and replaced where they are known)."""
    line, have = F.col("line"), set(lines.columns)
    outcome = F.when(wants_json(line, config.parse_json), json_outcome(line))
    said = {
        "lines": F.count(F.lit(1)), "blank": F.count_if(line == ""), "oversized": F.count_if("oversized") if "oversized" in have else F.lit(0),
        "replaced": F.coalesce(F.sum("replaced"), F.lit(0)) if "replaced" in have else F.lit(0),
        "undecodable_files": F.count_distinct(F.when(F.col("replaced") > 0, F.col("file"))) if "replaced" in have else F.lit(0),
        "json_candidates": F.count(outcome), "json_parsed": F.count_if(outcome == "parsed"), "json_failed": F.count_if(outcome == "failed"),
    }
    return lines.agg(*[c.cast("long").alias(n) for n, c in said.items()])
