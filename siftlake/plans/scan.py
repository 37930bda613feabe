"""A whole scan: inputs to findings, summary, matrix, diagnostics, reports, sheets and status."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, shipped
from ..config import ScanConfig
from ..functions.text import severity_text
from ..operators import findings as R
from ..operators.detect import detect, findings, rejected_counts, timeouts
from ..operators.diagnostics import Diagnostics, line_counts
from ..sources.lines import from_table, read_logs, spread


@dataclass
class Scan:
    lines: DataFrame
    detected: DataFrame
    config: ScanConfig
    catalog: Catalog
    files: DataFrame | None = None

    @property
    def found(self) -> DataFrame:
        return findings(self.detected)

    @property
    def found_with_others(self) -> DataFrame:
        """The findings with the values found around each, for what is masked."""
        return findings(detect(self.lines, self.catalog, self.config, others=True))

    @property
    def mask(self) -> str | None:
        return self.config.anon_muster if self.config.anon else None

    def summary(self) -> DataFrame:
        return R.summary(self.found, self.config.examplecount, self.mask)

    def matrix(self) -> DataFrame:
        return R.severity_matrix(self.summary(), self.config.critical)

    def rejected(self) -> DataFrame:
        return rejected_counts(self.detected)

    def to_write(self) -> DataFrame:
        """The findings as they may be stored: masked, unless values are asked for."""
        return R.masked(self.found_with_others, self.mask) if self.mask else self.found

    def report(self) -> list[str]:
        """The report's lines: one per rule, and in the full view one for each value that is shown, so they fit the driver."""
        rows = R.with_rules(self.summary().where(F.col("krit") <= self.config.critical), self.catalog)
        said = R.report_lines(rows, self.config.showskipped).orderBy(F.col("ord").asc_nulls_last(), "pattern").collect()
        under: dict[str, list[str]] = {}
        if self.config.full:
            for r in R.report_entries(self.found_with_others if self.mask else self.found, self.config.examplecount, self.mask).orderBy("pattern", "n").collect():
                under.setdefault(r["pattern"], []).append(r["text"])
        return [x for r in said for x in (r["text"], *under.get(r["pattern"], ()))] or ["Keine kritischen Daten gefunden."]

    def diagnostics(self) -> Diagnostics:
        """Counts of a scan; one small row and a row per pattern reach the driver, and a row per unreadable file."""
        n = line_counts(self.lines, self.config).first().asDict()
        pairs = lambda df: {r[0]: r[1] for r in df.collect()}
        errors = () if self.files is None else tuple((r["file"], r["reason"]) for r in self.files.where("status <> 'ok'").collect())
        dropped = pairs(R.dropped_values(self.found, self.config))
        return Diagnostics(**n, rejected=pairs(self.rejected()), timeouts=pairs(timeouts(self.detected)), dropped=dropped, file_errors=errors, limit="max_values_per_pattern" if dropped else "")

    def statistics(self, diagnostics: Diagnostics, seconds: float | None = None) -> list[str]:
        """The statistics block: inputs, findings by severity and kind, what is hidden, lines, and the speed if the time is given."""
        kinds = ("regexp", "field", "string")
        rows = {r["krit"]: r for r in R.severity_matrix(self.summary(), self.config.critical).collect()}
        shown = [k for k in range(1, 6) if k <= self.config.critical]
        out = ["Statistik"] + ([] if self.files is None else [f"Logdateien: {self.files.where(F.col('status') == 'ok').count()}"])
        count = lambda k, kind: rows[k][kind] if k in rows else 0
        out += [f"Prio {k} ({severity_text(k)}): {sum(count(k, x) for x in kinds)} ({'/'.join(str(count(k, x)) for x in kinds)} {'/'.join(kinds)})" for k in shown]
        hidden = sum(r["total"] for k, r in rows.items() if k > self.config.critical)
        out += [f"Ausgeblendet: {hidden} (Prio > {self.config.critical})"] if hidden else []
        out += [f"Total: {sum(count(k, x) for k in shown for x in kinds)}", f"Pre-Filter: {self.config.prefilter}", f"Zeilen: {diagnostics.lines}"]
        if seconds is not None:
            out += [f"Zeilen / sec: {int(diagnostics.lines / seconds) if seconds > 0 else 0}", f"Dauer: {format_duration(seconds)}"]
        return out

    def sheets(self) -> dict[str, DataFrame]:
        """The workbook's sheets by name."""
        mask = self.config.anon_muster if self.config.excelanon else None
        found = R.summary(self.found, self.config.examplecount, mask)
        spark, rules = self.lines.sparkSession, self.catalog.frame(self.lines.sparkSession).orderBy("ord")
        about = [("Kritikalitaet bis", str(self.config.critical)), ("Beispiele", str(self.config.examplecount)), ("Maskierung", mask or "keine"), ("Regeln", str(len(self.catalog.rules)))]
        about += [(f"Quelle {n}", digest) for n, digest in self.catalog.sources]
        out = {
            "Findings": R.findings_sheet(found, self.config.critical),
            "Full": R.full_sheet(self.found_with_others if mask else self.found, self.config.examplecount, self.config.critical, mask),
            "Tool": spark.createDataFrame(about, "Angabe string, Wert string"),
        }
        for name, kind, more in (("Regexp", "regexp", [F.col("regex").alias("Ausdruck"), F.col("scope").alias("Bereich")]), ("Field", "field", [F.col("regex").alias("Ausdruck"), F.col("value_offset").alias("Abstand")]), ("String", "string", [])):
            out[name] = rules.where(F.col("kind") == kind).select(F.col("name").alias("Muster"), F.col("krit").alias("Kritikalitaet"), F.col("description").alias("Beschreibung"), *more)
        return out

    def status(self, diagnostics: Diagnostics | None = None) -> tuple[str, int]:
        """(status, exit code): failed, partial or complete. Lines that a policy left out, characters that could not be decoded and rules
        that ran out of time make a scan partial."""
        lossy = bool(diagnostics and (diagnostics.timeouts or diagnostics.replaced))
        if self.files is None:
            return R.scan_status(1, 0, 0, int(lossy))
        n = {r["status"]: r["count"] for r in self.files.groupBy("status").count().collect()}
        touched = self.lines.where("oversized").select("file").distinct().count() if self.config.oversized_line_policy != "truncate" else 0
        return R.scan_status(n.get("ok", 0) - touched, touched, 0, int(lossy) + len(self.catalog.warnings))


def format_duration(seconds: float) -> str:
    """m min s sec."""
    return f"{int(seconds) // 60} min {int(seconds) % 60} sec."


def status_report(catalog: Catalog, config: ScanConfig) -> list[str]:
    """Settings and rules, without a scan."""
    out = [f"{k} = {v}" for k, v in config.as_dict().items()]
    for kind in ("regexp", "field", "string"):
        rules = [r for _, r in catalog.of(kind)]
        out.append(f"{kind}: {len(rules)} Regeln")
        out += [f"  {r.name} [{severity_text(r.krit)}]" + (f" {r.description}" if r.description else f" {len(r.values)} Eintraege") for r in rules]
    return out + [f"Quelle {n}: {d}" for n, d in catalog.sources] + [f"Warnung: {w}" for w in catalog.warnings]


def scan_table(df: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), catalog: Catalog | None = None, config: ScanConfig = ScanConfig(), file_col: str | None = None) -> Scan:
    catalog = catalog or shipped(config.minlen)
    lines = from_table(spread(df), text_col, keep, file_col)
    return Scan(lines, detect(lines, catalog, config), config, catalog)


def scan_logs(spark: SparkSession, patterns: Sequence[str], catalog: Catalog | None = None, config: ScanConfig = ScanConfig()) -> Scan:
    catalog = catalog or shipped(config.minlen)
    lines, files = read_logs(spark, patterns, config)
    return Scan(lines, detect(lines, catalog, config), config, catalog, files)
