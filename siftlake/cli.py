"""python -m siftlake.cli LOG... : scans log files and prints a report.

Exit codes: 0 complete, 1 findings (with --exit-on-findings), 2 bad call, 3 partial, 4 failed, 5 internal error."""

from __future__ import annotations

import argparse
import sys
import time
import traceback
from dataclasses import replace
from pathlib import Path

from pyspark.sql import SparkSession

from .catalog import Catalog, DuplicateRule, from_files, shipped
from .config import ConfigError, ScanConfig, ini_files, load_ini
from .plans.scan import scan_logs, status_report
from .sinks import write, write_report, write_workbook

#: The configuration that --use-local-config takes from the current folder.
LOCAL = "siftlake.ini"
_SWITCHES = ("anon", "full", "showskipped", "excelanon", "show_sensitive_values", "follow_input_symlinks")
_VALUES = {"examplecount": int, "critical": int, "minlen": int, "encoding": str, "encoding_errors": str, "prefilter": str, "parse_json": str, "anon_muster": str, "regex_timeout_ms": int}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftlake", description=__doc__)
    p.add_argument("logs", nargs="*")
    for name, kind in _VALUES.items():
        p.add_argument("--" + name.replace("_", "-"), dest=name, type=kind)
    for name in _SWITCHES:
        p.add_argument("--" + name.replace("_", "-"), dest=name, action=argparse.BooleanOptionalAction, default=None)
    p.add_argument("--config", help="INI file; rule files in its [files] lie in its folder")
    p.add_argument("--use-local-config", action="store_true", help=f"take {LOCAL} of the current folder")
    p.add_argument("--lenient-config", action="store_true")
    p.add_argument("--print-effective-config", action="store_true")
    p.add_argument("--status", action="store_true", help="show settings and rules, without a scan")
    p.add_argument("--nocolor", action="store_true", help="accepted; reports have no colours")
    p.add_argument("--verbose", action="store_true", help="print diagnostics of complete scans too")
    p.add_argument("--logresult", help="report file")
    p.add_argument("--logresultanon", help="report file, masked whatever else is asked for")
    p.add_argument("--xlsx", help="workbook; needs openpyxl")
    p.add_argument("--findings", help="folder for all findings as Parquet, masked unless --show-sensitive-values")
    p.add_argument("--continue-on-error", action="store_true", help="accepted; unreadable files never end a scan")
    p.add_argument("--exit-on-findings", action="store_true")
    return p


def settings(args: argparse.Namespace) -> tuple[ScanConfig, Catalog]:
    """Explicit values first, then the INI file, then defaults."""
    explicit = {k: getattr(args, k) for k in (*_VALUES, *_SWITCHES) if getattr(args, k) is not None}
    path = args.config or (LOCAL if args.use_local_config else None)
    if not path:
        config = replace(ScanConfig(), **explicit)
        return config, shipped(config.minlen)
    text = Path(path).read_text(encoding="utf-8")
    config, files = load_ini(text, not args.lenient_config, **explicit), ini_files(text, not args.lenient_config)
    return config, from_files(files, Path(path).resolve().parent, config.minlen) if files else shipped(config.minlen)


def run(args: argparse.Namespace) -> int:
    try:
        config, catalog = settings(args)
    except (ConfigError, DuplicateRule, OSError) as e:
        print(f"siftlake: {e}", file=sys.stderr)
        return 2
    for w in catalog.warnings:
        print(f"siftlake: {w}", file=sys.stderr)
    if args.print_effective_config:
        print("\n".join(f"{k} = {v}" for k, v in config.as_dict().items()))
        return 0
    if args.status:
        print("\n".join(status_report(catalog, config)))
        return 0
    if not args.logs:
        print("siftlake: no log files", file=sys.stderr)
        return 2
    began = time.perf_counter()
    scan = scan_logs(SparkSession.builder.getOrCreate(), args.logs, catalog, config)
    lines, diagnostics = scan.report(), scan.diagnostics()
    status, code = scan.status(diagnostics)
    tail = [*scan.statistics(diagnostics, time.perf_counter() - began), *(diagnostics.report() if args.verbose or status != "complete" else [])]
    print("\n".join([*lines, "", *tail]))
    head = [f"siftlake: {', '.join(args.logs)}", f"Status: {status}", ""]
    if args.logresult:
        write_report([*head, *lines, "", *tail], args.logresult)
    if args.logresultanon:
        hidden = replace(scan, config=replace(config, show_sensitive_values=False, anon=True))
        write_report([*head, *hidden.report(), "", *tail], args.logresultanon)
    if args.xlsx:
        write_workbook(scan.sheets(), args.xlsx)
    if args.findings:
        write(scan.to_write(), args.findings)
    return 1 if args.exit_on_findings and code == 0 and any(x.startswith("[") for x in lines) else code


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return run(args)
    except Exception:  # noqa: BLE001  a failure of the tool has a code of its own
        traceback.print_exc()
        return 5


if __name__ == "__main__":
    sys.exit(main())
