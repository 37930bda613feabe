"""Reports, diagnostics, statistics, sheets and the command line."""

import os
import re
import stat

import pytest
from pyspark.sql import functions as F

from siftlake import cli
from siftlake.catalog import from_files, shipped
from siftlake.config import ConfigError, ScanConfig, ini_files
from siftlake.operators import findings as R
from siftlake.operators.diagnostics import Diagnostics, line_counts
from siftlake.plans.queries import GOLD
from siftlake.plans.scan import format_duration, scan_logs, scan_table

SECRET = "Sup3rSecret9"


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    d = tmp_path_factory.mktemp("logs")
    (d / "a.log").write_text(f"login password={SECRET} for alice@example.com\n\n{{\"user\": \"bob\"}}\n{{broken\nalice@example.com und Alice@example.com\nkarte 4111 1111 1111 1112\n", encoding="utf-8")
    (d / "b.bin").write_bytes(b"\0\1" * 50)
    return d


def test_diagnostics_and_statistics(spark, logs):
    scan = scan_logs(spark, [f"file://{logs}/*"])
    d = scan.diagnostics()
    assert (d.lines, d.blank, d.json_candidates, d.json_parsed, d.json_failed) == (6, 1, 2, 1, 1)
    assert d.rejected == {"Kreditkarte": 1} and len(d.file_errors) == 1 and "binary content" in d.report()[-1] and d.lossy
    said = "\n".join(scan.statistics(d, 2.0))
    assert "Zeilen: 6" in said and "Zeilen / sec: 3" in said and "0 min 2 sec." in said and "Ausgeblendet" not in said
    low = scan_logs(spark, [f"file://{logs}/a.log"], config=ScanConfig(critical=1))
    assert any(re.match(r"Ausgeblendet: [1-9]", x) for x in low.statistics(low.diagnostics()))
    both = d.merged(d)
    assert both.lines == 12 and both.rejected == {"Kreditkarte": 2} and len(both.file_errors) == 2
    assert Diagnostics(limit="x").merged(Diagnostics(limit="y")).limit == "x" and format_duration(125) == "2 min 5 sec."
    assert len(Diagnostics(file_errors=tuple((f"f{i:03}", "x") for i in range(60))).report()) == 51


def test_rules_that_run_out_of_time_make_a_scan_partial(spark):
    from siftlake.catalog import from_tuples

    df = spark.createDataFrame([(i, "a" * (45 + i) + "!") for i in range(12)], "doc_id long, text string")
    scan = scan_table(df, catalog=from_tuples([("bad", 1, "", "(a|aa)+$", "line")]), config=ScanConfig(regex_timeout_ms=50, regex_disable_threshold=3))
    d = scan.diagnostics()
    assert d.timeouts["bad"] >= 3 and scan.status(d) == ("partial", 3) and scan.found.count() == 0


def test_full_view(spark, logs):
    scan = scan_logs(spark, [f"file://{logs}/a.log"], config=ScanConfig(full=True, show_sensitive_values=True))
    lines = scan.report()
    assert any(f">>>{SECRET}<<<" in x and "[FELD:" in x for x in lines)
    assert any(x.count(">>>Alice@example.com<<<") == 2 for x in lines)  # in its first line, the other spelling too
    hidden = "\n".join(scan_logs(spark, [f"file://{logs}/a.log"], config=ScanConfig(full=True)).report())
    assert SECRET not in hidden and "alice@example.com" not in hidden.lower()


def test_spans_are_merged(spark):
    got = spark.range(1).select(R.merged_spans(F.array(F.lit(9), F.lit(0), F.lit(2), F.lit(3)), F.lit(2)).alias("m")).first()["m"]
    assert [tuple(x) for x in got] == [(0, 5), (9, 11)]
    row = spark.createDataFrame([("xaaay aa", "aa", 1, 3)], "t string, v string, s int, e int").select(R.highlight(F.col("t"), F.col("v"), F.lit("#"), F.col("s"), F.col("e"))).first()[0]
    assert row == "x#ay #"  # its known place within a word, and where it stands alone


def test_sheets(spark, logs):
    sheets = scan_logs(spark, [f"file://{logs}/a.log"]).sheets()
    assert list(sheets) == ["Findings", "Full", "Tool", "Regexp", "Field", "String"]
    assert sheets["Regexp"].count() == 35 and sheets["Field"].count() == 20 and sheets["String"].count() == 4
    assert SECRET not in str(sheets["Full"].collect()) + str(sheets["Findings"].collect()) and sheets["Tool"].count() >= 4


def test_stored_findings_are_masked(spark, logs, tmp_path, capsys):
    assert cli.main([f"file://{logs}/a.log", "--findings", f"{tmp_path}/f", "--logresult", f"{tmp_path}/r.txt", "--exit-on-findings"]) == 1
    stored = spark.read.parquet(f"{tmp_path}/f")
    assert stored.count() > 3 and "line" not in stored.columns
    for text in (str(stored.collect()), capsys.readouterr().out, (tmp_path / "r.txt").read_text()):
        assert SECRET not in text and "alice@example" not in text.lower()
    assert stat.S_IMODE(os.stat(tmp_path / "r.txt").st_mode) == 0o600 and "Statistik" in (tmp_path / "r.txt").read_text()
    assert cli.main([f"file://{logs}/a.log", "--findings", f"{tmp_path}/g", "--show-sensitive-values", "--logresultanon", f"{tmp_path}/anon.txt"]) == 0
    assert SECRET in str(spark.read.parquet(f"{tmp_path}/g").collect()) and SECRET not in (tmp_path / "anon.txt").read_text()


def test_command_line(logs, tmp_path, capsys, monkeypatch):
    (tmp_path / "r.csv").write_text("Auftrag::2::Auftragsnummer::A-\\d{4}::token\nkaputt::1::x::(\n")
    (tmp_path / "c.ini").write_text("[defaults]\ncritical = 3\n[files]\nregexp = r.csv\n")
    assert cli.main(["--status", "--config", f"{tmp_path}/c.ini"]) == 0
    out = capsys.readouterr()
    assert "Auftrag [hoch] Auftragsnummer" in out.out and "critical = 3" in out.out and "kaputt" in out.err and "field: 20 Regeln" in out.out
    assert cli.main(["--print-effective-config", "--critical", "2"]) == 0 and "critical = 2" in capsys.readouterr().out
    assert cli.main([]) == 2 and cli.main(["x", "--config", "/none.ini"]) == 2
    (tmp_path / "bad.ini").write_text("[files]\nnonsense = x\n")
    assert cli.main(["x", "--config", f"{tmp_path}/bad.ini"]) == 2
    (tmp_path / "t.log").write_text("Auftrag A-1234 offen\n")
    assert cli.main([f"file://{tmp_path}/t.log", "--config", f"{tmp_path}/c.ini", "--no-anon"]) == 3  # a rule was left out
    assert "[regexp] [hoch] Auftrag: A-1234" in capsys.readouterr().out
    assert cli.main([f"file://{logs}/*"]) == 0 and cli.main([f"file://{tmp_path}/none*"]) == 4
    monkeypatch.setattr(cli, "scan_logs", lambda *a: 1 / 0)
    assert cli.main(["x"]) == 5
    with pytest.raises(ConfigError):
        ini_files("[files]\nx = y\n")
    assert from_files({"regexp": "../x.csv"}, tmp_path).warnings and len(from_files({}, tmp_path).rules) == len(shipped().rules)


def test_quality_by_kind(spark):
    gold = spark.createDataFrame([(0, "email"), (0, "Passwort"), (1, "email")], "line_id int, pattern string")
    fired = spark.createDataFrame([(0, "email"), (2, "email"), (0, "Passwort"), (0, "PLZ")], "line_id int, pattern string")
    got = {r["kind"]: (r["tp"], r["fp"], r["fn"], r["precision"]) for r in R.quality_by_kind(gold, fired, shipped()).collect()}
    assert got == {"regexp": (1, 1, 1, 0.5), "field": (1, 0, 0, 1.0)} and len(GOLD) == 15


def test_line_counts_of_a_plain_table(spark):
    df = spark.createDataFrame([("",), ("x",), ('{"a": 1}',)], "line string")
    assert line_counts(df, ScanConfig(parse_json="false")).first()["json_candidates"] == 0
    assert line_counts(df.limit(0)).first()["lines"] == 0
