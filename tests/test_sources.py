import gzip
import os

from siftlake.config import ConfigError, ScanConfig, load_ini
from siftlake.plans.scan import scan_logs, scan_table
from siftlake.sources.lines import classify, encoding_of, looks_binary, read_logs
from siftlake.streaming.stream import stream_findings, stream_lines, write_batches
from siftlake.catalog import shipped
import pytest


def test_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("eins a@bc.de\r\n\nzwei Straße\n" * 200, encoding="utf-8")
    (tmp_path / "b.log").write_bytes("größe x@yz.de\n".encode("windows-1252"))
    (tmp_path / "bin.log").write_bytes(b"\0\1\2" * 100)
    with gzip.open(tmp_path / "c.log.gz", "wt", encoding="utf-8") as f:
        f.write("drei q@rs.de\nvier\n")
    lines, files = read_logs(spark, [f"file://{tmp_path}/*"])
    by = {os.path.basename(r["file"]): r for r in files.collect()}
    assert by["bin.log"]["status"] == "skipped" and by["b.log"]["encoding"] == "windows-1252" and by["c.log.gz"]["encoding"] == "utf-8"
    got = {(os.path.basename(r["file"]), r["line_no"]): r["line"] for r in lines.collect()}
    assert got["a.log", 1] == "eins a@bc.de" and got["a.log", 600] == "zwei Straße" and got["a.log", 2] == ""
    assert got["b.log", 1] == "größe x@yz.de" and got["c.log.gz", 2] == "vier"


def test_numbers_over_splits(spark, tmp_path):
    (tmp_path / "n.log").write_text("".join(f"row {i}\n" for i in range(1, 20_001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines, _ = read_logs(spark, [f"file://{tmp_path}/n.log"])
        assert lines.rdd.getNumPartitions() > 3
        assert all(r["line"] == f"row {r['line_no']}" for r in lines.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_oversize_policies(spark, tmp_path):
    (tmp_path / "o.log").write_text("ok\n" + "ü" * 2000 + "\nlast\n")
    read = lambda p: [(r["line_no"], len(r["line"])) for r in read_logs(spark, [f"file://{tmp_path}/o.log"], ScanConfig(max_line_bytes=1025, oversized_line_policy=p))[0].orderBy("line_no").collect()]
    assert read("truncate")[1][1] in (512, 513) and read("skip") == [(1, 2), (3, 4)] and read("fail") == [(1, 2)]


def test_heads(tmp_path):
    os.symlink(tmp_path, tmp_path / "l")
    os.mkfifo(tmp_path / "p")
    assert classify(str(tmp_path / "l")) == "symlink" and classify(str(tmp_path)) == "directory" and classify(str(tmp_path / "p")) == "not a regular file"
    assert encoding_of(b"\xff\xfea\0") == "utf-16" and encoding_of(b"x" * 4095 + "ü".encode()[:1]) == "utf-8" and encoding_of(b"\xfc") == "windows-1252"
    assert looks_binary(b"a\0b") and not looks_binary("привет".encode()) and not looks_binary(b"")


def test_scan_and_report(spark, tmp_path):
    (tmp_path / "r.log").write_text("mail alice@example.com\nbob@example.org\n")
    scan = scan_logs(spark, [f"file://{tmp_path}/r.log"])
    assert scan.status() == ("complete", 0)
    assert any("[regexp] [niedrig] email: ali**@ex**ple**om, bob**xam**e.o**" == x for x in scan.report())
    assert scan.matrix().count() == 1 and scan.rejected().count() == 0
    assert scan_logs(spark, [f"file://{tmp_path}/none*"]).status() == ("failed", 4)


def test_tables(spark, sf):
    scan = scan_table(spark.read.parquet(f"{sf}/documents.parquet"), file_col="source")
    assert {r["pattern"] for r in scan.summary().collect()} >= {"email", "Kreditkarte"}


def test_streaming_is_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("mail alice@example.com\nnothing\n")
    got = []
    query = write_batches(stream_findings(stream_lines(spark, str(tmp_path / "in")), shipped()), lambda df, n: got.extend(r["value"] for r in df.collect()), str(tmp_path / "ck"), once=True)
    query.awaitTermination(120)
    assert got == ["alice@example.com"]


def test_config():
    c = load_ini("[defaults]\nexamplecount = 0\ncritical = 9\nparse_json = on\nsearch_feld = off\nworkers = 3\n")
    assert (c.examplecount, c.critical, c.parse_json, c.search_field) == (1, 5, "true", False)
    with pytest.raises(ConfigError):
        load_ini("[defaults]\nnonsense = 1\n")
    with pytest.raises(ConfigError):
        load_ini("[defaults]\nprefilter = maybe\n")
    assert load_ini("[defaults]\nminlen = x\nnonsense = 1\n", strict=False) == ScanConfig()
    assert ScanConfig(show_sensitive_values=True).anon is False
