"""Where lines come from: any table with a text column, or log files in any store Spark reads."""

from __future__ import annotations

import codecs
import os
import stat
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import ScanConfig
from ..functions.text import strip

HEAD = 4096
#: Threads that look at heads of files.
LOOKERS = 32
_TEXT = bytes(range(32, 127)) + b"\r\n\t\f\b\x1b"
_BOMS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))


#: Bytes a core of a table that is dealt over all cores before it is scanned. A small file may be one row group, which one task reads whole;
#: larger tables have many, and stay as they lie.
SPREAD = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it is so small (by the plan's statistics) that its files may keep most of them idle."""
    if df.isStreaming or not hasattr(df, "_jdf"):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(4 * cores) if size <= SPREAD * cores else df


def from_table(df: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), file_col: str | None = None) -> DataFrame:
    """One row per line of a text: the kept columns, file, line_no (from 1) and line (stripped). Null text has no lines. Narrow."""
    text = F.split(F.col(text_col), "\r?\n", -1)
    rows = df.select(*keep, (F.col(file_col) if file_col else F.lit("")).alias("file"), F.posexplode(text).alias("_n", "_l"))
    return rows.select(*keep, "file", (F.col("_n") + 1).cast("long").alias("line_no"), strip(F.col("_l")).alias("line"))


def classify(path: str, follow_symlinks: bool = False) -> str | None:
    """Why a local path is no regular file; None if it is one."""
    try:
        if stat.S_ISLNK(os.lstat(path).st_mode) and not follow_symlinks:
            return "symlink"
        mode = os.stat(path).st_mode
    except OSError as e:
        return f"stat failed: {e}"
    return "directory" if stat.S_ISDIR(mode) else None if stat.S_ISREG(mode) else "not a regular file"


def encoding_of(head: bytes, requested: str = "auto") -> str:
    """By mark, or UTF-8 if the head is (a character cut at its end aside), or windows-1252."""
    if requested != "auto":
        return requested
    for mark, name in _BOMS:
        if head.startswith(mark):
            return name
    for cut in range(4 if len(head) >= HEAD else 1):
        try:
            head[: len(head) - cut].decode("utf-8")
            return "utf-8"
        except UnicodeDecodeError:
            continue
    return "windows-1252"


def looks_binary(head: bytes) -> bool:
    """NUL bytes or many control bytes, unless a mark or valid UTF-8 says text."""
    if any(head.startswith(m) for m, _ in _BOMS):
        return False
    if b"\0" in head:
        return True
    if not head or encoding_of(head) == "utf-8":
        return False
    return sum(b not in _TEXT for b in head) > 0.3 * len(head)


def expand(spark: SparkSession, patterns: Sequence[str]) -> list[str]:
    """The files that patterns name, each once, in order. Through Hadoop's file systems."""
    jvm, conf, found = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for p in patterns:
        path = jvm.org.apache.hadoop.fs.Path(p)
        for status in path.getFileSystem(conf).globStatus(path) or []:
            found.append(status.getPath().toString())
    return list(dict.fromkeys(found))


def head_of(spark: SparkSession, path: str) -> bytes:
    """The first bytes of a file in any store (of the content, if it is gzip)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        inner = jvm.java.util.zip.GZIPInputStream(stream) if path.endswith(".gz") else stream
        return bytes(inner.readNBytes(HEAD))
    finally:
        stream.close()


def inspect(spark: SparkSession, patterns: Sequence[str], config: ScanConfig = ScanConfig()) -> list[dict[str, str | None]]:
    """file, status (ok or skipped), reason and encoding of each input. The heads are read by many threads of the driver, as all that
    they wait for is the store; a file that cannot be read is skipped, with its reason."""

    def look(path: str) -> dict[str, str | None]:
        local = path.removeprefix("file:") if path.startswith("file:") else None
        reason, head = classify(local, config.follow_input_symlinks) if local else None, b""
        if not reason:
            try:
                head = head_of(spark, path)
            except Exception as e:  # noqa: BLE001  py4j wraps whatever the store says
                reason = f"unreadable: {str(e).splitlines()[0]}"
        if not reason and looks_binary(head):
            reason = "binary content"
        return {"file": path, "status": "skipped" if reason else "ok", "reason": reason, "encoding": None if reason else encoding_of(head, config.encoding)}

    with ThreadPoolExecutor(LOOKERS) as pool:
        return list(pool.map(look, expand(spark, patterns)))


def _numbered(raw: DataFrame) -> DataFrame:
    """Line numbers by file without moving lines: rows of a split are numbered in place, from the summed counts of the splits before."""
    at = raw.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_id": F.monotonically_increasing_id()})
    splits = at.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = at.join(splits, ["_file", "_block"])
    return joined.select(F.col("_file").alias("file"), (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias("line_no"), F.col("value").alias("line"))


def by_lines(encoding: str) -> str | None:
    """The characters of bytes 0 to 255 in an encoding of one byte a character that leaves ASCII as it is; None for others. Files in such
    an encoding are cut into lines as bytes, and so are read in splits like UTF-8."""
    try:
        table = "".join(bytes([b]).decode(encoding, "replace") for b in range(256))
    except LookupError:
        return None
    return table if len(table) == 256 and table[:128] == bytes(range(128)).decode("ascii") and codecs.lookup(encoding).name not in ("utf-8", "ascii") and len(set(table)) > 200 else None


def _decoded(raw: DataFrame, table: str) -> DataFrame:
    """Lines whose bytes are read by a table of characters."""
    latin = "".join(map(chr, range(128, 256)))
    text = F.decode(F.col("line").cast("binary"), "ISO-8859-1")
    return raw.withColumn("line", F.translate(text, latin, table[128:]))


def _decoder(encodings: dict[str, str], errors: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                data = content.as_py()
                data = gzip.decompress(data) if path.endswith(".gz") else data
                text = data.decode(encodings[path], "replace" if errors == "strict" else errors).removeprefix("﻿")
                lines = text.split("\n")
                lines = lines[:-1] if lines[-1] == "" else lines
                for at in range(0, len(lines), 10_000):
                    part = [x.rstrip("\r") for x in lines[at : at + 10_000]]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part), pa.string()), pa.array(range(at + 1, at + 1 + len(part)), pa.int64()), pa.array(part, pa.string())], names=["file", "line_no", "line"])

    return run


def read_logs(spark: SparkSession, patterns: Sequence[str], config: ScanConfig = ScanConfig()) -> tuple[DataFrame, DataFrame]:
    """(lines, files): lines as file, line_no, line (stripped), oversized, replaced (undecodable characters); files as file, status,
    reason, encoding. UTF-8 files and those of one byte a character are read in splits, gzip included; UTF-16 and UTF-32 file by file."""
    seen = inspect(spark, patterns, config)
    files = spark.createDataFrame([(f["file"], f["status"], f["reason"], f["encoding"]) for f in seen], "file string, status string, reason string, encoding string")
    plain = [f["file"] for f in seen if f["status"] == "ok" and f["encoding"] == "utf-8"]
    other = {f["file"]: f["encoding"] for f in seen if f["status"] == "ok" and f["encoding"] != "utf-8"}
    frames = []
    if plain:
        frames.append(_numbered(spark.read.option("lineSep", "\n").text(plain)))
    for encoding in sorted({e for e in other.values() if e}):
        if table := by_lines(encoding):
            paths = [f for f, e in other.items() if e == encoding]
            frames.append(_decoded(_numbered(spark.read.option("lineSep", "\n").text(paths)), table))
            other = {f: e for f, e in other.items() if e != encoding}
    if other:
        content = spark.read.format("binaryFile").load(list(other)).select("path", "content")
        frames.append(content.mapInArrow(_decoder(other, config.encoding_errors), "file string, line_no bigint, line string"))
    empty = spark.createDataFrame([], "file string, line_no bigint, line string")
    lines = frames[0] if frames else empty
    for more in frames[1:]:
        lines = lines.unionByName(more)
    lines = lines.withColumn("line", F.regexp_replace("line", "^﻿|\r+$", ""))
    return limit_lines(lines, config), files


def limit_lines(lines: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Over-long lines by policy: truncate them, skip them, or drop a file from the first one on (fail). Numbers stay physical.
    encoding_errors: ignore drops undecodable characters, strict drops a file from the first one on."""
    most = config.max_line_bytes
    over = F.octet_length("line") > most
    lines = lines.withColumns({"oversized": over, "replaced": F.regexp_count("line", F.lit("�"))})
    cut = F.make_valid_utf8(F.substring(F.col("line").cast("binary"), 1, most).cast("string"))
    lines = lines.withColumn("line", F.when(F.col("oversized"), cut).otherwise(F.col("line")))
    ends = [F.col("oversized")] if config.oversized_line_policy == "fail" else []
    ends += [F.col("replaced") > 0] if config.encoding_errors == "strict" else []
    if ends:
        bad = ends[0] if len(ends) == 1 else ends[0] | ends[1]
        first = lines.where(bad).groupBy("file").agg(F.min("line_no").alias("_end"))
        lines = lines.join(first, "file", "left").where("_end is null or line_no < _end").drop("_end")
    if config.oversized_line_policy == "skip":
        lines = lines.where(~F.col("oversized"))
    if config.encoding_errors == "ignore":
        lines = lines.withColumn("line", F.replace("line", F.lit("�"), F.lit("")))
    return lines.withColumn("line", strip(F.col("line")))
