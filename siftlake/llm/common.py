"""What the training-data operators share: tables, the shared folder, identity of names."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables under sf_dir, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the cluster sets it.
    Only in local mode, as in tests, an unset one is replaced by a temporary folder, once a session: a machine's own
    folder is of no use to the others of a cluster."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = f"file://{tempfile.mkdtemp(prefix='siftlake-')}"
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/siftlake-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage with a Parquet table in the shared folder; a lost executor costs no more than a reread."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(col: str | Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def quoted(name: str) -> str:
    """A column's name as SQL and schema strings take it, whatever it contains."""
    return "`" + name.replace("`", "``") + "`"


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores in front as long as a column (of any case) has them."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def text_hash(text: str | Column) -> Column:
    """With an id, names a row's text."""
    return F.xxhash64(text_of(text))


def without(docs: DataFrame, dropped: DataFrame, once: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose (id, text_hash) is in dropped, and with one of the rows of each pair in once. Both are written
    tables of two columns: Spark knows their sizes and broadcasts them only if they are small, and then no text moves. Rows of a
    pair in once are folded where they are read, so a pair may have any number of them."""
    h, i, n, r = unused(docs.columns, "hash", "gone_id", "gone_hash", "row")
    keyed = docs.withColumn(h, text_hash(F.col(quoted(text_col))))
    same = F.col(quoted(id_col)).eqNullSafe(F.col(i)) & (F.col(h) == F.col(n))
    rest = keyed.join(dropped.unionByName(once).toDF(i, n), same, "left_anti").select(*map(quoted, docs.columns))
    if once.isEmpty():
        return rest
    rows = keyed.join(once.toDF(i, n), same, "left_semi")
    first = rows.groupBy(quoted(id_col), h).agg(F.first(F.struct(*map(quoted, docs.columns))).alias(r)).select(f"{r}.*")
    return rest.unionByName(first)


#: Bytes of an Arrow batch that goes to or from a Python worker, at most (one longer text makes a batch of its own).
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small in this session, so a worker's memory doesn't follow the length of texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m")
    if now.rstrip("b").isdigit() and 0 < int(now.rstrip("b")) <= BATCH_BYTES:
        return
    spark.conf.set(key, str(BATCH_BYTES))


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for workers that live on after a task: what it is done with goes back to the machine at its end."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim:
            trim(0)

    return wrapped
