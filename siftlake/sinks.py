"""Where results go. Frames are written by Spark; small reports as private local files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write(found: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """Findings as parquet, orc, json, or csv (structs as JSON strings)."""
    if kind == "csv":
        nested = [f.name for f in found.schema if f.dataType.typeName() in ("struct", "array", "map")]
        found = found.withColumns({c: F.to_json(c) for c in nested})
    found.write.mode(mode).format(kind).save(path)


def write_report(lines: list[str], path: str) -> None:
    """A text report that only its owner can read."""
    fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600)
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    os.chmod(path, 0o600)


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """Report-sized frames as sheets of a workbook; needs openpyxl."""
    try:
        from openpyxl import Workbook
    except ImportError as e:
        raise RuntimeError("writing workbooks needs openpyxl") from e
    book = Workbook()
    book.remove(book.active)
    for name, frame in sheets.items():
        sheet = book.create_sheet(name)
        sheet.append(frame.columns)
        for row in frame.toLocalIterator():
            sheet.append(list(row))
        sheet.auto_filter.ref = sheet.dimensions
        sheet.freeze_panes = "A2"
    book.save(path)
    os.chmod(path, 0o600)
