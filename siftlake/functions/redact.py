"""Redaction by mask: s keeps a character, * or x hides one, groups repeat; <redacted> hides a value whole."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT_MASK


def compile_mask(mask: str) -> list[bool] | None:
    """Which places of a period are kept; None for a mask that hides the whole value."""
    if mask.strip().lower() == "<redacted>":
        return None
    keep = [c == "s" for c in re.sub("[^s*x]", "", mask)]
    return keep or compile_mask(DEFAULT_MASK)


def leading(keep: list[bool]) -> int:
    return next((i for i, k in enumerate(keep) if not k), len(keep))


def redact(value: Column, mask: str = DEFAULT_MASK) -> Column:
    """The value under the mask; values hardly longer than a kept beginning are hidden whole."""
    keep = compile_mask(mask)
    if keep is None:
        return F.when(value.isNotNull(), F.lit("<redacted>"))
    kept, n = F.array(*map(F.lit, keep)), F.char_length(value)
    shown = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(F.element_at(kept, i % len(keep) + 1), c).otherwise("*")), "")
    short = (n <= leading(keep) + 1) if keep[0] else F.lit(False)
    return F.when(n == 0, F.lit("")).when(short, F.repeat(F.lit("*"), n)).otherwise(shown)


def redact_text(value: str, mask: str = DEFAULT_MASK) -> str:
    """`redact` on the driver."""
    keep = compile_mask(mask)
    if keep is None:
        return "<redacted>"
    if keep[0] and len(value) <= leading(keep) + 1:
        return "*" * len(value)
    return "".join(c if keep[i % len(keep)] else "*" for i, c in enumerate(value))
