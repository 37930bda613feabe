"""From findings to reports: caps, order, summaries, sheets. All grouped or ranked by Spark; nothing here collects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import rules
from ..catalog import Catalog
from ..config import ScanConfig
from ..functions.redact import redact
from ..functions.text import sanitize_cell, severity_label

#: Order of discovery of findings across lines.
SEQ = ("file", "line_no", "seq")
#: Order of kinds in sheets.
KIND_ORDER = {"field": 0, "regexp": 1, "string": 2}


def cap(found: DataFrame, config: ScanConfig = ScanConfig(), order: tuple[str, ...] = SEQ) -> DataFrame:
    """First come, first kept: values per pattern, values in all, examples per value, examples in all; a value stays even where the
    last cap leaves it no example (n_examples 0 in `summary`). Adds value_rank and example_rank."""
    first = Window.partitionBy("pattern", "value").orderBy(*order)
    seen = found.withColumn("example_rank", F.row_number().over(first))
    values = seen.where("example_rank = 1").select("pattern", "value", *[F.col(c).alias(f"_{c}") for c in order])
    ranked = values.withColumn("value_rank", F.row_number().over(Window.partitionBy("pattern").orderBy(*[f"_{c}" for c in order])))
    ranked = ranked.where(F.col("value_rank") <= config.max_values_per_pattern)
    # at most max_values_per_pattern of each pattern are left for the one sort that all patterns share
    kept = ranked.orderBy(*[f"_{c}" for c in order], "pattern").limit(config.max_total_findings).select("pattern", "value", "value_rank")
    rows = seen.where(F.col("example_rank") <= config.max_examples_per_value).join(kept, ["pattern", "value"])
    return rows.orderBy(*order, "pattern").limit(config.max_total_examples)


def dropped_values(found: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """(pattern, n_dropped) of distinct values beyond the cap per pattern."""
    n = found.groupBy("pattern").agg(F.count_distinct("value").alias("n"))
    return n.where(F.col("n") > config.max_values_per_pattern).select("pattern", (F.col("n") - config.max_values_per_pattern).alias("n_dropped"))


#: File names of a pattern that a summary lists, at most; n_files counts them all.
MOST_FILES = ScanConfig().max_total_examples


def summary(found: DataFrame, examples: int = 10, mask: str | None = None, most_files: int = MOST_FILES) -> DataFrame:
    """One row per pattern: pattern, kind, krit, n_values, n_examples, sample_values (the first by code point), files (the first by
    code point), n_files, confidence. Values and files are folded before they move, and counted apart from the few that are listed: each task
    hands on only the first ones of a pattern, so no task sees all values of one."""
    values = found.groupBy("pattern", "kind", "krit", "value").agg(F.count(F.lit(1)).alias("n"), F.min_by(_rank(F.col("confidence")), F.struct(*SEQ)).alias("c"))
    counts = values.groupBy("pattern", "kind", "krit").agg(F.count(F.lit(1)).alias("n_values"), F.sum("n").alias("n_examples"))
    top = values.withColumn("rank", F.row_number().over(Window.partitionBy("pattern").orderBy("value"))).where(F.col("rank") <= examples)
    top = top.withColumn("shown", redact(F.col("value"), mask) if mask else F.col("value"))
    top = top.groupBy("pattern").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "shown"))), lambda x: x["shown"]).alias("sample_values"), F.max("c").alias("c"))
    files = found.select("pattern", "file").distinct()
    listed = files.withColumn("rank", F.row_number().over(Window.partitionBy("pattern").orderBy("file"))).where(F.col("rank") <= most_files)
    listed = listed.groupBy("pattern").agg(F.array_sort(F.collect_list("file")).alias("files")).join(files.groupBy("pattern").agg(F.count(F.lit(1)).alias("n_files")), "pattern")
    confidence = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("c"))
    out = counts.join(top, "pattern").join(listed, "pattern").withColumn("confidence", confidence)
    return out.select("pattern", "kind", "krit", "n_values", "n_examples", "sample_values", "files", "n_files", "confidence")


def _rank(confidence: Column) -> Column:
    return F.when(confidence == "high", 3).when(confidence == "medium", 2).otherwise(1)


def severity_matrix(summarised: DataFrame, critical: int = 5) -> DataFrame:
    """(krit, field, regexp, string, total, shown): distinct values by severity and kind; shown is false beyond critical."""
    sums = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n_values"))), F.lit(0)).alias(k) for k in KIND_ORDER]
    return summarised.groupBy("krit").agg(*sums, F.sum("n_values").alias("total")).withColumn("shown", F.col("krit") <= critical)


def _sheet_order() -> list[Column]:
    kinds = F.element_at(F.create_map(*[x for k, v in KIND_ORDER.items() for x in (F.lit(k), F.lit(v))]), F.col("kind"))
    return [F.col("krit"), kinds, F.col("pattern")]


def findings_sheet(summarised: DataFrame, critical: int = 5) -> DataFrame:
    """The findings sheet: three columns for the reader's notes, then kind, pattern, severity, samples and files, safe for cells."""
    rows = summarised.where(F.col("krit") <= critical).orderBy(*_sheet_order())
    cell = lambda c: sanitize_cell(F.array_join(c, ", "))
    return rows.select(
        F.lit("").alias("Bearbeiter"), F.lit("").alias("Finding"), F.lit("").alias("Kommentar"), F.col("kind").alias("Art"), F.col("pattern").alias("Muster"),
        F.col("krit").alias("Kritikalitaet"), cell(F.col("sample_values")).alias("Beispiele"), cell(F.col("files")).alias("gefunden_in"),
    )


def merged_spans(starts: Column, length: Column) -> Column:
    """array<struct<s, e>> of the stretches that spans of one length from these starts cover, in order; spans that overlap or touch are one."""
    none = F.array().cast("array<struct<s:int,e:int>>")

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["s"].alias("s"), (s + length).cast("int").alias("e"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["e"] >= s), longer).otherwise(F.concat(done, F.array(F.struct(s.cast("int").alias("s"), (s + length).cast("int").alias("e")))))

    return F.aggregate(F.array_sort(F.array_distinct(starts)), none, add)


def highlight(text: Column, value: Column, shown: Column, start: Column, end: Column, rest: Callable[[Column], Column] = lambda c: c) -> Column:
    """The text with a value replaced: at its known place and wherever it stands alone; inside words only if its own edges are no
    word characters. Spans that overlap or touch are replaced once. What stands between them goes through rest."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    alone = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])"), quoted, F.lit(r"(?![\p{L}\p{N}_])"))
    word_edges = F.left(value, F.lit(1)).rlike(r"[\p{L}\p{N}]") & F.right(value, F.lit(1)).rlike(r"[\p{L}\p{N}]")
    rx, n = F.when(word_edges, alone).otherwise(F.concat(F.lit("(?iu)"), quoted)), F.char_length(value)
    gaps = F.transform(F.split(text, rx, -1), lambda g: F.char_length(g))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    step = lambda a, g: F.struct((a["at"] + g + n).alias("at"), F.concat(a["all"], F.array(a["at"] + g)).alias("all"))
    found = F.aggregate(F.slice(gaps, F.lit(1), F.size(gaps) - 1), first, step)["all"]
    known = (start >= 0) & (F.lower(F.substring(text, start + 1, end - start)) == F.lower(value))
    spans = merged_spans(F.when(known, F.concat(found, F.array(start.cast("int")))).otherwise(found), n)
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    put = lambda a, x: F.struct(x["e"].alias("at"), F.concat(a["out"], rest(F.substring(text, a["at"] + 1, x["s"] - a["at"])), shown).alias("out"))
    done = F.aggregate(spans, begin, put)
    return F.when(value == "", rest(text)).otherwise(F.concat(done["out"], rest(F.substring(text, done["at"] + 1, F.char_length(text)))))


def _hidden(found: DataFrame, mask: str | None) -> Callable[[Column], Column]:
    """Masks the values of other findings in a text, where found knows them (others)."""
    if not mask or "others" not in found.columns:
        return lambda c: c
    return lambda c: F.aggregate(F.coalesce("others", F.array().cast("array<string>")), c, lambda t, v: F.replace(t, v, redact(v, mask)))


def _entry(orig: Column, shown: Column, rest: Callable[[Column], Column]) -> Column:
    """The context with >>>value<<< marked; a field finding is followed by its key: [FELD:token]."""
    marked = highlight(F.col("context.text"), orig, F.concat(F.lit(">>>"), shown, F.lit("<<<")), F.col("context.start"), F.col("context.end"), rest)
    return F.concat(marked, F.when(F.col("token").isNotNull(), F.concat(F.lit(" [FELD:"), key_of(F.col("token"), orig), F.lit("]"))).otherwise(""))


def key_of(token: Column, value: Column) -> Column:
    """A field's token without its value, so that a report does not show it under another name."""
    return F.replace(token, value, F.lit("***"))


def full_sheet(found: DataFrame, examples: int = 10, critical: int = 5, mask: str | None = None) -> DataFrame:
    """One row for each of a pattern's first values, from its first example: file, kind, pattern, severity, value, field, entry with
    >>>value<<< marked."""
    first = found.where(F.col("krit") <= critical).withColumn("_n", F.row_number().over(Window.partitionBy("pattern", "value").orderBy(*SEQ))).where("_n = 1")
    top = first.withColumn("_v", F.row_number().over(Window.partitionBy("pattern").orderBy("value"))).where(F.col("_v") <= examples)
    shown = redact(F.col("orig"), mask) if mask else F.col("orig")
    marked = _entry(F.col("orig"), shown, _hidden(found, mask))
    field = F.coalesce(key_of(F.col("token"), F.col("orig")) if mask else F.col("token"), F.lit(""))
    return top.orderBy(*_sheet_order(), "value").select(
        sanitize_cell(F.col("file")).alias("Logdatei"), F.col("kind").alias("Art"), F.col("pattern").alias("Muster"), F.col("krit").alias("Kritikalitaet"),
        sanitize_cell(shown).alias("Gefundener_Wert"), sanitize_cell(field).alias("Feld"), sanitize_cell(marked).alias("Logeintrag"),
    )


def with_rules(summarised: DataFrame, catalog: Catalog) -> DataFrame:
    """All rules of the catalog in its order, then derived patterns; rules without hits have n_values 0."""
    names = catalog.frame(summarised.sparkSession).select(F.col("name").alias("r_name"), F.col("kind").alias("r_kind"), F.col("krit").alias("r_krit"), "ord")
    joined = names.join(summarised, F.col("r_name") == F.col("pattern"), "full_outer")
    return joined.select(
        F.coalesce("pattern", "r_name").alias("pattern"), F.coalesce("kind", "r_kind").alias("kind"), F.coalesce("krit", "r_krit").alias("krit"),
        F.coalesce("n_values", F.lit(0)).alias("n_values"), F.coalesce("n_examples", F.lit(0)).alias("n_examples"), "sample_values", "files", "confidence", "ord",
    )


def report_lines(summarised: DataFrame, show_skipped: bool = False) -> DataFrame:
    """(ord, pattern, text): one report line per pattern: [kind] [label] name: samples."""
    samples = F.when(F.col("n_values") > 0, F.array_join("sample_values", ", ")).otherwise("<nothing found>")
    hint = F.when((F.col("kind") == "string") & (F.col("n_values") > 0), F.concat(F.lit("  (Konfidenz: "), "confidence", F.lit(")"))).otherwise("")
    text = F.concat(F.lit("["), "kind", F.lit("] ["), severity_label(F.col("krit")), F.lit("] "), "pattern", F.lit(": "), samples, hint)
    rows = summarised if show_skipped else summarised.where("n_values > 0")
    return rows.select("ord", "pattern", text.alias("text"))


def report_entries(found: DataFrame, examples: int = 10, mask: str | None = None) -> DataFrame:
    """(pattern, n, text): the full view's lines under a pattern, one for each of its first values: file:line: entry."""
    first = found.withColumn("rank", F.row_number().over(Window.partitionBy("pattern", "value").orderBy(*SEQ))).where("rank = 1")
    top = first.withColumn("n", F.row_number().over(Window.partitionBy("pattern").orderBy("value"))).where(F.col("n") <= examples)
    shown = redact(F.col("orig"), mask) if mask else F.col("orig")
    place = F.concat(F.col("file"), F.lit(":"), F.col("line_no").cast("string"))
    return top.select("pattern", "n", F.concat(F.lit("    "), place, F.lit(": "), _entry(F.col("orig"), shown, _hidden(found, mask))).alias("text"))


def masked(found: DataFrame, mask: str) -> DataFrame:
    """Findings that may leave the scan: values and originals under the mask, contexts with the value and those of other findings (others)
    masked, no whole lines, and tokens without their values."""
    shown = redact(F.col("orig"), mask)
    text = highlight(F.col("context.text"), F.col("orig"), shown, F.col("context.start"), F.col("context.end"), _hidden(found, mask))
    context = F.struct(text.alias("text"), F.col("context.start").alias("start"), F.col("context.end").alias("end"), F.col("context.cut").alias("cut"))
    out = found.withColumns({"context": context, "token": key_of(F.col("token"), F.col("orig"))}).withColumns({"value": redact(F.col("value"), mask), "orig": shown})
    return out.drop("line", "others")


def _compared(gold: DataFrame, fired: DataFrame) -> DataFrame:
    expected = gold.select("line_id", "pattern").distinct().withColumn("e", F.lit(1))
    got = fired.join(gold.select("pattern").distinct(), "pattern", "left_semi").select("line_id", "pattern").distinct().withColumn("g", F.lit(1))
    return expected.join(got, ["line_id", "pattern"], "full_outer")


def _figures(n: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.when(a + b > 0, a / (a + b)).otherwise(1.0)
    n = n.withColumns({"precision": ratio(F.col("tp"), F.col("fp")), "recall": ratio(F.col("tp"), F.col("fn"))})
    return n.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def _counts() -> list[Column]:
    return [F.count_if(F.expr(x)).alias(n) for n, x in (("tp", "e = 1 and g = 1"), ("fp", "e is null"), ("fn", "g is null"))]


def quality(gold: DataFrame, fired: DataFrame) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) of pairs (line_id, pattern), over the patterns that gold names."""
    return _figures(_compared(gold, fired).agg(*_counts()))


def quality_by_kind(gold: DataFrame, fired: DataFrame, catalog: Catalog) -> DataFrame:
    """The same for each kind of rule: (kind, tp, fp, fn, precision, recall, f1)."""
    kinds = catalog.frame(gold.sparkSession).select(F.col("name").alias("pattern"), "kind")
    return _figures(_compared(gold, fired).join(kinds, "pattern").groupBy("kind").agg(*_counts()))


def scan_status(complete: int, partial: int, unreadable: int, skipped_rules: int = 0) -> tuple[str, int]:
    """(status, exit code): failed 4 if nothing was read, partial 3 if something is missing, else complete 0."""
    if complete + partial == 0:
        return "failed", 4
    return ("partial", 3) if partial or unreadable or skipped_rules else ("complete", 0)
