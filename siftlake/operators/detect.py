"""Detection: lines to candidates to decided findings, in one narrow pass.

Candidates come from one Arrow pass over the lines (operators.engine), which shuffles nothing; validation, decisions and contexts are
Columns over the few hits. Lexicons beyond UNROLLED_WORDS come by a join instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import rules
from ..catalog import Catalog
from ..config import ScanConfig
from ..functions import text as X
from ..functions import validators as V
from .engine import HIT, TIMED_OUT, TOKEN, Spec, hit_columns, scanner
from .tokenize import tokens

#: A lexicon of more single words than this is joined as a table and does not travel with the plan.
UNROLLED_WORDS = 50_000


def _stop(catalog: Catalog, kind: str, c: Column) -> Column:
    words = catalog.stopwords.get(kind)
    return c.isin(sorted(words)) if words else F.lit(False)


def _plain_markers() -> list[str]:
    """The pre-filter's markers, without those that hold another one: whatever holds them holds that."""
    return [m for m in rules.PREFILTER_MARKERS if not any(o != m and o in m for o in rules.PREFILTER_MARKERS)]


def passes_prefilter(line: Column, mode: str, catalog: Catalog) -> Column:
    """The coarse pre-filter of modes regexp_field and all. It may lose findings; off loses none."""
    if mode == "off":
        return F.lit(True)
    low = F.lower(line)
    # most markers hold one of a few common stems; strings are looked for one by one, which is faster than their alternation
    ok = reduce(lambda a, m: a | F.contains(low, F.lit(m)), _plain_markers(), line.rlike(r"\d{5}"))
    if mode == "all":
        values = sorted({v for _, _, _, v in catalog.words() + catalog.phrases()})
        parts = F.regexp_extract_all(F.lower(line), F.lit(r"(?U)[^\s?&=,;|]+"), F.lit(0))
        if values:
            ok = ok | F.exists(parts, lambda t: X.norm(F.btrim(t, F.lit("\"'{}[](),.:;!?=&|<>"))).isin(values))
        for phrase in sorted({v for _, _, _, v in catalog.phrases()}):
            ok = ok | F.contains(X.norm(line), F.lit(phrase))
    return ok


def _per_rule(catalog: Catalog, get) -> Column:
    return F.element_at(F.array(*[F.lit(get(r)) for r in catalog.rules]), F.col("ord") + 1)


def _words(catalog: Catalog) -> list[tuple[int, str]]:
    """(place, normal form) of the lexicon entries of one word that may be hits."""
    never = catalog.stopwords.get("search", frozenset()) | set(rules.TECHNICAL_TERMS)
    return [(i, v) for i, _, _, v in catalog.words() if v not in never]


def spec_of(catalog: Catalog, config: ScanConfig = ScanConfig(), others: bool = False) -> Spec:
    """What the engine needs of a catalog."""
    words: dict[str, tuple[int, ...]] = {}
    if len(wanted := _words(catalog)) <= UNROLLED_WORDS:
        for i, v in wanted:
            words[v] = (*words.get(v, ()), i)
    return Spec(
        tuple((i, r.regex) for i, r in catalog.of("regexp", "line")),
        tuple((i, r.regex) for i, r in catalog.of("regexp", "token")),
        tuple((i, r.regex, r.offset) for i, r in catalog.of("field")),
        tuple(words.items()),
        tuple((i, v) for i, _, _, v in catalog.phrases() if v not in catalog.stopwords.get("search", ())),
        catalog.stopwords.get("regexp", frozenset()),
        config.parse_json,
        config.regex_timeout_ms,
        config.regex_disable_threshold,
        (config.context_chars_before, config.context_chars_after) if others else None,
    )


def _hits(lines: DataFrame, catalog: Catalog, config: ScanConfig, others: bool = False) -> DataFrame:
    """candidates, with hits of stage TIMED_OUT."""
    families = [k for k, on in (("regexp", config.search_regexp), ("field", config.search_field), ("string", config.search_suchmuster)) if on]
    catalog = catalog.only(*families)
    columns, spec = lines.columns, spec_of(catalog, config, others)
    rows = lines.where((F.col("line") != "") & passes_prefilter(F.col("line"), config.prefilter, catalog))
    schema = StructType([*lines.schema.fields, *StructType.fromDDL(hit_columns(spec)).fields])
    out = rows.mapInArrow(scanner(spec, columns.index("line")), schema)
    if len(words := _words(catalog)) > UNROLLED_WORDS:
        lexicon = lines.sparkSession.createDataFrame([(v, i) for i, v in words], "_value string, _ord int")
        each = rows.select(*columns, F.posexplode(tokens(F.col("line"), config.parse_json)).alias("_i", "_t")).withColumn("_n", X.norm(F.col("_t")))
        at = F.instr("line", F.col("_t")) - 1
        hit = [F.lit(TOKEN), F.col("_i"), F.lit(2), F.col("_ord"), F.col("_t"), F.col("_t"), F.lit(None).cast("string"), at, F.when(at >= 0, at + F.char_length("_t")).otherwise(-1), X.lexicon_confidence(F.col("line"))]
        named = [c.cast(f.dataType).alias(f.name) for c, f in zip(hit, StructType.fromDDL(HIT))]
        out = out.unionByName(each.join(lexicon, F.col("_n") == F.col("_value")).select(*columns, *named), allowMissingColumns=True)
    if not catalog.rules:
        return out.withColumns({"pattern": F.lit(""), "kind": F.lit(""), "krit": F.lit(0)})
    return out.withColumns({"pattern": _per_rule(catalog, lambda r: r.name), "kind": _per_rule(catalog, lambda r: r.kind), "krit": _per_rule(catalog, lambda r: r.krit)})


def candidates(lines: DataFrame, catalog: Catalog, config: ScanConfig = ScanConfig()) -> DataFrame:
    """lines (with a column `line`, stripped) → one row per hit: the columns of lines, stage, pos, family, ord, value, orig,
    token, start, end, confidence, pattern, kind, krit. Narrow unless a lexicon is large."""
    return _hits(lines, catalog, config).where(F.col("stage") != TIMED_OUT)


def decide(found: DataFrame, catalog: Catalog, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Candidates with decision (keep, rejected, path, stopword, timeout), variant ('', masked, low, incomplete), pattern as displayed, base_pattern, krit,
    value, confidence, seq (order of discovery in a line) and context (struct<text, start, end, cut>)."""
    value, line, kind, base = F.col("value"), F.col("line"), F.col("kind"), F.col("pattern")
    valid = reduce(lambda c, x: c.when(base == x[0], x[1](value)), V.BY_RULE.items(), F.when(F.lit(False), F.lit(True))).otherwise(F.lit(True))
    street = F.when(base == "strasse", V.street_status(value, line))
    key = F.when(base.isin("SSHPrivateKey", "TLSPrivateKey"), V.private_key_status(line))
    regexp, field_ = kind == "regexp", kind == "field"
    masked = field_ & X.is_masked(value)
    decision = (
        F.when(F.col("stage") == TIMED_OUT, "timeout")
        .when(regexp & (~valid | F.coalesce(street == "drop", F.lit(False))), "rejected")
        .when(field_ & ~masked & X.looks_like_path(value), "path")
        .when(field_ & ~masked & _stop(catalog, "field", X.norm(value)), "stopword")
        .otherwise("keep")
    )
    variant = (
        F.when(masked, "masked").when(regexp & F.coalesce(street == "low", F.lit(False)), "low").when(regexp & F.coalesce(key != "complete", F.lit(False)), "incomplete").otherwise("")
    )
    out = found.withColumns({"decision": decision, "variant": variant, "base_pattern": base, "_key": key})
    at = lambda c: F.when(F.col("variant") == "", F.col(c)).otherwise(-1)
    suffix = F.element_at(F.create_map(*[x for k, v in rules.SUFFIX.items() for x in (F.lit(k), F.lit(v))]), F.col("variant"))
    said = F.when(F.col("variant") == "masked", F.lit(rules.MASKED_STATUS)).when(F.col("variant") == "incomplete", F.concat(F.lit("private key: "), F.col("_key"))).otherwise(F.col("value"))
    krit = F.when(F.col("variant") == "low", 5).when(F.col("variant").isin("masked", "incomplete"), config.masked_value_criticality).otherwise(F.col("krit"))
    out = out.withColumns(
        {
            "pattern": F.concat("base_pattern", suffix), "krit": krit.cast("int"), "value": said,
            "orig": F.when(F.col("variant").isin("masked", "incomplete"), said).otherwise(F.col("orig")), "start": at("start"), "end": at("end"),
            "seq": F.struct("stage", "pos", "family", "ord"),
        }
    )
    context = X.context_window(line, F.col("start"), F.col("end"), config.context_chars_before, config.context_chars_after, config.max_example_chars)
    return out.withColumn("context", context).drop("_key", "stage", "pos", "family", "ord")


def detect(lines: DataFrame, catalog: Catalog, config: ScanConfig = ScanConfig(), others: bool = False) -> DataFrame:
    """Decided candidates; others adds the values found around each (others array<string>), which masked reports hide too."""
    return decide(_hits(lines, catalog, config, others), catalog, config)


def findings(detected: DataFrame) -> DataFrame:
    return detected.where("decision = 'keep'").drop("decision")


def rejected_counts(detected: DataFrame) -> DataFrame:
    """(pattern, n) of candidates that validation turned down."""
    return detected.where("decision = 'rejected'").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def timeouts(detected: DataFrame) -> DataFrame:
    """(pattern, n) of texts on which a rule ran out of time."""
    return detected.where("decision = 'timeout'").groupBy(F.col("base_pattern").alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
