"""Operator 6: secret scans by multipart credential linking. Built-in functions only.

Base kinds (assign, access, hex) are found everywhere. Weak candidates (identifiers, secret-like values,
endpoints) mean little alone; they are reported only where complementary parts co-occur: within REACH code
points of each other and within one scope, a stretch of text without a blank line. A stretch of text is one part only: a weak
span that overlaps a base span goes, and of weak spans that overlap, the secret stays, else the identifier, so no span is its own
complement. The interval join is a merge over one text's spans in order: running maxima of the ends before and minima of the
starts behind each span, so its cost follows the number of spans, not of pairs. Reported parts of one scope that follow each other within
REACH are one credential, which the result lists by its parts.

Positions come from lengths: what lies between the matches of a pattern (split) and the matches themselves are
added up in order. Only lengths and short values leave the task that read a text. Weak patterns are looked for only in texts that hold
a secret and a locator of any kind.

Defined cases: null text is empty and has no spans; repeated rows each get their own result row; a row without any span
gets an empty spans string and the digest of the empty string. Columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import quoted, text_of

#: Kinds in their order; the first three are the base.
KINDS = ("assign", "access", "hex", "linked_id", "linked_secret", "linked_endpoint")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
    "linked_id": r"""(?i:(?<![a-z0-9])(?:client|access_?key|key|account|user|tenant|login)(?:_?(?:id|name))?["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,}))""",
    "linked_secret": r"""(?i:(?<![a-z0-9])(?:pass(?:phrase|code)?|pwd|credentials?|auth|signature|sig|sas|(?:private|shared|access|account)_?key|key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,})|(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])""",
    "linked_endpoint": r"""(?i:(?<![a-z0-9])(?:https?|ftp|jdbc:[a-z]{2,16}|amqps?|redis|postgres(?:ql)?|mongodb)://[^\s"'<>]{3,}|(?<![a-z0-9])(?:host|server|endpoint|url|bucket)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{4,})""",
}
#: Scopes are parted by blank lines.
BREAK = r"\n[ \t\r]*\n"
#: Complementary parts are at most this many code points apart.
REACH = 240
_BREAK = len(KINDS)


#: Parts that are secrets; the others say where or whose they are.
_SECRETS = (0, 2, 4)
_NONE = "array<struct<kind:int,pos:int,gap:int,len:int,ok:boolean>>"


def _found(text: Column, kind: int, pattern: str, there: Column) -> Column:
    """array<struct<kind, pos, gap, len, ok>> for a pattern: the length before each match since the last, and its own."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
    ok = (lambda h: F.char_length(F.regexp_extract(h, ASSIGN, 2)) >= 8) if kind == 0 else (lambda h: F.lit(True))
    rows = F.transform(
        F.arrays_zip(hits.alias("h"), gaps.alias("g")),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), x["g"].alias("gap"), F.char_length(x["h"]).alias("len"), F.coalesce(ok(x["h"]), F.lit(False)).alias("ok")),
    )
    return F.when(there, F.filter(rows, lambda x: x["len"].isNotNull())).otherwise(F.array().cast(_NONE))


def _overlaps(rows: DataFrame, better: Column, name: str) -> DataFrame:
    """Adds name: whether the row's span overlaps one of the spans that are better."""
    order = Window.partitionBy("rid").orderBy("start", "kind")
    ends = F.max(F.when(better, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.min(F.when(better, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn(name, F.coalesce(ends > F.col("start"), F.lit(False)) | F.coalesce(starts < F.col("end"), F.lit(False)))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All spans of every row: (rid, id, kind, start, end, credential), base ones and linked weak ones; rid numbers the rows of docs,
    credential the linked groups of a row (null: not linked). A row without spans has one line of nulls. One shuffle, of spans."""
    t = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(quoted(id_col)).alias("id"), text_of(quoted(text_col)).alias("t"))
    has = lambda k: F.rlike("t", F.lit(PATTERNS[k]))
    t = t.withColumns({"h0": has("assign"), "h1": has("access"), "h2": has("hex"), "h4": has("linked_secret")})
    t = t.withColumn("any_secret", F.col("h0") | F.col("h2") | F.col("h4"))
    t = t.withColumn("h3", F.col("any_secret") & has("linked_id"))
    t = t.withColumn("h5", F.col("any_secret") & has("linked_endpoint"))
    weak = F.col("any_secret") & (F.col("h1") | F.col("h3") | F.col("h5"))
    there = [F.col(f"h{i}") if i < 3 else F.col(f"h{i}") & weak for i in range(len(KINDS))]
    every = [_found(F.col("t"), i, PATTERNS[k], there[i]) for i, k in enumerate(KINDS)] + [_found(F.col("t"), _BREAK, BREAK, weak)]
    rows = t.select("rid", "id", F.explode_outer(F.concat(*every)).alias("x")).select("rid", "id", "x.*").repartition("rid")
    order = Window.partitionBy("rid", "kind").orderBy("pos")
    end = F.sum("gap").over(order) + F.sum("len").over(order)
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("len")).where("ok or kind is null")
    by_start = Window.partitionBy("rid").orderBy("start", "kind")
    rows = rows.withColumn("scope", F.sum(F.when(F.col("kind") == _BREAK, 1).otherwise(0)).over(by_start)).where(f"kind is null or kind < {_BREAK}")
    kind = F.col("kind")
    rows = _overlaps(rows, kind < 3, "over").where("kind is null or kind < 3 or not over")
    rows = _overlaps(rows, kind == 4, "over").where("kind is null or kind < 3 or kind = 4 or not over")
    rows = _overlaps(rows, kind == 3, "over").where("kind is null or kind <> 5 or not over").drop("over")
    scope = Window.partitionBy("rid", "scope").orderBy("start", "kind")
    before, behind = scope.rowsBetween(Window.unboundedPreceding, -1), scope.rowsBetween(1, Window.unboundedFollowing)
    secret = kind.isin(*_SECRETS)
    near = {}
    for name, part in (("secret", secret), ("locator", ~secret)):
        ends = F.max(F.when(part, F.col("end"))).over(before)
        starts = F.min(F.when(part, F.col("start"))).over(behind)
        near[name] = F.coalesce(F.col("start") - ends <= REACH, F.lit(False)) | F.coalesce(starts - F.col("end") <= REACH, F.lit(False))
    rows = rows.withColumn("linked", kind.isNotNull() & F.when(secret, near["locator"]).otherwise(near["secret"]))
    last = F.max(F.when(F.col("linked"), F.col("end"))).over(before)
    opens = F.col("linked") & (last.isNull() | (F.col("start") - last > REACH))
    rows = rows.withColumn("opens", opens.cast("int"))
    credential = F.when(F.col("linked"), F.sum("opens").over(by_start))
    stays = kind.isNull() | (kind < 3) | F.col("linked")
    return rows.select("rid", "id", F.when(stays, kind).alias("kind"), "start", "end", credential.alias("credential"))


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id_col, n_assign, n_access, n_hex, base_sha256, spans, n_linked, credentials); credentials says which
    parts belong together, as kind:start:end joined by + within one and by commas between them."""
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    item = F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end", F.concat_ws(":", name, "start", "end").alias("s"), "credential"))
    rows = spans(docs, id_col, text_col).groupBy("rid", "id").agg(F.array_sort(F.collect_list(item)).alias("x"))
    said = lambda least: F.array_join(F.transform(F.filter("x", lambda s: s["kind"] < least), lambda s: s["s"]), ",")
    count = lambda k: F.size(F.filter("x", lambda s: s["kind"] == k)).cast("long")
    linked = F.filter("x", lambda s: s["credential"].isNotNull())
    first = F.struct(F.lit("").alias("s"), F.lit(None).cast("bigint").alias("c"))
    step = lambda a, s: F.struct(F.concat(a["s"], F.when(a["c"].isNull(), "").when(a["c"] == s["credential"], "+").otherwise(","), s["s"]).alias("s"), s["credential"].alias("c"))
    return rows.select(
        F.col("id").alias(id_col),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(said(3), 256).alias("base_sha256"),
        said(9).alias("spans"),
        F.size(F.filter("x", lambda s: s["kind"] >= 3)).cast("long").alias("n_linked"),
        F.aggregate(linked, first, step)["s"].alias("credentials"),
    )
