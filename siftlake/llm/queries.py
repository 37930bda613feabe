"""The queries opN_<name> of this subpackage and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, exact_dedup, fingerprint, mixing, near_dedup, packing, pseudo_likelihood, quality, secrets, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_turns(turns.unionByName(chat.planted(spark, turns)))).drop("n_tokens", "loss_tokens")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op5_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_report(table(spark, sf_dir, "documents"))


def op6_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op7_bagminhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op8_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).drop("intact")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_chunk_recipe_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_masked_pseudo_likelihood": op1_masked_pseudo_likelihood,
    "op2_chat_format": op2_chat_format,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_source_mix": op4_source_mix,
    "op5_merkle_fingerprints": op5_merkle_fingerprints,
    "op6_linked_secrets": op6_linked_secrets,
    "op7_bagminhash_near_duplicates": op7_bagminhash_near_duplicates,
    "op8_warc_segments": op8_warc_segments,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_chunk_recipe_dedup": op10_chunk_recipe_dedup,
}

_OP4 = r"""
WITH RECURSIVE e AS (
  SELECT doc_id AS id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s0 AS (
  SELECT source, count(*) AS entries, sum(size)::BIGINT AS source_size FROM e GROUP BY source
), s1 AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s0
), s2 AS (
  SELECT *, row_number() OVER w AS rank, 1.5::DOUBLE * sum(source_size) OVER () AS total,
    coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight
  FROM s1 WINDOW w AS (ORDER BY cap / weight, source ASC NULLS LAST)
), lv AS (
  SELECT min_by((total - capped) / rest_weight, rank) AS level FROM s2 WHERE (total - capped) / rest_weight <= cap / weight
), s3 AS (
  SELECT source, entries, source_size, coalesce(least(level * weight, cap), cap) AS target FROM s2, lv
), s4 AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
    greatest(1, ceil(entries / 1000.0))::BIGINT AS buckets FROM s3
), s5 AS (
  SELECT *, greatest(0.0::DOUBLE, target - whole * source_size) AS rest FROM s4
), s6 AS (
  SELECT *, CASE WHEN source_size > 0 THEN rest / source_size ELSE 0.0::DOUBLE END AS pi FROM s5
), r0 AS (
  SELECT e.id, e.source, e.size, s6.* EXCLUDE (source),
    (('0x' || substr(md5('mix:' || coalesce(e.id::VARCHAR, '') || ':' || coalesce(e.source, '')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM e JOIN s6 ON e.source IS NOT DISTINCT FROM s6.source
), r1 AS (
  SELECT *, CASE WHEN pi > 0 THEN (u / (1 - u)) / (pi / (1 - pi)) END AS q FROM r0
), r2 AS (
  SELECT *, q / (1 + q) AS t, least(floor(q / (1 + q) * buckets)::BIGINT, buckets - 1) AS bucket FROM r1
), b AS (
  SELECT source, rest, bucket, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY bucket) AS upto FROM r2 WHERE pi > 0 GROUP BY source, rest, bucket
), c AS (
  SELECT source, min(bucket) AS cut, min_by(rest - upto + words, bucket) AS room FROM b WHERE upto > rest GROUP BY source
), r3 AS (
  SELECT r2.*, c.cut, c.room FROM r2 LEFT JOIN c ON r2.source IS NOT DISTINCT FROM c.source
), o AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY t, id) AS rn FROM r3 WHERE pi > 0 AND bucket = cut
), g AS (
  SELECT source, 0::BIGINT AS rn, room::DOUBLE AS room, NULL::BIGINT AS id, 0::BIGINT AS got FROM c
  UNION ALL
  SELECT o.source, o.rn, g.room - CASE WHEN o.size > 0 AND o.size <= g.room THEN o.size ELSE 0 END, o.id, CASE WHEN o.size > 0 AND o.size <= g.room THEN 1 ELSE 0 END
  FROM g JOIN o ON o.source IS NOT DISTINCT FROM g.source AND o.rn = g.rn + 1
), a AS (
  SELECT r3.*, CASE WHEN r3.pi <= 0 THEN 0 WHEN r3.cut IS NULL OR r3.bucket < r3.cut THEN 1 WHEN r3.bucket > r3.cut THEN 0 ELSE g.got END AS extra
  FROM r3 LEFT JOIN g ON g.id IS NOT DISTINCT FROM r3.id AND g.rn > 0
)
SELECT id AS doc_id, size, source_size, target, (size * (whole + extra))::BIGINT AS taken, (whole + extra)::BIGINT AS copies FROM a
"""

_LEAVES = fingerprint.LEAVES.replace("'", "''")


def _nodes(text: str) -> str:
    return f"list_transform(string_split({text}, chr(10)), lambda p: array_to_string(list_transform(regexp_extract_all(p, '{_LEAVES}'), lambda s: md5(s)), ' '))"


def _sections(p: str) -> str:
    return f"list_transform(list_filter(string_split(regexp_replace(array_to_string({p}, ' ') || ' ', '([0-3][0-9a-f]{{63}} )', '\\1|', 'g'), '|'), lambda x: x <> ''), lambda x: sha256(x))"


def _below(a: str, b: str) -> str:
    return f"list_distinct(list_filter(string_split(array_to_string(list_filter({a}, lambda y: NOT list_contains({b}, y)), ' '), ' '), lambda x: x <> ''))"


def _like(a: str, b: str) -> str:
    """By the columns that hold the differing leaves of either side."""
    both = f"2.0::DOUBLE * coalesce(list_sum(list_transform(list_intersect({a}, {b}), lambda x: (length(x) + 1) // 33)), 0)"
    rest, common = f"len({a}_{b}) + len({b}_{a})", f"2.0::DOUBLE * len(list_intersect({a}_{b}, {b}_{a}))"
    return f"CASE WHEN {both} + {rest} = 0 THEN 1.0 ELSE ({both} + {common}) / ({both} + {rest}) END"


def _first(a: str, b: str) -> str:
    differs = f"list_position(list_transform(range(greatest(len({a}), len({b}))), lambda i: {a}[i + 1] IS NOT DISTINCT FROM {b}[i + 1]), false)"
    return f"CASE WHEN {differs} > 0 THEN ({differs} - 1)::INT END"


_OP5 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nt FROM t WINDOW w AS (ORDER BY doc_id ASC NULLS FIRST, t)),
e AS (SELECT *, length(t)::BIGINT AS n_chars, substr(t, 1, length(t) - length(t) // 4) || substr(nt, 1, length(t) // 4) AS edited FROM n),
m AS (SELECT doc_id, n_chars, edited, {_nodes("t")} AS o, {_nodes("edited")} AS e, {_nodes("nt")} AS x FROM e),
d AS (SELECT *, list_transform(o, lambda p: sha256(p)) AS op, list_transform(e, lambda p: sha256(p)) AS ep,
  {_below("o", "e")} AS o_e, {_below("e", "o")} AS e_o, {_below("o", "x")} AS o_x, {_below("x", "o")} AS x_o FROM m),
s AS (SELECT *, {_sections("op")} AS os, {_sections("ep")} AS es FROM d)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, sha256(array_to_string(os, ' ')) AS fingerprint, sha256(array_to_string(es, ' ')) AS edited_fingerprint,
  {_like("o", "e")} AS near_edited, {_like("o", "x")} AS near_next, {_first("os", "es")} AS first_section, {_first("op", "ep")} AS first_paragraph
FROM s
"""

_OP10 = """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""

_OP2 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

_OP8 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, ((i // 8) * 10 + 1)::BIGINT, 10))::BIGINT >> (35 - 5 * (i % 8))::BIGINT) & 31) + 1, 1)), '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM d WINDOW w AS (PARTITION BY payload_digest)
"""

ORACLE_SQL: dict[str, str] = {
    "op2_chat_format": _OP2,
    "op8_warc_segments": _OP8,
    "op4_source_mix": _OP4,
    "op5_merkle_fingerprints": _OP5,
    "op10_chunk_recipe_dedup": _OP10,
}
