"""Validators of candidates as Column functions; `register` gives them SQL names."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .. import rules
from .text import strip

#: Longest segment of a token that is looked into.
SEGMENT = 8192


def luhn_valid(c: Column) -> Column:
    return c.rlike("^[0-9]+$") & F.call_function("luhn_check", c)


def card_valid(c: Column) -> Column:
    """13 to 19 digits, spaces and hyphens aside, with a right check digit."""
    digits = F.translate(c, " -", "")
    return digits.rlike("^[0-9]{13,19}$") & F.call_function("luhn_check", digits)


def iban_valid(c: Column) -> Column:
    """The country's length and a remainder of 1 by 97."""
    s = F.upper(F.regexp_replace(c, r"(?U)\s", ""))
    lengths = F.create_map(*[x for k, v in rules.IBAN_LENGTHS.items() for x in (F.lit(k), F.lit(v))])
    expected = F.try_element_at(lengths, F.left(s, F.lit(2)))
    turned = F.concat(F.substr(s, F.lit(5)), F.left(s, F.lit(4)))
    value = lambda x: F.when(x.between("0", "9"), F.ascii(x) - 48).otherwise(F.ascii(x) - 55)
    step = lambda a, x: (a * F.when(x.between("0", "9"), 10).otherwise(100) + value(x)) % 97
    rest = F.aggregate(F.split(turned, ""), F.lit(0), step)
    shape = s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$") & F.char_length(s).between(15, 34)
    return F.when(shape & F.coalesce(F.char_length(s) == expected, F.lit(True)), rest == 1).otherwise(F.lit(False))


def tax_id_valid(c: Column) -> Column:
    """Eleven digits: one digit of the first ten occurs two or three times, the last is the ISO 7064 MOD 11,10 check digit."""
    s = strip(c)
    ten = F.transform(F.split(F.left(s, F.lit(10)), ""), lambda x: F.ascii(x) - 48)
    counts = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.size(F.filter(ten, lambda x: x == d)))
    once = F.filter(counts, lambda n: n >= 2)
    left = lambda p, x: F.when((x + p) % 10 == 0, 10).otherwise((x + p) % 10)
    product = F.aggregate(ten, F.lit(10), lambda p, x: (left(p, x) * 2) % 11)
    check = (11 - product) % 10
    good = (F.size(once) == 1) & (F.get(once, F.lit(0)) <= 3) & (check == F.ascii(F.substring(s, 11, 1)) - 48)
    return F.when(s.rlike("^[1-9][0-9]{10}$"), good).otherwise(F.lit(False))


def _is_object(segment: Column) -> Column:
    """A base64url segment that is the UTF-8 of a JSON object."""
    raw = F.try_to_binary(F.translate(segment, "-_", "+/"), F.lit("base64"))
    value = F.try_parse_json(F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")))
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False)) & F.char_length(segment).between(1, SEGMENT)


def jwt_valid(c: Column) -> Column:
    """Three segments, the first two of them JSON objects, the third not empty. Signatures are not verified."""
    parts = F.split(c, r"\.", -1)
    third = F.char_length(F.get(parts, F.lit(2))).between(1, SEGMENT)
    return F.when(F.size(parts) == 3, _is_object(F.get(parts, F.lit(0))) & _is_object(F.get(parts, F.lit(1))) & third).otherwise(F.lit(False))


_BEGIN = r"(?is)-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----"


def private_key_status(c: Column) -> Column:
    """none, header_only (no end of the same type), incomplete (no plausible body) or complete."""
    block = r"(?is)-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----(.*?)-----END \1-----"
    body = F.regexp_replace(F.regexp_extract(c, block, 2), r"(?U)\s+", "")
    return (
        F.when(~c.rlike(_BEGIN), "none").when(~c.rlike(block), "header_only").when(body.rlike("^[A-Za-z0-9+/=]{32,}$"), "complete").otherwise("incomplete")
    )


def street_status(value: Column, line: Column) -> Column:
    """drop (no street), high (a house number or an address field on the line) or low."""
    plain = F.lower(strip(value))
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    context = line.rlike(r"(?U)(?i)\b(street|stra(?:ss|ß)e|address|adresse|anschrift)\s*[:=]") | line.rlike(r"(?U)\b\d{1,4}\s?[a-z]?\b")
    return F.when(plain.isin(rules.NO_STREETS), "drop").when(context, "high").otherwise("low")


#: Validators by the rule whose candidates they confirm.
BY_RULE = {"Kreditkarte": card_valid, "IBAN": iban_valid, "SteuerID": tax_id_valid, "JWT": jwt_valid}


_STRING = re.compile(r"('(?:[^'\\\\]|\\\\.)*')", re.S)
_OPERATOR = re.compile(r"(?<![\w`])(<=>|<=|>=|=|<|>|\+|-|\*|/|%|!|and|or|not)\(")


def _sql(c: Column) -> str:
    """The Column as SQL: operators, which it prints as prefix calls, are quoted as function names outside strings."""
    parts = _STRING.split(c._jc.node().sql())
    return "".join(x if i % 2 else _OPERATOR.sub(r"`\1`(", x) for i, x in enumerate(parts))


def register(spark: SparkSession) -> list[str]:
    """Temporary SQL functions of one string: card_valid, iban_valid, tax_id_valid, jwt_valid, luhn_valid, private_key_status, norm,
    redact, and street_status(value, line). They are SQL expressions, so queries that use them are optimized as a whole."""
    from . import redact, text

    one = {"luhn_valid": luhn_valid, "card_valid": card_valid, "iban_valid": iban_valid, "tax_id_valid": tax_id_valid, "jwt_valid": jwt_valid}
    said = {"private_key_status": private_key_status, "norm": text.norm, "redact": redact.redact, "looks_like_path": text.looks_like_path, "is_masked": text.is_masked}
    kinds = {"looks_like_path": "BOOLEAN", "is_masked": "BOOLEAN"}
    for name, f in (one | said).items():
        kind = "BOOLEAN" if name in one else kinds.get(name, "STRING")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS {kind} RETURN {_sql(f(F.col('s')))}")
    street = _sql(street_status(F.col("value"), F.col("line")))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION street_status(value STRING, line STRING) RETURNS STRING RETURN {street}")
    return [*one, *said, "street_status"]
