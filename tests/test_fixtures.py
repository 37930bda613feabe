"""Operators on small fixtures, against SQL that states their results."""

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake import rules
from siftlake.catalog import shipped
from siftlake.functions import text as X
from siftlake.functions import validators as V
from siftlake.operators import findings as R
from siftlake.operators import tokenize as K
from siftlake.operators.detect import detect, findings
from siftlake.plans.queries import _IBAN_LEN, _STRIP, GOLD, _values

from .test_entry import compare

CASES = {}


def query(sql):
    def add(f):
        CASES[f.__name__] = (f, sql)
        return f

    return add


_IBANS = [(x,) for x in ("DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "DE00 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130", "XX00 1234", "NL91ABNA0417164300", "fr14 2004 1010 0505 0001 3m02 606", "", "BE68539007547034")]


@query(f"""WITH s AS (SELECT iban, upper(replace(iban, ' ', '')) AS s FROM {_values('iban', _IBANS)}), r AS (SELECT *, substr(s, 5) || left(s, 4) AS t FROM s)
SELECT iban, coalesce(regexp_full_match(s, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]+') AND length(s) BETWEEN 15 AND 34 AND length(s) = {_IBAN_LEN}
  AND list_reduce(list_prepend(0, list_transform(range(1, length(t) + 1), lambda i: CASE WHEN t[i] BETWEEN '0' AND '9' THEN ascii(t[i]) - 48 ELSE ascii(t[i]) - 55 END)), lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1, false) AS valid FROM r""")
def iban_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_IBANS, "iban string").select("iban", V.iban_valid(F.col("iban")).alias("valid"))


_TAX = [(x,) for x in ("86095742719", "12345678901", "11111111111", "00000000000", "8609574271", "8609574271A", "65929970489", "57549285017", "")]


@query(f"""WITH t AS (SELECT tax_id AS id, CASE WHEN regexp_full_match(tax_id, '[1-9][0-9]{{10}}') THEN tax_id ELSE '00000000000' END AS s FROM {_values('tax_id', _TAX)}),
c AS (SELECT *, list_transform(range(10), lambda d: len(list_filter(range(1, 11), lambda i: s[i] = d::VARCHAR))) AS n,
 list_reduce(list_prepend(10, list_transform(range(1, 11), lambda i: s[i]::BIGINT)), lambda p, x: (CASE WHEN (x + p) % 10 = 0 THEN 10 ELSE (x + p) % 10 END * 2) % 11) AS p FROM t)
SELECT id AS tax_id, s[1] <> '0' AND len(list_filter(n, lambda x: x >= 2)) = 1 AND list_max(n) <= 3 AND (11 - p) % 10 = s[11]::INT AS valid FROM c""")
def tax_id_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_TAX, "tax_id string").select("tax_id", V.tax_id_valid(F.col("tax_id")).alias("valid"))


_PEM = [(f"{a}{b}{c}",) for a in ("-----BEGIN RSA PRIVATE KEY-----", "-----begin PRIVATE KEY-----", "none ") for b in ("", "A" * 40, "A" * 20 + " " + "b/+=" * 5, "short!") for c in ("", "-----END RSA PRIVATE KEY-----", "-----END PRIVATE KEY-----")]


@query(rf"""SELECT line, CASE WHEN NOT regexp_matches(line, '(?i)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----') THEN 'none'
  WHEN lower(regexp_extract(line, '(?i)-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----', 1)) <> lower(regexp_extract(line, '(?i)-----END ([A-Z0-9 ]*PRIVATE KEY)-----', 1)) THEN 'header_only'
  WHEN regexp_full_match(replace(regexp_extract(line, '(?i)PRIVATE KEY-----(.*)-----END', 1), ' ', ''), '[A-Za-z0-9+/=]{{32,}}') THEN 'complete' ELSE 'incomplete' END AS status FROM {_values('line', _PEM)}""")
def pem_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_PEM, "line string").select("line", V.private_key_status(F.col("line")).alias("status"))


_JWT = [("eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.sig",), ("a.b",), ("a.b.c.d",), ("bm8.bm8.sig",), ("WzFd.eyJhIjoxfQ.x",), ("eyJhIjoxfQ.eyJhIjoxfQ.",), ("eyJhIjoxfQ.eyJhIjoxfQ.x",)]
_OBJECT = "coalesce(try(json_type(decode(from_base64(rpad(translate(split_part(token, '.', {0}), '-_', '+/'), ((length(split_part(token, '.', {0})) + 3) // 4 * 4)::INT, '='))))) = 'OBJECT', false)"


@query(f"SELECT token, len(string_split(token, '.')) = 3 AND split_part(token, '.', 3) <> '' AND {_OBJECT.format(1)} AND {_OBJECT.format(2)} AS valid FROM {_values('token', _JWT)}")
def jwt_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_JWT, "token string").select("token", V.jwt_valid(F.col("token")).alias("valid"))


_STREETS = [("Hauptstraße", "Hauptstraße 12"), ("Rheinufer", "am Rheinufer"), ("Bahnhofstraße", "street=Bahnhofstraße"), ("Speicherplatz", "Speicherplatz 5"), ("Lösungsweg", "x"), ("Gartenweg", "Gartenweg in 50667 Koeln")]


@query(rf"""SELECT value, CASE WHEN replace(replace(replace(replace(lower(trim(value)), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss') IN ({', '.join(f"'{x}'" for x in rules.NO_STREETS)}) THEN 'drop'
  WHEN regexp_matches(line, '(?i)\b(street|stra(?:ss|ß)e|address|adresse|anschrift)\s*[:=]') OR regexp_matches(line, '\b\d{{1,4}}\s?[a-z]?\b') THEN 'high' ELSE 'low' END AS status FROM {_values('value, line', _STREETS)}""")
def street_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_STREETS, "value string, line string").select("value", V.street_status(F.col("value"), F.col("line")).alias("status"))


_FIELD_VALUES = [(x,) for x in ("****", "*", "xxx", "XXXX", "xx", "<redacted>", "[ MASKED ]", "hidden", "Sup3r", "/var/log/a.log", "/MySecret2026!", "~/a", "C:\\t", "C:verySecret", "D:/x", "\\\\srv\\a")]


@query(rf"""SELECT value, regexp_matches(value, '(?i)^(?:\*{{2,}}|x{{3,}}|[<\[]\s*(?:redacted|masked|hidden|removed|sanitized|filtered|secret|xxxx+)\s*[>\]]|(?:redacted|masked|hidden|removed|sanitized|filtered))$') AS masked,
  (left(value, 1) = '/' AND contains(substr(value, 2), '/')) OR left(value, 2) = '~/' OR left(value, 2) = '\\' OR regexp_matches(value, '^[A-Za-z]:[\\/]') AS path FROM {_values('value', _FIELD_VALUES)}""")
def masked_and_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return spark.createDataFrame(_FIELD_VALUES, "value string").select("value", X.is_masked(v).alias("masked"), X.looks_like_path(v).alias("path"))


_CELLS = [(x,) for x in ("=1+1", "  +x", "\t@y", "-z", "plain", "a\x01b", "\x02=3", "", "a=b")]


@query(f"SELECT cell, CASE WHEN regexp_matches(c, '^[ \\t\\r\\n\\f\\v]*[=+\\-@]') THEN '''' || c ELSE c END AS safe FROM (SELECT cell, regexp_replace(cell, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') AS c FROM {_values('cell', _CELLS)})")
def sanitize_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_CELLS, "cell string").select("cell", X.sanitize_cell(F.col("cell")).alias("safe"))


_KV = [(x,) for x in ("RVNR:65170839J008", '"password":"x"', "password=Secret", "2001:db8::1", "12:34:56", "https://user:pw@host/path", "plain", "a:", "{'k':'v'}", "x.y-z:1:2")]


@query(rf"""WITH t AS (SELECT token, regexp_extract(token, '^[\s"''{{\[(]*([\w.\-]{{1,60}})[\s"''}}\])]*([:=])(.+)$', ['k', 's', 'v']) AS m FROM {_values('token', _KV)}),
p AS (SELECT token, m.s AS s, trim(m.k, '"''{{}}[](),.;!? ') AS k, trim(m.v, {_STRIP}) AS v FROM t)
SELECT token, CASE WHEN ok THEN k END AS key, CASE WHEN ok THEN v END AS value FROM (SELECT *, NOT contains(token, '://') AND k <> '' AND v <> '' AND NOT (s = ':' AND regexp_full_match(k, '[0-9]+') AND contains(v, ':')) AS ok FROM p)""")
def inline_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_KV, "token string").withColumn("p", K.inline_pair(F.col("token"))).select("token", "p.key", "p.value")


@query("SELECT 10::BIGINT AS tp, 0::BIGINT AS fp, 0::BIGINT AS fn, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1")
def quality_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.createDataFrame([(i, "gold", i, t) for i, (t, _) in enumerate(GOLD)], "line_id int, file string, line_no int, line string")
    gold = spark.createDataFrame([(i, p) for i, (_, e) in enumerate(GOLD) for p in e], "line_id int, pattern string")
    return R.quality(gold, findings(detect(lines, shipped())))


@pytest.mark.parametrize("name", CASES)
def test_fixture(spark, sf, name):
    compare(spark, sf, name, *CASES[name])
