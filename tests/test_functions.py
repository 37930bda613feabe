import base64
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftlake.functions import redact, text, validators


def _segment(value):
    return base64.urlsafe_b64encode(json.dumps(value).encode()).decode().rstrip("=")


TRUTH = [
    ("card_valid", ["4111 1111 1111 1111", "4111-1111-1111-1111", "5500005555555559", "340000000000009"], ["4111111111111112", "1234567890123456", "12345", "abcd", ""]),
    ("luhn_valid", ["79927398713"], ["79927398714", "", "x"]),
    ("iban_valid", ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"], ["DE00 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130", "XX00 1234", ""]),
    ("tax_id_valid", ["86095742719"], ["12345678901", "11111111111", "00000000000", "8609574271", "8609574271A", ""]),
    ("jwt_valid", [f"{_segment({'alg': 'x'})}.{_segment({})}.sig"], ["a.b", "a.b.c.d", "notbase64!.notbase64!.sig", f"{_segment([1])}.{_segment({})}.x", f"{_segment({})}.{_segment({})}."]),
]


@pytest.mark.parametrize("name,good,bad", TRUTH)
def test_validators(spark, name, good, bad):
    df = spark.createDataFrame([(s,) for s in good + bad], "s string")
    got = [r[0] for r in df.select(getattr(validators, name)(F.col("s"))).collect()]
    assert got == [True] * len(good) + [False] * len(bad)


def test_sql_names(spark):
    validators.register(spark)
    row = spark.sql("SELECT iban_valid('DE89 3704 0044 0532 0130 00'), tax_id_valid('86095742719'), norm('Múltiple Straße'), redact('amelie.hofmann@beispiel.de'), street_status('Hauptstraße', 'Hauptstraße')").first()
    assert tuple(row) == (True, True, "multiple strasse", "ame**e.h**man**bei**iel**e", "low")


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40), st.sampled_from(["sss**sss**sss**", "s*", "**", "<redacted>", "", "?!", "ssxx"]))
def test_redacted_length_and_secrecy(value, mask):
    out = redact.redact_text(value, mask)
    if out != "<redacted>":
        assert len(out) == len(value)
        assert len(value) < 6 or "*" in out


def test_redact_column_is_redact_text(spark):
    values = ["", "a", "Anna", "Anna1", "amelie.hofmann@beispiel.de", "Straße 😀 abc"]
    for mask in ("sss**sss**sss**", "s*", "<redacted>", "**s"):
        got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(redact.redact(F.col("v"), mask)).collect()]
        assert got == [redact.redact_text(v, mask) for v in values]


def test_norm_on_both_sides(spark):
    values = ["Hamburg", "MÜNCHEN", "Straße", "Čapek", "Múltiple", "Ǆ", "résumé", "Ελλάδα"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(text.norm(F.col("v"))).collect()]
    assert got == [text.norm_text(v) for v in values]


def test_context_window_marks_cuts(spark):
    line = "a" * 200 + "SECRET" + "b" * 200
    row = spark.createDataFrame([(line,)], "l string").select(text.context_window(F.col("l"), F.lit(200), F.lit(206), 10, 5)).first()[0]
    assert row["text"][row["start"] : row["end"]] == "SECRET" and row["cut"] and row["text"].count("[gekuerzt]") == 2
