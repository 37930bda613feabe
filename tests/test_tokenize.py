import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftlake.operators import tokenize as K


def _tokens(spark, line, mode):
    return spark.createDataFrame([(line,)], "line string").select(K.tokens(F.col("line"), mode)).first()[0]


@pytest.mark.parametrize("mode", ["auto", "true", "false"])
@pytest.mark.parametrize(
    "line,wanted",
    [
        ("GET /app?email=test@mail.de&name=Hans", ["test@mail.de", "Hans"]),
        ("GET /login?nr=65 170839 J 08 8", ["65 170839 J 08 8"]),
        ("jdbc:oracle://admin:P@ssw0rd!@host:1521/db", ["admin", "P@ssw0rd!"]),
        ("https://x.org/?filters[email]=a%40b.example", ["a@b.example"]),
        ("https://x.org/?password=Secret%402026", ["Secret@2026"]),
    ],
)
def test_values_of_urls(spark, mode, line, wanted):
    assert set(wanted) <= set(_tokens(spark, line, mode))


def test_json_lines(spark):
    assert "admin" in _tokens(spark, '{"message": "login", "user": "admin"}', "auto")
    assert "password:Secret123" in _tokens(spark, '{"password":"Secret123"}', "true")
    fragment = '{"street":"Gartenweg 7","zip":"50667"}'
    got = _tokens(spark, f"payload {fragment} rest", "auto")
    assert fragment in got and got.index(fragment) < got.index("Gartenweg") < got.index("rest")


def test_python_and_sql_agree_without_json(spark):
    lines = ["GET /app?email=test@mail.de&name=Hans", "a=b;c|d,e https://u:p@h/x?y=%zz+1&q=a%41", "plain words", "", "http://[::1]:80/x?z=1 user@x", "x?a=ä%C3%BC&b="]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select(K.plain_tokens(F.col("line"))).collect()
    assert [r[0] for r in got] == [K.json_tokens(x) for x in lines]


@settings(max_examples=300, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=4), c, max_size=3), max_leaves=8), st.text(max_size=10))
def test_json_tokenizer_never_fails(value, around):
    K.json_tokens(json.dumps(value))
    K.json_tokens(around + json.dumps({"k": value}) + around)
    K.json_tokens(around + "{" + around)


def test_deep_and_wide_json_is_bounded():
    deep = "[" * 200 + '"x"' + "]" * 200
    assert K._Walk(json.loads(deep)).strings == []
    assert len(K._Walk([str(i) for i in range(5000)]).strings) == K.MOST_VALUES
