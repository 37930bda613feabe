from pyspark.sql import functions as F

from siftlake.config import ScanConfig
from siftlake.operators import findings as R


def _found(spark, rows):
    df = spark.createDataFrame([(p, k, n, v, f, i) for i, (p, k, n, v, f) in enumerate(rows)], "pattern string, kind string, krit int, value string, file string, line_no int")
    context = F.struct(F.concat(F.lit("x "), "value", F.lit(" y")).alias("text"), F.lit(2).alias("start"), (F.lit(2) + F.char_length("value")).alias("end"))
    return df.withColumns({"seq": F.lit(0), "confidence": F.lit("high"), "orig": F.col("value"), "token": F.lit(None).cast("string"), "context": context})


def test_caps(spark):
    rows = [("email", "regexp", 4, f"v{i % 50}", "f") for i in range(150)]
    assert R.cap(_found(spark, rows), ScanConfig(max_values_per_pattern=10)).select("value").distinct().count() == 10
    assert R.cap(_found(spark, [("a", "regexp", 1, "v", "f")] * 20), ScanConfig(max_examples_per_value=3)).count() == 3
    assert R.cap(_found(spark, rows), ScanConfig(max_total_examples=5)).count() == 5
    assert R.dropped_values(_found(spark, rows), ScanConfig(max_values_per_pattern=10)).first()["n_dropped"] == 40


def test_summary_and_sheets(spark):
    found = _found(spark, [("b", "regexp", 2, "=1+1", "f2"), ("b", "regexp", 2, "aa", "f1"), ("a", "field", 2, "pw", "f1"), ("c", "string", 5, "w", "f1")])
    s = {r["pattern"]: r for r in R.summary(found).collect()}
    assert s["b"]["n_values"] == 2 and s["b"]["files"] == ["f1", "f2"] and s["b"]["sample_values"] == ["=1+1", "aa"]
    sheet = R.findings_sheet(R.summary(found), 4).collect()
    assert [r["Muster"] for r in sheet] == ["a", "b"] and sheet[1]["Beispiele"].startswith("'=")
    full = R.full_sheet(found, mask="<redacted>").collect()
    assert full[0]["Logeintrag"] == "x >>><redacted><<< y" and full[0]["Gefundener_Wert"] == "<redacted>"


def test_highlight(spark):
    row = lambda t, v, s=-1, e=-1: spark.createDataFrame([(t, v, s, e)], "t string, v string, s int, e int").select(R.highlight(F.col("t"), F.col("v"), F.lit("$1\\"), F.col("s"), F.col("e"))).first()[0]
    assert row("Anna und Susanna, ANNA", "anna") == "$1\\ und Susanna, $1\\"
    assert row("x.*y", ".*") == "x$1\\y" and row("nothing", "") == "nothing"


def test_status():
    assert R.scan_status(0, 0, 3) == ("failed", 4) and R.scan_status(2, 1, 0) == ("partial", 3) and R.scan_status(2, 0, 0) == ("complete", 0)
