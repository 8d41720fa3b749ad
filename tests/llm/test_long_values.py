"""Values of any length are proposed whole."""

from labourmill.llm import pii
from pyspark.sql import functions as F


def test_long_secret_and_name(spark):
    secret, name = "password=" + "aB3/" * 2000, "Dr. " + "A" + "b" * 90 + " " + "C" + "d" * 90
    df = spark.createDataFrame([(1, secret), (2, name)], "doc_id long, text string")
    for i, (kind, text) in enumerate((("secret", secret), ("name", name)), 1):
        found = df.filter(F.col("doc_id") == i).select(F.regexp_extract("text", pii.ADDED[kind], 0)).first()[0]
        assert found == text


def test_long_secret_is_redacted(spark):
    value = "aB3/" * 2000
    texts = [f"login with password={value[: 12 + i % 9]} for host {i}" for i in range(40)] + [f"login with password={value} for host"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = df.sparkSession.createDataFrame([tuple(r) for r in pii.redact(df).collect()], df.schema).filter("doc_id = 40").first().text
    assert out != texts[40] and "aB3/aB3/" not in out and out.endswith(" for host")
