import pytest
from pyspark.sql import functions as F

from plumbline.functions import values as V
from plumbline.sources.tables import from_bytes_text

NUMBERS = [(0.0, "0"), (-0.0, "0"), (1.0, "1"), (1.5, "1.5"), (0.1, "0.1"), (1e7, "10000000"), (123456789.125, "123456789.125"), (1e21, "1000000000000000000000"), (1e-7, "0.0000001"), (-2.5e-3, "-0.0025"), (1e22, "10000000000000000000000"), (100000.0, "100000"), (float("nan"), "NaN"), (float("inf"), "Inf"), (float("-inf"), "-Inf"), (None, None), (1 / 3, "0.333333333333333")]


def test_number_text(spark):
    df = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(NUMBERS)], "k int, x double")
    got = {r.k: r.t for r in df.select("k", V.number_text(F.col("x")).alias("t")).collect()}
    assert [got[k] for k in range(len(NUMBERS))] == [t for _, t in NUMBERS]


@pytest.mark.parametrize(
    "text,value,lost,endless",
    [("1", 1.0, False, False), (" 1.5 ", 1.5, False, False), ("1d", None, True, False), ("0x1F", None, True, False), ("abc", None, True, False), ("", None, True, False), ("1e3", 1000.0, False, False), (".5", 0.5, False, False), ("Inf", float("inf"), False, True), ("-inf", float("-inf"), False, True), ("+7", 7.0, False, False), (None, None, False, False), ("1 2", None, True, False)],
)
def test_read_number(spark, text, value, lost, endless):
    n = V.read_number(F.col("c"), "string", False)
    r = spark.createDataFrame([(text,)], "c string").select(n.value.alias("v"), n.lost.alias("l"), n.not_finite.alias("e")).first()
    assert (r.v, r.l, r.e) == (value, lost, endless)


def test_whole_numbers(spark):
    n = V.read_number(F.col("c"), "double", True)
    got = [r.l for r in spark.createDataFrame([(1.0,), (1.5,), (3e9,), (-2147483647.0,), (float("nan"),)], "c double").select(n.lost.alias("l")).collect()]
    assert got == [False, True, True, False, False]
    n = V.read_number(F.col("c"), "bigint", False)
    got = [r.l for r in spark.createDataFrame([(2**53,), (2**53 + 1,), (2**63 - 1,)], "c bigint").select(n.lost.alias("l")).collect()]
    assert got == [False, True, True]


def test_spaces(spark):
    rows = [("", True, False, ""), (" \t\r\n", True, False, ""), (" ", True, False, ""), ("a", False, False, "a"), (" a", False, True, "a"), ("a\n", False, True, "a"), (" é ", False, True, "é"), ("\x0b", False, False, "\x0b"), ("a b", False, False, "a b")]
    df = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "k int, c string")
    got = sorted(df.select("k", V.is_blank(F.col("c")), V.is_padded(F.col("c")), V.trimmed(F.col("c"))).collect())
    assert [tuple(r)[1:] for r in got] == [r[1:] for r in rows]


def test_dates(spark):
    rows = [("2020-02-29", True), ("2020-02-30", False), ("2020-1-1", False), ("20200101", False), ("x", False), (" 2020-01-01", False)]
    df = spark.createDataFrame(rows, "c string, ok boolean")
    assert all(r[0] == r.ok for r in df.select(V.reads_as_date(F.col("c"), "%Y-%m-%d"), "ok").collect())
    with pytest.raises(ValueError):
        V.java_format("%Q")


def test_patterns():
    assert V.java_pattern("^[[:alpha:]]+$") == r"^[\p{Alpha}]+$"
    with pytest.raises(ValueError):
        V.java_pattern("[[:nope:]]")


def test_bytes(spark):
    cells = ["é".encode(), "é".encode("cp1252"), b"\x81x", "€".encode("cp1252"), b"plain"]
    df = spark.createDataFrame([(b.decode("latin-1"),) for b in cells], "c string")
    assert [r[0] for r in df.select(from_bytes_text(F.col("c"))).collect()] == ["é", "é", "\x81x", "€", "plain"]
