import duckdb
from pyspark.sql import functions as F

from plumbline import queries
from plumbline.functions import values as V
from plumbline.operators import rules
from plumbline.operators.bind import ROW, identified
from plumbline.plans.model import Attribute, Spec, sentinels, type_map
from plumbline.run import check_conformance


def test_rows_keep_their_delivered_order(spark, tmp_path):
    """A small first and a large second file, read in splits of any size: rows are numbered as delivered."""
    spark.range(0, 50).coalesce(1).write.parquet(str(tmp_path / "a"))
    spark.range(50, 200_000).coalesce(1).write.option("parquet.block.size", 1 << 17).parquet(str(tmp_path / "b"))
    (tmp_path / "t").mkdir()
    for name in "ab":
        next((tmp_path / name).glob("part-*")).rename(tmp_path / "t" / f"{name}.parquet")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        found = []
        for size in ("100k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1k")
            rows = identified(spark.read.parquet(str(tmp_path / "t")), [F.col("id")])
            found.append([r.id for r in rows.orderBy(ROW).collect()])
        assert found[0] == found[1] == list(range(200_000))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_tables_that_are_no_files(spark):
    rows = identified(spark.range(10).repartition(3), [F.col("id")]).collect()
    assert len({r[ROW] for r in rows}) == 10


def test_code_set_counts_kept_values(spark, tmp_path):
    """Five codes in 500 rows look like a code set, however many blanks of different width stand beside them."""
    spec = Spec((Attribute("t", "k", "string", "PK"), Attribute("t", "c")), type_map(), sentinels(queries.CODES))
    for more in (0, 600):
        data = [(f"r{n}", f"code{n % 5}") for n in range(500)] + [(f"b{n}", " " * (n + 1)) for n in range(more)]
        spark.createDataFrame(data, "k string, c string").write.parquet(str(tmp_path / str(more)))
        run = check_conformance(spark, spec, {"t": spark.read.parquet(str(tmp_path / str(more)))}, rules=["undeclared_code_set"])
        assert [r.status for r in run.results.filter("column_name = 'c'").collect()] == ["fail"]
    many = [(f"r{n}", f"code{n % 400}") for n in range(1200)]
    spark.createDataFrame(many, "k string, c string").write.parquet(str(tmp_path / "many"))
    run = check_conformance(spark, spec, {"t": spark.read.parquet(str(tmp_path / "many"))}, rules=["undeclared_code_set"])
    assert [r.status for r in run.results.filter("column_name = 'c'").collect()] == ["pass"]


def test_signatures_are_compared_by_their_lines(spark, sf_dir, monkeypatch):
    """With the number of lines alone as a print, nearly all prints collide, and the twins stay the same."""
    run = queries.QUERIES["design_duplicate_signature_orders"]
    want = sorted(map(str, run(spark, sf_dir).collect()))
    monkeypatch.setattr(rules, "SIGNATURE_SUMS", ())
    assert sorted(map(str, run(spark, sf_dir).collect())) == want and want


def test_whole_numbers_as_text(spark):
    values = [0.0, -0.0, 5.0, -12.0, 999999999999999.0, 1e15, 1e22, 0.1, -2.5, 123456789.125]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in frame.select(V.number_text(F.col("x"))).collect()] == ["0", "0", "5", "-12", "999999999999999", "1000000000000000", "10000000000000000000000", "0.1", "-2.5", "123456789.125"]


def test_bound_runs_are_numbered_as_their_sql_does(spark, tmp_path):
    """Files against the keys' order, a repeated and an unknown key, and balances that are codes or no finite numbers."""
    balances = [-5.0, 9500.0, -99.0, -88.0, 0.0, -0.0, 9000.0, 9000.01, float("nan"), float("inf"), float("-inf"), None, -1.5, 9999.0]
    rows = [(n % 37 if n != 10 else None, f"c{n}", n % 5, balances[n % len(balances)], "BUILDING") for n in range(41)]
    for k, part in enumerate((rows[30:], rows[29:12:-1], rows[:13])):
        spark.createDataFrame(part, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").coalesce(1).write.parquet(str(tmp_path / str(k)))
    (tmp_path / "customer.parquet").mkdir()
    for k in range(3):
        next((tmp_path / str(k)).glob("part-*")).rename(tmp_path / "customer.parquet" / f"{k}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = con.execute(queries.SQL["bind_two_runs"]).fetchall()
    got = queries.QUERIES["bind_two_runs"](spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and {r[1] for r in want} == {1, 2}
