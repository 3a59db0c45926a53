import os

import pytest
from pyspark.sql import functions as F

from plumbline.operators.decode import decode, verify_positions
from plumbline.operators.report import file_names, guarded, route, split_keys
from plumbline.plans.preflight import PreflightError
from plumbline.run import check_conformance, new_run_id, run_qc
from plumbline.sources.runs import bind_results, read_run
from plumbline.sources.tables import read_csv, read_tables
from tests.core.mill import LINEAGE, edit, frames, mill_spec, rows


def dirty():
    data = rows()
    edit(data, "grinds", "G3", "grain", "XX")
    edit(data, "grinds", "G4", "grain", "=1+1")
    edit(data, "grinds", "G0", "grain", "YY")
    edit(data, "grinds", "G6", "old_grind_ref", "6-#")
    edit(data, "grinds", "G6", "grain", "ZZ")
    return data


def test_whole_run(spark, tmp_path):
    spec = mill_spec(lineage=LINEAGE, lineage_separators={"EAST": "-"}, contributors={"EAST": "EAST", "NORTH": "NORTH", "WEST": "WEST"})
    import dataclasses

    spec = dataclasses.replace(spec, lineage=spec.lineage, findings=())
    tables = frames(spark, dirty(), tmp_path / "in")
    overrides = [{"fingerprint": None, "rule_id": "code_not_in_list", "table_name": None, "column_name": "grain", "issue_class": "source", "who": "a", "when": "b", "why": "c", "valley": "EAST"}]
    from plumbline.plans.model import parse_lineage

    spec = dataclasses.replace(spec, lineage=(*spec.lineage, *parse_lineage("WEST", "grinds", "old_grind_ref", "Z")))
    run, root, pages = run_qc(spark, spec, tables, str(tmp_path / "out"), group_cols=["valley"], overrides=overrides, settings={"fallback_class": {"code_not_in_list": "harmonization"}})
    got = {i.record_pk: i for i in run.issues.collect()}
    assert (got["G3"].provider_key, got["G3"].provider_key_status, got["G3"].issue_class) == ("book.page=3; book.line=w", "decoded", "source")
    assert got["G6"].provider_key_status == "partial" and got["G4"].provider_key_status == "fallback_pk"
    assert (got["G4"].issue_class, got["G4"].class_basis) == ("harmonization", "fallback")
    assert verify_positions(run.bound, run.issues).isEmpty()
    stored = read_run(spark, root)
    assert sorted(map(str, stored.issues.collect())) == sorted(map(str, run.issues.collect())) and stored.results.schema == run.results.schema or set(stored.results.columns) == set(run.results.columns)
    both = bind_results(stored, stored)
    assert both.issues.select("issue_id").distinct().count() == 2 * len(got)
    assert set(pages) == {"EAST", "NORTH", "WEST"}
    with open(pages["EAST"]["csv"], encoding="utf-8-sig") as f:
        text = f.read()
    assert "G3" in text and "G4" not in text and "key_book.page" in text  # a unit never sees another's records
    with open(pages["NORTH"]["csv"], encoding="utf-8-sig") as f:
        assert "'=1+1" in f.read()
    with open(pages["NORTH"]["html"], encoding="utf-8") as f:
        page = f.read()
    assert "G3" not in page and "G4" in page and len(page) < 10_000_000
    with pytest.raises(FileExistsError):
        from plumbline.sources.runs import write_run

        write_run(run, str(tmp_path / "out"))


def test_stopped_run_leaves_its_findings(spark, tmp_path):
    import dataclasses

    spec = mill_spec()
    bad = dataclasses.replace(spec, attributes=tuple(dataclasses.replace(a, data_type="odd") if a.name == "grain" else a for a in spec.attributes))
    with pytest.raises(PreflightError):
        run_qc(spark, bad, "/nowhere", str(tmp_path))
    assert os.listdir(tmp_path / os.listdir(tmp_path)[0] / "metadata")


def test_routing_keeps_units_apart(spark, tmp_path):
    tables = frames(spark, dirty(), tmp_path)
    run = check_conformance(spark, mill_spec(), tables, group_cols=["valley"])
    units = ["EAST", "NORTH", "WEST"]
    total = run.issues.filter("level = 'record'").count()
    parts = [route(run.results, run.issues, u, units, ["valley"]) for u in units]
    assert sum(p[1].filter("level = 'record'").count() for p in parts) == total
    for u, (results, issues, _) in zip(units, parts, strict=True):
        assert issues.filter((F.col("valley") != u) & (F.col("level") == "record")).isEmpty() and results.filter("examples is not null").isEmpty()


def test_keys_split(spark):
    rows_ = [("a=1; b=2", "decoded"), ("b=3; a=4", "decoded"), ("x", "raw"), ("a=1; a=2", "decoded"), (None, "fallback_pk")]
    got = split_keys(spark.createDataFrame(rows_, "provider_key string, provider_key_status string")).collect()
    assert {(r.provider_key, r.key_a, r.key_b) for r in got} == {("a=1; b=2", "1", "2"), ("b=3; a=4", "4", "3"), ("x", None, None), ("a=1; a=2", None, None), (None, None, None)}


def test_guard(spark):
    cells = [("=x", "'=x"), ("-1.5", "-1.5"), ("-x", "'-x"), ("+1", "'+1"), ("@a", "'@a"), ("ok", "ok")]
    assert [r[0] for r in spark.createDataFrame(cells, "c string, w string").select(guarded(F.col("c"))).collect()] == [w for _, w in cells]


def test_file_names():
    got = file_names(["a/b", "con", "é", ".x"])
    assert got["a/b"] == "a%2Fb" and got["con"] == "_con" and got["é"] == "%C3%A9" and got[".x"] == "%2Ex"
    with pytest.raises(ValueError):
        file_names(["A", "a"])
    with pytest.raises(ValueError):
        file_names(["é" * 40])


def test_csv(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_bytes('a;b\n1;""\n;"x ""y"""\n"two\nlines";'.encode() + "é".encode("cp1252") + b"\n")
    got = [tuple(r) for r in read_csv(spark, str(p)).collect()]
    assert got == [("1", ""), (None, 'x "y"'), ("two\nlines", "é")]
    tables, text = read_tables(spark, {"t": str(p)})
    assert text == {"t"} and tables["t"].columns == ["a", "b"]
    p.write_bytes(b"a,b\n1,2")
    with pytest.raises(ValueError, match="does not end"):
        read_csv(spark, str(p))
    p.write_bytes(b"a,a\n1,2\n")
    with pytest.raises(ValueError, match="twice"):
        read_csv(spark, str(p))


def test_run_id():
    import re

    assert re.fullmatch(r"\d{8}T\d{6}Z_[0-9a-f]{6}", new_run_id())


def test_decode_without_spec(spark, tmp_path):
    run = check_conformance(spark, mill_spec(), frames(spark, dirty(), tmp_path), rules=["code_not_in_list"])
    assert {i.provider_key_status for i in decode(run.bound, run.issues).collect()} == {"fallback_pk"}  # no ID has an entry


def test_flags(spark, tmp_path):
    """Conditions read the caller's flags, of the record's own table or of its parent's in a nested ID's table."""
    lineage = [{"contributor_label": "*", "table_name": "grinds", "attribute_name": "old_grind_ref", "source_text": "book.page + book.line"}]
    when = [{"contributor_label": "*", "table_name": "grinds", "attribute_name": "old_grind_ref", "part_order": "1", "part_source": "boat.number", "when": 'flag.towed == "yes"'}, {"contributor_label": "*", "table_name": "grinds", "attribute_name": "old_grind_ref", "part_order": "1", "part_source": "far.number", "when": "is_present(flag.towed)"}]
    spec = mill_spec(lineage=lineage, lineage_when=when, lineage_separators={"*": "-"}, contributors={"EAST": "*", "NORTH": "*", "WEST": "*"})
    assert not [f for f in spec.findings if f.check == "lineage_when_invalid"]
    run = check_conformance(spark, spec, frames(spark, dirty(), tmp_path), rules=["code_not_in_list"], group_cols=["valley"])
    flags = spark.createDataFrame([("G0", "yes"), ("G3", "no"), ("G5", "yes")], "grind_no string, towed string")
    got = {i.record_pk: i.provider_key for i in decode(run.bound, run.issues, {"grinds": flags}).collect()}
    assert (got["G0"], got["G3"], got["G4"]) == ("boat.number=0; book.line=w", "far.number=3; book.line=w", "book.page=4; book.line=w")
    again = decode(run.bound, run.issues, {"grinds": spark.createDataFrame([("G4", "yes")], flags.schema)})  # flags of an earlier call are gone
    assert {i.record_pk: i.provider_key.split("=")[0] for i in again.filter("record_pk <> 'G6'").collect()} == {"G0": "book.page", "G3": "book.page", "G4": "boat.number"}
    for rows_, told in (([("G0", "a"), ("G0", "b")], "more than once"), ([("G99", "a")], "no record"), ([(None, "a")], "no record")):
        with pytest.raises(ValueError, match=told):
            decode(run.bound, run.issues, {"grinds": spark.createDataFrame(rows_, "grind_no string, towed string")})
    with pytest.raises(ValueError, match="a flag"):
        decode(run.bound, run.issues, {"grinds": flags.select("grind_no")})
    with pytest.raises(ValueError, match="no table"):
        decode(run.bound, run.issues, {"nowhere": flags})


def test_stream(spark, tmp_path):
    from plumbline.streaming.increment import check_stream

    frames(spark, dirty(), tmp_path / "in")
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in/grinds.parquet")).schema).parquet(str(tmp_path / "in/grinds.parquet"))
    got = []
    query = check_stream(stream, mill_spec(), "grinds", lambda results, issues, n: got.extend(issues.filter("rule_id = 'code_not_in_list'").collect()), str(tmp_path / "check"), available_now=True)
    query.awaitTermination()
    assert {i.record_pk for i in got} == {"G0", "G3", "G4", "G6"}
