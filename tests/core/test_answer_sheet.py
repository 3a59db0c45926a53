"""Each planted defect is found by its rule, in its record, with its value, and by no other but those it entails."""

import pytest

from plumbline.run import check_conformance
from tests.core.mill import VALLEYS, edit, frames, mill_spec, rows


SHEET = [
    ("grinds", "G3", "mill_no", "M55", "fk_orphan", "M55", set()),
    ("grinds", "G3", "mill_no", None, "fk_unassigned", None, set()),
    ("grinds", "G3", "mill_no", "#", "fk_unassigned", "#", set()),
    ("grinds", "G3", "grain", "MAIZE", "code_not_in_list", "MAIZE", set()),
    ("grinds", "G3", "grain", "RYE ", "whitespace_padding", "RYE ", set()),
    ("grinds", "G3", "grain", "", "blank_string", "", set()),
    ("grinds", "G3", "grain", None, "raw_na", None, set()),
    ("grinds", "G3", "grain", "-77", "sentinel_wrong_type", "-77", set()),
    ("grinds", "G3", "grain", "UNK", "sentinel_rogue_code", "UNK", set()),
    ("grinds", "G3", "turns", 901, "value_above_max", "901", set()),
    ("grinds", "G3", "turns", 4, "value_below_min", "4", set()),
    ("sacks", "K5", "mass", 2.0, "value_below_min", "2", set()),
    ("sacks", "K5", "mass", 31.415, "decimals_exceeded", "31.415", set()),
    ("sacks", "K5", "mass", float("inf"), "value_not_finite", "Inf", set()),
    ("sacks", "K5", "mass", -999.0, "sentinel_rogue_code", "-999", set()),
    ("mills", "M2", "title", "mill no 2", "pattern_mismatch", "mill no 2", set()),
    ("mills", "M2", "title", "M" + "i" * 30, "string_too_long", "M" + "i" * 30, set()),
    ("mills", "M2", "built", "31.04.1901", "date_unparseable", "31.04.1901", set()),
    ("mills", "M4", "wheel", 12.5, "value_above_max", "12.5", set()),
    ("grinds", "G3", "old_grind_ref", "NA", "na_text_in_id", "NA", set()),
    ("grinds", "G3", "old_grind_ref", "12-w", "src_id_duplicate", "12-w", set()),
    ("sacks", "K5", "sack_no", "K6", "pk_duplicate", "K6", set()),
    ("sacks", "K5", "sack_no", None, "pk_missing", None, set()),
]


def findings(spark, data, folder, **more):
    run = check_conformance(spark, mill_spec(), frames(spark, data, folder), group_cols=["valley"], **more)
    return run, run.issues.filter("status = 'open'").collect()


def test_clean(spark, tmp_path):
    run, found = findings(spark, rows(), tmp_path)
    assert found == []
    results = run.results.collect()
    assert {r.status for r in results} <= {"pass", "not_run"}
    total = {t: len(x) for t, x in rows().items()}
    from plumbline.operators.record import adds_up

    assert adds_up(run.results, total).collect() == []
    assert {r.valley for r in results if r.table_name == "sacks" and r.rule_id == "raw_na"} == set(VALLEYS)
    from plumbline.sources.runs import problems

    assert problems(run.results, run.issues) == []


@pytest.mark.parametrize("defects", [SHEET[:8], SHEET[8:15], SHEET[15:]], ids=["a", "b", "c"])
def test_planted(spark, tmp_path, defects):
    """Defects of one batch touch different cells or are checked one by one."""
    seen = {}
    for d in defects:
        seen.setdefault((d[0], d[1], d[2]), []).append(d)
    rounds = max(len(v) for v in seen.values())
    for k in range(rounds):
        data, batch = rows(), [v[k] for v in seen.values() if len(v) > k]
        for table, key, column, value, *_ in batch:
            edit(data, table, key, column, value)
        _, found = findings(spark, data, tmp_path / str(k))
        got = {(i.rule_id, i.table_name, i.column_name, i.value) for i in found}
        for table, _key, column, _value, rule, witness, _more in batch:
            assert (rule, table, column, witness) in got, (rule, got)
        extra = {g[0] for g in got} - {b[4] for b in batch} - set().union(*[b[6] for b in batch])
        assert not extra


def test_masks_and_collapse(spark, tmp_path):
    data = rows(60)
    data["sacks"] = [(*r[:3], "  " if k % 3 == 0 else r[3]) for k, r in enumerate(data["sacks"])]
    run, found = findings(spark, data, tmp_path, settings={"column_level_min_n": 5}, layers=(2, 3))
    whole = [i for i in found if i.level == "column"]
    assert {(i.rule_id, i.valley, i.n_records) for i in whole} == {("blank_string", "EAST", 20)}
    masked = [i for i in run.issues.collect() if i.status == "not_evaluated" and i.rule_id == "code_not_in_list"]
    assert [(i.level, i.n_records, i.root_issue_id) for i in masked] == [("column", 20, whole[0].issue_id)]
    ids = [i.issue_id for i in run.issues.collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1))
    row = next(r for r in run.results.collect() if r.rule_id == "code_not_in_list" and r.table_name == "sacks" and r.valley == "EAST")
    assert (row.status, row.not_run_reason, row.n_not_evaluated) == ("not_run", "none_checked", 20)


def test_structure_and_empty_tables(spark, tmp_path):
    tables = frames(spark, {**rows(), "sacks": []}, tmp_path)
    tables["grinds"] = tables["grinds"].withColumnRenamed("grain", " Grain").drop("turns")
    tables["odd"] = tables["mills"]
    del tables["mills"]
    run = check_conformance(spark, mill_spec(), tables)
    got = {(i.rule_id, i.table_name, i.column_name) for i in run.issues.filter("layer = 0").collect()}
    assert got == {("table_missing", "mills", "*"), ("table_unexpected", "odd", "*"), ("column_missing", "grinds", "turns"), ("column_name_mismatch", "grinds", "grain")}
    why = {(r.rule_id, r.table_name, r.column_name): r.not_run_reason for r in run.results.collect()}
    assert why["raw_na", "sacks", "grade"] == "no_records" and why["fk_orphan", "grinds", "mill_no"] == "no_table" and why["value_above_max", "grinds", "turns"] == "no_column"


def test_refuses(spark):
    nested = spark.createDataFrame([(1, [1])], "a int, b array<int>")
    with pytest.raises(ValueError, match="more than one value"):
        check_conformance(spark, mill_spec(), {"mills": nested})
    with pytest.raises(ValueError, match="no attribute"):
        check_conformance(spark, mill_spec(), {}, group_cols=["nope"])
    with pytest.raises(ValueError, match="unknown setting"):
        check_conformance(spark, mill_spec(), {}, settings={"nope": 1})
