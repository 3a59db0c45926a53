import dataclasses

import pytest

from plumbline.operators.decode import entry_slots
from plumbline.plans import preflight as P
from plumbline.plans.model import Attribute, Condition, Finding, Spec, add_conditions, lineage_tokens, match_columns, parse_condition, parse_lineage, resolve_clashes, sentinels, type_map
from plumbline.plans.registry import PREFLIGHT, RULES
from plumbline.plans.settings import RuleSet, resolve, rule_row_value, severity_of, enabled
from plumbline.sources import spec_files
from tests.core.mill import COLUMNS, DICTIONARY, LINEAGE, mill_spec


def outcome(spec=None, settings=None, rule_set=None, **more):
    spec, rule_set = spec or mill_spec(), rule_set or RuleSet()
    rows = P.preflight_rows(P.Inputs(spec, resolve(settings, rule_set, more.pop("options", None)), rule_set, **more))
    return {r["check"] for r in rows if r["outcome"] in ("stop", "warn")}


def test_registry():
    assert len(RULES) == 39 and len(PREFLIGHT) == 40 and set(P.CHECKS) == {r.rule_id for r in PREFLIGHT}


def test_clean_spec():
    assert outcome() == {"lineage_id_unflagged"} - {"lineage_id_unflagged"}


def change(field, **values):
    s = mill_spec()
    return dataclasses.replace(s, attributes=tuple(dataclasses.replace(a, **values) if a.name == field else a for a in s.attributes))


def extra(**values):
    return dataclasses.replace(mill_spec(), **values)


@pytest.mark.parametrize(
    "check,make",
    [
        ("dd_duplicate_attribute", lambda: extra(attributes=mill_spec().attributes + mill_spec().attributes[:1])),
        ("dd_name_missing", lambda: change("grain", name=" ")),
        ("dd_type_unknown", lambda: change("grain", data_type="odd")),
        ("dd_pk_missing", lambda: change("sack_no", key=None)),
        ("dd_fk_target_missing", lambda: change("mill_no", reference="nowhere")),
        ("code_list_missing", lambda: change("grain", lookup="nowhere")),
        ("code_column_missing", lambda: extra(code_lists=mill_spec().code_lists | {"grain": [{"other": "x"}]})),
        ("code_list_duplicate_code", lambda: extra(code_lists=mill_spec().code_lists | {"grain": [{"grain": "RYE"}, {"grain": "RYE"}]})),
        ("code_list_blank_row", lambda: extra(code_lists=mill_spec().code_lists | {"grain": [{"grain": "RYE"}, {"grain": None}]})),
        ("code_list_unreferenced", lambda: extra(code_lists=mill_spec().code_lists | {"more": [{"a": "b"}]})),
        ("code_list_empty_column", lambda: extra(code_lists=mill_spec().code_lists | {"grain": [{"grain": "RYE", "b": None}]})),
        ("spec_clash_resolved", lambda: extra(clashes=({"sheet": "s", "key": "k", "attribute_name": "a", "dictionary": "1", "other": "2", "winner": "sheet"},))),
        ("spec_clash_unresolved", lambda: extra(clashes=({"sheet": "s", "key": "k", "attribute_name": "a", "dictionary": "1", "other": "2", "winner": None},))),
        ("site_id_range_invalid", lambda: extra(id_bands=({"key_value": "a", "band_start": 1, "band_end": 5}, {"key_value": "b", "band_start": 5, "band_end": 9}))),
        ("lineage_spec_unparseable", lambda: extra(lineage=tuple(parse_lineage("A", "grinds", "old_grind_ref", "a ++ b")))),
        ("lineage_when_invalid", lambda: extra(lineage=tuple(dataclasses.replace(e, when="wheel > 3") for e in parse_lineage("A", "grinds", "old_grind_ref", "n.a")))),
        ("lineage_name_unknown", lambda: extra(lineage=tuple(parse_lineage("A", "grinds", "old_grind_ref", "nothing")))),
        ("lineage_spec_row_unflagged", lambda: extra(lineage=tuple(parse_lineage("A", "grinds", "grain", "n.a")))),
        ("lineage_id_unflagged", lambda: extra(attributes=(*mill_spec().attributes, Attribute("grinds", "src_x_id", "text", id_marked=True)))),
        ("dd_format_invalid", lambda: change("title", pattern="[[:nope:]]")),
        ("key_pair_invalid", lambda: extra(key_pairs=({"table_name": "grinds", "left": "mill_no > nope", "right": "grain"},))),
        ("reach_invalid", lambda: extra(reach=({"table_name": "grinds", "attribute_name": "mill_no", "how": "from_parent"},))),
        ("one_to_many_invalid", lambda: extra(one_to_many=({"contributor_label": "Z", "table_name": "grinds", "attribute_name": "grain"},))),
        *[(c, lambda c=c: mill_spec().with_findings(Finding(c, "here", "what"))) for c in ("dd_type_column_ambiguous", "datasets_row_missing", "spec_encoding_invalid", "spec_csv_malformed", "crosswalk_unreadable")],
    ],
)
def test_spec_defects(check, make):
    assert check in outcome(make())


@pytest.mark.parametrize(
    "check,more",
    [
        ("rule_set_unknown_column", {"rule_set": RuleSet(({"rule_id": "raw_na", "table_name": "nope"},))}),
        ("rule_id_unknown", {"rule_set": RuleSet(({"rule_id": "nope"},))}),
        ("rule_set_override_invalid", {"rule_set": RuleSet(({"rule_id": "raw_na", "severity": "info"},))}),
        ("rule_set_duplicate_row", {"rule_set": RuleSet(({"rule_id": "raw_na"}, {"rule_id": "raw_na"}))}),
        ("setting_unknown_name", {"settings": {"coordinate_attributes": ("nope",)}}),
        ("option_unknown_name", {"options": {"coordinate_attributes": "nope"}}),
        ("text_id_missing", {"texts": {"en": {}}, "needed_texts": {"a": set()}}),
        ("text_id_fallback", {"settings": {"lang": "fr"}, "texts": {"en": {"a": "x"}}, "needed_texts": {"a": set()}}),
        ("text_slot_unknown", {"texts": {"en": {"a": "x {odd}"}}, "needed_texts": {"a": {"n"}}}),
        ("input_unparseable", {"run_inputs": {"overrides": [{"rule_id": "raw_na"}]}}),
        ("override_scope_conflict", {"run_inputs": {"overrides": [{"rule_id": "raw_na", "issue_class": "source"}, {"rule_id": "raw_na", "issue_class": "harmonization"}]}}),
        ("override_unknown_name", {"run_inputs": {"overrides": [{"rule_id": "nope", "issue_class": "source"}]}}),
    ],
)
def test_configuration_defects(check, more):
    assert check in outcome(**more)


def test_stop():
    with pytest.raises(P.PreflightError) as e:
        P.run_preflight(change("grain", data_type="odd"), resolve(), RuleSet())
    assert any(r["check"] == "dd_type_unknown" for r in e.value.table)


def test_settings_tiers():
    rules = RuleSet(({"rule_id": "raw_na", "severity": "warning", "table_name": "grinds"}, {"rule_id": "raw_na", "attribute_name": "grain", "enabled": "false"}), {"example_cap": 3})
    assert resolve({"example_cap": 2}, rules)["example_cap"] == 2 and resolve(None, rules, {"example_cap": "9"})["example_cap"] == 3 and resolve(None, None, {"example_cap": "9"})["example_cap"] == 9
    from plumbline.plans.registry import BY_ID

    r = resolve(None, rules)
    assert severity_of(BY_ID["raw_na"], "grinds", "grain", r, rules) == "warning" and severity_of(BY_ID["raw_na"], "sacks", "grain", r, rules) == "error"
    assert not enabled(BY_ID["raw_na"], "sacks", "grain", rules) and enabled(BY_ID["raw_na"], "grinds", "x", rules)
    assert rule_row_value(rules, "raw_na", "grinds", "grain", "severity") == "warning"
    with pytest.raises(ValueError):
        resolve({"example_cap": -1})


def test_conditions():
    assert parse_condition('grade == "A1"') == Condition("==", "grade", ("A1",))
    assert parse_condition("a > b != '3'") == Condition("!=", "a > b", ("3",))
    assert parse_condition('x %in% c("a", "b")') == Condition("%in%", "x", ("a", "b"))
    assert parse_condition("is_present(flag.kind)") == Condition("is_present", "flag.kind")
    assert parse_condition("a == b and c") is None and parse_condition("nonsense") is None


def test_matching():
    assert match_columns(["A", "b ", "c", "C"], ["a", "b", "c"]) == {"c": ("c", False), "a": ("A", True), "b": ("b ", True)}


def test_types_and_codes():
    with pytest.raises(ValueError):
        type_map([("x", "logical", None)])
    with pytest.raises(ValueError):
        type_map([("x", "double", "%Y")])
    with pytest.raises(ValueError):
        sentinels([("numeric", "missing", "-1"), ("numeric", "missing", "-2")])


def test_clashes():
    found, out = resolve_clashes({"k": {"a": "1", "b": None}}, {"s": {"k": {"a": "2", "b": "3"}, "z": {"a": "1"}}}, [{"sheet": "s", "attribute_name": "b", "winner": "dictionary", "blank_rule": "blank_loses"}])
    assert [(c["attribute_name"], c["winner"]) for c in found] == [("a", None), ("b", "sheet")] and out["k"]["b"] == "3"


def test_compiled_round_trip(tmp_path):
    s = mill_spec(lineage=LINEAGE, lineage_separators={"EAST": "_"})
    spec_files.write_compiled(s, str(tmp_path))
    assert spec_files.read_compiled(str(tmp_path)) == s


def test_dictionary_file(tmp_path):
    p = tmp_path / "20240131_dd.csv"
    names = list(DICTIONARY[0])
    p.write_bytes((",".join(names) + "\n" + "\n".join(",".join(r[n] or "" for n in names) for r in DICTIONARY[:2]) + "\n\xff,short\n").encode("latin-1"))
    attributes, found, manifest = spec_files.read_dictionary(str(p), COLUMNS)
    assert len(attributes) == 2 and attributes[0].where == "20240131_dd.csv:2" and manifest["date"] == "20240131"
    assert {f.check for f in found} == {"spec_encoding_invalid", "spec_csv_malformed"}


def test_rule_set_folder(tmp_path):
    (tmp_path / "rules_rules.csv").write_text("rule_id,table_name,attribute_name,severity,class,enabled\nraw_na,*,grain,warning,,\n")
    (tmp_path / "rules_settings.csv").write_text("setting,value,type\nexample_cap,3,integer\n")
    r = spec_files.read_rule_set(str(tmp_path))
    assert r.rules[0]["severity"] == "warning" and r.settings == {"example_cap": 3}


def test_routes():
    s = mill_spec()
    assert [[e.attribute for e in r] for r in s.routes("sacks", "valley")] == [["grind_no", "mill_no"]]
    assert s.chain("sacks", "grind_no > mill_no > wheel")[1:] == ("mills", "wheel") and s.chain("sacks", "nope > wheel") is None
    assert isinstance(s, Spec)


def test_lineage_conditions():
    entries = [*parse_lineage("A", "trees", "src_tree_id", "src_site_id + n.tree", "_"), *parse_lineage("A", "sites", "src_site_id", "n.site", "_"), *parse_lineage("B", "trees", "src_tree_id", "x: n.a | y: n.b", "_"), *parse_lineage("C", "trees", "src_tree_id", "X", "_")]

    def row(*cells):
        return dict(zip(("contributor_label", "table_name", "attribute_name", "part_order", "part_source", "when"), cells, strict=True))

    tree = ("trees", "src_tree_id")
    wrong = [("D", *tree, "1", "n.z", "a == 1"), ("C", *tree, "1", "n.z", "a == 1"), ("B", *tree, "1", "n.z", "a == 1"), ("A", *tree, "3", "n.z", "a == 1"), ("A", *tree, "x", "n.z", "a == 1"), ("A", *tree, "1", "n.z", "a == 1"), ("A", *tree, "2", "n z+", "a == 1"), ("A", *tree, "2", "n.z", "a > 1"), (None, None, None, None, None, None)]
    good = [("A", *tree, "2", "n.first", "a == 1"), ("A", *tree, 2, "n_second", "is_present(a)")]
    found, told = add_conditions(entries, [row(*r) for r in [*wrong, *good]])
    assert [w for w, _ in told] == [f"lineage_when:{k + 2}" for k in range(len(wrong))]
    assert [(e.part_source, e.part_kind, e.when) for e in found if e.contributor == "A" and e.part_order == 2] == [("n.first", "source", "a == 1"), ("n_second", "derived", "is_present(a)"), ("n.tree", "source", None)]
    assert len(found) == len(entries) + len(good)
    spec = Spec(attributes=(), lineage=tuple(found))
    slots = entry_slots(spec, "A", [e for e in found if (e.contributor, e.table) == ("A", "trees")])
    assert [(s.table, s.name, len(s.conditioned)) for s in slots] == [("sites", "n.site", 0), ("trees", "n.tree", 2)]


def test_nested_ids_that_do_not_expand():
    trees = parse_lineage("A", "trees", "src_tree_id", "src_site_id + n.tree", "_")
    for inner in (
        parse_lineage("A", "sites", "src_site_id", "src_site_id + n.b"),  # nested in itself
        parse_lineage("A", "sites", "src_site_id", "X"),  # no parts
        parse_lineage("A", "sites", "src_site_id", "x: n.a | y: n.b"),  # alternatives
        parse_lineage("A", "sites", "src_site_id", "n.a") + parse_lineage("A", "plots", "src_site_id", "n.a"),  # in two tables
    ):
        assert entry_slots(Spec(attributes=(), lineage=(*trees, *inner)), "A", trees) is None


def test_lineage_tokens_are_the_missing_value_codes():
    codes = sentinels([("character", "missing", "?", False, False), ("character", "not_applicable", "~", False, True), ("numeric", "missing", "-77", False, False)])
    assert lineage_tokens(codes) == {"?": "no_id", "~": "not_applicable"}
