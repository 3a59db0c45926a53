"""Checks of the specification and the settings, before any data is read."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from plumbline.functions.values import java_format, java_pattern
from plumbline.plans.model import Spec, parse_condition
from plumbline.plans.registry import BY_ID, CLASSES, PREFLIGHT, allowed_severities
from plumbline.plans.settings import NAMING, NAMING_TABLES, Resolved, RuleSet


class PreflightError(ValueError):
    """The specification or the settings stop the run. `table` has the rows."""

    def __init__(self, table: list[dict]):
        self.table = table
        super().__init__("; ".join(sorted({f"{r['check']} ({r['where']}): {r['detail']}" for r in table if r["outcome"] == "stop"})))


@dataclass
class Inputs:
    """What the checks read. texts: language -> identifier -> text; run_inputs: name -> rows."""

    spec: Spec
    settings: Resolved
    rule_set: RuleSet
    texts: dict[str, dict[str, str]] = field(default_factory=dict)
    needed_texts: dict[str, set[str]] = field(default_factory=dict)
    run_inputs: dict[str, list[dict]] = field(default_factory=dict)
    options: dict[str, str] = field(default_factory=dict)


CHECKS: dict[str, Callable[[Inputs], list[tuple[str, str]] | str]] = {}

RULE_COLUMNS = {"rule_id", "table_name", "attribute_name", "severity", "class", "enabled"}
#: Columns of the inputs of a run (fixed values).
RUN_INPUTS = {
    "overrides": ("fingerprint", "rule_id", "table_name", "column_name", "issue_class", "who", "when", "why"),
    "lineage": ("table_name", "record_pk", "column_name", "raw_value", "raw_source"),
    "filled": ("table_name", "record_pk", "column_name", "written_value"),
    "computed": ("table_name", "column_name", "derivation"),
    "crosswalk": ("provider_code", "code", "column_name"),
}


def check(f):
    CHECKS[f.__name__] = f
    return f


def told(name: str):
    """A check that passes on what a reader found."""

    def f(x: Inputs):
        return [(y.where, y.detail) for y in x.spec.findings if y.check == name]

    CHECKS[name] = f


@check
def dd_duplicate_attribute(x):
    n = Counter((a.table, a.name) for a in x.spec.attributes)
    return [(f"{t}.{c}", f"listed {k} times") for (t, c), k in n.items() if k > 1]


@check
def dd_name_missing(x):
    return [(a.where, "no table or attribute name") for a in x.spec.attributes if not (a.table or "").strip() or not (a.name or "").strip()]


@check
def dd_type_unknown(x):
    return [(f"{a.table}.{a.name}", f"type {a.data_type!r} is not in the type map") for a in x.spec.attributes if a.data_type not in x.spec.types] + [(y.where, y.detail) for y in x.spec.findings if y.check == "dd_type_unknown"]


told("dd_type_column_ambiguous")


@check
def dd_pk_missing(x):
    return [(t, "no primary key") for t in x.spec.tables() if t and not x.spec.primary_key(t)]


@check
def dd_fk_target_missing(x):
    out = []
    for a in x.spec.attributes:
        if a.is_fk and (not a.reference or a.reference not in x.spec.tables()):
            out.append((f"{a.table}.{a.name}", f"names no table: {a.reference}"))
        elif a.is_fk and not x.spec.primary_key(a.reference):
            out.append((f"{a.table}.{a.name}", f"table {a.reference} has no primary key"))
    return out


@check
def code_list_missing(x):
    found = [(a, x.spec.code_source(a)) for a in x.spec.attributes if a.lookup]
    return [(f"{a.table}.{a.name}", f"no list named {s[0]}") for a, s in found if s and s[0] not in x.spec.code_lists and s[0] not in x.spec.crosswalks]


@check
def code_column_missing(x):
    found = [(a, x.spec.code_source(a)) for a in x.spec.attributes if a.lookup]
    return [(f"{a.table}.{a.name}", f"list {s[0]} has no column for its codes") for a, s in found if s and s[1] is None and (s[0] in x.spec.code_lists or s[0] in x.spec.crosswalks)]


def used_columns(spec: Spec) -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for a in spec.attributes:
        s = spec.code_source(a)
        if s and s[1]:
            out.setdefault(s[0], set()).add(s[1])
    return out


@check
def code_list_duplicate_code(x):
    out = []
    for name, columns in used_columns(x.spec).items():
        for c in sorted(columns):
            n = Counter(r.get(c) for r in x.spec.code_lists.get(name, []) if r.get(c))
            out += [(f"{name}.{c}", f"code {v!r} is listed {k} times") for v, k in n.items() if k > 1]
    return out


@check
def code_list_blank_row(x):
    return [(f"{n}:{k + 2}", "a row without a value") for n, rows in x.spec.code_lists.items() if n not in x.spec.non_code_sheets for k, r in enumerate(rows) if not any((v or "").strip() for v in r.values())]


@check
def code_list_unreferenced(x):
    used = {s[0] for a in x.spec.attributes if (s := x.spec.code_source(a))}
    return [(n, "no attribute uses the list") for n in x.spec.code_lists if n not in used and n not in x.spec.non_code_sheets]


@check
def code_list_empty_column(x):
    return [(f"{n}.{c}", "a column without a value") for n, rows in x.spec.code_lists.items() if n not in x.spec.non_code_sheets and rows for c in rows[0] if not any((r.get(c) or "").strip() for r in rows)]


@check
def spec_clash_resolved(x):
    return [(f"{c['sheet']}.{c['attribute_name']}", f"{c['key']}: {c['dictionary']!r} and {c['other']!r}, settled for the {c['winner']}") for c in x.spec.clashes if c["winner"]]


@check
def spec_clash_unresolved(x):
    return [(f"{c['sheet']}.{c['attribute_name']}", f"{c['key']}: {c['dictionary']!r} and {c['other']!r}") for c in x.spec.clashes if not c["winner"]] + [(y.where, y.detail) for y in x.spec.findings if y.check == "spec_clash_unresolved"]


for _name in ("datasets_row_missing", "spec_encoding_invalid", "spec_csv_malformed", "crosswalk_unreadable"):
    told(_name)


@check
def site_id_range_invalid(x):
    """A band that ends before it starts, or that overlaps the one before it (by start, end)."""
    out = [(y.where, y.detail) for y in x.spec.findings if y.check == "site_id_range_invalid"]
    furthest = None
    for b in sorted(x.spec.id_bands, key=lambda b: (b["band_start"], b["band_end"])):
        if b["band_end"] < b["band_start"]:
            out.append((str(b["key_value"]), "the band ends before it starts"))
            continue
        if furthest and b["band_start"] <= furthest["band_end"]:
            out.append((str(b["key_value"]), f"the band overlaps that of {furthest['key_value']}"))
        if not furthest or b["band_end"] > furthest["band_end"]:
            furthest = b
    return out


@check
def lineage_spec_unparseable(x):
    out = [(f"{e.contributor}: {e.table}.{e.attribute}", f"{e.part_source!r} is no lineage notation") for e in x.spec.lineage if e.id_status == "unparseable"]
    flagged = [(a.table, a.name) for a in x.spec.attributes if a.lineage]
    given = {(e.contributor, e.table, e.attribute) for e in x.spec.lineage}
    for who in sorted({e.contributor for e in x.spec.lineage}):
        out += [(f"{who}: {t}.{n}", "no entry") for t, n in flagged if (who, t, n) not in given]
    return out + [(y.where, y.detail) for y in x.spec.findings if y.check == "lineage_spec_unparseable"]


@check
def lineage_when_invalid(x):
    out = []
    for e in x.spec.lineage:
        condition = parse_condition(e.when) if e.when else None
        if e.when and (condition is None or not (condition.operand.startswith("flag.") or x.spec.chain(e.table, condition.operand))):
            out.append((f"{e.contributor}: {e.table}.{e.attribute}", f"{e.when!r} is no condition"))
    return out + [(y.where, y.detail) for y in x.spec.findings if y.check == "lineage_when_invalid"]


@check
def lineage_name_unknown(x):
    names = {a.name for a in x.spec.attributes}
    return [(f"{e.contributor}: {e.table}.{e.attribute}", f"{e.part_source} is no attribute") for e in x.spec.lineage if e.part_kind == "derived" and e.part_source not in names]


@check
def lineage_spec_row_unflagged(x):
    flagged = {(a.table, a.name) for a in x.spec.attributes if a.lineage}
    return sorted({(f"{e.contributor}: {e.table}.{e.attribute}", "the attribute is not flagged for lineage") for e in x.spec.lineage if (e.table, e.attribute) not in flagged})


@check
def lineage_id_unflagged(x):
    if not any(a.lineage for a in x.spec.attributes):
        return "no_dd_column"
    return [(f"{a.table}.{a.name}", "an ID that is not flagged for lineage") for a in x.spec.attributes if a.id_marked and not a.lineage]


@check
def dd_format_invalid(x):
    out = [(y.where, y.detail) for y in x.spec.findings if y.check == "dd_format_invalid"]
    for a in x.spec.attributes:
        where = f"{a.table}.{a.name}"
        if a.min_value is not None and a.max_value is not None and a.min_value > a.max_value:
            out.append((where, "the minimum is above the maximum"))
        if a.pattern is not None:
            try:
                re.compile(java_pattern(a.pattern).replace(r"\p{Alpha}", "A-Za-z").replace(r"\p{", "{"))
            except (ValueError, re.error) as e:
                out.append((where, f"pattern: {e}"))
        t = x.spec.types.get(a.data_type or "")
        if t and t.date_format:
            try:
                java_format(t.date_format)
            except ValueError as e:
                out.append((where, str(e)))
    return out


@check
def key_pair_invalid(x):
    if x.spec.key_pairs is None:
        return "no_input"
    return [(p["table_name"], f"{p[s]!r} does not parse") for p in x.spec.key_pairs for s in ("left", "right") if x.spec.chain(p["table_name"], p[s]) is None]


@check
def reach_invalid(x):
    """Unknown tables, links or kinds, and tables that no root leads to."""
    if x.spec.reach is None:
        return "no_input"
    out, links = [], []
    for r in x.spec.reach:
        e = x.spec.edge(r["table_name"], r.get("attribute_name") or "")
        if r["how"] not in ("root", "exempt", "from_parent", "from_child"):
            out.append((r["table_name"], f"{r['how']!r} is no way to reach"))
        elif r["table_name"] not in x.spec.tables():
            out.append((r["table_name"], "no such table"))
        elif r["how"].startswith("from_") and e is None:
            out.append((r["table_name"], f"{r.get('attribute_name')} is no foreign key of one column"))
        elif e:
            links.append((e.parent, e.table) if r["how"] == "from_parent" else (e.table, e.parent))
    reached = {r["table_name"] for r in x.spec.reach if r["how"] == "root"}
    while more := {b for a, b in links if a in reached} - reached:
        reached |= more
    return out + [(t, "no root leads to the table") for t in sorted({b for _, b in links} - reached)]


@check
def one_to_many_invalid(x):
    labels = {e.contributor for e in x.spec.lineage} | set(x.spec.contributors.values())
    out = []
    for r in x.spec.one_to_many:
        a = x.spec.attribute(r["table_name"], r["attribute_name"])
        if a is None:
            out.append((f"{r['table_name']}.{r['attribute_name']}", "no such attribute"))
        elif not a.id_marked:
            out.append((f"{a.table}.{a.name}", "the attribute is no ID"))
        elif not x.spec.contributors:
            out.append((f"{a.table}.{a.name}", "records have no contributor label"))
        elif r["contributor_label"] not in labels:
            out.append((f"{a.table}.{a.name}", f"no contributor is labelled {r['contributor_label']!r}"))
    return out


@check
def rule_set_unknown_column(x):
    out = []
    for r in x.rule_set.rules:
        t, a = r.get("table_name", "*"), r.get("attribute_name", "*")
        if t != "*" and t not in x.spec.tables():
            out.append((r["rule_id"], f"no table {t}"))
        elif a != "*" and not any(y.name == a and t in ("*", y.table) for y in x.spec.attributes):
            out.append((r["rule_id"], f"no attribute {a}"))
        out += [(r["rule_id"], f"no column {c} in a rule set") for c in r if c not in RULE_COLUMNS]
    return out


@check
def rule_id_unknown(x):
    named = [("rule set", r["rule_id"]) for r in x.rule_set.rules] + [("severity", r) for r in x.settings["severity"]] + [("fallback_class", r) for r in x.settings["fallback_class"]]
    return [(w, f"no rule {r!r}") for w, r in named if r not in BY_ID]


@check
def rule_set_override_invalid(x):
    out = []
    given = [("rule set", r["rule_id"], r.get("severity"), r.get("class")) for r in x.rule_set.rules] + [("severity", k, v, None) for k, v in x.settings["severity"].items()]
    for where, rule_id, severity, issue_class in given:
        rule = BY_ID.get(rule_id)
        if rule and severity and severity not in allowed_severities(rule):
            out.append((where, f"{rule_id}: severity {severity!r} is not allowed"))
        if issue_class and issue_class not in CLASSES[:2] and issue_class != "depends":
            out.append((where, f"{rule_id}: class {issue_class!r} is not allowed"))
    return out


@check
def rule_set_duplicate_row(x):
    n = Counter((r["rule_id"], r.get("table_name", "*"), r.get("attribute_name", "*")) for r in x.rule_set.rules)
    return [(" ".join(k), f"listed {v} times") for k, v in n.items() if v > 1]


def unknown_names(x: Inputs, wanted: Callable[[str], bool]) -> list[tuple[str, str]]:
    names, out = {a.name for a in x.spec.attributes}, []
    for s in NAMING:
        value = x.settings[s]
        given = value if isinstance(value, (list, tuple, dict)) else [value] if value else []
        if wanted(x.settings.tiers[s]):
            out += [(s, f"no attribute {n}") for n in given if n not in names]
    for s in NAMING_TABLES:
        if wanted(x.settings.tiers[s]) and x.settings[s] and x.settings[s] not in x.spec.tables():
            out.append((s, f"no table {x.settings[s]}"))
    return out


@check
def setting_unknown_name(x):
    return unknown_names(x, lambda tier: tier in ("argument", "rule_set"))


@check
def option_unknown_name(x):
    return unknown_names(x, lambda tier: tier == "option")


def languages(lang: str) -> list[str]:
    """A language, its base, English: where a text is looked for, before any language."""
    return list(dict.fromkeys([lang, lang.split("-")[0], "en"]))


@check
def text_id_missing(x):
    if not x.texts:
        return "no_input"
    return [(i, "no text in any language") for i in sorted(x.needed_texts) if not any(i in t for t in x.texts.values())]


@check
def text_id_fallback(x):
    if not x.texts:
        return "no_input"
    lang = x.settings["lang"]
    return [(i, f"no text in {lang}") for i in sorted(x.needed_texts) if i not in x.texts.get(lang, {}) and any(i in t for t in x.texts.values())]


@check
def text_slot_unknown(x):
    if not x.texts:
        return "no_input"
    return [(f"{lang}: {i}", f"unknown slot {{{s}}}") for lang, texts in sorted(x.texts.items()) for i, text in texts.items() if i in x.needed_texts for s in re.findall(r"\{(\w+)\}", text) if s not in x.needed_texts[i]]


@check
def input_unparseable(x):
    if not x.run_inputs:
        return "no_input"
    out = []
    for name, rows in x.run_inputs.items():
        for k, r in enumerate(rows):
            missing = [c for c in RUN_INPUTS.get(name, ()) if c not in r]
            if missing:
                out.append((f"{name}:{k + 2}", f"no column {', '.join(missing)}"))
            elif name == "overrides" and r["issue_class"] not in ("source", "harmonization"):
                out.append((f"{name}:{k + 2}", f"class {r['issue_class']!r}"))
    return out


SCOPE = ("fingerprint", "rule_id", "table_name", "column_name")


@check
def override_scope_conflict(x):
    rows = x.run_inputs.get("overrides")
    if rows is None:
        return "no_input"
    by: dict[tuple, set] = {}
    for r in rows:
        by.setdefault(tuple((k, v) for k, v in sorted(r.items()) if k not in ("issue_class", "who", "when", "why") and v), set()).add(r.get("issue_class"))
    return [(repr(dict(k)), "both classes for one scope") for k, v in by.items() if len(v) > 1]


@check
def override_unknown_name(x):
    rows = x.run_inputs.get("overrides")
    if rows is None:
        return "no_input"
    names = {a.name for a in x.spec.attributes}
    out = []
    for k, r in enumerate(rows):
        if r.get("rule_id") and r["rule_id"] not in BY_ID:
            out.append((f"overrides:{k + 2}", f"no rule {r['rule_id']}"))
        if r.get("table_name") and r["table_name"] not in x.spec.tables():
            out.append((f"overrides:{k + 2}", f"no table {r['table_name']}"))
        if r.get("column_name") and r["column_name"] not in names:
            out.append((f"overrides:{k + 2}", f"no attribute {r['column_name']}"))
    return out


def preflight_rows(x: Inputs) -> list[dict]:
    """A row for each finding, or one that says passed or not run."""
    out = []
    for rule in PREFLIGHT:
        found = CHECKS[rule.rule_id](x)
        bad = "stop" if rule.severity == "error" else "warn"
        if isinstance(found, str):
            out.append({"check": rule.rule_id, "outcome": "not_run", "where": "", "detail": found})
        elif not found:
            out.append({"check": rule.rule_id, "outcome": "pass", "where": "", "detail": ""})
        out += [{"check": rule.rule_id, "outcome": bad, "where": w, "detail": d} for w, d in (found if not isinstance(found, str) else [])]
    return out


def run_preflight(spec: Spec, settings: Resolved, rule_set: RuleSet, **more) -> list[dict]:
    """All checks; PreflightError if one stops the run."""
    rows = preflight_rows(Inputs(spec, settings, rule_set, **more))
    if any(r["outcome"] == "stop" for r in rows):
        raise PreflightError(rows)
    return rows
