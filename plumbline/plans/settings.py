"""Settings and rule sets: four tiers of values, and rows of rules by specificity."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from plumbline.plans.registry import BY_ID, Rule, allowed_severities


@dataclass(frozen=True)
class Setting:
    name: str
    kind: str  # text, texts, mapping, count (0 or more), size (1 or more), choice
    default: Any
    choices: tuple[str, ...] = ()


#: The settings and their built-in values (fixed values).
SETTINGS = {
    s.name: s
    for s in (
        Setting("lang", "text", "en"), Setting("severity", "mapping", {}), Setting("example_cap", "count", 5), Setting("row_cap", "count", 500), Setting("cell_cap", "count", 100), Setting("column_level_min_n", "size", 10),
        Setting("raw_na_policy", "choice", "when_sentinels", ("never", "when_sentinels", "always")), Setting("rogue_codes", "texts", ("-999", "UNK", "NA", "N/A")), Setting("unknown_codes", "mapping", {}), Setting("coordinate_attributes", "texts", ()),
        Setting("code_set_max_values", "size", 25), Setting("code_set_skip_attributes", "texts", ()), Setting("code_set_skip_pattern", "text", None), Setting("design_geometry_table", "text", None), Setting("design_geometry_by", "texts", ()),
        Setting("design_geometry_columns", "texts", ()), Setting("subplot_label_table", "text", None), Setting("subplot_label_columns", "texts", ()), Setting("design_signature_table", "text", None), Setting("design_signature_by", "text", None),
        Setting("design_signature_columns", "texts", ()), Setting("fallback_class", "mapping", {}),
    )
}

#: Settings that name tables or attributes.
NAMING = ("coordinate_attributes", "unknown_codes", "code_set_skip_attributes", "design_geometry_by", "design_geometry_columns", "subplot_label_columns", "design_signature_by", "design_signature_columns")
NAMING_TABLES = ("design_geometry_table", "subplot_label_table", "design_signature_table")
OPTION_PREFIX = "plumbline."


def valid(s: Setting, value: Any) -> bool:
    if value is None:
        return s.default is None
    if s.kind == "text":
        return isinstance(value, str)
    if s.kind == "texts":
        return isinstance(value, (list, tuple)) and all(isinstance(x, str) for x in value)
    if s.kind == "mapping":
        return isinstance(value, dict) and all(isinstance(k, str) and isinstance(v, str) for k, v in value.items())
    if s.kind == "choice":
        return value in s.choices
    return isinstance(value, int) and not isinstance(value, bool) and value >= (1 if s.kind == "size" else 0)


def read_option(s: Setting, text: str) -> Any:
    """A setting's value from the text of a session option."""
    if s.kind in ("count", "size"):
        return int(text)
    if s.kind == "texts":
        return tuple(x.strip() for x in text.split(";") if x.strip())
    if s.kind == "mapping":
        return dict(tuple(p.strip() for p in x.split("=", 1)) for x in text.split(";") if "=" in x)
    return text


@dataclass(frozen=True)
class RuleSet:
    """rules: rows of rule_id, table_name, attribute_name, severity, class, enabled ("*" is any); settings: name -> value."""

    rules: tuple[dict, ...] = ()
    settings: dict[str, Any] = field(default_factory=dict)
    meta: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Resolved:
    """Each setting's value and the tier that gave it: argument, rule_set, option or built_in."""

    values: dict[str, Any]
    tiers: dict[str, str]
    severity_argument: dict[str, str] = field(default_factory=dict)
    severity_option: dict[str, str] = field(default_factory=dict)

    def __getitem__(self, name: str) -> Any:
        return self.values[name]


def resolve(arguments: dict[str, Any] | None = None, rule_set: RuleSet | None = None, options: dict[str, str] | None = None) -> Resolved:
    """An argument is stronger than the rule set, that than a session option, that than the built-in value."""
    arguments, rule_set, options = arguments or {}, rule_set or RuleSet(), options or {}
    for name in arguments:
        if name not in SETTINGS:
            raise ValueError(f"unknown setting {name!r}")
    values, tiers = {}, {}
    for name, s in SETTINGS.items():
        given = [("argument", arguments.get(name)), ("rule_set", rule_set.settings.get(name)), ("option", read_option(s, options[name]) if name in options else None)]
        tier, value = next(((t, v) for t, v in given if v is not None), ("built_in", s.default))
        if not valid(s, value):
            raise ValueError(f"setting {name!r}: {value!r} is no {s.kind}")
        values[name], tiers[name] = value, tier
    option = read_option(SETTINGS["severity"], options["severity"]) if "severity" in options else {}
    return Resolved(values, tiers, dict(arguments.get("severity") or {}), option)


def session_options(spark) -> dict[str, str]:
    """Settings given as session options, plumbline.<name>."""
    found = {n: spark.conf.get(OPTION_PREFIX + n, None) for n in SETTINGS}
    return {n: v for n, v in found.items() if v is not None}


def rule_row_value(rule_set: RuleSet, rule_id: str, table: str, attribute: str, name: str) -> Any:
    """The field of the most specific row that gives it: (table, attribute), (table, *), (*, attribute), (*, *)."""
    for t, a in ((table, attribute), (table, "*"), ("*", attribute), ("*", "*")):
        for row in rule_set.rules:
            if row["rule_id"] == rule_id and row.get("table_name", "*") == t and row.get("attribute_name", "*") == a and row.get(name) is not None:
                return row[name]
    return None


def severity_of(rule: Rule, table: str, attribute: str, resolved: Resolved, rule_set: RuleSet) -> str:
    return resolved.severity_argument.get(rule.rule_id) or rule_row_value(rule_set, rule.rule_id, table, attribute, "severity") or resolved.severity_option.get(rule.rule_id) or rule.severity


def enabled(rule: Rule, table: str, attribute: str, rule_set: RuleSet) -> bool:
    value = rule_row_value(rule_set, rule.rule_id, table, attribute, "enabled")
    return True if value is None else str(value).lower() not in ("false", "0", "no")


def class_of(rule_id: str, table: str, attribute: str, rule_set: RuleSet) -> str:
    return rule_row_value(rule_set, rule_id, table, attribute, "class") or BY_ID[rule_id].issue_class


__all__ = ["SETTINGS", "NAMING", "NAMING_TABLES", "RuleSet", "Resolved", "resolve", "session_options", "rule_row_value", "severity_of", "enabled", "class_of", "allowed_severities"]
