"""The rules: identifier, layer, severity, class, version and inputs of each."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    rule_id: str
    stage: str
    layer: int | None
    severity: str
    issue_class: str
    strategy: str = "none"
    version: int = 1
    unit: bool = False
    settings: tuple[str, ...] = ()

    @property
    def message_id(self) -> str:
        return self.rule_id


def _r(rule_id, layer, severity, issue_class, strategy="none", version=1, unit=False, settings=()):
    return Rule(rule_id, "conformance", layer, severity, issue_class, strategy, version, unit, tuple(settings))


_N = "column_level_min_n"
_GEOMETRY = (_N, "design_geometry_table", "design_geometry_by", "design_geometry_columns", "example_cap")
_SIGNATURE = (_N, "design_signature_table", "design_signature_by", "design_signature_columns", "example_cap")

#: The conformance rules, in the order in which they run (fixed values: identifiers, layers, severities, classes, versions).
RULES = (
    _r("table_missing", 0, "error", "harmonization", unit=True),
    _r("table_unexpected", 0, "warning", "harmonization", unit=True),
    _r("column_missing", 0, "error", "harmonization", unit=True),
    _r("column_unexpected", 0, "warning", "harmonization", unit=True),
    _r("column_name_mismatch", 0, "error", "harmonization", unit=True),
    _r("class_mismatch", 1, "error", "harmonization", unit=True),
    _r("coercion_loss", 1, "error", "harmonization", version=2, settings=(_N, "rogue_codes", "unknown_codes")),
    _r("date_unparseable", 1, "error", "depends", version=2, settings=(_N, "rogue_codes", "unknown_codes")),
    _r("integer_stored_as_double", 1, "warning", "harmonization", unit=True),
    _r("value_not_finite", 1, "error", "harmonization", settings=(_N,)),
    _r("raw_na", 2, "error", "harmonization", "sentinel_fix", settings=(_N, "raw_na_policy")),
    _r("blank_string", 2, "error", "harmonization", "sentinel_fix", settings=(_N,)),
    _r("sentinel_wrong_type", 2, "error", "harmonization", "sentinel_fix", 2, settings=(_N, "unknown_codes")),
    _r("sentinel_rogue_code", 2, "error", "depends", version=2, settings=(_N, "rogue_codes", "unknown_codes")),
    _r("species_unknown_code", 2, "error", "harmonization", version=2, settings=(_N, "unknown_codes")),
    _r("whitespace_padding", 2, "warning", "harmonization", "trim_whitespace", settings=(_N,)),
    _r("na_text_in_id", 2, "error", "harmonization", settings=(_N,)),
    _r("code_not_in_list", 3, "error", "depends", settings=(_N, "unknown_codes")),
    _r("value_below_min", 3, "error", "depends", settings=(_N, "coordinate_attributes", "unknown_codes")),
    _r("value_above_max", 3, "error", "depends", settings=(_N, "coordinate_attributes", "unknown_codes")),
    _r("string_too_long", 3, "error", "depends", settings=(_N, "unknown_codes")),
    _r("pattern_mismatch", 3, "error", "depends", settings=(_N, "unknown_codes")),
    _r("decimals_exceeded", 3, "warning", "depends", settings=(_N, "unknown_codes")),
    _r("site_id_out_of_range", 3, "error", "harmonization", settings=(_N, "unknown_codes")),
    _r("coordinate_out_of_bounds", 3, "error", "depends", settings=(_N, "coordinate_attributes", "unknown_codes")),
    _r("undeclared_code_set", 3, "warning", "harmonization", version=3, unit=True, settings=("code_set_max_values", "code_set_skip_attributes", "code_set_skip_pattern", "unknown_codes")),
    _r("pk_duplicate", 4, "error", "harmonization", settings=(_N,)),
    _r("pk_missing", 4, "error", "harmonization", settings=(_N,)),
    _r("fk_orphan", 4, "error", "harmonization", settings=(_N,)),
    _r("fk_unassigned", 4, "error", "harmonization", settings=(_N,)),
    _r("fk_sentinel_unverified", 4, "warning", "harmonization", settings=(_N,)),
    _r("fk_not_applicable_mismatch", 4, "error", "harmonization"),
    _r("src_id_duplicate", 4, "warning", "depends", settings=(_N,)),
    _r("key_incoherent", 4, "error", "harmonization", settings=(_N,)),
    _r("record_unreachable", 4, "error", "harmonization", settings=(_N,)),
    _r("parent_without_children", 4, "info", "none", version=2),
    _r("design_geometry_inconsistent", 4, "error", "harmonization", settings=_GEOMETRY),
    _r("subplot_label_ambiguous", 4, "error", "harmonization", settings=(_N, "subplot_label_table", "subplot_label_columns")),
    _r("design_duplicate_signature", 4, "warning", "harmonization", settings=_SIGNATURE),
)

_P_ERRORS = (
    "dd_duplicate_attribute", "dd_name_missing", "dd_type_unknown", "dd_type_column_ambiguous", "dd_pk_missing", "dd_fk_target_missing", "code_list_missing", "code_column_missing", "code_list_unreferenced", "spec_clash_unresolved",
    "spec_encoding_invalid", "spec_csv_malformed", "site_id_range_invalid", "lineage_spec_unparseable", "lineage_when_invalid", "crosswalk_unreadable", "dd_format_invalid", "key_pair_invalid", "reach_invalid", "rule_set_unknown_column",
    "rule_id_unknown", "rule_set_override_invalid", "rule_set_duplicate_row", "setting_unknown_name", "text_id_missing", "text_slot_unknown", "input_unparseable",
)
_P_WARNINGS = (
    "code_list_duplicate_code", "code_list_blank_row", "code_list_empty_column", "spec_clash_resolved", "datasets_row_missing", "lineage_name_unknown", "lineage_spec_row_unflagged", "lineage_id_unflagged", "one_to_many_invalid", "option_unknown_name",
    "text_id_fallback", "override_scope_conflict", "override_unknown_name",
)

#: The pre-flight checks: errors stop a run, warnings are told (fixed values: identifiers and severities).
PREFLIGHT = tuple(Rule(x, "preflight", None, "error", "none") for x in _P_ERRORS) + tuple(Rule(x, "preflight", None, "warning", "none") for x in _P_WARNINGS)

BY_ID = {r.rule_id: r for r in RULES + PREFLIGHT}
ORDER = {r.rule_id: k for k, r in enumerate(RULES)}

#: Coded values of the outputs (fixed values).
REASONS = ("no_matrix", "offline", "no_companion_data", "text_input", "no_sentinels", "no_dd_column", "no_thresholds", "no_table", "no_column", "no_input", "no_dd_values", "none_checked", "no_records")
CLASSES = ("source", "harmonization", "unclassified", "none")
KEY_STATUS = ("decoded", "partial", "raw", "fallback_pk", "no_lineage_spec")


def allowed_severities(rule: Rule) -> tuple[str, ...]:
    """What a rule's severity may be set to: a counted rule's is info, another's error or warning."""
    return ("info",) if rule.severity == "info" else ("error", "warning")
