"""Entry points: check tables against a specification, and the whole run from reading to reports."""

from __future__ import annotations

import datetime
import hashlib
import json
import secrets
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators.bind import Bound, bind
from plumbline.operators.record import Outcome, record_run
from plumbline.operators.rules import Context
from plumbline.plans.model import Spec
from plumbline.plans.registry import BY_ID, RULES
from plumbline.plans.settings import Resolved, RuleSet, resolve, session_options


@dataclass
class Run:
    run_id: str
    spec: Spec
    bound: Bound
    settings: Resolved
    rule_set: RuleSet
    outcome: Outcome
    preflight: list[dict] = field(default_factory=list)
    metadata: dict[str, list[dict]] = field(default_factory=dict)

    @property
    def results(self) -> DataFrame:
        return self.outcome.results

    @property
    def issues(self) -> DataFrame:
        return self.outcome.issues


def new_run_id(now: datetime.datetime | None = None) -> str:
    """YYYYMMDDTHHMMSSZ_xxxxxx, UTC."""
    now = now or datetime.datetime.now(datetime.timezone.utc)
    return f"{now:%Y%m%dT%H%M%SZ}_{secrets.token_hex(3)}"


def fingerprint(rule_id: str, spec: Spec, settings: Resolved, rule_set: RuleSet) -> str:
    """SHA-256 over what a rule reads: its registry row, its rule rows, the specification, its settings."""
    rule = BY_ID[rule_id]
    parts = [repr(rule), sorted(json.dumps(r, sort_keys=True, default=str) for r in rule_set.rules if r["rule_id"] == rule_id), repr(spec.attributes), repr(sorted(spec.types.items())), repr(spec.sentinels), repr(spec.key_pairs), repr(spec.reach), repr(spec.id_bands), [(s, repr(settings[s])) for s in (*rule.settings, "severity")]]
    return hashlib.sha256(json.dumps(parts, default=str).encode()).hexdigest()


def check_conformance(
    spark: SparkSession,
    spec: Spec,
    tables: dict[str, DataFrame],
    *,
    layers: tuple[int, ...] = (0, 1, 2, 3, 4),
    rules: list[str] | None = None,
    group_cols: list[str] | None = None,
    key_col: str | None = None,
    settings: dict[str, Any] | None = None,
    rule_set: RuleSet | None = None,
    text_tables: set[str] | None = None,
    run_scope: str = "full",
    preflight: bool = True,
) -> Run:
    """Check tables against the specification.

    The specification and settings are pre-flighted first, before any data is
    read. `rules` limits the run to some rules. Tables are read as given: pass
    stored tables (files, catalog tables), whose rows keep their order. Sessions
    started with spark.python.sql.dataFrameDebugging.enabled=false build the
    plans, thousands of expressions, several times faster.
    """
    from plumbline.plans.preflight import run_preflight

    rule_set = rule_set or RuleSet()
    resolved = resolve(settings, rule_set, session_options(spark))
    told = run_preflight(spec, resolved, rule_set) if preflight else []
    bound = bind(spark, spec, tables, text_tables, group_cols, key_col)
    ctx = Context(bound, resolved, tuple(layers), frozenset(rules) if rules else None)
    run_id = new_run_id()
    prints = {r.rule_id: fingerprint(r.rule_id, spec, resolved, rule_set) for r in RULES if ctx.wants(r.rule_id)}
    outcome = record_run(ctx, rule_set, run_id, run_scope, prints)
    metadata = {
        "run": [{"run_id": run_id, "run_scope": run_scope, "layers": "; ".join(map(str, layers)), "group_cols": "; ".join(group_cols or []), "key_col": key_col}],
        "spec_manifest": list(spec.manifest),
        "inputs": [{"table_name": n, "columns": "; ".join(t.columns), "extra": "; ".join(t.extra), "text_input": t.text_input} for n, t in bound.tables.items()],
        "rules": [{"rule_id": r.rule_id, "layer": r.layer, "severity": r.severity, "class": r.issue_class, "version": r.version, "fingerprint": prints[r.rule_id]} for r in RULES if r.rule_id in prints],
        "settings": [{"setting": n, "value": json.dumps(resolved[n]), "tier": resolved.tiers[n]} for n in resolved.values],
        "clashes": list(spec.clashes),
        "preflight": told,
        "self_test": [{"rule_id": r, "found": "no outcome"} for r in outcome.not_expected],
    }
    return Run(run_id, spec, bound, resolved, rule_set, outcome, told, metadata)


def run_qc(
    spark: SparkSession,
    spec: Spec,
    delivery: str | dict[str, DataFrame | str],
    output: str,
    *,
    group_cols: list[str] | None = None,
    key_col: str | None = None,
    settings: dict[str, Any] | None = None,
    rule_set: RuleSet | None = None,
    overrides: list[dict] | None = None,
    evidence: dict[str, DataFrame] | None = None,
    flags: dict[str, DataFrame] | None = None,
    reports: bool = True,
    layers: tuple[int, ...] = (0, 1, 2, 3, 4),
) -> tuple[Run, str, dict]:
    """The whole run: read, pre-flight, check, decode, classify, write, report.

    Stops before reading data if the specification does not pass pre-flight;
    what was found is then written to the run folder all the same.
    """
    from plumbline.operators.classify import classify
    from plumbline.operators.decode import decode
    from plumbline.operators.report import build_reports
    from plumbline.plans.preflight import Inputs, PreflightError, preflight_rows
    from plumbline.sources.runs import write_metadata, write_run
    from plumbline.sources.tables import read_delivery, read_tables

    rule_set = rule_set or RuleSet()
    resolved = resolve(settings, rule_set, session_options(spark))
    told = preflight_rows(Inputs(spec, resolved, rule_set, run_inputs={"overrides": overrides} if overrides else {}))
    if any(r["outcome"] == "stop" for r in told):
        write_metadata({"preflight": told, "spec_manifest": list(spec.manifest)}, f"{output}/{new_run_id()}")
        raise PreflightError(told)
    if isinstance(delivery, str):
        tables, text, stamps = read_delivery(spark, delivery, spec.tables())
    else:
        tables, text = read_tables(spark, delivery, spec.tables())
        stamps = []
    run = check_conformance(spark, spec, tables, layers=layers, group_cols=group_cols, key_col=key_col, settings=settings, rule_set=rule_set, text_tables=text, preflight=False)
    run.preflight = run.metadata["preflight"] = told
    run.metadata["inputs"] = [r | next((s for s in stamps if s["table_name"] == r["table_name"]), {}) for r in run.metadata["inputs"]]
    issues = decode(run.bound, run.issues, flags)
    columns = [(c.rule_id, c.table, c.column) for c in run.outcome.checks]
    issues = classify(spark, issues, rule_set, overrides, evidence, resolved["fallback_class"], group_cols, columns)
    run.outcome.issues = run.bound.work.keep(issues)
    run.outcome.results = run.bound.work.keep(run.outcome.results)
    root = write_run(run, output)
    pages = build_reports(run, f"{root}/reports", lineage=(evidence or {}).get("lineage")) if reports else {}
    return run, root, pages
