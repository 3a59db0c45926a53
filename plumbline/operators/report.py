"""Reports: what a unit may see, its tables, and its files."""

from __future__ import annotations

import html
import re
from collections import Counter
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import values as V
from plumbline.plans.registry import BY_ID

SEVERITIES = ("error", "warning", "info")
UNIT_RULES = [r for r, x in BY_ID.items() if x.unit]


def held_apart(results: DataFrame, issues: DataFrame, group_cols: list[str]) -> DataFrame:
    """results with n_not_evaluated_own: records not evaluated that no issue speaks for."""
    cells = ["rule_id", "table_name", "column_name", *group_cols]
    weight = F.when(F.col("level") == "column", F.col("n_records")).otherwise(F.lit(1))
    counted = issues.filter("status = 'not_evaluated'").groupBy(*cells).agg(F.sum(weight).alias("__told"))
    on = None
    renamed = counted.select(*[F.col(c).alias(f"__{c}") for c in cells], "__told")
    for c in cells:
        x = F.col(c).eqNullSafe(F.col(f"__{c}"))
        on = x if on is None else on & x
    return results.join(renamed, on, "left").withColumn("n_not_evaluated_own", F.col("n_not_evaluated") - F.coalesce("__told", F.lit(0))).select(*results.columns, "n_not_evaluated_own")


def route(results: DataFrame, issues: DataFrame, unit: str | None, units: list[str], group_cols: list[str], lineage: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """What a report unit sees.

    Its own rows. Of rows of all units (`*`): those of rules that judge whole
    columns, those that count nothing, and all of them if there is one unit
    only. Never an issue that reads another unit's record, unless there is one
    unit only. Examples and the other group columns are blanked. Raw values go
    with an issue on their own cell only, and only where a key names one record.
    """
    told = held_apart(results, issues, group_cols)
    if unit is not None and group_cols:
        first, one = F.col(group_cols[0]), len(units) <= 1
        nothing = (F.coalesce("n_checked", F.lit(0)) == 0) & (F.coalesce("n_not_evaluated", F.lit(0)) == 0) & (F.coalesce("n_unchecked", F.lit(0)) == 0)
        told = told.filter((first == unit) | ((first == "*") & (F.lit(one) | F.col("rule_id").isin(UNIT_RULES) | nothing)))
        if one:
            issues = issues.filter(first.isin(unit, "*"))
        else:
            issues = issues.filter(((first == unit) | ((first == "*") & F.col("rule_id").isin(UNIT_RULES))) & (F.col("reaches_other_unit") == F.lit(False)))
    for c in ["examples", *group_cols[1:]]:
        told = told.withColumn(c, F.lit(None).cast("string"))
    raw = None
    if lineage is not None:
        cells = ["table_name", "record_pk", "column_name"]
        raw = lineage.join(issues.filter("level = 'record' and not pk_positional").select(*cells).distinct(), cells, "left_semi")
    return told, issues, raw


def in_order(issues: DataFrame) -> DataFrame:
    """By severity, rule, table, column, provider key (nulls last), record, number."""
    severity = F.coalesce(*[F.when(F.col("severity") == s, F.lit(k)) for k, s in enumerate(SEVERITIES)], F.lit(9))
    return issues.orderBy(severity, "rule_id", "table_name", "column_name", F.col("provider_key").asc_nulls_last(), "record_pk", "issue_id")


def guarded(c: Column) -> Column:
    """Text that a spreadsheet would run as a formula gets an apostrophe; a negative number does not."""
    risky = c.rlike(r"^[=+@\t\r]") | (c.startswith("-") & ~c.rlike(V.NUMBER))
    return F.when(risky, F.concat(F.lit("'"), c)).otherwise(c)


def split_keys(issues: DataFrame) -> DataFrame:
    """Columns key_<label> from the decoded provider keys, by position of the label, then its name.

    A key with a part that has no label, two equals signs or a label twice stays in one piece.
    """
    parts = F.transform(F.split("provider_key", "; "), lambda p: F.struct(F.substring_index(p, "=", 1).alias("label"), F.expr("1").alias("one"), p.alias("text")))
    keyed = issues.filter(F.col("provider_key_status").isin("decoded", "partial") & F.col("provider_key").isNotNull()).select("provider_key").distinct()
    keyed = keyed.withColumn("parts", parts)
    good = ~F.exists("parts", lambda p: ~p["text"].contains("=") | p["text"].startswith("=") | (F.length(p["text"]) - F.length(F.replace(p["text"], F.lit("="), F.lit(""))) > 1)) & (F.size(F.array_distinct(F.col("parts.label"))) == F.size("parts"))
    pairs = keyed.filter(good).select("provider_key", F.posexplode("parts").alias("position", "p")).select("provider_key", "position", F.col("p.label").alias("label"), F.expr("substring(p.text, length(p.label) + 2)").alias("part"))
    labels = [r.label for r in pairs.groupBy("label").agg(F.min("position").alias("position")).orderBy("position", "label").collect()]
    if not labels:
        return issues
    wide = pairs.groupBy(F.col("provider_key").alias("__key")).pivot("label", labels).agg(F.first("part"))
    out = issues.join(wide.select("__key", *[F.col(f"`{x}`").alias(f"key_{x}") for x in labels]), F.col("provider_key") == F.col("__key"), "left")
    decoded = F.col("provider_key_status").isin("decoded", "partial")
    return out.drop("__key").withColumns({f"key_{x}": F.when(decoded, F.col(f"`key_{x}`")) for x in labels})


def provider_table(issues: DataFrame) -> DataFrame:
    """A row for each issue of a unit, in order, text guarded."""
    wide = in_order(split_keys(issues))
    return wide.select(*[guarded(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in wide.dtypes])


RESERVED = {"con", "prn", "aux", "nul", *(f"com{k}" for k in range(1, 10)), *(f"lpt{k}" for k in range(1, 10))}


def file_names(units: list[str]) -> dict[str, str]:
    """A file stem for each unit: percent-encoded, no reserved name, distinct without case, at most 200 bytes."""
    out = {}
    for u in units:
        stem = quote(u, safe=" ").replace("%20", " ")
        stem = re.sub(r"^[. ]|[. ]$", lambda m: f"%{ord(m[0]):02X}", stem)
        if stem.split(".")[0].lower() in RESERVED or not stem:
            stem = f"_{stem}"
        if len(stem.encode()) > 200:
            raise ValueError(f"unit {u!r} gives a file name of more than 200 bytes")
        out[u] = stem
    clash = [k for k, n in Counter(s.lower() for s in out.values()).items() if n > 1]
    if clash:
        raise ValueError(f"units share a file name: {', '.join(clash)}")
    return out


def cut(text: str | None, most: int) -> str:
    text = "" if text is None else text
    return text if len(text) <= most else text[: max(0, most - 1)] + "…"


def matrix(issues: DataFrame) -> list[dict]:
    """Issues by severity and layer, with totals, from one grouping-sets aggregation."""
    rows = issues.filter("status = 'open'").rollup("severity", "layer").agg(F.count(F.lit(1)).alias("n")).collect()
    layers = issues.filter("status = 'open'").groupBy("layer").agg(F.count(F.lit(1)).alias("n")).collect()
    out = [{"severity": s, **{f"layer_{r.layer}": r.n for r in rows if r.severity == s and r.layer is not None}, "total": next((r.n for r in rows if r.severity == s and r.layer is None), 0)} for s in SEVERITIES]
    return [*out, {"severity": "total", **{f"layer_{r.layer}": r.n for r in layers}, "total": sum(r.n for r in layers)}]


def summary(issues: DataFrame, cap: int) -> list[dict]:
    """The rules, tables and columns with most records, shown in their natural order."""
    by = issues.filter("status = 'open'").groupBy("layer", "rule_id", "severity", "table_name", "column_name").agg(F.count(F.lit(1)).alias("issues"), F.sum(F.when(F.col("level") == "column", F.col("n_records")).otherwise(1)).alias("records"))
    top = by.orderBy(F.desc("records"), "rule_id", "table_name", "column_name").limit(cap)
    return [r.asDict() for r in top.orderBy("layer", "rule_id", "table_name", "column_name").collect()]


def not_evaluated(results: DataFrame) -> list[dict]:
    rows = results.filter("n_not_evaluated > 0 or status = 'not_run'").groupBy("rule_id", "not_run_reason").agg(F.sum("n_not_evaluated").alias("n_not_evaluated"), F.sum("n_unchecked").alias("n_unchecked"), F.count(F.lit(1)).alias("cells"))
    return [r.asDict() for r in rows.orderBy("rule_id", F.col("not_run_reason").asc_nulls_first()).collect()]


def table_html(title: str, rows: list[dict], cell_cap: int = 100) -> str:
    if not rows:
        return f"<section><h2>{html.escape(title)}</h2><p>None.</p></section>"
    names = list(dict.fromkeys(k for r in rows for k in r))
    names = [n for n in names if any(r.get(n) is not None for r in rows)]
    head = "".join(f"<th>{html.escape(n)}</th>" for n in names)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(cut(None if r.get(n) is None else str(r[n]), cell_cap))}</td>" for n in names) + "</tr>" for r in rows)
    return f"<section><h2>{html.escape(title)}</h2><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table></section>"


SCRIPT = """
document.querySelectorAll('table').forEach(t => {
  const box = document.createElement('input'); box.placeholder = 'filter'; t.before(box);
  const rows = () => Array.from(t.tBodies[0].rows);
  box.oninput = () => rows().forEach(r => r.hidden = !r.textContent.toLowerCase().includes(box.value.toLowerCase()));
  Array.from(t.tHead.rows[0].cells).forEach((c, k) => c.onclick = () => {
    const up = c.dataset.up = c.dataset.up === '1' ? '' : '1';
    rows().sort((a, b) => (up ? 1 : -1) * a.cells[k].textContent.localeCompare(b.cells[k].textContent, undefined, {numeric: true})).forEach(r => t.tBodies[0].append(r));
  });
});
"""


def page(title: str, sections: list[str]) -> str:
    style = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}th,td{border:1px solid #bbb;padding:2px 6px;text-align:left}th{cursor:pointer;background:#eee}@media print{input{display:none}}"
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1>{"".join(sections)}<script>{SCRIPT}</script></body></html>'


def build_reports(run, folder: str, units: list[str] | None = None, lineage: DataFrame | None = None, row_cap: int | None = None) -> dict[str, dict[str, str]]:
    """An HTML page and a CSV for each unit, in a folder of the driver. Classified issues only.

    A page holds capped tables; the CSV, all of the unit's issues, is streamed
    to the driver partition by partition. Files are written under another name
    and then renamed; those of an earlier build go first.
    """
    import csv
    import os

    group_cols = run.bound.group_cols
    row_cap = run.settings["row_cap"] if row_cap is None else row_cap
    if not run.issues.filter("issue_class is null").isEmpty():
        raise ValueError("issues are not classified")
    if units is None:
        units = [r[0] for r in run.results.select(group_cols[0]).distinct().collect() if r[0] != "*"] if group_cols else []
    names = file_names(units) if group_cols else {"all": "all"}
    os.makedirs(folder, exist_ok=True)
    for f in os.listdir(folder):
        if f.endswith((".html", ".csv", ".part")):
            os.remove(os.path.join(folder, f))
    out = {}
    for unit, stem in names.items():
        results, issues, raw = route(run.results, run.issues, unit if group_cols else None, units, group_cols, lineage)
        issues = issues.persist()
        classes = [r.asDict() for r in issues.groupBy("issue_class", "class_basis").agg(F.count(F.lit(1)).alias("issues")).orderBy("issue_class", "class_basis").collect()]
        shown = [r.asDict() for r in in_order(issues).limit(row_cap).collect()]
        keep = ("issue_id", "severity", "rule_id", "table_name", "column_name", "record_pk", "provider_key", "value", "expected", "n_records", "status", "issue_class", "class_basis")
        sections = [table_html("Run", run.metadata["run"]), table_html("At a glance", matrix(issues)), table_html("Classes", classes), table_html("Most records", summary(issues, row_cap)), table_html("Each issue", [{k: r[k] for k in keep} for r in shown], run.settings["cell_cap"]), table_html("Not evaluated", not_evaluated(results))]
        if raw is not None:
            sections.append(table_html("Values as delivered", [r.asDict() for r in raw.limit(row_cap).collect()], run.settings["cell_cap"]))
        paths = {"html": os.path.join(folder, f"{stem}.html"), "csv": os.path.join(folder, f"{stem}.csv")}
        with open(paths["html"] + ".part", "w", encoding="utf-8") as f:
            f.write(page(f"Conformance: {unit}", sections))
        rows = provider_table(issues)
        with open(paths["csv"] + ".part", "w", encoding="utf-8-sig", newline="") as f:
            w = csv.writer(f, lineterminator="\n")
            w.writerow(rows.columns)
            for r in rows.toLocalIterator():
                w.writerow(["" if v is None else v for v in r])
        for p in paths.values():
            os.replace(p + ".part", p)
        issues.unpersist()
        out[unit] = paths
    return out
