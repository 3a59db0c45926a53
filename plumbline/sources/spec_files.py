"""A specification from files: dictionary, code lists and the optional inputs, with where each cell stood."""

from __future__ import annotations

import csv
import datetime
import hashlib
import io
import json
import os
import re
from dataclasses import asdict
from typing import Any

from plumbline.plans.model import Attribute, Finding, LineageEntry, Sentinel, Spec, TypeRow, add_conditions, lineage_tokens, parse_lineage, resolve_clashes, sentinels, type_map

#: What a dictionary's columns are called here, by their meaning; a column map renames them.
COLUMNS = ("table", "attribute", "type", "key", "reference", "lookup", "lineage", "min", "max", "min_inclusive", "max_inclusive", "pattern", "max_length", "decimals", "units")
Rows = list[dict[str, str | None]]


def column_map(**names: str) -> dict[str, str]:
    """A dictionary's column names by meaning; unknown meanings are a ValueError."""
    unknown = set(names) - set(COLUMNS)
    if unknown:
        raise ValueError(f"a dictionary has no {', '.join(sorted(unknown))}")
    return {c: names.get(c, c) for c in COLUMNS}


def mark_bytes(data: bytes) -> tuple[str, bool]:
    """UTF-8 text, bytes that are none as <xx>; and whether there were any."""
    try:
        return data.decode("utf-8-sig"), False
    except UnicodeDecodeError:
        return re.sub(r"[\udc80-\udcff]", lambda m: f"<{ord(m[0]) - 0xDC00:02x}>", data.decode("utf-8", "surrogateescape")), True


def read_csv_text(path: str) -> tuple[Rows, list[Finding]]:
    """A comma-separated specification file: blank cells are null; what is malformed is a finding with its line."""
    with open(path, "rb") as f:
        text, marked = mark_bytes(f.read())
    name = os.path.basename(path)
    found = [Finding("spec_encoding_invalid", name, "bytes that are not UTF-8")] if marked else []
    reader = csv.reader(io.StringIO(text, newline=""), strict=True)
    rows: Rows = []
    header: list[str] = []
    try:
        for line in reader:
            if not header:
                header = [c if c.strip() else f"V{k + 1}" for k, c in enumerate(line)]
                repeated = {c for c in header if header.count(c) > 1}
                header = [f"{c}.{k}" if c in repeated and header.index(c) != k else c for k, c in enumerate(header)]
            elif len(line) != len(header):
                if line:
                    found.append(Finding("spec_csv_malformed", f"{name}:{reader.line_num}", f"{len(line)} cells, not {len(header)}"))
            else:
                rows.append({c: (v if v.strip() else None) for c, v in zip(header, line, strict=True)} | {"__line": str(reader.line_num)})
    except csv.Error as e:
        found.append(Finding("spec_csv_malformed", f"{name}:{reader.line_num}", str(e)))
    if text and not text.endswith("\n"):
        found.append(Finding("spec_csv_malformed", f"{name}:{reader.line_num}", "the last line does not end"))
    return rows, found


def read_xlsx(path: str) -> dict[str, Rows]:
    """Sheets of a workbook as text. Needs openpyxl."""
    try:
        import openpyxl
    except ImportError as e:
        raise ModuleNotFoundError(f"{path}: reading a workbook needs openpyxl") from e
    out = {}
    for sheet in openpyxl.load_workbook(path, read_only=True, data_only=True):
        header, *lines = [[None if c is None else str(c) for c in line] for line in sheet.iter_rows(values_only=True)] or [[]]
        out[sheet.title] = [dict(zip([h or f"V{k + 1}" for k, h in enumerate(header)], line, strict=False)) for line in lines]
    return out


def read_input(x: str | Rows) -> tuple[Rows, list[Finding], dict]:
    """Rows from a file or as given, with findings and a manifest row."""
    if isinstance(x, str):
        if x.endswith(".xlsx"):
            return next(iter(read_xlsx(x).values())), [], manifest_row(x)
        rows, found = read_csv_text(x)
        return rows, found, manifest_row(x)
    return [dict(r) for r in x], [], {"file": "in memory", "date": None, "sha256": None}


def manifest_row(path: str) -> dict:
    """File, date (from the name where it begins with one) and SHA-256."""
    with open(path, "rb") as f:
        digest = hashlib.sha256(f.read()).hexdigest()
    name = os.path.basename(path)
    m = re.match(r"(\d{8})", name)
    return {"file": name, "date": m[1] if m else datetime.date.fromtimestamp(os.path.getmtime(path)).strftime("%Y%m%d"), "sha256": digest}


def _number(text: str | None, where: str, name: str, found: list[Finding], whole: bool = False):
    if text is None:
        return None
    try:
        value = float(text)
        if value != value or (whole and (value != int(value) or value < 0)):
            raise ValueError
        return int(value) if whole else value
    except ValueError:
        found.append(Finding("dd_format_invalid", where, f"{name} {text!r} is no number"))
        return None


def _flag(text: str | None, where: str, name: str, found: list[Finding]) -> bool:
    if text is None or text.strip().lower() in ("true", "t", "yes", "y", "1"):
        return True
    if text.strip().lower() in ("false", "f", "no", "n", "0"):
        return False
    found.append(Finding("dd_format_invalid", where, f"{name} {text!r} is neither yes nor no"))
    return True


def read_dictionary(x: str | Rows, columns: dict[str, str] | None = None, id_pattern: str | None = None) -> tuple[list[Attribute], list[Finding], dict]:
    """A dictionary's attributes. Bad cells are findings; an inverted range gives neither bound."""
    rows, found, manifest = read_input(x)
    m = columns or column_map()
    if rows and m["type"] not in rows[0]:
        close = [c for c in rows[0] if "type" in c.lower()]
        if len(close) == 1:
            m = m | {"type": close[0]}
        else:
            found.append(Finding("dd_type_column_ambiguous", manifest["file"], f"{len(close)} columns may hold the type"))
    out = []
    for k, r in enumerate(rows):
        cell = lambda name: r.get(m[name])  # noqa: B023, E731
        where = f"{manifest['file']}:{r.get('__line') or k + 2}"
        low, high = _number(cell("min"), where, "minimum", found), _number(cell("max"), where, "maximum", found)
        if low is not None and high is not None and low > high:
            found.append(Finding("dd_format_invalid", where, "the minimum is above the maximum"))
            low = high = None
        name = cell("attribute") or ""
        out.append(
            Attribute(
                cell("table") or "", name, cell("type"), cell("key"), cell("reference"), cell("lookup"), _flag(cell("lineage") or "n", where, "lineage", found), bool(id_pattern and re.search(id_pattern, name)),
                low, high, _flag(cell("min_inclusive"), where, "min_inclusive", found), _flag(cell("max_inclusive"), where, "max_inclusive", found), cell("pattern"), _number(cell("max_length"), where, "max_length", found, True),
                _number(cell("decimals"), where, "decimals", found, True), cell("units"), where,
            )
        )
    return out, found, manifest


def read_spec(
    dictionary: str | Rows,
    *,
    columns: dict[str, str] | None = None,
    types: str | Rows | dict[str, TypeRow] | None = None,
    missing: list[tuple] | tuple[Sentinel, ...] = (),
    code_lists: dict[str, str | Rows] | str | None = None,
    crosswalks: dict[str, tuple[str | Rows, str | None, dict[str, str]]] | None = None,
    non_code_sheets: tuple[str, ...] = (),
    key_pairs: str | Rows | None = None,
    reach: str | Rows | None = None,
    id_bands: str | Rows | None = None,
    id_band_columns: dict | None = None,
    one_to_many: str | Rows | None = None,
    lineage: str | Rows | None = None,
    lineage_when: str | Rows | None = None,
    lineage_separators: dict[str, str] | None = None,
    contributors: dict[str, str] | None = None,
    precedence: str | Rows | None = None,
    datasets: dict[str, dict[str, dict]] | None = None,
    dataset_rows: dict[str, dict] | None = None,
    id_pattern: str | None = None,
) -> Spec:
    """A specification. Reading never stops on a defect of the specification: defects are findings, and pre-flight stops."""
    attributes, found, manifest = read_dictionary(dictionary, columns, id_pattern)
    files = [{"input": "dictionary", **manifest}]

    def optional(name: str, x):
        if x is None:
            return None
        rows, more, m = read_input(x)
        found.extend(more)
        files.append({"input": name, **m})
        return [{k: v for k, v in r.items() if k != "__line"} for r in rows]

    kinds = types if isinstance(types, dict) else type_map([(r["data_type"], r["r_class"], r.get("date_format")) for r in optional("types", types) or []])
    lists: dict[str, Rows] = {}
    if isinstance(code_lists, str):
        lists = read_xlsx(code_lists)
        files.append({"input": "code_lists", **manifest_row(code_lists)})
    else:
        for name, x in (code_lists or {}).items():
            lists[name] = optional(f"code list {name}", x)
    translations = {}
    for name, (x, column, keep) in (crosswalks or {}).items():
        try:
            translations[name] = (optional(f"crosswalk {name}", x), column, keep)
        except (OSError, ModuleNotFoundError) as e:
            found.append(Finding("crosswalk_unreadable", name, str(e)))
    bands = []
    for k, r in enumerate(optional("id_bands", id_bands) or []):
        low, high = _number(r.get("band_start"), f"id_bands:{k + 2}", "band_start", found), _number(r.get("band_end"), f"id_bands:{k + 2}", "band_end", found)
        if low is not None and high is not None:
            bands.append({"key_value": r["key_value"], "band_start": low, "band_end": high})
    codes = sentinels(missing) if missing and not isinstance(missing[0], Sentinel) else tuple(missing)
    entries: list[LineageEntry] = []
    for r in optional("lineage_spec", lineage) or []:
        entries += parse_lineage(r["contributor_label"], r["table_name"], r["attribute_name"], r.get("source_text"), (lineage_separators or {}).get(r["contributor_label"]), lineage_tokens(codes))
    entries, wrong = add_conditions(entries, optional("lineage_when", lineage_when) or [])
    found += [Finding("lineage_when_invalid", where, why) for where, why in wrong]
    clashes, settled = resolve_clashes(dataset_rows or {}, datasets or {}, optional("precedence", precedence) or [])
    for sheet, rows in (datasets or {}).items():
        found += [Finding("datasets_row_missing", sheet, f"{k} is not among the datasets") for k in rows if k not in (dataset_rows or {})]
    pairs, walk, many = optional("key_pairs", key_pairs), optional("reach", reach), optional("one_to_many", one_to_many)
    return Spec(
        tuple(attributes), kinds, codes, lists, translations, non_code_sheets, None if pairs is None else tuple(pairs), None if walk is None else tuple(walk),
        tuple(bands), id_band_columns, tuple(many or ()), tuple(entries), contributors or {}, tuple(clashes), tuple(found), tuple(files),
    )


def write_compiled(spec: Spec, folder: str) -> None:
    """A specification as one JSON file for each component."""
    os.makedirs(folder, exist_ok=True)
    for name, value in asdict(spec).items():
        with open(os.path.join(folder, f"{name}.json"), "w", encoding="utf-8") as f:
            json.dump(value, f, ensure_ascii=False, indent=1)


def read_compiled(folder: str) -> Spec:
    """The specification that write_compiled() wrote."""
    part: dict[str, Any] = {}
    for f in os.listdir(folder):
        if f.endswith(".json"):
            with open(os.path.join(folder, f), encoding="utf-8") as x:
                part[f[:-5]] = json.load(x)
    rows = lambda kind, name: tuple(kind(**r) for r in part[name])
    return Spec(
        rows(Attribute, "attributes"), {k: TypeRow(**v) for k, v in part["types"].items()}, rows(Sentinel, "sentinels"), part["code_lists"], {k: tuple(v) for k, v in part["crosswalks"].items()}, tuple(part["non_code_sheets"]),
        None if part["key_pairs"] is None else tuple(part["key_pairs"]), None if part["reach"] is None else tuple(part["reach"]), tuple(part["id_bands"]), part["id_band_columns"], tuple(part["one_to_many"]), rows(LineageEntry, "lineage"), part["contributors"],
        tuple(part["clashes"]), rows(Finding, "findings"), tuple(part["manifest"]),
    )


def read_rule_set(folder: str):
    """rules_rules.csv, rules_settings.csv and rules_meta.csv of a folder."""
    from plumbline.plans.settings import SETTINGS, RuleSet, read_option

    def rows(name: str) -> Rows:
        path = os.path.join(folder, f"rules_{name}.csv")
        return [{k: v for k, v in r.items() if k != "__line" and v is not None} for r in read_csv_text(path)[0]] if os.path.exists(path) else []

    settings: dict[str, Any] = {}
    for r in rows("settings"):
        s = SETTINGS.get(r["setting"])
        if s is None:
            raise ValueError(f"unknown setting {r['setting']!r}")
        value = read_option(s, r["value"])
        settings[s.name] = (*settings[s.name], *value) if s.kind == "texts" and s.name in settings else value
    return RuleSet(tuple(rows("rules")), settings, {r.get("name", ""): r.get("value", "") for r in rows("meta")})
