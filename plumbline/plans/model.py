"""The specification: attributes, keys, codes, missing-value codes, links and lineage."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

FAMILIES = ("numeric", "date", "character")


@dataclass(frozen=True)
class TypeRow:
    """A dictionary type: how it is stored, and for a date how it is written."""

    data_type: str
    r_class: str
    date_format: str | None = None

    @property
    def family(self) -> str:
        return "numeric" if self.r_class in ("integer", "double") else "date" if self.date_format else "character"


#: Types of a dictionary that names none of its own.
BUILT_IN_TYPES = (TypeRow("character", "character"), TypeRow("string", "character"), TypeRow("integer", "integer"), TypeRow("int", "integer"), TypeRow("double", "double"), TypeRow("date", "character", "%Y-%m-%d"))


def type_map(rows: Iterable[tuple] = ()) -> dict[str, TypeRow]:
    """Types by name, the given ones over the built-in ones. r_class is character, integer or double; only text has a date format."""
    out = {t.data_type: t for t in BUILT_IN_TYPES}
    for row in rows:
        t = TypeRow(*row)
        if t.r_class not in ("character", "integer", "double"):
            raise ValueError(f"type {t.data_type!r}: class {t.r_class!r} is not character, integer or double")
        if t.date_format and t.r_class != "character":
            raise ValueError(f"type {t.data_type!r}: only a character type may have a date format")
        out[t.data_type] = t
    return out


@dataclass(frozen=True)
class Sentinel:
    """A missing-value code of a family, and whether keys may hold it."""

    family: str
    role: str
    value: str
    allowed_in_pk: bool = False
    allowed_in_fk: bool = False


def sentinels(rows: Iterable[tuple]) -> tuple[Sentinel, ...]:
    """Missing-value codes, one for each family and role."""
    found = tuple(Sentinel(*r) for r in rows)
    for s in found:
        if s.family not in FAMILIES or s.role not in ("missing", "not_applicable"):
            raise ValueError(f"missing-value code {s.value!r}: unknown family or role")
    if len({(s.family, s.role) for s in found}) < len(found):
        raise ValueError("a family has two missing-value codes of one role")
    return found


@dataclass(frozen=True)
class Attribute:
    table: str
    name: str
    data_type: str | None = "character"
    key: str | None = None  # PK, FK or None; "PK, FK" is both
    reference: str | None = None
    lookup: str | None = None
    lineage: bool = False
    id_marked: bool = False
    min_value: float | None = None
    max_value: float | None = None
    min_inclusive: bool = True
    max_inclusive: bool = True
    pattern: str | None = None
    max_length: int | None = None
    decimals: int | None = None
    units: str | None = None
    where: str = "in memory"

    @property
    def is_pk(self) -> bool:
        return "PK" in (self.key or "")

    @property
    def is_fk(self) -> bool:
        return "FK" in (self.key or "")


@dataclass(frozen=True)
class Edge:
    """A foreign key that names one-column primary key."""

    table: str
    attribute: str
    parent: str
    parent_key: str


@dataclass(frozen=True)
class LineageEntry:
    contributor: str
    table: str
    attribute: str
    alternative: str | None
    part_order: int
    part_source: str | None
    part_kind: str | None
    when: str | None
    id_status: str
    separator: str | None


@dataclass(frozen=True)
class Finding:
    """What a reader found wrong; pre-flight reports it."""

    check: str
    where: str
    detail: str


@dataclass(frozen=True)
class Spec:
    attributes: tuple[Attribute, ...]
    types: dict[str, TypeRow] = field(default_factory=type_map)
    sentinels: tuple[Sentinel, ...] = ()
    code_lists: dict[str, list[dict[str, str | None]]] = field(default_factory=dict)
    crosswalks: dict[str, tuple[list[dict[str, str | None]], str | None, dict[str, str]]] = field(default_factory=dict)
    non_code_sheets: tuple[str, ...] = ()
    key_pairs: tuple[dict, ...] | None = None
    reach: tuple[dict, ...] | None = None
    id_bands: tuple[dict, ...] = ()
    id_band_columns: dict | None = None
    one_to_many: tuple[dict, ...] = ()
    lineage: tuple[LineageEntry, ...] = ()
    contributors: dict[str, str] = field(default_factory=dict)
    clashes: tuple[dict, ...] = ()
    findings: tuple[Finding, ...] = ()
    manifest: tuple[dict, ...] = ()

    # -- lookups ---------------------------------------------------------

    def tables(self) -> list[str]:
        return list(dict.fromkeys(a.table for a in self.attributes))

    def of(self, table: str) -> list[Attribute]:
        return [a for a in self.attributes if a.table == table]

    def attribute(self, table: str, name: str) -> Attribute | None:
        return next((a for a in self.attributes if a.table == table and a.name == name), None)

    def type_of(self, a: Attribute) -> TypeRow:
        return self.types.get(a.data_type or "", TypeRow(a.data_type or "", "character"))

    def family(self, a: Attribute) -> str:
        return self.type_of(a).family

    def own_codes(self, a: Attribute) -> list[Sentinel]:
        return [s for s in self.sentinels if s.family == self.family(a)]

    def primary_key(self, table: str) -> list[Attribute]:
        return [a for a in self.of(table) if a.is_pk]

    def edges(self) -> list[Edge]:
        """Foreign keys whose parent has a primary key of one column."""
        out = []
        for a in self.attributes:
            if a.is_fk and a.reference:
                pk = self.primary_key(a.reference)
                if len(pk) == 1:
                    out.append(Edge(a.table, a.name, a.reference, pk[0].name))
        return out

    def edge(self, table: str, attribute: str) -> Edge | None:
        return next((e for e in self.edges() if e.table == table and e.attribute == attribute), None)

    # -- code lists ------------------------------------------------------

    def code_source(self, a: Attribute) -> tuple[str, str | None] | None:
        """(source, code column) of an attribute's list; column None if the source has none that fits."""
        if not a.lookup:
            return None
        name = a.name if a.lookup == "Y" else a.lookup
        if name in self.code_lists:
            columns = list(self.code_lists[name][0]) if self.code_lists[name] else []
            return name, next((c for c in (a.name, name) if c in columns), None)
        if name in self.crosswalks:
            rows, declared, _ = self.crosswalks[name]
            columns = list(rows[0]) if rows else []
            return name, next((c for c in (a.name, name, declared) if c and c in columns), None)
        return name, None

    def codes(self, a: Attribute) -> list[str] | None:
        """The codes an attribute may hold, in order; None where it has no list that can be read."""
        source = self.code_source(a)
        if not source or source[1] is None:
            return None
        name, column = source
        if name in self.code_lists:
            rows = self.code_lists[name]
        else:
            rows, _, keep = self.crosswalks[name]
            rows = [r for r in rows if all(r.get(k) == v for k, v in keep.items())]
        return list(dict.fromkeys(r[column] for r in rows if r.get(column) not in (None, "")))

    # -- routes ----------------------------------------------------------

    def routes(self, table: str, target: str) -> list[list[Edge]]:
        """Simple paths of foreign keys from a table to those that hold the attribute, shortest first."""
        return self.routes_to(table, {a.table for a in self.attributes if a.name == target})

    def routes_to(self, table: str, homes: set[str]) -> list[list[Edge]]:
        """Simple paths of foreign keys from a table to others, shortest first."""
        edges = self.edges()
        found, queue = [], [[e] for e in edges if e.table == table]
        while queue:
            path = queue.pop(0)
            end = path[-1].parent
            if end in homes:
                found.append(path)
                continue
            seen = {table, *(e.parent for e in path)}
            queue += [[*path, e] for e in edges if e.table == end and e.parent not in seen]
        return found

    def chain(self, table: str, text: str) -> tuple[list[Edge], str, str] | None:
        """`fk > fk > attribute` as (edges, home table, attribute); None where it does not parse."""
        steps, home = [], table
        *links, last = [p.strip() for p in text.split(">")]
        for name in links:
            e = self.edge(home, name)
            if e is None:
                return None
            steps.append(e)
            home = e.parent
        return (steps, home, last) if self.attribute(home, last) else None

    def with_findings(self, *more: Finding) -> Spec:
        return replace(self, findings=self.findings + more)


@dataclass(frozen=True)
class Condition:
    """`x == "a"`, `x != "a"`, `x %in% c(...)`, `is_present(x)` or `is_sentinel(x)`; x is a chain or flag.<name>."""

    operator: str
    operand: str
    values: tuple[str, ...] = ()


def parse_condition(text: str) -> Condition | None:
    """The condition, or None where the text is none. There is no and, or, not."""
    text = text.strip()
    m = re.fullmatch(r"(is_present|is_sentinel)\(\s*([^()\"']+?)\s*\)", text)
    if m:
        return Condition(m[1], m[2])
    m = re.fullmatch(r"([^()\"'=!%]+?)\s*(==|!=)\s*(.+)", text)
    if m and (values := _literals(m[3])) is not None and len(values) == 1:
        return Condition(m[2], m[1], values)
    m = re.fullmatch(r"([^()\"'=!%]+?)\s*%in%\s*c\((.*)\)", text)
    if m and (values := _literals(m[2])):
        return Condition("%in%", m[1], values)
    return None


def _literals(text: str) -> tuple[str, ...] | None:
    """Comma-separated quoted texts or numbers."""
    out, rest = [], text.strip()
    while rest:
        m = re.match(r"""("([^"]*)"|'([^']*)'|([-+]?[0-9.]+))\s*(,\s*|$)""", rest)
        if not m:
            return None
        out.append(m[2] if m[2] is not None else m[3] if m[3] is not None else m[4])
        rest = rest[m.end() :]
    return tuple(out)


NO_ID = {"X": "no_id", "Z": "not_applicable"}
#: A part of a source ID: an attribute, or `table.column` of the provider.
PART = r"[\w]+(\.[\w ]+)?"


def lineage_tokens(codes: Iterable[Sentinel]) -> dict[str, str]:
    """What an entry says for no ID: the missing-value codes of text."""
    kinds = {"missing": "no_id", "not_applicable": "not_applicable"}
    return {s.value: kinds[s.role] for s in codes if s.family == "character" and s.role in kinds}


def parse_lineage(contributor: str, table: str, attribute: str, text: str | None, separator: str | None = None, tokens: dict[str, str] | None = None) -> list[LineageEntry]:
    """The notation of a source ID: parts joined by ` + `, labelled alternatives by ` | `, or a token for none.

    A part written `table.column` is the provider's, another is an attribute.
    """
    tokens = NO_ID if tokens is None else tokens

    def row(alternative, order, source, kind, status):
        return LineageEntry(contributor, table, attribute, alternative, order, source, kind, None, status, separator)

    if text is None or not text.strip():
        return [row(None, 1, None, None, "blank")]
    if text.strip() in tokens:
        return [row(None, 1, None, None, tokens[text.strip()])]
    alternatives, out = text.split(" | "), []
    for one in alternatives:
        label, parts = None, one
        if len(alternatives) > 1:
            m = re.fullmatch(r"\s*([^:]+):\s*(.+)", one)
            if not m:
                return [row(None, 1, text, None, "unparseable")]
            label, parts = m[1].strip(), m[2]
        names = [p.strip() for p in parts.split(" + ")]
        if any(not re.fullmatch(PART, p) for p in names):
            return [row(None, 1, text, None, "unparseable")]
        for k, p in enumerate(names):
            out.append(row(label, k + 1, p, part_kind(p), "single" if len(names) == 1 else "composite"))
    return out


def part_kind(name: str) -> str:
    return "source" if "." in name else "derived"


def add_conditions(entries: list[LineageEntry], rows: Iterable[dict]) -> tuple[list[LineageEntry], list[tuple[str, str]]]:
    """Entries with their condition rows, and (where, why) of the rows that condition nothing.

    A row names a part of an entry without alternatives and gives the name that
    the part has where a condition holds. Rows of a part stand before it, in
    their order, and the first that holds decides.
    """
    named: dict[tuple, list[LineageEntry]] = {}
    wrong = []
    for n, r in enumerate(rows):
        who = (r.get("contributor_label"), r.get("table_name"), r.get("attribute_name"))
        own = [e for e in entries if (e.contributor, e.table, e.attribute) == who and e.id_status in ("single", "composite")]
        order, name, when = str(r.get("part_order") or ""), r.get("part_source") or "", r.get("when") or ""
        parts = [e for e in own if order.isdecimal() and e.part_order == int(order)]
        why = None
        if not own:
            why = "names no entry that has parts"
        elif any(e.alternative for e in own):
            why = "names an entry with labelled alternatives"
        elif len(parts) != 1:
            why = f"names no part: {order!r}"
        elif parts[0].part_kind == "derived" and any((e.contributor, e.attribute) == (who[0], parts[0].part_source) for e in entries):
            why = f"names a part that is an ID with an entry of its own: {parts[0].part_source}"
        elif not re.fullmatch(PART, name):
            why = f"{name!r} is no part"
        elif parse_condition(when) is None:
            why = f"{when!r} is no condition"
        if why:
            wrong.append((f"lineage_when:{n + 2}", why))
        else:
            named.setdefault((*who, parts[0].part_order), []).append(replace(parts[0], part_source=name, part_kind=part_kind(name), when=when))
    out: list[LineageEntry] = []
    for e in entries:
        out += [*named.get((e.contributor, e.table, e.attribute, e.part_order), []), e]
    return out, wrong


def match_columns(given: list[str], wanted: list[str]) -> dict[str, tuple[str, bool]]:
    """attribute -> (column, near): by exact name, then by name without space and case, each column once."""
    out = {a: (a, False) for a in wanted if a in given}
    left = [c for c in given if c not in out]
    fold = lambda s: re.sub(r"\s+", "", s).casefold()
    for a in wanted:
        if a not in out:
            near = next((c for c in left if fold(c) == fold(a)), None)
            if near is not None:
                out[a] = (near, True)
                left.remove(near)
    return out


def resolve_clashes(dictionary: dict[str, dict], sheets: dict[str, dict[str, dict]], precedence: list[dict]) -> tuple[list[dict], dict[str, dict]]:
    """Settle a key's values that the sheets give differently.

    precedence has sheet, attribute_name, winner (`dictionary` or `sheet`) and
    blank_rule (`blank_loses` or `blank_wins`). Returns the clashes (settled or
    not) and the dictionary with the winners.
    """
    rules = {(p["sheet"], p["attribute_name"]): p for p in precedence}
    clashes, out = [], {k: dict(v) for k, v in dictionary.items()}
    for sheet, rows in sheets.items():
        for key, cells in rows.items():
            for name, value in cells.items():
                own = dictionary.get(key, {}).get(name)
                if key not in dictionary or own == value:
                    continue
                p = rules.get((sheet, name))
                if p and p.get("blank_rule") == "blank_loses" and (own in (None, "")) != (value in (None, "")):
                    winner = "sheet" if own in (None, "") else "dictionary"
                else:
                    winner = p["winner"] if p else None
                clashes.append({"sheet": sheet, "key": key, "attribute_name": name, "dictionary": own, "other": value, "winner": winner})
                if winner == "sheet":
                    out[key][name] = value
    return clashes, out
