"""Providers' own keys for issues: source IDs split and labelled as their lineage says."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import values as V
from plumbline.operators import bind as B
from plumbline.operators.bind import ROW, Bound, Table
from plumbline.operators.record import key_text
from plumbline.plans.model import Attribute, Condition, LineageEntry, Spec, parse_condition

NO_KEY = ("blank", "no_id", "not_applicable")


def add_label(b: Bound, t: Table) -> DataFrame:
    """t.df with __label: the contributor label of the row's contributor group."""
    if "__label" in t.df.columns:
        return t.df
    group = F.col(b.groups[0]) if b.groups else F.lit(None).cast("string")
    pairs = b.spec.contributors
    label = F.coalesce(*[F.when(group == k, F.lit(v)) for k, v in pairs.items()], F.lit(None).cast("string")) if pairs else group
    return t.df.withColumn("__label", label)


def source_id(spec: Spec, table: str) -> Attribute | None:
    """The table's first ID that has a lineage entry."""
    entries = {(e.table, e.attribute) for e in spec.lineage}
    return next((a for a in spec.of(table) if a.id_marked and (table, a.name) in entries), None)


@dataclass(frozen=True)
class Slot:
    """A part of an ID: the table whose rows its conditions read, its own name, and the names it has where a condition holds."""

    table: str
    name: str
    conditioned: tuple[tuple[str, str], ...]


def entry_slots(spec: Spec, label: str, entry: list[LineageEntry], seen: tuple[str, ...] = ()) -> list[Slot] | None:
    """The parts of an ID, nested IDs replaced by theirs; None where one does not expand.

    A nested ID expands if its entry is in one table, has parts, has no
    alternatives and is not nested in itself.
    """
    out: list[Slot] = []
    for own in sorted((e for e in entry if e.when is None), key=lambda e: e.part_order):
        inner = [e for e in spec.lineage if own.part_kind == "derived" and (e.contributor, e.attribute) == (label, own.part_source)]
        if not inner:
            out.append(Slot(own.table, own.part_source, tuple((e.when, e.part_source) for e in entry if e.when and e.part_order == own.part_order)))
            continue
        whole = len({e.table for e in inner}) == 1 and all(e.id_status in ("single", "composite") and not e.alternative for e in inner)
        more = entry_slots(spec, label, inner, (*seen, own.part_source)) if whole and own.part_source not in seen else None
        if more is None:
            return None
        out += more
    return out


def condition_column(b: Bound, t: Table, condition: Condition, flags: dict[str, Column]) -> Column:
    """The condition over a table's rows; null, or a chain that breaks, satisfies nothing."""
    spec = b.spec
    if condition.operand.startswith("flag."):
        text, a = flags.get(condition.operand[5:], F.lit(None).cast("string")), None
    else:
        parsed = spec.chain(t.name, condition.operand)
        name = f"__c_{abs(hash((t.name, condition.operand)))}"
        read = B.read_chain(b, t.df, t.name, condition.operand, name) if parsed and name not in t.df.columns else None
        if parsed is None:
            return F.lit(False)
        a = spec.attribute(parsed[1], parsed[2])
        if read:
            t.df = read[0]
        if name not in t.df.columns:
            return F.lit(False)
        text = V.value_text(F.col(name), b.tables[parsed[1]].types[parsed[2]])
    codes = [s.value for s in spec.own_codes(a)] if a else []
    held = V.no(text.isin(codes)) if codes else F.lit(False)
    if condition.operator == "==":
        found = text == condition.values[0]
    elif condition.operator == "!=":
        found = text != condition.values[0]
    elif condition.operator == "%in%":
        found = text.isin(list(condition.values))
    elif condition.operator == "is_present":
        found = text.isNotNull() & ~V.no(V.is_blank(text)) & ~held
    else:
        found = held
    return V.no(found)


def add_flags(b: Bound, given: dict[str, DataFrame]) -> dict[str, dict[str, Column]]:
    """The caller's flags, joined to their tables by primary key: columns by table and name, as text.

    A table of flags holds the primary key and one or more flags. A key that is
    given twice, or that no record holds, is refused. A record whose key is
    missing has no flag; all holders of a repeated key have that key's flags.
    """
    spec, out = b.spec, {}
    for name, df in given.items():
        t = b.tables.get(name)
        keys = [p.name for p in spec.primary_key(name)]
        flags = [c for c in df.columns if c not in keys]
        if t is None or not keys:
            raise ValueError(f"flags are given for {name}, which is no table with a primary key here")
        if not set(keys) <= set(df.columns) or not flags:
            raise ValueError(f"flags of {name} must hold its primary key ({', '.join(keys)}) and a flag")
        kinds = dict(df.dtypes)
        texts = {c: V.value_text(F.col(c), kinds[c]) for c in df.columns}
        whole = ~V.any_of(*[texts[k].isNull() | V.no(V.is_blank(texts[k])) for k in keys])
        named = [texts[c].alias(f"__flag{k}") for k, c in enumerate(flags)]
        rows = b.work.keep(df.select(F.when(whole, F.concat_ws("|", *[texts[k] for k in keys])).alias("__flag_key"), *named))
        twice = rows.groupBy("__flag_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").first()
        if twice:
            raise ValueError(f"flags of {name} give the key {twice[0]} more than once")
        own = t.base.select(key_text(spec, t).alias("__own_key"))
        unknown = rows.join(own, F.col("__flag_key") == F.col("__own_key"), "left_anti").first()
        if unknown:
            raise ValueError(f"flags of {name} give the key {unknown[0]}, which no record holds")
        earlier = [c for c in t.df.columns if c.startswith("__flag")]
        t.df = t.df.drop(*earlier).withColumn("__own_key", key_text(spec, t)).join(rows, F.col("__own_key") == F.col("__flag_key"), "left").drop("__own_key", "__flag_key")
        out[name] = {c: F.col(f"__flag{k}") for k, c in enumerate(flags)}
    return out


def decode_table(b: Bound, t: Table, flags: dict[str, dict[str, Column]] | None = None) -> DataFrame:
    """ROW, provider_key, provider_key_status of a table's rows.

    A label's entry is one expression: its ID is split at the separator, parts
    are labelled and joined. flags holds columns by table and name. decoded, partial (a part is blank or a missing-value
    code), raw (kept as delivered), no_lineage_spec, or fallback_pk.
    """
    spec = b.spec
    null = F.lit(None).cast("string")
    a = source_id(spec, t.name)
    if a is None or not t.has(a.name):
        return t.df.select(ROW, null.alias("provider_key"), F.lit("fallback_pk").alias("provider_key_status"))
    t.df = add_label(b, t)
    text = t.text(a, spec)
    own = [s.value for s in spec.own_codes(a)]
    every = list(dict.fromkeys(s.value for s in spec.sentinels))
    fits = text.isNotNull() & ~V.no(V.is_blank(text)) & ~(V.no(text.isin(own)) if own else F.lit(False))
    status: Column = F.lit("no_lineage_spec")
    key: Column = text
    for label in sorted({e.contributor for e in spec.lineage if (e.table, e.attribute) == (t.name, a.name)}):
        entry = [e for e in spec.lineage if (e.contributor, e.table, e.attribute) == (label, t.name, a.name)]
        here = F.col("__label") == label
        kind = entry[0].id_status
        if kind == "unparseable":
            continue
        if kind in NO_KEY:
            status, key = F.when(here, "fallback_pk").otherwise(status), F.when(here, null).otherwise(key)
            continue
        slots = None if any(e.alternative for e in entry) else entry_slots(spec, label, entry)
        separator = entry[0].separator
        if slots is None or (len(slots) > 1 and not separator):
            status, key = F.when(here, "raw").otherwise(status), F.when(here, text).otherwise(key)
            continue
        pieces = F.split(text, _literal(separator), -1) if len(slots) > 1 else F.array(text)
        parts = [F.get(pieces, k) for k in range(len(slots))]
        labels = [_label(b, t, slot, flags or {}) for slot in slots]
        joined = F.concat_ws("; ", *[F.concat(n, F.lit("="), p) for n, p in zip(labels, parts, strict=True)])
        odd = V.any_of(*[V.no(x.contains("; ") | x.contains("=")) for x in [*parts, *labels]])
        blank = V.any_of(*[V.no(V.is_blank(p)) | (V.no(p.isin(every)) if every else F.lit(False)) for p in parts])
        ok = F.size(pieces) == len(slots)
        told = F.when(~ok | odd, "raw").when(blank, "partial").otherwise("decoded")
        status, key = F.when(here, told).otherwise(status), F.when(here, F.when(~ok | odd, text).otherwise(joined)).otherwise(key)
    status = F.when(~fits, "fallback_pk").otherwise(status)
    key = F.when(status != "fallback_pk", key)
    return t.df.select(ROW, key.alias("provider_key"), status.alias("provider_key_status"))


def _literal(separator: str) -> str:
    return r"\Q" + separator + r"\E"


def _label(b: Bound, t: Table, slot: Slot, flags: dict[str, dict[str, Column]]) -> Column:
    """A part's name: that of the first condition that holds for the row, or for its parent in the part's table; else its own."""
    conditions = [(c, name) for when, name in slot.conditioned if (c := parse_condition(when))]
    if not conditions:
        return F.lit(slot.name)
    if slot.table == t.name:
        held = [condition_column(b, t, c, flags.get(t.name, {})) for c, _ in conditions]
    else:
        held = _held_by_parent(b, t, slot.table, [c for c, _ in conditions], flags.get(slot.table, {}))
    return F.coalesce(*[F.when(h, F.lit(name)) for h, (_, name) in zip(held, conditions, strict=True)], F.lit(slot.name))


def _held_by_parent(b: Bound, t: Table, home: str, conditions: list[Condition], flags: dict[str, Column]) -> list[Column]:
    """Whether each condition holds for the parent in `home` that the first unbroken route reaches; a row that reaches none holds none."""
    if home not in b.tables:
        return [F.lit(False)] * len(conditions)
    parent = b.tables[home]
    fields = {f"__h{k}": condition_column(b, parent, c, flags) for k, c in enumerate(conditions)}
    frames = {n: x.base for n, x in b.tables.items()} | {home: parent.df}
    chosen: list[Column] = [F.lit(None).cast("boolean")] * len(conditions)
    closed, df, drop = F.lit(False), t.df, []
    for k, path in enumerate(r for r in b.spec.routes_to(t.name, {home}) if B.followed(b, r)):
        df = B.follow(b, frames, df, path, lambda end: {f"{n}_{k}": c for n, c in fields.items()})  # noqa: B023
        df = df.withColumnRenamed("__state", f"__s{k}")
        chosen = [F.coalesce(c, F.when(~closed & (F.col(f"__s{k}") == "reached"), F.col(f"{n}_{k}"))) for c, n in zip(chosen, fields, strict=True)]
        closed = closed | (F.col(f"__s{k}") == "orphan")
        drop += [f"__s{k}", *[f"{n}_{k}" for n in fields]]
    start = len(t.df.columns)
    names = [f"__l{start}_{k}" for k in range(len(conditions))]
    t.df = df.withColumns({n: V.no(c) for n, c in zip(names, chosen, strict=True)}).drop(*drop)
    return [F.col(n) for n in names]


def decode(b: Bound, issues: DataFrame, flags: dict[str, DataFrame] | None = None) -> DataFrame:
    """Issues with their provider key and its status, and a fingerprint of the key.

    Keys are decoded once for each table. A key that another record of the table
    has too does not name a record, so such an issue shows the key but its
    fingerprint stays that of the primary key. Record-level issues are joined by
    row number; column-level ones have no key. flags holds a table of flags by
    table (see add_flags), which conditions read as flag.<name>.
    """
    joined_flags = add_flags(b, flags or {})
    parts = None
    for name, t in b.tables.items():
        if name not in b.spec.tables():
            continue
        found = b.work.keep(decode_table(b, t, joined_flags))
        shared = found.filter("provider_key is not null").groupBy("provider_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("provider_key", F.lit(True).alias("shared"))
        found = found.join(shared, "provider_key", "left")
        n = t.base.groupBy(F.shiftright(ROW, 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        first, at = [], 0
        for r in sorted(n, key=lambda r: r.p):
            first.append((r.p, at))
            at += r.n
        offsets = b.spark.createDataFrame(first, "p long, first long")
        place = F.col("first") + F.col(ROW).bitwiseAND(F.lit((1 << 33) - 1)) + 1
        numbered = found.join(F.broadcast(offsets), F.shiftright(ROW, 33) == F.col("p")).select(F.lit(name).alias("__t"), place.alias("__n"), F.col("provider_key").alias("__key"), F.col("provider_key_status").alias("__status"), F.col("shared").alias("__shared"))
        parts = numbered if parts is None else parts.unionByName(numbered)
    if parts is None:
        return issues
    joined = issues.join(parts, (F.col("table_name") == F.col("__t")) & (F.col("row_number") == F.col("__n")), "left")
    own = F.col("__key").isNotNull() & F.col("__shared").isNull()
    told = F.when(own, F.concat_ws("|", "rule_id", "table_name", "column_name", "__key")).otherwise(F.col("fingerprint_pk"))
    return joined.withColumns({"provider_key": F.col("__key"), "provider_key_status": F.coalesce("__status", F.lit("fallback_pk")), "fingerprint": told}).select(*issues.columns)


def verify_positions(b: Bound, issues: DataFrame) -> DataFrame:
    """Issues whose row no longer holds their key; empty if issues and tables belong together."""
    parts = None
    for name, t in b.tables.items():
        one = t.base.select(F.lit(name).alias("__t"), key_text(b.spec, t).alias("__pk")).filter("__pk is not null").distinct()
        parts = one if parts is None else parts.unionByName(one)
    own = issues.filter("level = 'record' and not pk_positional")
    return own.join(parts, (F.col("table_name") == F.col("__t")) & (F.col("record_pk") == F.col("__pk")), "left_anti")
