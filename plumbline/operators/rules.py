"""The conformance rules as columns over bound tables.

Every rule family returns checks: for each attribute in scope either columns
that say of each row whether it fails (and with what value), or an outcome that
is known without rows. All row checks of a table are evaluated in one pass by
the recorder; rules across rows first add columns to their table by grouped
counts and joins.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import values as V
from plumbline.operators import bind as B
from plumbline.operators.bind import ROW, Bound, Table
from plumbline.plans.model import Attribute, Edge, Spec
from plumbline.plans.registry import BY_ID
from plumbline.plans.settings import Resolved

#: Sums of line hashes that tell multisets of lines apart before they are compared.
SIGNATURE_SUMS = ("s1", "s2")


@dataclass
class Check:
    """One rule on one column. kind: record, unit, not_run or count."""

    rule_id: str
    table: str
    column: str
    kind: str
    fail: Column | None = None
    value: Column | None = None
    expected: Column | str | None = None
    unchecked: Column | None = None
    waiting: Column | None = None
    other_unit: Column | None = None
    masked_by: tuple[str, ...] = ()
    reason: str | None = None
    counted_table: str | None = None
    failed: bool = False
    issues: list[dict] = field(default_factory=list)  # of a unit check: unit, n_records, value, expected
    examples: str | None = None
    index: int = -1

    @property
    def layer(self) -> int:
        return BY_ID[self.rule_id].layer


@dataclass
class Context:
    bound: Bound
    settings: Resolved
    layers: tuple[int, ...] = (0, 1, 2, 3, 4)
    only: frozenset[str] | None = None
    added: dict[tuple, Any] = field(default_factory=dict)

    @property
    def spec(self) -> Spec:
        return self.bound.spec

    def wants(self, rule_id: str) -> bool:
        return BY_ID[rule_id].layer in self.layers and (self.only is None or rule_id in self.only)

    def unknown(self, a: Attribute) -> list[str]:
        return [v for k, v in self.settings["unknown_codes"].items() if k == a.name]


def not_run(rule_id: str, table: str, column: str, reason: str, counted: str | None = None) -> Check:
    return Check(rule_id, table, column, "not_run", reason=reason, counted_table=counted)


def each(ctx: Context, rule_id: str, scope: list[Attribute], evaluate) -> list[Check]:
    """A check for each attribute in scope; one that was not delivered is not run."""
    out = []
    if not ctx.wants(rule_id):
        return out
    for a in scope:
        t = ctx.bound.tables.get(a.table)
        if t is None:
            out.append(not_run(rule_id, a.table, a.name, "no_table"))
        elif not t.has(a.name):
            out.append(not_run(rule_id, a.table, a.name, "no_column"))
        else:
            found = evaluate(t, a)
            if found is not None:
                out.append(found)
    return out


def record(rule_id: str, a: Attribute, fail: Column, value: Column | None, expected=None, **more) -> Check:
    return Check(rule_id, a.table, a.name, "record", fail=V.no(fail), value=value, expected=expected, **more)


# ---- shared masks ------------------------------------------------------


def codes_of(spec: Spec, a: Attribute, own: bool = True) -> list[str]:
    mine = [s.value for s in spec.own_codes(a)]
    return mine if own else list(dict.fromkeys(s.value for s in spec.sentinels if s.family != spec.family(a) and s.value not in mine))


def is_coded(spec: Spec, a: Attribute) -> bool:
    return spec.codes(a) is not None


def rogue_codes(ctx: Context, a: Attribute) -> list[str]:
    listed = ctx.spec.codes(a) or []
    return [c for c in ctx.settings["rogue_codes"] if c not in listed]


def missing_like(ctx: Context, a: Attribute, text: Column, blank: Column | None = None) -> Column:
    """Values that Layer 2 reports, which Layer 1 leaves alone; blank is given where it is known."""
    spec = ctx.spec
    other = codes_of(spec, a, own=False) if codes_of(spec, a) else []
    codes = other + ([] if a.key else rogue_codes(ctx, a)) + ctx.unknown(a)
    if a.key or a.id_marked:
        codes = [*codes, "NA"]
    found = V.no(V.is_blank(text)) if blank is None else blank
    return found | V.no(text.isin(codes)) if codes else found


def domain_skipped(ctx: Context, t: Table, a: Attribute, number: Column | None = None) -> Column:
    """Values that Layer 3 does not judge: null, blank, the type's own codes, unknown codes."""
    return t.once(("skipped", a.name, number is None), lambda: _skipped(ctx, t, a, number))


def _skipped(ctx: Context, t: Table, a: Attribute, number: Column | None) -> Column:
    text = t.text(a, ctx.spec)
    codes = codes_of(ctx.spec, a) + ctx.unknown(a)
    skipped = text.isNull() | t.blank(a)
    if codes:
        skipped = skipped | V.no(text.isin(codes))
        numbers = [float(c) for c in codes if V._is_number(c)]
        if number is not None and numbers:
            skipped = skipped | V.no(number.isin(numbers))
    return skipped


def key_missing(ctx: Context, t: Table, a: Attribute, allowed: str) -> tuple[Column, Column]:
    """(missing, open): a key that is null, NaN, blank or a code keys may not hold; a code they may hold."""
    return t.once(("key", a.name, allowed), lambda: _key_missing(ctx, t, a, allowed))


def _key_missing(ctx: Context, t: Table, a: Attribute, allowed: str) -> tuple[Column, Column]:
    text, kind, own = t.text(a, ctx.spec), t.types[a.name], ctx.spec.own_codes(a)
    no_codes = [s.value for s in own if not getattr(s, allowed)]
    ok_codes = [s.value for s in own if getattr(s, allowed)]
    missing = F.col(a.name).isNull() | V.holds(F.col(a.name), kind, no_codes)
    if V.is_text(kind):
        missing = missing | t.blank(a)
    if kind in V.FRACTION:
        missing = missing | V.no(F.isnan(a.name))
    opened = V.holds(F.col(a.name), kind, ok_codes)
    if ctx.spec.family(a) == "numeric" and not V.is_number(kind):
        number = t.number(a).value
        if lost := [float(c) for c in no_codes if V._is_number(c)]:
            missing = missing | V.no(number.isin(lost))
        if held := [float(c) for c in ok_codes if V._is_number(c)]:
            opened = opened | V.no(number.isin(held))
    return missing, opened


def compared(ctx: Context, t: Table, a: Attribute) -> Column:
    """A value as groups compare it: a number by its number, what does not read as one as written."""
    return t.once(("compared", a.name), lambda: _compared(ctx, t, a))


def _compared(ctx: Context, t: Table, a: Attribute) -> Column:
    text = t.text(a, ctx.spec)
    if ctx.spec.family(a) == "numeric" and V.is_text(t.types[a.name]):
        number = t.number(a)
        return F.when(~number.lost & number.value.isNotNull(), V.number_text(number.value)).otherwise(text)
    return text


# ---- layer 0 -----------------------------------------------------------


def structure(ctx: Context) -> list[Check]:
    b, spec, out = ctx.bound, ctx.spec, []

    def unit(rule_id, table, column, failed, n=1, value=None, expected=None):
        if ctx.wants(rule_id):
            issues = [{"unit": None, "n_records": n, "value": value, "expected": expected}] if failed else []
            out.append(Check(rule_id, table, column, "unit", failed=failed, issues=issues, examples=value))

    for name in spec.tables():
        unit("table_missing", name, "*", name not in b.tables)
    for name, t in b.tables.items():
        if name not in spec.tables():
            unit("table_unexpected", name, "*", True, n=t.base.count() if ctx.wants("table_unexpected") else 0)
    for a in spec.attributes:
        t = b.tables.get(a.table)
        if t is None:
            if ctx.wants("column_missing"):
                out.append(not_run("column_missing", a.table, a.name, "no_table"))
        else:
            unit("column_missing", a.table, a.name, not t.has(a.name))
    for name in spec.tables():
        if name in b.tables:
            t = b.tables[name]
            for a, (c, near) in t.columns.items():
                unit("column_unexpected", name, c, False)
                unit("column_name_mismatch", name, a, near, value=c, expected=a)
            for c in t.extra:
                unit("column_unexpected", name, c, True)
    return out


# ---- layer 1 -----------------------------------------------------------


def types(ctx: Context) -> list[Check]:
    spec, out = ctx.spec, []
    numeric = [a for a in spec.attributes if spec.family(a) == "numeric"]
    dates = [a for a in spec.attributes if spec.family(a) == "date"]

    def padding_checked(t, a):
        return V.is_text(t.types[a.name]) and bool(a.key or a.id_marked or is_coded(spec, a))

    def storage(rule_id):
        def evaluate(t, a):
            if t.text_input:
                return not_run(rule_id, a.table, a.name, "text_input")
            word, wanted = V.stored(t.types[a.name]), spec.type_of(a).r_class
            near = "integer" if word == "integer64" else word
            if rule_id == "class_mismatch":
                failed = near != wanted and not (near in ("integer", "double") and wanted in ("integer", "double"))
            else:
                failed = {near, wanted} == {"integer", "double"}
            issues = [{"unit": None, "n_records": t.base.count(), "value": word, "expected": wanted}] if failed else []
            return Check(rule_id, a.table, a.name, "unit", failed=failed, issues=issues, examples=word if failed else None)

        return evaluate

    def lost(t, a):
        kind, c = t.types[a.name], F.col(a.name)
        wanted = spec.type_of(a).r_class
        if wanted == "character":
            return record("coercion_loss", a, F.lit(False), None, wanted)
        text = t.text(a, spec)
        fail = t.number(a, wanted == "integer").lost & ~t.once(("missing", a.name), lambda: missing_like(ctx, a, text, t.blank(a)))
        if padding_checked(t, a):
            bare = V.trimmed(text)
            passes = ~V.read_number(bare, "string", wanted == "integer").lost | missing_like(ctx, a, bare)
            fail = fail & ~(V.no(V.is_padded(text)) & passes)
        return record("coercion_loss", a, fail, text, wanted)

    def unparseable(t, a):
        text, written = t.text(a, spec), spec.type_of(a).date_format
        own = codes_of(spec, a)

        def bad(x):
            left = missing_like(ctx, a, x) | (V.no(x.isin(own)) if own else F.lit(False))
            return x.isNotNull() & ~left & ~V.reads_as_date(x, written)

        fail = bad(text)
        if padding_checked(t, a):
            fail = fail & ~(V.no(V.is_padded(text)) & ~bad(V.trimmed(text)))
        return record("date_unparseable", a, fail, text, written)

    def endless(t, a):
        return record("value_not_finite", a, t.number(a).not_finite, t.text(a, spec))

    out += each(ctx, "class_mismatch", list(spec.attributes), storage("class_mismatch"))
    out += each(ctx, "coercion_loss", list(spec.attributes), lost)
    out += each(ctx, "date_unparseable", dates, unparseable)
    out += each(ctx, "integer_stored_as_double", numeric, storage("integer_stored_as_double"))
    out += each(ctx, "value_not_finite", numeric, endless)
    return out


# ---- layer 2 -----------------------------------------------------------


def missing_codes(ctx: Context) -> list[Check]:
    spec, out, policy = ctx.spec, [], ctx.settings["raw_na_policy"]
    plain = [a for a in spec.attributes if not a.key]
    ids = [a for a in spec.attributes if a.key or a.id_marked]
    padded = [a for a in spec.attributes if a.key or a.id_marked or is_coded(spec, a)]

    def joined(a):
        return "; ".join(codes_of(spec, a)) or None

    def null(t, a):
        if policy == "when_sentinels" and not codes_of(spec, a):
            return not_run("raw_na", a.table, a.name, "no_sentinels")
        return record("raw_na", a, F.col(a.name).isNull(), F.lit(None).cast("string"), joined(a))

    def blank(t, a):
        fail = t.blank(a)
        return record("blank_string", a, fail, t.text(a, spec), joined(a))

    def wrong(t, a) -> tuple[Column, list[tuple[Column, str]]]:
        """Rows that hold another family's code, and the conditions by role."""
        mine, by_role = codes_of(spec, a), []
        for s in spec.sentinels:
            if s.family == spec.family(a) or s.value in mine:
                continue
            if V.is_number(t.types[a.name]) and s.family != "numeric":
                hit = V.no(t.text(a, spec) == s.value) if spec.family(a) != "numeric" else F.lit(False)
            else:
                hit = V.holds(F.col(a.name), t.types[a.name], [s.value])
            by_role.append((hit, s.role))
        known = V.holds(F.col(a.name), t.types[a.name], ctx.unknown(a))
        return V.any_of(*[h for h, _ in by_role]) & ~known, by_role

    def own_held(t, a):
        mine = codes_of(spec, a)
        if V.is_number(t.types[a.name]) and spec.family(a) != "numeric":
            return V.no(t.text(a, spec).isin(mine)) if mine else F.lit(False)
        return V.holds(F.col(a.name), t.types[a.name], mine)

    def wrong_type(t, a):
        right = {s.role: s.value for s in spec.own_codes(a)}
        if not right:
            return not_run("sentinel_wrong_type", a.table, a.name, "no_sentinels")
        fail, by_role = wrong(t, a)
        expected = F.coalesce(*[F.when(h, F.lit(right.get(role))) for h, role in by_role], F.lit(None).cast("string"))
        return record("sentinel_wrong_type", a, fail, t.text(a, spec), expected)

    def rogue(t, a):
        codes = [c for c in rogue_codes(ctx, a) if not (a.id_marked and c == "NA")]
        fail = V.holds(F.col(a.name), t.types[a.name], codes) & ~own_held(t, a) & ~V.holds(F.col(a.name), t.types[a.name], ctx.unknown(a))
        if codes_of(spec, a):
            fail = fail & ~wrong(t, a)[0]
        return record("sentinel_rogue_code", a, fail, t.text(a, spec), joined(a))

    def unknown(t, a):
        fail = V.holds(F.col(a.name), t.types[a.name], ctx.unknown(a)) & ~own_held(t, a)
        missing = "; ".join(s.value for s in spec.own_codes(a) if s.role == "missing") or None
        return record("species_unknown_code", a, fail, t.text(a, spec), missing)

    def padding(t, a):
        c = F.col(a.name)
        fail = V.is_padded(c) if V.is_text(t.types[a.name]) else F.lit(False)
        return record("whitespace_padding", a, fail, t.text(a, spec), V.trimmed(c) if V.is_text(t.types[a.name]) else None)

    def na_text(t, a):
        return record("na_text_in_id", a, F.col(a.name) == "NA" if V.is_text(t.types[a.name]) else F.lit(False), F.lit("NA"))

    if policy != "never":
        out += each(ctx, "raw_na", plain, null)
    out += each(ctx, "blank_string", plain, blank)
    out += each(ctx, "sentinel_wrong_type", list(spec.attributes), wrong_type)
    out += each(ctx, "sentinel_rogue_code", plain, rogue)
    named = [a for a in spec.attributes if a.name in ctx.settings["unknown_codes"]]
    if not ctx.settings["unknown_codes"]:
        out += [not_run("species_unknown_code", "*", "*", "no_input")] if ctx.wants("species_unknown_code") else []
    else:
        out += each(ctx, "species_unknown_code", named, unknown)
    out += each(ctx, "whitespace_padding", padded, padding)
    out += each(ctx, "na_text_in_id", ids, na_text)
    return out


# ---- layer 3 -----------------------------------------------------------


def bound_text(x: float) -> str:
    return f"{x:.15g}" if "e" not in f"{x:.15g}" else str(int(x)) if x == int(x) else repr(x)


def domains(ctx: Context) -> list[Check]:
    spec, out = ctx.spec, []
    coordinates = set(ctx.settings["coordinate_attributes"])
    family = {id(a): spec.family(a) for a in spec.attributes}

    def scoped(rule_id, keep, evaluate):
        scope = [a for a in spec.attributes if keep(a)]
        if not scope:
            return [not_run(rule_id, "*", "*", "no_dd_values")] if ctx.wants(rule_id) else []
        return each(ctx, rule_id, scope, evaluate)

    def number_of(t, a):
        return t.number(a).value

    def beyond(number, a, side):
        bound = a.min_value if side == "min" else a.max_value
        inclusive = a.min_inclusive if side == "min" else a.max_inclusive
        if bound is None:
            return F.lit(False)
        hit = (number < bound if inclusive else number <= bound) if side == "min" else (number > bound if inclusive else number >= bound)
        return V.no(hit & ~F.isnan(number))

    def listed(t, a):
        codes, number = spec.codes(a), number_of(t, a) if family[id(a)] == "numeric" else None
        fail = ~V.holds(F.col(a.name), t.types[a.name], codes) & ~domain_skipped(ctx, t, a, number)
        return record("code_not_in_list", a, fail, t.text(a, spec), spec.code_source(a)[0])

    def ranged(rule_id, side):
        def evaluate(t, a):
            number = number_of(t, a)
            bound = a.min_value if side == "min" else a.max_value
            return record(rule_id, a, beyond(number, a, side) & ~domain_skipped(ctx, t, a, number), t.text(a, spec), bound_text(bound))

        return evaluate

    def too_long(t, a):
        text = t.text(a, spec)
        return record("string_too_long", a, (F.char_length(text) > a.max_length) & ~domain_skipped(ctx, t, a), text, str(a.max_length))

    def pattern(t, a):
        text = t.text(a, spec)
        return record("pattern_mismatch", a, ~text.rlike(V.java_pattern(a.pattern)) & ~domain_skipped(ctx, t, a), text, a.pattern)

    def decimals(t, a):
        number = number_of(t, a)
        return record("decimals_exceeded", a, (V.decimal_places(V.number_text(number)) > a.decimals) & ~domain_skipped(ctx, t, a, number), t.text(a, spec), str(a.decimals))

    def outside(t, a):
        number = number_of(t, a)
        low, high = beyond(number, a, "min"), beyond(number, a, "max")
        expected = F.when(low, F.lit(None if a.min_value is None else bound_text(a.min_value))).otherwise(F.lit(None if a.max_value is None else bound_text(a.max_value)))
        return record("coordinate_out_of_bounds", a, (low | high) & ~domain_skipped(ctx, t, a, number), t.text(a, spec), expected)

    out += each(ctx, "code_not_in_list", [a for a in spec.attributes if is_coded(spec, a)], listed)
    out += scoped("value_below_min", lambda a: family[id(a)] == "numeric" and a.min_value is not None and a.name not in coordinates, ranged("value_below_min", "min"))
    out += scoped("value_above_max", lambda a: family[id(a)] == "numeric" and a.max_value is not None and a.name not in coordinates, ranged("value_above_max", "max"))
    out += scoped("string_too_long", lambda a: family[id(a)] != "numeric" and a.max_length is not None, too_long)
    out += scoped("pattern_mismatch", lambda a: family[id(a)] != "numeric" and a.pattern is not None, pattern)
    out += scoped("decimals_exceeded", lambda a: family[id(a)] == "numeric" and a.decimals is not None, decimals)
    out += _bands(ctx)
    if not coordinates:
        out += [not_run("coordinate_out_of_bounds", "*", "*", "no_input")] if ctx.wants("coordinate_out_of_bounds") else []
    else:
        out += scoped("coordinate_out_of_bounds", lambda a: family[id(a)] == "numeric" and a.name in coordinates and (a.min_value is not None or a.max_value is not None), outside)
    if ctx.wants("undeclared_code_set"):
        out += _code_sets(ctx)
    return out


def _bands(ctx: Context) -> list[Check]:
    """IDs outside the band of the key that their record reaches."""
    spec, where = ctx.spec, ctx.spec.id_band_columns
    if not ctx.wants("site_id_out_of_range"):
        return []
    if not where:
        return [not_run("site_id_out_of_range", "*", "*", "no_input")]
    scope = [a for a in spec.attributes if (a.table, a.name) == (where["table_name"], where["attribute_name"])]

    def evaluate(t, a):
        read = B.read_chain(ctx.bound, t.df, a.table, where["key_attribute"], "__band_key")
        if read is None:
            return not_run("site_id_out_of_range", a.table, a.name, "no_column")
        df, kind = read
        rows = [(str(x["key_value"]), float(x["band_start"]), float(x["band_end"])) for x in spec.id_bands]
        bands = ctx.bound.spark.createDataFrame(rows, "__band string, __band_start double, __band_end double")
        # the bands are part of the specification, so their number is that of its rows
        t.df = df.withColumn("__band_key", V.value_text(F.col("__band_key"), kind)).drop("__band_key__unit").join(F.broadcast(bands), F.col("__band_key") == F.col("__band"), "left")
        number = t.number(a).value
        unchecked = F.col("__band").isNull() | number.isNull() | F.isnan(number) | domain_skipped(ctx, t, a, number)
        fail = ~unchecked & ((number < F.col("__band_start")) | (number > F.col("__band_end")))
        expected = F.concat(V.number_text(F.col("__band_start")), F.lit(" to "), V.number_text(F.col("__band_end")))
        return record("site_id_out_of_range", a, fail, t.text(a, spec), expected, unchecked=V.no(unchecked))

    return each(ctx, "site_id_out_of_range", scope, evaluate)


def _code_sets(ctx: Context) -> list[Check]:
    """Text columns without a list that look as if they had one: many values, few different."""
    import re

    b, spec, most = ctx.bound, ctx.spec, ctx.settings["code_set_max_values"]
    skip, skipped = ctx.settings["code_set_skip_pattern"], set(ctx.settings["code_set_skip_attributes"])
    judged = [a for a in spec.attributes if spec.family(a) == "character" and not is_coded(spec, a) and not a.key and not a.id_marked and a.name not in skipped and not (skip and re.search(skip, a.name))]
    others = list(dict.fromkeys(s.value for s in spec.sentinels if s.family != "character")) if any(s.family == "character" for s in spec.sentinels) else []
    unit = F.col(b.groups[0]) if b.groups else F.lit("*")
    out = []
    for name in spec.tables():
        mine = [a for a in judged if a.table == name]
        t = b.tables.get(name)
        out += [not_run("undeclared_code_set", name, a.name, "no_table" if t is None else "no_column") for a in mine if t is None or not t.has(a.name)]
        mine = [a for a in mine if t is not None and t.has(a.name)]
        if not mine:
            continue
        kept = {a.name: F.when(~domain_skipped(ctx, t, a) & (~V.no(t.text(a, spec).isin(others)) if others else F.lit(True)), t.text(a, spec)) for a in mine}
        # values of more than `most` different hash places are more than `most` values: a bitmap a column proves it
        places = t.base.agg(*[F.bitmap_count(F.bitmap_construct_agg(F.when(v.isNotNull(), F.pmod(F.xxhash64(v), F.lit(1 << 15))))).alias(n) for n, v in kept.items()]).first()
        few = [a for a in mine if (places[a.name] or 0) <= most]
        held: dict[str, list] = {a.name: [] for a in few}
        if few:
            cells = F.explode(F.array(*[F.struct(F.lit(a.name).alias("c"), kept[a.name].alias("v")) for a in few])).alias("x")
            # few values, a row for each unit that holds one
            counted = t.base.select(unit.alias("u"), cells).filter("x.v is not null").groupBy("x.c", "x.v", "u").agg(F.count(F.lit(1)).alias("n"))
            for r in counted.collect():
                held[r.c].append(r)
            sizes = {r.u: r.n for r in t.base.groupBy(unit.alias("u")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for a in mine:
            rows = held.get(a.name)
            if rows is None or len(found := sorted({r.v for r in rows}, key=lambda v: v.encode())) > most:
                out.append(Check("undeclared_code_set", name, a.name, "unit"))
            elif sum(r.n for r in rows) > most:
                shown = "; ".join(found[: ctx.settings["example_cap"]]) or None
                issues = []
                for u in sorted({r.u for r in rows}, key=lambda u: u.encode()):
                    values = sorted({r.v for r in rows if r.u == u}, key=lambda v: v.encode())
                    issues.append({"unit": u if b.groups else None, "n_records": sizes[u], "value": "; ".join(values), "expected": None})
                out.append(Check("undeclared_code_set", name, a.name, "unit", failed=True, issues=issues, examples=shown))
    return out


# ---- layer 4 -----------------------------------------------------------


def keys(ctx: Context) -> list[Check]:
    b, spec, out = ctx.bound, ctx.spec, []
    primary = [a for name in spec.tables() for a in spec.primary_key(name)]
    firsts = [spec.primary_key(n)[0] for n in spec.tables() if spec.primary_key(n)]
    foreign = [a for a in spec.attributes if a.is_fk]
    edges = [a for a in foreign if spec.edge(a.table, a.name)]

    def duplicate(t, a):
        parts = spec.primary_key(a.table)
        if not all(t.has(p.name) for p in parts):
            return not_run("pk_duplicate", a.table, a.name, "no_column")
        t.df = repeats(ctx, t, parts)
        value = F.concat_ws("|", *[F.coalesce(t.text(p, spec), F.lit("NA")) for p in parts])
        return record("pk_duplicate", a, F.col("__pk_repeats"), value)

    def absent(rule_id, allowed):
        return lambda t, a: record(rule_id, a, key_missing(ctx, t, a, allowed)[0], t.text(a, spec))

    def orphan(t, a):
        e = spec.edge(a.table, a.name)
        if reason := parent_missing(ctx, e):
            return not_run("fk_orphan", a.table, a.name, reason)
        t.df = parent_row(ctx, t, e)
        missing, opened = key_missing(ctx, t, a, "allowed_in_fk")
        return record("fk_orphan", a, F.col(f"__p_{a.name}").isNull() & ~missing & ~opened, t.text(a, spec), e.parent, waiting=opened & ~missing)

    def unverified(t, a):
        return record("fk_sentinel_unverified", a, key_missing(ctx, t, a, "allowed_in_fk")[1], t.text(a, spec))

    out += each(ctx, "pk_duplicate", firsts, duplicate)
    out += each(ctx, "pk_missing", primary, absent("pk_missing", "allowed_in_pk"))
    out += each(ctx, "fk_orphan", edges, orphan)
    out += each(ctx, "fk_unassigned", foreign, absent("fk_unassigned", "allowed_in_fk"))
    out += each(ctx, "fk_sentinel_unverified", [a for a in foreign if spec.family(a) == "numeric"], unverified)
    out += each(ctx, "fk_not_applicable_mismatch", foreign, lambda t, a: not_run("fk_not_applicable_mismatch", a.table, a.name, "no_matrix"))
    out += _source_ids(ctx)
    out += _coherence(ctx)
    if ctx.wants("record_unreachable"):
        from plumbline.operators.reach import unreachable

        out += unreachable(ctx)
    if ctx.wants("parent_without_children"):
        out += [_childless(ctx, spec.edge(a.table, a.name)) for a in edges]
    out += _designs(ctx)
    return [c for c in out if c is not None]


def parent_missing(ctx: Context, e: Edge) -> str | None:
    t = ctx.bound.tables.get(e.parent)
    return "no_table" if t is None else None if t.has(e.parent_key) else "no_column"


def repeats(ctx: Context, t: Table, parts: list[Attribute]) -> DataFrame:
    """t.df with __pk_repeats: the whole key is held by more than one row. Counted by key, then joined."""
    if "__pk_repeats" in t.df.columns:
        return t.df
    dead = V.any_of(*[x for p in parts for x in key_missing(ctx, t, p, "allowed_in_pk")])
    named = [F.when(~dead, compared(ctx, t, p)).alias(f"__k{i}") for i, p in enumerate(parts)]
    names = [f"__k{i}" for i in range(len(parts))]
    many = t.base.select(*named).filter("__k0 is not null").groupBy(*names).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    on = [F.col(f"__k{i}") == F.col(f"__m{i}") for i in range(len(parts))]
    df = t.df.withColumns({f"__k{i}": F.when(~dead, compared(ctx, t, p)) for i, p in enumerate(parts)})
    joined = df.join(many.select(*[F.col(n).alias(f"__m{i}") for i, n in enumerate(names)], "__n"), on, "left")
    return joined.withColumn("__pk_repeats", F.col("__n").isNotNull()).drop(*names, *[f"__m{i}" for i in range(len(parts))], "__n")


def parent_row(ctx: Context, t: Table, e: Edge) -> DataFrame:
    """t.df with __p_<attribute>: the first row of the parent that holds the key."""
    name = f"__p_{e.attribute}"
    if name in t.df.columns:
        return t.df
    b, spec = ctx.bound, ctx.spec
    parent, fk, pk = b.tables[e.parent], spec.attribute(e.table, e.attribute), spec.attribute(e.parent, e.parent_key)
    holders = parent.base.select(B.join_key(spec, parent, pk, fk).alias("__pk"), ROW).filter("__pk is not null").groupBy("__pk").agg(F.min(ROW).alias(name))
    return t.df.withColumn("__fk", B.join_key(spec, t, fk, pk)).join(holders, F.col("__fk") == F.col("__pk"), "left").drop("__fk", "__pk")


def _source_ids(ctx: Context) -> list[Check]:
    """IDs repeated within a table and report unit, where their contributor does not document that."""
    b, spec = ctx.bound, ctx.spec

    def evaluate(t, a):
        missing, opened = key_missing(ctx, t, a, "allowed_in_fk")
        left = missing | opened
        documented = [x["contributor_label"] for x in spec.one_to_many if (x["table_name"], x["attribute_name"]) == (a.table, a.name)]
        if documented:
            from plumbline.operators.decode import add_label

            t.df = add_label(b, t)
            left = left | V.no(F.col("__label").isin(documented))
        unit = F.col(b.groups[0]) if b.groups else F.lit("1")
        mine, name = F.when(~left & (unit != "*"), t.text(a, spec)), f"__r_{a.name}"
        many = t.df.select(unit.alias("__u"), mine.alias("__v")).filter("__v is not null").groupBy("__u", "__v").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__u", "__v", F.lit(True).alias(name))
        df = t.df.withColumn("__my", mine).withColumn("__unit", unit)
        t.df = df.join(many, (F.col("__my") == F.col("__v")) & (F.col("__unit") == F.col("__u")), "left").drop("__my", "__unit", "__u", "__v")
        return record("src_id_duplicate", a, V.no(F.col(name)), t.text(a, spec), unchecked=unit == "*")

    return each(ctx, "src_id_duplicate", [a for a in spec.attributes if a.id_marked and not a.key], evaluate)


def _coherence(ctx: Context) -> list[Check]:
    """Two ways to a value, through keys, that do not agree."""
    b, spec = ctx.bound, ctx.spec
    if not ctx.wants("key_incoherent"):
        return []
    if spec.key_pairs is None:
        return [not_run("key_incoherent", "*", "*", "no_input")]
    heads = list(dict.fromkeys((p["table_name"], p["left"].split(">")[0].strip()) for p in spec.key_pairs))
    scope = [x for x in (spec.attribute(*h) for h in heads) if x]

    def evaluate(t, a):
        bad, any_compared, shown, wanted, other = [], F.lit(False), [], [], F.lit(False)
        for k, p in enumerate(x for x in spec.key_pairs if (x["table_name"], x["left"].split(">")[0].strip()) == (a.table, a.name)):
            sides = []
            for side in ("left", "right"):
                out = f"__{side}{k}_{a.name}"
                read = B.read_chain(b, t.df, a.table, p[side], out)
                if read is None:
                    break
                t.df, kind = read
                steps, home, last = spec.chain(a.table, p[side])
                end = spec.attribute(home, last)
                text = V.value_text(F.col(out), kind, spec.type_of(end).date_format)
                codes = codes_of(spec, end)
                skip = text.isNull() | V.no(V.is_blank(text)) | V.holds(F.col(out), kind, codes) | (V.no(text.isin(codes)) if codes else F.lit(False))
                if b.groups and steps:
                    theirs = F.col(f"{out}__unit")
                    other = other | V.no((theirs == "*") | (theirs != F.col(b.groups[0])))
                sides.append((text, skip, last))
            if len(sides) < 2:
                continue
            (lt, ls, label), (rt, rs, _) = sides
            both = ~ls & ~rs
            differ = V.no(both & (lt != rt))
            any_compared = any_compared | both
            bad.append(differ)
            shown.append(F.when(differ, F.concat(F.lit(f"{label}="), lt)))
            wanted.append(F.when(differ, F.concat(F.lit(f"{label}="), rt)))
        if not bad:
            return record("key_incoherent", a, F.lit(False), None, unchecked=F.lit(True))
        return record("key_incoherent", a, V.any_of(*bad), F.concat_ws("; ", *shown), F.concat_ws("; ", *wanted), unchecked=~any_compared, other_unit=other)

    return each(ctx, "key_incoherent", scope, evaluate)


def _childless(ctx: Context, e: Edge) -> Check:
    """Parents that no child names, counted in the parents' groups."""
    b, spec = ctx.bound, ctx.spec
    child = b.tables.get(e.table)
    reason = "no_table" if child is None else "no_column" if not child.has(e.attribute) else parent_missing(ctx, e)
    if reason:
        return not_run("parent_without_children", e.table, e.attribute, reason, e.parent)
    parent, pk, fk = b.tables[e.parent], spec.attribute(e.parent, e.parent_key), spec.attribute(e.table, e.attribute)
    named = child.base.select(B.join_key(spec, child, fk, pk).alias("__named")).filter("__named is not null").distinct()
    own = parent.base.withColumn("__key", B.join_key(spec, parent, pk)).withColumn("__join", B.join_key(spec, parent, pk, fk))
    joined = own.join(named, F.col("__join") == F.col("__named"), "left")
    counted = joined.groupBy(*b.groups).agg(F.count_if(F.col("__key").isNotNull() & F.col("__named").isNull()).alias("n_fail"), F.count_if(F.col("__key").isNull()).alias("waiting"), F.count(F.lit(1)).alias("size"))
    check = Check("parent_without_children", e.table, e.attribute, "count", counted_table=e.parent)
    ctx.added["count", e.table, e.attribute] = counted
    return check


def _designs(ctx: Context) -> list[Check]:
    b, spec, s, out = ctx.bound, ctx.spec, ctx.settings, []
    most = s["example_cap"]

    def grouping(t: Table, by: list[str]) -> Column | None:
        """One text for a row's group, null where a grouping key is missing; None where a column was not given."""
        if not all(t.has(x) for x in by):
            return None
        parts = [spec.attribute(t.name, x) for x in by]
        dead = V.any_of(*[x for p in parts for x in key_missing(ctx, t, p, "allowed_in_fk")])
        return F.when(~dead, F.to_json(F.array(*[F.coalesce(compared(ctx, t, p), F.lit("")) for p in parts])))

    def rest(listed: Column, n: Column) -> Column:
        return F.concat(listed, F.when(n > most, F.concat(F.lit("; and "), (n - most).cast("string"), F.lit(" more"))).otherwise(F.lit("")))

    table, by, columns = s["design_geometry_table"], list(s["design_geometry_by"]), list(s["design_geometry_columns"])
    if ctx.wants("design_geometry_inconsistent"):
        if not (table and by and columns):
            out.append(not_run("design_geometry_inconsistent", "*", "*", "no_input"))
        else:

            def geometry(t, a):
                group = grouping(t, by)
                if group is None:
                    return not_run("design_geometry_inconsistent", a.table, a.name, "no_column")
                text, numeric = F.coalesce(t.text(a, spec), F.lit("")), spec.family(a) == "numeric"
                unit = F.col(b.groups[0]) if b.groups else F.lit("1")
                # distinct values of a group first; a group's list is cut to the first ones by a ranked window
                values = t.base.select(group.alias("__g"), F.coalesce(compared(ctx, t, a), F.lit("")).alias("__c"), text.alias("__v"), unit.alias("__u")).filter("__g is not null")
                spans = values.groupBy("__g").agg((F.min("__c") != F.max("__c")).alias("__differs"), (V.no(F.min("__u") != F.max("__u")) | V.no(F.max(F.col("__u") == "*"))).alias("__spans")).filter("__differs")
                distinct = values.select("__g", "__v").distinct().join(spans.select("__g"), "__g", "left_semi")
                number = F.col("__v").try_cast("double") if numeric else F.lit(None).cast("double")
                from pyspark.sql import Window

                w = Window.partitionBy("__g").orderBy(F.col("__v") != "", number.asc_nulls_last(), "__v")
                first = distinct.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= max(1, most)).groupBy("__g").agg(F.array_sort(F.collect_list(F.struct("__n", F.when(F.col("__v") == "", "(blank)").otherwise(F.col("__v")).alias("v")))).alias("l"))
                count = distinct.groupBy("__g").agg(F.count(F.lit(1)).alias("__count"))
                lists = first.join(count, "__g").join(spans, "__g").select("__g", rest(F.array_join(F.col("l.v"), "; "), F.col("__count")).alias(f"__list_{a.name}"), F.col("__spans").alias(f"__spans_{a.name}"))
                t.df = t.df.withColumn("__my_group", group).join(lists, F.col("__my_group") == F.col("__g"), "left").drop("__my_group", "__g")
                return record("design_geometry_inconsistent", a, F.col(f"__list_{a.name}").isNotNull(), t.text(a, spec), F.col(f"__list_{a.name}"), other_unit=V.no(F.col(f"__spans_{a.name}")) if b.groups else None)

            out += each(ctx, "design_geometry_inconsistent", [x for x in (spec.attribute(table, c) for c in columns) if x], geometry)

    table, columns = s["subplot_label_table"], list(s["subplot_label_columns"])
    if ctx.wants("subplot_label_ambiguous"):
        if not (table and columns):
            out.append(not_run("subplot_label_ambiguous", "*", "*", "no_input"))
        else:

            def ambiguous(t, a):
                group, parts = grouping(t, columns), spec.primary_key(t.name)
                if group is None or not all(t.has(p.name) for p in parts):
                    return not_run("subplot_label_ambiguous", a.table, a.name, "no_column")
                dead = V.any_of(*[key_missing(ctx, t, p, "allowed_in_pk")[0] for p in parts])
                key = F.to_json(F.array(*[F.coalesce(compared(ctx, t, p), F.lit("")) for p in parts]))
                mine = F.when(~dead, group)
                many = t.base.select(mine.alias("__g"), key.alias("__c")).filter("__g is not null").groupBy("__g").agg((F.min("__c") != F.max("__c")).alias("__differs")).filter("__differs").select("__g", F.lit(True).alias("__ambiguous"))
                t.df = t.df.withColumn("__my_group", mine).join(many, F.col("__my_group") == F.col("__g"), "left").drop("__my_group", "__g")
                return record("subplot_label_ambiguous", a, V.no(F.col("__ambiguous")), t.text(a, spec))

            out += each(ctx, "subplot_label_ambiguous", [x for x in [spec.attribute(table, columns[-1])] if x], ambiguous)

    table, by, columns = s["design_signature_table"], s["design_signature_by"], list(s["design_signature_columns"])
    if ctx.wants("design_duplicate_signature"):
        e = spec.edge(table, by) if table and by else None
        if not (table and by and columns) or e is None:
            out.append(not_run("design_duplicate_signature", "*", "*", "no_input"))
        else:

            def signature(t, a):
                child = b.tables.get(table)
                if child is None:
                    return not_run("design_duplicate_signature", a.table, a.name, "no_table")
                if not child.has(by) or not all(child.has(c) for c in columns):
                    return not_run("design_duplicate_signature", a.table, a.name, "no_column")
                # a multiset of lines is first told apart by its count and the sums of two hashes of each line, without
                # gathering rows; those that agree in that are then compared line by line
                cells = F.to_json(F.array(*[F.coalesce(compared(ctx, child, spec.attribute(table, c)), F.lit("\u0000")) for c in columns]))
                fk = spec.attribute(table, by)
                lines = child.base.select(B.join_key(spec, child, fk, a).alias("__fk"), cells.alias("__line")).filter("__fk is not null")
                sums = lines.groupBy("__fk").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("__line").cast("decimal(38,0)")).alias("s1"), F.sum(F.xxhash64("__line", F.lit(1)).cast("decimal(38,0)")).alias("s2"))
                print_ = F.concat_ws(":", F.col("n").cast("string"), *[F.col(x).cast("string") for x in SIGNATURE_SUMS])
                unit = F.col(b.groups[0]) if b.groups else F.lit("1")
                holders = t.base.select(B.join_key(spec, t, a, fk).alias("__pk"), ROW, unit.alias("__u"), t.text(a, spec).alias("__id")).filter("__pk is not null").groupBy("__pk").agg(F.min(F.struct(ROW, "__u", "__id")).alias("h"))
                signed = holders.join(sums.select(F.col("__fk").alias("__pk"), print_.alias("__print")), "__pk").select("__pk", F.col(f"h.{ROW}").alias("__owner"), F.col("h.__u").alias("__u"), F.col("h.__id").alias("__id"), "__print")
                signed = b.work.keep(signed)
                from pyspark.sql import Window

                alike = _equal_lines(b, signed.filter("__u <> '*'"), lines)
                shared = alike.groupBy("__u", "__first").agg(F.count(F.lit(1)).alias("__size")).filter("__size > 1")
                twins = b.work.keep(alike.join(shared, ["__u", "__first"]))
                # a group's first ones only are ranked: Spark cuts each task's rows to them before they are shuffled
                place = F.row_number().over(Window.partitionBy("__u", "__first").orderBy("__id", "__owner"))
                heads = twins.withColumn("__place", place).filter(F.col("__place") <= most + 1).groupBy("__u", "__first").agg(F.array_sort(F.collect_list(F.struct("__id", "__owner"))).alias("__heads"))
                others = F.slice(F.filter("__heads", lambda x: x["__owner"] != F.col("__owner")), 1, max(1, most))
                listed = twins.join(b.work.keep(heads), ["__u", "__first"]).select("__owner", rest(F.array_join(F.transform(others, lambda x: x["__id"]), "; "), F.col("__size") - 1).alias("__twins"))
                t.df = t.df.join(listed, F.col(ROW) == F.col("__owner"), "left").drop("__owner")
                t.df = t.df.join(signed.select(F.col("__owner"), F.lit(True).alias("__signed")), F.col(ROW) == F.col("__owner"), "left").drop("__owner")
                star = V.no(F.col("__signed")) & (unit == "*")
                return record("design_duplicate_signature", a, F.col("__twins").isNotNull(), t.text(a, spec), F.col("__twins"), unchecked=star)

            out += each(ctx, "design_duplicate_signature", [spec.attribute(e.parent, e.parent_key)], signature)
    return out


def _equal_lines(b: Bound, signed: DataFrame, lines: DataFrame) -> DataFrame:
    """signed (__pk, __u, __print, ...) with __first: the least key, of those of its unit and print, that has the same lines.

    Of each unit and print the least key stands for the others; a key whose
    lines, with their numbers, are all its lines too has the same ones. Keys that
    only share its print go round again among themselves.
    """
    shared = b.work.keep(signed.groupBy("__u", "__print").agg(F.count(F.lit(1)).alias("n"), F.min("__pk").alias("__first")).filter("n > 1").drop("n"))
    left = b.work.keep(signed.join(shared, ["__u", "__print"]).select(*signed.columns))
    counted = lines.join(left.select(F.col("__pk").alias("__fk")), "__fk", "left_semi").groupBy("__fk", "__line").agg(F.count(F.lit(1)).alias("__times"))
    counted = b.work.keep(counted.withColumnRenamed("__fk", "__pk"))
    kinds = b.work.keep(counted.groupBy("__pk").agg(F.count(F.lit(1)).alias("__kinds")))
    found = None
    while found is None or not left.isEmpty():
        firsts = left.groupBy("__u", "__print").agg(F.min("__pk").alias("__first"))
        model = firsts.join(counted.withColumnRenamed("__pk", "__first"), "__first").join(kinds.withColumnRenamed("__pk", "__first"), "__first")
        same = left.select("__u", "__print", "__pk").join(counted, "__pk").join(b.work.keep(model), ["__u", "__print", "__line", "__times"]).groupBy("__pk", "__first").agg(F.count(F.lit(1)).alias("n"), F.first("__kinds").alias("theirs"))
        same = same.join(kinds, "__pk").filter("n = theirs and n = __kinds").select("__pk", "__first")
        done = b.work.keep(left.join(same, "__pk"))
        found = done if found is None else found.unionByName(done)
        left = b.work.keep(left.join(done.select("__pk"), "__pk", "left_anti"))
    return found


FAMILIES = (structure, types, missing_codes, domains, keys)
