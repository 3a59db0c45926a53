"""From checks to results and issues: masks, counts by group, collapsed columns, issue numbers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import values as V
from plumbline.operators.bind import OTHER, ROW, SPLITS, Bound, Table
from plumbline.operators.rules import FAMILIES, Check, Context, repeats
from plumbline.plans.model import Spec
from plumbline.plans.registry import BY_ID, ORDER
from plumbline.plans.settings import Resolved, RuleSet, enabled, severity_of
from plumbline.sources.work import numbered

PASS, FAIL, UNCHECKED, WAITING, MASKED = range(5)


def results_columns(groups: list[str]) -> str:
    """The results' columns, the caller's groups after column_name."""
    g = "".join(f"{x} string, " for x in groups)
    return f"run_id string, run_scope string, rule_id string, rule_fingerprint string, stage string, layer int, severity string, table_name string, column_name string, {g}n_checked long, n_fail long, n_not_evaluated long, n_unchecked long, reason_code string, n_distinct_fail_values long, n_easy_fix long, examples string, status string, not_run_reason string, message_id string"


def issues_columns(groups: list[str], key_col: str | None) -> str:
    """The issues' columns, the caller's groups and key column after provider_key_status."""
    g = "".join(f"{x} string, " for x in dict.fromkeys([*groups, *([key_col] if key_col else [])]))
    return (
        "issue_id long, run_id string, run_scope string, rule_id string, rule_fingerprint string, stage string, layer int, severity string, reason_code string, table_name string, column_name string, record_pk string, row_number long, pk_positional boolean, level string, n_records long, value string, expected string, "
        f"entity_key string, visit_keys string, provider_key string, provider_key_status string, {g}reaches_other_unit boolean, root_issue_id long, status string, issue_class string, class_basis string, script_file string, script_block string, attribution_status string, fingerprint string, fingerprint_pk string, first_seen_run string, change string, change_cause string"
    )


CORRECTIONS = "correction_id long, run_id string, issue_id long, related_issue_ids string, table_name string, record_pk string, column_name string, entity_key string, current_value string, proposed_value string, strategy string, tie_break string, tie boolean, reason_code string, support string, support_n long, support_d long, evidence string, fixed_value_passes boolean, easy_fix boolean, easy_fix_blocked_by string"


@dataclass
class Outcome:
    """What a run found. Issues are numbered and stored when they are first asked for."""

    results: DataFrame
    build: Callable[[], DataFrame]
    corrections: DataFrame
    checks: list[Check]
    not_expected: list[str]
    _issues: DataFrame | None = None

    @property
    def issues(self) -> DataFrame:
        if self._issues is None:
            self._issues = self.build()
        return self._issues

    @issues.setter
    def issues(self, issues: DataFrame) -> None:
        self._issues = issues


def gather(ctx: Context, rule_set: RuleSet) -> tuple[list[Check], list[str]]:
    """All checks that are on, numbered in the order of layers, rules and columns."""
    found: dict[str, list[Check]] = {}
    for family in FAMILIES:
        for c in family(ctx):
            found.setdefault(c.rule_id, []).append(c)
    out, missing = [], []
    for rule_id in ORDER:
        if not ctx.wants(rule_id):
            continue
        on = [c for c in found.get(rule_id, []) if enabled(BY_ID[rule_id], c.table, c.column, rule_set)]
        if not on:
            missing.append(rule_id)
        out += on
    for k, c in enumerate(out):
        c.index = k
    return out, missing


def key_text(spec: Spec, t: Table) -> Column:
    """A record's primary key as text; null where a part is null or blank, or the table has no key."""
    parts = [p for p in spec.primary_key(t.name) if t.has(p.name)]
    if not parts:
        return F.lit(None).cast("string")
    texts = [t.text(p, spec) for p in parts]
    return F.when(~V.any_of(*[x.isNull() | t.blank(p) for x, p in zip(texts, parts, strict=True)]), F.concat_ws("|", *texts))


def cells_of(ctx: Context, t: Table, checks: list[Check]) -> DataFrame | None:
    """A row for each cell that a check of the table does not pass.

    One pass: every check is a pair of columns, failure and mask. A cell that
    failed a check of layers 1 to 3 is masked for later layers, but a failure of
    layer 3 in a key column does not mask layer 4; `masked_by` names rules of
    the check's own layer. The mask names the first check that failed.
    """
    if not checks:
        return None
    b, spec = ctx.bound, ctx.spec
    df = t.df
    by_column: dict[str, list[Check]] = {}
    structs = []
    for layer in sorted({c.layer for c in checks}):
        # flags of a layer are columns of their own, so later layers read them and repeat nothing
        raw, effective = {}, {}
        for c in (c for c in checks if c.layer == layer):
            raw[f"__f{c.index}"] = c.fail
        df = df.withColumns(raw)
        for c in (c for c in checks if c.layer == layer):
            a = spec.attribute(c.table, c.column)
            keyed = layer == 4 and a is not None and a.key
            masks = [m for m in by_column.get(c.column, []) if (1 <= m.layer <= 3 and m.layer < layer and not (keyed and m.layer == 3)) or (m.layer == layer and m.rule_id in c.masked_by)]
            root = F.coalesce(*[F.when(F.col(f"__e{m.index}"), F.lit(m.index)) for m in masks]) if masks else F.lit(None).cast("int")
            if any(m.layer == layer for m in masks):
                df = df.withColumns(effective)
                effective = {}
            effective[f"__m{c.index}"] = root
            effective[f"__e{c.index}"] = F.col(f"__f{c.index}") & root.isNull()
            by_column.setdefault(c.column, []).append(c)
        df = df.withColumns(effective)
    null, through = F.lit(None).cast("string"), F.col(OTHER) if OTHER in df.columns else F.lit(False)
    for c in checks:
        a = spec.attribute(c.table, c.column)
        own = t.text(a, spec) if a is not None and t.has(a.name) else null
        expected = F.lit(c.expected) if isinstance(c.expected, str) else null if c.expected is None else c.expected.cast("string")
        mask, failed = F.col(f"__m{c.index}"), F.col(f"__e{c.index}")
        state = F.when(mask.isNotNull(), MASKED).when(failed, FAIL)
        for status, extra in ((UNCHECKED, c.unchecked), (WAITING, c.waiting)):
            if extra is not None:
                state = state.when(V.no(extra), status)
        value = F.when(mask.isNotNull(), own)
        if c.value is not None:
            value = value.when(failed, c.value.cast("string"))
        given = F.when(failed, expected) if c.expected is not None else null
        state = state.otherwise(PASS)
        found = F.struct(F.lit(c.index).alias("check"), state.alias("cell"), value.alias("value"), given.alias("expected"), mask.alias("root"), (through if c.other_unit is None else through | V.no(c.other_unit)).alias("other"))
        structs.append(F.when(state != PASS, found))
    key = [F.col(b.group(b.key_col)).alias("__key_col")] if b.key_col else []
    # the cells are a column before they are exploded: with so many columns Spark would interpret them within the
    # explode; an outer one, or Spark would first filter by the whole expression of that column
    listed = df.select(ROW, key_text(spec, t).alias("__pk"), *b.groups, *key, F.array(*structs).alias("__cells"))
    return listed.withColumn("c", F.explode_outer("__cells")).drop("__cells").select(ROW, "__pk", *b.groups, *[k for k in ["__key_col"] if key], "c").filter("c is not null").select(ROW, "__pk", *b.groups, *[k for k in ["__key_col"] if key], "c.*")


def record_run(ctx: Context, rule_set: RuleSet, run_id: str, run_scope: str, fingerprints: dict[str, str] | None = None) -> Outcome:
    """Results and issues of all checks."""
    b, spec, spark = ctx.bound, ctx.spec, ctx.bound.spark
    least = ctx.settings["column_level_min_n"]
    cap = ctx.settings["example_cap"]
    checks, not_expected = gather(ctx, rule_set)
    by_table: dict[str, list[Check]] = {}
    for c in checks:
        if c.kind == "record":
            by_table.setdefault(c.table, []).append(c)

    parts, sizes, marks = [], {}, {}
    for name, mine in by_table.items():
        t = b.tables[name]
        found = cells_of(ctx, t, mine)
        parts.append(found.withColumn("__table", F.lit(name)))
    for name, t in b.tables.items():
        if any(c.kind in ("record", "not_run") and (c.counted_table or c.table) == name for c in checks):
            sizes[name] = t.base.groupBy(*b.groups).agg(F.count(F.lit(1)).alias("size")).filter("size > 0")
    g = b.groups
    cell_schema = f"{ROW} long, __pk string, {''.join(f'{x} string, ' for x in g)}{'__key_col string, ' if b.key_col else ''}check int, cell int, value string, expected string, root int, other boolean, __table string"
    cells = parts[0] if parts else spark.createDataFrame([], cell_schema)
    for p in parts[1:]:
        cells = cells.unionByName(p)
    cells = b.work.keep(cells)
    del marks

    # -- counts by check and group ---------------------------------------
    counted = cells.groupBy("check", *g).agg(*[F.count_if(F.col("cell") == s).alias(n) for s, n in ((FAIL, "n_fail"), (MASKED, "masked"), (UNCHECKED, "n_unchecked"), (WAITING, "waiting"))])
    values = cells.filter(F.col("cell") == FAIL).groupBy("check", *g, "value").agg(F.min(ROW).alias("first"))
    distinct = values.groupBy("check", *g).agg(F.count(F.lit(1)).alias("n_distinct"))
    ranked = values.filter("value is not null").withColumn("k", F.row_number().over(Window.partitionBy("check", *g).orderBy("first"))).filter(F.col("k") <= cap)
    shown = ranked.groupBy("check", *g).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]), "; ").alias("examples"))

    meta_rows = []
    for c in checks:
        rule = BY_ID[c.rule_id]
        meta_rows.append((c.index, c.rule_id, (fingerprints or {}).get(c.rule_id), rule.layer, severity_of(rule, c.table, c.column, ctx.settings, rule_set), c.table, c.column, c.reason))
    meta = spark.createDataFrame(meta_rows, "check int, rule_id string, rule_fingerprint string, layer int, severity string, table_name string, column_name string, __reason string")
    meta = F.broadcast(meta)  # a row for each rule and column of the specification

    stars = [F.lit("*").alias(x) for x in g]
    rows = []
    for name, size in sizes.items():
        here = [c for c in checks if c.kind == "record" and c.table == name]
        if here:
            grid = size.select(*g, "size", F.explode(F.array(*[F.lit(c.index) for c in here])).alias("check"))
            joined = grid.join(counted, ["check", *g], "left").join(distinct, ["check", *g], "left").join(shown, ["check", *g], "left")
            zero = lambda x: F.coalesce(F.col(x), F.lit(0)).cast("long")
            checked = F.col("size") - zero("masked") - zero("n_unchecked") - zero("waiting")
            rows.append(joined.select("check", *g, checked.alias("n_checked"), zero("n_fail").alias("n_fail"), (zero("masked") + zero("waiting")).alias("n_not_evaluated"), zero("n_unchecked").alias("n_unchecked"), zero("n_distinct").alias("n_distinct"), "examples", F.lit(None).cast("string").alias("__why")))
        idle = [c for c in checks if c.kind == "not_run" and not BY_ID[c.rule_id].unit and (c.counted_table or c.table) == name]
        if idle:
            grid = size.select(*g, F.col("size").alias("n_unchecked"), F.explode(F.array(*[F.lit(c.index) for c in idle])).alias("check"))
            zero = F.lit(0).cast("long")
            rows.append(grid.select("check", *g, zero.alias("n_checked"), zero.alias("n_fail"), zero.alias("n_not_evaluated"), "n_unchecked", zero.alias("n_distinct"), F.lit(None).cast("string").alias("examples"), F.lit("not_run").alias("__why")))
    for c in (c for c in checks if c.kind == "count"):
        zero = F.lit(0).cast("long")
        n = ctx.added["count", c.table, c.column]
        rows.append(n.select(F.lit(c.index).alias("check"), *g, (F.col("size") - F.col("waiting")).alias("n_checked"), F.col("n_fail"), F.col("waiting").alias("n_not_evaluated"), zero.alias("n_unchecked"), zero.alias("n_distinct"), F.lit(None).cast("string").alias("examples"), F.lit(None).cast("string").alias("__why")))
    schema = f"check int, {''.join(f'{x} string, ' for x in g)}n_checked long, n_fail long, n_not_evaluated long, n_unchecked long, n_distinct long, examples string, __why string"
    fixed = []
    for c in checks:
        star = ["*"] * len(g)
        if c.kind == "unit":
            fixed.append((c.index, *star, 1, int(c.failed), 0, None, int(c.failed and any(i["value"] is not None for i in c.issues)), c.examples if c.failed else None, None))
        elif c.kind == "not_run" and BY_ID[c.rule_id].unit:
            fixed.append((c.index, *star, 0, 0, 1, None, 0, None, "not_run"))
        elif c.kind == "not_run" and (c.counted_table or c.table) not in b.tables:
            fixed.append((c.index, *star, 0, 0, 0, 0, 0, None, "not_run"))
    rows.append(spark.createDataFrame(fixed, schema))
    counts = rows[0]
    for r in rows[1:]:
        counts = counts.unionByName(r)
    counts = b.work.keep(counts)
    # a table without rows has no group: one row says so
    listed = {r.check for r in counts.select("check").distinct().collect()}
    empty = [(c.index, *["*"] * len(g), 0, 0, 0, 0, 0, None, "no_records") for c in checks if c.index not in listed]
    if empty:
        counts = counts.unionByName(spark.createDataFrame(empty, schema))
    idle = F.col("__why").isNotNull()
    none = ~idle & (F.col("n_checked") == 0) & (F.col("n_fail") == 0)
    status = F.when(idle, "not_run").when(F.col("n_fail") > 0, "fail").when(none, "not_run").otherwise("pass")
    why = F.when(F.col("__why") == "not_run", F.col("__reason")).when(idle, F.col("__why")).when(none, "none_checked")
    null = F.lit(None).cast("string")
    results = counts.join(meta, "check").select(
        F.lit(run_id).alias("run_id"), F.lit(run_scope).alias("run_scope"), "rule_id", "rule_fingerprint", F.lit("conformance").alias("stage"), "layer", "severity", "table_name", "column_name", *[F.col(x).alias(n) for x, n in zip(g, b.group_cols, strict=True)],
        "n_checked", "n_fail", "n_not_evaluated", "n_unchecked", null.alias("reason_code"), F.col("n_distinct").alias("n_distinct_fail_values"), F.lit(None).cast("long").alias("n_easy_fix"), "examples", status.alias("status"), why.alias("not_run_reason"), F.col("rule_id").alias("message_id"),
    )

    corrections = spark.createDataFrame([], CORRECTIONS)
    return Outcome(results, lambda: _issues(ctx, checks, cells, counts, meta, least, run_id, run_scope), corrections, checks, not_expected)


def _issues(ctx: Context, checks: list[Check], cells: DataFrame, counts: DataFrame, meta: DataFrame, least: int, run_id: str, run_scope: str) -> DataFrame:
    b, spec, spark, g = ctx.bound, ctx.spec, ctx.bound.spark, ctx.bound.groups
    fixed_expected = {c.index: c.expected for c in checks if isinstance(c.expected, str)}
    record_checks = [c.index for c in checks if c.kind == "record"]
    whole = counts.filter((F.col("n_fail") > 0) & (F.col("n_fail") == F.col("n_checked")) & (F.col("n_checked") >= least) & F.col("check").isin(record_checks)).select("check", *g, F.lit(True).alias("__whole"))
    whole = b.work.keep(whole)
    fails = cells.filter(F.col("cell") == FAIL).join(whole, ["check", *g], "left")
    masked = cells.filter(F.col("cell") == MASKED).join(whole.select(F.col("check").alias("root"), *g, F.col("__whole").alias("__root_whole")), ["root", *g], "left")
    null = F.lit(None).cast("string")
    given = F.coalesce(*[F.when(F.col("check") == k, F.lit(v)) for k, v in fixed_expected.items()], null) if fixed_expected else null
    key = F.col("__key_col") if b.key_col else F.lit("*")

    def shape(df, kind, level, pk, n, value, expected, other, root, status, row, key):
        return df.select("check", F.lit(kind).alias("__kind"), *g, pk.alias("__pk"), row.alias(ROW), F.lit(level).alias("level"), n.alias("n_records"), value.alias("value"), expected.alias("expected"), other.alias("other"), root.alias("root"), F.lit(status).alias("status"), key.alias("__key"))

    no_int, no_row, star = F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit("*")
    together = fails.filter("__whole").groupBy("check", *g).agg(F.count(F.lit(1)).alias("n"), F.max("other").alias("other"))
    pieces = [
        shape(together, 0, "column", star, F.col("n"), null, given, F.col("other"), no_int, "open", no_row, star),
        shape(fails.filter("__whole is null"), 1, "record", F.col("__pk"), no_row, F.col("value"), F.col("expected"), F.col("other"), no_int, "open", F.col(ROW), key),
    ]
    shared = masked.filter("__root_whole").groupBy("check", "root", *g).agg(F.count(F.lit(1)).alias("n"), F.max("other").alias("other"))
    shared = b.work.keep(shared)
    big = shared.filter(F.col("n") >= least)
    pieces.append(shape(big, 2, "column", star, F.col("n"), null, null, F.col("other"), F.col("root"), "not_evaluated", no_row, star))
    small = masked.join(big.select("check", "root", *g, F.lit(True).alias("__big")), ["check", "root", *g], "left").filter("__big is null")
    pieces.append(shape(small, 3, "record", F.col("__pk"), no_row, F.col("value"), null, F.col("other"), F.col("root"), "not_evaluated", F.col(ROW), key))
    units = []
    for c in checks:
        for i in c.issues:
            unit = i["unit"]
            units.append((c.index, 0, *([unit if unit is not None else "*", *["*"] * (len(g) - 1)] if g else []), "*", None, "column", i["n_records"], i["value"], i["expected"], unit == "*" if unit is not None else False, None, "open", "*"))
    unit_schema = f"check int, __kind int, {''.join(f'{x} string, ' for x in g)}__pk string, {ROW} long, level string, n_records long, value string, expected string, other boolean, root int, status string, __key string"
    everything = spark.createDataFrame(units, unit_schema)
    for p in pieces:
        everything = everything.unionByName(p)
    ids = b.work.keep(numbered(b.work, everything, ["check", "__kind", *g, "root", ROW, "value"], "issue_id"))

    # the issue that masks a cell: of the same row, or the group's column-level one
    open_ = ids.filter(F.col("status") == "open")
    by_row = open_.filter("level = 'record'").select(F.col("check").alias("root"), F.col(ROW), F.col("issue_id").alias("__root_row"))
    by_group = open_.filter("level = 'column'").select(F.col("check").alias("root"), *g, F.col("issue_id").alias("__root_group"))
    rooted = ids.join(by_row, ["root", ROW], "left").join(by_group, ["root", *g], "left")

    # which keys are held by more than one row, for the tables that have record issues
    tables = [t for t in b.tables.values() if spec.primary_key(t.name) and any(c.kind == "record" and c.table == t.name for c in checks)]
    rooted = rooted.join(meta, "check")
    many = None
    for t in tables:
        one = t.base.select(key_text(spec, t).alias("__many")).filter("__many is not null").groupBy("__many").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit(t.name).alias("__many_table"), "__many")
        many = one if many is None else many.unionByName(one)
    positional = F.lit(None).cast("boolean")
    if many is not None:
        rooted = rooted.join(b.work.keep(many), (F.col("table_name") == F.col("__many_table")) & (F.col("__pk") == F.col("__many")), "left")
        positional = F.when(F.col("level") == "record", F.col("__pk").isNull() | F.col("__many").isNotNull())
    else:
        positional = F.when(F.col("level") == "record", F.col("__pk").isNull())

    # row numbers from 1 in delivered order, from the sizes of the tables' splits, whose rows are numbered without gaps
    within = F.col(ROW).bitwiseAND(F.lit((1 << 33) - 1))
    splits = None
    for name in sorted({c.table for c in checks if c.kind == "record"}):
        one = b.tables[name].base.groupBy(F.shiftright(ROW, 33).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min(within).alias("least")).select(F.lit(name).alias("t"), "p", "n", "least")
        splits = one if splits is None else splits.unionByName(one)
    numbers, at = [], {}
    for r in sorted(splits.collect() if splits is not None else [], key=lambda r: (r.t, r.p)):
        numbers.append((r.t, r.p, at.get(r.t, 0) - r.least))
        at[r.t] = at.get(r.t, 0) + r.n
    offsets = spark.createDataFrame(numbers, "__n_table string, __n_part long, __n_first long")  # a row for each split of the tables
    offsets = F.broadcast(offsets) if len(numbers) <= SPLITS else offsets
    rooted = rooted.join(offsets, (F.col("table_name") == F.col("__n_table")) & (F.shiftright(ROW, 33) == F.col("__n_part")), "left")
    number = F.col("__n_first") + within + 1
    groups = [F.col(x).alias(n) for x, n in zip(g, b.group_cols, strict=True)]
    more = [F.col("__key").alias(b.key_col)] if b.key_col and b.key_col not in b.group_cols else []
    none = F.lit(None).cast("string")
    pk_print = F.concat_ws("|", "rule_id", "table_name", "column_name", F.concat(F.lit("pk:"), F.col("__shown_pk")))
    out = rooted.withColumn("__shown_pk", F.when(F.col("level") == "record", F.col("__pk")).otherwise("*"))
    return out.select(
        "issue_id", F.lit(run_id).alias("run_id"), F.lit(run_scope).alias("run_scope"), "rule_id", "rule_fingerprint", F.lit("conformance").alias("stage"), "layer", "severity", none.alias("reason_code"), "table_name", "column_name", F.col("__shown_pk").alias("record_pk"), number.alias("row_number"),
        positional.alias("pk_positional"), "level", "n_records", "value", "expected", none.alias("entity_key"), none.alias("visit_keys"), none.alias("provider_key"), none.alias("provider_key_status"), *groups, *more, F.coalesce("other", F.lit(False)).alias("reaches_other_unit"),
        F.coalesce("__root_row", "__root_group").alias("root_issue_id"), "status", none.alias("issue_class"), none.alias("class_basis"), none.alias("script_file"), none.alias("script_block"), none.alias("attribution_status"), pk_print.alias("fingerprint"), pk_print.alias("fingerprint_pk"), none.alias("first_seen_run"), none.alias("change"), none.alias("change_cause"),
    )


def adds_up(results: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Record rules whose counts do not add up to their table's rows; empty if all is well."""
    unit = [r for r, x in BY_ID.items() if x.unit]
    total = results.filter(~F.col("rule_id").isin(*unit, "parent_without_children")).groupBy("rule_id", "table_name", "column_name").agg(F.sum(F.col("n_checked") + F.col("n_not_evaluated") + F.col("n_unchecked")).alias("total"))
    wanted = F.coalesce(*[F.when(F.col("table_name") == t, F.lit(n)) for t, n in sizes.items()], F.lit(0))
    return total.filter(F.col("total") != wanted)


__all__ = ["Bound", "Outcome", "Resolved", "adds_up", "cells_of", "record_run", "repeats"]
