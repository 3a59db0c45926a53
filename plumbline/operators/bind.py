"""Delivered tables bound to the specification: columns, row identity, keys, groups."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import values as V
from plumbline.plans.model import Attribute, Edge, Spec, match_columns
from plumbline.sources.work import Work

ROW = "__row"
#: Whether a row's group was read through a record of another report unit.
OTHER = "__reaches_other"
#: Most splits of a table's files whose places are broadcast; their number is known where this is asked.
SPLITS = 50_000


@dataclass
class Table:
    """A delivered table. base has the row identity, the matched columns, named as their attributes, and the groups.

    df is base with the columns that rules across rows add; other tables read base.
    Many rules read a cell's text and whether it is blank, so what is costly of
    these is stored with the table: `told` names the attributes that have it.
    """

    name: str
    df: DataFrame
    columns: dict[str, tuple[str, bool]]
    types: dict[str, str]
    extra: list[str]
    text_input: bool = False
    base: DataFrame | None = None
    told: frozenset[str] = frozenset()
    memo: dict = field(default_factory=dict)  # expressions built once a column: building them is most of a small run's time

    def has(self, attribute: str) -> bool:
        return attribute in self.types

    def text(self, a: Attribute, spec: Spec) -> Column:
        if a.name in self.told and not V.is_text(self.types[a.name]):
            return F.col(f"__t_{a.name}")
        return self.once(("text", a.name), lambda: V.value_text(F.col(a.name), self.types[a.name], spec.type_of(a).date_format))

    def blank(self, a: Attribute) -> Column:
        """The cell's text is blank; false where it is null."""
        if not V.is_text(self.types[a.name]):
            return F.lit(False)
        return F.col(f"__b_{a.name}") if a.name in self.told else V.no(V.is_blank(F.col(a.name)))

    def number(self, a: Attribute, whole: bool = False) -> V.Number:
        return self.once(("number", a.name, whole), lambda: V.read_number(F.col(a.name), self.types[a.name], whole))

    def once(self, key: tuple, build):
        if key not in self.memo:
            self.memo[key] = build()
        return self.memo[key]


@dataclass
class Bound:
    spark: SparkSession
    spec: Spec
    tables: dict[str, Table]
    work: Work
    group_cols: list[str] = field(default_factory=list)
    key_col: str | None = None

    def group(self, name: str) -> str:
        return f"__g_{name}"

    @property
    def groups(self) -> list[str]:
        return [self.group(g) for g in self.group_cols]


def check_tables(tables: dict[str, DataFrame]) -> None:
    """Refuse repeated columns and nested ones: a cell is one value."""
    for name, df in tables.items():
        repeated = {c for c in df.columns if df.columns.count(c) > 1}
        if repeated:
            raise ValueError(f"table {name}: columns named twice: {', '.join(sorted(repeated))}")
        nested = [c for c, t in df.dtypes if t.startswith(("array", "map", "struct", "binary"))]
        if nested:
            raise ValueError(f"table {name}: columns that hold more than one value a row: {', '.join(nested)}")


def bind(spark: SparkSession, spec: Spec, tables: dict[str, DataFrame], text_tables: set[str] | None = None, group_cols: list[str] | None = None, key_col: str | None = None) -> Bound:
    """Match columns to attributes, number rows, and find each row's groups.

    Each table is stored once with its row identity, so no later read, however
    it is dealt to tasks, numbers rows anew.
    """
    check_tables(tables)
    out, work = {}, Work(spark)
    for name in [*[t for t in spec.tables() if t in tables], *[t for t in tables if t not in spec.tables()]]:
        df = tables[name]
        matched = match_columns(df.columns, [a.name for a in spec.of(name)])
        taken = {c for c, _ in matched.values()}
        kinds = dict(df.dtypes)
        bound = identified(df, [F.col(f"`{c}`").alias(a) for a, (c, _) in matched.items()])
        out[name] = t = Table(name, bound, matched, {a: kinds[c] for a, (c, _) in matched.items()}, [c for c in df.columns if c not in taken], name in (text_tables or set()))
        given = [a for a in spec.of(name) if t.has(a.name)]
        told = {f"__b_{a.name}": t.blank(a) for a in given if V.is_text(t.types[a.name])} | {f"__t_{a.name}": t.text(a, spec) for a in given if not V.is_text(t.types[a.name]) and t.types[a.name] not in V.WHOLE}
        t.df = work.keep(bound.withColumns(told))
        t.told = frozenset(n[4:] for n in told)
        t.memo.clear()
    b = Bound(spark, spec, out, work, list(group_cols or []), key_col)
    homes = {a.name for a in spec.attributes}
    unknown = [g for g in [*b.group_cols, *([key_col] if key_col else [])] if g not in homes]
    if unknown:
        raise ValueError(f"no attribute is named {', '.join(unknown)}")
    wanted = list(dict.fromkeys([*b.group_cols, *([key_col] if key_col else [])]))
    # the report unit first: the other groups' routes tell whether they pass through a record of another unit
    for some in (wanted[:1], wanted[1:]):
        frames = {n: t.df for n, t in out.items()}  # routes read tables as they were before this round
        for t in out.values():
            for g in some:
                t.df = add_group(b, frames, t, g)
            if any(spec.routes(t.name, g) for g in some):
                t.df = b.work.keep(t.df)  # the routes are walked once, not in every pass over the table
    for t in out.values():
        t.base = t.df
    return b


def identified(df: DataFrame, columns: list[Column]) -> DataFrame:
    """The columns with a row identity that follows the delivered order.

    A table read from files has the order of its files by path and of the rows
    within; Spark reads the splits of files by size and gathers them in tasks,
    so each split gets its place among all (a row for each split is listed). Any
    other table has the order of its partitions.
    """
    at = F.monotonically_increasing_id()
    try:
        split = df.select(F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__start")) if "_metadata" not in df.columns else None
    except AnalysisException:  # not read from files
        split = None
    places = sorted((r["__path"], r["__start"]) for r in split.distinct().collect()) if split is not None else []
    if len(places) < 2:
        return df.select(at.alias(ROW), *columns)
    listed = df.sparkSession.createDataFrame([(p, s, k) for k, (p, s) in enumerate(places)], "__p string, __s long, __place long")
    listed = F.broadcast(listed) if len(places) <= SPLITS else listed
    read = df.select(F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__start"), at.alias("__at"), *columns)
    joined = read.join(listed, (F.col("__path") == F.col("__p")) & (F.col("__start") == F.col("__s")))
    row = F.shiftleft("__place", 33) + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.withColumn(ROW, row).select(ROW, *[c for c in read.columns if c not in ("__path", "__start", "__at")])


def key_codes(spec: Spec, *attributes: Attribute) -> list[str]:
    return list(dict.fromkeys(s.value for a in attributes for s in spec.own_codes(a)))


def join_key(spec: Spec, t: Table, a: Attribute, *also: Attribute) -> Column:
    """A key as joins compare it: its text, null where it names nothing (null, NaN, blank, a missing-value code of either side)."""
    text = t.text(a, spec)
    codes = key_codes(spec, a, *also)
    dead = t.blank(a) | V.no(text.isin(["NaN"]) if V.is_number(t.types[a.name]) else F.lit(False))
    if codes:
        dead = dead | V.no(text.isin(codes)) | V.holds(F.col(a.name), t.types[a.name], codes)
    return F.when(~dead, text)


def followed(b: Bound, path: list[Edge]) -> bool:
    """All tables and key columns of a route are given."""
    return all(e.table in b.tables and e.parent in b.tables and b.tables[e.table].has(e.attribute) and b.tables[e.parent].has(e.parent_key) for e in path)


def lookup(b: Bound, frames: dict[str, DataFrame], path: list[Edge], fields) -> DataFrame:
    """A row for each key of the path's first parent: __k, its first holder's fields at the path's end, __state.

    Parents are cut to their first holder of a key before they are joined, so a
    repeated parent key never multiplies rows.
    """
    e, spec = path[0], b.spec
    parent = b.tables[e.parent]
    pk, fk = spec.attribute(e.parent, e.parent_key), spec.attribute(e.table, e.attribute)
    df = frames[e.parent].withColumn("__k", join_key(spec, parent, pk, fk))
    if len(path) == 1:
        named = fields(parent)
        df = df.select("__k", ROW, *[c.alias(n) for n, c in named.items()], F.lit("reached").alias("__state"))
    else:
        named = fields(b.tables[path[-1].parent])
        df = follow(b, frames, df, path[1:], fields).select("__k", ROW, *named, "__state")
    first = F.min(F.struct(ROW, *named, "__state")).alias("__first")
    return df.filter("__k is not null").groupBy("__k").agg(first).select("__k", *[F.col(f"__first.{n}").alias(n) for n in named], F.col("__first.__state").alias("__state"), F.col(f"__first.{ROW}").alias("__parent_row"))


def follow(b: Bound, frames: dict[str, DataFrame], df: DataFrame, path: list[Edge], fields) -> DataFrame:
    """df (rows of the path's first table) with the fields at the path's end and __state: reached, masked or orphan."""
    e, spec = path[0], b.spec
    child = b.tables[e.table]
    mine = join_key(spec, child, spec.attribute(e.table, e.attribute), spec.attribute(e.parent, e.parent_key))
    found = lookup(b, frames, path, fields).withColumnRenamed("__state", "__their_state").withColumnRenamed("__k", "__their_key").drop("__parent_row")
    joined = df.withColumn("__my_key", mine).join(found, F.col("__my_key") == F.col("__their_key"), "left")
    state = F.when(F.col("__my_key").isNull(), "masked").when(F.col("__their_key").isNull(), "orphan").otherwise(F.col("__their_state"))
    return joined.withColumn("__state", state).drop("__my_key", "__their_key", "__their_state")


def usable(spec: Spec, t: Table, a: Attribute) -> Column:
    """A group's value, or null where the cell gives none (null, blank, a missing-value code, `*`)."""
    text = t.text(a, spec)
    codes = [*key_codes(spec, a), "*"]
    return F.when(~(t.blank(a) | V.no(text.isin(codes)) | V.holds(F.col(a.name), t.types[a.name], codes)), text)


def add_group(b: Bound, frames: dict[str, DataFrame], t: Table, name: str) -> DataFrame:
    """t.df with __g_<name>: the row's own value, else the first route's that has one, else `*`.

    A route that breaks at a masked key, or ends at no value, passes on to the
    next; one that names a parent which does not exist ends the search. Of other
    groups than the report unit's, OTHER tells whether the value was read in a
    record whose report unit is another than the row's, or `*`.
    """
    spec, target = b.spec, b.group(name)
    own = spec.attribute(t.name, name)
    df = t.df
    value = usable(spec, t, own) if own and t.has(name) else F.lit(None).cast("string")
    chosen, closed, drop, other = value, F.lit(False), [], F.lit(False)
    unit = b.groups[0] if b.groups and name != b.group_cols[0] else None
    routes = spec.routes(t.name, name)
    for k, path in enumerate(r for r in routes if followed(b, r) and b.tables[r[-1].parent].has(name)):
        fields = lambda end: {f"__v{k}": usable(spec, end, spec.attribute(end.name, name)), **({f"__u{k}": F.col(unit)} if unit else {})}  # noqa: B023, E731
        df = follow(b, frames, df, path, fields).withColumnRenamed("__state", f"__s{k}")
        if unit:
            theirs = F.col(f"__u{k}")
            other = other | V.no(chosen.isNull() & ~closed & F.col(f"__v{k}").isNotNull() & ((theirs == "*") | (theirs != F.col(unit))))
            drop.append(f"__u{k}")
        chosen = F.coalesce(chosen, F.when(~closed, F.col(f"__v{k}")))
        closed = closed | (F.col(f"__s{k}") == "orphan")
        drop += [f"__v{k}", f"__s{k}"]
    if unit:
        other = (F.col(OTHER) | other) if OTHER in t.df.columns else other
        df = df.withColumn(OTHER, other)
    return df.withColumn(target, F.coalesce(chosen, F.lit("*"))).drop(*drop)


def read_chain(b: Bound, df: DataFrame, table: str, text: str, out: str) -> tuple[DataFrame, str] | None:
    """df (rows of table) with the value at a chain's end as `out`, and its stored type; None where it cannot be followed."""
    parsed = b.spec.chain(table, text)
    if parsed is None or table not in b.tables:
        return None
    steps, home, name = parsed
    if home not in b.tables or not b.tables[home].has(name) or not followed(b, steps):
        return None
    kind = b.tables[home].types[name]
    if not steps:
        return df.withColumn(out, F.col(name)), kind
    frames = {n: t.base for n, t in b.tables.items()}
    unit = [b.groups[0]] if b.groups else []
    joined = follow(b, frames, df, steps, lambda end: {out: F.col(name), **{f"{out}__unit": F.col(u) for u in unit}})
    return joined.drop("__state"), kind
