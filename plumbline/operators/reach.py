"""Records that no walk over the key links reaches from a root table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import bind as B
from plumbline.operators.bind import ROW, Bound
from plumbline.operators.rules import Check, Context, each, not_run, record
from plumbline.plans.model import Edge


def holding(b: Bound, table: str, name: str, other) -> DataFrame:
    """The table's rows that hold a key; all of them if the key column was not given."""
    t = b.tables[table]
    rows = t.base if not t.has(name) else t.base.filter(B.join_key(b.spec, t, b.spec.attribute(table, name), other).isNotNull())
    return rows.select(ROW)


def sides(b: Bound, e: Edge, how: str) -> tuple[tuple, tuple]:
    """A link's near and far side: table, key column, the other side's attribute."""
    child = (e.table, e.attribute, b.spec.attribute(e.parent, e.parent_key))
    parent = (e.parent, e.parent_key, b.spec.attribute(e.table, e.attribute))
    return (parent, child) if how == "from_parent" else (child, parent)


def walk(b: Bound, links: list[tuple[Edge, str]], start: dict[str, DataFrame], loose: list[tuple[Edge, str]] = ()) -> dict[str, DataFrame]:
    """Rows reached from `start` (rows by table): passes over the links until one reaches nothing new.

    Links are semi-joins on key text. Each table's reached rows are written
    after a link added to them, and a link is passed again only when its near
    side has grown. Where links form a cycle a pass goes one level deeper in the
    data, so there may be as many passes as levels. A loose link lacks a key
    column: once a reached row on its near side holds a key, every row on its far
    side that holds one is reached.
    """
    spec, reached = b.spec, dict(start)
    sizes = {t: df.count() for t, df in reached.items()}
    seen: dict[int, int] = {}
    waiting = list(loose)
    grown = True

    def add(far: str, new: DataFrame) -> bool:
        kept = b.work.keep(new.union(reached[far]).distinct() if far in reached else new)
        n = kept.count()
        if n <= sizes.get(far, 0):
            return False
        reached[far], sizes[far] = kept, n
        return True

    while grown:  # reached rows only grow, so it ends
        grown = False
        for k, (e, how) in enumerate(links):
            near, far = (e.parent, e.table) if how == "from_parent" else (e.table, e.parent)
            if near not in reached or seen.get(k) == sizes[near]:
                continue
            seen[k] = sizes[near]
            child, parent = b.tables[e.table], b.tables[e.parent]
            fk, pk = spec.attribute(e.table, e.attribute), spec.attribute(e.parent, e.parent_key)
            child_key, parent_key = B.join_key(spec, child, fk, pk), B.join_key(spec, parent, pk, fk)
            (nt, nk), (ft, fk_) = ((parent, parent_key), (child, child_key)) if how == "from_parent" else ((child, child_key), (parent, parent_key))
            near_keys = nt.base.select(ROW, nk.alias("__key")).join(reached[near], ROW, "left_semi").select("__key").filter("__key is not null").distinct()
            new = ft.base.select(ROW, fk_.alias("__key")).join(near_keys, "__key", "left_semi").select(ROW)
            grown |= add(far, new)
        for e, how in list(waiting):
            near, far = sides(b, e, how)
            if near[0] in reached and not holding(b, *near).join(reached[near[0]], ROW, "left_semi").isEmpty():
                waiting.remove((e, how))
                grown |= add(far[0], holding(b, *far))
    return reached


def unreachable(ctx: Context) -> list[Check]:
    """A check for each walked table: rows that the walk leaves out, at their topmost.

    Where a table or key column of a link was not given, a second walk takes the
    table as a root and follows the link without its column (see walk()); rows
    that only it reaches are not checked.
    """
    b, spec = ctx.bound, ctx.spec
    if spec.reach is None:
        return [not_run("record_unreachable", "*", "*", "no_input")]
    rows = spec.reach
    roots = [r["table_name"] for r in rows if r["how"] == "root"]
    exempt = {r["table_name"] for r in rows if r["how"] == "exempt"}
    above = {r["table_name"] for r in rows if r["how"] == "from_parent"}
    declared = [(e, r["how"]) for r in rows if r["how"] in ("from_parent", "from_child") and (e := spec.edge(r["table_name"], r["attribute_name"]))]
    followed = [(e, how) for e, how in declared if e.table not in exempt and e.parent not in exempt]
    usable = [(e, how) for e, how in followed if B.followed(b, [e])]
    walked = [t for t in spec.tables() if t not in exempt and (t in {r["table_name"] for r in rows} or t in {e.parent for e, how in declared if how == "from_child"})]
    firsts = [spec.primary_key(t)[0] for t in walked if spec.primary_key(t)]
    if not all(t in b.tables for t in roots):
        return [not_run("record_unreachable", a.table, a.name, "no_table") for a in firsts]
    start = {t: b.tables[t].base.select(ROW) for t in roots}
    reached = walk(b, usable, start)
    more, loose = dict(start), []
    for e, how in followed:
        (near, *_), far = sides(b, e, how)
        if (e, how) in usable or far[0] not in b.tables:
            continue
        if near in b.tables:
            loose.append((e, how))
        else:
            could = holding(b, *far)
            more[far[0]] = more[far[0]].union(could).distinct() if far[0] in more else could
    possible = walk(b, usable, more, loose) if len(usable) < len(followed) else None

    def evaluate(t, a):
        none = b.spark.createDataFrame([], f"{ROW} long")
        got = reached.get(t.name, none).select(F.col(ROW).alias("__r"), F.lit(True).alias("__reached"))
        t.df = t.df.join(got, F.col(ROW) == F.col("__r"), "left").drop("__r")
        left = F.col("__reached").isNull()
        if t.name in above:
            return record("record_unreachable", a, F.lit(False), t.text(a, spec), unchecked=left, masked_by=("pk_missing",))
        if possible is None:
            return record("record_unreachable", a, left, t.text(a, spec), masked_by=("pk_missing",))
        maybe = possible.get(t.name, none).select(F.col(ROW).alias("__r"), F.lit(True).alias("__possible"))
        t.df = t.df.join(maybe, F.col(ROW) == F.col("__r"), "left").drop("__r")
        return record("record_unreachable", a, left & F.col("__possible").isNull(), t.text(a, spec), unchecked=left & F.col("__possible").isNotNull(), masked_by=("pk_missing",))

    return each(ctx, "record_unreachable", firsts, evaluate)
