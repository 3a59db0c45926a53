"""Issue classes: defaults, ranked overrides, reason codes, evidence, fallbacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.registry import RULES
from plumbline.plans.settings import RuleSet, rule_row_value

SCOPE = ("fingerprint", "rule_id", "table_name", "column_name")
#: Rules that judge a value against its code list.
CODE_RULES = ("code_not_in_list",)


def tier(given: set[str], groups: set[str]) -> int:
    """1 (strongest) to 9 by the cells that an override gives; a table makes it stronger by half a tier."""
    rule, column, group = "rule_id" in given, "column_name" in given, bool(given & groups)
    order = [(True, True, True), (True, True, False), (True, False, True), (True, False, False), (False, True, True), (False, True, False), (False, False, True), (False, False, False)]
    return 1 if "fingerprint" in given else 2 + order.index((rule, column, group))


def rank(given: set[str], groups: set[str]) -> int:
    return 2 * tier(given, groups) - ("table_name" in given)


def override_classes(spark: SparkSession, issues: DataFrame, overrides: list[dict], group_cols: list[str]) -> DataFrame:
    """(issue_id, override_class, override_basis) for issues that an override matches.

    One equi-join for each set of given cells; the strongest rank that matches
    an issue decides, and both classes at that rank are a conflict.
    """
    scope = [*SCOPE, *group_cols]
    patterns: dict[frozenset, list[dict]] = {}
    for r in overrides:
        patterns.setdefault(frozenset(c for c in scope if r.get(c)), []).append(r)
    parts = []
    for given, rows in patterns.items():
        columns = [c for c in scope if c in given]
        strength = rank(set(given), set(group_cols))
        schema = "".join(f"__{c} string, " for c in columns) + "__class string"
        data = spark.createDataFrame(list({tuple([*[r[c] for c in columns], r["issue_class"]]) for r in rows}), schema)
        for side in ("fingerprint", "fingerprint_pk") if "fingerprint" in given else ("fingerprint",):
            on = [F.col(side if c == "fingerprint" else c) == F.col(f"__{c}") for c in columns]
            joined = issues.join(data, reduce(lambda x, y: x & y, on)) if on else issues.select("issue_id").withColumn("__class", F.explode(F.array(*[F.lit(r["issue_class"]) for r in rows])))
            parts.append(joined.select("issue_id", F.lit(strength).alias("__rank"), "__class"))
    if not parts:
        return spark.createDataFrame([], "issue_id long, override_class string, override_basis string")
    found = reduce(DataFrame.unionByName, parts)
    by_rank = found.groupBy("issue_id", "__rank").agg(F.min("__class").alias("lo"), F.max("__class").alias("hi"))
    best = by_rank.groupBy("issue_id").agg(F.min(F.struct("__rank", "lo", "hi")).alias("b"))
    both = F.col("b.lo") != F.col("b.hi")
    return best.select("issue_id", F.when(both, "unclassified").otherwise(F.col("b.lo")).alias("override_class"), F.when(both, "override conflict").otherwise("override").alias("override_basis"))


def evidence_basis(issues: DataFrame, evidence: dict[str, DataFrame], group_col: str | None) -> DataFrame:
    """(issue_id, evidence): the first of computed, filled, lineage, crosswalk that settles an issue.

    computed: table_name, column_name, group value or `*`. filled: the value
    that the pipeline wrote in the cell. lineage with crosswalk: a code that was
    already bad in its raw form, or one that the translation made bad.
    """
    null = F.lit(None).cast("boolean")
    out = issues
    group = F.col(group_col) if group_col else F.lit("*")
    if "computed" in evidence:
        c = evidence["computed"].select(F.col("table_name").alias("__t"), F.col("column_name").alias("__c"), F.col(group_col or "table_name").alias("__g")).distinct()
        every = c.filter("__g = '*'").select("__t", "__c", F.lit(True).alias("__all")).distinct()
        some = c.filter("__g <> '*'").select(F.col("__t").alias("__t2"), F.col("__c").alias("__c2"), F.col("__g").alias("__g2"), F.lit(True).alias("__one"))
        out = out.join(every, (F.col("table_name") == F.col("__t")) & (F.col("column_name") == F.col("__c")), "left").join(some, (F.col("table_name") == F.col("__t2")) & (F.col("column_name") == F.col("__c2")) & (group == F.col("__g2")), "left")
        computed = F.coalesce("__all", "__one")
    else:
        computed = null
    if "filled" in evidence:
        f = evidence["filled"].select(F.col("table_name").alias("__ft"), F.col("record_pk").alias("__fp"), F.col("column_name").alias("__fc"), F.col("written_value").alias("__fv"), F.lit(True).alias("__filled")).distinct()
        out = out.join(f, (F.col("level") == "record") & (F.col("table_name") == F.col("__ft")) & (F.col("record_pk") == F.col("__fp")) & (F.col("column_name") == F.col("__fc")) & (F.col("value") == F.col("__fv")), "left")
        filled = F.col("__filled")
    else:
        filled = null
    lineage = crosswalk = F.lit(False)
    if "lineage" in evidence and "crosswalk" in evidence and group_col:
        raw = evidence["lineage"].groupBy(F.col("table_name").alias("__lt"), F.col("record_pk").alias("__lp"), F.col("column_name").alias("__lc")).agg(F.min("raw_value").alias("__raw"), F.lit(True).alias("__listed"))
        x = evidence["crosswalk"]
        covering = x.select(F.col("column_name").alias("__xc"), F.col(group_col).alias("__xg"), F.lit(True).alias("__covered")).distinct()
        codes = x.select(F.col("column_name").alias("__yc"), F.col(group_col).alias("__yg"), F.col("provider_code").alias("__yv"), F.lit(True).alias("__valid")).distinct()
        out = out.join(raw, (F.col("table_name") == F.col("__lt")) & (F.col("record_pk") == F.col("__lp")) & (F.col("column_name") == F.col("__lc")), "left")
        out = out.withColumn("__raw_value", F.when(F.col("__listed"), F.col("__raw")).otherwise(F.col("value")))
        out = out.join(covering, (F.col("column_name") == F.col("__xc")) & (group == F.col("__xg")), "left").join(codes, (F.col("column_name") == F.col("__yc")) & (group == F.col("__yg")) & (F.col("__raw_value") == F.col("__yv")), "left")
        judged = F.col("rule_id").isin(*CODE_RULES) & (F.col("level") == "record") & F.coalesce("__covered", F.lit(False))
        changed = F.coalesce(F.col("__listed"), F.lit(False)) & ~F.coalesce(F.col("__raw") == F.col("value"), F.lit(False))
        lineage = judged & F.coalesce("__valid", F.lit(False))
        crosswalk = judged & F.col("__valid").isNull() & changed
    basis = F.when(F.coalesce(computed, F.lit(False)), "computed").when(F.coalesce(filled, F.lit(False)), "filled").when(lineage, "lineage").when(crosswalk, "crosswalk")
    return out.select("issue_id", basis.alias("evidence")).filter("evidence is not null").dropDuplicates(["issue_id"])


def default_class(rule_set: RuleSet, columns: list[tuple[str, str, str]]) -> Column:
    """A rule's class: that of its most specific row of the rule set, else the registry's."""
    out = F.lit("none")
    for r in RULES:
        out = F.when(F.col("rule_id") == r.rule_id, F.lit(r.issue_class)).otherwise(out)
    for rule_id, t, c in columns:
        own = rule_row_value(rule_set, rule_id, t, c, "class")
        if own:
            out = F.when((F.col("rule_id") == rule_id) & (F.col("table_name") == t) & (F.col("column_name") == c), F.lit(own)).otherwise(out)
    return out


def classify(spark: SparkSession, issues: DataFrame, rule_set: RuleSet | None = None, overrides: list[dict] | None = None, evidence: dict[str, DataFrame] | None = None, fallback: dict[str, str] | None = None, group_cols: list[str] | None = None, columns: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Issues with issue_class and class_basis.

    An override is stronger than a class that the rule declares; a rule whose
    class depends is settled by evidence (pipeline steps are harmonization, a
    code bad in its raw form is source... see evidence_basis), then by the
    fallback class, and is unclassified otherwise.
    """
    groups = list(group_cols or [])
    over = override_classes(spark, issues, overrides or [], groups)
    found = evidence_basis(issues, evidence or {}, groups[0] if groups else None) if evidence else spark.createDataFrame([], "issue_id long, evidence string")
    base = default_class(rule_set or RuleSet(), columns or [])
    fallback_class = F.lit(None).cast("string")
    for rule_id, c in (fallback or {}).items():
        fallback_class = F.when(F.col("rule_id") == rule_id, F.lit(c)).otherwise(fallback_class)
    joined = issues.drop("issue_class", "class_basis").join(over, "issue_id", "left").join(found, "issue_id", "left")
    depends = base == "depends"
    artifact = F.coalesce(F.col("reason_code") == "harmonization_artifact", F.lit(False))
    settled = F.when(artifact | (depends & F.col("evidence").isNotNull()), "harmonization")
    issue_class = F.coalesce("override_class", settled, F.when(~depends, base), fallback_class, F.lit("unclassified"))
    basis = F.coalesce("override_basis", F.when(artifact, "reason code"), F.when(~depends, F.lit("default")), "evidence", F.when(fallback_class.isNotNull(), F.lit("fallback")), F.lit("default"))
    return joined.withColumns({"issue_class": issue_class, "class_basis": basis}).select(*issues.columns)
