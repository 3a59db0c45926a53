"""Mix sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common
from plumbline.llm.prefix import prefix_sums

#: A word is a run of other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def water_fill(scratch: common.Scratch, sources: DataFrame, total: float, epochs: float) -> DataFrame:
    """sources (source, size, weight) with target and rank.

    Targets are in proportion to the weights, add up to `total`, and none is
    above epochs x its size: sources whose part is above that cap are clamped to
    it, the rest is shared among the others by weight, and so on until none is
    above. Sources are clamped in order of cap over weight: a source can only be
    above its cap if all those before it are. So running sums of caps and weights
    in that order give each source the level that holds if those before it are
    clamped, and the first that stays below its cap sets the level of the rest.
    Sources may be as many as there are rows: only that one level is collected.
    A source without weight has target 0.
    """
    known = sources.withColumn("cap", F.lit(float(epochs)) * F.col("size")).withColumn("turn", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")))
    with_weight = prefix_sums(scratch, known.filter("weight > 0"), [], ["turn", "no"], {"clamped": "cap", "passed": "weight", "at": "one"}, "turns-")
    with_weight = scratch.keep(with_weight, "levels")
    weights = with_weight.agg(F.sum("weight")).first()[0] or 0.0
    level = (F.lit(float(total)) - F.col("clamped")) / (F.lit(weights) - F.col("passed"))
    levels = with_weight.withColumn("level", level)
    first = levels.filter("level * weight <= cap").agg(F.min(F.struct("at", "level")).alias("x")).first().x
    target = F.col("cap") if first is None else F.when(F.col("at") >= first["at"], F.lit(first.level) * F.col("weight")).otherwise(F.col("cap"))
    idle = known.filter("weight <= 0").select("source", "size", F.lit(0.0).alias("target"))
    return levels.select("source", "size", target.alias("target")).unionByName(idle)


def targets(scratch: common.Scratch, sizes: DataFrame, cycle: list[float], share: float, epochs: float) -> DataFrame:
    """(source, size, target) of sizes (source, size): sources by code point, null last; their weights repeat the cycle."""
    one = sizes.withColumn("none", F.col("source").isNull()).withColumn("one", F.lit(1).cast("long"))
    ranked = prefix_sums(scratch, one, [], ["none", "source"], {"no": "one"}, "names-")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("no") % len(cycle) + 1).cast("int"))
    named = scratch.keep(ranked.select("source", "size", "no", "one", weight.alias("weight")), "named")
    total = named.agg(F.sum("size")).first()[0] or 0
    return scratch.keep(water_fill(scratch, named, share * total, epochs), "targets")


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """docs with size, source_size, target, times and taken: how often the mix takes each document.

    Of each source every document is taken floor(target / size) times, and the
    fraction that is left once more from a seeded order of its documents, up to
    the last one whose middle word the fraction reaches: so a source's taken
    words are within half a document of its target. Rows of one doc_id and equal
    texts are taken alike; there, half of them together stand for the document.

    The order is md5 of seed and doc_id, then doc_id, size and a hash of the
    text, so reruns agree. Running sums over (source, order, size) find each
    source's last document; texts are never shuffled for that, and a source may
    hold any part of all rows. Texts reach another task only where sources are
    too many to broadcast a row for each.

    Null text: size 0; null source: a source of its own, last; null doc_id:
    ordered by md5 of the seed alone; a text of any length counts whole. An
    empty table gives no rows. Of docs' own columns those called size,
    source_size, target, times or taken are replaced; others may have any name.
    """
    scratch = common.Scratch(spark, "mixing")
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    tie = F.xxhash64(F.col("text").cast("string"))
    order = ["draw", "doc_id", "size", "tie"]
    rows = docs.select(F.col("source").cast("string").alias("source"), draw.alias("draw"), F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), tie.alias("tie"))
    placed = prefix_sums(scratch, rows, ["source"], order, {"before": "size"})
    sizes = spark.read.parquet(scratch.path("ranged")).groupBy("source").agg(F.sum("size").alias("size"))
    plan = targets(scratch, sizes, list(weights), share, epochs)
    n = plan.count()
    # whole repetitions, and the words left to take once more
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.select(F.col("source").alias("of"), F.col("size").alias("source_size"), "target", whole.alias("whole")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    drawn = (F.col("rest") > 0) & (F.col("before") + F.col("size") / 2 <= F.col("rest"))
    last = placed.join(common.small(plan, n), F.col("source").eqNullSafe(F.col("of"))).filter(drawn).groupBy("source").agg(F.max(F.struct(*order)).alias("last"))
    plan = plan.join(last, F.col("of").eqNullSafe(F.col("source")), "left").drop("source")
    plan = scratch.keep(plan, "plan")
    added = ("size", "source_size", "target", "times", "taken")
    own = [c for c in docs.columns if c.lower() not in added]
    its = common.free_name(own, "plan")
    mixed = docs.join(common.small(plan.select(F.struct("*").alias(its)), n), F.col("source").cast("string").eqNullSafe(F.col(f"{its}.of")))
    here = F.struct(draw.alias("draw"), F.col("doc_id").cast("long").alias("doc_id"), F.col("size"), tie.alias("tie"))
    mixed = mixed.select(*[F.col(f"`{c}`") for c in own], size.alias("size"), its)
    times = F.col(f"{its}.whole") + F.when(here <= F.col(f"{its}.last"), 1).otherwise(0)
    mixed = mixed.withColumn("times", times)
    return mixed.select(*[F.col(f"`{c}`") for c in own], "size", f"{its}.source_size", f"{its}.target", "times", (F.col("size") * F.col("times")).alias("taken"))


#: Rows-for-rows SQL of the query that mixes documents by the defaults of mix().
SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap,
        1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, k) AS j FROM w),
c AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clamped,
        sum(weight) OVER (ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM o),
l AS (SELECT *, (total - clamped) / open_weight AS level FROM c),
f AS (SELECT min(j) AS j FROM l WHERE level * weight <= cap),
t AS (SELECT l.source, l.source_size, CASE WHEN f.j IS NOT NULL AND l.j >= f.j THEN (SELECT x.level FROM l x WHERE x.j = f.j) * l.weight ELSE l.cap END AS target FROM l, f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT p.doc_id, p.size, r.source_size, r.target,
       CAST(p.size * (r.whole + CASE WHEN r.target - r.whole * r.source_size > 0 AND p.before + p.size / 2.0 <= r.target - r.whole * r.source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source
"""
