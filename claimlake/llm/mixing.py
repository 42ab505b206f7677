"""Mixing sources to target weights.

Sizes are summed per source and each source gets a target and a repetition rate. A document is then
emitted floor(rate) times plus one hash-seeded Bernoulli copy with the fraction as its probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Weights, repeating over the sources in code point order, null last.
WEIGHTS = (3, 1, 2)
#: All targets together, and the most of one source, as multiples of the sizes.
TOTAL, CAP = 1.5, 2.0
#: Seeds tried per source; the one whose draw comes nearest to the target is used. Each copy is one draw with the
#: fraction as its probability, but as the best of 16 is taken, draws of one source are not quite independent.
SEEDS = 16


def word_count(text: Column) -> Column:
    return common.count_runs(F.coalesce(text.cast("string"), F.lit("")), common.WS)


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("-"))


def draw_of(doc_id: Column, text: Column) -> Column:
    """What a document's draw depends on: its id, or without one its text."""
    return F.xxhash64(doc_id.isNull(), doc_id, F.when(doc_id.isNull(), text.cast("string")))


def _copies(draw: Column, rate: Column, seed: Column | int) -> Column:
    extra = (common.unit_hash(draw, seed=seed) < rate - F.floor(rate)).cast("long")
    return F.least(F.floor(rate) + extra, F.lit(int(CAP)).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """Per source of (source, size): source_size, target and rate.

    Sources share total * sum of sizes by weight. A target stops at cap * its source's size and what is over
    goes to the others by weight: with sources ordered by cap / weight the capped ones are a prefix, so running
    sums find the common level. One row per source passes the windows, never one per document.
    """
    per = sizes.groupBy(_key(F.col("source")).alias("key"), "source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    per = per.withColumn("weight", weight).withColumn("most", F.lit(cap) * F.col("source_size"))
    by = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rest = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.lit(total) * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    per = per.withColumn("level", level)
    open_level = F.min(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct(F.col("most") / F.col("weight"), "level"))).over(whole)
    target = F.when(F.col("open").isNull(), F.col("most")).otherwise(F.least("most", F.col("weight") * F.col("open.level")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return per.withColumn("open", open_level).withColumn("target", target).select("key", "source_size", "target", rate.alias("rate"))


def plan(sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For (draw, source, size): per source key, source_size, target, rate and seed; and sizes with its key."""
    keyed = sizes.withColumn("key", _key(F.col("source")))
    rates = common.materialize(targets(sizes), "mix-rates")
    tried = keyed.join(common.small_side(rates), "key")
    sums = [F.sum(_copies(F.col("draw"), F.col("rate"), s) * F.col("size")).alias(f"t{s}") for s in range(SEEDS)]
    miss = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{s}") - F.col("target")).alias("miss"), F.lit(s).alias("seed")) for s in range(SEEDS)]))
    per = ["key", "source_size", "target", "rate"]
    return common.materialize(tried.groupBy(*per).agg(*sums).select(*per, miss["seed"].alias("seed")), "mix-plan"), keyed


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """Every document as often as the mix takes it, with the columns of the input.

    Null text has size 0, null source is a source of its own (the last), rows without an id draw by their text, repeated
    rows draw alike, an empty table gives an empty mix. Documents of size 0 follow their source's rate.
    """
    draw = draw_of(common.col(doc_id), common.col(text)).alias("draw")
    rows = docs.select(F.struct(*[common.col(c) for c in docs.columns]).alias("row"), draw, common.col(source).alias("source"), word_count(common.col(text)).alias("size"))
    sizes = common.materialize(rows.drop("row"), "mix-sizes")
    rates, _ = plan(sizes)
    out = rows.withColumn("key", _key(F.col("source"))).join(common.small_side(rates), "key")
    copies = _copies(F.col("draw"), F.col("rate"), F.col("seed"))
    return out.select("row", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias("_copy")).select("row.*")


def op2(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", draw_of(F.col("doc_id"), F.col("text")).alias("draw"), "source", word_count(F.col("text")).alias("size"))
    rates, keyed = plan(common.materialize(docs, "mix-sizes"))
    out = keyed.join(common.small_side(rates), "key")
    taken = _copies(F.col("draw"), F.col("rate"), F.col("seed")) * F.col("size")
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"))
