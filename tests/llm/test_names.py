"""Odd column names and types, and filters of any size."""

import pytest
from pyspark.sql import functions as F

from claimlake.llm import bestfit, common, exact_dedup, license_scan, mixing, near_dedup, packing, pii, sharding, url_filter

NAMES = [packing.pack, bestfit.pack, mixing.mix, near_dedup.near_groups, near_dedup.near_dedup, sharding.shard, pii.find, pii.redact, license_scan.scan, exact_dedup.mark_copies, exact_dedup.exact_dedup, lambda d, text: url_filter.filter_urls(d, text)]


@pytest.mark.parametrize("apply", NAMES)
def test_dotted_and_case_differing_names(spark, apply):
    rows = [(1, "some words here", "s"), (2, None, None), (2, "some words here", "s"), (None, "", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, `te.xt` string, source string")
    odd = docs.selectExpr("*", "1 AS `meta.x`", "'y' AS `a``b`", "map('k', 1) AS `m.ap`", "array(1) AS list", *[f"'z' AS {n}" for n in ("Shard", "Kept", "Labels", "BASE", "Verdict")])
    out = apply(odd, text="te.xt")
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    assert len(out.collect()) == out.count() > 0


def test_shards_do_not_depend_on_the_order_of_rows(spark, data):
    some = common.table(spark, data, "documents").where("doc_id < 100").withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))
    some = some.unionAll(some.where("doc_id % 3 = 0").withColumn("m", F.create_map(F.lit("k"), F.lit(0).cast("long"))))
    places = [sorted((r["doc_id"], str(r["m"]), r["shard"], r["slot"]) for r in sharding.shard(d).collect()) for d in (some.repartition(3), some.repartition(7).orderBy(F.desc("doc_id")))]
    assert places[0] == places[1]


def test_filters_in_parts_move_no_row(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 1 << 13)
    rows = spark.range(3000).select("id", F.concat(F.lit("text "), (F.col("id") % 2500).cast("string")).alias("text"))
    bits = common.filter_bits(3000)
    words = common.materialize(common.filter_words(rows, "text", bits, least=2), "words")
    probed = common.might_hold(rows, words, "text", bits, "hit")
    assert bits // 8 // common.BROADCAST_BYTES > 1
    assert probed.count() == 3000
    assert 1000 <= probed.where("hit").count() <= 1100
    assert probed.where("hit").where("id % 2500 < 500").count() == 1000
    kept = exact_dedup.exact_dedup(rows, "text", "id")
    assert kept.count() == 2500 == kept.select("text").distinct().count()


def test_texts_that_stay_are_never_shuffled(spark):
    rows = spark.range(2000).select("id", F.concat(F.lit("text "), (F.col("id") % 1900).cast("string")).alias("text"))
    rows = common.materialize(rows, "rows")
    plan = exact_dedup.exact_dedup(rows, "text", "id")._jdf.queryExecution().executedPlan().toString()
    scans = plan.count("Scan parquet")
    assert scans and "Exchange hashpartitioning(row" not in plan
    for line in plan.splitlines():
        assert "Exchange" not in line or "text" not in line
