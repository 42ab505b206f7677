"""Reciprocal rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How much ranks far down still count: the constant of the published method.
DAMPING = 60


def fused(rankings: dict[str, DataFrame], query_id: str = "query_id", doc_id: str = "doc_id", k: int | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """Rows query_id, doc_id, rank, score and one rank per ranking: the union of all rankings, best first.

    Each ranking has rows (query_id, doc_id, rank from 1). A document that a ranking lacks gets nothing from it and a null
    rank there; one that it holds twice counts by its best rank. Documents tied within a ranking may share a rank. Equal
    scores go to smaller ids. Null ids of queries or documents are ids like others.
    """
    weights = weights or {}
    names = list(rankings)
    tagged = [r.select(F.col(query_id).alias("query_id"), F.col(doc_id).alias("doc_id"), F.lit(n).alias("of"), F.col("rank").cast("int").alias("r")) for n, r in rankings.items()]
    ranks = [F.min(F.when(F.col("of") == n, F.col("r"))).alias(f"{n}_rank") for n in names]
    merged = reduce(DataFrame.unionByName, tagged).groupBy("query_id", "doc_id").agg(*ranks)
    share = lambda n: F.coalesce(F.lit(float(weights.get(n, 1.0))) / (DAMPING + F.col(f"{n}_rank")), F.lit(0.0))
    score: Column = reduce(Column.__add__, [share(n) for n in names])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = merged.withColumn("score", score).withColumn("rank", F.row_number().over(order))
    return (out if k is None else out.where(F.col("rank") <= k)).select("query_id", "doc_id", "rank", "score", *[f"{n}_rank" for n in names])
