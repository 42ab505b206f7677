"""Queries over the retrieval operators, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch
from . import bm25, chunkers, dense, fusion

#: Sizes of chunks that are searched and of those that are read, and chunks found per query.
CHILD, PARENT, FOUND = 400, 2000, 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return bm25.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("query_id", "item_id")


def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkers.recursive(table(spark, sf_dir, "documents"))


def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkers.semantic(table(spark, sf_dir, "documents"))


def parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items search small chunks; what they find is the large chunks around them.

    All documents are cut and searched; those with a hit are cut again, to link their chunks.
    """
    docs = table(spark, sf_dir, "documents")
    children = chunkers.recursive(docs, size=CHILD, overlap=0).withColumn("chunk_id", F.col("doc_id") * 1_000_000 + F.col("chunk"))
    hits = bm25.search(children, table(spark, sf_dir, "benchmark"), FOUND, doc_id="chunk_id")
    hits = hits.select("query_id", F.expr("doc_id div 1000000").alias("doc_id"), (F.col("doc_id") % 1_000_000).cast("int").alias("chunk"), "score")
    hits = scratch.written(hits, "chunk-hits")
    met = scratch.written(hits.select("doc_id", "chunk").distinct(), "chunks-met")
    cut = lambda size: chunkers.recursive(docs.join(scratch.small(met.select("doc_id").distinct()), "doc_id", "left_semi"), size=size, overlap=0)
    links = chunkers.contained(cut(CHILD).join(scratch.small(met), ["doc_id", "chunk"], "left_semi"), cut(PARENT), cell=PARENT)
    return chunkers.expanded(hits, links).withColumnRenamed("query_id", "item_id")


def asking(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf_dir, "embeddings")
    return vectors, vectors.where("vec_id % 100 = 0")


def dense_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth, exactly."""
    return dense.search(*asking(spark, sf_dir), exact=True)


def dense_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the ten nearest vectors a search of the nearest lists alone finds."""
    vectors, asked = asking(spark, sf_dir)
    path = scratch.fresh(spark, "dense")
    dense.build(vectors, path)
    lists = dense.Quantiser(spark, path)
    return dense.recall(lists.search(asked), lists.search(asked, exact=True))


def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical and dense rankings as one. A benchmark item's vector is the one whose id is a hundred times the item's."""
    nearest = dense_search(spark, sf_dir).select(F.expr("query_id div 100").alias("query_id"), F.col("vec_id").alias("doc_id"), "rank")
    lexical = bm25_search(spark, sf_dir).withColumnRenamed("item_id", "query_id")
    both = fusion.fused({"lexical": lexical, "dense": nearest}).withColumnRenamed("query_id", "item_id")
    return both.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("lexical_rank", "dense_rank")})


ITEMS = "(SELECT item_id AS query_id, text FROM benchmark)"
BM25_SQL = f"WITH {bm25.sql('documents', ITEMS)} SELECT query_id AS item_id, rank, doc_id, score FROM bm25"
RECURSIVE_SQL = f"WITH RECURSIVE {chunkers.recursive_sql('documents', 'r')} SELECT * FROM r"
DENSE_SQL = f"WITH {dense.sql('embeddings', 'vec_id % 100 = 0')} SELECT * FROM dense"
PARENT_CHILD_SQL = f"""WITH RECURSIVE {chunkers.recursive_sql("documents", "c", CHILD, 0)},
{chunkers.recursive_sql("documents", "p", PARENT, 0)},
{bm25.sql("(SELECT doc_id * 1000000 + chunk AS doc_id, text FROM c)", ITEMS, FOUND)}
SELECT query_id AS item_id, p.doc_id, p.chunk AS parent, max(h.score) AS score, count(*) AS n_hits, CAST(min_by(c.chunk, (-h.score, c.chunk)) AS INTEGER) AS best_chunk
FROM bm25 h JOIN c ON h.doc_id = c.doc_id * 1000000 + c.chunk JOIN p ON p.doc_id = c.doc_id AND c.fresh >= p.start AND c.fresh < p.start + p.length
GROUP BY ALL"""
FUSION_SQL = f"""WITH {bm25.sql("documents", ITEMS)}, {dense.sql("embeddings", "vec_id % 100 = 0")},
n AS (SELECT query_id // 100 AS query_id, vec_id AS doc_id, rank FROM dense),
u AS (
  SELECT query_id AS item_id, doc_id, coalesce(b.rank, 0) AS lexical_rank, coalesce(n.rank, 0) AS dense_rank, coalesce(1.0::DOUBLE / ({fusion.DAMPING} + b.rank), 0) + coalesce(1.0::DOUBLE / ({fusion.DAMPING} + n.rank), 0) AS score
  FROM bm25 b FULL JOIN n USING (query_id, doc_id))
SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM u"""

QUERIES = {"bm25_search": bm25_search, "recursive_chunks": recursive_chunks, "parent_child": parent_child, "dense_search": dense_search, "dense_recall": dense_recall, "rank_fusion": rank_fusion, "semantic_chunks": semantic_chunks}
ORACLES = {"bm25_search": BM25_SQL, "recursive_chunks": RECURSIVE_SQL, "parent_child": PARENT_CHILD_SQL, "dense_search": DENSE_SQL, "rank_fusion": FUSION_SQL, "semantic_chunks": chunkers.SEMANTIC_SQL}
