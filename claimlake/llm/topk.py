"""Exact top-k by columnar branch and bound.

Vectors lie in blocks, dimension by dimension, candidates in order of their norms. A block of queries meets a group of
candidate blocks, one after the other. Inner products are summed over a few dimensions at a time; what the remaining
dimensions can still add is bounded by the product of the remaining norms, and pairs that cannot reach the query's
k-th score so far are dropped and the survivors compacted. A first pass over one block of the longest candidates gives
each query a k-th score to start from, and candidate blocks too short for all queries of a block never meet it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Numbers in a block of candidates and in one of queries, and dimensions per step.
CANDIDATE_NUMBERS, QUERY_NUMBERS, STEP = 1 << 19, 1 << 22, 16
#: Cells of the grid of query blocks and candidate groups, per core.
CELLS = 3
#: Queries that are compared at a time, and the density below which pairs are compacted.
SLICE, DENSE = 64, 0.2
BLOCK = "block long, n int, dims int, kind string, rids binary, vids binary, data binary, longest double"


def _smallest(values: np.ndarray) -> np.ndarray:
    top = float(np.abs(values).max(initial=0))
    return values.astype(np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.float64)


def into_blocks(rows: DataFrame, most: int, *order: Column) -> DataFrame:
    """Rows (vec_id, rid, v, norm), sorted within partitions, packed into blocks of at most so many vectors, stored dimension by dimension."""

    def block(number: int, part: list[tuple]) -> pa.RecordBatch:
        ids, rids, vectors, norms = zip(*part, strict=True)
        dims = max(map(len, vectors))
        data = np.zeros((dims, len(vectors)))
        for i, v in enumerate(vectors):
            data[: len(v), i] = v
        data = _smallest(data)
        cells = [number, len(vectors), dims, data.dtype.str, np.array(rids, dtype="<i8").tobytes(), np.array(ids, dtype="<i8").tobytes(), data.tobytes(), max(norms)]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(cells, types, strict=True)], ["block", "n", "dims", "kind", "rids", "vids", "data", "longest"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []
        for batch in common.small_batches(batches, 4096):
            held += zip(*(batch.column(c).to_pylist() for c in ("vec_id", "rid", "v", "norm")), strict=True)
            while len(held) >= most:
                yield block(number, held[:most])
                number, held = number + 1, held[most:]
        if held:
            yield block(number, held)

    return rows.select("vec_id", "rid", "v", "norm").sortWithinPartitions(*order).mapInArrow(common.tidy(build), BLOCK)


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products in Python integers, held within 64 bits, for components too large for doubles."""
    as_int = np.vectorize(int, otypes=[object])
    return np.clip(as_int(q) @ as_int(v), -(2**63), 2**63 - 1).astype(np.int64)


class Best:
    """The k best candidates so far of each query of a block. Ties go to smaller ids."""

    def __init__(self, row: dict, k: int):
        self.k, self.rids, self.ids = k, np.frombuffer(row["rids"], "<i8"), np.frombuffer(row["vids"], "<i8")
        self.q = vectors(row).T.astype(np.float64)
        self.floor = np.frombuffer(row["floor"], "<f8").copy() if row.get("floor") else np.full(len(self.q), -np.inf)
        self.count = np.zeros(len(self.q), dtype=np.int64)
        self.scores, self.found = (np.zeros((len(self.q), k), dtype=np.int64) for _ in range(2))

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        n = self.count[i]
        scores, ids = np.concatenate([self.scores[i, :n], scores]), np.concatenate([self.found[i, :n], ids])
        first = np.lexsort((ids, ~scores))[: self.k]  # ~ turns the order round and never overflows
        self.count[i] = n = len(first)
        self.scores[i, :n], self.found[i, :n] = scores[first], ids[first]
        if n == self.k:
            self.floor[i] = max(self.floor[i], float(self.scores[i, n - 1]))

    def meet(self, row: dict) -> None:
        """Compare all queries with a block of candidates."""
        v, ids, rids = vectors(row).astype(np.float64), np.frombuffer(row["vids"], "<i8"), np.frombuffer(row["rids"], "<i8")
        own = np.full(len(self.q), -1)
        _, mine, theirs = np.intersect1d(self.rids, rids, assume_unique=True, return_indices=True)
        own[mine] = theirs
        dims = max(self.q.shape[1], v.shape[0])
        q = self.q if dims == self.q.shape[1] else np.pad(self.q, ((0, 0), (0, dims - self.q.shape[1])))
        v = v if dims == v.shape[0] else np.pad(v, ((0, dims - v.shape[0]), (0, 0)))
        if float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(dims, 1) >= 2.0**52:
            scores = _exact(q, v)
            for i in range(len(q)):
                at = np.flatnonzero(np.arange(v.shape[1]) != own[i])
                self.add(i, scores[i][at], ids[at])
            return
        steps = list(range(0, dims, STEP))
        v_left = np.sqrt(np.array([(v[s:] ** 2).sum(0) for s in [*steps[1:], dims]]))
        for low in range(0, len(q), SLICE):
            part, mine = q[low : low + SLICE], own[low : low + SLICE]
            floor = self.floor[low : low + SLICE]
            q_left = np.sqrt(np.array([(part[:, s:] ** 2).sum(1) for s in [*steps[1:], dims]]))
            total, pairs = np.zeros((len(part), v.shape[1])), None
            alive, sums = np.ones(total.shape, dtype=bool), np.zeros(0)
            for n, s in enumerate(steps):
                if pairs is None:
                    total += part[:, s : s + STEP] @ v[s : s + STEP]
                    alive = total + q_left[n][:, None] * v_left[n] + 1e-3 >= floor[:, None]
                    if alive.mean() < DENSE:
                        pairs = np.nonzero(alive)
                        sums = total[pairs]
                elif len(sums):
                    sums = sums + np.einsum("ij,ji->i", part[pairs[0], s : s + STEP], v[s : s + STEP][:, pairs[1]])
                    keep = sums + q_left[n][pairs[0]] * v_left[n, pairs[1]] + 1e-3 >= floor[pairs[0]]
                    pairs, sums = (pairs[0][keep], pairs[1][keep]), sums[keep]
            if pairs is None:
                pairs = np.nonzero(alive)
                sums = total[pairs]
            ends = np.searchsorted(pairs[0], np.arange(len(part) + 1))
            for i in np.flatnonzero(np.diff(ends)):
                at, score = pairs[1][ends[i] : ends[i + 1]], sums[ends[i] : ends[i + 1]]
                keep = at != mine[i]
                at, score = at[keep], score[keep]
                if len(at) > self.k:
                    keep = score >= np.partition(score, -self.k)[-self.k]
                    at, score = at[keep], score[keep]
                if len(at):
                    self.add(low + i, np.rint(score).astype(np.int64), ids[at])

    def rows(self) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(self.q), 2048):
            i = np.repeat(np.arange(low, min(low + 2048, len(self.q))), self.count[low : low + 2048])
            at = np.concatenate([np.arange(n) for n in self.count[low : low + 2048]]) if len(i) else i
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (self.rids[i], self.ids[i], self.found[i, at], self.scores[i, at])], ["rid", "query_id", "vec_id", "score"])


def vectors(row: dict) -> np.ndarray:
    """The numbers of a block, one column per vector."""
    return np.frombuffer(row["data"], row["kind"]).reshape(row["dims"], row["n"])


def _row(batch: pa.RecordBatch, x: int) -> dict:
    return {n: batch.column(n)[x].as_py() for n in batch.schema.names}


def usable(vectors: DataFrame, vec_id: str, vector: str, scale: float) -> DataFrame:
    """(vec_id, v) with v = floor(scale * x); rows with null ids, null vectors, or null or non-finite components go."""
    scaled = F.transform(F.col(vector), lambda x: x.cast("double") * F.lit(scale).cast("double"))
    fine = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # beyond 2**53 a double is a whole number already, and Spark's floor would overflow
    v = F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x))
    return vectors.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & fine).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))


def top_k(vectors: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """Rows query_id, rank, vec_id, score: the k largest inner products of every query row with all rows but itself.

    Scores beyond 64 bits are held at the ends of their range. Components that are finite but not so once scaled count
    as not finite. Shorter vectors count as padded with zeros; repeated rows are rows of their own; ties go to smaller ids; fewer
    than k other rows give fewer results; an empty table or no query gives an empty result.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")
    rows = common.materialize(usable(vectors, vec_id, vector, scale).select("vec_id", "v", norm, F.monotonically_increasing_id().alias("rid")), "vectors")
    queries = rows.where(is_query)
    sizes = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.max(F.size("v")).alias("dims")).first()
    if not sizes["q"]:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    most, most_q = (max(64, numbers // max(sizes["dims"], 1)) for numbers in (CANDIDATE_NUMBERS, QUERY_NUMBERS))
    longest_first = [F.desc("norm"), F.col("rid")]
    left = common.materialize(into_blocks(rows.repartitionByRange(-(-sizes["n"] // most), *longest_first), most, *longest_first), "candidate-blocks")
    right = common.materialize(into_blocks(queries.repartitionByRange(-(-sizes["q"] // most_q), "rid"), most_q, F.col("rid")), "query-blocks")
    probe = left.orderBy("block").first().asDict()  # one block, whatever the corpus: at most CANDIDATE_NUMBERS numbers and their ids

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in range(batch.num_rows):
                row = _row(batch, x)
                best = Best(row, k)
                best.meet(probe)
                # a block is needed unless even its longest vector falls short of every query's floor
                lengths = np.sqrt((best.q**2).sum(1))
                needed = np.where(lengths > 0, (best.floor - 1) / np.where(lengths > 0, lengths, 1), np.where(best.floor <= 0, -np.inf, np.inf)).min()
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([best.floor.astype("<f8").tobytes()], pa.binary()), pa.array([float(needed)])], ["block", "floor", "needed"])

    floors = common.materialize(right.mapInArrow(common.tidy(start), "block long, floor binary, needed double"), "query-floors")
    needed = sorted(tuple(r) for r in floors.select("block", "needed").collect())  # one row per block of queries
    cells = CELLS * max(vectors.sparkSession.sparkContext.defaultParallelism, 2)
    groups = max(1, min(-(-sizes["n"] // most), -(-cells // len(needed))))
    asked = F.array(*[F.struct(F.lit(b).alias("q_block"), F.lit(least).alias("least")) for b, least in needed])
    meets = F.filter(asked, lambda a: a["least"] <= F.col("longest") * (1 + 1e-9))
    group = F.pmod(F.shiftright("block", 32) + F.col("block").bitwiseAND(F.lit((1 << 32) - 1)), F.lit(groups)).cast("long").alias("group")
    content = ["n", "dims", "kind", "rids", "vids", "data"]
    guests = left.select(F.explode(F.transform(meets, lambda a: a["q_block"])).alias("q_block"), group, F.col("block").alias("place"), *content, F.lit(None).cast("binary").alias("floor"))
    hosts = right.join(floors.select("block", "floor"), "block").select(F.col("block").alias("q_block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"), F.lit(-1).cast("long").alias("place"), *content, "floor")
    keys = ["q_block", "group"]
    dealt = hosts.unionByName(guests).repartition(2 * groups * len(needed), *keys).sortWithinPartitions(*keys, "place")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for x in range(batch.num_rows):
                row = _row(batch, x)
                if row["place"] >= 0:
                    best.meet(row)
                    continue
                if best is not None:
                    yield from best.rows()
                best = Best(row, k)
        if best is not None:
            yield from best.rows()

    found = dealt.mapInArrow(common.tidy(search), "rid long, query_id long, vec_id long, score long")
    order = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5(spark, sf_dir: str) -> DataFrame:
    return top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
