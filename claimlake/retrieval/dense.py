"""Dense retrieval: cosine similarity through a coarse quantiser with probe lists.

Centroids are fitted on a bounded sample, every vector then goes to the list of its nearest centroid. Lists are stored in
blocks, each list's radius is the widest angle between its centroid and a member. A query visits the lists of its nearest
centroids. For exact results it also visits every list in which, by its radius, a member may reach the k-th score found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import scratch

#: Rows that centroids are fitted on, centroids at most, turns of fitting.
SAMPLE, LISTS, TURNS = 65_536, 4096, 10
#: Leading bits of hashes by which rows are counted before some are drawn.
SLOT_BITS = 14
#: Rows that ask, when it is measured how many lists a query must visit, how many neighbours each asks for, and the share of these to be found.
TUNERS, NEIGHBOURS, GOAL = 200, 10, 0.95
#: Numbers in a block of a list and in a pack of queries, and the digits that scores are rounded to.
NUMBERS, DIGITS = 1 << 18, 6
#: Numbers in the queries that meet a block together and in what they keep, parts that blocks are dealt to, and a score under all others.
ASKING, PARTS, NONE = 1 << 21, 64, -2.0
_BLOCK = "list int, ids array<bigint>, data binary"
_PACK = "ids array<bigint>, data binary, floors array<double>, visits binary"


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v), v of length 1; rows with null ids, null or zero vectors, or null or non-finite components go."""
    v = F.transform(scratch.col(vector), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(scratch.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    rows = rows.withColumn("norm", norm).where((F.col("norm") > 0) & (F.col("norm") < F.lit(float("inf"))))
    return rows.select("vec_id", F.transform("v", lambda x: x / F.col("norm")).alias("v"))


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """Vectors as rows; shorter ones are padded with zeros."""
    out = np.zeros((len(column), dims))
    out[np.arange(dims) < np.diff(column.offsets.to_numpy())[:, None]] = column.flatten().to_numpy()
    return out


def centroids(sample: np.ndarray, lists: int, turns: int = TURNS) -> np.ndarray:
    """Spherical k-means: centroids of length 1, started from evenly spread rows of the sample."""
    out = sample[np.linspace(0, len(sample) - 1, min(lists, len(sample))).astype(int)].copy()
    for _ in range(turns):
        near = nearest(sample, out)
        for c in np.unique(near):
            mean = sample[near == c].sum(axis=0)
            if (length := np.sqrt(mean @ mean)) > 0:
                out[c] = mean / length
    return np.unique(out, axis=0)


def nearest(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(x[low : low + 4096] @ to.T, axis=1) for low in range(0, len(x), 4096)]) if len(x) else np.zeros(0, dtype=int)


def _blocks(rows: DataFrame, dims: int) -> DataFrame:
    """Rows (list, vec_id, v) as blocks, each of one list; a large list spreads over partitions."""
    most = max(1, NUMBERS // dims)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(lists)) + 1, [len(lists)]])
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                for low in range(begin, end, most):
                    part = batch.slice(low, min(most, end - low))
                    ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(1))
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(0, 1), ids, pa.array([matrix(part.column(2), dims).tobytes()])], ["list", "ids", "data"])

    dealt = rows.repartitionByRange("list", "vec_id").sortWithinPartitions("list", "vec_id")
    return dealt.select("list", "vec_id", "v").mapInArrow(build, _BLOCK)


class Best:
    """The k best rows that each of some queries has met: those of higher score first, ties by smaller ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, floors: np.ndarray, visits: np.ndarray, k: int):
        self.ids, self.vectors, self.floors, self.visits, self.k = ids, vectors, floors, visits, k
        self.score = np.full((len(ids), k), -np.inf)
        self.found, self.list = np.zeros((len(ids), k), dtype=np.int64), np.zeros((len(ids), k), dtype=np.int32)

    def meet(self, number: int, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Compare a block of a list with the queries that visit the list."""
        asking = np.flatnonzero(self.visits[:, number >> 3] & (128 >> (number & 7)))
        step = max(256, NUMBERS // len(ids))
        for low in range(0, len(asking), step):
            some = asking[low : low + step]
            raw = self.vectors[some] @ vectors.T
            raw[self.ids[some, None] == ids] = -np.inf
            floor = self.floors[some]
            if len(ids) > self.k and (floor == NONE).any():
                floor = np.maximum(floor, np.partition(raw, -self.k, axis=1)[:, -self.k])
            row, at = np.nonzero(raw >= floor[:, None] - 2 * 10.0**-DIGITS)  # may reach the floor when rounded
            score, row = np.round(raw[row, at], DIGITS) + 0.0, some[row]
            good = score >= self.floors[row]
            if good.any():
                self._keep(row[good], ids[at[good]], score[good], number)

    def _keep(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray, number: int) -> None:
        touched = np.unique(row)
        of, at = np.nonzero(self.score[touched] > -np.inf)
        of = touched[of]
        lists = np.concatenate([np.full(len(row), number, dtype=np.int32), self.list[of, at]])
        row, ids, score = np.concatenate([row, of]), np.concatenate([ids, self.found[of, at]]), np.concatenate([score, self.score[of, at]])
        order = np.lexsort((ids, -score, row))
        turn = np.arange(len(row)) - np.searchsorted(row[order], row[order])
        order, turn = order[turn < self.k], turn[turn < self.k]
        row = row[order]
        self.score[row, turn], self.found[row, turn], self.list[row, turn] = score[order], ids[order], lists[order]
        self.floors[touched] = np.maximum(self.floors[touched], self.score[touched, -1])

    def rows(self) -> Iterator[pa.RecordBatch]:
        row, at = np.nonzero(self.score > -np.inf)
        for low in range(0, len(row), 1 << 16):
            some = row[low : low + (1 << 16)], at[low : low + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[some[0]]), pa.array(self.found[some]), pa.array(self.score[some]), pa.array(self.list[some])], ["query_id", "vec_id", "score", "list"])


class Quantiser:
    """Vectors by list, and what a driver needs to choose lists: centroids and radii, one row per list."""

    def __init__(self, spark: SparkSession, path: str, probes: int | None = None):
        self.spark = spark
        rows = sorted(spark.read.parquet(f"{path}/lists").collect(), key=lambda r: r["list"])  # at most LISTS rows
        self.centroids = np.array([r["centroid"] for r in rows])
        self.radii = np.array([r["radius"] for r in rows])
        self.blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
        self.probes = probes or spark.read.parquet(f"{path}/probes").first()["probes"]

    def asking(self, queries: DataFrame, probes: int, groups: int, floors: DataFrame | None = None) -> DataFrame:
        """(grp, ids, data, floors, visits): queries (vec_id, v) in packs, each of one group of queries.

        ``visits`` has a bit per list: a query visits the nearest ones or, given floors, all others that may hold something at least as good. Those that visit none are left out.
        """
        own, radii, others = self.centroids, self.radii, floors is not None
        dims = own.shape[1]
        most = max(1, NUMBERS // dims)

        def visited(x: np.ndarray, floor: np.ndarray) -> np.ndarray:
            like = x @ own.T
            order = np.argsort(-like, axis=1, kind="stable")
            near = np.zeros(like.shape, dtype=bool)
            np.put_along_axis(near, order[:, :probes], True, axis=1)
            if others:
                angle = np.maximum(np.arccos(np.clip(like, -1, 1)) - radii, 0)
                near = ~near & (np.cos(angle) + 10.0 ** -(DIGITS - 1) >= floor[:, None])
            return np.packbits(near, axis=1)

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                grp = batch.column(3).to_numpy()
                for g in np.unique(grp):
                    rows = batch.take(pa.array(np.flatnonzero(grp == g)))
                    for low in range(0, rows.num_rows, most):
                        part = rows.slice(low, most)
                        x, floor = matrix(part.column(1), dims), part.column(2).to_numpy()
                        bits = np.concatenate([visited(x[i : i + 128], floor[i : i + 128]) for i in range(0, len(x), 128)])
                        some = np.flatnonzero(bits.any(axis=1))
                        if len(some):
                            one = lambda a, n=len(some): pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), a)
                            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), one(part.column(0).take(pa.array(some))), pa.array([x[some].tobytes()]), one(pa.array(floor[some])), pa.array([bits[some].tobytes()])], ["grp", "ids", "data", "floors", "visits"])

        rows = queries.join(floors, "vec_id", "left") if others else queries.withColumn("floor", F.lit(None).cast("double"))
        grp = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("grp")
        return rows.select("vec_id", "v", F.coalesce("floor", F.lit(NONE)).alias("floor"), grp).mapInArrow(choose, f"grp int, {_PACK}")

    def met(self, queries: DataFrame, k: int, probes: int, floors: DataFrame | None = None) -> DataFrame:
        """(query_id, vec_id, score, list): each query's k best of every part of the lists it visits, save rows with its own id and ones under its floor.

        Blocks are dealt to parts. Every group of queries meets every part in one task, which holds the group and the k best
        of each of its queries, and one block at a time: a vector travels once per group, a query once per part.
        """
        dims = self.centroids.shape[1]
        groups = max(1, -(-queries.count() * max(dims, k) // ASKING))
        every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
        packs = self.asking(queries, probes, groups, floors).select(every(PARTS, "part"), "grp", F.lit(-1).alias("list"), "ids", "data", "floors", "visits")
        part = F.pmod(F.xxhash64("list", F.col("ids")[0]), F.lit(PARTS)).cast("int").alias("part")
        blocks = self.blocks.select(part, every(groups, "grp"), "list", "ids", "data", F.lit(None).cast("array<double>").alias("floors"), F.lit(None).cast("binary").alias("visits"))
        dealt = packs.unionByName(blocks).repartition("part", "grp").sortWithinPartitions("part", "grp", "list")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell, asked, best = None, [], None
            for batch in batches:
                for i in range(batch.num_rows):
                    part, grp, number = (batch.column(c)[i].as_py() for c in range(3))
                    if (part, grp) != cell:
                        if best:
                            yield from best.rows()
                        cell, asked, best = (part, grp), [], None
                    ids, data = batch.column(3)[i].values.to_numpy(), np.frombuffer(batch.column(4)[i].as_buffer()).reshape(-1, dims)
                    if number < 0:
                        bits = np.frombuffer(batch.column(6)[i].as_buffer(), np.uint8).reshape(len(ids), -1)
                        asked.append([x.copy() for x in (ids, data, batch.column(5)[i].values.to_numpy(), bits)])
                    elif best or asked:
                        if not best:
                            best, asked = Best(*map(np.concatenate, zip(*asked, strict=True)), k), []
                        best.meet(number, ids, data)
            if best:
                yield from best.rows()

        return dealt.mapInArrow(compare, "query_id long, vec_id long, score double, list int")

    def search(self, queries: DataFrame, k: int = NEIGHBOURS, probes: int | None = None, exact: bool = False, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """Rows query_id, rank, vec_id, score: each query's k vectors of highest cosine, save those with its own id, ties by smaller ids.

        Scores are rounded. Without ``exact`` only the ``probes`` nearest lists are visited, unless told as many as ``build`` found to be enough. Unusable vectors, null or
        zero ones or with null or non-finite components, neither ask nor are found. Repeated query rows ask once.
        """
        asked = scratch.written(usable(queries, vec_id, vector).dropDuplicates(["vec_id"]), "dense-queries")
        found = self._found(asked, k, probes or self.probes, exact)
        return found.select("query_id", "rank", "vec_id", "score")

    def _found(self, asked: DataFrame, k: int, probes: int, exact: bool) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        top = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if not len(self.centroids):
            return self.spark.createDataFrame([], "query_id long, vec_id long, score double, list int, rank int")
        first = top(self.met(asked, k, probes))
        if exact:
            first = scratch.written(first, "dense-first")
            floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
            rest = self.met(asked, k, probes, floors)
            first = top(first.drop("rank").unionByName(rest))
        return first

    def enough(self, asked: DataFrame, k: int, goal: float) -> int:
        """How many lists hold the share ``goal`` of the k neighbours of some queries (vec_id, v); these few are collected."""
        rows = asked.collect()
        at = {r["vec_id"]: i for i, r in enumerate(rows)}
        found = self._found(asked, k, 1, exact=True).select("query_id", "list").collect()
        if not found:
            return 1
        x = np.zeros((len(rows), self.centroids.shape[1]))
        for i, r in enumerate(rows):
            x[i, : len(r["v"])] = r["v"]
        turn = np.argsort(np.argsort(-(x @ self.centroids.T), axis=1, kind="stable"), axis=1)
        turns = np.sort([turn[at[r["query_id"]], r["list"]] for r in found])
        return int(turns[math.ceil(goal * len(turns)) - 1]) + 1


def first_by_hash(rows: DataFrame, n: int, seed: int | None = None, once: bool = False) -> DataFrame:
    """The n rows (vec_id, v) of smallest hash, with ``once`` the first of every id, written to a table of their own.

    Counts by the hash's leading bits tell which rows can be among them. A sort with a limit over all rows would send n
    rows of every partition to one place, and collected ones to the driver.
    """
    key = F.xxhash64("vec_id") if seed is None else F.xxhash64("vec_id", F.lit(seed))
    slot = F.shiftright(key, 64 - SLOT_BITS)
    ids = rows.select("vec_id").distinct() if once else rows
    counts = ids.groupBy(slot.alias("slot")).count().orderBy("slot").collect()  # at most 2 ** SLOT_BITS rows
    last = next((r["slot"] for r, held in zip(counts, accumulate(r["count"] for r in counts), strict=True) if held >= n), None)
    near = rows if last is None else rows.where(slot <= last)
    near = near.dropDuplicates(["vec_id"]) if once else near
    return scratch.written(near.orderBy(key, "vec_id", *([] if once else ["v"])).limit(n), "dense-drawn")


def build(vectors: DataFrame, path: str, lists: int | None = None, vec_id: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, goal: float = GOAL) -> None:
    """Write the quantiser of all usable vectors. Centroids are fitted on ``sample`` rows at most; every row is listed.

    How many lists a query visits later is measured: TUNERS rows ask for their neighbours among all rows, exactly, and
    as many lists are visited as hold the share ``goal`` of these.
    """
    spark = vectors.sparkSession
    rows = scratch.written(usable(vectors, vec_id, vector), "dense-vectors")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).first()
    dims = size["dims"] or 1
    fitted = matrix(first_by_hash(rows, sample).select("v").toArrow().column(0).combine_chunks(), dims)
    own = centroids(fitted, lists or max(1, min(LISTS, math.isqrt(size["n"])))) if len(fitted) else fitted

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dims)
            near = nearest(x, own)
            angle = np.arccos(np.clip((x * own[near]).sum(axis=1), -1, 1)) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), *batch.columns, pa.array(angle)], ["list", "vec_id", "v", "angle"])

    listed = scratch.written(rows.mapInArrow(assign, "list int, vec_id long, v array<double>, angle double"), "dense-listed")
    _blocks(listed, dims).write.parquet(f"{path}/blocks")
    radii = {r["list"]: r["radius"] for r in listed.groupBy("list").agg(F.max("angle").alias("radius")).collect()}  # at most LISTS rows
    shown = [(i, [float(x) for x in c], radii.get(i, 0.0) + 1e-9) for i, c in enumerate(own)]
    spark.createDataFrame(shown, "list int, centroid array<double>, radius double").write.parquet(f"{path}/lists")
    asking = first_by_hash(rows, TUNERS, 1, once=True)
    probes = Quantiser(spark, path, 1).enough(asking, NEIGHBOURS, goal)
    spark.createDataFrame([(probes,)], "probes int").write.parquet(f"{path}/probes")


def search(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, probes: int | None = None, exact: bool = False, lists: int | None = None, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Quantise the vectors in the shared folder and search them. To search again, keep a quantiser: ``build`` and ``Quantiser``."""
    path = scratch.fresh(vectors.sparkSession, "dense")
    build(vectors, path, lists, vec_id, vector)
    return Quantiser(vectors.sparkSession, path).search(queries, k, probes, exact, vec_id, vector)


def recall(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows query_id, wanted, found: how many of a query's wanted rows (query_id, vec_id) another result holds."""
    hit = wanted.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))


def sql(vectors: str, is_query: str, k: int = 10) -> str:
    """CTEs that end in ``dense``, by comparing every query with every vector (vec_id, embedding)."""
    return f"""
d_v AS MATERIALIZED (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM {vectors}
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d_s AS (
  SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(q.e, c.e), {DIGITS}) + 0.0 AS score
  FROM (SELECT * FROM d_v WHERE {is_query}) q JOIN d_v c ON q.vec_id <> c.vec_id),
dense AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM d_s QUALIFY rank <= {k})"""
