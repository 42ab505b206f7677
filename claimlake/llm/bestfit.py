"""Best-fit packing planned over the length histogram.

Documents longer than a sequence are cut from their end, so that only the first piece may be shorter. Pieces are counted by
length, and best fit, longest first, runs over these counts: what it keeps are groups of sequences of one filling, never
sequences or documents. The plan says which ranks of a length go to which sequences, and every piece takes its slot by a
join on its rank within its length. Neither histogram nor plan grows with the corpus: the sequence length bounds both.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .packing import RANKS, TOKENIZER
from .tokens import encoder, tokenizer_path

LENGTH = 2048
PIECE = "piece int, start long, length long, ids_crc32 long"
#: Ranks from ``low`` to below ``high`` of a length: ``per`` of them to each sequence from ``first`` on, at ``base`` and after.
PLAN = "length long, low long, high long, per long, first long, base long"


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of PLAN: best fit over counts, longest length first.

    A length goes to the fullest sequences it still fits, which then take as many of it as they can: after one, they are
    the best fit for the next. Sequences filled alike are one group, so each step places a whole group or ends a length.
    """
    rows, opened = [], 0
    groups: dict[int, list[tuple[int, int]]] = {}  # room left -> groups (first sequence, how many)
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        fitting = sorted(room for room in groups if room >= length)
        while left:
            if fitting:
                room = fitting.pop(0)
                candidates = groups.pop(room)
            else:  # nothing open fits: open as many sequences as the rest takes
                count = -(-left // (capacity // length))
                room, candidates, opened = capacity, [(opened, count)], opened + count
            per = room // length
            for first, count in candidates:
                whole = min(count, left // per)
                if whole:
                    rows.append((length, rank, rank + whole * per, per, first, capacity - room))
                    groups.setdefault(room - per * length, []).append((first, whole))
                    rank, left = rank + whole * per, left - whole * per
                if whole < count and left:  # fewer than a sequence would take
                    rows.append((length, rank, rank + left, left, first + whole, capacity - room))
                    groups.setdefault(room - left * length, []).append((first + whole, 1))
                    whole, left = whole + 1, 0
                if whole < count:
                    groups.setdefault(room, []).append((first + whole, count - whole))
    return rows


def cut_pieces(docs: DataFrame, text: str, doc_id: str, path: str, ranks: str | None, length: int) -> DataFrame:
    """Pieces of every document (doc_id, PIECE) with the partition that made them and their rank among its pieces of their length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path, ranks).ids, TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in common.small_batches(batches):
            owner, rows = [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                ids = memoryview(encode(value or "") + b"\0\0\0\0")
                n, at, piece = len(ids) // 4, 0, 0
                while at < n:
                    size = (n - at) % length or length
                    rank = seen.get(size, 0)
                    seen[size] = rank + 1
                    owner.append(i)
                    rows.append((piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), rank))
                    at, piece = at + size, piece + 1
            numbers = np.array(rows, dtype=np.int64).reshape(-1, 5)
            columns = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(numbers[:, 0].astype(np.int32)), *(pa.array(numbers[:, c]) for c in (1, 2, 3)), pa.array(np.full(len(owner), part, dtype=np.int32)), pa.array(numbers[:, 4])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    kind = docs.schema[doc_id].dataType.simpleString()
    named = docs.select(common.col(doc_id).alias("doc_id"), common.col(text).cast("string").alias("text"))
    return named.mapInArrow(common.tidy(cut), f"doc_id {kind}, {PIECE}, part int, rank long")


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, ranks: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece with the id 0 alone. Repeated rows are packed as often as they occur. An empty
    table gives an empty result. Other columns of the input are left out.
    """
    if path is None:
        path, ranks = tokenizer_path(TOKENIZER), tokenizer_path(RANKS)
    spark = docs.sparkSession
    pieces = common.materialize(cut_pieces(docs, text, doc_id, path, ranks, length), "bestfit-pieces")
    counts = common.materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "bestfit-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row per token of a sequence
    slots = spark.createDataFrame(plan(histogram, length), PLAN)

    upto = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = common.materialize(counts.select("part", "length", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before")), "bestfit-starts")
    ranked = pieces.join(common.small_side(before), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    taken = ranked.join(F.broadcast(slots), (ranked["length"] == slots["length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    at = F.col("rank") - F.col("low")
    sequence = (F.col("first") + F.expr("(rank - low) div per")).alias("sequence_id")
    return taken.select("doc_id", "piece", "start", ranked["length"], "ids_crc32", sequence, (F.col("base") + at % F.col("per") * ranked["length"]).alias("offset"))


def op11(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
