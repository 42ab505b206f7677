"""Ranked lexical search by Fagin's threshold algorithm.

A first pass over the documents writes a forward index: each document's length and how often it holds the terms that the
queries ask for. The second pass streams that index through its tasks, block by block. A block lays out, for every term,
the list of its documents by falling impact; a query reads its lists in turn to equal depth, looks every new document up
in the forward index for its whole score, and stops when what an unread document can still reach, the sum of the next
impacts, lies strictly below its k-th score. That score is carried from block to block, so later blocks are left sooner.
Queries go in blocks of bounded size, which is all of them that the driver or a task ever holds.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

K = 50
#: Bytes of query texts in a block, numbers in a block of documents, list entries read per term at first.
QUERY_BYTES, NUMBERS, DEPTH = 1 << 22, 1 << 22, 32
#: Search tasks per core; each carries its queries' k-th scores through its blocks.
CELLS = 3
#: A text is split into terms in parts of about so many bytes.
PART = 1 << 20
#: ASCII but digits and letters separates terms, A-Z are lower-cased; all other bytes of UTF-8 stay as they are.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> Counter:
    """How often each term occurs."""
    folded, at, out = text.translate(FOLD), 0, Counter()
    while at < len(folded):
        end = folded.find(b" ", at + PART)
        end = len(folded) if end < 0 else end
        out.update(folded[at:end].split())
        at = end
    return out


def as_bytes(name: str):
    return common.col(name).cast("string").cast("binary")


def forward_index(docs: DataFrame, text: str, doc_id: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """Scratch table (doc_id, rid, n, t, f) of the documents with a term: how many in all, which of the vocabulary, how often each."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches):
            kept, n, t, f = [], [], [], []
            for i, value in enumerate(batch.column(2)):
                counts = terms(value.as_py() or b"")
                if counts:
                    held = sorted((vocabulary[x], counts[x]) for x in counts.keys() & vocabulary.keys())
                    kept.append(i)
                    n.append(counts.total())
                    t.append(np.array([x for x, _ in held], dtype="<i4").tobytes())
                    f.append(np.array([x for _, x in held], dtype="<i8").tobytes())
            rows = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(n, pa.int64()), pa.array(t, pa.binary()), pa.array(f, pa.binary())], ["doc_id", "rid", "n", "t", "f"])

    named = docs.select(common.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), as_bytes(text).alias("text"))
    return common.materialize(named.mapInArrow(common.tidy(index), "doc_id long, rid long, n long, t binary, f binary"), "forward-index")


def document_frequencies(forward: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, dtype=np.int64)
        for batch in batches:
            found += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), minlength=size)
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(found[held])], ["term", "df"])

    out = np.zeros(size, dtype=np.int64)
    for row in forward.select("t").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # at most one row per term of a block of queries
        out[row["term"]] = row["df"]
    return out


class Block:
    """Some documents of the forward index: impacts by term and document, and each term's documents by falling impact."""

    def __init__(self, rows: list[tuple], weights: np.ndarray, documents: int, length: int):
        self.missing = np.array([r[0] is None for r in rows])
        self.ids = np.array([0 if r[0] is None else r[0] for r in rows], dtype=np.int64)
        self.rids = np.array([r[1] for r in rows], dtype=np.int64)
        sizes = [r[2] for r in rows]
        exact = np.int64 if 50 * max(sizes) * documents < 2**63 else object
        m = (50 + 50 * np.array(sizes, dtype=exact) * documents // length).astype(np.int64)
        t, f = (np.frombuffer(b"".join(r[c] for r in rows), kind) for c, kind in ((3, "<i4"), (4, "<i8")))
        doc = np.repeat(np.arange(len(rows)), [len(r[3]) // 4 for r in rows])
        impact = weights[t] * ((1_000_000_000 * f) // (1000 * f + 20 * m[doc]))
        held = impact > 0
        t, doc, impact = t[held], doc[held], impact[held]
        self.lookup = np.zeros((len(weights), len(rows)), dtype=np.int64)
        self.lookup[t, doc] = impact
        order = np.lexsort((-impact, t))
        self.docs, self.impacts = doc[order], impact[order]
        self.ends = np.cumsum(np.bincount(t, minlength=len(weights)))
        self.starts = np.concatenate([[0], self.ends[:-1]])


class Best:
    """A query's k best documents so far: score, whether the id is null, id, row. Ties go to smaller ids, null ones last."""

    def __init__(self, asked: np.ndarray, k: int):
        self.asked, self.k, self.rows = asked, k, np.zeros((4, 0), dtype=np.int64)

    def add(self, block: Block, docs: np.ndarray, scores: np.ndarray) -> None:
        if self.rows.shape[1] == self.k:
            able = scores >= self.rows[0, -1]
            docs, scores = docs[able], scores[able]
        if len(docs):
            rows = np.concatenate([self.rows, [scores, block.missing[docs], block.ids[docs], block.rids[docs]]], axis=1)
            self.rows = rows[:, np.lexsort((rows[3], rows[2], rows[1], -rows[0]))[: self.k]]

    def meet(self, block: Block) -> None:
        """Read the lists of the query's terms in turn, to a depth that doubles, until no unread document can be among the best."""
        starts, ends = block.starts[self.asked], block.ends[self.asked]
        held = ends > starts
        asked, starts, ends = self.asked[held], starts[held], ends[held]
        seen, depth, step = np.zeros(len(block.ids), dtype=bool), 0, DEPTH
        while True:
            open_ = starts + depth < ends
            threshold = int(block.impacts[starts[open_] + depth].sum())  # of documents that no list has shown yet
            if not threshold or (self.rows.shape[1] == self.k and threshold < self.rows[0, -1]):
                return
            places = starts[open_, None] + np.arange(depth, depth + step)
            docs = np.unique(block.docs[places[places < ends[open_, None]]])
            docs = docs[~seen[docs]]
            seen[docs] = True
            self.add(block, docs, block.lookup[asked[:, None], docs].sum(axis=0))
            depth, step = depth + step, 2 * step


def search(docs: DataFrame, items: list[tuple], k: int, text: str, doc_id: str, item_type) -> DataFrame:
    """(item_rid, item_id, score, doc_id, rid): the best documents of every task for a block of items (rid, item_id, terms)."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, _, own in items for t in own}))}
    forward = forward_index(docs, text, doc_id, vocabulary)
    documents, length = forward.agg(F.count("*"), F.sum("n")).first()
    df = document_frequencies(forward, len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) if x else 0 for x in df], dtype=np.int64)
    asked = [np.array(sorted(vocabulary[t] for t in own), dtype=np.int64) for _, _, own in items]
    rids, names = [r for r, _, _ in items], [n for _, n, _ in items]
    most = max(16, NUMBERS // max(len(vocabulary), 1))
    tasks = CELLS * max(docs.sparkSession.sparkContext.defaultParallelism, 2)
    kind = item_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, rows = [Best(a, k) for a in asked], []

        def meet() -> None:
            block = Block(rows, weights, documents, length)
            for b in best:
                b.meet(block)
            rows.clear()

        for batch in common.small_batches(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[3]:
                    rows.append(row)
                if len(rows) == most:
                    meet()
        if rows:
            meet()
        for low in range(0, len(best), 256):
            part = best[low : low + 256]
            owner = np.repeat(np.arange(low, low + len(part)), [b.rows.shape[1] for b in part])
            found = np.concatenate([b.rows for b in part], axis=1)
            ids = pa.array(found[2], mask=found[1].astype(bool))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(rids, dtype=np.int64)[owner]), pa.array([names[i] for i in owner], arrow_type(kind)), pa.array(found[0]), ids, pa.array(found[3])], ["item_rid", "item_id", "score", "doc_id", "rid"])

    return forward.coalesce(tasks).mapInArrow(common.tidy(run), f"item_rid long, item_id {kind}, score long, doc_id long, rid long")


def arrow_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(kind, pa.string())


def ranked(docs: DataFrame, items: DataFrame, k: int = K, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Rows item_id, rank, doc_id, score: the k documents of highest score above 0 for every item, ties by ascending doc_id.

    Document ids are whole numbers, item ids whole numbers or else taken as strings. Documents without a term, null and
    empty ones among them, do not count at all; items without one find nothing. Repeated rows of either table are rows of
    their own; null ids come last among equal scores. An empty table gives an empty result. Other columns are left out.
    """
    spark, kind = docs.sparkSession, items.schema[item_id].dataType.simpleString()
    kind = kind if kind in ("bigint", "int", "smallint", "tinyint") else "string"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches):
            own = [sorted(terms(x or b"")) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.list_(pa.binary()))], ["rid", "item_id", "terms"])

    named = items.select(F.monotonically_increasing_id().alias("rid"), common.col(item_id).cast(kind).alias("item_id"), as_bytes(item_text).alias("text"))
    asked = common.materialize(named.mapInArrow(split, f"rid long, item_id {kind}, terms array<binary>").where("size(terms) > 0"), "lexical-items")
    total = asked.agg(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t) + 8))).first()[0] or 0
    blocks = -(-int(total) // QUERY_BYTES)
    found = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("rid"), F.lit(blocks)) == b).collect()  # QUERY_BYTES on average
        if block:
            part = search(docs, [(r["rid"], r["item_id"], r["terms"]) for r in block], k, text, doc_id, kind)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    order = Window.partitionBy("item_rid").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12(spark, sf_dir: str) -> DataFrame:
    return ranked(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
s AS (SELECT count(*)::BIGINT AS docs, sum(len(terms))::BIGINT AS length FROM d WHERE len(terms) > 0),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
t AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM t GROUP BY term) CROSS JOIN s),
h AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // length)))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN t USING (term) CROSS JOIN s GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM h WHERE score > 0 QUALIFY rank <= 50
"""
