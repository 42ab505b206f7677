"""BM25 over an inverted index.

The index lies in a folder. ``postings`` holds, by bucket of the term's hash, one row per term and block of documents: the
documents' places in the block, how often each holds the term, and what bounds the saturation any of them reaches. One more
bucket holds the ids and lengths of each block's documents, ``terms`` how many documents hold a term. A search reads the
bounds of its terms first. It scores the most promising blocks of each query, and then only those blocks whose bounds
reach the k-th score found there, so the result is exact. Contributions are whole millionths, so that sums do not depend
on their order. An index for one search holds postings of that search's terms only; lengths and numbers of documents are
those of all terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import scratch

K1, B, UNIT = 1.2, 0.75, 1_000_000
#: Documents in a block (65,536 at most), buckets of terms and parts of a bucket that are written apart, queries that meet a block together, blocks of a query that are scored at first.
BLOCK, BUCKETS, SPREAD, GROUP, SEEDS = 8192, 64, 4, 256, 4
#: Terms of documents, repeated ones once each, after which a block ends early, and bytes of text that are counted at once.
HELD, TEXTS = 1 << 21, 1 << 20
#: Bytes of all terms of a search up to which an index for it alone leaves other terms out.
ASKED = 1 << 22
#: The bucket of the blocks' documents, and an entry of a posting list.
DOCUMENTS, ENTRY = -1, np.dtype([("place", "<u2"), ("count", "<u4")])
#: Terms are runs of digits, ASCII letters, which are lower-cased, and everything beyond ASCII.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _parts(folded: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A text in parts that end between terms, so that a very long one is never held as a list of all its terms."""
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + size)
        end = len(folded) if end < 0 else end
        yield folded[at:end]
        at = end


def counted(text: bytes | None) -> Counter:
    out = Counter()
    for part in _parts((text or b"").translate(FOLD)):
        out.update(part.split())
    return out


def _bytes(name: str) -> Column:
    return scratch.col(name).cast("string").cast("binary")


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def saturation(count: np.ndarray, length: np.ndarray, average: float) -> np.ndarray:
    """How much a term's occurrences count in documents of these lengths."""
    return count * (K1 + 1) / (count + K1 * (1 - B + B * length / average))


def tallied(texts: list[bytes], vocabulary: dict[bytes, int], grows: bool, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many terms each text holds, how many distinct ones of the vocabulary, and text by text these and how often each occurs.

    A text of more than ``most`` bytes comes alone and is counted in parts.
    """
    if len(texts) == 1 and len(texts[0]) > most:
        all_ = counted(texts[0])
        words, length = list(all_), np.array([all_.total()])
        count = np.fromiter(all_.values(), np.int64, len(words))
        owner = np.zeros(len(words), dtype=np.int64)
    else:
        parts = [t.translate(FOLD).split() for t in texts]
        words, length, count = list(chain.from_iterable(parts)), np.array([len(p) for p in parts]), None
        owner = np.repeat(np.arange(len(texts)), length)
    found = (vocabulary.setdefault(w, len(vocabulary)) for w in words) if grows else map(vocabulary.get, words, repeat(-1))
    term = np.fromiter(found, np.int64, len(words))
    known, many = term >= 0, max(len(vocabulary), 1)
    key = owner * many + term
    if count is None:
        key, count = np.unique(key[known], return_counts=True)
    else:
        key, count = key[known], count[known]
    return length, np.bincount(key // many, minlength=len(texts)), (key % many).astype(np.int32), count.astype(np.uint32)


def _postings(docs: DataFrame, text: str, doc_id: str, only: list[bytes] | None) -> DataFrame:
    """Rows (term, block, n, most, least, entries), and one per block without a term but with its documents' ids and lengths.

    Of n entries ``most`` is the highest count and ``least`` the smallest length per count. Terms are all, or ``only`` these.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["term", "block", "n", "most", "least", "entries", "ids", "lengths"]

    def block(number: int, ids: list, vocabulary: dict[bytes, int], lengths: list[np.ndarray], sizes: list[np.ndarray], terms: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        length, size, term, count = (np.concatenate(x) for x in (lengths, sizes, terms, counts))
        own = pa.concat_arrays(ids)
        whole = pa.array([0, len(own)], pa.int32())
        of_ids, of_lengths = pa.ListArray.from_arrays(whole, own), pa.ListArray.from_arrays(whole, pa.array(length, pa.int64()))
        none = [pa.nulls(1, t) for t in (pa.int32(), pa.int64(), pa.float64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.array([number]), *none, of_ids, of_lengths], names)
        if not len(term):
            return
        place = np.repeat(np.arange(len(size), dtype=np.uint16), size)
        order = np.argsort(term, kind="stable")
        place, count = place[order], count[order]
        n = np.bincount(term, minlength=len(vocabulary))
        present = np.flatnonzero(n)
        n = n[present]
        ends = np.cumsum(n)
        starts = ends - n
        most, least = np.maximum.reduceat(count.astype(np.int64), starts), np.minimum.reduceat(length[place] / count, starts)
        entries = np.zeros(len(place), dtype=ENTRY)
        entries["place"], entries["count"] = place, count
        offsets = (np.concatenate([[0], ends]) * ENTRY.itemsize).astype(np.int32)
        lists = pa.Array.from_buffers(pa.binary(), len(present), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(entries.tobytes())])
        held = pa.array(list(vocabulary), pa.binary()).take(pa.array(present))
        number = pa.array(np.full(len(present), number))
        rows = pa.RecordBatch.from_arrays([held, number, pa.array(n, pa.int32()), pa.array(most), pa.array(least), lists, pa.nulls(len(present), of_ids.type), pa.nulls(len(present), of_lengths.type)], names)
        for low in range(0, len(present), 4096):
            yield rows.slice(low, 4096)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, many = TaskContext.get().partitionId() << 32, 0, 0
        fixed = {t: i for i, t in enumerate(only or [])}
        ids, vocabulary, parts = [], {} if only is None else fixed, []
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                # as many texts as can't lead beyond a block's end
                texts, room = [], min(TEXTS, 2 * (HELD - held))
                while at + len(texts) < batch.num_rows and len(texts) < BLOCK - many:
                    one = batch.column(1)[at + len(texts)].as_py() or b""
                    room -= len(one) + 1
                    if texts and room < 0:
                        break
                    texts.append(one)
                length, size, term, count = tallied(texts, vocabulary, only is None, TEXTS)
                # those with a term, by an id that does not hold on to its batch
                full = np.flatnonzero(length)
                if len(full):
                    ids.append(batch.column(0).take(pa.array(at + full)))
                    parts.append((length[full], size[full], term, count))
                many, held, at = many + len(full), held + len(term), at + len(texts)
                if many == BLOCK or held >= HELD:
                    yield from block(number, ids, vocabulary, *map(list, zip(*parts)))
                    number, held, many = number + 1, 0, 0
                    ids, vocabulary, parts = [], {} if only is None else fixed, []
        if many:
            yield from block(number, ids, vocabulary, *map(list, zip(*parts)))

    schema = f"term binary, block long, n int, most long, least double, entries binary, ids array<{kind}>, lengths array<bigint>"
    return docs.select(scratch.col(doc_id).alias("doc_id"), _bytes(text).alias("text")).mapInArrow(build, schema)


def build(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", only: list[bytes] | None = None) -> None:
    """Write the index of all documents that hold a term. Null and empty texts do not count; repeated rows each do.

    Documents are read once. Postings are made and dealt out by bucket once. Blocks of a term go to several parts of its
    bucket, so that a term which most documents hold is not the work of one task. With ``only``, postings of other terms
    are left out; as a search for these terms reads all that is left, it is written as it is made.
    """
    spark, kind = docs.sparkSession, docs.schema[doc_id].dataType.simpleString()
    raw = _postings(docs, text, doc_id, only).withColumn("bucket", F.when(F.col("term").isNull(), F.lit(DOCUMENTS)).otherwise(_bucket(F.col("term"))))
    if only is None:
        part = F.pmod(F.xxhash64("block"), F.lit(SPREAD))
        raw.repartition("bucket", part).sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/postings")
    else:
        raw.write.parquet(f"{path}/postings")
    rows = _rows(spark, path, kind)
    totals = rows.where(F.col("bucket") == DOCUMENTS).select(F.size("lengths").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("length"))
    documents, length = totals.agg(F.sum("n"), F.sum("length")).first()
    spark.createDataFrame([(documents or 0, length or 0, kind)], "documents long, length long, kind string").write.parquet(f"{path}/stats")
    rows.where(F.col("bucket") != DOCUMENTS).groupBy("bucket", "term").agg(F.sum("n").alias("df")).write.parquet(f"{path}/terms")


def _rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(f"term binary, block long, n int, most long, least double, entries binary, ids array<{kind}>, lengths array<bigint>, bucket int").parquet(f"{path}/postings")


def split(queries: DataFrame, text: str, query_id: str) -> DataFrame:
    """(item, item_id, terms): every query row with its terms, once each."""
    kind = queries.schema[query_id].dataType.simpleString()

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(counted(x)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(terms, pa.list_(pa.binary()))], ["item", "item_id", "terms"])

    named = queries.select(F.monotonically_increasing_id().alias("item"), scratch.col(query_id).alias("item_id"), _bytes(text).alias("text"))
    return scratch.written(named.mapInArrow(own, f"item long, item_id {kind}, terms array<binary>"), "bm25-queries")


class Index:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.documents, self.length, self.kind = spark.read.parquet(f"{path}/stats").first()
        rows = _rows(spark, path, self.kind)
        self.postings = rows.where(F.col("bucket") != DOCUMENTS).drop("ids", "lengths")
        self.blocks = rows.where(F.col("bucket") == DOCUMENTS).select("block", "ids", "lengths")
        self.average = self.length / max(self.documents, 1)

    @property
    def terms(self) -> DataFrame:
        return self.spark.read.schema("bucket int, term binary, df long").parquet(f"{self.path}/terms")

    def asked(self, rows: DataFrame) -> DataFrame:
        """(item, item_id, grp, bucket, term, idf): the known terms of every row of ``split``."""
        groups = F.lit(-(-max(rows.count(), 1) // GROUP))
        each = rows.select("item", "item_id", F.pmod(F.xxhash64("item"), groups).alias("grp"), F.explode("terms").alias("term")).withColumn("bucket", _bucket(F.col("term")))
        n = F.lit(float(self.documents))
        df = F.col("df").cast("double")
        return scratch.written(each.join(self.terms, ["bucket", "term"]).withColumn("idf", F.log(1 + (n - df + 0.5) / (df + 0.5))).drop("df"), "bm25-asked")

    def scored(self, pairs: DataFrame, asked: DataFrame, k: int, kind: str) -> DataFrame:
        """(item, doc_id, score): the k best documents of every pair of a query and a block.

        A block's ids, its queries and the postings these ask for, each with the queries that do, meet in one task, one block and group of queries after the other.
        """
        average, row = self.average, "kind int, items array<bigint>, idf double, entries binary"
        empty = {f.split()[0]: F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in row.split(", ")}
        pairs = scratch.written(pairs, "bm25-pairs")
        needs = pairs.groupBy("grp", "block").agg(F.collect_list("item").alias("items"))
        cells = scratch.written(needs.select("grp", "block"), "bm25-cells")
        own = {"ids": F.lit(None).cast(f"array<{kind}>").alias("ids"), "lengths": F.lit(None).cast("array<bigint>").alias("lengths")}

        def shaped(df: DataFrame, number: int) -> DataFrame:
            columns = {**empty, **own, "kind": F.lit(number).alias("kind")}
            return df.select("grp", "block", *[F.col(c) if c in df.columns else v for c, v in columns.items()])

        hosts = shaped(self.blocks.join(scratch.small(cells), "block"), 0)
        used = scratch.written(asked.groupBy("grp", "bucket", "term").agg(F.collect_list("item").alias("items"), F.first("idf").alias("idf")), "bm25-terms")
        guests = self.postings.select("bucket", "term", "block", "entries").join(scratch.small(used), ["bucket", "term"]).join(scratch.small(cells), ["grp", "block"], "left_semi")
        dealt = hosts.unionByName(shaped(needs, 1)).unionByName(shaped(guests, 2)).repartition("grp", "block").sortWithinPartitions("grp", "block", "kind")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, lengths, items, scores, rank = None, None, {}, None, None

            def best() -> Iterator[pa.RecordBatch]:
                names = np.array(list(items), dtype=np.int64)
                for i in range(len(names)):
                    at = np.flatnonzero(scores[i])
                    if len(at) > k:
                        at = at[scores[i][at] >= np.partition(scores[i][at], -k)[-k]]
                    at = at[np.lexsort((rank[at], -scores[i][at]))[:k]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), names[i])), ids.take(pa.array(at)), pa.array(scores[i][at])], ["item", "doc_id", "score"])

            for batch in batches:
                cell = {n: batch.column(n) for n in ("items", "entries", "ids", "lengths")}
                idf = batch.column("idf").to_pylist()
                for r, what in enumerate(batch.column("kind").to_pylist()):
                    if what == 0:
                        if scores is not None:
                            yield from best()
                        ids, scores = cell["ids"][r].values, None
                        lengths = cell["lengths"][r].values.to_numpy().astype(np.float64)
                        rank = np.empty(len(ids), dtype=np.int64)
                        rank[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
                    elif what == 1:
                        items = {item: i for i, item in enumerate(cell["items"][r].as_py())}
                        scores = np.zeros((len(items), len(ids)), dtype=np.int64)
                    elif asking := [items[i] for i in cell["items"][r].as_py() if i in items]:
                        entries = np.frombuffer(cell["entries"][r].as_buffer(), ENTRY)
                        places = entries["place"].astype(np.intp)
                        adds = np.floor(UNIT * (idf[r] * saturation(entries["count"].astype(np.float64), lengths[places], average))).astype(np.int64)
                        if 8 * len(places) > len(ids):  # whole rows are added up faster than picked places
                            whole = np.zeros(len(ids), dtype=np.int64)
                            whole[places] = adds
                            for i in asking:
                                scores[i] += whole
                        else:
                            for i in asking:
                                scores[i, places] += adds
            if scores is not None:
                yield from best()

        return dealt.mapInArrow(run, f"item long, doc_id {kind}, score long")

    def search(self, queries: DataFrame, k: int = 10, text: str = "text", query_id: str = "item_id") -> DataFrame:
        """Rows query_id, rank, doc_id, score: the k documents of highest score above 0, ties by ascending id, null ids last.

        Every row of queries is a query of its own; one without a known term finds nothing.
        """
        return self.found(split(queries, text, query_id), k)

    def found(self, rows: DataFrame, k: int) -> DataFrame:
        """The search for rows of ``split``."""
        kind = self.kind
        asked = self.asked(rows)
        few = scratch.small(asked)
        reached = (K1 + 1) / (1 + K1 * ((1 - B) / F.col("most") + B * F.col("least") / F.lit(self.average)))  # of no entry higher
        bound = F.ceil(F.col("idf") * reached * UNIT + 1).alias("bound")
        bounds = self.postings.select("bucket", "term", "block", "most", "least").join(few, ["bucket", "term"]).select("item", "grp", "block", bound)
        bounds = scratch.written(bounds.groupBy("item", "grp", "block").agg(F.sum("bound").alias("bound")).where("bound > 0"), "bm25-bounds")
        ranked = bounds.withColumn("n", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "block")))
        first = scratch.written(ranked.where(F.col("n") <= SEEDS).drop("n"), "bm25-first")
        begun = scratch.written(self.scored(first.select("item", "grp", "block"), asked, k, kind), "bm25-begun")
        by_score = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        floors = scratch.written(begun.withColumn("n", F.row_number().over(by_score)).where(F.col("n") == k).select("item", F.col("score").alias("floor")), "bm25-floors")
        rest = bounds.join(scratch.small(floors), "item", "left").where("bound >= coalesce(floor, 0)").join(scratch.small(first.select("item", "block")), ["item", "block"], "left_anti")
        found = begun.unionByName(self.scored(rest.select("item", "grp", "block"), asked, k, kind))
        names = scratch.written(asked.select("item", F.col("item_id").alias("query_id")).distinct(), "bm25-names")
        top = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
        return top.join(scratch.small(names), "item").select("query_id", "rank", "doc_id", (F.col("score") / UNIT).alias("score"))


def search(docs: DataFrame, queries: DataFrame, k: int = 10, text: str = "text", doc_id: str = "doc_id", query_text: str = "text", query_id: str = "item_id") -> DataFrame:
    """Index the documents in the shared folder and search them. To search again, keep an index: ``build`` and ``Index``."""
    spark = docs.sparkSession
    path, rows = scratch.fresh(spark, "bm25-index"), split(queries, query_text, query_id)
    build(docs, path, text, doc_id, asked_terms(rows))
    return Index(spark, path).found(rows, k)


def asked_terms(rows: DataFrame) -> list[bytes] | None:
    """The distinct terms of rows of ``split``, if they are few enough to go to every task; else none."""
    terms = scratch.written(rows.select(F.explode("terms").alias("term")).distinct(), "bm25-words")
    size = terms.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0
    return [bytes(r["term"]) for r in terms.collect()] if size <= ASKED else None


def sql(docs: str, queries: str, k: int = 10) -> str:
    """CTEs that end in ``bm25``; docs and queries are tables (doc_id, text) and (query_id, text)."""
    words = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
b_d AS MATERIALIZED (SELECT doc_id, {words} AS terms FROM {docs}),
b_s AS (SELECT count(*)::DOUBLE AS n, sum(len(terms))::DOUBLE / count(*) AS average FROM b_d WHERE len(terms) > 0),
b_q AS (SELECT DISTINCT query_id, unnest({words}) AS term FROM {queries}),
b_t AS MATERIALIZED (SELECT doc_id, m, term, count(*)::DOUBLE AS c FROM (SELECT doc_id, len(terms)::DOUBLE AS m, unnest(terms) AS term FROM b_d) GROUP BY ALL),
b_w AS (SELECT term, ln(1 + (any_value(n) - count(*)::DOUBLE + 0.5) / (count(*)::DOUBLE + 0.5)) AS idf FROM b_t CROSS JOIN b_s GROUP BY term),
b_h AS (
  SELECT query_id, doc_id, sum(floor({UNIT} * (idf * (c * ({K1}::DOUBLE + 1) / (c + {K1}::DOUBLE * (1 - {B}::DOUBLE + {B}::DOUBLE * m / average)))))::BIGINT)::BIGINT AS score
  FROM b_q JOIN b_w USING (term) JOIN b_t USING (term) CROSS JOIN b_s GROUP BY query_id, doc_id),
bm25 AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score::DOUBLE / {UNIT} AS score
  FROM b_h WHERE score > 0 QUALIFY rank <= {k})"""
