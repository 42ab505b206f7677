"""Vector codes: four codebooks of 256 entries fitted by k-means, every nearest entry found by Exponion search.

Vectors lie in blocks together with their codes so far. To reassign a part, the exact distance to its previous entry is
taken first; an entry at least as near lies within twice that distance of the previous entry, so only the head of that
entry's list of neighbours, sorted by distance, is scanned. All distances are whole numbers, equal ones go to the lower
index. Each round writes the blocks with their new codes to a scratch table, adds up parts by entry there, and moves the
entries; the driver holds nothing but the codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024.0
#: Numbers in a block of vectors, and vectors that scan their lists together.
BLOCK_NUMBERS, SLICE = 1 << 19, 256
#: Components beyond this are held there.
MOST = 2.0**62
BLOCK = "ids array<bigint>, labels array<string>, kind string, data binary, codes binary"


def usable(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, x) with x = floor(SCALE * component); rows with null vectors, or null or non-finite components go."""
    v = common.col(vector)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    held = F.transform(v, lambda x: F.greatest(F.least(x.cast("double") * SCALE, F.lit(MOST)), F.lit(-MOST)))
    return vectors.where(fine).select(common.col(vec_id).cast("long").alias("vec_id"), common.col(label).cast("string").alias("label"), F.transform(held, lambda x: F.floor(x)).alias("x"))


def small_type(values: np.ndarray) -> np.ndarray:
    low, high = values.min(initial=0), values.max(initial=0)
    return values.astype(next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max))


def into_blocks(rows: DataFrame, dims: int) -> DataFrame:
    """BLOCKs of rows (vec_id, label, x), shorter vectors padded with zeros, all with code 0."""
    most = max(1, BLOCK_NUMBERS // dims)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, most):
            x = batch.column(2)
            data = np.zeros((batch.num_rows, dims), dtype=np.int64)
            data[np.arange(dims) < np.diff(x.offsets.to_numpy())[:, None]] = x.flatten().to_numpy(zero_copy_only=False)
            data = small_type(data)
            whole = pa.array([0, batch.num_rows], pa.int32())
            ids, labels = (pa.ListArray.from_arrays(whole, batch.column(c)) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array([data.dtype.str]), pa.array([data.tobytes()]), pa.array([bytes(PARTS * len(data))])], ["ids", "labels", "kind", "data", "codes"])

    return rows.select("vec_id", "label", "x").mapInArrow(common.tidy(build), BLOCK)


def contents(kind: str, data: bytes, codes: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    """The parts of a block's vectors, and their codes, part by part."""
    n = len(codes) // PARTS
    return np.split(np.frombuffer(data, kind).reshape(n, -1), PARTS, axis=1), np.frombuffer(codes, np.uint8).reshape(PARTS, n)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Row by row, one block at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(n)[i].as_py() for n in names)


def exact(*arrays: np.ndarray) -> tuple[np.ndarray, ...]:
    """The arrays as doubles if squared distances between their rows are exact in these, else as Python's whole numbers."""
    top = max((int(np.abs(a.astype(np.float64)).max(initial=0)) for a in arrays), default=0)
    fits = 4 * top * top * max(a.shape[-1] for a in arrays) < 2**52
    return tuple(a.astype(np.float64 if fits else object) for a in arrays)


class Codebook:
    """The entries of one part, and each entry's list of entries by distance from it."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        (e,) = exact(entries)
        norms = (e * e).sum(axis=1)
        apart = norms[:, None] + norms - 2 * (e @ e.T)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.sorted = np.take_along_axis(apart, self.order, axis=1)

    def assign(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of every row of x, and its squared distance. ``start``: the entry that each search begins at."""
        x, entries = exact(x, self.entries)
        norms, own = (entries * entries).sum(axis=1), (x * x).sum(axis=1)
        first = own + norms[start] - 2 * (x * entries[start]).sum(axis=1)
        code, distance = start.astype(np.uint8), first.copy()
        for s in np.unique(start):
            at = np.flatnonzero(start == s)
            # an entry as near to x as s is at most d(entry, x) + d(x, s) <= 2 d(x, s) from s; squared, in whole numbers
            reach = np.searchsorted(self.sorted[s], 4 * first[at], side="right")
            by = np.argsort(reach, kind="stable")
            for low in range(0, len(at), SLICE):
                rows = at[by[low : low + SLICE]]
                near = self.order[s, : reach[by[low : low + SLICE][-1]]]
                apart = own[rows, None] + norms[near] - 2 * (x[rows] @ entries[near].T)
                distance[rows] = apart.min(axis=1)
                code[rows] = np.where(apart == distance[rows, None], near, ENTRIES).min(axis=1)
        return code, distance


def reassign(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """The blocks with every part's nearest entry as its code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(e) for e in books]
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                parts, codes = contents(*next(rows_of([row], "kind", "data", "codes")))
                fresh = b"".join(b.assign(x, c)[0].tobytes() for b, x, c in zip(own, parts, codes, strict=True))
                yield pa.RecordBatch.from_arrays([*row.columns[:-1], pa.array([fresh])], row.schema.names)

    return blocks.mapInArrow(common.tidy(run), BLOCK)


def moved(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The entries after each took the componentwise floor of its parts' mean; entries without parts stay."""
    width = books[0].shape[1]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((PARTS, ENTRIES), dtype=np.int64)
        sums = [np.zeros((PARTS, ENTRIES, width), dtype=k) for k in (np.int64, object)]  # up to 32 bits a component, and more
        for kind, data, codes in rows_of(batches, "kind", "data", "codes"):
            wide = kind == "<i8"
            for p, (x, c) in enumerate(zip(*contents(kind, data, codes), strict=True)):
                order = np.argsort(c, kind="stable")
                entries, first = np.unique(c[order], return_index=True)
                sums[wide][p, entries] += np.add.reduceat(x[order].astype(object if wide else np.int64), first, axis=0)
                counts[p] += np.bincount(c, minlength=ENTRIES)
        part, entry = np.nonzero(counts)
        total = [str(a + int(b)) for a, b in zip(sums[0][part, entry].ravel().tolist(), sums[1][part, entry].ravel(), strict=True)]
        columns = [pa.array(np.repeat(v.astype(np.int32), width)) for v in (part, entry)]
        at = pa.array(np.tile(np.arange(width, dtype=np.int32), len(part)))
        yield pa.RecordBatch.from_arrays([*columns, at, pa.array(np.repeat(counts[part, entry], width)), pa.array(total, pa.string())], ["part", "entry", "at", "n", "total"])

    added = blocks.select("kind", "data", "codes").mapInArrow(common.tidy(add_up), "part int, entry int, at int, n long, total string")
    means = added.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = [e.copy() for e in books]
    for r in means.collect():  # one row per component of the codebooks
        out[r["part"]][r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return out


def measured(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) of every vector, its codes assigned anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(e) for e in books]
        for batch in batches:
            for i in range(batch.num_rows):
                parts, codes = contents(*next(rows_of([batch.slice(i, 1)], "kind", "data", "codes")))
                found = [b.assign(x, c) for b, x, c in zip(own, parts, codes, strict=True)]
                code = [bytes(c).hex() for c in np.stack([c for c, _ in found], axis=1)]
                error = sum(d.astype(object) for _, d in found)
                error = np.minimum(error, 2**63 - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, batch.column(1)[i].values, pa.array(code), pa.array(error)], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(common.tidy(run), "vec_id long, label string, code string, error long")


def vector_codes(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """Rows vec_id, code, error, label_error, codebooks_sha256 of every usable vector.

    Rows with a null vector, or null or non-finite components, go. Shorter vectors count as padded with zeros to the
    longest, and that to a multiple of four. Codebooks start from the smallest ids, null ids last, repeated ids by their
    vectors; fewer than 256 vectors make fewer entries. Repeated rows are rows of their own. Errors beyond 64 bits are
    held at the end of their range. An empty table gives an empty result. Other columns are left out.
    """
    rows = usable(vectors, vec_id, vector, label)
    longest = rows.agg(F.max(F.size("x"))).first()[0]
    if longest is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    dims = PARTS * max(1, -(-longest // PARTS))
    head = rows.orderBy(F.asc_nulls_last("vec_id"), "x").select("x").limit(ENTRIES).collect()
    start = np.array([r["x"] + [0] * (dims - len(r["x"])) for r in head], dtype=np.int64)
    books = np.split(start, PARTS, axis=1)
    blocks = common.materialize(into_blocks(rows, dims), "code-blocks")
    for _ in range(rounds):
        fresh = common.materialize(reassign(blocks, books), "code-blocks")
        common.discard(blocks)
        blocks, books = fresh, moved(fresh, books)
    done = common.materialize(measured(blocks, books), "codes")
    common.discard(blocks)
    digest = hashlib.sha256(",".join(str(x) for e in books for x in e.ravel().tolist()).encode()).hexdigest()
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    sums = common.materialize(done.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error")), "label-errors")
    return done.join(common.small_side(sums), F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13(spark, sf_dir: str) -> DataFrame:
    return vector_codes(common.table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The rounds written out: every part meets every entry of its codebook."""
    near = """a{i} AS MATERIALIZED (
  SELECT r, part, any_value(x) AS x, min((list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c))::HUGEINT * 256 + entry) AS best
  FROM p JOIN c{i} USING (part) GROUP BY r, part)"""
    move = """c{j} AS MATERIALIZED (
  SELECT part, entry, coalesce(u.c, c{i}.c) AS c
  FROM c{i} LEFT JOIN (
    SELECT part, entry, list(m ORDER BY pos) AS c FROM (
      SELECT part, (best % 256)::BIGINT AS entry, pos, floor(sum(x[pos]) / count(*)) AS m
      FROM a{i}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS pos) GROUP BY ALL)
    GROUP BY ALL) u USING (part, entry))"""
    steps = ",\n".join(near.format(i=i) + ",\n" + move.format(i=i, j=i + 1) for i in range(ROUNDS))
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT r, part, e[part * (len(e) // 4) + 1 : (part + 1) * (len(e) // 4)] AS x
  FROM v, (SELECT unnest(range(4)) AS part)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= 256),
{steps},
{near.format(i=ROUNDS)},
codes AS (
  SELECT vec_id, label, string_agg(format('{{:02x}}', (best % 256)::BIGINT), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error
  FROM a{ROUNDS} JOIN v USING (r) GROUP BY r, vec_id, label),
entries AS (SELECT part, entry, generate_subscripts(c, 1) AS pos, unnest(c)::BIGINT AS m FROM c{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(m::VARCHAR, ',' ORDER BY part, entry, pos)) FROM entries) AS codebooks_sha256
FROM codes
"""


OP13_SQL = _sql()
